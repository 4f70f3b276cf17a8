"""Scores, conflicts, actions and remediations of pages and sites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text, urls
from ..functions.dims import AUTHORITY_DOMAINS, AUTHORITY_TLDS, DESCRIPTION_LENGTH, SOCIAL_DOMAINS, TITLE_LENGTH
from .eligibility import header_values
from .search import schema_types

STATISTIC = r"(?i)\b\d+(?:[.,]\d+)*\s?(?:%|percent|million|billion|thousand|years?|months?|days?|hours?|kg|km|mm|cm|usd|eur|inr|\$|€|£)|[$€£]\s?\d+"
FACT = r"\d|\b(?:is|are|means|refers to)\b"
TECHNICAL = r"(?i)\b(?:ISO|IEC|ASTM|IEEE|ANSI|NIST|API|HTTP|JSON|XML|SQL|HTML|CSS|SDK|TLS|specification|standard|protocol|calibration|algorithm|parameter|compliance)\b"
AUTHORITY = r"(?i)\b(?:according to|research|study|studies|certified|accredited|published|expert|professor|ph\.?d|peer[- ]reviewed|official)\b"
QUESTION = r"(?i)^(what|how|why|who|when|where|is|are|can|which|difference)\b|\?"


def _count(c: Column, pattern: str) -> Column:
    return F.regexp_count(F.coalesce(c, F.lit("")), F.lit(pattern))


def citability(parsed: DataFrame) -> DataFrame:
    """Per page: seven capped sub-scores (sources, quotes, statistics, answer_first, passage, technical, tone) and their sum
    in percent of 38."""
    p = parsed.where("p is not null").select("site", "url", "p.*")
    bare = lambda h: F.regexp_replace(h, "^www\\.", "")
    hosts = F.filter(F.transform(F.filter("links", lambda l: l["href"].startswith("http")), lambda l: bare(urls.host(l["href"]))), lambda h: h != bare(F.col("site")))
    trusted = lambda h: F.concat(F.lit("."), F.element_at(F.split(h, r"\."), -1)).isin(*AUTHORITY_TLDS) | _any(F.contains, h, AUTHORITY_DOMAINS)
    auth = F.size(F.filter(hosts, trusted))
    words = F.greatest(text.word_count(F.col("visible_text")), F.lit(1))
    density = F.round(_count(F.col("visible_text"), STATISTIC) / words * 1000, 2)
    h2 = F.filter("headings", lambda h: h["level"] == 2)
    answered = F.filter(h2, lambda h: F.exists("units", lambda u: (u["heading"] == h["text"]) & F.substring(u["text"], 1, 150).rlike(FACT)))
    first = F.when(F.size(h2) > 0, F.round(F.size(answered) / F.size(h2), 2)).otherwise(0.0)
    paras = F.filter("blocks", lambda b: text.word_count(b) >= 15)
    dense = F.filter(paras, lambda b: text.word_count(b).between(50, 160) & b.rlike(r"\b\d+"))
    passage = F.when(F.size(paras) > 0, F.round(F.size(dense) / F.size(paras), 2)).otherwise(0.0)
    cap = lambda c, n: F.least(c.cast("int"), F.lit(n))
    has_author = F.coalesce("author", F.lit("")) != ""
    parts = {
        "sources": cap(auth * 2 + F.when(F.size(hosts) > 0, 1).otherwise(0), 6), "quotes": cap(F.col("blockquotes") * 3, 6), "statistics": cap(F.floor(density * 2), 6), "answer_first": cap(F.floor(first * 7), 5),
        "passage": cap(F.floor(passage * 8), 5), "technical": cap(F.floor(_count(F.col("visible_text"), TECHNICAL) / 5) + F.col("code_blocks") * 2, 5), "tone": cap(_count(F.col("visible_text"), AUTHORITY) + F.when(has_author, 2).otherwise(0), 5),
    }
    out = p.select("site", "url", *[c.alias(n) for n, c in parts.items()], density.alias("density"), first.alias("answer_first_ratio"), passage.alias("passage_ratio"), auth.alias("authoritative"), F.size(hosts).alias("external"), F.transform(F.filter(h2, lambda h: h["text"].rlike(QUESTION)), lambda h: h["text"]).alias("questions"))
    return out.withColumn("citability", F.bround(sum(F.col(n) for n in parts) / 38.0 * 100, 0).cast("int"))


def _any(test, c: Column, values) -> Column:
    out = F.lit(False)
    for v in values:
        out = out | test(c, F.lit(v))
    return out


def grade(score: Column) -> Column:
    return F.when(score >= 80, "A").when(score >= 65, "B").when(score >= 50, "C").when(score >= 35, "D").otherwise("F")


def trust(parsed: DataFrame, cite: DataFrame) -> DataFrame:
    """Per page: five layers of five points (technical, identity, social, academic, consistency), percent and grade."""
    h = F.col("response_headers")
    has = lambda n: (F.size(header_values(h, n)) > 0).cast("int")
    p = parsed.where("p is not null").join(cite.select("site", "url", "density", "passage_ratio", "authoritative", "external"), ["site", "url"])
    types = schema_types()
    link = lambda pattern: F.exists("p.links", lambda l: F.lower(l["href"]).rlike(pattern) | F.lower(l["text"]).rlike(pattern)).cast("int")
    frames = F.contains(F.lower(F.array_join(header_values(h, "content-security-policy"), ";")), F.lit("frame-ancestors"))
    same = F.size(F.array_distinct(F.flatten(F.transform("p.jsonld", lambda s: F.regexp_extract_all(F.regexp_extract(s, r'"sameAs"\s*:\s*(\[[^\]]*\]|"[^"]*")', 1), F.lit(r'"(https?://[^"]+)"'), F.lit(1))))))
    brand = F.element_at(F.split(urls.root_domain(F.col("site")), r"\."), 1)
    social = F.exists("p.links", lambda l: _any(F.contains, urls.host(l["href"]), SOCIAL_DOMAINS)).cast("int")
    b = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    v = F.col("p.visible_text")
    layers = {
        "technical": 2 * b(F.lower("url").startswith("https://")) + has("strict-transport-security") + has("content-security-policy") + b((F.size(header_values(h, "x-frame-options")) > 0) | frames),
        "identity": b(F.exists(types, lambda t: t.rlike("Organization|LocalBusiness|Corporation"))) + b(F.coalesce("p.author", F.lit("")) != "") + link("about") + link("contact") + b(F.contains(F.lower(F.concat_ws(" ", "p.title", F.array_join("p.h1", " "))), brand)),
        "social": b(same > 0) + b(same >= 3) + social + b(v.rlike(r"(?i)\b(reviews?|testimonials?|ratings?)\b")) + link("wikipedia|wikidata"),
        "academic": b((F.col("density") >= 5) | (F.col("passage_ratio") > 0.1)) + b(F.col("external") >= 2) + b(F.col("authoritative") > 0) + b(F.exists("p.headings", lambda x: F.lower(x["text"]).rlike("references|sources|citations|bibliography"))) + b(_count(v, STATISTIC) >= 3),
        "consistency": link("privacy") + link("terms") + b(v.rlike(r"(?i)(©|copyright).{0,20}\b(19|20)\d{2}")) + b(F.size("p.canonical") > 0) + b(v.rlike(r"(?i)\b(updated|published|last modified)\b")),
    }
    out = p.select("site", "url", *[F.least(c, F.lit(5)).alias(n) for n, c in layers.items()])
    out = out.withColumn("trust", F.bround(sum(F.col(n) for n in layers) / 25.0 * 100, 0).cast("int"))
    return out.withColumn("grade", grade(F.col("trust")))


def technical_score(parsed: DataFrame) -> DataFrame:
    """site, url, technical_score: 100 less 25 for no title or 10 for its length, 20 or 10 for the description, 15 for other
    than one H1, 10 for under 80 % of images with alt, 20 without structured data; 10 at least."""
    p = parsed.where("p is not null")
    t, d = F.length(F.trim("p.title")), F.length(F.trim(F.coalesce(F.col("p.meta").getItem("description"), F.lit(""))))
    n = F.size("p.images")
    alt = F.size(F.filter("p.images", lambda i: F.trim(F.coalesce(i["alt"], F.lit(""))) != ""))
    off = (
        F.when(t == 0, 25).when(~t.between(*TITLE_LENGTH), 10).otherwise(0) + F.when(d == 0, 20).when(~d.between(*DESCRIPTION_LENGTH), 10).otherwise(0)
        + F.when(F.size(F.filter("p.headings", lambda h: h["level"] == 1)) != 1, 15).otherwise(0) + F.when((n > 0) & (alt / F.greatest(n, F.lit(1)) < 0.8), 10).otherwise(0) + F.when(F.size(schema_types()) == 0, 20).otherwise(0)
    )
    return p.select("site", "url", F.greatest(F.lit(100) - off, F.lit(10)).alias("technical_score"))


def keyword_score(traffic: Column) -> Column:
    return F.when(traffic >= 100_000, 95).when(traffic >= 25_000, 80).when(traffic >= 5_000, 65).when(traffic >= 500, 50).otherwise(35)


def health(scores: DataFrame) -> DataFrame:
    """scores (technical_score, citability, trust, performance, keyword; the last two may be null) with health and mode.

    Weights by what there is: 30/25/20/15/10 with all; 35/30/25/-/10 without performance; 35/30/20/15/- without
    keywords; 44/37/19 with neither. Rounded half to even.
    """
    t, g, r, p, k = (F.col(c).cast("double") for c in ("technical_score", "citability", "trust", "performance", "keyword"))
    mode = F.when(k.isNotNull() & p.isNotNull(), "5_engine").when(k.isNotNull(), "4_engine_keyword").when(p.isNotNull(), "4_engine").otherwise("3_engine")
    value = F.when(mode == "5_engine", t * 0.30 + g * 0.25 + r * 0.20 + p * 0.15 + k * 0.10).when(mode == "4_engine_keyword", t * 0.35 + g * 0.30 + r * 0.25 + k * 0.10).when(mode == "4_engine", t * 0.35 + g * 0.30 + r * 0.20 + p * 0.15).otherwise(t * 0.44 + g * 0.37 + r * 0.19)
    return scores.withColumn("health", F.bround(value, 0).cast("int")).withColumn("mode", mode)


def merged(static: DataFrame, rendered: DataFrame | None) -> DataFrame:
    """Per page, the rendered value of each field where there is one, else the static one."""
    if rendered is None:
        return static
    r = rendered.select("site", "url", F.col("p").alias("_r"))
    return static.join(r, ["site", "url"], "left").withColumn("p", F.coalesce("_r", "p")).drop("_r")


def _rows(rules, *names) -> Column:
    return F.filter(F.array(*[F.when(F.coalesce(cond, F.lit(False)), F.struct(*[F.lit(v).alias(n) for n, v in zip(names, values, strict=True)])) for cond, *values in rules]), lambda x: x.isNotNull())


def conflicts(wide: DataFrame) -> DataFrame:
    """site, url, category, severity of contradictions between sources.

    wide has one row a page: p and rendered (parsed structs), agents (verdict of robots.txt by crawler), llms_txt,
    citability, mixed_content, alignment, noindex, blocked, unsupported_topics, disagreements (names of fields),
    contradicted_claims, visual_only (images that hide an answer), citation_mismatch; what is missing may be null.
    """
    c = lambda name, kind: (F.col(name) if name in wide.columns else F.lit(None)).cast(kind)
    bot = lambda name, status: c("agents", "map<string,string>").getItem(name) == status
    fields = c("disagreements", "array<string>")
    p = F.col("p")
    rules = [
        (bot("OAI-SearchBot", "DISALLOWED") & bot("GPTBot", "ALLOWED"), "AI_CRAWLER_MISCONFIG", "HIGH"),
        (bot("Googlebot", "DISALLOWED") & bot("Google-Extended", "ALLOWED"), "AI_CRAWLER_MISCONFIG", "HIGH"),
        ((c("citability", "int") >= 50) & ~c("llms_txt", "boolean"), "AI_DISCOVERY_GAP", "LOW"),
        (c("mixed_content", "boolean"), "MIXED_CONTENT_SECURITY", "HIGH"),
        (c("alignment", "string") == "DIVERGENT_IDENTITY_SUSPECTED", "DIVERGENT_ORGANIZATION_IDENTITY", "MEDIUM"),
        (bot("OAI-SearchBot", "ALLOWED") & c("noindex", "boolean"), "AI_RETRIEVAL_DIRECTIVE_CONFLICT", "HIGH"),
        (c("blocked", "boolean") & F.array_contains(F.map_values(c("agents", "map<string,string>")), "ALLOWED"), "WAF_RETRIEVAL_BLOCK", "HIGH"),
        (c("unsupported_topics", "int") > 0, "CONTENT_ANSWERABILITY_GAP", "MEDIUM"),
        (F.exists(p["units"], lambda u: u["obscured"]), "SNIPPET_SUPPRESSION_CONFLICT", "HIGH"),
        (F.arrays_overlap(fields, F.array(F.lit("name"), F.lit("phone"))), "STRUCTURED_VISIBLE_DIVERGENCE", "HIGH"),
        (F.size(F.array_except(fields, F.array(F.lit("name"), F.lit("phone")))) > 0, "STRUCTURED_VISIBLE_DIVERGENCE", "MEDIUM"),
        (c("contradicted_claims", "int") > 0, "ON_SITE_CLAIM_CONTRADICTION", "HIGH"),
        (c("visual_only", "int") > 0, "MULTIMODAL_INFORMATION_GAP", "MEDIUM"),
        (p["name_clashes"] > 0, "ACTION_ACCESSIBLE_NAME_MISMATCH", "HIGH"),
        (_diverging_actions(p), "STRUCTURED_ACTION_CONTROL_CONFLICT", "MEDIUM"),
        (c("citation_mismatch", "int") > 0, "EXTERNAL_CITATION_MATERIAL_MISMATCH", "HIGH"),
    ]
    if "rendered" in wide.columns:
        d = F.col("rendered")
        rules += [
            (F.size(F.array_except(schema_types("rendered"), schema_types("p"))) > 0, "CLIENT_RENDERED_SCHEMA", "HIGH"),
            ((p["title"] != "") & (d["title"] != "") & (p["title"] != d["title"]), "DOM_HYDRATION_DIVERGENCE", "MEDIUM"),
            ((F.size(p["h1"]) == 0) & (F.size(d["h1"]) > 0), "CSR_HEADING_DEPENDENCY", "MEDIUM"),
            ((p["body_words"] < 50) & (text.word_count(d["main_text"]) >= 250), "CLIENT_RENDERED_CONTENT", "HIGH"),
        ]
    return wide.select("site", "url", F.explode(_rows(rules, "category", "severity")).alias("x")).select("site", "url", "x.*")


def _diverging_actions(p: Column) -> Column:
    """Whether declared data sends an action elsewhere than a search or plain form of the page does."""
    stem = lambda u: F.regexp_replace(F.regexp_replace(u, r"[?].*$", ""), "/+$", "")
    declared = F.filter(p["jsonld"], lambda t: t.rlike(r'"@type"\s*:\s*"\w*Action"'))
    targets = F.flatten(F.transform(declared, lambda t: F.regexp_extract_all(t, F.lit(r'"(?:target|urlTemplate)"\s*:\s*"([^"]+)"'), F.lit(1))))
    targets = F.filter(F.transform(targets, lambda t: stem(F.lower(t))), lambda t: t != "")
    forms = F.filter(p["forms"], lambda f: f["purpose"].isin("SEARCH_FORM", "FORM_CONTROL"))
    ends = F.filter(F.transform(forms, lambda f: stem(f["action"])), lambda e: e != "")
    return F.exists(targets, lambda t: F.exists(ends, lambda e: ~F.contains(t, e) & ~F.contains(e, t)))


def provenance(wide: DataFrame) -> DataFrame:
    """site, url, fact, source, nature: where each measured value of a page comes from. wide as for conflicts."""
    p = F.col("p")
    tags = [("title", "static_html", p["title"]), ("meta_description", "static_html", p["meta"].getItem("description")), ("h1", "static_html", F.array_join(p["h1"], " | ")), ("canonical", "static_html", F.array_join(p["canonical"], " | ")), ("schema_types", "structured_data", F.array_join(schema_types(), ",")), ("words", "main_content", text.word_count(p["main_text"]).cast("string")), ("images", "static_html", F.size(p["images"]).cast("string")), ("links", "static_html", F.size(p["links"]).cast("string"))]
    rows = F.array(*[F.struct(F.lit(n).alias("fact"), F.lit(s).alias("source"), F.when(F.coalesce(v, F.lit("")) == "", "UNAVAILABLE").otherwise("OBSERVED").alias("nature"), v.alias("value")) for n, s, v in tags])
    return wide.where("p is not null").select("site", "url", F.explode(rows).alias("x")).select("site", "url", "x.*")


def actions(wide: DataFrame) -> DataFrame:
    """site, url, priority, action, area: what to do, most urgent first. wide has p and, where known, conflicts (HIGH or
    CRITICAL), technical_trust, ttfb_ms, llms_txt, answer_first_ratio, security (worst severity), accessibility_critical,
    tier, placeholders, alignment, empty_anchors, generic_anchors."""
    c = lambda name: F.col(name) if name in wide.columns else F.lit(None)
    p = F.col("p")
    t, d, h1 = F.length(F.trim(p["title"])), F.length(F.coalesce(p["meta"].getItem("description"), F.lit(""))), F.size(F.filter(p["headings"], lambda h: h["level"] == 1))
    types = schema_types()
    rules = [
        (c("conflicts").cast("int") > 0, 1, "Settle the contradictions between sources.", "conflicts"), (c("security") == "CRITICAL", 1, "Close the critical security findings.", "security"), (c("security") == "HIGH", 2, "Close the severe security findings.", "security"),
        (c("accessibility_critical").cast("int") > 0, 2, "Mend the critical accessibility findings.", "accessibility"), (~t.between(*TITLE_LENGTH), 2, "Give the page a title of 30 to 65 characters.", "on_page"), (~d.between(*DESCRIPTION_LENGTH), 3, "Give the page a description of 110 to 165 characters.", "on_page"),
        (h1 > 1, 3, "Keep one H1.", "on_page"), (h1 == 0, 2, "Add an H1.", "on_page"), (F.size(types) == 0, 2, "Add structured data.", "schema"), (~F.exists(types, lambda x: x.rlike("Organization|LocalBusiness")), 3, "Declare the organization.", "schema"),
        (c("technical_trust").cast("int") < 5, 3, "Send the missing security headers.", "trust"), (c("ttfb_ms").cast("double") > 1200, 2, "Answer faster.", "performance"), (~c("llms_txt").cast("boolean"), 4, "Offer an llms.txt.", "discovery"),
        (c("answer_first_ratio").cast("double") < 0.3, 3, "Answer first under each heading.", "content"), ((c("tier") == "EMPTY") | (F.size(c("placeholders").cast("array<string>")) > 0), 1, "Replace empty or placeholder text.", "content"), (c("alignment") == "DIVERGENT_IDENTITY_SUSPECTED", 2, "Use one name for the organization.", "entity"),
        (c("empty_anchors").cast("int") > 0, 3, "Name the links without text.", "links"), (c("generic_anchors").cast("int") >= 5, 4, "Say in link texts where links lead.", "links"),
    ]
    return wide.where("p is not null").select("site", "url", F.explode(_rows(rules, "priority", "action", "area")).alias("x")).select("site", "url", "x.*")


def remediations(wide: DataFrame) -> DataFrame:
    """site, url, remediation, classification: fixes that are safe to make, or need a person. wide as for actions."""
    c = lambda name: F.col(name) if name in wide.columns else F.lit(None)
    p = F.col("p")
    alts = F.size(F.filter(p["images"], lambda i: i["alt"].isNull()))
    rules = [
        (F.trim(p["title"]) == "", "TITLE_MISSING", "AUTO_SAFE"), (F.coalesce(p["meta"].getItem("description"), F.lit("")) == "", "DESCRIPTION_MISSING", "HUMAN_REVIEW"), (F.size(p["canonical"]) == 0, "CANONICAL_MISSING", "AUTO_SAFE"), (alts > 0, "IMAGE_ALT", "HUMAN_REVIEW"),
        (~c("robots_txt").cast("boolean"), "ROBOTS_MISSING", "AUTO_SAFE"), (c("alignment") == "DIVERGENT_IDENTITY_SUSPECTED", "SCHEMA_DIVERGENCE", "HUMAN_REVIEW"), (p["unlabelled"] > 0, "LABEL_MISSING", "AUTO_SAFE"),
        (c("csp_missing").cast("boolean"), "CSP_MISSING", "HUMAN_REVIEW"), (c("hsts_missing").cast("boolean"), "HSTS_MISSING", "AUTO_SAFE"), (c("empty_anchors").cast("int") > 0, "ANCHOR_EMPTY", "HUMAN_REVIEW"), (c("unsupported_topics").cast("int") > 0, "ANSWER_UNSUPPORTED", "HUMAN_REVIEW"),
    ]
    return wide.where("p is not null").select("site", "url", F.explode(_rows(rules, "remediation", "classification")).alias("x")).select("site", "url", "x.*")


def ci_policy(fixes: DataFrame, max_findings: int = 0, failing: tuple[str, ...] = ("AUTO_SAFE",)) -> DataFrame:
    """site, findings, failing, passed: a site fails with a finding of a failing class, or over max_findings."""
    g = fixes.groupBy("site").agg(F.count("*").alias("findings"), F.count_if(F.col("classification").isin(*failing)).alias("failing"))
    return g.withColumn("passed", (F.col("failing") == 0) & (F.col("findings") <= max_findings))


def fixes(parsed: DataFrame) -> DataFrame:
    """site, url, meta_tags, jsonld, llms_line: texts to add to a page."""
    p = parsed.where("p is not null").select("site", "url", "p.*")
    esc = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit('"'), F.lit("&quot;")), F.lit("<"), F.lit("&lt;"))
    title = F.when(F.trim("title") != "", F.col("title")).otherwise(F.coalesce(F.try_element_at("h1", F.lit(1)), F.col("site")))
    desc = F.coalesce(F.col("meta").getItem("description"), text.snippet(F.col("main_text"), 160))
    tags = F.format_string('<title>%s</title>\n<meta name="description" content="%s">\n<link rel="canonical" href="%s">', esc(title), esc(desc), F.col("url"))
    ld = F.to_json(F.struct(F.lit("https://schema.org").alias("@context"), F.lit("WebPage").alias("@type"), title.alias("name"), F.col("url").alias("url"), desc.alias("description")))
    return p.select("site", "url", tags.alias("meta_tags"), ld.alias("jsonld"), F.format_string("- [%s](%s): %s", title, F.col("url"), desc).alias("llms_line"))


def robots_text(bots: DataFrame, sitemap: str | None = None) -> DataFrame:
    """One row, content: a robots.txt that lets search crawlers in and keeps training crawlers out."""
    block = F.concat(F.lit("User-agent: "), "agent", F.when(F.col("purpose") == "ai_training", F.lit("\nDisallow: /")).otherwise(F.lit("\nAllow: /")))
    lines = bots.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("category", "agent", block.alias("b")))), lambda x: x["b"]), "\n\n").alias("content"))
    tail = "\n\nUser-agent: *\nAllow: /" + (f"\n\nSitemap: {sitemap}" if sitemap else "") + "\n"
    return lines.withColumn("content", F.concat("content", F.lit(tail)))


def compare(scores: DataFrame, a: str, b: str) -> DataFrame:
    """metric, a, b, delta, winner of two sites' scores (site and numeric columns)."""
    metrics = [c for c, t in scores.dtypes if c != "site" and t in ("int", "bigint", "double", "float")]
    long = scores.where(F.col("site").isin(a, b)).unpivot(["site"], metrics, "metric", "value") if len({t for c, t in scores.dtypes if c in metrics}) == 1 else scores.where(F.col("site").isin(a, b)).select("site", *[F.col(m).cast("double") for m in metrics]).unpivot(["site"], metrics, "metric", "value")
    g = long.groupBy("metric").agg(F.max(F.when(F.col("site") == a, F.col("value"))).alias("a"), F.max(F.when(F.col("site") == b, F.col("value"))).alias("b"))
    return g.withColumn("delta", F.col("a") - F.col("b")).withColumn("winner", F.when(F.col("delta") > 0, a).when(F.col("delta") < 0, b).when(F.col("delta") == 0, "tie"))


def gap_actions(sites: DataFrame, a: str, b: str) -> DataFrame:
    """category, points, priority, weaker, stronger: what the site with less health should do to catch up, most points
    first. sites (site, health, llms_txt, organization_schema, answer_first, technical_trust, security_gaps, ttfb_ms,
    referring_domains); what is null makes no action."""
    measures = [c for c in sites.columns if c != "site"]
    one = lambda name, tag: sites.where(F.col("site") == name).limit(1).select(*[F.col(c).alias(f"{tag}_{c}") for c in sites.columns])
    pair = one(a, "a").crossJoin(one(b, "b"))  # a row each
    less = F.col("a_health") <= F.col("b_health")
    pair = pair.select(*[F.when(less, F.col(f"a_{c}")).otherwise(F.col(f"b_{c}")).alias(f"w_{c}") for c in ("site", *measures)], *[F.when(less, F.col(f"b_{c}")).otherwise(F.col(f"a_{c}")).alias(f"s_{c}") for c in ("site", *measures)])
    known = lambda c, tag: F.col(f"{tag}_{c}") if c in measures else F.lit(None).cast("double")
    w, s = (lambda c: known(c, "w")), (lambda c: known(c, "s"))
    yes = lambda c: c.cast("boolean")
    rules = [
        (yes(s("llms_txt")) & ~yes(w("llms_txt")), "AI Discovery", 15, "HIGH"), (yes(s("organization_schema")) & ~yes(w("organization_schema")), "Structured Data", 12, "HIGH"),
        ((s("referring_domains") > w("referring_domains") * 2) & (s("referring_domains") > 10), "Authority & Backlinks", 12, "HIGH"), (s("answer_first") > w("answer_first") + 0.2, "GEO Optimization", 10, "MEDIUM"),
        ((s("technical_trust") > w("technical_trust")) & (w("security_gaps") > 0), "Technical Trust", 8, "MEDIUM"), (w("ttfb_ms") > s("ttfb_ms") + 400, "Performance", 8, "MEDIUM"),
    ]
    out = pair.select(F.col("w_site").alias("weaker"), F.col("s_site").alias("stronger"), F.explode(_rows(rules, "category", "points", "priority")).alias("x"))
    return out.select("x.*", "weaker", "stronger").orderBy(F.desc("points"), "category")


def console_summary(rows: DataFrame, top: int = 5) -> DataFrame:
    """Per page of search-console rows (query, page, clicks, impressions, position): sums, rate, weighted position, best queries."""
    order = F.struct((-F.col("clicks")).alias("c"), (-F.col("impressions")).alias("i"), "query")
    g = rows.groupBy("page").agg(
        F.sum("clicks").alias("clicks"), F.sum("impressions").alias("impressions"), F.sum(F.col("position") * F.col("impressions")).alias("w"), F.transform(F.slice(F.sort_array(F.collect_list(order)), 1, top), lambda x: x["query"]).alias("top_queries"),
    )
    return g.withColumn("ctr", F.col("clicks") / F.nullif(F.col("impressions"), F.lit(0))).withColumn("position", F.col("w") / F.nullif(F.col("impressions"), F.lit(0))).drop("w")
