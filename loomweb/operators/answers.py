"""Retrieval readiness, answer units, claims, multimodal assets and external answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text, urls
from ..plans.shared import keep
from .eligibility import directives, header_values, x_robots
from .entities import entity_name, phone_number

# Phrases of challenge pages.
CHALLENGES = ("checking your browser before accessing", "verify you are human", "please verify you are a human", "security check to access", "attention required! | cloudflare", "cf-challenge", "ddos protection by", "enable javascript and cookies to continue", "access denied", "recaptcha", "hcaptcha", "perimeterx", "datadome")


# --- retrieval ---


def waf(crawl: DataFrame) -> DataFrame:
    """site, url, blocked, provider, barrier: answers 403, 429 and 503, and challenge pages; a captcha in a full page
    (over 200 words) is only a form's. Needs raw_html or p."""
    h = F.col("response_headers")
    has = lambda n: F.size(header_values(h, n)) > 0
    server = F.lower(F.coalesce(F.try_element_at(header_values(h, "server"), F.lit(1)), F.lit("")))
    body = F.lower(F.coalesce(F.col("raw_html") if "raw_html" in crawl.columns else F.col("p.visible_text"), F.lit("")))
    full = (F.col("status_code") == 200) & (text.word_count(body) > 200)
    hit = F.lit(False)
    for c in CHALLENGES:
        found = F.contains(body, F.lit(c))
        hit = hit | ((found & ~full) if c in ("recaptcha", "hcaptcha") else found)
    provider = F.when(has("cf-ray") | has("cf-mitigated") | F.contains(server, F.lit("cloudflare")), "Cloudflare").when(has("x-amz-cf-id"), "AWS CloudFront").when(has("x-datadome"), "DataDome").when(has("x-px"), "PerimeterX").when(F.contains(server, F.lit("akamai")), "Akamai")
    status = F.col("status_code").isin(403, 429, 503)
    barrier = F.when(hit, "BOT_CHALLENGE").when(F.col("status_code") == 429, "RATE_LIMIT").when(status, "WAF_HTTP_STATUS")
    return crawl.select("site", "url", (status | hit).alias("blocked"), provider.alias("provider"), barrier.alias("barrier"))


def snippet_controls(parsed: DataFrame) -> DataFrame:
    """site, url, status, max_snippet, nosnippet_blocks: nosnippet prevails; of several max-snippet the least; 0 is none."""
    meta = F.col("p.meta")
    d = F.array_distinct(F.concat(*[directives(meta.getItem(k)) for k in ("robots", "googlebot", "bingbot")], x_robots(F.col("response_headers"))))
    limits = F.filter(F.transform(d, lambda x: F.regexp_extract(x, r"^max-snippet\s*:\s*(-?\d{1,9})$", 1).try_cast("int")), lambda n: n.isNotNull() & (n >= 0))
    least = F.array_min(limits).cast("int")
    no = F.arrays_overlap(d, F.array(F.lit("nosnippet"), F.lit("none"))) | (least == 0)
    return parsed.select("site", "url", F.when(F.coalesce(no, F.lit(False)), "NOSNIPPET").when(least.isNotNull(), "MAX_SNIPPET").otherwise("ALLOWED").alias("status"), least.alias("max_snippet"), F.coalesce("p.nosnippet", F.lit(0)).alias("nosnippet_blocks"))


def content_availability(raw: DataFrame, rendered: DataFrame) -> DataFrame:
    """site, url, raw_words, rendered_words, needs_rendering: over 50 words and a quarter of the text only in a browser.
    Words are tokens of two characters or more."""
    count = lambda c: F.size(F.filter(F.split(F.coalesce(c, F.lit("")), r"\s+"), lambda w: F.length(w) > 1))
    r = raw.select("site", "url", count(F.col("p.visible_text")).alias("raw_words"))
    b = rendered.select("site", "url", count(F.col("p.visible_text")).alias("rendered_words"))
    d = F.col("rendered_words") - F.col("raw_words")
    return r.join(b, ["site", "url"], "left").withColumn("needs_rendering", F.coalesce((d > 50) & (d > 0.25 * F.col("rendered_words")), F.lit(False)))


def retrieval(eligibility: DataFrame, barriers: DataFrame, matrix: DataFrame, bots: DataFrame) -> DataFrame:
    """site, url, agent, status of every page for every crawler: BLOCKED by a barrier, DISALLOWED by robots.txt or, for
    search crawlers, by noindex, else ALLOWED. matrix is a bot matrix by path; without a robots.txt all are allowed."""
    page = eligibility.select("site", "url", "indexability").join(barriers.select("site", "url", "blocked"), ["site", "url"], "left")
    page = page.withColumn("path", F.regexp_replace("url", "^[A-Za-z]+://[^/?#]*", "")).withColumn("path", F.when(F.col("path") == "", "/").otherwise(F.col("path")))
    each = page.crossJoin(F.broadcast(bots.select("agent", "purpose", "category")))  # the registry: some dozens
    j = each.join(matrix.select("site", "path", "agent", F.col("status").alias("robots")), ["site", "path", "agent"], "left")
    status = F.when(F.col("blocked"), "BLOCKED").when(F.col("robots") == "DISALLOWED", "DISALLOWED").when((F.col("indexability") == "NOINDEX") & (F.col("purpose") == "search_index"), "DISALLOWED").otherwise("ALLOWED")
    return j.select("site", "url", "agent", "purpose", "category", F.coalesce("robots", F.lit("NOT_APPLICABLE")).alias("robots"), status.alias("status"))


def retrieval_summary(r: DataFrame) -> DataFrame:
    return r.groupBy("site", "purpose").agg(F.count_distinct("url").alias("pages"), *[F.count_if(F.col("status") == s).alias(s.lower()) for s in ("ALLOWED", "DISALLOWED", "BLOCKED")])


# --- answer units ---

UNIT_ORDER = ("FAQ", "DEFINITION", "DIRECT_ANSWER", "PROCEDURE_STEPS", "TABLE", "SERVICE_DESCRIPTION", "REQUIREMENTS_ELIGIBILITY", "LIST", "LOCATION_CONTACT", "DATE_POLICY", "FACTUAL_STATEMENT", "EXAMPLE")
SCHEMA_UNITS = {"FAQPage": "FAQ", "Question": "FAQ", "HowTo": "PROCEDURE_STEPS", "Service": "SERVICE_DESCRIPTION", "Product": "SPECIFICATION", "PostalAddress": "LOCATION_CONTACT", "ContactPoint": "LOCATION_CONTACT"}


def answer_units(parsed: DataFrame) -> DataFrame:
    """site, url, key, type, secondary, heading, text: passages that answer something, each once; the key is ten hex digits
    of the MD5 of a passage's first 120 characters, and further types of it are secondary. Questions and answers, steps
    and descriptions in JSON-LD count as well."""
    from .search import schema_types

    dom = parsed.where("p is not null").select("site", "url", F.explode("p.units").alias("u")).select("site", "url", "u.pos", "u.kind", "u.heading", "u.text")
    kinds = F.create_map(*[F.lit(x) for kv in SCHEMA_UNITS.items() for x in kv])
    named = F.filter(F.transform(schema_types(), lambda t: F.struct(t.alias("t"), F.try_element_at(kinds, t).alias("k"))), lambda x: x["k"].isNotNull())
    sch = parsed.where("p is not null").select("site", "url", F.explode(named).alias("s"), F.array_join("p.jsonld", " ").alias("ld"))
    answers = F.regexp_extract("ld", r'"(?:text|description|streetAddress|telephone)"\s*:\s*"([^"]{4,400})"', 1)
    sch = sch.select("site", "url", F.lit(-1).alias("pos"), F.col("s.k").alias("kind"), F.col("s.t").alias("heading"), answers.alias("text")).where("text <> ''")
    u = dom.union(sch).withColumn("key", F.substring(F.md5(F.substring(F.lower(F.trim("text")), 1, 120)), 1, 10))
    order = F.array_position(F.array(*[F.lit(x) for x in UNIT_ORDER]), F.col("kind"))
    g = u.groupBy("site", "url", "key").agg(F.min_by(F.struct("kind", "heading", "text"), F.struct(F.when(F.col("pos") < 0, 0).otherwise(1), "pos", order)).alias("f"), F.sort_array(F.collect_set("kind")).alias("kinds"))
    return g.select("site", "url", "key", F.col("f.kind").alias("type"), F.array_remove("kinds", F.col("f.kind")).alias("secondary"), "f.heading", F.col("f.text").alias("text"))


def clarity(parsed: DataFrame, units: DataFrame) -> DataFrame:
    """Per page: whether a definition, a direct answer, steps, contact or table is there, and facts buried in long text."""
    has = lambda *k: F.count_if(F.col("type").isin(*k)) > 0
    g = units.groupBy("site", "url").agg(F.count("*").alias("units"), has("DEFINITION").alias("definition"), has("DIRECT_ANSWER", "FAQ").alias("direct_answer"), has("PROCEDURE_STEPS").alias("steps"), has("TABLE", "SPECIFICATION").alias("specification"), has("LOCATION_CONTACT").alias("contact"), F.count_if((text.word_count(F.col("text")) > 50) & F.col("text").rlike(r"\b\d+(\.\d+)?\s?%|\b(ISO|IEC|ASTM)\b")).alias("buried_facts"))
    out = parsed.where("p is not null").select("site", "url").join(g, ["site", "url"], "left").na.fill(0).na.fill(False)
    kinds = sum(F.col(c).cast("int") for c in ("definition", "direct_answer", "steps", "specification", "contact"))
    return out.withColumn("status", F.when(kinds >= 3, "OBSERVED").when(kinds > 0, "PARTIAL").otherwise("ABSENT"))


def topic_answers(topics: DataFrame, units: DataFrame) -> DataFrame:
    """site, url, topic, status, units: EXPLAINED by a unit that names it in text and has ten words, UNSUPPORTED_HEADING
    if only headings do, MENTIONED_ONLY if the page's text does, else ABSENT."""
    j = topics.select("site", "url", "topic", "locations").join(units.select("site", "url", "key", "heading", "text"), ["site", "url"], "left")
    inside = lambda c: F.contains(F.lower(F.coalesce(c, F.lit(""))), F.col("topic"))
    g = j.groupBy("site", "url", "topic").agg(F.count_if(inside(F.col("text")) & (text.word_count(F.col("text")) >= 10)).alias("units"), F.first("locations").alias("locations"))
    heads = F.arrays_overlap("locations", F.array(F.lit("H1"), F.lit("H2"), F.lit("H3")))
    return g.select("site", "url", "topic", F.when(F.col("units") > 0, "EXPLAINED").when(heads, "UNSUPPORTED_HEADING").when(F.array_contains("locations", "MAIN_CONTENT"), "MENTIONED_ONLY").otherwise("ABSENT").alias("status"), "units")


def answer_summary(units: DataFrame) -> DataFrame:
    """Units of each site by type, with their pages."""
    return units.groupBy("site", "type").agg(F.count("*").alias("units"), F.count_distinct("url").alias("pages"))


# --- claims ---

STANDARD = r"\b((?:ISO|IEC|ASTM|EN|DIN|IEEE|ANSI|BS|NABL|NIST)[ /-]*[A-Z]*[ -]?\d{2,6}(?:[-:]\d+)*)\b"
FOUNDED = r"(?i)\b(?:founded|established|since|incorporated)\s+(?:in\s+)?((?:19|20)\d{2})\b"
METRIC = r"(?i)\b(\d[\d,.]*\s?(?:%|percent|\+|years|clients|customers|projects|countries|employees))"


def _names(t: Column, pattern: str) -> Column:
    """Whether a text holds one of the patterns above; none does without a digit, which is found much faster."""
    return t.rlike(r"\d") & t.rlike(pattern)


def _key(whole: Column) -> Column:
    return F.substring(F.md5(F.substring(F.lower(F.trim(whole)), 1, 120)), 1, 10)


def _claim_id(shown: Column) -> Column:
    return F.substring(F.md5(F.lower(shown)), 1, 10)


#: Types of passages that prove a claim by words in common.
PROOF = ("PROCEDURE_STEPS", "TABLE")


def passages(parsed: DataFrame, units: DataFrame, evidence: bool = False) -> DataFrame:
    """site, url, key, type, text, own: the whole texts of answer units, and the paragraphs that are none, of any length;
    with evidence only those that ground_claims reads: steps, tables, and texts that name a standard or a founding year.

    key is the MD5 of a text; own is the id of the claim that the text itself would make (units are shown by their
    beginning)."""
    from .search import schema_types

    p = parsed.where("p is not null")
    digest = lambda t: F.md5(F.lower(F.trim(t)))
    named = (_names(F.col("text"), STANDARD) | _names(F.col("text"), FOUNDED)) if evidence else F.lit(True)
    steps = F.arrays_overlap(schema_types(), F.array(*[F.lit(t) for t, k in SCHEMA_UNITS.items() if k in PROOF]))
    proofs = F.transform(F.filter("p.units", lambda u: u["kind"].isin(*PROOF)), lambda u: _key(u["text"]))
    dom = p.select("site", "url", steps.alias("steps"), proofs.alias("proofs"), F.explode("p.units").alias("u")).select("site", "url", "steps", "proofs", _key(F.col("u.text")).alias("unit"), F.col("u.whole").alias("text"))
    # texts go as early as they can: where paragraphs aren't closed they hold one another, and are several times the pages
    dom = dom.select("site", "url", "unit", digest(F.col("text")).alias("key"), F.when(F.col("steps") | F.array_contains("proofs", F.col("unit")) | named, F.col("text")).alias("text")).distinct()
    u = units.select("site", "url", F.col("key").alias("unit"), "type", F.col("text").alias("shown")).join(dom, ["site", "url", "unit"], "left")
    u = u.select("site", "url", "type", F.when(F.col("key").isNull(), F.col("shown")).otherwise(F.col("text")).alias("text"), _claim_id(F.col("shown")).alias("own"), F.coalesce("key", digest(F.col("shown"))).alias("key"))
    plain = p.select("site", "url", F.explode(F.array_distinct("p.texts")).alias("text")).where(named).withColumn("key", digest(F.col("text")))
    plain = plain.join(u.select("site", "url", "key"), ["site", "url", "key"], "left_anti")
    if evidence:
        u = u.where(F.col("type").isin(*PROOF) | named)
    return u.where("text is not null").select("site", "url", "key", "type", "text", "own").union(plain.select("site", "url", "key", F.lit("PARAGRAPH"), "text", _claim_id(F.col("text"))))


def claims(parsed: DataFrame, units: DataFrame) -> DataFrame:
    """site, url, claim_id, type, subject, text: statements that can be backed or contradicted, each once.

    From paragraphs of 15 to 400 characters, the description, and units: accreditation (names a standard), founding
    (a year), metric (a number), else the unit's own kind (service, specification, requirement, contact)."""
    p = parsed.where("p is not null").select("site", "url", F.explode(F.array_distinct("p.texts")).alias("text")).withColumn("key", _key(F.col("text")))
    p = p.where(F.length("text").between(15, 400) & (_names(F.col("text"), STANDARD) | _names(F.col("text"), FOUNDED) | _names(F.col("text"), METRIC)))  # others make no claim
    plain = p.join(units.select("site", "url", "key"), ["site", "url", "key"], "left_anti").select("site", "url", "text", F.lit("PARAGRAPH").alias("type"))
    para = units.select("site", "url", "text", "type").union(plain)
    desc = parsed.where("p is not null").select("site", "url", F.col("p.meta").getItem("description").alias("text"), F.lit("DESCRIPTION").alias("type"))
    c = para.union(desc).where(F.length("text").between(15, 400))
    kind = (
        F.when(_names(F.col("text"), STANDARD), "accreditation").when(_names(F.col("text"), FOUNDED), "founding").when(_names(F.col("text"), METRIC), "metric").when(F.col("type") == "SERVICE_DESCRIPTION", "service")
        .when(F.col("type").isin("SPECIFICATION", "TABLE"), "specification").when(F.col("type") == "REQUIREMENTS_ELIGIBILITY", "requirement").when(F.col("type") == "LOCATION_CONTACT", "contact").when(F.col("type") == "FACTUAL_STATEMENT", "factual")
    )
    subject = F.when(kind == "accreditation", F.upper(F.regexp_replace(F.regexp_extract("text", STANDARD, 1), r"\s+", " "))).when(kind == "founding", F.regexp_extract("text", FOUNDED, 1)).when(kind == "metric", F.regexp_extract("text", METRIC, 1)).otherwise("")
    c = c.withColumn("kind", kind).where("kind is not null").select("site", "url", _claim_id(F.col("text")).alias("claim_id"), F.col("kind").alias("type"), subject.alias("subject"), "text")
    return c.dropDuplicates(["site", "url", "claim_id"])


def _accredited(claim: DataFrame, passage: DataFrame) -> DataFrame:
    """s of the accreditations that passages of other claims name: of each standard two rows say it, the best of any
    passage and the best of those of another claim."""
    std = passage.select("site", "own", "u_text", F.explode(F.array_distinct(F.transform(F.regexp_extract_all("u_text", F.lit(STANDARD), F.lit(1)), lambda x: F.upper(F.regexp_replace(x, r"\s+", " "))))).alias("subject"))
    s = F.when((F.length("u_text") >= 120) | F.col("u_text").rlike(r"(?i)\b(scope|method|testing|calibration|accredited)\b"), 2).otherwise(1)
    std = std.groupBy("site", "subject", "own").agg(F.max(s).alias("s"))
    best = std.groupBy("site", "subject").agg(F.max(F.struct("s", "own")).alias("first"))
    other = std.join(best, ["site", "subject"]).where("own <> first.own").groupBy("site", "subject").agg(F.max("s").alias("second"))
    best = best.join(other, ["site", "subject"], "left")
    a = claim.where("type = 'accreditation'").join(best, ["site", "subject"])
    return a.select("site", "url", "claim_id", F.when(F.col("first.own") != F.col("claim_id"), F.col("first.s")).otherwise(F.col("second")).alias("s")).where("s is not null")


def _founded(claim: DataFrame, passage: DataFrame) -> DataFrame:
    """s of the founding years of sites where passages of other claims name a year: a site has 200 years at most, each with
    the least and the greatest claim that its passages make."""
    years = passage.select("site", "own", F.explode(F.array_distinct(F.regexp_extract_all("u_text", F.lit(FOUNDED), F.lit(1)))).alias("year"))
    years = years.groupBy("site", "year").agg(F.min("own").alias("a"), F.max("own").alias("b")).groupBy("site").agg(F.collect_list(F.struct("year", "a", "b")).alias("years"))
    f = claim.where("type = 'founding'").join(years, "site").withColumn("years", F.filter("years", lambda y: (y["a"] != F.col("claim_id")) | (y["b"] != F.col("claim_id"))))
    return f.where("size(years) > 0").select("site", "url", "claim_id", F.when(F.exists("years", lambda y: y["year"] != F.col("subject")), 3).otherwise(2).alias("s"))


#: Passages of a site, and of its tables, that each claim is held against at once.
WITNESSES = 32


def _backed(c: DataFrame, u: DataFrame) -> DataFrame:
    """The ids of claims c (id, site, claim_id, type, need, words) that have `need` words in common with passages u (site,
    own, table, words) of another claim; metrics with tables alone.

    Whether there is such a passage is all that matters, so the passages with most words of a site are tried first. The
    claims that they don't settle meet all passages on their rarer words: a claim that needs n words in common shares one
    of all but its n - 1 most frequent ones.
    """
    c, u = keep(c), keep(u.withColumn("pid", F.monotonically_increasing_id()))
    shown = u.withColumnRenamed("words", "u_words")
    agree = (F.col("own") != F.col("claim_id")) & (F.col("table") | (F.col("type") != "metric")) & (F.size(F.array_intersect("words", "u_words")) >= F.col("need"))
    most = Window.partitionBy("site", "table").orderBy(F.desc(F.size("u_words")), "pid")
    best = shown.withColumn("k", F.row_number().over(most)).where(F.col("k") <= WITNESSES)
    salted = best.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(31))))  # a site's claims in several tasks
    first = keep(c.withColumn("salt", F.pmod("id", F.lit(32)).cast("int")).join(salted, ["site", "salt"]).where(agree).select("id").distinct())
    left = keep(c.join(first, "id", "left_anti"))
    t = left.select("id", "site", "claim_id", "need", F.explode("words").alias("t"))
    ut = u.select("site", "pid", "own", F.explode("words").alias("t")).join(t.select("site", "t").distinct(), ["site", "t"], "left_semi")
    often = ut.groupBy("site", "t").agg(F.count("*").alias("n"))
    mine = Window.partitionBy("id")
    rare = t.join(often, ["site", "t"]).withColumn("place", F.row_number().over(mine.orderBy("n", "t"))).withColumn("m", F.count("*").over(mine)).where(F.col("place") <= F.col("m") - F.col("need") + 1)
    pairs = rare.join(ut, ["site", "t"]).where("own <> claim_id").select("id", "pid").distinct()
    return first.union(pairs.join(left.drop("site"), "id").join(shown.drop("site"), "pid").where(agree).select("id").distinct())


def _worded(claim: DataFrame, passage: DataFrame) -> DataFrame:
    """s of the claims that share words with steps or tables (metrics: tables) of other claims. Services and metrics need
    two words in common, others three. Copies of claims, and of passages, are one. Other passages say no more of a claim
    than it has without any, and aren't read."""
    c = claim.where("type in ('service', 'specification', 'requirement', 'factual', 'metric')").withColumn("id", F.xxhash64("site", "claim_id", "type"))
    u = passage.where(F.col("u_type").isin(*PROOF)).withColumn("words", F.array_sort(text.tokens(F.col("u_text"))))
    u = u.groupBy("site", "own", "words").agg(F.max(F.col("u_type") == "TABLE").alias("table"))
    need = F.when(F.col("type").isin("service", "metric"), 2).otherwise(3)
    one = c.join(u.select("site").distinct(), "site", "left_semi").dropDuplicates(["site", "claim_id", "type"])
    one = one.select("id", "site", "claim_id", "type", need.alias("need"), text.tokens(F.col("text")).alias("words"))
    ids = _backed(one.where("size(words) >= need"), u.where("size(words) >= 2"))
    return c.join(ids, "id", "left_semi").select("site", "url", "claim_id", F.lit(2).alias("s"))


def ground_claims(claim: DataFrame, passage: DataFrame) -> DataFrame:
    """Claims with support: what other passages of the site say of them.

    SUPPORTED_ON_SITE, PARTIALLY_SUPPORTED, UNCORROBORATED_ON_SITE, or CONTRADICTED_ON_SITE (another founding year).
    Passages meet claims on a shared subject, or on shared content words."""
    u = passage.select("site", F.col("url").alias("u_url"), F.col("type").alias("u_type"), F.col("text").alias("u_text"), "own")
    all_ = _accredited(claim, u).union(_founded(claim, u)).union(_worded(claim, u)).groupBy("site", "url", "claim_id").agg(F.max("s").alias("s"))
    j = claim.join(all_, ["site", "url", "claim_id"], "left")
    none = F.when(F.col("type").isin("accreditation"), "UNCORROBORATED_ON_SITE").when(F.col("type") == "contact", "SUPPORTED_ON_SITE").otherwise("PARTIALLY_SUPPORTED")
    return j.withColumn("support", F.when(F.col("s") == 3, "CONTRADICTED_ON_SITE").when(F.col("s") == 2, "SUPPORTED_ON_SITE").when(F.col("s") == 1, "PARTIALLY_SUPPORTED").otherwise(none)).drop("s")


def claim_summary(grounded: DataFrame) -> DataFrame:
    return grounded.groupBy("site", "type", "support").agg(F.count("*").alias("claims"))


def surfaces(parsed: DataFrame, entities: DataFrame) -> DataFrame:
    """site, url, normalized, surfaces, status: on how many of title, H1, description, text, copyright and data a page's
    organization shows; three are CONSISTENT."""
    org = entities.where("type in ('ORGANIZATION', 'LOCAL_BUSINESS')").select("site", "url", "normalized", F.array_contains("sources", "JSON_LD").alias("data"))
    p = parsed.where("p is not null").select("site", "url", "p.title", F.array_join("p.h1", " ").alias("h1"), F.col("p.meta").getItem("description").alias("d"), F.col("p.main_text").alias("m"), F.array_join("p.copyright", " ").alias("c"))
    j = org.join(p, ["site", "url"])
    n = sum(F.contains(F.lower(F.coalesce(c, F.lit(""))), F.col("normalized")).cast("int") for c in ("title", "h1", "d", "m", "c")) + F.col("data").cast("int")
    return j.select("site", "url", "normalized", n.alias("surfaces")).withColumn("status", F.when(F.col("surfaces") >= 3, "CONSISTENT").when(F.col("surfaces") >= 1, "PARTIALLY_CONSISTENT").otherwise("UNKNOWN"))


def agreement(kind: Column, a: Column, b: Column) -> Column:
    """How a declared and a visible value of a field agree."""
    norm = lambda c: F.when(kind == "phone", phone_number(c)).when(kind == "name", entity_name(c)).otherwise(F.regexp_replace(F.lower(F.trim(c)), r"\s+|^https?://(www\.)?|/$", ""))
    x, y = norm(a), norm(b)
    return F.when(a.isNull() & b.isNull(), "UNAVAILABLE").when(a.isNull(), "MISSING_STRUCTURED").when(b.isNull(), "MISSING_VISIBLE").when(x == y, "AGREEMENT").when(F.contains(x, y) | F.contains(y, x), "PARTIAL_AGREEMENT").otherwise("DISAGREEMENT")


def structured_fields(parsed: DataFrame, entities: DataFrame) -> DataFrame:
    """site, url, field, structured, visible, status of a page's organization: name, phone and address."""
    org = entities.where("source = 'JSON_LD' and type in ('ORGANIZATION', 'LOCAL_BUSINESS')").groupBy("site", "url").agg(F.min("name").alias("name"), F.min("phone").alias("phone"), F.min("address").alias("address"))
    vis = parsed.where("p is not null").select("site", "url", F.try_element_at("p.copyright", F.lit(1)).alias("v_name"), F.try_element_at("p.phones", F.lit(1)).alias("v_phone"), F.try_element_at("p.address", F.lit(1)).alias("v_address"))
    j = org.join(vis, ["site", "url"])
    rows = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("structured"), F.col(f"v_{f}").alias("visible")) for f in ("name", "phone", "address")])
    out = j.select("site", "url", F.explode(rows).alias("r")).select("site", "url", "r.*")
    return out.withColumn("status", agreement(F.col("field"), F.col("structured"), F.col("visible")))


# --- assets and agents ---


def visual_assets(parsed: DataFrame) -> DataFrame:
    """site, url, pos, role (decorative, informational, unknown) and status of every image."""
    i = parsed.where("p is not null").select("site", "url", F.explode("p.images").alias("i")).select("site", "url", "i.*")
    words = lambda c: text.word_count(F.coalesce(c, F.lit("")))
    size = lambda c: F.regexp_extract(F.coalesce(c, F.lit("")), r"^(\d{1,6})", 1).try_cast("int")
    only_link = F.col("in_link").isNotNull() & (F.trim(F.coalesce("in_link", F.lit(""))) == "")
    tiny = (size(F.col("width")) <= 16) & (size(F.col("height")) <= 16)
    decorative = F.col("role").isin("presentation", "none") | F.col("hidden") | ((F.col("alt") == "") & ~only_link) | F.coalesce(tiny, F.lit(False)) | F.col("src").rlike(r"(?i)(spacer|pixel|divider|background|decor)")
    informational = F.col("caption").isNotNull() | (words(F.col("alt")) >= 2) | F.col("inside")
    file_name = F.coalesce("alt", F.lit("")).rlike(r"(?i)^\S+\.(jpe?g|png|gif|webp|svg)$|^(image|photo|img|picture|logo|icon)$")
    role = F.when(decorative, "decorative").when(informational, "informational").otherwise("unknown")
    status = F.when(words(F.col("caption")) >= 2, "CAPTION_REPRESENTED").when((words(F.col("alt")) >= 2) & ~file_name, "ALT_REPRESENTED").when(words(F.col("in_link")) >= 1, "TEXT_REPRESENTED").when(role == "unknown", "UNLABELED_UNKNOWN").otherwise("VISUAL_ONLY_OBSERVED")
    return i.select("site", "url", "pos", "src", role.alias("role"), status.alias("status"), "heading")


def hidden_answers(assets: DataFrame, units: DataFrame) -> DataFrame:
    """site, url, visual_only: images without words that stand under the heading of an answer unit of their page."""
    a = assets.where("status = 'VISUAL_ONLY_OBSERVED' and heading <> ''").select("site", "url", "pos", F.lower("heading").alias("h"))
    u = units.where("heading <> ''").select("site", "url", F.lower("heading").alias("uh")).distinct()
    return a.join(u, ["site", "url"]).where(F.contains("uh", F.col("h"))).groupBy("site", "url").agg(F.count_distinct("pos").alias("visual_only"))


def agent_surfaces(parsed: DataFrame) -> DataFrame:
    """site, url, signal, status, name: forms, links in menus, and actions declared in data."""
    p = parsed.where("p is not null")
    f = p.select("site", "url", F.explode("p.forms").alias("f"))
    status = F.when(F.col("f.controls") == 0, "OBSERVED").when(F.col("f.labelled") == F.col("f.controls"), "LABELED").when(F.col("f.labelled") > 0, "PARTIALLY_LABELED").otherwise("UNLABELED")
    forms = f.select("site", "url", F.col("f.purpose").alias("signal"), status.alias("status"), F.coalesce("f.submit", F.lit("")).alias("name"))
    nav = p.select("site", "url", F.explode(F.filter("p.links", lambda l: l["nav"])).alias("l")).where("l.text <> ''").select("site", "url", F.lit("DESCRIPTIVE_NAVIGATION"), F.when(text.generic_anchor(F.col("l.text")), "AMBIGUOUS").otherwise("EXPLICIT"), "l.text")
    act = p.select("site", "url", F.explode(F.array_distinct(F.regexp_extract_all(F.array_join("p.jsonld", " "), F.lit(r'"@type"\s*:\s*"(\w*Action)"'), F.lit(1)))).alias("a")).select("site", "url", F.lit("SCHEMA_POTENTIAL_ACTION"), F.lit("EXPLICIT"), "a")
    return forms.union(nav).union(act)


def access_paths(units: DataFrame, assets: DataFrame, agents: DataFrame) -> DataFrame:
    """Per page: answer units, informational images with and without text, and labelled controls."""
    a = units.groupBy("site", "url").agg(F.count("*").alias("units"))
    b = assets.where("role = 'informational'").groupBy("site", "url").agg(F.count("*").alias("informational"), F.count_if(F.col("status") == "VISUAL_ONLY_OBSERVED").alias("visual_only"))
    c = agents.groupBy("site", "url").agg(F.count_if(F.col("status").isin("LABELED", "EXPLICIT")).alias("usable"), F.count_if(F.col("status").isin("UNLABELED", "PARTIALLY_LABELED")).alias("unlabelled"))
    return a.join(b, ["site", "url"], "full").join(c, ["site", "url"], "full").na.fill(0)


# --- external answers ---

# Question templates as (category, template).
TEMPLATES = (("entity_identification", "What is {0}?"), ("service_discovery", "What services does {0} offer?"), ("location_contact", "How can I contact {0}?"), ("certification_standard", "Which certifications does {0} hold?"), ("comparison_decision", "How does {0} compare with alternatives?"))


def external_queries(organizations: DataFrame, topics: DataFrame | None = None, trials: int = 1, providers: tuple[str, ...] = ("mock",), per_site: int = 5) -> DataFrame:
    """site, provider, category, query, trial: questions on each site's organization and its first topics."""
    rows = F.array(*[F.struct(F.lit(c).alias("category"), F.replace(F.lit(t), F.lit("{0}"), F.col("name")).alias("query")) for c, t in TEMPLATES])
    q = organizations.select("site", F.explode(rows).alias("q")).select("site", "q.*")
    if topics is not None:
        t = topics.withColumn("k", F.row_number().over(Window.partitionBy("site").orderBy(F.desc("title_or_h1"), F.desc("pages"), "topic"))).where(F.col("k") <= per_site)
        q = q.union(t.select("site", F.lit("service_explanation"), F.concat(F.lit("What is "), F.col("topic"), F.lit("?"))))
    return q.withColumn("provider", F.explode(F.array(*[F.lit(p) for p in providers]))).withColumn("trial", F.explode(F.sequence(F.lit(1), F.lit(trials))))


NEGATIONS = (("not accredited", "accredited"), ("not certified", "certified"), ("no longer", "currently"), ("closed", "open"), ("unavailable", "available"))


def citation_match(cited: Column, page: Column) -> Column:
    """MISMATCH if one text denies what the other says, MATCHES from 65 % of the cited words of four letters, PARTIALLY
    from 25 %, else UNABLE_TO_DETERMINE."""
    bag = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"\b[a-z]{4,}\b"), F.lit(0)))
    a, b = bag(cited), bag(page)
    ratio = F.size(F.array_intersect(a, b)) / F.greatest(F.size(a), F.lit(1))
    x, y = F.lower(F.coalesce(cited, F.lit(""))), F.lower(F.coalesce(page, F.lit("")))
    against = F.lit(False)
    for no, yes in NEGATIONS:
        against = against | (F.contains(x, F.lit(no)) & F.contains(y, F.lit(yes)) & ~F.contains(y, F.lit(no))) | (F.contains(y, F.lit(no)) & F.contains(x, F.lit(yes)) & ~F.contains(x, F.lit(no)))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), "UNABLE_TO_DETERMINE").when(against, "MISMATCH").when(ratio >= 0.65, "MATCHES_PAGE_EVIDENCE").when(ratio >= 0.25, "PARTIALLY_MATCHES").otherwise("UNABLE_TO_DETERMINE")


def mentions(answers: DataFrame, names: DataFrame) -> DataFrame:
    """site, id, name, position, context of every mention of a site's names (site, name) in its answers (site, id, text),
    with 40 characters on either side."""
    j = answers.join(names.select("site", "name").distinct(), "site")
    n = F.length("name")
    # positions: lengths of the pieces between occurrences, summed
    parts = F.split(F.lower("text"), F.concat(F.lit("\\Q"), F.lower("name"), F.lit("\\E")), -1)
    hits = F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.aggregate(F.slice(parts, F.lit(1), i), F.lit(0), lambda a, s: a + F.length(s)) + (i - 1) * n)).otherwise(F.array().cast("array<int>"))
    out = j.where(n > 0).withColumn("position", F.explode(hits))
    start = F.greatest(F.lit(0), F.col("position") - 40)
    return out.select("site", "id", "name", "position", F.substring(F.col("text"), start + 1, F.col("position") - start + n + 40).alias("context"))


def citations(cited: DataFrame, parsed: DataFrame) -> DataFrame:
    """Citations (site, id, url, text) with the crawled page they mean, how they relate to the site, and whether they agree."""
    page = parsed.where("p is not null").select("site", F.col("normalized_url").alias("n"), F.col("p.main_text").alias("page_text")).dropDuplicates(["site", "n"])
    j = cited.withColumn("n", urls.normalise(F.col("url"))).join(page, ["site", "n"], "left")
    own = F.regexp_replace(urls.host(F.col("url")), "^www\\.", "") == F.regexp_replace("site", "^www\\.", "")
    relation = F.when(F.coalesce("url", F.lit("")) == "", "CITATION_UNAVAILABLE").when(F.col("page_text").isNotNull(), "TARGET_PAGE_CITED").when(own, "TARGET_DOMAIN_CITED").otherwise("NO_TARGET_CITATION")
    return j.select("site", "id", "url", relation.alias("relation"), F.when(F.col("page_text").isNotNull(), citation_match(F.col("text"), F.col("page_text"))).alias("match"))


def trial_consistency(observations: DataFrame) -> DataFrame:
    """Per site: the share of queries whose trials agree on mention, and on citation (site, query, trial, mentioned, cited)."""
    q = observations.groupBy("site", "query").agg(*[(F.bool_and(c) | ~F.bool_or(c)).alias(f"same_{c}") for c in ("mentioned", "cited")], F.bool_or("mentioned").alias("mentioned"), F.bool_or("cited").alias("cited"))
    return q.groupBy("site").agg(F.count("*").alias("queries"), F.avg(F.col("same_mentioned").cast("double")).alias("mention_consistency"), F.avg(F.col("same_cited").cast("double")).alias("citation_consistency"), F.count_if("mentioned").alias("mentioned"), F.count_if("cited").alias("cited"))


SECRET = r"(?i)\b(api[_-]?key|token|secret|password|authorization)\b(\s*[=:]\s*|\"\s*:\s*\")([^\s\",;&]+)"


def redacted(message: Column) -> Column:
    """A message with the values of keys, tokens and passwords replaced."""
    return F.regexp_replace(message, SECRET, "$1$2***")


def provider_status(code: Column, error: Column) -> Column:
    return F.when(F.lower(error).rlike("timed? ?out"), "TIMEOUT").when(code == 429, "RATE_LIMITED").when(code.isin(401, 403), "UNAVAILABLE").when(error.isNotNull() | (code >= 400), "ERROR").when(code.isNull(), "DISABLED").otherwise("SUCCESS")
