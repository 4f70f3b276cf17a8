"""Search intelligence: signals, topics, concepts, intents, and what pages of a site share or lack.

Everything is relational: a page's terms are rows, topics are a join of terms with anchor terms, and pairs of pages are
joins on what they have in common. Lists are whole; `most` limits a report where one is asked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text, urls
from ..functions.dims import STOPWORDS
from ..plans.shared import keep

# Words of navigation that are no search terms.
GENERIC = ("home", "page", "click", "here", "read", "more", "menu", "contact", "about", "privacy", "policy", "terms", "login", "search", "view", "details", "copyright", "rights", "reserved", "skip", "content", "image", "photo", "icon", "logo")
LOCATIONS = ("TITLE", "META_DESCRIPTION", "H1", "H2", "H3", "MAIN_CONTENT", "URL_PATH", "IMAGE_ALT", "STRUCTURED_DATA", "ENTITY")
SPLIT = r"[^\p{L}\p{N}_'-]+"


def _ignored(t: Column) -> Column:
    return t.isin(*STOPWORDS) | t.isin(*GENERIC)


def _pieces(source: Column, location: str, split: str, least: int, most_words: int | None = None) -> Column:
    """Array of (raw, loc, n) of a text's parts that can be terms."""
    parts = F.filter(F.transform(F.split(F.coalesce(source, F.lit("")), split), lambda x: F.trim(x)), lambda x: x != "")
    rows = F.transform(parts, lambda x: F.struct(x.alias("raw"), F.lit(location).alias("loc"), F.lit(1).cast("long").alias("n"), F.lit(False).alias("entity"), F.lit(None).cast("string").alias("etype")))
    if most_words:
        return F.filter(rows, lambda r: (F.size(F.split(text.term(r["raw"]), " ")) <= most_words) & (F.length(text.term(r["raw"])) >= least))
    return F.filter(rows, lambda r: F.length(text.term(r["raw"])) >= least)


def content_terms(parsed: DataFrame) -> DataFrame:
    """site, url, raw, n: the 30 most frequent words, and the 25 most frequent phrases of 2 to 4 words without function
    words between, that a main text has twice or more. Phrases come from shifted copies of a page's words; only what
    stands twice in a page leaves its row."""
    found = F.regexp_extract_all(F.lower(F.col("p.main_text")), F.lit(r"[\p{L}\p{N}]+(?:-[\p{L}\p{N}]+)?"), F.lit(0))
    page = parsed.select("site", "url", F.transform(found, lambda w: F.when(~(_ignored(w) | (F.length(w) < 2)), w)).alias("w"))
    joined = lambda a, b: F.concat(a, F.lit(" "), b)
    rest = lambda k: F.slice("w", k, F.greatest(F.size("w"), F.lit(1)))
    page = page.withColumn("g2", F.zip_with("w", rest(2), joined)).withColumn("g3", F.zip_with("g2", rest(3), joined)).withColumn("g4", F.zip_with("g3", rest(4), joined))

    def top(terms: Column, k: int, *order) -> DataFrame:
        t = page.select("site", "url", F.array_sort(F.filter(terms, lambda x: x.isNotNull())).alias("t"))
        same = lambda x, y: F.when(x == y, x)
        # of n equal terms in order n - 1 equal the next
        t = t.select("site", "url", F.explode(F.filter(F.zip_with("t", F.slice("t", 2, F.greatest(F.size("t"), F.lit(1))), same), lambda x: x.isNotNull())).alias("raw"))
        t = t.groupBy("site", "url", "raw").agg((F.count("*") + 1).alias("n"))
        return t.withColumn("k", F.row_number().over(Window.partitionBy("site", "url").orderBy(*order))).where(F.col("k") <= k).drop("k")

    single = F.filter("w", lambda x: F.length(x) >= 3)
    return top(single, 30, F.desc("n"), "raw").union(top(F.concat("g2", "g3", "g4"), 25, F.desc("n"), F.desc(F.length("raw")), "raw"))


def _heading_terms(level: int):
    return lambda h: F.concat(_pieces(h["text"], f"H{level}", r"\n{9}", 2, 6), _pieces(h["text"], f"H{level}", SPLIT, 3))


def signals(parsed: DataFrame, entities: DataFrame | None = None) -> DataFrame:
    """site, url, term, raw_term, locations, occurrences, prominent, is_entity, entity_type, confidence.

    From title, description, headings, main text, entities (site, url, name, type) or the names in structured data, URL
    path and image texts. DIRECT: in title, H1 or description, or an entity; SUPPORTED: in two places or three times.
    """
    p = parsed.where("p is not null")
    head = lambda level: F.filter("p.headings", lambda h: h["level"] == level)
    each = lambda items, f: F.flatten(F.transform(items, f))
    parts = [
        _pieces(F.col("p.title"), "TITLE", r"\s*[|–—•:-]\s*", 2, 5), _pieces(F.col("p.title"), "TITLE", SPLIT, 3), _pieces(F.col("p.meta").getItem("description"), "META_DESCRIPTION", SPLIT, 3),
        *[each(head(i), _heading_terms(i)) for i in (1, 2, 3)],
        F.filter(_pieces(F.regexp_replace(urls.path(F.col("url")), r"\.[A-Za-z0-9]+$", ""), "URL_PATH", r"[/_-]+", 3), lambda r: ~r["raw"].rlike("^[0-9]+$")),
        each(F.filter("p.images", lambda i: F.trim(F.coalesce(i["alt"], F.lit(""))) != ""), lambda i: _pieces(i["alt"], "IMAGE_ALT", r"\n{9}", 2)),
    ]
    rows = p.select("site", "url", F.explode(F.concat(*parts)).alias("r")).select("site", "url", "r.*")
    body = content_terms(p).select("site", "url", "raw", F.lit("MAIN_CONTENT").alias("loc"), "n", F.lit(False).alias("entity"), F.lit(None).cast("string").alias("etype"))
    rows = rows.union(body)
    if entities is not None:
        rows = rows.union(entities.select("site", "url", F.col("name").alias("raw"), F.lit("ENTITY"), F.lit(1).cast("long"), F.lit(True), F.col("type")))
    rows = rows.withColumn("term", text.term(F.col("raw"))).where(F.length("term") >= 2).where(~_ignored(F.col("term")))
    s = rows.groupBy("site", "url", "term").agg(
        F.min_by("raw", F.struct(F.lit(1) - F.length("raw"), "raw")).alias("raw_term"), F.sort_array(F.collect_set("loc")).alias("locations"), F.sum("n").alias("occurrences"), F.max("entity").alias("is_entity"), F.max("etype").alias("entity_type")
    )
    prominent = F.array_intersect("locations", F.array(F.lit("TITLE"), F.lit("H1"), F.lit("META_DESCRIPTION")))
    s = s.withColumn("prominent", F.size(prominent) > 0)
    return s.withColumn("confidence", F.when(F.col("prominent") | F.col("is_entity"), "DIRECT").when((F.size("locations") >= 2) | (F.col("occurrences") >= 3), "SUPPORTED").otherwise("WEAK"))


def ranked_signals(s: DataFrame) -> DataFrame:
    """Signals with their place on the page: prominent ones first, then direct ones, then by number."""
    order = Window.partitionBy("site", "url").orderBy(F.desc("prominent"), F.desc(F.col("confidence") == "DIRECT"), F.desc("occurrences"), "term")
    return s.withColumn("place", F.row_number().over(order))


def recurring(s: DataFrame, most: int | None = None) -> DataFrame:
    """Per site, terms of two pages or more (of one, in a site of one page): pages, occurrences, places, longest raw form."""
    total = s.groupBy("site").agg(F.count_distinct("url").alias("total"))
    r = s.where(F.length("term") >= 3).groupBy("site", "term").agg(
        F.max_by("raw_term", F.struct(F.length("raw_term"), "raw_term")).alias("concept"), F.count_distinct("url").alias("pages"), F.sort_array(F.collect_set("url")).alias("urls"),
        F.sort_array(F.collect_set(F.when(F.col("prominent"), F.col("url")))).alias("prominent_pages"), F.sum("occurrences").alias("occurrences"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_set("locations")))).alias("locations"), F.max("is_entity").alias("is_entity"), F.max("entity_type").alias("entity_type"),
    )
    r = r.join(total, "site").where(F.col("pages") >= F.when(F.col("total") > 1, 2).otherwise(1)).drop("total")
    return _top(r, most, F.desc("pages"), F.desc("occurrences"), "term")


def _top(df: DataFrame, most: int | None, *order, by=("site",)) -> DataFrame:
    if most is None:
        return df
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_k") <= most).drop("_k")


# --- topics ---


def topic_members(s: DataFrame) -> DataFrame:
    """site, url, topic, term, membership, raw_term, locations, occurrences, ...: the terms of each page by topic.

    Anchors are entities, terms of title or H1, of H2 twice, or three times anywhere; a page without any takes its five
    most frequent. Each other term joins the first that fits of an entity it contains or is part of, the longest anchor
    it contains or is part of, an anchor with most of its words; else it is a topic itself if a subheading, the
    description or two occurrences speak for it. Candidates meet on a shared word, so no page's terms are all paired.
    """
    s = s.where(F.length("term") >= 3)
    has = lambda loc: F.array_contains("locations", loc)
    anchor = F.col("is_entity") | has("TITLE") | has("H1") | (has("H2") & (F.col("occurrences") >= 2)) | (F.col("occurrences") >= 3)
    w = Window.partitionBy("site", "url")
    s = s.withColumn("a", anchor).withColumn("some", F.max("a").over(w))
    s = s.withColumn("a", F.col("a") | (~F.col("some") & (F.row_number().over(w.orderBy(F.desc("occurrences"), F.length("term"), "term")) <= 5))).drop("some")
    stop = F.array(*[F.lit(x) for x in STOPWORDS])
    s = s.withColumn("toks", F.array_distinct(F.filter(F.split("term", r"[^\p{L}\p{N}-]+"), lambda t: (F.length(t) >= 2) & ~F.array_contains(stop, t))))
    left, anchors = s.where(~F.col("a")), s.where("a")
    x = left.select("site", "url", "term", "toks", F.explode(F.array_distinct(F.split("term", " "))).alias("t"))
    y = anchors.select("site", "url", F.col("term").alias("anchor"), F.col("toks").alias("atoks"), F.col("is_entity").alias("aent"), F.explode(F.array_distinct(F.split("term", " "))).alias("t"))
    pair = x.join(y, ["site", "url", "t"]).drop("t").dropDuplicates(["site", "url", "term", "anchor"])
    inside = text.word_bounded(F.col("anchor"), F.col("term")) | text.word_bounded(F.col("term"), F.col("anchor"))
    both = F.size(F.array_intersect("toks", "atoks"))
    j = both / F.size(F.array_union("toks", "atoks"))
    close = (F.size("toks") >= 2) & (F.size("atoks") >= 2) & (((both >= 2) & (j >= 0.5)) | (j >= 0.6))
    rank = F.when(inside & F.col("aent"), F.struct(F.lit(1).alias("r"), F.lit(0).alias("l"), "anchor")).when(inside, F.struct(F.lit(2).alias("r"), (-F.length("anchor")).alias("l"), "anchor")).when(close, F.struct(F.lit(3).alias("r"), F.lit(0).alias("l"), "anchor"))
    best = pair.withColumn("rank", rank).where("rank is not null").groupBy("site", "url", "term").agg(F.min("rank").alias("m"))
    kind = F.element_at(F.array(F.lit("ENTITY_MEMBER"), F.lit("PHRASE_CONTAINMENT"), F.lit("TOKEN_OVERLAP")), F.col("m.r"))
    sub = F.arrays_overlap("locations", F.array(F.lit("H2"), F.lit("H3"), F.lit("META_DESCRIPTION"))) | (F.col("occurrences") >= 2)
    joined = left.join(best, ["site", "url", "term"], "left").withColumn("topic", F.when(F.col("m").isNotNull(), F.col("m.anchor")).when(sub, F.col("term"))).withColumn("membership", F.when(F.col("m").isNotNull(), kind).otherwise("EXACT")).drop("m")
    own = anchors.withColumn("topic", F.col("term")).withColumn("membership", F.when(F.col("is_entity"), "ENTITY_MEMBER").otherwise("EXACT"))
    return own.unionByName(joined.where("topic is not null")).drop("a", "toks")


def page_topics(members: DataFrame) -> DataFrame:
    """site, url, topic with name, terms, occurrences, locations, entities; and its place on the page."""
    t = members.groupBy("site", "url", "topic").agg(
        F.max(F.when(F.col("term") == F.col("topic"), F.col("raw_term"))).alias("name"), F.sort_array(F.collect_set("term")).alias("terms"), F.sum("occurrences").alias("occurrences"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_set("locations")))).alias("locations"), F.sort_array(F.collect_set(F.when(F.col("is_entity"), F.concat("term", F.lit(" ("), F.coalesce("entity_type", F.lit("")), F.lit(")"))))).alias("entities"),
    )
    t = t.withColumn("name", F.coalesce("name", "topic")).withColumn("title_or_h1", F.arrays_overlap("locations", F.array(F.lit("TITLE"), F.lit("H1"))))
    order = Window.partitionBy("site", "url").orderBy(F.desc("title_or_h1"), F.desc("occurrences"), F.desc(F.size("locations")), F.lower("name"), "topic")
    return t.withColumn("place", F.row_number().over(order))


def topic_relations(topics: DataFrame) -> DataFrame:
    """site, url, topic_a, topic_b, relation: pairs of a page's topics; the first that holds of containment (SUBTOPIC_OF
    if the shorter is in title or H1 and the longer below), a shared entity, a shared title or H1. Pairs meet on what
    they share: a word, an entity or a place."""
    key = F.array_distinct(F.concat(F.transform(F.split("topic", " "), lambda x: F.concat(F.lit("w:"), x)), F.transform("entities", lambda x: F.concat(F.lit("e:"), x)), F.transform(F.array_intersect("locations", F.array(F.lit("TITLE"), F.lit("H1"))), lambda x: F.concat(F.lit("l:"), x))))
    t = topics.select("site", "url", "topic", "place", "locations", "entities", F.explode(key).alias("k"))
    a, b = t, t.select("site", "url", "k", *[F.col(c).alias(f"{c}_b") for c in ("topic", "place", "locations", "entities")])
    pair = a.join(b, ["site", "url", "k"]).where("place < place_b").drop("k").dropDuplicates(["site", "url", "topic", "topic_b"])
    a_in_b, b_in_a = text.word_bounded(F.col("topic"), F.col("topic_b")), text.word_bounded(F.col("topic_b"), F.col("topic"))
    top, low = F.array(F.lit("TITLE"), F.lit("H1")), F.array(F.lit("H2"), F.lit("H3"), F.lit("MAIN_CONTENT"))
    parent_top = F.when(a_in_b, F.arrays_overlap("locations", top)).otherwise(F.arrays_overlap("locations_b", top))
    child_low = F.when(a_in_b, F.arrays_overlap("locations_b", low)).otherwise(F.arrays_overlap("locations", low))
    relation = (
        F.when(a_in_b | b_in_a, F.when(parent_top & child_low, "SUBTOPIC_OF").otherwise("LEXICAL_OVERLAP"))
        .when(F.arrays_overlap("entities", "entities_b"), "SHARED_ENTITY")
        .when(F.size(F.array_intersect(F.array_intersect("locations", "locations_b"), top)) > 0, "CO_OCCURRENCE")
    )
    child, parent = F.when(a_in_b, F.col("topic_b")).otherwise(F.col("topic")), F.when(a_in_b, F.col("topic")).otherwise(F.col("topic_b"))
    return pair.withColumn("relation", relation).where("relation is not null").select("site", "url", child.alias("topic_a"), parent.alias("topic_b"), "relation")


def site_topics(topics: DataFrame, most: int | None = None) -> DataFrame:
    """Per site and topic: pages, terms, occurrences, places, entities; the longest name."""
    t = topics.groupBy("site", "topic").agg(
        F.max_by("name", F.struct(F.length("name"), "name")).alias("name"), F.count_distinct("url").alias("pages"), F.sort_array(F.collect_set("url")).alias("urls"), F.sum("occurrences").alias("occurrences"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_set("locations")))).alias("locations"), F.sort_array(F.array_distinct(F.flatten(F.collect_set("terms")))).alias("terms"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_set("entities")))).alias("entities"), F.max("title_or_h1").alias("title_or_h1"),
    )
    return _top(t, most, F.desc("title_or_h1"), F.desc("pages"), F.desc("occurrences"), F.lower("name"), "topic")


def site_relations(relations: DataFrame) -> DataFrame:
    """Per site, relation and pair of topics: the pages that show it."""
    return relations.groupBy("site", "topic_a", "topic_b", "relation").agg(F.count_distinct("url").alias("pages"))


# --- concepts ---


def concepts(s: DataFrame, topics: DataFrame, parsed: DataFrame) -> DataFrame:
    """site, url, concept, display, nature, locations, occurrences, title_or_h1, url_match, strength of each page.

    Candidates are the page's topics, and terms in title, headings or data, found twice, or direct. DIRECT: in title or
    H1, in structured data, or an entity there; SUPPORTED: a heading with main text or path, twice, or a topic in two
    places; else WEAK.
    """
    wide = F.arrays_overlap("locations", F.array(*[F.lit(x) for x in ("TITLE", "H1", "H2", "H3", "STRUCTURED_DATA", "ENTITY")]))
    sig = s.where(F.length("term") >= 3).select("site", "url", F.col("term").alias("concept"), "raw_term", F.col("locations").alias("sl"), F.col("occurrences").alias("so"), (wide | (F.col("occurrences") >= 2) | (F.col("confidence") == "DIRECT")).alias("keep"))
    top = topics.where(F.length("topic") >= 3).select("site", "url", F.col("topic").alias("concept"), "name", F.col("locations").alias("tl"), F.col("occurrences").alias("to"), "title_or_h1")
    c = sig.join(top, ["site", "url", "concept"], "full").where("keep or name is not null")
    page = parsed.where("p is not null").select("site", "url", F.lower("p.title").alias("_title"), F.lower(F.array_join("p.h1", "\n")).alias("_h1"), F.lower(urls.path(F.col("url"))).alias("_path"))
    c = c.join(page, ["site", "url"])
    none = F.array().cast("array<string>")
    words = F.split("concept", r"[\s-]+")
    path_words = F.split(F.regexp_replace("_path", "[/-]", " "), r"\s+")
    match = (F.size(F.array_except(words, path_words)) == 0) | F.contains("_path", F.col("concept"))
    add = lambda cond, loc: F.when(cond, F.array(F.lit(loc))).otherwise(none)
    locs = F.array_distinct(F.concat(F.coalesce("sl", none), F.coalesce("tl", none), add(match, "URL_PATH"), add(F.contains("_title", F.col("concept")), "TITLE"), add(F.contains("_h1", F.col("concept")), "H1")))
    c = c.withColumn("locations", F.sort_array(locs)).withColumn("occurrences", F.greatest(F.lit(1), F.coalesce("to", F.lit(0)), F.coalesce("so", F.lit(0)))).withColumn("url_match", match)
    has = lambda *ls: F.arrays_overlap("locations", F.array(*[F.lit(x) for x in ls]))
    c = c.withColumn("title_or_h1", has("TITLE", "H1"))
    strong = has("TITLE", "H1", "STRUCTURED_DATA")
    some = (has("H2", "H3") & has("MAIN_CONTENT")) | (has("H2", "H3") & F.col("url_match")) | (F.col("occurrences") >= 2) | (F.col("name").isNotNull() & (F.size("locations") >= 2))
    return c.select("site", "url", "concept", F.coalesce("name", "raw_term").alias("display"), F.when(F.col("name").isNotNull(), "EVIDENCED_TOPIC").otherwise("OBSERVED_CONCEPT").alias("nature"), "locations", "occurrences", "title_or_h1", "url_match", F.when(strong, "DIRECT").when(some, "SUPPORTED").otherwise("WEAK").alias("strength"))


def strength_order(c: Column) -> Column:
    return F.when(c == "DIRECT", 0).when(c == "SUPPORTED", 1).otherwise(2)


def concept_pages(c: DataFrame, supporting: int = 10) -> DataFrame:
    """Per site and concept: pages by strength, those with it in title or H1, the best ones in order, and overlap."""
    order = Window.partitionBy("site", "concept").orderBy(strength_order(F.col("strength")), F.desc("title_or_h1"), F.desc("occurrences"), F.desc(F.size("locations")), "url")
    r = c.withColumn("k", F.row_number().over(order))
    of = lambda cond: F.sort_array(F.collect_list(F.when(cond, F.col("url"))))
    out = r.groupBy("site", "concept").agg(
        F.max_by("display", F.struct(F.length("display"), "display")).alias("display"), F.count("*").alias("pages"), of(F.col("strength") == "DIRECT").alias("direct"), of(F.col("strength") == "SUPPORTED").alias("supported"), of(F.col("strength") == "WEAK").alias("weak"),
        of(F.col("title_or_h1")).alias("title_or_h1_pages"), F.transform(F.sort_array(F.collect_list(F.when(F.col("k") <= supporting, F.struct("k", "url", "strength")))), lambda x: F.struct(x["url"], x["strength"])).alias("best"),
    )
    d, sup, th = F.size("direct"), F.size("supported"), F.size("title_or_h1_pages")
    return out.withColumn("overlap", (d >= 2) | ((d + sup >= 2) & ((th >= 1) | (d >= 1))))


# --- intents ---

# Patterns as (category, kind, points, where, pattern).
INTENTS = (
    ("informational", "structural", 2, "heading", r"(?i)^(what|why|how|when|who|where|which)\b|\b(guide|tutorial|explained|overview|introduction)\b"),
    ("informational_reference", "structural", 2, "heading", r"(?i)\b(glossary|definitions?|reference|documentation|specifications?|standards?|faqs?)\b"),
    ("informational", "supporting", 1, "heading", r"(?i)\b(learn|tips|examples?|process|benefits|types of)\b"),
    ("commercial", "structural", 2, "heading", r"(?i)\b[a-z0-9]+\s+(vs\.?|versus)\s+[a-z0-9]+\b|\b(comparison|compare|alternatives?|reviews?|best|top \d+)\b"),
    ("commercial", "supporting", 1, "heading", r"(?i)\b(pricing|price|plans|features|why choose)\b"),
    ("transactional_ecommerce", "structural", 2, "action", r"(?i)\b(add to cart|buy now|checkout|order now|shop now|add to basket)\b"),
    ("transactional_lead_gen", "structural", 2, "action", r"(?i)\b(request a quote|get a quote|book (a|an|now)|schedule|enquire|free trial|request demo|contact sales)\b"),
    ("transactional", "supporting", 1, "action", r"(?i)\b(buy|order|subscribe|sign up|register|download)\b"),
    ("informational", "structural", 2, "schema", r"(?i)^(faqpage|howto|techarticle|article|blogposting|newsarticle)$"),
    ("transactional", "structural", 2, "schema", r"(?i)(offer|orderaction|buyaction|reserveaction)"),
    ("local", "structural", 2, "schema", r"(?i)(postaladdress|localbusiness|place|geocoordinates)"),
    ("navigational", "supporting", 1, "schema", r"(?i)^(website|organization)$"),
    ("navigational", "structural", 2, "path", r"(?i)/(login|portal|signin|dashboard|account)"),
    ("navigational", "supporting", 1, "path", r"^/?$"),
    ("local", "structural", 2, "text", r"(?i)\b(street|road|avenue|floor|district|suite|nagar|sector|building)\b[^\n]{0,120}\b(\d{6}|\d{5}(-\d{4})?)\b"),
    ("local", "supporting", 1, "text", r"\+91[-\s]?\d{2,5}[-\s]?\d{6,8}|\b0\d{2,4}[-\s]?\d{6,8}\b|\(\d{3}\)\s*\d{3}[-\s]\d{4}"),
    ("transactional_lead_gen", "structural", 2, "form", r"(?i)^CONTACT_INQUIRY_FORM$"),
    ("local_service", "structural", 2, "iframe", r"(?i)google\.com/maps|openstreetmap"),
)


def schema_types(p: str = "p") -> Column:
    """The @type names in a page's JSON-LD and microdata."""
    found = F.flatten(F.transform(F.col(f"{p}.jsonld"), lambda s: F.regexp_extract_all(s, F.lit(r'"@type"\s*:\s*\[?\s*"([^"]+)"'), F.lit(1))))
    return F.array_distinct(F.concat(found, F.filter(F.transform(f"{p}.microdata", lambda m: m["type"]), lambda t: t != "")))


def _matches(pattern: str):
    return lambda x: x.rlike(pattern)


def _hint(category: str, kind: str, points: int, place: str):
    return lambda x: F.struct(F.lit(category).alias("category"), F.lit(kind).alias("kind"), F.lit(points).alias("points"), F.lit(place).alias("place"), F.substring(x, 1, 120).alias("observed"))


def intent_hints() -> Column:
    """Array of (category, kind, points, place, observed) over a page's `p` and URL."""
    sources = {
        "heading": F.transform("p.headings", lambda h: h["text"]), "action": F.concat(F.transform("p.links", lambda x: x["text"]), F.transform("p.forms", lambda f: F.coalesce(f["submit"], F.lit("")))), "schema": schema_types(),
        "path": F.array(urls.path(F.col("url"))), "text": F.array("p.visible_text"), "form": F.transform("p.forms", lambda f: f["purpose"]), "iframe": F.transform(F.filter("p.resources", lambda r: r["tag"] == "iframe"), lambda r: r["url"]),
    }
    parts = []
    for category, kind, points, place, pattern in INTENTS:
        hits = F.filter(sources[place], _matches(pattern))
        parts.append(F.transform(hits, _hint(category, kind, points, place)))
    return F.concat(*parts)


def intent_evidence(parsed: DataFrame) -> DataFrame:
    """site, url, category, kind, points, place, observed: each hint at a page's purpose."""
    return parsed.where("p is not null").select("site", "url", F.explode(intent_hints()).alias("e")).select("site", "url", "e.*")


def intents(evidence: DataFrame, pages: DataFrame) -> DataFrame:
    """site, url, intent, secondary of each of pages (site, url): the category with most points among those with two
    structural or two supporting points; mixed if two tie at four or more; unspecified without any."""
    score = evidence.groupBy("site", "url", "category").agg(F.sum(F.when(F.col("kind") == "structural", F.col("points")).otherwise(0)).alias("st"), F.sum(F.when(F.col("kind") == "supporting", F.col("points")).otherwise(0)).alias("su")).where("st >= 2 or su >= 2")
    score = score.withColumn("total", F.col("st") + F.col("su"))
    w = Window.partitionBy("site", "url").orderBy(F.desc("total"), F.desc("st"), "category")
    r = score.withColumn("k", F.row_number().over(w)).groupBy("site", "url").agg(
        F.max(F.when(F.col("k") == 1, F.struct("category", "total"))).alias("a"), F.max(F.when(F.col("k") == 2, F.col("total"))).alias("second"),
        F.transform(F.sort_array(F.collect_list(F.when((F.col("k") > 1) & (F.col("total") >= 2), F.struct("k", "category")))), lambda x: x["category"]).alias("secondary"),
    )
    tie = (F.col("a.total") == F.col("second")) & (F.col("second") >= 4)
    r = r.select("site", "url", F.when(F.coalesce(tie, F.lit(False)), "mixed").otherwise(F.col("a.category")).alias("intent"), "secondary")
    return pages.select("site", "url").distinct().join(r, ["site", "url"], "left").withColumn("intent", F.coalesce("intent", F.lit("unspecified"))).withColumn("secondary", F.coalesce("secondary", F.array().cast("array<string>")))


def coverage(concept: DataFrame, topics: DataFrame, intent: DataFrame) -> DataFrame:
    """Per site and topic or concept: its pages, the primary ones, their intents, the dominant one (60 % of those that
    are classified), and whether several occur."""
    pages = concept.select("site", F.col("concept").alias("topic"), "url", ((F.col("strength") == "DIRECT") | F.col("title_or_h1")).alias("primary")).union(topics.select("site", "topic", "url", F.lit(False)))
    pages = pages.groupBy("site", "topic", "url").agg(F.max("primary").alias("primary")).join(intent.select("site", "url", "intent"), ["site", "url"], "left")
    counts = pages.groupBy("site", "topic", "intent").agg(F.count("*").alias("n"))
    known = counts.where("intent not in ('unspecified', 'mixed')").groupBy("site", "topic").agg(F.max(F.struct("n", "intent")).alias("m"), F.sum("n").alias("classified"), F.count("*").alias("kinds"))
    breakdown = counts.where("intent is not null").groupBy("site", "topic").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("intent", "n")))).alias("intents"))
    out = pages.groupBy("site", "topic").agg(F.count("*").alias("pages"), F.sort_array(F.collect_list("url")).alias("urls"), F.sort_array(F.collect_list(F.when(F.col("primary"), F.col("url")))).alias("primary_pages"))
    out = out.join(breakdown, ["site", "topic"], "left").join(known, ["site", "topic"], "left")
    dominant = F.when(F.col("m").isNull(), "unspecified").when(F.col("m.n") / F.col("classified") >= 0.6, F.col("m.intent")).otherwise("mixed")
    return out.withColumn("dominant", dominant).withColumn("multi_intent", F.coalesce("kinds", F.lit(0)) >= 2).withColumn("primary_pages", F.when(F.size("primary_pages") > 0, F.col("primary_pages")).otherwise(F.slice("urls", 1, 3))).drop("m", "classified", "kinds")


# --- pairs of pages ---


def _meeting(sets: DataFrame, least: int) -> DataFrame:
    """a, b: ids of sets (id, scope, w: array) of one scope that may have a Jaccard similarity of `least` hundredths.

    No such pair is missed: of two sets in order of size, so many of the rarest words of the smaller suffice as the larger
    one has no fewer, and more of the larger. Sizes and places are whole numbers, so nothing is lost by rounding.
    """
    up = lambda x, y: F.expr(f"({x} + {y} - 1) div ({y})")
    words = sets.where("size(w) > 0").select("scope", "id", F.size("w").alias("n"), F.explode("w").alias("t"))
    often = words.groupBy("scope", "t").agg(F.count("*").alias("df")).where("df > 1")
    mine = Window.partitionBy("scope", "id")
    words = words.join(often, ["scope", "t"]).withColumn("place", F.row_number().over(mine.orderBy("df", "t")) + F.col("n") - F.count("*").over(mine))
    words = words.where(F.col("place") <= F.col("n") - up(f"{least} * n", 100) + 1)
    x = words.where(F.col("place") <= F.col("n") - up(f"{2 * least} * n", 100 + least) + 1).select("scope", "t", F.col("id").alias("a"), F.col("n").alias("na"))
    y = words.select("scope", "t", F.col("id").alias("b"), F.col("n").alias("nb"))
    fits = (F.struct("na", "a") < F.struct("nb", "b")) & (100 * F.col("na") >= least * F.col("nb"))
    return x.join(y, ["scope", "t"]).where(fits).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def cannibalization(concept: DataFrame, topics: DataFrame, parsed: DataFrame, intent: DataFrame, family: bool = True, most: int | None = None) -> DataFrame:
    """site, topic, url_a < url_b, title and H1 similarity, shared intent and concepts, strength of pages that may
    compete: both strong on a topic, titles or H1s alike, the same intent (or a commercial and a transactional one; with
    family its kinds count as transactional), and a concept in common.

    The pages of a topic aren't paired: those without an intent have no rival, and those of one intent meet, as classes of
    equal titles and H1s, on the rarer words of these. Only pairs whose titles or H1s are alike are looked at for topics.
    """
    fold = lambda c: F.when(c.startswith("transactional"), "transactional").otherwise(c) if family else c
    known = intent.select("site", "url", "intent").where("intent <> 'unspecified'")
    concept, topics = (x.join(known, ["site", "url"], "left_semi") for x in (concept, topics))
    t = topics.select("site", "url", "topic").union(concept.select("site", "url", F.col("concept"))).distinct()
    t = t.join(concept.select("site", "url", F.col("concept").alias("topic"), "strength"), ["site", "url", "topic"], "left").withColumn("strength", F.coalesce("strength", F.lit("SUPPORTED"))).where("strength <> 'WEAK'")
    t = t.groupBy("site", "url").agg(F.collect_list(F.struct("topic", "strength")).alias("ts"))
    bag = concept.groupBy("site", "url").agg(F.collect_set("concept").alias("bag"))
    page = parsed.where("p is not null").select("site", "url", F.sort_array(text.tokens(F.col("p.title"))).alias("tt"), F.sort_array(text.tokens(F.try_element_at("p.h1", F.lit(1)))).alias("ht"))
    page = page.join(known, ["site", "url"]).join(t, ["site", "url"]).join(bag, ["site", "url"])
    kind = fold(F.col("intent"))
    scope = F.concat_ws("\n", "site", F.when(kind.isin("commercial", "transactional"), "commercial").otherwise(kind))
    page = page.withColumn("scope", scope).withColumn("id", F.md5(F.concat_ws("\n", "scope", F.array_join("tt", " "), F.array_join("ht", " "))))
    # topics of several words that the title has
    named = F.filter(F.transform("ts", lambda x: x["topic"]), lambda x: (F.size(text.tokens(x)) >= 2) & (F.size(F.array_except(text.tokens(x), F.col("tt"))) == 0))
    page = keep(page.withColumn("named", F.array_distinct(named)))
    one = keep(page.groupBy("id").agg(F.first("scope").alias("scope"), F.first("tt").alias("tt"), F.first("ht").alias("ht"), F.array_distinct(F.flatten(F.collect_set("named"))).alias("named")))
    sets = lambda w: one.select("id", "scope", F.col(w).alias("w"), "named")
    some = lambda w: sets(w).where("size(named) > 0")
    met = _meeting(sets("tt"), 35).union(_meeting(sets("ht"), 35)).union(_meeting(some("tt"), 20)).union(_meeting(some("ht"), 20)).distinct()
    met = met.union(one.where("size(tt) > 0 or size(ht) > 0").select("id", F.col("id").alias("b")))
    side = lambda df, x, *cs: df.select(F.col("id").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in cs])
    met = met.join(side(one, "a", "tt", "ht", "named"), "a").join(side(one, "b", "tt", "ht", "named"), "b")
    met = met.withColumn("title_similarity", text.jaccard(F.col("tt_a"), F.col("tt_b"))).withColumn("h1_similarity", text.jaccard(F.col("ht_a"), F.col("ht_b")))
    best = F.greatest("title_similarity", "h1_similarity")
    met = keep(met.where((best >= 0.35) | ((best >= 0.2) & F.arrays_overlap("named_a", "named_b"))).select("a", "b", "title_similarity", "h1_similarity"))
    both = met.union(met.where("a <> b").select("b", "a", "title_similarity", "h1_similarity"))
    columns = ("url", "ts", "intent", "bag", "named")
    pair = both.join(side(page, "a", "site", *columns), "a").join(side(page, "b", *columns), "b").where("url_a < url_b").withColumnRenamed("site_a", "site")
    same = fold(F.col("intent_a")) == fold(F.col("intent_b"))
    pair = pair.withColumn("shared", F.slice(F.sort_array(F.array_intersect("bag_a", "bag_b")), 1, 8)).where("size(shared) > 0")
    topic = lambda ts: F.transform(ts, lambda x: x["topic"])
    common = F.array_intersect(topic("ts_a"), topic("ts_b"))
    common = F.when(best >= 0.35, common).otherwise(F.array_intersect(common, F.array_intersect("named_a", "named_b")))
    of = lambda x: F.filter(f"ts_{x}", lambda y: y["topic"] == F.col("topic"))
    out = pair.withColumn("topic", F.explode(common)).withColumn("strong_a", F.explode(of("a"))).withColumn("strong_b", F.explode(of("b")))
    strength = F.when((F.col("strong_a.strength") == "DIRECT") & (F.col("strong_b.strength") == "DIRECT"), "DIRECT").otherwise("SUPPORTED")
    out = out.select("site", "topic", "url_a", "url_b", strength.alias("strength"), F.when(same, F.col("intent_a")).otherwise("commercial").alias("shared_intent"), F.round("title_similarity", 3).alias("title_similarity"), F.round("h1_similarity", 3).alias("h1_similarity"), F.col("shared").alias("shared_concepts"))
    return _top(out, most, "topic", "url_a", "url_b")


def _topic_pages(concept: DataFrame, topics: DataFrame) -> DataFrame:
    return topics.select("site", "topic", "url").union(concept.select("site", F.col("concept"), "url")).distinct()


def topic_gaps(concept: DataFrame, topics: DataFrame, most: int | None = None) -> DataFrame:
    """site, topic, source_url, related_url, missing: ordered pairs of pages of a topic of which the related one has two
    concepts or more that the source lacks."""
    bag = concept.groupBy("site", "url").agg(F.sort_array(F.collect_set("concept")).alias("bag"))
    t = _topic_pages(concept, topics).join(bag, ["site", "url"])
    a, b = t.select("site", "topic", F.col("url").alias("source_url"), F.col("bag").alias("sb")), t.select("site", "topic", F.col("url").alias("related_url"), F.col("bag").alias("rb"))
    missing = F.array_except(F.array_except("rb", "sb"), F.array("topic"))
    out = a.join(b, ["site", "topic"]).where("source_url <> related_url").withColumn("missing", missing).where("size(missing) >= 2")
    return _top(out.select("site", "topic", "source_url", "related_url", F.lit("OBSERVED_TOPIC_GAP").alias("gap_type"), "missing"), most, "topic", "source_url", "related_url")


def depth_gaps(concept: DataFrame, topics: DataFrame, parsed: DataFrame, most: int | None = None) -> DataFrame:
    """The same pairs where the related page has three H2 or more and the source at most one, and the related page is
    long, twice as long, or the source has none."""
    h2 = F.filter("p.headings", lambda h: h["level"] == 2)
    page = parsed.where("p is not null").select("site", "url", text.word_count(F.col("p.main_text")).alias("w"), F.size(h2).alias("h"), F.transform(h2, lambda x: x["text"]).alias("hs"))
    t = _topic_pages(concept, topics).join(page, ["site", "url"])
    a, b = t.select("site", "topic", *[F.col(c).alias(f"s_{c}") for c in ("url", "w", "h", "hs")]), t.select("site", "topic", *[F.col(c).alias(f"r_{c}") for c in ("url", "w", "h", "hs")])
    cond = (F.col("s_url") != F.col("r_url")) & (F.col("r_h") >= 3) & (F.col("s_h") <= 1) & ((F.col("r_w") >= 300) | (F.col("r_w") >= 2 * F.greatest("s_w", F.lit(1))) | (F.col("s_h") == 0))
    out = a.join(b, ["site", "topic"]).where(cond)
    return _top(out.select("site", "topic", F.col("s_url").alias("source_url"), F.col("r_url").alias("related_url"), F.lit("CONTENT_DEPTH_ASYMMETRY").alias("gap_type"), F.slice(F.array_except("r_hs", "s_hs"), 1, 4).alias("missing")), most, "topic", "source_url", "related_url")


def gap_classes(concept: DataFrame, topics: DataFrame, parsed: DataFrame) -> DataFrame:
    """The pairs of topic_gaps and depth_gaps without writing them out: they grow with the square of a topic's pages.

    site, topic, url of each page of a topic, with
    * class_id: the smallest URL of the site's pages with its topics and concepts; is_concept: whether the topic is one of
      its concepts, so that the rows of a URL hold them all;
    * offers: whether it has two concepts or more beside the topic; gaps: the number of the topic's pages of which it lacks
      two concepts or more; without: the classes, its own aside, that offer something and of which it doesn't. Every
      other page that offers is one of its gaps, and misses what that has and it has not, the topic aside;
    * h2, words; depth_gaps and depth_words: the number of the topic's pages with three H2 or more and so many words or
      more, which are its gaps in depth; 0 and null for a page with two H2 or more.

    Pages without a gap between them are few and found exactly: of the three rarest concepts of the related one (of two,
    if it has no more) the source has one.
    """
    t = _topic_pages(concept, topics)
    of = lambda df, c: df.groupBy("site", "url").agg(F.sort_array(F.collect_set(c)).alias(c))
    page = of(concept, "concept").join(of(t, "topic"), ["site", "url"]).withColumn("class", F.xxhash64("concept", "topic"))
    named = ["site", "concept", "topic", "class"]
    member = keep(page.select("site", "url", "class"))
    c = keep(page.groupBy(*named).agg(F.min("url").alias("class_id"), F.count("*").alias("size")))
    item = c.select("site", "class", F.explode("concept").alias("x"), F.size("concept").alias("m"))
    often = item.groupBy("site", "x").agg(F.count("*").alias("n"))
    rare = item.where("m >= 2").join(often, ["site", "x"]).withColumn("k", F.row_number().over(Window.partitionBy("site", "class").orderBy("n", "x"))).where("k <= 3")
    met = item.select("site", "x", F.col("class").alias("source")).join(rare.select("site", "x", F.col("class").alias("related")), ["site", "x"]).where("source <> related").select("site", "source", "related").distinct()
    a, b = c.toDF("site", "sb", "st", "source", "source_id", "source_size"), c.toDF("site", "rb", "rt", "related", "related_id", "related_size")
    lacks = F.array_except("rb", "sb")
    met = met.join(a, ["site", "source"]).join(b, ["site", "related"]).withColumn("lacks", lacks).where("size(lacks) <= 2")
    # of topics of both: the related class offers, and the source lacks one concept or none, the topic aside
    less = F.filter(F.array_intersect("st", "rt"), lambda x: (F.size(F.array_remove("rb", x)) >= 2) & (F.size(F.array_remove("lacks", x)) <= 1))
    less = met.select("site", F.col("source").alias("class"), "related_id", "related_size", F.explode(less).alias("topic"))
    less = less.groupBy("site", "class", "topic").agg(F.sort_array(F.collect_list("related_id")).alias("without"), F.sum("related_size").alias("not_gaps"))
    each = c.select("site", "class", "class_id", "size", F.explode("topic").alias("topic"), "concept")
    each = each.select("site", "class", "class_id", "size", "topic", F.array_contains("concept", F.col("topic")).alias("is_concept"), (F.size(F.array_remove("concept", F.col("topic"))) >= 2).alias("offers"))
    total = each.groupBy("site", "topic").agg(F.sum(F.when(F.col("offers"), F.col("size")).otherwise(0)).alias("all"))
    each = each.join(less, ["site", "class", "topic"], "left").join(total, ["site", "topic"])
    own = F.when(F.col("offers"), F.col("size")).otherwise(0)
    each = each.select("site", "class", "class_id", "topic", "is_concept", "offers", (F.col("all") - own - F.coalesce("not_gaps", F.lit(0))).alias("gaps"), F.coalesce("without", F.array().cast("array<string>")).alias("without"))
    out = member.join(each, ["site", "class"]).drop("class")
    size = parsed.where("p is not null").select("site", "url", F.size(F.filter("p.headings", lambda h: h["level"] == 2)).alias("h2"), text.word_count(F.col("p.main_text")).alias("words"))
    out = keep(out.join(size, ["site", "url"]).withColumn("depth_words", F.when(F.col("h2") == 0, 0).when(F.col("h2") == 1, F.least(F.lit(300), 2 * F.greatest("words", F.lit(1))))))
    # a topic has 301 such numbers at most
    deep = out.where("h2 >= 3").groupBy("site", "topic", F.least("words", F.lit(300)).alias("w")).agg(F.count("*").alias("n")).groupBy("site", "topic").agg(F.collect_list(F.struct("w", "n")).alias("deep"))
    n = F.aggregate("deep", F.lit(0).cast("long"), lambda s, x: s + F.when(x["w"] >= F.col("depth_words"), x["n"]).otherwise(0))
    out = out.join(deep, ["site", "topic"], "left").withColumn("depth_gaps", F.coalesce(n, F.lit(0)))
    return out.select("site", "topic", "url", "class_id", "is_concept", "offers", "gaps", "without", "h2", "words", "depth_gaps", "depth_words")
