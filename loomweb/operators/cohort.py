"""Packages, reviews and comparisons across sites."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

FLAGS = ("faq", "contact", "pricing", "table", "definition", "procedure", "organization_schema", "local_schema", "author", "llms_txt", "privacy", "images_described")


def site_packages(parsed: DataFrame, content: DataFrame, units: DataFrame, entities: DataFrame, topics: DataFrame, intents: DataFrame, scores: DataFrame, links: DataFrame | None = None, assets: DataFrame | None = None, agents: DataFrame | None = None, accessibility: DataFrame | None = None, security: DataFrame | None = None, grounded: DataFrame | None = None, retrieval: DataFrame | None = None) -> DataFrame:
    """One row a site: pages, words, titles, services and concepts, entities, units by type, schema types, intents, mean
    scores, where given links, images, forms, findings, claims and access, and which dimensions are available."""
    from .search import schema_types

    pages = parsed.groupBy("site").agg(F.count("*").alias("pages"), F.count_if(F.col("status_code") == 200).alias("ok_pages"), F.sort_array(F.array_distinct(F.flatten(F.collect_set(schema_types())))).alias("schema_types"))
    words = content.groupBy("site").agg(F.sum("words").alias("words"), F.round(F.avg("words"), 1).alias("mean_words"), F.count_if(F.col("tier").isin("EMPTY", "VERY_LOW", "LOW")).alias("thin_pages"))
    unit = units.groupBy("site", "type").agg(F.count("*").alias("n")).groupBy("site").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("type", "n")))).alias("units"))
    ent = entities.where("type <> 'OTHER'").groupBy("site").agg(F.sort_array(F.collect_set("normalized")).alias("entities"), F.sort_array(F.collect_set(F.when(F.col("type").isin("SERVICE", "PRODUCT"), F.col("normalized")))).alias("services"))
    top = topics.groupBy("site").agg(F.sort_array(F.collect_set("topic")).alias("topics"))
    kinds = intents.groupBy("site", "intent").agg(F.count("*").alias("n")).groupBy("site").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("intent", "n")))).alias("intents"))
    means = scores.groupBy("site").agg(*[F.round(F.avg(c), 1).alias(c) for c, t in scores.dtypes if t in ("int", "bigint", "double") and c != "url"])
    out = pages
    for part in (words, unit, ent, top, kinds, means):
        out = out.join(part, "site", "left")
    if links is not None:
        out = out.join(links.groupBy("site").agg(F.count_if(F.col("link_class") == "INTERNAL").alias("internal_links"), F.count_if(F.col("link_class") == "EXTERNAL").alias("external_links")), "site", "left")
    for part in _measures(assets, agents, accessibility, security, grounded, retrieval):
        out = out.join(part, "site", "left")
    state = lambda c: F.when(c.isNull(), "UNAVAILABLE").otherwise("AVAILABLE")
    return out.withColumn("dimensions", F.create_map(*[x for name, col in DIMENSIONS.items() for x in (F.lit(name), state(F.col(col) if col in out.columns else F.lit(None)))]))


DIMENSIONS = {
    "crawl": "pages", "content": "words", "answers": "units", "entities": "entities", "topics": "topics", "intents": "intents", "scores": "health", "structured_data": "schema_types", "links": "internal_links",
    "multimodal": "visual_assets", "agents": "forms", "accessibility": "accessibility_findings", "security": "security_findings", "claims": "claims", "retrieval": "search_access",
}


def _measures(assets, agents, accessibility, security, grounded, retrieval):
    """Per site, of the tables that are given: images, forms and controls, findings, claims, and search crawlers' access."""
    share = lambda part, whole: F.round(F.count_if(part) / F.nullif(F.count_if(whole), F.lit(0)), 4)
    if assets is not None:
        told = F.col("role") == "informational"
        yield assets.groupBy("site").agg(F.count("*").alias("visual_assets"), share(told & (F.col("status") == "ALT_REPRESENTED"), told).alias("alt_ratio"), F.count_if(told & (F.col("status") == "VISUAL_ONLY_OBSERVED")).alias("visual_only"))
    if agents is not None:
        form = ~F.col("signal").isin("DESCRIPTIVE_NAVIGATION", "SCHEMA_POTENTIAL_ACTION")
        yield agents.groupBy("site").agg(F.count_if(form).alias("forms"), F.count_if(form & (F.col("status") == "LABELED")).alias("labelled_forms"), F.count_if(F.col("signal") == "SCHEMA_POTENTIAL_ACTION").alias("declared_actions"))
    if accessibility is not None:
        yield accessibility.groupBy("site").agg(F.sum("count").alias("accessibility_findings"))
    if security is not None:
        yield security.groupBy("site").agg(F.count("*").alias("security_findings"))
    if grounded is not None:
        yield grounded.groupBy("site").agg(F.count("*").alias("claims"), share(F.col("support") == "SUPPORTED_ON_SITE", F.lit(True)).alias("grounding_ratio"), F.count_if(F.col("support") == "CONTRADICTED_ON_SITE").alias("contradicted"))
    if retrieval is not None:
        search = F.col("purpose") == "search_index"
        yield retrieval.groupBy("site").agg(share(search & (F.col("status") == "ALLOWED"), search).alias("search_access"))


def reviews(packages: DataFrame) -> DataFrame:
    """Packages with profile statements: what a site is about, how it answers, what is thin, what is missing."""
    n = lambda kind: F.coalesce(F.col("units").getItem(kind), F.lit(0))
    total = F.aggregate(F.map_values(F.coalesce("units", F.create_map().cast("map<string,bigint>"))), F.lit(0).cast("bigint"), lambda a, x: a + x)
    main = F.element_at(F.map_keys("intents"), F.array_position(F.map_values("intents"), F.array_max(F.map_values("intents"))).cast("int"))
    return packages.withColumn("answer_units", total).withColumn("main_intent", main).withColumn("thin_share", F.round(F.col("thin_pages") / F.greatest("pages", F.lit(1)), 3)).withColumn(
        "absent", F.filter(F.array(F.when(n("FAQ") == 0, "FAQ"), F.when(n("TABLE") == 0, "TABLE"), F.when(n("DEFINITION") == 0, "DEFINITION"), F.when(n("LOCATION_CONTACT") == 0, "LOCATION_CONTACT"), F.when(F.size("schema_types") == 0, "STRUCTURED_DATA")), lambda x: x.isNotNull())
    )


def frequency(items: DataFrame, common: int = 2) -> DataFrame:
    """item, sites, on, state of (site, item): COMMON on so many sites, UNIQUE on one."""
    g = items.where("item is not null").groupBy("item").agg(F.count_distinct("site").alias("sites"), F.sort_array(F.collect_set("site")).alias("on"))
    return g.withColumn("state", F.when(F.col("sites") >= common, "COMMON").when(F.col("sites") == 1, "UNIQUE").otherwise("PARTIAL"))


def overlap_matrix(items: DataFrame) -> DataFrame:
    """site_a < site_b, shared, similarity: Jaccard of sites by their items, for pairs that share one; from counts, so
    that no site's items are gathered."""
    i = items.select("site", "item").where("item is not null").distinct()
    size = i.groupBy("site").agg(F.count("*").alias("n"))
    a, b = i.select(F.col("site").alias("site_a"), "item"), i.select(F.col("site").alias("site_b"), "item")
    s = a.join(b, "item").where("site_a < site_b").groupBy("site_a", "site_b").agg(F.count("*").alias("shared"))
    s = s.join(size.select(F.col("site").alias("site_a"), F.col("n").alias("na")), "site_a").join(size.select(F.col("site").alias("site_b"), F.col("n").alias("nb")), "site_b")
    return s.select("site_a", "site_b", "shared", F.round(F.col("shared") / (F.col("na") + F.col("nb") - F.col("shared")), 4).alias("similarity"))


TARGET_METRICS = ("health", "technical_score", "citability", "schema_type_count", "answer_units", "alt_ratio", "forms", "visual_assets", "accessibility_findings", "security_findings", "grounding_ratio", "trust", "mean_words")


def target_vs_cohort(packages: DataFrame, target: str, metrics: tuple[str, ...] = TARGET_METRICS) -> DataFrame:
    """metric, target, cohort (the others' mean), delta, standing."""
    counts = {"schema_type_count": F.size("schema_types"), "answer_units": F.aggregate(F.map_values("units"), F.lit(0).cast("bigint"), lambda a, x: a + x)}
    packages = packages.withColumns({k: v for k, v in counts.items() if k not in packages.columns})
    have = [m for m in metrics if m in packages.columns]
    long = packages.select("site", *[F.col(m).cast("double").alias(m) for m in have]).unpivot(["site"], have, "metric", "value")
    g = long.groupBy("metric").agg(F.max(F.when(F.col("site") == target, F.col("value"))).alias("target"), F.avg(F.when(F.col("site") != target, F.col("value"))).alias("cohort"))
    d = F.col("target") - F.col("cohort")
    return g.withColumn("delta", F.round(d, 2)).withColumn("standing", F.when(d.isNull(), "INSUFFICIENT_EVIDENCE").when(d > 0, "ABOVE").when(d < 0, "BELOW").otherwise("EQUAL"))


def facets(reviewed: DataFrame) -> DataFrame:
    """site, facet, value, rank: sites compared by intents, concentration of topics, answers, technique and trust."""
    cols = {"answer_units": "answerability", "technical_score": "technical", "trust": "trust", "citability": "citability", "mean_words": "depth", "thin_share": "thinness"}
    have = {c: n for c, n in cols.items() if c in reviewed.columns}
    long = reviewed.select("site", *[F.col(c).cast("double").alias(n) for c, n in have.items()], F.size("topics").cast("double").alias("topic_breadth")).unpivot(["site"], [*have.values(), "topic_breadth"], "facet", "value")
    return long.withColumn("rank", F.rank().over(Window.partitionBy("facet").orderBy(F.desc_nulls_last("value"))))


def voids(reviewed: DataFrame) -> DataFrame:
    """void, present, absent, state: what some sites of the cohort have and others lack."""
    n = lambda *kinds: sum(F.coalesce(F.col("units").getItem(k), F.lit(0)) for k in kinds) > 0
    schema = lambda pattern: F.exists("schema_types", lambda t: t.rlike(pattern))
    rules = {
        "FAQ": n("FAQ"), "DEFINITION": n("DEFINITION"), "DIRECT_ANSWER": n("DIRECT_ANSWER"), "PROCEDURE": n("PROCEDURE_STEPS"), "TABLE_OR_SPECIFICATION": n("TABLE", "SPECIFICATION"), "REQUIREMENTS": n("REQUIREMENTS_ELIGIBILITY"),
        "CONTACT": n("LOCATION_CONTACT"), "POLICY_DATES": n("DATE_POLICY"), "ORGANIZATION_SCHEMA": schema("Organization"), "LOCAL_SCHEMA": schema("LocalBusiness|Place"), "ANY_SCHEMA": F.size("schema_types") > 0, "SERVICES": F.size(F.coalesce("services", F.array().cast("array<string>"))) > 0,
    }
    long = reviewed.select("site", F.explode(F.array(*[F.struct(F.lit(k).alias("void"), F.coalesce(v, F.lit(False)).alias("has")) for k, v in rules.items()])).alias("x")).select("site", "x.*")
    g = long.groupBy("void").agg(F.sort_array(F.collect_list(F.when(F.col("has"), F.col("site")))).alias("present"), F.sort_array(F.collect_list(F.when(~F.col("has"), F.col("site")))).alias("absent"))
    return g.withColumn("state", F.when(F.size("absent") == 0, "COMMON").when(F.size("present") == 0, "INSUFFICIENT_EVIDENCE").when(F.size("present") == 1, "UNIQUE").otherwise("OBSERVED_DIFFERENCE"))


def uncertainty(packages: DataFrame) -> DataFrame:
    """dimension, state, sites: how many sites have each dimension."""
    return packages.select("site", F.explode("dimensions").alias("dimension", "state")).groupBy("dimension", "state").agg(F.count("*").alias("sites"))


def facts_and_analyses(reviewed: DataFrame) -> DataFrame:
    """site, kind, statement: measured facts apart from conclusions."""
    fact = F.array(F.format_string("%d pages with %d words", F.col("pages"), F.coalesce("words", F.lit(0))), F.format_string("%d answer units", F.col("answer_units")))
    analysis = F.array(F.format_string("mostly %s pages", F.coalesce("main_intent", F.lit("unspecified"))), F.format_string("absent: %s", F.array_join("absent", ", ")))
    a = reviewed.select("site", F.lit("FACT").alias("kind"), F.explode(fact).alias("statement"))
    return a.union(reviewed.select("site", F.lit("ANALYSIS"), F.explode(analysis)))


def cross_site_matrix(packages: DataFrame, metrics: tuple[str, ...] = ("pages", "words", "technical_score", "citability", "trust", "health")) -> DataFrame:
    """metric by site, one column a site (a cohort's, given by its packages)."""
    have = [m for m in metrics if m in packages.columns]
    long = packages.select("site", *[F.col(m).cast("double").alias(m) for m in have]).unpivot(["site"], have, "metric", "value")
    return long.groupBy("metric").pivot("site").agg(F.first("value"))


# Known limits as (id, severity, class, category, statement).
GAPS = (
    ("rendering", "P1", "EVIDENCE_LIMITATION", "EXTRACTION_BLIND_SPOT", "Pages are read as archived; nothing is rendered here."),
    ("network", "P1", "EVIDENCE_LIMITATION", "DETECTION_BLIND_SPOT", "Certificates, timings and answers of services come as tables."),
    ("index_state", "P2", "EVIDENCE_LIMITATION", "SEARCH_INTENT", "Index entries are known from a search console only."),
    ("language", "P2", "TRUE_CAPABILITY_GAP", "SEMANTIC_INTERPRETATION", "Intent patterns are English."),
)


def capability_gaps(spark) -> DataFrame:
    return spark.createDataFrame(list(GAPS), "id string, severity string, classification string, category string, statement string")


def gap_breakdown(gaps: DataFrame) -> DataFrame:
    return gaps.rollup("classification", "severity").agg(F.count("*").alias("gaps"))
