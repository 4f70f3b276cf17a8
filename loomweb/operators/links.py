"""Hyperlinks: extraction, anchors, link evidence and structural findings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text, urls
from .crawl import lookup


def extract_links(parsed: DataFrame, subdomains: bool = False, crawl: DataFrame | None = None) -> DataFrame:
    """One row for each hyperlink: source_url, pos, href, target_url, target_identity_url, anchor_text, flags, rel and class.

    The anchor text is the link's text, else [IMG: alt], else [ARIA: name]. With a crawl, target identities are those
    of the records that the targets mean.
    """
    link = parsed.select("site", F.col("url").alias("source_url"), F.explode("p.links").alias("l"))
    link = link.select("site", "source_url", "l.*").withColumn("link_class", urls.link_class(F.col("href"), F.col("source_url"), subdomains))
    special = F.col("link_class") == "SPECIAL"
    link = link.withColumn("target_url", F.when(special, F.col("href")).otherwise(urls.resolve(F.col("href"), F.col("source_url"))))
    link = link.withColumn("target_identity_url", F.when(special, F.col("href")).otherwise(urls.node(F.col("target_url"))))
    name = F.when(F.col("text") != "", F.col("text")).when(F.col("alt") != "", F.concat(F.lit("[IMG: "), "alt", F.lit("]"))).when(F.col("aria") != "", F.concat(F.lit("[ARIA: "), "aria", F.lit("]"))).otherwise("")
    has = lambda r: F.array_contains("rel", r)
    out = link.select(
        "site", "source_url", "pos", "href", "target_url", "target_identity_url", name.alias("anchor_text"), (name == "").alias("is_empty_anchor"),
        ((F.col("text") == "") & (F.col("alt") != "")).alias("is_image_link"), F.when((F.col("text") == "") & (F.col("alt") != ""), F.col("alt")).alias("image_alt"),
        "rel", has("nofollow").alias("is_nofollow"), has("sponsored").alias("is_sponsored"), has("ugc").alias("is_ugc"), F.col("target").alias("target_attribute"), "link_class", "nav", "section",
    )
    if crawl is not None:
        ids = crawl.select("site", F.col("url").alias("found"), F.col("identity_url").alias("_identity")).dropDuplicates(["site", "found"])
        out = lookup(out, crawl, "target_url").join(ids, ["site", "found"], "left").withColumn("target_identity_url", F.coalesce("_identity", "target_identity_url")).drop("_identity")
    return out


def link_evidence(links: DataFrame) -> DataFrame:
    """Per page: numbers of links by class and kind of anchor."""
    n = lambda c: F.count_if(c)
    internal = F.col("link_class") == "INTERNAL"
    return links.groupBy("site", "source_url").agg(
        F.count("*").alias("links"), n(internal).alias("internal"), n(F.col("link_class") == "EXTERNAL").alias("external"), n(F.col("link_class") == "SPECIAL").alias("special"),
        n(F.col("is_empty_anchor")).alias("empty_anchors"), n(internal & text.generic_anchor(F.col("anchor_text"))).alias("generic_anchors"), n(F.col("is_image_link")).alias("image_links"),
        n(F.col("is_nofollow")).alias("nofollow"), n(F.col("is_sponsored")).alias("sponsored"), n(F.col("is_ugc")).alias("ugc"), F.count_distinct(F.when(internal, F.col("target_identity_url"))).alias("internal_targets"),
    )


def anchor_summary(links: DataFrame, top: int = 15) -> DataFrame:
    """Per site: anchors of internal links counted by kind, and the most frequent texts."""
    internal = links.where("link_class = 'INTERNAL'")
    named = internal.where("not is_empty_anchor")
    counts = named.groupBy("site", "anchor_text").agg(F.count("*").alias("n"))
    ranked = counts.withColumn("k", F.row_number().over(Window.partitionBy("site").orderBy(F.desc("n"), "anchor_text"))).where(F.col("k") <= top)
    tops = ranked.groupBy("site").agg(F.sort_array(F.collect_list(F.struct("k", "anchor_text", "n"))).alias("top_anchors"))
    total = internal.groupBy("site").agg(
        F.count("*").alias("anchors"), F.count_if("is_empty_anchor").alias("empty"), F.sort_array(F.collect_set(F.when(F.col("is_empty_anchor"), F.col("source_url")))).alias("empty_sources"),
        F.count_if(text.generic_anchor(F.col("anchor_text"))).alias("generic"),
    )
    unique = counts.groupBy("site").agg(F.count("*").alias("unique_texts"))
    return total.join(unique, "site", "left").join(tops, "site", "left")


def generic_anchors(links: DataFrame) -> DataFrame:
    """Anchors that say nothing, by target, with their number."""
    return links.where("link_class = 'INTERNAL'").where(text.generic_anchor(F.col("anchor_text"))).groupBy("site", "anchor_text", "target_identity_url").agg(F.count("*").alias("occurrences"))


def ambiguous_anchors(links: DataFrame) -> DataFrame:
    """Anchor texts, normalised, that lead to several targets of a site."""
    named = links.where("link_class = 'INTERNAL' and not is_empty_anchor").withColumn("anchor", text.anchor(F.col("anchor_text"))).where("anchor <> ''")
    return named.groupBy("site", "anchor").agg(F.count_distinct("target_identity_url").alias("targets"), F.sort_array(F.collect_set("target_identity_url")).alias("target_urls"), F.slice(F.sort_array(F.collect_set("source_url")), 1, 5).alias("sources"), F.count("*").alias("occurrences")).where("targets > 1")


def broken_links(links: DataFrame, crawl: DataFrame) -> DataFrame:
    """Internal links whose target record failed or answered 400 and up, by (source, target) once."""
    rec = crawl.select("site", "url", "identity_url", "status_code", "crawl_status", "failure_reason")
    by_id = rec.groupBy("site", F.col("identity_url").alias("target_identity_url")).agg(F.max(F.struct("url", "status_code", "crawl_status", "failure_reason")).alias("i"))
    by_url = rec.groupBy("site", F.col("url").alias("target_url")).agg(F.max(F.struct("url", "status_code", "crawl_status", "failure_reason")).alias("u"))
    hit = links.where("link_class = 'INTERNAL'").join(by_id, ["site", "target_identity_url"], "left").join(by_url, ["site", "target_url"], "left").withColumn("r", F.coalesce("i", "u"))
    bad = hit.where((F.col("r.status_code") >= 400) | (F.col("r.crawl_status") == "FAILED"))
    first = bad.groupBy("site", "source_url", "target_url").agg(F.min(F.struct("pos", "anchor_text")).alias("f"), F.max("r").alias("r"))
    reason = F.coalesce("r.failure_reason", F.when(F.col("r.status_code") > 0, F.concat(F.lit("HTTP "), F.col("r.status_code").cast("string"))), F.lit("Fetch failed"))
    return first.select("site", "source_url", "target_url", F.col("f.anchor_text").alias("anchor_text"), F.when(F.col("r.status_code") > 0, F.col("r.status_code")).alias("status_code"), reason.alias("failure_reason"))


def inbound_counts(links: DataFrame) -> DataFrame:
    """Per target page: links in, distinct linking pages, and up to five of their anchors."""
    inner = links.where("link_class = 'INTERNAL'")
    return inner.groupBy("site", F.col("target_identity_url").alias("url")).agg(
        F.count("*").alias("inlinks"), F.count_distinct("source_url").alias("unique_inlinks"), F.slice(F.sort_array(F.collect_set(F.when(~F.col("is_empty_anchor"), F.trim("anchor_text")))), 1, 5).alias("sample_anchors")
    )


def concentration(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """Per site: the ten pages with most linking pages, and the share of all internal links that the first five have."""
    ranked = nodes.where("inbound > 0").withColumn("k", F.row_number().over(Window.partitionBy("site").orderBy(F.desc("inbound"), "id"))).where("k <= 10")
    top = ranked.groupBy("site").agg(F.sort_array(F.collect_list(F.struct("k", "id", "inbound"))).alias("top_linked"), F.sum(F.when(F.col("k") <= 5, F.col("inbound"))).alias("top5"))
    total = links.where("link_class = 'INTERNAL'").groupBy("site").agg(F.count("*").alias("internal_links"))
    return total.join(top, "site", "left").withColumn("top5_pct", F.round(100.0 * F.coalesce("top5", F.lit(0)) / F.col("internal_links"), 1)).drop("top5")


def page_link_records(nodes: DataFrame, edges: DataFrame, links: DataFrame) -> DataFrame:
    """Per node of the link graph: total and distinct links in and out, samples, and what is known of its links out."""
    inn = inbound_counts(links).withColumnRenamed("url", "id")
    out = edges.where("src <> dst").groupBy("site", F.col("src").alias("id")).agg(F.sum("weight").alias("outlinks"), F.slice(F.sort_array(F.collect_set("dst")), 1, 5).alias("sample_targets"))
    sources = edges.where("src <> dst").groupBy("site", F.col("dst").alias("id")).agg(F.slice(F.sort_array(F.collect_set("src")), 1, 5).alias("sample_sources"))
    known = F.when(F.col("crawl_state") != "CRAWLED", "UNVERIFIED").when(F.col("outbound") == 0, "NO_DISCOVERED_OUTLINKS").otherwise("HAS_DISCOVERED_OUTLINKS")
    j = nodes.join(inn, ["site", "id"], "left").join(out, ["site", "id"], "left").join(sources, ["site", "id"], "left")
    return j.select("site", "id", F.coalesce("inlinks", "inbound").alias("inlinks"), F.col("inbound").alias("unique_inlinks"), F.coalesce("outlinks", F.lit(0)).alias("outlinks"), F.col("outbound").alias("unique_outlinks"), known.alias("outlink_status"), "sample_sources", "sample_targets", "sample_anchors")


def structural_findings(nodes: DataFrame, broken: DataFrame, ambiguous: DataFrame) -> DataFrame:
    """site, finding, url: pages without or with one link in, without links out, far from the root; broken and ambiguous targets."""
    crawled = F.col("crawl_state") == "CRAWLED"
    found = F.filter(
        F.array(
            F.when(crawled & (F.col("orphan_status") != "ROOT") & (F.col("inbound") == 0), "NO_DISCOVERED_INCOMING_LINKS"),
            F.when(crawled & (F.col("orphan_status") != "ROOT") & (F.col("inbound") == 1), "LIMITED_CONNECTIVITY"),
            F.when(crawled & (F.col("outbound") == 0), "ZERO_OUTLINKS"),
            F.when(F.col("click_depth") > 3, "DEEP_CLICK_DEPTH"),
        ),
        lambda x: x.isNotNull(),
    )
    a = nodes.select("site", F.explode(found).alias("finding"), F.col("id").alias("url"))
    b = broken.select("site", F.lit("BROKEN_TARGET").alias("finding"), F.col("target_url").alias("url"))
    c = ambiguous.select("site", F.lit("AMBIGUOUS_ANCHOR").alias("finding"), F.col("target_urls")[0].alias("url"))
    return a.union(b).union(c)
