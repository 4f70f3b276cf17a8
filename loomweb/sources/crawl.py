"""Crawl tables: one row for each fetched URL, from archived pages or from records in files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import urls

SCHEMA = """site string, url string, status_code int, crawl_status string, depth int, parent_url string, discovery_source string, content_type string, response_bytes bigint,
fetch_time_sec double, retry_count int, failure_reason string, redirect_url string, response_headers map<string,array<string>>, discovered_links array<string>, raw_html string"""
STATUSES = ("QUEUED", "FETCHED", "SKIPPED", "BLOCKED", "FAILED", "REDIRECTED", "DUPLICATE")


def crawl_frame(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """A crawl table of literal records; missing fields get defaults: 200, FETCHED, depth 0."""
    defaults = {"status_code": 200, "crawl_status": "FETCHED", "depth": 0, "discovery_source": "internal_link", "fetch_time_sec": 0.0, "retry_count": 0, "response_headers": {}, "discovered_links": []}
    names = [f.split()[0] for f in SCHEMA.replace("map<string,array<string>>", "m").replace("\n", " ").split(", ")]
    data = [tuple(({**defaults, "site": "site"} | r).get(n) for n in names) for r in rows]
    return keyed(spark.createDataFrame(data, SCHEMA.replace("\n", " ")))


def keyed(crawl: DataFrame) -> DataFrame:
    """With identity_url and normalized_url, for lookups."""
    return crawl.withColumn("url", F.trim("url")).withColumn("identity_url", urls.identity(F.col("url"))).withColumn("normalized_url", urls.normalise(F.col("url")))


def read_crawl(spark: SparkSession, path: str) -> DataFrame:
    """Crawl records from line-JSON or Parquet files in a folder."""
    reader = spark.read.schema(SCHEMA.replace("\n", " "))
    return keyed(reader.parquet(path) if path.rstrip("/").endswith(".parquet") else reader.json(path))


def from_pages(pages: DataFrame, by_domain: bool = False) -> DataFrame:
    """A crawl table of archived pages (page_id, url, html): a site is a host, or the last two labels of one; every page
    was fetched."""
    site = urls.host(F.col("url"))
    site = urls.root_domain(site) if by_domain else site
    base = pages.where("url is not null").select(site.alias("site"), "url", F.col("html").alias("raw_html"), F.lit(200).alias("status_code"), F.lit("FETCHED").alias("crawl_status"))
    base = base.withColumn("depth", F.when(urls.path(F.col("url")).isin("", "/"), 0).otherwise(1)).withColumn("discovery_source", F.lit("internal_link"))
    base = base.withColumn("response_headers", F.create_map().cast("map<string,array<string>>")).withColumn("redirect_url", F.lit(None).cast("string")).withColumn("fetch_time_sec", F.lit(0.0)).withColumn("failure_reason", F.lit(None).cast("string")).withColumn("parent_url", F.lit(None).cast("string")).withColumn("discovered_links", F.array().cast("array<string>"))
    return keyed(base)


def eligible(crawl: DataFrame) -> DataFrame:
    """Fetched pages with content; the filter comes before any parsing."""
    return crawl.where("(status_code = 200 or status_code is null) and length(raw_html) > 0")


def render_needed(parsed: DataFrame) -> DataFrame:
    """url, render: pages that seem to need a browser: an application root, or under 50 words and a script."""
    return parsed.select("site", "url", (F.col("p.spa_root") | ((F.col("p.body_words") < 50) & (F.col("p.scripts") >= 1))).alias("render"))


def primary_html(raw: DataFrame, rendered: DataFrame, least: int = 20) -> DataFrame:
    """raw with its HTML replaced by the rendered one where that holds `least` characters or more; html_source says which."""
    r = rendered.select("url", F.col("raw_html").alias("_rendered"))
    use = F.coalesce(F.length("_rendered"), F.lit(0)) >= least
    out = raw.join(r, "url", "left")
    return out.withColumn("html_source", F.when(use, "rendered").otherwise("raw")).withColumn("raw_html", F.when(use, F.col("_rendered")).otherwise(F.col("raw_html"))).drop("_rendered")
