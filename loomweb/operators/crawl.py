"""Frontier admission, record lookup and the roll-up of a crawl."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import urls


def admit(candidates: DataFrame, base_url: Column, max_depth: int = 3, max_pages: int = 50, variants: int = 20, subdomains: bool = False, seen: DataFrame | None = None) -> DataFrame:
    """candidates (site, seq, url, depth, parent_url) with identity_url, normalized_url and verdict.

    The verdict is the first that holds of EMPTY, NON_HTML, OFF_DOMAIN, TOO_DEEP, DUPLICATE (an earlier seq has the
    normalised URL, or `seen` (site, normalized_url) does), VARIANT (over so many query variants of one path), BUDGET
    (over max_pages in the site), ADMITTED.
    """
    url = F.trim(F.col("url"))
    c = candidates.withColumn("normalized_url", urls.normalise(F.col("url"), F.col("parent_url"))).withColumn("identity_url", urls.identity(F.col("url"), F.col("parent_url")))
    early = (
        F.when(F.coalesce(url, F.lit("")) == "", "EMPTY")
        .when(~urls.crawlable(url), "NON_HTML")
        .when(~urls.same_domain(url, base_url, subdomains), "OFF_DOMAIN")
        .when(F.col("depth") > max_depth, "TOO_DEEP")
    )
    c = c.withColumn("verdict", early)
    nth = F.row_number().over(Window.partitionBy("site", "normalized_url").orderBy(F.col("verdict").isNotNull(), "seq", "url"))
    c = c.withColumn("verdict", F.coalesce("verdict", F.when(nth > 1, "DUPLICATE")))
    if seen is not None:
        s = seen.select("site", "normalized_url", F.lit(True).alias("_seen")).distinct()
        c = c.join(s, ["site", "normalized_url"], "left").withColumn("verdict", F.coalesce("verdict", F.when(F.col("_seen"), "DUPLICATE"))).drop("_seen")
    query = urls.query_of(F.col("normalized_url")) != ""
    c = c.withColumn("_path", F.regexp_replace("normalized_url", r"\?.*$", ""))
    nth = F.row_number().over(Window.partitionBy("site", "_path", F.col("verdict").isNull() & query).orderBy("seq", "url"))
    c = c.withColumn("verdict", F.coalesce("verdict", F.when(query & (nth > variants), "VARIANT")))
    nth = F.row_number().over(Window.partitionBy("site", F.col("verdict").isNull()).orderBy("seq", "url"))
    return c.withColumn("verdict", F.coalesce("verdict", F.when(nth > max_pages, "BUDGET"), F.lit("ADMITTED"))).drop("_path")


def outcome(status_code: Column, blocked: Column, error: Column) -> Column:
    """The crawl status that a fetch ends in."""
    return (
        F.when(blocked, "BLOCKED")
        .when(error.isNotNull(), "FAILED")
        .when(status_code.between(300, 399), "REDIRECTED")
        .when(status_code >= 400, "FAILED")
        .when(status_code == 200, "FETCHED")
        .when(status_code.isNull(), "QUEUED")
        .otherwise("SKIPPED")
    )


def retry_delay(attempt: Column, status_code: Column, retry_after: Column, base: float = 0.5, most: float = 5.0) -> Column:
    """Seconds before a fetch is tried again: Retry-After of a 429 or 503 up to 5 s, else doubled each time; null if it isn't."""
    wait = F.when(status_code.isin(429, 503) & retry_after.isNotNull(), F.least(retry_after.cast("double"), F.lit(most))).otherwise(F.least(F.lit(base) * F.pow(F.lit(2.0), attempt), F.lit(most)))
    return F.when(status_code.isin(429, 503) | (status_code >= 500) | status_code.isNull(), wait)


def lookup(keys: DataFrame, crawl: DataFrame, column: str = "target") -> DataFrame:
    """keys with `found`, the url of the crawl record that their URL means, or null.

    By the raw URL, else by identity, else by the normalised URL, the last only if the identities agree or neither has
    a query. Of records with the same raw URL or identity the last by url wins, of those with the same normalised URL
    the first. keys and crawl have a site.
    """
    k = keys.withColumn("_raw", F.trim(F.col(column)))
    distinct = k.select("site", "_raw").where("_raw is not null and _raw <> ''").distinct().withColumn("_id", urls.identity(F.col("_raw"))).withColumn("_norm", urls.normalise(F.col("_raw")))
    by_raw = crawl.groupBy("site", F.col("url").alias("_raw")).agg(F.max("url").alias("r"))
    by_id = crawl.groupBy("site", F.col("identity_url").alias("_id")).agg(F.max("url").alias("i"))
    by_norm = crawl.groupBy("site", F.col("normalized_url").alias("_norm")).agg(F.min(F.struct("url", "identity_url")).alias("n"))
    safe = (F.col("n.identity_url") == F.col("_id")) | (~F.contains("_raw", F.lit("?")) & ~F.contains("n.url", F.lit("?")))
    hit = distinct.join(by_raw, ["site", "_raw"], "left").join(by_id, ["site", "_id"], "left").join(by_norm, ["site", "_norm"], "left")
    hit = hit.select("site", "_raw", F.coalesce("r", "i", F.when(safe, F.col("n.url"))).alias("found"))
    return k.join(hit, ["site", "_raw"], "left").drop("_raw")


def page_issues(parsed: DataFrame) -> DataFrame:
    """Per page: title and description lengths, H1 count, canonical, words, and issue codes."""
    code, words, ok = F.col("status_code"), F.coalesce("p.crawl_words", F.lit(0)), F.col("status_code") == 200
    description = F.coalesce(F.col("p.meta").getItem("description"), F.lit(""))
    h1 = F.size(F.filter("p.headings", lambda h: h["level"] == 1))
    has = F.col("p").isNotNull()
    issues = F.filter(
        F.array(
            F.when(code >= 400, F.concat(F.lit("HTTP_"), code.cast("string"))),
            F.when(has & ok & (description == ""), "NO_META_DESC"),
            F.when(has & ok & (h1 == 0), "MISSING_H1"),
            F.when(has & ok & (words < 300), "THIN_CONTENT"),
        ),
        lambda x: x.isNotNull(),
    )
    return parsed.where(F.col("crawl_status").isin("FETCHED", "REDIRECTED") & code.isNotNull()).select(
        "site", "url", "status_code", F.coalesce("p.title", F.lit("")).alias("title"), F.length(F.coalesce("p.title", F.lit(""))).alias("title_length"), F.length(description).alias("meta_desc_length"),
        F.greatest(h1, F.lit(0)).alias("h1_count"), (F.size(F.filter("p.canonical", lambda c: c != "")) > 0).alias("has_canonical"), words.alias("word_count"), issues.alias("issues"),
    )


def rollup(parsed: DataFrame) -> DataFrame:
    """Per site: counts by crawl status and discovery source, URLs by issue, titles used more than once, completeness."""
    issue = page_issues(parsed)
    has = lambda code: F.sort_array(F.collect_list(F.when(F.array_contains("issues", code), F.col("url"))))
    by_page = issue.groupBy("site").agg(
        has("NO_META_DESC").alias("no_description"), has("MISSING_H1").alias("missing_h1"), has("THIN_CONTENT").alias("thin"), F.count_if(F.size("issues") > 0).alias("pages_with_issues")
    )
    titles = duplicate_titles(issue).groupBy("site").agg(F.sort_array(F.collect_list("title")).alias("duplicate_titles"))
    status = [F.count_if(F.col("crawl_status") == s).alias(s.lower()) for s in ("QUEUED", "FETCHED", "SKIPPED", "BLOCKED", "FAILED", "REDIRECTED", "DUPLICATE")]
    sources = [F.count_if(F.col("discovery_source") == "rendered_dom_link").alias("rendered_only"), F.count_if(F.col("discovery_source") == "sitemap").alias("sitemap_only"), F.count_if(F.col("discovery_source").isin("internal_link", "seed")).alias("navigation_only")]
    broken = F.sort_array(F.collect_list(F.when((F.col("status_code") >= 400) | (F.col("crawl_status") == "FAILED"), F.col("url")))).alias("broken")
    done = F.when(F.col("queued") > 0, "CRAWL_LIMIT_REACHED").when((F.col("failed") > 0) & (F.col("fetched") == 0), "CRAWL_FAILED").otherwise("CRAWL_COMPLETE")
    out = parsed.groupBy("site").agg(F.count("*").alias("records"), *status, *sources, broken).withColumn("completeness", done)
    return out.join(by_page, "site", "left").join(titles, "site", "left")


def duplicate_titles(pages: DataFrame) -> DataFrame:
    """site, title, pages of non-empty titles that several pages of a site have."""
    return pages.where("title <> ''").groupBy("site", "title").agg(F.count("*").alias("pages")).where("pages > 1")
