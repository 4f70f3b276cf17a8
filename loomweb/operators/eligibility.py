"""May a page be crawled and indexed, and which address stands for it; URL representations of the same page."""

from __future__ import annotations

from urllib.parse import parse_qsl, urlencode, urlsplit

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import urls
from ..functions.dims import TRACKING
from .crawl import lookup


def directives(value: Column) -> Column:
    """A robots value's directives: lower case, each once."""
    return F.array_distinct(F.filter(F.transform(F.split(F.lower(F.coalesce(value, F.lit(""))), ","), lambda x: F.trim(x)), lambda x: x != ""))


def header_values(headers: Column, name: str) -> Column:
    """All values of a header, whatever its case; an empty array without it."""
    return F.flatten(F.map_values(F.map_filter(headers, lambda k, _: F.lower(F.trim(k)) == name)))


def x_robots(headers: Column) -> Column:
    """X-Robots-Tag directives; a leading agent name is dropped."""
    joined = F.array_join(F.transform(header_values(headers, "x-robots-tag"), lambda v: F.regexp_replace(v, r"^\s*[A-Za-z][\w-]*bot\s*:\s*", "")), ",")
    return directives(joined)


def canonical_of(parsed: DataFrame) -> DataFrame:
    """site, url, canonical: the first declared canonical, resolved against the page."""
    first = F.try_element_at(F.filter("p.canonical", lambda c: c != ""), F.lit(1))
    return parsed.select("site", "url", F.when(first.isNotNull(), urls.resolve(first, F.col("url"))).alias("canonical"))


def crawlability(status: Column, allowed: Column | None = None) -> Column:
    """BLOCKED, ALLOWED or UNKNOWN from the crawl, else from a robots verdict."""
    out = F.when(status == "BLOCKED", "BLOCKED")
    if allowed is not None:
        out = out.when(allowed, "ALLOWED").when(~allowed, "BLOCKED")
    return out.when(status == "FETCHED", "ALLOWED").otherwise("UNKNOWN")


def indexability(code: Column, meta: Column, header: Column, has_content: Column) -> Column:
    """REDIRECT, ERROR, NOINDEX, INDEXABLE or UNKNOWN; `none` means noindex, a code of 0 an unknown answer."""
    no = F.arrays_overlap(F.concat(meta, header), F.array(F.lit("noindex"), F.lit("none")))
    fine = code.between(200, 299) | ((code == 0) & has_content)
    return F.when(code.between(300, 399), "REDIRECT").when((code >= 400) | ((code == 0) & ~has_content), "ERROR").when(fine & no, "NOINDEX").when(fine, "INDEXABLE").otherwise("UNKNOWN")


def confirmation(status: Column) -> Column:
    """What a search console says of a page; nothing else confirms an index entry."""
    return F.when(status == "INDEXED", "CONFIRMED_INDEXED").when(status == "NOT_INDEXED", "CONFIRMED_NOT_INDEXED").otherwise("UNKNOWN")


def eligibility(parsed: DataFrame, sitemap_urls: DataFrame | None = None, links: DataFrame | None = None, robots: DataFrame | None = None, telemetry: DataFrame | None = None) -> DataFrame:
    """Per record: directives, crawlability, indexability, canonical signal, confirmation, links in, presence in a sitemap."""
    c = parsed.join(canonical_of(parsed), ["site", "url"], "left")
    target = F.trim("canonical")
    recs = parsed.select("site", "url", "normalized_url", F.struct("status_code", "crawl_status").alias("rec"))
    raw = recs.groupBy("site", F.col("url").alias("canonical")).agg(F.max("rec").alias("r1"))
    norm = recs.groupBy("site", F.col("normalized_url").alias("canonical_norm")).agg(F.max("rec").alias("r2"))
    c = c.withColumn("canonical", target).withColumn("canonical_norm", urls.normalise(F.col("canonical"))).join(raw, ["site", "canonical"], "left").join(norm, ["site", "canonical_norm"], "left").withColumn("t", F.coalesce("r1", "r2"))
    bad = (F.col("t.status_code") >= 400) | F.col("t.crawl_status").isin("FAILED", "REDIRECTED")
    signal = (
        F.when(F.coalesce("canonical", F.lit("")) == "", "MISSING")
        .when(~F.col("canonical").rlike("^https?://[^/?#]+"), "INVALID_TARGET")
        .when(F.col("canonical_norm") == F.col("normalized_url"), "SELF_REFERENCING")
        .when(F.coalesce(bad, F.lit(False)), "INVALID_TARGET")
        .when(urls.same_domain(F.col("canonical"), F.col("url")), "CANONICALIZED_ELSEWHERE")
        .otherwise("CROSS_DOMAIN")
    )
    meta, header = directives(F.col("p.meta").getItem("robots")), x_robots(F.col("response_headers"))
    out = c.withColumn("meta_robots", meta).withColumn("x_robots", header)
    if robots is not None:
        out = out.join(robots.select("site", "url", "allowed"), ["site", "url"], "left")
    out = out.withColumn("crawlability", crawlability(F.col("crawl_status"), F.col("allowed") if robots is not None else None))
    out = out.withColumn("indexability", indexability(F.coalesce("status_code", F.lit(0)), F.col("meta_robots"), F.col("x_robots"), F.col("p").isNotNull())).withColumn("canonicalization", signal)
    if telemetry is not None:
        out = out.join(telemetry.select("site", "url", F.col("status").alias("_t")), ["site", "url"], "left").withColumn("confirmation", confirmation(F.col("_t"))).drop("_t")
    else:
        out = out.withColumn("confirmation", F.lit("UNKNOWN"))
    if links is not None:
        inn = links.where("link_class = 'INTERNAL'").groupBy("site", urls.normalise(F.col("target_url")).alias("normalized_url")).agg(F.count("*").alias("inbound"))
        out = out.join(inn, ["site", "normalized_url"], "left").na.fill(0, ["inbound"])
    if sitemap_urls is not None:
        s = sitemap_urls.select("site", "identity_url", F.lit(True).alias("in_sitemap")).distinct()
        out = out.join(s, ["site", "identity_url"], "left").withColumn("in_sitemap", F.coalesce("in_sitemap", F.lit(False)))
    return out.drop("p", "r1", "r2", "t", "canonical_norm")


# --- representations of one page ---


def anomaly(a: str, b: str) -> str:
    """In what two URLs of a page differ, the first that applies."""
    x, y = urlsplit(a.strip()), urlsplit(b.strip())
    if x.scheme.lower() != y.scheme.lower():
        return "PROTOCOL_HTTP_HTTPS"
    hx, hy = x.netloc.lower().split(":")[0], y.netloc.lower().split(":")[0]
    if hx != hy and hx.removeprefix("www.") == hy.removeprefix("www."):
        return "WWW_SUBDOMAIN"
    if ("//" in x.path) != ("//" in y.path):
        return "MULTIPLE_SLASHES"
    trim = lambda p: p.rstrip("/") if len(p) > 1 else p
    if trim(x.path) == trim(y.path) and x.path != y.path:
        return "TRAILING_SLASH"
    if x.path.lower() == y.path.lower() and x.path != y.path:
        return "PATH_CASING"
    qx, qy = parse_qsl(x.query, keep_blank_values=True), parse_qsl(y.query, keep_blank_values=True)
    tracked = lambda q: any(k.lower() in TRACKING for k, _ in q)
    if tracked(qx) != tracked(qy):
        return "TRACKING_PARAMETERS"
    if sorted(qx) == sorted(qy) and x.query != y.query:
        return "QUERY_PARAM_ORDER"
    return "TRAILING_SLASH"


def preferred(a: str, b: str, kind: str) -> bool:
    """Whether the first of two representations is the better address."""
    x = urlsplit(a.strip())
    q = parse_qsl(x.query, keep_blank_values=True)
    return {
        "PROTOCOL_HTTP_HTTPS": x.scheme.lower() == "https",
        "WWW_SUBDOMAIN": not x.netloc.lower().startswith("www."),
        "MULTIPLE_SLASHES": "//" not in x.path,
        "TRAILING_SLASH": not x.path.endswith("/") and len(x.path) > 1,
        "PATH_CASING": x.path == x.path.lower(),
        "TRACKING_PARAMETERS": not any(k.lower() in TRACKING for k, _ in q),
        "QUERY_PARAM_ORDER": x.query == urlencode(sorted(q)),
    }.get(kind, True)


def representations(parsed: DataFrame, extra_urls: DataFrame | None = None) -> DataFrame:
    """anomaly_type, primary_url, duplicate_url, evidence_type of pairs of a site's URLs that are one page by all but form.

    Evidence, best first: one redirects to the other, one names the other canonical, their visible texts are equal or
    differ; else it is only potential. extra_urls (site, url) are URLs seen in links but not fetched.
    """
    known = parsed.select("site", "url")
    every = known.union(extra_urls.select("site", "url")).distinct() if extra_urls is not None else known.distinct()
    every = every.withColumn("key", urls.hygiene(F.col("url"))).withColumn("bare", F.regexp_replace("url", "#.*$", ""))
    a = every.select("site", "key", F.col("url").alias("a"), F.col("bare").alias("bare_a"))
    b = every.select("site", "key", F.col("url").alias("b"), F.col("bare").alias("bare_b"))
    pairs = a.join(b, ["site", "key"]).where("a < b and bare_a <> bare_b")

    def judge(x: pd.Series, y: pd.Series) -> pd.DataFrame:
        kinds = [anomaly(i, j) for i, j in zip(x, y, strict=True)]
        return pd.DataFrame({"kind": kinds, "first": [preferred(i, j, k) for i, j, k in zip(x, y, kinds, strict=True)]})

    pairs = pairs.withColumn("v", F.pandas_udf(judge, "kind string, first boolean")("a", "b"))
    moved = (F.col("crawl_status") == "REDIRECTED") | F.col("status_code").between(300, 399)
    to = F.coalesce("redirect_url", F.try_element_at(header_values(F.col("response_headers"), "location"), F.lit(1)))
    rec = parsed.join(canonical_of(parsed), ["site", "url"], "left").select("site", "url", "status_code", F.when(moved, urls.identity(to)).alias("to"), urls.identity(F.col("canonical")).alias("canon"), F.sha2("p.visible_text", 256).alias("h"), (F.length("p.visible_text") > 0).alias("some")).dropDuplicates(["site", "url"])
    side = lambda x: rec.select("site", F.col("url").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in ("status_code", "to", "canon", "h", "some")])
    j = pairs.withColumn("id_a", urls.identity(F.col("a"))).withColumn("id_b", urls.identity(F.col("b"))).join(side("a"), ["site", "a"], "left").join(side("b"), ["site", "b"], "left")
    ok = (F.col("status_code_a") == 200) & (F.col("status_code_b") == 200) & F.col("h_a").isNotNull() & F.col("h_b").isNotNull()
    same = (F.col("h_a") == F.col("h_b")) & F.col("some_a")
    tier = (
        F.when(F.col("to_a") == F.col("id_b"), F.struct(F.lit("REDIRECT_EQUIVALENT").alias("e"), F.lit(False).alias("a_first")))
        .when(F.col("to_b") == F.col("id_a"), F.struct(F.lit("REDIRECT_EQUIVALENT").alias("e"), F.lit(True).alias("a_first")))
        .when(F.col("canon_a") == F.col("id_b"), F.struct(F.lit("CANONICAL_EQUIVALENT").alias("e"), F.lit(False).alias("a_first")))
        .when(F.col("canon_b") == F.col("id_a"), F.struct(F.lit("CANONICAL_EQUIVALENT").alias("e"), F.lit(True).alias("a_first")))
        .when(ok & same, F.struct(F.lit("IDENTICAL_EXTRACTED_TEXT").alias("e"), F.col("v.first").alias("a_first")))
        .when(ok, F.struct(F.lit("DISTINCT_CONTENT_VARIANT").alias("e"), F.lit(True).alias("a_first")))
        .otherwise(F.struct(F.lit("POTENTIAL_DUPLICATE_REPRESENTATION").alias("e"), F.col("v.first").alias("a_first")))
    )
    j = j.withColumn("t", tier)
    primary, other = F.when(F.col("t.a_first"), F.col("a")).otherwise(F.col("b")), F.when(F.col("t.a_first"), F.col("b")).otherwise(F.col("a"))
    return j.select("site", F.col("v.kind").alias("anomaly_type"), primary.alias("primary_url"), other.alias("duplicate_url"), F.col("t.e").alias("evidence_type")).withColumn("recommendation", advice())


def advice() -> Column:
    e, p, d = F.col("evidence_type"), F.col("primary_url"), F.col("duplicate_url")
    return (
        F.when(e == "REDIRECT_EQUIVALENT", F.format_string("Link to %s itself rather than to %s, which redirects there.", p, d))
        .when(e == "CANONICAL_EQUIVALENT", F.format_string("%s names %s its canonical; a permanent redirect would settle it.", d, p))
        .when(e == "IDENTICAL_EXTRACTED_TEXT", F.format_string("Both show the same text; redirect %s to %s.", d, p))
        .when(e == "DISTINCT_CONTENT_VARIANT", F.format_string("%s and %s differ in form only, but show different texts; check the routing.", d, p))
        .otherwise(F.format_string("Use %s alone.", p))
    )


def lookup_status(keys: DataFrame, crawl: DataFrame, column: str) -> DataFrame:
    """keys with the status code and crawl status of the record that a URL means."""
    rec = crawl.groupBy("site", F.col("url").alias("found")).agg(F.max("status_code").alias("target_code"), F.max("crawl_status").alias("target_status"))
    return lookup(keys, crawl, column).join(rec, ["site", "found"], "left")
