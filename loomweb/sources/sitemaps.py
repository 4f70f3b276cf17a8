"""Sitemaps: parsing, traversal of indexes, and reconciliation with the crawl."""

from __future__ import annotations

import html
import re
import xml.etree.ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import urls
from ..plans.shared import settle

DOC = "struct<format:string, urls:array<struct<loc:string, lastmod:string, changefreq:string, priority:double>>, children:array<string>>"
MAX_DOCS, MAX_URLS, MAX_DEPTH, MAX_BYTES = 50, 50_000, 3, 10 * 1024 * 1024


def _local(tag) -> str:
    return tag.rsplit("}", 1)[-1].lower() if isinstance(tag, str) else ""


def _priority(text: str | None) -> float | None:
    try:
        return float(text) if text else None
    except ValueError:
        return None


def parse_sitemap(data: bytes | str | None, most: int = MAX_URLS) -> dict:
    """Format, URLs (each identity once) and child sitemaps. HTML is refused; broken XML is read by its tags if its root shows."""
    if isinstance(data, (bytes, bytearray)):
        try:
            data = data.decode("utf-8-sig")
        except UnicodeDecodeError:
            data = data.decode("latin-1")
    text = (data or "").lstrip("﻿ \t\r\n")
    empty = {"format": "UNKNOWN", "urls": [], "children": []}
    if not text:
        return empty
    if re.search(r"<!doctype\s+html|<html[\s>]", text[:2048], re.I):
        return empty | {"format": "HTML_ERROR_PAGE"}
    rows, children = [], []
    try:
        root = ET.fromstring(text)
        kind = _local(root.tag)
        for x in root:
            values = {_local(c.tag): (c.text or "").strip() for c in x}
            if values.get("loc"):
                rows.append(values)
    except ET.ParseError:
        kind = "sitemapindex" if re.search(r"<(?:\w+:)?sitemapindex", text, re.I) else "urlset" if re.search(r"<(?:\w+:)?urlset", text, re.I) else ""
        if not kind:
            return empty | {"format": "MALFORMED"}
        item = "sitemap" if kind == "sitemapindex" else "url"
        for part in re.findall(rf"<(?:\w+:)?{item}\b[^>]*>(.*?)(?=</(?:\w+:)?{item}>|<(?:\w+:)?{item}\b|\Z)", text, re.S | re.I):
            values = {k.lower(): html.unescape(v).strip() for k, v in re.findall(r"<(?:\w+:)?(loc|lastmod|changefreq|priority)\s*>([^<]*)", part, re.I)}
            if values.get("loc"):
                rows.append(values)
    if kind == "sitemapindex":
        return {"format": "SITEMAPINDEX", "urls": [], "children": list(dict.fromkeys(r["loc"] for r in rows))}
    if kind != "urlset":
        return empty
    seen: dict[str, dict] = {}
    for r in rows:
        seen.setdefault(urls.identity_one(r["loc"]), {"loc": r["loc"], "lastmod": r.get("lastmod") or None, "changefreq": r.get("changefreq") or None, "priority": _priority(r.get("priority"))})
    return {"format": "URLSET", "urls": list(seen.values())[:most], "children": []}


def parsed(documents: DataFrame) -> DataFrame:
    """site, sitemap, status, doc of fetched documents (site, sitemap, status_code, body): what each of them is."""

    def run(bodies: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([parse_sitemap(b) for b in bodies], columns=["format", "urls", "children"])

    d = documents.withColumn("doc", F.pandas_udf(run, DOC)(F.col("body")))
    size = F.octet_length(F.col("body"))
    status = F.when(F.coalesce("status_code", F.lit(0)) == 0, "CONNECTION_FAILED").when(F.col("status_code") != 200, "HTTP_ERROR").when(size > MAX_BYTES, "MAX_SIZE_EXCEEDED").when(F.col("doc.format").isin("MALFORMED", "HTML_ERROR_PAGE", "UNKNOWN"), "MALFORMED_CONTENT").otherwise("SUCCESS")
    return d.select("site", "sitemap", status.alias("status"), "doc")


def traverse(roots: DataFrame, documents: DataFrame, max_docs: int = MAX_DOCS, max_depth: int = MAX_DEPTH) -> DataFrame:
    """site, sitemap, depth, parent, status, doc: indexes followed level by level from the roots (site, sitemap).

    A sitemap met again is LOOP_DETECTED and not read; beyond max_depth, MAX_DEPTH_EXCEEDED; a site's documents are
    counted up to max_docs.
    """
    docs = settle(parsed(documents))
    front = settle(roots.select("site", "sitemap").distinct().withColumn("parent", F.lit(None).cast("string")))
    out, seen = None, roots.select("site", "sitemap").limit(0)
    for depth in range(max_depth + 2):
        again = front.join(seen.withColumn("again", F.lit(True)), ["site", "sitemap"], "left")
        if depth > max_depth:
            level = again.join(docs, ["site", "sitemap"], "left").select("site", "sitemap", F.lit(depth).alias("depth"), "parent", F.lit("MAX_DEPTH_EXCEEDED").alias("status"), F.lit(None).cast(DOC).alias("doc"))
        else:
            j = again.join(docs, ["site", "sitemap"], "left")
            status = F.when(F.col("again"), "LOOP_DETECTED").otherwise(F.coalesce("status", F.lit("CONNECTION_FAILED")))
            level = j.select("site", "sitemap", F.lit(depth).alias("depth"), "parent", status.alias("status"), F.when(status == "SUCCESS", F.col("doc")).alias("doc"))
        level = settle(level)
        out = level if out is None else out.union(level)
        seen = settle(seen.union(level.where("status <> 'LOOP_DETECTED'").select("site", "sitemap")).distinct())
        front = settle(level.where("status = 'SUCCESS'").select("site", F.col("sitemap").alias("parent"), F.explode("doc.children").alias("sitemap")).dropDuplicates(["site", "sitemap"]).select("site", "sitemap", "parent"))
        if front.isEmpty() or depth > max_depth:
            break
    count = F.row_number().over(_by_site().orderBy("depth", "sitemap"))
    return out.withColumn("k", count).where(F.col("k") <= max_docs).drop("k")


def _by_site():
    from pyspark.sql import Window

    return Window.partitionBy("site")


def sitemap_urls(traversed: DataFrame, most: int = MAX_URLS) -> DataFrame:
    """site, loc, identity_url, source_sitemap, lastmod, changefreq, priority: each identity once, up to `most` a site."""
    u = traversed.where("status = 'SUCCESS'").select("site", F.col("sitemap").alias("source_sitemap"), "depth", F.explode("doc.urls").alias("u")).select("site", "source_sitemap", "depth", "u.*")
    u = u.withColumn("identity_url", urls.identity(F.col("loc")))
    first = u.groupBy("site", "identity_url").agg(F.min(F.struct("depth", "source_sitemap", "loc", "lastmod", "changefreq", "priority")).alias("f"))
    ranked = first.withColumn("k", F.row_number().over(_by_site().orderBy("identity_url"))).where(F.col("k") <= most)
    return ranked.select("site", "f.loc", "identity_url", "f.source_sitemap", "f.lastmod", "f.changefreq", "f.priority")


def reconcile(sitemap: DataFrame, eligibility: DataFrame, crawl: DataFrame, nodes: DataFrame | None = None, canonicals: DataFrame | None = None) -> DataFrame:
    """site, url, conflict_type, severity, signal_a_state, signal_b_state: where sitemap, crawl, index rules, link graph
    and canonical chains contradict one another."""
    from ..operators.crawl import lookup

    rec = eligibility.select("site", F.col("url").alias("found"), "status_code", "crawl_status", "crawlability", "indexability", "canonicalization", "canonical", "redirect_url").dropDuplicates(["site", "found"])
    s = lookup(sitemap.select("site", "loc", "identity_url"), crawl, "loc").join(rec, ["site", "found"], "left")
    if nodes is not None:
        orphan = nodes.where("orphan_status = 'POTENTIAL_ORPHAN'").select("site", F.col("id").alias("nid"), F.lit(True).alias("orphan"))
        s = s.withColumn("nid", urls.node(F.col("found"))).join(orphan, ["site", "nid"], "left")
    else:
        s = s.withColumn("orphan", F.lit(None).cast("boolean"))
    blocked = (F.col("crawl_status") == "BLOCKED") | (F.col("crawlability") == "BLOCKED")
    here, code = F.col("found").isNotNull(), F.col("status_code")
    item = lambda cond, kind, severity, state: F.when(cond, F.struct(F.lit(kind).alias("conflict_type"), F.lit(severity).alias("severity"), state.alias("signal_b_state")))
    http = F.when(code > 0, F.concat(F.lit("HTTP "), code.cast("string"))).otherwise("FAILED")
    rows = F.filter(
        F.array(
            item(blocked, "SITEMAP_ROBOTS_BLOCKED", "HIGH", F.lit("BLOCKED")),
            item(here & (F.col("indexability") == "NOINDEX"), "SITEMAP_NOINDEX_CONFLICT", "HIGH", F.lit("noindex")),
            item(here & (code.between(300, 399) | (F.col("crawl_status") == "REDIRECTED")), "SITEMAP_REDIRECT_CONFLICT", "MEDIUM", F.concat(http, F.lit(" -> "), F.coalesce("redirect_url", F.lit("unknown")))),
            item(here & ((code >= 400) | ((F.col("crawl_status") == "FAILED") & ~blocked)), "SITEMAP_ERROR_CONFLICT", "HIGH", http),
            item(here & F.col("canonicalization").isin("CANONICALIZED_ELSEWHERE", "CROSS_DOMAIN"), "SITEMAP_CANONICAL_ELSEWHERE", "MEDIUM", F.concat(F.lit("canonical_target="), F.coalesce("canonical", F.lit("")))),
            item(here & F.col("orphan"), "SITEMAP_ORPHAN_CANDIDATE", "LOW", F.lit("zero_observed_inbound_internal_links")),
            item(~here, "SITEMAP_URL_UNCRAWLED", "INFO", F.lit("UNAVAILABLE")),
        ),
        lambda x: x.isNotNull(),
    )
    a = s.select("site", F.col("loc").alias("url"), F.explode(rows).alias("c")).select("site", "url", "c.conflict_type", "c.severity", F.when(F.col("c.conflict_type") == "SITEMAP_URL_UNCRAWLED", "discovered_in_sitemap").otherwise("included_in_sitemap").alias("signal_a_state"), "c.signal_b_state")
    fine = eligibility.where("status_code = 200 and indexability = 'INDEXABLE' and canonicalization in ('SELF_REFERENCING', 'MISSING')")
    by_raw = sitemap.select("site", F.trim("loc").alias("url")).distinct()
    by_id = sitemap.select("site", "identity_url").distinct()
    missing = fine.join(by_raw, ["site", "url"], "left_anti").join(by_id, ["site", "identity_url"], "left_anti")
    b = missing.select("site", "url", F.lit("INTERNAL_URL_NOT_IN_SITEMAP"), F.lit("LOW"), F.lit("crawled_indexable_200"), F.lit("missing_from_sitemap"))
    out = a.union(b)
    if canonicals is not None:
        kind = F.when(F.col("points_to_redirect"), "CANONICAL_TARGET_REDIRECT").when(F.col("points_to_dead"), "CANONICAL_TARGET_DEAD")
        c = canonicals.where("points_to_redirect or points_to_dead").select("site", F.col("source_url").alias("url"), kind, F.lit("HIGH"), F.concat(F.lit("declared_canonical="), "declared"), F.when(F.col("points_to_redirect"), "target_is_redirect").otherwise("target_returned_error"))
        out = out.union(c)
    return out


def conflict_counts(conflicts: DataFrame) -> DataFrame:
    """Conflicts of each site by type and by severity, in one pass."""
    return conflicts.groupingSets([["site", "conflict_type"], ["site", "severity"]], "site", "conflict_type", "severity").agg(F.count("*").alias("n"))
