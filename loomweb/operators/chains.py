"""Redirect and canonical chains: every start is followed at once, one join a hop, until all have stopped."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import urls
from ..plans.shared import settle
from .crawl import lookup


def location(crawl: DataFrame):
    """Where a redirect leads: the recorded target, else the Location header, resolved."""
    header = F.try_element_at(F.map_values(F.map_filter("response_headers", lambda k, _: F.lower(k) == "location")), F.lit(1))
    return urls.resolve(F.coalesce("redirect_url", F.try_element_at(header, F.lit(1))), F.col("url"))


def _step(crawl: DataFrame) -> DataFrame:
    redirect = (F.col("crawl_status") == "REDIRECTED") | F.col("status_code").isin(301, 302, 303, 307, 308)
    return crawl.dropDuplicates(["site", "url"]).select(
        "site", F.col("url").alias("found"), "status_code", "crawl_status", redirect.alias("redirect"), F.when(redirect, location(crawl)).alias("next"), F.when(F.col("fetch_time_sec") > 0, F.round(F.col("fetch_time_sec") * 1000, 2)).alias("ms")
    )


def redirect_chains(crawl: DataFrame, starts: DataFrame | None = None, max_hops: int = 10) -> DataFrame:
    """initial_url, final_url, total_hops, hops, has_loop, status, total_latency_ms of each start (site, url).

    Without starts, of every record that redirects. A chain that comes back to a URL or its identity is a LOOP; one
    that leaves the crawl is UNVERIFIED_TARGET.
    """
    step = settle(_step(crawl))
    starts = step.where("redirect").select("site", F.col("found").alias("url")) if starts is None else starts.select("site", F.trim("url").alias("url"))
    walk = starts.distinct().select("site", F.col("url").alias("initial_url"), F.col("url").alias("at"), F.array().cast("array<string>").alias("hops"), F.lit(0.0).alias("ms"), F.lit(False).alias("timed"), F.array("url", urls.identity(F.col("url"))).alias("seen"))
    done = None
    for hop in range(max_hops + 1):
        j = lookup(walk, crawl, "at").join(step.withColumnRenamed("ms", "step_ms"), ["site", "found"], "left")
        n = F.size("hops")
        end = (
            F.when(F.lit(hop >= max_hops), "EXCEEDED_MAX_HOPS")
            .when(F.col("found").isNull(), "UNVERIFIED_TARGET")
            .when(~F.col("redirect") & (F.col("status_code") == 200), F.when(n > 1, "MULTI_HOP").otherwise("RESOLVED"))
            .when(~F.col("redirect") & ((F.col("status_code") >= 400) | (F.col("crawl_status") == "FAILED")), "BROKEN_TARGET")
            .when(~F.col("redirect"), "RESOLVED")
            .when(F.coalesce("next", F.lit("")) == "", "MISSING_LOCATION")
        )
        j = settle(j.withColumn("end", end).withColumn("next_id", urls.identity(F.col("next"))))
        over = j.where("end is not null").select("site", "initial_url", F.when(F.col("end").isin("RESOLVED", "MULTI_HOP", "BROKEN_TARGET"), F.col("found")).otherwise(F.col("at")).alias("final_url"), "hops", F.lit(False).alias("has_loop"), F.col("end").alias("status"), "ms", "timed")
        on = j.where("end is null").withColumn("hops", F.concat("hops", F.array("next"))).withColumn("ms", F.col("ms") + F.coalesce("step_ms", F.lit(0.0))).withColumn("timed", F.col("timed") | F.col("step_ms").isNotNull())
        loop = F.array_contains("seen", F.col("next")) | F.array_contains("seen", F.col("next_id"))
        looped = on.where(loop).select("site", "initial_url", F.col("next").alias("final_url"), "hops", F.lit(True).alias("has_loop"), F.lit("LOOP").alias("status"), "ms", "timed")
        part = over.union(looped)
        done = part if done is None else done.union(part)
        walk = settle(on.where(~loop).select("site", "initial_url", F.col("next").alias("at"), "hops", "ms", "timed", F.concat("seen", F.array("next", "next_id")).alias("seen")))
        if walk.isEmpty():
            break
    return done.select("site", "initial_url", "final_url", F.size("hops").alias("total_hops"), "hops", "has_loop", "status", F.when(F.col("timed"), F.round("ms", 2)).alias("total_latency_ms"))


def canonical_chains(crawl: DataFrame, canonicals: DataFrame, redirects: DataFrame | None = None, max_hops: int = 10) -> DataFrame:
    """source_url, declared, final, total_hops, has_loop, points_to_redirect, points_to_dead, status, hops of every record.

    canonicals (site, url, canonical) has the resolved canonical of each page. redirects are chains as above: a
    canonical that redirects ends where its chain does.
    """
    ids = canonicals.groupBy("site", "url").agg(F.first("canonical").alias("canonical"))
    step = _step(crawl).join(ids.withColumnRenamed("url", "found"), ["site", "found"], "left")
    if redirects is not None:
        step = step.join(redirects.select("site", F.col("initial_url").alias("found"), F.col("final_url").alias("chain_end")), ["site", "found"], "left")
    else:
        step = step.withColumn("chain_end", F.lit(None).cast("string"))
    step = settle(step)
    start = crawl.select("site", "url").distinct().join(ids, ["site", "url"], "left").withColumn("declared", F.trim("canonical"))
    start = start.withColumn("sid", urls.identity(F.col("url"))).withColumn("tid", urls.identity(F.col("declared")))
    now = (
        F.when(F.coalesce("declared", F.lit("")) == "", "MISSING")
        .when(~F.col("declared").rlike(r"^https?://[^/?#]+"), "INVALID_TARGET")
        .when(F.col("sid") == F.col("tid"), "SELF_REFERENCING")
    )
    start = settle(start.withColumn("now", now))
    out_cols = ["site", "source_url", "declared", "final", "total_hops", "has_loop", "points_to_redirect", "points_to_dead", "status", "hops"]
    at_once = start.where("now is not null").select(
        "site", F.col("url").alias("source_url"), F.when(F.col("now") != "MISSING", F.col("declared")).alias("declared"), F.when(F.col("now") == "SELF_REFERENCING", F.col("declared")).alias("final"),
        F.when(F.col("now") == "INVALID_TARGET", 1).otherwise(0).alias("total_hops"), F.lit(False).alias("has_loop"), F.lit(False).alias("points_to_redirect"), F.lit(False).alias("points_to_dead"),
        F.col("now").alias("status"), F.when(F.col("now") == "INVALID_TARGET", F.array("url", "declared")).otherwise(F.array("url")).alias("hops"),
    )
    walk = start.where("now is null").select("site", F.col("url").alias("source_url"), "declared", F.col("declared").alias("at"), F.array("url", "declared").alias("hops"), F.array("sid", "tid").alias("seen"))
    done = at_once
    for hop in range(1, max_hops + 1):
        j = lookup(walk, crawl, "at").join(step, ["site", "found"], "left")
        j = settle(j.withColumn("nid", urls.identity(F.col("canonical"))).withColumn("aid", urls.identity(F.col("at"))))
        settled = F.when(F.size("hops") == 2, "RESOLVED").otherwise("CHAIN")
        moved = F.col("redirect") | F.col("status_code").between(300, 399)
        goes_on = (F.coalesce("canonical", F.lit("")) != "") & (F.col("nid") != F.col("aid"))
        loop = F.array_contains("seen", F.col("nid")) | F.array_contains("seen", F.trim("canonical"))
        end = (
            F.when(F.col("found").isNull(), "UNVERIFIED_TARGET")
            .when(moved, "POINTS_TO_REDIRECT")
            .when((F.col("status_code") >= 400) | (F.col("crawl_status") == "FAILED"), "POINTS_TO_DEAD_URL")
            .when(~goes_on, settled)
            .when(loop, "LOOP")
            .when(F.lit(hop >= max_hops), "CHAIN")
        )
        j = settle(j.withColumn("end", end))
        last = F.when(F.col("end") == "POINTS_TO_REDIRECT", F.coalesce("chain_end", "next", "at")).when(F.col("end") == "LOOP", F.trim("canonical")).otherwise(F.col("at"))
        hops = F.when(F.col("end") == "LOOP", F.concat("hops", F.array(F.trim("canonical")))).otherwise(F.col("hops"))
        part = j.where("end is not null").withColumn("hops", hops).select(
            "site", "source_url", "declared", last.alias("final"), (F.size("hops") - 1).alias("total_hops"), (F.col("end") == "LOOP").alias("has_loop"), (F.col("end") == "POINTS_TO_REDIRECT").alias("points_to_redirect"),
            (F.col("end") == "POINTS_TO_DEAD_URL").alias("points_to_dead"), F.col("end").alias("status"), "hops",
        )
        done = done.select(out_cols).union(part.select(out_cols))
        walk = settle(j.where("end is null").select("site", "source_url", "declared", F.trim("canonical").alias("at"), F.concat("hops", F.array(F.trim("canonical"))).alias("hops"), F.concat("seen", F.array("nid")).alias("seen")))
        if walk.isEmpty():
            break
    return done
