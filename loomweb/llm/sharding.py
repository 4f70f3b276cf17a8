"""Sharding by balanced label propagation, in DataFrame operations alone.

Documents with equal texts are linked. Groups that are large against a shard get runs of neighbouring shards, so that a
group lies in as few shards as its size allows. All other linked documents start in a shard by hash, weighted by the
room that is left; then in each round every group's documents vote for their shards, and those elsewhere move to the
shard with most of the group. What moves into a shard is kept to a quota of its bytes: the flows between shards, a table
of shards squared, tell which share of the wishes can be granted. Documents without links, and what lies above a shard's
share, fill the shards up to an even number of bytes, larger documents first. All state but the tables of shards stays in
tables; positions come from sums by bucket and running sums within buckets. Above 17 million rows both the number of
buckets and the rows of one grow with the square root of the rows, so that no window holds more.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

#: Rows of a bucket at least; rounds; the share of a shard that linked documents may take; a group is large from this
#: share of a shard on.
BUCKET, ROUNDS, QUOTA, LARGE = 4096, 5, 0.9, 0.125
STEPS = 1 << 30
#: Groups that are sent to all tasks at most (about 20 MB); beyond it they are joined by a shuffle.
BROADCAST_GROUPS = 250_000


def part(*key) -> Column:
    """A number from 0 to 1 by hash."""
    return F.pmod(F.xxhash64(*key), F.lit(STEPS)) / F.lit(float(STEPS))


def _checked(df: DataFrame) -> DataFrame:
    """A table for a join: sent to all tasks if its rows are few."""
    return F.broadcast(df) if df.count() <= BROADCAST_GROUPS else df


def pick(x: Column, cuts: list[float]) -> Column:
    """The index of the first interval that ends above x; the last one if none does."""
    ends = F.array(*[F.lit(float(c)) for c in cuts[:-1]]) if len(cuts) > 1 else F.array().cast("array<double>")
    return F.size(F.filter(ends, lambda c: c <= x)).cast("int")


def running(values: list[float]) -> list[float]:
    out, total = [], 0.0
    for v in values:
        total += v
        out.append(total)
    return out


def grants(flows: list[list[float]], load: list[float], quota: float) -> list[float]:
    """The share of the wishes into each shard that can be granted, if each may hold quota bytes."""
    n = len(load)
    share = [1.0] * n
    for _ in range(30):
        new = []
        for q in range(n):
            wish = sum(flows[p][q] for p in range(n))
            leave = sum(flows[q][p] * share[p] for p in range(n))
            new.append(1.0 if wish <= 0 else max(0.0, min(1.0, (quota - load[q] + leave) / wish)))
        if new == share:
            break
        share = [min(a, b) for a, b in zip(share, new, strict=True)]
    return share


def shard(docs: DataFrame, shards: int = 40, group: Column | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every row of docs (doc_id, text).

    size is the text's UTF-8 bytes and 16; a null text counts as an empty one. group tells which documents are linked,
    by default those with equal texts. The law is `bytes`: sizes near equal. slot numbers a shard's rows from 0 without
    gaps. Equal rows are alike, so that reruns agree as tables. No rows give no rows; with fewer rows than shards, some
    shards stay empty.
    """
    scratch = Scratch(docs.sparkSession)
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    group = F.unhex(F.sha2(text, 256)) if group is None else group
    slim = scratch.keep(docs.select("doc_id", (F.length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("crc"), group.alias("g")), "slim")
    total = slim.agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("b")).first()
    mean, each = total.b / max(1, total.n), total.b / shards
    buckets = max(1, -(-total.n // max(BUCKET, math.isqrt(total.n))))

    groups = scratch.keep(slim.where("g is not null").groupBy("g").agg(F.count("*").alias("n"), F.sum("size").alias("b")).where("n > 1"), "groups")
    # at most shards / LARGE groups are large, so these few lie in one partition
    large = groups.where(F.col("b") > LARGE * each).select("g", F.col("b").alias("bytes"))
    large = scratch.keep(large.withColumn("begin", F.sum("bytes").over(Window.orderBy(F.desc("bytes"), "g").rowsBetween(Window.unboundedPreceding, 0)) - F.col("bytes")), "pinned")
    quota = max(QUOTA * each, (large.agg(F.sum("bytes").alias("b")).first().b or 0) / shards)
    linked = slim.join(_checked(groups), "g")
    at = F.least(F.floor((F.col("begin") + part("doc_id", "size", "crc") * F.col("bytes")) / quota), F.lit(shards - 1)).cast("int") if quota else F.lit(0)
    big = scratch.keep(linked.join(F.broadcast(large), "g").select("doc_id", "size", "crc", at.alias("shard")), "large")
    used = by_shard(big, shards)

    # the others' state is kept by group and first shard, since what starts together moves together
    room = running([max(0.0, quota - u) for u in used])
    start = pick(part(F.lit("start"), "doc_id", "size", "crc") * (room[-1] or 1.0), room)
    rest = linked.where(F.col("b") <= LARGE * each).select("doc_id", "size", "crc", "g", start.alias("start"))
    state = scratch.keep(rest.groupBy("g", "start").agg(F.sum("size").alias("b"), F.count("*").alias("n")).withColumn("shard", F.col("start")), "state")
    for turn in range(ROUNDS):
        votes = state.groupBy("g", "shard").agg(F.sum("b").alias("b"), F.sum("n").alias("n"))
        best = votes.groupBy("g").agg(F.max(F.struct("n", F.xxhash64("g", "shard"), "shard")).alias("m")).select("g", F.col("m.shard").alias("best"))
        wished = scratch.keep(state.join(best, "g"), "wished")
        flows = [[0.0] * shards for _ in range(shards)]
        load = list(used)
        for r in wished.groupBy("shard", "best").agg(F.sum("b").alias("b")).collect():
            load[r.shard] += r.b
            if r.shard != r.best:
                flows[r.shard][r.best] += r.b
        scratch.drop(state)
        if not any(map(any, flows)):
            state = wished.drop("best")
            break
        share = F.element_at(F.array(*[F.lit(x) for x in grants(flows, load, quota)]), F.col("best") + 1)
        moved = F.when(part(F.lit(turn), "g") < share, F.col("best")).otherwise(F.col("shard"))
        state = scratch.keep(wished.select("g", "start", "b", "n", moved.cast("int").alias("shard")), "state")
        scratch.drop(wished)
    few = scratch.keep(rest.join(_checked(state.select("g", "start", "shard")), ["g", "start"]).select("doc_id", "size", "crc", "shard").union(big), "linked")

    # what fills the shards: documents without links, and what a shard holds above its share
    load = by_shard(few, shards)
    over = F.element_at(F.array(*[F.lit(max(0.0, 1 - each / x) if x else 0.0) for x in load]), F.col("shard") + 1)
    out = part(F.lit("over"), "doc_id", "size", "crc") < over
    alone = slim.join(_checked(groups.select("g")), "g", "left_anti").select("doc_id", "size", "crc")
    pool = alone.union(few.where(out).select("doc_id", "size", "crc"))
    level = F.when(F.col("size") > 4 * mean, 0).when(F.col("size") > mean / 2, 1).otherwise(2)
    bucket = F.pmod(F.xxhash64("doc_id", "size", "crc"), F.lit(buckets)).cast("int")
    pool = scratch.keep(pool.withColumn("level", level).withColumn("bucket", bucket), "pool")
    sums = pool.groupBy("level", "bucket").agg(F.sum("size").alias("b"))
    before = scratch.keep(sums.select("level", "bucket", (F.sum("b").over(Window.partitionBy("level").orderBy("bucket")) - F.col("b")).alias("before")), "before")
    order = Window.partitionBy("bucket", "level").orderBy(F.xxhash64("doc_id", "crc"), "doc_id", "size", "crc").rowsBetween(Window.unboundedPreceding, 0)
    placed = pool.join(before, ["bucket", "level"]).withColumn("x", F.col("before") + F.sum("size").over(order) - F.col("size") / 2)
    placed = scratch.keep(placed.select("doc_id", "size", "crc", "level", "x"), "positions")
    parts = [few.where(~out).select("doc_id", "size", "crc", "shard")]
    load = by_shard(parts[0], shards)
    for k in range(3):
        here = placed.where(F.col("level") == k)
        whole = here.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("b")).first().b
        gaps = [max(0.0, each - x) for x in load]
        scale = whole / sum(gaps) if sum(gaps) else 0.0
        filled = here.select("doc_id", "size", "crc", pick(F.col("x"), running([g * scale for g in gaps]) if scale else [float(whole) / shards * (i + 1) for i in range(shards)]).alias("shard"))
        parts.append(filled)
        load = [a + b for a, b in zip(load, by_shard(filled, shards), strict=True)]
    # another hash than that of the positions: a shard's rows then lie evenly over all buckets
    other = F.pmod(F.xxhash64(F.lit("slot"), "doc_id", "size", "crc"), F.lit(buckets)).cast("int")
    every = parts[0].union(parts[1]).union(parts[2]).union(parts[3]).withColumn("bucket", other)
    every = scratch.keep(every, "placed")
    counts = every.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    first = counts.select("shard", "bucket", (F.sum("n").over(Window.partitionBy("shard").orderBy("bucket")) - F.col("n")).alias("first"))
    order = Window.partitionBy("shard", "bucket").orderBy(F.xxhash64("doc_id", "crc"), "doc_id", "size", "crc")
    slot = (F.col("first") + F.row_number().over(order) - 1).cast("long")
    return every.join(first, ["shard", "bucket"]).select("doc_id", "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", slot.alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def by_shard(df: DataFrame, shards: int) -> list[float]:
    """The bytes in each shard."""
    out = [0.0] * shards
    for r in df.groupBy("shard").agg(F.sum("size").alias("b")).collect():
        out[r.shard] = float(r.b)
    return out
