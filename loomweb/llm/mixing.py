"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source is to be taken target / (words of the source) times. The whole part is taken for certain;
the fraction left is rounded by pairing documents: mass moves between the two, in a random direction and weighted by
their sizes so that the words in expectation stay as they are, until the fraction of one of them is 0 or 1. A group of
documents so ends with one fractional document at most. Those are paired on in a tree of groups until each source has
one, which a last draw decides: a source's words miss its target by less than its last document's size.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, word_count

#: Rows of a leaf group, and groups that a node of the tree combines.
LEAF, FAN = 2048, 64


def source_targets(sources: DataFrame, weights=(5, 2, 1), most: float = 3.0) -> DataFrame:
    """source_size and target of each row of sources (source, source_size; each source once, null allowed).

    Sources by code point, null last, get the weights in turn and share the total of all sizes; none gets more than
    `most` times its size, and what is cut off goes to the others by weight. The level at which this settles follows
    from running sums over the sources in the order in which they reach their limit.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").cast("binary").asc_nulls_last())) - 1
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (place % len(weights) + 1).cast("int"))
    s = sources.withColumn("w", w).withColumn("cap", F.col("source_size") * most)
    order = Window.orderBy((F.col("cap") / F.col("w")), F.col("source").cast("binary").asc_nulls_last())
    everything = Window.partitionBy()
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("level", (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0))))
    # the first source, in that order, whose limit lies above the level, sets it
    s = s.withColumn("level", F.min(F.when(F.col("cap") >= F.col("level") * F.col("w"), F.struct((F.col("cap") / F.col("w")).alias("r"), F.col("level").alias("v")))).over(everything)["v"])
    return s.select("source", "source_size", F.when(F.col("source_size") > 0, F.least("cap", F.coalesce(F.col("level") * F.col("w"), F.col("cap")))).otherwise(0.0).alias("target"))


def draw(seed: int, *key) -> float:
    """A number from 0 to 1 that depends on nothing but the key."""
    return xxhash.xxh3_64_intdigest(repr(key), seed & 0xFFFFFFFF) / 2.0**64


def pivot(sizes, fractions, uniform) -> list[float]:
    """Round fractions by pairing; all but one at most become 0 or 1, and sum(size * fraction) stays.

    uniform(i) gives a number from 0 to 1 for the i-th step.
    """
    f = [float(x) for x in fractions]
    held = None
    for i, x in enumerate(f):
        if x <= EPS or x >= 1 - EPS or sizes[i] <= 0:
            f[i] = float(x >= 0.5) if sizes[i] > 0 else x
            continue
        if held is None:
            held = i
            continue
        a, b = sizes[held], sizes[i]
        up = min((1 - f[held]) * a, f[i] * b)  # words that can move to the one held, and from it
        down = min(f[held] * a, (1 - f[i]) * b)
        move = up if uniform(i) < down / (up + down) else -down
        f[held] += move / a
        f[i] -= move / b
        done = [k for k in (held, i) if f[k] <= EPS or f[k] >= 1 - EPS]
        for k in done:
            f[k] = float(f[k] >= 0.5)
        held = next((k for k in (held, i) if k not in done), None)
    return f


EPS = 1e-9


def mixed_sizes(docs: DataFrame, weights=(5, 2, 1), most: float = 3.0, seed: int = 11) -> DataFrame:
    """doc_id, size, source_size, target (of its source) and taken (words, repeats counted) of every row of docs.

    docs has doc_id, text and source. A null or empty text has size 0 and is taken 0 times; a null source is a source of
    its own. Rows with the same doc_id are documents of their own, and equal rows are alike, so that reruns agree as
    tables. No rows give no rows.
    """
    scratch = Scratch(docs.sparkSession)
    slim = scratch.keep(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.crc32(F.col("text").cast("binary")).alias("crc")), "sizes")
    taken, targets = _taken(slim, scratch, weights, most, seed)
    t = targets.withColumnRenamed("source", "s")
    out = taken.join(F.broadcast(t) if t.count() <= MANY_SOURCES else t, F.col("source").eqNullSafe(F.col("s")))
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"))


#: Sources whose targets are sent to all tasks at most.
MANY_SOURCES = 50_000


def _taken(slim: DataFrame, scratch: Scratch, weights, most: float, seed: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, source, size, crc, nth, copies) of every row, and the sources' targets."""
    sums = slim.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    sums = scratch.keep(sums, "sources")
    targets = scratch.keep(source_targets(sums.select("source", "source_size"), weights, most), "targets")
    plan = targets.join(sums.select(F.col("source").alias("s"), "n"), F.col("source").eqNullSafe(F.col("s"))).select(
        F.col("source").alias("s"), F.coalesce(F.col("target") / F.col("source_size"), F.lit(0.0)).alias("ratio"), F.ceil(F.col("n") / LEAF).cast("int").alias("leaves")
    )
    few = plan.count() <= MANY_SOURCES
    most_leaves = plan.agg(F.max("leaves")).first()[0] or 1
    leaf = F.pmod(F.xxhash64("doc_id", "size", "crc", F.lit(seed)), F.col("leaves")).cast("long")
    dealt = slim.join(F.broadcast(plan) if few else plan, F.col("source").eqNullSafe(F.col("s"))).select("doc_id", "source", "size", "crc", "ratio", leaf.alias("leaf"))

    def round_leaf(t: pa.Table) -> pa.Table:
        t = t.sort_by([("size", "descending"), ("crc", "ascending"), ("doc_id", "ascending")])  # small ones last: what is left open is small
        ids, sizes, crcs, n = t.column("doc_id").to_pylist(), t.column("size").to_pylist(), t.column("crc").to_pylist(), t.num_rows
        source, leaf, ratio = t.column("source")[0].as_py(), t.column("leaf")[0].as_py(), t.column("ratio")[0].as_py()
        whole = math.floor(ratio + EPS)
        rest = max(0.0, ratio - whole)
        got = pivot(sizes, [rest if s > 0 else 0.0 for s in sizes], lambda i: draw(seed, "leaf", source, leaf, i))
        nth, last = [], None
        for row in zip(ids, sizes, crcs, strict=True):
            nth.append(nth[-1] + 1 if row == last else 1)
            last = row
        open_ = [EPS < g < 1 - EPS for g in got]
        return pa.table(
            {
                "doc_id": t.column("doc_id"),
                "source": t.column("source"),
                "size": t.column("size"),
                "crc": t.column("crc"),
                "nth": pa.array(nth, pa.int32()),
                "leaf": t.column("leaf"),
                "whole": pa.array([float(whole if s > 0 else 0) for s in sizes], pa.float64()),
                "part": pa.array(got, pa.float64()),
                "open": pa.array(open_, pa.bool_()),
            }
        ).slice(0, n)

    id_type = slim.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, source string, size bigint, crc bigint, nth int, leaf bigint, whole double, part double, open boolean"
    leaves = scratch.keep(dealt.groupBy("source", "leaf").applyInArrow(round_leaf, schema), "leaves")

    # the tree: what is open of up to FAN groups meets in one, until one document of a source is left
    nodes = leaves.where("open").select("source", F.col("leaf").alias("node"), "leaf", "size", "part")

    def round_node(last: bool):
        def run(t: pa.Table) -> pa.Table:
            t = t.sort_by([("size", "descending"), ("leaf", "ascending")])
            source, node, leaf = t.column("source")[0].as_py(), t.column("node")[0].as_py(), t.column("leaf").to_pylist()
            got = pivot(t.column("size").to_pylist(), t.column("part").to_pylist(), lambda i: draw(seed, "node", source, node, leaf[i]))
            if last:
                got = [g if g in (0.0, 1.0) else float(draw(seed, "last", source, x) < g) for g, x in zip(got, leaf, strict=True)]
            return t.select(["source", "node", "leaf", "size"]).append_column("part", pa.array(got, pa.float64()))

        return run

    decided, width = None, most_leaves
    while True:
        width = -(-width // FAN)
        nodes = nodes.withColumn("node", F.floor(F.col("node") / FAN).cast("long"))
        level = scratch.keep(nodes.groupBy("source", "node").applyInArrow(round_node(width <= 1), "source string, node bigint, leaf bigint, size bigint, part double"), "level")
        final = level.where("part in (0.0, 1.0)").select("source", "leaf", "part")
        decided = final if decided is None else decided.union(final)
        if width <= 1:
            break
        nodes = level.where("part not in (0.0, 1.0)")
    d = decided.select(F.col("source").alias("s"), F.col("leaf").alias("l"), F.col("part").alias("p"))
    now = leaves.join(d, F.col("open") & F.col("source").eqNullSafe(F.col("s")) & (F.col("leaf") == F.col("l")), "left")
    copies = F.round(F.col("whole") + F.when(F.col("open"), F.coalesce("p", F.lit(0.0))).otherwise(F.col("part"))).cast("long")
    return now.select("doc_id", "source", "size", "crc", "nth", copies.alias("copies")), targets


def repeated(docs: DataFrame, weights=(5, 2, 1), most: float = 3.0, seed: int = 11) -> DataFrame:
    """The mixed documents themselves: every row of docs as often as it is taken, with the columns of docs."""
    scratch = Scratch(docs.sparkSession)
    size, crc = word_count(F.col("text")), F.crc32(F.col("text").cast("binary"))
    slim = scratch.keep(docs.select("doc_id", "source", size.alias("size"), crc.alias("crc")), "sizes")
    taken, _ = _taken(slim, scratch, weights, most, seed)
    taken = scratch.keep(taken.where("copies > 0").select("doc_id", "crc", F.col("source").alias("_source"), "nth", F.col("copies").cast("int").alias("copies")), "taken")
    by = Window.partitionBy("doc_id", "_crc").orderBy(*[c for c in docs.columns if c not in ("doc_id", "text")])
    # one shuffle of the texts: the window and the join both need them by doc_id and checksum
    base = docs.withColumn("_crc", crc).withColumn("_nth", F.row_number().over(by))
    taken = taken.withColumn("nth", F.row_number().over(Window.partitionBy("doc_id", "crc").orderBy("_source", "nth")))
    same = base["doc_id"].eqNullSafe(taken["doc_id"]) & base["_crc"].eqNullSafe(taken["crc"]) & (base["_nth"] == taken["nth"])
    out = base.join(taken.select("doc_id", "crc", "nth", "copies"), same).withColumn("_copy", F.explode(F.array_repeat(F.lit(0), F.col("copies"))))
    return out.select(*[base[c] for c in docs.columns])
