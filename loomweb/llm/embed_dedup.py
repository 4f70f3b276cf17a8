"""Near-duplicate vectors: random-hyperplane sign hashing in several tables, exact cosines, connected components.

Equal vectors of a label become one class with a count. Each class gets a k-bit sign hash in each of L tables; k follows
from the largest label's size, and L from k and the threshold, so that a pair right at the threshold is missed with a
probability below MISS. Within a bucket all cosines are computed in double precision, block by block: a large bucket is
cut into chunks, and each pair of chunks is a task of its own. A pair counts in the first table that brings it together,
so no pairs are stored; a block returns for each vector its number of new links and one edge to its local component.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, connected_components

MISS = 1e-7
BUCKET, CHUNK, SEED = 96, 512, 20240607


def plan_tables(largest: int, threshold: float) -> tuple[int, int]:
    """(bits, tables) for a label of so many classes."""
    same = 1 - math.acos(threshold) / math.pi
    bits = max(1, min(30, math.ceil(math.log2(max(2, largest / BUCKET)))))
    count = lambda k: max(1, math.ceil(math.log(MISS) / math.log1p(-(same**k)))) if same < 1 else 1
    while bits > 1 and count(bits) > 96:
        bits -= 1
    return bits, count(bits)


def local_roots(hits: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For each vector of a block, the smallest id of its component under the symmetric boolean matrix hits."""
    root = np.full(len(ids), -1, np.int64)
    for i in np.argsort(ids, kind="stable"):
        if root[i] >= 0:
            continue
        reached = np.zeros(len(ids), bool)
        edge = reached.copy()
        edge[i] = True
        while edge.any():
            reached |= edge
            edge = hits[edge].any(0) & ~reached
        root[reached] = i
    return ids[root]


def vector_components(vectors: DataFrame, threshold: float = 0.98) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of vectors (vec_id, embedding, label, any others).

    Only vectors with an equal, non-null label and equal length are compared. A vector that is null, empty or zero,
    holds a null or non-finite component, or has no label or no vec_id, links with nothing: n_links 0, its own
    component. Every row is a vector: a repeated row is linked with its repeats. No rows give no rows.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark)
    v = vectors.select("vec_id", "embedding", "label")
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    some = F.exists("embedding", lambda x: x != 0)
    v = v.withColumn("ok", F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & ~bad & some, F.lit(False)))
    good = v.where("ok")
    classes = scratch.keep(good.groupBy("label", "embedding").agg(F.min("vec_id").cast("long").alias("rep"), F.count("*").alias("copies")), "classes")
    sizes = classes.groupBy("label", F.size("embedding").alias("dim")).agg(F.count("*").alias("c"))
    largest = sizes.agg(F.max("c")).first()[0] or 0
    bits, tables = plan_tables(largest, threshold)
    wide = vectors.schema["embedding"].dataType.elementType.typeName() != "float"
    kind = np.float64 if wide else np.float32

    def sign(batches):
        planes: dict[int, np.ndarray] = {}
        for b in batches:
            rep, copies, label, dim = (b.column(i) for i in range(4))
            dims = dim.to_numpy(zero_copy_only=False)
            for d in np.unique(dims):
                at = np.flatnonzero(dims == d)
                if d not in planes:
                    planes[d] = np.random.default_rng([SEED, int(d)]).standard_normal((int(d), bits * tables))
                x = np.stack([np.asarray(e, kind) for e in b.column(4).take(pa.array(at)).to_pylist()])
                y = x.astype(np.float64)
                y /= np.abs(y).max(1, keepdims=True)
                up = (y @ planes[d] > 0).reshape(len(at), tables, bits)
                sigs = (up * (1 << np.arange(bits))).sum(2).astype(np.int32)
                take = pa.array(np.repeat(at, tables))
                yield pa.RecordBatch.from_arrays(
                    [
                        rep.take(take),
                        copies.take(take),
                        label.take(take),
                        dim.take(take),
                        pa.array(np.tile(np.arange(tables, dtype=np.int32), len(at))),
                        pa.array(sigs.ravel()),
                        pa.array([s for r in sigs for s in [r.tobytes()] * tables], pa.binary()),
                        pa.array([s for r in x for s in [r.tobytes()] * tables], pa.binary()),
                    ],
                    names=["rep", "copies", "label", "dim", "t", "sig", "sigs", "vec"],
                )

    label_type = vectors.schema["label"].dataType.simpleString()
    schema = f"rep bigint, copies bigint, label {label_type}, dim int, t int, sig int, sigs binary, vec binary"
    key = ["label", "dim", "t", "sig"]
    hashed = classes.select("rep", "copies", "label", F.size("embedding").alias("dim"), "embedding").mapInArrow(sign, schema)
    big = scratch.keep(hashed.groupBy(*key).agg(F.count("*").alias("c")).where(F.col("c") > CHUNK).select(*key, F.ceil(F.col("c") / CHUNK).cast("int").alias("nb")), "big")
    chunk = F.pmod(F.xxhash64("rep"), F.col("nb")).cast("int")
    dealt = (
        hashed.join(big, key, "left")
        .withColumn("nb", F.coalesce("nb", F.lit(1)))
        .withColumn("chunk", chunk)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
        .withColumn("i", F.least("chunk", "other"))
        .withColumn("j", F.greatest("chunk", "other"))
        .drop("other", "nb", "dim")
    )

    def compare(group: pa.Table) -> pa.Table:
        n = group.num_rows
        ids = group.column("rep").to_numpy()
        empty = {"id": pa.array([], pa.int64()), "n": pa.array([], pa.int64()), "root": pa.array([], pa.int64())}
        if n < 2:
            return pa.table(empty)
        copies, part = group.column("copies").to_numpy(), group.column("chunk").to_numpy()
        t = group.column("t")[0].as_py()
        x = np.frombuffer(b"".join(group.column("vec").to_pylist()), kind).reshape(n, -1).astype(np.float64)
        sigs = np.frombuffer(b"".join(group.column("sigs").to_pylist()), np.int32).reshape(n, -1)
        x = x / np.abs(x).max(1, keepdims=True)
        x = x / np.sqrt((x * x).sum(1, keepdims=True))
        hits = x @ x.T >= threshold
        np.fill_diagonal(hits, False)
        if group.column("i")[0].as_py() != group.column("j")[0].as_py():
            hits &= part[:, None] != part[None, :]
        some = hits.any(1)
        if not some.any():
            return pa.table(empty)
        hits, ids, copies, sigs = hits[np.ix_(some, some)], ids[some], copies[some], sigs[some]
        roots = local_roots(hits, ids)
        fresh = hits.copy()
        for earlier in range(t):
            fresh &= sigs[:, earlier][:, None] != sigs[:, earlier][None, :]
        return pa.table({"id": pa.array(ids), "n": pa.array(fresh @ copies), "root": pa.array(roots)})

    blocks = dealt.groupBy("label", F.length("vec").alias("bytes"), "t", "sig", "i", "j").applyInArrow(compare, "id bigint, n bigint, root bigint")
    found = scratch.keep(blocks, "links")
    near = connected_components(found.select(F.col("id").alias("src"), F.col("root").alias("dst")), scratch)
    links = found.groupBy("id").agg(F.sum("n").alias("n"))
    named = (
        classes.join(links, classes.rep == links.id, "left")
        .drop("id")
        .join(near, classes.rep == near.id, "left")
        .select("label", "embedding", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    )
    rest = v.where("not ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").cast("long").alias("component_id"))
    out = good.join(named, ["label", "embedding"], "left").select("vec_id", "n_links", "component_id").union(rest)
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
