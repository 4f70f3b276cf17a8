"""Best-fit packing under conflicts.

Documents become pieces of at most the capacity; pieces that fill a bin are bins of their own. The rest are dealt into
blocks of similar numbers of rows, and a block is packed by best fit, larger pieces first: its bins are ordered by what
is left in them, the search starts at the first bin in which the piece fits and goes on to the next larger residual
until a bin is compatible, so that the tightest compatible bin is found. Each bin carries bitmaps: one for the
duplicate clusters that it holds, of which none may come twice, and one for each time that a source may come.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, word_count

#: Rows of a block.
BLOCK = 4096


def best_fit(sizes: list[int], clusters: list[int], sources: list[int], capacity: int, per_source: int) -> list[int]:
    """The bin of each piece, pieces in the order given; a source of -1 has no limit.

    Clusters and sources are small numbers; bin k holds cluster c if bit c of its bitmap is set.
    """
    left: list[tuple[int, int]] = []  # (residual, bin), ascending
    held: list[int] = []
    seen: list[list[int]] = []
    out = []
    for size, cluster, source in zip(sizes, clusters, sources, strict=True):
        c, s = 1 << cluster, 1 << source if source >= 0 else 0
        at = bisect_left(left, (size, -1))
        while at < len(left) and (held[left[at][1]] & c or seen[left[at][1]][-1] & s):
            at += 1
        if at < len(left):
            residual, b = left.pop(at)
        else:
            residual, b = capacity, len(held)
            held.append(0)
            seen.append([0] * per_source)
        held[b] |= c
        for i in range(per_source):  # the first plane in which the source is new takes it
            if not seen[b][i] & s:
                seen[b][i] |= s
                break
        out.append(b)
        if residual - size > 0:
            insort(left, (residual - size, b))
    return out


def pack(docs: DataFrame, capacity: int = 2048, per_source: int = 2, size: Column | None = None, cluster: Column | None = None) -> DataFrame:
    """doc_id, piece, start, length, bin, place, fill: where every piece of every row of docs (doc_id, text, source) goes.

    size is a document's length in units of the capacity, by default its words; a piece is units start to start +
    length. cluster tells which documents are duplicates of one another, by default those with equal texts once case
    and white space are folded. A document of size 0 (null, empty or blank) is one piece of length 0 in a bin of its
    own; a null source has no limit. Rows with the same doc_id are documents of their own, told apart by place: equal
    rows are duplicates, and so in different bins. bin is a number from 0 that is unique over all blocks but has gaps;
    fill is the bin's sum of lengths. No rows give no rows.
    """
    scratch = Scratch(docs.sparkSession)
    text = F.coalesce(F.col("text"), F.lit(""))
    size = word_count(F.col("text")) if size is None else size
    cluster = F.xxhash64(F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))) if cluster is None else cluster
    slim = scratch.keep(docs.select("doc_id", F.col("source").cast("string").alias("source"), size.cast("long").alias("size"), cluster.alias("cluster")), "sizes")
    blocks = max(1, -(-slim.count() // BLOCK))
    # a group of copies is as even over the blocks as the hashes of its doc_ids
    dealt = slim.withColumn("block", F.pmod(F.xxhash64("doc_id", "size"), F.lit(blocks)).cast("int"))

    def run(t: pa.Table) -> pa.Table:
        block = t.column("block")[0].as_py()
        rows = sorted(zip(*(t.column(c).to_pylist() for c in ("size", "cluster", "doc_id", "source")), strict=True), key=lambda r: (-(r[0] % capacity), r[1], r[2] is None, r[2] or 0, r[0]))
        rest = [r[0] % capacity for r in rows]
        some = sum(1 for x in rest if x)  # those without a rest come last
        number = lambda values: {v: i for i, v in enumerate(dict.fromkeys(values))}
        cn, sn = number(r[1] for r in rows[:some]), number(r[3] for r in rows[:some] if r[3] is not None)
        bins = best_fit(rest[:some], [cn[r[1]] for r in rows[:some]], [sn.get(r[3], -1) for r in rows[:some]], capacity, per_source)
        out, fill, place, free = [], {}, {}, max(bins, default=-1) + 1
        for i, (size, _, doc, _) in enumerate(rows):
            full = size // capacity
            for piece in range(full + (i < some or not size)):
                length = capacity if piece < full else rest[i]
                if piece < full or not size:
                    b, free = free, free + 1
                else:
                    b = bins[i]
                out.append((doc, piece, piece * capacity, length, b, place.setdefault(b, 0)))
                place[b] += 1
                fill[b] = fill.get(b, 0) + length
        columns = list(zip(*out, strict=True))
        kinds = [t.schema.field("doc_id").type, pa.int32(), pa.int64(), pa.int64()]
        arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=False)]
        arrays += [pa.array([b * blocks + block for b in columns[4]], pa.int64()), pa.array(columns[5], pa.int32()), pa.array([fill[b] for b in columns[4]], pa.int64())]
        return pa.Table.from_arrays(arrays, names=["doc_id", "piece", "start", "length", "bin", "place", "fill"])

    id_type = slim.schema["doc_id"].dataType.simpleString()
    return dealt.groupBy("block").applyInArrow(run, f"doc_id {id_type}, piece int, start bigint, length bigint, bin bigint, place int, fill bigint")
