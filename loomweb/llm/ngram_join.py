"""N-gram Jaccard join by T-occurrence search with DivideSkip, distributed.

A document is its set of 64-bit shingle hashes. Two sets of sizes a and b with Jaccard similarity J or more share at
least T = ceil(J * a) hashes, whichever of the two is a. The search runs in these steps, all exact:

1.  Sets that are equal become one class, represented by its smallest doc_id (by a number of its own where a doc_id
    stands for several texts).
2.  Inverted lists are kept for part of the hash space: the hashes below a cut (a share of about 2.2 * (1 - J) of all
    hash values, the same for all documents), of documents that have at least p = a - T + 1 hashes there. Small
    documents, and all near the size of any document that has too few, are listed in full as a second level. Either
    way a linked pair shares at least t = listed - p + 1 of the listed hashes.
3.  The lists' lengths are counted over all documents. DivideSkip: the t - 1 longest lists of a document need not be
    merged, since a partner that is in them alone can't reach t. What is left are its p shortest lists, and those with
    no other document fall away too. A document that has none left has no partner.
4.  Each short list links its members to its first one; such pairs are checked and components formed, which closes
    groups of near copies in a number of checks that is linear in their size. The check probes by binary search the
    larger set for all hashes of the smaller.
5.  What then still spans several components is cut into pairs of chunks of documents of similar size. A task builds
    the chunk's inverted lists and runs DivideSkip for each document of the other: it merges the short lists, probes
    the long ones, and retains the documents in other components that reach the overlap.
"""

from __future__ import annotations

import heapq
import math
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, bounded_batches, connected_components

M1, M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
#: Documents of up to so many shingles are listed in full.
FULL = 320
#: Documents of a chunk; share of long lists (the weight in DivideSkip's rule); ids that are broadcast at most (16 MB).
CHUNK, MU, BROADCAST_IDS = 64, 0.01, 1_000_000


class Words(dict):
    """Hashes of words, remembered within a task."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 100_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def shingle_set(text: bytes | None, k: int, words: Words) -> np.ndarray:
    """The sorted distinct hashes (63 bits, the last bit 0) of the k-word shingles; of all words as one if there are fewer."""
    found = text.lower().split() if text else []  # bytes: A-Z alone are folded, and the six ASCII white spaces split
    if not found:
        return np.empty(0, np.int64)
    w = np.fromiter(map(words.__getitem__, found), np.uint64, len(found))
    k = min(k, len(w))
    h = np.full(len(w) - k + 1, k, np.uint64)
    for j in range(k):
        h = (h ^ (h >> np.uint64(29))) * M1 + w[j : len(w) - k + 1 + j]
    h = (h ^ (h >> np.uint64(32))) * M2
    h = h ^ (h >> np.uint64(31))
    return np.unique(h.view(np.int64) & ~np.int64(1))


def need(n: int, num: int, den: int) -> int:
    """The fewest shingles that a set of n must share with a partner: ceil(n * num / den)."""
    return -(-n * num // den)


def _sets(docs: DataFrame, k: int, schema: str, row) -> DataFrame:
    """mapInArrow over (doc_id, text bytes) and the hash of the text; row(set) gives the values after doc_id and th."""
    kind = T._parse_datatype_string("doc_id bigint, th bigint, " + schema)

    def run(batches):
        words = Words()
        names = [f.name for f in kind.fields]
        for b in batches:
            out = [[] for _ in names]
            for d, t, th in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), strict=True):
                for to, value in zip(out, (d, th, *row(shingle_set(t.as_py(), k, words))), strict=True):
                    to.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(v, type=ty) for v, ty in zip(out, arrow(kind), strict=True)], names=names)

    return docs.select("doc_id", F.col("text").cast("binary").alias("text"), F.xxhash64("text").alias("th")).mapInArrow(run, kind)


def arrow(kind: T.StructType) -> list[pa.DataType]:
    known = {"bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "array<bigint>": pa.list_(pa.int64()), "boolean": pa.bool_()}
    return [known[f.dataType.simpleString()] for f in kind.fields]


def merge_short(lists: list[list[int]], most: int = 1) -> list[tuple[int, int]]:
    """Heap-merge sorted lists; (member, number of lists it is in) of members in `most` lists or more."""
    out, last, seen = [], None, 0
    for x in heapq.merge(*lists):
        if x == last:
            seen += 1
            continue
        if last is not None and seen >= most:
            out.append((last, seen))
        last, seen = x, 1
    if last is not None and seen >= most:
        out.append((last, seen))
    return out


def probe(small: np.ndarray, large: np.ndarray) -> int:
    """Binary-probe every hash of one sorted set in the other: the size of their intersection."""
    if len(small) > len(large):
        small, large = large, small
    if not len(small):
        return 0
    at = np.searchsorted(large, small)
    at[at == len(large)] = 0
    return int(np.count_nonzero(large[at] == small))


def divide_skip(lists: list[list[int]], t: int) -> list[tuple[int, int]]:
    """The T-occurrence search on one machine: members in t lists or more, by merging all but the t - 1 longest lists
    and probing those. The plain form of steps 3 and 5, which the tests hold against a count over all lists."""
    ordered = sorted(lists, key=len)
    cut = max(1, len(ordered) - (t - 1))
    short, long = ordered[:cut], [np.asarray(x, np.int64) for x in ordered[cut:]]
    out = []
    for x, seen in merge_short(short, max(1, t - len(long))):
        seen += sum(1 for a in long if len(a) and (i := int(np.searchsorted(a, x))) < len(a) and a[i] == x)
        if seen >= t:
            out.append((x, seen))
    return out


def overlapping(sets: list[np.ndarray], queries: list[np.ndarray], num: int, den: int, skip=None) -> list[tuple[int, int]]:
    """All (query, set) with a Jaccard similarity of num / den or more, by DivideSkip over the sets' inverted lists.

    skip(query, sets) may tell by a boolean array which sets need no look.
    """
    if not sets or not queries:
        return []
    sizes = np.array([len(s) for s in sets])
    tokens = np.concatenate(sets)
    order = np.argsort(tokens, kind="stable")
    members = np.repeat(np.arange(len(sets)), sizes)[order]
    keys, starts = np.unique(tokens[order], return_index=True)
    ends = np.append(starts[1:], len(tokens))
    out = []
    for q, s in enumerate(queries):
        n = len(s)
        open_ = (sizes * den >= n * num) & (n * den >= sizes * num)
        if skip is not None:
            open_ &= ~skip(q)
        if not n or not open_.any():
            continue
        t = need(n, num, den)
        at = np.searchsorted(keys, s)
        at[at == len(keys)] = 0
        hit = np.flatnonzero(keys[at] == s)
        if len(hit) < t:
            continue
        length = (ends - starts)[at[hit]]
        hit = hit[np.argsort(length, kind="stable")]
        skipped = min(t - 1, int(t / (MU * np.log(max(2, length.max())) + 1)))
        short, long = at[hit[: len(hit) - skipped]], s[np.sort(hit[len(hit) - skipped :])]
        lists = [members[starts[i] : ends[i]] for i in short]
        if sum(map(len, lists)) <= 2000:
            seen = np.zeros(len(sets), np.int64)
            for x, c in merge_short([x.tolist() for x in lists]):
                seen[x] = c
        else:  # as the heap, for many members
            seen = np.bincount(np.concatenate(lists), minlength=len(sets))
        for x in np.flatnonzero((seen >= t - skipped) & open_):
            both = int(seen[x]) + probe(long, sets[x])
            if den * both >= num * (n + int(sizes[x]) - both):
                out.append((q, int(x)))
    return out


def ngram_components(docs: DataFrame, k: int = 5, similarity: str | float = "0.8") -> DataFrame:
    """doc_id, n_shingles, component_id of every row of docs (doc_id, text, any other columns).

    Words are runs of anything but ASCII white space, with A-Z folded. A null, empty or blank text has no shingles and
    links with nothing; fewer than k words count as one shingle. Rows with equal sets are linked. component_id is the
    smallest doc_id among the rows that links reach. Repeated doc_ids come back as often as they came, and rows of one
    doc_id with different texts are documents of their own: each is linked by its own text. A null doc_id is a document
    that links with none. An empty table gives none.
    """
    named, nameless, _ = _components(docs, k, similarity)
    out = named.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("low", "doc_id").alias("component_id"))
    return out.union(nameless.select("doc_id", F.col("n").cast("long"), F.lit(None).cast("long")))


def _components(docs: DataFrame, k: int, similarity: str | float) -> tuple[DataFrame, DataFrame, bool]:
    """Of every row with a doc_id: doc_id, hash of the text (th), n, digest, group of linked sets and smallest doc_id
    (low) in it, both null without shingles; doc_id, th and n of the rows without a doc_id; and whether each doc_id
    comes once."""
    spark = docs.sparkSession
    bounded_batches(spark)
    scratch = Scratch(spark)
    j = Fraction(str(similarity))
    num, den = j.numerator, j.denominator
    share = min(1.0, 2.2 * (1 - num / den) + 0.005)
    cut = int(-(2**63) + share * 2**64) if share < 1 else 2**63 - 1
    full = FULL

    while True:
        # documents of up to `full` shingles are listed in full; those above `alone` below the cut
        alone = full * num // den

        def listed(s: np.ndarray, full=full, alone=alone):
            n, low = len(s), int(np.searchsorted(s, cut))
            weak = n if 0 < n and low < n - need(n, num, den) + 1 else 0
            parts = ([s[:low]] if n > alone else []) + ([s | np.int64(1)] if n <= full else [])
            return n, xxhash.xxh3_128_digest(s.tobytes()) if n else None, weak, low if n > alone else 0, np.concatenate(parts).tobytes() if n else b""

        base = scratch.keep(_sets(docs.where("doc_id is not null"), k, "n int, digest binary, weak int, l0 int, lists binary", listed), "lists")
        total = base.agg(F.max("weak").alias("weak"), F.count("*").alias("rows"), F.count_distinct("doc_id").alias("ids")).first()
        if -(-(total.weak or 0) * den // num) <= full:
            break
        full = -(-total.weak * den // num)
        scratch.drop(base)

    # equal sets are one class, known by the number rep; low is its smallest doc_id. The lists, most of the bytes, go
    # once the short ones are found
    rows = scratch.keep(base.select("doc_id", "th", "n", "digest"), "rows")
    some = rows.where("n > 0")
    if total.rows == total.ids:  # rep is low, which no other class has
        classes = scratch.keep(some.groupBy("n", "digest").agg(F.min("doc_id").alias("low")).withColumn("rep", F.col("low")), "classes")
        copies = some.select("doc_id", "n", "digest").join(classes, ["n", "digest"]).where("doc_id <> rep").select("doc_id").distinct()
        heads, old = base.where("n > 0").join(_checked(copies), "doc_id", "left_anti").select("doc_id", "n", "l0", "lists"), [base]
    else:  # a doc_id may stand for several texts: classes are numbered as they are written
        firsts = base.where("n > 0").groupBy("n", "digest").agg(F.min("doc_id").alias("low"), F.first("l0").alias("l0"), F.first("lists").alias("lists"))
        numbered = scratch.keep(firsts.withColumn("rep", F.monotonically_increasing_id()), "numbered")
        classes = scratch.keep(numbered.select("n", "digest", "low", "rep"), "classes")
        heads, old = numbered.select(F.col("rep").alias("doc_id"), "n", "l0", "lists"), [base, numbered]

    def counted(batches):
        held, size = [], 0
        for b in batches:
            for x in b.column(0).to_pylist():
                held.append(np.frombuffer(x, np.int64))
                size += len(held[-1])
                if size > 1_000_000:
                    yield _tokens(*np.unique(np.concatenate(held), return_counts=True))
                    held, size = [], 0
        if held:
            yield _tokens(*np.unique(np.concatenate(held), return_counts=True))

    def postings(batches):
        for b in batches:
            held, ids, size = [], [], 0
            for d, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                held.append(np.frombuffer(x, np.int64))
                ids.append(np.full(len(held[-1]), d, np.int64))
                size += len(held[-1])
                if size > 500_000:
                    yield _tokens(np.concatenate(held), np.concatenate(ids), "doc")
                    held, ids, size = [], [], 0
            if held:
                yield _tokens(np.concatenate(held), np.concatenate(ids), "doc")

    # counted per task first: a list that most documents are in is a few rows a task here
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    lengths = heads.select("lists").mapInArrow(counted, "token bigint, c bigint").repartition(parts, "token").groupBy("token").agg(F.sum("c").cast("int").alias("df")).where("df > 1")
    lengths = scratch.keep(lengths, "lengths")
    shared = heads.select("doc_id", "lists").mapInArrow(postings, "token bigint, doc bigint").join(lengths, "token")
    mine = shared.groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("lists"))

    # of a document's listed hashes its p rarest are merged; those of no other document come first and cost nothing
    sizes = heads.select("doc_id", "n", "l0", F.when(F.col("n") <= full, F.col("n")).otherwise(0).alias("l1"))
    level = lambda one: F.filter("lists", lambda x: x["token"].bitwiseAND(F.lit(1)) == one)
    p = F.col("n") - F.ceil(F.col("n") * F.lit(num) / F.lit(den)).cast("int") + 1
    keep = lambda lists, total: F.slice(lists, 1, F.greatest(F.lit(0), p - (total - F.size(lists))))
    merged = (
        mine.join(sizes, mine.doc == sizes.doc_id)
        .withColumn("a", level(0))
        .withColumn("b", level(1))
        .select("doc", "n", F.concat(keep(F.col("a"), F.col("l0")), keep(F.col("b"), F.col("l1"))).alias("lists"))
        .where("size(lists) > 0")
        .select("doc", "n", F.explode(F.col("lists.token")).alias("token"))
    )
    short = scratch.keep(merged, "short")
    scratch.drop(lengths)
    for done in old:
        scratch.drop(done)

    first = short.groupBy("token").agg(F.min(F.struct("doc", "n")).alias("f"), F.count("*").alias("c")).where("c > 1").select("token", F.col("f.doc").alias("y"), F.col("f.n").alias("m"))
    fits = lambda a, b: F.least(a, b) * den >= F.greatest(a, b) * num
    star = scratch.keep(short.join(first, "token").where((F.col("doc") != F.col("y")) & fits(F.col("n"), F.col("m"))).select(F.col("doc").alias("x"), "y").distinct(), "star")
    ends = star.select("x").union(star.select("y")).union(short.join(first, "token").select("doc")).toDF("doc_id").distinct()
    ends = scratch.keep(ends, "ends")
    if total.rows == total.ids:
        found = scratch.keep(_sets(docs.select("doc_id", "text").join(_checked(ends), "doc_id", "left_semi"), k, "s binary", lambda s: (s.tobytes(),)), "sets").drop("th")
    else:
        wanted = scratch.keep(classes.join(ends, classes.rep == ends.doc_id, "left_semi"), "wanted")
        lows = wanted.select(F.col("low").alias("doc_id")).distinct()
        again = _sets(docs.select("doc_id", "text").join(_checked(lows), "doc_id", "left_semi"), k, "digest binary, s binary", lambda s: (xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None, s.tobytes()))
        found = again.groupBy("digest").agg(F.first("s").alias("s")).join(wanted, "digest").select(F.col("rep").alias("doc_id"), "s")
        found = scratch.keep(found, "sets")

    def similar(a, b):
        import pandas as pd

        out = np.zeros(len(a), bool)
        for i, (u, v) in enumerate(zip(a, b, strict=True)):
            u, v = np.frombuffer(u, np.int64), np.frombuffer(v, np.int64)
            both = probe(u, v)
            out[i] = den * both >= num * (len(u) + len(v) - both)
        return pd.Series(out)

    pairs = star.join(found.select(F.col("doc_id").alias("x"), F.col("s").alias("sx")), "x").join(found.select(F.col("doc_id").alias("y"), F.col("s").alias("sy")), "y")
    edges = scratch.keep(pairs.where(F.pandas_udf(similar, "boolean")("sx", "sy")).select(F.col("x").alias("src"), F.col("y").alias("dst")), "linked")
    near = scratch.keep(connected_components(edges, scratch), "near")

    # what still spans several components
    named = short.join(near.select(F.col("id").alias("doc"), "component"), "doc", "left").withColumn("component", F.coalesce("component", "doc"))
    open_ = named.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.min("doc").alias("head")).where("lo < hi").select("token", "head")
    left = scratch.keep(named.join(open_, "token").select("doc", "n", "component", "head"), "open")
    if not left.isEmpty():
        near = scratch.keep(connected_components(edges.union(_remaining(left, found, num, den, scratch)), scratch), "components")

    group = classes.join(near.select(F.col("id").alias("rep"), "component"), "rep", "left").select("n", "digest", "low", F.coalesce("component", "rep").alias("group"))
    if total.rows != total.ids:
        group = group.drop("low").join(group.groupBy("group").agg(F.min("low").alias("low")), "group")
    else:
        group = group.withColumn("low", F.col("group"))
    return rows.join(group, ["n", "digest"], "left"), _sets(docs.where("doc_id is null"), k, "n int", lambda s: (len(s),)), total.rows == total.ids


def _tokens(token: np.ndarray, value: np.ndarray, name: str = "c") -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(token), pa.array(value.astype(np.int64))], names=["token", name])


def _checked(ids: DataFrame) -> DataFrame:
    """Ids for a semi join: sent to all tasks if they are few, else joined by a shuffle."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def _remaining(left: DataFrame, found: DataFrame, num: int, den: int, scratch: Scratch) -> DataFrame:
    """Links between different components among documents that share a short list (doc, n, component, head of the list).

    Documents that lists connect form a group; within it only documents of one size band or two adjacent ones can link.
    A band is cut into chunks and each pair of chunks is searched by a task of its own.
    """
    group = connected_components(left.select(F.col("doc").alias("src"), F.col("head").alias("dst")), scratch)
    band = F.floor(F.log("n") / F.lit(math.log(den / num) * (1 + 1e-9))) if num < den else F.col("n").cast("long")
    docs = left.select("doc", "n", "component").distinct().join(group.select(F.col("id").alias("doc"), F.col("component").alias("g")), "doc").withColumn("band", band)
    docs = scratch.keep(docs, "bands")
    chunks = docs.groupBy("g", "band").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("nb"))
    here, above, below = chunks, chunks.select("g", (F.col("band") - 1).alias("band"), F.col("nb").alias("na")), chunks.select("g", (F.col("band") + 1).alias("band"), F.col("nb").alias("nu"))
    docs = docs.join(here, ["g", "band"]).join(above, ["g", "band"], "left").join(below, ["g", "band"], "left").withColumn("c", F.pmod(F.xxhash64("doc"), F.col("nb")).cast("int"))
    to = lambda count, f: F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), f)).otherwise(F.array())
    task = lambda band, kind, i, j: F.struct(band.cast("long").alias("b"), F.lit(kind).alias("kind"), i.cast("int").alias("i"), j.cast("int").alias("j"))
    own, nb = F.col("band"), F.col("nb")
    tasks = F.concat(
        to(nb, lambda o: task(own, 0, F.least(o, F.col("c")), F.greatest(o, F.col("c")))),
        to(F.coalesce("na", F.lit(0)), lambda o: task(own, 1, F.col("c"), o)),
        to(F.coalesce("nu", F.lit(0)), lambda o: task(own - 1, 1, o, F.col("c"))),
    )
    dealt = docs.withColumn("task", F.explode(tasks)).select("doc", "component", "c", "g", (F.col("task.b") == F.col("band")).alias("base"), "task.*")
    dealt = dealt.join(found.select(F.col("doc_id").alias("doc"), "s"), "doc")

    def search(table: pa.Table) -> pa.Table:
        kind, i, j = (table.column(x)[0].as_py() for x in ("kind", "i", "j"))
        doc, comp, c, base = (table.column(x).to_numpy() for x in ("doc", "component", "c", "base"))
        sets = [np.frombuffer(x, np.int64) for x in table.column("s").to_pylist()]
        if kind:
            a, b = np.flatnonzero(base), np.flatnonzero(~base)
        else:
            a, b = np.flatnonzero(c == i), np.flatnonzero(c == j)
        same = (lambda q: (comp[a] == comp[b[q]]) | (doc[a] >= doc[b[q]])) if not kind and i == j else (lambda q: comp[a] == comp[b[q]])
        links = overlapping([sets[x] for x in a], [sets[x] for x in b], num, den, same)
        return pa.table({"src": pa.array([int(doc[b[q]]) for q, _ in links], pa.int64()), "dst": pa.array([int(doc[a[x]]) for _, x in links], pa.int64())})

    return scratch.keep(dealt.groupBy("g", "b", "kind", "i", "j").applyInArrow(search, "src bigint, dst bigint"), "more")


def one_of_each(docs: DataFrame, k: int = 5, similarity: str | float = "0.8") -> DataFrame:
    """One row of each group of near copies, that with the smallest doc_id; texts without shingles and rows without a
    doc_id stay.

    Rows of one doc_id with different texts are documents of their own: one of two near copies goes, others stay. Of
    rows with equal doc_id and text one stays, the first in the order of the columns that have an order.
    """
    named, _, once = _components(docs, k, similarity)
    row = F.struct("doc_id", "digest", "th")
    best = named.where("n > 0").groupBy("group").agg(F.min(row).alias("r")).select("r.doc_id", "r.th")
    keep = best.union(named.where("n = 0").select("doc_id", "th").distinct())
    some = docs.where("doc_id is not null").withColumn("_th", F.xxhash64("text"))
    some = some.join(keep.toDF("doc_id", "_th"), ["doc_id", "_th"], "left_semi")
    if once:
        return some.select(docs.columns).union(docs.where("doc_id is null"))
    ordered = [f.name for f in docs.schema.fields if "map<" not in f.dataType.simpleString() and f.dataType.simpleString() != "variant"]
    one = some.groupBy("doc_id", "_th").agg(F.min_by(F.struct(*docs.columns), F.struct(*ordered)).alias("r")).select("r.*")
    return one.select(docs.columns).union(docs.where("doc_id is null"))
