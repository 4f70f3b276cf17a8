"""Each operator against a plain version, and on nulls, empty and long texts, ties, repeats, empty tables and extra columns."""

from __future__ import annotations

import collections
import html
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pytest

from loomweb.llm import common, embed_dedup, htmltext, licenses, media, mixing, ngram_join, packing, quality, sharding, toxicity, webp
from loomweb.llm.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def words(rng, n, k=60):
    return " ".join(rng.choice([f"w{i}" for i in range(k)]) for _ in range(n))


def corpus(seed=3, n=60):
    """Documents with exact and near copies, shared passages, blanks, nulls, repeats and a very long text."""
    rng = random.Random(seed)
    passage = words(rng, 50, 500)
    rows = []
    for i in range(n):
        t = words(rng, rng.choice([0, 1, 2, 3, 5, 30, 120, 400]), 2000)
        if i % 5 == 0:
            t = passage + " " + t
        rows.append(t)
    for i in range(0, n, 3):
        w = rows[i].split()
        if w:
            w[rng.randrange(len(w))] = "changed"
        rows.append(" ".join(w))
    for _ in range(40):  # a group of near copies, not all of which are alike
        w = passage.split() * 3
        for _ in range(rng.randrange(6)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(99)}"
        rows.append(" ".join(w))
    rows += [rows[1], rows[1], "", "   ", None, "A b", "a B", words(rng, 20000, 9000)]
    return [(i, t, "en", f"s{i % 4}" if i % 7 else None, len(t or "")) for i, t in enumerate(rows)]


def frame(spark, rows, schema=DOCS):
    return spark.createDataFrame(rows, schema)


# --- n-gram join ---


def plain_components(rows, k, num, den):
    sets = {}
    for d, t, *_ in rows:
        w = (t or "").encode().lower().split()
        sets[d] = frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and den * both >= num * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {d: (len(s), find(d)) for d, s in sets.items()}


@pytest.mark.parametrize("k,similarity,num,den", [(4, "0.85", 17, 20), (5, "0.8", 4, 5), (2, "0.5", 1, 2)])
def test_ngram_components(spark, k, similarity, num, den):
    rows = corpus()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_components(frame(spark, rows), k, similarity).collect()}
    assert got == plain_components(rows, k, num, den)


def test_ngram_edges(spark):
    assert ngram_join.ngram_components(frame(spark, [])).collect() == []
    rows = [(1, "a b c", None, None, 1), (1, "a b c", None, None, 1), (2, "A B C", None, None, 1), (None, "a b c", None, None, 1), (3, None, None, None, 0)]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.ngram_components(frame(spark, rows)).collect()), key=str)
    assert got == sorted([(1, 1, 1), (1, 1, 1), (2, 1, 1), (None, 1, None), (3, 0, 3)], key=str)
    extra = frame(spark, corpus()).selectExpr("*", "1 as n", "'x' as digest", "2 as component", "3 as component_id", "4 as token")
    kept = ngram_join.one_of_each(extra)
    assert kept.columns == extra.columns
    want = plain_components(corpus(), 5, 4, 5)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(d for d, (_, c) in want.items() if d == c)


def test_ngram_doc_id_with_several_texts(spark):
    rng = random.Random(8)
    a, b, c = (words(rng, 40, 900) for _ in range(3))
    near = " ".join(["changed", *b.split()[1:]])
    rows = [(5, a), (5, b), (9, near), (7, c), (7, c), (3, b + " end"), (3, a.upper()), (4, "")]
    want = [3, 3, 3, 7, 7, 3, 3, 4]
    many = [words(rng, 30, 900) for _ in range(40)]  # a doc_id with many texts, each a near copy of one of another
    rows += [(11, t) for t in many] + [(100 + i, t + " more") for i, t in enumerate(many)]
    want += [11] * 80
    got = sorted((r.doc_id, r.component_id) for r in ngram_join.ngram_components(frame(spark, rows, "doc_id bigint, text string")).collect())
    assert got == sorted((d, w) for (d, _), w in zip(rows, want, strict=True))
    kept = ngram_join.one_of_each(frame(spark, [(*r, i, {"k": i}) for i, r in enumerate(rows)], "doc_id bigint, text string, nth int, extra map<string,int>")).collect()
    # two groups, of a and of b, each by the row with the smallest doc_id; c once, its first row; the empty text; the many
    assert sorted(r.nth for r in kept) == [3, 5, 6, 7, *range(8, 48)]


def test_divide_skip():
    rng = random.Random(1)
    for _ in range(50):
        lists = [sorted(rng.sample(range(40), rng.randrange(1, 30))) for _ in range(rng.randrange(1, 12))]
        t = rng.randrange(1, len(lists) + 1)
        counts = collections.Counter(x for ls in lists for x in ls)
        assert sorted(ngram_join.divide_skip(lists, t)) == sorted((x, c) for x, c in counts.items() if c >= t)


def test_overlapping():
    rng = random.Random(2)
    sets = [np.array(sorted(rng.sample(range(120), rng.randrange(1, 100))), np.int64) for _ in range(120)]
    got = sorted(ngram_join.overlapping(sets, sets, 1, 2))
    plain = [(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets) if 2 * len(np.intersect1d(a, b)) >= len(np.union1d(a, b))]
    assert got == sorted(plain)


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 140)] + [(None, 3), (7, None)]
    scratch = common.Scratch(spark)
    got = {r.id: r.component for r in common.connected_components(spark.createDataFrame(edges, "src bigint, dst bigint"), scratch).collect()}
    parent = {x: x for e in edges for x in e if None not in e and e[0] != e[1]}
    for _ in range(200):
        for a, b in edges:
            if a is not None and b is not None and a != b:
                parent[a] = parent[b] = min(parent[a], parent[b])
    assert got == parent
    assert common.connected_components(spark.createDataFrame([], "src bigint, dst bigint"), scratch).collect() == []


# --- embeddings ---


def test_vectors(spark):
    rng = np.random.default_rng(5)
    base = rng.standard_normal((40, 16)).astype(np.float32)
    rows = []
    for i, v in enumerate(base):
        rows.append((3 * i, v.tolist(), i % 3))
        rows.append((3 * i + 1, (v + rng.standard_normal(16) * 0.12).astype(np.float32).tolist(), i % 3))
        rows.append((3 * i + 2, v.tolist(), i % 3))
    bad = [(900, None, 1), (901, [0.0] * 16, 1), (902, [float("nan")] * 16, 1), (903, [None] + [1.0] * 15, 1), (904, base[0].tolist(), None), (905, [float("inf")] * 16, 0), (906, [], 0), (907, [1.0, 2.0], 0)]
    df = spark.createDataFrame(rows + bad, "vec_id bigint, embedding array<float>, label int").selectExpr("*", "1 as n", "2 as id", "'x' as rep")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embed_dedup.vector_components(df).collect()}
    assert len(got) == len(rows) + len(bad)
    x = np.array([r[1] for r in rows], np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids, label = np.array([r[0] for r in rows]), np.array([r[2] for r in rows])
    hits = (x @ x.T >= 0.98) & (label[:, None] == label[None, :])
    np.fill_diagonal(hits, False)
    roots = embed_dedup.local_roots(hits, ids)
    for i, v in enumerate(ids.tolist()):
        assert got[v] == (int(hits[i].sum()), int(roots[i]), bool(roots[i] == v))
    for v, *_ in bad:
        assert got[v] == (0, v, True)
    assert embed_dedup.vector_components(df.limit(0)).collect() == []


def test_large_bucket(spark, monkeypatch):
    monkeypatch.setattr(embed_dedup, "CHUNK", 16)
    rng = np.random.default_rng(6)
    v = rng.standard_normal(8)
    rows = [(i, (v + rng.standard_normal(8) * 0.02).astype(np.float32).tolist(), 1) for i in range(150)]
    got = embed_dedup.vector_components(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")).collect()
    x = np.array([r[1] for r in rows], np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    n = (x @ x.T >= 0.98).sum(1) - 1
    assert {r.vec_id: r.n_links for r in got} == dict(enumerate(n.tolist()))


# --- classifiers ---


def labelled(seed=7, n=400):
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        toxic, poor = i % 5 == 0, i % 7 == 0
        w = words(rng, rng.randrange(20, 80), 300).split()
        if toxic:
            for _ in range(3):
                w[rng.randrange(len(w))] = rng.choice(["idiot", "m0r0n", "grumpfa", "grumpfo", f"grumpf{rng.choice('aeiou')}x"])
        if poor:
            w = [x + "###" for x in w]
        docs.append((i, " ".join(w) + ".", "en", "s", 0))
        labels.append((i, int(not poor), int(toxic)))
    return docs, labels


def fold(d, n):
    return zlib.crc32(str(d).encode()) % n


def test_toxicity(spark):
    docs, labels = labelled()
    lab = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    more = [(1000, None, None, None, 0), (1001, "", None, None, 0), (1002, "You ѕtupіd person", None, None, 0), (1003, "an i d i o t", None, None, 0), (1004, "put it in the trash can, please", None, None, 0), (1005, "ok " * 30000, None, None, 0), (1005, "ok " * 30000, None, None, 0), (1006, "oxymoron and clowns", None, None, 0), (1007, "1D10T!", None, None, 0)]
    df = frame(spark, docs + more).selectExpr("*", "1 as toxic", "2 as a", "3 as w")
    out = toxicity.score_toxicity(df, lab)
    got = {r.doc_id: r for r in out.collect()}
    assert out.count() == len(docs) + len(more) and all(0 <= r.toxicity <= 1 for r in got.values())
    held = [(d, t) for d, _, t in labels if fold(d, 3) == 1]
    assert all(got[d].toxic == t for d, t in held)
    assert [got[i].toxic for i in range(1000, 1008)] == [0, 0, 1, 1, 0, 0, 0, 1]
    empty = toxicity.score_toxicity(df.limit(0), lab.limit(0))
    assert empty.collect() == []


def test_quality(spark):
    docs, labels = labelled()
    lab = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    more = [(1000, None, None, None, 0), (1001, "", None, None, 0), (1002, "x " * 50000, None, None, 0), (1002, "x " * 50000, None, None, 0)]
    df = frame(spark, docs + more).selectExpr("*", "1 as good", "2 as quality", "3 as s")
    out = quality.score_quality(df, lab)
    got = {r.doc_id: r for r in out.collect()}
    assert out.count() == len(docs) + len(more) and all(0 <= r.quality_score <= 1 for r in got.values())
    held = [(d, q) for d, q, _ in labels if fold(d, 5) == 0]
    assert sum(got[d].good == q for d, q in held) >= 0.97 * len(held)
    assert quality.score_quality(df.limit(0), lab.limit(0)).collect() == []


def test_rules_match_their_column(spark):
    rng = np.random.default_rng(8)
    x = rng.random((500, len(quality.STATS)))
    y = ((x[:, 0] > 0.4) & (x[:, 5] < 0.8)).astype(float)
    m = quality.RuleModel.fit(x, y)
    assert ((m.predict(x) >= 0.5) == y).mean() > 0.97 and len(m.weights) > 0
    from pyspark.sql import functions as F

    got = [r[0] for r in spark.createDataFrame([(v.tolist(),) for v in x[:50]], "s array<double>").select(m.column(F.col("s"))).collect()]
    assert np.allclose(got, m.predict(x[:50]))


# --- packing, mixing, sharding ---


def check_bins(rows, out, capacity, per_source):
    total = collections.Counter()
    by_bin = collections.defaultdict(list)
    for r in out:
        total[r.doc_id] += r.length
        by_bin[r.bin].append(r)
    sizes = collections.Counter()
    for d, t, *_ in rows:
        sizes[d] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert total == sizes or {k: v for k, v in total.items() if v} == {k: v for k, v in sizes.items() if v}
    text = {d: " ".join((t or "").lower().split()) for d, t, *_ in rows}
    source = {d: s for d, _, _, s, _ in rows}
    for b in by_bin.values():
        assert sum(r.length for r in b) <= capacity and {r.fill for r in b} == {sum(r.length for r in b)}
        assert sorted(r.place for r in b) == list(range(len(b)))
        if len(b) > 1:
            assert len({text[r.doc_id] for r in b}) == len(b)
            assert max(collections.Counter(source[r.doc_id] for r in b if source[r.doc_id]).values(), default=0) <= per_source


def test_packing(spark):
    rows = corpus()
    df = frame(spark, rows).selectExpr("*", "1 as size", "2 as block", "3 as cluster")
    out = packing.pack(df, 256, 2).collect()
    check_bins(rows, out, 256, 2)
    assert {r.doc_id for r in out} == {r[0] for r in rows}
    assert packing.pack(df, 256, 2).collect() == out or sorted(packing.pack(df, 256, 2).collect()) == sorted(out)
    assert packing.pack(df.limit(0)).collect() == []


def test_best_fit_is_tightest():
    rng = random.Random(9)
    for _ in range(30):
        n, cap = 60, 50
        sizes = sorted((rng.randrange(1, 30) for _ in range(n)), reverse=True)
        cl, so = [rng.randrange(20) for _ in range(n)], [rng.randrange(-1, 6) for _ in range(n)]
        bins = []  # plain: look at every bin
        want = []
        for s, c, o in zip(sizes, cl, so, strict=True):
            fit = [(b["left"], i) for i, b in enumerate(bins) if b["left"] >= s and c not in b["c"] and (o < 0 or b["s"][o] < 2)]
            i = min(fit)[1] if fit else len(bins)
            if not fit:
                bins.append({"left": cap, "c": set(), "s": collections.Counter()})
            bins[i]["left"] -= s
            bins[i]["c"].add(c)
            if o >= 0:
                bins[i]["s"][o] += 1
            want.append(i)
        assert packing.best_fit(sizes, cl, so, cap, 2) == want


def plain_targets(sizes, weights=(5, 2, 1)):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        left = total - sum(3 * sizes[s] for s in capped)
        share = {s: left * w[s] / sum(w[x] for x in names if x not in capped) for s in names if s not in capped}
        over = {s for s, v in share.items() if v > 3 * sizes[s] + 1e-9}
        if not over:
            return {s: 3 * sizes[s] if s in capped else share[s] for s in names}
        capped |= over


def test_mixing(spark):
    rows = corpus() + [(5000 + i, words(random.Random(i), 40), "en", "tiny", 0) for i in range(2)]
    df = frame(spark, rows).selectExpr("*", "1 as size", "2 as target", "3 as node", "4 as leaf")
    out = mixing.mixed_sizes(df).collect()
    assert len(out) == len(rows) and sorted(mixing.mixed_sizes(df).collect()) == sorted(out)
    source, size = {r[0]: r[3] for r in rows}, collections.Counter()
    for r in out:
        size[source[r.doc_id]] += r.size
    target = plain_targets(dict(size))
    taken = collections.Counter()
    for r in out:
        s = source[r.doc_id]
        assert r.source_size == size[s] and math.isclose(r.target, target[s], rel_tol=1e-9)
        assert 0 <= r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0)
        taken[s] += r.taken
    biggest = collections.defaultdict(int)
    for r in out:
        biggest[source[r.doc_id]] = max(biggest[source[r.doc_id]], r.size)
    assert all(abs(taken[s] - target[s]) <= biggest[s] for s in size)
    again = mixing.repeated(df)
    assert again.columns == df.columns
    copies = collections.Counter(r.doc_id for r in again.collect())
    assert all(copies[r.doc_id] == (r.taken // r.size if r.size else 0) for r in out)
    assert mixing.mixed_sizes(df.limit(0)).collect() == [] and mixing.repeated(df.limit(0)).collect() == []


def test_pivot_keeps_mass():
    rng = random.Random(10)
    hits = 0
    for trial in range(300):
        sizes = [rng.randrange(1, 9) for _ in range(20)]
        f = [0.3] * 20
        got = mixing.pivot(sizes, f, lambda i: rng.random())
        assert math.isclose(sum(s * g for s, g in zip(sizes, got, strict=True)), 0.3 * sum(sizes), abs_tol=1e-6)
        assert sum(1e-9 < g < 1 - 1e-9 for g in got) <= 1
        hits += got[3]
    assert 0.2 < hits / 300 < 0.4


def test_sharding(spark):
    rows = corpus() + [(9000 + i, "the same text", "en", None, 0) for i in range(400)] + [(9999, "a b", None, None, 0)] * 2
    df = frame(spark, rows).selectExpr("*", "1 as size", "2 as shard", "3 as g", "4 as b")
    out = sharding.shard(df, 8).collect()
    assert len(out) == len(rows) and sorted(sharding.shard(df, 8).collect()) == sorted(out)
    by = collections.defaultdict(list)
    for r in out:
        by[r.shard].append(r)
        assert r.law == "bytes" and r.grown_shard is None
    assert all(sorted(r.slot for r in b) == list(range(len(b))) for b in by.values())
    text = {r[0]: r[1] or "" for r in rows}
    for r in out:
        assert r.size == len(text[r.doc_id].encode()) + 16 and r.text_crc32 == zlib.crc32(text[r.doc_id].encode())
    assert sharding.shard(df.limit(0), 8).collect() == []


def test_shards_are_even_and_keep_groups(spark):
    rng = random.Random(11)
    rows = [(i, f"t{i // 3 if i % 2 else i} " + "x" * rng.randrange(50, 200), None, None, 0) for i in range(4000)]
    rows += [(10_000 + i, "y" * 150, None, None, 0) for i in range(1500)] + [(20_000 + i, f"pair {i // 2} " + "z" * 100, None, None, 0) for i in range(600)]
    out = sharding.shard(frame(spark, rows), 10).collect()
    size, where = collections.Counter(), collections.defaultdict(set)
    text = {r[0]: r[1] for r in rows}
    for r in out:
        size[r.shard] += r.size
        where[text[r.doc_id]].add(r.shard)
    mean = sum(size.values()) / 10
    assert len(size) == 10 and max(size.values()) - min(size.values()) < 0.02 * mean
    pairs = [w for t, w in where.items() if t.startswith("pair")]
    assert sum(len(w) == 1 for w in pairs) >= 0.95 * len(pairs)
    assert len(where["y" * 150]) <= 5


def test_sharding_is_native():
    source = open(sharding.__file__).read()
    assert not re.search(r"pandas_udf|mapIn|applyIn|\.rdd|\budf\b|createDataFrame|import pandas|import numpy", source)


# --- HTML, media, licences ---


def test_main_text():
    page = """<html><head><title>t</title><style>p{}</style></head><body><header><a href="/">Home</a></header><nav><ul><li>menu</li></ul></nav>
<article><h1>Head</h1><p>First&nbsp;&amp;
 second<br>line.<p>Short.</p><div class="ad">Buy this</div><script>var t="</p>";</script><p><b>Bold</b>text &lt;ok&gt;</p><section id="comments"><p>I like it a lot, the best of all.</p></section></article>
<aside>side</aside><form><input><p>Name</p></form><footer>&copy; me</footer></body></html>"""
    assert htmltext.main_text(page) == "Head\nFirst & second line.\nShort.\nBoldtext <ok>"
    below = "<article><h1>T</h1><p>Some good text that is long enough for a block of the article.</p><h3>3 Comments</h3><p>I like the text and the rest of it, the best of all the texts.</p><h2>More</h2><p>Back to it.</p></article>"
    assert htmltext.main_text(below) == "T\nSome good text that is long enough for a block of the article.\nMore\nBack to it."
    assert htmltext.main_text(None) == htmltext.main_text("") == htmltext.main_text("<script>x</script>") == ""
    prose = "This is the first paragraph of the text and it has the words that are in the language, and so it is good for the reader. " * 3
    assert htmltext.main_text(f"<div><a href=x>one</a> <a href=y>two</a></div><div><p>{prose}</p><p>Tail.</p></div><div><a href=z>three</a></div>") == prose.strip() + "\nTail."
    assert len(htmltext.main_text("<p>" + "the word of it " * 50_000 + "</p>")) > 700_000


def test_extract(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    rows = {r.page_id: r for r in htmltext.extract(pages).collect()}
    for r in pages.collect():
        inner = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        want = [" ".join(html.unescape(re.sub(r"<br>", " ", re.sub(r"</?b>", "", x))).split()) for x in re.split(r"</?(?:p|h1)>", inner)]
        assert rows[r.page_id].text == "\n".join(x for x in want if x) and rows[r.page_id].n_chars == len(rows[r.page_id].text)
    odd = spark.createDataFrame([(1, "u", None, "z"), (1, "u", None, "z"), (None, None, "<p>x", "z")], "page_id bigint, url string, html string, text string")
    assert sorted((str(r.page_id), r.text, r.n_chars) for r in htmltext.extract(odd).collect()) == [("1", "", 0), ("1", "", 0), ("None", "x", 1)]
    assert htmltext.extract(odd.limit(0)).collect() == []


def images():
    rng = np.random.default_rng(12)
    for h, w in ((1, 1), (5, 7), (20, 33), (16, 16)):
        for colours in (1, 2, 3, 11, 200, 5000):
            few = rng.integers(0, 2**32, min(colours, h * w), dtype=np.uint32)
            yield few[rng.integers(0, len(few), (h, w))]


@pytest.mark.parametrize("transforms", [(), (0,), (1,), (2,), (3,), (0, 1, 2), (2, 1, 0), (3, 0)])
def test_webp_round_trip(transforms):
    for p in images():
        if 3 in transforms and len(np.unique(p)) > 256:
            continue
        for more in ({}, {"cache_bits": 4}, {"lz": True}, {"lz": True, "cache_bits": 7, "tile": 2}):
            for mode in (0, 5, 11):
                assert (webp.decode(webp.encode(p, transforms, mode=mode, **more)) == p).all()


def test_webp_known_bytes():
    """A 1 x 1 image, bit by bit: size, no transform, no cache, one group of single-symbol codes, no pixel bits."""
    out = webp.Writer()
    for v, n in ((0, 14), (0, 14), (1, 1), (0, 3), (0, 1), (0, 1), (0, 1)):
        out.put(v, n)
    for symbol in (200, 10, 30, 255):
        for v, n in ((1, 1), (0, 1), (1, 1), (symbol, 8)):
            out.put(v, n)
    for v, n in ((1, 1), (0, 1), (0, 1), (0, 1)):
        out.put(v, n)
    assert webp.decode(webp.riff(out.bytes())).tolist() == [[0xFF0AC81E]]


def test_webp_refuses():
    good = webp.encode(np.zeros((9, 9), np.uint32), lz=True)
    for bad in (b"", b"RIFF", good[:22], good.replace(b"VP8L", b"VP8 "), good[:30] + b"\x00" * 3):
        with pytest.raises((webp.BadImage, IndexError, ValueError)):
            p = webp.decode(bad)
            if (p == 0).all() and p.shape == (9, 9):
                raise ValueError("the padding was not needed")


def test_webp_of_another_encoder():
    """The 1 x 1 lossless image that browsers are tested with."""
    import base64

    assert webp.decode(base64.b64decode("UklGRhoAAABXRUJQVlA4TA0AAAAvAAAAEAcQERGIiP4HAA==")).shape == (1, 1)


def test_webp_palette_by_hand():
    """Two colours, eight pixels to a byte, 0b10110001 from the lowest bit on: the table, then one bundled pixel."""
    out = webp.Writer()
    for v, n in ((7, 14), (0, 14), (1, 1), (0, 3), (1, 1), (3, 2), (1, 8)):
        out.put(v, n)
    out.put(0, 1)  # the table: no cache, then its codes; green 5 and 3 (the second adds to the first), red and blue 0, alpha 255 and 0
    for v, n in ((1, 1), (1, 1), (1, 1), (3, 8), (5, 8)):
        out.put(v, n)
    for symbol in (0, 0):
        for v, n in ((1, 1), (0, 1), (1, 1), (symbol, 8)):
            out.put(v, n)
    for v, n in ((1, 1), (1, 1), (1, 1), (0, 8), (255, 8)):
        out.put(v, n)
    for v, n in ((1, 1), (0, 1), (0, 1), (0, 1)):
        out.put(v, n)
    for v in (1, 1, 0, 0):  # first pixel: green 5, alpha 255; second: green 3, alpha 0
        out.put(v, 1)
    for v, n in ((0, 1), (0, 1), (0, 1)):  # no more transforms, no cache, one group
        out.put(v, n)
    for symbol in (0b10110001, 0, 0, 255):
        for v, n in ((1, 1), (0, 1), (1, 1), (symbol, 8)):
            out.put(v, n)
    for v, n in ((1, 1), (0, 1), (0, 1), (0, 1)):
        out.put(v, n)
    first, second = 0xFF000500, 0xFF000800
    assert webp.decode(webp.riff(out.bytes())).tolist() == [[second, first, first, first, second, second, first, second]]


def test_webp_transforms_by_hand():
    """What undoing a transform gives, worked out from the format's text."""
    left = np.array([0xFF102030, 0x00010203, 0x000000FF], np.uint32)  # residuals of the first row: black, then the pixel before
    assert webp.predict(left, 3, 1, np.zeros(1, np.int64), 2, True).tolist() == [0xFE102030, 0xFE112233, 0xFE112232]
    # red += 16 * green / 32, blue += -16 * green / 32 + 32 * red / 32, for green 64 and red 1
    e = np.array([0xFF000000 | 32 << 16 | (-16 & 255) << 8 | 16], np.uint32)
    assert webp.cross(np.array([0xFF014005], np.uint32), 1, 1, e, 2, True).tolist() == [0xFF000000 | 33 << 16 | 64 << 8 | ((5 - 32 + 33) & 255)]


def test_payloads(monkeypatch):
    rng = random.Random(13)
    known = [bytes(64), b"a" * 640, bytes(range(256)) * 10, bytes(2_200_000 // 64 * 64), rng.randbytes(6400), ("Über den Wolken " * 40).encode()[:640]]
    known += [bytes(rng.choice(b"ab") for _ in range(6400)), bytes(rng.choice(b"abc") for _ in range(640)), bytes(rng.choice(b"0123456789abcdef") for _ in range(64_000)), rng.randbytes(64 * 16385)]
    for p in known:
        assert webp.decode_payload(webp.encode_payload(p))[0] == p
    assert webp.chunks(webp.encode_payload(known[-1]))[-1][0] == webp.LENGTH
    assert len(webp.encode_payload(known[6])) < 6400 / 8 + 100  # one bit a sample, by the palette
    # the most that one image holds, and what is above
    assert webp.payload_shape(webp.MOST) == (webp.MAX_SIDE, webp.MAX_SIDE) and all(max(webp.payload_shape(64 * n)) <= webp.MAX_SIDE for n in (1, 16384, 16385, 2**22 - 1, 2**22))
    monkeypatch.setattr(webp, "MOST", 6400)
    for p in known[2:]:
        data = webp.encode_payload(p)
        back, images = webp.decode_payload(data)
        assert back == p and len(images) == -(-len(p) // 6400)
        assert media.features(images).count("x") == len(images)
    for bad in (b"", data[:-9], data + b"RIFF"):
        with pytest.raises(webp.BadImage):
            webp.decode_payload(bad)


def test_media(spark):
    rows = corpus()[-20:] + [(1, "same", None, None, 0), (2, "same", None, None, 0), (3, "é" * 50000, None, None, 0)]
    df = frame(spark, rows).selectExpr("*", "1 as media", "2 as payload")
    import hashlib

    stored = media.store(df)
    out = media.read_back(stored).collect()
    text = collections.defaultdict(list)
    for r in rows:
        text[r[0]].append((r[1] or "").encode())
    for r in out:
        p = media.padded(text[r.doc_id][0])
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(text[r.doc_id][0]), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
    one, two = (r[3:] for r in out if r.doc_id in (1, 2))
    assert one == two and len(out) == len(rows)
    pixels = media.pixel_arrays(stored.limit(2).selectExpr("doc_id", "media").union(spark.createDataFrame([(7, b"bad")], "doc_id bigint, media binary"))).collect()
    assert pixels[-1].width is None and all(len(r.pixels) == r.width * r.height for r in pixels[:-1])
    assert media.read_back(media.store(df.limit(0))).collect() == []


def planted_licenses():
    """(doc_id, text, extra): each known licence whole, in other spelling and wrapping, without title; others; notices."""
    rows, want = [], []

    def put(text, name):
        rows.append((len(rows), text, 0))
        want.append(name)

    for name, text in licenses.whole_texts():
        put(text, name)
        put(re.sub(r"(?<=[a-z,]) (?=[a-z])", "\n    ", re.sub(r"\n(?!\s*\n)\s*", " ", text)) if "Copyright" not in text and "copyright" not in text else text.replace("\n", "\r\n  ").upper(), name)
        put("Copyright (c) 1999 Somebody, Inc.  All rights reserved.\n\n" + re.sub(r"\bsublicense\b", "sub-licence", re.sub(r"\blicense(s|d)?\b", r"licence\1", text)), name)
        put(licenses.variants(text)[-1], name)
        put(text + " And more.", None)
    for t in (None, "", "x " * 100_000):
        put(t, None)
    return rows, want


def test_licenses(spark):
    rows, want = planted_licenses()
    rows += [(900, "Text\nReleased under the MIT Licence.\nmore\nLicensed under CC BY-NC 4.0", 0)] * 2 + [(None, "Licensed under the MIT License.", 0)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, digest int")
    got = licenses.scan(df).collect()
    assert {r.doc_id: r.license_id for r in got if r.doc_id is not None and r.doc_id < 900} == dict(enumerate(want))
    assert len(set(want) - {None}) >= 20 and all(want.count(name) == 4 for name in set(want) - {None})
    assert [r.notices for r in got if r.doc_id == 900] == ["CC-BY-NC-4.0,MIT"] * 2 and [r.notices for r in got if r.doc_id is None] == ["MIT"]
    assert licenses.scan(df.limit(0)).collect() == []
    con = duckdb.connect()
    con.execute("create table planted (doc_id bigint, text varchar)")
    con.executemany("insert into planted values (?, ?)", [r[:2] for r in rows])
    key = lambda r: tuple(map(str, r))
    assert sorted(con.execute(licenses.scan_sql("planted")).fetchall(), key=key) == sorted(map(tuple, got), key=key)


def test_license_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    want = sorted(con.execute(ORACLE["op8_license_scan"]).fetchall())
    assert sorted(tuple(r) for r in QUERIES["op8_license_scan"](spark, SF).collect()) == want


# --- queries and pipeline ---


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_queries_keep_every_row(spark, name):
    out = QUERIES[name](spark, SF)
    n = {"op3": 50, "op10": 500}.get(name.split("_")[0], 200)
    assert out.count() == n or (name.startswith("op2") and out.select("doc_id").distinct().count() == n)


def test_pipeline(spark):
    import corpus_pipeline as cp

    assert [n for n, _ in cp.STAGES] == ["quality", "toxicity", "near_duplicates", "mixing", "packing"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    scratch = common.Scratch(spark)
    before = docs
    for name, stage in cp.STAGES[:-1]:
        after = scratch.keep(stage(spark, before, SF), name)
        assert after.columns == docs.columns and after.count() > 0
        if name != "mixing":
            assert after.count() <= before.count() and after.exceptAll(before).isEmpty()
        if name == "near_duplicates":
            rows = [tuple(r) for r in before.select("doc_id", "text").collect()]
            want = plain_components(rows, 5, 4, 5)
            assert sorted(r.doc_id for r in after.collect()) == sorted(d for d, (_, c) in want.items() if c == d)
        before = after
    out = cp.run(spark, SF).collect()
    rows = [tuple(r) for r in before.select("doc_id", "text", "lang", "source", "n_chars").collect()]
    check_bins(rows, out, 2048, 4)
