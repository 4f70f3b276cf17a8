import hashlib
import re

import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomweb.functions import text, urls

CASES = [
    ("https://A.Example:443/x/?utm_source=a&b=2&a=1#f", None, "https://a.example/x?a=1&b=2", "https://a.example/x?a=1&b=2&utm_source=a"),
    ("http://a.example:80//x//y/", None, "http://a.example/x/y", "http://a.example//x//y"),
    ("/p?id=10", "https://a.example/q/", "https://a.example/p?id=10", "https://a.example/p?id=10"),
    ("https://a.example", None, "https://a.example/", "https://a.example/"),
    ("mailto:x@a.example", None, "mailto:x@a.example", "mailto:x@a.example"),
    ("../z", "https://a.example/b/c/d", "https://a.example/b/z", "https://a.example/b/z"),
    ("https://a.example/?gclid=1", None, "https://a.example/", "https://a.example/?gclid=1"),
]


def test_url_algebra(spark):
    df = spark.createDataFrame([(u, b) for u, b, _, _ in CASES], "u string, b string")
    got = df.select(urls.normalise(F.col("u"), F.col("b")), urls.identity(F.col("u"), F.col("b"))).collect()
    assert [tuple(r) for r in got] == [(n, i) for _, _, n, i in CASES]


def test_expression_form_agrees(spark):
    some = [u for u, b, _, _ in CASES if u.startswith("http") and not b] + ["https://a.example/A/b/?z=1&c=2&fbclid=9", "http://a.example/x?"]
    df = spark.createDataFrame([(u,) for u in some], "u string")
    for a, b in df.select(urls.normalise(F.col("u")), urls.normalise_expr(F.col("u"))).collect():
        assert a == b


def test_predicates(spark):
    rows = [("/rel", True, True, "INTERNAL"), ("https://a.example/x.pdf", True, False, "INTERNAL"), ("https://b.a.example/", False, True, "EXTERNAL"), ("tel:1", True, False, "SPECIAL"), ("#x", True, True, "SPECIAL"), ("https://other.example/", False, True, "EXTERNAL"), ("//a.example/z", True, True, "INTERNAL")]
    df = spark.createDataFrame([(r[0],) for r in rows], "u string")
    base = F.lit("https://a.example/")
    got = df.select(urls.crawlable(F.col("u")), urls.link_class(F.col("u"), base), urls.link_class(F.col("u"), base, True)).collect()
    assert [g[0] for g in got] == [r[2] for r in rows] and [g[1] for g in got] == [r[3] for r in rows]
    assert got[2][2] == "INTERNAL"


def test_hygiene_key():
    assert urls.hygiene_one("http://www.A.example:80//X/Y/?utm_term=1&b=2") == urls.hygiene_one("https://a.example/x/y?b=2")


@settings(max_examples=60, deadline=None)
@given(st.from_regex(r"https?://[a-z]{1,5}\.example(/[a-z]{0,4}){0,3}(\?[a-z]=[a-z0-9]{0,3}(&[a-z]=[0-9]{0,2}){0,2})?", fullmatch=True))
def test_normalising_twice_changes_nothing(u):
    for f in (urls.normalise_one, urls.identity_one, urls.node_one):
        assert f(f(u)) == f(u)


def plain_simhash(t):
    w = regex.sub(r"[^\w\s]", "", t.lower()).split()
    toks = w + [" ".join(w[i : i + 2]) for i in range(len(w) - 1)]
    v = [0] * 64
    for k in toks:
        h = int(hashlib.md5(k.encode()).hexdigest()[:16], 16)
        for i in range(64):
            v[i] += 1 if h >> i & 1 else -1
    return f"{sum(1 << i for i in range(64) if v[i] > 0):016x}" if w else "0" * 16


@settings(max_examples=50, deadline=None)
@given(st.text(alphabet="ab cdé-.", max_size=60))
def test_simhash(t):
    assert text.simhash_one(t) == plain_simhash(t)


def plain_jaccard(a, b, k=3):
    wa, wb = (regex.sub(r"[^\w\s]", "", x.lower()).split() for x in (a, b))
    if not wa or not wb:
        return 0.0
    if len(wa) < k or len(wb) < k:
        sa, sb = set(wa), set(wb)
    else:
        sa, sb = ({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} for w in (wa, wb))
    return round(len(sa & sb) / len(sa | sb), 4)


def test_shingle_jaccard(spark):
    pairs = [("a b c d", "a b c e"), ("a b", "b a"), ("", "a"), ("A, b! c d", "a b c d"), ("x", "x"), ("a b c", "a b")]
    df = spark.createDataFrame(pairs, "a string, b string")
    got = [r[0] for r in df.select(text.shingle_jaccard(F.col("a"), F.col("b"))).collect()]
    assert got == [plain_jaccard(*p) for p in pairs]
    back = [r[0] for r in df.select(text.shingle_jaccard(F.col("b"), F.col("a"))).collect()]
    assert back == got


def test_hamming(spark):
    df = spark.createDataFrame([("0" * 16, "f" * 16), ("8000000000000001", "0000000000000001"), ("zz", "0" * 16)], "a string, b string")
    assert [r[0] for r in df.select(text.hamming(F.col("a"), F.col("b"))).collect()] == [64, 1, 64]


def test_scalars(spark):
    one = spark.range(1)
    get = lambda c: one.select(c).first()[0]
    assert get(text.term(F.lit("  Foo_Bar! "))) == "foo bar"
    assert get(text.tokens(F.lit("The state-of the art, AI a I 5g"))) == ["state-of", "art", "ai", "5g"]
    assert get(text.word_bounded(F.lit("iso"), F.lit("iso 9001"))) and not get(text.word_bounded(F.lit("is"), F.lit("iso 9001"))) and not get(text.word_bounded(F.lit("a"), F.lit("a")))
    assert get(text.snippet(F.lit("aa bb cc dd"), 7)) == "aa bb..." and get(text.hard_snippet(F.lit("abcdefghij"), 8)) == "abcde..."
    assert get(text.generic_anchor(F.lit("[ARIA: Read More!]"))) and not get(text.generic_anchor(F.lit("Pricing")))
    assert get(text.stripped(F.lit("É-a!  b"))) == "éa b" == re.sub(r"\s+", " ", regex.sub(r"[^\w\s]", "", "É-a!  b".lower())).strip()


@pytest.mark.parametrize("n", [0, 1, 2, 5])
def test_shingles(spark, n):
    w = [f"w{i}" for i in range(n)]
    df = spark.createDataFrame([(w,)], "w array<string>")
    assert df.select(text.shingles(F.col("w"), 3)).first()[0] == [" ".join(w[i : i + 3]) for i in range(max(0, n - 2))]
