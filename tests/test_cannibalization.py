"""Rivals of a site without pairing the pages of a topic."""

import random
import re

from loomweb.functions.dims import STOPWORDS
from loomweb.operators import search
from loomweb.plans import registry

TABLES = (
    "site string, url string, concept string, strength string", "site string, url string, topic string",
    "site string, url string, p struct<title:string,h1:array<string>>", "site string, url string, intent string",
)


def _tables(seed=3, n=240):
    rng = random.Random(seed)
    word, intent = lambda: rng.choice("steel tube pipe copper best price welded seamless valve pump flange acme".split()), lambda: rng.choice(["commercial", "transactional", "transactional_ecommerce", "transactional_lead_gen", "mixed", "unspecified", "local"])
    some = lambda k: " ".join(word() for _ in range(rng.randrange(k)))
    p = [(f"s{i % 2}", f"/{i // 2:03}", (some(9), [some(5)] * rng.randrange(2))) for i in range(n)] + [("s0", "/000", ("acme steel tube", ["acme"]))]  # the last repeats a URL
    i = [(s, u, intent()) for s, u, _ in p[:n]]
    names = ["steel", "steel tube", "acme pump", "valve", "copper pipe", "x"]
    c = [(s, u, x, rng.choice(["DIRECT", "SUPPORTED", "WEAK"])) for s, u, _ in p for x in rng.sample(names, rng.randrange(4))]
    t = [(s, u, x) for s, u, _ in p[:n] for x in rng.sample(names, rng.randrange(3))]
    return c, t, p, i


def _plain(c, t, p, i, family):
    toks = lambda x: {w for w in re.findall(r"[a-z0-9]+(?:-[a-z0-9]+)?", (x or "").lower()) if len(w) >= 2 and w not in STOPWORDS}
    jac = lambda a, b: len(a & b) / len(a | b) if a and b else 0.0
    fold = lambda x: "transactional" if family and x.startswith("transactional") else x
    intent, bag, strong = {(s, u): x for s, u, x in i}, {}, []
    for s, u, x, _ in c:
        bag.setdefault((s, u), set()).add(x)
    for s, u, x in {(s, u, x) for s, u, x, _ in c} | set(t):
        found = [k for ss, uu, xx, k in c if (ss, uu, xx) == (s, u, x)] or ["SUPPORTED"]
        strong += [(s, u, x, k) for k in found if k != "WEAK"]
    full = [(s, u, x, k, toks(q[0]), toks(q[1][0] if q[1] else ""), intent[s, u]) for s, u, x, k in strong for ss, uu, q in p if (ss, uu) == (s, u)]
    out = []
    for sa, ua, xa, ka, ta, ha, ia in full:
        for sb, ub, xb, kb, tb, hb, ib in full:
            if (sa, xa) != (sb, xb) or ua >= ub:
                continue
            ts, hs, tt = jac(ta, tb), jac(ha, hb), toks(xa)
            alike = max(ts, hs) >= 0.35 or (len(tt) >= 2 and tt <= ta and tt <= tb and max(ts, hs) >= 0.2)
            same = fold(ia) == fold(ib) and ia != "unspecified"
            shared = sorted(bag.get((sa, ua), set()) & bag.get((sb, ub), set()))
            if alike and shared and (same or {fold(ia), fold(ib)} == {"commercial", "transactional"}):
                out.append((sa, xa, ua, ub, "DIRECT" if ka == kb == "DIRECT" else "SUPPORTED", ia if same else "commercial", round(ts, 3), round(hs, 3), shared[:8]))
    return out


def test_all_rivals_are_found(spark):
    tables = _tables()
    frames = [spark.createDataFrame(r, k) for r, k in zip(tables, TABLES, strict=True)]
    for family in (True, False):
        want = _plain(*tables, family)
        assert len(want) > 80 and any(max(r[6:8]) < 0.35 for r in want)
        assert sorted(str(tuple(r)) for r in search.cannibalization(*frames, family).collect()) == sorted(map(str, want))


def test_pages_of_a_hot_topic_are_not_paired(spark):
    """2,000 pages of one topic, intent and brand name with titles of their own, and three that are alike."""
    p = [("s", f"/{i:04}", (f"acme tools a{i} b{i} c{i} d{i} e{i}", [])) for i in range(2000)] + [("s", f"/x{i}", (f"acme tools red hammer green {i}0 {i}1", [])) for i in range(3)]
    one = spark.createDataFrame(p, TABLES[2]).selectExpr("url as id", "site as scope", "split(p.title, ' ') as w")
    assert search._meeting(one, 20).count() < 10
    both = [(s, u, "acme tools") for s, u, _ in p]
    c, t, i = [(*x, "DIRECT") for x in both], both, [(s, u, "local") for s, u, _ in p]
    got = search.cannibalization(*[spark.createDataFrame(r, k) for r, k in zip((c, t, p, i), TABLES, strict=True)])
    assert {(r.url_a, r.url_b) for r in got.collect()} >= {("/x0", "/x1"), ("/x0", "/x2"), ("/x1", "/x2")}


def test_terms_are_looked_for_on_pages_with_an_intent_alone(spark, monkeypatch):
    seen, whole = [], search.signals
    known = registry._search(spark, "/root/testdata/sf0.01")[4].where("intent <> 'unspecified'").count()
    monkeypatch.setattr(search, "signals", lambda p: seen.append(p.count()) or whole(p))
    registry.cannibalization(spark, "/root/testdata/sf0.01")
    assert seen == [known] and known < 250
