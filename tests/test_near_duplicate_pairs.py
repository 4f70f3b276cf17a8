"""Results that limits once cut."""

import math
import random

from loomweb.functions import text
from loomweb.operators import content
from loomweb.plans import registry


def test_near_duplicate_pairs_of_both_branches(spark, tmp_path):
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(3000)}"
    rows = []
    for n, more in ((2000, 100), (2000, 20), (1200, 60), (400, 35), (90, 4), (300, 200)):
        base = [word() for _ in range(n)]
        at = rng.randrange(n)
        rows += [base, base[:at] + [word() for _ in range(more)] + base[at:]]
    rows += [rows[8], rows[9], rows[8]]  # copies: each has the partners of the others, and none of them
    rows = [(i, " ".join(w), "s", "en") for i, w in enumerate(rows)]
    rows.append((len(rows), rows[8][1].upper() + " !", "s", "en"))  # an equal hash, another number of words
    rows.append((len(rows), rows[8][1], "other", "en"))  # another site
    spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    finger = [text.simhash_one(t) for _, t, _, _ in rows]
    norm = [t.lower().replace("!", "").split() for _, t, _, _ in rows]
    grams = [{tuple(t[k : k + 3]) for k in range(len(t) - 2)} for t in norm]
    want, long = set(), 0
    for a in range(len(rows)):
        for b in range(a + 1, len(rows)):
            bits = bin(int(finger[a], 16) ^ int(finger[b], 16)).count("1")
            dn = abs(len(rows[a][1].split()) - len(rows[b][1].split()))
            j = round(len(grams[a] & grams[b]) / len(grams[a] | grams[b]), 4)
            if rows[a][2] != rows[b][2] or norm[a] == norm[b]:
                continue
            if j >= 0.8 and (bits <= 12 or dn <= 30):
                want.add(tuple(sorted((a, b), key=str)))
                long += dn > 30
    assert long >= 2 and len(want) >= 10
    got = registry.near_duplicate_pairs(spark, str(tmp_path))
    assert {(r.doc_a, r.doc_b) for r in got.collect()} == want
    assert got.columns == ["site", "doc_a", "doc_b", "similarity"]


def test_lists_hold_enough_of_every_text(spark):
    rng = random.Random(2)
    rows = [(i, "s", [f"w{rng.randrange(9999)}" for _ in range(n)]) for i, n in enumerate([1, 2, 3, 5, 9, 30, 31, 60, 200, 400] * 3)]
    c = spark.createDataFrame(rows, "id long, site string, w array<string>")
    for full in (1, 20, 128):
        for r in content._lists(c, 0.79995, 3, full).collect():
            p = r.n - math.ceil(r.n * 0.79995) + 1
            assert r.l0 + r.l1 == len(r.tokens) and (r.l1 in (0, r.n)) and (r.l1 == r.n or r.l0 >= p)
            assert len(set(r.tokens)) == len(r.tokens) and sum(t % 2 == 0 for t in r.tokens) == r.l0
