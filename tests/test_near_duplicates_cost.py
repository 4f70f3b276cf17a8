"""What the search for near duplicates does once, in parts, or not at all."""

from collections import Counter

import pandas as pd
from pyspark.sql import functions as F

from loomweb.functions import text
from loomweb.operators import content
from loomweb.plans import registry


def test_only_texts_with_a_partner_get_fingerprints(spark, tmp_path, monkeypatch):
    real = text.simhash_one

    def simhash(column):
        def run(texts: pd.Series) -> pd.Series:
            assert not texts.str.contains("lonely").any()
            return texts.map(real)

        return F.pandas_udf(run, "string")(column)

    base = [f"w{i}" for i in range(60)]
    rows = [(0, " ".join(base), "s"), (1, " ".join(base[:58]), "s"), (2, " ".join(base), "s"), (3, "lonely " * 5, "s"), (4, "a lonely text of its own words", "s"), (5, " ".join(base), "other"), (6, None, "s"), (7, "?!", "s")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(text, "simhash", simhash)
    assert {(r.doc_a, r.doc_b) for r in registry.near_duplicate_pairs(spark, str(tmp_path)).collect()} == {(0, 1), (1, 2)}


def test_repeated_url_keeps_its_texts_apart(spark):
    """Two texts of one URL: each is compared as what it is."""
    words = [f"w{i}" for i in range(50)]
    rows = [("s", "/a", " ".join(words)), ("s", "/a", "x y z " * 5 + "q"), ("s", "/b", " ".join(words[:48])), ("s", "/c", "x y z " * 5)]
    c = spark.createDataFrame(rows, "site string, url string, main_text string")
    c = c.withColumn("words", text.word_count(F.col("main_text"))).withColumn("content_hash", text.content_hash(F.col("main_text"))).withColumn("simhash", text.simhash(F.col("main_text")))
    got = {(r.url_a, r.url_b, r.similarity) for r in content.near_duplicates(c).collect()}
    assert ("/a", "/b", 95.8) in got


def test_parts_hold_all_repeated_shingles(spark):
    rows = [(i, [(i * j * 2 + j % 2) for j in range(1, 40)]) for i in range(12)]
    lists = spark.createDataFrame(rows, "id long, tokens array<long>")
    want = Counter(t for _, ts in rows for t in ts)
    got = [(r.t, r.id, r.df) for i in range(content.PARTS) for r in content._repeated(lists, i).collect()]
    assert sorted(got) == sorted((t, i, want[t]) for i, ts in rows for t in ts if want[t] > 1)
