"""Gaps between pages of a topic, without a row for each pair."""

from collections import defaultdict

from loomweb.operators import search
from loomweb.plans import registry


def test_gap_classes_hold_all_pairs(spark):
    import random

    rng = random.Random(4)
    pages = [("a", f"/{i:02}", {rng.choice("abcdefgh") for _ in range(rng.randrange(1, 8))}, rng.randrange(5), rng.randrange(1, 700)) for i in range(60)]
    pages += [("b", f"/{i:02}", *x[2:]) for i, x in enumerate(pages[:9])]
    c = spark.createDataFrame([(s, u, x) for s, u, bag, _, _ in pages for x in bag], "site string, url string, concept string")
    t = spark.createDataFrame([("a", "/00", "z"), ("a", "/01", "z"), ("a", "/02", "z"), ("a", "/03", "a")], "site string, url string, topic string")
    p = spark.createDataFrame([(s, u, ([(2, f"h{i}") for i in range(h)], "w " * n)) for s, u, _, h, n in pages], "site string, url string, p struct<headings:array<struct<level:int,text:string>>,main_text:string>")
    rows = search.gap_classes(c, t, p).collect()
    of, bag = defaultdict(list), defaultdict(set)
    for r in rows:
        of[r.site, r.topic].append(r)
        bag[r.site, r.url] |= {r.topic} if r.is_concept else set()
    gaps, depth = set(), set()
    for (s, topic), all_ in of.items():
        for a in all_:
            lacks = [b for b in all_ if b.offers and b.class_id != a.class_id and b.class_id not in a.without]
            deep = [b for b in all_ if a.depth_words is not None and b.h2 >= 3 and b.words >= a.depth_words]
            assert a.gaps == len(lacks) and a.depth_gaps == len(deep)
            gaps |= {(s, topic, a.url, b.url, tuple(sorted(bag[s, b.url] - bag[s, a.url] - {topic}))) for b in lacks}
            depth |= {(s, topic, a.url, b.url) for b in deep}
    want = {(r.site, r.topic, r.source_url, r.related_url, tuple(r.missing)) for r in search.topic_gaps(c, t).collect()}
    assert gaps == want and len(want) > 1000
    assert depth == {(r.site, r.topic, r.source_url, r.related_url) for r in search.depth_gaps(c, t, p).collect()} and depth


def test_the_query_gives_one_row_for_each_page_of_a_topic(spark, monkeypatch):
    rows = registry.topic_gaps(spark, "/root/testdata/sf0.001").collect()
    assert rows and len({(r.site, r.topic, r.url) for r in rows}) == len(rows)
    monkeypatch.setattr(registry, "PART", 20)
    assert sorted(map(str, registry.topic_gaps(spark, "/root/testdata/sf0.001").collect())) == sorted(map(str, rows))
