"""Loops over long chains of pages end whole, or with an error."""

import pytest

from loomweb.operators import graph


def chain(spark, n):
    """'/' -> post/(n-1) -> ... -> post/001: ids fall along the links."""
    ids = ["/"] + [f"post/{i:04d}" for i in range(n - 1, 0, -1)]
    nodes = spark.createDataFrame([("s", x, x == "/") for x in ids] + [("s", "zz", False), ("t", "/", True)], "site string, id string, is_root boolean")
    return nodes, spark.createDataFrame([("s", a, b, 1) for a, b in zip(ids, ids[1:], strict=False)], "site string, src string, dst string, weight long")


def test_weak_components_of_a_chain(spark):
    nodes, edges = chain(spark, 300)
    got = {(r.site, r.id): r.component for r in graph.weak_components(nodes, edges, 20).collect()}
    assert len(got) == 302 and got["s", "zz"] == "zz" and got["t", "/"] == "/"
    assert {c for (s, i), c in got.items() if s == "s" and i != "zz"} == {"/"}


def test_too_few_rounds_are_an_error(spark):
    nodes, edges = chain(spark, 8)
    for f in (graph.click_depth, graph.strong_components, graph.weak_components):
        with pytest.raises(RuntimeError):
            f(nodes, edges, 1).collect()
    assert max(r.click_depth for r in graph.click_depth(nodes, edges).collect()) == 7
