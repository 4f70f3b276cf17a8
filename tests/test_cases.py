"""Some of the queries over written tables give the rows that their SQL gives; the rest takes the driver's check."""

import duckdb
import pytest

from loomweb.plans import cases
from loomweb.plans.registry import ORACLE, QUERIES

FAST = ["url_algebra", "frontier", "snippet_controls", "fingerprints", "title_alignment", "robots_decisions", "text_scalars", "health", "cohort_voids", "conflict_rules", "no_conflicts", "gap_actions"]


def test_every_case_has_rows():
    names = [n for n in QUERIES if n.startswith("case_")]
    assert len(names) > 100 and all(duckdb.sql(ORACLE[n]).fetchall() for n in names) and cases.B


@pytest.mark.parametrize("name", FAST)
def test_case(spark, name):
    got = QUERIES[f"case_{name}"](spark, "")
    want = duckdb.sql(ORACLE[f"case_{name}"])
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want.fetchall(), key=str)
