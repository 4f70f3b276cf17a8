"""python -m loomweb audit|compare|benchmark|gaps CRAWL [OUT]: tables of an archived crawl, written as Parquet and Markdown."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from .operators import cohort, scores
from .plans import api, reports
from .sources import crawl as source


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="loomweb", description=__doc__)
    p.add_argument("command", choices=("audit", "compare", "benchmark", "gaps"))
    p.add_argument("crawl", nargs="?", help="line-JSON or Parquet records, or a Parquet table of pages (page_id, url, html)")
    p.add_argument("out", nargs="?")
    p.add_argument("--pages", action="store_true", help="CRAWL is a table of pages")
    p.add_argument("--sites", nargs=2, metavar=("A", "B"))
    p.add_argument("--target")
    p.add_argument("--fail-on", nargs="*", default=None, help="classes of remediations that make the exit code 1")
    p.add_argument("--max-findings", type=int, default=10**9)
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("loomweb").getOrCreate()
    if a.command == "gaps":
        cohort.gap_breakdown(cohort.capability_gaps(spark)).show(50, False)
        return 0
    records = source.from_pages(spark.read.parquet(a.crawl)) if a.pages else source.read_crawl(spark, a.crawl)
    tables = api.audit(records)
    if a.command == "compare":
        api.compare_sites(tables, *a.sites).show(50, False)
        return 0
    if a.command == "benchmark":
        tables = api.benchmark(tables, a.target)
    if a.out:
        for name, df in tables.items():
            (reports.write_markdown if name == "report" else reports.write_parquet)(df, f"{a.out}/{name}")
    else:
        print(reports.scorecard(tables["health"] if "health" in tables else next(iter(tables.values()))))
    if a.fail_on is not None and a.command == "audit":
        return reports.exit_code(scores.ci_policy(tables["remediations"], a.max_findings, tuple(a.fail_on)))
    return 0


if __name__ == "__main__":
    sys.exit(main())
