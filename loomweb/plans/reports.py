"""Sinks: JSON and Parquet of whole tables, and Markdown from a small summary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_parquet(df: DataFrame, path: str, by: str | None = None) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(by) if by else writer).parquet(path)


def markdown_lines(scores: DataFrame, findings: DataFrame | None = None, actions: DataFrame | None = None) -> DataFrame:
    """site, pos, line: a Markdown report for each site, as rows, so that any number of sites can be written."""
    metrics = [c for c, t in scores.dtypes if c not in ("site", "url") and t in ("int", "bigint", "double", "string")]
    parts = [F.struct(F.lit(0).alias("pos"), F.concat(F.lit("# "), "site").alias("line")), *[F.struct(F.lit(i).alias("pos"), F.lit(t).alias("line")) for i, t in ((1, ""), (2, "| Measure | Value |"), (3, "|---|---|"))]]
    parts += [F.struct(F.lit(4 + i).alias("pos"), F.concat(F.lit(f"| {m} | "), F.coalesce(F.col(m).cast("string"), F.lit("unavailable")), F.lit(" |")).alias("line")) for i, m in enumerate(metrics)]
    out = scores.select("site", F.explode(F.array(*parts)).alias("x")).select("site", "x.pos", "x.line")
    at = 4 + len(metrics)
    for title, df, line in (("Findings", findings, lambda: F.concat(F.lit("- "), "severity", F.lit(" "), "code", F.lit(": "), F.col("pages").cast("string"), F.lit(" pages"))), ("Actions", actions, lambda: F.concat(F.lit("- ("), F.col("priority").cast("string"), F.lit(") "), "action"))):
        if df is None:
            continue
        out = out.union(df.select("site").distinct().select("site", F.lit(at), F.lit(f"\n## {title}\n"))).union(df.select("site", F.lit(at + 1), line()).distinct())
        at += 2
    return out


def write_markdown(lines: DataFrame, path: str) -> None:
    """A text file for each site, partitioned by site."""
    text = lines.groupBy("site").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n").alias("value"))
    text.write.mode("overwrite").partitionBy("site").text(path)


def scorecard(scores: DataFrame, most: int = 20) -> str:
    """A terminal table of the first sites."""
    rows = scores.orderBy("site").limit(most).collect()
    names = scores.columns
    return "\n".join("  ".join(str(r[n]) for n in names) for r in [dict(zip(names, names, strict=True)), *[r.asDict() for r in rows]])


def exit_code(policy: DataFrame) -> int:
    """1 if a site fails its policy."""
    return int(not policy.where("not passed").isEmpty())


def read_reports(spark, path: str, schema: str) -> DataFrame:
    """Reports of a file or folder of JSON, one object a file."""
    return spark.read.schema(schema).option("multiLine", True).json(path)
