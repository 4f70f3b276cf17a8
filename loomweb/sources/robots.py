"""robots.txt as tables: groups, rules, and what they say to each crawler about each path."""

from __future__ import annotations


import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RULES = "array<struct<grp:int, agents:array<string>, directive:string, pattern:string, line:int>>"


def parse_rules(content: str | None) -> list[dict]:
    """The rules of a robots.txt: agents before a rule share the group; a group without rules has one with no directive."""
    out, agents, count, group = [], [], 0, 0
    for number, raw in enumerate((content or "").splitlines(), 1):
        field, colon, value = raw.split("#", 1)[0].strip().partition(":")
        field, value = field.strip().lower(), value.strip()
        if not colon:
            continue
        if field == "user-agent":
            if count:
                agents, count, group = [], 0, group + 1
            agents.append(value.lower())
        elif field in ("allow", "disallow") and agents:
            count += 1
            out.append({"grp": group, "agents": None, "directive": field, "pattern": value, "line": number})
        if agents:
            for r in out:
                if r["grp"] == group:
                    r["agents"] = list(agents)
    if agents and not count:
        out.append({"grp": group, "agents": list(agents), "directive": None, "pattern": None, "line": None})
    return out


def sitemaps_of(robots: DataFrame) -> DataFrame:
    """site, sitemap: the Sitemap lines of each robots.txt; the two usual places where there are none."""
    lines = robots.where("status_code = 200").select("site", F.explode(F.split("content", r"\r?\n")).alias("line"))
    found = lines.select("site", F.regexp_extract("line", r"(?i)^\s*sitemap\s*:\s*(\S+)", 1).alias("sitemap")).where("sitemap <> ''").distinct()
    usual = robots.select("site").distinct().join(found, "site", "left_anti").select("site", F.explode(F.array(*[F.concat(F.lit("https://"), "site", F.lit(p)) for p in ("/sitemap.xml", "/sitemap_index.xml")])).alias("sitemap"))
    return found.union(usual)


def rules(robots: DataFrame) -> DataFrame:
    """site, grp, agents, directive, pattern, line of robots (site, status_code, content); other answers than 200 have none."""

    def run(texts: pd.Series) -> pd.Series:
        return texts.map(parse_rules)

    r = robots.where("status_code = 200 and content is not null").withColumn("r", F.pandas_udf(run, RULES)("content"))
    return r.select("site", F.explode("r").alias("r")).select("site", "r.*")


def to_regex(pattern):
    """A rule's pattern as a regular expression: * stands for anything, a final $ for the end."""
    body = F.regexp_replace(pattern, r"\$$", "")
    quoted = F.concat(F.lit("\\Q"), F.replace(F.replace(body, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("*"), F.lit("\\E.*\\Q")), F.lit("\\E"))
    return F.concat(F.lit("(?s)^"), quoted, F.when(F.endswith(pattern, F.lit("$")), "$").otherwise(""))


def bot_matrix(robots: DataFrame, paths: DataFrame, bots: DataFrame) -> DataFrame:
    """site, path, agent, status, rule_source, matched, line: the verdict for each crawler (agent) on each path (site, path).

    The group that names the agent most closely holds: its own name, else a name that is part of it, else *. Of its
    rules that match the longest wins, Allow before Disallow; an empty Disallow allows all; without a match, allowed.
    """
    g = rules(robots)
    agents = g.select("site", "grp", F.explode("agents").alias("a")).distinct().crossJoin(F.broadcast(bots.select("agent")))  # registry: some dozens
    name = F.lower("agent")
    score = F.when(F.col("a") == name, 1000 + F.length("a")).when(F.col("a") == "*", 1).when((F.length("a") > 0) & (F.contains(name, F.col("a")) | F.contains(F.col("a"), name)), 100 + F.length("a"))
    best = agents.withColumn("score", score).where("score is not null").groupBy("site", "agent").agg(F.max(F.struct("score", (-F.col("grp")).alias("g"))).alias("m"))
    best = best.select("site", "agent", (-F.col("m.g")).alias("grp"), F.when(F.col("m.score") > 10, "explicit").otherwise("wildcard").alias("rule_source"))
    targets = paths.select("site", "path").distinct().crossJoin(F.broadcast(bots.select("agent")))
    t = targets.join(best, ["site", "agent"], "left").join(g.where("directive is not null").select("site", "grp", "directive", "pattern", "line"), ["site", "grp"], "left")
    free = (F.col("directive") == "disallow") & (F.col("pattern") == "")
    hit = free | ((F.col("pattern") != "") & F.expr("rlike(path, _re)"))
    t = t.withColumn("_re", to_regex(F.col("pattern"))).withColumn("hit", F.coalesce(hit, F.lit(False)))
    allow = free | (F.col("directive") == "allow")
    length = F.when(free, 1).otherwise(F.length("pattern"))
    order = Window.partitionBy("site", "path", "agent").orderBy(F.desc("hit"), F.desc(F.when(F.col("hit"), length)), F.desc(allow), "line")
    t = t.withColumn("k", F.row_number().over(order)).where("k = 1")
    said = F.when(F.col("hit"), F.when(free, "Allow: /").otherwise(F.concat(F.initcap("directive"), F.lit(": "), "pattern")))
    return t.select("site", "path", "agent", F.when(F.col("hit") & ~allow, "DISALLOWED").otherwise("ALLOWED").alias("status"), F.coalesce("rule_source", F.lit("default_allow")).alias("rule_source"), said.alias("matched"), F.when(F.col("hit"), F.col("line")).alias("line"))


def bot_recommendations(matrix: DataFrame, bots: DataFrame) -> DataFrame:
    """site, agent, priority, recommendation for crawlers whose verdict is at odds with their use."""
    m = matrix.join(F.broadcast(bots), "agent")
    say = F.when((F.col("status") == "DISALLOWED") & F.col("category").isin("search_engine", "ai_search"), "Allow it: pages it may not read are not found through it.").when((F.col("status") == "ALLOWED") & (F.col("category") == "ai_training"), "Training crawlers may be kept out without loss in search.")
    return m.select("site", "path", "agent", "priority", say.alias("recommendation")).where("recommendation is not null")


def allowed_pages(crawl: DataFrame, robots: DataFrame, agent: str = "*") -> DataFrame:
    """site, url, allowed of every record, for one crawler; all are where there is no robots.txt."""
    spark = crawl.sparkSession
    pages = crawl.select("site", "url", F.regexp_replace("url", "^[A-Za-z]+://[^/?#]*", "").alias("path")).withColumn("path", F.when(F.col("path") == "", "/").otherwise(F.regexp_replace("path", "#.*$", "")))
    m = bot_matrix(robots, pages, spark.createDataFrame([(agent,)], "agent string"))
    return pages.join(m.select("site", "path", (F.col("status") == "ALLOWED").alias("allowed")), ["site", "path"], "left").select("site", "url", F.coalesce("allowed", F.lit(True)).alias("allowed"))


def llms_txt(texts: DataFrame) -> DataFrame:
    """site, has_h1, has_summary, links, words, valid of llms.txt files (site, content)."""
    c = F.coalesce("content", F.lit(""))
    out = texts.select("site", c.rlike(r"(?m)^#\s+\S").alias("has_h1"), c.rlike(r"(?m)^>\s*\S").alias("has_summary"), F.regexp_count(c, F.lit(r"\[[^\]]+\]\([^)]+\)")).alias("links"), F.regexp_count(c, F.lit(r"\S+")).alias("words"))
    return out.withColumn("valid", F.col("has_h1") & F.col("has_summary") & (F.col("links") > 0) & (F.col("words") >= 30))


