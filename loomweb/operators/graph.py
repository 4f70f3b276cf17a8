"""The internal link graph of each site: edges, click depth, rank, components. All tables carry the site as a key."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import urls
from ..plans.shared import settle


def edges_of(links: DataFrame) -> DataFrame:
    """site, src, dst, weight: internal links by their number; links of a page to itself stay."""
    inner = links.where("link_class = 'INTERNAL'")
    return inner.groupBy("site", urls.node(F.col("source_url")).alias("src"), F.col("target_identity_url").alias("dst")).agg(F.count("*").alias("weight"))


def nodes_of(crawl: DataFrame, edges: DataFrame) -> DataFrame:
    """site, id, crawl_state, status_code, is_root: crawled pages, then what only links name; the root has the least depth."""
    c = crawl.select("site", urls.node(F.col("url")).alias("id"), "status_code", "depth", "url")
    c = c.groupBy("site", "id").agg(F.max("status_code").alias("status_code"), F.min(F.struct("depth", "url")).alias("first"))
    named = edges.select("site", F.col("dst").alias("id")).distinct().join(c.select("site", "id"), ["site", "id"], "left_anti")
    roots = c.groupBy("site").agg(F.min(F.struct("first", "id")).alias("m")).select("site", F.col("m.id").alias("id"), F.lit(True).alias("is_root"))
    every = c.select("site", "id", F.lit("CRAWLED").alias("crawl_state"), "status_code").union(named.select("site", "id", F.lit("DISCOVERED_UNCRAWLED"), F.lit(None).cast("int")))
    return every.join(roots, ["site", "id"], "left").withColumn("is_root", F.coalesce("is_root", F.lit(False)))


def _rounds(what: str, most: int | None) -> Iterator[int]:
    """1, 2, ... for loops that break when they are done; an error beyond `most`."""
    yield from range(1, most + 1) if most else itertools.count(1)
    raise RuntimeError(f"{what}: not done after {most} rounds")


def _with(seen: DataFrame, more: DataFrame) -> DataFrame:
    """The union, settled, in no more partitions than a shuffle has: rounds don't add to them."""
    return settle(seen.union(more).coalesce(int(seen.sparkSession.conf.get("spark.sql.shuffle.partitions"))))


def click_depth(nodes: DataFrame, edges: DataFrame, most: int | None = None) -> DataFrame:
    """site, id, click_depth of the nodes that the root reaches, breadth first. A round finds a page at least, so the
    loop ends by itself; more than `most` rounds are an error."""
    e = settle(edges.where("src <> dst").select("site", "src", "dst").distinct())
    seen = settle(nodes.where("is_root").select("site", "id", F.lit(0).alias("click_depth")))
    front = seen
    for step in _rounds("click_depth", most):
        nxt = front.select("site", F.col("id").alias("src")).join(e, ["site", "src"]).select("site", F.col("dst").alias("id")).distinct()
        front = settle(nxt.join(seen, ["site", "id"], "left_anti").withColumn("click_depth", F.lit(step)))
        if front.isEmpty():
            break
        seen = _with(seen, front)
    return seen


def page_rank(nodes: DataFrame, edges: DataFrame, damping: float = 0.85, rounds: int = 100, tolerance: float = 1e-6) -> DataFrame:
    """site, id, equity: power iteration over weighted links without loops, the rank of pages without links out spread
    evenly; a site that doesn't settle gets even ranks; to 6 places."""
    e = edges.where("src <> dst")
    out = e.groupBy("site", "src").agg(F.sum("weight").alias("total"))
    e = settle(e.join(out, ["site", "src"]).select("site", "src", "dst", (F.col("weight") / F.col("total")).alias("share")))
    size = nodes.groupBy("site").agg(F.count("*").alias("n"))
    base = settle(nodes.select("site", "id").join(size, "site").join(out.select("site", F.col("src").alias("id"), F.lit(True).alias("gives")), ["site", "id"], "left").withColumn("gives", F.coalesce("gives", F.lit(False))))
    rank = settle(base.select("site", "id", "n", "gives", (1 / F.col("n")).alias("r")))
    calm = None
    for _ in range(rounds):
        lost = rank.groupBy("site").agg(F.sum(F.when(~F.col("gives"), F.col("r")).otherwise(0.0)).alias("lost"))
        got = e.join(rank.select("site", F.col("id").alias("src"), "r"), ["site", "src"]).groupBy("site", F.col("dst").alias("id")).agg(F.sum(F.col("r") * F.col("share")).alias("got"))
        new = rank.join(got, ["site", "id"], "left").join(lost, "site")
        new = new.withColumn("x", F.lit(damping) * (F.coalesce("got", F.lit(0.0)) + F.col("lost") / F.col("n")) + (1 - damping) / F.col("n"))
        new = settle(new.select("site", "id", "n", "gives", "x", F.abs(F.col("x") - F.col("r")).alias("d")))
        calm = new.groupBy("site").agg((F.sum("d") < F.first("n") * tolerance).alias("calm"))
        rank = new.withColumnRenamed("x", "r").drop("d")
        if calm.where("not calm").isEmpty():
            break
    r = rank.join(calm, "site") if calm is not None else rank.withColumn("calm", F.lit(True))
    return r.select("site", "id", F.round(F.when(F.col("n") == 1, 1.0).when(F.col("calm"), F.col("r")).otherwise(1 / F.col("n")), 6).alias("equity"))


def percentiles(ranks: DataFrame) -> DataFrame:
    """With equity_percentile: the place by equity (ties by id) over the last place, in percent to one place."""
    w = Window.partitionBy("site")
    n = F.count("*").over(w)
    place = F.row_number().over(w.orderBy("equity", "id")) - 1
    return ranks.withColumn("equity_percentile", F.when(n <= 1, 100.0).otherwise(F.round(100.0 * place / (n - 1), 1)))


def weak_components(nodes: DataFrame, edges: DataFrame, most: int = 200) -> DataFrame:
    """site, id, component: the least id that is reached when links count both ways.

    Large-star and small-star steps until the edges don't change: rounds grow with the logarithm of a component's size,
    however its ids run. More than `most` rounds are an error."""
    ends = lambda e: e.where("u <> v").distinct()
    state = lambda e: tuple(e.agg(F.count("*"), F.sum(F.xxhash64("site", "u", "v").cast("decimal(38,0)"))).first())
    cur = settle(ends(edges.select("site", F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v"))))
    before = state(cur)
    for _ in _rounds("weak_components", most):
        both = cur.union(cur.select("site", "v", "u"))
        low = both.groupBy("site", "u").agg(F.min("v").alias("m")).select("site", "u", F.least("u", "m").alias("m"))
        large = settle(ends(both.where("v > u").join(low, ["site", "u"]).select("site", F.col("v").alias("u"), F.col("m").alias("v"))))
        low = large.groupBy("site", "u").agg(F.min("v").alias("m"))
        small = large.join(low, ["site", "u"]).select("site", F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
        cur = settle(ends(small.select("site", "e.u", "e.v")))
        before, old = state(cur), before
        if before == old:
            break
    found = cur.select("site", F.col("u").alias("id"), F.col("v").alias("component"))
    return nodes.select("site", "id").join(found, ["site", "id"], "left").select("site", "id", F.coalesce("component", "id").alias("component"))


def strong_components(nodes: DataFrame, edges: DataFrame, most: int | None = None) -> DataFrame:
    """site, id, component: pages that reach one another. Colours spread forwards by the greatest id; what a colour's
    owner reaches backwards within its colour is a component, and the rest goes on. Every loop ends by itself; more than
    `most` rounds of one are an error."""
    left = settle(nodes.select("site", "id").where("site is not null and id is not null"))
    done = None
    e = settle(edges.where("src <> dst").select("site", "src", "dst").distinct())
    for _ in _rounds("strong_components", most):
        if left.isEmpty():
            break
        e = settle(e.join(left.select("site", F.col("id").alias("src")), ["site", "src"], "left_semi").join(left.select("site", F.col("id").alias("dst")), ["site", "dst"], "left_semi").select("site", "src", "dst"))
        colour = left.withColumn("c", F.col("id"))
        for _ in _rounds("strong_components", most):
            got = e.join(colour.select("site", F.col("id").alias("src"), "c"), ["site", "src"]).groupBy("site", F.col("dst").alias("id")).agg(F.max("c").alias("m"))
            new = settle(colour.join(got, ["site", "id"], "left").select("site", "id", F.col("c").alias("old"), F.greatest("c", "m").alias("c")))
            colour = new.drop("old")
            if new.where("old <> c").isEmpty():
                break
        same = e.join(colour.select("site", F.col("id").alias("src"), F.col("c").alias("cs")), ["site", "src"]).join(colour.select("site", F.col("id").alias("dst"), F.col("c").alias("cd")), ["site", "dst"]).where("cs = cd").select("site", "src", "dst")
        same = settle(same)
        found = front = settle(colour.where("id = c"))
        for _ in _rounds("strong_components", most):
            back = same.join(front.select("site", F.col("id").alias("dst"), "c"), ["site", "dst"]).select("site", F.col("src").alias("id"), "c").distinct()
            front = settle(back.join(found.select("site", "id"), ["site", "id"], "left_anti"))
            if front.isEmpty():
                break
            found = _with(found, front.select("site", "id", "c"))
        part = found.select("site", "id", F.col("c").alias("component"))
        done = part if done is None else _with(done, part)
        left = settle(left.join(found.select("site", "id"), ["site", "id"], "left_anti"))
    return done if done is not None else nodes.select("site", "id", F.col("id").alias("component")).limit(0)


def degrees(nodes: DataFrame, edges: DataFrame, external: DataFrame | None = None) -> DataFrame:
    """nodes with distinct and total links in and out, links to themselves, orphan status and dead ends."""
    e = edges.where("src <> dst")
    inn = e.groupBy("site", F.col("dst").alias("id")).agg(F.count("*").alias("inbound"), F.sum("weight").alias("tin"))
    out = e.groupBy("site", F.col("src").alias("id")).agg(F.count("*").alias("outbound"), F.sum("weight").alias("tout"))
    loops = edges.where("src = dst").select("site", F.col("src").alias("id"), F.col("weight").alias("self_links"))
    j = nodes.join(inn, ["site", "id"], "left").join(out, ["site", "id"], "left").join(loops, ["site", "id"], "left").na.fill(0, ["inbound", "tin", "outbound", "tout", "self_links"])
    if external is not None:
        ext = external.where("link_class = 'EXTERNAL'").groupBy("site", urls.node(F.col("source_url")).alias("id")).agg(F.count("*").alias("external_outbound"))
        j = j.join(ext, ["site", "id"], "left").na.fill(0, ["external_outbound"])
    crawled = F.col("crawl_state") == "CRAWLED"
    orphan = F.when(F.col("is_root"), "ROOT").when(crawled & (F.col("inbound") == 0), "POTENTIAL_ORPHAN").otherwise("CONNECTED")
    return j.withColumn("total_inbound", F.col("tin") + F.col("self_links")).withColumn("total_outbound", F.col("tout") + F.col("self_links")).withColumn("orphan_status", orphan).withColumn("is_dead_end", crawled & (F.col("outbound") == 0)).drop("tin", "tout")


def link_graph(crawl: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes with all their measures, and edges."""
    edges = settle(edges_of(links))
    nodes = settle(nodes_of(crawl, edges))
    depth, rank = click_depth(nodes, edges), percentiles(page_rank(nodes, edges))
    full = degrees(nodes, edges, links).join(depth, ["site", "id"], "left").join(rank, ["site", "id"], "left")
    return full.withColumn("reachability", F.when(F.col("click_depth").isNotNull(), "REACHABLE_FROM_ROOT").otherwise("UNREACHABLE_IN_OBSERVED_GRAPH")), edges


def graph_summary(nodes: DataFrame, edges: DataFrame, weak: DataFrame, strong: DataFrame) -> DataFrame:
    """Per site: sizes, components, depths, orphans, dead ends, and the ten pages of most and of least equity."""
    crawled = nodes.where("crawl_state = 'CRAWLED'")
    w = Window.partitionBy("site")
    ranked = crawled.withColumn("a", F.row_number().over(w.orderBy(F.desc("equity"), "id"))).withColumn("z", F.row_number().over(w.orderBy("equity", F.desc("id"))))
    tops = ranked.where("a <= 10 or z <= 10").groupBy("site").agg(
        F.transform(F.sort_array(F.collect_list(F.when(F.col("a") <= 10, F.struct("a", "id")))), lambda x: x["id"]).alias("top_equity"),
        F.transform(F.sort_array(F.collect_list(F.when((F.col("z") <= 10) & (F.col("a") > 10), F.struct("a", "id")))), lambda x: x["id"]).alias("lowest_equity"),
    )
    total = nodes.groupBy("site").agg(
        F.count("*").alias("nodes"), F.count_if(F.col("crawl_state") == "CRAWLED").alias("crawled"), F.count_if(F.col("crawl_state") != "CRAWLED").alias("uncrawled"), F.coalesce(F.max("click_depth"), F.lit(0)).alias("max_depth"),
        F.count_if(F.col("orphan_status") == "POTENTIAL_ORPHAN").alias("orphans"), F.count_if("is_dead_end").alias("dead_ends"), F.count_if(F.col("click_depth").isNull()).alias("unreachable"), F.count_if(F.col("click_depth") > 3).alias("deep"),
    )
    e = edges.where("src <> dst").groupBy("site").agg(F.count("*").alias("edges"))
    c = weak.groupBy("site").agg(F.count_distinct("component").alias("weak_components"))
    s = strong.groupBy("site").agg(F.count_distinct("component").alias("strong_components"))
    return total.join(e, "site", "left").na.fill(0, ["edges"]).join(c, "site", "left").join(s, "site", "left").join(tops, "site", "left")
