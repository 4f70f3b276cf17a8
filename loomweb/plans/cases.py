"""Queries over small tables written out here, each with the table that it must give.

They show what the tables of pages lack: redirects, canonicals, sitemaps, structured data, forms, images, several sites.
The expected rows are written out by the rules, or worked out by the plain functions below, without Spark; their SQL is
just these rows. The queries read no files, so their size says nothing of a plan at scale.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from ..functions import dims, text, urls
from ..operators import answers, chains, cohort, content, crawl, eligibility, entities, graph, links, scores, search, technical
from ..sources import crawl as source
from ..sources import parse, robots, sitemaps
from . import reports
from .registry import ORACLE, QUERIES
from .shared import settle

B = "https://a.example"


def _literal(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return "true" if v else "false"
    return repr(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'"


_SQL = {"string": "VARCHAR", "int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "boolean": "BOOLEAN"}


def case(name: str, columns: str, rows):
    """Register a query f(spark) and its expected rows; columns as `name type, ...`."""
    fields = [c.split() for c in columns.split(", ")]

    def put(f):
        def run(spark, d):
            return f(spark).select(*[F.col(c).cast(t).alias(c) for c, t in fields])

        run.__doc__ = f.__doc__
        QUERIES[f"case_{name}"] = run
        values = ", ".join("(" + ", ".join(map(_literal, r)) + ")" for r in (rows() if callable(rows) else rows))
        quoted = ", ".join(f'"{c}"' for c, _ in fields)
        casts = ", ".join(f'CAST("{c}" AS {_SQL[t]}) AS "{c}"' for c, t in fields)
        ORACLE[f"case_{name}"] = f"SELECT {casts} FROM (VALUES {values}) AS v({quoted})"
        return f

    return put


def _join(*columns):
    """Arrays as strings, parts joined by a bar."""
    return {c: F.array_join(c, "|") for c in columns}


def _path(c: str):
    return F.regexp_replace(c, "^https://a.example", "")


# --- the site ---

LONG = "The scope of calibration services that the laboratory offers to all of its customers in the region. " * 12
ORG = '<script type="application/ld+json">{"@type":"Organization","name":"Acme Labs Ltd","telephone":"+1 555 0100","sameAs":["https://x.com/acme"]}</script>'


def page(title="Title", h1="Head", body="", head=""):
    return f"<html lang='en'><head><title>{title}</title>{head}</head><body><main><h1>{h1}</h1>{body}</main></body></html>"


SITE = [
    {"url": f"{B}/", "depth": 0, "discovery_source": "seed", "raw_html": page("Acme Labs - Calibration", "Calibration Services", f"<p>{LONG}</p><a href='/s'>Services</a><a href='/s'>again</a><a href='/gone'>read more</a><a href='https://other.example/'>Out</a>", ORG)},
    {"url": f"{B}/s", "depth": 1, "raw_html": page("Calibration Services", "Calibration Services", f"<h2>What is calibration?</h2><p>Calibration is the comparison of a device with a known standard such as ISO 17025.</p><h2>Scope</h2><p>{LONG}</p><h2>Price</h2><table><tr><td>A</td></tr><tr><td>B</td></tr></table><a href='/'>Home</a><a href='/t'>read more</a>")},
    {"url": f"{B}/t", "depth": 2, "raw_html": page("Testing", "Testing", f"<p>Acme Labs was founded in 1999.</p><p>{LONG} extra</p><a href='/s'>Services</a>")},
    {"url": f"{B}/copy", "depth": 1, "raw_html": page("Testing", "Testing", f"<p>Acme Labs was founded in 2001.</p><p>{LONG} extra</p>")},
    {"url": f"{B}/old", "status_code": 301, "crawl_status": "REDIRECTED", "redirect_url": f"{B}/older", "fetch_time_sec": 0.1},
    {"url": f"{B}/older", "status_code": 302, "crawl_status": "REDIRECTED", "response_headers": {"Location": ["/s"]}, "fetch_time_sec": 0.2},
    {"url": f"{B}/loop", "status_code": 301, "crawl_status": "REDIRECTED", "redirect_url": f"{B}/loop2"},
    {"url": f"{B}/loop2", "status_code": 301, "crawl_status": "REDIRECTED", "redirect_url": f"{B}/loop"},
    {"url": f"{B}/lost", "status_code": 301, "crawl_status": "REDIRECTED"},
    {"url": f"{B}/out", "status_code": 301, "crawl_status": "REDIRECTED", "redirect_url": "https://other.example/"},
    {"url": f"{B}/dead", "status_code": 301, "crawl_status": "REDIRECTED", "redirect_url": f"{B}/gone"},
    {"url": f"{B}/gone", "status_code": 404, "crawl_status": "FAILED", "failure_reason": "HTTP 404"},
]


def _crawl(spark, rows=SITE, site="a.example"):
    return source.crawl_frame(spark, [{"site": site} | r for r in rows])


def _parsed(spark, rows=SITE):
    return parse.parse_pages(source.eligible(_crawl(spark, rows)))


def _one(spark, html, **more):
    return _parsed(spark, [{"url": f"{B}/", "raw_html": html, **more}])


def _links(spark):
    return links.extract_links(_parsed(spark), crawl=_crawl(spark))


_GRAPHS: dict = {}


def _graph(spark):
    """The nodes and edges, worked out once in a session: they are settled."""
    key = spark.sparkContext.applicationId
    if key not in _GRAPHS:
        nodes, edges = graph.link_graph(_crawl(spark).where("status_code = 200"), _links(spark))
        _GRAPHS[key] = settle(nodes), edges
    return _GRAPHS[key]


# --- URLs, frontier, lookup, fetches ---


@case(
    "url_algebra", "url string, normalised string, identity string, node string, hygiene string, crawlable boolean, kind string, same boolean",
    [
        ("HTTP://A.Example:80/x//y/?b=2&a=1&utm_source=z#f", "http://a.example/x/y?a=1&b=2", "http://a.example/x//y?a=1&b=2&utm_source=z", "http://a.example/x//y?a=1&b=2", "https://a.example/x/y?a=1&b=2", True, "INTERNAL", True),
        ("https://www.a.example/P/", "https://www.a.example/P", "https://www.a.example/P", "https://www.a.example/P", "https://a.example/p", True, "EXTERNAL", False),
        ("https://a.example:443", "https://a.example/", "https://a.example/", "https://a.example/", "https://a.example/", True, "INTERNAL", True),
        ("https://a.example/d.PDF?x=1", "https://a.example/d.PDF?x=1", "https://a.example/d.PDF?x=1", "https://a.example/d.PDF?x=1", "https://a.example/d.pdf?x=1", False, "INTERNAL", True),
        ("https://b.example/?gclid=1&k=", "https://b.example/?k=", "https://b.example/?gclid=1&k=", "https://b.example/?k=", "https://b.example/?k=", True, "EXTERNAL", False),
    ],
)
def url_algebra(spark):
    u, base = F.col("url"), F.lit(f"{B}/")
    df = spark.createDataFrame([(x,) for x in ("HTTP://A.Example:80/x//y/?b=2&a=1&utm_source=z#f", "https://www.a.example/P/", "https://a.example:443", f"{B}/d.PDF?x=1", "https://b.example/?gclid=1&k=")], "url string")
    return df.select("url", urls.normalise(u).alias("normalised"), urls.identity(u).alias("identity"), urls.node(u).alias("node"), urls.hygiene(u).alias("hygiene"), urls.crawlable(u).alias("crawlable"), urls.link_class(u, base).alias("kind"), urls.same_domain(u, base).alias("same"))


@case(
    "url_resolution", "url string, base string, normalised string, kind string",
    [
        ("../p/", f"{B}/d/e/", f"{B}/d/p", "INTERNAL"), ("?q=1", f"{B}/x", f"{B}/x?q=1", "INTERNAL"), ("#top", f"{B}/x", f"{B}/x", "SPECIAL"), ("//b.example/y", f"{B}/x", "https://b.example/y", "EXTERNAL"),
        ("mailto:a@b.example", f"{B}/x", "mailto:a@b.example", "SPECIAL"), ("z", f"{B}/x/", f"{B}/x/z", "INTERNAL"),
    ],
)
def url_resolution(spark):
    df = spark.createDataFrame([("../p/", f"{B}/d/e/"), ("?q=1", f"{B}/x"), ("#top", f"{B}/x"), ("//b.example/y", f"{B}/x"), ("mailto:a@b.example", f"{B}/x"), ("z", f"{B}/x/")], "url string, base string")
    return df.select("url", "base", urls.normalise(F.col("url"), F.col("base")).alias("normalised"), urls.link_class(F.col("url"), F.col("base")).alias("kind"))


_FRONTIER = [("", "EMPTY"), ("/a.pdf", "NON_HTML"), ("https://b.example/", "OFF_DOMAIN"), ("/a", "ADMITTED"), ("/a/", "DUPLICATE"), ("/a?utm_source=1", "DUPLICATE"), ("mailto:x@a.example", "NON_HTML"), ("/q?i=1", "ADMITTED"), ("/q?i=2", "ADMITTED"), ("/q?i=3", "VARIANT"), ("/seen", "DUPLICATE"), ("/r1", "ADMITTED"), ("/r2", "BUDGET"), ("/deep", "TOO_DEEP")]


@case("frontier", "url string, verdict string", _FRONTIER)
def frontier(spark):
    c = spark.createDataFrame([("s", i, u, 9 if u == "/deep" else 1, f"{B}/") for i, (u, _) in enumerate(_FRONTIER)], "site string, seq int, url string, depth int, parent_url string")
    return crawl.admit(c, F.lit(f"{B}/"), max_pages=4, variants=2, seen=spark.createDataFrame([("s", f"{B}/seen")], "site string, normalized_url string"))


@case("record_lookup", "target string, found string", [(f"{B}/p?id=2", f"{B}/p?id=2"), (f"{B}/p?id=3", None), (f"{B}/q", f"{B}/q/"), (f"{B}/r?utm_source=y", None), (f"{B}//q", f"{B}/q/")])
def record_lookup(spark):
    c = source.crawl_frame(spark, [{"url": f"{B}/p?id=1"}, {"url": f"{B}/p?id=2"}, {"url": f"{B}/q/"}, {"url": f"{B}/r?utm_source=z"}])
    return crawl.lookup(spark.createDataFrame([("site", u) for u in (f"{B}/p?id=2", f"{B}/p?id=3", f"{B}/q", f"{B}/r?utm_source=y", f"{B}//q")], "site string, target string"), c)


@case("fetch_retries", "attempt int, code int, after string, delay double", [(0, 500, None, 0.5), (1, 500, None, 1.0), (2, 503, None, 2.0), (0, 429, "3", 3.0), (0, 503, "60", 5.0), (5, 500, None, 5.0), (0, 404, None, None), (0, 200, None, None)])
def fetch_retries(spark):
    df = spark.createDataFrame([(0, 500, None), (1, 500, None), (2, 503, None), (0, 429, "3"), (0, 503, "60"), (5, 500, None), (0, 404, None), (0, 200, None)], "attempt int, code int, after string")
    return df.select("attempt", "code", "after", crawl.retry_delay(F.col("attempt"), F.col("code"), F.col("after")).alias("delay"))


@case("provider_status", "code int, error string, status string", [(200, None, "SUCCESS"), (429, None, "RATE_LIMITED"), (401, None, "UNAVAILABLE"), (500, None, "ERROR"), (None, "Read timed out", "TIMEOUT"), (None, "boom", "ERROR"), (None, None, "DISABLED")])
def provider_status(spark):
    df = spark.createDataFrame([(200, None), (429, None), (401, None), (500, None), (None, "Read timed out"), (None, "boom"), (None, None)], "code int, error string")
    return df.withColumn("status", answers.provider_status(F.col("code"), F.col("error")))


@case("render_need", "url string, render boolean", [("/app", True), ("/thin", True), ("/plain", False), ("/full", False)])
def render_need(spark):
    rows = [{"url": f"{B}/app", "raw_html": f"<body><div id='root'></div>{LONG}</body>"}, {"url": f"{B}/thin", "raw_html": "<body>few words<script>x()</script></body>"}, {"url": f"{B}/plain", "raw_html": "<body>few words</body>"}, {"url": f"{B}/full", "raw_html": f"<body>{LONG}<script>x()</script></body>"}]
    return source.render_needed(_parsed(spark, rows)).withColumn("url", _path("url"))


@case("rendered_html", "url string, html_source string", [("/a", "rendered"), ("/b", "raw"), ("/c", "raw")])
def rendered_html(spark):
    c = _crawl(spark, [{"url": f"{B}/{x}", "raw_html": "<p>raw</p>"} for x in "abc"])
    r = spark.createDataFrame([(f"{B}/a", "<p>rendered, and long enough</p>"), (f"{B}/b", "<p>short")], "url string, raw_html string")
    return source.primary_html(c, r).withColumn("url", _path("url"))


@case("crawl_rollup", "fetched int, redirected int, failed int, completeness string, titles string, broken string", [(4, 7, 1, "CRAWL_COMPLETE", "Testing", f"{B}/gone")])
def crawl_rollup(spark):
    r = crawl.rollup(parse.parse_pages(_crawl(spark)))
    return r.withColumns({"titles": F.array_join("duplicate_titles", "|"), "broken": F.array_join("broken", "|")})


# --- links and the graph ---


@case(
    "link_extraction", "pos int, anchor_text string, is_empty_anchor boolean, is_image_link boolean, is_nofollow boolean, is_sponsored boolean, is_ugc boolean, link_class string, target string",
    [
        (0, "Text here", False, False, False, False, False, "INTERNAL", f"{B}/a"), (1, "[IMG: A picture]", False, True, False, False, False, "INTERNAL", f"{B}/b"), (2, "[ARIA: Close]", False, False, False, False, False, "INTERNAL", f"{B}/c"),
        (3, "", True, False, True, True, False, "EXTERNAL", "https://o.example/x"), (4, "Mail", False, False, False, False, True, "SPECIAL", "mailto:x@a.example"),
    ],
)
def link_extraction(spark):
    h = "<a href='/a'>Text <b>here</b></a><a href='b'><img alt='A picture'></a><a href='/c' aria-label='Close'></a><a href='https://o.example/x' rel='nofollow sponsored'></a><a href='mailto:x@a.example' rel='UGC'>Mail</a><a name='n'>no link</a>"
    return links.extract_links(_one(spark, page(body=h))).withColumn("target", F.col("target_url"))


@case("link_evidence", "url string, links int, internal int, external int, generic_anchors int, internal_targets int", [("/", 4, 3, 1, 1, 2), ("/s", 2, 2, 0, 1, 2), ("/t", 1, 1, 0, 0, 1)])
def link_evidence(spark):
    return links.link_evidence(_links(spark)).withColumn("url", _path("source_url"))


@case("broken_links", "source string, target string, anchor_text string, status_code int, failure_reason string", [("/", "/gone", "read more", 404, "HTTP 404")])
def broken_links(spark):
    return links.broken_links(_links(spark), _crawl(spark)).withColumns({"source": _path("source_url"), "target": _path("target_url")})


@case("ambiguous_anchors", "anchor string, targets int, sources string, occurrences int", [("read more", 2, f"{B}/|{B}/s", 2)])
def ambiguous_anchors(spark):
    return links.ambiguous_anchors(_links(spark)).withColumns(_join("sources"))


@case("anchor_summary", "anchors int, empty int, generic int, unique_texts int, top string", [(6, 0, 2, 4, "Services=2,read more=2,Home=1,again=1")])
def anchor_summary(spark):
    return links.anchor_summary(_links(spark)).withColumn("top", F.array_join(F.transform("top_anchors", lambda x: F.concat(x["anchor_text"], F.lit("="), x["n"].cast("string"))), ","))


@case("inbound_counts", "url string, inlinks int, unique_inlinks int, sample string", [("/s", 3, 2, "Services|again"), ("/gone", 1, 1, "read more"), ("/", 1, 1, "Home"), ("/t", 1, 1, "read more")])
def inbound_counts(spark):
    return links.inbound_counts(_links(spark)).withColumns({"url": _path("url"), "sample": F.array_join("sample_anchors", "|")})


@case("link_concentration", "internal_links int, top string, top5_pct double", [(6, "/s=2,/=1,/gone=1,/t=1", 83.3)])
def link_concentration(spark):
    c = links.concentration(_graph(spark)[0], _links(spark))
    return c.withColumn("top", F.array_join(F.transform("top_linked", lambda x: F.concat(F.replace(x["id"], F.lit(B), F.lit("")), F.lit("="), x["inbound"].cast("string"))), ","))


@case("page_link_records", "id string, inlinks int, unique_inlinks int, outlinks int, unique_outlinks int, outlink_status string", [("/", 1, 1, 3, 2, "HAS_DISCOVERED_OUTLINKS"), ("/s", 3, 2, 2, 2, "HAS_DISCOVERED_OUTLINKS"), ("/t", 1, 1, 1, 1, "HAS_DISCOVERED_OUTLINKS"), ("/copy", 0, 0, 0, 0, "NO_DISCOVERED_OUTLINKS"), ("/gone", 1, 1, 0, 0, "UNVERIFIED")])
def page_link_records(spark):
    n, e = _graph(spark)
    return links.page_link_records(n, e, _links(spark)).withColumn("id", _path("id"))


@case(
    "link_findings", "finding string, url string",
    [("LIMITED_CONNECTIVITY", "/t"), ("NO_DISCOVERED_INCOMING_LINKS", "/copy"), ("ZERO_OUTLINKS", "/copy"), ("BROKEN_TARGET", "/gone"), ("AMBIGUOUS_ANCHOR", "/gone")],
)
def link_findings(spark):
    l = _links(spark)
    return links.structural_findings(_graph(spark)[0], links.broken_links(l, _crawl(spark)), links.ambiguous_anchors(l)).withColumn("url", _path("url"))


EDGES = {("/", "/s"): 2, ("/", "/gone"): 1, ("/s", "/"): 1, ("/s", "/t"): 1, ("/t", "/s"): 1}


def plain_ranks(nodes: list[str], edges: dict[tuple[str, str], int]) -> dict[str, float]:
    """Ranks by power iteration, page by page, until they settle."""
    n = len(nodes)
    rank = dict.fromkeys(nodes, 1 / n)
    for _ in range(100):
        lost = sum(rank[x] for x in nodes if not any(a == x for a, _ in edges))
        new = {}
        for x in nodes:
            got = sum(rank[a] * w / sum(v for (c, _), v in edges.items() if c == a) for (a, b), w in edges.items() if b == x)
            new[x] = 0.85 * (got + lost / n) + 0.15 / n
        calm = sum(abs(new[x] - rank[x]) for x in nodes) < n * 1e-6
        rank = new
        if calm:
            break
    return rank


def _ranked():
    r = plain_ranks(["/", "/s", "/t", "/copy", "/gone"], EDGES)
    order = sorted(r, key=lambda x: (round(r[x], 6), x))
    return [(x, round(r[x], 4), round(100 * i / 4, 1)) for i, x in enumerate(order)]


@case("page_rank", "id string, equity double, percentile double", _ranked)
def page_rank(spark):
    return _graph(spark)[0].select(_path("id").alias("id"), F.round("equity", 4).alias("equity"), F.col("equity_percentile").alias("percentile"))


@case(
    "graph_nodes", "id string, crawl_state string, orphan_status string, reachability string, click_depth int, inbound int, outbound int, total_inbound int, total_outbound int, external_outbound int, is_dead_end boolean",
    [
        ("/", "CRAWLED", "ROOT", "REACHABLE_FROM_ROOT", 0, 1, 2, 1, 3, 1, False), ("/s", "CRAWLED", "CONNECTED", "REACHABLE_FROM_ROOT", 1, 2, 2, 3, 2, 0, False), ("/t", "CRAWLED", "CONNECTED", "REACHABLE_FROM_ROOT", 2, 1, 1, 1, 1, 0, False),
        ("/copy", "CRAWLED", "POTENTIAL_ORPHAN", "UNREACHABLE_IN_OBSERVED_GRAPH", None, 0, 0, 0, 0, 0, True), ("/gone", "DISCOVERED_UNCRAWLED", "CONNECTED", "REACHABLE_FROM_ROOT", 1, 1, 0, 1, 0, 0, False),
    ],
)
def graph_nodes(spark):
    return _graph(spark)[0].withColumn("id", _path("id"))


@case("graph_summary", "nodes int, crawled int, uncrawled int, max_depth int, orphans int, dead_ends int, unreachable int, deep int, edges int, weak_components int, strong_components int, top string, lowest string", [(5, 4, 1, 2, 1, 1, 1, 0, 5, 2, 3, "/s|/|/t|/copy", "")])
def graph_summary(spark):
    n, e = _graph(spark)
    s = graph.graph_summary(n, e, graph.weak_components(n, e), graph.strong_components(n, e))
    return s.withColumns({"top": F.replace(F.array_join("top_equity", "|"), F.lit(B), F.lit("")), "lowest": F.array_join("lowest_equity", "|")})


_SMALL = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("e", "d"), ("g", "h")]


def _small(spark):
    nodes = spark.createDataFrame([("s", x) for x in "abcdefgh"], "site string, id string")
    return nodes, spark.createDataFrame([("s", a, b, 1) for a, b in _SMALL], "site string, src string, dst string, weight int")


@case("components", "kind string, members string", [("weak", "a|b|c|d|e"), ("weak", "f"), ("weak", "g|h"), ("strong", "a|b|c"), ("strong", "d|e"), ("strong", "f"), ("strong", "g"), ("strong", "h")])
def components(spark):
    n, e = _small(spark)
    both = graph.weak_components(n, e).withColumn("kind", F.lit("weak")).unionByName(graph.strong_components(n, e).withColumn("kind", F.lit("strong")))
    return both.groupBy("kind", "component").agg(F.array_join(F.sort_array(F.collect_list("id")), "|").alias("members"))


# --- chains, eligibility, representations ---


@case(
    "redirect_chains", "initial string, final string, total_hops int, has_loop boolean, status string, total_latency_ms double",
    [
        ("/old", "/s", 2, False, "MULTI_HOP", 300.0), ("/older", "/s", 1, False, "RESOLVED", 200.0), ("/loop", "/loop", 2, True, "LOOP", None), ("/loop2", "/loop2", 2, True, "LOOP", None),
        ("/lost", "/lost", 0, False, "MISSING_LOCATION", None), ("/out", "https://other.example/", 1, False, "UNVERIFIED_TARGET", None), ("/dead", "/gone", 1, False, "BROKEN_TARGET", None),
    ],
)
def redirect_chains(spark):
    return chains.redirect_chains(_crawl(spark)).withColumns({"initial": _path("initial_url"), "final": _path("final_url")})


@case("redirect_limit", "initial string, status string, total_hops int", [(f"/{i}", "EXCEEDED_MAX_HOPS" if i < 3 else "MULTI_HOP" if i < 11 else "RESOLVED", min(10, 12 - i)) for i in range(12)])
def redirect_limit(spark):
    rows = [{"url": f"{B}/{i}", "status_code": 301, "crawl_status": "REDIRECTED", "redirect_url": f"{B}/{i + 1}"} for i in range(12)] + [{"url": f"{B}/12"}]
    return chains.redirect_chains(_crawl(spark, rows)).withColumn("initial", _path("initial_url"))


_CANON = {"/self": "/self", "/a": "/b", "/b": "/b", "/c": "/a", "/x": "/y", "/y": "/x", "/r": "/redir", "/d": "/dead", "/u": "https://other.example/", "/bad": "ftp://z", "/none": None}


def _canon(spark):
    rows = [{"url": B + k, "raw_html": page(head=f'<link rel="canonical" href="{v}">' if v else "")} for k, v in _CANON.items()]
    return _crawl(spark, [*rows, {"url": f"{B}/redir", "status_code": 301, "crawl_status": "REDIRECTED", "redirect_url": f"{B}/self"}, {"url": f"{B}/dead", "status_code": 500, "crawl_status": "FAILED"}])


@case(
    "canonical_chains", "source string, final string, total_hops int, has_loop boolean, points_to_redirect boolean, points_to_dead boolean, status string",
    [
        ("/self", "/self", 0, False, False, False, "SELF_REFERENCING"), ("/a", "/b", 1, False, False, False, "RESOLVED"), ("/b", "/b", 0, False, False, False, "SELF_REFERENCING"), ("/c", "/b", 2, False, False, False, "CHAIN"),
        ("/x", "/x", 2, True, False, False, "LOOP"), ("/y", "/y", 2, True, False, False, "LOOP"), ("/r", "/self", 1, False, True, False, "POINTS_TO_REDIRECT"), ("/d", "/dead", 1, False, False, True, "POINTS_TO_DEAD_URL"),
        ("/u", "https://other.example/", 1, False, False, False, "UNVERIFIED_TARGET"), ("/bad", None, 1, False, False, False, "INVALID_TARGET"), ("/none", None, 0, False, False, False, "MISSING"), ("/redir", None, 0, False, False, False, "MISSING"), ("/dead", None, 0, False, False, False, "MISSING"),
    ],
)
def canonical_chains(spark):
    c = _canon(spark)
    out = chains.canonical_chains(c, eligibility.canonical_of(parse.parse_pages(c)), chains.redirect_chains(c))
    return out.withColumns({"source": _path("source_url"), "final": _path("final")})


@case(
    "search_eligibility", "url string, crawlability string, indexability string, canonicalization string",
    [
        ("/self", "ALLOWED", "INDEXABLE", "SELF_REFERENCING"), ("/a", "ALLOWED", "INDEXABLE", "CANONICALIZED_ELSEWHERE"), ("/b", "ALLOWED", "INDEXABLE", "SELF_REFERENCING"), ("/c", "ALLOWED", "INDEXABLE", "CANONICALIZED_ELSEWHERE"),
        ("/x", "ALLOWED", "INDEXABLE", "CANONICALIZED_ELSEWHERE"), ("/y", "ALLOWED", "INDEXABLE", "CANONICALIZED_ELSEWHERE"), ("/r", "ALLOWED", "INDEXABLE", "INVALID_TARGET"), ("/d", "ALLOWED", "INDEXABLE", "INVALID_TARGET"),
        ("/u", "ALLOWED", "INDEXABLE", "CROSS_DOMAIN"), ("/bad", "ALLOWED", "INDEXABLE", "INVALID_TARGET"), ("/none", "ALLOWED", "INDEXABLE", "MISSING"), ("/redir", "UNKNOWN", "REDIRECT", "MISSING"), ("/dead", "UNKNOWN", "ERROR", "MISSING"),
    ],
)
def search_eligibility(spark):
    return eligibility.eligibility(parse.parse_pages(_canon(spark))).withColumn("url", _path("url"))


_INDEX = [(200, "noindex", "", True, "NOINDEX"), (200, "nofollow", "", True, "INDEXABLE"), (200, "", "none", True, "NOINDEX"), (200, "", "googlebot: noindex", True, "NOINDEX"), (301, "", "", True, "REDIRECT"), (404, "", "", True, "ERROR"), (0, "", "", False, "ERROR"), (0, "", "", True, "INDEXABLE"), (100, "", "", True, "UNKNOWN")]


@case("indexability", "code int, meta string, header string, content boolean, state string", _INDEX)
def indexability(spark):
    df = spark.createDataFrame([r[:4] for r in _INDEX], "code int, meta string, header string, content boolean")
    header = eligibility.x_robots(F.create_map(F.lit("X-Robots-Tag"), F.array("header")))
    return df.withColumn("state", eligibility.indexability(F.col("code"), eligibility.directives(F.col("meta")), header, F.col("content")))


@case("index_confirmation", "url string, confirmation string, inbound int, in_sitemap boolean, crawlability string", [("/self", "CONFIRMED_INDEXED", 0, True, "ALLOWED"), ("/a", "CONFIRMED_NOT_INDEXED", 0, False, "BLOCKED"), ("/b", "UNKNOWN", 0, False, "ALLOWED")])
def index_confirmation(spark):
    p = parse.parse_pages(_canon(spark)).where(F.col("url").isin(f"{B}/self", f"{B}/a", f"{B}/b"))
    told = spark.createDataFrame([("a.example", f"{B}/self", "INDEXED"), ("a.example", f"{B}/a", "NOT_INDEXED")], "site string, url string, status string")
    rob = robots.allowed_pages(_canon(spark), spark.createDataFrame([("a.example", 200, "User-agent: *\nDisallow: /a$\n")], "site string, status_code int, content string"))
    maps = spark.createDataFrame([("a.example", f"{B}/self")], "site string, identity_url string")
    return eligibility.eligibility(p, maps, _links(spark).limit(0), rob, told).withColumn("url", _path("url"))


_FORMS = [(f"{B}/p", "same"), (f"{B}/p/", "same"), ("http://a.example/q", "one"), (f"{B}/q", "two"), (f"{B}/z?a=1&b=2", "k"), (f"{B}/z?b=2&a=1", "k"), ("https://www.a.example/w", "w"), (f"{B}/w", "w"), (f"{B}/Case", "c"), (f"{B}/case", "c"), (f"{B}/m//n", "m"), (f"{B}/m/n", "m"), (f"{B}/u", "u"), (f"{B}/u?utm_source=x", "u")]


@case(
    "url_representations", "anomaly_type string, primary_url string, duplicate_url string, evidence_type string",
    [
        ("TRAILING_SLASH", f"{B}/p", f"{B}/p/", "IDENTICAL_EXTRACTED_TEXT"), ("PROTOCOL_HTTP_HTTPS", "http://a.example/q", f"{B}/q", "DISTINCT_CONTENT_VARIANT"), ("QUERY_PARAM_ORDER", f"{B}/z?a=1&b=2", f"{B}/z?b=2&a=1", "IDENTICAL_EXTRACTED_TEXT"),
        ("WWW_SUBDOMAIN", f"{B}/w", "https://www.a.example/w", "IDENTICAL_EXTRACTED_TEXT"), ("PATH_CASING", f"{B}/case", f"{B}/Case", "IDENTICAL_EXTRACTED_TEXT"), ("MULTIPLE_SLASHES", f"{B}/m/n", f"{B}/m//n", "IDENTICAL_EXTRACTED_TEXT"),
        ("TRACKING_PARAMETERS", f"{B}/u", f"{B}/u?utm_source=x", "IDENTICAL_EXTRACTED_TEXT"),
    ],
)
def url_representations(spark):
    return eligibility.representations(_parsed(spark, [{"url": u, "raw_html": page(body=f"<p>{t}</p>")} for u, t in _FORMS]))


@case("representation_evidence", "primary string, evidence_type string, advice string", [("/to", "REDIRECT_EQUIVALENT", f"Link to {B}/to itself rather than to {B}/to/, which redirects there."), ("/c", "CANONICAL_EQUIVALENT", f"{B}/c/ names {B}/c its canonical; a permanent redirect would settle it."), ("/seen", "POTENTIAL_DUPLICATE_REPRESENTATION", f"Use {B}/seen alone.")])
def representation_evidence(spark):
    rows = [{"url": f"{B}/to", "raw_html": page()}, {"url": f"{B}/to/", "status_code": 301, "crawl_status": "REDIRECTED", "redirect_url": f"{B}/to"}, {"url": f"{B}/c", "raw_html": page()}, {"url": f"{B}/c/", "raw_html": page(head=f"<link rel='canonical' href='{B}/c'>")}, {"url": f"{B}/seen", "raw_html": page()}]
    # the identity of a URL has no closing slash, so the pages that redirect or name a canonical are told by their records
    extra = spark.createDataFrame([("a.example", f"{B}/seen/")], "site string, url string")
    return eligibility.representations(parse.parse_pages(_crawl(spark, rows)), extra).withColumns({"primary": _path("primary_url"), "advice": F.col("recommendation")})


# --- robots.txt, llms.txt ---

ROBOTS = "# comment\nUser-agent: *\nDisallow: /private\nAllow: /private/open\nDisallow: /*.tmp$\n\nUser-agent: GPTBot\nUser-agent: CCBot\nDisallow: /\n\nUser-agent: Bingbot\nDisallow:\n\nSitemap: https://a.example/map.xml\n"


def _robots(spark):
    return spark.createDataFrame([("a.example", 200, ROBOTS), ("b.example", 404, "")], "site string, status_code int, content string")


@case("robots_sitemaps", "site string, sitemap string", [("a.example", f"{B}/map.xml"), ("b.example", "https://b.example/sitemap.xml"), ("b.example", "https://b.example/sitemap_index.xml")])
def robots_sitemaps(spark):
    return robots.sitemaps_of(_robots(spark))


_PATHS = ["/", "/private/x", "/private/open/y", "/a.tmp", "/a.tmp?x=1"]


@case(
    "robots_decisions", "path string, agent string, status string, rule_source string, matched string, line int",
    [
        *[(p, "GPTBot", "DISALLOWED", "explicit", "Disallow: /", 9) for p in _PATHS], *[(p, "bingbot", "ALLOWED", "explicit", "Allow: /", 12) for p in _PATHS],
        ("/", "Googlebot", "ALLOWED", "wildcard", None, None), ("/private/x", "Googlebot", "DISALLOWED", "wildcard", "Disallow: /private", 3), ("/private/open/y", "Googlebot", "ALLOWED", "wildcard", "Allow: /private/open", 4),
        ("/a.tmp", "Googlebot", "DISALLOWED", "wildcard", "Disallow: /*.tmp$", 5), ("/a.tmp?x=1", "Googlebot", "ALLOWED", "wildcard", None, None),
    ],
)
def robots_decisions(spark):
    paths = spark.createDataFrame([("a.example", p) for p in _PATHS], "site string, path string")
    return robots.bot_matrix(_robots(spark), paths, spark.createDataFrame([(a,) for a in ("GPTBot", "bingbot", "Googlebot")], "agent string"))


@case("allowed_pages", "url string, allowed boolean", [("https://a.example/private/x#f", False), ("https://a.example/private/open", True), ("https://a.example", True), ("https://b.example/private", True)])
def allowed_pages(spark):
    c = spark.createDataFrame([("a.example", f"{B}/private/x#f"), ("a.example", f"{B}/private/open"), ("a.example", B), ("b.example", "https://b.example/private")], "site string, url string")
    return robots.allowed_pages(c, _robots(spark))


@case("llms_txt", "site string, has_h1 boolean, has_summary boolean, links int, valid boolean", [("a", True, True, 1, True), ("b", False, True, 1, False), ("c", True, True, 0, False), ("d", False, False, 0, False)])
def llms_txt(spark):
    words = "word " * 30
    rows = [("a", f"# A\n> sum\n- [x](https://a.example/x)\n{words}"), ("b", f"A\n> sum\n[x](/x) {words}"), ("c", f"# A\n> sum\n{words}"), ("d", None)]
    return robots.llms_txt(spark.createDataFrame(rows, "site string, content string"))


# --- sitemaps ---

_NS = "xmlns='http://www.sitemaps.org/schemas/sitemap/0.9'"
_MAPS = [
    ("index.xml", 200, f"<?xml version='1.0'?><sitemapindex {_NS}><sitemap><loc>{B}/one.xml</loc></sitemap><sitemap><loc>{B}/two.xml</loc></sitemap><sitemap><loc>{B}/index.xml</loc></sitemap><sitemap><loc>{B}/lost.xml</loc></sitemap></sitemapindex>"),
    ("one.xml", 200, f"<urlset {_NS}><url><loc>{B}/s</loc><lastmod>2024-01-02</lastmod><changefreq>daily</changefreq><priority>0.8</priority></url><url><loc>{B}/s/</loc></url><url><loc>{B}/gone</loc></url><url><loc>{B}/old</loc></url></urlset>"),
    ("two.xml", 200, f"<urlset><url><loc>{B}/copy</loc></url><url><loc>{B}/never?a=1&b=2</loc></url>"),
    ("html.xml", 200, "<!DOCTYPE html><html><body>Not found</body></html>"),
    ("err.xml", 500, ""),
]


def _maps(spark):
    docs = spark.createDataFrame([("a.example", f"{B}/{n}", c, t) for n, c, t in _MAPS], "site string, sitemap string, status_code int, body string")
    roots = spark.createDataFrame([("a.example", f"{B}/{n}") for n in ("index.xml", "html.xml", "err.xml")], "site string, sitemap string")
    return sitemaps.traverse(roots, docs)


@case(
    "sitemap_traversal", "sitemap string, depth int, status string, format string",
    [
        ("/index.xml", 0, "SUCCESS", "SITEMAPINDEX"), ("/html.xml", 0, "MALFORMED_CONTENT", None), ("/err.xml", 0, "HTTP_ERROR", None), ("/one.xml", 1, "SUCCESS", "URLSET"), ("/two.xml", 1, "SUCCESS", "URLSET"),
        ("/index.xml", 1, "LOOP_DETECTED", None), ("/lost.xml", 1, "CONNECTION_FAILED", None),
    ],
)
def sitemap_traversal(spark):
    return _maps(spark).withColumns({"sitemap": _path("sitemap"), "format": F.col("doc.format")})


@case(
    "sitemap_urls", "loc string, source string, lastmod string, changefreq string, priority double",
    [("/s", "/one.xml", "2024-01-02", "daily", 0.8), ("/gone", "/one.xml", None, None, None), ("/old", "/one.xml", None, None, None), ("/copy", "/two.xml", None, None, None), ("/never?a=1&b=2", "/two.xml", None, None, None)],
)
def sitemap_urls(spark):
    return sitemaps.sitemap_urls(_maps(spark)).withColumns({"loc": _path("loc"), "source": _path("source_sitemap")})


def _conflicts(spark):
    c = _crawl(spark)
    return sitemaps.reconcile(sitemaps.sitemap_urls(_maps(spark)), eligibility.eligibility(parse.parse_pages(c)), c, _graph(spark)[0])


@case(
    "sitemap_conflicts", "url string, conflict_type string, severity string, state string",
    [
        ("/gone", "SITEMAP_ERROR_CONFLICT", "HIGH", "HTTP 404"), ("/old", "SITEMAP_REDIRECT_CONFLICT", "MEDIUM", f"HTTP 301 -> {B}/older"), ("/copy", "SITEMAP_ORPHAN_CANDIDATE", "LOW", "zero_observed_inbound_internal_links"),
        ("/never?a=1&b=2", "SITEMAP_URL_UNCRAWLED", "INFO", "UNAVAILABLE"), ("/", "INTERNAL_URL_NOT_IN_SITEMAP", "LOW", "missing_from_sitemap"), ("/t", "INTERNAL_URL_NOT_IN_SITEMAP", "LOW", "missing_from_sitemap"),
    ],
)
def sitemap_conflicts(spark):
    return _conflicts(spark).withColumns({"url": _path("url"), "state": F.col("signal_b_state")})


@case("conflict_counts", "kind string, n int", [("SITEMAP_ERROR_CONFLICT", 1), ("SITEMAP_REDIRECT_CONFLICT", 1), ("SITEMAP_ORPHAN_CANDIDATE", 1), ("SITEMAP_URL_UNCRAWLED", 1), ("INTERNAL_URL_NOT_IN_SITEMAP", 2), ("HIGH", 1), ("MEDIUM", 1), ("LOW", 3), ("INFO", 1)])
def conflict_counts(spark):
    return sitemaps.conflict_counts(_conflicts(spark)).withColumn("kind", F.coalesce("conflict_type", "severity"))


@case("canonical_conflicts", "url string, conflict_type string, severity string", [("/r", "CANONICAL_TARGET_REDIRECT", "HIGH"), ("/d", "CANONICAL_TARGET_DEAD", "HIGH"), ("/a", "SITEMAP_CANONICAL_ELSEWHERE", "MEDIUM"), ("/n", "SITEMAP_NOINDEX_CONFLICT", "HIGH"), ("/block", "SITEMAP_ROBOTS_BLOCKED", "HIGH")])
def canonical_conflicts(spark):
    c = _canon(spark).unionByName(_crawl(spark, [{"url": f"{B}/n", "raw_html": page(head="<meta name='robots' content='noindex'>")}, {"url": f"{B}/block", "status_code": 0, "crawl_status": "BLOCKED"}]))
    p = parse.parse_pages(c)
    chain = chains.canonical_chains(c, eligibility.canonical_of(p), chains.redirect_chains(c))
    maps = spark.createDataFrame([("a.example", f"{B}/{x}", f"{B}/{x}") for x in ("a", "n", "block")], "site string, loc string, identity_url string")
    return sitemaps.reconcile(maps, eligibility.eligibility(p), c, None, chain).where("conflict_type <> 'INTERNAL_URL_NOT_IN_SITEMAP'").withColumn("url", _path("url"))


# --- text and content ---


def plain_simhash(t: str) -> str:
    """A fingerprint by counting votes, bit by bit."""
    import re

    w = re.sub(r"\s+", " ", re.sub(r"[^\w\s]", "", t.lower())).strip().split()
    marks = w + [f"{a} {b}" for a, b in zip(w, w[1:])]
    votes = [0] * 64
    for m in marks:
        h = int(hashlib.md5(m.encode()).hexdigest()[:16], 16)
        for i in range(64):
            votes[i] += 1 if h >> i & 1 else -1
    return f"{sum(1 << i for i in range(64) if votes[i] > 0):016x}"


_TEXTS = ["The quick brown fox.", "the  QUICK brown fox", "Something else, entirely different", "one"]


@case("fingerprints", "text string, simhash string, content_hash string", lambda: [(t, plain_simhash(t), hashlib.sha256(" ".join(t.lower().replace(".", "").replace(",", "").split()).encode()).hexdigest()) for t in _TEXTS])
def fingerprints(spark):
    return spark.createDataFrame([(t,) for t in _TEXTS], "text string").withColumns({"simhash": text.simhash(F.col("text")), "content_hash": text.content_hash(F.col("text"))})


@case("hamming", "a string, b string, bits int", [("0000000000000000", "ffffffffffffffff", 64), ("0000000000000003", "0000000000000001", 1), ("8000000000000000", "0000000000000000", 1), ("xyz", "0000000000000000", 64)])
def hamming(spark):
    df = spark.createDataFrame([("0000000000000000", "ffffffffffffffff"), ("0000000000000003", "0000000000000001"), ("8000000000000000", "0000000000000000"), ("xyz", "0000000000000000")], "a string, b string")
    return df.withColumn("bits", text.hamming(F.col("a"), F.col("b")))


@case("shingle_similarity", "a string, b string, similarity double, words double", [("a b c d", "a b c e", 0.3333, 0.6), ("a b", "b a c", 0.6667, 0.6667), ("a b c", "a b c", 1.0, 1.0), ("", "a b c", 0.0, 0.0)])
def shingle_similarity(spark):
    df = spark.createDataFrame([("a b c d", "a b c e"), ("a b", "b a c"), ("a b c", "a b c"), ("", "a b c")], "a string, b string")
    bag = lambda c: F.filter(F.split(c, " "), lambda w: w != "")
    return df.withColumns({"similarity": text.shingle_jaccard(F.col("a"), F.col("b")), "words": F.round(text.jaccard(bag(F.col("a")), bag(F.col("b"))), 4)})


@case(
    "text_scalars", "raw string, term string, tokens string, snippet string, hard string, anchor string, generic boolean",
    [
        ("  *Hello_World!* ", "hello world", "hello|world", "*Hello_World!*", "  *Hello_World!* ", "hello_world", False), ("Read More", "read more", "read", "Read More", "Read More", "read more", True),
        ("[IMG: Click here]", "img: click here", "img|click", "[IMG: Click here]", "[IMG: Click here]", "click here", True), ("The state-of-the-art of ISO 9001 labs", "the state-of-the-art of iso 9001 labs", "state-of|the-art|iso|9001|labs", "The state-of-the-art...", "The state-of-the-ar...", "the state of the art of iso 9001 labs", False),
    ],
)
def text_scalars(spark):
    r = F.col("raw")
    df = spark.createDataFrame([("  *Hello_World!* ",), ("Read More",), ("[IMG: Click here]",), ("The state-of-the-art of ISO 9001 labs",)], "raw string")
    return df.select("raw", text.term(r).alias("term"), F.array_join(text.tokens(r), "|").alias("tokens"), text.snippet(r, 22).alias("snippet"), text.hard_snippet(r, 22).alias("hard"), text.anchor(r).alias("anchor"), text.generic_anchor(r).alias("generic"))


@case("word_bounds", "needle string, haystack string, inside boolean", [("cal", "cal lab", True), ("cal", "calibration", False), ("lab", "cal lab", True), ("cal", "cal", False), ("", "cal", False)])
def word_bounds(spark):
    df = spark.createDataFrame([("cal", "cal lab"), ("cal", "calibration"), ("lab", "cal lab"), ("cal", "cal"), ("", "cal")], "needle string, haystack string")
    return df.withColumn("inside", text.word_bounded(F.col("needle"), F.col("haystack")))


@case(
    "title_alignment", "url string, status string, exact boolean, overlap double",
    [("/exact", "STRONG_ALIGNMENT", True, 1.0), ("/half", "STRONG_ALIGNMENT", False, 0.667), ("/fifth", "MODERATE_ALIGNMENT", False, 0.25), ("/none", "MISALIGNED", False, 0.0), ("/empty", "UNAVAILABLE", False, 0.0)],
)
def title_alignment(spark):
    rows = [("exact", "Steel Tube", "steel tube!"), ("half", "steel tube welding", "steel tube"), ("fifth", "steel tube copper", "steel brass"), ("none", "steel tube", "green apple"), ("empty", "steel", "")]
    c = content.page_content(_parsed(spark, [{"url": f"{B}/{u}", "raw_html": page(t, h, "<p>words</p>")} for u, t, h in rows]).where("true"))
    return c.select(_path("url").alias("url"), "alignment.status", "alignment.exact", "alignment.overlap")


@case("heading_structure", "total int, h1 int, h2 int, h3 int, h4 int, valid boolean, skips string, several_h1 boolean, empty int, empty_sections int, mean_section_words double", [(5, 2, 1, 1, 1, False, "h2>h4: Four", True, 1, 2, 1.2)])
def heading_structure(spark):
    c = content.page_content(_one(spark, "<body><h1>One</h1><p>a b</p><h2>Two</h2><p>c</p><h4>Four</h4><h3></h3><p>d e f</p><h1>Last</h1></body>"))
    return c.select("headings_evidence.*").withColumn("skips", F.array_join("skips", "|"))


@case("heading_skips", "level int, previous int, text string", [(4, 2, "Four"), (6, 3, "Six")])
def heading_skips(spark):
    return content.heading_skips(_one(spark, "<body><h1>One</h1><h2>Two</h2><h4>Four</h4><h3>Three</h3><h6>Six</h6><h1>x</h1></body>"))


_MAIN = "word " * 14 + "end"


@case(
    "main_content", "url string, main_method string, words int, tier string, paragraphs int, sentences int",
    [("/main", "SEMANTIC_MAIN", 15, "VERY_LOW", 1, 1), ("/role", "ROLE_MAIN", 15, "VERY_LOW", 0, 1), ("/article", "SEMANTIC_ARTICLE", 15, "VERY_LOW", 0, 1), ("/pruned", "HEURISTIC_PRUNED_BODY", 15, "VERY_LOW", 0, 1), ("/raw", "RAW_BODY_FALLBACK", 2, "VERY_LOW", 0, 1)],
)
def main_content(spark):
    rows = {"main": f"<nav>menu</nav><main><p>{_MAIN}</p></main>", "role": f"<div role=main>{_MAIN}</div><p>x", "article": f"<main>too short</main><article>{_MAIN}</article>", "pruned": f"<div class=sidebar>side</div><div>{_MAIN}</div>", "raw": "<nav>only menu</nav>"}
    return content.page_content(_parsed(spark, [{"url": f"{B}/{k}", "raw_html": f"<body>{v}</body>"} for k, v in rows.items()])).withColumn("url", _path("url"))


_BASE = " ".join(f"w{i}" for i in range(60))


@case("page_duplicates", "kind string, a string, b string, similarity double", [("exact", "/1", "/3", None), ("near", "/1", "/2", 90.2), ("near", "/2", "/3", 90.2)])
def page_duplicates(spark):
    """60 words have 58 shingles; another word in the middle changes 3, so that 55 of 61 are shared."""
    rows = [("1", _BASE), ("2", _BASE.replace("w30 ", "zz ")), ("3", _BASE.upper() + "."), ("4", "quite another text " * 9)]
    c = settle(content.page_content(_parsed(spark, [{"url": f"{B}/{u}", "raw_html": f"<body><main><p>{t}</p></main></body>"} for u, t in rows])))
    e = content.exact_duplicates(c).select(F.lit("exact").alias("kind"), F.col("urls")[0].alias("a"), F.col("urls")[1].alias("b"), F.lit(None).cast("double").alias("similarity"))
    n = content.near_duplicates(c).select(F.lit("near"), "url_a", "url_b", "similarity")
    return e.union(n).withColumns({"a": _path("a"), "b": _path("b")})


@case("page_boilerplate", "block string, words int, pages int", [("call us any time of the day or night", 9, 3)])
def page_boilerplate(spark):
    rows = [{"url": f"{B}/{i}", "raw_html": f"<body><p>page number {i} has a text of its own that differs</p><p>Call us any time of the day or night!</p></body>"} for i in range(3)] + [{"url": f"{B}/z", "raw_html": "<body><p>none</p></body>"}]
    return content.boilerplate(content.page_content(_parsed(spark, rows)))


@case("site_content", "pages int", [(4,)])
def site_content(spark):
    return content.site_content(content.page_content(_parsed(spark)))


@case(
    "page_issues", "url string, h1_count int, has_canonical boolean, issues string",
    [("/bare", 0, False, "NO_META_DESC,MISSING_H1,THIN_CONTENT"), ("/fine", 1, True, "")],
)
def page_issues(spark):
    fine = page("A title that is long enough for it", "One", f"<p>{LONG * 3}</p>", f"<link rel=canonical href='{B}/fine'><meta name=description content='{'d' * 120}'>")
    return crawl.page_issues(_parsed(spark, [{"url": f"{B}/bare", "raw_html": "<body>text</body>"}, {"url": f"{B}/fine", "raw_html": fine}])).withColumns({"url": _path("url"), "issues": F.array_join("issues", ",")})


# --- search ---

TUBES = [
    {"url": f"{B}/tubes/steel", "raw_html": page("Steel Tubes", "Steel Tubes", "<h2>Welded steel tubes</h2><p>Welded steel tubes carry water.</p><h2>What sizes exist?</h2><p>Many.</p><h2>Seamless tubes</h2><p>Seamless tubes carry gas, and seamless tubes carry oil.</p><a href='/x'>Request a quote</a>")},
    {"url": f"{B}/tubes/copper", "raw_html": page("Copper Tubes", "Copper Tubes", "<p>Short text.</p>")},
    {"url": f"{B}/shop/steel", "raw_html": page("Buy Steel Tubes", "Steel Tubes Shop", "<p>Short text.</p><a href='/y'>Add to cart</a>")},
]


def _search(spark):
    p = settle(_parsed(spark, TUBES))
    s = settle(search.signals(p))
    t = settle(search.page_topics(search.topic_members(s)))
    return p, s, t, settle(search.concepts(s, t, p)), settle(search.intents(search.intent_evidence(p), p))


@case(
    "search_signals", "term string, locations string, occurrences int, prominent boolean, confidence string",
    [
        ("copper tubes", "H1|TITLE", 2, True, "DIRECT"), ("copper", "H1|TITLE|URL_PATH", 3, True, "DIRECT"), ("tubes", "H1|TITLE|URL_PATH", 3, True, "DIRECT"),
    ],
)
def search_signals(spark):
    return search.signals(_parsed(spark, TUBES[1:2])).withColumn("locations", F.array_join("locations", "|"))


@case(
    "ranked_signals", "place int, term string",
    [(1, "copper"), (2, "tubes"), (3, "copper tubes")],
)
def ranked_signals(spark):
    return search.ranked_signals(search.signals(_parsed(spark, TUBES[1:2])))


@case("recurring_concepts", "term string, pages int, prominent int, occurrences int", [("tubes", 3, 3, None), ("steel", 2, 2, None)])
def recurring_concepts(spark):
    r = search.recurring(_search(spark)[1])
    return r.where("term in ('tubes', 'steel', 'steel tubes')").withColumns({"prominent": F.size("prominent_pages"), "occurrences": F.lit(None)})


@case("page_intents", "url string, intent string, secondary string", [("/tubes/steel", "informational", "transactional_lead_gen"), ("/tubes/copper", "unspecified", ""), ("/shop/steel", "transactional_ecommerce", "")])
def page_intents(spark):
    return _search(spark)[4].withColumns({"url": _path("url"), "secondary": F.array_join("secondary", "|")})


_HINTS = [
    ("/a", "<h2>Steel vs. copper</h2>", "commercial"), ("/b", "<a href='/c'>Buy now</a>", "transactional_ecommerce"), ("/c", "<h2>Glossary of terms</h2>", "informational_reference"),
    ("/d", "<form><textarea name=m></textarea></form>", "transactional_lead_gen"), ("/account", "<p>x</p>", "navigational"), ("/e", "<p>12 High Street, Town 12345</p>", "local"), ("/f", "<iframe src='https://www.google.com/maps/x'></iframe>", "local_service"),
    ("/g", "<h2>What is it?</h2><h2>How it works</h2><a href='/z'>Buy now</a><a href='/q'>Add to cart</a>", "mixed"),
]


@case("intent_rules", "url string, intent string", [(u, w) for u, _, w in _HINTS])
def intent_rules(spark):
    p = _parsed(spark, [{"url": B + u, "raw_html": page("T", "X", h)} for u, h, _ in _HINTS])
    return search.intents(search.intent_evidence(p), p).withColumn("url", _path("url"))


@case("topic_coverage", "topic string, pages int, primary string, dominant string, multi_intent boolean", [("steel", 2, "/shop/steel|/tubes/steel", "mixed", True), ("copper tubes", 1, "/tubes/copper", "unspecified", False)])
def topic_coverage(spark):
    _, _, t, c, i = _search(spark)
    out = search.coverage(c, t, i).where("topic in ('steel', 'copper tubes')")
    return out.withColumn("primary", F.replace(F.array_join("primary_pages", "|"), F.lit(B), F.lit("")))


@case("concept_pages", "concept string, pages int, direct string, overlap boolean", [("steel", 2, "/shop/steel|/tubes/steel", True), ("copper tubes", 1, "/tubes/copper", False), ("seamless tubes", 1, "", False)])
def concept_pages(spark):
    out = search.concept_pages(_search(spark)[3]).where("concept in ('steel', 'copper tubes', 'seamless tubes')")
    return out.withColumn("direct", F.replace(F.array_join("direct", "|"), F.lit(B), F.lit("")))


@case("page_concepts", "url string, concept string, strength string, title_or_h1 boolean, url_match boolean", [("/tubes/steel", "seamless tubes", "SUPPORTED", False, False), ("/tubes/steel", "steel tubes", "DIRECT", True, True), ("/shop/steel", "steel", "DIRECT", True, True), ("/tubes/steel", "steel", "DIRECT", True, True), ("/tubes/copper", "copper tubes", "DIRECT", True, True)])
def page_concepts(spark):
    return _search(spark)[3].where("concept in ('steel', 'steel tubes', 'copper tubes', 'seamless tubes')").withColumn("url", _path("url"))


@case("cannibalization", "topic string, a string, b string, strength string, shared_intent string, title_similarity double", [("best steel tubes", "/p1", "/p2", "DIRECT", "commercial", 1.0)])
def cannibalization(spark):
    rows = [{"url": f"{B}/p{i}", "raw_html": page("Best Steel Tubes", "Best Steel Tubes", f"<p>Text {i}.</p>")} for i in (1, 2)] + [{"url": f"{B}/p3", "raw_html": page("Green Apples", "Best Green Apples", "<p>x</p>")}]
    p = settle(_parsed(spark, rows))
    s = settle(search.signals(p))
    t = settle(search.page_topics(search.topic_members(s)))
    out = search.cannibalization(search.concepts(s, t, p), t, p, search.intents(search.intent_evidence(p), p))
    return out.where("topic = 'best steel tubes'").withColumns({"a": _path("url_a"), "b": _path("url_b")})


@case("depth_gaps", "topic string, source string, related string, missing string", [("steel", "/shop/steel", "/tubes/steel", "Welded steel tubes|What sizes exist?|Seamless tubes")])
def depth_gaps(spark):
    p, _, t, c, _ = _search(spark)
    out = search.depth_gaps(c, t, p).where("topic = 'steel'")
    return out.withColumns({"source": _path("source_url"), "related": _path("related_url"), "missing": F.array_join("missing", "|")})


@case("topic_gaps", "source string, related string, lacks boolean", [("/shop/steel", "/tubes/steel", True)])
def topic_gaps(spark):
    _, _, t, c, _ = _search(spark)
    out = search.topic_gaps(c, t).where("topic = 'steel' and source_url like '%shop%'")
    return out.withColumns({"source": _path("source_url"), "related": _path("related_url"), "lacks": F.array_contains("missing", "seamless tubes")})


@case("topic_relations", "topic_a string, topic_b string, relation string", [("copper tubes", "copper", "LEXICAL_OVERLAP"), ("copper tubes", "tubes", "LEXICAL_OVERLAP"), ("copper", "tubes", "CO_OCCURRENCE")])
def topic_relations(spark):
    """No term of the page is below title and H1, so that what contains another only overlaps with it."""
    return search.topic_relations(search.page_topics(search.topic_members(search.signals(_parsed(spark, TUBES[1:2])))))


@case("site_topics", "topic string, pages int, title_or_h1 boolean", [("steel", 2, True), ("copper tubes", 1, True)])
def site_topics(spark):
    return search.site_topics(_search(spark)[2]).where("topic in ('steel', 'copper tubes')")


# --- entities ---

_GRAPH_LD = '<script type="application/ld+json">{"@context":"https://schema.org","@graph":[{"@type":"LocalBusiness","name":"\\"Acme\\" Labs, Inc.","telephone":"+1 (555) 010-0","address":{"@type":"PostalAddress","streetAddress":"1 Main St","addressLocality":"Town"},"sameAs":["https://x.com/acme"]},{"@type":"Person","name":"Jo Roe"}]}</script><script type="application/ld+json">{broken</script>'


@case("entity_names", "raw string, normalized string", [('"Acme" Labs, Inc.', "acme labs"), ("ACME LABS LTD", "acme labs"), ("Ltd", "ltd"), ("Café GmbH & Co.", None)])
def entity_names(spark):
    df = spark.createDataFrame([('"Acme" Labs, Inc.',), ("ACME LABS LTD",), ("Ltd",)], "raw string")
    return df.withColumn("normalized", entities.entity_name(F.col("raw"))).union(spark.createDataFrame([("Café GmbH & Co.", None)], "raw string, normalized string"))


@case("name_alignment", "a string, b string, alignment string", [("Acme", "Acme", "EXACT_MATCH"), ("Acme Ltd", "ACME", "NORMALIZED_MATCH"), ("Acme Labs", "Acme", "PARTIAL_MATCH"), ("Acme", "Zeta", "DIVERGENT_IDENTITY_SUSPECTED"), (None, "Acme", "UNAVAILABLE")])
def name_alignment(spark):
    df = spark.createDataFrame([("Acme", "Acme"), ("Acme Ltd", "ACME"), ("Acme Labs", "Acme"), ("Acme", "Zeta"), (None, "Acme")], "a string, b string")
    return df.withColumn("alignment", entities.name_alignment(F.col("a"), F.col("b")))


@case(
    "page_entities", "type string, normalized string, source string",
    [("LOCAL_BUSINESS", "acme labs", "JSON_LD"), ("PERSON", "jo roe", "JSON_LD"), ("ORGANIZATION", "acme", "META_TAG"), ("PERSON", "ann lee", "META_TAG")],
)
def page_entities(spark):
    e = entities.page_entities(_one(spark, page(head=_GRAPH_LD + "<meta property='og:site_name' content='Acme'><meta name=author content='Ann Lee'>")))
    return e.where("type in ('LOCAL_BUSINESS', 'PERSON', 'ORGANIZATION')")


@case("entity_relations", "source string, target string, relation string", [('"Acme" Labs, Inc.', "a.example", "organization_to_website"), ('"Acme" Labs, Inc.', "https://x.com/acme", "organization_to_social_profile"), ('"Acme" Labs, Inc.', "1 Main St, Town", "organization_to_location")])
def entity_relations(spark):
    return entities.entity_relations(entities.page_entities(_one(spark, page(head=_GRAPH_LD)))).where("relation like 'organization_to%'")


def _branches(spark):
    ld = lambda name, phone: f'<script type="application/ld+json">{{"@type":"Organization","name":"{name}","telephone":"{phone}"}}</script>'
    return entities.page_entities(_parsed(spark, [{"url": f"{B}/", "raw_html": page(head=ld("Acme Labs", "555 0100"))}, {"url": f"{B}/x", "raw_html": page(head=ld("Acme Labs Ltd", "555 0199"))}, {"url": f"{B}/y", "raw_html": page(head=ld("Zeta", "1"))}]))


@case("entity_profiles", "normalized string, pages int, names string, inconsistent string", [("acme labs", 2, "Acme Labs|Acme Labs Ltd", "name|phone"), ("zeta", 1, "Zeta", "")])
def entity_profiles(spark):
    return entities.entity_profiles(_branches(spark)).withColumns(_join("names", "inconsistent"))


@case("primary_organization", "normalized string, name string, score int", [("acme labs", "Acme Labs", 19)])
def primary_organization(spark):
    return entities.primary_organization(_branches(spark))


@case("brand_names", "name string, normalized string, score int", [("Acme Labs", "acme labs", 90)])
def brand_names(spark):
    rows = [{"url": "https://acmelabs.example/", "raw_html": page("Acme Labs - Steel Tubes", "Acme Labs")}]
    return entities.brand_candidates(_parsed(spark, rows))


# --- answers ---


@case("barriers", "url string, blocked boolean, provider string, barrier string", [("/ok", False, None, None), ("/403", True, "Cloudflare", "WAF_HTTP_STATUS"), ("/429", True, None, "RATE_LIMIT"), ("/challenge", True, "Akamai", "BOT_CHALLENGE"), ("/captcha", False, None, None)])
def barriers(spark):
    rows = [{"url": f"{B}/ok", "raw_html": "<p>x"}, {"url": f"{B}/403", "status_code": 403, "response_headers": {"CF-Ray": ["1"]}}, {"url": f"{B}/429", "status_code": 429}, {"url": f"{B}/challenge", "raw_html": "Checking your browser before accessing", "response_headers": {"Server": ["AkamaiGHost"]}}, {"url": f"{B}/captcha", "raw_html": "word " * 250 + "recaptcha"}]
    return answers.waf(_crawl(spark, rows)).withColumn("url", _path("url"))


@case("snippet_controls", "url string, status string, max_snippet int, nosnippet_blocks int", [("/a", "ALLOWED", None, 0), ("/b", "MAX_SNIPPET", 20, 1), ("/c", "NOSNIPPET", None, 0), ("/d", "NOSNIPPET", 0, 0), ("/e", "MAX_SNIPPET", 5, 0)])
def snippet_controls(spark):
    meta = lambda c, b="": page(head=f"<meta name=robots content='{c}'>", body=b)
    rows = [{"url": f"{B}/a", "raw_html": page()}, {"url": f"{B}/b", "raw_html": meta("max-snippet:50, max-snippet:20", "<p data-nosnippet>x</p>")}, {"url": f"{B}/c", "raw_html": meta("nosnippet, max-snippet:-1")}, {"url": f"{B}/d", "raw_html": meta("max-snippet:0")}, {"url": f"{B}/e", "raw_html": meta("max-snippet:9"), "response_headers": {"X-Robots-Tag": ["max-snippet:5"]}}]
    return answers.snippet_controls(_parsed(spark, rows)).withColumn("url", _path("url"))


@case("content_availability", "url string, raw_words int, rendered_words int, needs_rendering boolean", [("/a", 1, 61, True), ("/b", 200, 251, False), ("/c", 10, None, False)])
def content_availability(spark):
    p = lambda rows: _parsed(spark, [{"url": f"{B}/{u}", "raw_html": f"<body>{'word ' * n}</body>"} for u, n in rows])
    return answers.content_availability(p([("a", 1), ("b", 200), ("c", 10)]), p([("a", 61), ("b", 251)])).withColumn("url", _path("url"))


@case("retrieval", "agent string, url string, robots string, status string", [("GPTBot", "/", "DISALLOWED", "DISALLOWED"), ("GPTBot", "/n", "DISALLOWED", "DISALLOWED"), ("GPTBot", "/w", "DISALLOWED", "BLOCKED"), ("Googlebot", "/", "ALLOWED", "ALLOWED"), ("Googlebot", "/n", "ALLOWED", "DISALLOWED"), ("Googlebot", "/w", "ALLOWED", "BLOCKED")])
def retrieval(spark):
    c = _crawl(spark, [{"url": f"{B}/", "raw_html": page()}, {"url": f"{B}/n", "raw_html": page(head="<meta name=robots content=noindex>")}, {"url": f"{B}/w", "raw_html": "access denied"}])
    bots = dims.bots(spark).where("agent in ('GPTBot', 'Googlebot')")
    paths = spark.createDataFrame([("a.example", x) for x in ("/", "/n", "/w")], "site string, path string")
    return answers.retrieval(eligibility.eligibility(parse.parse_pages(c)), answers.waf(c), robots.bot_matrix(_robots(spark), paths, bots), bots).withColumn("url", _path("url"))


_UNITS = "<h2>What is calibration?</h2><p>Calibration compares a device with a known standard.</p><h2>Steps</h2><ol><li>Open it</li><li>Close it</li></ol><h2>Data</h2><table><tr><td>A</td></tr><tr><td>B</td></tr></table><dl><dt>Tube</dt><dd>A pipe.</dd></dl><details><summary>Why so?</summary>Because.</details><p>A gauge is a device that measures.</p><p>Write to info@a.example for it.</p><p>Last updated on 4 May 2021 here.</p><p>Applicants must be of age and hold a valid licence.</p><blockquote>An example</blockquote>"


@case(
    "answer_units", "type string, heading string, text string",
    [
        ("DIRECT_ANSWER", "What is calibration?", "Calibration compares a device with a known standard."), ("PROCEDURE_STEPS", "Steps", "Open it Close it"), ("TABLE", "Data", "A B"), ("DEFINITION", "Data", "Tube A pipe."), ("FAQ", "Data", "Why so? Because."),
        ("DEFINITION", "Data", "A gauge is a device that measures."), ("LOCATION_CONTACT", "Data", "Write to info@a.example for it."), ("DATE_POLICY", "Data", "Last updated on 4 May 2021 here."), ("REQUIREMENTS_ELIGIBILITY", "Data", "Applicants must be of age and hold a valid licence."), ("EXAMPLE", "Data", "An example"),
    ],
)
def answer_units(spark):
    return answers.answer_units(_one(spark, page(body=_UNITS)))


@case("answer_clarity", "units int, definition boolean, direct_answer boolean, steps boolean, specification boolean, contact boolean, status string", [(10, True, True, True, True, True, "OBSERVED")])
def answer_clarity(spark):
    p = _one(spark, page(body=_UNITS))
    return answers.clarity(p, answers.answer_units(p))


@case("answer_summary", "type string, units int, pages int", [("DIRECT_ANSWER", 1, 1), ("PROCEDURE_STEPS", 1, 1), ("TABLE", 1, 1), ("DEFINITION", 2, 1), ("FAQ", 1, 1), ("LOCATION_CONTACT", 1, 1), ("DATE_POLICY", 1, 1), ("REQUIREMENTS_ELIGIBILITY", 1, 1), ("EXAMPLE", 1, 1)])
def answer_summary(spark):
    return answers.answer_summary(answers.answer_units(_one(spark, page(body=_UNITS))))


@case("topic_answers", "topic string, status string", [("steel", "EXPLAINED"), ("copper", "UNSUPPORTED_HEADING"), ("brass", "MENTIONED_ONLY"), ("zinc", "ABSENT")])
def topic_answers(spark):
    t = spark.createDataFrame([("s", "u", "steel", ["H1"]), ("s", "u", "copper", ["H2"]), ("s", "u", "brass", ["MAIN_CONTENT"]), ("s", "u", "zinc", ["URL_PATH"])], "site string, url string, topic string, locations array<string>")
    u = spark.createDataFrame([("s", "u", "k", "h", "Steel is a metal that is made of iron and some carbon."), ("s", "u", "l", "h", "copper and brass")], "site string, url string, key string, heading string, text string")
    return answers.topic_answers(t, u)


_CLAIMS = [
    ("/a", "<p>Acme Labs was founded in 1999.</p><p>We hold ISO 17025 since long ago.</p>"),
    ("/b", "<p>Acme Labs was founded in 2001.</p><p>The scope of ISO 17025 covers the calibration of scales and of all weights that we use in our laboratories every day.</p>"),
    ("/c", "<p>We are certified by ASTM 1234 only.</p>"),
]


@case("grounded_claims", "url string, type string, subject string, support string", [("/a", "founding", "1999", "CONTRADICTED_ON_SITE"), ("/b", "founding", "2001", "CONTRADICTED_ON_SITE"), ("/a", "accreditation", "ISO 17025", "SUPPORTED_ON_SITE"), ("/b", "accreditation", "ISO 17025", "PARTIALLY_SUPPORTED"), ("/c", "accreditation", "ASTM 1234", "UNCORROBORATED_ON_SITE")])
def grounded_claims(spark):
    p = _parsed(spark, [{"url": B + u, "raw_html": page(body=h)} for u, h in _CLAIMS])
    u = answers.answer_units(p)
    return answers.ground_claims(answers.claims(p, u), answers.passages(p, u)).withColumn("url", _path("url"))


@case("surfaces", "normalized string, surfaces int, status string", [("acme labs", 3, "CONSISTENT")])
def surfaces(spark):
    p = _one(spark, page("Acme Labs", "Welcome", "<p>Acme Labs makes scales.</p>", ORG))
    return answers.surfaces(p, entities.page_entities(p)).where("normalized = 'acme labs'")


@case("field_agreement", "field string, a string, b string, status string", [("phone", "+1 555 0100", "+15550100", "AGREEMENT"), ("phone", "+1 555 0100", "15550100", "PARTIAL_AGREEMENT"), ("name", "Acme Ltd", "ACME", "AGREEMENT"), ("name", "Acme Labs", "Acme", "PARTIAL_AGREEMENT"), ("address", "1 Main St", "2 High St", "DISAGREEMENT"), ("address", None, "x", "MISSING_STRUCTURED"), ("address", "x", None, "MISSING_VISIBLE"), ("address", None, None, "UNAVAILABLE")])
def field_agreement(spark):
    df = spark.createDataFrame([("phone", "+1 555 0100", "+15550100"), ("phone", "+1 555 0100", "15550100"), ("name", "Acme Ltd", "ACME"), ("name", "Acme Labs", "Acme"), ("address", "1 Main St", "2 High St"), ("address", None, "x"), ("address", "x", None), ("address", None, None)], "field string, a string, b string")
    return df.withColumn("status", answers.agreement(F.col("field"), F.col("a"), F.col("b")))


_IMAGES = "<img src=/a.png alt='Two words' width=10 height=10 loading=lazy><img src=/b.webp alt=''><figure><img src=/c.jpg><figcaption>Some caption</figcaption></figure><img src='data:x'><a href=/l><img src=/d.svg alt=logo>Go on</a><img src=/e.gif srcset='x 2x'>"


@case(
    "visual_assets", "src string, role string, status string",
    [("/a.png", "decorative", "ALT_REPRESENTED"), ("/b.webp", "decorative", "VISUAL_ONLY_OBSERVED"), ("/c.jpg", "informational", "CAPTION_REPRESENTED"), ("data:x", "informational", "VISUAL_ONLY_OBSERVED"), ("/d.svg", "informational", "TEXT_REPRESENTED"), ("/e.gif", "informational", "VISUAL_ONLY_OBSERVED")],
)
def visual_assets(spark):
    """A picture of 10 by 10 is decorative; in a main element one without an alt informs."""
    return answers.visual_assets(_one(spark, page(body=_IMAGES)))


@case("image_audit", "images int, missing_alt int, empty_alt int, unsized int, lazy int, lazy_early int, responsive int, modern int, legacy int", [(6, 3, 1, 5, 1, 1, 1, 1, 3)])
def image_audit(spark):
    return technical.image_summary(technical.images(_one(spark, page(body=_IMAGES))))


@case("agent_surfaces", "signal string, status string, name string", [("LOGIN_ACCOUNT_SURFACE", "PARTIALLY_LABELED", "Sign in"), ("SEARCH_FORM", "UNLABELED", ""), ("CONTACT_INQUIRY_FORM", "LABELED", "Send"), ("DESCRIPTIVE_NAVIGATION", "EXPLICIT", "Products"), ("DESCRIPTIVE_NAVIGATION", "AMBIGUOUS", "Click here"), ("SCHEMA_POTENTIAL_ACTION", "EXPLICIT", "SearchAction")])
def agent_surfaces(spark):
    h = "<nav><a href=/p>Products</a><a href=/q>Click here</a></nav><form><label for=u>User</label><input id=u><input type=password><button>Sign in</button></form><form role=search><input type=search></form><form><label>Text <textarea></textarea></label><input type=submit value=Send></form>"
    return answers.agent_surfaces(_one(spark, page(body=h, head='<script type="application/ld+json">{"@type":"WebSite","potentialAction":{"@type":"SearchAction"}}</script>')))


# --- external answers ---

_MATCHES = [("The lab is not accredited today", "The lab is accredited today", "MISMATCH"), ("alpha beta gamma delta", "alpha beta gamma delta words", "MATCHES_PAGE_EVIDENCE"), ("alpha beta zeta theta", "alpha other words here", "PARTIALLY_MATCHES"), ("xxxx", "yyyy", "UNABLE_TO_DETERMINE"), (None, "a", "UNABLE_TO_DETERMINE")]


@case("citation_match", "cited string, page string, verdict string", _MATCHES)
def citation_match(spark):
    return spark.createDataFrame([m[:2] for m in _MATCHES], "cited string, page string").withColumn("verdict", answers.citation_match(F.col("cited"), F.col("page")))


@case("citations", "id string, relation string, verdict string", [("1", "TARGET_PAGE_CITED", "MATCHES_PAGE_EVIDENCE"), ("2", "TARGET_DOMAIN_CITED", None), ("3", "NO_TARGET_CITATION", None), ("4", "CITATION_UNAVAILABLE", None)])
def citations(spark):
    cited = spark.createDataFrame([("a.example", "1", f"{B}/t/?utm_source=x", "Acme Labs was founded"), ("a.example", "2", f"{B}/zzz", "x"), ("a.example", "3", "https://o.example/", "x"), ("a.example", "4", None, "x")], "site string, id string, url string, text string")
    return answers.citations(cited, _parsed(spark)).withColumn("verdict", F.col("match"))


@case("mentions", "name string, position int, context string", [("Acme", 0, "Acme, acme and ACME."), ("Acme", 6, "Acme, acme and ACME."), ("Acme", 15, "Acme, acme and ACME.")])
def mentions(spark):
    return answers.mentions(spark.createDataFrame([("s", "1", "Acme, acme and ACME.")], "site string, id string, text string"), spark.createDataFrame([("s", "Acme")], "site string, name string"))


@case("trial_consistency", "queries int, mention_consistency double, citation_consistency double, mentioned int, cited int", [(2, 1.0, 0.5, 1, 1)])
def trial_consistency(spark):
    return answers.trial_consistency(spark.createDataFrame([("s", "q", 1, True, False), ("s", "q", 2, True, True), ("s", "r", 1, False, False)], "site string, query string, trial int, mentioned boolean, cited boolean"))


@case("external_queries", "category string, query string, provider string, trial int", [(c, q, "mock", t) for c, q in (("entity_identification", "What is Acme?"), ("service_discovery", "What services does Acme offer?"), ("location_contact", "How can I contact Acme?"), ("certification_standard", "Which certifications does Acme hold?"), ("comparison_decision", "How does Acme compare with alternatives?")) for t in (1, 2)])
def external_queries(spark):
    return answers.external_queries(spark.createDataFrame([("s", "Acme")], "site string, name string"), trials=2)


@case("redaction", "message string, shown string", [("api_key=abc token: x", "api_key=*** token: ***"), ('{"password":"p", "k":1}', '{"password":"***", "k":1}'), ("nothing", "nothing")])
def redaction(spark):
    return spark.createDataFrame([("api_key=abc token: x",), ('{"password":"p", "k":1}',), ("nothing",)], "message string").withColumn("shown", answers.redacted(F.col("message")))


# --- technique and scores ---


@case("security_findings", "code string", [(c,) for c in ("SEC_HSTS_SHORT_MAX_AGE", "SEC_CSP_UNSAFE_INLINE", "SEC_X_FRAME_OPTIONS_INVALID", "SEC_X_CONTENT_TYPE_OPTIONS_MISSING", "SEC_REFERRER_POLICY_MISSING", "SEC_PERMISSIONS_POLICY_MISSING", "SEC_SERVER_HEADER_VERSION_LEAK", "SEC_COOKIE_NO_SAMESITE", "SEC_PASSIVE_MIXED_CONTENT")])
def security_findings(spark):
    h = {"Strict-Transport-Security": ["max-age=5"], "Content-Security-Policy": ["script-src 'unsafe-inline'"], "X-Frame-Options": ["ALLOWALL"], "Set-Cookie": ["a=b; Secure; HttpOnly"], "Server": ["nginx/1.2"]}
    return technical.security(_one(spark, "<html><body><img src='http://x/a.png'></body></html>", response_headers=h))


@case("accessibility_findings", "code string", [(c,) for c in ("html-has-lang", "document-title", "label", "landmark-one-main", "duplicate-id", "button-name", "image-alt", "aria-roles", "link-name")])
def accessibility_findings(spark):
    return technical.accessibility(_one(spark, "<html><body><img src=a.png><button></button><a href=x></a><input type=text><div role=wrong id=i></div><p id=i></p></body></html>"))


@case("metric_bands", "metric string, value double, band string", [("LCP", 2.5, "GOOD"), ("LCP", 3.0, "NEEDS_IMPROVEMENT"), ("LCP", 4.1, "POOR"), ("CLS", 0.3, "POOR"), ("CLS", 0.1, "GOOD"), ("zz", 1.0, None)])
def metric_bands(spark):
    df = spark.createDataFrame([("LCP", 2.5), ("LCP", 3.0), ("LCP", 4.1), ("CLS", 0.3), ("CLS", 0.1), ("zz", 1.0)], "metric string, value double")
    return df.withColumn("band", technical.band(F.col("metric"), F.col("value")))


@case("answer_times", "site string, score int", [("fast", 85), ("fair", 65), ("slow", 35)])
def answer_times(spark):
    return technical.local_speed(spark.createDataFrame([("fast", 0.7), ("fast", 0.9), ("fair", 1.8), ("slow", 1.9)], "site string, seconds double"))


_HEALTH = [("a", 70.0, 90.0), ("b", None, 90.0), ("c", 70.0, None), ("d", None, None)]


@case("health", "site string, health int, mode string", [("a", 68, "5_engine"), ("b", 67, "4_engine_keyword"), ("c", 66, "4_engine"), ("d", 65, "3_engine")])
def health(spark):
    """30/25/20/15/10 of 80, 50, 60, 70, 90 is 68; 35/30/25/10 is 67; 35/30/20/15 is 65.5, to even 66; 44/37/19 is 65.1."""
    return scores.health(spark.createDataFrame([(s, 80, 50, 60, p, k) for s, p, k in _HEALTH], "site string, technical_score int, citability int, trust int, performance double, keyword double"))


@case("keyword_scores", "traffic int, score int", [(100_000, 95), (25_000, 80), (5_000, 65), (500, 50), (499, 35)])
def keyword_scores(spark):
    return spark.createDataFrame([(t,) for t in (100_000, 25_000, 5_000, 500, 499)], "traffic int").withColumn("score", scores.keyword_score(F.col("traffic")))


@case("technical_scores", "url string, technical_score int", [("/", 70), ("/s", 50), ("/t", 50), ("/copy", 50)])
def technical_scores(spark):
    """Less 10 for short titles, 20 without a description, and 20 without structured data, which the root page has."""
    return scores.technical_score(_parsed(spark)).withColumn("url", _path("url"))


@case("citability", "sources int, quotes int, statistics int, answer_first int, passage int, technical int, tone int, citability int", [(3, 3, 6, 0, 0, 0, 4, 42)])
def citability(spark):
    """One authority of three points, one quote, two figures in few words, and two words of authority with an author."""
    h = "<p>According to a study, 45% of 200 million agree.</p><blockquote>q</blockquote><a href='https://www.nih.gov/x'>x</a>"
    return scores.citability(_one(spark, page(body=h, head="<meta name=author content=A>")))


@case("trust", "technical int, identity int, social int, consistency int", [(5, 5, 3, 5)])
def trust(spark):
    h = {"Strict-Transport-Security": ["x"], "Content-Security-Policy": ["frame-ancestors 'none'"]}
    body = "<a href=/about>About</a><a href=/contact>Contact</a><a href=/privacy>P</a><a href=/terms>T</a><p>Reviews © 2024 updated</p><a href='https://www.linkedin.com/x'>in</a>"
    head = f"<meta name=author content=A><link rel=canonical href='{B}/'>" + ORG
    p = _one(spark, page("A example", "a", body, head), response_headers=h)
    return scores.trust(p, scores.citability(p))


@case("compare_sites", "metric string, winner string, delta double", [("health", "a", 10.0), ("trust", "b", -5.0), ("tech", "tie", 0.0)])
def compare_sites(spark):
    return scores.compare(spark.createDataFrame([("a", 70.0, 40.0, 1.0), ("b", 60.0, 45.0, 1.0)], "site string, health double, trust double, tech double"), "a", "b")


@case("ci_policy", "site string, findings int, failing int, passed boolean", [("a", 2, 1, False), ("b", 1, 0, True), ("c", 3, 0, False)])
def ci_policy(spark):
    f = spark.createDataFrame([("a", "AUTO_SAFE"), ("a", "HUMAN_REVIEW"), ("b", "HUMAN_REVIEW"), *[("c", "HUMAN_REVIEW")] * 3], "site string, classification string")
    return scores.ci_policy(f, max_findings=2)


@case(
    "conflict_rules", "category string, severity string",
    [
        ("AI_CRAWLER_MISCONFIG", "HIGH"), ("AI_CRAWLER_MISCONFIG", "HIGH"), ("CLIENT_RENDERED_SCHEMA", "HIGH"), ("DOM_HYDRATION_DIVERGENCE", "MEDIUM"), ("CSR_HEADING_DEPENDENCY", "MEDIUM"), ("AI_DISCOVERY_GAP", "LOW"), ("MIXED_CONTENT_SECURITY", "HIGH"), ("CLIENT_RENDERED_CONTENT", "HIGH"),
        ("DIVERGENT_ORGANIZATION_IDENTITY", "MEDIUM"), ("WAF_RETRIEVAL_BLOCK", "HIGH"), ("CONTENT_ANSWERABILITY_GAP", "MEDIUM"), ("SNIPPET_SUPPRESSION_CONFLICT", "HIGH"), ("STRUCTURED_VISIBLE_DIVERGENCE", "HIGH"), ("STRUCTURED_VISIBLE_DIVERGENCE", "MEDIUM"), ("ON_SITE_CLAIM_CONTRADICTION", "HIGH"),
        ("MULTIMODAL_INFORMATION_GAP", "MEDIUM"), ("ACTION_ACCESSIBLE_NAME_MISMATCH", "HIGH"), ("STRUCTURED_ACTION_CONTROL_CONFLICT", "MEDIUM"), ("EXTERNAL_CITATION_MATERIAL_MISMATCH", "HIGH"),
    ],
)
def conflict_rules(spark):
    """A page that breaks all rules at once, but for the one that needs search crawlers let in."""
    search = '<script type="application/ld+json">{"@type":"SearchAction","target":"https://a.example/find?q={q}"}</script>'
    raw = _one(spark, f"<html><head><title>Raw</title>{search}</head><body><div data-nosnippet><p>Write to us at a@a.example now</p></div><button aria-label='Cancel'>Submit</button><form action='/search'><input type=search></form></body></html>")
    live = _one(spark, page("Live", "Head", f"<p>{LONG * 2}</p>", ORG)).select("site", "url", F.col("p").alias("rendered"))
    agents = F.create_map(*[F.lit(x) for kv in (("OAI-SearchBot", "DISALLOWED"), ("GPTBot", "ALLOWED"), ("Googlebot", "DISALLOWED"), ("Google-Extended", "ALLOWED")) for x in kv])
    wide = raw.join(live, ["site", "url"]).withColumns({k: F.lit(True) for k in ("noindex", "blocked", "mixed_content")}).withColumns({k: F.lit(1) for k in ("unsupported_topics", "contradicted_claims", "visual_only", "citation_mismatch")})
    return scores.conflicts(wide.withColumns({"llms_txt": F.lit(False), "citability": F.lit(50), "alignment": F.lit("DIVERGENT_IDENTITY_SUSPECTED"), "agents": agents, "disagreements": F.array(F.lit("address"), F.lit("phone"))}))


@case("directive_conflict", "category string", [("AI_RETRIEVAL_DIRECTIVE_CONFLICT",)])
def directive_conflict(spark):
    return scores.conflicts(_one(spark, page()).withColumns({"noindex": F.lit(True), "agents": F.create_map(F.lit("OAI-SearchBot"), F.lit("ALLOWED"))}))


@case("no_conflicts", "category string", [("none",)])
def no_conflicts(spark):
    """A page with agreeing buttons, forms and data, and nothing known of it otherwise, breaks no rule."""
    search = '<script type="application/ld+json">{"@type":"SearchAction","target":{"urlTemplate":"https://a.example/search?q={q}"}}</script>'
    p = _one(spark, page(body="<p>Write to us at a@a.example now</p><button aria-label='Submit order'>Submit</button><form action='/search'><input type=search></form>", head=search))
    return scores.conflicts(p).groupBy().agg(F.count("*").alias("n")).select(F.when(F.col("n") == 0, "none").otherwise("some").alias("category"))


@case("gap_actions", "category string, points int, priority string, weaker string, stronger string", [("AI Discovery", 15, "HIGH", "b", "a"), ("Authority & Backlinks", 12, "HIGH", "b", "a"), ("Structured Data", 12, "HIGH", "b", "a"), ("GEO Optimization", 10, "MEDIUM", "b", "a"), ("Performance", 8, "MEDIUM", "b", "a"), ("Technical Trust", 8, "MEDIUM", "b", "a")])
def gap_actions(spark):
    rows = [("a", 70.0, True, True, 0.8, 5.0, 0, 200.0, 30), ("b", 60.0, False, False, 0.5, 2.0, 2, 700.0, 12)]
    return scores.gap_actions(spark.createDataFrame(rows, "site string, health double, llms_txt boolean, organization_schema boolean, answer_first double, technical_trust double, security_gaps int, ttfb_ms double, referring_domains int"), "b", "a")


@case("hidden_answers", "url string, visual_only int", [("/", 1)])
def hidden_answers(spark):
    """Of two images without words one stands under the heading of an answer."""
    p = _one(spark, page(body="<h2>Steps to calibrate</h2><ol><li>first do this</li><li>then do that</li></ol><figure><img src=a.png></figure><h2>Gallery</h2><figure><img src=b.png></figure>"))
    return answers.hidden_answers(answers.visual_assets(p), answers.answer_units(p)).withColumn("url", _path("url"))


@case("action_rules", "area string, priority int", [("conflicts", 1), ("security", 1), ("accessibility", 2), ("on_page", 2), ("on_page", 3), ("on_page", 2), ("schema", 2), ("schema", 3), ("trust", 3), ("performance", 2), ("discovery", 4), ("content", 3), ("content", 1), ("entity", 2), ("links", 3), ("links", 4)])
def action_rules(spark):
    wide = _one(spark, "<html><body>x</body></html>").withColumns({"conflicts": F.lit(1), "security": F.lit("CRITICAL"), "accessibility_critical": F.lit(1), "technical_trust": F.lit(1), "ttfb_ms": F.lit(1300.0), "llms_txt": F.lit(False), "answer_first_ratio": F.lit(0.1), "tier": F.lit("EMPTY"), "alignment": F.lit("DIVERGENT_IDENTITY_SUSPECTED"), "empty_anchors": F.lit(1), "generic_anchors": F.lit(5)})
    return scores.actions(wide)


@case("remediation_rules", "remediation string, classification string", [("TITLE_MISSING", "AUTO_SAFE"), ("DESCRIPTION_MISSING", "HUMAN_REVIEW"), ("CANONICAL_MISSING", "AUTO_SAFE"), ("IMAGE_ALT", "HUMAN_REVIEW"), ("ROBOTS_MISSING", "AUTO_SAFE"), ("SCHEMA_DIVERGENCE", "HUMAN_REVIEW"), ("LABEL_MISSING", "AUTO_SAFE"), ("CSP_MISSING", "HUMAN_REVIEW"), ("HSTS_MISSING", "AUTO_SAFE"), ("ANCHOR_EMPTY", "HUMAN_REVIEW"), ("ANSWER_UNSUPPORTED", "HUMAN_REVIEW")])
def remediation_rules(spark):
    wide = _one(spark, "<html><body><img src=a><input></body></html>").withColumns({"robots_txt": F.lit(False), "alignment": F.lit("DIVERGENT_IDENTITY_SUSPECTED"), "csp_missing": F.lit(True), "hsts_missing": F.lit(True), "empty_anchors": F.lit(1), "unsupported_topics": F.lit(1)})
    return scores.remediations(wide)


@case("provenance", "fact string, source string, nature string, value string", [("title", "static_html", "OBSERVED", "T"), ("meta_description", "static_html", "UNAVAILABLE", None), ("h1", "static_html", "OBSERVED", "H"), ("canonical", "static_html", "UNAVAILABLE", ""), ("schema_types", "structured_data", "OBSERVED", "Organization"), ("words", "main_content", "OBSERVED", "2"), ("images", "static_html", "OBSERVED", "0"), ("links", "static_html", "OBSERVED", "0")])
def provenance(spark):
    return scores.provenance(_one(spark, page("T", "H", "<p>word</p>", ORG)))


@case("fix_texts", "meta_tags string, llms_line string", [(f'<title>A &amp; B</title>\n<meta name="description" content="Head word">\n<link rel="canonical" href="{B}/">', f"- [A & B]({B}/): Head word")])
def fix_texts(spark):
    return scores.fixes(_one(spark, page("A &amp; B", "Head", "<p>word</p>")))


# --- cohorts and reports ---


def _packages(spark):
    rows = [("a", 3, 3, ["Organization", "FAQPage"], 300, 100.0, 1, {"FAQ": 2, "TABLE": 1}, ["acme"], ["steel"], ["steel", "tubes"], {"informational": 2, "commercial": 1}, 80.0, 40.0, 60.0, 66.0), ("b", 2, 2, [], 100, 50.0, 2, {"DEFINITION": 1}, ["zeta"], [], ["tubes"], {"commercial": 2}, 60.0, 50.0, 40.0, 52.0)]
    df = spark.createDataFrame(rows, "site string, pages int, ok_pages int, schema_types array<string>, words bigint, mean_words double, thin_pages int, units map<string,bigint>, entities array<string>, services array<string>, topics array<string>, intents map<string,bigint>, technical_score double, citability double, trust double, health double")
    return df.withColumn("dimensions", F.create_map(F.lit("content"), F.lit("AVAILABLE"), F.lit("answers"), F.when(F.col("site") == "a", "AVAILABLE").otherwise("UNAVAILABLE")))


@case("site_reviews", "site string, answer_units int, main_intent string, thin_share double, absent string", [("a", 3, "informational", 0.333, "DEFINITION|LOCATION_CONTACT"), ("b", 1, "commercial", 1.0, "FAQ|TABLE|LOCATION_CONTACT|STRUCTURED_DATA")])
def site_reviews(spark):
    return cohort.reviews(_packages(spark)).withColumns(_join("absent"))


@case("cohort_voids", "void string, present string, absent string, state string", [("FAQ", "a", "b", "UNIQUE"), ("DEFINITION", "b", "a", "UNIQUE"), ("DIRECT_ANSWER", "", "a|b", "INSUFFICIENT_EVIDENCE"), ("PROCEDURE", "", "a|b", "INSUFFICIENT_EVIDENCE"), ("TABLE_OR_SPECIFICATION", "a", "b", "UNIQUE"), ("REQUIREMENTS", "", "a|b", "INSUFFICIENT_EVIDENCE"), ("CONTACT", "", "a|b", "INSUFFICIENT_EVIDENCE"), ("POLICY_DATES", "", "a|b", "INSUFFICIENT_EVIDENCE"), ("ORGANIZATION_SCHEMA", "a", "b", "UNIQUE"), ("LOCAL_SCHEMA", "", "a|b", "INSUFFICIENT_EVIDENCE"), ("ANY_SCHEMA", "a", "b", "UNIQUE"), ("SERVICES", "a", "b", "UNIQUE")])
def cohort_voids(spark):
    return cohort.voids(cohort.reviews(_packages(spark))).withColumns(_join("present", "absent"))


@case("cohort_target", "metric string, target double, cohort double, delta double, standing string", [("technical_score", 80.0, 60.0, 20.0, "ABOVE"), ("citability", 40.0, 50.0, -10.0, "BELOW"), ("trust", 60.0, 40.0, 20.0, "ABOVE"), ("health", 66.0, 52.0, 14.0, "ABOVE"), ("mean_words", 100.0, 50.0, 50.0, "ABOVE")])
def cohort_target(spark):
    return cohort.target_vs_cohort(_packages(spark), "a", ("technical_score", "citability", "trust", "health", "mean_words"))


@case("cohort_facets", "site string, facet string, rank int", [("a", "answerability", 1), ("b", "answerability", 2), ("a", "technical", 1), ("b", "technical", 2), ("a", "trust", 1), ("b", "trust", 2), ("a", "citability", 2), ("b", "citability", 1), ("a", "depth", 1), ("b", "depth", 2), ("a", "thinness", 2), ("b", "thinness", 1), ("a", "topic_breadth", 1), ("b", "topic_breadth", 2)])
def cohort_facets(spark):
    return cohort.facets(cohort.reviews(_packages(spark)))


@case("cohort_uncertainty", "dimension string, state string, sites int", [("content", "AVAILABLE", 2), ("answers", "AVAILABLE", 1), ("answers", "UNAVAILABLE", 1)])
def cohort_uncertainty(spark):
    return cohort.uncertainty(_packages(spark))


@case("cohort_matrix", "metric string, a double, b double", [("pages", 3.0, 2.0), ("words", 300.0, 100.0), ("technical_score", 80.0, 60.0), ("citability", 40.0, 50.0), ("trust", 60.0, 40.0), ("health", 66.0, 52.0)])
def cohort_matrix(spark):
    return cohort.cross_site_matrix(_packages(spark))


@case("cohort_statements", "site string, kind string, statement string", [("a", "FACT", "3 pages with 300 words"), ("a", "FACT", "3 answer units"), ("a", "ANALYSIS", "mostly informational pages"), ("a", "ANALYSIS", "absent: DEFINITION, LOCATION_CONTACT"), ("b", "FACT", "2 pages with 100 words"), ("b", "FACT", "1 answer units"), ("b", "ANALYSIS", "mostly commercial pages"), ("b", "ANALYSIS", "absent: FAQ, TABLE, LOCATION_CONTACT, STRUCTURED_DATA")])
def cohort_statements(spark):
    return cohort.facts_and_analyses(cohort.reviews(_packages(spark)))


@case("cohort_items", "item string, sites int, state string", [("x", 2, "COMMON"), ("y", 1, "UNIQUE"), ("z", 1, "UNIQUE"), ("q", 1, "UNIQUE")])
def cohort_items(spark):
    return cohort.frequency(spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "x"), ("b", "z"), ("c", "q"), ("a", "x")], "site string, item string"))


@case("cohort_overlap", "site_a string, site_b string, shared int, similarity double", [("a", "b", 1, 0.3333)])
def cohort_overlap(spark):
    return cohort.overlap_matrix(spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "x"), ("b", "z"), ("c", "q")], "site string, item string"))


@case("report_lines", "pos int, line string", [(0, "# a"), (1, ""), (2, "| Measure | Value |"), (3, "|---|---|"), (4, "| health | 66.0 |"), (5, "| trust | unavailable |")])
def report_lines(spark):
    return reports.markdown_lines(spark.createDataFrame([("a", 66.0, None)], "site string, health double, trust double"))
