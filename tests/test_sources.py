from pyspark.sql import functions as F

from loomweb.functions import dims
from loomweb.sources import console, parse, robots, sitemaps
from loomweb.sources import crawl as source

PAGE = """<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title> T </title><meta name="description" content="d"><meta name="robots" content="NoIndex, follow">
<link rel="canonical" href="/c"><script type="application/ld+json">{"@graph":[{"@type":"Organization","name":"Acme Inc.","sameAs":["https://x.com/a"],"telephone":"+1 2"}]}</script></head><body>
<nav><a href="/n">Nav</a></nav><main><h1>One</h1><p>The first paragraph has more than fifteen words in it so that it is taken as the main text.</p><h3>Skip</h3><img src="a.png"><a href="/b"><img alt="Pic"></a><a href="#"></a>
<ol><li>Do this</li><li>Then that</li></ol></main><form role="search"><input type="text" id="q"></form></body></html>"""


def test_page_record():
    r = parse.page_record(PAGE)
    assert (r["title"], r["h1"], r["main_method"], r["canonical"], r["lang"], r["charset"]) == ("T", ["One"], "SEMANTIC_MAIN", ["/c"], "en", True)
    assert [(h["level"], h["text"]) for h in r["headings"]] == [(1, "One"), (3, "Skip")]
    assert [x["href"] for x in r["links"]] == ["/n", "/b", "#"] and r["links"][1]["alt"] == "Pic"
    assert r["forms"][0]["purpose"] == "SEARCH_FORM" and r["unlabelled"] == 1 and r["images_without_alt"] == 1
    assert "Nav" not in r["main_text"] and r["units"][-1]["kind"] == "PROCEDURE_STEPS"


def test_parse_null_and_empty(spark):
    rows = spark.createDataFrame([("s", "u1", None), ("s", "u2", ""), ("s", "u3", PAGE)], "site string, url string, raw_html string")
    got = {r.url: r.p for r in parse.parse_pages(rows).collect()}
    assert got["u1"] is None and got["u2"] is None and got["u3"].title == "T" and got["u3"].meta["robots"] == "NoIndex, follow"


ROBOTS = """# c
User-agent: a-bot
User-agent: B
Disallow: /x
Allow: /x/y$
Disallow: /*.pdf
User-agent: *
Disallow:
User-agent: GPTBot
Disallow: /
Sitemap: https://s/map.xml"""


def test_robots(spark):
    r = spark.createDataFrame([("s", 200, ROBOTS), ("t", 404, "User-agent: *\nDisallow: /")], "site string, status_code int, content string")
    paths = spark.createDataFrame([(s, p) for s in ("s", "t") for p in ("/", "/x/y", "/x/yz", "/d/a.pdf")], "site string, path string")
    bots = spark.createDataFrame([("A-Bot",), ("GPTBot",), ("Other",)], "agent string")
    m = {(x.site, x.path, x.agent): (x.status, x.rule_source, x.matched) for x in robots.bot_matrix(r, paths, bots).collect()}
    assert len(m) == 24
    assert m["s", "/x/y", "A-Bot"] == ("ALLOWED", "explicit", "Allow: /x/y$") and m["s", "/x/yz", "A-Bot"][0] == "DISALLOWED"
    assert m["s", "/d/a.pdf", "A-Bot"][0] == "DISALLOWED" and m["s", "/", "A-Bot"] == ("ALLOWED", "explicit", None)
    assert m["s", "/", "GPTBot"][0] == "DISALLOWED" and m["s", "/x/y", "Other"] == ("ALLOWED", "wildcard", "Allow: /")
    assert m["t", "/", "Other"] == ("ALLOWED", "default_allow", None)
    assert sorted(x.sitemap for x in robots.sitemaps_of(r).collect()) == ["https://s/map.xml", "https://t/sitemap.xml", "https://t/sitemap_index.xml"]
    assert robots.bot_recommendations(robots.bot_matrix(r, paths, dims.bots(spark)), dims.bots(spark)).count() > 0


def test_sitemap_documents():
    p = sitemaps.parse_sitemap
    good = b'<?xml version="1.0"?><urlset xmlns="http://x"><url><loc>https://a/1</loc><priority>0.5</priority></url><url><loc>https://a/1/</loc></url><url><loc>https://a/2</loc></url></urlset>'
    assert [u["loc"] for u in p(good)["urls"]] == ["https://a/1", "https://a/2"] and p(good)["urls"][0]["priority"] == 0.5
    assert p("<!doctype html><html>")["format"] == "HTML_ERROR_PAGE" and p("")["format"] == "UNKNOWN" and p("<nonsense")["format"] == "MALFORMED"
    assert p("<sitemapindex><sitemap><loc>https://a/s</loc></sitemap></sitemapindex>")["children"] == ["https://a/s"]
    broken = "<urlset><url><loc>https://a/1?x=1&y=2</loc><lastmod>2020</lastmod></url><url><loc>https://a/2</loc>"
    assert [u["loc"] for u in p(broken)["urls"]] == ["https://a/1?x=1&y=2", "https://a/2"]


def test_traverse(spark):
    index = lambda *c: "<sitemapindex>" + "".join(f"<sitemap><loc>{x}</loc></sitemap>" for x in c) + "</sitemapindex>"
    leaf = "<urlset><url><loc>https://a/1</loc></url></urlset>"
    docs = spark.createDataFrame([("a", "r", 200, index("m", "gone", "r")), ("a", "m", 200, index("l")), ("a", "l", 200, leaf), ("a", "gone", 500, "")], "site string, sitemap string, status_code int, body string")
    got = {(r.sitemap, r.depth): r.status for r in sitemaps.traverse(spark.createDataFrame([("a", "r")], "site string, sitemap string"), docs).collect()}
    assert got == {("r", 0): "SUCCESS", ("m", 1): "SUCCESS", ("gone", 1): "HTTP_ERROR", ("r", 1): "LOOP_DETECTED", ("l", 2): "SUCCESS"}


def test_console(spark):
    df = console.read_console(spark, "loomweb.sources.console:sample_rows", 25_010)
    assert df.count() == 25_010 and df.rdd.getNumPartitions() == 2


def test_llms_txt(spark):
    text = "# Name\n> About it\n" + "- [a](https://a) " + "word " * 40
    got = robots.llms_txt(spark.createDataFrame([("a", text), ("b", "nothing"), ("c", None)], "site string, content string")).orderBy("site").collect()
    assert [r.valid for r in got] == [True, False, False]


def test_rendered(spark):
    raw = spark.createDataFrame([("u", "<p>x"), ("v", "<p>y")], "url string, raw_html string")
    ren = spark.createDataFrame([("u", "<p>" + "long " * 20), ("v", "z")], "url string, raw_html string")
    got = {r.url: r.html_source for r in source.primary_html(raw, ren).collect()}
    assert got == {"u": "rendered", "v": "raw"}
    assert source.from_pages(spark.createDataFrame([(1, "http://a.b.example/x", "h")], "page_id int, url string, html string"), True).select(F.col("site")).first()[0] == "b.example"
