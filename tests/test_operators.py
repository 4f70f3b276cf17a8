import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomweb.operators import answers, chains, cohort, content, crawl, eligibility, entities, graph, links, scores, search, technical
from loomweb.plans import api, reports
from loomweb.sources import parse
from loomweb.sources import crawl as source

B = "https://a.example"


def page(title="Title", h1="Head", body="", head=""):
    return f"<html lang='en'><head><title>{title}</title>{head}</head><body><main><h1>{h1}</h1>{body}</main></body></html>"


LONG = "The scope of calibration services that the laboratory offers to all of its customers in the region. " * 12


@pytest.fixture(scope="module")
def site(spark):
    org = '<script type="application/ld+json">{"@type":"Organization","name":"Acme Labs Ltd","telephone":"+1 555 0100","sameAs":["https://x.com/acme"]}</script>'
    rows = [
        {"url": f"{B}/", "depth": 0, "discovery_source": "seed", "raw_html": page("Acme Labs - Calibration", "Calibration Services", f"<p>{LONG}</p><a href='/s'>Services</a><a href='/s'>again</a><a href='/gone'>read more</a><a href='https://other.example/'>Out</a>", org)},
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
    return source.crawl_frame(spark, [{"site": "a.example"} | r for r in rows])


@pytest.fixture(scope="module")
def parsed(site):
    p = parse.parse_pages(site).cache()
    return p


@pytest.fixture(scope="module")
def link(parsed, site):
    return links.extract_links(parsed.where("status_code = 200"), crawl=site).cache()


def test_admission(spark):
    urls = ["", "/a.pdf", "https://b.example/", "/a", "/a/", "/a?utm_source=1"] + [f"/q?i={i}" for i in range(25)] + [f"/r{i}" for i in range(60)]
    c = spark.createDataFrame([("s", i, u, 1, f"{B}/") for i, u in enumerate(urls)] + [("s", 999, "/deep", 9, f"{B}/")], "site string, seq int, url string, depth int, parent_url string")
    got = {r.url: r.verdict for r in crawl.admit(c, F.lit(f"{B}/")).collect()}
    assert [got[u] for u in urls[:6]] == ["EMPTY", "NON_HTML", "OFF_DOMAIN", "ADMITTED", "DUPLICATE", "DUPLICATE"] and got["/deep"] == "TOO_DEEP"
    v = list(got.values())
    assert v.count("VARIANT") == 5 and v.count("ADMITTED") == 50 and v.count("BUDGET") == 1 + 20 + 60 - 50


def test_lookup(spark):
    c = source.crawl_frame(spark, [{"url": f"{B}/p?id=1"}, {"url": f"{B}/p?id=2"}, {"url": f"{B}/q/"}, {"url": f"{B}/r?utm_source=z"}])
    k = spark.createDataFrame([("site", u) for u in (f"{B}/p?id=2", f"{B}/p?id=3", f"{B}/q", f"{B}/r?utm_source=y", f"{B}//q")], "site string, target string")
    got = {r.target: r.found for r in crawl.lookup(k, c).collect()}
    assert got == {f"{B}/p?id=2": f"{B}/p?id=2", f"{B}/p?id=3": None, f"{B}/q": f"{B}/q/", f"{B}/r?utm_source=y": None, f"{B}//q": f"{B}/q/"}


def test_rollup(parsed):
    r = crawl.rollup(parsed).first()
    assert (r.fetched, r.redirected, r.failed, r.completeness) == (4, 7, 1, "CRAWL_COMPLETE") and r.duplicate_titles == ["Testing"] and r.broken == [f"{B}/gone"]


def test_links(link, site):
    assert links.link_evidence(link).where(F.col("source_url") == f"{B}/").select("internal", "external", "generic_anchors").first() == (3, 1, 1)
    b = links.broken_links(link, site).collect()
    assert [(r.source_url, r.target_url, r.status_code) for r in b] == [(f"{B}/", f"{B}/gone", 404)]
    assert [r.anchor for r in links.ambiguous_anchors(link).collect()] == ["read more"]


def test_graph(site, link):
    nodes, edges = graph.link_graph(site.where("status_code = 200"), link)
    n = {r.id: r for r in nodes.collect()}
    assert n[f"{B}/"].orphan_status == "ROOT" and n[f"{B}/copy"].orphan_status == "POTENTIAL_ORPHAN" and n[f"{B}/copy"].is_dead_end
    assert [n[f"{B}{p}"].click_depth for p in ("/", "/s", "/t", "/gone", "/copy")] == [0, 1, 2, 1, None]
    assert n[f"{B}/s"].inbound == 2 and n[f"{B}/s"].total_inbound == 3 and abs(sum(r.equity for r in n.values()) - 1) < 1e-4
    ids = sorted(n)
    w = np.zeros((len(ids), len(ids)))
    for e in edges.collect():
        if e.src != e.dst:
            w[ids.index(e.src), ids.index(e.dst)] = e.weight
    out = w.sum(1, keepdims=True)
    m = np.where(out > 0, w / np.maximum(out, 1), 1 / len(ids))
    r = np.full(len(ids), 1 / len(ids))
    for _ in range(300):
        r = 0.85 * r @ m + 0.15 / len(ids)
    assert np.allclose(r, [n[i].equity for i in ids], atol=2e-6)
    s = graph.graph_summary(nodes, edges, graph.weak_components(nodes, edges), graph.strong_components(nodes, edges)).first()
    assert (s.weak_components, s.strong_components, s.orphans) == (2, 3, 1)


def test_components_random(spark):
    rng = random.Random(1)
    ids = [f"n{i:02d}" for i in range(14)]
    es = {(rng.choice(ids), rng.choice(ids)) for _ in range(18)}
    nodes = spark.createDataFrame([("s", i) for i in ids], "site string, id string")
    edges = spark.createDataFrame([("s", a, b, 1) for a, b in es], "site string, src string, dst string, weight int")
    reach = {i: {i} for i in ids}
    for _ in ids:
        for a, b in es:
            for i in ids:
                if a in reach[i]:
                    reach[i].add(b)
    got = {r.id: r.component for r in graph.strong_components(nodes, edges).collect()}
    assert all((got[a] == got[b]) == (b in reach[a] and a in reach[b]) for a in ids for b in ids)


def test_redirects(site):
    got = {r.initial_url.removeprefix(B): r for r in chains.redirect_chains(site).collect()}
    assert {k: v.status for k, v in got.items()} == {"/old": "MULTI_HOP", "/older": "RESOLVED", "/loop": "LOOP", "/loop2": "LOOP", "/lost": "MISSING_LOCATION", "/out": "UNVERIFIED_TARGET", "/dead": "BROKEN_TARGET"}
    assert got["/old"].final_url == f"{B}/s" and got["/old"].total_hops == 2 and got["/old"].total_latency_ms == 300.0 and got["/loop"].has_loop


def test_redirect_limit(spark):
    rows = [{"url": f"{B}/{i}", "status_code": 301, "crawl_status": "REDIRECTED", "redirect_url": f"{B}/{i + 1}"} for i in range(12)] + [{"url": f"{B}/12"}]
    got = {r.initial_url: (r.status, r.total_hops) for r in chains.redirect_chains(source.crawl_frame(spark, rows)).collect()}
    assert got[f"{B}/0"] == ("EXCEEDED_MAX_HOPS", 10) and got[f"{B}/3"] == ("MULTI_HOP", 9)


def test_canonicals(spark):
    links_ = {"/self": "/self", "/a": "/b", "/b": "/b", "/c": "/a", "/x": "/y", "/y": "/x", "/r": "/redir", "/d": "/dead", "/u": "https://other.example/", "/bad": "ftp://z", "/none": None}
    rows = [{"url": B + k, "raw_html": page(head=f'<link rel="canonical" href="{v}">' if v else "")} for k, v in links_.items()]
    rows += [{"url": f"{B}/redir", "status_code": 301, "crawl_status": "REDIRECTED", "redirect_url": f"{B}/self"}, {"url": f"{B}/dead", "status_code": 500, "crawl_status": "FAILED"}]
    c = source.crawl_frame(spark, rows)
    p = parse.parse_pages(c)
    got = {r.source_url.removeprefix(B): r for r in chains.canonical_chains(c, eligibility.canonical_of(p), chains.redirect_chains(c)).collect()}
    want = {"/self": "SELF_REFERENCING", "/a": "RESOLVED", "/b": "SELF_REFERENCING", "/c": "CHAIN", "/x": "LOOP", "/y": "LOOP", "/r": "POINTS_TO_REDIRECT", "/d": "POINTS_TO_DEAD_URL", "/u": "UNVERIFIED_TARGET", "/bad": "INVALID_TARGET", "/none": "MISSING"}
    assert {k: got[k].status for k in want} == want and got["/c"].total_hops == 2 and got["/r"].final == f"{B}/self"
    e = {r.url.removeprefix(B): r.canonicalization for r in eligibility.eligibility(p).collect()}
    assert (e["/self"], e["/a"], e["/d"], e["/u"], e["/bad"], e["/none"]) == ("SELF_REFERENCING", "CANONICALIZED_ELSEWHERE", "INVALID_TARGET", "CROSS_DOMAIN", "INVALID_TARGET", "MISSING")


def test_indexability(spark):
    rows = [(200, ["noindex"], [], True, "NOINDEX"), (200, ["nofollow"], [], True, "INDEXABLE"), (200, [], ["none"], True, "NOINDEX"), (301, [], [], True, "REDIRECT"), (404, [], [], True, "ERROR"), (0, [], [], False, "ERROR"), (0, [], [], True, "INDEXABLE"), (100, [], [], True, "UNKNOWN")]
    df = spark.createDataFrame(rows, "c int, m array<string>, x array<string>, h boolean, want string")
    assert df.select(eligibility.indexability(F.col("c"), F.col("m"), F.col("x"), F.col("h")).alias("g"), "want").where("g <> want").count() == 0


def test_representations(spark):
    rows = [{"url": u, "raw_html": page(body=f"<p>{t}</p>")} for u, t in ((f"{B}/p", "same"), (f"{B}/p/", "same"), ("http://a.example/q", "one"), (f"{B}/q", "two"), (f"{B}/z?a=1&b=2", "k"), (f"{B}/z?b=2&a=1", "k"))]
    got = {(r.anomaly_type, r.primary_url, r.evidence_type) for r in eligibility.representations(parse.parse_pages(source.crawl_frame(spark, rows))).collect()}
    assert got == {("TRAILING_SLASH", f"{B}/p", "IDENTICAL_EXTRACTED_TEXT"), ("PROTOCOL_HTTP_HTTPS", "http://a.example/q", "DISTINCT_CONTENT_VARIANT"), ("QUERY_PARAM_ORDER", f"{B}/z?a=1&b=2", "IDENTICAL_EXTRACTED_TEXT")}


def test_near_duplicates(spark):
    rng = random.Random(3)
    base = [f"w{rng.randrange(500)}" for _ in range(90)]
    texts = [" ".join(base)]
    for k in (1, 2, 3, 4, 5, 6, 8):
        w = list(base)
        for i in rng.sample(range(90), k):
            w[i] = "zz"
        texts.append(" ".join(w))
    texts += ["one two", "two one", "one two three", "", "one two", " ".join(base) + "!"]
    c = spark.createDataFrame([("s", f"u{i:02d}", t) for i, t in enumerate(texts)], "site string, url string, main_text string")
    from loomweb.functions import text

    c = c.withColumn("words", text.word_count(F.col("main_text"))).withColumn("content_hash", text.content_hash(F.col("main_text"))).withColumn("simhash", text.simhash(F.col("main_text")))
    got = {(r.url_a, r.url_b): r.similarity for r in content.near_duplicates(c).collect()}
    want = {}
    norm = [t.replace("!", "").split() for t in texts]
    for i, a in enumerate(norm):
        for j in range(i + 1, len(norm)):
            b = norm[j]
            if not a or not b or a == b:
                continue
            f = (lambda w: {tuple(w[x : x + 3]) for x in range(len(w) - 2)}) if min(len(a), len(b)) >= 3 else set
            s = round(len(f(a) & f(b)) / len(f(a) | f(b)), 4)
            if s >= 0.8:
                want[f"u{i:02d}", f"u{j:02d}"] = round(s * 100, 1)
    assert got == want and want


def test_content(parsed):
    c = content.page_content(parsed.where("status_code = 200")).cache()
    r = {x.url.removeprefix(B): x for x in c.collect()}
    assert r["/s"].alignment.status == "STRONG_ALIGNMENT" and r["/s"].headings_evidence.valid and r["/"].main_method == "SEMANTIC_MAIN"
    assert [x.urls for x in content.exact_duplicates(c).collect()] == []
    assert content.heading_skips(parsed).count() == 0


def test_search(parsed):
    p = parsed.where("status_code = 200")
    s = search.signals(p).cache()
    got = {(r.url.removeprefix(B), r.term): r for r in s.collect()}
    assert got["/s", "calibration services"].confidence == "DIRECT" and {"TITLE", "H1"} <= set(got["/s", "calibration services"].locations)
    t = search.page_topics(search.topic_members(s)).cache()
    assert t.where("topic = 'calibration services'").count() == 4
    rel = search.topic_relations(t).where("relation in ('SUBTOPIC_OF', 'LEXICAL_OVERLAP')").select("topic_a", "topic_b").collect()
    assert ("calibration services", "calibration") in {tuple(r) for r in rel}
    c = search.concepts(s, t, p).cache()
    i = search.intents(search.intent_evidence(p), p).cache()
    assert {r.url.removeprefix(B): r.intent for r in i.collect()}["/s"] == "informational"
    pages = {r.concept: r for r in search.concept_pages(c).collect()}
    assert pages["calibration services"].overlap and len(pages["calibration services"].direct) >= 2
    assert search.coverage(c, t, i).where("topic = 'calibration services'").first().pages >= 2
    assert search.depth_gaps(c, t, p).where(F.col("related_url") == f"{B}/s").count() >= 1
    assert search.topic_gaps(c, t).where("size(missing) < 2").count() == 0


def test_entities(parsed):
    e = entities.page_entities(parsed.where("status_code = 200")).cache()
    r = [x for x in e.collect() if x.url == f"{B}/" and x.type == "ORGANIZATION"]
    assert len(r) == 1 and r[0].normalized == "acme labs" and r[0].same_as == ["https://x.com/acme"]
    assert entities.primary_organization(e).first().normalized == "acme labs"
    assert entities.entity_relations(e).where("relation = 'organization_to_social_profile'").count() == 1


def test_technical(spark):
    h = {"Strict-Transport-Security": ["max-age=5"], "Content-Security-Policy": ["script-src 'unsafe-inline'"], "X-Frame-Options": ["ALLOWALL"], "Set-Cookie": ["a=b; Secure; HttpOnly"], "Server": ["nginx/1.2"]}
    rows = [{"url": f"{B}/", "response_headers": h, "raw_html": "<html><body><img src='http://x/a.png'><button></button><input type=text><div role=wrong id=i></div><p id=i></p></body></html>"}]
    p = parse.parse_pages(source.crawl_frame(spark, rows))
    codes = {r.code for r in technical.security(p).collect()}
    assert codes == {"SEC_HSTS_SHORT_MAX_AGE", "SEC_CSP_UNSAFE_INLINE", "SEC_X_FRAME_OPTIONS_INVALID", "SEC_X_CONTENT_TYPE_OPTIONS_MISSING", "SEC_REFERRER_POLICY_MISSING", "SEC_PERMISSIONS_POLICY_MISSING", "SEC_SERVER_HEADER_VERSION_LEAK", "SEC_COOKIE_NO_SAMESITE", "SEC_PASSIVE_MIXED_CONTENT"}
    a = technical.accessibility(p)
    assert {r.code for r in a.collect()} == {"html-has-lang", "document-title", "label", "landmark-one-main", "duplicate-id", "button-name", "image-alt", "aria-roles"}
    assert technical.accessibility_status(a, p).first().status == "FAIL"
    v = spark.createDataFrame([("LCP", 2.5, "GOOD"), ("LCP", 3.0, "NEEDS_IMPROVEMENT"), ("CLS", 0.3, "POOR"), ("zz", 1.0, None)], "m string, v double, want string")
    assert v.select(technical.band(F.col("m"), F.col("v")).alias("g"), "want").where("not (g <=> want)").count() == 0


def test_answers_and_claims(parsed):
    p = parsed.where("status_code = 200")
    u = answers.answer_units(p).cache()
    assert {"DIRECT_ANSWER", "TABLE"} <= {r.type for r in u.where(F.col("url") == f"{B}/s").collect()}
    g = answers.ground_claims(answers.claims(p, u), answers.passages(p, u))
    f = {r.url.removeprefix(B): r.support for r in g.where("type = 'founding'").collect()}
    assert f == {"/t": "CONTRADICTED_ON_SITE", "/copy": "CONTRADICTED_ON_SITE"}


def test_external(spark):
    m = spark.createDataFrame([("The lab is not accredited today", "The lab is accredited today", "MISMATCH"), ("alpha beta gamma delta", "alpha beta gamma delta words", "MATCHES_PAGE_EVIDENCE"), ("alpha beta zeta theta", "alpha other words here", "PARTIALLY_MATCHES"), ("xxxx", "yyyy", "UNABLE_TO_DETERMINE"), (None, "a", "UNABLE_TO_DETERMINE")], "a string, b string, want string")
    assert m.select(answers.citation_match(F.col("a"), F.col("b")).alias("g"), "want").where("g <> want").count() == 0
    ans = spark.createDataFrame([("s", "1", "Acme, acme and ACME.")], "site string, id string, text string")
    assert sorted(r.position for r in answers.mentions(ans, spark.createDataFrame([("s", "Acme")], "site string, name string")).collect()) == [0, 6, 15]
    assert spark.createDataFrame([("api_key=abc token: x",)], "m string").select(answers.redacted(F.col("m"))).first()[0] == "api_key=*** token: ***"
    o = spark.createDataFrame([("s", "q", 1, True, False), ("s", "q", 2, True, True), ("s", "r", 1, False, False)], "site string, query string, trial int, mentioned boolean, cited boolean")
    r = answers.trial_consistency(o).first()
    assert (r.mention_consistency, r.citation_consistency) == (1.0, 0.5)


def test_health(spark):
    df = spark.createDataFrame([("a", 80, 50, 60, 70.0, 90.0), ("b", 80, 50, 60, None, 90.0), ("c", 80, 50, 60, 70.0, None), ("d", 80, 50, 60, None, None)], "site string, technical_score int, citability int, trust int, performance double, keyword double")
    got = [(r.health, r.mode) for r in scores.health(df).orderBy("site").collect()]
    assert got == [(round(24 + 12.5 + 12 + 10.5 + 9), "5_engine"), (round(28 + 15 + 15 + 9), "4_engine_keyword"), (round(28 + 15 + 12 + 10.5), "4_engine"), (round(35.2 + 18.5 + 11.4), "3_engine")]


def test_scores(parsed):
    p = parsed.where("status_code = 200")
    c = scores.citability(p)
    t = {r.url.removeprefix(B): r for r in scores.trust(p, c).collect()}
    assert t["/"].identity >= 2 and 0 <= t["/"].trust <= 100 and t["/"].technical == 2
    s = {r.url.removeprefix(B): r.technical_score for r in scores.technical_score(p).collect()}
    assert s["/"] == 100 - 10 - 20 and s["/t"] == 100 - 10 - 20 - 20
    assert scores.remediations(p).where("remediation = 'CANONICAL_MISSING'").count() == 4
    pol = scores.ci_policy(scores.remediations(p))
    assert reports.exit_code(pol) == 1


def test_cohort(spark):
    i = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "x"), ("b", "z"), ("c", "q")], "site string, item string")
    assert {(r.item): r.state for r in cohort.frequency(i).collect()} == {"x": "COMMON", "y": "UNIQUE", "z": "UNIQUE", "q": "UNIQUE"}
    assert [tuple(r) for r in cohort.overlap_matrix(i).collect()] == [("a", "b", 1, 0.3333)]


def test_audit(site):
    tables = api.audit(site)
    for name in ("rollup", "graph_summary", "link_findings", "conflicts", "actions", "package", "review", "report", "retrieval", "queries", "remediations", "site_topics"):
        assert tables[name].count() > 0, name
    b = api.benchmark(tables, "a.example")
    assert b["voids"].count() == 12 and b["target"].count() > 0


def test_audit_with_all_inputs(spark):
    low = page("Raw", "", "<p>few words</p>")
    full = page("Live title", "Head", "<p>" + "The laboratory is not accredited for calibration of many instruments. " * 40 + "</p>", '<script type="application/ld+json">{"@type":"Organization","name":"Acme"}</script>')
    records = source.crawl_frame(spark, [{"site": "a.example", "url": f"{B}/", "raw_html": low}, {"site": "a.example", "url": f"{B}/x", "raw_html": page("X", "X", "<p>text</p>", "<meta name=robots content=noindex>")}])
    robots_txt = spark.createDataFrame([("a.example", 200, "User-agent: Googlebot\nDisallow: /\n")], "site string, status_code int, content string")
    tables = api.audit(
        records, robots_txt, rendered=spark.createDataFrame([("a.example", f"{B}/", full)], "site string, url string, raw_html string"), llms_txt=spark.createDataFrame([], "site string, content string"),
        timings=spark.createDataFrame([("a.example", 2.0)], "site string, seconds double"), keywords=spark.createDataFrame([("a.example", 600)], "site string, traffic int"),
        cited=spark.createDataFrame([("a.example", "1", f"{B}/", "The accredited laboratory offers calibration")], "site string, id string, url string, text string"),
    )
    got = {(r.url.removeprefix(B), r.category) for r in tables["conflicts"].collect()}
    want = {"AI_CRAWLER_MISCONFIG", "CLIENT_RENDERED_SCHEMA", "DOM_HYDRATION_DIVERGENCE", "CLIENT_RENDERED_CONTENT", "EXTERNAL_CITATION_MATERIAL_MISMATCH"}
    assert {c for u, c in got if u == "/"} >= want and {c for u, c in got if u == "/x"} == {"AI_CRAWLER_MISCONFIG", "AI_RETRIEVAL_DIRECTIVE_CONFLICT"}
    assert {r.mode for r in tables["health"].collect()} == {"5_engine"}
    assert {r.area for r in tables["actions"].collect()} >= {"conflicts", "performance", "discovery"}
    assert "ROBOTS_MISSING" not in {r.remediation for r in tables["remediations"].collect()}
    review = tables["package"].first()
    assert len(review.dimensions) == 15 and review.dimensions["retrieval"] == "AVAILABLE" and 0 < review.search_access < 1
    assert api.benchmark(tables, "a.example")["target"].count() >= 11


def test_stream(spark, tmp_path):
    from loomweb.streaming import recrawl

    rows = [("http://a.example/x?utm_source=1", "2024-01-01 00:00:00", 200, 0.1), ("http://a.example/x", "2024-01-01 00:01:00", 200, 0.3), ("http://b.example/y", "2024-01-01 00:20:00", 500, 0.2)]
    spark.createDataFrame(rows, "url string, ts string, status_code int, fetch_time_sec double").selectExpr("url", "timestamp(ts) ts", "status_code", "fetch_time_sec").write.parquet(str(tmp_path / "in"))
    feed = lambda: spark.readStream.schema("url string, ts timestamp, status_code int, fetch_time_sec double").parquet(str(tmp_path / "in"))
    for name, df, mode, n in (("once", recrawl.once(feed()), "append", 2), ("win", recrawl.answers_by_window(feed()), "complete", 2), ("budget", recrawl.host_budget(feed(), 1), "append", 3)):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert spark.table(name).count() == n, name
    assert spark.table("budget").where("admitted").count() == 2
