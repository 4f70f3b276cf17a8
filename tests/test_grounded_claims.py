"""Evidence for claims that stands in long paragraphs."""

import hashlib

from loomweb.operators import answers
from loomweb.sources import crawl as source
from loomweb.sources import parse

LONG = "The laboratory serves customers in the whole region and takes in devices of many kinds every day. " * 6


def test_evidence_in_long_texts(spark):
    pages = {
        ("a", "/claim"): "<p>Acme works under ISO 17025 today.</p>",
        ("a", "/proof"): f"<p>{LONG} All of it follows ISO 17025.</p>",  # a unit, after character 350
        ("b", "/claim"): "<div><p>Acme Labs was founded in 1999.</p></div>",
        ("b", "/other"): f"<p>{LONG} Acme was founded in 1999, or, as others say, established in 2001.</p>",  # no unit, over 400
        ("c", "/own"): f"<p>ISO 9001 holds here. {LONG}</p>",  # a unit whose claim is cut: no evidence for itself
        ("d", "/same"): "<h2>Scope</h2><p>" + "The scope of all services of the laboratory in the region and of every customer that sends its devices to it, as it says here: " + "one. " * 60 + "</p>",
    }
    rows = [{"site": s, "url": f"https://{s}.example{u}", "raw_html": f"<html><head><title>t</title></head><body><main>{t}</main></body></html>"} for (s, u), t in pages.items()]
    p = parse.parse_pages(source.crawl_frame(spark, rows)).cache()
    u = answers.answer_units(p)
    got = {(r.site, r.type): r.support for r in answers.ground_claims(answers.claims(p, u), answers.passages(p, u)).collect() if r.url.endswith(("/claim", "/own"))}
    assert got[("a", "accreditation")] == "SUPPORTED_ON_SITE"
    assert got[("b", "founding")] == "CONTRADICTED_ON_SITE"
    assert got[("c", "accreditation")] == "UNCORROBORATED_ON_SITE"
    assert all(len(r.text) <= 400 for r in answers.claims(p, u).collect()) and all(len(r.text) <= 350 for r in u.collect())


def test_words_in_common_with_steps_and_tables(spark, monkeypatch):
    import random

    rng = random.Random(3)
    some = lambda n: " ".join(f"w{rng.randrange(40)}" for _ in range(n))
    kinds = ("service", "specification", "requirement", "factual", "metric")
    claims = [(s, f"/{i}", answers_id(t := some(rng.randrange(2, 7))), rng.choice(kinds), "", t) for s in "ab" for i in range(80)]
    texts = [(s, f"/{rng.randrange(9)}", rng.choice(("TABLE", "PROCEDURE_STEPS", "PARAGRAPH")), some(rng.randrange(1, 9))) for s in "ab" for _ in range(5)]
    texts += [("a", "/9", "TABLE", claims[0][5]), ("c", "/1", "TABLE", "apple pie w1"), ("c", "/1", "TABLE", "APPLE Pie w1")]  # a claim's own text; one text in two cases
    claims.append(("c", "/2", "x", "metric", "", "an apple costs 5 percent"))
    c = spark.createDataFrame(claims, "site string, url string, claim_id string, type string, subject string, text string").dropDuplicates(["site", "url", "claim_id"])
    u = spark.createDataFrame([(s, u, answers_id(t), k, t, answers_id(t)) for s, u, k, t in texts], "site string, url string, key string, type string, text string, own string")

    def backed(r) -> bool:
        kinds = ("TABLE",) if r.type == "metric" else ("TABLE", "PROCEDURE_STEPS")
        return any(s == r.site and k in kinds and answers_id(t) != r.claim_id and len(set(t.lower().split()) & set(r.text.split())) >= (2 if r.type in ("metric", "service") else 3) for s, _, k, t in texts)

    want = {(r.site, r.url): "SUPPORTED_ON_SITE" if backed(r) else "PARTIALLY_SUPPORTED" for r in c.collect()}
    assert len(set(want.values())) == 2 and want[("c", "/2")] == "PARTIALLY_SUPPORTED"
    for n in (0, 1, answers.WITNESSES):
        monkeypatch.setattr(answers, "WITNESSES", n)
        assert {(r.site, r.url): r.support for r in answers.ground_claims(c, u).collect()} == want


def test_accreditations_and_years_of_other_claims(spark):
    rows = [(s, u, answers_id(t), k, x, t) for s, u, k, x, t in (
        ("a", "/1", "accreditation", "ISO 17025", "Acme has ISO 17025 now."), ("a", "/2", "accreditation", "ISO 17025", "The scope of ISO 17025."), ("b", "/1", "accreditation", "ISO 9001", "We have ISO 9001 here."),
        ("a", "/3", "founding", "1999", "Founded in 1999 by two."), ("b", "/3", "founding", "1999", "Founded in 1999 by two."), ("c", "/3", "founding", "2001", "Established 2001."), ("c", "/4", "founding", "2001", "Founded in 2001."),
    )]
    c = spark.createDataFrame(rows, "site string, url string, claim_id string, type string, subject string, text string")
    u = c.select("site", "url", "claim_id", "type", "text", "claim_id").toDF("site", "url", "key", "type", "text", "own")
    u = u.union(spark.createDataFrame([("a", "/5", "k", "PARAGRAPH", "Since 1998.", "k")], u.schema))
    got = {(r.site, r.url): r.support.split("_")[0] for r in answers.ground_claims(c, u).collect()}
    assert got == {("a", "/1"): "SUPPORTED", ("a", "/2"): "PARTIALLY", ("b", "/1"): "UNCORROBORATED", ("a", "/3"): "CONTRADICTED", ("b", "/3"): "PARTIALLY", ("c", "/3"): "SUPPORTED", ("c", "/4"): "SUPPORTED"}


def answers_id(t: str) -> str:
    return hashlib.md5(t.lower().encode()).hexdigest()[:10]
