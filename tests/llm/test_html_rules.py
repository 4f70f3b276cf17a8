"""Text that the rules over blocks must keep or drop, with and without a marked article."""

from __future__ import annotations

import random

from loomweb.llm import htmltext
from loomweb.llm.htmltext import main_text

PROSE = "This is a paragraph of the text, and it has the words that are in the language, so that it is good for the reader. "


def article(inner):
    return f"<html><body><nav><a href='/'>Home</a></nav><article><h1>Head</h1><p>{PROSE}</p>{inner}<p>Last words of the text.</p></article><footer>{PROSE}</footer></body></html>"


def kept(inner):
    return main_text(article(inner)).split("\n")[2:-1]


def test_text_of_an_article_stays():
    assert kept(f"<section class='legal-analysis'><p>{PROSE}</p></section>") == [PROSE.strip()]
    assert kept(f"<h2>Related</h2><p>{PROSE}</p>") == ["Related", PROSE.strip()]
    assert kept("<p>The sum <math><mi>a</mi><mo>+</mo><mn>1</mn></math> is odd.</p>") == ["The sum a+1 is odd."]
    assert kept("<p><a href='/x'>See the whole report of the committee</a></p>") == ["See the whole report of the committee"]
    assert kept("<p>Prices of <span class='ad-hoc'>ad hoc</span> work.</p>") == ["Prices of ad hoc work."]


def test_noise_of_an_article_goes():
    for part in (f"<aside>{PROSE}</aside>", f"<form>{PROSE}</form>", f"<div role='complementary'>{PROSE}</div>", f"<div class='ad'>{PROSE}</div>", f"<div id='comments'><p>{PROSE}</p></div>"):
        assert kept(part) == [], part
    assert kept("<h2>Related</h2><ul><li><a href='/a'>One more story</a></li><li><a href='/b'>And another one</a></li></ul>") == []


def page(rng, words):
    """A page without an article: (html, blocks that belong to its text, other blocks)."""
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n)).capitalize() + "."
    good, bad, parts = [], [], []

    def put(to, tag, text, inner=None):
        to.append(text)
        parts.append(f"<{tag}>{inner or text}</{tag.split()[0]}>")

    for i in range(rng.randrange(3, 8)):  # a menu, without a class
        put(bad, "li", f"Place {i}", f"<a href='/{i}'>Place {i}</a>")
    put(bad, "div class='box-3'", "Sign in | Register | Contact | Sitemap | Terms | Privacy | Jobs | Press | Store")
    put(good, "h1", prose(6))
    for _ in range(rng.randrange(3, 8)):
        put(good, "p", prose(rng.randrange(25, 80)))
        if rng.random() < 0.3:
            put(good, "p", prose(rng.randrange(3, 8)))
        if rng.random() < 0.3:
            put(good, "h2", prose(3))
            put(good, "p", prose(rng.randrange(35, 60)))
    put(bad, "div class='promo'", prose(12))
    for i in range(rng.randrange(3, 6)):
        t = f"Another headline number {i} from elsewhere"
        put(bad, "div", t, f"<a href='/n{i}'>{t}</a>")
    put(bad, "div", "Copyright 2020 Example Ltd. Registered office: 12 High Street, Exampletown EX1 2AB. VAT 123 4567 89, Company No. 0987654.")
    return "<body>" + "".join(parts) + "</body>", good, bad


WORDS = ("the of and to in a is that it was for on are as with his they at be this from have or by one had not but what all were when we there can an your which their said if do will each "
         "river garden table window report letter number people season market answer village station harbour colour measure").split()  # fmt: skip


def rates(pages):
    right = wrong = lost = 0
    for html, good, bad in pages:
        got = set(main_text(html).split("\n"))
        right += sum(t in got for t in good)
        lost += sum(t not in got for t in good)
        wrong += sum(t in got for t in bad)
    return right / max(1, right + wrong), right / max(1, right + lost)


def test_pages_without_an_article(monkeypatch):
    pages = [page(random.Random(i), WORDS) for i in range(200)]
    precision, recall = rates(pages)
    print(f"precision {precision:.3f}, recall {recall:.3f}")
    assert precision >= 0.95 and recall >= 0.95
    # without the densities the rules do worse: they are what decides
    monkeypatch.setattr(htmltext, "_stops", lambda block: 1.0)
    no_stops = rates(pages)
    monkeypatch.setattr(htmltext, "LINKS", 2.0)
    no_links = rates(pages)
    print(no_stops, no_links)
    assert no_stops[0] < precision - 0.02 and no_links[0] < no_stops[0] - 0.05
