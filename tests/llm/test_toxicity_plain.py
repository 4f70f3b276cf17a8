"""The toxicity weight against a plain version that tries every pattern at every place."""

from __future__ import annotations

import random
import re
import time

import pytest

from loomweb.llm import toxicity as tx


def places(pattern, whole, text):
    """Where a pattern stands in a text, at the edges of words."""
    at = text.find(pattern)
    while at >= 0:
        end = at + len(pattern)
        if not (at and text[at - 1].isalnum()) and not (whole and end < len(text) and text[end].isalnum()):
            yield at, end
        at = text.find(pattern, at + 1)


def plain_weight(lexicon, text):
    t = tx.plain(text)
    known = [(p, w, whole) for p, (w, whole) in lexicon.patterns.items()]
    phrases = [(p, 0.0, True) for p in lexicon.exceptions]
    hits = [(a, b, w) for p, w, whole in known + phrases for a, b in places(p, whole, t)]
    # digits and signs in words: the whole text once more, with what they stand for
    mixed, other = [], list(t.replace("l", "i"))
    for m in re.finditer(r"\S+", t):
        a, b = m.span()
        while b > a and t[b - 1] in tx.TAIL:
            b -= 1
        while a < b and t[a] in tx.HEAD:
            a += 1
        if tx.MIXED.search(t[a:b]):
            mixed.append((a, b))
            other[a:b] = [tx.DIGITS.get(c, c).replace("l", "i") for c in t[a:b]]
    other = "".join(other)
    fold = lambda p: "".join(tx.DIGITS.get(c, c) for c in p).replace("l", "i")
    for p, w, whole in known + phrases:
        for a, b in places(fold(p), whole, other):
            if any((x <= a and b <= y) if w else (a < y and x < b) for x, y in mixed):
                hits.append((a, b, w))
    for m in tx.APART.finditer(t):
        word = re.sub(r"[ .\-_*]", "", m[0])
        rest = fold(word) + t[m.end() :].replace("l", "i")
        for p, w, whole in known + phrases:
            for a, b in places(fold(p), whole, rest):
                if not a:
                    hits.append((m.start(), m.end() if w else m.end() + max(0, b - len(word)), w))
    bare = t.translate(tx.ACCENTS)
    for p, w, whole in known + phrases:
        for a, b in places(p, whole, bare):
            if t[a:b] != p and (whole or not w):
                hits.append((a, b, w))
    best = {}
    for a, b, w in hits:
        if w and not any(not v and x <= a and b <= y for x, y, v in hits):
            best[a] = max(best.get(a, 0.0), w)
    return sum(best.values())


LEXICON = tx.Lexicon({w: (1.0, True) for w in tx.WORDS} | {"grum": (0.5, False), "yo": (0.4, True), "extraordinarilybadword": (0.6, True)})


@pytest.mark.parametrize(
    "text, weight",
    [
        ("soap scum", 0), ("soap scum!", 0), ("a pond scum! here", 0), ("s0ap scum, so4p scum!", 0), ("tr4sh can", 0), ("t r a s h can", 0),
        ("you idiot", 1), ("you idiot!", 1), ("you-1d10t", 1), ("1d10t", 1), ("an i d i o t!", 1), ("trash can trash", 1), ("grumble yo", 0.9),
        ("an extraordinarilybadword", 0.6), ("", 0), (None, 0),
    ],
)
def test_examples(text, weight):
    assert LEXICON.weight(text)[0] == pytest.approx(weight)


def test_every_pattern_at_every_place():
    rng = random.Random(4)
    pieces = [*tx.WORDS, *tx.EXCEPTIONS, "1d10t", "m0r0n!", "5cum", "p0nd", "tr4sh", "c4n", "i d i o t", "s.c.u.m", "grumpy", "yo", "2nd", "b4", "(", "- ", "word", "l0ser", "sore", "débile", "debile", "ѕtupіd", "ok", "élan"]
    for _ in range(1000):
        t = "".join(rng.choice(pieces) + rng.choice([" ", " ", " ", "! ", "-", ", ", "\n", ""]) for _ in range(rng.randrange(12)))
        assert LEXICON.weight(t)[0] == pytest.approx(plain_weight(LEXICON, t)), t


def test_many_matches_take_linear_time():
    for piece in ("trash can ", "1d10t scum! ", "t r a s h can "):
        begin = time.process_time()
        LEXICON.weight(piece * (1_000_000 // len(piece)))
        assert time.process_time() - begin < 20  # some 2 s here; at the square of the length it would be minutes


def test_words_of_any_length_are_candidates():
    rows = [("=yo", "yo", "yo", 90, 0), ("extr", "extra", "extraordinarilybadword", 95, 60), ("=extraordinarilybadword", "extraordinarilybadword", "extraordinarilybadword", 80, 0), ("grum", "grumpa", "grumpo", 70, 0), ("=grumpalotalot", "grumpalotalot", "grumpalotalot", 30, 0)]
    got = tx.choose(rows, 1000, 100, 900)
    assert {k: v[1] for k, v in got.items()} == {"yo": True, "extraordinarilybadword": True, "grum": False}
