"""Toxicity: a weighted lexicon matched by Aho-Corasick after folding disguises, normalised by length.

Text is lower-cased; full-width and look-alike letters of other scripts become Latin, invisible characters go, digits
and signs inside words become the letters they stand for, and letters set apart by spaces or dots are joined. The
lexicon has fixed words and what labelled documents teach: words, and word beginnings shared by several words, that
documents labelled toxic hold far more often than others do. Matches of the plain and of the undisguised text are spans
of one text: those that lie in an exception phrase, disguised or not, don't count, and a word counts once, by its heaviest
pattern. The sum of the weights per word of text goes through a logistic curve that is fitted to the labels.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, bounded_batches, fold

# Words that count in any corpus, in English, German, French and Spanish.
WORDS = """idiot idiots idiotic moron morons moronic stupid dumbass loser losers scum scumbag worthless pathetic disgusting trash
clown asshole bastard bitch retard whore slut cunt fuck fucking fucker shithead dickhead arschloch schlampe wichser hurensohn
vollidiot abschaum connard connasse salope putain enculé ordure débile gilipollas cabrón hijoputa pendejo puta imbécil""".split()
# Phrases in which those words are harmless.
EXCEPTIONS = ["trash can", "trash cans", "trash bin", "trash bag", "trash collection", "trash pickup", "clown fish", "clown anemonefish", "circus clown", "clown school",
              "idiot proof", "idiot-proof", "idiot light", "pond scum", "soap scum", "scum line", "sore loser", "loser bracket", "winner and loser", "winners and losers"]
# Letters of other scripts that look like Latin ones.
ALIKE = dict(zip("аеорсухіјѕԁһӏԛԝвкмнтαοιρτυνκχεηωі", "aeopcyxijsdhlqwbkmhtaoiptuvkxenwi", strict=True))
# Digits and signs that stand for letters.
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "i"}
INVISIBLE = "\u00ad\u200b\u200c\u200d\u2060\ufeff"

PLAIN = {ord(a): b for a, b in ALIKE.items()} | {ord(c): None for c in INVISIBLE} | {0xFF01 + i: chr(0x21 + i).lower() for i in range(94)}
ACCENTS = {ord(a): b for a, b in zip("áàâäãåéèêëíìîïóòôöõúùûüñç", "aaaaaaeeeeiiiiooooouuuunc", strict=True)}
MIXED = re.compile(r"[^\W\d_][0-9@$!|]|[0-9@$!|][^\W\d_]")
TOKEN = re.compile(r"\S+")
APART = re.compile(r"(?<!\S)[^\W\d_](?:[ .\-_*][^\W\d_]){3,}(?!\w)")
EDGES = ".,;:!?\"'()[]{}<>*%#&$|…«»„“”"
#: Lengths of the beginnings of words that are tried beside whole words; labelled documents that are read at most; weight
#: of fixed words.
STEMS, FIT_ROWS, FIXED = (4, 8), 20_000, 1.0


def plain(text: str) -> str:
    """Lower case, Latin letters for those that look like them, nothing invisible."""
    return text.lower().translate(PLAIN)


STANDS_FOR = {ord(a): b for a, b in DIGITS.items()} | {ord("l"): "i"}
HEAD, TAIL = ".,;:?\"'()[]", ".,;:?\"'()[]!"


def disguised(text: str) -> str:
    """A text with the letters that its digits and signs stand for, i and l taken as one; as long as it was."""
    return text.translate(STANDS_FOR)


class Lexicon:
    """patterns: {text: (weight, whole word?)}; harmless phrases; one automaton for plain and one for undisguised text."""

    def __init__(self, patterns: dict[str, tuple[float, bool]], exceptions=tuple(EXCEPTIONS)):
        self.patterns, self.exceptions = patterns, exceptions
        self.main, self.alike = ahocorasick.Automaton(), ahocorasick.Automaton()
        known = {p: (w, whole) for p, (w, whole) in patterns.items()} | {p: (0.0, True) for p in exceptions if p not in patterns}
        folded: dict[str, tuple[float, bool]] = {}
        for p, (w, whole) in known.items():
            self.main.add_word(p, (len(p), w, whole))
            folded[disguised(p)] = max(folded.get(disguised(p), (0.0, True)), (w, whole))
        for p, (w, whole) in folded.items():
            self.alike.add_word(p, (len(p), w, whole))
        for a in (self.main, self.alike):
            if len(a):
                a.make_automaton()
        self.reach = max(map(len, known), default=0) + 2

    def __reduce__(self):
        return Lexicon, (self.patterns, self.exceptions)

    @staticmethod
    def _hits(auto, text: str) -> list[tuple[int, int, float]]:
        """(start, end, weight) of the patterns that begin, and if they are whole words end, at the edge of a word."""
        out = []
        for end, (n, w, whole) in auto.iter(text):
            start = end - n + 1
            if (start and text[start - 1].isalnum()) or (whole and end + 1 < len(text) and text[end + 1].isalnum()):
                continue
            out.append((start, end + 1, w))
        return out

    def _undisguised(self, t: str) -> list[tuple[int, int, float]]:
        """The patterns in words that hold digits or signs for letters, and the exception phrases around them."""
        words = []
        for m in TOKEN.finditer(t):
            word = m[0].rstrip(TAIL)  # signs after a word are no letters
            bare = word.lstrip(HEAD)
            if MIXED.search(bare):
                words.append((m.start() + len(word) - len(bare), m.start() + len(word)))
        out, i = [], 0
        while i < len(words):  # words near each other are read in one piece of text
            first, end = max(0, words[i][0] - self.reach), words[i][1]
            j, piece = i, []
            while j < len(words) and words[j][0] <= end + self.reach:
                piece.append(words[j])
                end = words[j][1]
                j += 1
            last = min(len(t), end + self.reach)
            parts, at = [], first
            for a, b in piece:
                parts += [t[at:a].replace("l", "i"), disguised(t[a:b])]
                at = b
            parts.append(t[at:last].replace("l", "i"))
            k = 0
            for a, b, w in sorted(self._hits(self.alike, "".join(parts))):
                a, b = a + first, b + first
                while k < len(piece) and piece[k][1] <= a:
                    k += 1
                inside = k < len(piece) and piece[k][0] <= a and (b <= piece[k][1] or not w)
                if inside or (not w and k < len(piece) and piece[k][0] < b):
                    out.append((a, b, w))
            i = j
        return out

    def _apart(self, t: str) -> list[tuple[int, int, float]]:
        """The patterns in letters that are set apart, and the exception phrases that these begin."""
        out = []
        for m in APART.finditer(t):
            word = re.sub(r"[ .\-_*]", "", m[0])
            longer = self.reach + len(m[0]) - len(word)
            for a, b, w in self._hits(self.alike, disguised(word) + t[m.end() : m.end() + self.reach].replace("l", "i")):
                if not a:
                    out.append((m.start(), m.end() + max(0, b - len(word)) if not w else min(m.end(), m.start() + longer), w))
        return out

    def weight(self, text: str | None) -> tuple[float, int]:
        """The sum of the weights that match, and the number of words."""
        if not text or not len(self.main):
            return 0.0, len(text.split()) if text else 0
        t = plain(text)
        hits = self._hits(self.main, t)
        if MIXED.search(t):
            hits += self._undisguised(t)
        hits += self._apart(t)
        if not t.isascii():
            bare = t.translate(ACCENTS)
            hits += [(a, b, w) for a, b, w in self._hits(self.main, bare) if t[a:b] != bare[a:b] and (not w or self.patterns[bare[a:b]][1])]
        total = 0.0
        if hits:
            # one pass in order of the starts, phrases before words: safe is how far the phrases so far reach
            safe, at, best = 0, -1, 0.0
            for a, b, w in sorted(hits, key=lambda h: (h[0], h[2] > 0, h[1])):
                if not w:
                    safe = max(safe, b)
                    continue
                if a != at:
                    total, at, best = total + best, a, 0.0
                if b > safe:
                    best = max(best, w)
            total += best
        return total, len(t.split())

    def feature(self, text: str | None) -> float:
        w, n = self.weight(text)
        return math.log1p(1000 * w / (n + 5))


def fit_curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Logistic regression on one feature with a weak penalty; a fixed curve without two classes."""
    if not len(y) or y.min() == y.max():
        return -3.0, 4.0
    z, p = np.column_stack([np.ones(len(x)), x]), np.zeros(2)
    ridge = np.diag([1e-6, 0.02])
    for _ in range(60):
        q = 1 / (1 + np.exp(-np.clip(z @ p, -30, 30)))
        step = np.linalg.solve((z * (q * (1 - q) + 1e-9)[:, None]).T @ z + ridge, z.T @ (y - q) - ridge @ p)
        p = p + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return float(p[0]), float(p[1])


def fewest(tried: int, toxic: int, clean: int) -> float:
    """In how many toxic documents a candidate must be, for chance not to explain it among so many."""
    base = toxic / (toxic + clean)
    return max(4, math.log(1e-3 / max(1, tried)) / math.log(base) if base < 1 else 4)


def choose(rows: list[tuple[str, str, str, int, int]], tried: int, toxic: int, clean: int) -> dict[str, tuple[float, bool]]:
    """Patterns from (beginning, first and last word with it, toxic documents, clean documents), of `tried` candidates.

    A beginning counts if its documents are toxic more often than chance allows among so many candidates, and nearly
    always. One that a single word has gives that word. Of nested beginnings the longest that keeps the documents stays.
    A whole word comes as "=word"; it counts if no beginning of it does.
    """
    if not toxic or not clean:
        return {}
    least = fewest(tried, toxic, clean)
    every = {p: (a, b, lo, hi) for p, lo, hi, a, b in rows if a >= least and a >= 20 * b}
    good = {p: v for p, v in every.items() if p[0] != "="}
    out: dict[str, tuple[float, bool]] = {}
    top = math.log((toxic + 0.5) / (toxic + 1)) - math.log(0.5 / (clean + 1))
    share = lambda a, b: (math.log((a + 0.5) / (toxic + 1)) - math.log((b + 0.5) / (clean + 1))) / top
    strength = lambda a, b: round(max(0.3, min(1.0, share(a, b) + 0.3)), 4)
    for p in sorted(good, key=lambda p: (len(p), p)):
        a, b, lo, hi = good[p]
        if any(p[:n] in good and good[p[:n]][0] > a * 1.02 for n in range(STEMS[0], len(p))):
            continue  # a shorter one has more documents
        longer = [q for q in good if q.startswith(p) and q != p and good[q][0] * 1.02 >= a]
        if longer and lo != hi:
            continue  # a longer one has them all
        out[lo if lo == hi else p] = (strength(a, b), lo == hi)
    for p in sorted(every.keys() - good.keys()):
        a, b, word, _ = every[p]
        if word not in out and not any(word[:n] in out for n in range(STEMS[0], min(STEMS[1], len(word)) + 1)):
            out[word] = (strength(a, b), True)
    return out


def sketches(text: str | None) -> tuple[int, int, int]:
    """Three minimum hashes of a text's three-word sequences; of all its words as one, if there are fewer."""
    words = (text or "").lower().split()
    seqs = [xxhash.xxh3_64_intdigest(" ".join(words[i : i + 3])) for i in range(max(1, len(words) - 2))]
    h = np.array(seqs, np.uint64)
    return tuple(int((h * np.uint64(k) ^ (h >> np.uint64(29))).min() >> np.uint64(1)) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def learn(docs: DataFrame, labels: DataFrame, scratch: Scratch, fit_rows: int = FIT_ROWS) -> tuple[Lexicon, tuple[float, float]]:
    """A lexicon and curve from labelled documents whose fold (crc32 of doc_id, modulo 3) is not 1.

    At most about fit_rows labelled documents are read, those with the smallest hashes; their words, of any length, and
    the beginnings of 4 to 8 letters that several words share are tried. A doc_id with several labels is toxic if one of
    them says so.
    """
    bounded_batches(docs.sparkSession)
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(fold("doc_id", 3) != 1)
    rate = min(1.0, fit_rows / max(1, known.count()))
    some = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(rate * 1_000_000)) if rate < 1 else known
    sample = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").select("doc_id", "text", F.col("toxic").cast("int").alias("toxic"))
    # near copies of one document would pass for evidence from many: of those that share a sketch one stays
    def sketch(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([sketches(t) for t in texts], columns=["a", "b", "c"])

    sample = sample.withColumn("m", F.pandas_udf(sketch, "a long, b long, c long")("text")).select("doc_id", "text", "toxic", "m.a", "m.b", "m.c")
    for m in "abc":
        sample = sample.groupBy(m).agg(F.min(F.struct("doc_id", "text", "toxic", *[x for x in "abc" if x > m])).alias("r")).select("r.*")
    sample = scratch.keep(sample.select("text", "toxic"), "labelled")

    def stems(batches):
        for b in batches:
            toxic, clean, first, last = Counter(), Counter(), {}, {}
            for text, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                seen = set()
                for w in {w.strip(EDGES) for w in plain(text or "").split()} - {""}:
                    # beginnings, and the whole word where it is none of them
                    cuts = [w[:n] for n in range(STEMS[0], min(STEMS[1], len(w)) + 1) if w[0] != "="]
                    for p in cuts if cuts and cuts[-1] == w else [*cuts, "=" + w]:
                        seen.add(p)
                        if p not in first or w < first[p]:
                            first[p] = w
                        if p not in last or w > last[p]:
                            last[p] = w
                (toxic if y else clean).update(seen)
            keys = list(first)
            yield pa.RecordBatch.from_pydict({"p": keys, "lo": list(first.values()), "hi": [last[k] for k in keys], "a": [toxic[k] for k in keys], "b": [clean[k] for k in keys]})

    totals = {r.toxic: r["count"] for r in sample.groupBy("toxic").count().collect()}
    counted = sample.mapInArrow(stems, "p string, lo string, hi string, a bigint, b bigint").groupBy("p").agg(F.min("lo"), F.max("hi"), F.sum("a").alias("a"), F.sum("b").alias("b"))
    toxic, clean = totals.get(1, 0), totals.get(0, 0)
    tried = counted.where("a >= 4").count()
    found = counted.where((F.col("a") >= fewest(tried, toxic, clean)) & F.expr("a >= 20 * b")).collect() if toxic and clean else []
    lexicon = Lexicon({w: (FIXED, True) for w in WORDS} | choose([tuple(r) for r in found], tried, toxic, clean))

    def feature(texts: pd.Series) -> pd.Series:
        return texts.map(lexicon.feature)

    xy = sample.select(F.pandas_udf(feature, "double")("text").alias("x"), "toxic").toPandas()
    return lexicon, fit_curve(xy["x"].to_numpy(float), xy["toxic"].to_numpy(float))


def score_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, fit_rows: int = FIT_ROWS) -> DataFrame:
    """docs with toxicity (0 to 1), toxic_weight, and toxic (1 from the threshold on).

    docs has doc_id and text; its other columns stay, but for ones of those three names, which are replaced. A null or
    empty text has weight 0 and scores as any text without a match. Without labels of both kinds the fixed words and a
    fixed curve are used.
    """
    lexicon, (a, b) = learn(docs, labels, Scratch(docs.sparkSession), fit_rows)

    def weigh(texts: pd.Series) -> pd.DataFrame:
        found = [lexicon.weight(t) for t in texts]
        return pd.DataFrame({"w": [float(w) for w, _ in found], "x": [math.log1p(1000 * w / (n + 5)) for w, n in found]})

    m = F.pandas_udf(weigh, "w double, x double")("text")
    base = docs.drop("toxicity", "toxic_weight", "toxic").withColumn("_m", m)
    score = 1 / (1 + F.exp(-(F.lit(a) + F.lit(b) * F.col("_m.x"))))
    return base.withColumn("toxicity", score).withColumn("toxic_weight", F.col("_m.w")).withColumn("toxic", (F.col("toxicity") >= threshold).cast("int")).drop("_m")
