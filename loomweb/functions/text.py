"""Text scalars: hashes, fingerprints, shingles, tokens, snippets."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .dims import GENERIC_ANCHORS, STOPWORDS

NOT_WORD = r"[^\p{L}\p{N}_\s]"


def stripped(text: Column) -> Column:
    """Lower case, without punctuation, single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), NOT_WORD, ""), r"\s+", " "))


def words(text: Column) -> Column:
    t = stripped(text)
    return F.when(F.coalesce(t, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(t, " "))


def word_count(text: Column) -> Column:
    """Runs of anything but white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0))


def content_hash(text: Column) -> Column:
    return F.sha2(stripped(text), 256)


def html_hash(page: Column) -> Column:
    return F.sha2(page, 256)


def simhash_one(text: str) -> str:
    """64-bit fingerprint of words and word pairs: the sign of each bit's vote, strictly above 0; 16 hex digits."""
    import regex

    w = regex.sub(r"[^\w\s]", "", text.lower()).split()
    if not w:
        return "0" * 16
    tokens = w + [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)]
    digests = b"".join(hashlib.md5(t.encode()).digest()[:8] for t in tokens)
    bits = np.unpackbits(np.frombuffer(digests, np.uint8).reshape(-1, 8), axis=1)
    return np.packbits(2 * bits.sum(0, dtype=np.int64) > len(tokens)).tobytes().hex()


def simhash(text: Column) -> Column:
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: simhash_one(t or ""))

    return F.pandas_udf(run, "string")(text)


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two 16-digit hex fingerprints; 64 if one is no such number."""
    ok = a.rlike("^[0-9a-fA-F]{16}$") & b.rlike("^[0-9a-fA-F]{16}$")
    x, y = F.conv(a, 16, -10).cast("bigint"), F.conv(b, 16, -10).cast("bigint")
    return F.when(ok, F.bit_count(x.bitwiseXOR(y))).otherwise(64)


def shingles(w: Column, k: int = 3) -> Column:
    """The distinct runs of k words of an array of words; empty if there are fewer."""
    # element by element from shifted copies: a function of an index would evaluate w for each of them
    n = F.greatest(F.size(w) - (k - 1), F.lit(0))
    out = F.slice(w, 1, n)
    for j in range(1, k):
        out = F.zip_with(out, F.slice(w, j + 1, n), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.array_distinct(out)


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays as sets; 0 if one is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(both / F.size(F.array_union(a, b)))


def shingle_jaccard(a: Column, b: Column, k: int = 3) -> Column:
    """Of two texts: by shingles, or by words if either has fewer than k; to 4 places."""
    wa, wb = words(a), words(b)
    few = (F.size(wa) < k) | (F.size(wb) < k)
    return F.round(F.when(few, jaccard(wa, wb)).otherwise(jaccard(shingles(wa, k), shingles(wb, k))), 4)


def tokens(text: Column, stop: tuple[str, ...] = STOPWORDS) -> Column:
    """Distinct content words: letters and digits, hyphenated pairs whole, two characters or more, no function words."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[a-z0-9]+(?:-[a-z0-9]+)?"), F.lit(0))
    stops = F.array(*[F.lit(s) for s in stop])
    return F.array_distinct(F.filter(found, lambda t: (F.length(t) >= 2) & ~F.array_contains(stops, t)))


def term(text: Column) -> Column:
    """A term's normal form: lower case, underscores as spaces, edges without punctuation, single spaces."""
    t = F.replace(F.lower(F.trim(text)), F.lit("_"), F.lit(" "))
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", ""), r"\s+", " "))


def word_bounded(needle: Column, haystack: Column) -> Column:
    """Whether a term is a proper part of another, at word boundaries."""
    return (F.length(needle) > 0) & (needle != haystack) & F.contains(F.concat(F.lit(" "), haystack, F.lit(" ")), F.concat(F.lit(" "), needle, F.lit(" ")))


def snippet(text: Column, most: int = 350) -> Column:
    """A text cut at a word's end within `most` characters, with an ellipsis if it was cut."""
    t = F.trim(F.regexp_replace(text, r"\s+", " "))
    cut = F.regexp_replace(F.substring(t, 1, most), r"\s+\S*$", "")
    return F.when(F.length(t) <= most, t).otherwise(F.concat(cut, F.lit("...")))


def hard_snippet(text: Column, most: int = 350) -> Column:
    """A text cut to `most` characters, the last three an ellipsis if it was cut."""
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.substring(text, 1, most - 3), F.lit("...")))


def anchor(text: Column) -> Column:
    """An anchor text without the marks of image and ARIA names, punctuation and case."""
    t = F.regexp_replace(text, r"^\[(?:IMG|ARIA):\s*(.*)\]$", "$1")
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(t), NOT_WORD, " "), r"\s+", " "))


def generic_anchor(text: Column) -> Column:
    return anchor(text).isin(*GENERIC_ANCHORS)
