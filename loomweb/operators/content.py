"""Content of pages: measures, duplicates, near duplicates, boilerplate."""

from __future__ import annotations

import functools
import math

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..functions.dims import STOPWORDS
from ..plans.shared import discard, keep, small_batches

# Phrases of unfinished pages.
PLACEHOLDER = r"(?i)\b(lorem ipsum|under construction|coming soon|page intentionally left blank|insert text here|sample text|dummy text|template placeholder)\b"


def tier(words):
    """EMPTY, VERY_LOW, LOW, MODERATE or SUBSTANTIVE by number of words."""
    return F.when(words == 0, "EMPTY").when(words < 100, "VERY_LOW").when(words < 200, "LOW").when(words < 600, "MODERATE").otherwise("SUBSTANTIVE")


def page_content(parsed: DataFrame) -> DataFrame:
    """Per page with HTML: main text, how it was found, words, ratio, tier, hashes, headings, title and H1 alignment."""
    p = parsed.where("p is not null").select("site", "url", "p.*")
    words = text.word_count(F.col("main_text"))
    p = p.withColumn("words", words).withColumn("ratio", F.round(F.col("words") / F.greatest(F.col("body_words"), F.lit(1)), 3))
    p = p.withColumn("placeholders", F.array_distinct(F.transform(F.regexp_extract_all("main_text", F.lit(PLACEHOLDER), F.lit(1)), F.lower)))
    p = p.withColumn("content_hash", F.when(F.col("words") > 0, text.content_hash(F.col("main_text")))).withColumn("simhash", text.simhash(F.col("main_text")))
    out = p.select(
        "site", "url", "title", "main_text", "main_method", "words", "body_words", "paragraphs", "ratio", tier(F.col("words")).alias("tier"), ((F.col("words") >= 300) & (F.col("paragraphs") >= 2)).alias("substantive"),
        ((F.col("ratio") < 0.20) & (F.col("body_words") > 100)).alias("boilerplate_dominated"), "placeholders", "content_hash", "simhash",
        F.size(F.filter(F.split("main_text", r"[.!?]+(?:\s|$)"), lambda s: F.trim(s) != "")).alias("sentences"), "headings", "h1", "blocks",
    )
    return out.withColumn("headings_evidence", heading_structure()).withColumn("alignment", title_alignment())


def heading_structure():
    """Struct over the `headings` of a page: counts by level, skips, several or no H1, empty headings and sections."""
    h = F.col("headings")
    at = F.when(F.size(h) > 1, F.sequence(F.lit(2), F.size(h))).otherwise(F.array().cast("array<int>"))
    skips = F.filter(F.transform(at, lambda i: F.struct(F.element_at(h, i - 1)["level"].alias("a"), F.element_at(h, i)["level"].alias("b"), F.element_at(h, i)["text"].alias("text"))), lambda s: s["b"] > s["a"] + 1)
    n = lambda level: F.size(F.filter(h, lambda x: x["level"] == level))
    counts = [n(i).alias(f"h{i}") for i in range(1, 7)]
    valid = (F.size(skips) == 0) & (n(1) > 0)
    total = F.aggregate(h, F.lit(0), lambda a, x: a + x["words"])
    return F.struct(
        F.size(h).alias("total"), *counts, valid.alias("valid"), F.transform(skips, lambda s: F.concat(F.lit("h"), s["a"].cast("string"), F.lit(">h"), s["b"].cast("string"), F.lit(": "), F.substring(s["text"], 1, 30))).alias("skips"), (n(1) > 1).alias("several_h1"),
        F.size(F.filter(h, lambda x: x["text"] == "")).alias("empty"), F.size(F.filter(h, lambda x: x["words"] == 0)).alias("empty_sections"), F.round(F.when(F.size(h) > 0, total / F.size(h)).otherwise(0.0), 1).alias("mean_section_words"),
    )


def heading_skips(parsed: DataFrame) -> DataFrame:
    """The same skips as rows: headings over one level below the one before, by a window over a page's headings."""
    h = parsed.where("p is not null").select("site", "url", F.explode("p.headings").alias("h")).select("site", "url", "h.*")
    before = F.lag("level").over(Window.partitionBy("site", "url").orderBy("pos"))
    return h.withColumn("previous", before).where(F.col("level") > F.col("previous") + 1)


def title_alignment():
    """Struct: how a page's title, first H1 and main text agree."""
    stop = F.array(*[F.lit(s) for s in STOPWORDS])
    clean = lambda c: F.regexp_replace(F.lower(F.trim(c)), text.NOT_WORD, "")
    bag = lambda c: F.array_distinct(F.filter(F.split(F.trim(c), r"\s+"), lambda w: (w != "") & ~F.array_contains(stop, w)))
    t, h = clean(F.coalesce("title", F.lit(""))), clean(F.coalesce(F.try_element_at("h1", F.lit(1)), F.lit("")))
    tt, ht = bag(t), bag(h)
    exact = t == h
    inner = (F.contains(h, t) & (F.length(t) > 3)) | (F.contains(t, h) & (F.length(h) > 3))
    overlap = F.when((F.size(tt) == 0) | (F.size(ht) == 0), F.when(exact, 1.0).otherwise(0.0)).otherwise(F.round(F.size(F.array_intersect(tt, ht)) / F.size(F.array_union(tt, ht)), 3))
    body = text.words(F.col("main_text"))
    full = F.array_except(F.filter(F.array_distinct(body), lambda w: ~F.array_contains(stop, w)), ht)
    lead = F.filter(F.array_distinct(F.slice(body, 1, 200)), lambda w: ~F.array_contains(stop, w))
    both = F.greatest(F.size(F.array_union(tt, ht)), F.lit(1))
    hits = lambda a: F.size(F.array_intersect(tt, a)) + F.size(F.array_intersect(ht, a))
    lead_ratio, full_ratio = F.round(hits(lead) / both, 3), F.round(hits(full) / both, 3)
    status = (
        F.when((F.coalesce(t, F.lit("")) == "") | (F.coalesce(h, F.lit("")) == ""), "UNAVAILABLE")
        .when(exact | (overlap >= 0.5) | (inner & (overlap >= 0.3)), "STRONG_ALIGNMENT")
        .when((overlap >= 0.2) | ((overlap > 0) & (lead_ratio >= 0.3)), "MODERATE_ALIGNMENT")
        .when((overlap > 0) | ((F.size(F.array_intersect(tt, full)) > 0) & (F.size(F.array_intersect(ht, full)) > 0)), "WEAK_ALIGNMENT")
        .otherwise("MISALIGNED")
    )
    return F.struct(status.alias("status"), exact.alias("exact"), overlap.alias("overlap"), lead_ratio.alias("lead_ratio"), full_ratio.alias("full_ratio"))


def exact_duplicates(content: DataFrame) -> DataFrame:
    """site, content_hash, words, pages, urls of main texts that several pages of a site have."""
    return content.where("words > 0").groupBy("site", "content_hash").agg(F.first("words").alias("words"), F.count("*").alias("pages"), F.sort_array(F.collect_list("url")).alias("urls")).where("pages > 1")


def _lists(c: DataFrame, near: float, k: int, full: int = 128) -> DataFrame:
    """id, n, l0, l1, tokens of texts (id, site, w): hashes of a text's shingles of k words, of its words if it has fewer.

    Listed are the hashes below a cut, the same for all texts (level 0, even), and all of them (level 1, odd) for texts of
    up to `full` shingles. Two texts that can be alike are on one level, which holds enough of each for the search: `full`
    is raised until that is so of every text.
    """
    import numpy as np

    kind = "id bigint, n int, weak int, l0 int, l1 int, tokens array<bigint>"
    cut = int(-(2**63) + min(0.999, 2.2 * (1 - near) + 0.005) * 2**64)
    one, two = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)

    def lists(full: int, alone: int):
        def row(salt: int, w: np.ndarray):
            h = w if len(w) < k else np.zeros(len(w) - k + 1, np.uint64)
            for i in range(k if len(w) >= k else 0):
                h = (h ^ (h >> np.uint64(29))) * one + w[i : len(w) - k + 1 + i]
            h = (h ^ np.uint64(salt)) * two
            h = np.unique((h ^ (h >> np.uint64(32))).view(np.int64) & ~np.int64(1))
            n, low = len(h), int(np.searchsorted(h, cut))
            weak = n if low < n - int(np.ceil(n * near)) + 1 else 0
            low = low if n > alone else 0
            return n, weak, low, n if n <= full else 0, np.concatenate([h[:low], h | np.int64(1) if n <= full else h[:0]])

        def run(batches):
            for b in (whole.slice(i, 500) for whole in batches for i in range(0, whole.num_rows, 500)):
                ids, salts = b.column(0), b.column(1).to_numpy().view(np.uint64).tolist()
                found = [row(x, np.asarray(w.values, np.int64).view(np.uint64)) for x, w in zip(salts, b.column(2), strict=True)]
                n, weak, l0, l1, tokens = zip(*found, strict=True) if found else ([], [], [], [], [])
                ends = np.concatenate([[0], np.cumsum([len(t) for t in tokens], dtype=np.int64)]).astype(np.int32)
                flat = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(tokens) if tokens else np.empty(0, np.int64)))
                yield pa.RecordBatch.from_arrays([ids, *[pa.array(v, pa.int32()) for v in (n, weak, l0, l1)], flat], names=["id", "n", "weak", "l0", "l1", "tokens"])

        return run

    hashed = c.select("id", F.xxhash64("site", F.size("w") >= k).alias("salt"), F.transform("w", lambda x: F.xxhash64(x)).alias("w"))
    while True:
        out = keep(hashed.mapInArrow(lists(full, int(full * near)), kind))
        weak = out.agg(F.max("weak")).first()[0] or 0
        if weak <= int(full * near):
            return out
        discard(out)
        full = math.ceil((weak + 1) / near)


#: Shingles are counted in so many parts, of which one at a time has its shuffles on disk.
PARTS = 4


def _repeated(lists: DataFrame, part: int) -> DataFrame:
    """t, id, df of a part of the shingles in lists: those that several texts have, and how many."""
    tokens = lists.select("id", F.explode("tokens").alias("t")).where(F.pmod(F.shiftright("t", 1), F.lit(PARTS)) == part)
    return tokens.join(tokens.groupBy("t").agg(F.count("*").cast("int").alias("df")).where("df > 1"), "t")


def near_duplicates(content: DataFrame, threshold: float = 0.80, k: int = 3) -> DataFrame:
    """url_a < url_b, similarity (percent, one place) and hamming distance of pages of a site that share most shingles.

    Only what differs by 12 bits of the fingerprint or 30 words at most counts, and pages with equal hashes don't. The
    candidates share one of the rarest of a text's shingles, enough of them that no pair at the threshold is missed: the
    verdict is on the similarity to four places, so the filter leaves that much room. Texts of fewer than k words are
    compared with all of few words by their words instead, as are they with longer ones by a shared word. Fingerprints
    are made of texts that have a partner alone.
    """
    small_batches(content.sparkSession)
    named = ["site", "words", "content_hash"]
    base = keep(content.where("words > 0").select(*named, "url", text.stripped(F.col("main_text")).alias("s")))
    rows = keep(base.drop("s"))
    # pages of one hash and number of words are one class: searched once, and paired at the end alone
    c = base.dropDuplicates(named).select(*named, "s", F.when(F.col("s") == "", 0).otherwise(F.size(F.split("s", " "))).alias("nw"))
    c = keep(c.withColumn("id", F.monotonically_increasing_id()))
    discard(base)
    w = F.when(F.col("s") == "", F.array().cast("array<string>")).otherwise(F.split("s", " "))
    near = threshold - 0.00005
    lists = _lists(c.withColumn("w", w), near, k)
    parts = [keep(_repeated(lists, i)) for i in range(PARTS)]
    level = F.col("t").bitwiseAND(F.lit(1))
    mine = Window.partitionBy("id", level)
    ranked = functools.reduce(lambda x, y: x.union(y), parts).withColumn("place", F.row_number().over(mine.orderBy("df", "t"))).withColumn("m", F.count("*").over(mine)).join(lists.select("id", "n", "l0", "l1"), "id")
    room = F.col("n") - F.ceil(F.col("n") * near) + 1  # of the listed shingles so many rarest ones suffice
    prefix = keep(ranked.where(F.col("place") + F.when(level == 0, F.col("l0")).otherwise(F.col("l1")) - F.col("m") <= room).select("t", "id", "n"))
    for x in parts:
        discard(x)
    a, b = prefix.toDF("t", "a", "na"), prefix.toDF("t", "b", "nb")
    fits = F.least("na", "nb") >= F.greatest("na", "nb") * near
    pairs = a.join(b, "t").where((F.col("a") < F.col("b")) & fits).select("a", "b")
    few = c.where(F.col("nw").between(1, k - 1)).select("site", "id", F.explode(F.array_distinct(w)).alias("t"))
    # so many words at most, so no more shingles than these
    most = int(k / threshold)
    other = c.where(F.col("nw") >= k).join(lists.where(F.col("n") <= most**k).select("id"), "id", "left_semi").select("site", F.col("id").alias("v"), F.array_distinct(w).alias("t")).where(F.size("t") <= most).withColumn("t", F.explode("t"))
    mixed = few.join(other, ["site", "t"]).select(F.least("id", "v").alias("a"), F.greatest("id", "v").alias("b"))
    pairs = keep(pairs.union(mixed).distinct())
    discard(lists)
    discard(prefix)
    wanted = c.join(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "id", "left_semi")
    side = lambda x: wanted.select(F.col("id").alias(x), F.col("s").alias(f"s_{x}"), *[F.col(v).alias(f"{v}_{x}") for v in named])
    j = pairs.join(side("a"), "a").join(side("b"), "b").where("site_a = site_b and content_hash_a <> content_hash_b").withColumn("o", _overlap(k)(F.col("s_a"), F.col("s_b")))
    j = j.select("a", "b", F.col("site_a").alias("site"), F.abs(F.col("words_a") - F.col("words_b")).alias("dn"), F.when(F.col("o.whole") > 0, F.round(F.col("o.both") / F.col("o.whole"), 4)).otherwise(0.0).alias("j"))
    j = keep(j.where(F.col("j") >= threshold))
    found = c.join(j.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "id", "left_semi").select("id", *named)
    texts = content.select("site", "url", "main_text").join(rows.join(found, named, "left_semi").select("site", "url"), ["site", "url"], "left_semi")
    # never null: else a filter on that is inferred, which would hash all texts before the join above
    texts = texts.select("site", "url", "main_text", text.word_count(F.col("main_text")).alias("words"), F.coalesce(text.content_hash(F.col("main_text")), F.lit("")).alias("content_hash"))
    own = keep(texts.join(found, named).select("id", "url", text.simhash(F.col("main_text")).alias("f")))
    for x in "ab":
        j = j.join(own.toDF(x, f"u_{x}", f"f_{x}"), x)
    j = j.withColumn("hamming", text.hamming(F.col("f_a"), F.col("f_b"))).where((F.col("hamming") <= 12) | (F.col("dn") <= 30))
    return j.select("site", F.least("u_a", "u_b").alias("url_a"), F.greatest("u_a", "u_b").alias("url_b"), F.round(F.col("j") * 100, 1).alias("similarity"), "hamming")


def _overlap(k: int):
    """both, whole: sizes of intersection and union of two texts' shingles of k words, or words if either has fewer."""

    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        out = []
        for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True):
            x, y = x.split(" ") if x else [], y.split(" ") if y else []
            if len(x) >= k and len(y) >= k:
                x, y = (zip(*[w[i:] for i in range(k)], strict=False) for w in (x, y))
            x, y = set(x), set(y)
            both = len(x & y)
            out.append({"both": both, "whole": len(x) + len(y) - both})
        return pa.array(out, pa.struct([("both", pa.int32()), ("whole", pa.int32())]))

    return F.arrow_udf(run, "both int, whole int")


def boilerplate(content: DataFrame, top: int | None = 10) -> DataFrame:
    """site, block, words, pages: text blocks of 8 words or more that 3 pages of a site have (2, or all, of few pages)."""
    total = content.groupBy("site").agg(F.count("*").alias("n"))
    b = content.select("site", "url", F.explode(F.array_distinct("blocks")).alias("block"))
    found = b.groupBy("site", "block").agg(F.count("*").alias("pages")).withColumn("words", text.word_count(F.col("block"))).where("words >= 8").join(total, "site")
    found = found.where(F.col("pages") >= F.when(F.col("n") >= 4, 3).otherwise(F.greatest(F.lit(2), F.col("n")))).drop("n")
    if top is None:
        return found
    return found.withColumn("_k", F.row_number().over(Window.partitionBy("site").orderBy(F.desc("pages"), "block"))).where(F.col("_k") <= top).drop("_k")


def site_content(content: DataFrame) -> DataFrame:
    """Per site: pages, and URLs that are thin, skip headings, or whose title and H1 disagree."""
    urls = lambda cond: F.sort_array(F.collect_set(F.when(cond, F.col("url"))))
    return content.groupBy("site").agg(
        F.count("*").alias("pages"), urls(F.col("tier").isin("EMPTY", "VERY_LOW", "LOW")).alias("thin"), urls(F.size("headings_evidence.skips") > 0).alias("heading_skips"),
        urls(F.col("alignment.status").isin("MISALIGNED", "WEAK_ALIGNMENT")).alias("title_h1_mismatch"),
    )
