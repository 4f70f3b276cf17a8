"""Quality classifier: a sparse ensemble of rules over text statistics.

Small trees are grown on labelled documents; every path from a root gives a conjunction of comparisons. A logistic
regression with an L1 penalty picks the rules that matter, and the result is compiled into one Spark column expression
over the statistics.
"""

from __future__ import annotations

import itertools
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, fold

STATS = ["words", "word_len", "upper", "alpha", "digit", "symbol", "bang", "pipe", "stop", "repeat", "run", "distinct", "top", "short", "line_words", "shout"]
#: Labelled documents that are read at most; trees, their depth, and the bins of a statistic.
FIT_ROWS, TREES, DEPTH, BINS = 20_000, 30, 3, 24
_LETTER, _UPPER, _DIGIT, _SYMBOL = (np.zeros(256, bool) for _ in range(4))
_UPPER[65:91] = True
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_DIGIT[48:58] = True
_SYMBOL[[ord(c) for c in "#$%&*~^<>{}[]=+\\@_`"]] = True


def statistics(text: bytes | None) -> list[float]:
    """The statistics of one text, all 0 without words; shares are of words or of bytes that aren't white space."""
    words = text.split() if text else []
    n = len(words)
    if not n:
        return [0.0] * len(STATS)
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    solid = max(1, int(counts[33:].sum()))
    letters = max(1, int(counts[_LETTER].sum()))
    freq = Counter(words)
    longest = run = 1
    repeats = sum(map(bytes.__eq__, words, itertools.islice(words, 1, None)))
    if repeats:
        for a, b in zip(words, itertools.islice(words, 1, None), strict=False):
            run = run + 1 if a == b else 1
            longest = max(longest, run)
    return [
        float(np.log1p(n)),
        sum(map(len, words)) / n,
        float(counts[_UPPER].sum() / letters),
        float(counts[_LETTER].sum() / solid),
        float(counts[_DIGIT].sum() / solid),
        float(counts[_SYMBOL].sum() / solid),
        counts[33] / n,
        counts[124] / n,
        (counts[46] + counts[63]) / n,
        repeats / max(1, n - 1),
        float(np.log1p(longest - 1)),
        len(freq) / n,
        max(freq.values()) / n,
        sum(k for w, k in freq.items() if len(w) <= 3) / n,
        float(np.log1p(n / (counts[10] + 1))),
        sum(k for w, k in freq.items() if w.isupper()) / n,
    ]


def _split(x: np.ndarray, y: np.ndarray, rows: np.ndarray, edges: list[np.ndarray], features) -> tuple | None:
    """The best (gain, feature, cut) of a node by Gini impurity."""
    best, total, pos = None, len(rows), y[rows].sum()
    impurity = lambda p, n: 2 * p * (n - p) / np.maximum(n, 1)
    for f in features:
        if not len(edges[f]):
            continue
        at = np.searchsorted(edges[f], x[rows, f], side="left")
        n = np.cumsum(np.bincount(at, minlength=len(edges[f]) + 1))[:-1]
        p = np.cumsum(np.bincount(at, weights=y[rows], minlength=len(edges[f]) + 1))[:-1]
        gain = impurity(pos, total) - impurity(p, n) - impurity(pos - p, total - n)
        gain[(n < 5) | (total - n < 5)] = 0
        k = int(gain.argmax())
        if gain[k] > 1e-9 and (best is None or gain[k] > best[0]):
            best = (gain[k], f, float(edges[f][k]))
    return best


def grow_rules(x: np.ndarray, y: np.ndarray, seed: int = 7) -> list[tuple[tuple[int, bool, float], ...]]:
    """Rules as sorted tuples of (statistic, above?, cut), each once, of all nodes of trees on bootstrap samples."""
    rng, rules = np.random.default_rng(seed), {}
    for _ in range(TREES):
        rows = rng.integers(0, len(y), min(len(y), 4000))
        edges = [np.unique(np.quantile(x[rows, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
        features = rng.permutation(x.shape[1])[: max(4, x.shape[1] // 2)]
        todo = [(rows, ())]
        while todo:
            rows, path = todo.pop()
            if len(path) == DEPTH or len(rows) < 10 or not (found := _split(x, y, rows, edges, features)):
                continue
            _, f, cut = found
            above = x[rows, f] > cut
            for side, part in ((True, rows[above]), (False, rows[~above])):
                rule = (*path, (int(f), side, cut))
                rules.setdefault(tuple(sorted(set(rule))))
                todo.append((part, rule))
    return list(rules)


def rule_matrix(x: np.ndarray, rules) -> np.ndarray:
    """Whether each row follows each rule, as bytes."""
    out = np.zeros((len(x), len(rules)), bool)
    for i, r in enumerate(rules):
        out[:, i] = np.all([(x[:, f] > c) == up for f, up, c in r], axis=0)
    return out


def lasso_logistic(z: np.ndarray, y: np.ndarray, penalty: float = 1e-3, steps: int = 600) -> tuple[float, np.ndarray]:
    """Accelerated proximal gradient for the mean logistic loss with an L1 penalty on all but the constant."""
    n, base = len(y), np.clip(y.mean(), 1e-3, 1 - 1e-3)
    b, w = float(np.log(base / (1 - base))), np.zeros(z.shape[1])
    if not z.shape[1]:
        return b, w
    z = z.astype(np.float32)
    size = 0.25 * (float(np.linalg.eigvalsh((z.T @ z).astype(np.float64))[-1]) / n + 1)
    vb, v, t = b, w.copy(), 1.0
    for _ in range(steps):
        err = 1 / (1 + np.exp(-np.clip(vb + z @ v.astype(np.float32), -30, 30))) - y
        nb, nw = vb - err.mean() / size, v - (z.T @ err.astype(np.float32)).astype(np.float64) / n / size
        nw = np.sign(nw) * np.maximum(np.abs(nw) - penalty / size, 0)
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        vb, v = nb + (t - 1) / nt * (nb - b), nw + (t - 1) / nt * (nw - w)
        b, w, t = nb, nw, nt
    return float(b), w


class RuleModel:
    def __init__(self, constant: float, weights: list[tuple[float, tuple]]):
        self.constant, self.weights = constant, weights

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray) -> RuleModel:
        """Without labels of both kinds, the share of label 1 with one document added to either side."""
        if not len(y) or y.min() == y.max():
            p = (y.sum() + 1) / (len(y) + 2)
            return cls(float(np.log(p / (1 - p))), [])
        rules = grow_rules(x, y)
        z = rule_matrix(x, rules)
        keep = [i for i in range(z.shape[1]) if 0 < z[:, i].sum() < len(z)]
        first = {np.packbits(z[:, i]).tobytes(): i for i in reversed(keep)}  # of rules that hold for the same rows, the first
        keep = sorted(first.values())
        b, w = lasso_logistic(z[:, keep], y)
        return cls(b, [(float(a), rules[i]) for i, a in zip(keep, w, strict=True) if abs(a) > 1e-6])

    def column(self, stats: Column) -> Column:
        """The score as an expression over the array of statistics."""
        total = F.lit(self.constant)
        for w, rule in self.weights:
            hold = F.lit(True)
            for f, up, cut in rule:
                hold = hold & ((stats[f] > cut) if up else (stats[f] <= cut))
            total = total + F.when(hold, F.lit(w)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))

    def predict(self, x: np.ndarray) -> np.ndarray:
        z = rule_matrix(x, [r for _, r in self.weights])
        return 1 / (1 + np.exp(-(self.constant + z @ np.array([w for w, _ in self.weights]))))


def measured(text: Column) -> Column:
    """The statistics of a binary column, as an array of doubles."""

    def run(texts: pd.Series) -> pd.Series:
        return texts.map(statistics)

    return F.pandas_udf(run, "array<double>")(text)


def fit_quality(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> RuleModel:
    """A model from labelled documents whose fold (crc32 of doc_id, modulo 5) is not 0.

    At most about fit_rows of them are read, those with the smallest hashes. Of several labels of a doc_id the lowest counts.
    """
    bounded_batches(docs.sparkSession)
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality")).where(fold("doc_id", 5) != 0)
    rate = min(1.0, fit_rows / max(1, known.count()))
    some = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(rate * 1_000_000)) if rate < 1 else known
    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text")).join(F.broadcast(some), "doc_id").select("doc_id", "quality", measured(F.col("text")).alias("s")).collect()
    rows.sort(key=lambda r: (r.doc_id, r.s))
    return RuleModel.fit(np.array([r.s for r in rows], float).reshape(len(rows), len(STATS)), np.array([r.quality for r in rows], float))


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, fit_rows: int = FIT_ROWS) -> DataFrame:
    """docs with quality_score (0 to 1) and good (1 from the threshold on); columns of these names are replaced.

    A null, empty or blank text has statistics of 0 and a score like any other. An empty table gives an empty one.
    """
    model = fit_quality(docs, labels, fit_rows)
    base = docs.drop("quality_score", "good").withColumn("_s", measured(F.col("text").cast("binary")))
    return base.withColumn("quality_score", model.column(F.col("_s"))).withColumn("good", (F.col("quality_score") >= threshold).cast("int")).drop("_s")
