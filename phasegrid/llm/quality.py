"""Operator 3: a quality classifier by regularised quadratic discriminants.

Each document becomes a vector of transformed statistics. A class has a mean and a covariance, shrunk
towards the pooled covariance and towards a multiple of the identity; its Cholesky factor is computed once
and kept in the model. A score is the difference of the classes' log densities (Mahalanobis distance and
log determinant) plus the log ratio of their sizes, as a probability.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import rows, stored, table
from .langid import held_out

STATISTICS = ("words", "word_len", "upper", "digit", "symbol", "bang", "bar", "stop", "noisy_words", "caps_words", "distinct", "stutter", "lines", "line_len", "dup_lines", "top_word")
_KIND = np.zeros((6, 256), np.float64)
for _i, _chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"#*$%&<>@^~=+\\/_{}[]", b"!?", b"|", b".,;:")):
    _KIND[_i, list(_chars)] = 1
_NOISE = frozenset("#*$%&<>|@^~=+_{}[]")


def statistics(text: str | None) -> list[float]:
    """The transformed statistics of a whole text; a null text counts as empty."""
    text = text or ""
    words, n_chars = text.split(), max(1, len(text))
    n = max(1, len(words))
    counts = np.bincount(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8), minlength=256)
    upper, digit, symbol, bang, bar, stop = _KIND @ counts
    kinds: dict[str, int] = {}
    for w in words:
        kinds[w] = kinds.get(w, 0) + 1
    noisy = sum(m for w, m in kinds.items() if w[-1] in _NOISE or w[0] in _NOISE)
    caps = sum(m for w, m in kinds.items() if len(w) > 1 and w.isupper())
    stutter = sum(map(str.__eq__, words[1:], words[:-1]))
    lines = [x for x in text.split("\n") if x.strip()]
    root = lambda x, of: math.sqrt(x / of)
    return [
        math.log1p(len(words)), math.log1p(sum(map(len, words)) / n), root(upper, n_chars), root(digit, n_chars), root(symbol, n_chars), root(bang, n_chars), root(bar, n_chars), root(stop, n_chars),
        root(noisy, n), root(caps, n), math.log(len(kinds) / n) if kinds else 0.0, root(stutter, n), math.log1p(len(lines)), math.log1p(n / max(1, len(lines))), root(len(lines) - len(set(lines)), max(1, len(lines))), root(max(kinds.values(), default=0), n),
    ]


def features(docs: DataFrame) -> DataFrame:
    """(doc_id, x): the statistics of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in rows(batches):
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([statistics(t) for t in texts], pa.list_(pa.float64()))], ["doc_id", "x"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, x array<double>")


@dataclass
class Quadratic:
    """For each class: mean, inverse of the Cholesky factor, log determinant, log share."""

    classes: list[tuple[np.ndarray, np.ndarray, float, float]]
    slope: float = 1.0

    def score(self, x: np.ndarray) -> np.ndarray:
        """P(class 1) of each row of x; 0.5 if a class was never seen."""
        if len(self.classes) < 2 or not len(x):
            return np.full(len(x), 0.5)
        log = []
        for mean, factor, log_det, share in self.classes:
            z = (x - mean) @ factor.T
            log.append(share - 0.5 * (log_det + (z * z).sum(1)))
        return 1 / (1 + np.exp(-np.clip(self.slope * (log[1] - log[0]), -500, 500)))


def fit(labelled: DataFrame, to_pooled: float = 0.2, to_identity: float = 0.02) -> Quadratic:
    """A model from labelled(x, y): every row with y 0 or 1 counts; Spark adds up the classes' moments."""
    d = len(STATISTICS)

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, d + 1, d + 1))
        for xs, ys in rows(batches):
            x, y = np.c_[np.ones(len(xs)), np.array(xs).reshape(-1, d)], np.array(ys)
            for c in (0, 1):
                sums[c] += x[y == c].T @ x[y == c]
        c, i, j = np.nonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(v, pa.int32()) for v in (c, i, j)] + [pa.array(sums[c, i, j])], ["c", "i", "j", "v"])

    got = labelled.select("x", "y").where("y IN (0, 1)").mapInArrow(moments, "c int, i int, j int, v double").groupBy("c", "i", "j").agg(F.sum("v").alias("v")).collect()
    sums = np.zeros((2, d + 1, d + 1))
    for r in got:
        sums[r.c, r.i, r.j] = r.v
    n = sums[:, 0, 0]
    if not n.all():
        return Quadratic([])
    means = sums[:, 0, 1:] / n[:, None]
    scatter = [sums[c, 1:, 1:] - n[c] * np.outer(means[c], means[c]) for c in (0, 1)]
    pooled = sum(scatter) / n.sum()
    classes = []
    for c in (0, 1):
        cov = (1 - to_pooled) * scatter[c] / n[c] + to_pooled * pooled
        cov = (1 - to_identity) * cov + to_identity * (np.trace(pooled) / d + 1e-6) * np.eye(d)
        low = np.linalg.cholesky(cov)
        classes.append((means[c], np.linalg.inv(low), 2 * float(np.log(np.diag(low)).sum()), math.log(n[c] / n.sum())))
    return Quadratic(classes)


def score(vectors: DataFrame, model: Quadratic) -> DataFrame:
    """(doc_id, score) for every row of vectors(doc_id, x)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, xs in rows(batches):
            out = model.score(np.array(xs, float).reshape(-1, len(STATISTICS)))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out)], ["doc_id", "score"])

    return vectors.select("doc_id", "x").mapInArrow(run, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, cut_at: float = 0.7) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of docs; labels(doc_id, quality) are learned from.

    Each label row counts; nulls in doc_id or quality are left out. A null text counts as empty. Without
    labels of both classes each score is 0.5. Repeated rows return as often as they came; other columns are
    not read. Texts are read once: their statistics are stored.
    """
    vectors = stored(features(docs), "statistics")
    known = labels.select("doc_id", F.col("quality").alias("y")).where(~held_out(4, 2) & F.col("y").isNotNull())
    model = fit(vectors.join(known, "doc_id").select("x", "y"))
    return score(vectors, model).select("doc_id", held_out(4, 2).alias("held_out"), "score", (F.col("score") >= cut_at).cast("int").alias("predicted"))


def op3_quality(spark, sf_dir):
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
