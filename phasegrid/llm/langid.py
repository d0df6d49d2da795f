"""Operator 2: language identification by mixtures.

A document is a bag of hashed byte trigrams, drawn from a mixture of languages and one background part
that is flat over all trigrams. Expectation-maximisation gives the parts' proportions; the set of languages
is grown from the single best one for as long as the penalised log-likelihood rises.

The model is fitted on a bounded sample of labelled rows: about PER_LANG whole documents of each language,
chosen by a hash of the id. Every label that occurs gets a model, held as the counts of the trigrams its sample has: what is
sent to the executors is 8 bytes for each trigram of each language, of at most 65,536, whatever the size of the corpus.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import rows, table

BUCKETS, PER_LANG, PRIOR = 1 << 16, 3000, 0.5
#: Overlapping trigrams repeat each other's evidence: three count as one.
OVERLAP = 3.0
LETTER = re.compile(r"[^\W\d_]")

_FOLD = np.arange(256, dtype=np.uint32)
_FOLD[:128] = [ord(chr(i).lower()) if chr(i).isalpha() else 32 for i in range(128)]


def trigrams(text: str) -> np.ndarray:
    """Buckets of the byte trigrams of a text: ASCII lower-cased, its non-letters read as spaces, runs of spaces left out."""
    raw = _FOLD[np.frombuffer(f" {text} ".encode("utf-8", "surrogatepass"), np.uint8)]
    raw = raw[np.r_[True, (raw[1:] != 32) | (raw[:-1] != 32)]]
    code = (raw[:-2] << np.uint32(16)) | (raw[1:-1] << np.uint32(8)) | raw[2:]
    return (code * np.uint32(0x9E3779B1)) >> np.uint32(16)


def _em(p: np.ndarray, n: np.ndarray, steps: int) -> tuple[np.ndarray, float]:
    """Proportions of the parts and the log-likelihood; p: probabilities (trigram, part), n: counts."""
    total = n.sum()
    mix = np.full(p.shape[1], 1 / p.shape[1])
    for _ in range(steps):
        new = mix * ((n / (p @ mix)) @ p) / total
        done = np.abs(new - mix).max() < 1e-3
        mix = new
        if done:
            break
    return mix, float(n @ np.log(p @ mix))


@dataclass
class Model:
    """Counts by bucket: those of bucket b, for the languages lang[start[b]:start[b + 1]], are n[start[b]:start[b + 1]]."""

    langs: list[str]
    start: np.ndarray
    lang: np.ndarray
    n: np.ndarray

    def __post_init__(self):
        total = np.bincount(self.lang, self.n, len(self.langs)) + PRIOR * BUCKETS
        self.floor, self.p = (PRIOR / total).astype(np.float32), ((PRIOR + self.n) / total[self.lang]).astype(np.float32)

    def rows(self, grams: np.ndarray) -> np.ndarray:
        """Probabilities (trigram, language and then the background)."""
        first, size = self.start[grams], self.start[grams + 1] - self.start[grams]
        out = np.empty((len(grams), len(self.langs) + 1), np.float32)
        out[:, :-1], out[:, -1] = self.floor, 1 / BUCKETS
        at = np.repeat(first - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())
        out[np.repeat(np.arange(len(grams)), size), self.lang[at]] = self.p[at]
        return out

    def mixture(self, text: str | None, steps: int = 12) -> dict[str, float]:
        """Proportions of the chosen languages; what is missing to 1 is background. Empty without letters or languages."""
        if not text or not self.langs or not LETTER.search(text):
            return {}
        grams, n = np.unique(trigrams(text), return_counts=True)
        p, n, back = self.rows(grams.astype(np.int64)), n.astype(np.float32), len(self.langs)
        alone = n @ np.log(p[:, :back])
        first = int(np.argmax(alone))
        full, _ = _em(p, n, steps)
        others = [int(i) for i in np.argsort(-full[:back], kind="stable") if i != first and full[i] > 0.02]
        cost = 0.5 * np.log(max(2.0, n.sum() / OVERLAP)) * OVERLAP
        chosen = [first]
        mix, best = _em(p[:, [first, back]], n, steps)
        for i in others:
            new, like = _em(p[:, [*chosen, i, back]], n, steps)
            if like - best <= cost:
                break
            chosen, mix, best = [*chosen, i], new, like
        return {self.langs[i]: float(m) for i, m in zip(chosen, mix)}

    def best(self, text: str | None) -> tuple[str, float]:
        found = self.mixture(text)
        return max(sorted(found.items()), key=lambda x: x[1]) if found else ("und", 0.0)


def fit(labelled: DataFrame, per_lang: int = PER_LANG) -> Model:
    """A model from labelled(doc_id, text, lang), of about per_lang documents of each language.

    Rows with a null text or lang are left out. Without any, the model has no language.
    """
    spark = labelled.sparkSession
    labelled = labelled.select("doc_id", "text", "lang").where("text IS NOT NULL AND lang IS NOT NULL")
    sizes = labelled.groupBy("lang").count().collect()
    langs = sorted(r["lang"] for r in sizes)
    if not langs:
        return Model([], np.zeros(BUCKETS + 1, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int32))
    number = {v: i for i, v in enumerate(langs)}
    share = spark.createDataFrame([(r["lang"], min(1.0, per_lang / r["count"])) for r in sizes], "lang string, share double")
    sample = labelled.join(F.broadcast(share), "lang").where("pmod(xxhash64(doc_id, 'langid'), 1000000) < share * 1000000").select("text", "lang")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for texts, of in rows(batches):
            for text, lang in zip(texts, of):
                if (i := number[lang]) not in sums:
                    if len(sums) == 64:
                        yield from map(_counted, sums.items())
                        sums.clear()
                    sums[i] = np.zeros(BUCKETS, np.int64)
                sums[i] += np.bincount(trigrams(text), minlength=BUCKETS)
        yield from map(_counted, sums.items())

    got = sample.mapInArrow(count, "lang long, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas().sort_values(["gram", "lang"])
    start = np.r_[0, np.cumsum(np.bincount(got["gram"], minlength=BUCKETS))]
    return Model(langs, start, got["lang"].to_numpy(np.int32), got["n"].to_numpy(np.int32))


def _counted(item: tuple[int, np.ndarray]) -> pa.RecordBatch:
    lang, sums = item
    gram = np.flatnonzero(sums)
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(gram), lang)), pa.array(gram), pa.array(sums[gram])], ["lang", "gram", "n"])


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score, n_langs) for every row of docs(doc_id, text).

    score is the proportion of the most frequent language, background counted. Texts that are null or have
    no letter are `und` with score 0. Ties go to the first language by name.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for ids, texts in rows(batches):
            found = [m.mixture(t) for t in texts]
            top = [max(sorted(x.items()), key=lambda y: y[1]) if x else ("und", 0.0) for x in found]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array([x[0] for x in top], pa.string()), pa.array([min(1.0, max(0.0, x[1])) for x in top], pa.float64()), pa.array([len(x) for x in found], pa.int32())],
                ["doc_id", "lang_pred", "score", "n_langs"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double, n_langs int")


def keep_known(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The rows of docs whose text is for at least `least` in the model's languages; `und` texts go."""
    sent, schema = docs.sparkSession.sparkContext.broadcast(model), docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                found = [m.mixture(t) for t in part.column("text").to_pylist()]
                yield part.filter(pa.array([bool(x) and sum(x.values()) >= least for x in found]))

    return docs.mapInArrow(run, schema)


def held_out(mod: int, left: int):
    """Whether the CRC-32 of the id's text leaves `left` modulo `mod`; false for a null id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % mod == left, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, n_langs): learned from the rows that aren't held out, predicted for all.

    Only text and lang are learned from, only text is predicted from. Null ids count as not held out but
    are not learned from. Repeated rows return as often as they came; other columns are not read.
    """
    model = fit(docs.where(~held_out(5, 0) & F.col("doc_id").isNotNull()))
    return predict(docs, model).select("doc_id", held_out(5, 0).alias("held_out"), "lang_pred", "score", "n_langs")


def op2_langid(spark, sf_dir):
    return identify(table(spark, sf_dir, "documents"))
