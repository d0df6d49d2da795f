import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from phasegrid.llm import langid as L
from phasegrid.llm import quality as Q

SMALL = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, share double, x string"


def test_language_held_out_accuracy(spark):
    got = L.op2_langid(spark, SMALL)
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "lang")
    r = got.where("held_out").join(docs, "doc_id").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")).alias("a"), F.count("*").alias("n")).first()
    assert r.n > 100 and r.a > 0.98
    assert got.count() == 1000 and got.where(~F.col("score").between(0, 1)).count() == 0


def test_held_out_by_crc(spark):
    import zlib

    ids = [0, 1, 7, -5, 123456789, None]
    got = spark.createDataFrame([(i,) for i in ids], "doc_id long").select("doc_id", L.held_out(5, 0).alias("h"), L.held_out(4, 2).alias("q")).collect()
    for r in got:
        crc = zlib.crc32(str(r.doc_id).encode()) if r.doc_id is not None else None
        assert r.h == (crc is not None and crc % 5 == 0) and r.q == (crc is not None and crc % 4 == 2)


@pytest.fixture(scope="module")
def model(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    return L.fit(docs)


def test_mixtures_and_rejects(spark, model):
    docs = {r.lang: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").where("n_chars > 3000").groupBy("lang").agg(F.max_by("text", "doc_id").alias("text")).collect()}
    both = docs["en"][:1500] + " " + docs["de"][:1500]
    mix = model.mixture(both)
    assert set(mix) == {"en", "de"} and all(0.3 < v < 0.7 for v in mix.values())
    assert set(model.mixture(docs["fr"])) == {"fr"}
    for none in (None, "", "123 456 !!!", " \n"):
        assert model.best(none) == ("und", 0.0)
    assert model.best("zqxj " * 200)[1] < 0.5


TINY = "/root/testdata/sf0.001"


def brute_grams(text):
    """Hashed byte trigrams, one after the other."""
    folded = ""
    for b in f" {text} ".encode("utf-8", "surrogatepass"):
        c = chr(b)
        c = c if b > 127 else c.lower() if c.isalpha() else " "
        folded += "" if c == " " and folded.endswith(" ") else c
    code = [(ord(x) << 16) + (ord(y) << 8) + ord(z) for x, y, z in zip(folded, folded[1:], folded[2:])]
    return Counter(c * 0x9E3779B1 % 2**32 >> 16 for c in code)


def brute_mixture(text, counts, totals):
    """The penalised choice of languages, by loops over a dictionary of counts."""
    langs, grams = sorted(counts), brute_grams(text)
    n, all_ = sum(grams.values()), [*sorted(counts), None]
    p = lambda g, x: 1 / 65536 if x is None else (counts[x].get(g, 0) + 0.5) / totals[x]

    def em(parts):
        mix = dict.fromkeys(parts, 1 / len(parts))
        for _ in range(12):
            new = dict.fromkeys(parts, 0.0)
            for g, k in grams.items():
                whole = sum(mix[x] * p(g, x) for x in parts)
                for x in parts:
                    new[x] += k * mix[x] * p(g, x) / whole / n
            done = max(abs(new[x] - mix[x]) for x in parts) < 1e-3
            mix = new
            if done:
                break
        return mix, sum(k * math.log(sum(mix[x] * p(g, x) for x in parts)) for g, k in grams.items())

    first = max(langs, key=lambda x: sum(k * math.log(p(g, x)) for g, k in grams.items()))
    full = em(all_)[0]
    chosen, (mix, best) = [first], em([first, None])
    for x in sorted((x for x in langs if x != first and full[x] > 0.02), key=lambda x: -full[x]):
        new, like = em([*chosen, x, None])
        if like - best <= 1.5 * math.log(max(2.0, n / 3)):
            break
        chosen, mix, best = [*chosen, x], new, like
    return {x: mix[x] for x in chosen}


def test_predictions_equal_brute_force(spark):
    import zlib

    docs = spark.read.parquet(f"{TINY}/documents.parquet").collect()
    counts = {}
    for r in docs:
        if r.text is not None and r.lang is not None and zlib.crc32(str(r.doc_id).encode()) % 5:
            counts.setdefault(r.lang, Counter()).update(brute_grams(r.text))
    totals = {x: sum(c.values()) + 0.5 * 65536 for x, c in counts.items()}
    got = {r.doc_id: r for r in L.op2_langid(spark, TINY).collect()}
    asked = [r for r in docs if r.text and len(r.text) < 2500][:70]
    for r in asked:
        want = brute_mixture(r.text, counts, totals) if any(c.isalpha() for c in r.text) else {}
        lang = max(sorted(want), key=want.get) if want else "und"
        assert (got[r.doc_id].lang_pred, got[r.doc_id].n_langs) == (lang, len(want)) and got[r.doc_id].score == pytest.approx(want.get(lang, 0.0), abs=2e-3)
    assert len(asked) > 40


def test_two_hundred_languages_are_all_predicted(spark):
    rng = np.random.default_rng(3)
    letters = list("abcdefghijklmnopqrstuvwxyz")
    vocabulary = {f"l{i:03d}": ["".join(rng.choice(letters, 5)) for _ in range(12)] for i in range(200)}
    rows = [(1000 * k + i, " ".join(rng.choice(vocabulary[x], 40)), x, 0.0, "x") for i, x in enumerate(vocabulary) for k in range(4)]
    model = L.fit(spark.createDataFrame(rows, SCHEMA))
    fresh = spark.createDataFrame([(i, " ".join(rng.choice(w, 30)), None, 0.0, "x") for i, w in enumerate(vocabulary.values())], SCHEMA)
    got = {r.doc_id: r.lang_pred for r in L.predict(fresh, model).collect()}
    assert len(model.langs) == 200 and sum(got[i] == x for i, x in enumerate(vocabulary)) >= 198


def test_em_likelihood_never_falls():
    rng = np.random.default_rng(0)
    p, n = rng.dirichlet([1] * 50, 3).T, rng.integers(1, 9, 50).astype(float)
    likes = [L._em(p, n, s)[1] for s in range(1, 12)]
    assert all(b >= a - 1e-9 for a, b in zip(likes, likes[1:]))


def test_language_edge_rows(spark, model):
    long = "The and attion to thanedble the, anea. " * 20_000
    rows = [(1, None, "en", 0.0, "x"), (2, "", None, 0.0, None), (None, "The and attion", "en", 1.0, "x"), (3, long, "en", 1.0, "x"), (3, long, "en", 1.0, "x"), (4, "é", "fr", 1.0, "x")]
    got = L.identify(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == 6 and {r.lang_pred for r in got if r.doc_id in (1, 2)} == {"und"}
    assert L.identify(spark.createDataFrame([], SCHEMA)).count() == 0
    nothing = spark.createDataFrame([(1, "some words", None, 1.0, "x")], SCHEMA)
    assert [r.lang_pred for r in L.identify(nothing).collect()] == ["und"]
    kept = L.keep_known(spark.createDataFrame(rows, SCHEMA), model)
    assert kept.columns == ["doc_id", "text", "lang", "share", "x"] and sorted(r.doc_id or 0 for r in kept.collect())[:3] == [0, 3, 3]


def test_quality_held_out_accuracy(spark):
    got = Q.op3_quality(spark, SMALL)
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    r = got.where("held_out").join(labels, "doc_id").agg(F.avg((F.col("quality") == F.col("predicted")).cast("int")).alias("a"), F.count("*").alias("n")).first()
    assert r.n > 50 and r.a > 0.95
    assert got.count() == 1000 and got.where("predicted <> cast(score >= 0.7 AS int)").count() == 0


def test_quadratic_equals_its_definition():
    rng = np.random.default_rng(1)
    d = len(Q.STATISTICS)
    a = [rng.normal(size=(d, d)) for _ in range(2)]
    covs, means = [x @ x.T + np.eye(d) for x in a], rng.normal(size=(2, d))
    classes = [(m, np.linalg.inv(np.linalg.cholesky(c)), float(np.linalg.slogdet(c)[1]), np.log(s)) for m, c, s in zip(means, covs, (0.3, 0.7))]
    x = rng.normal(size=(20, d))
    log = [np.log(s) - 0.5 * (np.linalg.slogdet(c)[1] + np.einsum("ni,ij,nj->n", x - m, np.linalg.inv(c), x - m)) for m, c, s in zip(means, covs, (0.3, 0.7))]
    assert Q.Quadratic(classes).score(x) == pytest.approx(1 / (1 + np.exp(np.clip(log[0] - log[1], -500, 500))))


def brute_statistics(text):
    """The sixteen numbers by plain loops over characters, words and lines."""
    text = text or ""
    words, lines = text.split(), [x for x in text.split("\n") if x.strip()]
    share = lambda chars: math.sqrt(sum(c in chars for c in text) / max(1, len(text)))
    of_words = lambda n: math.sqrt(n / max(1, len(words)))
    noise, most = "#*$%&<>|@^~=+_{}[]", max((words.count(w) for w in set(words)), default=0)
    return [
        math.log1p(len(words)), math.log1p(sum(len(w) for w in words) / max(1, len(words))), share("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), share("0123456789"), share("#*$%&<>@^~=+\\/_{}[]"), share("!?"), share("|"), share(".,;:"),
        of_words(sum(w[0] in noise or w[-1] in noise for w in words)), of_words(sum(len(w) > 1 and w == w.upper() and w != w.lower() for w in words)),
        math.log(len(set(words)) / len(words)) if words else 0.0, of_words(sum(a == b for a, b in zip(words, words[1:]))),
        math.log1p(len(lines)), math.log1p(max(1, len(words)) / max(1, len(lines))), math.sqrt((len(lines) - len(set(lines))) / max(1, len(lines))), of_words(most),
    ]


def test_scores_equal_brute_force(spark):
    import zlib

    docs = [r for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    x = {r.doc_id: np.array(brute_statistics(r.text) if len(r.text or "") < 6000 else Q.statistics(r.text)) for r in docs}
    learn = [[x[i] for i, y in labels.items() if y == c and i in x and zlib.crc32(str(i).encode()) % 4 != 2] for c in (0, 1)]
    n = [len(a) for a in learn]
    covs = [np.cov(np.array(a).T, bias=True) for a in learn]
    pooled = (n[0] * covs[0] + n[1] * covs[1]) / sum(n)
    logs = []
    for c in (0, 1):
        cov = 0.8 * covs[c] + 0.2 * pooled
        cov = 0.98 * cov + 0.02 * (np.trace(pooled) / len(cov) + 1e-6) * np.eye(len(cov))
        inverse, mean = np.linalg.inv(cov), np.mean(learn[c], 0)
        logs.append({i: math.log(n[c] / sum(n)) - 0.5 * (np.linalg.slogdet(cov)[1] + (v - mean) @ inverse @ (v - mean)) for i, v in x.items()})
    got = {r.doc_id: r.score for r in Q.op3_quality(spark, SMALL).collect()}
    assert len(got) == len(x) == 1000
    for i in x:
        assert got[i] == pytest.approx(1 / (1 + math.exp(min(500, max(-500, logs[0][i] - logs[1][i])))), abs=1e-6)


def test_quality_edge_rows(spark):
    rows = [(i, "Good plain words in a row here, again and more.", "en", 0.0, "x") for i in range(30)] + [(i, "BAD!! BAD!! ### $$$ | x |", "en", 0.0, "x") for i in range(30, 60)]
    rows += [(100, None, None, None, None), (101, "", "x", 0.0, "x"), (None, "no id", "x", 0.0, "x"), (102, "long " * 100_000, "x", 0.0, "x"), (5, "repeated", "x", 0.0, "x")]
    docs = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(i, int(i < 30), 0.5) for i in range(60)] + [(None, 1, 0.1), (100, None, 0.1), (5, 1, 0.2)], "doc_id long, quality int, x double")
    got = Q.classify(docs, labels).collect()
    assert len(got) == 65 and all(0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r.score for r in got}
    assert by[3] > 0.7 and by[40] < 0.3
    assert Q.classify(docs.limit(0), labels).count() == 0
    assert {r.score for r in Q.classify(docs, labels.where("quality = 1")).collect()} == {0.5}
