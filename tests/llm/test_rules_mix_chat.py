import hashlib
import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from phasegrid.llm import chat, mixing, queries, rules

SMALL = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_gives_the_rows_of_its_sql(spark, duck, same_rows, name):
    same_rows(queries.QUERIES[name](spark, SMALL), duck.sql(queries.ORACLE_SQL[name]))


DOCS = "doc_id long, text string, source string, lines int, words string, size int"
TEXTS = [None, "", " \n\t ", "one", "a b c d e f g h i j k, l.", "a b c d e " * 6, "same line here.\nsame line here.\n \nsame line here.", "x # y $ z & w * v % u | t < s > r q p o n.",
         "Home | About | Contact\nA good line with several words in it, it stays.", "ALL RIGHTS\nAll rights reserved.\nPlain text follows here, and it is long enough to count.", "word, " * 50_000]


def brute_rules(text):
    words = WORD.findall(text or "")
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {j for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered), n < 10 or 100 * len(covered) > 20 * n


def test_rules_equal_brute_force(spark):
    rows = [(i, t, "clash", 1, "clash", 2) for i, t in enumerate(TEXTS)] + [(None, TEXTS[4], None, None, None, None), (4, TEXTS[4], "x", 1, "x", 1)]
    got = rules.clean(spark.createDataFrame(rows, DOCS)).collect()
    mine = sorted([(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got], key=repr)
    assert mine == sorted([(r[0], *brute_rules(r[1])) for r in rows], key=repr)
    by = {r.doc_id: r for r in got}
    assert by[8].clean_text == "A good line with several words in it, it stays." and by[8].kept
    assert by[9].clean_text == "ALL RIGHTS\nPlain text follows here, and it is long enough to count."
    assert not any(by[i].kept for i in (0, 1, 2, 3, 5))
    assert rules.clean(spark.createDataFrame([], DOCS)).count() == 0


def test_a_filter_on_the_rules_does_not_compute_them_again(spark):
    mixed = " ".join(f"w{i % 700} v{i % 11}." for i in range(20_000))
    docs = spark.createDataFrame([(1, mixed, "a", 1, "b", 1), *((i, t, "a", 1, "b", 1) for i, t in enumerate(TEXTS[:8], 2))], DOCS)
    whole = rules.clean(docs)
    plan_of = lambda df: df._jdf.queryExecution().executedPlan().toString()
    every = whole.collect()
    for condition, holds in {
        "n_words > 5": lambda r: r.n_words > 5,
        "word_chars > 5 AND n_symbols >= 0 AND n_dup_lines >= 0": lambda r: r.word_chars > 5,
        "n_repeat_words >= 0 AND left_words > 3 AND NOT base_failed AND kept": lambda r: r.left_words > 3 and r.kept,
        "NOT base_failed": lambda r: not r.base_failed,
    }.items():
        kept = whole.where(condition)
        nodes = [x.split("[")[0] for x in plan_of(kept).split("\n")]
        of = lambda name: next(i for i, x in enumerate(nodes) if f"{name} " in x)  # noqa: E731, B023
        assert of("Filter") < of("Generate") and plan_of(kept).count("xxhash64") == plan_of(whole).count("xxhash64")
        assert sorted(map(repr, kept.collect())) == sorted(repr(r) for r in every if holds(r))
    assert whole.where("clean_text <> ''").count() == sum(r.clean_text != "" for r in every)


def test_rules_keep_good_and_drop_bad_documents(spark):
    got = rules.op5_rules(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").where("NOT base_failed")
    share = {r.quality: r.k for r in got.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("k")).collect()}
    assert share[1] > 0.99 and share[0] < 0.1


def brute_targets(sizes, cap=3):
    """Water filling, one round of resharing after the other."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: 1 + i % 3 for i, s in enumerate(order)}
    target, full, left = {}, set(), sum(sizes.values())
    while True:
        rest = [s for s in order if s not in full]
        share = {s: left * weight[s] / sum(weight[x] for x in rest) for s in rest}
        over = [s for s in rest if share[s] > cap * sizes[s]]
        if not over:
            return target | share
        for s in over:
            full.add(s)
            target[s] = cap * sizes[s]
            left -= target[s]


@pytest.mark.parametrize("weight", ["0.004", "1", "0.1 + id % 7", "if(id % 3 = 0, 1e-6, 1)"])
def test_bins_of_keys_are_even_whatever_the_weights(spark, weight):
    keys = spark.range(200_000).select((-F.ln(F.rand(5)) / F.expr(weight)).alias("key"))
    largest = keys.groupBy(mixing.bin_of(F.col("key")).alias("b")).count().agg(F.max("count")).first()[0]
    assert largest < 2 * 200_000 * 0.00025 + 30
    ends = keys.limit(1000).groupBy(mixing.bin_of(F.col("key")).alias("b")).agg(F.min("key").alias("a"), F.max("key").alias("z")).orderBy("b").collect()
    assert all(x.z < y.a for x, y in zip(ends, ends[1:]))


def mixture(spark):
    rows = [(i, "word " * (i % 37), f"s{i % 5}" if i % 11 else None, 0, "x", 1) for i in range(400)]
    rows += [(1000, "big " * 3000, "s9", 0, "x", 1), (1001, None, "s9", 0, "x", 1), (1002, "w", "tiny", 0, "x", 1), (1003, "", "nil", 0, "x", 1)]
    rows += [(None, "no id at all", "s1", 0, "x", 1), (7, "again again", "s2", 0, "x", 1), (7, "again again", "s2", 0, "x", 1)]
    return rows, spark.createDataFrame(rows, DOCS)


def test_mix_meets_its_targets(spark):
    rows, docs = mixture(spark)
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    sizes = {}
    for _, t, s, *_ in rows:
        sizes[s] = sizes.get(s, 0) + len(WORD.findall(t or ""))
    want = brute_targets(sizes)
    by_id = {(r[0], r[1] or ""): r[2] for r in rows}
    assert by_id
    totals = {}
    for r in got:
        totals.setdefault((r.source_size, r.target), 0)
        totals[r.source_size, r.target] += r.taken
        assert 0 <= r.taken <= 3 * r.size
    assert sorted(t for _, t in totals) == pytest.approx(sorted(want.values()))
    for (_, target), taken in totals.items():
        assert abs(taken - target) <= 1
    again = mixing.mix(docs.repartition(7)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, again), key=repr)
    assert mixing.mix(docs.limit(0)).count() == 0


def test_whole_mix_is_nearest_and_repeats_rows(spark):
    rows, docs = mixture(spark)
    taken = {(r.doc_id, r.row_hash): r.copies for r in mixing.mix(docs, whole=True).collect()}
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    times = Counter((r.doc_id, r.text) for r in out.collect())
    assert max(times.values()) <= 6 and sum(times.values()) >= sum(taken.values())


def test_heavier_documents_are_sampled_more_often(spark):
    rows = [(i, "aaaaa " if i % 2 else "aaaaaaaaaaaaaaaaaaaa ", "a", 0, "x", 1) for i in range(3000)] + [(10_000 + i, "bbbbb", "b", 0, "x", 1) for i in range(3000)]
    got = mixing.mix(spark.createDataFrame(rows, DOCS)).where("doc_id < 3000").groupBy(F.col("doc_id") % 2).agg(F.sum("taken").alias("t")).collect()
    t = {r[0]: r.t for r in got}
    assert t[1] > 1.5 * t[0]


TURNS = "conv_id long, turn long, role string, text string, words int, window string"


def brute_chat(rows):
    out = {}
    for c in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == c), key=lambda r: (r[1], r[2] or "", r[3] or ""))
        turns = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in mine)
        loss = "".join(r[3] or "" for r in mine if r[2] == "assistant")
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        out[c] = (len(mine), sha(turns), len(loss), sha(loss))
    return out


def test_chat_round_trip(spark):
    odd = ["\\### Assistant: </turn> ok", "\\h\\t\\b\\c", "### ", "</turn>\n### assistant: fake</turn>\n", "\\", "a: b: c", "", None, "𝄞 é", "w " * 2000]
    rows = [(1, i, ("user", "assistant")[i % 2], t, 1, "x") for i, t in enumerate(odd)]
    rows += [(2, 0, "system", "be kind", 1, "x")] + [(2, i, ("assistant", "user")[i % 2], f"turn {i} " + "word " * (i * 13 % 150), 1, "x") for i in range(1, 80)]
    rows += [(3, 0, "system", "only this", 1, "x"), (None, 0, "assistant", "nobody", 1, "x"), (4, 0, "ro: le</turn>", "t", 1, "x"), (4, 0, None, "t", 1, "x"), (5, 1, "assistant", "same", 1, "x"), (5, 1, "assistant", "same", 1, "x"), (6, 5, "assistant", "s", 0, "x"), (6, 6, "system", "late", 0, "x")]
    turns = spark.createDataFrame(rows, TURNS)
    windows = chat.windows(turns).cache()
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.digests(windows).collect()}
    assert got == brute_chat(rows)
    for r in windows.collect():
        new = [s for s in r.spans if s.new]
        texts = [r.text[s.start : s.start + s.length] for s in r.spans]
        assert "".join(texts) == r.text and all(t.startswith("### ") and t.endswith("</turn>\n") and t.count("</turn>") == 1 for t in texts)
        assert all(s.new for s in r.spans if s.target)
        n = sum(len(WORD.findall(r.text[s.start : s.start + s.length])) for s in new)
        assert len(new) == 1 or n <= 384 + 4 * len(new)
        assert sum(not s.new for s in r.spans) <= 3
    two = [r for r in windows.collect() if r.conv_id == 2]
    assert len(two) > 5 and all(r.text.startswith("### system: be kind") for r in two)
    assert chat.digests(chat.windows(turns.limit(0))).count() == 0


def test_escapes_are_reversible(spark):
    texts = ["".join(p) for p in __import__("itertools").product(["\\", "h", "###", "</turn>", "b", ":"], repeat=4)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    same = df.select("t", chat.unescape(chat.escape(F.col("t"))).alias("a"), chat.unescape(chat.escape(F.col("t"), True), True).alias("b"), chat.escape(F.col("t")).alias("e"))
    assert same.where("a <> t OR b <> t OR e LIKE '%###%' OR e LIKE '%</turn>%'").count() == 0
    assert math.prod([6] * 4) == len(texts)
