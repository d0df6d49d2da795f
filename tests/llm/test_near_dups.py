import hashlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from phasegrid.llm import components, fingerprint, simhash_dedup as S

SCHEMA = "doc_id long, text string, fp string, bucket int"


def brute_fingerprint(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
    if not words:
        return 0
    parts = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(ids, fps, radius):
    root = {i: i for i in range(len(fps))}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= radius:
                root[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [least.get(find(i)) for i in range(len(fps))]


def texts(rng, n):
    words = [f"w{i}" for i in range(400)]
    base = [" ".join(rng.choice(words, rng.integers(30, 90))) for _ in range(n)]
    near = []
    for b in base[: n // 2]:
        w = b.split()
        w[int(rng.integers(len(w)))] = "Changed"
        near.append(" ".join(w))
    return base + near + base[:5]


def test_near_duplicates_equal_brute_force(spark):
    all_ = [None, "", " \t\n", "one", "ONE", "two words here", "É é", "x " * 30_000, *texts(np.random.default_rng(1), 40)]
    rows = [(i * 3 % 1009, t, "clash", 1) for i, t in enumerate(all_)] + [(None, all_[9], None, None), (None, "nobody else", "x", 2), (7, all_[8], "a", 1), (7, all_[8], "a", 1)]
    got = S.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    fps = [brute_fingerprint(t) for _, t, *_ in rows]
    want = sorted(zip([r[0] for r in rows], [f"{f:016x}" for f in fps], brute_components([r[0] for r in rows], fps, 4)), key=repr)
    assert sorted([(r.doc_id, r.fingerprint, r.component_id) for r in got], key=repr) == want


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert S.near_duplicates(empty).count() == 0
    assert S.one_of_each(empty).count() == 0
    assert fingerprint.with_next(empty).count() == 0


def test_links_of_many_close_fingerprints(spark):
    rng = np.random.default_rng(2)
    centre = rng.integers(0, 2**63, 6, dtype=np.uint64)
    codes = {int(c) for c in centre}
    for c in centre:
        for _ in range(150):
            code = int(c)
            for b in rng.choice(64, rng.integers(1, 6), replace=False):
                code ^= 1 << int(b)
            codes.add(code)
    codes = sorted(codes)
    signed = [c - 2**64 if c >> 63 else c for c in codes]
    df = spark.createDataFrame([(c,) for c in signed], "fp long")
    edges = S.links(df, crowd=100, most_pairs=1000)
    assert edges.count() <= 5 * 2 * len(codes)
    found = {r.node: r.root for r in components.components(edges).collect()}
    want = brute_components(range(len(codes)), codes, 4)
    groups = {}
    for s, w in zip(signed, want):
        groups.setdefault(w, set()).add(found.get(s, s))
    assert all(len(g) == 1 for g in groups.values()) and len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_gray_index_is_exact():
    rng = np.random.default_rng(3)
    codes = np.unique(rng.integers(0, 2**12, 700, dtype=np.uint64) << np.uint64(20))
    codes = codes[np.argsort(S.gray_rank(codes))]
    assert (np.diff(S.gray_rank(codes).astype(float)) > 0).all()
    index = S.GrayIndex(codes, np.zeros(len(codes), int))
    who, entry = index.search(codes, np.zeros(len(codes), int), np.arange(len(codes)), 3)
    want = {(i, j) for i in range(len(codes)) for j in range(i + 1, len(codes)) if bin(int(codes[i] ^ codes[j])).count("1") <= 3}
    assert set(zip(who.tolist(), entry.tolist())) == want


@pytest.mark.parametrize("crowd,deepest", [(50_000, 3), (40, 3), (5, 2), (2, 1)])
def test_links_of_crowded_blocks_equal_brute_force(spark, crowd, deepest):
    rng = np.random.default_rng(9)
    lead = int(rng.integers(2**12)) << 52
    codes = [lead | int(c) for c in rng.integers(0, 2**52, 120)]
    for c in codes[:60]:
        for d in (1, 3, 4, 5, 6):
            x = c
            for b in rng.choice(64, d, replace=False):
                x ^= 1 << int(b)
            codes.append(x)
    signed = [c - 2**64 if c >> 63 else c for c in codes]
    edges = S.links(spark.createDataFrame([(c,) for c in signed], "fp long").distinct(), crowd=crowd, deepest=deepest)
    got = {r.node: r.root for r in components.components(edges).collect()}
    assert [got.get(c, c) for c in signed] == brute_components(signed, codes, 4)


def test_one_of_each_ignores_map_columns(spark):
    docs = spark.createDataFrame([(1, "a b c d e", {"k": 1}), (2, "a b c d e", {"k": 2}), (None, "x y z", None), (1, "a b c d e", {"k": 3})], "doc_id long, text string, extra map<string,int>")
    assert sorted((r.doc_id for r in S.one_of_each(docs).collect()), key=repr) == [1, None]


def test_components_of_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(200)]
    star = [(1000, 1000 + i) for i in range(1, 300)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame([*chain, *star, (5, 5), (7777, 7778)], "a long, b long")).collect()}
    assert set(got[i] for i in range(201)) == {0} and set(got[i] for i in range(1000, 1300)) == {1000} and got[7778] == 7777


def test_one_of_each_keeps_columns_and_whole_rows(spark):
    rng = np.random.default_rng(4)
    all_ = texts(rng, 20)
    rows = [(i, t, "f", i) for i, t in enumerate(all_)] + [(0, all_[0], "f", 0), (None, all_[0], "n", 1), (None, "alone and without a name", "n", 2)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = S.one_of_each(docs)
    assert got.columns == docs.columns
    want = set(brute_components(range(len(all_)), [brute_fingerprint(t) for t in all_], 4))
    ids = [r.doc_id for r in got.collect()]
    assert sorted(i for i in ids if i is not None) == sorted(want) and ids.count(None) == 1


def test_edited_fingerprints(spark):
    rows = [(5, "a b c d e f"), (2, None), (9, ""), (3, "x" * 50_000 + " y"), (3, "second of three"), (None, "no name"), (8, "ñandú é 𝄞 words")]
    got = fingerprint.with_next(spark.createDataFrame([(*r, "c", 1) for r in rows], SCHEMA)).collect()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    texts_ = [t or "" for _, t in order]
    want = []
    for (i, _), t, n in zip(order, texts_, texts_[1:] + texts_[:1]):
        e = fingerprint.edited(t, n)
        want.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), fingerprint.fingerprint(t), fingerprint.fingerprint(e), fingerprint.fingerprint(n)))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    one = fingerprint.with_next(spark.createDataFrame([(1, "alone", "c", 1)], SCHEMA)).first()
    assert one.next_fp == one.fp


def test_likeness_falls_with_edits():
    rng = np.random.default_rng(5)
    words = [f"term{i}" for i in range(3000)]
    a = list(rng.choice(words, 400))
    far = lambda x, y: bin((fingerprint.fingerprint(x) ^ fingerprint.fingerprint(y)) & (2**64 - 1)).count("1")
    steps = [far(" ".join(a), " ".join(list(rng.choice(words, k)) + a[k:])) for k in (0, 20, 200, 400)]
    assert steps[0] == 0 and steps[1] < steps[2] < steps[3] + 8 and steps[1] <= 14


@pytest.mark.parametrize("radius,keep", [(3, 2), (2, 1)])
def test_block_tables_find_all_within_the_radius(spark, radius, keep):
    rng = np.random.default_rng(6)
    codes = [int(c) for c in rng.integers(-(2**63), 2**63 - 1, 60)]
    near = []
    for c in codes:
        for d in range(1, 6):
            x = c & (2**64 - 1)
            for b in rng.choice(64, d, replace=False):
                x ^= 1 << int(b)
            near.append(x - 2**64 if x >> 63 else x)
    entries = spark.createDataFrame([(c,) for c in [*codes, *near, codes[0], None]], "fp long")
    queries = spark.createDataFrame([(c,) for c in codes[:30]], "fp long")
    got = {(r.query, r.fp, r.distance) for r in fingerprint.within(entries, queries, radius, keep).collect()}
    want = {(q, e, d) for q in codes[:30] for e in {*codes, *near} if (d := bin((q ^ e) & (2**64 - 1)).count("1")) <= radius}
    assert got == want


def brute_term_fingerprint(text):
    """Each term's hash votes bit by bit with weight 1 + ln(count)."""
    words = (text or "").lower().split()
    terms = [*words, *(f"{a} {b}" for a, b in zip(words, words[1:]))]
    counts = {t: terms.count(t) for t in terms}
    hashes = {t: xxhash.xxh3_64_intdigest(t.encode()) for t in counts}
    votes = [sum((1 + np.log(n)) * (1 if hashes[t] >> b & 1 else -1) for t, n in counts.items()) for b in range(64)]
    return sum(1 << b for b in range(64) if votes[b] > 0)


def test_query_equals_brute_force(spark):
    got = {r.doc_id: r for r in fingerprint.op8_fingerprint(spark, "/root/testdata/sf0.001").collect()}
    docs = sorted((r.doc_id, r.text or "") for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect())
    short = [(i, t) for i, t in docs if len(t) < 4000]
    marks = {i: fingerprint.fingerprint(t) & (2**64 - 1) for i, t in docs}
    assert len(short) > 100 and all(marks[i] == brute_term_fingerprint(t) for i, t in short[:60])
    far = lambda x, y: bin(x ^ y).count("1")
    for (i, t), (j, n) in zip(docs, docs[1:] + docs[:1]):
        half = len(t) // 2
        e = t[: len(t) - half] + n[:half]
        mark = fingerprint.fingerprint(e) & (2**64 - 1)
        want = (i, len(t), hashlib.sha256(e.encode()).hexdigest(), f"{marks[i]:016x}", f"{mark:016x}", 1 - far(marks[i], mark) / 64, 1 - far(marks[i], marks[j]) / 64)
        near = len({m for m in marks.values() if 0 < far(m, marks[i]) <= 3}) if i % 50 == 0 else None
        assert tuple(got[i]) == (*want, near)
    assert len(got) == len(docs) == 200
