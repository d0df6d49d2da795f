import numpy as np

from phasegrid.llm import substring_dedup as G
from phasegrid.llm.common import stored

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, spans string"


def words(rng, n):
    return [f"w{x}" for x in rng.integers(0, 5000, n)]


def test_compact_windows_are_the_wide_nodes_of_the_cartesian_tree():
    rng = np.random.default_rng(1)
    for _ in range(40):
        v = rng.integers(1, 60, rng.integers(1, 150)).astype(np.uint64)
        v[rng.integers(0, len(v), 2)] = 0
        width = int(rng.integers(1, 14))
        want = set()
        for c in np.flatnonzero(v):
            left = right = c
            while left > 0 and v[left - 1] > v[c]:
                left -= 1
            while right + 1 < len(v) and v[right + 1] >= v[c]:
                right += 1
            if right - left + 1 >= width:
                want.add((left, c, right))
        assert set(zip(*(x.tolist() for x in G.compact_windows(v, width)))) == want


def corpus():
    rng = np.random.default_rng(2)
    shared = [words(rng, 55) for _ in range(4)]
    rows, expect = [], {}
    for i in range(60):
        w = words(rng, 150)
        if i % 3 == 0:
            at = int(rng.integers(0, 150))
            w[at:at] = shared[i % 4]
            if i >= 12:
                expect[i] = (at, at + 55)
        rows.append((i, " ".join(w), "en", "s", 1, "x"))
    near = rows[1][1].split()
    near[70] = "changed"
    rows.append((100, " ".join(near), "en", "s", 1, "x"))
    rows.append((101, rows[2][1], "en", "s", 1, "x"))
    rows += [(102, None, None, None, None, None), (103, "", "en", "s", 0, "x"), (104, "too short to count", "en", "s", 1, "x"), (None, rows[2][1], "en", "s", 1, "x"), (105, "again " * 60_000, "en", "s", 1, "x"), (5, rows[5][1], "en", "s", 1, "x")]
    return rows, expect


def test_planted_passages_are_found_and_clean_documents_left_alone(spark):
    rows, expect = corpus()
    got = G.near_passages(spark.createDataFrame(rows, SCHEMA)).collect()
    hit = {}
    for r in got:
        assert r.of_id < r.doc_id and r.similarity >= 0.8 and r.end - r.start >= 50
        hit.setdefault(r.doc_id, []).append((r.start, r.end))
    assert set(hit) == {*expect, 100, 101}
    for i, (a, b) in expect.items():
        assert any(s <= a + 1 and e >= b - 1 for s, e in hit[i])
    assert max(e - s for s, e in hit[100]) >= 150 and hit[101] == [(0, 150)]


def test_a_passage_of_a_third_of_the_documents_is_one_row_a_document(spark):
    rng = np.random.default_rng(3)
    common = words(rng, 80)
    rows = [(i, " ".join(words(rng, 60) + (common if i % 3 == 0 else []) + words(rng, 60)), "en", "s", 1, "x") for i in range(600)]
    got = G.near_passages(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()
    assert {r.doc_id for r in got} == set(range(3, 600, 3)) and len(got) <= 4 * 200


def test_removal(spark):
    text = "a b  c\nd e f g"
    assert G.without(text, [(1, 3)]) == "a d e f g"
    assert G.without(text, [(0, 2), (1, 4)]) == "e f g"
    assert G.without(text, [(0, 7)]) == ""
    assert G.without(text, [(5, 9)]) == "a b  c\nd e "
    rows, expect = corpus()
    docs = spark.createDataFrame(rows, SCHEMA)
    out = G.remove_passages(docs, G.near_passages(docs))
    assert out.columns == docs.columns
    by = {r.doc_id: r for r in out.collect()}
    assert 101 not in by and by[1].text == rows[1][1] and by[102].text is None
    for i in expect:
        assert 145 <= len(by[i].text.split()) <= 152 and by[i].n_chars == len(by[i].text)
    again = G.near_passages(stored(out, "again"))
    assert again.count() == 0
    empty = docs.limit(0)
    assert G.near_passages(empty).count() == 0 and G.remove_passages(empty, G.near_passages(empty)).count() == 0


def repeated(texts, n):
    """(document, place) of every word in a run of n words that also stands in a document with a lesser id."""
    seen, out = {}, set()
    for d in sorted(texts):
        grams = [tuple(texts[d][i : i + n]) for i in range(len(texts[d]) - n + 1)]
        out |= {(d, j) for i, g in enumerate(grams) if seen.get(g, d) < d for j in range(i, i + n)}
        for g in grams:
            seen.setdefault(g, d)
    return out


def shingle_likeness(a, b):
    x, y = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (a, b))
    return len(x & y) / len(x | y)


def test_recall_against_all_pairs(spark):
    rng = np.random.default_rng(6)
    texts, planted = {}, []
    for g in range(40):  # the least holder has only a part, of 27 to 49 words, of what two others share
        passage, part = words(rng, int(rng.integers(50, 61))), int(rng.integers(27, 50))
        at = int(rng.integers(0, len(passage) - part + 1))
        for k, body in enumerate((passage[at : at + part], passage, passage)):
            texts[1000 * k + g] = words(rng, int(rng.integers(0, 60))) + body + words(rng, int(rng.integers(0, 60)))
    long = words(rng, 2000)
    for k in range(3):
        texts[5000 + k] = words(rng, 300) + long + words(rng, 200 * k)
    for k in range(20):  # one edit in every 60 words
        passage = words(rng, 120)
        edited = [*passage]
        edited[30], edited[90] = "x", "y"
        texts[6000 + k], texts[7000 + k] = words(rng, 40) + passage + words(rng, 40), words(rng, 20) + edited + words(rng, 60)
        planted.append((7000 + k, 20, 140))
    docs = spark.createDataFrame([(i, " ".join(w), "en", "s", 1, "x") for i, w in texts.items()], SCHEMA).repartition(3)
    got = G.near_passages(docs).collect()
    covered = {}
    for r in got:
        assert r.of_id < r.doc_id and r.end - r.start >= 50 and r.of_end - r.of_start >= 50
        assert shingle_likeness(texts[r.doc_id][r.start : r.end], texts[r.of_id][r.of_start : r.of_end]) >= 0.78
        covered.setdefault(r.doc_id, set()).update(range(r.start, r.end))
    want = repeated(texts, 50)
    assert len(want) > 6000 and sum(i in covered.get(d, ()) for d, i in want) >= 0.97 * len(want)
    whole = {d for d, _ in want}
    assert sum(d in covered for d in whole) >= 0.95 * len(whole)
    assert all(len(covered[5000 + k] & set(range(300, 2300))) == 2000 for k in (1, 2))
    assert sum(len(covered.get(d, set()) & set(range(s, e))) >= 0.9 * (e - s) for d, s, e in planted) >= 19
    assert set(covered) <= whole | {d for d, _, _ in planted}


def test_alignment_bridges_small_edits():
    rng = np.random.default_rng(4)
    a = [w.encode() for w in words(rng, 200)]
    b = [*a[:80], b"new", b"words", *a[80:140], *a[143:]]
    found = G.align([b"q", *a], b, 50, 0.8)
    assert len(found) == 1 and found[0][:4] == (1, 201, 0, 199)
    assert G.align(a[:49], a[:49], 50, 0.8) == [] and G.align([], a, 50, 0.8) == []


def test_alignment_tries_each_occurrence_of_a_repeated_beginning():
    rng = np.random.default_rng(5)
    w = lambda n: [x.encode() for x in words(rng, n)]
    passage = w(60)
    x, y = w(30) + passage + w(30), w(30) + passage[:20] + w(40) + passage + w(30)
    assert G.align(x, y, 50, 0.8) == [(30, 90, 90, 150, 1.0)]
    edited = [*passage[:12], b"new", *passage[12:]]
    found = G.align(x, w(30) + passage[:20] + w(40) + edited + w(30), 50, 0.8)
    assert [f[:4] for f in found] == [(30, 90, 90, 151)]
    assert G.align([b"again"] * 500, [b"again"] * 400, 50, 0.8)[0][:2] == (0, 400)


def test_both_copies_inside_one_document_are_found_however_rows_are_dealt(spark):
    rng = np.random.default_rng(6)
    passage = words(rng, 60)
    twice = " ".join(words(rng, 40) + passage + words(rng, 400) + passage + words(rng, 40))
    rows = [(1, " ".join(words(rng, 40) + passage + words(rng, 40)), "en", "s", 1, "x"), (5, twice, "en", "s", 1, "x")]
    for n in (1, 2):
        docs = stored(spark.createDataFrame(rows, SCHEMA).repartitionByRange(n, "doc_id"), "dealt")
        assert docs.rdd.getNumPartitions() >= n
        got = sorted((r.start, r.end) for r in G.near_passages(docs).collect() if r.doc_id == 5)
        assert got == [(40, 100), (500, 560)]


def test_a_head_with_part_of_the_passage_hides_no_link_of_the_others(spark):
    rng = np.random.default_rng(7)
    rows = []
    for k in range(40):
        passage = words(rng, 51)
        for i, n in enumerate((49, 51, 51)):
            rows.append((10 * k + i, " ".join(words(rng, 60) + passage[:n] + words(rng, 60)), "en", "s", 1, "x"))
    got = {(r.doc_id, r.of_id) for r in G.near_passages(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()}
    assert len(got & {(10 * k + 2, 10 * k + 1) for k in range(40)}) >= 38


def test_pipeline_stages_equal_brute_force(spark):
    """Each stage over what the one before kept, against loops over its rows that share no code with it."""
    import zlib
    from collections import Counter

    import corpus_pipeline as C
    from test_models import brute_grams, brute_mixture
    from test_near_copies import brute
    from test_rules_mix_chat import WORD, brute_targets
    from tokenizers import Tokenizer

    from phasegrid.llm.tokens import default_path

    docs = stored(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("doc_id < 150").select("doc_id", "text", "lang", "source", "n_chars"), "docs")
    before, stages = {r.doc_id: r for r in docs.collect()}, dict(C.STAGES)
    read = lambda df: sorted(df.collect(), key=lambda r: (r.doc_id, r.text))

    out = stored(stages["language"](spark, docs, ""), "language")
    counts = {}
    for i, r in before.items():
        if r.text is not None and r.lang is not None and zlib.crc32(str(i).encode()) % 5:
            counts.setdefault(r.lang, Counter()).update(brute_grams(r.text))
    totals = {x: sum(c.values()) + 0.5 * 65536 for x, c in counts.items()}
    rows = {r.doc_id: r for r in read(out)}
    asked = [i for i, r in before.items() if len(r.text or "") < 1500][:50]
    for i in asked:
        text = before[i].text or ""
        assert (i in rows) == (any(c.isalpha() for c in text) and sum(brute_mixture(text, counts, totals).values()) >= 0.5)
    assert len(asked) > 25 and all(tuple(r) == tuple(before[i]) for i, r in rows.items())

    before, docs = rows, out
    out = stored(stages["near_copies"](spark, docs, ""), "near_copies")
    ids = sorted(before)
    rows = {r.doc_id: r for r in read(out)}
    assert sorted(rows) == sorted({ids[k] for k in brute([before[i].text for i in ids], 0.8)}) and all(tuple(r) == tuple(before[i]) for i, r in rows.items())

    before, docs = rows, out
    out = stored(stages["passages"](spark, docs, ""), "passages")
    words = {i: (r.text or "").lower().split() for i, r in before.items()}
    rows = {r.doc_id: r for r in read(out)}
    left = {i: (r.text or "").lower().split() for i, r in rows.items()}
    held = repeated(words, 50)
    assert held and len(repeated(left, 50)) <= 0.03 * len(held)
    shingles = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, w in words.items()}
    clean = [i for i in words if all(len(shingles[i] & shingles[j]) < 25 for j in words if j < i)]
    assert len(clean) > 20 and all(rows[i].text == before[i].text for i in clean)
    assert all(r.n_chars == len(r.text) for i, r in rows.items() if r.text != before[i].text)

    before, docs = rows, out
    out = stored(stages["mix"](spark, docs, ""), "mix")
    sizes, taken = Counter(), Counter()
    for r in before.values():
        sizes[r.source] += len(WORD.findall(r.text or ""))
    copies = Counter(r.doc_id for r in read(out))
    for i, n in copies.items():
        taken[before[i].source] += n * len(WORD.findall(before[i].text or ""))
    longest = {x: max(len(WORD.findall(r.text or "")) for r in before.values() if r.source == x) for x in sizes}
    for x, target in brute_targets(dict(sizes)).items():
        assert abs(taken[x] - target) <= longest[x] and all(int(target // sizes[x]) <= copies[i] <= int(target // sizes[x]) + 1 for i, r in before.items() if r.source == x)

    packed = stages["pack"](spark, out, "").collect()
    t = Tokenizer.from_file(default_path())
    place = {}
    for r in packed:
        place.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in place.values():
        spans.sort()
        assert all(a == sum(n for _, n in spans[:k]) for k, (a, _) in enumerate(spans)) and sum(n for _, n in spans) <= 1024
    pieces = Counter((r.doc_id, r.start, r.length, r.ids_crc32) for r in packed)
    want = Counter()
    for i, n in copies.items():
        ids = np.array([*t.encode(before[i].text, add_special_tokens=False).ids, 0], "<u4")
        for at in range(0, len(ids), 1024):
            want[i, at, len(ids[at : at + 1024]), zlib.crc32(ids[at : at + 1024].tobytes())] += n
    assert pieces == want


def test_pipeline_stages_take_odd_rows(spark):
    import corpus_pipeline as C

    schema = "doc_id long, text string, lang string, source string, n_chars long, spans int, node int, keys string, `of` int, n int, a int, extra map<string,int>"
    good = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("doc_id < 40").collect()
    tail = (1, 2, "k", 3, 4, 5, {"x": 1})
    rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars, *tail) for r in good]
    rows += [rows[3], rows[3], (None, rows[5][1], None, None, None, *[None] * 7), (500, None, None, None, None, *tail), (501, "", "en", "s", 0, *tail), (502, rows[7][1], "en", None, 5, *tail), (503, "\n".join([rows[9][1]] * 60), "en", "s", 9, *tail)]
    docs = spark.createDataFrame(rows, schema)
    before, n = docs, len(rows)
    for name, stage in C.STAGES:
        out = stored(stage(spark, before, ""), name)
        if name != "pack":
            assert out.schema == docs.schema and 0 < out.count() <= 3 * n
        assert stage(spark, docs.limit(0), "").count() == 0
        before, n = out, out.count()
