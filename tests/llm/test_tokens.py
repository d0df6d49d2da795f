import random
import struct
import zlib

import numpy as np
import pytest

from phasegrid.llm import packing as P
from phasegrid.llm import sstable as S
from phasegrid.llm import tokens
from phasegrid.llm.common import stored
from phasegrid.llm.tokens import Encoder, default_path

SCHEMA = "doc_id long, text string, start long, ids string"


@pytest.fixture(scope="module")
def encode():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(default_path())
    return lambda text: np.array(t.encode(text or "", add_special_tokens=False).ids, "<u4").tobytes()


def rows():
    rng = random.Random(1)
    words = ["alpha", "bêta", "γ", "don't", "x\ty", "12", "!!", "\n\nnext", "  two"]
    some = [(i * 7 - 20, " ".join(rng.choice(words) for _ in range(rng.randint(0, 60))), 1, "c") for i in range(60)]
    return [*some, (None, "no id", None, None), (1, None, 0, "x"), (2, "", 0, "x"), (3, "long text " * 30_000, 0, "x"), (4, "line\n" * 3000 + "<|endoftext|>" + "z" * 20_000, 0, "x"), (8, some[4][1], 0, "x"), (8, some[4][1], 0, "x"), (-(2**63), "least", 0, "x"), (2**63 - 1, "most <|endoftext|>", 0, "x")]


def test_cached_encoding_is_that_of_the_whole_text(encode):
    fast, rng = Encoder(), random.Random(2)
    alphabet = " \n\t\r  ab'sdé1.,! 　 \u0085\x1c|<>"
    for _ in range(4000):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 16)))
        assert fast(text) == encode(text), repr(text)


def test_long_pieces_and_special_tokens(encode):
    fast, rng = Encoder(), random.Random(4)
    lines = [f"w{rng.randint(0, 3000)}" for _ in range(100_000)]
    for text in ("\n".join(lines), "\n\nab" * 5000, "中文字" * 30_000, "".join(rng.choice("abcdef") for _ in range(5_000_000)), "." * 9000, "a <|endoftext|> b", "<|endoftext|>" * 3):
        assert fast(text) == encode(text)
    assert encode("a <|endoftext|> b") == np.array([64, 220, 50256, 275], "<u4").tobytes()
    plain = np.frombuffer(Encoder(plain=True)("a <|endoftext|> b"), "<u4")
    assert 50256 not in plain and fast.tokenizer.decode(plain.tolist()) == "a <|endoftext|> b"


def test_cache_is_bounded_in_bytes(monkeypatch, encode):
    monkeypatch.setattr(tokens, "ROOM", 20_000)
    fast, rng = Encoder(), random.Random(5)
    for _ in range(40):
        text = " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 200))) for _ in range(50))
        assert fast(text) == encode(text)
    for cache in (fast.pieces, fast.pieces.old, fast.first, fast.first.old):
        assert all(len(k) <= tokens.LONGEST for k in cache) and sum(len(k) + len(v) + tokens.ENTRY for k, v in cache.items()) <= 20_000 + 1000


def test_shards_end_at_their_size(spark, encode):
    docs = spark.createDataFrame([(i, f"text {i} " * 400) for i in range(300)], "doc_id long, text string")
    manifest = S.write_shards(docs, shard_bytes=1)
    assert manifest.count() > 4 and [r.doc_id for r in S.read_shards(manifest).orderBy("start").collect()] == list(range(300))
    found = S.lookup(manifest, [0, 7, 150, 299, 300])
    assert [len(found[k]) for k in (0, 7, 150, 299, 300)] == [1, 1, 1, 1, 0] and found[150][0] == encode("text 150 " * 400) + struct.pack("<I", 2)


def test_shards_hold_all_ids_in_order(spark, encode):
    docs = spark.createDataFrame(rows(), SCHEMA)
    manifest = S.write_shards(docs)
    got = sorted(map(tuple, S.read_shards(manifest, with_ids=True).collect()), key=lambda r: r[1])
    order = sorted(rows(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    at, want = 0, []
    for doc_id, text, *_ in order:
        ids = encode(text) + struct.pack("<I", 2)
        want.append((doc_id, at, len(ids) // 4, zlib.crc32(ids), ids))
        at += len(ids) // 4
    assert [(*r[:4], bytes(r[4])) for r in got] == want
    found = S.lookup(manifest, [None, 8, 3, 2**63 - 1, -(2**63), 123])
    assert [len(found[k]) for k in (None, 8, 3, 2**63 - 1, -(2**63), 123)] == [1, 3, 1, 1, 1, 0]
    assert found[3][0] == next(w[4] for w in want if w[0] == 3)


def test_no_shards_of_an_empty_table(spark):
    manifest = S.write_shards(spark.createDataFrame([], SCHEMA))
    assert manifest.count() == 0 and S.read_shards(manifest).count() == 0 and S.lookup(manifest, [1]) == {1: []}


def test_shard_file_lookup(tmp_path):
    from pyarrow import fs

    ids = sorted({random.Random(3).randrange(-(2**40), 2**40) for _ in range(1)} | {7 * i for i in range(5000)})
    path = f"{tmp_path}/a.sst"
    with fs.LocalFileSystem().open_output_stream(path) as out:
        w = S.Writer(out)
        for i in ids:
            w.add(S.key_of(i), S.pack_ids(np.arange(i % 50, dtype="<u4").tobytes()), i % 50)
        with pytest.raises(ValueError):
            w.add(S.key_of(ids[0] - 1), b"\x02", 0)
        w.close()
    shard = S.open_shard(f"file://{path}")
    assert shard.n_docs == len(ids) and len(shard.places) > 3
    assert [S.id_of(k) for k, _ in shard] == ids
    for i in ids[:: 97]:
        assert S.unpack_ids(shard.get(S.key_of(i))[0]) == np.arange(i % 50, dtype="<u4").tobytes()
    absent = [i for i in range(1, 30_000) if i % 7]
    assert all(not shard.get(S.key_of(i)) for i in absent[:500])
    assert np.mean([shard.may_have(S.key_of(i)) for i in absent[:3000]]) < 0.03


def test_wide_ids_keep_four_bytes():
    wide = np.array([1, 70_000, 2**32 - 1], "<u4").tobytes()
    assert S.unpack_ids(S.pack_ids(wide)) == wide and S.pack_ids(wide)[0] == 4 and S.pack_ids(b"")[0] == 2


def check_packed(got, want, length=1024):
    """Every id in exactly one piece, sequences gapless and not too long."""
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= length
    pieces = sorted((r.doc_id is not None, r.doc_id or 0, r.doc_tokens, r.start, r.length, r.ids_crc32) for r in got)
    cut = []
    for doc_id, ids in want:
        for s in range(0, len(ids) // 4, length):
            p = ids[4 * s : 4 * (s + length)]
            cut.append((doc_id is not None, doc_id or 0, len(ids) // 4, s, len(p) // 4, zlib.crc32(p)))
    assert pieces == sorted(cut)
    return len(by), sum(r.length for r in got)


def test_packing_is_exact_and_tight(spark, encode):
    docs = spark.createDataFrame(rows(), SCHEMA)
    got = P.pack_documents(docs).collect()
    n, total = check_packed(got, [(i, encode(t) + struct.pack("<I", 0)) for i, t, *_ in rows()])
    assert n <= -(-total // 1024) + 1
    again = P.pack_documents(docs).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, again), key=repr)
    assert P.pack_documents(spark.createDataFrame([], SCHEMA)).count() == 0


def test_sequences_carry_the_ids(spark, encode):
    docs = spark.createDataFrame(rows(), SCHEMA)
    packed = P.pack(stored(P.pieces(docs, with_ids=True), "with_ids"))
    got = P.sequences(packed).collect()
    assert all(len(r.input_ids) == 1024 for r in got)
    total = sum(len(encode(t)) // 4 + 1 for _, t, *_ in rows())
    assert sum(r.n_tokens for r in got) == total


@pytest.mark.parametrize("seed", range(6))
def test_cutting_stock_holds_all_pieces_near_the_bound(seed):
    rng = np.random.default_rng(seed)
    widths = rng.integers(1, 129, rng.integers(1, 60))
    demand = {int(w): int(rng.integers(1, 500 if seed % 2 else 5)) for w in widths}
    made = P.cutting_stock(demand, 128)
    given = dict.fromkeys(demand, 0)
    for pattern, times in made:
        assert sum(w * n for w, n in pattern.items()) <= 128 and times > 0
        for w, n in pattern.items():
            given[w] += n * times
    assert given == demand
    # The bound: material, and pieces over half a sequence never share one.
    bound = max(-(-sum(w * n for w, n in demand.items()) // 128), sum(n for w, n in demand.items() if w > 64))
    bins = sum(t for _, t in made)
    assert bins <= 1.12 * bound + 3


def test_cutting_stock_of_a_solved_case():
    # Five pieces of 64 and of 32 and 32: pairs and fours fit without waste.
    assert sum(t for _, t in P.cutting_stock({64: 100, 32: 200}, 128)) == 100
    assert P.cutting_stock({}, 128) == []
