"""Operator 13 against a plain construction of the trie, and its SQL."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from phasegrid.llm import trie

SMALL = "/root/testdata/sf0.001"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def _nodes(convs):
    """The nodes of {conv_id: [(turn, chars), ...]}, each turn told apart by its first part."""
    members = defaultdict(list)
    for c in sorted(convs):
        for d in range(len(convs[c]) + 1):
            members[tuple(t for t, _ in convs[c][:d])].append(c)
    chars = {tuple(t for t, _ in x[:d]): x[d - 1][1] for x in convs.values() for d in range(1, len(x) + 1)}
    children = defaultdict(list)
    for k in members:
        if k:
            children[k[:-1]].append(k)
    leaves, saved = {}, {}
    for k in sorted(members, key=len, reverse=True):
        leaves[k] = sum(leaves[x] for x in children[k]) or 1
        saved[k] = sum(saved[x] for x in children[k]) + (len(members[k]) - 1) * chars.get(k, 0)
    ends = lambda k: ",".join(str(c) for c in members[k] if len(convs[c]) == len(k))
    return sorted((members[k][0], len(k), members[k[:-1]][0] if k else -1, len(members[k]), len(children[k]), leaves[k], saved[k], hashlib.sha256(ends(k).encode()).hexdigest()) for k in members)


def _rows(df):
    return sorted((*r[:2], -1 if r[2] is None else r[2], *r[3:]) for r in (tuple(r) for r in df.select(*COLUMNS).collect()))


def _tables(spark, convs):
    digest = lambda t: hashlib.sha256(str(t).encode()).hexdigest()[:32]
    turns = [(c, d + 1, digest(t), n) for c, x in convs.items() for d, (t, n) in enumerate(x)]
    return spark.createDataFrame(turns, "conv_id long, depth long, digest string, chars long"), spark.createDataFrame([(c, len(x)) for c, x in convs.items()], "conv_id long, size long")


@pytest.mark.parametrize("seed, block, piece, long", [(1, 1 << 16, 4096, 1024), (2, 4, 2, 3)])
def test_random_conversations_in_blocks_of_any_size(spark, seed, block, piece, long):
    rng = random.Random(seed)
    pool = [(t, 3 * t + 1) for t in range(3)]
    convs = {c: [rng.choice(pool) for _ in range(rng.choice([0, 1, 2, 3, 5, 8]))] for c in rng.sample(range(-50, 5000), 150)}
    hot = [rng.choice(pool) for _ in range(6)]
    convs |= {c: list(hot) for c in rng.sample(range(6000, 9000), 60)}
    assert _rows(trie.trie(*_tables(spark, convs), block, piece, long)) == _nodes(convs)


def test_one_conversation_with_a_third_of_all_turns_and_its_copy(spark):
    long = [(t, 2) for t in range(3000)]
    convs = {7: long, 9: [*long, (1, 5)], 11: long[:2000] + [(-1, 4)] * 500} | {c: [(0, 2), (c, 1)] for c in range(20, 400)}
    assert _rows(trie.trie(*_tables(spark, convs))) == _nodes(convs)


def _rebuilt(rows):
    own = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        role, text = role or "", text or ""
        key = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
        if c is not None:
            own[c].append((turn is not None, turn or 0, key[:32], (role, text), len(text)))
    own = {c: [x[3:] for x in sorted(v)] for c, v in own.items()}
    h = lambda c: zlib.crc32(str(c).encode()) % 6
    return {c: own.get(c - c % 100, [])[: h(c)] + v[h(c) :] for c, v in own.items()}


def _query(spark, tmp_path, rows, schema="conv_id long, turn long, role string, text string"):
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "conversations.parquet"))
    return _rows(trie.op13_trie(spark, str(tmp_path)))


def test_odd_rows(spark, tmp_path):
    rows = [(c, t, ("user", "assistant")[t % 2], f"é{t % 3}" * (c % 4 + 1)) for c in range(0, 640, 3) for t in range(c % 9)]
    rows += [(100, None, None, None), (100, None, None, None), (101, 1, "", ""), (101, 1, "user", None), (None, 0, "user", "x"), (305, 2, "user", "y" * 200_000), (305, 2, "user", "y" * 200_000), (900, 5, "system", "\n"), (901, 1, "x", "only"), (1234, 0, "u", "a"), (1234, 0, "u", "a")]
    assert _query(spark, tmp_path, rows) == _nodes(_rebuilt(rows))


def test_other_columns_with_clashing_names_and_no_rows(spark, tmp_path):
    rows = [(c, 0, "user", "hi", 1, "k", 2) for c in range(30)]
    schema = "conv_id long, turn long, role string, text string, depth long, digest string, place long"
    assert _query(spark, tmp_path / "a", rows, schema) == _nodes(_rebuilt(rows))
    assert _query(spark, tmp_path / "b", []) == []


def test_query_gives_the_rows_of_its_sql(spark, duck):
    want = duck.execute(trie.OP13_SQL).fetchall()
    assert _rows(trie.op13_trie(spark, SMALL)) == sorted((*r[:2], -1 if r[2] is None else r[2], *r[3:]) for r in want)
