"""Operator 12 against a plain construction of the trees, and its SQL."""

import hashlib
import zlib
from collections import defaultdict

from phasegrid.llm import merkle

SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def _h(x):
    return hashlib.sha256(x.encode()).hexdigest()


def _leaf(row, text):
    cells = (row[0], row[3], row[2], row[4], text)
    return _h("".join("-" if c is None else f"{len(str(c).encode())}:{c}" for c in cells))


def _tree(nodes):
    """Per leaf its sides on each level, and the root."""
    sides, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, i in enumerate(at):
            run = nodes[i - i % 8 : i - i % 8 + 8]
            sides[k].append(("".join(run[: i % 8]), "".join(run[i % 8 + 1 :])))
            at[k] = i // 8
        nodes = [_h("".join(nodes[i : i + 8])) for i in range(0, len(nodes), 8)]
    return sides, nodes[0]


def _expected(rows):
    by = defaultdict(list)
    for r in rows:
        by[r[2]].append((r[0] is not None, r[0] or 0, _leaf(r, r[1]), r))
    names = sorted(by, key=lambda n: (n is not None, (n or "").encode()))
    trees = [_tree([x[2] for x in sorted(by[n], key=lambda x: x[:3])]) for n in names]
    up, root = _tree([t[1] for t in trees])
    out = []
    for name, (sides, sub), above in zip(names, trees, up):
        for (_, _, leaf, r), path in zip(sorted(by[name], key=lambda x: x[:3]), sides):
            path, now = path + above, leaf
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0:
                low = None if r[1] is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in r[1])
                now = _leaf(r, low)
            for a, b in path:
                now = _h(a + now + b)
            out.append((r[0], leaf, sub, root, _h("".join(a + b for a, b in path)), now, now == root))
    return sorted(out, key=repr)


def _got(spark, tmp_path, rows):
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame(rows, SCHEMA).write.parquet(path)
    return sorted(map(tuple, merkle.op12_merkle(spark, str(tmp_path)).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=repr)


def test_trees_of_several_blocks(spark, tmp_path):
    rows = [(i, f"Text {i} ÄÖ" if i % 7 else None, ("en", "de", None, "fr")[min(3, i % 40)] if i % 40 < 3 else "en", f"s{i % 3}" if i % 5 else None, i if i % 11 else None) for i in range(1400)]
    assert _got(spark, tmp_path, rows) == _expected(rows)


def test_more_groups_than_a_block_holds(spark, tmp_path):
    rows = [(i, f"T{i}", f"l{i // 2}é" if i % 9 else "", "s", 2) for i in range(1300)]
    assert _got(spark, tmp_path, rows) == _expected(rows)


def test_ties_repeats_nulls_and_long_texts(spark, tmp_path):
    rows = [(1, "A", "en", "s", 1), (1, "B", "en", "s", 1), (1, "A", "en", "s", 1), (None, "x", "en", None, None), (None, None, None, None, None), (5, "", "", "", 0), (6, "Z" * 300_000, "en", "s", None), (3, "é\n\x0bQ", "zz", "s", -4)]
    assert _got(spark, tmp_path, rows) == _expected(rows)


def test_one_leaf_and_none(spark, tmp_path):
    assert _got(spark, tmp_path / "a", [(3, "Abc", None, "s", 1)]) == _expected([(3, "Abc", None, "s", 1)])
    assert _got(spark, tmp_path / "b", []) == []


def test_other_columns_with_clashing_names(spark):
    rows = [(i, f"T{i}", "en", "s", 2, "a", "b", i, "c", {"k": "v"}) for i in range(20)]
    docs = spark.createDataFrame(rows, SCHEMA + ", leaf string, grp string, place long, kept string, key map<string,string>")
    found = merkle.manifest(docs)
    assert found.count() == 20 and found.where("verified").count() == 20


def test_query_gives_the_rows_of_its_sql(spark, duck, same_rows):
    same_rows(merkle.op12_merkle(spark, SMALL), duck.sql(merkle.OP12_SQL))
