"""Operator 12: a Merkle manifest of a dataset, by blocks of ordered leaves that higher-order functions collapse.

A row's leaf is the digest of its columns. The leaves of a group, in order, form a tree of runs of FANOUT nodes; the groups'
subroots form one more. Spark numbers the leaves and gathers them in blocks of FANOUT ** LEVELS; `sequence`,
`transform`, `slice` and `aggregate` collapse a block's levels, and the block roots are the leaves of the next round. On the way
back each block hands its members what stands left and right of them on each level, up to the root, so a proof is
folded where its leaf is. Texts are read once; only digests are shuffled.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ranked, stored, table

FANOUT, LEVELS = 8, 3
BLOCK = FANOUT**LEVELS


def h(text: Column) -> Column:
    return F.sha2(text, 256)


def leaf(columns: list[Column]) -> Column:
    """The digest of columns as text, each with its length in bytes before it; a null is `-`, which no length begins with."""
    part = lambda c: F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-"))
    return h(F.concat(*[part(c) for c in columns]))


def lowered(text: Column) -> Column:
    """text with A-Z in lower case, and nothing else changed."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def _collapsed(nodes: Column) -> Column:
    """One level up: each run of FANOUT nodes, the last perhaps shorter, becomes its digest."""
    runs = F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / FANOUT).cast("int"))
    return F.transform(runs, lambda i: h(F.array_join(F.slice(nodes, i * FANOUT + 1, FANOUT), "")))


def _blocks(nodes: DataFrame, name: str) -> DataFrame:
    """(grp, block, total, members, levels) from (grp, place, total, node[, kept]): BLOCK neighbours in each row, with the levels above them.

    A group in one block is collapsed until one node is left; in any other group every block, full or not, is collapsed
    LEVELS times, since each of those levels has several nodes.
    """
    kept = ["kept"] if "kept" in nodes.columns else []
    each = F.struct("place", "node", *kept)
    made = nodes.groupBy("grp", F.expr(f"place div {BLOCK}").alias("block"), "total").agg(F.sort_array(F.collect_list(each)).alias("members"))
    some = F.slice(F.array(*[F.lit(i) for i in range(LEVELS)]), 1, LEVELS)
    steps = F.when(F.col("total") > BLOCK, some).otherwise(F.filter(some, lambda i: F.pow(F.lit(FANOUT), i) < F.col("total")))
    start = F.array(F.transform("members", lambda m: m["node"]))
    levels = F.aggregate(steps, start, lambda up, _: F.concat(up, F.array(_collapsed(F.element_at(up, -1)))))
    return stored(made.withColumn("levels", levels), name)


def _path(place: Column, levels: Column) -> Column:
    """What stands left and right of a block's member on each level below the block's root."""

    def beside(nodes: Column, level: Column) -> Column:
        at = F.floor(place / F.pow(F.lit(FANOUT), level)).cast("int")
        run = F.slice(nodes, (at - at % FANOUT) + 1, FANOUT)
        return F.struct(F.array_join(F.slice(run, 1, at % FANOUT), "").alias("before"), F.array_join(F.slice(run, at % FANOUT + 2, FANOUT), "").alias("after"))

    return F.transform(F.slice(levels, 1, F.size(levels) - 1), beside)


def _climb(nodes: DataFrame, name: str) -> tuple[list[DataFrame], DataFrame]:
    """The rounds of blocks over nodes(grp, place, total, node), and (grp, top): what each group comes to."""
    rounds = []
    while True:
        rounds.append(blocks := _blocks(nodes, name))
        root = F.element_at(F.element_at("levels", -1), 1)
        if (blocks.agg(F.max("total")).first()[0] or 0) <= BLOCK:
            return rounds, blocks.select("grp", root.alias("top"))
        nodes = blocks.select("grp", F.col("block").alias("place"), F.ceil(F.col("total") / BLOCK).alias("total"), root.alias("node"))


def _descend(rounds: list[DataFrame], tops: DataFrame) -> DataFrame:
    """(grp, place, node[, kept], path, and tops' other columns): each leaf's path, by the paths of the blocks above, from tops(grp, path, ...)."""
    above = tops.withColumn("place", F.lit(0).cast("long"))
    for blocks in reversed(rounds):
        up = above.select(*[F.col(c).alias(f"{c}_") if c in ("grp", "place", "path") else F.col(c) for c in above.columns])
        rest = [c for c in above.columns if c not in ("grp", "place", "path", "node", "kept")]
        met = blocks.join(up.drop("node"), F.col("grp").eqNullSafe(F.col("grp_")) & (F.col("block") == F.col("place_")))
        own = F.posexplode(F.transform("members", lambda m, i: F.struct(m.alias("m"), F.concat(_path(i, F.col("levels")), F.col("path_")).alias("path"))))
        met = met.select("grp", *rest, own.alias("i", "x"))
        above = met.select("grp", "x.m.*", "x.path", *rest)
    return above


def proofs(leaves: DataFrame) -> DataFrame:
    """Each of leaves(grp, order columns, node, kept) with subroot, root and path, an array of what stands before and after on each level.

    Leaves ascend in each group by `kept.key` (null first), then by node; groups ascend by UTF-8 bytes, null first. Equal rows are leaves of
    their own. No leaves, no rows. leaves is read twice, so it should be stored.
    """
    numbered = ranked(leaves.withColumn("key", F.col("kept.key")), ["grp"], ["key", "node"], "leaves").drop("key")
    rounds, subroots = _climb(numbered, "blocks")
    # The groups' own tree: one group of subroots in the order of their names.
    groups = ranked(stored(subroots.select(F.lit(0).alias("all"), F.col("grp").alias("kept"), F.col("top").alias("node")), "subroots"), ["all"], ["kept"], "groups")
    upper, root = _climb(groups.select(F.col("all").alias("grp"), "place", "total", "node", F.col("kept").alias("kept")), "upper")
    tops = root.select("grp", F.array().cast("array<struct<before:string,after:string>>").alias("path"), F.col("top").alias("root"))
    tops = _descend(upper, tops).select(F.col("kept").alias("grp"), "path", F.col("node").alias("subroot"), "root")
    return _descend(rounds, tops)


def folded(node: Column, path: Column) -> Column:
    """The root that a leaf and its path lead to."""
    return F.aggregate(path, node, lambda now, x: h(F.concat(x["before"], now, x["after"])))


def manifest(docs: DataFrame, columns: list[str] | None = None, changed: Column | None = None, changed_text: Column | None = None) -> DataFrame:
    """(doc_id, leaf, subroot, root, path, folded_root, verified) of docs(doc_id, lang, ...), a tree for each lang.

    columns: what a leaf covers, in order; others are not read. changed, changed_text: rows whose text was altered since, and to what; their
    folded_root starts at the altered row's leaf and verified says whether it is still the root. Null ids come first in their
    lang, equal ids go by leaf, and repeated rows return as often as they came. A null lang is a tree of its own. Empty and
    very long texts are like any other. An empty table gives no rows.
    """
    columns = columns or ["doc_id", "source", "lang", "n_chars", "text"]
    cells = {c: F.col(c) for c in columns}
    now = F.when(changed, leaf(list((cells | {"text": changed_text}).values()))) if changed is not None else F.lit(None).cast("string")
    made = docs.select(F.col("lang").alias("grp"), leaf(list(cells.values())).alias("node"), F.struct(F.col("doc_id").alias("key"), now.alias("now")).alias("kept"))
    found = proofs(stored(made, "leaf"))
    end = folded(F.coalesce("kept.now", "node"), F.col("path"))
    found = found.select(F.col("kept.key").alias("doc_id"), F.col("node").alias("leaf"), "subroot", "root", "path", end.alias("folded_root"))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_merkle(spark, sf_dir):
    changed = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 3 == 0
    found = manifest(table(spark, sf_dir, "documents"), changed=changed, changed_text=lowered(F.col("text")))
    proof = h(F.array_join(F.transform("path", lambda x: F.concat(x["before"], x["after"])), ""))
    return found.select("doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), "folded_root", "verified")


#: CRC-32 of a decimal number, bit by bit.
CRC32_SQL = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({0}::VARCHAR, ''), lambda ch: ascii(ch)::BIGINT)), lambda c, b: list_reduce(list_prepend(xor(c, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, k: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384::BIGINT) ELSE x // 2 END)), 4294967295::BIGINT)"


def _leaf_sql(text: str) -> str:
    part = lambda c: f"coalesce(octet_length(encode({c}::VARCHAR))::VARCHAR || ':' || {c}::VARCHAR, '-')"
    return f"sha256({' || '.join(map(part, ('doc_id', 'source', 'lang', 'n_chars', text)))})"


OP12_SQL = f"""
WITH RECURSIVE d AS MATERIALIZED (
  SELECT doc_id, lang, {_leaf_sql('text')} AS leaf,
    CASE WHEN {CRC32_SQL.format('doc_id')} % 3 = 0 THEN {_leaf_sql("translate(text, '" + string.ascii_uppercase + "', '" + string.ascii_lowercase + "')")} ELSE {_leaf_sql('text')} END AS now FROM documents),
a AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place FROM d),
up AS (
  SELECT lang, 0 AS level, place AS i, leaf AS node, count(*) OVER (PARTITION BY lang) AS n FROM a
  UNION ALL
  SELECT lang, level + 1, i // 8, sha256(string_agg(node, '' ORDER BY i)), count(*) OVER (PARTITION BY lang) FROM up WHERE n > 1 GROUP BY lang, level, i // 8),
up1 AS MATERIALIZED (SELECT * FROM up),
s AS MATERIALIZED (SELECT lang, node AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS place FROM up1 WHERE n = 1),
top AS (
  SELECT 0 AS level, place AS i, subroot AS node, count(*) OVER () AS n FROM s
  UNION ALL
  SELECT level + 1, i // 8, sha256(string_agg(node, '' ORDER BY i)), count(*) OVER () FROM top WHERE n > 1 GROUP BY level, i // 8),
top1 AS MATERIALIZED (SELECT * FROM top),
sides AS (
  SELECT a.lang, a.place, u.level, coalesce(string_agg(u.node, '' ORDER BY u.i) FILTER (u.i < a.place // (8 ** u.level)::BIGINT), '') AS before, coalesce(string_agg(u.node, '' ORDER BY u.i) FILTER (u.i > a.place // (8 ** u.level)::BIGINT), '') AS after
  FROM a JOIN up1 u ON u.lang IS NOT DISTINCT FROM a.lang AND u.n > 1 AND u.i // 8 = a.place // (8 ** (u.level + 1))::BIGINT GROUP BY 1, 2, 3
  UNION ALL
  SELECT a.lang, a.place, 1000 + t.level, coalesce(string_agg(t.node, '' ORDER BY t.i) FILTER (t.i < s.place // (8 ** t.level)::BIGINT), ''), coalesce(string_agg(t.node, '' ORDER BY t.i) FILTER (t.i > s.place // (8 ** t.level)::BIGINT), '')
  FROM a JOIN s ON s.lang IS NOT DISTINCT FROM a.lang JOIN top1 t ON t.n > 1 AND t.i // 8 = s.place // (8 ** (t.level + 1))::BIGINT GROUP BY 1, 2, 3),
paths AS (SELECT a.lang, a.place, list([before, after] ORDER BY level) FILTER (level IS NOT NULL) AS path FROM a LEFT JOIN sides p ON p.lang IS NOT DISTINCT FROM a.lang AND p.place = a.place GROUP BY 1, 2),
f AS (SELECT a.*, s.subroot, (SELECT node FROM top1 WHERE n = 1) AS root, coalesce(path, []) AS path FROM a JOIN s ON s.lang IS NOT DISTINCT FROM a.lang JOIN paths p ON p.lang IS NOT DISTINCT FROM a.lang AND p.place = a.place),
g AS (SELECT *, sha256(array_to_string(flatten(path), '')) AS proof_sha256, list_reduce(list_prepend([now, ''], path), lambda x, y: [sha256(y[1] || x[1] || y[2]), ''])[1] AS folded_root FROM f)
SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified FROM g
"""
