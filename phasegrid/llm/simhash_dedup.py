"""Operator 1: near-duplicates by SimHash, found with Gray-order hierarchical indexes.

A document's fingerprint has 64 majority bits over its word shingles. The distinct fingerprints are put
into radius + 1 indexes, one for each rotation that brings another block of bits to the front. In each,
entries lie in Gray order; the upmost nodes fix the leading block, and lower nodes hold what further bits
their entries share, as (mask, pattern). A search adds up differences from the top and drops a node with
all it holds once they exceed the radius. If two fingerprints differ in at most `radius` bits, some block
is equal in both, so they meet below one upmost node of some index: the result is exact. Upmost nodes are
what Spark shuffles by. A crowded one is parted: of radius + k blocks of its entries' other bits, two that lie within
the radius agree in k, so the entries go below a node for each choice of k blocks, with k growing for as long as nodes are crowded.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import first_by_id, fresh, partitions, rows, stored, table, with_mark
from .components import components

FANOUT = 8


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """XXH64 (seed 42) of each shingle: words are split at ASCII white space, A-Z lower-cased, joined by spaces."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends[:-1]]
    digest = xxhash.xxh64_intdigest
    hashes = [digest(joined[a : b - 1], 42) for a, b in zip(starts, ends[width - 1 :])] or [digest(joined, 42)]
    return np.array(hashes, np.uint64)


def majority(hashes: np.ndarray) -> int:
    """The signed 64-bit number whose bits are those set in over half the hashes."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1).sum(0, dtype=np.int64)
    bits = np.packbits(2 * counts > len(hashes))
    return int(bits.view(">i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4) -> DataFrame:
    """(doc_id, fp): a fingerprint for every row; null and wordless texts get 0."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in rows(batches):
            found = [majority(shingle_hashes(t, width)) for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(found, pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(make, "doc_id long, fp long")


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """The place of each code in the Gray sequence."""
    out = codes.copy()
    for s in (1, 2, 4, 8, 16, 32):
        out ^= out >> np.uint64(s)
    return out


class GrayIndex:
    """Entries in Gray order below nodes that hold the bits all their entries share; one root for each group."""

    def __init__(self, codes: np.ndarray, groups: np.ndarray):
        """codes: in Gray order within each group; groups: of each entry, ascending."""
        self.codes = codes
        self.levels = []  # from the leaves up: mask, pattern, first and last child
        mask, pattern = np.full(len(codes), ~np.uint64(0)), codes
        first = np.arange(len(codes))
        self.levels.append((mask, pattern, first, first + 1, first + 1))
        both, any_, of, end = codes, codes, groups, first + 1
        while True:
            heads = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
            within = np.arange(len(of)) - np.repeat(heads, np.diff(np.r_[heads, len(of)]))
            starts = np.flatnonzero(within % FANOUT == 0)
            both, any_ = np.bitwise_and.reduceat(both, starts), np.bitwise_or.reduceat(any_, starts)
            stops = np.r_[starts[1:], len(of)]
            of, end = of[starts], end[stops - 1]
            mask = ~(both ^ any_)
            self.levels.append((mask, both & mask, starts, stops, end))
            if len(starts) == len(heads):
                break
        self.root = {int(g): i for i, g in enumerate(of)}

    def search(self, queries: np.ndarray, roots: np.ndarray, after: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """(query number, entry number) within the radius, entries after after[query] only."""
        mask, pattern, first, last, end = self.levels[-1]
        who, node = np.arange(len(queries)), roots
        far = np.bitwise_count((queries ^ pattern[node]) & mask[node])
        for level in range(len(self.levels) - 1, 0, -1):
            keep = (far <= radius) & (end[node] > after[who] + 1)
            who, node, far = who[keep], node[keep], far[keep]
            n = last[node] - first[node]
            child = np.repeat(first[node] - np.r_[0, np.cumsum(n)[:-1]] if len(n) else n, n) + np.arange(n.sum())
            who, far, above = np.repeat(who, n), np.repeat(far, n), np.repeat(mask[node], n)
            mask, pattern, first, last, end = self.levels[level - 1]
            node = child
            far = far + np.bitwise_count((queries[who] ^ pattern[node]) & mask[node] & ~above)
        keep = (far <= radius) & (node > after[who])
        return who[keep], node[keep]


def _roots(parent: np.ndarray) -> np.ndarray:
    while True:
        up = parent[parent]
        if np.array_equal(up, parent):
            return parent
        parent = up


def _union(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    while True:
        parent = _roots(parent)
        x, y = parent[a], parent[b]
        if not (apart := x != y).any():
            return parent
        np.minimum.at(parent, np.maximum(x, y)[apart], np.minimum(x, y)[apart])


def _search(radius: int, most_pairs: int):
    """Links inside each (index, block) of a partition, as edges to the least member of each linked set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        code, turn, bucket = (np.concatenate([b.column(n).to_numpy(zero_copy_only=False) for b in got]) for n in ("fp", "turn", "bucket"))
        code, turn = code.view(np.uint64), turn.astype(np.uint64)
        turned = (code << turn) | (code >> ((np.uint64(64) - turn) % np.uint64(64)))
        order = np.lexsort((gray_rank(turned), bucket))
        code, turned, bucket = code[order], turned[order], bucket[order]
        group = np.cumsum(np.r_[True, bucket[1:] != bucket[:-1]]) - 1
        index = GrayIndex(turned, group)
        sizes = np.bincount(group)
        parent = np.arange(len(code))
        ask = np.flatnonzero(sizes[group] > 1)
        for part in np.split(ask, np.flatnonzero(np.diff(np.cumsum(sizes[group[ask]]) // most_pairs)) + 1):
            if len(part):
                who, entry = index.search(turned[part], group[part], part, radius)
                parent = _union(parent, part[who], entry)
        parent = _roots(parent)
        moved = np.flatnonzero(parent != np.arange(len(code)))
        yield pa.RecordBatch.from_arrays([pa.array(code[moved].view(np.int64)), pa.array(code[parent[moved]].view(np.int64))], ["a", "b"])

    return run


def _parted(entries: DataFrame, cuts: list[int], k: int, radius: int) -> DataFrame:
    """entries(fp, turn, bucket), each in a bucket of its bucket for each choice of k of radius + k blocks of the bits behind the leading block."""
    lead, blocks = max(y - x for x, y in zip(cuts, cuts[1:])), radius + k
    ends = [lead + round(i * (64 - lead) / blocks) for i in range(blocks + 1)]
    masks = [sum(((1 << (ends[b + 1] - ends[b])) - 1) << (64 - ends[b + 1]) for b in chosen) for chosen in combinations(range(blocks), k)]
    turned = F.coalesce(*[F.when(F.col("turn") == t, F.shiftleft("fp", t).bitwiseOR(F.shiftrightunsigned("fp", 64 - t)) if t else F.col("fp")) for t in cuts[:-1]])
    keys = F.array(*[F.xxhash64("bucket", F.lit(i), turned.bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m))) for i, m in enumerate(masks)])
    return entries.select("fp", "turn", F.explode(keys).alias("bucket"))


def links(distinct: DataFrame, radius: int = 4, crowd: int = 50_000, deepest: int = 3, most_pairs: int = 4_000_000) -> DataFrame:
    """Edges (a, b) that connect the fingerprints of distinct(fp) differing in at most radius bits.

    Not all such pairs, but enough to have the same connected components: what is linked below an upmost
    node becomes edges to its least member, so no group's pairs are written out. Nodes of over crowd entries are parted
    up to deepest times; fingerprints that then still share a node share over half their bits.
    """
    n, cuts = radius + 1, [round(i * 64 / (radius + 1)) for i in range(radius + 2)]
    blocks = F.array(*[F.struct(F.lit(cuts[i]).alias("turn"), (F.lit(i).cast("long") * F.lit(1 << 32) + F.shiftrightunsigned(F.shiftleft("fp", cuts[i]), 64 - (cuts[i + 1] - cuts[i]))).alias("bucket")) for i in range(n)])
    entries, ready = distinct.select("fp", F.explode(blocks).alias("x")).select("fp", "x.*"), []
    for k in range(deepest):
        sizes = stored(entries.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"), "sizes")
        ready.append(entries.join(sizes.where(F.col("n") <= crowd), "bucket", "left_semi"))
        over = sizes.where(F.col("n") > crowd)
        if over.isEmpty():
            break
        entries = _parted(stored(entries.join(over, "bucket", "left_semi"), "crowded"), cuts, k + 1, radius)
    else:
        ready.append(entries)
    spread = reduce(DataFrame.unionByName, ready).repartition(partitions(distinct.sparkSession), "bucket")
    return spread.select("fp", "turn", "bucket").mapInArrow(_search(radius, most_pairs), "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, radius: int = 4) -> DataFrame:
    """(doc_id, fingerprint, component_id, fp) for every row of docs.

    component_id is the least doc_id reachable over links of at most radius differing bits. Null or
    wordless texts have fingerprint zero and link like others. Rows with a null doc_id keep their
    fingerprint and get the component's least doc_id, null if no member has one. Repeated rows return as
    often as they came. An empty table gives no rows; other columns of docs are not read.
    """
    marks = stored(fingerprints(docs, id_col, text_col, width), "fingerprints")
    members = stored(marks.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "members")
    found = components(links(members.select("fp"), radius))
    named = members.join(found, members["fp"] == found["node"], "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = named.join(least, "root").select("fp", "component_id")
    return marks.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "fp")


def one_of_each(docs: DataFrame, width: int = 4, radius: int = 4) -> DataFrame:
    """docs without near copies: of each component the document with the least doc_id stays.

    Rows that share a doc_id count as one document; one of them stays. Rows with a null doc_id stay if their component has no
    document with an id, all of them.
    """
    found = near_duplicates(docs, width=width, radius=radius)
    kept = found.where("doc_id = component_id").select(F.col("doc_id").alias("of")).distinct()
    named = first_by_id(docs.join(kept, docs["doc_id"] == kept["of"], "left_semi"))
    nameless = docs.where("doc_id IS NULL")
    alone = found.where("doc_id IS NULL AND component_id IS NULL").select("fp").distinct()
    return named if nameless.isEmpty() else named.unionByName(_nameless(nameless, alone, width, fresh("fp", docs.columns)))


def _nameless(docs: DataFrame, alone: DataFrame, width: int, name: str) -> DataFrame:
    """The rows of docs whose fingerprint is among alone(fp)."""
    alone = alone.select(F.col("fp").alias("of"))
    marked = with_mark(docs, name, lambda t: majority(shingle_hashes(t, width)))
    return marked.join(alone, marked[name] == alone["of"], "left_semi").drop(name)


def op1_simhash_dedup(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents")).drop("fp")
