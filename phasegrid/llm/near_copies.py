"""The pipeline's near copies: documents whose sets of five-word shingles are alike by `similarity` or more.

Candidates come from operator 1 (SimHash fingerprints over the same shingles, linked by its Gray-order indexes) and, since its radius
reaches few pairs at a similarity of 0.8, from MinHash: sets that share a band of minima under several hash functions. A
signature of SIGNS minima decides on pairs that are clearly alike or clearly not; for those within SURE of the similarity the sets
themselves do. Both are made anew from the texts, once, for the sets that have a candidate. Equal sets are one node from the start.

In a band's group one head is compared with all others, then up to 64, then eight times as many that aren't connected to them; heads leave the group, until
it is one component or empty. So every pair is compared or connected in the first band that both share, and what is connected early costs no more pairs: a group of copies
takes a few times its size. In a large group each set is also told by what sets it apart from the root of the largest component that reaches into it, so
that the groups of several bands share theirs. Of that, what no other set has can't bring it nearer to any, which bounds the sets that may be alike to it: pairs beyond the bound aren't compared, and sets that nothing is left for leave the group.
So edited copies of one text stay cheap though they are too far from each other; only sets that share what sets them apart, and yet stay just below the similarity, take the
square of their number. A round's tables are small, and have tasks in proportion to their rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import simhash_dedup
from .common import cut, first_by_id, fresh, rows, stored, with_mark
from .components import components
from .simhash_dedup import majority, shingle_hashes

WIDTH, SIMILARITY = 5, 0.8
#: Minima in a signature, and how far from the similarity its estimate decides alone: 3.7 standard deviations at 0.8.
SIGNS, SURE = 128, 0.13
_ODD, _PLUS = np.random.default_rng(0).integers(0, 2**63, (2, SIGNS, 1), dtype=np.uint64)
_ODD = _ODD * np.uint64(2) + np.uint64(1)
#: The minima of each band, 16 of 5; at a similarity of 0.8, 0.2 % of the pairs share none.
BANDS = np.arange(80).reshape(16, 5)
#: Groups of more sets get bounds; smaller ones are compared as they are, at most so many pairs a set. As many heads of either kind come first.
BOUNDED = 32
#: Pairs, and other rows of a round, for each task.
PAIRS, ROWS = 1_000, 10_000


def shingle_set(text: str | None) -> np.ndarray:
    return np.unique(shingle_hashes(text, WIDTH))


def node(found: np.ndarray) -> int:
    """A name of the set: the same for equal sets."""
    return xxhash.xxh3_64_intdigest(found.tobytes()) - 2**63


def signature(found: np.ndarray, n: int = SIGNS) -> np.ndarray:
    """The least of n hash functions over the set, 32 bits of each; nothing for an empty set."""
    if not len(found):
        return np.empty(0, np.uint32)
    least, odd, plus = np.full(n, ~np.uint64(0)), _ODD[:n], _PLUS[:n]
    for at in range(0, len(found), 1024):
        x = (found[at : at + 1024] ^ plus) * odd
        least = np.minimum(least, ((x ^ (x >> np.uint64(32))) * odd).min(1))
    return (least >> np.uint64(32)).astype(np.uint32)


def keys(sign: np.ndarray) -> list[int]:
    """A key a band; none for an empty set."""
    if not len(sign):
        return []
    return [xxhash.xxh3_64_intdigest(b.tobytes(), i) - 2**63 for i, b in enumerate(sign[BANDS])]


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if both else float(len(a) == len(b) == 0)


def _marks(docs: DataFrame) -> DataFrame:
    """(doc_id, node, fp, keys) of every row."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in rows(batches, 128):
            hashes = [shingle_hashes(t, WIDTH) for t in texts]
            sets = [np.unique(h) for h in hashes]
            columns = (ids, [node(s) for s in sets], [majority(h) for h in hashes], [keys(signature(s, BANDS.size)) for s in sets])
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["doc_id", "node", "fp", "keys"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(make, "doc_id long, node long, fp long, keys array<long>")


def _tasks(n: int, each: int) -> int:
    """Tasks for n rows."""
    return n // each + 1


def _of_both(pairs: DataFrame, sets: DataFrame, column: str, tasks: int) -> DataFrame:
    """pairs(a, b) with x and y, the column of their sets."""
    mine = pairs.join(sets.select(F.col("node").alias("a"), F.col(column).alias("x")), "a").coalesce(tasks)
    return mine.join(sets.select(F.col("node").alias("b"), F.col(column).alias("y")), "b").coalesce(tasks).select("a", "b", "x", "y")


def _estimated(pairs: DataFrame, sets: DataFrame, tasks: int) -> DataFrame:
    """pairs(a, b) with the share of equal minima in their signatures."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(n).to_pylist()), np.uint32).reshape(-1, SIGNS) for n in ("x", "y"))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array((x == y).mean(1))], ["a", "b", "alike"])

    both = _of_both(pairs, sets, "sign", tasks).where("length(x) > 0 AND length(y) > 0")
    return both.mapInArrow(compare, "a long, b long, alike double")


def _sets(docs: DataFrame, marks: DataFrame, asked: DataFrame) -> DataFrame:
    """(node, found, sign): the sets of the nodes asked(of) for and their signatures, from one text of each."""
    asked = stored(asked, "asked")
    wanted = marks.join(asked, marks["node"] == asked["of"], "left_semi")
    holders = stored(wanted.where("doc_id IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("id")).select("id").distinct(), "holders")
    texts = docs.where("doc_id IS NOT NULL").select("doc_id", "text").join(holders.hint("merge"), F.col("doc_id") == F.col("id"), "left_semi").select("text")
    if not wanted.where("doc_id IS NULL").isEmpty():
        texts = texts.unionByName(docs.where("doc_id IS NULL").select("text"))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (some,) in rows(batches, 128):
            found = [shingle_set(t) for t in some]
            out = ([node(s) for s in found], [s.tobytes() for s in found], [signature(s).tobytes() for s in found])
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, (pa.int64(), pa.binary(), pa.binary()))], ["node", "found", "sign"])

    made = texts.mapInArrow(make, "node long, found binary, sign binary").join(asked, F.col("node") == F.col("of"), "left_semi")
    return stored(made.dropDuplicates(["node"]), "sets")


def _alike(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs(a, b), which are stored, whose sets are similar enough."""
    tasks = _tasks(pairs.count(), PAIRS)
    guessed = cut(_estimated(pairs, sets, tasks).where(F.col("alike") > similarity - SURE))
    sure, unsure = guessed.where(F.col("alike") >= similarity + SURE).select("a", "b"), guessed.where(F.col("alike") < similarity + SURE).select("a", "b")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                x, y = (part.column(n).to_pylist() for n in ("x", "y"))
                yield part.select(["a", "b"]).filter(pa.array([jaccard(np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)) >= similarity for p, q in zip(x, y)], pa.bool_()))

    return sure.unionByName(_of_both(unsure, sets, "found", tasks).mapInArrow(check, "a long, b long"))


def _by_fingerprint(members: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes that operator 1 links: those of one fingerprint with its least node, and the least nodes of linked fingerprints."""
    marks = stored(members.groupBy("fp").agg(F.min("node").alias("least")), "fingerprints")
    same = members.join(marks, "fp").where("node <> least").select(F.col("least").alias("a"), F.col("node").alias("b"))
    linked = simhash_dedup.links(marks.select("fp"))
    x, y = (marks.select(F.col("fp").alias(c), F.col("least").alias(n)) for c, n in (("a", "x"), ("b", "y")))
    linked = linked.join(x, "a").join(y, "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    return same.unionByName(linked).where("a <> b")


def _grouped(bands: DataFrame) -> DataFrame:
    """(key, node, weight) of the keys that several nodes hold; weight: how many others the node meets over all keys."""
    sizes = bands.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    bands = cut(bands.join(sizes, "key"))
    return cut(bands.select("key", "node").join(bands.groupBy("node").agg(F.sum("size").alias("weight")), "node"))


def _several(groups: DataFrame) -> DataFrame:
    """The keys of groups(key, root) that more than one component holds."""
    return groups.groupBy("key").agg(F.min("root").alias("r"), F.max("root").alias("s")).where("r <> s").select("key")


def _bounds(groups: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(head, node, far, reach) of the nodes of groups(key, node, head) with over BOUNDED of them. Sets x and y of one head can only be alike if x's far is at most y's reach, and the reverse.

    D(x) are the hashes that x or the head has, not both; any set may be the head. x and y are alike if |D(x)| + |D(y)| - 2 |D(x) & D(y)|, in which they differ, is at most
    the share c of their sizes, and the common part is at most what D(x) shares with any other of the head's nodes: |D(x)| less its own hashes.
    """
    c = (1 - similarity) / (1 + similarity)
    large = groups.groupBy("key").agg(F.count("*").alias("size")).where(F.col("size") > BOUNDED).select("key")
    asked = groups.join(large, "key").select("node", "head").distinct()

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                x, y = ([np.frombuffer(v, np.uint64) for v in part.column(n).to_pylist()] for n in ("x", "y"))
                own = [np.setxor1d(p, q, assume_unique=True).view(np.int64) for p, q in zip(x, y)]
                columns = [part.column("head"), part.column("node"), pa.array([len(p) for p in x], pa.int64()), pa.array(own, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, ["head", "node", "size", "own"])

    # By node last: one head may have most of the nodes.
    mine = asked.join(sets.select(F.col("node").alias("head"), F.col("found").alias("y")), "head").join(sets.select("node", F.col("found").alias("x")), "node")
    apart = cut(mine.select("head", "node", "x", "y").mapInArrow(compare, "head long, node long, size long, own array<long>"))
    alone = apart.select("head", "node", F.explode("own").alias("hash")).groupBy("head", "hash").agg(F.count("*").alias("n"), F.min("node").alias("node")).where("n = 1")
    alone = alone.groupBy("head", "node").agg(F.count("*").alias("alone"))
    size, most = F.size("own"), F.col("size") * c
    # A hair more, for the rounding of the share.
    reach = most + size - 2 * F.coalesce("alone", F.lit(0)) + 1e-6
    return apart.join(alone, ["head", "node"], "left").select("head", "node", (size - most).alias("far"), reach.alias("reach"))


def named(docs: DataFrame, marks: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(node, root, least): of each node of marks, which are those of docs, its component and the component's least doc_id."""
    members = stored(marks.groupBy("node").agg(F.min("doc_id").alias("first_id"), *[F.first(c).alias(c) for c in ("fp", "keys")]), "members")
    roots = stored(members.select("node", F.col("node").alias("root")), "roots")

    def compare(pairs: DataFrame) -> None:
        """Joins the components of the pairs that are alike: only their roots are edges, whatever was joined before."""
        nonlocal roots
        alike = _alike(pairs, sets, similarity)
        of = lambda c, name: roots.select(F.col("node").alias(c), F.col("root").alias(name))
        tasks = _tasks(pairs.count(), ROWS)
        edges = alike.join(of("a", "x"), "a").coalesce(tasks).join(of("b", "y"), "b").coalesce(tasks)
        merged = components(edges.select(F.col("x").alias("a"), F.col("y").alias("b")), each=ROWS)
        moved = merged.select(F.col("node").alias("was"), F.col("root").alias("now"))
        roots = stored(roots.join(moved, F.col("root") == F.col("was"), "left").select("node", F.coalesce("now", "root").alias("root")), "roots")

    def apart(groups: DataFrame, tasks: int) -> DataFrame:
        """groups without the nodes that none of their group can be alike to, of the groups that more than one component holds; with the nodes' roots."""
        ends = groups.groupBy("key").agg(F.max("reach").alias("most"), F.min("far").alias("least"))
        near = groups.join(ends, "key").where("far <= most AND reach >= least").select(*groups.columns)
        now = cut(near.join(roots, "node").coalesce(tasks))
        return now.join(_several(now), "key").coalesce(tasks)

    groups = _grouped(members.select("node", F.explode("keys").alias("key")))
    head = cut(groups.groupBy("key").agg(F.max(F.struct("weight", "node"))["node"].alias("head")))
    stars = groups.join(head, "key").where("node <> head").select(F.least("node", "head").alias("a"), F.greatest("node", "head").alias("b"))
    first = cut(stars.unionByName(_by_fingerprint(members)).distinct())
    sets = _sets(docs, marks, groups.select(F.col("node").alias("of")).unionByName(first.select(F.explode(F.array("a", "b")).alias("of"))).distinct())
    compare(first)
    groups = groups.join(head, "key").where("node <> head").drop("head").join(roots, "node")
    groups = cut(groups.join(_several(groups), "key"))
    large = groups.join(roots.groupBy("root").agg(F.count("*").alias("n")), "root").groupBy("key").agg(F.max(F.struct("n", "root"))["root"].alias("head"))
    groups = cut(groups.join(large, "key"))
    tasks = _tasks(groups.count(), ROWS)
    bounds = _bounds(groups, sets, similarity)
    endless = F.lit(float("inf"))
    kept = ["key", "node", "weight", "far", "reach", "keys"]
    groups = groups.join(bounds, ["head", "node"], "left").withColumns({"far": F.coalesce("far", -endless), "reach": F.coalesce("reach", endless)})
    groups, n = apart(groups.join(members.select("node", "keys"), "node").select(*kept), tasks), BOUNDED
    while True:
        # The greatest reach is a head's, too: while such a set is there, no other can leave.
        place = lambda by: F.row_number().over(Window.partitionBy("key").orderBy(F.desc(by), "node"))
        groups = cut(groups.withColumn("first", (place("weight") <= n) | (place("reach") <= n)).coalesce(tasks))
        if not (size := groups.count()):
            break
        tasks = _tasks(size, ROWS)
        heads = groups.where("first").select("key", *[F.col(c).alias(f"{c}_") for c in ("node", "root", "far", "reach", "keys")])
        # Of the bands that both share the first alone compares them: there they stay until they are compared, connected or beyond their bounds.
        once = F.array_intersect("keys", "keys_")[0] == F.col("key")
        met = heads.join(groups, "key").where("root <> root_ AND far <= reach_ AND far_ <= reach AND (NOT first OR node > node_)").where(once)
        compare(cut(met.select(F.least("node", "node_").alias("a"), F.greatest("node", "node_").alias("b")).coalesce(_tasks(size, PAIRS))))
        groups, n = apart(groups.where("NOT first").select(*kept), tasks), 8 * n
    found = members.select("node", "first_id").join(roots, "node")
    least = found.groupBy("root").agg(F.min("first_id").alias("least"))
    return found.join(least, "root").select("node", "root", "least")


def one_of_each(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """docs without near copies: of each component the document with the least doc_id stays.

    Texts without a word are copies of each other. Rows that share a doc_id count as one document; one of them stays. Rows
    with a null doc_id stay if their component has no document with an id, all of them.
    """
    marks = stored(_marks(docs), "marks")
    found = cut(marks.select("doc_id", "node").join(named(docs, marks, similarity), "node"))
    kept = found.where("doc_id = least").select(F.col("doc_id").alias("of")).distinct()
    with_id = first_by_id(docs.join(kept.hint("merge"), docs["doc_id"] == kept["of"], "left_semi"))
    nameless = docs.where("doc_id IS NULL")
    if nameless.isEmpty():
        return with_id
    alone = found.where("doc_id IS NULL AND least IS NULL").select(F.col("node").alias("of")).distinct()
    name = fresh("node", docs.columns)
    marked = with_mark(nameless, name, lambda t: node(shingle_set(t)))
    return with_id.unionByName(marked.join(alone, marked[name] == alone["of"], "left_semi").drop(name))
