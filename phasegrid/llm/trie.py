"""Operator 13: the prefix trie of conversations, from the Cartesian tree over the sorted conversations' LCP array.

Turns become digests of 16 bytes; a conversation's key is its turns' digests, and Spark sorts conversations by key over
all tasks. lcp[i] is how many turns conversation i shares with the one before it. A trie node is named by the first place i
that has its prefix, and its depth: conversation i starts the nodes of the depths lcp[i] + 1 to its length. The members of a node are
a run of places. The runs of more than one are the intervals of the Cartesian tree: around an entry v of the LCP array, from the nearest smaller
entry on its left up to the place before the nearest smaller on its right. Blocks of the array find these with a stack; what a block leaves open is looked up
in the one block that the blocks' minima tell, in the staircase of its records. Equal entries of one run are one
interval, and an interval stands for the depths between its parent's and its own. Sums over subtrees are differences of prefix sums over
places, since the nodes below a run start inside it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, ranked, rows, stored, table
from .merkle import CRC32_SQL

#: Bytes of a turn's digest; places of the LCP array in a block; conversations in a piece of a list of ends.
WIDTH, BLOCK, PIECE = 16, 1 << 16, 4096
#: Turns that every conversation's key has; later ones only as long as some other conversation may share them.
LONG = 1024


def read_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, digest, chars): the digest tells (role, text) apart, chars counts the text's code points. Rows without a conv_id are in no conversation."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * WIDTH)
    return conversations.where("conv_id IS NOT NULL").select("conv_id", "turn", digest.alias("digest"), F.length(text).cast("long").alias("chars"))


def rebuilt(conversations: DataFrame, family: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """(conv_id, depth, digest, chars) and (conv_id, size): conversations whose first turns are those of the first of their family.

    Rows without a conv_id are left out, null roles and texts are empty, other columns aren't read. Conversation c begins with the first h = crc32(c) % most turns of c - c % family and goes on with its own from the (h + 1)-th. Turns go by number, null first, and
    equal numbers by digest, so repeated rows are turns of their own.
    """
    own = ranked(stored(read_turns(conversations), "turns"), ["conv_id"], ["turn", "digest"], "order")
    h = F.crc32(F.encode(F.col("conv_id").cast("string"), "UTF-8")) % most
    sizes = own.where("place = 0").select("conv_id", "total", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % family).alias("head"))
    heads = own.where(F.col("place") < most - 1).select(F.col("conv_id").alias("head"), "place", "digest", "chars")
    known = sizes.select(F.col("conv_id").alias("head"), F.col("total").alias("theirs"))
    convs = sizes.join(known, "head", "left").withColumn("taken", F.least("h", F.coalesce("theirs", F.lit(0))))
    convs = stored(convs.select("conv_id", "head", "h", "taken", (F.col("taken") + F.greatest(F.col("total") - F.col("h"), F.lit(0))).alias("size")), "convs")
    first = convs.select("conv_id", "head", "h").join(heads, "head").where("place < h").select("conv_id", (F.col("place") + 1).alias("depth"), "digest", "chars")
    rest = own.join(convs.select("conv_id", "h", "taken"), "conv_id").where("place >= h").select("conv_id", (F.col("taken") + F.col("place") - F.col("h") + 1).alias("depth"), "digest", "chars")
    return stored(first.unionByName(rest), "sequences"), convs.select("conv_id", "size")


def _keys(turns: DataFrame, convs: DataFrame, long: int) -> DataFrame:
    """(conv_id, size, key). A turn after the long-th whose digest no other conversation has at its depth ends what can be shared, and so the key."""
    if (convs.agg(F.max("size")).first()[0] or 0) > long:
        deep = turns.where(F.col("depth") > long)
        alone = deep.groupBy("depth", "digest").agg(F.count("*").alias("n"), F.min("conv_id").alias("conv_id")).where("n = 1")
        ends = alone.groupBy("conv_id").agg(F.min("depth").alias("last"))
        kept = deep.join(ends, "conv_id", "left").where(F.coalesce(F.col("depth") <= F.col("last"), F.lit(True)))
        turns = turns.where(F.col("depth") <= long).unionByName(kept.select(*turns.columns))
    each = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("depth", "digest"))).alias("x"))
    key = F.unhex(F.array_join(F.transform("x", lambda t: t["digest"]), ""))
    made = convs.join(each, "conv_id", "left").select("conv_id", "size", F.coalesce(key, F.unhex(F.lit(""))).alias("key"))
    return stored(made, "keys")


def _shared(a: bytes, b: bytes) -> int:
    """How many whole digests two keys begin with alike."""
    low, high = 0, min(len(a), len(b)) // WIDTH
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[: mid * WIDTH] == b[: mid * WIDTH] else (low, mid - 1)
    return low


def _sorted(keys: DataFrame) -> DataFrame:
    """(i, conv_id, size, lcp, next): conversations in order of key and id; next is the lcp of the one after. Before the first and after the last stands -1."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n, held, out = TaskContext.get().partitionId(), 0, None, []
        for ids, sizes, of in rows(batches):
            for conv_id, size, key in zip(ids, sizes, of):
                lcp = None if held is None else _shared(held[-1], key)
                if held is not None:
                    out.append((*held[:5], lcp, held[5]))
                held = (conv_id, size, part, n, lcp, key if n == 0 else None, key)
                n += 1
            if out:
                yield _rows(out)
                out = []
        if held is not None:
            yield _rows([(*held[:5], None, held[-1])])

    def _rows(out: list[tuple]) -> pa.RecordBatch:
        kinds = (*[pa.int64()] * 6, pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], ["conv_id", "size", "part", "at", "lcp", "next", "edge"])

    dealt = keys.repartitionByRange(partitions(keys.sparkSession), "key", "conv_id").sortWithinPartitions("key", "conv_id")
    walked = stored(dealt.select("conv_id", "size", "key").mapInArrow(walk, "conv_id long, size long, part long, at long, lcp long, next long, edge binary"), "walked")
    # A row for each task: its first and last key, and how many rows it has.
    tasks = walked.where("edge IS NOT NULL").groupBy(F.col("part").alias("of")).agg(F.min_by("edge", "at").alias("first"), F.max_by("edge", "at").alias("last"), (F.max("at") + 1).alias("n"))
    order = Window.orderBy("of")
    tasks = tasks.select("of", (F.sum("n").over(order) - F.col("n")).alias("base"), "n", F.lag("last").over(order).alias("before"), "first")

    def borders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            met = [-1 if a is None else _shared(a, b) for a, b in zip(batch.column("before").to_pylist(), batch.column("first").to_pylist())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("of", "base", "n")), pa.array(met, pa.int64())], ["of", "base", "n", "met"])

    tasks = stored(tasks.mapInArrow(borders, "of long, base long, n long, met long"), "tasks")
    tasks = tasks.select("of", "base", "n", "met", F.coalesce(F.lead("met").over(order), F.lit(-1)).alias("after"))
    found = walked.join(tasks, F.col("part") == F.col("of"))
    lcp = F.when(F.col("at") == 0, F.col("met")).otherwise(F.col("lcp"))
    after = F.when(F.col("at") == F.col("n") - 1, F.col("after")).otherwise(F.col("next"))
    return stored(found.select((F.col("base") + F.col("at")).alias("i"), "conv_id", "size", lcp.alias("lcp"), after.alias("next")), "sorted")


FOUND = "kind string, block long, a long, b long, c long, d long, e long, f long"


def _in_block(pdf: pd.DataFrame, size: int) -> pd.DataFrame:
    """What a block of size places (i, conv_id, lcp) can tell of its part of the tree, in rows of several kinds:

    place: i, its nearest smaller entry on the left, the least id from the block's start to i, and from i to its end
    run: entry, left and right end, the entries there, least id (nulls: beyond the block)
    fall, rise: entry and place of each record from the left, and from the right
    block: least entry, least id
    """
    pdf = pdf.sort_values("i")
    base, v, ids, n = int(pdf["i"].iloc[0]), pdf["lcp"].tolist(), pdf["conv_id"].to_numpy(), len(pdf)
    block = base // size
    left, right, stack, least = [-1] * n, [n] * n, [], None
    firsts, falls = [], []
    for k, x in enumerate(v):
        while stack and v[stack[-1][0]] > x:
            right[stack.pop()[0]] = k
        if stack and v[stack[-1][0]] == x:
            left[k] = left[stack[-1][0]]
            stack[-1][1] = k
        else:
            left[k] = stack[-1][1] if stack else -1
            stack.append([k, k])
            firsts.append(k)
        if least is None or x < least:
            least = x
            falls.append(k)
    low = [np.minimum.accumulate(ids), np.minimum.accumulate(ids[::-1])[::-1]]
    tables = [ids]
    while 2 ** len(tables) <= n:
        half = 2 ** (len(tables) - 1)
        tables.append(np.minimum(tables[-1][:-half], tables[-1][half:]))
    known = lambda ok, x: x if ok else None
    out = [("place", block, base + k, known(left[k] >= 0, base + left[k]), int(low[0][k]), int(low[1][k]), None, None) for k in range(n)]
    for k in firsts:
        if v[k] < 1:
            continue
        a, b, least_id = left[k], right[k], None
        if a >= 0 and b < n:
            level = (b - a).bit_length() - 1
            least_id = int(min(tables[level][a], tables[level][b - 2**level]))
        out.append(("run", block, v[k], known(a >= 0, base + a), known(b < n, base + b - 1), known(a >= 0, v[a]), known(b < n, v[b] if b < n else None), least_id))
    out += [("fall", block, v[k], base + k, None, None, None, None) for k in falls]
    out += [("rise", block, v[k], base + last, None, None, None, None) for k, last in stack]
    out.append(("block", block, min(v), int(ids.min()), None, None, None, None))
    made = pd.DataFrame(out, columns=["kind", "block", *"abcdef"])
    return made.astype({c: "Int64" for c in "abcdef"})


class _Minima:
    """Least values over runs of blocks: two numbers a block of 65,536 conversations are all that tasks are sent."""

    def __init__(self, values: np.ndarray):
        self.tables = [values]
        while 2 ** len(self.tables) <= len(values):
            half = 2 ** (len(self.tables) - 1)
            self.tables.append(np.minimum(self.tables[-1][:-half], self.tables[-1][half:]))

    def first_below(self, start: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """The first block from start on whose value is below limit; the number of blocks where there is none."""
        at, n = start.copy(), len(self.tables[0])
        for level in reversed(range(len(self.tables))):
            fits = at + 2**level <= n
            skip = fits & (self.tables[level][np.where(fits, at, 0)] >= limit)
            at = np.where(skip, at + 2**level, at)
        return at

    def over(self, start: int, end: int) -> int | None:
        """Least value of the blocks from start up to, not including, end."""
        if start >= end:
            return None
        level = (end - start).bit_length() - 1
        return int(min(self.tables[level][start], self.tables[level][end - 2**level]))


def _intervals(places: DataFrame, size: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(i, block, left), (l, v, r, low, above) and (fb, fv, fp, fe).

    Each place's nearest smaller entry on the left, null if it isn't in the place's block; the tree's intervals with their least id
    and their parent's depth; and, for a block and an entry that it leaves open on the left, the nearest smaller one.
    """
    blocks = places.select("i", "conv_id", "lcp").groupBy(F.expr(f"i div {size}").alias("block_of"))
    found = stored(blocks.applyInPandas(lambda pdf: _in_block(pdf, size), FOUND), "found")
    of = lambda kind: found.where(F.col("kind") == kind)
    minima = of("block").orderBy("block").select("a", "b").toPandas()
    n_blocks = len(minima)
    entries, ids = _Minima(minima["a"].to_numpy(np.int64)), _Minima(minima["b"].to_numpy(np.int64))
    backwards = _Minima(minima["a"].to_numpy(np.int64)[::-1].copy())

    def where(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            b, x, falls = pdf["block"].to_numpy(np.int64), pdf["a"].to_numpy(np.int64), (pdf["kind"] == "fall").to_numpy()
            right = entries.first_below(np.minimum(b + 1, n_blocks), x)
            left = n_blocks - 1 - backwards.first_below(n_blocks - b, x)
            yield pd.DataFrame({"kind": pdf["kind"], "block": b, "v": x, "target": np.where(falls, left, right)})

    # Entries that have no smaller one in their block on the left (fall) or on the right (rise): which block has it.
    asked = found.where("kind IN ('fall', 'rise') AND a >= 1").select("kind", "block", "a").mapInPandas(where, "kind string, block long, v long, target long")
    stairs = found.where("kind IN ('fall', 'rise')").groupBy(F.col("kind").alias("stair"), F.col("block").alias("target")).agg(F.collect_list(F.struct(F.col("b").alias("place"), F.col("a").alias("entry"))).alias("steps"))
    met = asked.withColumn("stair", F.when(F.col("kind") == "fall", "rise").otherwise("fall")).join(stairs, ["stair", "target"], "left")
    lower = F.filter("steps", lambda s: s["entry"] < F.col("v"))
    answer = F.when(F.col("kind") == "fall", F.array_max(lower)).otherwise(F.array_min(lower))
    answers = stored(met.select("kind", "block", "v", answer.alias("s")), "answers")
    on = lambda kind, names: answers.where(F.col("kind") == kind).select(F.col("block").alias(names[0]), F.col("v").alias(names[1]), F.col("s.place").alias(names[2]), F.col("s.entry").alias(names[3]))
    last = places.agg(F.max("i")).first()[0] or 0
    runs = of("run").select("block", F.col("a").alias("v"), F.col("b").alias("l"), F.col("c").alias("r"), F.col("d").alias("at_l"), F.col("e").alias("at_r"), F.col("f").alias("low"))
    closed = runs.where("l IS NOT NULL AND r IS NOT NULL")
    opened = runs.where("l IS NULL OR r IS NULL").join(on("fall", ["fb", "fv", "fp", "fe"]), (F.col("block") == F.col("fb")) & (F.col("v") == F.col("fv")), "left")
    opened = opened.join(on("rise", ["rb", "rv", "rp", "re"]), (F.col("block") == F.col("rb")) & (F.col("v") == F.col("rv")), "left")
    opened = opened.select("v", F.coalesce("l", "fp").alias("l"), F.coalesce(F.col("r"), F.col("rp") - 1, F.lit(last)).alias("r"), F.coalesce("at_l", "fe").alias("at_l"), F.coalesce("at_r", "re", F.lit(-1)).alias("at_r"))
    # Blocks name an interval that reaches over several of them once each.
    opened = opened.groupBy("l", "v").agg(F.max("r").alias("r"), F.max("at_l").alias("at_l"), F.max("at_r").alias("at_r"))
    place = of("place").select(F.col("a").alias("i"), F.col("c").alias("to_here"), F.col("d").alias("from_here"))
    opened = opened.join(place.select(F.col("i").alias("l"), "from_here"), "l").join(place.select(F.col("i").alias("r"), "to_here"), "r")

    def between(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            a, b = (pdf["l"] // size).tolist(), (pdf["r"] // size).tolist()
            ends = zip(a, b, pdf["from_here"].tolist(), pdf["to_here"].tolist())
            # In one block, an open end is the table's: all that follows l.
            low = [min(x for x in (ids.over(p + 1, q), s, t if q > p else None) if x is not None) for p, q, s, t in ends]
            yield pdf[["v", "l", "r", "at_l", "at_r"]].assign(low=np.array(low, np.int64))

    kinds = "v long, l long, r long, at_l long, at_r long, low long"
    whole = opened.select("v", "l", "r", "at_l", "at_r", "from_here", "to_here").mapInPandas(between, kinds)
    tree = closed.select("v", "l", "r", "at_l", "at_r", "low").unionByName(whole)
    tree = tree.select("l", "v", "r", "low", F.greatest("at_l", "at_r", F.lit(0)).alias("above"))
    lefts = of("place").select(F.col("a").alias("i"), "block", F.col("b").alias("left"))
    return lefts, stored(tree, "tree"), on("fall", ["fb", "fv", "fp", "fe"])


def _ends(places: DataFrame, piece: int) -> DataFrame:
    """(i, depth, ends_sha256) of the nodes at which conversations end; i is -1 at the root.

    Conversations that end at a node are equal, so they stand side by side in order of id: pieces of their list are made
    apart, and one pass over a node's pieces, in order, hashes them without holding the list.
    """
    start = F.when(F.col("size") == 0, F.lit(-1)).when(F.col("size") > F.col("lcp"), F.col("i")).otherwise(F.col("left"))
    pieces = places.groupBy(start.alias("start"), F.col("size").alias("depth"), F.expr(f"i div {piece}").alias("piece")).agg(F.sort_array(F.collect_list("conv_id")).alias("ids"))
    pieces = pieces.select("start", "depth", "piece", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, hasher, out = None, None, []
        for starts, depths, texts in rows(batches):
            for at, depth, text in zip(starts, depths, texts):
                if (at, depth) != now:
                    if now is not None:
                        out.append((*now, hasher.hexdigest()))
                    now, hasher = (at, depth), hashlib.sha256(text.encode())
                else:
                    hasher.update(b"," + text.encode())
            if out:
                yield made(out)
                out = []
        if now is not None:
            yield made([(*now, hasher.hexdigest())])

    def made(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), (pa.int64(), pa.int64(), pa.string()))], ["start", "depth", "ends_sha256"])

    dealt = pieces.repartition(partitions(places.sparkSession), "start", "depth").sortWithinPartitions("start", "depth", "piece")
    return dealt.select("start", "depth", "text").mapInArrow(run, "start long, depth long, ends_sha256 string")


def trie(turns: DataFrame, convs: DataFrame, block: int = BLOCK, piece: int = PIECE, long: int = LONG) -> DataFrame:
    """The nodes of the trie of turns(conv_id, depth, digest, chars), for convs(conv_id, size), whose ids are unique.

    (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256): a node goes by its least member and its depth. A
    conversation without turns is a member of the root. No conversations, no rows. Both tables are read several times, so they should be stored.
    block: places of the LCP array that one task handles together; piece: conversations in a piece of a list of ends; long: turns
    after which a key may end. None of them changes the result.
    """
    places = _sorted(_keys(turns, convs, long))
    lefts, tree, answers = _intervals(places, block)
    # Nearest smaller entries: those outside the block come from the answers; they are asked for where lcp >= 1 only.
    places = places.join(lefts, "i").join(answers, (F.col("block") == F.col("fb")) & (F.col("lcp") == F.col("fv")) & F.col("left").isNull(), "left")
    places = stored(places.select("i", "conv_id", "size", "lcp", "next", F.coalesce("left", "fp").alias("left")), "places")
    # An interval is its own node and those of the depths that are missing between it and its parent.
    several = tree.select("l", "r", "low", F.explode(F.expr("sequence(above + 1, v)")).alias("d"))
    started = places.where("size > lcp AND lcp >= 1").groupBy(F.col("left").alias("l"), F.col("lcp").alias("d")).agg(F.count("*").alias("more"))
    several = stored(several.join(started, ["l", "d"], "left"), "several")
    lows = several.select("l", "d", "low")
    nodes = turns.select("conv_id", "depth", "chars").join(places, "conv_id").where("depth > lcp")
    alone = nodes.where("depth > next").select("i", "depth", "lcp", "next", "left", "conv_id", F.lit(1).cast("long").alias("n_convs"), (F.col("depth") < F.col("size")).cast("long").alias("n_children"), F.lit(0).cast("long").alias("own"), F.col("i").alias("r"))
    many = nodes.where("depth <= next").join(several, (F.col("i") == F.col("l")) & (F.col("depth") == F.col("d")))
    children = (F.col("depth") < F.col("size")).cast("long") + F.coalesce("more", F.lit(0))
    n = F.col("r") - F.col("i") + 1
    many = stored(many.select("i", "depth", "lcp", "next", "left", F.col("low").alias("conv_id"), n.alias("n_convs"), children.alias("n_children"), ((n - 1) * F.col("chars")).alias("own"), "r"), "many")
    # Prefix sums over places: leaves, and what is saved at the nodes that start there.
    leaf = F.sum((F.col("n_children") == 0).cast("long"))
    here = alone.groupBy("i").agg(leaf.alias("leaves"), F.lit(0).cast("long").alias("saved")).unionByName(many.groupBy("i").agg(leaf.alias("leaves"), F.sum("own").alias("saved")))
    here = here.unionByName(places.select("i", F.lit(0).cast("long").alias("leaves"), F.lit(0).cast("long").alias("saved")))
    here = here.groupBy("i").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")).withColumn("block", F.expr(f"i div {block}"))
    here = stored(here, "here")
    whole = here.groupBy("block").agg(F.sum("leaves").alias("bl"), F.sum("saved").alias("bs"))
    order, inside = Window.orderBy("block"), Window.partitionBy("block").orderBy("i")
    whole = whole.select("block", (F.sum("bl").over(order) - F.col("bl")).alias("bl"), (F.sum("bs").over(order) - F.col("bs")).alias("bs"))
    sums = here.withColumn("il", F.sum("leaves").over(inside)).withColumn("is", F.sum("saved").over(inside)).join(whole, "block")
    sums = stored(sums.select("i", "leaves", "saved", (F.col("il") + F.col("bl")).alias("to_leaves"), (F.col("is") + F.col("bs")).alias("to_saved")), "sums")
    to_r = sums.select(F.col("i").alias("r"), F.col("to_leaves").alias("rl"), F.col("to_saved").alias("rs"))
    to_l = sums.select("i", (F.col("to_leaves") - F.col("leaves")).alias("ll"), (F.col("to_saved") - F.col("saved")).alias("ls"))
    higher = F.sum("own").over(Window.partitionBy("i").orderBy("depth")) - F.col("own")
    many = many.withColumn("higher", higher).join(to_r, "r").join(to_l, "i")
    many = many.withColumn("n_leaves", F.col("rl") - F.col("ll")).withColumn("saved_tokens", F.col("rs") - F.col("ls") - F.col("higher"))
    alone = alone.withColumn("n_leaves", F.lit(1).cast("long")).withColumn("saved_tokens", F.lit(0).cast("long"))
    cols = ["i", "depth", "lcp", "next", "left", "conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    nodes = alone.select(*cols).unionByName(many.select(*cols))
    # A node's parent starts where it does, unless the node is the first that starts there. Parents that no other conversation shares have the same id.
    same = F.col("depth") - 1 > F.col("lcp")
    nodes = nodes.withColumn("pi", F.when(same, F.col("i")).otherwise(F.col("left"))).withColumn("pd", F.col("depth") - 1)
    least = places.agg(F.min("conv_id")).first()[0]
    plain = nodes.where("pd = 0 OR pd > greatest(next, lcp)").withColumn("parent_conv_id", F.when(F.col("pd") == 0, F.lit(least)).otherwise(F.col("conv_id")))
    looked = nodes.where("pd > 0 AND pd <= greatest(next, lcp)").join(lows.select(F.col("l").alias("pi"), F.col("d").alias("pd"), F.col("low").alias("parent_conv_id")), ["pi", "pd"])
    ends = stored(_ends(places, piece), "ends")
    nodes = plain.select(*cols, "parent_conv_id").unionByName(looked.select(*cols, "parent_conv_id"))
    nodes = nodes.join(ends.select(F.col("start").alias("i"), "depth", "ends_sha256"), ["i", "depth"], "left")
    root = places.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.count_if(F.expr("size > 0 AND lcp < 1")).alias("n_children"))
    below = sums.agg(F.greatest(F.sum("leaves"), F.lit(1)).alias("n_leaves"), F.sum("saved").alias("saved_tokens"))
    root = root.join(below).where("n_convs > 0").withColumn("i", F.lit(-1)).withColumn("depth", F.lit(0).cast("long")).withColumn("parent_conv_id", F.lit(None).cast("long"))
    root = root.join(ends.where("start = -1").select(F.col("start").alias("i"), "ends_sha256"), "i", "left")
    shown = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256")]
    return nodes.select(*shown).unionByName(root.select(*shown))


def op13_trie(spark, sf_dir):
    return trie(*rebuilt(table(spark, sf_dir, "conversations")))


OP13_SQL = f"""
WITH a AS (SELECT conv_id, turn, sha256(strlen(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS digest, length(coalesce(text, '')) AS chars FROM conversations WHERE conv_id IS NOT NULL),
o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, digest) - 1 AS place FROM a),
c AS MATERIALIZED (SELECT conv_id, conv_id - conv_id % 100 AS head, {CRC32_SQL.format('conv_id')} % 6 AS h FROM (SELECT DISTINCT conv_id FROM o)),
r AS (SELECT c.conv_id, 0 AS part, o.place, o.digest, o.chars FROM c JOIN o ON o.conv_id = c.head AND o.place < c.h
  UNION ALL SELECT o.conv_id, 1, o.place, o.digest, o.chars FROM o JOIN c USING (conv_id) WHERE o.place >= c.h),
t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY part, place) AS depth, digest, chars FROM r),
s AS (SELECT conv_id, depth, chars, sha256(string_agg(digest, '') OVER (PARTITION BY conv_id ORDER BY depth)) AS node FROM t),
m AS MATERIALIZED (SELECT conv_id, depth, chars, node, count(*) OVER (PARTITION BY conv_id) AS size FROM s
  UNION ALL SELECT conv_id, 0, 0, '', coalesce((SELECT count(*) FROM t WHERE t.conv_id = c.conv_id), 0) FROM c),
n AS MATERIALIZED (SELECT depth, node, min(conv_id) AS conv_id, count(*) AS n_convs, max(chars) AS chars,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (size = depth), '')) AS ends_sha256 FROM m GROUP BY 1, 2),
p AS MATERIALIZED (SELECT n.*, x.node AS parent FROM n LEFT JOIN m x ON x.conv_id = n.conv_id AND x.depth = n.depth - 1),
k AS (SELECT depth - 1 AS depth, parent AS node, count(*) AS n_children FROM p WHERE depth > 0 GROUP BY 1, 2),
q AS (SELECT p.*, coalesce(k.n_children, 0) AS n_children FROM p LEFT JOIN k ON k.depth = p.depth AND k.node = p.node),
u AS (SELECT x.depth, x.node, count(*) FILTER (q.n_children = 0) AS n_leaves, sum((q.n_convs - 1) * q.chars)::BIGINT AS saved_tokens FROM q JOIN m x ON x.conv_id = q.conv_id AND x.depth <= q.depth GROUP BY 1, 2)
SELECT q.conv_id, q.depth, y.conv_id AS parent_conv_id, q.n_convs, q.n_children, u.n_leaves, u.saved_tokens, q.ends_sha256
FROM q JOIN u ON u.depth = q.depth AND u.node = q.node LEFT JOIN n y ON y.depth = q.depth - 1 AND y.node = q.parent
"""
