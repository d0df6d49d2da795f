"""Operator 9: near-duplicate passages by compact windows.

A text is its sequence of five-word shingles. For each of `hashes` hash functions, the Cartesian tree over a
sequence's hash values has a node (left, centre, right) for each position: all subsequences inside left..right
that contain the centre have their least value there. Nodes at least as wide as a passage are the compact
windows, about 2 n / width of them, and together they stand for every subsequence long enough.

Windows whose centre and a shingle near it (after it for every other function, before it for the rest) are the
same are brought together, first inside a batch and then by a shuffle, and each is linked to the one with the least
document id, if the two intervals, laid over each other at their centres, share enough. Links of two
documents are joined to a stretch of each; the stretches' words are fetched and aligned, and
passages of at least `least_words` words with a shingle similarity of at least `similarity` remain.

Windows that no passage covers then, since the one with the least id shares too little, are linked once more, under finer keys: those of
the group that also share shingles farther from the centre, 12 or 23 places to either side. A passage of 50 words
reaches 23 places to one side of any centre inside it. So no group's pairs are written out, and a group that holds a
third of all documents reaches a task only as the rows of one document a batch.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, partitions, rows, stored, table

WIDTH, NEAR, REPEATS = 5, 8, 32
#: Windows are cut to CLIP places on each side, and MARGIN words more are fetched; passages that reach the end of what was fetched are aligned again over whole texts.
CLIP, MARGIN = 400, 100
#: Where else two windows may agree, and which of these places make a finer key.
BESIDE = (-23, -12, 12, 23)
FINER = ((0,), (3,), (1, 2), (1, 3), (0, 2))
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(words: list[bytes]) -> np.ndarray:
    """64-bit hashes of the five-word shingles."""
    if len(words) < WIDTH:
        return np.empty(0, np.uint64)
    each = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    out = each[: len(each) - WIDTH + 1].copy()
    for k in range(1, WIDTH):
        out = out * _ODD + each[k : len(each) - WIDTH + 1 + k]
    return _mix(out)


def split_words(text: str | None) -> list[bytes]:
    return (text or "").lower().encode("utf-8", "surrogatepass").split()


def compact_windows(values: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(left, centre, right), ends included, of the Cartesian tree's nodes that span at least width positions.

    Zeros are walls that no window crosses. Of equal values the first is the least.
    """
    n = len(values)
    none = np.empty(0, np.int64)
    if n < width:
        return none, none, none
    steps = [values]  # steps[i][p]: the least of 2 ** i values from p on
    while 2 << len(steps) - 1 <= width:
        s = 1 << len(steps) - 1
        steps.append(np.minimum(steps[-1][:-s], steps[-1][s:]))
    top = 1 << len(steps) - 1
    least = np.minimum(steps[-1][: n - width + 1], steps[-1][width - top : width - top + n - width + 1])
    most = np.concatenate([np.zeros(width - 1, values.dtype), least, np.zeros(width - 1, values.dtype)])
    s = 1
    while 2 * s <= width:
        most = np.maximum(most[:-s], most[s:])
        s *= 2
    most = np.maximum(most[:n], most[width - s : width - s + n])
    centre = np.flatnonzero((most == values) & (values > 0))
    value, left, right = values[centre], centre.copy(), centre.copy()  # the window is left..right so far
    for side in (-1, 1):
        at = left if side < 0 else right
        active = np.arange(len(centre))
        while len(active):  # whole steps of the greatest size, as long as they fit
            p = at[active] - top if side < 0 else at[active] + 1
            ok = (p >= 0) & (p + top <= n)
            ok[ok] = (steps[-1][p[ok]] > value[active[ok]]) if side < 0 else (steps[-1][p[ok]] >= value[active[ok]])
            active = active[ok]
            at[active] += side * top
        for i in range(len(steps) - 2, -1, -1):
            p = at - (1 << i) if side < 0 else at + 1
            ok = (p >= 0) & (p + (1 << i) <= n)
            ok[ok] = (steps[i][p[ok]] > value[ok]) if side < 0 else (steps[i][p[ok]] >= value[ok])
            at[ok] += side * (1 << i)
    wide = right - left + 1 >= width
    return left[wide], centre[wide], right[wide]


_ONE = ("doc_id", "centre", "lo", "hi", "near")
_OTHER = ("of_id", "of_centre", "of_lo", "of_hi", "of_near")
LINKS = "key long, doc_id long, centre int, lo int, hi int, near long, of_id long, of_centre int, of_lo int, of_hi int, of_near long"
SEEN = f"part long, {LINKS}"
_KINDS = {"long": pa.int64(), "int": pa.int32()}


def _batch(schema: str, columns: list[np.ndarray], masks: dict[int, np.ndarray] | None = None) -> pa.RecordBatch:
    fields = [f.split() for f in schema.split(", ")]
    arrays = [pa.array(c, _KINDS[k], mask=(masks or {}).get(i)) for i, (c, (_, k)) in enumerate(zip(columns, fields))]
    return pa.RecordBatch.from_arrays(arrays, [n for n, _ in fields])


def _groups(key: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order by key and document, and for each place in it that of its group's first row."""
    order = np.lexsort((doc, key))
    k = key[order]
    heads = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
    return order, np.repeat(heads, np.diff(np.r_[heads, len(k)]))


def _beside(flat: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For each place of flat 16 bits of each shingle at BESIDE, 0 where the text has none there."""
    size = np.diff(starts) - 1
    first, last = np.repeat(starts[:-1], size + 1), np.repeat(starts[1:] - 1, size + 1)
    at, out = np.arange(len(flat)), np.zeros(len(flat), np.uint64)
    for k, off in enumerate(BESIDE):
        p = at + off
        ok = (p >= first) & (p < last)
        out |= np.where(ok, (flat[np.where(ok, p, 0)] >> np.uint64(48)) | np.uint64(1), np.uint64(0)) << np.uint64(16 * k)
    return out.view(np.int64)


def _windows(width: int, hashes: int, room: int = 1 << 18):
    def make(docs: list[int], parts: list[np.ndarray]) -> pa.RecordBatch:
        wall = np.zeros(1, np.uint64)
        flat = np.concatenate([x for p in parts for x in (p, wall)])
        starts = np.cumsum([0, *(len(p) + 1 for p in parts)])
        ids, out, around = np.array(docs, np.int64), [], _beside(flat, starts)
        for f in range(hashes):
            values = _mix(flat + np.uint64((f + 1) * int(_ODD) & (2**64 - 1))) | np.uint64(1)
            values[starts[1:] - 1] = 0
            left, centre, right = compact_windows(values, width)
            near = centre + (NEAR if f % 2 == 0 else -NEAR)
            of = np.searchsorted(starts, centre, "right") - 1
            inside = (near >= starts[of]) & (near < starts[of + 1])
            beside = np.where(inside, flat[np.where(inside, near, 0)], np.uint64(0))
            key = _mix(flat[centre] + _mix(beside + np.uint64(f)))
            base = starts[of]
            out.append((key.view(np.int64), ids[of], centre - base, np.maximum(left, centre - CLIP) - base, np.minimum(right, centre + CLIP) - base, around[centre], np.full(len(of), f)))
        key, *one, f = (np.concatenate(x) for x in zip(*out))
        # The key's lowest bits name the hash function, so that links can tell how many agree.
        key = (key & ~np.int64(15)) | f
        order, head = _groups(key, one[0])
        key, *one = (x[order] for x in (key, *one))
        doc = one[0]
        linked = doc != doc[head]  # the head's own repeats go on: its document may not be the least of all
        part = np.where(linked, _mix(doc.view(np.uint64)).view(np.int64), key)
        return _batch(SEEN, [part, key, *one, *(x[head] for x in one)], dict.fromkeys(range(7, 12), ~linked))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, parts, n = [], [], 0
        for ids, texts in rows(batches, 128):
            for doc_id, text in zip(ids, texts):
                found = shingles(split_words(text))
                if doc_id is not None and len(found) >= width:
                    docs.append(doc_id)
                    parts.append(found)
                    n += len(found)
                    if n >= room:
                        yield make(docs, parts)
                        docs, parts, n = [], [], 0
        if docs:
            yield make(docs, parts)

    return run


def _link():
    """A partition's rows as links: those made already, and each window's to its group's first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wait = []
        for b in batches:
            made = b.column("of_id").is_valid()
            ready = b.filter(made)
            if ready.num_rows:
                yield ready.select(["key", *_ONE, *_OTHER])
            wait.append([b.column(n).to_numpy(zero_copy_only=False)[~made.to_numpy(zero_copy_only=False)] for n in ("key", *_ONE)])
        if not wait:
            return
        key, *one = map(np.concatenate, zip(*wait))
        if not len(key):
            return
        order, head = _groups(key, one[0])
        key, *one = (x[order] for x in (key, *one))
        at = np.flatnonzero(one[0] != one[0][head])
        yield _batch(LINKS, [key[at], *(x[at] for x in one), *(x[head[at]] for x in one)])

    return run


def align(a: list[bytes], b: list[bytes], least_words: int, similarity: float, gap: int = 20) -> list[tuple[int, int, int, int, float]]:
    """(start, end, other start, other end, similarity), in words, of the passages that two stretches share.

    Runs of equal shingles are chained over gaps of up to `gap` words while the chain's shared shingles are enough of the union. A
    shingle that occurs more often starts a run at each occurrence, and each run goes on the chain that shares most; only
    where repeats have over `REPEATS` matches a shingle, a run starts at the occurrence where it is longest.
    """
    x, y = shingles(a), shingles(b)
    found: list[tuple[int, int, int, int, float]] = []
    if not len(x) or not len(y):
        return found
    runs = _runs(x, y, gap)
    ends = sorted(range(len(runs)), key=lambda r: runs[r][0] + runs[r][2])
    places = [runs[r][0] + runs[r][2] for r in ends]
    alike = lambda c: c[4] / (c[1] - c[0] + c[3] - c[2] - c[4])
    chains: list[tuple[int, int, int, int, int]] = []  # the best that ends with each run
    for i, j, n in runs:
        best = (i, i + n, j, j + n, n)
        for r in ends[bisect_left(places, i - gap) : bisect_right(places, i)]:
            c = chains[r]
            if 0 <= j - c[3] <= gap and c[4] + n > best[4] and alike(longer := (c[0], i + n, c[2], j + n, c[4] + n)) >= similarity:
                best = longer
        chains.append(best)
    # As few of the passages as cover all words that any covers.
    whole = sorted(c for c in chains if min(c[1] - c[0], c[3] - c[2]) + WIDTH - 1 >= least_words)
    at, done = 0, 0
    while True:
        near = []
        while at < len(whole) and whole[at][0] <= done:
            near.append(whole[at])
            at += 1
        c = max(near, key=lambda c: (c[1], c[4]), default=None)
        if c and c[1] + WIDTH - 1 > done:
            found.append((c[0], c[1] + WIDTH - 1, c[2], c[3] + WIDTH - 1, alike(c)))
            done = c[1] + WIDTH - 1
        elif at < len(whole):
            done = whole[at][0]
        else:
            return found


def _runs(x: np.ndarray, y: np.ndarray, gap: int) -> list[tuple[int, int, int]]:
    """(place in x, place in y, length) of the runs of equal shingles, by place."""
    order = np.argsort(y, kind="stable")
    first, last = np.searchsorted(y[order], x), np.searchsorted(y[order], x, "right")
    n = last - first
    if n.sum() <= REPEATS * (len(x) + len(y)):
        i = np.repeat(np.arange(len(x)), n)
        j = order[np.repeat(first - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())]
        by = np.lexsort((i, j - i))
        i, j = i[by], j[by]
        starts = np.flatnonzero(np.r_[True, (np.diff(i) != 1) | (np.diff(j) != 1)])[: len(i)]
        return sorted(zip(i[starts].tolist(), j[starts].tolist(), np.diff(np.r_[starts, len(i)]).tolist()))
    runs, at = [], 0
    while at < len(x):
        if not n[at]:
            at += 1
            continue
        here = order[first[at] : last[at]]
        if runs and at - runs[-1][0] - runs[-1][2] <= gap:  # rather where the last run goes on
            k = runs[-1][1] + at - runs[-1][0]
            here = np.array([k]) if k < len(y) and y[k] == x[at] else here
        size = 1
        while at + size < len(x):
            more = here[here + size < len(y)]
            more = more[y[more + size] == x[at + size]]
            if not len(more):
                break
            here, size = more, size + 1
        runs.append((at, int(here[0]), size))
        at += size
    return runs


PASSAGES = "doc_id long, start int, end int, of_id long, of_start int, of_end int, similarity double"


def near_passages(docs: DataFrame, least_words: int = 50, similarity: float = 0.8, hashes: int = 4, least_hashes: int = 1) -> DataFrame:
    """(doc_id, start, end, of_id, of_start, of_end, similarity): passages of doc_id that also stand in of_id, a lesser id.

    Places are in words (split at ASCII white space, compared in lower case), the end excluded. Rows of one document repeat no passage of itself; texts
    with a null id, null texts and texts of fewer than least_words words have none. Rows with the same id count as one document, whose
    text is then the greatest. Documents without such passages don't appear; an empty table gives no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    width, n = least_words - WIDTH + 1, partitions(spark)
    docs = docs.select("doc_id", "text")
    seen = docs.mapInArrow(_windows(width, hashes), SEEN).repartition(n, "part")
    links = stored(seen.mapInArrow(_link(), LINKS), "links")
    found = _verified(docs, links, least_words, similarity, least_hashes)
    again = stored(_again(links, found), "again")
    if again.isEmpty():
        return found
    return found.unionByName(_verified(docs, again, least_words, similarity, least_hashes)).distinct()


def _again(links: DataFrame, found: DataFrame) -> DataFrame:
    """Links, as those given, of the windows that no passage covers, to the least of all and to the least such window under each finer key of their group."""
    passed = found.select(F.col("doc_id").alias("d"), "start", "end").distinct()
    held = (F.col("doc_id") == F.col("d")) & (F.col("centre") >= F.col("start")) & (F.col("centre") < F.col("end"))
    failed = stored(links.join(passed, held, "left_anti").select("key", *_ONE).distinct(), "failed")
    heads = links.select("key", *[F.col(o).alias(c) for c, o in zip(_ONE, _OTHER)])
    asked = failed.select("key").distinct()
    members = links.select("key", *_ONE).unionByName(heads).join(asked, "key", "left_semi")

    def finer(df: DataFrame) -> DataFrame:
        fields = [F.shiftrightunsigned("near", 16 * i).bitwiseAND(65535) for i in range(len(BESIDE))]
        made = [F.when(reduce(Column.__and__, [fields[i] != 0 for i in chosen]), F.xxhash64("key", F.lit(k), *[fields[i] for i in chosen])) for k, chosen in enumerate(FINER)]
        return df.select("key", *_ONE, F.explode(F.array_compact(F.array(*made))).alias("finer"))

    least = lambda df, name: finer(df).groupBy("finer").agg(F.min(F.struct(*_ONE)).alias(name))
    both = least(members, "all").join(least(failed, "apart"), "finer")
    tried = finer(failed).join(both, "finer").select("key", *_ONE, F.explode(F.array("all", "apart")).alias("x"))
    tried = tried.select("key", *_ONE, *[F.col(f"x.{c}").alias(o) for c, o in zip(_ONE, _OTHER)]).where("of_id < doc_id").distinct()
    return tried.join(links.select("key", "doc_id", "of_id"), ["key", "doc_id", "of_id"], "left_anti")


def _verified(docs: DataFrame, links: DataFrame, least_words: int, similarity: float, least_hashes: int) -> DataFrame:
    """The passages that documents of links share, stored."""
    width, off = least_words - WIDTH + 1, F.col("centre") - F.col("of_centre")
    # Both windows' common interval, in the places of each; the key's lowest bits name the hash function.
    links = links.select("doc_id", "of_id", off.alias("off"), F.greatest("lo", F.col("of_lo") + off).alias("lo"), F.least("hi", F.col("of_hi") + off).alias("hi"), F.expr("shiftleft(1, cast(key & 15 AS int))").alias("bit"))
    links = links.where(F.col("hi") - F.col("lo") + 1 >= width // 2).select("doc_id", "of_id", "lo", "hi", (F.col("lo") - F.col("off")).alias("of_lo"), (F.col("hi") - F.col("off")).alias("of_hi"), "bit")
    pairs = links.groupBy("doc_id", "of_id").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min("of_lo").alias("of_lo"), F.max("of_hi").alias("of_hi"), F.expr("bit_or(bit)").alias("bits"))
    pairs = stored(pairs.where(F.bit_count("bits") >= least_hashes).drop("bits"), "pairs")
    found = stored(_aligned(docs, pairs, least_words, similarity), "found")
    cut = found.where("open").select("doc_id", "of_id").distinct()
    if cut.isEmpty():
        return found.drop("open")
    whole = cut.select("doc_id", "of_id", *[F.lit(v).alias(c) for c, v in (("lo", 0), ("hi", 2**30), ("of_lo", 0), ("of_hi", 2**30))])
    longer = stored(_aligned(docs, whole, least_words, similarity), "longer")
    return found.join(cut, ["doc_id", "of_id"], "left_anti").unionByName(longer).drop("open")


def _aligned(docs: DataFrame, pairs: DataFrame, least_words: int, similarity: float, gap: int = 20) -> DataFrame:
    """The passages of each pair's stretches; open: the passage reaches an end of what was fetched, and the text goes on there."""
    sides = F.array(
        F.struct(F.col("doc_id").alias("id"), F.lit(0).alias("side"), F.greatest(F.col("lo") - MARGIN, F.lit(0)).alias("from"), (F.col("hi") + MARGIN).alias("to")),
        F.struct(F.col("of_id").alias("id"), F.lit(1).alias("side"), F.greatest(F.col("of_lo") - MARGIN, F.lit(0)).alias("from"), (F.col("of_hi") + MARGIN).alias("to")),
    )
    asked = pairs.select("doc_id", "of_id", F.explode(sides).alias("x")).select("doc_id", "of_id", "x.*")

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, words = None, []
        for text, doc, of, side, start, end in rows(batches, 128):
            out, more = [], []
            for t, s, e in zip(text, start, end):
                if t != last:
                    last, words = t, split_words(t)
                out.append(b" ".join(words[s : e + WIDTH]).decode("utf-8", "surrogatepass"))
                more.append(len(words) > e + WIDTH)
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip((doc, of, side, start, out, more), kinds)], ["doc_id", "of_id", "side", "from", "words", "more"])

    # By shuffles whatever is asked: a plan that changes with the number of requests would tell little about more of them.
    texts = docs.withColumnRenamed("doc_id", "id").hint("merge").join(asked, "id").select("text", "doc_id", "of_id", "side", "from", "to")
    parts = texts.mapInArrow(fetch, "doc_id long, of_id long, side int, from int, words string, more boolean")
    both = parts.groupBy("doc_id", "of_id").agg(*[F.max(F.when(F.col("side") == s, F.struct("from", "words", "more"))).alias(c) for s, c in ((0, "x"), (1, "y"))])
    both = both.select("doc_id", "of_id", *[F.col(f"{c}.{k}").alias(f"{c}_{k}") for c in ("x", "y") for k in ("from", "words", "more")])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc, of, start, a, a_more, of_start, b, b_more in rows(batches, 128):
            out = []
            for d, o, s, x, xm, p, y, ym in zip(doc, of, start, a, a_more, of_start, b, b_more):
                x, y = split_words(x), split_words(y)
                for i, j, k, m, sim in align(x, y, least_words, similarity, gap):
                    left, right = (s > 0 and i <= gap) or (p > 0 and k <= gap), (xm and j >= len(x) - gap) or (ym and m >= len(y) - gap)
                    out.append((d, s + i, s + j, o, p + k, p + m, sim, left or right))
            if out:
                kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.bool_())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], [c.split()[0] for c in PASSAGES.split(", ")] + ["open"])

    return both.mapInArrow(verify, f"{PASSAGES}, open boolean")


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """text without the words in the spans, and without what lies between two of them that touch."""
    places = [m.span() for m in WORDS.finditer(text)]
    out, at = [], 0
    for start, end in merged(spans):
        if start < len(places):
            out.append(text[at : places[start][0]])
            at = places[end][0] if end < len(places) else len(text)
    return "".join([*out, text[at:]])


def merged(spans: list[tuple[int, int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return out


def remove_passages(docs: DataFrame, passages: DataFrame) -> DataFrame:
    """docs(doc_id, text and others) without the passages; documents of which no word is left go. n_chars, if there, is set anew where text changes."""
    columns, name = docs.columns, fresh("spans", docs.columns)
    spans = passages.groupBy(F.col("doc_id").alias("of")).agg(F.collect_list(F.struct("start", "end")).alias(name))
    joined = docs.join(spans.hint("merge"), docs["doc_id"] == spans["of"], "left").select(*[docs[c] for c in columns], name)
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            texts, spans = batch.column("text").to_pylist(), batch.column(name).to_pylist()
            new = [without(t, [(x["start"], x["end"]) for x in s]) if s and t else t for t, s in zip(texts, spans)]
            out = {c: batch.column(c) for c in columns}
            out["text"] = pa.array(new, batch.schema.field("text").type)
            if "n_chars" in out:
                sizes = out["n_chars"].to_pylist()
                out["n_chars"] = pa.array([len(n) if s and n is not None else old for n, s, old in zip(new, spans, sizes)], batch.schema.field("n_chars").type)
            keep = pa.array([not s or bool(n and WORDS.search(n)) for n, s in zip(new, spans)])
            yield pa.RecordBatch.from_arrays(list(out.values()), columns).filter(keep)

    return joined.mapInArrow(run, schema)


def op9_substring_dedup(spark, sf_dir):
    return near_passages(table(spark, sf_dir, "documents"))
