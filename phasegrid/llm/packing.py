"""Operator 10: packing documents into sequences by cutting-stock column generation.

Documents are cut into pieces of `length` tokens and a remainder. Piece lengths, rounded up to `unit` tokens,
make a histogram of at most length / unit classes, all that the driver sees. A linear program over patterns
(how many pieces of each class share a sequence) is solved by column generation: dynamic programming over
the knapsack prices new patterns at the current duals until none saves anything. Pattern counts are rounded
down and the rest is filled by patterns of the largest pieces first. Spark ranks the pieces of each class,
and a rank's place in the patterns' running counts is its sequence.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import rows, stored, table
from .tokens import encoder

PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids binary"


def pieces(docs: DataFrame, length: int = 1024, end_id: int = 0, tokenizer: str | None = None, with_ids: bool = False, room: int | None = None) -> DataFrame:
    """The pieces of docs(doc_id, text): doc_id, start, length, ids_crc32, doc_tokens, and ids (32-bit) if asked for.

    end_id ends each document, so an empty or null text is one piece of one token. Repeated rows are
    documents of their own.
    """
    vocabulary, end = tokenizer, struct.pack("<I", end_id)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary, room=room)
        kinds = [pa.int64()] * 5 + [pa.binary()]
        for doc_ids, texts in rows(batches, 64):
            out = []
            for doc_id, ids in zip(doc_ids, encode.many(texts)):
                ids += end
                n = len(ids) // 4
                for at in range(0, n, length):
                    part = ids[4 * at : 4 * (at + length)]
                    out.append((doc_id, at, len(part) // 4, zlib.crc32(part), n, part if with_ids else None))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], [c.split()[0] for c in PIECE.split(", ")])

    return docs.select("doc_id", "text").mapInArrow(cut, PIECE)


def _price(duals: np.ndarray, widths: np.ndarray, room: int) -> np.ndarray:
    """The pattern of the greatest total dual that fits, by dynamic programming over the room."""
    best, last = np.zeros(room + 1), np.full(room + 1, -1)
    for c in range(1, room + 1):
        best[c] = best[c - 1]
        fit = np.searchsorted(widths, c, "right")
        if fit:
            gain = best[c - widths[:fit]] + duals[:fit]
            i = int(gain.argmax())
            if gain[i] > best[c] + 1e-12:
                best[c], last[c] = gain[i], i
    pattern, c = np.zeros(len(widths)), room
    while c > 0:
        if (i := last[c]) < 0:
            c -= 1
        else:
            pattern[i] += 1
            c -= widths[i]
    return pattern


def cutting_stock(demand: dict[int, int], room: int, close: float = 1e-3, most: int = 4000) -> list[tuple[dict[int, int], int]]:
    """Patterns ({width: count}, times) that hold demand[width] pieces of each width, few in total.

    The last use of a width may have more places than pieces are left; such places stay free.
    """
    left = {w: n for w, n in demand.items() if n > 0}
    widths = np.array(sorted(left), int)
    if not len(widths):
        return []
    need = np.array([left[w] for w in widths], float)
    patterns = np.diag(room // widths).astype(float)  # a column for each pattern of the basis
    inverse = np.diag(1 / np.diag(patterns))
    # Needs are spread a little, or steps of length zero make the search go round in circles.
    spread = need * (1 + 1e-4 * np.arange(1, len(need) + 1) / len(need)) + 1e-4 * np.arange(1, len(need) + 1) / len(need)
    for step in range(most):
        duals = inverse.sum(0)
        new = _price(duals, widths, room)
        if duals @ new <= 1 + close:
            break
        if step % 500 == 499:
            inverse = np.linalg.inv(patterns)
        times, way = inverse @ spread, inverse @ new
        ratio = np.where(way > 1e-9, np.maximum(times, 0) / np.where(way > 1e-9, way, 1), np.inf)
        out = int(ratio.argmin())
        patterns[:, out] = new
        row = inverse[out] / way[out]
        inverse = inverse - np.outer(way, row)
        inverse[out] = row
    times = np.floor(np.maximum(np.linalg.solve(patterns, need), 0) + 1e-6).astype(int)
    made = []
    rest = need.astype(int)
    for p, n in zip(patterns.T.astype(int), times):
        fits = min([n, *(rest[i] // p[i] for i in np.flatnonzero(p))])
        if fits > 0:
            made.append(({int(widths[i]): int(p[i]) for i in np.flatnonzero(p)}, int(fits)))
            rest = rest - fits * p
    while rest.any():
        free, pattern = room, np.zeros(len(widths), int)
        for i in np.flatnonzero(rest)[::-1]:
            pattern[i] = min(rest[i], free // widths[i])
            free -= pattern[i] * widths[i]
        used = np.flatnonzero(pattern)
        n = int((rest[used] // pattern[used]).min())
        made.append(({int(widths[i]): int(pattern[i]) for i in used}, n))
        rest = rest - n * pattern
    return made


def pack(parts: DataFrame, length: int = 1024, unit: int = 8) -> DataFrame:
    """parts(doc_id, start, length, ids_crc32, doc_tokens) with sequence_id and offset; parts should be stored.

    Pieces of a class are ranked by a hash bucket, then by id and start, so no class is ranked by one task.
    A null doc_id ranks first. Offsets have no gaps; a sequence's pieces go by size, id and start.
    """
    spark = parts.sparkSession
    parts = parts.withColumn("width", F.ceil(F.col("length") / unit).cast("int"))
    demand = {r["width"]: r["count"] for r in parts.groupBy("width").count().collect()}
    buckets = max(64, sum(demand.values()) // 1_000_000)
    room, first, plan, given = length // unit, 0, [], dict.fromkeys(demand, 0)
    for pattern, times in cutting_stock(demand, room):
        for width, each in pattern.items():
            plan.append((width, given[width], given[width] + each * times, each, first))
            given[width] += each * times
        first += times
    plan = spark.createDataFrame(plan, "width int, first_rank long, end_rank long, each int, first_sequence long")
    parts = parts.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start"), F.lit(buckets)).cast("int"))
    sizes = parts.groupBy("width", "bucket").count()
    before = F.sum("count").over(Window.partitionBy("width").orderBy("bucket")) - F.col("count")
    inside = Window.partitionBy("width", "bucket").orderBy("doc_id", "start", "ids_crc32", "doc_tokens")
    ranked = parts.withColumn("n", F.row_number().over(inside)).join(sizes.select("width", "bucket", before.alias("bucket_rank")), ["width", "bucket"])
    ranked = ranked.withColumn("rank", F.col("bucket_rank") + F.col("n") - 1)
    # The plan has at most (length / unit) ** 2 rows, whatever the input.
    placed = ranked.join(F.broadcast(plan), (ranked["width"] == plan["width"]) & (F.col("rank") >= F.col("first_rank")) & (F.col("rank") < F.col("end_rank")))
    placed = placed.withColumn("sequence_id", F.col("first_sequence") + F.floor((F.col("rank") - F.col("first_rank")) / F.col("each")))
    order = Window.partitionBy("sequence_id").orderBy(F.desc("length"), "doc_id", "start", "ids_crc32")
    placed = placed.withColumn("offset", F.sum("length").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("length"))
    kept = [c for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids") if c in parts.columns]
    return placed.select(*kept, "sequence_id", "offset")


def sequences(packed: DataFrame, length: int = 1024, pad_id: int = 0) -> DataFrame:
    """(sequence_id, input_ids, n_tokens): the padded ids of each sequence, from pieces packed with ids."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for numbers, parts in rows(batches):
            ids = [np.frombuffer(b"".join(p), "<u4") for p in parts]
            full = [np.pad(x, (0, length - len(x)), constant_values=pad_id).astype("i4") for x in ids]
            yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), pa.array(full, pa.list_(pa.int32())), pa.array(list(map(len, ids)), pa.int32())], ["sequence_id", "input_ids", "n_tokens"])

    grouped = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("x"))
    return grouped.select("sequence_id", F.transform("x", lambda p: p["ids"]).alias("parts")).mapInArrow(join, "sequence_id long, input_ids array<int>, n_tokens int")


def pack_documents(docs: DataFrame, length: int = 1024, room: int | None = None) -> DataFrame:
    """Every piece of docs(doc_id, text), placed. Texts are read and encoded once: the pieces are stored.

    Null and empty texts are one token, null ids documents like any other, repeated rows documents of their own. Other columns are not
    read. An empty table gives no rows. A text of any length is cut; documents that tie in size are ranked by hash, then by id. room: bytes of each generation of
    a worker's token cache, which the result doesn't depend on.
    """
    return pack(stored(pieces(docs, length, room=room).drop("ids"), "pieces"), length)


def op10_pack(spark, sf_dir):
    return pack_documents(table(spark, sf_dir, "documents"))
