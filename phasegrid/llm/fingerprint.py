"""Operator 8: document fingerprints by SimHash, with permuted block tables to search them.

A text's terms are its lower-cased words and pairs of neighbours; a term's weight is 1 + log of its count. Each term's
64-bit hash votes for its set bits and against the others with that weight; a fingerprint has the bits with a
positive sum. To search, the 64 bits are split into blocks; a table for each choice of blocks holds the
fingerprints by those blocks' bits. With radius + keep blocks, of which `keep` make a table's key, any two
fingerprints within the radius agree in some table's key, so the search is exact.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from itertools import combinations, pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import partitions, rows, stored, table

BITS = 64


def fingerprint(text: str | None) -> int:
    """The signed 64-bit fingerprint of a whole text; 0 without words."""
    words = (text or "").lower().encode("utf-8", "surrogatepass").split()
    if not words:
        return 0
    terms = Counter(words)
    terms.update(map(b" ".join, pairwise(words)))
    digest = xxhash.xxh3_64_intdigest
    hashes = np.fromiter(map(digest, terms), np.uint64, len(terms))
    weights = 1 + np.log(np.fromiter(terms.values(), np.float64, len(terms)))
    votes = np.zeros(BITS)
    for at in range(0, len(hashes), 1 << 14):
        bits = np.unpackbits(hashes[at : at + (1 << 14)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        votes += weights[at : at + (1 << 14)] @ bits.astype(np.float64)
    return int(np.packbits(2 * votes > weights.sum()).view(">i8")[0])


def hexed(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def likeness(a: Column, b: Column) -> Column:
    return 1 - F.bit_count(a.bitwiseXOR(b)) / BITS


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) for every row of docs(doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in rows(batches):
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(list(map(fingerprint, texts)), pa.int64())], ["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fp long")


def within(entries: DataFrame, queries: DataFrame, radius: int = 3, keep: int = 2) -> DataFrame:
    """(query, fp, distance): for each query fingerprint, the distinct entries that differ in at most radius bits.

    entries(fp), queries(fp); nulls and repeated values count once. Rows are exact and whole: the tables'
    candidates are only joined on a block key, of (64 / blocks) * keep bits, never all with all.
    """
    blocks = radius + keep
    ends = [round(i * BITS / blocks) for i in range(blocks + 1)]
    masks = [sum(((1 << (ends[b + 1] - ends[b])) - 1) << ends[b] for b in chosen) for chosen in combinations(range(blocks), keep)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]

    def tables(df: DataFrame, name: str) -> DataFrame:
        keys = F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in signed])
        return df.select("fp").where("fp IS NOT NULL").distinct().select(F.col("fp").alias(name), F.posexplode(keys).alias("permutation", "key"))

    pairs = tables(queries, "query").join(tables(entries, "fp"), ["permutation", "key"])
    pairs = pairs.select("query", "fp", F.bit_count(F.col("query").bitwiseXOR(F.col("fp"))).alias("distance")).where(F.col("distance") <= radius)
    return pairs.distinct()


def edited(text: str, following: str) -> str:
    """text with its last half replaced by the beginning of the following text, as long as that half or all of it."""
    n = len(text) // 2
    return text[: len(text) - n] + following[:n]


OUT = "doc_id long, n_chars long, edited_sha256 string, fp long, edited_fp long, next_fp long"


def with_next(docs: DataFrame) -> DataFrame:
    """For every row of docs(doc_id, text): its fingerprint, its edited text's, the next document's.

    The next document is the one after it by (doc_id, text), null first; after the last comes the first. Null texts are empty.
    Rows are dealt out to ranges of identifiers. The rows with a range's least identifier also go to the range before it,
    marked as ahead, so each task finds its last row's successor; only range numbers and their least identifiers reach the driver.
    Repeated rows are documents of their own, texts of any length are compared whole, other columns are not read, and an empty table
    gives no rows.
    """
    spark = docs.sparkSession
    n = partitions(spark)
    docs = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    ids = docs.select("doc_id")
    ends = ids.where("doc_id IS NOT NULL").agg(F.percentile_approx("doc_id", F.array(*[F.lit(i / n) for i in range(1, n)]), F.lit(20 * n))).first()[0] if n > 1 else None
    ends = sorted(set(ends or []))
    below = F.size(F.filter(F.array(*[F.lit(e).cast("long") for e in ends]), lambda e: e < F.col("doc_id"))) if ends else F.lit(0)
    bucket = F.when(F.col("doc_id").isNull(), F.lit(0)).otherwise(below)
    heads = sorted((r["bucket"], r["least"]) for r in ids.groupBy(bucket.alias("bucket")).agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("a"), "doc_id")).alias("x")).select("bucket", F.col("x.doc_id").alias("least")).collect())
    before = {least: heads[i - 1][0] for i, (_, least) in enumerate(heads)}
    known = [F.lit(v) for least, to in before.items() if least is not None for v in (least, to)]
    lead = F.try_element_at(F.create_map(*known), F.col("doc_id")) if known else F.lit(None).cast("int")
    if None in before:
        lead = F.when(F.col("doc_id").isNull(), F.lit(before[None])).otherwise(lead)
    both = F.array_compact(F.array(F.struct(bucket.alias("bucket"), F.lit(False).alias("ahead")), F.when(lead.isNotNull(), F.struct(lead.alias("bucket"), F.lit(True).alias("ahead")))))
    dealt = docs.select("doc_id", "text", F.explode(both).alias("at")).select("doc_id", "text", "at.*")
    dealt = dealt.repartitionById(n, F.col("bucket")).sortWithinPartitions("bucket", "ahead", "doc_id", "text").select("doc_id", "text", "bucket", "ahead")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, out = None, []  # last: a row of whose successor we don't know yet
        for doc_ids, texts, buckets, aheads in rows(batches, 128):
            for doc_id, text, at, is_ahead in zip(doc_ids, texts, buckets, aheads):
                mine = fingerprint(text)
                if last and last[2] == at:
                    other = edited(last[1], text)
                    sha = hashlib.sha256(other.encode("utf-8", "surrogatepass")).hexdigest()
                    out.append((last[0], len(last[1]), sha, last[3], fingerprint(other), mine))
                last = None if is_ahead else (doc_id, text, at, mine)
            if out:
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], [c.split()[0] for c in OUT.split(", ")])
                out = []

    return dealt.mapInArrow(run, OUT)


def op8_fingerprint(spark, sf_dir):
    """The contract's columns, and n_near for documents whose id is divisible by 50: the other fingerprints in at most 3 differing bits."""
    got = stored(with_next(table(spark, sf_dir, "documents")), "fingerprints")
    asked = got.where("doc_id % 50 = 0").select("fp")
    near = within(got.select("fp"), asked).where("distance > 0").groupBy(F.col("query").alias("of")).agg(F.count("*").alias("n"))
    n_near = F.when(F.col("doc_id") % 50 == 0, F.coalesce("n", F.lit(0))).alias("n_near")
    return got.join(near, F.col("fp") == F.col("of"), "left").select(
        "doc_id", "n_chars", "edited_sha256", hexed(F.col("fp")).alias("fingerprint"), hexed(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"), likeness(F.col("fp"), F.col("next_fp")).alias("near_next"), n_near,
    )
