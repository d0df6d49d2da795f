"""Operator 4: mixing sources to target weights by Efraimidis-Spirakis sampling.

Each document draws u in (0, 1) from a hash of seed and id, and gets the key -ln(u) / weight; the least keys
of a source, up to its budget of words, are a weighted sample without replacement. Whole epochs of a source
come first; the keys choose what is taken once more. The keys' order is cut into bins, OCTAVE for each doubling of the key:
sums by bin give where each bin begins, and only the rows of one bin are sorted together, so a source that holds
a third of all rows is no single task. An exponential key's logarithm has a density of at most 1 / e whatever its
rate, so whatever the weights a bin is expected to hold no more than ln 2 / (e OCTAVE), 0.00025, of its source's rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACES, WORD, fresh, row_hash, stored, table

OCTAVE = 1024
SYMBOLS, ENDS = r"[#*$%&|<>]", r"[.!?。]"


def word_count(text):
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def quality_weight(text, size):
    """Between 0 and 1: less for symbols among the words, for few sentence ends, and the farther the mean word length is from five characters."""
    mean, symbols, ends = F.length(F.translate(text, SPACES, "")) / size, F.regexp_count(text, F.lit(SYMBOLS)) / size, F.regexp_count(text, F.lit(ENDS)) / size
    bare = F.greatest(F.lit(0.0), 0.04 - ends)
    return F.when(size > 0, 1 / (1 + F.abs(mean - 5) / 5 + 10 * symbols + 25 * bare)).otherwise(F.lit(1.0))


def bin_of(key):
    """The bin of a key: bins ascend with keys."""
    return F.floor(OCTAVE * F.log2(key)).cast("int")


def targets(sizes: DataFrame, cap: int = 3) -> DataFrame:
    """(source_key, source_size, target) from sizes(source_key, source, source_size): one row for each source.

    Weights are 1, 2, 3 and so on again, by the source's code points, null last. The level at which the capped shares add up
    to all words is found from running sums over the sources in the order in which they reach their cap.
    """
    named = sizes.withColumn("n", F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")))
    named = named.withColumn("w", (1 + (F.col("n") - 1) % 3).cast("long")).withColumn("r", cap * F.col("source_size") / F.col("w"))
    by = Window.orderBy("r", "n")
    whole = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    named = named.select(
        "*",
        F.sum("source_size").over(whole).alias("total"),
        F.coalesce(F.sum(cap * F.col("source_size")).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("capped"),
        F.sum("w").over(by.rowsBetween(0, Window.unboundedFollowing)).alias("open"),
    )
    named = named.withColumn("level", (F.col("total") - F.col("capped")) / F.col("open"))
    named = named.withColumn("level", F.min_by(F.when(F.col("level") <= F.col("r"), F.col("level")), F.when(F.col("level") <= F.col("r"), F.struct("r", "n"))).over(whole))
    return named.select("source_key", "source_size", F.least((cap * F.col("source_size")).cast("double"), F.col("level") * F.col("w")).alias("target"))


def mix(docs: DataFrame, seed: str = "mix", cap: int = 3, whole: bool = False, weight=quality_weight) -> DataFrame:
    """(doc_id, size, source_size, target, taken, copies, row_hash) for every row of docs(doc_id, text, source).

    taken: words taken from the row: its size times the source's whole epochs, and once more if its key is
    among the least; the row at the budget's end gives the words that are missing, or with whole=True
    all or none of them, whichever is nearer. copies: how often the row is taken whole. Null texts have size 0; a null source is a source of its own;
    null ids draw by their text; repeated rows draw the same key and are counted one after the other. A text of any length is one
    document; other columns are not read; an empty table gives no rows.
    """
    size = word_count(F.col("text"))
    text_hash = F.xxhash64("text")
    u = (F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), text_hash.cast("string"))).cast("binary")), 1, 13), 16, 10).cast("double") + 0.5) / float(16**13)
    rows = docs.select("doc_id", "source", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")).alias("source_key"), "text", size.alias("size"))
    rows = rows.select("doc_id", "source", "source_key", "size", (-F.ln(u) / weight(F.col("text"), F.col("size"))).alias("key"), text_hash.alias("row_hash"))
    rows = stored(rows.withColumn("bin", bin_of(F.col("key"))), "mix")
    goal = targets(rows.groupBy("source_key").agg(F.first("source").alias("source"), F.sum("size").alias("source_size")), cap)
    bins = rows.groupBy("source_key", "bin").agg(F.sum("size").alias("bin_size"))
    before = F.coalesce(F.sum("bin_size").over(Window.partitionBy("source_key").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bins = bins.join(goal, "source_key").select("source_key", "bin", "source_size", "target", before.alias("bin_before"))
    run = Window.partitionBy("source_key", "bin").orderBy("key", "doc_id", "size", "row_hash").rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.withColumn("upto", F.sum("size").over(run)).join(bins, ["source_key", "bin"])
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    left = F.round(F.col("target")).cast("long") - epochs * F.col("source_size") - (F.col("bin_before") + F.col("upto") - F.col("size"))
    more = F.when(2 * left >= F.col("size"), F.col("size")).otherwise(F.lit(0)) if whole else F.greatest(F.lit(0), F.least(left, F.col("size")))
    copies = epochs + ((more == F.col("size")) & (F.col("size") > 0)).cast("long")
    return placed.select("doc_id", "size", "source_size", "target", (epochs * F.col("size") + more).cast("long").alias("taken"), copies.alias("copies"), "row_hash")


def mixed(docs: DataFrame, seed: str = "mix", cap: int = 3) -> DataFrame:
    """The mix itself: each row of docs as often as mix() takes it, whole documents only.

    Rows that share id and text also share what is taken of them, as evenly as it goes.
    """
    columns = docs.columns
    h, n = fresh("h", columns), fresh("n", columns)
    total = mix(docs, seed, cap, whole=True).groupBy(F.col("doc_id").alias("of"), "row_hash").agg(F.sum("copies").alias("copies"), F.count("*").alias("rows"))
    docs = docs.withColumn(h, F.xxhash64("text"))
    docs = docs.withColumn(n, F.row_number().over(Window.partitionBy("doc_id", h).orderBy(row_hash(docs))))
    joined = docs.join(total, docs["doc_id"].eqNullSafe(total["of"]) & (docs[h] == total["row_hash"]))
    times = F.floor(total["copies"] / total["rows"]) + (docs[n] <= total["copies"] % total["rows"]).cast("long")
    return joined.select(*[docs[c] for c in columns], F.explode(F.array_repeat(F.lit(0), times.cast("int"))).alias(n)).drop(n)


def op4_mix(spark, sf_dir):
    return mix(table(spark, sf_dir, "documents")).drop("row_hash", "copies")


_SPACES_SQL = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
OP4_SQL = rf"""
WITH d AS (
  SELECT doc_id, source, coalesce('s' || source, 'n') AS source_key, text,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), k AS (
  SELECT doc_id, source, source_key, size,
         -ln((('0x' || substr(md5('mix:' || doc_id), 1, 13))::UBIGINT::DOUBLE + 0.5) / 4503599627370496.0)
         / CASE WHEN size > 0 THEN 1 / (1 + abs(length(translate(text, {_SPACES_SQL}, ''))::DOUBLE / size - 5) / 5
             + 10 * (len(regexp_extract_all(text, '{SYMBOLS}'))::DOUBLE / size)
             + 25 * greatest(0.0::DOUBLE, 0.04::DOUBLE - len(regexp_extract_all(text, '{ENDS}'))::DOUBLE / size)) ELSE 1.0 END AS key
  FROM d
), s AS (
  SELECT *, row_number() OVER (ORDER BY source IS NULL, encode(source)) AS n
  FROM (SELECT source_key, any_value(source) AS source, sum(size)::BIGINT AS source_size FROM k GROUP BY 1)
), r AS (
  SELECT *, 1 + (n - 1) % 3 AS w, 3 * source_size::DOUBLE / (1 + (n - 1) % 3) AS r FROM s
), l AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (ORDER BY r, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
         / (sum(w) OVER (ORDER BY r, n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level FROM r
), t AS (
  SELECT source_key, source_size,
         least(3.0::DOUBLE * source_size, (SELECT level FROM l WHERE level <= r ORDER BY r, n LIMIT 1) * w)::DOUBLE AS target FROM l
), o AS (
  SELECT k.doc_id, k.size, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END::BIGINT AS epochs,
         sum(k.size) OVER (PARTITION BY source_key ORDER BY key, doc_id ROWS UNBOUNDED PRECEDING)::BIGINT - k.size AS before
  FROM k JOIN t USING (source_key)
)
SELECT doc_id, size, source_size, target,
       (epochs * size + greatest(0, least(round(target)::BIGINT - epochs * source_size - before, size)))::BIGINT AS taken FROM o
"""
