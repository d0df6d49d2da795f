"""Likelihoods as codes of a small codebook, and haplotypes around medoids."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..rng import uniform
from .panel import hamming, pack

#: The first four centres (rr, het) of every codebook.
SEEDS = ((0.0, 1.0), (0.0, 0.0), (1.0, 0.0), (1 / 3, 1 / 3))


def first_codebook(spark: SparkSession, size: int = 16, seed: int = 1) -> DataFrame:
    """(code, rr, het): the fixed centres and further ones at random in the triangle rr + het <= 1."""
    if not 4 <= size <= 256:
        raise ValueError("a codebook has 4 to 256 codes")
    more = spark.range(4, size).select(F.col("id").cast("int").alias("code"), uniform(seed, "rr", F.col("id")).alias("u"), uniform(seed, "het", F.col("id")).alias("v"))
    flip = F.col("u") + F.col("v") > 1
    more = more.select("code", F.when(flip, 1 - F.col("u")).otherwise(F.col("u")).alias("rr"), F.when(flip, 1 - F.col("v")).otherwise(F.col("v")).alias("het"))
    return spark.createDataFrame([(i, *s) for i, s in enumerate(SEEDS)], "code int, rr double, het double").unionByName(more)


def encode(gl: DataFrame, codebook: DataFrame) -> DataFrame:
    """gl with code and d2, its nearest centre (the least code on ties) and the squared distance.

    A codebook has at most 256 rows: it goes to the tasks as one array, and no row of gl is copied.
    """
    book = codebook.agg(F.sort_array(F.collect_list(F.struct("code", "rr", "het"))).alias("book"))
    d2 = lambda c: (F.col("rr") - c["rr"]) * (F.col("rr") - c["rr"]) + (F.col("het") - c["het"]) * (F.col("het") - c["het"])
    best = F.array_min(F.transform("book", lambda c: F.struct(d2(c).alias("d2"), c["code"].alias("code"))))
    return gl.join(F.broadcast(book)).withColumn("best", best).select(*gl.columns, F.col("best.code").alias("code"), F.col("best.d2").alias("d2"))


def variance(encoded: DataFrame) -> DataFrame:
    return encoded.agg(F.sum("d2").alias("variance"))


def update_codebook(encoded: DataFrame, codebook: DataFrame, seed: int = 1) -> DataFrame:
    """(code, rr, het): the mean of each code's points; a code without points gets one of the points, by a hash."""
    means = encoded.groupBy("code").agg(F.avg("rr").alias("mr"), F.avg("het").alias("mh"))
    some = encoded.select(uniform(seed, F.col("sample_idx"), F.col("site_idx")).alias("u"), "rr", "het").agg(F.min_by(F.struct("rr", "het"), "u").alias("p"))
    joined = codebook.select("code").join(means, "code", "left").join(F.broadcast(some))
    return joined.select("code", F.coalesce("mr", F.col("p.rr")).alias("rr"), F.coalesce("mh", F.col("p.het")).alias("het"))


def fit_codebook(gl: DataFrame, size: int = 16, seed: int = 1, close: float = 0.01, most: int = 1000) -> DataFrame:
    """Lloyd's steps until the variance changes by at most 1 %."""
    book, before = first_codebook(gl.sparkSession, size, seed), None
    for _ in range(most):
        coded = encode(gl, book)
        now = variance(coded).first()[0] or 0.0
        if before is not None and abs(before - now) <= close * before:
            return book
        before = now
        rows = [tuple(r) for r in update_codebook(coded, book, seed).select("code", "rr", "het").collect()]
        book = gl.sparkSession.createDataFrame(rows, "code int, rr double, het double")
    raise RuntimeError("the codebook doesn't settle")


def pack_codes(encoded: DataFrame, bits: int = 4) -> DataFrame:
    """(sample_idx, chunk, word): 32 / bits codes in a word, the first in the highest bits; missing ones are 0."""
    per = 32 // bits
    shift = F.expr(f"cast({32 - bits} - {bits} * (site_idx % {per}) AS int)")
    return encoded.groupBy("sample_idx", F.expr(f"site_idx div {per}").alias("chunk")).agg(F.sum(F.expr("cast(code AS bigint)") * F.pow(F.lit(2.0), shift).cast("long")).alias("word"))


def unpack_codes(words: DataFrame, codebook: DataFrame, bits: int = 4) -> DataFrame:
    """(sample_idx, site_idx, rr, het, aa): the codes' centres; the third part is what is missing to 1."""
    per = 32 // bits
    each = words.select("sample_idx", "chunk", "word", F.explode(F.sequence(F.lit(0), F.lit(per - 1))).alias("i"))
    code = F.expr(f"cast(shiftrightunsigned(word, {32 - bits} - {bits} * i) & {(1 << bits) - 1} AS int)")
    each = each.select("sample_idx", (F.col("chunk") * per + F.col("i")).alias("site_idx"), code.alias("code"))
    return each.join(F.broadcast(codebook), "code").select("sample_idx", "site_idx", "rr", "het", F.greatest(1 - F.col("rr") - F.col("het"), F.lit(0.0)).alias("aa"))


def nearest_medoid(haps: DataFrame, medoids: DataFrame) -> DataFrame:
    """(hap_id, medoid, distance) of haps(hap_id, words): the nearest of medoids(medoid, rank), the first on ties. A haplotype meets the medoids only."""
    words = medoids.join(haps.select(F.col("hap_id").alias("medoid"), "words"), "medoid")
    # As many words as there are medoids, a run's option.
    listed = words.agg(F.sort_array(F.collect_list(F.struct("rank", "medoid", "words"))).alias("book"))
    best = F.array_min(F.transform("book", lambda m: F.struct(hamming(F.col("words"), m["words"]).alias("distance"), m["rank"].alias("rank"), m["medoid"].alias("medoid"))))
    return haps.join(F.broadcast(listed)).select("hap_id", best.alias("b")).select("hap_id", F.col("b.medoid").alias("medoid"), F.col("b.distance").alias("distance"))


def medoid_loss(assigned: DataFrame, power: int) -> DataFrame:
    return assigned.agg(F.sum(F.pow(F.col("distance").cast("double"), F.lit(power))).alias("loss"))


def better_medoids(alleles: DataFrame, assigned: DataFrame) -> DataFrame:
    """(medoid, best, loss): inside each cluster the member with the least sum of distances to the others, the least id on ties.

    A member differs at a site from as many as have the other allele there, so a cluster's counts of each site tell every member's
    loss: time and rows are linear in alleles(hap_id, site_idx, allele), and no two haplotypes meet. Clusters, a row a haplotype, are sent to all
    tasks; cells and counts are joined by shuffle, whatever Spark makes of their number.
    """
    of = alleles.join(F.broadcast(assigned.select("hap_id", "medoid")), "hap_id")
    counts = of.groupBy("medoid", "site_idx").agg(F.sum("allele").alias("ones"), F.count("*").alias("n"))
    others = F.when(F.col("allele") == 1, F.col("n") - F.col("ones")).otherwise(F.col("ones"))
    loss = of.join(counts.hint("merge"), ["medoid", "site_idx"]).groupBy("medoid", F.col("hap_id").alias("best")).agg(F.sum(others).cast("double").alias("loss"))
    return loss.groupBy("medoid").agg(F.min(F.struct("loss", "best")).alias("b")).select("medoid", F.col("b.best").alias("best"), F.col("b.loss").alias("loss"))


def best_swap(haps: DataFrame, medoids: DataFrame, power: int = 2, per: int = 1024) -> DataFrame:
    """(medoid, candidate, loss): for each medoid the other haplotype that would make the whole loss least in its place.

    What a haplotype is left with if a medoid goes is the nearest one, or the second nearest if the nearest was that. Blocks of candidates meet
    blocks of haplotypes in tasks, which add up losses: pairs are compared, as the search asks, but none is a row.
    """
    ids = [r.medoid for r in medoids.orderBy("rank").collect()]
    words = medoids.join(haps.select(F.col("hap_id").alias("medoid"), "words"), "medoid").agg(F.sort_array(F.collect_list(F.struct("rank", "words"))).alias("book"))
    far = haps.join(F.broadcast(words)).select("hap_id", "words", F.transform("book", lambda m: hamming(F.col("words"), m["words"])).alias("far"))
    n = max(1, -(-haps.count() // per))
    each = F.sort_array(F.collect_list(F.struct("hap_id", "words", "far")))
    dealt = far.groupBy(F.pmod(F.xxhash64("hap_id"), F.lit(n)).cast("int").alias("block")).agg(each.alias("x"))
    part = lambda name: F.transform("x", lambda h: h[name])
    theirs = dealt.select("block", F.flatten(part("words")).alias("words"), F.flatten(part("far")).alias("far"))
    mine = dealt.select(part("hap_id").alias("ids"), F.flatten(part("words")).alias("tw"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("block"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                flat = {c: batch.column(c).slice(at, 1).flatten().to_numpy(zero_copy_only=False) for c in ("ids", "tw", "words", "far")}
                d = flat["far"].reshape(-1, len(ids)).astype(float)
                a, b = flat["tw"].view(np.uint64).reshape(len(flat["ids"]), -1), flat["words"].view(np.uint64).reshape(len(d), -1)
                left = np.stack([np.delete(d, i, 1).min(1, initial=np.inf) for i in range(len(ids))], 1)
                loss = np.stack([(np.minimum(np.bitwise_count(b ^ x).sum(1, dtype=np.int64)[:, None], left) ** power).sum(0) for x in a])
                columns = (np.tile(ids, len(a)), np.repeat(flat["ids"], len(ids)), loss.ravel())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.float64()))], ["medoid", "candidate", "loss"])

    tried = mine.join(theirs, "block").mapInArrow(run, "medoid long, candidate long, loss double").groupBy("medoid", "candidate").agg(F.sum("loss").alias("loss"))
    return tried.groupBy("medoid").agg(F.min(F.struct("loss", "candidate")).alias("b")).select("medoid", F.col("b.candidate").alias("candidate"), F.col("b.loss").alias("loss"))


def kmedoids(alleles: DataFrame, k: int, seed: int = 1, inside: bool = False, most: int = 100) -> DataFrame:
    """(hap_id, medoid, distance): clusters of alleles(hap_id, site_idx, allele), which should be stored, around k medoids.

    From k haplotypes chosen by hash, medoids move to better members of their cluster (inside) or to any better haplotype, one at a time,
    while the loss falls. Only the medoids' ids pass through the driver; no table of pairs is made.
    """
    spark, power, haps = alleles.sparkSession, 1 if inside else 2, pack(alleles).checkpoint()
    ids = [r[0] for r in haps.orderBy(uniform(seed, "medoid", F.col("hap_id")), "hap_id").select("hap_id").limit(k).collect()]
    table = lambda m: spark.createDataFrame(list(zip(m, range(len(m)))), "medoid long, rank int")
    loss = medoid_loss(nearest_medoid(haps, table(ids)), power).first()[0]
    for _ in range(most):
        moves = better_medoids(alleles, nearest_medoid(haps, table(ids))) if inside else best_swap(haps, table(ids), power).withColumnRenamed("candidate", "best")
        found = [r for r in moves.collect() if r.best not in ids]
        if inside:
            to = {r.medoid: r.best for r in found}
            new = [to.get(m, m) for m in ids]
        else:
            top = min(found, key=lambda r: (r.loss, r.best), default=None)
            new = [top.best if top and m == top.medoid else m for m in ids]
        now = medoid_loss(nearest_medoid(haps, table(new)), power).first()[0]
        if not now < loss:
            break
        ids, loss = new, now
    return nearest_medoid(haps, table(ids))


def cluster_haps(assigned: DataFrame, hap_id: Column | str = "hap_id") -> DataFrame:
    """(sample_idx, haps): for each sample the haplotypes in either of its own two's clusters, without its own."""
    own = assigned.select(F.expr("hap_id div 2").alias("sample_idx"), "medoid").distinct()
    got = own.join(assigned.select("hap_id", "medoid"), "medoid").where("hap_id div 2 <> sample_idx")
    return got.groupBy("sample_idx").agg(F.sort_array(F.collect_set("hap_id")).alias("haps"))
