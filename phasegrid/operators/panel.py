"""Haplotypes in packed and long form: packing, distances, allele frequencies, nearest neighbours."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import maf

WORD = 64


def pack(alleles: DataFrame) -> DataFrame:
    """(hap_id, words) from (hap_id, site_idx, allele): 64 sites in a word, site 0 in the lowest bit."""
    bit = F.expr(f"shiftleft(cast(allele AS bigint), cast(site_idx % {WORD} AS int))")
    by_word = alleles.groupBy("hap_id", F.expr(f"cast(site_idx div {WORD} AS int)").alias("word")).agg(F.bit_or(bit).alias("bits"))
    packed = by_word.groupBy("hap_id").agg(F.sort_array(F.collect_list(F.struct("word", "bits"))).alias("w"))
    return packed.select("hap_id", F.transform("w", lambda x: x["bits"]).alias("words"))


def unpack(haps: DataFrame, n_sites: int) -> DataFrame:
    """(hap_id, site_idx, allele) from (hap_id, words)."""
    site = F.explode(F.sequence(F.lit(0), F.lit(n_sites - 1)))
    return haps.select("hap_id", "words", site.alias("site_idx")).select("hap_id", "site_idx", F.expr(f"cast(shiftrightunsigned(words[site_idx div {WORD}], site_idx % {WORD}) & 1 AS int)").alias("allele"))


def unpack_words(words: DataFrame, n_sites: int) -> DataFrame:
    """(hap_id, site_idx, allele) from rows (hap_id, word, bits), each on its own."""
    each = words.select("hap_id", "word", "bits", F.explode(F.sequence(F.lit(0), F.lit(WORD - 1))).alias("i"))
    rows = each.select("hap_id", F.expr(f"word * {WORD} + i").alias("site_idx"), F.expr("cast(shiftrightunsigned(bits, i) & 1 AS int)").alias("allele"))
    return rows.where(F.col("site_idx") < n_sites)


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two arrays of words."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y)).cast("long")), F.lit(0).cast("long"), lambda s, x: s + x)


def max_tract(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, tract): the longest run of sites at which allele_a equals allele_b, from rows by site_idx."""
    order = Window.partitionBy(*keys).orderBy("site_idx")
    same = pairs.withColumn("differs", (F.col("allele_a") != F.col("allele_b")).cast("int"))
    runs = same.withColumn("run", F.sum("differs").over(order)).groupBy(*keys, "run").agg(F.sum(1 - F.col("differs")).alias("n"))
    return runs.groupBy(*keys).agg(F.max("n").alias("tract"))


def max_tract_words(a: Column, b: Column, n_sites: int) -> Column:
    """The same from two arrays of words; bits past the last site don't count."""
    site = F.sequence(F.lit(0), F.lit(n_sites - 1))

    def step(s: Column, i: Column) -> Column:
        word = F.floor(i / WORD).cast("int")
        equal = F.getbit(F.get(a, word).bitwiseXOR(F.get(b, word)), i % WORD) == 0
        now = F.when(equal, s["now"] + 1).otherwise(0)
        return F.struct(now.alias("now"), F.greatest(s["most"], now).alias("most"))

    return F.aggregate(site, F.struct(F.lit(0).alias("now"), F.lit(0).alias("most")), step, lambda s: s["most"])


def allele_frequencies(alleles: DataFrame) -> DataFrame:
    return alleles.groupBy("site_idx").agg(F.avg("allele").alias("af"))


def frequent_sites(alleles: DataFrame, low: float, high: float, use_maf: bool = False) -> DataFrame:
    """(site_idx, af) with the (minor) allele frequency inside low..high, both ends included."""
    return within(allele_frequencies(alleles), low, high, use_maf)


def within(af: DataFrame, low: float, high: float, use_maf: bool = False) -> DataFrame:
    """The rows of af(site_idx, af) with it, or the minor one, inside low..high."""
    return af.where((maf(F.col("af")) if use_maf else F.col("af")).between(low, high))


def distances(targets: DataFrame, panel: DataFrame, metric: str = "hamming", n_sites: int | None = None, per: int = 1024) -> DataFrame:
    """(sample_idx, which, hap_id, distance): each target haplotype against the panel's, those of its own sample left out.

    All pairs are what is asked for: both sides are dealt into blocks of about per haplotypes, and each two blocks meet in one task.
    """
    return _met(targets, panel, metric, n_sites, per, per, None)


def _blocks(haps: DataFrame, per: int) -> tuple[DataFrame, int]:
    """(block, ids, words) with about per haplotypes of haps(hap_id, words) in each row; how many blocks."""
    n = max(1, -(-haps.count() // per))
    each = F.sort_array(F.collect_list(F.struct("hap_id", "words")))
    dealt = haps.groupBy(F.pmod(F.xxhash64("hap_id"), F.lit(n)).cast("int").alias("block")).agg(each.alias("x"))
    return dealt.select("block", F.transform("x", lambda h: h["hap_id"]).alias("ids"), F.flatten(F.transform("x", lambda h: h["words"])).alias("words")), n


def _prefix_orders(x: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """After each site m of x (haplotype, site): the haplotypes in order of their alleles read backwards from m, and for each the site from which it equals the one before.

    A site's allele deals the order out stably, so a step is linear in the haplotypes; neighbours in the order have the longest
    equal runs that end at m.
    """
    order, since = np.arange(len(x)), np.zeros(len(x), np.int64)
    for m in range(x.shape[1]):
        allele, orders, starts = x[order, m], [], []
        for side in (0, 1):
            at = np.flatnonzero(allele == side)
            if len(at):
                # The run with the one before of the same allele begins where the last of those between them ends it.
                met = np.maximum.reduceat(since[: at[-1] + 1], np.r_[0, at[:-1] + 1])
                met[0] = m + 1
                orders.append(order[at])
                starts.append(met)
        order, since = np.concatenate(orders), np.concatenate(starts)
        yield m, order, since


def _tract_neighbours(x: np.ndarray, targets: np.ndarray, allowed: np.ndarray, keep: int) -> np.ndarray:
    """(target, haplotype): the longest equal run of each of targets (rows of x) with each haplotype that is among the keep of the longest, ties included; 0 elsewhere.

    allowed (target, haplotype): what may be a neighbour. A haplotype of the keep longest is within keep places in the order at the site where its run ends, so
    a first walk looks that far and bounds the keep-th longest from below; a second walk looks as far as runs reach that bound.
    """
    n, best = len(x), np.zeros((len(targets), len(x)), np.int32)
    least = None
    for _ in range(2):
        for m, order, since in _prefix_orders(x):
            place = np.empty(n, np.int64)
            place[order] = np.arange(n)
            for step in (-1, 1):
                t, at, begun, far = np.arange(len(targets)), place[targets], np.zeros(len(targets), np.int64), 0
                while len(t) and (least is not None or far < keep):
                    at, far = at + step, far + 1
                    inside = (at >= 0) & (at < n)
                    t, at, begun = t[inside], at[inside], begun[inside]
                    begun = np.maximum(begun, since[at + 1] if step < 0 else since[at])
                    run = m + 1 - begun
                    if least is not None:
                        long = (run >= least[t]) & (run > 0)
                        t, at, begun, run = t[long], at[long], begun[long], run[long]
                    best[t, order[at]] = np.maximum(best[t, order[at]], run)
        known = np.where(allowed, best, -1)
        least = np.maximum(0, -np.partition(-known, min(keep, n) - 1, axis=1)[:, min(keep, n) - 1])
    return best


def _all_runs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """(a, b): the longest equal run of each two rows of alleles."""
    at, out = np.arange(1, a.shape[1] + 1), np.empty((len(a), len(b)), np.int64)
    for i, row in enumerate(a):
        out[i] = (at - np.maximum.accumulate(np.where(b != row, at, 0), axis=1)).max(1)
    return out


def _met(targets: DataFrame, panel: DataFrame, metric: str, n_sites: int | None, mine_per: int, per: int, keep: int | None) -> DataFrame:
    mine, _ = _blocks(targets, mine_per)
    theirs, n = _blocks(panel, per)
    met = mine.select(F.col("ids").alias("t"), F.col("words").alias("tw"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("block")).join(theirs, "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                flat = {c: batch.column(c).slice(at, 1).flatten().to_numpy(zero_copy_only=False) for c in ("t", "tw", "ids", "words")}
                t, p = flat["t"], flat["ids"]
                a, b = (flat[c].view(np.uint64).reshape(len(i), -1) for c, i in (("tw", t), ("words", p)))
                own = (t // 2)[:, None] == (p // 2)[None]
                bits = lambda words: np.unpackbits(words.view(np.uint8), axis=1, bitorder="little")[:, :n_sites]
                if metric == "hamming":
                    far = np.stack([np.bitwise_count(b ^ x).sum(1, dtype=np.int64) for x in a])
                elif keep is None:
                    far = n_sites - _all_runs(bits(a), bits(b))
                else:
                    every, first = np.unique(np.r_[p, t], return_index=True)
                    allowed = np.isin(every, p)[None] & ((t // 2)[:, None] != (every // 2)[None])
                    best = _tract_neighbours(bits(np.concatenate([b, a])[first]), np.searchsorted(every, t), allowed, keep)
                    far = n_sites - best[:, np.searchsorted(every, p)].astype(np.int64)
                order = np.lexsort((np.broadcast_to(p, far.shape), far, own), axis=1)[:, :keep]
                i = np.repeat(np.arange(len(t)), order.shape[1])
                j = order.ravel()
                i, j = i[~own[i, j]], j[~own[i, j]]
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip((t[i] // 2, t[i] % 2, p[j], far[i, j]), kinds)], ["sample_idx", "which", "hap_id", "distance"])

    return met.mapInArrow(run, "sample_idx long, which int, hap_id long, distance long")


def near_distances(targets: DataFrame, panel: DataFrame, k: int, metric: str = "hamming", n_sites: int | None = None, per: int | None = None) -> DataFrame:
    """The rows of distances() that nearest() needs for k neighbours, and few others: each target's nearest of each block of the panel.

    Targets are dealt into blocks of about 1,024 haplotypes, the panel into blocks of per; each two blocks meet in one task, which keeps a target's k + 1
    nearest of the panel's block. So what is written is targets x blocks x k rows, and nothing is sent to all tasks. Hamming distances
    are made for all pairs of two blocks; runs are read off prefix orders, in time linear in the haplotypes of both.
    """
    per = per or (1024 if metric == "hamming" else 16384)
    return _met(targets, panel, metric, n_sites, min(per, 1024), per, 2 * ((k + 1) // 2))


def nearest(dist: DataFrame, k: int, n_haps: int) -> DataFrame:
    """(sample_idx, rank, hap_id): for each sample ceil(k / 2) neighbours of its first haplotype and as many others of its second, alternating; ties go to the lesser haplotype.

    k is at most n_haps - 2: a sample's own two are no neighbours.
    """
    half = (min(k, n_haps - 2) + 1) // 2
    order = Window.partitionBy("sample_idx").orderBy("distance", "hap_id")
    first = dist.where("which = 0").withColumn("n", F.row_number().over(order)).where(F.col("n") <= half).select("sample_idx", "hap_id", "n")
    rest = dist.where("which = 1").join(first.select("sample_idx", "hap_id"), ["sample_idx", "hap_id"], "left_anti")
    second = rest.withColumn("n", F.row_number().over(order)).where(F.col("n") <= half).select("sample_idx", "hap_id", "n")
    return first.withColumn("rank", 2 * F.col("n") - 2).unionByName(second.withColumn("rank", 2 * F.col("n") - 1)).select("sample_idx", F.col("rank").cast("int").alias("rank"), "hap_id")


def neighbour_lines(near: DataFrame, samples: DataFrame) -> DataFrame:
    """(sample_id, neighbours): each sample's neighbours as name.hapA or name.hapB, in order."""
    names = samples.select(F.col("sample_idx").alias("of"), F.col("sample_id").alias("name"))
    each = near.join(names, F.expr("hap_id div 2") == F.col("of"), "left")
    label = F.concat(F.coalesce("name", F.concat(F.lit("ref"), F.expr("hap_id div 2").cast("string"))), F.when(F.col("hap_id") % 2 == 0, ".hapA").otherwise(".hapB"))
    lists = each.groupBy("sample_idx").agg(F.sort_array(F.collect_list(F.struct("rank", label.alias("label")))).alias("x"))
    return lists.join(samples, "sample_idx").select("sample_id", F.array_join(F.transform("x", lambda x: x["label"]), " ").alias("neighbours"))
