"""Draws of parent haplotypes and decisions about proposals, with counter-based random numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..rng import uniform


def any_other_hap(sample: Column, n_haps: int, u: Column) -> Column:
    """A haplotype that isn't the sample's own, each as likely."""
    k = F.floor(u * (n_haps - 2))
    return k + F.when(k >= 2 * sample, 2).otherwise(0)


def reference_hap(n_samples: int, n_haps: int, u: Column) -> Column:
    return F.lit(2 * n_samples) + F.floor(u * (n_haps - 2 * n_samples))


def listed_hap(haps: Column, u: Column) -> Column:
    """One of an array, each as likely; null for an empty one."""
    return F.try_element_at(haps, (F.floor(u * F.size(haps)) + 1).cast("int"))


def weighted_hap(weights: DataFrame, u: Column) -> DataFrame:
    """(sample_idx, hap_id): of each sample's weights(sample_idx, hap_id, w) the first whose running sum exceeds u of all."""
    w = Window.partitionBy("sample_idx")
    run = weights.withColumn("run", F.sum("w").over(w.orderBy("hap_id"))).withColumn("total", F.sum("w").over(w)).withColumn("u", u)
    return run.where(F.col("run") > F.col("u") * F.col("total")).groupBy("sample_idx").agg(F.min("hap_id").alias("hap_id"))


def accept(now: Column, proposed: Column, penalty: float, u: Column) -> Column:
    """Metropolis: better or equal always, worse with chance exp(difference times penalty)."""
    return (proposed >= now) | (u < F.exp((proposed - now) * penalty))


def first_haps(gl: DataFrame, u_ref: Column, u_het: Column, u_phase: Column) -> DataFrame:
    """(sample_idx, site_idx, a, b): alleles drawn from the likelihoods alone, heterozygotes in random phase."""
    het = u_het < F.col("het") / (F.col("het") + F.col("aa"))
    none = F.col("het") + F.col("aa") == 0
    a = F.when((u_ref < F.col("rr")) | none, 0).when(het, F.when(u_phase < 0.5, 1).otherwise(0)).otherwise(1)
    b = F.when((u_ref < F.col("rr")) | none, 0).when(het, F.when(u_phase < 0.5, 0).otherwise(1)).otherwise(1)
    return gl.select("sample_idx", "site_idx", a.alias("a"), b.alias("b"))


def update_graph(graph: DataFrame, proposals: DataFrame, n_samples: int) -> DataFrame:
    """graph(sample_idx, col, num, den) with the proposals (sample_idx, hap_id, accepted, penalty) added.

    col is a sample; what is accepted counts in num, everything in den, and for columns that aren't reference samples also the other way round.
    """
    col = F.expr("hap_id div 2")
    seen = proposals.select("sample_idx", col.alias("col"), F.col("penalty").alias("den"), F.when(F.col("accepted"), F.col("penalty")).otherwise(0.0).alias("num"))
    back = seen.where(F.col("col") < n_samples).select(F.col("col").alias("sample_idx"), F.col("sample_idx").cast("long").alias("col"), "den", "num")
    both = seen.unionByName(back).unionByName(graph.select("sample_idx", "col", "den", "num"))
    return both.groupBy("sample_idx", "col").agg(F.sum("num").alias("num"), F.sum("den").alias("den"))


def four_rows(parents: DataFrame, per: int = 4096) -> DataFrame:
    """(block, slot, haps): arrays of four parents by sample turned into a row for each slot and block of per samples, samples in order."""
    each = parents.select("sample_idx", F.posexplode("p").alias("slot", "hap_id"))
    blocks = each.groupBy(F.expr(f"sample_idx div {per}").alias("block"), "slot").agg(F.sort_array(F.collect_list(F.struct("sample_idx", "hap_id"))).alias("x"))
    return blocks.select("block", "slot", F.transform("x", lambda v: v["hap_id"]).alias("haps"))


def bisected(lists: DataFrame, least: int, seed: int = 1) -> DataFrame:
    """(id, path, first, last): the entries first..last of each of lists(id, n) cut at random into blocks of at least `least`, neighbours sharing two entries.

    A block of 2 * least + 2 entries or more is cut at a place drawn for it; path spells the cuts, l and r. Each round cuts all
    blocks there are, so rounds grow with the logarithm of a list's length.
    """
    todo = lists.select("id", F.lit("").alias("path"), F.lit(0).cast("long").alias("first"), (F.col("n") - 1).alias("last"))
    done = None
    while True:
        size = F.col("last") - F.col("first") + 1
        small = todo.where(size < 2 * least + 2)
        done = small if done is None else done.unionByName(small)
        at = least + F.floor(uniform(seed, F.col("id"), F.col("path")) * (size - 2 * least))
        cut = todo.where(size >= 2 * least + 2).withColumn("at", F.col("first") + at).checkpoint()
        if cut.isEmpty():
            return done
        sides = F.array(F.struct(F.lit("l").alias("s"), F.col("first").alias("a"), F.col("at").alias("b")), F.struct(F.lit("r").alias("s"), (F.col("at") - 1).alias("a"), F.col("last").alias("b")))
        todo = cut.select("id", "path", F.explode(sides).alias("x")).select("id", F.concat("path", "x.s").alias("path"), F.col("x.a").alias("first"), F.col("x.b").alias("last"))
