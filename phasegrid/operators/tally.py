"""Aggregates over reads, phased results and sampled haplotypes."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Chance of an alternative read by genotype.
ALT_READ = (0.005, 0.5, 0.995)


def pileup_likelihoods(counts: DataFrame) -> DataFrame:
    """counts(.., n, k) with rr, het, aa: binomial likelihoods of k alternative of n reads, normalised.

    Logarithms are used, so that thousands of reads don't underflow. No reads give a flat triple.
    """
    logs = [F.col("k") * math.log(p) + (F.col("n") - F.col("k")) * math.log(1 - p) for p in ALT_READ]
    top = F.greatest(*logs)
    parts = [F.exp(x - top) for x in logs]
    total = parts[0] + parts[1] + parts[2]
    return counts.select("*", *[(p / total).alias(n) for p, n in zip(parts, ("rr", "het", "aa"))])


def count_reads(reads: DataFrame, *keys: str) -> DataFrame:
    """(keys, n, k) from reads(keys, is_alt)."""
    return reads.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if("is_alt").alias("k"))


def orient_and_add(tally: DataFrame, drawn: DataFrame) -> DataFrame:
    """tally(sample_idx, site_idx, a, b) plus the drawn alleles (sample_idx, site_idx, x, y) in the better orientation.

    The direct one if it scores more over the whole sample, else swapped. Cells are joined by shuffle; what is sent to all tasks is a row a sample.
    """
    both = tally.join(drawn.hint("merge"), ["sample_idx", "site_idx"])
    score = both.groupBy("sample_idx").agg(F.sum(F.expr("x * a + y * b")).alias("direct"), F.sum(F.expr("x * b + y * a")).alias("swapped"))
    turned = both.join(F.broadcast(score.select("sample_idx", (F.col("direct") > F.col("swapped")).alias("keep"))), "sample_idx")
    add = lambda own, p, q: (F.col(own) + F.when(F.col("keep"), F.col(p)).otherwise(F.col(q))).alias(own)
    return turned.select("sample_idx", "site_idx", add("a", "x", "y"), add("b", "y", "x"))


def posterior(tally: DataFrame, n_sampled: int) -> DataFrame:
    """(sample_idx, site_idx, p_a, p_b): shares of the sampling generations with allele 1."""
    return tally.select("sample_idx", "site_idx", (F.col("a") / n_sampled).alias("p_a"), (F.col("b") / n_sampled).alias("p_b"))


def discordance(calls: DataFrame, truth: DataFrame) -> DataFrame:
    """(n_compared, n_wrong, nrd): non-reference discordance in percent of dosages by (sample_idx, site_idx)."""
    both = calls.select("sample_idx", "site_idx", F.col("dosage").alias("got")).join(truth.select("sample_idx", "site_idx", F.col("dosage").alias("want")), ["sample_idx", "site_idx"])
    wrong, both_ref = F.count_if(F.expr("got <> want")), F.count_if(F.expr("got = 0 AND want = 0"))
    counted = F.count("*") - both_ref
    return both.agg(F.count("*").alias("n_compared"), wrong.alias("n_wrong"), F.when(counted > 0, 100 * wrong / counted).otherwise(0.0).alias("nrd"))


def phase_differences(got: DataFrame, want: DataFrame) -> DataFrame:
    """(sample_idx, differences): sites at which the two haplotypes (a, b) differ from the expected ones, in the better of both orientations."""
    w = want.select("sample_idx", "site_idx", F.col("a").alias("wa"), F.col("b").alias("wb"))
    both = got.join(w, ["sample_idx", "site_idx"])
    return both.groupBy("sample_idx").agg(F.least(F.count_if(F.expr("a <> wa OR b <> wb")), F.count_if(F.expr("a <> wb OR b <> wa"))).alias("differences"))


def mean_loglik(loglik: DataFrame, n_sites: Column | int) -> DataFrame:
    """(mean_loglik): by sample and site."""
    return loglik.agg((F.sum("loglik") / F.count("*") / n_sites).alias("mean_loglik"))
