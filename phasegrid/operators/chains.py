"""Decisions of Metropolis steps with delayed rejection, and of chains at ascending temperatures, as column expressions.

A row has what a sample's generation needs: an array of its chains' log-likelihoods, parents, and random numbers. The array kernel takes the same
decisions for whole batches; these are for tables whose likelihoods are there already.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def heat(chain: Column, chains: int, hottest: float = 1.0) -> Column:
    """The temperature of a chain, from 0: an even part of the hottest."""
    return (chain + 1) * (hottest / chains)


def weights(loglik: Column) -> Column:
    """How likely each chain is to be picked, up to a factor: likelihoods at a temperature of 10,000, the greatest 1."""
    return F.transform(loglik, lambda x: F.exp((x - F.array_max(loglik)) / 10000))


def roulette(loglik: Column, u: Column) -> Column:
    """The chain on which u of all weights falls."""
    w = weights(loglik)
    up_to = lambda k: F.aggregate(F.slice(w, 1, k + 1), F.lit(0.0), lambda s, x: s + x)
    run = F.transform(F.sequence(F.lit(0), F.size(w) - 1), up_to)
    return F.least(F.size(F.filter(run, lambda c: u * F.element_at(run, -1) >= c)), F.size(w) - 1)


def other(chain: Column, chains: int, u: Column) -> Column:
    """Another chain, each as likely."""
    return ((chain + 1 + F.floor(u * (chains - 1))) % chains).cast("int")


def mutated(parents: Column, slot: Column, hap: Column) -> Column:
    """parents with hap in a slot, from 0."""
    return F.transform(parents, lambda x, i: F.when(i == slot, hap).otherwise(x))


def crossed(a: Column, b: Column, mask: Column) -> tuple[Column, Column]:
    """Both sets of parents after those in the slots of mask's bits have changed places."""
    swapped = lambda i: F.getbit(mask, i) == 1
    return F.transform(a, lambda x, i: F.when(swapped(i), F.get(b, i)).otherwise(x)), F.transform(b, lambda x, i: F.when(swapped(i), F.get(a, i)).otherwise(x))


def gains(gain: Column, penalty: float, u: Column) -> Column:
    """Whether a change is kept whose log-likelihoods, each over its chain's temperature, rise by gain in all."""
    return u < F.exp(F.least(F.lit(0.0), gain * penalty))


def exchanged(loglik: Column, draws: Column, chains: int, hottest: float = 1.0) -> Column:
    """loglik after neighbouring chains were offered to change places, once for each of draws, an array of (pick, u)."""

    def step(now: Column, d: Column) -> Column:
        c = F.floor(d["pick"] * (chains - 1)).cast("int")
        low, high = F.get(now, c), F.get(now, c + 1)
        cold = 1 / heat(c, chains, hottest) - 1 / heat(c + 1, chains, hottest)
        keep = F.transform(now, lambda x, i: F.when(i == c, high).when(i == c + 1, low).otherwise(x))
        return F.when(d["u"] < F.exp(F.least(F.lit(0.0), (high - low) * cold)), keep).otherwise(now)

    return F.aggregate(draws, loglik, step)


def delayed(start: Column, steps: Column, penalty: float = 1.0) -> Column:
    """(now, second, waiting, accepted) after steps, an array of proposals (loglik, u) in order, from the log-likelihood start.

    After a first rejection the next proposal builds on the first: it is refused if it is worse than that, and else taken with a chance
    that makes up for the first; if it fails too, both are undone.
    """
    first = F.struct(start.cast("double").alias("now"), F.lit(0.0).alias("second"), F.lit(False).alias("waiting"), F.array().cast("array<boolean>").alias("accepted"))

    def step(s: Column, p: Column) -> Column:
        x, u = p["loglik"], p["u"]
        plain = (x >= s["now"]) | (u < F.exp(F.least(F.lit(0.0), (x - s["now"]) * penalty)))
        left = F.nullif(1 - F.least(F.lit(1.0), F.exp(s["second"] - s["now"])), F.lit(0.0))
        odds = F.coalesce(F.exp(x - s["now"]) * (1 - F.least(F.lit(1.0), F.exp(s["second"] - x))) / left, F.lit(0.0))
        held = (x >= s["second"]) & ((x >= s["now"]) | (u < odds))
        ok = F.when(s["waiting"], held).otherwise(plain)
        return F.struct(F.when(ok, x).otherwise(s["now"]).alias("now"), F.when(ok, 0.0).otherwise(x).alias("second"), (~ok & ~s["waiting"]).alias("waiting"), F.concat(s["accepted"], F.array(ok)).alias("accepted"))

    return F.aggregate(steps, first, step)
