"""Column functions over likelihoods, alleles, dosages and vectors."""

from __future__ import annotations

import random
from functools import cache
from itertools import pairwise

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the pseudo-autosomal regions of chromosome X.
PAR_FIRST, PAR_LAST, PAR_SECOND = 60001, 2699520, 154931044
# A phred score above which a probability is zero, and the score written for zero.
PHRED_ZERO, PHRED_WRITTEN = 370, 380.0


def gl2prob(x: Column) -> Column:
    """A log10 likelihood as a probability between 0 and 1."""
    return F.least(F.greatest(F.pow(F.lit(10.0), x), F.lit(0.0)), F.lit(1.0))


def phred2prob(p: Column) -> Column:
    return F.when(p > PHRED_ZERO, 0.0).otherwise(F.pow(F.lit(10.0), -p / 10))


def prob2phred(p: Column) -> Column:
    """380 for 0, 0 for 1; outside 0..1 the query fails."""
    bad = F.raise_error(F.concat(F.lit("not a probability: "), p.cast("string"))).cast("double")
    return F.when(p == 0, PHRED_WRITTEN).when(p == 1, 0.0).when((p < 0) | (p > 1), bad).otherwise(-10 * F.log10(p))


def drop_first(rr: Column, het: Column, aa: Column) -> Column:
    """The (het, aa) of a likelihood triple, normalised."""
    total = rr + het + aa
    return F.struct((het / total).alias("het"), (aa / total).alias("aa"))


def recover_first(het: Column, aa: Column) -> Column:
    """The triple whose first part was left out; rounding below zero is cut off."""
    zero = F.lit(0.0)
    return F.struct(F.greatest(1 - het - aa, zero).alias("rr"), F.greatest(het, zero).alias("het"), F.greatest(aa, zero).alias("aa"))


def in_par(pos: Column) -> Column:
    return pos.between(PAR_FIRST, PAR_LAST) | (pos >= PAR_SECOND)


def haploid(rr: Column, aa: Column) -> Column:
    """A male's triple outside the pseudo-autosomal regions: no heterozygote; flat if nothing is left."""
    total = rr + aa
    part = lambda x: F.when(total == 0, 0.5).otherwise(x / F.when(total == 0, 1.0).otherwise(total))
    return F.struct(part(rr).alias("rr"), F.lit(0.0).alias("het"), part(aa).alias("aa"))


def known_genotype_prior(rr: Column, het: Column, aa: Column, dosage: Column, confidence: float) -> Column:
    """The triple, weighted towards a genotype known with some confidence, normalised; null dosages change nothing."""
    w = [F.when(dosage.isNull(), 1.0).when(dosage == g, confidence).otherwise((1 - confidence) / 2) for g in range(3)]
    parts = [rr * w[0], het * w[1], aa * w[2]]
    total = parts[0] + parts[1] + parts[2]
    return F.struct(*[(p / total).alias(n) for p, n in zip(parts, ("rr", "het", "aa"))])


def genotype_posterior(a: Column, b: Column) -> Column:
    """Of two haplotypes' probabilities of allele 1: those of the three genotypes."""
    return F.struct(((1 - a) * (1 - b)).alias("rr"), ((1 - a) * b + a * (1 - b)).alias("het"), (a * b).alias("aa"))


def phased_call(a: Column, b: Column) -> Column:
    """The most probable genotype with its phase; ties go to the fewer ones, then to 0|1."""
    rr, het, aa = (1 - a) * (1 - b), (1 - a) * b + a * (1 - b), a * b
    return F.when((rr >= het) & (rr >= aa), "0|0").when((het >= rr) & (het >= aa), F.when(a > b, "1|0").otherwise("0|1")).otherwise("1|1")


def best_dosage(rr: Column, het: Column, aa: Column) -> Column:
    """0, 1 or 2, whichever is likeliest, the least on ties."""
    return F.when((rr >= het) & (rr >= aa), 0).when(het >= aa, 1).otherwise(2)


def mutation(state: Column, pair: Column, mu: Column) -> Column:
    """The chance that parents' alleles `state` (two bits) give the alleles `pair`."""
    d = F.bit_count(state.bitwiseXOR(pair))
    return F.pow(1 - mu, 2 - d) * F.pow(mu, d)


def emission(rr: Column, het: Column, aa: Column, mu: Column) -> Column:
    """For each two-bit state of the parents, the likelihood of the reads."""
    same, one, two = (1 - mu) * (1 - mu), mu * (1 - mu), mu * mu
    homs = one * rr + one * aa + same * het + two * het
    return F.array(same * rr + 2 * one * het + two * aa, homs, homs, two * rr + 2 * one * het + same * aa)


@cache
def watterson(n_haps: int) -> tuple[float, float]:
    """(theta, mutation rate) for a number of haplotypes."""
    theta = 1 / sum(1 / i for i in range(1, n_haps))
    return theta, theta / (n_haps + theta)


def recombination_rate(theta: float, n_sites: Column, first: Column, last: Column, density: float = 1.0) -> Column:
    """The rate per base, 0 if all sites share a position."""
    return F.when(last == first, 0.0).otherwise(0.5 * theta * (n_sites - 1) / F.when(last == first, 1).otherwise(last - first) / density)


def transition(r: Column) -> Column:
    """Chances that none, one or both parents' haplotypes switch, at a recombination fraction capped at 1."""
    r = F.least(r, F.lit(1.0))
    return F.struct(((1 - r) * (1 - r)).alias("t0"), (r * (1 - r)).alias("t1"), (r * r).alias("t2"))


def half_byte(p: Column, tiny: float = 1e-8) -> Column:
    """A probability in sixteen steps."""
    return F.floor(F.greatest(p - tiny, F.lit(0.0)) * 16).cast("int")


def packed_pair(rr: Column, het: Column) -> Column:
    return F.shiftleft(half_byte(rr), 4).bitwiseOR(half_byte(het))


def maf(af: Column) -> Column:
    return F.least(af, 1 - af)


def words(text: Column, most: int | None = None) -> Column:
    """White-space separated parts, a carriage return at the end dropped; the first `most` of them."""
    parts = F.split(F.btrim(F.regexp_replace(text, r"\r$", ""), F.lit(" \t\n\r")), r"[ \t\r\n]+")
    return parts if most is None else F.slice(parts, 1, most)


def entropy(v: Column) -> Column:
    """Sum of v ln v over an array's positive entries (the sign is not turned)."""
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + F.when(x > 0, x * F.ln(F.when(x > 0, x).otherwise(1.0))).otherwise(0.0))


def kl_part(p: Column, q: Column) -> Column:
    """p (ln p - ln q) where both are positive: an entry's part of the distance, which may be summed over rows."""
    safe = lambda x: F.ln(F.when(x > 0, x).otherwise(1.0))
    return F.when((p > 0) & (q > 0), p * (safe(p) - safe(q))).otherwise(0.0)


def kl_distance(p: Column, q: Column) -> Column:
    """Sum of p (ln p - ln q) where both are positive."""
    return F.aggregate(F.zip_with(p, q, kl_part), F.lit(0.0), lambda s, x: s + x)


def normalised(v: Column) -> Column:
    """An array divided by its sum, as it is if that is 0. The sum is taken once: inside transform it would be taken for each entry."""
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x, lambda s: F.transform(v, lambda x: x / F.when(s == 0, 1.0).otherwise(s)))


def first_max(v: Column) -> Column:
    """The place of the first greatest entry, from 0."""
    return (F.array_position(v, F.array_max(v)) - 1).cast("int")


def true_places(bits: Column) -> Column:
    """The places, from 0, of an array's true entries."""
    return F.filter(F.transform(bits, lambda x, i: F.when(x, i)), lambda x: x.isNotNull())


def draw(weights: Column, u: Column) -> Column:
    """The place at which the running sum of weights first exceeds u times their sum."""
    total = F.aggregate(weights, F.lit(0.0), lambda s, x: s + x)
    walk = F.aggregate(
        weights,
        F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("n"), F.lit(False).alias("done")),
        lambda s, x: F.struct((s["sum"] + x).alias("sum"), F.when(s["done"] | (s["sum"] + x > u * total), s["n"]).otherwise(s["n"] + 1).alias("n"), (s["done"] | (s["sum"] + x > u * total)).alias("done")),
        lambda s: F.least(s["n"], F.size(weights) - 1),
    )
    return walk


def _cases(columns: list[Column], table: dict[tuple[int, ...], int]) -> Column:
    out = F.lit(None).cast("int")
    for key, value in table.items():
        hit = F.lit(True)
        for c, k in zip(columns, key):
            hit = hit & (c == k)
        out = F.when(hit, value).otherwise(out)
    return out


# Status of a child's dosage 0, 1, 2 by the parents' dosages; -1 is a Mendelian error.
DUO = {0: (0, 0, -1), 1: (1, 0, 1), 2: (-1, 0, 0)}
TRIO = {(0, 0): (0, -1, -1), (0, 1): (1, 1, -1), (0, 2): (-1, 0, -1), (1, 1): (2, 0, 2), (1, 2): (-1, 1, 1), (2, 2): (-1, -1, 0)}


def check_duo(parent: Column, child: Column) -> Column:
    return _cases([parent, child], {(p, c): v for p, row in DUO.items() for c, v in enumerate(row)})


def check_trio(father: Column, mother: Column, child: Column) -> Column:
    low, high = F.least(father, mother), F.greatest(father, mother)
    return _cases([low, high, child], {(*p, c): v for p, row in TRIO.items() for c, v in enumerate(row)})


def bisect_blocks(least: int, block: list[int], seed: int = 1) -> list[list[int]]:
    """A list cut at random into blocks of at least `least` entries, neighbours sharing two entries."""
    rng, todo, done = random.Random(seed), [list(block)], []
    while todo:
        b = todo.pop()
        if len(b) < 2 * least + 2:
            done.append(b)
            continue
        at = rng.randint(least, len(b) - least - 1)
        todo += [b[at - 1 :], b[: at + 1]]
    return done


def ascending(values: list[float], strictly: bool = False) -> bool:
    return all(a < b if strictly else a <= b for a, b in pairwise(values))
