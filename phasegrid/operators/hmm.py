"""The four-state hidden Markov model along sites, of any number, in two levels of blocks.

A sample copies from four parent haplotypes f0, f1, m0, m1; state (f, m) has f and m in {0, 1}. One site's step is a matrix: a
switch of parents, then the emission. Blocks of sites become one matrix each, in tasks side by side; a scan over a sample's blocks
tells the chances at each block's ends; and with these the blocks are worked through once more, side by side.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STATES = ("00", "01", "10", "11")


def states(gl: DataFrame, parents: DataFrame, alleles: DataFrame, tran: DataFrame, mu: float) -> DataFrame:
    """(sample_idx, site_idx, rr, het, aa, s00.., e00.., t0, t1, t2): for each state the parents' alleles (two bits) and the emission.

    gl(sample_idx, site_idx, rr, het, aa), parents(sample_idx, p ARRAY of 4 hap_ids), alleles(hap_id, site_idx, allele), tran(site_idx, t0, t1, t2).
    """
    slots = parents.select("sample_idx", F.posexplode("p").alias("slot", "hap_id")).join(alleles, "hap_id")
    wide = slots.groupBy("sample_idx", "site_idx").agg(*[F.max(F.when(F.col("slot") == i, F.col("allele"))).alias(f"x{i}") for i in range(4)])
    pair = {s: (2 * F.col(f"x{s[0]}") + F.col(f"x{2 + int(s[1])}")).cast("int") for s in STATES}
    same, one, two = (1 - mu) * (1 - mu), mu * (1 - mu), mu * mu
    likely = {0: same * F.col("rr") + one * F.col("het") + one * F.col("het") + two * F.col("aa"), 1: one * F.col("rr") + same * F.col("het") + two * F.col("het") + one * F.col("aa"), 3: two * F.col("rr") + one * F.col("het") + one * F.col("het") + same * F.col("aa")}
    emit = lambda s: F.when(pair[s] == 0, likely[0]).when(pair[s] == 3, likely[3]).otherwise(likely[1])
    joined = gl.join(wide, ["sample_idx", "site_idx"]).join(tran.select("site_idx", "t0", "t1", "t2"), "site_idx")
    return joined.select("sample_idx", "site_idx", "rr", "het", "aa", *[pair[s].alias(f"s{s}") for s in STATES], *[emit(s).alias(f"e{s}") for s in STATES], "t0", "t1", "t2")


def _moved(v: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Chances (row, state, ...) after a step with t (row, 3): each state stays, switches one parent, or both."""
    stay, one, both = (t[:, i].reshape(-1, *[1] * (v.ndim - 1)) for i in range(3))
    return v * stay + (v[:, [1, 0, 3, 2]] + v[:, [2, 3, 0, 1]]) * one + v[:, [3, 2, 1, 0]] * both


def blocks(rows: DataFrame, size: int = 512) -> DataFrame:
    """(sample_idx, block, x): each sample's sites in order, size neighbours in a row."""
    columns = ["site_idx", *[f"e{k}" for k in STATES], "t0", "t1", "t2"]
    return rows.groupBy("sample_idx", F.expr(f"site_idx div {size}").alias("block")).agg(F.sort_array(F.collect_list(F.struct(*columns))).alias("x"))


def _arrays(x: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lengths, sites, emissions (row, site, 4) and transitions (row, site, 3) of an array of blocks; short rows end in steps that change nothing."""
    n = pc.list_value_length(x).to_numpy(zero_copy_only=False).astype(int)
    flat = x.flatten()
    i = np.repeat(np.arange(len(n)), n)
    j = np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)
    of = lambda c: flat.field(c).to_numpy(zero_copy_only=False)
    e, t = np.ones((len(n), n.max(initial=0), 4)), np.zeros((len(n), n.max(initial=0), 3))
    t[:, :, 0] = 1
    for k, s in enumerate(STATES):
        e[i, j, k] = of(f"e{s}")
    for k in range(3):
        t[i, j, k] = of(f"t{k}")
    return n, of("site_idx"), e, t


def _parts(batches: Iterator[pa.RecordBatch], step: int = 64) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def _batch(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns.values()], list(columns))


def transfers(cut: DataFrame) -> DataFrame:
    """(sample_idx, block, m, log): what a block does to the chances it is entered with, a matrix scaled to sum 1 and the logarithm of its scale."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches):
            _, _, e, t = _arrays(part.column("x"))
            m, log = np.broadcast_to(np.eye(4), (len(e), 4, 4)), np.zeros(len(e))
            for k in range(e.shape[1]):
                m = _moved(m, t[:, k]) * e[:, k, :, None]
                total = m.sum((1, 2))
                m, log = m / total[:, None, None], log + np.log(total)
            yield _batch(sample_idx=part.column("sample_idx"), block=part.column("block"), m=list(m.reshape(-1, 16)), log=log)

    return cut.mapInArrow(run, "sample_idx long, block long, m array<double>, log double")


def _scanned(moves: DataFrame) -> DataFrame:
    """(sample_idx, block, enter, leave, loglik, last) from transfers(): chances before the block, likelihoods of what comes after it, the whole sequence's log-likelihood, and whether it is the last block.

    A sample's matrices, one for each block, are one row.
    """
    listed = moves.groupBy("sample_idx").agg(F.sort_array(F.collect_list(F.struct("block", "m", "log"))).alias("x"))
    made = "sample_idx long, block long, enter array<double>, leave array<double>, loglik double, last boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches, 1):
            x = part.column("x").flatten()
            n, sample = len(x), part.column("sample_idx")[0].as_py()
            m = x.field("m").flatten().to_numpy(zero_copy_only=False).reshape(n, 4, 4)
            enter, leave = np.full((n, 4), 0.25), np.ones((n, 4))
            score, v = float(x.field("log").to_numpy(zero_copy_only=False).sum()), enter[0]
            for k in range(n):
                enter[k] = v
                v = m[k] @ v
                score += np.log(v.sum())
                v = v / v.sum()
            for k in range(n - 1, 0, -1):
                v = m[k].T @ leave[k]
                leave[k - 1] = v / v.sum()
            yield _batch(sample_idx=np.full(n, sample), block=x.field("block"), enter=list(enter), leave=list(leave), loglik=np.full(n, score), last=np.arange(n) == n - 1)

    return listed.mapInArrow(run, made)


def forward_loglik(rows: DataFrame, size: int = 512) -> DataFrame:
    """(sample_idx, loglik) of states(): the blocks' matrices are made side by side and folded for each sample."""
    return _scanned(transfers(blocks(rows, size))).where("block = 0").select("sample_idx", "loglik")


def forward_backward(rows: DataFrame, size: int = 512) -> DataFrame:
    """rows of states() with a00.., the chances given the sites so far, and b00.., those of the sites to come; each scaled to 1, the last site's b all 1.

    Work and memory are linear in a sequence's length and no task holds more than a block of it: matrices of the blocks tell how
    each is entered and left, and then the blocks are worked through side by side.
    """
    cut = blocks(rows, size)
    ends = _scanned(transfers(cut)).select(F.col("sample_idx").alias("of"), F.col("block").alias("at"), "enter", "leave", "last")
    met = cut.join(ends, (F.col("sample_idx") == F.col("of")) & (F.col("block") == F.col("at"))).select("sample_idx", "x", "enter", "leave", "last")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches):
            n, sites, e, t = _arrays(part.column("x"))
            a, b = (part.column(c).flatten().to_numpy(zero_copy_only=False).reshape(-1, 4) for c in ("enter", "leave"))
            alpha, beta = np.empty_like(e), np.empty_like(e)
            for k in range(e.shape[1]):
                a = _moved(a, t[:, k]) * e[:, k]
                a = a / a.sum(1, keepdims=True)
                alpha[:, k] = a
            for k in range(e.shape[1] - 1, -1, -1):
                beta[:, k] = b
                before = _moved(b * e[:, k], t[:, k])
                b = np.where((k < n)[:, None], before / before.sum(1, keepdims=True), b)
            kept = np.arange(e.shape[1])[None] < n[:, None]
            who = np.repeat(part.column("sample_idx").to_numpy(zero_copy_only=False), n)
            yield _batch(sample_idx=who, site_idx=sites, **{f"a{s}": alpha[kept][:, k] for k, s in enumerate(STATES)}, **{f"b{s}": beta[kept][:, k] for k, s in enumerate(STATES)})

    made = ", ".join(["sample_idx long", "site_idx long", *[f"a{s} double" for s in STATES], *[f"b{s} double" for s in STATES]])
    return met.mapInArrow(run, made)


def forward_filter(rows: DataFrame, size: int = 512) -> DataFrame:
    return forward_backward(rows, size).select("sample_idx", "site_idx", *[f"a{s}" for s in STATES])


def backward(rows: DataFrame, size: int = 512) -> DataFrame:
    return forward_backward(rows, size).select("sample_idx", "site_idx", *[f"b{s}" for s in STATES])


def pair_weights(rows: DataFrame, mu: float, power: float = 1.0, size: int = 512) -> DataFrame:
    """(sample_idx, site_idx, c00, c01, c10, c11): weights of a sample's two new alleles, from rows of states()."""
    both = rows.join(forward_backward(rows, size), ["sample_idx", "site_idx"])
    chance = {0: (1 - mu) * (1 - mu), 1: mu * (1 - mu), 2: mu * mu}
    out = []
    for n, (k, g) in enumerate(zip(STATES, ("rr", "het", "het", "aa"))):
        total = sum((F.col(f"a{s}") * F.col(f"b{s}") * F.when(F.col(f"s{s}") == n, chance[0]).when(F.col(f"s{s}") == 3 - n, chance[2]).otherwise(chance[1]) for s in STATES), F.lit(0.0))
        weight = F.col(g) * total
        out.append((weight if power == 1.0 else F.pow(weight, F.lit(power))).alias(f"c{k}"))
    return both.select("sample_idx", "site_idx", *out)


def draw_pairs(weights: DataFrame, u: Column) -> DataFrame:
    """(sample_idx, site_idx, x, y): the two alleles drawn from cumulated weights."""
    aim = u * (F.col("c00") + F.col("c01") + F.col("c10") + F.col("c11"))
    n = F.when(aim < F.col("c00"), 0).when(aim < F.col("c00") + F.col("c01"), 1).when(aim < F.col("c00") + F.col("c01") + F.col("c10"), 2).otherwise(3)
    return weights.select("sample_idx", "site_idx", n.alias("n")).selectExpr("sample_idx", "site_idx", "cast(n div 2 AS int) AS x", "n % 2 AS y")
