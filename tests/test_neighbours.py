"""Neighbours by prefix orders and windows joined along a chromosome, held against plain versions."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from phasegrid.operators import ligate as L
from phasegrid.operators import panel as P


def _runs(x, y):
    best = now = 0
    for a, b in zip(x, y):
        now = now + 1 if a == b else 0
        best = max(best, now)
    return best


@pytest.mark.parametrize("seed, n, sites, keep", [(1, 40, 60, 4), (2, 9, 30, 6), (3, 60, 5, 4), (4, 30, 200, 8), (5, 5, 1, 2)])
def test_longest_runs_of_the_nearest(seed, n, sites, keep):
    rng = np.random.default_rng(seed)
    founders = rng.integers(0, 2, (4, sites))
    x = founders[rng.integers(0, 4, (n, sites // 7 + 1)).repeat(7, axis=1)[:, :sites], np.arange(sites)].astype(np.uint8)
    allowed = (np.arange(n) // 2)[:, None] != (np.arange(n) // 2)[None]
    got = P._tract_neighbours(x, np.arange(n), allowed, keep)
    for i in range(n):
        want = sorted(((-_runs(x[i], x[j]), j) for j in range(n) if allowed[i, j]))[:keep]
        mine = sorted((-int(got[i, j]), j) for j in range(n) if allowed[i, j])[:keep]
        assert mine == want


def test_walks_are_linear_in_haplotypes():
    rng = np.random.default_rng(6)
    took = []
    for n in (2000, 16000):
        x = rng.integers(0, 2, (n, 60)).astype(np.uint8)
        began = time.process_time()
        P._tract_neighbours(x, np.arange(50), (np.arange(50) // 2)[:, None] != (np.arange(n) // 2)[None], 4)
        took.append(time.process_time() - began)
    assert took[1] < 8 * 4 * took[0]  # all pairs of haplotypes would take 64 times as long


def test_neighbours_beyond_the_panel_come_from_both_haplotypes(spark):
    rng = np.random.default_rng(7)
    rows = [(h, [int(w) for w in rng.integers(0, 2**62, 2)]) for h in range(10)]
    haps = spark.createDataFrame(rows, "hap_id long, words array<long>")
    for metric in ("hamming", "tract"):
        near = P.nearest(P.near_distances(haps, haps, 20, metric, 128), 20, 10).collect()
        for i in range(5):
            mine = [r.hap_id for r in sorted((r for r in near if r.sample_idx == i), key=lambda r: r.rank)]
            assert sorted(mine) == [h for h in range(10) if h // 2 != i] and [r.rank for r in sorted(near, key=lambda r: r.rank) if r.sample_idx == i] == list(range(8))


@pytest.mark.parametrize("size, overlap", [(50, 6), (64, 32), (10, 0), (7, 3)])
def test_windows_hold_their_sites(spark, size, overlap):
    got = spark.range(200).select("id", L.windows_of(F.col("id"), size, overlap).alias("w")).collect()
    assert all(r.w == [w for w in range(200) if w * (size - overlap) <= r.id < w * (size - overlap) + size] for r in got)


def _truth_in_windows(spark, sites, size, overlap, seed=8):
    rng = np.random.default_rng(seed)
    truth = rng.integers(0, 2, (6, 2, sites))
    rows = []
    for w in range(sites // (size - overlap) + 1):
        for i in range(6):
            turn = int(rng.integers(0, 2))
            for m in range(w * (size - overlap), min(sites, w * (size - overlap) + size)):
                a, b = truth[i, turn, m], truth[i, 1 - turn, m]
                rows.append(("20", w, i, m, float(0.9 * a + 0.05), float(0.9 * b + 0.05)))
    return truth, spark.createDataFrame(rows, "chr string, window long, sample_idx long, site_idx long, p_a double, p_b double")


@pytest.mark.parametrize("size, overlap", [(50, 12), (40, 20)])
def test_turned_windows_are_joined_without_a_switch(spark, size, overlap):
    truth, parts = _truth_in_windows(spark, 330, size, overlap)
    got = L.ligate(parts, size, overlap).toPandas()
    assert len(got) == 6 * 330
    for i in range(6):
        mine = got[got.sample_idx == i].sort_values("site_idx")
        a = (mine.p_a.to_numpy() > 0.5).astype(int)
        assert (a == truth[i, 0]).all() or (a == truth[i, 1]).all()


def test_borders_that_say_nothing_leave_windows_as_they_are(spark):
    rows = [("20", w, 0, m, 0.5, 0.5) for w in (0, 1, 2) for m in range(8 * w, min(18, 8 * w + 10))]
    parts = spark.createDataFrame(rows, "chr string, window long, sample_idx long, site_idx long, p_a double, p_b double")
    assert L.ligate(parts, 10, 2).count() == 18 and L.ligate(parts.limit(0), 10, 2).count() == 0


def test_medoids_by_counts_and_by_blocks(spark):
    """Both searches against all pairs: the member with the least sum, and the swap with the least loss."""
    from phasegrid.operators import quantise as Q

    rng = np.random.default_rng(9)
    x = rng.integers(0, 2, (3, 70))[rng.integers(0, 3, 30)] ^ (rng.random((30, 70)) < 0.1)
    alleles = spark.createDataFrame([(h, m, int(x[h, m])) for h in range(30) for m in range(70)], "hap_id long, site_idx long, allele int")
    haps, ids = P.pack(alleles), [4, 9, 20]
    medoids = spark.createDataFrame(list(zip(ids, range(3))), "medoid long, rank int")
    d = (x[:, None] != x[None]).sum(2)
    near = d[:, ids].argmin(1)
    assigned = Q.nearest_medoid(haps, medoids)
    assert sorted(map(tuple, assigned.collect())) == [(h, ids[near[h]], d[h, ids[near[h]]]) for h in range(30)]
    for r in Q.better_medoids(alleles, assigned).collect():
        pool = np.flatnonzero(near == ids.index(r.medoid))
        loss = d[np.ix_(pool, pool)].sum(0)
        assert (r.best, r.loss) == (pool[loss.argmin()], loss.min())
    for r in Q.best_swap(haps, medoids, 2, per=7).collect():
        rest = np.delete(d[:, ids], ids.index(r.medoid), 1).min(1)
        loss = (np.minimum(d, rest[:, None]) ** 2).sum(0)
        assert (r.candidate, r.loss) == (loss.argmin(), loss.min())
    spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir"))
    for inside in (True, False):
        done = Q.kmedoids(alleles, 3, inside=inside).collect()
        assert len(done) == 30 and len({r.medoid for r in done}) <= 3
    assert sum(r.distance for r in done) <= 30 * 12


def test_a_run_in_windows_has_no_more_switches_than_one_window(spark):
    from phasegrid.config import PhaseConfig
    from phasegrid.plans.run import phase_joined

    rng = np.random.default_rng(4)
    n, sites = 12, 200
    founders = rng.integers(0, 2, (8, sites))
    truth = founders[rng.integers(0, 8, (2 * n, sites // 40)).repeat(40, axis=1), np.arange(sites)]
    dosage = truth[0::2] + truth[1::2]
    gl = [(i, m, *(0.98 if g == dosage[i, m] else 0.01 for g in range(3))) for i in range(n) for m in range(sites)]
    gl = spark.createDataFrame(gl, "sample_idx long, site_idx long, rr double, het double, aa double")
    where = spark.createDataFrame([(m, "20", 1000 * m, m * 0.02) for m in range(sites)], "site_idx long, chr string, pos long, cm double")
    panel = spark.createDataFrame([(h, m, int(founders[h, m])) for h in range(8) for m in range(sites)], "hap_id long, site_idx long, allele int")
    cfg = PhaseConfig(annealing_gens=5, burnin_gens=5, sampling_gens=15, nested_gens=60, seed=3)

    def switches(window, overlap):
        got = phase_joined(gl, where, cfg, panel, window, overlap=overlap).toPandas()
        total = 0
        for i in range(n):
            mine = got[got.sample_idx == i].sort_values("site_idx")
            het = np.flatnonzero(dosage[i] == 1)
            side = (mine.p_a.to_numpy() > mine.p_b.to_numpy())[het] == (truth[2 * i] == 1)[het]
            total += int((np.diff(side.astype(int)) != 0).sum())
        return total

    assert switches(50, 12) <= switches(200, 0) + 1
