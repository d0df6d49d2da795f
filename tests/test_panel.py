import numpy as np
import pytest
from pyspark.sql import functions as F

from phasegrid.operators import match, panel, tally


def haps_of(spark, bits, n_sites):
    rows = [(i, m, int(m in b)) for i, b in enumerate(bits) for m in range(n_sites)]
    return spark.createDataFrame(rows, "hap_id long, site_idx long, allele int")


def test_hamming_and_tract_of_short_haplotypes(spark):
    words = {r.hap_id: r.words for r in panel.pack(haps_of(spark, [set(), {0, 3}], 4)).collect()}
    df = spark.createDataFrame([(words[0], words[1])], "a array<long>, b array<long>")
    got = df.select(panel.hamming(F.col("a"), F.col("b")).alias("d"), panel.max_tract_words(F.col("a"), F.col("b"), 4).alias("t")).first()
    assert tuple(got) == (2, 2)


@pytest.mark.parametrize("bits,tract", [({23}, 1000), ({23, 1023}, 999)])
def test_tract_of_long_haplotypes(spark, bits, tract):
    long = haps_of(spark, [set(), bits], 1024)
    packed = panel.pack(long).collect()
    df = spark.createDataFrame([(packed[0].words, packed[1].words)], "a array<long>, b array<long>")
    assert df.select(panel.max_tract_words(F.col("a"), F.col("b"), 1024).alias("t")).first().t == tract
    a = long.where("hap_id = 0").select(F.lit(0).alias("k"), "site_idx", F.col("allele").alias("allele_a"))
    b = long.where("hap_id = 1").select("site_idx", F.col("allele").alias("allele_b"))
    assert panel.max_tract(a.join(b, "site_idx"), ["k"]).first().tract == tract
    assert panel.unpack(panel.pack(long), 1024).exceptAll(long.select("hap_id", F.col("site_idx").cast("int"), "allele")).count() == 0


def test_neighbours_alternate_and_are_unique(spark):
    rng = np.random.default_rng(3)
    x = rng.integers(0, 2, (16, 40))
    rows = [(i, m, int(x[i, m])) for i in range(16) for m in range(40)]
    packed = panel.pack(spark.createDataFrame(rows, "hap_id long, site_idx long, allele int"))
    got = panel.nearest(panel.distances(packed, packed), 5, 16).toPandas()
    from phasegrid.plans.engine import nearest_lists

    for metric in ("hamming", "tract"):  # the blocks' nearest rows are all that is needed
        every, some = (panel.nearest(d, 5, 16).collect() for d in (panel.distances(packed, packed, metric, 40), panel.near_distances(packed, packed, 5, metric, 40, per=3)))
        assert sorted(every) == sorted(some)
    assert panel.nearest(panel.near_distances(packed, packed, 500, per=5), 500, 16).count() == 8 * 14
    want = nearest_lists(x, 8, 5)
    for i in range(8):
        mine = got[got.sample_idx == i].sort_values("rank").hap_id.tolist()
        assert mine[0::2] == want[i][:3].tolist() and mine[1::2] == want[i][3:].tolist()


def test_map_interpolation(spark):
    gmap = spark.createDataFrame([(1140727, 5.49294697413266), (1140749, 5.49294973985857)], "pos long, cm double")
    sites = spark.createDataFrame([(0, "20", 1140727), (1, "20", 1140730), (2, "20", 1140749), (3, "20", 1140750)], "site_idx long, chr string, pos long")
    got = {r.pos: r for r in match.map_distance(match.map_location(sites, gmap)).collect()}
    assert got[1140727].cm == 5.49294697413266 and got[1140749].cm == 5.49294973985857
    assert got[1140730].cm == pytest.approx(5.49294697413266 + 3 / 22 * (5.49294973985857 - 5.49294697413266), abs=1e-15)
    assert got[1140730].morgans == pytest.approx((got[1140730].cm - got[1140727].cm) / 100)
    assert got[1140750].cm is None


def test_site_checks(spark):
    schema = "site_idx long, chr string, pos long, ref string, alt string"
    sites = spark.createDataFrame([(0, "20", 5, "A", "C"), (1, "20", 5, "A", "G"), (2, "20", 9, "T", "C")], schema)
    assert match.duplicate_sites(sites).count() == 0 and match.unordered_sites(sites).count() == 0 and match.unordered_sites(sites, True).count() == 1
    match.check_sites(sites, sites, False)
    some = sites.where("site_idx = 0")
    match.check_sites(some, sites, True)
    with pytest.raises(match.PanelError):
        match.check_sites(some, sites, False)
    with pytest.raises(match.PanelError):
        match.check_sites(some.withColumn("alt", F.lit("T")), sites, True)


def test_pileup_of_many_reads_does_not_underflow(spark):
    got = tally.pileup_likelihoods(spark.createDataFrame([(0, 0), (100_000, 50_000), (5000, 0)], "n long, k long")).collect()
    assert got[0].rr == pytest.approx(1 / 3) and got[1].het == pytest.approx(1) and got[2].rr == pytest.approx(1)
