import math

import pytest
from pyspark.sql import functions as F

from phasegrid.config import PhaseConfig
from phasegrid.functions import scalar as S
from phasegrid.functions.region import LAST, Region, in_region
from phasegrid.rng import uniform
from phasegrid.sources.writers import three_digits


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_regions():
    assert Region.parse("20:101363-") == Region("20", 101363, LAST)
    assert Region.parse("20:-7") == Region("20", 1, 7)
    assert Region.parse("") is None
    assert str(Region.parse("20:5-9")) == "20:5-9"
    for bad in ("20", "20:0-5", "20:9-5"):
        with pytest.raises(ValueError):
            Region.parse(bad)


def test_region_reaches_the_scan(spark):
    df = spark.createDataFrame([("20", 5), ("20", 10), ("21", 6)], "chr string, pos long")
    assert [tuple(r) for r in in_region(df, "20:5-9").collect()] == [("20", 5)]
    assert in_region(df, None).count() == 3


def test_probabilities(spark):
    assert one(spark, S.gl2prob(F.lit(-1.0))) == pytest.approx(0.1)
    assert one(spark, S.gl2prob(F.lit(2.0))) == 1
    assert one(spark, S.phred2prob(F.lit(371))) == 0
    assert one(spark, S.prob2phred(F.lit(0.0))) == 380
    assert one(spark, S.prob2phred(F.lit(1.0))) == 0
    with pytest.raises(Exception, match="not a probability"):
        one(spark, S.prob2phred(F.lit(1.5)))


def test_three_digits_are_those_of_printf(spark):
    values = [0.0, 1.0, 380.0, 7.958800173, 1.67, 0.969100130, 0.0434, 123.456, 99.96, 0.000123456, 0.0000432, 12.0, 5.1e-9]
    df = spark.createDataFrame([(v,) for v in values], "v double").select("v", three_digits(F.col("v")).alias("t"))
    for r in df.collect():
        assert r.t == f"{r.v:.3g}"


def test_quantised_codes(spark):
    assert [one(spark, S.half_byte(F.lit(x / 16 + 0.01))) for x in (0, 1, 2, 15)] == [0, 1, 2, 15]
    assert one(spark, S.half_byte(F.lit(1.0))) == 15
    assert one(spark, S.packed_pair(F.lit(1.01 / 16), F.lit(2.01 / 16))) == 18
    assert one(spark, S.packed_pair(F.lit(3.01 / 16), F.lit(4.01 / 16))) == 52


def test_vectors(spark):
    v = F.array(F.lit(0.2), F.lit(0.5), F.lit(0.3))
    assert one(spark, S.first_max(v)) == 1
    assert one(spark, S.entropy(v)) == pytest.approx(sum(x * math.log(x) for x in (0.2, 0.5, 0.3)))
    assert one(spark, S.kl_distance(v, v)) == pytest.approx(0)
    assert [one(spark, S.draw(v, F.lit(u))) for u in (0.0, 0.19, 0.2, 0.69, 0.71, 0.999)] == [0, 0, 1, 1, 2, 2]
    assert one(spark, S.true_places(F.array(F.lit(False), F.lit(True), F.lit(True)))) == [1, 2]
    assert one(spark, S.normalised(F.array(F.lit(0.0), F.lit(0.0)))) == [0, 0]


def test_mendel_tables(spark):
    for p, row in S.DUO.items():
        assert [one(spark, S.check_duo(F.lit(p), F.lit(c))) for c in range(3)] == list(row)
    assert one(spark, S.check_trio(F.lit(2), F.lit(0), F.lit(1))) == 0
    assert one(spark, S.check_trio(F.lit(1), F.lit(1), F.lit(0))) == 2


def test_bisection_covers_all_and_overlaps_by_two():
    blocks = sorted(S.bisect_blocks(4, list(range(50))))
    assert sorted(set().union(*blocks)) == list(range(50))
    assert all(len(set(a) & set(b)) == 2 for a, b in zip(blocks, blocks[1:]))


def test_config():
    c = PhaseConfig()
    assert c.generations == 256 and c.proposals(60) == 120 and c.first_cluster_generation == 28
    assert PhaseConfig(annealing_gens=0).penalty(0) == 1
    for bad in ({"chains": 1}, {"af_lower": 0.6, "af_upper": 0.5}, {"algorithm": 4}):
        with pytest.raises(ValueError):
            PhaseConfig(**bad)


def test_uniform_is_fixed(spark):
    assert one(spark, uniform(42, 1, 2, 3)) == 291718323 / 4294967296
