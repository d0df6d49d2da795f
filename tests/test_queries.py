import pytest

from phasegrid.plans import more_queries, queries as genomic

SMALL = "/root/testdata/sf0.001"
assert more_queries


#: One in six, and the longer folds; the driver's own comparison runs them all.
SOME = sorted({*sorted(genomic.ORACLES)[::6], "t01_knn_topk", "w01_forward_loglik", "w05_draw_haplotypes", "m16_batched_kernel", "a13_streamed_pileup", "r01_ligate", "r01_prepare", "t01_tract_topk", "s21_read_panel", "m04_best_swap", "f31_bisected_blocks"})


@pytest.mark.parametrize("name", SOME)
def test_query_gives_the_rows_of_its_sql(spark, duck, same_rows, name):
    same_rows(genomic.QUERIES[name](spark, SMALL), duck.sql(genomic.ORACLES[name]))


@pytest.mark.parametrize("name", ["w06_quantised_loglik", "m04_kmedoids", "r04_phase_metropolis", "k05_proposal_log"])
def test_query_without_sql_gives_rows(spark, name):
    assert genomic.QUERIES[name](spark, SMALL).count() > 0


def test_entry_and_registry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 25
    assert set(e.oracle_sql()) <= set(e.queries())
