"""Numbers of rows, equal ones and nulls among them, and how often rows are shuffled for them."""

import pytest
from pyspark.sql import functions as F

from faultsift import session
from faultsift.operators.positions import number_rows


@pytest.mark.parametrize("split_equal", [False, True])
def test_numbers_without_gaps_and_one_shuffle_of_rows(spark, split_equal):
    rows = spark.range(0, 4000, 1, 7).select(
        F.when(F.col("id") % 3 == 0, F.lit(5)).when(F.col("id") % 11 != 0, F.pmod(F.hash("id"), F.lit(900))).alias("k"),
        F.col("id").alias("v"))
    numbered = number_rows(rows, ["k"], "n", split_equal)
    plan = numbered._jdf.queryExecution().executedPlan().toString()
    assert "_tie" not in numbered.columns and numbered.columns == ["k", "v", "n"]
    assert "hashpartitioning(_part#" not in plan.split("BroadcastExchange")[0] and plan.count("Window") <= 1
    got = sorted((r["n"], -1 if r["k"] is None else r["k"], r["v"]) for r in numbered.collect())
    assert [n for n, _, _ in got] == list(range(4000))
    assert [k for _, k, _ in got] == sorted(k for _, k, _ in got) and len({v for _, _, v in got}) == 4000


def test_no_rows(spark):
    assert number_rows(spark.range(0), ["id"], "n").collect() == []
