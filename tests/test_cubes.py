"""Breakdowns with nulls among the values, empty tables and wrong sets."""

import pytest
from pyspark.sql import functions as F

from riskweft.operators import cubes


def test_levels_tell_nulls_from_totals(spark):
    df = spark.createDataFrame([("a", 1, 2.0), ("a", None, 3.0), (None, 1, 4.0)], "x string, y int, v double")
    got = sorted(map(tuple, cubes.cube(df, ["x", "y"], {"v": F.sum("v")}).collect()), key=str)
    want = [("a", 1, 0, 2.0), ("a", None, 0, 3.0), (None, 1, 0, 4.0), ("a", None, 1, 5.0), (None, None, 1, 4.0), (None, 1, 2, 6.0), (None, None, 2, 3.0), (None, None, 3, 9.0)]
    assert got == sorted(want, key=str)
    assert sorted(r["level"] for r in cubes.rollup(df, ["x", "y"], {"n": F.count("*")}).collect()) == [0, 0, 0, 1, 1, 3]


def test_one_pass_for_all_levels(spark):
    df = spark.range(1000).select((F.col("id") % 7).alias("x"), (F.col("id") % 5).alias("y"), "id")
    plan = cubes.cube(df, ["x", "y"], {"n": F.count("*")})._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("Expand") == 1


def test_pivot_and_odd_input(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (1, "z"), (2, None), (3, "b")], "k int, c string")
    assert sorted(map(tuple, cubes.pivot(df, ["k"], "c", ["a", "b"], F.count(F.lit(1)), "rest").collect())) == [(1, 2, None, 1), (2, None, None, 1), (3, None, 1, None)]
    assert cubes.pivot(df.limit(0), ["k"], "c", ["a"], F.count(F.lit(1))).columns == ["k", "a"]
    assert [tuple(r) for r in cubes.grouping_sets(df.limit(0), ["k"], [["k"], []], {"n": F.count("*")}).collect()] == []
    with pytest.raises(ValueError, match="columns"):
        cubes.grouping_sets(df, ["k"], [["c"]], {"n": F.count("*")})
    with pytest.raises(ValueError, match="sets"):
        cubes.cube(df, ["k"] * 7, {"n": F.count("*")})
