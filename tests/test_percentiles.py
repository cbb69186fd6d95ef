"""Nearest rank against sorting, for few and many ranges, on skewed groups."""

import random

import pytest

from lexframe.operators.percentiles import nearest_rank, nearest_ranks, widen

PERCENTS = [0, 10, 25, 50, 75, 95, 99, 100]


def expected(values, p):
    ordered = sorted(values)
    return ordered[min(int(len(ordered) * p / 100), len(ordered) - 1)]


def groups(seed):
    rng = random.Random(seed)
    return {
        "hot": [round(rng.expovariate(0.2), 3) for _ in range(9000)],
        "same": [5.0] * 3000,
        "tails": [rng.choice([-1e9, 0.0, 1e-9, 1e12]) for _ in range(2000)],
        "tiny": [3.0, 1.0],
        "one": [-2.5],
    }


@pytest.mark.parametrize("ranges", [None, 1, 60])
def test_groups(spark, ranges):
    data = groups(1)
    data[None] = [7.0, 7.0, 1.5]  # a group like any other
    rows = [(g, v) for g, values in data.items() for v in values] + [("hot", None), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(7)
    found = {(r.g, r.percent): r.value
             for r in nearest_rank(df, "v", PERCENTS, ["g"], ranges).collect()}
    assert found == {(g, p): expected(v, p) for g, v in data.items() for p in PERCENTS}


@pytest.mark.parametrize("ranges", [None, 40])
def test_without_groups(spark, ranges):
    values = groups(2)["hot"]
    df = spark.createDataFrame([(v,) for v in values], "v double").repartition(5)
    row = widen(nearest_rank(df, "v", [50, 90], ranges=ranges), [50, 90]).first()
    assert (row.p50, row.p90) == (expected(values, 50), expected(values, 90))


def test_rank_differs_from_the_lower_one_on_whole_numbers(spark):
    df = spark.createDataFrame([(float(i),) for i in range(10)], "v double")
    assert nearest_rank(df, "v", [50]).first().value == 5.0


def test_columns_together(spark):
    rng = random.Random(4)
    rows = [(rng.choice("ab"), rng.gauss(0, 1), rng.choice([None, 1, 2, 3])) for _ in range(800)]
    df = spark.createDataFrame(rows, "g string, x double, y int")
    found = {(r.g, r.column, r.percent): r.value
             for r in nearest_ranks(df, ["x", "y"], [0, 50, 90], ["g"], 9).collect()}
    for g in "ab":
        for column, i in (("x", 1), ("y", 2)):
            values = [r[i] for r in rows if r[0] == g and r[i] is not None]
            assert {p: found[g, column, p] for p in (0, 50, 90)} == {
                p: expected(values, p) for p in (0, 50, 90)}


def test_only_the_range_of_a_rank_is_ordered(spark):
    df = spark.range(40_000).selectExpr("id % 3 as g", "cast(hash(id) as double) as v")
    plan = nearest_rank(df, "v", [50], ["g"], 30)._jdf.queryExecution().optimizedPlan().toString()
    assert "percent" in plan and "__range" in plan.split("Window")[1]


def test_empty(spark):
    assert nearest_rank(spark.createDataFrame([], "v double"), "v", [50]).count() == 0
