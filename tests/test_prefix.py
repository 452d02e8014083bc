"""Ordered totals equal plain window functions, in whichever way they are made."""

import random

import pytest
from pyspark.sql import Window, functions as F

from triarm.operators import describe, prefix
from triarm.operators.leaderboard import rank_gaps


@pytest.fixture(scope="module")
def skewed(spark):
    rng = random.Random(3)
    rows = []
    for i in range(3000):
        group = None if i % 50 == 0 else ("hot" if rng.random() < 0.7 else rng.choice("abc"))
        value = 0.5 if rng.random() < 0.4 else round(rng.gauss(0, 1), 3)
        rows.append((group, i, value))
    return spark.createDataFrame(rows, "g string, id long, v double").repartition(7)


@pytest.fixture(params=["window", "parts"])
def way(request, monkeypatch):
    """Both ways: groups that fit one task, and groups that are cut."""
    if request.param == "parts":
        monkeypatch.setattr(prefix, "ROWS", 150)
    return request.param


def test_positions(skewed, way):
    got = prefix.total_before(skewed, "pos", ["g"], F.col("id"), [F.col("id")])
    want = F.row_number().over(Window.partitionBy("g").orderBy("id")) - 1
    assert got.count() == 3000 and got.columns == ["g", "id", "v", "pos"]
    assert got.withColumn("want", want).where("pos <> want").isEmpty()


def test_positions_by_named_parts(skewed):
    got = prefix.total_before(skewed, "pos", ["g"], F.col("id"), [F.col("id")], part=F.floor(F.col("id") / 100))
    want = F.row_number().over(Window.partitionBy("g").orderBy("id")) - 1
    assert got.count() == 3000
    assert got.withColumn("want", want).where("pos <> want").isEmpty()


def test_weighted_totals_without_group(skewed, way):
    got = prefix.total_before(skewed, "before", [], F.col("id"), [F.col("id")], F.col("id"))
    rows = {r["id"]: r["before"] for r in got.collect()}
    assert all(rows[i] == i * (i - 1) // 2 for i in range(3000))


def test_minimum_from(skewed, way):
    value = F.abs(F.hash("id"))
    got = prefix.minimum_from(skewed, "low", ["g"], "id", value)
    want = F.min(value).over(Window.partitionBy("g").orderBy(F.col("id").desc()).rowsBetween(Window.unboundedPreceding, 0))
    assert got.count() == 3000
    assert got.withColumn("want", want).where("low <> want").isEmpty()


def test_mid_ranks(skewed, way):
    rows = skewed.where("v is not null")
    got = prefix.mid_ranks(rows, "r", ["g"], "v")
    values = Window.partitionBy("g").orderBy("v")
    want = F.rank().over(values) + (F.count(F.lit(1)).over(Window.partitionBy("g", "v")) - 1) / 2.0
    assert got.count() == rows.count()
    assert got.withColumn("want", want).where("r <> want").isEmpty()


@pytest.mark.parametrize("values", ["sparse ids", "outlier", "both ends"])
def test_parts_are_even_whatever_the_values(spark, values):
    rng = random.Random(8)
    n = 40_000
    made = {
        "sparse ids": lambda i: rng.getrandbits(63) - 2**62,
        "outlier": lambda i: 2**62 if i == 0 else i,
        "both ends": lambda i: rng.choice([-1, 1]) * int(rng.expovariate(1) * 10**15),
    }[values]
    df = spark.createDataFrame([("hot" if i % 4 else "small", made(i)) for i in range(n)], "g string, id long").distinct()
    cut = prefix.with_parts(df, ["g"], F.col("id"), 1000)
    sizes = sorted(r["count"] for r in cut.where("g = 'hot'").groupBy("_part").count().collect())
    assert len(sizes) > 30 and sizes[-1] <= 3 * sizes[len(sizes) // 2]
    order = cut.groupBy("g", "_part").agg(F.min("id").alias("a"), F.max("id").alias("b")).orderBy("g", "_part").collect()
    assert all(x["g"] != y["g"] or x["b"] < y["a"] for x, y in zip(order, order[1:]))
    got = prefix.total_before(df, "pos", ["g"], F.col("id"), [F.col("id")], rows=1000)
    want = F.row_number().over(Window.partitionBy("g").orderBy("id")) - 1
    assert got.withColumn("want", want).where("pos <> want").isEmpty()


def test_value_ranks(skewed, way):
    ranks = prefix.value_ranks(skewed, ["g"], "v")
    want = skewed.withColumn("r", F.rank().over(Window.partitionBy("g").orderBy("v")) - 1).groupBy("g", "v").agg(
        F.max("r").alias("r"), F.count(F.lit(1)).alias("c")
    )
    both = ranks.alias("a").join(want.alias("b"), F.expr("a.g <=> b.g and a.v = b.v"))
    assert both.count() == want.count() == ranks.count()
    assert both.where("before <> r or n <> c").isEmpty()


@pytest.mark.parametrize("descending", [False, True])
def test_positions_by_value(skewed, descending, way):
    got = prefix.positions_by_value(skewed, "pos", ["g"], "v", "id", descending)
    order = F.col("v").desc() if descending else F.col("v")
    want = F.row_number().over(Window.partitionBy("g").orderBy(order, "id")) - 1
    assert got.count() == 3000
    assert got.withColumn("want", want).where("pos <> want").isEmpty()


def test_constant_values(spark):
    df = spark.createDataFrame([(1, 2.0), (2, 2.0), (3, None)], "id long, v double")
    assert [tuple(r) for r in prefix.value_ranks(df, [], "v").collect()] == [(2.0, 2, 0)]


def test_rank_gaps(spark):
    df = spark.createDataFrame([(1, 0.5), (2, 0.8), (3, 0.5), (4, 0.9)], "id long, s double")
    rows = {r["rank"]: r for r in rank_gaps(df, "s", "id").collect()}
    assert {k: (r["score"], r["next_score"]) for k, r in rows.items()} == {1: (0.9, 0.8), 2: (0.8, 0.5), 3: (0.5, 0.5)}
    assert rows[2]["odds_ratio"] == pytest.approx(4.0)
    assert rows[3]["gap"] == 0


def test_describe_series_uses_nearest_rank(spark):
    df = spark.createDataFrame([(float(x),) for x in (5, 1, 4, 2, 3, 10)] + [(None,)], "v double")
    stats = {r["statistic"]: r["value"] for r in describe.describe_series(df, "v").collect()}
    assert (stats["count"], stats["null_count"], stats["min"], stats["max"]) == (6, 1, 1, 10)
    assert (stats["25%"], stats["50%"], stats["75%"]) == (2, 4, 5)
