"""Splits: sizes, disjointness, balance, reproducibility, and the exact fallback."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from triarm.operators import sampling
from triarm.operators.validate import InvalidDataError


def make(spark, sizes, dataset="a"):
    rows, i = [], 0
    for label, n in enumerate(sizes):
        for _ in range(n):
            rows.append((dataset, i, label))
            i += 1
    return spark.createDataFrame(rows, "dataset string, row_id long, label int")


def as_set(df):
    return {tuple(r) for r in df.select("dataset", "subsample_idx", "row_id", "role").collect()}


def brute_force(rows, num_train, num_test, replicates):
    """The definition, one replicate at a time."""
    md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
    part = lambda digest, i: int(digest[7 * i:7 * i + 7], 16)

    def key(salt, seed, row):
        s, r = md5(f"{salt}|{seed}"), md5(str(row))
        mixed = (part(s, 0) * part(r, 0) + part(s, 1) * part(r, 1) + part(s, 2)) % (2**31 - 1)
        return mixed, md5(f"{seed}|{row}"), row

    out = set()
    datasets = {r[0] for r in rows}
    for dataset in datasets:
        mine = [(i, label) for d, i, label in rows if d == dataset]
        labels = {label for _, label in mine}
        quota = num_train // len(labels)
        for s in range(1, replicates + 1):
            train = []
            for label in labels:
                ids = sorted((i for i, k in mine if k == label), key=lambda i: key("train", 42 + s, i))
                train += ids[:quota]
            rest = sorted((i for i, _ in mine if i not in set(train)), key=lambda i: key("rest", 42 + s, i))
            out |= {(dataset, s, i, "train") for i in train}
            out |= {(dataset, s, i, "extra") for i in rest[:num_test]}
            out |= {(dataset, s, i, "test") for i in rest[num_test:2 * num_test]}
    return out


@pytest.mark.parametrize("slack", [6.0, 0.0, -2.0])
def test_equals_definition_also_when_the_cut_is_too_low(spark, slack):
    df = make(spark, [300, 40, 15]).unionByName(make(spark, [60, 70], "b"))
    rows = [tuple(r) for r in df.collect()]
    splits = sampling.replicate_splits(df, 20, 25, 6, by=["dataset"], slack=slack)
    assert as_set(splits) == brute_force(rows, 20, 25, 6)


def test_every_row_is_drawn_equally_often(spark):
    df = make(spark, [60, 60])
    splits = sampling.replicate_splits(df, 20, 20, 600, by=["dataset"])
    for role, share in (("train", 20 / 120), ("extra", 20 / 120), ("test", 20 / 120)):
        counts = splits.where(F.col("role") == role).groupBy("row_id").count().toPandas()["count"]
        assert len(counts) == 120
        expected, spread = 600 * share, (600 * share * (1 - share)) ** 0.5
        assert abs(counts - expected).max() < 4.5 * spread
        assert 0.6 < counts.std() / spread < 1.4


def test_rows_are_drawn_together_by_chance_only(spark):
    splits = sampling.replicate_splits(make(spark, [60, 60]), 20, 20, 400, by=["dataset"])
    drawn = splits.where("role = 'test'").toPandas()
    member = drawn.assign(x=1).pivot(index="subsample_idx", columns="row_id", values="x").fillna(0)
    pairs = member.T.dot(member).to_numpy()[~np.eye(120, dtype=bool)]
    chance = 400 * (20 / 120) * (19 / 119)
    assert abs(pairs.mean() - chance) < 0.5
    assert pairs.std() < 1.4 * chance**0.5


def test_sizes_disjoint_and_balanced(spark):
    splits = sampling.replicate_splits(make(spark, [500, 30, 30]), 20, 30, 4, by=["dataset"])
    counts = {(r["subsample_idx"], r["role"]): r["count"] for r in splits.groupBy("subsample_idx", "role").count().collect()}
    for s in range(1, 5):
        assert counts[s, "train"] == 18  # floor(20 / 3) per class
        assert counts[s, "extra"] == counts[s, "test"] == 30
    assert splits.count() == splits.select("subsample_idx", "row_id").distinct().count()
    balance = splits.where("role = 'train'").groupBy("subsample_idx", "label").count()
    assert {r["count"] for r in balance.collect()} == {6}


def test_partitioning_does_not_change_the_draw(spark):
    df = make(spark, [200, 100])
    one = sampling.replicate_splits(df.repartition(1), 20, 30, 3, by=["dataset"])
    many = sampling.replicate_splits(df.repartition(13, "row_id"), 20, 30, 3, by=["dataset"])
    assert as_set(one) == as_set(many)


def test_test_rows_depend_on_the_train_size_only_through_removed_rows(spark):
    df = make(spark, [100, 100])
    a = as_set(sampling.replicate_splits(df, 20, 30, 2, by=["dataset"]))
    b = as_set(sampling.replicate_splits(df, 20, 30, 2, by=["dataset"]))
    c = as_set(sampling.replicate_splits(df, 60, 30, 2, by=["dataset"]))
    test = lambda rows: {r for r in rows if r[3] == "test"}
    assert test(a) == test(b) != test(c)


@pytest.mark.parametrize("sizes, train, test", [([50, 50], 1, 5), ([100, 3], 20, 5), ([30, 30], 20, 21)])
def test_impossible_draws_are_refused(spark, sizes, train, test):
    with pytest.raises(InvalidDataError):
        sampling.replicate_splits(make(spark, sizes), train, test, 2, by=["dataset"])


def test_stratified_sample(spark):
    sample = sampling.stratified_sample(make(spark, [80, 20]).drop("dataset"), 11)
    assert {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()} == {0: 5, 1: 5}


def test_down_sample(spark):
    df = spark.range(200).select(
        F.lit("lm").alias("lm_type"), (F.col("id") % 4).cast("string").alias("dataset"), "id"
    )
    for size in (1, 7):
        sample = sampling.down_sample(df, ["id"], size)
        assert {r["count"] for r in sample.groupBy("dataset").count().collect()} == {size}
    other = sampling.down_sample(df, ["id"], 7, seed=1)
    assert other.join(sampling.down_sample(df, ["id"], 7), "id").count() < 28


def test_null_labels_are_refused(spark):
    rows = spark.createDataFrame([(i, None if i % 9 == 0 else i % 2) for i in range(300)], "row_id long, label int")
    with pytest.raises(InvalidDataError, match="NULL"):
        sampling.stratified_sample(rows, 30)
