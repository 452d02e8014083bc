"""Descriptive statistics."""

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from triarm.functions.draws import draw_key
from triarm.operators.prefix import join_groups, value_ranks

EXAMPLE_CHARACTERS = 30  # fixed value: how much of an example text is shown
QUARTILES = {"25%": 0.25, "50%": 0.5, "75%": 0.75}


def describe_texts(df: DataFrame, key: Sequence[str] = ("dataset",)) -> DataFrame:
    """Rows, classes, linear text-length quartiles (cut to ints) and a random example.

    Lengths are small integers: the exact percentile keeps a count per length, not
    the rows, and only the cut example travels with its hash.
    """
    rows = df.select(
        *key, "label", F.length("text").alias("_length"),
        F.left("text", F.lit(EXAMPLE_CHARACTERS)).alias("_example"),
        draw_key("example", F.col("row_id")).alias("_key"),
    )
    quartile = lambda q: F.percentile("_length", F.lit(q)).cast("bigint")
    described = rows.groupBy(*key).agg(
        F.count(F.lit(1)).alias("n_rows"),
        quartile(0.25).alias("length_25"),
        quartile(0.75).alias("length_75"),
        F.min_by("_example", "_key").alias("example"),
        # The distinct labels of a dataset are its classes: a short array.
        F.size(F.collect_set("label")).cast("bigint").alias("num_classes"),
    )
    return described


def class_range(described: DataFrame) -> DataFrame:
    """Smallest and largest number of classes, and the number of datasets."""
    return described.agg(
        F.min("num_classes").alias("min_classes"), F.max("num_classes").alias("max_classes"),
        F.count(F.lit(1)).alias("n_datasets"),
    )


def describe_series(df: DataFrame, value: str, group: Sequence[str] = ()) -> DataFrame:
    """Count, NULLs, mean, deviation, range and nearest-rank quartiles, as rows.

    The quartile is the value at position ``round((n - 1) * q)``. Values are counted
    first; the one whose copies cover the position is the quartile.
    """
    keys = list(group)
    moments = df.groupBy(*keys).agg(
        F.count(value).cast("double").alias("count"),
        F.count_if(F.col(value).isNull()).cast("double").alias("null_count"),
        F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("std"),
        F.min(value).cast("double").alias("min"),
        F.max(value).cast("double").alias("max"),
    )
    placed = join_groups(value_ranks(df, keys, value), moments.select(*keys, "count"), keys)
    quartiles = []
    for name, q in QUARTILES.items():
        position = F.floor((F.col("count") - 1) * F.lit(q) + F.lit(0.5))
        covers = (F.col("before") <= position) & (position < F.col("before") + F.col("n"))
        quartiles.append(F.max(F.when(covers, F.col(value)).cast("double")).alias(name))
    wide = join_groups(moments, placed.groupBy(*keys).agg(*quartiles), keys)
    return wide.unpivot(keys, [c for c in wide.columns if c not in keys], "statistic", "value")

