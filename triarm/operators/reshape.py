"""Wide to long and back."""

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from triarm.functions.fixed_values import EFFECT_NAMES, EFFECTS
from triarm.functions.naming import recode
from triarm.operators.prefix import fits, total_before

MELT_KEYS = ("num_test", "pair", "lm_type", "dataset")


def with_pair(df: DataFrame, group: Sequence[str] = ("lm_type",)) -> DataFrame:
    """Running index of the subsamples of an LM type, ordered by dataset and subsample.

    The same subsample has the same index for every LM type that covers the same
    datasets, as it is drawn with the same seed.
    """
    if fits(df, group):
        order = Window.partitionBy(*group).orderBy("dataset", "subsample_idx")
        return df.withColumn("pair", F.row_number().over(order).cast("bigint") - 1)
    placed = total_before(df, "_at", [*group, "dataset"], F.col("subsample_idx"), [F.col("subsample_idx")])
    # Datasets are few; their sizes give each its first index.
    sizes = df.groupBy(*group, "dataset").agg(F.count(F.lit(1)).alias("_size"))
    earlier = Window.partitionBy(*group).orderBy("dataset").rowsBetween(Window.unboundedPreceding, -1)
    first = sizes.select(*group, "dataset", F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_first"))
    joined = placed.join(first, [*group, "dataset"])
    return joined.withColumn("pair", F.col("_first") + F.col("_at")).drop("_first", "_at")


def melt_num_correct(
    df: DataFrame, names: Sequence[str] = tuple(EFFECTS), id_vars: Sequence[str] = MELT_KEYS,
    group: Sequence[str] = ("lm_type",),
) -> DataFrame:
    """One row per effect, subsample and method: ``(effect, *id_vars, method, num_correct)``. Subsamples are indexed once."""
    keys = list(dict.fromkeys(["num_test", "lm_type", *id_vars]))
    paired = with_pair(df, group) if "pair" in keys else df
    rows = [
        F.struct(F.lit(name).alias("effect"), F.lit(arm).alias("method"), F.col(arm).alias("num_correct"))
        for name in names for arm in reversed(EFFECTS[name])
    ]
    return paired.select(*keys, F.inline(F.array(*rows))).select("effect", *keys, "method", "num_correct")


def melt_differences(df: DataFrame, keys: Sequence[str] = ("dataset",)) -> DataFrame:
    """Both effects as rows, under their display names."""
    wide = df.select(*keys, *[(F.col(t) - F.col(c)).alias(e) for e, (t, c) in EFFECTS.items()])
    long = wide.unpivot(list(keys), list(EFFECTS), "distribution", "diff")
    return long.withColumn("distribution", recode(F.col("distribution"), EFFECT_NAMES))


def pivot_predictions(
    melted: DataFrame, predictions: DataFrame, treatment: str, control: str, id_vars: Sequence[str] = MELT_KEYS
) -> DataFrame:
    """Replace ``num_correct`` by predicted values and spread the methods into columns.

    Predictions are matched by key, not by row order.
    """
    keys = [*id_vars, "method"]
    filled = melted.drop("num_correct").join(predictions.select(*keys, "pred"), keys)
    wide = filled.groupBy(*id_vars).pivot("method", [treatment, control]).agg(F.max("pred"))
    return wide.drop("pair")


def union_runs(*runs: DataFrame) -> DataFrame:
    """Concatenate result tables by column name."""
    whole = runs[0]
    for run in runs[1:]:
        whole = whole.unionByName(run, allowMissingColumns=True)
    return whole
