"""Paired differences and their grouped means and standard errors.

Subsamples of one dataset are technical replicates: they are averaged first, and
the spread is taken over datasets. The mean of means is not one flat mean.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from triarm.functions.fixed_values import ACCURACY_COLUMNS, EFFECTS, REPLICATE_GROUP
from triarm.functions.scoring import standard_error
from triarm.operators.validate import InvalidDataError, require_equal_replicates


def effect(name: str) -> Column:
    treatment, control = EFFECTS[name]
    return F.col(treatment) - F.col(control)


def paired_differences(df: DataFrame) -> DataFrame:
    """Add ``boost`` and ``bias``."""
    return df.withColumns({name: effect(name) for name in EFFECTS})


def relative_difference(treatment: str, control: str) -> Column:
    """(treatment - control) / control, NULL where the control is 0."""
    return F.try_divide(F.col(treatment) - F.col(control), F.col(control))


def num_correct(df: DataFrame, num_test: Column, rounding: str = "trunc") -> DataFrame:
    """Accuracies as counts. ``trunc`` cuts like a cast (0.29 * 100 -> 28), ``round`` gives the true count."""
    if rounding not in ("trunc", "round"):
        raise ValueError("rounding is 'trunc' or 'round'")
    count = (lambda c: F.round(c)) if rounding == "round" else (lambda c: c)
    counts = {c: count(F.col(c) * num_test).cast("bigint") for c in ACCURACY_COLUMNS if c in df.columns}
    return df.withColumns(counts).withColumn("num_test", num_test.cast("int"))


def difference_summary(df: DataFrame, diff: Column, groups: Sequence[str] = ("dataset",)) -> DataFrame:
    """Mean and standard error per group, which must hold equally many replicates."""
    replicates = require_equal_replicates(df)
    return df.withColumn("_diff", diff).groupBy(*groups).agg(
        F.avg("_diff").alias("mean"),
        (F.stddev_samp("_diff") / F.sqrt(F.lit(float(replicates)))).alias("se"),
    )


def effects_of_groups(df: DataFrame, treatment: str, control: str, groups: Sequence[str] = ("dataset",)) -> DataFrame:
    """Mean and standard error of the raw and the relative effect per group; groups must hold equally many replicates."""
    require_equal_replicates(df, groups)
    raw, relative = F.col(treatment) - F.col(control), relative_difference(treatment, control)
    return df.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("n"), F.avg(raw).alias("raw_mean"), standard_error(raw).alias("raw_se"),
        F.avg(relative).alias("relative_mean"), standard_error(relative).alias("relative_se"))


def overall_difference(df: DataFrame, treatment: str, control: str) -> DataFrame:
    """Raw and relative effect over dataset means; datasets are the replicates."""
    diffs = {
        "raw": F.col(treatment) - F.col(control),
        "relative": relative_difference(treatment, control),
    }
    per_dataset = df.groupBy("dataset").agg(*[F.avg(d).alias(k) for k, d in diffs.items()])
    n = F.sqrt(F.count(F.lit(1)))
    overall = per_dataset.agg(
        *[F.struct(F.lit(k).alias("difference"), F.avg(k).alias("mean"), (F.stddev_samp(k) / n).alias("se")).alias(k)
          for k in diffs]
    )
    return overall.select(F.inline(F.array(*diffs)))


def two_level_summary(df: DataFrame, diff: Column, groups: Sequence[str] = ("num_test", "lm_type")) -> DataFrame:
    """Mean over subsamples per dataset, then mean and standard error over datasets."""
    means = df.groupBy(*groups, "dataset").agg(F.avg(diff).alias("_mean"))
    return means.groupBy(*groups).agg(F.avg("_mean").alias("mean"), standard_error(F.col("_mean")).alias("se"))


def summary_table(df: DataFrame, groups: Sequence[str] = ("num_train", "num_test", "lm_type")) -> DataFrame:
    """Two-level summary of both effects, one row per group and effect.

    Both effects ride along as columns and become rows only at the end.
    """
    means = df.groupBy(*groups, "dataset").agg(*[F.avg(effect(e)).alias(e) for e in EFFECTS])
    both = means.groupBy(*groups).agg(*[
        F.struct(F.lit(e).alias("effect"), F.avg(e).alias("mean"), standard_error(F.col(e)).alias("se")).alias(e)
        for e in EFFECTS
    ])
    return both.select(*groups, F.inline(F.array(*EFFECTS)))


def group_stats(df: DataFrame, groups: Sequence[str] = REPLICATE_GROUP) -> DataFrame:
    """Mean and standard error of both effects per replicate group."""
    stats = []
    for e in EFFECTS:
        stats += [F.avg(effect(e)).alias(f"{e}_mean"), standard_error(effect(e)).alias(f"{e}_se")]
    return df.groupBy(*groups).agg(*stats)


def beyond(stats: DataFrame, threshold: float, column: str = "bias_mean") -> DataFrame:
    """Groups whose effect is above the threshold, or below it for a negative one."""
    return stats.where(F.col(column) > threshold if threshold >= 0 else F.col(column) < threshold)


def dataset_rollup(stats: DataFrame) -> DataFrame:
    """Mean effects per dataset, and how often their sign surprises."""
    return stats.groupBy("dataset").agg(
        F.avg("boost_mean").alias("boost_mean"),
        F.avg("bias_mean").alias("bias_mean"),
        F.avg((F.col("boost_mean") < 0).cast("double")).alias("frac_boost_lt_0"),
        F.avg((F.col("bias_mean") > 0).cast("double")).alias("frac_bias_gt_0"),
    )


def first_majority(df: DataFrame, groups: Sequence[str] = REPLICATE_GROUP) -> DataFrame:
    """Number of classes, and the majority share of the first subsample."""
    return df.groupBy(*groups).agg(
        F.max("num_classes").alias("num_classes"), F.min_by("majority", "subsample_idx").alias("majority")
    )


def drop_outliers(
    df: DataFrame, threshold: float, arms: Sequence[str] = ("extra", "test"), expected: int | None = None,
) -> DataFrame:
    """Keep replicates where all the arms are above the threshold.

    With ``expected``, another number of dropped replicates is an error.
    """
    above = F.lit(True)
    for arm in arms:
        above = above & F.coalesce(F.col(arm) > threshold, F.lit(False))
    if expected is not None:
        dropped = df.where(~above).count()
        if dropped != expected:
            raise InvalidDataError(f"{dropped} outliers, expected {expected}")
    return df.where(above)
