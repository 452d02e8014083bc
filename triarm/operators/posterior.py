"""Summaries of long draw tables.

A draw table has one row per (effect, subsample, method, draw): a predicted count
``pred`` out of ``num_test``. All sums are plain aggregates keyed by draw, so the
table is read once and combined before it is shuffled.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from triarm.functions.fixed_values import EFFECTS
from triarm.operators.prefix import join_groups, total_before
from triarm.sources.scratch import stored

HDI_SHARE = 0.89  # fixed value: share of draws inside the reported interval


def _method(which: int) -> Column:
    """Name of the treatment (0) or control (1) of the row's effect."""
    return F.create_map(*[F.lit(x) for e, pair in EFFECTS.items() for x in (e, pair[which])])[F.col("effect")]


def _method_mean(which: int) -> Column:
    return F.avg(F.when(F.col("method") == _method(which), F.col("pred")))


def conditional_differences(
    draws: DataFrame, group: Sequence[str] = ("num_test", "lm_type", "dataset")
) -> DataFrame:
    """Per draw and group: mean treatment and control counts and ``acc_diff``.

    Where every subsample has both methods in a draw, the mean of the differences is
    the difference of the means and no join back to pairs is needed. That is checked in
    the same aggregate: a draw in which the subsamples of the methods differ fails.
    """
    pair = F.xxhash64(*[c for c in draws.columns if c not in ("method", "pred")])
    sides = [F.when(F.col("method") == _method(i), pair) for i in (0, 1)]
    means = draws.groupBy("effect", *group, "draw").agg(
        _method_mean(0).alias("treatment"), _method_mean(1).alias("control"),
        *[F.struct(F.count(s).alias("n"), F.bit_xor(s).alias("x")).alias(f"_side{i}") for i, s in enumerate(sides)],
    )
    unpaired = F.raise_error(F.lit("a draw has subsamples with only one of its two methods")).cast("double")
    difference = F.when(F.col("_side0") == F.col("_side1"), (F.col("treatment") - F.col("control")) / F.col("num_test"))
    return means.withColumn("acc_diff", difference.otherwise(unpaired)).drop("_side0", "_side1")


def marginal_differences(draws: DataFrame, group: Sequence[str] = ("num_test",)) -> DataFrame:
    """Per draw: mean accuracy difference over all subsamples, effects side by side."""
    per_effect = conditional_differences(draws, group)
    return per_effect.groupBy(*group, "draw").pivot("effect", list(EFFECTS)).agg(F.max("acc_diff"))


def calibration(draws: DataFrame, observed: DataFrame, effect: str, group: Sequence[str]) -> DataFrame:
    """Predicted against observed control accuracy and effect of each group."""
    treatment, control = EFFECTS[effect]
    mean = lambda method: F.avg(F.when(F.col("method") == method, F.col("pred") / F.col("num_test")))
    pred = draws.groupBy(*group).agg(
        mean(control).alias("pred_level"), (mean(treatment) - mean(control)).alias("pred_effect")
    )
    obs = observed.groupBy(*group).agg(
        F.avg(F.col(control) / F.col("num_test")).alias("obs_level"),
        F.avg((F.col(treatment) - F.col(control)) / F.col("num_test")).alias("obs_effect"),
    )
    return pred.join(obs, list(group))


def highest_density(draws: DataFrame, group: Sequence[str], value: str, tie: str, share: float = HDI_SHARE) -> DataFrame:
    """Narrowest interval over ``floor(share * n)`` steps of the sorted draws, the first of equals.

    Each draw is sent to its own position as lower
    end and ``floor(share * n)`` positions back as upper end, where the two meet in
    an aggregate; a group of any size is spread over many tasks.
    """
    rows = draws.where(F.col(value).isNotNull()).select(*group, value, tie)
    sizes = rows.groupBy(*group).agg(F.floor(share * F.count(F.lit(1))).alias("_steps"))
    placed = total_before(join_groups(rows, sizes, group), "_pos", group, F.col(value), [F.col(value), F.col(tie)])
    nothing = F.lit(None).cast("double")
    low = F.struct(F.col("_pos"), F.col(value).alias("_lo"), nothing.alias("_hi"))
    high = F.struct((F.col("_pos") - F.col("_steps")).alias("_pos"), nothing.alias("_lo"), F.col(value).alias("_hi"))
    ends = placed.select(*group, F.inline(F.array(low, high)))
    spans = ends.groupBy(*group, "_pos").agg(F.max("_lo").alias("_lo"), F.max("_hi").alias("_hi"))
    width = F.struct(F.round(F.col("_hi") - F.col("_lo"), 9), F.col("_pos"))
    return spans.where("_lo is not null and _hi is not null").groupBy(*group).agg(
        F.min_by("_lo", width).alias("hdi_low"), F.min_by("_hi", width).alias("hdi_high")
    )


def draw_summary(draws: DataFrame, group: Sequence[str], value: str, tie: str, share: float = HDI_SHARE) -> DataFrame:
    """Mean, standard deviation and highest-density interval of the draws."""
    draws = stored(draws.select(*group, value, tie), "draws")
    moments = draws.groupBy(*group).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))
    return join_groups(moments, highest_density(draws, group, value, tie, share), group)


def extreme_share(summaries: DataFrame, threshold: float, group: Sequence[str] = ()) -> DataFrame:
    """Share of means beyond the threshold, and how many of those exclude 0."""
    extreme = F.abs("mean") > threshold
    one_sided = (F.col("hdi_low") > 0) == (F.col("hdi_high") > 0)
    return summaries.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(extreme.cast("double")).alias("extreme_share"),
        F.avg(F.when(extreme, one_sided.cast("double"))).alias("one_sided_share"),
    )
