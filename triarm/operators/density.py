"""Distribution curves: density, cumulative share."""

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from triarm.operators.prefix import join_groups, positions_by_value, value_ranks

GRID_POINTS = 200  # fixed value: points of a density curve
CUT = 3.0  # fixed value: bandwidths the curve goes beyond the data
DECIMALS = 9


def kernel_density(
    df: DataFrame, value: str, group: Sequence[str], points: int = GRID_POINTS, cut: float = CUT
) -> DataFrame:
    """Gaussian kernel density on an even grid, bandwidth by Scott's rule.

    A value is dealt out to the two grid points beside it, more to the nearer one. So a group is ``points`` weights, however
    many values it has, and its curve is the convolution of the weights with one kernel, made within a row. Beside the
    curve of the values themselves it is off by at most ``step^2 / (8 h^2)`` of one kernel's peak, ``h`` being the bandwidth.
    """
    rows = df.select(*group, F.round(value, DECIMALS).alias("_v")).where("_v is not null")
    stats = rows.groupBy(*group).agg(
        F.count(F.lit(1)).cast("double").alias("_all"), F.stddev_samp("_v").alias("_sd"),
        F.min("_v").alias("_min"), F.max("_v").alias("_max"),
    ).where("_sd > 0").withColumn("_h", F.col("_sd") * F.pow(F.col("_all"), F.lit(-0.2)))
    low = F.col("_min") - cut * F.col("_h")
    step = (F.col("_max") - F.col("_min") + 2 * cut * F.col("_h")) / (points - 1)
    grid = stats.select(*group, "_all", "_h", low.alias("_low"), step.alias("_step"))

    at = join_groups(rows, grid, group).withColumn("_at", (F.col("_v") - F.col("_low")) / F.col("_step"))
    cell = F.least(F.floor("_at"), F.lit(points - 2)).cast("int")
    cells = at.groupBy(*group, cell.alias("_cell")).agg(
        F.count(F.lit(1)).cast("double").alias("_n"), F.sum(F.col("_at") - cell).alias("_above"))
    both = F.array(F.struct(F.col("_cell").alias("p"), (F.col("_n") - F.col("_above")).alias("w")),
                   F.struct((F.col("_cell") + 1).alias("p"), F.col("_above").alias("w")))
    # At most two weights a cell.
    weights = cells.groupBy(*group).agg(F.sort_array(F.flatten(F.collect_list(both))).alias("_weights"))
    curve = join_groups(weights, grid, group)

    numbers = F.sequence(F.lit(0), F.lit(points - 1))
    away = lambda k: k * F.col("_step") / F.col("_h")
    kernel = F.transform(numbers, lambda k: F.exp(-0.5 * away(k) * away(k)))
    mass = lambda i: F.aggregate("_weights", F.lit(0.0), lambda sum_, x: sum_ + x["w"] * F.get("_kernel", F.abs(i - x["p"])))
    convolved = curve.withColumn("_kernel", kernel).withColumn("_mass", F.transform(numbers, mass))
    scale = F.col("_all") * F.col("_h") * math.sqrt(2 * math.pi)
    return convolved.select(*group, "_low", "_step", scale.alias("_scale"), F.posexplode("_mass").alias("point", "_sum")).select(
        *group, "point", (F.col("_low") + F.col("point") * F.col("_step")).alias("x"), (F.col("_sum") / F.col("_scale")).alias("density"))


def cumulative_share(df: DataFrame, value: str, group: Sequence[str]) -> DataFrame:
    """Distinct values with the share of rows at or below them."""
    ranks = value_ranks(df, group, value)
    sizes = ranks.groupBy(*group).agg(F.sum("n").alias("_all"))
    return join_groups(ranks, sizes, group).select(
        *group, value, "n", ((F.col("before") + F.col("n")) / F.col("_all")).alias("ecdf")
    )


def share_below(df: DataFrame, value: str, threshold: float, group: Sequence[str]) -> DataFrame:
    """Where ``-threshold`` and ``threshold`` fall in the sorted values, as shares."""
    below = lambda t: F.avg((F.col(value) < t).cast("double"))
    return df.groupBy(*group).agg(below(-threshold).alias("below_minus"), below(threshold).alias("below_plus"))


def interval_band(df: DataFrame, value: str, tie: str, group: Sequence[str], low: str, high: str) -> DataFrame:
    """Intervals ordered by their mean: height ``i / n`` for the i-th smallest."""
    placed = positions_by_value(df, "_pos", group, value, tie)
    sizes = df.groupBy(*group).agg(F.count(value).alias("_all"))
    return join_groups(placed, sizes, group).select(
        *group, tie, (F.col("_pos") / F.col("_all")).alias("height"), value, low, high
    )
