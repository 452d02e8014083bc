"""Rank correlation between two LM types over the same subsamples."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from triarm.functions.draws import draw_key
from triarm.functions.fixed_values import EFFECTS
from triarm.operators.prefix import mid_ranks, total_before
from triarm.operators.summary import effect

DECIMALS = 9  # differences equal at this many decimals are tied


def effect_rows(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per subsample and effect, rounded so that equal counts tie."""
    wide = df.select(*keys, *[F.round(effect(e), DECIMALS).alias(e) for e in EFFECTS])
    return wide.unpivot(list(keys), list(EFFECTS), "effect", "diff")


def spearman(df: DataFrame, group: Sequence[str], key: str, types: tuple[str, str]) -> DataFrame:
    """Correlation of mid-ranks of ``diff`` between two LM types, matched by ``key``.

    Both sides of a pair are ranked as one long series, and meet again in an aggregate by key. A key that an LM type has
    twice is an error. A group without spread has no correlation (NULL).
    """
    one = lambda t: F.max(F.when(F.col("lm_type") == t, F.col("diff")))
    twice = F.raise_error(F.lit("an LM type has two rows with one key")).cast("double")
    once = lambda t: F.when(F.count_if(F.col("lm_type") == t) <= 1, one(t)).otherwise(twice)
    sides = df.where(F.col("lm_type").isin(*types)).groupBy(*group, key).agg(
        once(types[0]).alias("_x"), once(types[1]).alias("_y"))
    long = sides.where("_x is not null and _y is not null").unpivot([*group, key], ["_x", "_y"], "_side", "_value")
    ranked = mid_ranks(long, "_rank", [*group, "_side"], "_value")
    rank = lambda side: F.max(F.when(F.col("_side") == side, F.col("_rank")))
    pairs = ranked.groupBy(*group, key).agg(rank("_x").alias("_rx"), rank("_y").alias("_ry"))
    total = lambda a, b: F.sum(F.col(a) * F.col(b))
    sums = pairs.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n"), total("_rx", "_ry").alias("_xy"), total("_rx", "_rx").alias("_xx"),
        total("_ry", "_ry").alias("_yy"))
    # Mid-ranks average (n + 1) / 2 whatever the ties.
    centre = F.col("n") * F.pow((F.col("n") + 1) / 2.0, F.lit(2))
    spread = lambda c: F.sqrt(F.col(c) - centre)
    return sums.select(*group, "n", F.try_divide(F.col("_xy") - centre, spread("_xx") * spread("_yy")).alias("spearman"))


def spearman_between(
    df: DataFrame, types: tuple[str, str], group: Sequence[str] = ("num_train", "num_test", "dataset")
) -> DataFrame:
    """Rank correlation of both effects per configuration and dataset."""
    rows = effect_rows(df, [*group, "lm_type", "subsample_idx"])
    return spearman(rows, [*group, "effect"], "subsample_idx", types)


def spearman_null(
    df: DataFrame, types: tuple[str, str], shuffles: int = 10,
    group: Sequence[str] = ("num_train", "num_test", "dataset"), seed: int = 0,
) -> DataFrame:
    """The same after shuffling the subsamples of each LM type: one column per effect and shuffle."""
    number = F.explode(F.sequence(F.lit(0), F.lit(shuffles - 1)))
    shuffled = df.withColumn("shuffle", number).withColumn("_key", _shuffle_key(group, seed))
    start = F.conv(F.substring("_key", 1, 13), 16, 10).cast("bigint")
    placed = total_before(
        shuffled, "place", [*group, "shuffle", "lm_type"], start, [F.col("_key"), F.col("subsample_idx")])
    rows = effect_rows(placed, [*group, "shuffle", "lm_type", "place"])
    long = spearman(rows, [*group, "effect", "shuffle"], "place", types)
    columns = [
        F.max(F.when((F.col("effect") == e) & (F.col("shuffle") == i), F.col("spearman"))).alias(f"{e}_{i}")
        for e in EFFECTS for i in range(shuffles)
    ]
    return long.groupBy(*group).agg(*columns)


def _shuffle_key(group: Sequence[str], seed: int) -> Column:
    parts = [F.col(c) for c in (*group, "lm_type", "shuffle", "subsample_idx")]
    return draw_key("shuffle", str(seed), *parts)
