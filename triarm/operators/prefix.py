"""Ordered totals of groups of any size.

``row_number()`` or ``cume_dist()`` over a group sends the whole group to one task. Here groups are counted
first. If none is larger than one task should sort (``ROWS``), a plain window is the plan, with one shuffle.
Otherwise the larger groups are cut at measured splitters, quantiles from one mergeable sketch a group, so that
their parts hold about equally many rows whatever the values are: sparse ids, hashes, a far outlier. A small
table of part totals gives each part its offset, and windows only run inside a part. The splitters are
stored, so a recomputed task cuts as its first run did. Results do not depend on the way taken.
"""

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from triarm.sources.scratch import BROADCAST_ROWS, stored

ROWS = 200_000  # rows of a group that one task sorts
MAX_PARTS = 4096
SPLIT_VALUES = 1 << 20  # splitters of all groups that may be broadcast


def _key(columns: Sequence[str]) -> Column:
    """The columns as one join key; unlike plain columns it also matches NULLs."""
    return F.struct(*(columns or [F.lit(0)]))


def join_groups(left: DataFrame, right: DataFrame, group: Sequence[str]) -> DataFrame:
    """Add the columns of a table with one row per group; without groups, of its only row."""
    if group:
        return left.join(right, list(group))
    only = right.select(F.struct(*right.columns)).scalar()
    return left.withColumn("_only", only).select("*", "_only.*").drop("_only")


def _size(group: Sequence[str], df: DataFrame, rows: int) -> tuple[int, int]:
    """Rows of the largest group, and how many groups have more than ``rows``."""
    counts = df.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"))
    largest, many = counts.agg(F.max("_n"), F.count_if(F.col("_n") > rows)).first()
    return largest or 0, many


def fits(df: DataFrame, group: Sequence[str]) -> bool:
    """Whether no group is larger than one task should sort."""
    return not _size(group, df, ROWS)[1]


def _number_of_part(by: Column, splits: str, parts: int) -> Column:
    """How many of the sorted splitters are at or below the value, by halving; 0 without splitters."""
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(parts.bit_length()))])
    above = lambda at, step: F.get(splits, at + step - 1) <= by
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(above(at, step), at + step).otherwise(at))


def with_parts(df: DataFrame, group: Sequence[str], by: Column, rows: int | None = None) -> DataFrame | None:
    """Add ``_group``, the group as one key, and ``_part``, which never decreases along ``by`` within a group.

    Groups of more than ``rows`` rows have several parts, of about equally many rows each; the others
    one. None if all groups are small. ``by`` is a number; rows with equal ones share a part.
    """
    rows = ROWS if rows is None else rows
    largest, many = _size(group, df, rows)
    if not many:
        return None
    parts = min(MAX_PARTS, 1 << math.ceil(math.log2(2 * largest / rows)))
    keyed = df.withColumn("_group", _key(group))
    large = keyed.groupBy("_group").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > rows).select("_group")
    some = keyed.join(F.broadcast(large) if many <= BROADCAST_ROWS else large, "_group", "left_semi")
    shares = [i / parts for i in range(1, parts)]
    splits = stored(some.groupBy("_group").agg(F.percentile_approx(by, shares, 20 * parts).alias("_splits")), "splits")
    few = F.broadcast(splits) if many * parts <= SPLIT_VALUES else splits
    return keyed.join(few, "_group", "left").withColumn("_part", _number_of_part(by, "_splits", parts)).drop("_splits")


def _over_parts(
    cut: DataFrame, name: str, value: Column, total: Callable[[Column | str], Column], combine: Callable[[Column, Column], Column],
    order: Sequence[Column], part_order: Column, last: int,
) -> DataFrame:
    """``total`` of ``value`` over the rows that ``order`` puts first, up to ``last`` rows from the present one."""
    rows = cut.withColumn("_value", value)
    totals = rows.groupBy("_group", "_part").agg(total("_value").alias("_total"))
    outside = Window.partitionBy("_group").orderBy(part_order).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_group", "_part", total("_total").over(outside).alias("_outside"))
    inside = Window.partitionBy("_group", "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, last)
    joined = rows.join(offsets, ["_group", "_part"])
    return joined.withColumn(name, combine(F.col("_outside"), total("_value").over(inside))).drop(
        "_group", "_part", "_value", "_outside")


def total_before(
    df: DataFrame, name: str, group: Sequence[str], by: Column, order: Sequence[Column], weight: Column | None = None,
    part: Column | None = None, rows: int | None = None,
) -> DataFrame:
    """Add the total weight of the rows that come before in the group's order; without weights the 0-based position.

    ``by`` is the first column of ``order``, as a number. ``part`` names parts that are known to be even, as
    those of a hash are; then nothing is measured. Many rows with equal ``by`` should be counted first (``value_ranks``).
    """
    weight = F.lit(1).cast("bigint") if weight is None else weight
    nothing = F.lit(0).cast("bigint")
    cut = df.withColumns({"_group": _key(group), "_part": part}) if part is not None else with_parts(df, group, by, rows)
    if cut is None:
        earlier = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        return df.withColumn(name, F.coalesce(F.sum(weight).over(earlier), nothing))
    add = lambda a, b: F.coalesce(a, nothing) + F.coalesce(b, nothing)
    return _over_parts(cut, name, weight, F.sum, add, order, F.col("_part"), -1)


def minimum_from(
    df: DataFrame, name: str, group: Sequence[str], by: str, value: Column, rows: int | None = None
) -> DataFrame:
    """Add the smallest ``value`` of the rows at or above the present one in the order of ``by``, which has no ties."""
    cut, down = with_parts(df, group, F.col(by), rows), [F.col(by).desc()]
    if cut is None:
        higher = Window.partitionBy(*group).orderBy(*down).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumn(name, F.min(value).over(higher))
    return _over_parts(cut, name, value, F.min, F.least, down, F.col("_part").desc(), 0)


def value_ranks(df: DataFrame, group: Sequence[str], value: str, count: str | None = None) -> DataFrame:
    """Distinct values of each group with ``n`` copies and ``before`` smaller ones.

    Copies are counted before anything is sorted, so a value that fills a third
    of the table costs one row. ``count`` names a column of counts taken before.
    """
    copies = F.count(F.lit(1)) if count is None else F.sum(count)
    counts = df.where(F.col(value).isNotNull()).groupBy(*group, value).agg(copies.alias("n"))
    return total_before(counts, "before", group, F.col(value), [F.col(value)], F.col("n"))


def mid_ranks(df: DataFrame, name: str, group: Sequence[str], value: str) -> DataFrame:
    """Add the 1-based rank of each row's value in its group, the mean one for equal values."""
    if fits(df, group):
        values = Window.partitionBy(*group).orderBy(value)
        last = F.count(F.lit(1)).over(values.rangeBetween(Window.unboundedPreceding, Window.currentRow))
        return df.withColumn(name, (F.rank().over(values) + last) / 2.0)
    keyed = df.withColumn("_place", _key([*group, value]))
    ranks = value_ranks(df, group, value).select(
        _key([*group, value]).alias("_place"), (F.col("before") + (F.col("n") + 1) / 2.0).alias(name))
    return keyed.join(ranks, "_place").drop("_place")


def positions_by_value(
    df: DataFrame, name: str, group: Sequence[str], value: str, tie: str, descending: bool = False
) -> DataFrame:
    """0-based position by value, ties by the integer key ``tie``; NULLs left out.

    For large groups in two steps, so that neither a hot group nor a hot value is sorted in one task.
    """
    signed = -F.col(value) if descending else F.col(value)
    rows = df.where(F.col(value).isNotNull()).withColumn("_signed", signed)
    if fits(rows, group):
        order = Window.partitionBy(*group).orderBy("_signed", tie)
        return rows.withColumn(name, F.row_number().over(order).cast("bigint") - 1).drop("_signed")
    rows = rows.withColumn("_place", _key([*group, "_signed"]))
    ranks = value_ranks(rows, group, "_signed").select(_key([*group, "_signed"]).alias("_place"), "before")
    placed = total_before(rows.join(ranks, "_place"), "_within", ["_place"], F.col(tie), [F.col(tie)])
    return placed.withColumn(name, F.col("before") + F.col("_within")).drop("before", "_within", "_signed", "_place")
