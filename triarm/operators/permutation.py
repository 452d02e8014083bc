"""Paired sign-flip tests and false-discovery control."""

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from triarm.functions.draws import draw_key
from triarm.operators.prefix import minimum_from, total_before
from triarm.sources.scratch import spread, stored

SIGNS = 32  # hex digits of an MD5: signs from one hash
RUN = 32  # blocks of signs a row is sent out for at a time
TOLERANCE = 1e-9  # statistics closer than this count as equal


def sign_flip_test(
    df: DataFrame,
    diff: Column,
    group: Sequence[str],
    key: Sequence[str],
    resamples: int = 10_000,
    seed: int = 0,
) -> DataFrame:
    """One-sided test of ``mean(diff) > 0``, all groups in one job.

    Each resample flips the signs of the paired differences at random. A group with
    at most ``resamples`` sign patterns gets all of them, and then the p-value is
    exact. One hash gives 32 signs, so a row turns into ``resamples / 32`` rows, which
    are summed up before the shuffle: what is shuffled is 32 sums per group and block.
    """
    rows = stored(df.select(*group, *key, diff.cast("double").alias("_d")).where("_d is not null"), "differences")
    sizes = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), F.sum("_d").alias("_observed"))
    sized = rows.join(sizes, list(group))
    patterns = F.pow(F.lit(2.0), F.col("n"))
    few = patterns <= resamples

    def sums(part: DataFrame, total: Column, positive: Callable[[int], str], hashed: bool) -> DataFrame:
        counted = part.withColumn("_all", total.cast("bigint"))
        last = F.floor((F.col("_all") - 1) / SIGNS).cast("int")
        # A few rows turn into many: share them out, in runs of blocks, before they do.
        runs = counted.withColumn("_run", F.explode(F.sequence(F.lit(0), last, F.lit(RUN))))
        blocks = spread(runs, *group, *key, "_run").withColumn(
            "_block", F.explode(F.sequence(F.col("_run"), F.least(last, F.col("_run") + RUN - 1)))
        )
        if hashed:
            parts = [F.col("_block"), *[F.col(c) for c in key]]
            blocks = blocks.withColumn("_hash", draw_key("flip", str(seed), *parts))
        flipped = [F.expr(f"sum(if({positive(j)}, _d, -_d)) as _s{j}") for j in range(SIGNS)]
        return blocks.groupBy(*group, "_block").agg(
            F.max("n").alias("n"), F.max("_observed").alias("_observed"), F.max("_all").alias("_all"), *flipped
        )

    # All patterns: number p keeps the sign of row i where bit i of p is set. Such a
    # group has at most log2(resamples) rows, so numbering them is cheap.
    index = F.row_number().over(Window.partitionBy(*group).orderBy(*key)) - 1
    numbered = sized.where(few).withColumn("_bit", F.pow(F.lit(2.0), index).cast("bigint"))
    pattern = lambda j: f"(cast(_block as bigint) * {SIGNS} + {j})"
    exact = sums(numbered, patterns, lambda j: f"{pattern(j)} & _bit != 0", hashed=False)
    drawn = sums(sized.where(~few), F.lit(resamples), lambda j: f"substr(_hash, {j + 1}, 1) >= '8'", hashed=True)

    reached = lambda j: f"int({pattern(j)} < _all and _s{j} >= _observed - {TOLERANCE!r}d * n)"
    extreme = F.expr(" + ".join(reached(j) for j in range(SIGNS)))

    def p_values(null: DataFrame, plus: int) -> DataFrame:
        counts = null.select(*group, "n", "_observed", "_all", extreme.cast("bigint").alias("_extreme"))
        return counts.groupBy(*group).agg(
            F.max("n").alias("n"),
            (F.max("_observed") / F.max("n")).alias("mean"),
            ((F.sum("_extreme") + plus) / (F.max("_all") + plus)).alias("p_value"),
        )

    return p_values(exact, 0).unionByName(p_values(drawn, 1))


def adjust_fdr(df: DataFrame, p_value: str = "p_value", family: Sequence[str] = ()) -> DataFrame:
    """Benjamini-Hochberg adjusted p-values, as column ``p_adjusted``.

    Tests are counted by p-value first. A p-value is a number of hits over the number of resamples, so a family has no
    more distinct ones than resamples, whatever the number of its tests; the adjusted value is the smallest
    ``p * m / rank`` in this small table from the present value on.
    """
    df = stored(df, "p_values")
    counts = df.where(F.col(p_value).isNotNull()).groupBy(*family, p_value).agg(F.count(F.lit(1)).alias("_n"))
    ranked = total_before(counts, "_before", family, F.col(p_value), [F.col(p_value)], F.col("_n"))
    all_of_family = F.sum("_n").over(Window.partitionBy(*family))
    scaled = ranked.withColumn("_q", F.col(p_value) * all_of_family / (F.col("_before") + F.col("_n")))
    lowest = minimum_from(scaled, "_lowest", family, p_value, F.col("_q"))
    adjusted = lowest.select(*family, p_value, F.least(F.lit(1.0), F.col("_lowest")).alias("p_adjusted"))
    return df.join(adjusted, [*family, p_value], "left")
