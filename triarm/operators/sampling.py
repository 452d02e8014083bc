"""Subsamples: all replicates of all datasets in one job.

Each replicate orders the rows by a hash of (seed, row key) and takes the first
ones. A row is hashed once, and its key under each seed is two multiplications. Only rows whose key lies below a cut that is almost sure to be high enough leave the scan, so what is shuffled and sorted is a little more than the sample,
however large (or lopsided) the tables are. Replicates that still come up short
are redrawn without the cut, so the result is always the exact one.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from triarm.functions.draws import PRIME, coefficients, draw_key, key_below, order_key, row_words, seed_key
from triarm.operators.prefix import total_before
from triarm.operators.validate import InvalidDataError
from triarm.sources.scratch import new_path, stored

SEED = 42  # replicate i draws with seed 42 + i
SLACK = 6.0  # standard deviations between the wanted count and the cut
TRAIN_SALT, REST_SALT = "train", "rest"


def _generous(wanted: Column, slack: float) -> Column:
    """Expected rows below the cut: the wanted ones plus some deviations."""
    return wanted + slack * F.sqrt(wanted) + 2 * slack


def _stratum(stratify: bool) -> Column:
    return F.col("label") if stratify else F.lit(0)


def label_quotas(df: DataFrame, num_train: int, by: Sequence[str], stratify: bool = True) -> DataFrame:
    """Per dataset and label: rows there are (``n``) and rows to draw (``quota``)."""
    counts = df.groupBy(*by, _stratum(stratify).alias("_stratum")).agg(F.count(F.lit(1)).alias("n"))
    dataset = Window.partitionBy(*(by or [F.lit(0)]))
    return counts.withColumns({
        "n_strata": F.count(F.lit(1)).over(dataset),
        "n_rows": F.sum("n").over(dataset),
    }).withColumn("quota", F.floor(F.lit(num_train) / F.col("n_strata")).cast("int"))


def require_enough(quotas: DataFrame, num_test: int, by: Sequence[str]) -> tuple[DataFrame, int]:
    """Raise where a draw cannot be made; return the quotas and the rows of one replicate.

    There are at most ``num_train`` classes per dataset, else the draw fails, so
    the quotas are a small table. It is stored, and its measured size decides how it
    is joined. A NULL label belongs to no class, so it is refused.
    """
    problem = F.when(F.col("_stratum").isNull(), "a label is NULL").when(F.col("quota") < 1, "more classes than training rows; raise num_train").when(
        F.col("quota") > F.col("n"), "a class has fewer rows than its share of num_train"
    ).when(
        F.col("n_rows") - F.col("quota") * F.col("n_strata") < 2 * num_test,
        "too few rows are left for the extra and test splits",
    )
    quotas = stored(quotas, "quotas")
    datasets = F.count_distinct(*by) if by else F.lit(1)
    seen = quotas.withColumn("_problem", problem).agg(
        F.count(F.lit(1)).alias("n"), F.min("_problem").alias("problem"), F.sum("quota").alias("quota"),
        datasets.alias("datasets")).first()
    if not seen["n"]:
        raise InvalidDataError("the table is empty")
    if seen["problem"] is not None:
        raise InvalidDataError(seen["problem"])
    return quotas, seen["quota"] + 2 * num_test * seen["datasets"]


def _roles(draws: DataFrame, by: Sequence[str], num_test: int) -> DataFrame:
    """Assign roles among drawn rows: best of each stratum train, then extra, test."""
    cell = [*by, "subsample_idx"]
    first = Window.partitionBy(*cell, "_stratum").orderBy(
        F.col("_in_train").desc(), "_train_key", "_tie", "row_id"
    )
    is_train = F.col("_in_train") & (F.row_number().over(first) <= F.col("quota"))
    marked = draws.withColumn("_is_train", is_train)
    if not num_test:
        return marked.where("_is_train").select(*cell, "row_id", "label", F.lit("train").alias("role"))
    usable = F.col("_in_rest") & ~F.col("_is_train")
    rest = Window.partitionBy(*cell).orderBy(usable.desc(), "_rest_key", "_tie", "row_id")
    place = F.row_number().over(rest)
    role = (
        F.when(F.col("_is_train"), "train")
        .when(usable & (F.col("_place") <= num_test), "extra")
        .when(usable & (F.col("_place") <= 2 * num_test), "test")
    )
    placed = marked.withColumn("_place", place).withColumn("role", role)
    return placed.where(F.col("role").isNotNull()).select(*cell, "row_id", "label", "role")


def replicate_splits(
    df: DataFrame,
    num_train: int,
    num_test: int,
    num_subsamples: int,
    by: Sequence[str] = (),
    stratify: bool = True,
    seed: int = SEED,
    slack: float = SLACK,
) -> DataFrame:
    """Disjoint train / extra / test rows of ``num_subsamples`` replicates.

    ``df`` holds ``row_id``, ``label`` and the dataset keys ``by``. Returns one
    long table ``(*by, subsample_idx, row_id, label, role)``. Train takes
    ``floor(num_train / classes)`` rows of each class (or ``num_train`` of all
    without ``stratify``); extra and test take ``num_test`` rows each of the rest.

    The draw is written to the shared folder once, as every later step joins it.
    """
    spark, by = df.sparkSession, list(by)
    cell = [*by, "subsample_idx"]
    rows = df.select(*by, "row_id", "label").withColumn("_stratum", _stratum(stratify))
    quotas, wanted = require_enough(label_quotas(df, num_train, by, stratify), num_test, by)
    cuts = quotas.select(
        *by, "_stratum", "quota",
        key_below(_generous(F.col("quota"), slack) / F.col("n")).alias("_train_cut"),
        key_below(_generous(F.lit(2.0 * num_test + num_train), slack) / F.col("n_rows")).alias("_rest_cut"),
    )
    replicates = F.sequence(F.lit(1), F.lit(num_subsamples))
    words = dict(zip(("_h1", "_h2"), row_words(F.col("row_id"))))
    hashed = rows.join(cuts, [*by, "_stratum"]).withColumns(words)
    keyed = hashed.select("*", F.expr(_seeds(seed, num_subsamples))).withColumns({
        "_train_key": _key_of("t"), "_rest_key": _key_of("r"),
    })
    flagged = keyed.withColumns({
        "_in_train": F.col("_train_key") < F.col("_train_cut"),
        "_in_rest": (F.col("_rest_key") < F.col("_rest_cut")) & F.lit(num_test > 0),
    })
    path = new_path(spark, "splits")
    quick = _roles(_with_tie(flagged.where("_in_train or _in_rest"), seed), by, num_test)
    quick.write.parquet(f"{path}/draw=1")

    # Replicates the cut left short (as a rule none) are redrawn in full. No replicate
    # has too many rows, so the total tells whether one is short.
    drawn = spark.read.schema(quick.schema).parquet(f"{path}/draw=1")
    if drawn.count() == wanted * num_subsamples:
        return drawn
    per_dataset = quotas.groupBy(*by).agg((F.sum("quota") + 2 * num_test).alias("_wanted"))
    expected = per_dataset.withColumn("subsample_idx", F.explode(replicates))
    counts = drawn.groupBy(*cell).agg(F.count(F.lit(1)).alias("_drawn"))
    missing = F.coalesce(F.col("_drawn"), F.lit(0)) < F.col("_wanted")
    short = expected.join(counts, cell, "left").where(missing).select(*cell)
    whole = _whole_draw(_with_tie(keyed.join(short, cell, "left_semi"), seed), by, num_test)
    drawn.join(short, cell, "left_anti").unionByName(whole).write.parquet(f"{path}/draw=2")
    drawn = spark.read.schema(quick.schema).parquet(f"{path}/draw=2")
    if drawn.count() != wanted * num_subsamples:
        raise RuntimeError("a replicate could not be drawn in full")
    return drawn


def _seeds(seed: int, num_subsamples: int) -> str:
    """The replicates and their coefficients as a generator of literal rows."""
    rows = []
    for i in range(1, num_subsamples + 1):
        numbers = [*coefficients(TRAIN_SALT, seed + i), *coefficients(REST_SALT, seed + i)]
        rows.append(f"struct({i}, {', '.join(f'{n}L' for n in numbers)})")
    return f"inline(array({', '.join(rows)})) as (subsample_idx, _ta, _tb, _tc, _ra, _rb, _rc)"


def _key_of(which: str) -> Column:
    return seed_key([F.col("_h1"), F.col("_h2")], *[F.col(f"_{which}{x}") for x in "abc"])


def _with_tie(draws: DataFrame, seed: int) -> DataFrame:
    """Order of rows with equal keys: an MD5, computed for candidates only."""
    seeded = (F.lit(seed) + F.col("subsample_idx")).cast("string")
    return draws.withColumn("_tie", draw_key(seeded, F.col("row_id")))


def _part(key: str) -> Column:
    """Part of a key: one of 4,096 even ones, as keys are hashes."""
    return F.floor(F.col(key) / ((PRIME + 1) // 2**12))


def _whole_draw(draws: DataFrame, by: Sequence[str], num_test: int) -> DataFrame:
    """Roles over uncut replicates: positions from bucket offsets, as cells are large."""
    cell = [*by, "subsample_idx"]
    order = lambda key: [F.col(key), F.col("_tie"), F.col("row_id")]
    placed = total_before(
        draws, "_rank", [*cell, "_stratum"], F.col("_train_key"), order("_train_key"), part=_part("_train_key"))
    train = placed.where("_rank < quota").select(*cell, "row_id", "label", F.lit("train").alias("role"))
    if not num_test:
        return train
    left = placed.where("_rank >= quota")
    rest = total_before(left, "_place", cell, F.col("_rest_key"), order("_rest_key"), part=_part("_rest_key"))
    chosen = rest.where(F.col("_place") < 2 * num_test)
    role = F.when(F.col("_place") < num_test, "extra").otherwise("test")
    return train.unionByName(chosen.select(*cell, "row_id", "label", role.alias("role")))


def three_way_split(df: DataFrame, num_train: int, num_test: int, seed: int = SEED, **kwargs) -> DataFrame:
    """One train / extra / test split."""
    splits = replicate_splits(df, num_train, num_test, 1, seed=seed - 1, **kwargs)
    return splits.drop("subsample_idx")


def stratified_sample(df: DataFrame, size: int, seed: int = SEED, **kwargs) -> DataFrame:
    """``floor(size / classes)`` random rows of each class."""
    return three_way_split(df, size, 0, seed=seed, **kwargs).drop("role")


def down_sample(
    df: DataFrame, key: Sequence[str], size: int = 1, seed: int = SEED,
    group: Sequence[str] = ("lm_type", "dataset"),
) -> DataFrame:
    """``size`` random rows per group; ``key`` identifies a row.

    Every group draws by itself. One row per group is a plain aggregate on numbers. For more, the
    filter on the row number limits every partition before the shuffle.
    """
    keyed = df.withColumn("_key", order_key("down", str(seed), *[F.col(c) for c in (*group, *key)]))
    if size == 1:
        rest = [c for c in df.columns if c not in group]
        return keyed.groupBy(*group).agg(*[F.min_by(c, "_key").alias(c) for c in rest]).select(*df.columns)
    order = Window.partitionBy(*group).orderBy("_key", *key)
    return keyed.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= size).drop("_key", "_n")
