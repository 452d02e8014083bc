"""Data-quality checks.

``violations`` counts what is wrong, rule by rule; ``require_*`` run a check and
raise.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from triarm.functions.fixed_values import QUERY_MARKER, REPLICATE_GROUP
from triarm.functions.prompts import shared_prefix
from triarm.operators.prefix import total_before


class InvalidDataError(ValueError):
    """The data breaks a rule; the message names it."""


def require_columns(df: DataFrame, columns: Sequence[str] = ("text", "label")) -> None:
    for column in columns:
        if column not in df.columns:
            raise InvalidDataError(f'the table is missing a "{column}" column')


CHECKS = (
    "null_text", "empty_text", "null_label", "negative_label", "missing_label", "class_count_off", "duplicate_key",
)


def violations(df: DataFrame, num_class_names: int | None = None, key: str = "row_id") -> DataFrame:
    """``(check, n_bad)``, one row per rule; all zero for a valid table.

    Texts are counted in one pass; labels and keys are counted per value first, which
    is combined before the shuffle, so a repeated key or a hot label costs one row.
    """
    text = df.agg(
        F.count_if(F.col("text").isNull()).alias("null_text"),
        F.count_if(F.col("text") == "").alias("empty_text"),
    )
    label, n = F.col("label"), F.col("n")
    known = F.count("label")
    labels = df.groupBy("label").agg(F.count(F.lit(1)).alias("n")).agg(
        F.coalesce(F.sum(F.when(label.isNull(), n)), F.lit(0)).alias("null_label"),
        F.coalesce(F.sum(F.when(label < 0, n)), F.lit(0)).alias("negative_label"),
        F.greatest(F.coalesce(F.max(label).cast("bigint") + 1, F.lit(0)) - F.count_if(label >= 0), F.lit(0))
        .cast("bigint").alias("missing_label"),
        F.abs(known - (known if num_class_names is None else F.lit(num_class_names)))
        .cast("bigint").alias("class_count_off"),
    )
    keys = df.groupBy(key).agg((F.count(F.lit(1)) - 1).alias("extra")).agg(
        F.coalesce(F.sum("extra"), F.lit(0)).alias("duplicate_key")
    )
    parts = [part.unpivot([], part.columns, "check", "n_bad") for part in (text, labels, keys)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def missing_labels(df: DataFrame) -> DataFrame:
    """Ranges of labels from 0 to the largest that no row has, as ``first_label, last_label``.

    Each distinct label is sent to its own place in their order and to the place before, where neighbours meet; a stray label
    far off costs one range. Negative labels are another rule's business.
    """
    there = df.where("label >= 0").select(F.col("label").cast("bigint").alias("_label")).distinct()
    placed = total_before(there, "_place", [], F.col("_label"), [F.col("_label")])
    nothing = F.lit(None).cast("bigint")
    own = F.struct((F.col("_place") + 1).alias("_place"), F.col("_label"), nothing.alias("_next"))
    before = F.struct(F.col("_place"), nothing.alias("_label"), F.col("_label").alias("_next"))
    met = placed.select(F.inline(F.array(own, before))).groupBy("_place").agg(
        F.coalesce(F.max("_label"), F.lit(-1)).alias("_label"), F.max("_next").alias("_next"))
    return met.where("_next > _label + 1").select(
        (F.col("_label") + 1).alias("first_label"), (F.col("_next") - 1).alias("last_label"))


def require_valid(df: DataFrame, class_names: Sequence[str], key: str = "row_id") -> None:
    require_columns(df)
    found = {r["check"]: r["n_bad"] for r in violations(df, len(class_names), key).collect()}
    say = {
        "null_text": "NULL texts are not allowed",
        "empty_text": "empty texts are not allowed",
        "duplicate_key": f"{key} is not unique",
        "null_label": "labels are missing or not known",
        "negative_label": "labels are negative",
        "missing_label": "labels are not consecutive from 0",
    }
    for check, reason in say.items():
        if found[check]:
            raise InvalidDataError(f"{reason} ({found[check]} cases)")
    if found["class_count_off"]:
        labels = df.select("label").distinct().count()
        which = "class names are missing" if len(class_names) < labels else "class names are too many"
        raise InvalidDataError(f"{which}: {len(class_names)} names, {labels} labels in the data")


def require_probabilities(df: DataFrame, num_classes: int | Column, column: str = "probs") -> DataFrame:
    """Fail the query on a row whose array is not one probability per class."""
    wanted, size = F.lit(num_classes) if isinstance(num_classes, int) else num_classes, F.coalesce(F.size(column), F.lit(-1))
    say = lambda n: F.coalesce(n.cast("string"), F.lit("?"))
    bad = F.concat(F.lit("expected "), say(wanted), F.lit(" probabilities, got "), say(size))
    probs = F.when(size == wanted, F.col(column))
    return df.withColumn(column, F.coalesce(probs, F.raise_error(bad).cast("array<double>")))


def require_shared_prefix(df: DataFrame, prompt: str) -> None:
    """Every prompt has a query marker, and the same text in front of it."""
    text = F.col(prompt)
    seen = df.agg(
        F.count_if(~F.coalesce(F.contains(text, F.lit(QUERY_MARKER)), F.lit(False))).alias("unmarked"),
        F.min(shared_prefix(text)).alias("low"), F.max(shared_prefix(text)).alias("high"),
    ).first()
    if seen["unmarked"]:
        raise InvalidDataError(f"{seen['unmarked']} prompts have no query marker")
    if seen["low"] != seen["high"]:
        raise InvalidDataError("the prompts do not share the text in front of the query")


def replicate_counts(df: DataFrame, group: Sequence[str] = REPLICATE_GROUP) -> DataFrame:
    """Rows per replicate group, and how many groups have that many."""
    keys = [c for c in group if c in df.columns]
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_replicates"))
    return counts.groupBy("n_replicates").agg(F.count(F.lit(1)).alias("n_groups"))


def require_equal_replicates(df: DataFrame, group: Sequence[str] = REPLICATE_GROUP) -> int:
    """The number of replicates, which has to be the same in every group."""
    counts = replicate_counts(df, group).limit(2).collect()
    if len(counts) != 1:
        raise InvalidDataError("groups hold different numbers of replicates")
    return counts[0]["n_replicates"]


def dataset_differences(left: DataFrame, right: DataFrame, column: str = "dataset") -> DataFrame:
    """Datasets only one of two result tables holds."""
    a, b = left.select(column).distinct(), right.select(column).distinct()
    only = lambda x, y, side: x.join(y, column, "left_anti").withColumn("only_in", F.lit(side))
    return only(a, b, "left").unionByName(only(b, a, "right"))


def duplicate_names(df: DataFrame, column: str = "location") -> DataFrame:
    """Short names that several locations share."""
    short = F.substring_index(column, "/", -1).alias("dataset")
    return (
        df.select(short, column).distinct()
        .groupBy("dataset").agg(F.count(F.lit(1)).alias("n_locations")).where("n_locations > 1")
    )
