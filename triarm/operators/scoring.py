"""From class probabilities to predictions and the accuracy table."""

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from triarm.functions import scoring as fs
from triarm.functions.fixed_values import ARMS, REPLICATE_GROUP


def softmax_probabilities(df: DataFrame, logits: str = "logits", name: str = "probs") -> DataFrame:
    return df.withColumn(name, fs.softmax(F.col(logits)))


def accuracies(
    predictions: DataFrame, key: Sequence[str] = (*REPLICATE_GROUP, "subsample_idx"), arms: Sequence[str] = ARMS
) -> DataFrame:
    """Accuracy per arm and majority share of each replicate.

    ``predictions`` is wide: ``label`` and one ``pred_<arm>`` per arm. Rows are
    summed up per label before the shuffle; what follows is one row per label.
    """
    hits = [F.count_if(F.col("label") == F.col(f"pred_{arm}")).alias(arm) for arm in arms]
    by_label = predictions.groupBy(*key, "label").agg(F.count(F.lit(1)).alias("_n"), *hits)
    return _of_labels(by_label, key, arms)


def accuracies_of_sums(sums: DataFrame, key: Sequence[str], arms: Sequence[str] = ARMS) -> DataFrame:
    """The same from sums per label: rows ``_n`` and hits of each arm, of which a label may have several."""
    return _of_labels(sums.groupBy(*key, "label").agg(*[F.sum(c).alias(c) for c in ("_n", *arms)]), key, arms)


def _of_labels(by_label: DataFrame, key: Sequence[str], arms: Sequence[str]) -> DataFrame:
    return by_label.groupBy(*key).agg(
        *[(F.sum(arm) / F.sum("_n")).alias(arm) for arm in arms], (F.max("_n") / F.sum("_n")).alias("majority"))


def majority_share(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Share of the most frequent label, and how many labels there are."""
    counts = df.groupBy(*key, "label").agg(F.count(F.lit(1)).alias("_n"))
    return counts.groupBy(*key).agg(
        (F.max("_n") / F.sum("_n")).alias("majority_all"),
        F.count(F.lit(1)).cast("int").alias("num_classes"),
    )


def with_dataset_constants(accuracy: DataFrame, data: DataFrame, key: Sequence[str] = ("dataset",)) -> DataFrame:
    """Add ``num_classes`` and ``majority_all`` of the whole dataset."""
    return accuracy.join(majority_share(data, key), list(key))


def arms_to_columns(
    scored: DataFrame, key: Sequence[str], value: str, arms: Sequence[str] = ARMS, prefix: str = ""
) -> DataFrame:
    """Long rows ``(key, arm, value)`` to one column per arm."""
    one = [F.max(F.when(F.col("arm") == arm, F.col(value))).alias(f"{prefix}{arm}") for arm in arms]
    return scored.groupBy(*key).agg(*one)


def probability_columns(
    scored: DataFrame, key: Sequence[str], num_classes: int, arms: Sequence[str] = ARMS
) -> DataFrame:
    """Wide form: ``pred_prob_<class>_<arm>`` next to the key."""
    wide = arms_to_columns(scored, key, "probs", arms, "_p_")
    columns = [
        F.get(f"_p_{arm}", F.lit(i)).alias(f"pred_prob_{i}_{arm}") for arm in arms for i in range(num_classes)
    ]
    return wide.select(*key, *columns)


def predictions_from_columns(wide: DataFrame, arms: Sequence[str] = ARMS) -> DataFrame:
    """``pred_<arm>`` from the ``pred_prob_<class>_<arm>`` columns of a prediction table.

    Columns are matched by their full name and taken in class order, so neither an
    unrelated column with an arm in its name nor a tenth class can mislead it.
    """
    out = wide
    for arm in arms:
        pattern = re.compile(rf"pred_prob_(\d+)_{re.escape(arm)}")
        found = sorted((int(m[1]), c) for c in wide.columns if (m := pattern.fullmatch(c)))
        if [i for i, _ in found] != list(range(len(found))) or not found:
            raise ValueError(f"no complete set of probability columns for arm {arm!r}")
        out = out.withColumn(f"pred_{arm}", fs.argmax(F.array(*[F.col(c).cast("double") for _, c in found])))
    return out
