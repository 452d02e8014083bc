"""Arms with a model of the user's own.

The model runs in Python, once per replicate and arm, on the ``m + 2 n`` rows of that
replicate; replicates and arms run side by side. Spark joins the texts to the splits
and brings each group together.
"""

from collections.abc import Callable, Sequence
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from triarm.functions.fixed_values import ARMS
from triarm.functions.scoring import argmax
from triarm.session import ship


class Model(Protocol):
    """What an arm does. ``learn`` is skipped in the base arm."""

    def learn(self, texts: Sequence[str]) -> None:
        """Use unlabelled texts."""

    def fit(self, texts: Sequence[str], labels: Sequence[int]) -> None:
        """Train on labelled texts."""

    def predict_proba(self, texts: Sequence[str]) -> np.ndarray:
        """One row of class probabilities per text."""


def run_model(
    data: DataFrame, splits: DataFrame, make_model: Callable[[], Model], by: Sequence[str] = ("dataset",)
) -> DataFrame:
    """Predictions of all arms: ``(*by, subsample_idx, row_id, label, arm, probs, pred)``.

    All arms of a replicate are one call, so a text is shuffled once, whatever the arms that see it.
    """
    ship(data.sparkSession)
    cell = [*by, "subsample_idx"]
    rows = splits.join(data.select(*by, "row_id", "text"), [*by, "row_id"])

    def replicate(pdf: pd.DataFrame) -> pd.DataFrame:
        part = {role: group for role, group in pdf.sort_values("row_id").groupby("role")}
        train, test, out = part["train"], part["test"], []
        for arm in ARMS:
            # An arm sees the train rows, the test rows, and the unlabelled rows it learns from.
            model = make_model()
            if arm != "base":
                model.learn(part[arm]["text"].tolist())
            model.fit(train["text"].tolist(), train["label"].tolist())
            probs = np.asarray(model.predict_proba(test["text"].tolist()), dtype=float)
            if probs.ndim != 2 or len(probs) != len(test):
                raise ValueError(f"expected one row of probabilities per text, got shape {probs.shape}")
            out.append(test[[*cell, "row_id", "label"]].assign(arm=arm, probs=list(probs)))
        return pd.concat(out)

    schema = rows.select(*cell, "row_id", "label", F.lit("").alias("arm")).schema.add("probs", T.ArrayType(T.DoubleType()))
    scored = rows.groupBy(*cell).applyInPandas(replicate, schema)
    return scored.withColumn("pred", argmax(F.col("probs")))
