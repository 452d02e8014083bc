"""Dimension reduction before a regression, with and without the test rows."""

import sys
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

from triarm.sources.scratch import broadcast_bounded

# Send the small functions below with the task, as executors may not have the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Components are 0.6 of the effective ranks 5, 10, 15, 20.
COMPONENTS = (3, 6, 9, 12)
Z = 1.96  # fixed value: half width of the error bars in standard errors


def _r2(x_train, y_train, x_test, y_test) -> float:
    """R^2 on test rows of least squares with intercept (the shortest one if not unique)."""
    centre_x, centre_y = x_train.mean(axis=0), y_train.mean()
    weights = np.linalg.lstsq(x_train - centre_x, y_train - centre_y, rcond=None)[0]
    residual = y_test - ((x_test - centre_x) @ weights + centre_y)
    return 1.0 - float(residual @ residual) / float(((y_test - y_test.mean()) ** 2).sum())


def _directions(x, components: int):
    centre = x.mean(axis=0)
    return centre, np.linalg.svd(x - centre, full_matrices=False)[2][:components].T


def pca_r2(
    vectors: DataFrame, splits: DataFrame, num_rows: int, components: Sequence[int] = COMPONENTS,
    features: str = "embedding", target: str = "label",
) -> DataFrame:
    """R^2 of each arm, replicate and number of components.

    A replicate is one group of ``m + 2 n`` rows, a size the caller chose, so its small
    dense algebra runs inside one task and replicates run side by side. ``num_rows``
    is the size of the split table.
    """
    ids = broadcast_bounded(splits.select("subsample_idx", "row_id", "role"), num_rows)
    rows = vectors.select("row_id", F.col(target).cast("double").alias("y"), F.col(features).alias("x"))

    def replicate(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["role", "row_id"])
        part = {
            role: (np.array(g["x"].tolist(), dtype=float), g["y"].to_numpy()) for role, g in pdf.groupby("role")
        }
        (x_train, y_train), (x_test, y_test) = part["train"], part["test"]
        out = [(key[0], k, "base", _r2(x_train, y_train, x_test, y_test)) for k in components]
        for arm in ("extra", "test"):
            for k in components:
                centre, axes = _directions(part[arm][0], k)
                score = _r2((x_train - centre) @ axes, y_train, (x_test - centre) @ axes, y_test)
                out.append((key[0], k, arm, score))
        return pd.DataFrame(out, columns=["subsample_idx", "components", "arm", "r2"])

    schema = "subsample_idx int, components int, arm string, r2 double"
    return rows.join(ids, "row_id").groupBy("subsample_idx").applyInPandas(replicate, schema)


def error_bars(r2: DataFrame) -> DataFrame:
    """Mean of the paired differences per effect, with the half width of its error bar."""
    arm = lambda a: F.max(F.when(F.col("arm") == a, F.col("r2"))).alias(a)
    wide = r2.groupBy("components", "subsample_idx").agg(arm("base"), arm("extra"), arm("test"))
    diffs = wide.select(
        "components", F.inline(F.array(
            F.struct(F.lit("boost").alias("effect"), (F.col("extra") - F.col("base")).alias("diff")),
            F.struct(F.lit("bias").alias("effect"), (F.col("test") - F.col("extra")).alias("diff")),
        ))
    )
    return diffs.groupBy("components", "effect").agg(
        F.count("diff").alias("n"), F.avg("diff").alias("mean"),
        (Z * F.stddev_samp("diff") / F.sqrt(F.count("diff"))).alias("margin"),
    )


def logistic_arms(df: DataFrame, seed: str = "ml") -> DataFrame:
    """The three arms: token counts, IDF, logistic regression.

    All labelled rows take part: a hash of the key makes 40% train, 30% extra and 30%
    test rows. The base arm skips the IDF. Returns the accuracy per arm. Every token of the training rows is a
    feature of its own; neither the list of them nor their coefficients are on the driver.
    """
    from triarm.functions.draws import WORD_RANGE, draw_key, word
    from triarm.functions.scoring import tokens
    from triarm.operators import logistic

    share = word(draw_key(seed, F.col("row_id"))) / F.lit(float(WORD_RANGE))
    role = F.when(share < 0.4, 0).when(share < 0.7, 1).otherwise(2)
    words = df.select(F.col("label").cast("double"), role.alias("role"), tokens(F.col("text")).alias("words"),
                      F.octet_length("text").alias("n_bytes"))
    out = None
    for arm, scored in logistic.arms_of(words, max_iter=20, penalty=0.01).items():
        hit = (F.col("label") == F.col("pred")).cast("double")
        one = scored.agg(F.lit(arm).alias("arm"), F.count(F.lit(1)).alias("n_test"), F.avg(hit).alias("accuracy"))
        out = one if out is None else out.unionByName(one)
    return out
