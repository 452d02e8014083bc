"""Summaries, tests and effects against brute force and planted effects."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from triarm.operators import (
    correlation, density, effects, permutation, posterior, regression, reshape, scoring, summary,
)
from triarm.operators.sampling import replicate_splits

SCHEMA = (
    "num_train int, num_test int, lm_type string, dataset string, subsample_idx int, base double, extra double, "
    "test double, majority double, num_classes int, majority_all double"
)


def accuracy_table(spark, boost=0.0, bias=0.0, datasets=4, subsamples=20, n=100, seed=1, types=("a", "b")):
    rng = np.random.default_rng(seed)
    rows = []
    for lm in types:
        for d in range(datasets):
            level = rng.uniform(0.5, 0.7)
            for s in range(1, subsamples + 1):
                draw = lambda p: float(rng.binomial(n, p)) / n
                rows.append((
                    100, n, lm, f"d{d}", s, draw(level), draw(level + boost), draw(level + boost + bias), 0.3, 4, 0.25
                ))
    return spark.createDataFrame(rows, SCHEMA)


def test_two_level_mean_is_not_the_flat_mean(spark):
    rows = [(1, 1, "a", "x", i, 0.0, v, 0.0, 0.0, 2, 0.5) for i, v in enumerate([1.0, 1.0, 1.0])]
    rows += [(1, 1, "a", "y", 0, 0.0, 0.0, 0.0, 0.0, 2, 0.5)]
    table = summary.summary_table(spark.createDataFrame(rows, SCHEMA))
    boost = table.where("effect = 'boost'").first()
    assert boost["mean"] == 0.5
    assert boost["se"] == pytest.approx(0.5)


def test_counts_truncate_or_round(spark):
    df = spark.createDataFrame([(0.29,)], "base double")
    assert summary.num_correct(df, F.lit(100)).first()["base"] == 28
    assert summary.num_correct(df, F.lit(100), "round").first()["base"] == 29


def test_relative_difference_of_zero_control_is_null(spark):
    df = spark.createDataFrame([(0.0, 0.5), (0.5, 0.75)], "base double, extra double")
    assert [r[0] for r in df.select(summary.relative_difference("extra", "base")).collect()] == [None, 0.5]


def test_difference_summary_needs_equal_replicates(spark):
    df = accuracy_table(spark)
    table = summary.difference_summary(df, summary.effect("bias"), ["lm_type", "dataset"])
    values = df.where("lm_type = 'a' and dataset = 'd0'").toPandas()
    row = table.where("lm_type = 'a' and dataset = 'd0'").first()
    diff = values["test"] - values["extra"]
    assert row["mean"] == pytest.approx(diff.mean())
    assert row["se"] == pytest.approx(diff.std(ddof=1) / 20**0.5)
    with pytest.raises(ValueError):
        summary.difference_summary(df.where("not (dataset = 'd0' and subsample_idx = 3)"), summary.effect("bias"))


def test_accuracies_and_majority(spark):
    rows = [("k", 0, 0, 1), ("k", 0, 0, 0), ("k", 1, 0, 1), ("k", 0, 1, 1)]
    df = spark.createDataFrame(rows, "key string, label int, pred_base int, pred_extra int")
    row = scoring.accuracies(df, ["key"], ["base", "extra"]).first()
    assert (row["base"], row["extra"], row["majority"]) == (0.5, 0.5, 0.75)


def test_predictions_from_columns_match_full_names_in_class_order(spark):
    names = [f"pred_prob_{i}_base" for i in range(11)]
    values = [0.0] * 11
    values[10] = 0.9
    df = spark.createDataFrame([(*values, 5.0, 1.0)], ", ".join(f"{n} double" for n in [*names, "base_rate", "x_pred_prob_0_base"]))
    assert scoring.predictions_from_columns(df, ["base"]).first()["pred_base"] == 10
    with pytest.raises(ValueError):
        scoring.predictions_from_columns(df.drop("pred_prob_3_base"), ["base"])


def test_wide_probabilities(spark):
    rows = [(1, "base", [0.1, 0.9]), (1, "extra", [0.6, 0.4])]
    df = spark.createDataFrame(rows, "row_id long, arm string, probs array<double>")
    row = scoring.probability_columns(df, ["row_id"], 2, ["base", "extra"]).first()
    assert (row["pred_prob_1_base"], row["pred_prob_0_extra"]) == (0.9, 0.6)


def p_value_by_enumeration(d):
    stats = [sum(s * x for s, x in zip(signs, d)) for signs in itertools.product((1, -1), repeat=len(d))]
    return sum(s >= sum(d) - 1e-9 for s in stats) / len(stats)


def test_sign_flip_test_is_exact_for_few_rows(spark):
    rng = random.Random(5)
    data = {f"g{n}": [round(rng.uniform(-1, 1.4), 2) for _ in range(n)] for n in (1, 2, 4, 5, 9)}
    rows = [(g, i, x) for g, xs in data.items() for i, x in enumerate(xs)]
    df = spark.createDataFrame(rows, "g string, i int, d double")
    table = permutation.sign_flip_test(df, F.col("d"), ["g"], ["i"], 1000)
    for row in table.collect():
        assert row["p_value"] == pytest.approx(p_value_by_enumeration(data[row["g"]]))
        assert row["n"] == len(data[row["g"]])


def test_sign_flip_test_of_many_rows(spark):
    rng = np.random.default_rng(2)
    data = {"null": rng.normal(0, 1, 60), "shifted": rng.normal(0.8, 1, 60), "slight": rng.normal(0.1, 1, 60)}
    rows = [(g, i, float(x)) for g, xs in data.items() for i, x in enumerate(xs)]
    df = spark.createDataFrame(rows, "g string, i int, d double")
    table = permutation.sign_flip_test(df, F.col("d"), ["g"], ["i"], 5000)
    for row in table.collect():
        d = data[row["g"]]
        signs = rng.integers(0, 2, (50_000, 60)) * 2 - 1
        expected = float((signs @ d >= d.sum()).mean())
        assert row["p_value"] == pytest.approx(expected, abs=0.03)
        assert 0 < row["p_value"] <= 1


def test_fdr(spark):
    p = [0.01, 0.04, 0.03, 0.005, 0.2, 0.04, 1.0]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(p)], "i int, p_value double")
    found = {r["i"]: r["p_adjusted"] for r in permutation.adjust_fdr(df).collect()}
    order = np.argsort(p, kind="stable")
    scaled = np.array(p)[order] * len(p) / np.arange(1, len(p) + 1)
    expected = np.minimum(1, np.minimum.accumulate(scaled[::-1])[::-1])
    assert [found[i] for i in order] == pytest.approx(list(expected))


def test_spearman(spark):
    x, y = [1.0, 2.0, 2.0, 4.0, 5.0], [3.0, 1.0, 4.0, 4.0, 9.0]
    rows = [("a", i, v) for i, v in enumerate(x)] + [("b", i, v) for i, v in enumerate(y)]
    df = spark.createDataFrame(rows, "lm_type string, k int, diff double").withColumn("g", F.lit(1))
    rank = lambda v: np.array([sum(u < w for u in v) + (sum(u == w for u in v) + 1) / 2 for w in v])
    row = correlation.spearman(df, ["g"], "k", ("a", "b")).first()
    assert row["spearman"] == pytest.approx(np.corrcoef(rank(x), rank(y))[0, 1])
    flat = df.withColumn("diff", F.lit(1.0))
    assert correlation.spearman(flat, ["g"], "k", ("a", "b")).first()["spearman"] is None


def test_a_key_that_comes_twice_is_refused(spark):
    rows = [(t, i, float(i)) for t in "ab" for i in range(4)] + [("a", 2, 9.0)]
    df = spark.createDataFrame(rows, "lm_type string, k int, diff double").withColumn("g", F.lit(1))
    with pytest.raises(Exception, match="two rows with one key"):
        correlation.spearman(df, ["g"], "k", ("a", "b")).collect()


def test_shuffles_break_the_correlation(spark):
    df = accuracy_table(spark, subsamples=40, types=("a",), datasets=2)
    same = df.unionByName(df.withColumn("lm_type", F.lit("b")))
    observed = correlation.spearman_between(same, ("a", "b")).collect()
    assert all(r["spearman"] == pytest.approx(1.0) for r in observed)
    null = correlation.spearman_null(same, ("a", "b"), 5).toPandas()
    columns = [f"{e}_{i}" for e in ("boost", "bias") for i in range(5)]
    assert abs(null[columns].to_numpy().mean()) < 0.3


def test_kernel_density_integrates_to_one(spark):
    df = accuracy_table(spark)
    curve = density.kernel_density(df, "base", ["lm_type"]).where("lm_type = 'a'").orderBy("x").toPandas()
    assert np.trapezoid(curve["density"], curve["x"]) == pytest.approx(1, abs=0.01)


def test_binned_density_keeps_its_bound(spark):
    rng = np.random.default_rng(6)
    data = {"even": rng.normal(0, 1, 400), "outlier": np.append(rng.normal(0, 1, 300), 40.0), "few": np.repeat([1.0, 2.0, 2.5], 20)}
    df = spark.createDataFrame([(g, float(v)) for g, xs in data.items() for v in xs], "g string, v double")
    curves = density.kernel_density(df, "v", ["g"]).toPandas()
    for g, xs in data.items():
        curve = curves[curves["g"] == g].sort_values("point")
        h = xs.std(ddof=1) * len(xs) ** -0.2
        x = curve["x"].to_numpy()
        exact = np.exp(-0.5 * ((x[:, None] - xs) / h) ** 2).sum(axis=1) / (len(xs) * h * np.sqrt(2 * np.pi))
        bound = (x[1] - x[0]) ** 2 / (8 * h**2) / (h * np.sqrt(2 * np.pi))
        assert len(x) == 200 and np.abs(curve["density"] - exact).max() <= bound * (1 + 1e-6)


def test_cumulative_share(spark):
    df = spark.createDataFrame([("g", v) for v in (1.0, 1.0, 2.0, 5.0)], "g string, v double")
    rows = {r["v"]: r["ecdf"] for r in density.cumulative_share(df, "v", ["g"]).collect()}
    assert rows == {1.0: 0.5, 2.0: 0.75, 5.0: 1.0}
    shares = density.share_below(df, "v", 2.0, ["g"]).first()
    assert (shares["below_minus"], shares["below_plus"]) == (0.0, 0.5)


def test_interval_band(spark):
    rows = [(i, float(v)) for i, v in enumerate((3, 1, 2, 2))]
    df = spark.createDataFrame(rows, "i long, m double").withColumns({"lo": F.col("m") - 1, "hi": F.col("m") + 1})
    band = density.interval_band(df, "m", "i", [], "lo", "hi")
    assert {r["i"]: r["height"] for r in band.collect()} == {1: 0.0, 2: 0.25, 3: 0.5, 0: 0.75}


def hdi(values, share=0.89):
    x = sorted(values)
    steps = int(np.floor(share * len(x)))
    widths = [x[i + steps] - x[i] for i in range(len(x) - steps)]
    i = int(np.argmin(np.round(widths, 9)))
    return x[i], x[i + steps]


def test_highest_density_interval(spark):
    rng = np.random.default_rng(4)
    data = {"normal": rng.normal(0, 1, 700), "skewed": rng.exponential(1, 500), "tied": np.repeat([1.0, 2.0, 7.0], 30)}
    rows = [(g, i, float(v)) for g, xs in data.items() for i, v in enumerate(xs)]
    df = spark.createDataFrame(rows, "g string, i long, v double")
    for row in posterior.draw_summary(df, ["g"], "v", "i").collect():
        d = data[row["g"]]
        assert (row["hdi_low"], row["hdi_high"]) == pytest.approx(hdi(d))
        assert row["mean"] == pytest.approx(d.mean()) and row["sd"] == pytest.approx(d.std(ddof=1))


def test_melt_and_pivot_round_trip(spark):
    counts = summary.num_correct(accuracy_table(spark), F.col("num_test"), "round")
    melted = reshape.melt_num_correct(counts, ["bias"]).drop("effect")
    assert melted.count() == 2 * counts.count()
    pairs = melted.where("lm_type = 'a' and method = 'test'").select("pair", "dataset").orderBy("pair").collect()
    assert [r["pair"] for r in pairs] == list(range(80))
    assert [r["dataset"] for r in pairs] == sorted(r["dataset"] for r in pairs)
    wide = reshape.pivot_predictions(melted, melted.withColumnRenamed("num_correct", "pred"), "test", "extra")
    keys = ["num_test", "lm_type", "dataset", "test", "extra"]
    assert sorted(map(tuple, wide.select(*keys).collect())) == sorted(map(tuple, counts.select(*keys).collect()))


def test_planted_effects_are_found_and_null_is_not(spark):
    counts = summary.num_correct(accuracy_table(spark, boost=0.1, datasets=8, n=200), F.col("num_test"), "round")
    boost, bias = (effects.log_odds_effect(counts, e, ["num_test"]).first() for e in ("boost", "bias"))
    assert boost["log_odds"] > 4 * boost["se"]
    assert abs(bias["log_odds"]) < 3 * bias["se"]
    draws = effects.bootstrap_effect(counts, "boost", 300).toPandas()["log_odds"]
    assert len(draws) == 300 and draws.quantile(0.025) > 0.2
    replicates = effects.meta_replicates(counts, ["boost"], ["subsample_idx"], 100).toPandas()
    assert (replicates["n_subsamples"] == 16).all()
    assert replicates["mean"].mean() == pytest.approx(0.1, abs=0.03)
    # Every LM type and dataset picks by itself, so experiments differ.
    assert replicates["mean"].nunique() > 50


def test_regression_agrees_with_the_pooled_effect(spark):
    counts = summary.num_correct(accuracy_table(spark, boost=0.1, types=("a",)), F.col("num_test"), "round")
    fitted = {r["term"]: r["estimate"] for r in effects.glm_effect(counts, "boost").collect()}
    sums = counts.agg(F.sum("extra"), F.sum("base"), F.sum("num_test")).first()
    logit = lambda k: np.log(k / (sums[2] - k))
    assert fitted["method"] == pytest.approx(logit(sums[0]) - logit(sums[1]), abs=1e-6)


@pytest.mark.parametrize("boost", [0.0, 0.25])
def test_regression_equals_a_plain_fit(spark, boost):
    """Estimates and standard errors of the whole design matrix, fitted by Newton steps over all of its columns."""
    counts = summary.num_correct(accuracy_table(spark, boost=boost, types=("a", "b", "c"), n=60), F.col("num_test"), "round")
    found = {r["term"]: (r["estimate"], r["se"]) for r in effects.glm_effect(counts, "boost").collect()}
    sums = {r[0]: r[1:] for r in counts.groupBy("lm_type").agg(F.sum("base"), F.sum("extra"), F.sum("num_test")).collect()}
    x, hits, trials = [], [], []
    for i, t in enumerate(sorted(sums)):
        for method in (0, 1):
            x.append([1, method, int(i == 1), int(i == 2)])
            hits.append(sums[t][method])
            trials.append(sums[t][2])
    x, hits, trials, w = np.array(x, float), np.array(hits, float), np.array(trials, float), np.zeros(4)
    for _ in range(40):
        p = 1 / (1 + np.exp(-x @ w))
        information = x.T @ (x * (trials * p * (1 - p))[:, None])
        w = w + np.linalg.solve(information, x.T @ (hits - trials * p))
    errors = np.sqrt(np.diag(np.linalg.inv(information)))
    for name, estimate, error in zip(("intercept", "method", "lm_type[b]", "lm_type[c]"), w, errors):
        assert found[name] == (pytest.approx(estimate, abs=1e-8), pytest.approx(error, rel=1e-6))
    assert len(found) == 4


def test_pca_experiment(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(120, 6))
    y = x[:, 0] * 2 + rng.normal(size=120) * 0.1
    rows = [(i, float(y[i]), x[i].tolist()) for i in range(120)]
    df = spark.createDataFrame(rows, "row_id long, label double, embedding array<double>")
    splits = replicate_splits(df.withColumn("label", F.col("label").cast("double")), 40, 30, 3, stratify=False)
    table = regression.pca_r2(df, splits, 300, [6]).toPandas()
    assert len(table) == 9
    # All components kept: every arm is plain least squares.
    wide = table.pivot(index="subsample_idx", columns="arm", values="r2")
    assert np.allclose(wide["base"], wide["extra"]) and np.allclose(wide["base"], wide["test"])
    assert (wide["base"] > 0.95).all()
    bars = regression.error_bars(regression.pca_r2(df, splits, 300, [6])).collect()
    assert {r["effect"] for r in bars} == {"boost", "bias"}


def test_unpaired_draws_are_refused(spark):
    from triarm.operators.posterior import conditional_differences

    rows = [("bias", 50, p, m, 1, 10.0 + (m == "test")) for p in (1, 2) for m in ("extra", "test")]
    draws = lambda r: spark.createDataFrame(r, "effect string, num_test int, pair int, method string, draw int, pred double")
    assert conditional_differences(draws(rows), ["num_test"]).first()["acc_diff"] == pytest.approx(0.02)
    for broken in (rows[:-1], [*rows[:-1], ("bias", 50, 3, "test", 1, 11.0)]):
        with pytest.raises(Exception, match="only one of its two methods"):
            conditional_differences(draws(broken), ["num_test"]).collect()
