"""Whole runs on small tables: files, reproducibility, plug-in models, analysis."""

from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from triarm.operators import arms, plugins
from triarm.operators.sampling import replicate_splits
from triarm.plans import run as runs
from triarm.sources import results
from triarm.sources.specs import DatasetSpec

WORDS = {0: ["red", "rose", "ruby"], 1: ["blue", "sky", "sea"]}


def loader(spark, location):
    """A table where the words give the label away, most of the time."""
    rng = np.random.default_rng(len(location))
    rows = []
    for i in range(240):
        label = int(i % 2)
        source = label if rng.random() < 0.9 else 1 - label
        words = [str(rng.choice(WORDS[source])) for _ in range(3)] + [f"w{rng.integers(0, 50)}" for _ in range(5)]
        rows.append((i, " ".join(words), label))
    return spark.createDataFrame(rows, "row_id long, text string, label int")


SPECS = {n: DatasetSpec(n, ("red", "blue"), "Say the colour.", loader=loader) for n in ("owner/first", "second")}
NOW = datetime(2025, 1, 2, 3, 4, 5)


@pytest.fixture(scope="module")
def home(spark, tmp_path_factory):
    experiment = results.Experiment("nb", "small", num_subsamples=4, num_train=30, num_test=40)
    out = str(tmp_path_factory.mktemp("runs"))
    path = runs.run(spark, experiment, out, specs=SPECS, now=NOW)
    assert path == f"{out}/run-2025-01-02_03-04-05-small"
    return path


def test_files_of_a_run(spark, home):
    assert results.read_manifests(spark, f"{home}/experiment").first()["num_test"] == 40
    accuracy = spark.read.parquet(f"{home}/accuracies")
    assert accuracy.count() == 2 * 4
    means = accuracy.groupBy("dataset").agg(*[F.avg(c).alias(c) for c in ("base", "extra", "test", "majority")])
    assert means.where("least(base, extra, test) > majority").count() == 2
    predictions = spark.read.parquet(f"{home}/predictions")
    assert predictions.count() == 2 * 4 * 40 * 3
    total = F.aggregate("probs", F.lit(0.0), lambda a, x: a + x)
    assert predictions.where(F.abs(total - 1) > 1e-9).isEmpty()
    metrics = spark.read.parquet(f"{home}/train_metrics")
    assert metrics.count() == 2 * 4 * 5
    assert {r["train_type"] for r in metrics.where("split = 'base'").collect()} == {"classification"}


def test_a_run_is_not_overwritten(spark, home):
    experiment = results.Experiment("nb", "small", num_subsamples=4, num_train=30, num_test=40)
    with pytest.raises(Exception, match="(?i)already exists"):
        runs.run(spark, experiment, home.rsplit("/", 1)[0], specs=SPECS, now=NOW)


def test_analysis_of_a_run(spark, home, tmp_path):
    other = spark.read.parquet(f"{home}/accuracies")
    both = other.unionByName(other.withColumn("lm_type", F.lit("other")))
    tables = runs.analyze(both, runs.Analysis(resamples=64, bootstrap=50, replicates=20))
    sizes = {name: df.count() for name, df in tables.items()}
    assert sizes["summary"] == 4 and sizes["groups"] == 4 and sizes["tests"] == 4
    assert sizes["single_subsamples"] == 20 and sizes["effect_interval"] == 1 and sizes["rank_correlation"] == 4
    three = both.unionByName(other.withColumn("lm_type", F.lit("third")))
    pairs = runs.rank_correlations(three).select("lm_type", "other_lm_type").distinct()
    assert pairs.count() == 3 and runs.rank_correlations(other).count() == 0
    with pytest.raises(ValueError, match="absent"):
        runs.rank_correlations(three, (("absent", "third"),))
    runs.write_table(tables["single_subsamples"], f"{tmp_path}/meta")
    schema = "num_train int, num_test int, replicate int, n_subsamples long, effect string, log_odds double, mean double"
    again = runs.read_table(spark, f"{tmp_path}/meta", schema)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, tables["single_subsamples"].collect()))
    with pytest.raises(ValueError):
        runs.Analysis(effect="other")


class Lengths:
    """Scores by text length; what it learned from unlabelled text is its mean length."""

    def __init__(self):
        self.centre = 0.0

    def learn(self, texts):
        self.centre = float(np.mean([len(t) for t in texts]))

    def fit(self, texts, labels):
        self.means = [np.mean([len(t) for t, k in zip(texts, labels) if k == c]) for c in sorted(set(labels))]

    def predict_proba(self, texts):
        scores = np.array([[1 / (1 + abs(len(t) - m)) for m in self.means] for t in texts])
        return scores / scores.sum(axis=1, keepdims=True) + 0 * self.centre


def test_model_of_the_user(spark):
    import sys

    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    data = loader(spark, "x").withColumn("dataset", F.lit("d"))
    splits = replicate_splits(data, 20, 30, 3, by=["dataset"])
    scored = plugins.run_model(data, splits, Lengths)
    counts = {(r["subsample_idx"], r["arm"]): r["count"] for r in scored.groupBy("subsample_idx", "arm").count().collect()}
    assert len(counts) == 9 and set(counts.values()) == {30}
    same = scored.groupBy("subsample_idx", "row_id").agg(F.count_distinct("pred").alias("n"))
    assert same.where("n <> 1").isEmpty()  # this model ignores what it learned


def naive_bayes(texts, splits):
    """The arms by hand, replicate by replicate."""
    from collections import Counter
    from math import exp, log

    out = {}
    for s in {x[0] for x in splits}:
        role = lambda r: [(i, k) for s_, i, k, r_ in splits if s_ == s and r_ == r]
        count = {i: Counter(texts[i].split()) for _, i, _, _ in splits}
        for arm in ("base", "extra", "test"):
            def weight(token):
                if arm == "base":
                    return 1.0
                seen = [i for i, _ in role(arm)]
                return log((1 + len(seen)) / (1 + sum(token in count[i] for i in seen))) + 1
            model = {0: Counter(), 1: Counter()}
            for i, k in role("train"):
                for t, n in count[i].items():
                    model[k][t] += n * weight(t)
            size = len(set(model[0]) | set(model[1]))
            for i, _ in role("test"):
                mass = sum(n * weight(t) for t, n in count[i].items())
                score = []
                for k in (0, 1):
                    total = sum(model[k].values())
                    hits = sum(n * weight(t) * log(model[k][t] + 1) for t, n in count[i].items())
                    prior = log(sum(c == k for _, c in role("train")) / len(role("train")))
                    score.append(prior + (hits - mass * log(total + size)) / mass)
                top = max(score)
                parts = [exp(x - top) for x in score]
                out[s, i, arm] = [p / sum(parts) for p in parts]
    return out


def test_arms_equal_the_formulas(spark):
    data = loader(spark, "abc").withColumn("dataset", F.lit("d"))
    splits = replicate_splits(data, 20, 25, 2, by=["dataset"])
    rows = [(r["subsample_idx"], r["row_id"], r["label"], r["role"]) for r in splits.collect()]
    texts = {r["row_id"]: r["text"] for r in data.collect()}
    expected = naive_bayes(texts, rows)
    found = arms.run_experiment(data, splits).collect()
    assert len(found) == len(expected) == 2 * 25 * 3
    for r in found:
        assert r["probs"] == pytest.approx(expected[r["subsample_idx"], r["row_id"], r["arm"]], abs=1e-9)
