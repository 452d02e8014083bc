"""Whole runs: an experiment from datasets to result tables, and its analysis."""

from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime
from functools import reduce
from itertools import combinations

from pyspark.sql import DataFrame, SparkSession, functions as F

from triarm.functions.fixed_values import ARMS, EFFECTS, REPLICATE_GROUP
from triarm.operators import arms, correlation, effects, permutation, posterior, sampling, scoring, summary, validate
from triarm.sources import results
from triarm.sources.datasets import load_dataset
from triarm.sources.scratch import stored
from triarm.sources.specs import REGISTRY, DatasetSpec, dataset_names

Predict = Callable[[DataFrame, DataFrame], DataFrame]


def canonical_datasets(spark: SparkSession, specs: list[DatasetSpec], root: str | None) -> DataFrame:
    """All datasets, checked, as one table keyed by ``dataset``."""
    whole = None
    for spec in specs:
        rows = load_dataset(spark, spec, root).select(
            F.lit(spec.name).alias("dataset"), F.col("row_id").cast("string").alias("row_id"), "text", "label"
        )
        whole = rows if whole is None else whole.unionByName(rows)
    return whole


def run(
    spark: SparkSession,
    experiment: results.Experiment,
    out: str,
    root: str | None = None,
    specs: dict[str, DatasetSpec] | None = None,
    predict: Predict = arms.run_experiment,
    now: datetime | None = None,
) -> str:
    """Run an experiment below ``out``; return the path of its folder.

    Datasets and replicates go through one plan. ``predict`` makes the predictions of
    all arms from (data, splits): the built-in arms, or a user's model. The folder
    gets the manifest, the predictions, the training records and the accuracies;
    nothing that exists is overwritten.
    """
    known = REGISTRY if specs is None else specs
    names = dataset_names(experiment.dataset_names or known)
    home = f"{out}/{experiment.run_id(now or datetime.now())}"
    results.write_manifest(spark, experiment, f"{home}/experiment")

    data = canonical_datasets(spark, [known[n] for n in names], root)
    splits = sampling.replicate_splits(
        data, experiment.num_train, experiment.num_test, experiment.num_subsamples, by=["dataset"]
    )
    cell = ["dataset", "subsample_idx"]
    classes = F.create_map(*[F.lit(x) for n in names for x in (known[n].name, len(known[n].class_names))])
    predicted = validate.require_probabilities(predict(data, splits), classes[F.col("dataset")])
    results.write_predictions(predicted, f"{home}/predictions")
    scored = spark.read.parquet(f"{home}/predictions")

    records = [
        results.train_record(F.lit(arm), F.lit(step), None if trained is None else F.col(trained))
        for arm, step, trained in [
            ("base", "classification", "n_train"),
            *[(a, s, c) for a in ARMS[1:] for s, c in (("pretrain", f"n_{a}"), ("classification", "n_train"))],
        ]
    ]
    seen = [F.count_if(F.col("role") == r).alias(f"n_{r}") for r in ("train", "extra", "test")]
    steps = splits.groupBy(*cell).agg(*seen).select(*cell, F.inline(F.array(*records)))
    results.write_train_metrics(steps, f"{home}/train_metrics")

    wide = scoring.arms_to_columns(scored, [*cell, "row_id", "label"], "pred", prefix="pred_")
    accuracy = scoring.with_dataset_constants(scoring.accuracies(wide, cell), data.select("dataset", "label"))
    keyed = accuracy.withColumns({
        "num_train": F.lit(experiment.num_train), "num_test": F.lit(experiment.num_test),
        "lm_type": F.lit(experiment.lm_type),
    })
    results.write_accuracies(keyed, f"{home}/accuracies")
    return home


@dataclass(frozen=True)
class Analysis:
    """Settings of an analysis of an accuracy table."""

    effect: str = "bias"
    resamples: int = 10_000
    bootstrap: int = 1_000
    replicates: int = 500
    threshold: float = 0.03
    pairs: tuple[tuple[str, str], ...] | None = None  # LM types to correlate; all pairs by default

    def __post_init__(self):
        if self.effect not in EFFECTS:
            raise ValueError(f"the effect is one of {sorted(EFFECTS)}")


def analyze(accuracy: DataFrame, analysis: Analysis = Analysis()) -> dict[str, DataFrame]:
    """The result tables of an analysis, by name. The accuracy table is stored first, as all read it."""
    table = stored(accuracy, "accuracies")
    config = ["num_train", "num_test"]
    counts = summary.num_correct(table, F.col("num_test"))
    tests = permutation.sign_flip_test(
        table, summary.effect(analysis.effect), list(REPLICATE_GROUP), ["subsample_idx"], analysis.resamples
    )
    stats = summary.group_stats(table)
    boot = effects.bootstrap_effect(counts, analysis.effect, analysis.bootstrap, config)
    out = {
        "summary": summary.summary_table(table),
        "groups": stats,
        "large_effects": summary.beyond(stats, analysis.threshold, f"{analysis.effect}_mean"),
        "datasets": summary.dataset_rollup(stats),
        "tests": permutation.adjust_fdr(tests, family=[*config, "lm_type"]),
        "effect": effects.log_odds_effect(counts, analysis.effect, [*config, "lm_type"]),
        "effect_interval": posterior.draw_summary(boot, config, "log_odds", "replicate"),
        "single_subsamples": effects.meta_replicates(
            counts, [analysis.effect], ["subsample_idx"], analysis.replicates, config=config
        ),
    }
    out["rank_correlation"] = rank_correlations(table, analysis.pairs)
    return out


def rank_correlations(accuracy: DataFrame, pairs: tuple[tuple[str, str], ...] | None = None) -> DataFrame:
    """Rank correlation of every pair of LM types, named by ``lm_type`` and ``other_lm_type``.

    One LM type has no pair, so no rows. A named type that is not in the table is refused.
    """
    types = sorted(r["lm_type"] for r in accuracy.select("lm_type").distinct().collect())
    chosen = tuple(combinations(types, 2)) if pairs is None else pairs
    if absent := sorted({t for pair in chosen for t in pair} - set(types)):
        raise ValueError(f"no results of the LM types {absent}")
    named = lambda pair: correlation.spearman_between(accuracy, pair).select(
        F.lit(pair[0]).alias("lm_type"), F.lit(pair[1]).alias("other_lm_type"), "*")
    if not chosen:
        return named(("", "")).where("false")
    return reduce(DataFrame.unionByName, map(named, chosen))


def write_table(df: DataFrame, path: str) -> None:
    """A small result table as CSV with a header."""
    df.write.mode("errorifexists").option("header", True).csv(path)


def read_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)
