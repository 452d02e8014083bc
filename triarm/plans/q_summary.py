"""Scoring and summaries of the accuracy table."""

from pyspark.sql import functions as F

from triarm.functions.fixed_values import EFFECTS
from triarm.operators import scoring, summary
from triarm.plans.catalog import query
from triarm.sources.scratch import stored
from triarm.plans.inputs import ACC, NUM, accuracies, datasets, full_accuracies, num_correct, per_effect, r6, sql, sql_per_effect

KEYS = ("num_train", "num_test", "lm_type", "dataset", "subsample_idx")
GROUP = ("num_train", "num_test", "lm_type", "dataset")


@query("accuracy", sql("""
SELECT num_train, num_test, lm_type, dataset, subsample_idx, num_classes, round(base, 6) AS base,
       round(extra, 6) AS extra, round(test, 6) AS test, round(majority, 6) AS majority,
       round(majority_all, 6) AS majority_all
FROM accuracies""", *ACC))
def accuracy(spark, sf_dir):
    rounded = [r6(c).alias(c) for c in ("base", "extra", "test", "majority", "majority_all")]
    return full_accuracies(spark, sf_dir).select(*KEYS, "num_classes", *rounded)


@query("summary_table", sql("""
, means AS (SELECT num_train, num_test, lm_type, dataset, avg(extra - base) AS boost, avg(test - extra) AS bias
            FROM accuracies GROUP BY 1, 2, 3, 4)
SELECT num_train, num_test, lm_type, effect, round(avg(v), 6) AS mean,
       round(stddev_samp(v) / sqrt(count(*)), 6) AS se
FROM (SELECT num_train, num_test, lm_type, 'boost' AS effect, boost AS v FROM means
      UNION ALL SELECT num_train, num_test, lm_type, 'bias', bias FROM means) AS u
GROUP BY 1, 2, 3, 4""", *ACC))
def summary_table(spark, sf_dir):
    table = summary.summary_table(accuracies(spark, sf_dir))
    return table.withColumns({"mean": r6("mean"), "se": r6("se")})


def _effect_sql(name: str) -> str:
    treatment, control = EFFECTS[name]
    return f"{treatment} - {control}"


@query("paired_diff", sql("""
SELECT num_train, num_test, lm_type, dataset, subsample_idx,
       round(extra - base, 6) AS boost, round(test - extra, 6) AS bias FROM accuracies""", *ACC))
def paired_diff(spark, sf_dir):
    diffs = summary.paired_differences(accuracies(spark, sf_dir))
    return diffs.select(*KEYS, r6("boost").alias("boost"), r6("bias").alias("bias"))


@query("relative_diff", sql("""
SELECT num_train, num_test, lm_type, dataset, subsample_idx,
       round(CASE WHEN base <> 0 THEN (extra - base) / base END, 6) AS boost_relative,
       round(CASE WHEN extra <> 0 THEN (test - extra) / extra END, 6) AS bias_relative FROM accuracies""", *ACC))
def relative_diff(spark, sf_dir):
    return accuracies(spark, sf_dir).select(
        *KEYS,
        r6(summary.relative_difference("extra", "base")).alias("boost_relative"),
        r6(summary.relative_difference("test", "extra")).alias("bias_relative"),
    )


@query("num_correct", sql("""
SELECT num_train, num_test, lm_type, dataset, subsample_idx, num_classes, base, extra, test, majority, majority_all
FROM num_correct""", *NUM))
def num_correct_counts(spark, sf_dir):
    return num_correct(spark, sf_dir, full_accuracies).select(
        *KEYS, "num_classes", "base", "extra", "test", "majority", "majority_all"
    )


@query("majority_share", sql("""
SELECT dataset, round(majority_all, 6) AS majority_all, num_classes
FROM (SELECT dataset, max(n) / CAST(sum(n) AS DOUBLE) AS majority_all, CAST(count(*) AS INTEGER) AS num_classes
      FROM (SELECT dataset, label, CAST(count(*) AS DOUBLE) AS n FROM datasets GROUP BY 1, 2) AS c GROUP BY 1) AS s
""", "docs", "quality", "datasets"))
def majority_share(spark, sf_dir):
    shares = scoring.majority_share(datasets(spark, sf_dir), ["dataset"])
    return shares.withColumn("majority_all", r6("majority_all"))


@query("diff_summary", sql("""
, per_group AS (SELECT DISTINCT count(*) AS k FROM accuracies GROUP BY num_train, num_test, lm_type, dataset)
""" + sql_per_effect(lambda e, t, c: f"""
SELECT '{e}' AS effect, dataset, round(avg({t} - {c}), 6) AS mean,
       round(stddev_samp({t} - {c}) / sqrt((SELECT max(k) FROM per_group)), 6) AS se
FROM accuracies GROUP BY dataset"""), *ACC))
def diff_summary(spark, sf_dir):
    acc = accuracies(spark, sf_dir)
    table = per_effect(lambda e: summary.difference_summary(acc, summary.effect(e)))
    return table.withColumns({"mean": r6("mean"), "se": r6("se")})


@query("eda_overall", sql(f"""
, means AS ({sql_per_effect(lambda e, t, c: f"""
  SELECT '{e}' AS effect, dataset, avg({t} - {c}) AS raw, avg(CASE WHEN {c} <> 0 THEN ({t} - {c}) / {c} END) AS relative
  FROM accuracies GROUP BY dataset""")})
SELECT effect, 'raw' AS difference, round(avg(raw), 6) AS mean,
       round(stddev_samp(raw) / sqrt(count(*)), 6) AS se FROM means GROUP BY 1
UNION ALL
SELECT effect, 'relative', round(avg(relative), 6), round(stddev_samp(relative) / sqrt(count(*)), 6) FROM means GROUP BY 1""", *ACC))
def eda_overall(spark, sf_dir):
    acc = accuracies(spark, sf_dir)
    table = per_effect(lambda e: summary.overall_difference(acc, *EFFECTS[e]))
    return table.withColumns({"mean": r6("mean"), "se": r6("se")})


@query("eda_datasets", sql(sql_per_effect(lambda e, t, c: f"""
SELECT '{e}' AS effect, lm_type, num_train, num_test, dataset, count(*) AS n, round(avg({t} - {c}), 6) AS raw_mean,
       round(stddev_samp({t} - {c}) / sqrt(count(*)), 6) AS raw_se,
       round(avg(CASE WHEN {c} <> 0 THEN ({t} - {c}) / {c} END), 6) AS relative_mean,
       round(stddev_samp(CASE WHEN {c} <> 0 THEN ({t} - {c}) / {c} END) / sqrt(count(CASE WHEN {c} <> 0 THEN 1 END)), 6) AS relative_se
FROM accuracies GROUP BY lm_type, num_train, num_test, dataset"""), *ACC))
def eda_datasets(spark, sf_dir):
    """Raw and relative effect of every dataset, all of which must hold equally many replicates."""
    acc = stored(accuracies(spark, sf_dir), "accuracies")
    group = ["lm_type", "num_train", "num_test", "dataset"]
    table = per_effect(lambda e: summary.effects_of_groups(acc, *EFFECTS[e], group))
    return table.withColumns({c: r6(c) for c in ("raw_mean", "raw_se", "relative_mean", "relative_se")})


@query("summary_two_level", sql(f"""
, means AS ({sql_per_effect(lambda e, t, c: f"""
  SELECT '{e}' AS effect, num_test, lm_type, dataset, avg({t} - {c}) AS v FROM accuracies GROUP BY ALL""")})
SELECT effect, num_test, lm_type, round(avg(v), 6) AS mean, round(stddev_samp(v) / sqrt(count(*)), 6) AS se
FROM means GROUP BY 1, 2, 3""", *ACC))
def summary_two_level(spark, sf_dir):
    acc = accuracies(spark, sf_dir)
    table = per_effect(lambda e: summary.two_level_summary(acc, summary.effect(e)))
    return table.withColumns({"mean": r6("mean"), "se": r6("se")})


_STATS = """
, stats AS (SELECT num_train, num_test, lm_type, dataset,
                   avg(extra - base) AS boost_mean, stddev_samp(extra - base) / sqrt(count(*)) AS boost_se,
                   avg(test - extra) AS bias_mean, stddev_samp(test - extra) / sqrt(count(*)) AS bias_se
            FROM accuracies GROUP BY 1, 2, 3, 4)"""


@query("group_stats", sql(_STATS + """
SELECT num_train, num_test, lm_type, dataset, round(boost_mean, 6) AS boost_mean, round(boost_se, 6) AS boost_se,
       round(bias_mean, 6) AS bias_mean, round(bias_se, 6) AS bias_se FROM stats""", *ACC))
def group_stats(spark, sf_dir):
    stats = summary.group_stats(accuracies(spark, sf_dir))
    return stats.withColumns({c: r6(c) for c in ("boost_mean", "boost_se", "bias_mean", "bias_se")})


@query("effect_threshold", sql(_STATS + sql_per_effect(lambda e, t, c: f"""
SELECT '{e}' AS effect, num_train, num_test, lm_type, dataset, round({e}_mean, 6) AS mean, round({e}_se, 6) AS se,
       CASE WHEN {e}_mean > 0 THEN 'above' ELSE 'below' END AS side
FROM stats WHERE {e}_mean > 0.03 OR {e}_mean < -0.03"""), *ACC))
def effect_threshold(spark, sf_dir):
    stats = summary.group_stats(accuracies(spark, sf_dir))

    def one(effect):
        side = lambda threshold, name: summary.beyond(stats, threshold, f"{effect}_mean").withColumn("side", F.lit(name))
        both = side(0.03, "above").unionByName(side(-0.03, "below"))
        return both.select(*GROUP, r6(f"{effect}_mean").alias("mean"), r6(f"{effect}_se").alias("se"), "side")

    return per_effect(one)


@query("dataset_rollup", sql(_STATS + """
SELECT dataset, round(avg(boost_mean), 6) AS boost_mean, round(avg(bias_mean), 6) AS bias_mean,
       round(avg(CASE WHEN boost_mean < 0 THEN 1.0 ELSE 0.0 END::DOUBLE), 6) AS frac_boost_lt_0,
       round(avg(CASE WHEN bias_mean > 0 THEN 1.0 ELSE 0.0 END::DOUBLE), 6) AS frac_bias_gt_0
FROM stats GROUP BY 1""", *ACC))
def dataset_rollup(spark, sf_dir):
    rollup = summary.dataset_rollup(summary.group_stats(accuracies(spark, sf_dir)))
    return rollup.withColumns({c: r6(c) for c in rollup.columns if c != "dataset"})


@query("first_majority", sql("""
SELECT num_train, num_test, lm_type, dataset, max(num_classes) AS num_classes,
       round(min_by(majority, subsample_idx), 6) AS majority
FROM accuracies GROUP BY 1, 2, 3, 4""", *ACC))
def first_majority(spark, sf_dir):
    return summary.first_majority(full_accuracies(spark, sf_dir)).withColumn("majority", r6("majority"))


@query("outlier_filter", sql("""
SELECT num_train, num_test, lm_type, dataset, subsample_idx, round(extra, 6) AS extra, round(test, 6) AS test
FROM accuracies WHERE extra > 0.43 AND test > 0.43""", *ACC))
def outlier_filter(spark, sf_dir):
    kept = summary.drop_outliers(accuracies(spark, sf_dir), 0.43)
    return kept.select(*KEYS, r6("extra").alias("extra"), r6("test").alias("test"))
