"""Wide to long, back, and joins of result tables."""

from pyspark.sql import functions as F

from triarm.functions.fixed_values import EFFECTS
from triarm.functions.draws import word
from triarm.functions.naming import recode_strict
from triarm.operators import posterior, reshape
from triarm.plans.catalog import query
from triarm.plans.inputs import (
    ACC, CTES, NUM, accuracies, num_correct, per_effect, r6, sql, sql_per_effect, sql_word,
)

CONFIG = ("num_train", "num_test", "lm_type")

# The pair index counts the subsamples of one configuration by dataset and subsample.
CTES["pairs"] = """
  SELECT *, CAST(row_number() OVER (PARTITION BY num_train, num_test, lm_type
                                    ORDER BY dataset, subsample_idx) - 1 AS BIGINT) AS pair
  FROM num_correct"""
PAIRS = (*NUM, "pairs")
IDS = ("num_train", "num_test", "pair", "lm_type", "dataset")


def melted(spark, sf_dir):
    return reshape.melt_num_correct(num_correct(spark, sf_dir), id_vars=IDS, group=CONFIG)


CTES["melted"] = sql_per_effect(lambda e, t, c: " UNION ALL ".join(
    f"SELECT '{e}' AS effect, {', '.join(IDS)}, '{m}' AS method, {m} AS num_correct FROM pairs" for m in (c, t)))
MELTED = (*PAIRS, "melted")


@query("melt_num_correct", sql("SELECT * FROM melted", *MELTED))
def melt_num_correct(spark, sf_dir):
    return melted(spark, sf_dir)


@query("melt_diffs", sql("""
SELECT lm_type, dataset, 'pretraining boost' AS distribution, round(extra - base, 6) AS diff FROM accuracies
UNION ALL SELECT lm_type, dataset, 'evaluation bias', round(test - extra, 6) FROM accuracies""", *ACC))
def melt_diffs(spark, sf_dir):
    long = reshape.melt_differences(accuracies(spark, sf_dir), ["lm_type", "dataset"])
    return long.withColumn("diff", r6("diff"))


@query("recode_names", sql("""
SELECT CASE lm_type WHEN 'lm_a' THEN 'First LM' WHEN 'lm_b' THEN 'Second LM' END AS lm_type,
       'n = ' || num_test AS num_test, count(*) AS n_subsamples
FROM accuracies GROUP BY 1, 2""", *ACC))
def recode_names(spark, sf_dir):
    names = {"lm_a": "First LM", "lm_b": "Second LM"}
    renamed = accuracies(spark, sf_dir).select(
        recode_strict(F.col("lm_type"), names).alias("lm_type"),
        recode_strict(F.col("num_test"), {50: "n = 50", 100: "n = 100"}).alias("num_test"),
    )
    return renamed.groupBy("lm_type", "num_test").agg(F.count(F.lit(1)).alias("n_subsamples"))


@query("union_runs", sql("""
SELECT num_test, count(*) AS n_subsamples, round(avg(test), 6) AS mean_test
FROM (SELECT * FROM accuracies WHERE num_test = 50 UNION ALL SELECT * FROM accuracies WHERE num_test = 100) AS u
GROUP BY 1""", *ACC))
def union_runs(spark, sf_dir):
    acc = accuracies(spark, sf_dir)
    whole = reshape.union_runs(acc.where("num_test = 50"), acc.where("num_test = 100"))
    return whole.groupBy("num_test").agg(
        F.count(F.lit(1)).alias("n_subsamples"), r6(F.avg("test")).alias("mean_test")
    )


@query("pivot_predictions", sql(sql_per_effect(lambda e, t, c: f"""
SELECT '{e}' AS effect, num_train, num_test, lm_type, dataset,
       max(CASE WHEN method = '{t}' THEN num_correct + 0.25 END::DOUBLE) AS treatment,
       max(CASE WHEN method = '{c}' THEN num_correct + 0.25 END::DOUBLE) AS control
FROM melted WHERE effect = '{e}' GROUP BY num_train, num_test, pair, lm_type, dataset"""), *MELTED))
def pivot_predictions(spark, sf_dir):
    long = melted(spark, sf_dir)

    def one(effect):
        rows, (treatment, control) = long.where(F.col("effect") == effect).drop("effect"), EFFECTS[effect]
        predicted = rows.withColumn("pred", F.col("num_correct") + F.lit(0.25))
        wide = reshape.pivot_predictions(rows, predicted, treatment, control, id_vars=IDS)
        return wide.withColumnsRenamed({treatment: "treatment", control: "control"})

    return per_effect(one)


# --- Draw tables: 100 draws around every count --------------------------------

DRAWS = 100


def draw_table(spark, sf_dir):
    """Long draws ``(effect, keys, method, draw, pred)`` of both effects."""
    drawn = melted(spark, sf_dir).withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(DRAWS - 1))))
    key = F.md5(F.concat_ws("|", "effect", *[
        F.col(c).cast("string") for c in ("num_train", "num_test", "lm_type", "dataset", "pair", "method", "draw")
    ]))
    noise = word(key) / F.lit(2.0**31) - F.lit(1.0)
    return drawn.withColumn("pred", F.col("num_correct") + noise).drop("num_correct")


def _sql_draws() -> str:
    key = ("md5(concat_ws('|', effect, num_train, num_test, lm_type, dataset, pair, method, draw))")
    return (f"SELECT effect, num_train, num_test, pair, lm_type, dataset, method, CAST(draw AS INTEGER) AS draw, "
            f"num_correct + (CAST({sql_word(key)} AS DOUBLE) / 2147483648e0 - 1e0) AS pred "
            f"FROM melted AS b CROSS JOIN range({DRAWS}) AS d(draw)")


CTES["draws"] = _sql_draws()
DRAW_CTES = (*MELTED, "draws")


@query("posterior_marginal", sql("""
, per_pair AS (
  SELECT effect, num_train, num_test, draw, lm_type, pair,
         (max(CASE WHEN (effect = 'boost' AND method = 'extra') OR method = 'test' THEN pred END)
          - max(CASE WHEN (effect = 'bias' AND method = 'extra') OR method = 'base' THEN pred END)) / num_test AS d
  FROM draws GROUP BY 1, 2, 3, 4, 5, 6)
SELECT num_train, num_test, draw, round(avg(CASE WHEN effect = 'boost' THEN d END), 6) AS boost,
       round(avg(CASE WHEN effect = 'bias' THEN d END), 6) AS bias
FROM per_pair GROUP BY 1, 2, 3""", *DRAW_CTES))
def posterior_marginal(spark, sf_dir):
    diffs = posterior.marginal_differences(draw_table(spark, sf_dir), ["num_train", "num_test"])
    return diffs.withColumns({e: r6(e) for e in EFFECTS})


@query("posterior_conditional", sql("""
SELECT effect, num_train, num_test, lm_type, dataset, draw,
       round(avg(CASE WHEN (effect = 'boost' AND method = 'extra') OR method = 'test' THEN pred END), 6) AS treatment,
       round(avg(CASE WHEN (effect = 'bias' AND method = 'extra') OR method = 'base' THEN pred END), 6) AS control,
       round((avg(CASE WHEN (effect = 'boost' AND method = 'extra') OR method = 'test' THEN pred END)
        - avg(CASE WHEN (effect = 'bias' AND method = 'extra') OR method = 'base' THEN pred END)) / num_test, 6)
       AS acc_diff
FROM draws GROUP BY 1, 2, 3, 4, 5, 6""", *DRAW_CTES))
def posterior_conditional(spark, sf_dir):
    diffs = posterior.conditional_differences(
        draw_table(spark, sf_dir), ["num_train", "num_test", "lm_type", "dataset"]
    )
    return diffs.withColumns({c: r6(c) for c in ("treatment", "control", "acc_diff")})


@query("calibration_join", sql(f"""
, p AS ({sql_per_effect(lambda e, t, c: f"""
  SELECT '{e}' AS effect, num_train, num_test, lm_type, dataset,
         avg(CASE WHEN method = '{c}' THEN pred END) / num_test AS level,
         (avg(CASE WHEN method = '{t}' THEN pred END) - avg(CASE WHEN method = '{c}' THEN pred END)) / num_test AS diff
  FROM draws WHERE effect = '{e}' GROUP BY 2, 3, 4, 5""")}),
  o AS ({sql_per_effect(lambda e, t, c: f"""
  SELECT '{e}' AS effect, num_train, num_test, lm_type, dataset, avg({c} / CAST(num_test AS DOUBLE)) AS level,
         avg(({t} - {c}) / CAST(num_test AS DOUBLE)) AS diff
  FROM num_correct GROUP BY 2, 3, 4, 5""")})
SELECT effect, num_train, num_test, lm_type, dataset, round(p.level, 6) AS pred_level, round(o.level, 6) AS obs_level,
       round(p.diff, 6) AS pred_effect, round(o.diff, 6) AS obs_effect
FROM p JOIN o USING (effect, num_train, num_test, lm_type, dataset)""", *DRAW_CTES))
def calibration_join(spark, sf_dir):
    group = ["num_train", "num_test", "lm_type", "dataset"]
    draws, counts = draw_table(spark, sf_dir), num_correct(spark, sf_dir)
    joined = per_effect(lambda e: posterior.calibration(draws.where(F.col("effect") == e), counts, e, group))
    return joined.withColumns({c: r6(c) for c in joined.columns if c not in (*group, "effect")})


@query("hdi_summary", sql("""
, diffs AS (SELECT effect, num_train, num_test, lm_type, dataset, draw,
                   (avg(CASE WHEN (effect = 'boost' AND method = 'extra') OR method = 'test' THEN pred END)
                    - avg(CASE WHEN (effect = 'bias' AND method = 'extra') OR method = 'base' THEN pred END)) / num_test
                   AS v
            FROM draws GROUP BY 1, 2, 3, 4, 5, 6),
  sorted AS (SELECT *, row_number() OVER w AS pos, count(*) OVER (PARTITION BY effect, num_train, num_test, lm_type, dataset) AS n
             FROM diffs WINDOW w AS (PARTITION BY effect, num_train, num_test, lm_type, dataset ORDER BY v, draw)),
  spans AS (SELECT a.effect, a.num_train, a.num_test, a.lm_type, a.dataset, a.v AS lo, b.v AS hi, a.pos
            FROM sorted AS a JOIN sorted AS b
              ON a.effect = b.effect AND a.num_train = b.num_train AND a.num_test = b.num_test
             AND a.lm_type = b.lm_type AND a.dataset = b.dataset AND b.pos = a.pos + CAST(floor(0.89 * a.n) AS BIGINT))
SELECT s.effect, s.num_train, s.num_test, s.lm_type, s.dataset, round(m.mean, 6) AS mean, round(m.sd, 6) AS sd,
       round(min_by(s.lo, (round(s.hi - s.lo, 9), s.pos)), 6) AS hdi_low,
       round(min_by(s.hi, (round(s.hi - s.lo, 9), s.pos)), 6) AS hdi_high
FROM spans AS s JOIN (SELECT effect, num_train, num_test, lm_type, dataset, avg(v) AS mean, stddev_samp(v) AS sd
                      FROM diffs GROUP BY 1, 2, 3, 4, 5) AS m USING (effect, num_train, num_test, lm_type, dataset)
GROUP BY 1, 2, 3, 4, 5, m.mean, m.sd""", *DRAW_CTES))
def hdi_summary(spark, sf_dir):
    group = ["effect", "num_train", "num_test", "lm_type", "dataset"]
    diffs = posterior.conditional_differences(draw_table(spark, sf_dir), group[1:])
    table = posterior.draw_summary(diffs, group, "acc_diff", "draw")
    return table.withColumns({c: r6(c) for c in ("mean", "sd", "hdi_low", "hdi_high")})


@query("extreme_share", sql("""
, diffs AS (SELECT effect, num_train, num_test, lm_type, dataset, draw,
                   (avg(CASE WHEN (effect = 'boost' AND method = 'extra') OR method = 'test' THEN pred END)
                    - avg(CASE WHEN (effect = 'bias' AND method = 'extra') OR method = 'base' THEN pred END)) / num_test
                   AS v
            FROM draws GROUP BY 1, 2, 3, 4, 5, 6),
  ends AS (SELECT effect, num_train, num_test, lm_type, dataset, avg(v) AS mean, min(v) AS lo, max(v) AS hi
           FROM diffs GROUP BY 1, 2, 3, 4, 5)
SELECT effect, count(*) AS n, round(avg((abs(mean) > 0.04)::INTEGER), 6) AS extreme_share,
       round(avg(CASE WHEN abs(mean) > 0.04 THEN ((lo > 0) = (hi > 0))::INTEGER END), 6) AS one_sided_share
FROM ends GROUP BY 1""", *DRAW_CTES))
def extreme_share(spark, sf_dir):
    group = ["num_train", "num_test", "lm_type", "dataset"]
    diffs = posterior.conditional_differences(draw_table(spark, sf_dir), group)
    ends = diffs.groupBy("effect", *group).agg(
        F.avg("acc_diff").alias("mean"), F.min("acc_diff").alias("hdi_low"), F.max("acc_diff").alias("hdi_high")
    )
    shares = posterior.extreme_share(ends, 0.04, ["effect"])
    return shares.withColumns({"extreme_share": r6("extreme_share"), "one_sided_share": r6("one_sided_share")})
