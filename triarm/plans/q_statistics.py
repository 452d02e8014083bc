"""Tests, correlations, curves and effects."""

from pyspark.sql import functions as F

from triarm.functions.fixed_values import ARMS, EFFECTS
from triarm.operators import correlation, density, effects, permutation, posterior, regression, summary
from triarm.operators.describe import describe_series
from triarm.operators.leaderboard import rank_gaps as gaps
from triarm.plans.catalog import query
from triarm.plans.inputs import (
    ACC, CTES, NUM, accuracies, num_correct, per_effect, predictions, r6, sql, sql_per_effect, sql_row_word, sql_seed_key, sql_word,
)
from triarm.plans.run import rank_correlations
from triarm.sources.scratch import stored

CONFIG = ["num_train", "num_test"]
GROUP = [*CONFIG, "lm_type", "dataset"]
G4 = "num_train, num_test, lm_type, dataset"
RESAMPLES = 10_000
EXACT_RESAMPLES = 70_000
TYPES = ("lm_a", "lm_b")

CTES["effect_rows"] = sql_per_effect(
    lambda e, t, c: f"SELECT {G4}, subsample_idx, '{e}' AS effect, {t} - {c} AS d FROM accuracies")
G_EFFECT = f"{G4}, effect"
CTES["flips"] = f"""
  SELECT {G_EFFECT}, b * 32 + j AS r, sum(CASE WHEN substr(h, j + 1, 1) >= '8' THEN d ELSE -d END) AS s
  FROM (SELECT {G_EFFECT}, d, b, md5('flip|0|' || b || '|' || subsample_idx) AS h
        FROM effect_rows CROSS JOIN range({-(-RESAMPLES // 32)}) AS x(b)) AS k CROSS JOIN range(32) AS y(j)
  GROUP BY ALL"""
CTES["observed"] = f"SELECT {G_EFFECT}, count(*) AS n, sum(d) AS s FROM effect_rows GROUP BY ALL"
CTES["tests"] = f"""
  SELECT {G_EFFECT}, o.n, o.s / o.n AS mean,
         (count(*) FILTER (WHERE f.s >= o.s - 1e-9 * o.n) + 1) / CAST({RESAMPLES} + 1 AS DOUBLE) AS p_value
  FROM flips AS f JOIN observed AS o USING ({G_EFFECT}) WHERE f.r < {RESAMPLES} GROUP BY {G_EFFECT}, o.n, o.s"""
OBSERVED = (*ACC, "effect_rows", "observed")
TESTS = (*OBSERVED, "flips", "tests")


def effect_rows(spark, sf_dir):
    """A row for each replicate and effect."""
    wide = summary.paired_differences(accuracies(spark, sf_dir))
    return wide.unpivot([*GROUP, "subsample_idx"], list(EFFECTS), "effect", "diff")


def tests(spark, sf_dir, resamples=RESAMPLES):
    return permutation.sign_flip_test(
        effect_rows(spark, sf_dir), F.col("diff"), [*GROUP, "effect"], ["subsample_idx"], resamples)


@query("permutation_test", sql(f"""
SELECT {G_EFFECT}, n, round(mean, 6) AS mean, round(p_value, 6) AS p_value FROM tests""", *TESTS))
def permutation_test(spark, sf_dir):
    return tests(spark, sf_dir).withColumns({"mean": r6("mean"), "p_value": r6("p_value")})


@query("permutation_test_exact", sql(f"""
, rows AS (SELECT {G_EFFECT}, d, CAST(row_number() OVER (PARTITION BY {G_EFFECT} ORDER BY subsample_idx) - 1 AS INTEGER) AS i
           FROM effect_rows),
  patterns AS (SELECT {G_EFFECT}, p, sum(CASE WHEN (p >> i) & 1 = 1 THEN d ELSE -d END) AS s
               FROM rows CROSS JOIN range(65536) AS x(p) GROUP BY ALL)
SELECT {G_EFFECT}, o.n, round(o.s / o.n, 6) AS mean,
       round(count(*) FILTER (WHERE p.s >= o.s - 1e-9 * o.n) / 65536e0, 6) AS p_value
FROM patterns AS p JOIN observed AS o USING ({G_EFFECT}) GROUP BY {G_EFFECT}, o.n, o.s""", *OBSERVED))
def permutation_test_exact(spark, sf_dir):
    """16 subsamples have 65,536 sign patterns: few enough to take all of them."""
    table = tests(spark, sf_dir, EXACT_RESAMPLES)
    return table.withColumns({"mean": r6("mean"), "p_value": r6("p_value")})


FAMILY = "num_train, num_test, lm_type, effect"


@query("fdr_bh", sql(f"""
, ranked AS (SELECT *, rank() OVER (PARTITION BY {FAMILY} ORDER BY p_value)
                      + count(*) OVER (PARTITION BY {FAMILY}, p_value) - 1 AS k,
                    count(*) OVER (PARTITION BY {FAMILY}) AS m FROM tests)
SELECT {G_EFFECT}, round(p_value, 3) AS p_value,
       round(least(1, min(p_value * m / k) OVER (PARTITION BY {FAMILY} ORDER BY p_value DESC)), 3) AS p_adjusted
FROM ranked""", *TESTS))
def fdr_bh(spark, sf_dir):
    table = permutation.adjust_fdr(tests(spark, sf_dir), "p_value", [*CONFIG, "lm_type", "effect"])
    key = [*GROUP, "effect"]
    rounded = table.select(*key, F.round("p_value", 3).alias("p_value"), F.round("p_adjusted", 3).alias("p_adjusted"))
    return rounded.orderBy("p_value", *key)


_EFFECTS = """
  SELECT num_train, num_test, dataset, lm_type, subsample_idx, 'boost' AS effect, round(extra - base, 9) AS diff FROM accuracies
  UNION ALL SELECT num_train, num_test, dataset, lm_type, subsample_idx, 'bias', round(test - extra, 9) FROM accuracies"""


def _sql_spearman(source: str, keys: str, match: str, types: tuple[str, str] = TYPES) -> str:
    return f"""
  SELECT {keys}, count(*) AS n,
         CASE WHEN stddev_samp(rx) > 0 AND stddev_samp(ry) > 0 THEN corr(rx, ry) END AS spearman
  FROM (SELECT {keys}, rank() OVER wx + (count(*) OVER (PARTITION BY {keys}, x) - 1) / 2e0 AS rx,
               rank() OVER wy + (count(*) OVER (PARTITION BY {keys}, y) - 1) / 2e0 AS ry
        FROM (SELECT {keys}, {match}, max(diff) FILTER (WHERE lm_type = '{types[0]}') AS x,
                     max(diff) FILTER (WHERE lm_type = '{types[1]}') AS y FROM {source} GROUP BY {keys}, {match}) AS p
        WHERE x IS NOT NULL AND y IS NOT NULL
        WINDOW wx AS (PARTITION BY {keys} ORDER BY x), wy AS (PARTITION BY {keys} ORDER BY y)) AS r
  GROUP BY {keys}"""


@query("spearman_groups", sql(f"""
, rows AS ({_EFFECTS}), s AS ({_sql_spearman('rows', 'num_train, num_test, dataset, effect', 'subsample_idx')})
SELECT num_train, num_test, dataset, effect, n, round(spearman, 6) AS spearman FROM s""", *ACC))
def spearman_groups(spark, sf_dir):
    return correlation.spearman_between(stored(accuracies(spark, sf_dir), "accuracies"), TYPES).withColumn("spearman", r6("spearman"))


THREE = (("lm_a", "lm_b"), ("lm_a", "lm_c"), ("lm_b", "lm_c"))


@query("spearman_pairs", sql(f"""
, three AS (SELECT num_train, num_test, dataset, lm_type, subsample_idx, base, extra, test FROM accuracies
            UNION ALL SELECT num_train, num_test, dataset, 'lm_c', 17 - subsample_idx, base, extra, test
            FROM accuracies WHERE lm_type = 'lm_b'),
  rows AS ({_EFFECTS.replace('accuracies', 'three')})
{' UNION ALL '.join(f"""SELECT '{t[0]}' AS lm_type, '{t[1]}' AS other_lm_type, num_train, num_test, dataset, effect, n,
       round(spearman, 6) AS spearman
FROM ({_sql_spearman('rows', 'num_train, num_test, dataset, effect', 'subsample_idx', t)}) AS s""" for t in THREE)}""", *ACC))
def spearman_pairs(spark, sf_dir):
    """Three LM types: every pair of them."""
    acc = accuracies(spark, sf_dir)
    third = acc.where("lm_type = 'lm_b'").withColumns({"lm_type": F.lit("lm_c"), "subsample_idx": 17 - F.col("subsample_idx")})
    return rank_correlations(stored(acc.unionByName(third), "accuracies")).withColumn("spearman", r6("spearman"))


SHUFFLES = 10
_NULL_COLUMNS = [(e, i) for e in ("boost", "bias") for i in range(SHUFFLES)]


@query("spearman_null", sql(f"""
, places AS (SELECT *, row_number() OVER (PARTITION BY num_train, num_test, dataset, shuffle, lm_type ORDER BY
               md5('shuffle|0|' || num_train || '|' || num_test || '|' || dataset || '|' || lm_type || '|' || shuffle
                   || '|' || subsample_idx)) AS place
             FROM accuracies CROSS JOIN range({SHUFFLES}) AS x(shuffle)),
  rows AS (SELECT num_train, num_test, dataset, shuffle, lm_type, place, 'boost' AS effect, round(extra - base, 9) AS diff FROM places
           UNION ALL SELECT num_train, num_test, dataset, shuffle, lm_type, place, 'bias', round(test - extra, 9) FROM places),
  s AS ({_sql_spearman('rows', 'num_train, num_test, dataset, effect, shuffle', 'place')})
SELECT num_train, num_test, dataset, {', '.join(
    f"round(max(spearman) FILTER (WHERE effect = '{e}' AND shuffle = {i}), 6) AS {e}_{i}" for e, i in _NULL_COLUMNS)}
FROM s GROUP BY 1, 2, 3""", *ACC))
def spearman_null(spark, sf_dir):
    null = correlation.spearman_null(stored(accuracies(spark, sf_dir), "accuracies"), TYPES, SHUFFLES)
    return null.withColumns({f"{e}_{i}": r6(f"{e}_{i}") for e, i in _NULL_COLUMNS})


@query("kde_grid", sql("""
, v AS (SELECT lm_type, dataset, effect, round(d, 9) AS v FROM effect_rows),
  s AS (SELECT lm_type, dataset, effect, count(*) AS n, stddev_samp(v) * pow(count(*), -0.2) AS h, min(v) AS lo, max(v) AS hi
        FROM v GROUP BY ALL),
  g AS (SELECT *, lo - 3 * h AS low, (hi - lo + 6 * h) / 199 AS step FROM s WHERE h > 0),
  a AS (SELECT *, (v - low) / step AS place, CAST(least(floor((v - low) / step), 198) AS INTEGER) AS cell
        FROM v JOIN g USING (lm_type, dataset, effect)),
  w AS (SELECT lm_type, dataset, effect, p, sum(w) AS w
        FROM (SELECT lm_type, dataset, effect, cell AS p, 1 - (place - cell) AS w FROM a
              UNION ALL SELECT lm_type, dataset, effect, cell + 1, place - cell FROM a) AS u GROUP BY ALL)
SELECT lm_type, dataset, effect, CAST(i AS INTEGER) AS point, round(low + i * step, 6) AS x,
       round(sum(w * exp(-0.5 * pow((i - p) * step / h, 2))) / (n * h * sqrt(2 * pi())), 6) AS density
FROM w JOIN g USING (lm_type, dataset, effect) CROSS JOIN range(200) AS r(i) GROUP BY lm_type, dataset, effect, i, low, step, n, h""",
    *ACC, "effect_rows"))
def kde_grid(spark, sf_dir):
    curves = density.kernel_density(effect_rows(spark, sf_dir), "diff", ["lm_type", "dataset", "effect"])
    return curves.withColumns({"x": r6("x"), "density": r6("density")})


# --- Effects -------------------------------------------------------------------

def _sql_logit(hits: str, trials: str) -> str:
    return f"ln(({hits} + 0.5e0) / ({trials} - {hits} + 0.5e0))"


@query("effect_log_odds", sql(f"""
, s AS ({sql_per_effect(lambda e, t, c: f"""
  SELECT num_train, num_test, lm_type, '{e}' AS effect, CAST(sum({t}) AS DOUBLE) AS t, CAST(sum({c}) AS DOUBLE) AS c,
         CAST(sum(num_test) AS DOUBLE) AS n FROM num_correct GROUP BY 1, 2, 3""")})
SELECT num_train, num_test, lm_type, effect,
       round({_sql_logit('t', 'n')} - {_sql_logit('c', 'n')}, 6) AS log_odds,
       round(sqrt(1 / (t + 0.5e0) + 1 / (n - t + 0.5e0) + 1 / (c + 0.5e0) + 1 / (n - c + 0.5e0)), 6) AS se FROM s""", *NUM))
def effect_log_odds(spark, sf_dir):
    counts = num_correct(spark, sf_dir)
    table = per_effect(lambda e: effects.log_odds_effect(counts, e, [*CONFIG, "lm_type"]))
    return table.withColumns({"log_odds": r6("log_odds"), "se": r6("se")})


META = 500
_META_ROW = "concat_ws('|', num_train, num_test, lm_type, dataset, subsample_idx)"
CTES["meta_rows"] = f"""
  SELECT *, row_number() OVER (PARTITION BY num_train, num_test, replicate, lm_type, dataset ORDER BY
              {sql_seed_key(_META_ROW, "'meta|' || replicate")}, {sql_row_word(_META_ROW, 1)}) AS k
  FROM num_correct CROSS JOIN range({META}) AS x(replicate)"""
CTES["meta"] = sql_per_effect(lambda e, t, c: f"""
  SELECT num_train, num_test, CAST(replicate AS INTEGER) AS replicate, count(*) AS n_subsamples, '{e}' AS effect,
         {_sql_logit(f'sum({t})', 'sum(num_test)')} - {_sql_logit(f'sum({c})', 'sum(num_test)')} AS log_odds,
         (sum({t}) - sum({c})) / CAST(sum(num_test) AS DOUBLE) AS mean
  FROM meta_rows WHERE k = 1 GROUP BY 1, 2, 3""")
META_CTES = (*NUM, "meta_rows", "meta")


def meta(spark, sf_dir):
    return effects.meta_replicates(
        num_correct(spark, sf_dir), list(EFFECTS), ["subsample_idx"], META, config=CONFIG
    )


@query("meta_replicates", sql("""
SELECT num_train, num_test, replicate, n_subsamples, effect, round(log_odds, 6) AS log_odds, round(mean, 6) AS mean FROM meta""",
    *META_CTES))
def meta_replicates(spark, sf_dir):
    return meta(spark, sf_dir).withColumns({"log_odds": r6("log_odds"), "mean": r6("mean")})


@query("ecdf", sql("""
, v AS (SELECT num_train, num_test, effect, round(mean, 6) AS mean FROM meta)
SELECT DISTINCT num_train, num_test, effect, mean, count(*) OVER (PARTITION BY num_train, num_test, effect, mean) AS n,
       round(cume_dist() OVER (PARTITION BY num_train, num_test, effect ORDER BY mean), 6) AS ecdf FROM v""", *META_CTES))
def ecdf(spark, sf_dir):
    means = stored(meta(spark, sf_dir).select(*CONFIG, "effect", r6("mean").alias("mean")), "means")
    return density.cumulative_share(means, "mean", [*CONFIG, "effect"]).withColumn("ecdf", r6("ecdf"))


@query("ecdf_positions", sql("""
SELECT num_train, num_test, effect, round(avg((mean < -0.04)::INTEGER), 6) AS below_minus,
       round(avg((mean < 0.04)::INTEGER), 6) AS below_plus FROM meta GROUP BY ALL""", *META_CTES))
def ecdf_positions(spark, sf_dir):
    shares = density.share_below(meta(spark, sf_dir), "mean", 0.04, [*CONFIG, "effect"])
    return shares.withColumns({"below_minus": r6("below_minus"), "below_plus": r6("below_plus")})


@query("interval_band", sql("""
SELECT num_train, num_test, effect, replicate, round((row_number() OVER w - 1) / CAST(count(*) OVER (PARTITION BY num_train, num_test, effect) AS DOUBLE), 6)
       AS height, round(mean, 6) AS mean, round(mean - 0.02, 6) AS low, round(mean + 0.02, 6) AS high
FROM (SELECT * REPLACE (round(mean, 9) AS mean) FROM meta) AS m WINDOW w AS (PARTITION BY num_train, num_test, effect ORDER BY mean, replicate)""", *META_CTES))
def interval_band(spark, sf_dir):
    """Intervals around the means of all replicates, the smallest lowest."""
    means = stored(meta(spark, sf_dir).withColumn("mean", F.round("mean", 9)), "means")
    ends = means.withColumns({"low": F.col("mean") - 0.02, "high": F.col("mean") + 0.02})
    band = density.interval_band(ends, "mean", "replicate", [*CONFIG, "effect"], "low", "high")
    return band.withColumns({c: r6(c) for c in ("height", "mean", "low", "high")})


@query("error_bars", sql(f"""
SELECT concat_ws('/', {G4}) AS components, effect, count(*) AS n, round(avg(d), 6) AS mean,
       round({regression.Z} * stddev_samp(d) / sqrt(count(*)), 6) AS margin FROM effect_rows GROUP BY 1, 2""", *ACC, "effect_rows"))
def error_bars(spark, sf_dir):
    """Mean of both effects over the replicates of each group, with the half width of its bar."""
    group = F.concat_ws("/", *[F.col(c).cast("string") for c in GROUP]).alias("components")
    long = accuracies(spark, sf_dir).select(group, "subsample_idx", *ARMS).unpivot(["components", "subsample_idx"], list(ARMS), "arm", "r2")
    return regression.error_bars(long).withColumns({"mean": r6("mean"), "margin": r6("margin")})


BOOT = 1000


@query("effect_bootstrap", sql(f"""
, s AS ({sql_per_effect(lambda e, t, c: f"""
        SELECT '{e}' AS effect, num_train, num_test, dataset, CAST(sum({t}) AS DOUBLE) AS t, CAST(sum({c}) AS DOUBLE) AS c,
               CAST(sum(num_test) AS DOUBLE) AS n,
               row_number() OVER (PARTITION BY num_train, num_test ORDER BY dataset) - 1 AS slot,
               count(*) OVER (PARTITION BY num_train, num_test) AS size FROM num_correct GROUP BY num_train, num_test, dataset""")}),
  p AS (SELECT effect, num_train, num_test, replicate, CAST(floor({sql_word(
      "md5('boot|0|' || num_train || '|' || num_test || '|' || replicate || '|' || slot)")}
              * size / 4294967296e0) AS BIGINT) AS slot
        FROM s CROSS JOIN range({BOOT}) AS x(replicate)),
  b AS (SELECT effect, num_train, num_test, replicate, sum(t) AS t, sum(c) AS c, sum(n) AS n
        FROM p JOIN s USING (effect, num_train, num_test, slot) GROUP BY ALL)
SELECT effect, num_train, num_test, CAST(replicate AS INTEGER) AS replicate,
       round({_sql_logit('t', 'n')} - {_sql_logit('c', 'n')}, 6) AS log_odds FROM b""", *NUM))
def effect_bootstrap(spark, sf_dir):
    counts = num_correct(spark, sf_dir)
    table = per_effect(lambda e: effects.bootstrap_effect(counts, e, BOOT, CONFIG))
    return table.withColumn("log_odds", r6("log_odds"))


def _sql_newton() -> str:
    """The steps of the regression, one building block each; every effect is a fit of its own."""
    weighed = """SELECT *, w + w0 AS b, r + r0 AS rest, sum(w - w * w / (w + w0)) OVER e AS information
       FROM (SELECT *, n * p1 * (1 - p1) AS w, n * p0 * (1 - p0) AS w0, t - n * p1 AS r, c - n * p0 AS r0
             FROM (SELECT *, 1 / (1 + exp(-(level + method))) AS p1, 1 / (1 + exp(-level)) AS p0 FROM n{0}) AS p) AS q
       WINDOW e AS (PARTITION BY effect)"""
    blocks = [f"""n0 AS (SELECT effect, lm_type, t, c, n, ln((t + c + 0.5e0) / (2 * n - t - c + 0.5e0)) AS level, 0e0 AS method FROM (
  {sql_per_effect(lambda e, t, c: f"SELECT '{e}' AS effect, lm_type, CAST(sum({t}) AS DOUBLE) AS t, CAST(sum({c}) AS DOUBLE) AS c, CAST(sum(num_test) AS DOUBLE) AS n FROM num_correct GROUP BY lm_type")}) AS s)"""]
    for i in range(effects.NEWTON_STEPS):
        blocks.append(f"""w{i} AS ({weighed.format(i)}),
  n{i + 1} AS (SELECT effect, lm_type, t, c, n, level + (rest - w * step) / b AS level, method + step AS method
       FROM (SELECT *, sum(r - w * rest / b) OVER (PARTITION BY effect) / information AS step FROM w{i}) AS x)""")
    return ", " + ",\n".join(blocks) + f""",
  last AS ({weighed.format(effects.NEWTON_STEPS)}),
  f AS (SELECT *, first_value(lm_type) OVER o AS first, first_value(level) OVER o AS level0, first_value(w / b) OVER o AS tilt0,
               first_value(b) OVER o AS b0 FROM last WINDOW o AS (PARTITION BY effect ORDER BY lm_type))
SELECT DISTINCT effect, 'method' AS term, round(method, 6) AS estimate, round(1 / sqrt(information), 6) AS se FROM f WHERE lm_type = first
UNION ALL SELECT effect, 'intercept', round(level, 6), round(sqrt(1 / b + pow(w / b, 2) / information), 6) FROM f WHERE lm_type = first
UNION ALL SELECT effect, 'lm_type[' || lm_type || ']', round(level - level0, 6),
       round(sqrt(1 / b + 1 / b0 + pow(w / b - tilt0, 2) / information), 6) FROM f WHERE lm_type <> first"""


@query("effect_glm", sql(_sql_newton(), *NUM))
def effect_glm(spark, sf_dir):
    counts = num_correct(spark, sf_dir)
    table = per_effect(lambda e: effects.glm_effect(counts, e))
    return table.withColumns({"estimate": r6("estimate"), "se": r6("se")})


# --- Leaderboard -----------------------------------------------------------------

CTES["board"] = """
  SELECT user_id, round(avg((pred_extra = p.label)::INTEGER), 9) AS score
  FROM predictions AS p JOIN events AS e ON p.row_id = e.event_id GROUP BY 1"""
CTES["gaps"] = """
  SELECT rank, score, next_score, score - next_score AS gap,
         (score / nullif(1 - score, 0)) / nullif(next_score / nullif(1 - next_score, 0), 0) AS odds_ratio
  FROM (SELECT row_number() OVER w AS rank, score, lead(score) OVER w AS next_score FROM board
        WINDOW w AS (ORDER BY score DESC, user_id)) AS l WHERE next_score IS NOT NULL"""
BOARD = ("predictions", "board")


def board(spark, sf_dir):
    """Users ranked by their share of right answers."""
    hit = (F.col("pred_extra") == F.col("label")).cast("double")
    scored = predictions(spark, sf_dir, keep=["user_id"])
    return scored.groupBy("user_id").agg(F.round(F.avg(hit), 9).alias("score"))


@query("rank_gaps", sql("""
SELECT rank, round(score, 6) AS score, round(next_score, 6) AS next_score, round(gap, 6) AS gap,
       round(odds_ratio, 6) AS odds_ratio FROM gaps""", *BOARD, "gaps"))
def rank_gaps(spark, sf_dir):
    table = gaps(stored(board(spark, sf_dir), "board"), "score", "user_id")
    return table.withColumns({c: r6(c) for c in ("score", "next_score", "gap", "odds_ratio")})


def _sql_describe(source: str, value: str) -> str:
    quartile = lambda q: f"max({value}) FILTER (WHERE k = CAST(floor((c - 1) * {q}e0 + 0.5e0) AS BIGINT))"
    parts = {
        "count": "CAST(max(c) AS DOUBLE)", "null_count": f"CAST(count(*) FILTER (WHERE {value} IS NULL) AS DOUBLE)",
        "mean": f"avg({value})", "std": f"stddev_samp({value})", "min": f"min({value})", "max": f"max({value})",
        "25%": quartile(0.25), "50%": quartile(0.5), "75%": quartile(0.75),
    }
    inner = (f"SELECT {value}, count({value}) OVER () AS c, "
             f"row_number() OVER (ORDER BY {value} NULLS LAST) - 1 AS k FROM {source}")
    return " UNION ALL ".join(
        f"SELECT '{name}' AS statistic, round({e}, 6) AS value FROM ({inner}) AS s" for name, e in parts.items()
    )


@query("series_describe", sql(f"""
, g AS (SELECT round(gap, 9) AS gap FROM gaps) {_sql_describe('g', 'gap')}""", *BOARD, "gaps"))
def series_describe(spark, sf_dir):
    table = gaps(board(spark, sf_dir), "score", "user_id").select(F.round("gap", 9).alias("gap"))
    return describe_series(stored(table, "gaps"), "gap").withColumn("value", r6("value"))
