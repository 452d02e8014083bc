"""The experiment: unsupervised step, classifier, prediction, accuracy."""

from pyspark.sql import functions as F

from triarm.functions import scoring as fs
from triarm.functions.fixed_values import ARMS
from triarm.operators import arms, plugins, scoring
from triarm.plans.catalog import query
from triarm.plans.inputs import CTES, LANGS, datasets, documents, r6, sql
from triarm.plans.q_sampling import SPLITS, splits

CELL = "dataset, subsample_idx"
TOKENS = f"string_split_regex(lower(text), '{fs.TOKEN_BREAK}')"

CTES["counts"] = f"""
  SELECT dataset, row_id, token, CAST(count(*) AS DOUBLE) AS tf
  FROM (SELECT dataset, row_id, unnest({TOKENS}) AS token FROM datasets) AS w WHERE token <> '' GROUP BY 1, 2, 3"""
CTES["occ"] = "SELECT s.*, c.token, c.tf FROM splits AS s JOIN counts AS c USING (dataset, row_id)"
CTES["sizes"] = f"""
  SELECT {CELL}, CAST(count(*) FILTER (WHERE role = 'extra') AS DOUBLE) AS n_extra,
         CAST(count(*) FILTER (WHERE role = 'test') AS DOUBLE) AS n_test FROM splits GROUP BY 1, 2"""
CTES["freq"] = f"""
  SELECT {CELL}, token, CAST(count(*) FILTER (WHERE role = 'extra') AS DOUBLE) AS df_extra,
         CAST(count(*) FILTER (WHERE role = 'test') AS DOUBLE) AS df_test
  FROM occ WHERE role IN ('extra', 'test') GROUP BY 1, 2, 3"""
CTES["weighted"] = f"""
  SELECT o.dataset, o.subsample_idx, o.role, o.row_id, o.label, o.token, o.tf AS x_base,
         o.tf * (ln((1 + n_extra) / (1 + coalesce(df_extra, 0))) + 1) AS x_extra,
         o.tf * (ln((1 + n_test) / (1 + coalesce(df_test, 0))) + 1) AS x_test
  FROM occ AS o LEFT JOIN freq AS f USING (dataset, subsample_idx, token) JOIN sizes USING (dataset, subsample_idx)
  WHERE o.role IN ('train', 'test')"""
CTES["model"] = f"""
  SELECT {CELL}, label, token, sum(x_base) AS c_base, sum(x_extra) AS c_extra, sum(x_test) AS c_test
  FROM weighted WHERE role = 'train' GROUP BY 1, 2, 3, 4"""
CTES["classes"] = f"""
  SELECT r.dataset, r.subsample_idx, r.label AS class_idx, ln(r.n / a.n) AS log_prior, v.v,
         t.t_base, t.t_extra, t.t_test
  FROM (SELECT {CELL}, label, CAST(count(*) AS DOUBLE) AS n FROM splits WHERE role = 'train' GROUP BY 1, 2, 3) AS r
  JOIN (SELECT {CELL}, CAST(count(*) AS DOUBLE) AS n FROM splits WHERE role = 'train' GROUP BY 1, 2) AS a
    USING (dataset, subsample_idx)
  JOIN (SELECT {CELL}, count(DISTINCT token) AS v FROM model GROUP BY 1, 2) AS v USING (dataset, subsample_idx)
  JOIN (SELECT {CELL}, label, sum(c_base) AS t_base, sum(c_extra) AS t_extra, sum(c_test) AS t_test
        FROM model GROUP BY 1, 2, 3) AS t USING (dataset, subsample_idx, label)"""


def _sql_score(a: str) -> str:
    return (f"log_prior + coalesce((coalesce(hit_{a}, 0) - mass_{a} * ln(t_{a} + v)) "
            f"/ nullif(mass_{a}, 0), 0) AS s_{a}")


_HITS = ", ".join(f"sum(x_{a} * ln(c_{a} + 1)) AS hit_{a}" for a in ARMS)
_MASS = ", ".join(f"sum(x_{a}) AS mass_{a}" for a in ARMS)
CTES["scores"] = f"""
  SELECT r.dataset, r.subsample_idx, r.row_id, r.label, c.class_idx, {', '.join(map(_sql_score, ARMS))}
  FROM (SELECT {CELL}, row_id, label FROM splits WHERE role = 'test') AS r
  LEFT JOIN (SELECT {CELL}, row_id, {_MASS} FROM weighted WHERE role = 'test' GROUP BY 1, 2, 3) AS m
    USING (dataset, subsample_idx, row_id)
  JOIN classes AS c USING (dataset, subsample_idx)
  LEFT JOIN (SELECT w.dataset, w.subsample_idx, w.row_id, k.label AS class_idx, {_HITS}
             FROM weighted AS w JOIN model AS k USING (dataset, subsample_idx, token)
             WHERE w.role = 'test' GROUP BY 1, 2, 3, 4) AS h USING (dataset, subsample_idx, row_id, class_idx)"""
CTES["probs"] = " UNION ALL ".join(
    f"SELECT {CELL}, row_id, label, class_idx, '{a}' AS arm, "
    f"exp(s_{a} - max(s_{a}) OVER w) / sum(exp(s_{a})) OVER w * exp(max(s_{a}) OVER w) AS prob "
    f"FROM scores WINDOW w AS (PARTITION BY {CELL}, row_id)" for a in ARMS
)
CTES["preds"] = f"""
  SELECT {CELL}, row_id, label, arm, min_by(class_idx, (-round(prob, 9), class_idx)) AS pred
  FROM probs GROUP BY 1, 2, 3, 4, 5"""
FIT = (*SPLITS, "counts", "occ", "sizes", "freq", "weighted", "model")
PREDICT = (*FIT, "classes", "scores", "probs", "preds")


@query("unsup_idf", sql(f"""
SELECT {CELL}, token, 'extra' AS arm, CAST(df_extra AS BIGINT) AS df,
       round(ln((1 + n_extra) / (1 + df_extra)) + 1, 6) AS idf
FROM freq JOIN sizes USING (dataset, subsample_idx) WHERE df_extra > 0
UNION ALL
SELECT {CELL}, token, 'test', CAST(df_test AS BIGINT), round(ln((1 + n_test) / (1 + df_test)) + 1, 6)
FROM freq JOIN sizes USING (dataset, subsample_idx) WHERE df_test > 0""", *SPLITS, "counts", "occ", "sizes", "freq"))
def unsup_idf(spark, sf_dir):
    table = arms.idf_table(datasets(spark, sf_dir), splits(spark, sf_dir))
    return table.withColumn("idf", r6("idf"))


@query("clf_fit", sql(f"""
SELECT {CELL}, label, token, round(c_base, 6) AS c_base, round(c_extra, 6) AS c_extra, round(c_test, 6) AS c_test
FROM model""", *FIT))
def clf_fit(spark, sf_dir):
    model = arms.fitted_model(datasets(spark, sf_dir), splits(spark, sf_dir))
    return model.withColumns({f"c_{a}": r6(f"c_{a}") for a in ARMS})


def predicted(spark, sf_dir):
    return arms.run_experiment(datasets(spark, sf_dir), splits(spark, sf_dir))


@query("predict_proba", sql(f"""
SELECT {CELL}, row_id, arm, class_idx, round(prob, 6) AS prob FROM probs""", *PREDICT))
def predict_proba(spark, sf_dir):
    rows = predicted(spark, sf_dir).select(
        "dataset", "subsample_idx", "row_id", "arm", F.posexplode("probs").alias("class_idx", "prob")
    )
    return rows.withColumn("prob", r6("prob"))


@query("experiment_arms", sql(f"""
, hits AS (SELECT {CELL}, arm, avg((label = pred)::INTEGER) AS acc FROM preds GROUP BY 1, 2, 3),
  major AS (SELECT {CELL}, max(n) / sum(n) AS majority FROM (
              SELECT {CELL}, label, CAST(count(*) AS DOUBLE) AS n FROM splits WHERE role = 'test' GROUP BY 1, 2, 3) AS t
            GROUP BY 1, 2),
  whole AS (SELECT dataset, max(n) / sum(n) AS majority_all, CAST(count(*) AS INTEGER) AS num_classes FROM (
              SELECT dataset, label, CAST(count(*) AS DOUBLE) AS n FROM datasets GROUP BY 1, 2) AS d GROUP BY 1)
SELECT {CELL}, round(max(acc) FILTER (WHERE arm = 'base'), 6) AS base,
       round(max(acc) FILTER (WHERE arm = 'extra'), 6) AS extra, round(max(acc) FILTER (WHERE arm = 'test'), 6) AS test,
       round(max(majority), 6) AS majority, max(num_classes) AS num_classes, round(max(majority_all), 6) AS majority_all
FROM hits JOIN major USING (dataset, subsample_idx) JOIN whole USING (dataset) GROUP BY 1, 2""", *PREDICT))
def experiment_arms(spark, sf_dir):
    acc = arms.experiment_accuracies(datasets(spark, sf_dir), splits(spark, sf_dir))
    return acc.withColumns({c: r6(c) for c in (*ARMS, "majority", "majority_all")})


CLASSES = {"languages": len(LANGS), "quality": 2}


@query("pred_probs_wide", sql(f"""
SELECT {CELL}, row_id, label, {', '.join(
    f"round(max(prob) FILTER (WHERE arm = '{a}' AND class_idx = {i}), 6) AS pred_prob_{i}_{a}"
    for a in ARMS for i in range(max(CLASSES.values())))}
FROM probs GROUP BY 1, 2, 3, 4""", *PREDICT), also="pred_probs_wide_all")
def pred_probs_wide(spark, sf_dir):
    """Both datasets; the columns of classes that a dataset does not have are NULL."""
    rows = predicted(spark, sf_dir)
    wide = scoring.probability_columns(rows, ["dataset", "subsample_idx", "row_id", "label"], max(CLASSES.values()))
    return wide.withColumns({c: r6(c) for c in wide.columns if c.startswith("pred_prob")})


# --- A model of the user's own ---------------------------------------------------

class NearestLength:
    """The class whose mean text length is nearest; lengths count in means of the texts a model has learned from, if any."""

    def __init__(self):
        self.unit = None

    def learn(self, texts):
        self.unit = sum(map(len, texts)) / len(texts)

    def fit(self, texts, labels):
        sizes = [len(t) for t in texts]
        scale = 1.0 if self.unit is None else sum(sizes) / len(sizes)
        self.means = []
        for label in range(max(labels) + 1):
            own = [n for n, x in zip(sizes, labels) if x == label]
            self.means.append(sum(own) / len(own) / scale)

    def predict_proba(self, texts):
        rows = []
        for text in texts:
            away = [abs(len(text) / (self.unit or 1.0) - m) for m in self.means]
            rows.append([1 / (1 + x) / sum(1 / (1 + y) for y in away) for x in away])
        return rows


_AWAY = "abs(length(d.text) / u.unit - m.mean / u.scale)"


@query("user_model_arms", sql(f"""
, t AS (SELECT s.dataset, s.subsample_idx, s.row_id, s.label, s.role, d.text FROM splits AS s JOIN datasets AS d USING (dataset, row_id)),
  m AS (SELECT {CELL}, label AS class_idx, avg(length(text)) AS mean FROM t WHERE role = 'train' GROUP BY ALL),
  a AS (SELECT {CELL}, avg(length(text)) FILTER (WHERE role = 'train') AS train,
               avg(length(text)) FILTER (WHERE role = 'extra') AS extra, avg(length(text)) FILTER (WHERE role = 'test') AS test
        FROM t GROUP BY ALL),
  u AS (SELECT {CELL}, 'base' AS arm, 1e0 AS unit, 1e0 AS scale FROM a UNION ALL SELECT {CELL}, 'extra', extra, train FROM a
        UNION ALL SELECT {CELL}, 'test', test, train FROM a),
  p AS (SELECT {CELL}, d.row_id, d.label, u.arm, m.class_idx, 1 / (1 + {_AWAY}) AS w
        FROM t AS d JOIN m USING ({CELL}) JOIN u USING ({CELL}) WHERE d.role = 'test')
SELECT {CELL}, row_id, arm, class_idx, round(w / sum(w) OVER (PARTITION BY {CELL}, row_id, arm), 6) AS prob FROM p""", *SPLITS))
def user_model_arms(spark, sf_dir):
    """Probabilities of a plain model that is brought along."""
    rows = plugins.run_model(datasets(spark, sf_dir), splits(spark, sf_dir), NearestLength)
    flat = rows.select("dataset", "subsample_idx", "row_id", "arm", F.posexplode("probs").alias("class_idx", "prob"))
    return flat.withColumn("prob", r6("prob"))


# --- Scores without training --------------------------------------------------

# Common words of each language, in label order.
KEYWORDS = {
    0: ("der", "die", "und", "den", "von", "das", "mit"),
    1: ("the", "of", "and", "to", "is", "that", "for"),
    2: ("el", "los", "del", "por", "con", "una", "para"),
    3: ("le", "les", "et", "des", "du", "est", "dans"),
}


def _sql_share(words) -> str:
    listed = ", ".join(f"'{w}'" for w in words)
    return f"len(list_filter(t, lambda x: x IN ({listed}))) / CAST(greatest(len(t), 1) AS DOUBLE)"


CTES["shares"] = f"""
  SELECT row_id, label, {', '.join(f'{_sql_share(w)} AS s{i}' for i, w in KEYWORDS.items())}
  FROM (SELECT row_id, label, list_filter({TOKENS}, lambda x: x <> '') AS t FROM docs) AS w"""
_TOTAL = " + ".join(f"exp(s{i})" for i in KEYWORDS)
CTES["zero_shot"] = f"""
  SELECT row_id, label, {', '.join(f'exp(s{i}) / ({_TOTAL}) AS p{i}' for i in KEYWORDS)} FROM shares"""


def zero_shot(spark, sf_dir):
    return arms.keyword_scores(documents(spark, sf_dir), KEYWORDS)


_P = ", ".join(f"p{i}" for i in KEYWORDS)


@query("zero_shot_scores", sql(f"""
SELECT row_id, label, {', '.join(f'round(p{i}, 6) AS p{i}' for i in KEYWORDS)} FROM zero_shot""",
    "docs", "shares", "zero_shot"))
def zero_shot_scores(spark, sf_dir):
    probs = [r6(F.get("probs", F.lit(i))).alias(f"p{i}") for i in KEYWORDS]
    return zero_shot(spark, sf_dir).select("row_id", "label", *probs)


@query("argmax_pred", sql(f"""
SELECT row_id, CASE WHEN r0 = m THEN 0 WHEN r1 = m THEN 1 WHEN r2 = m THEN 2 ELSE 3 END AS pred
FROM (SELECT row_id, {', '.join(f'round(p{i}, 9) AS r{i}' for i in KEYWORDS)},
             greatest({', '.join(f'round(p{i}, 9)' for i in KEYWORDS)}) AS m FROM zero_shot) AS z""",
    "docs", "shares", "zero_shot"))
def argmax_pred(spark, sf_dir):
    return zero_shot(spark, sf_dir).select("row_id", "pred")


@query("softmax", f"""
, z AS (SELECT vec_id, i, embedding[i] * 10e0 AS x FROM embeddings CROSS JOIN range(1, 65) AS r(i))
SELECT vec_id, CAST(i - 1 AS INTEGER) AS class_idx, round(exp(x) / sum(exp(x)) OVER (PARTITION BY vec_id), 6) AS prob FROM z
""".replace(", z", "WITH z", 1))
def softmax(spark, sf_dir):
    from triarm.plans.inputs import table

    logits = F.transform("embedding", lambda x: x.cast("double") * F.lit(10.0))
    rows = scoring.softmax_probabilities(table(spark, sf_dir, "embeddings").withColumn("logits", logits))
    return rows.select("vec_id", F.posexplode("probs").alias("class_idx", "prob")).withColumn("prob", r6("prob"))
