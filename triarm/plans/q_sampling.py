"""Subsamples and splits."""

from pyspark.sql import functions as F

from triarm.functions.draws import order_key
from triarm.operators import sampling
from triarm.plans.catalog import query
from triarm.plans.inputs import ACC, CTES, accuracies, datasets, documents, quality, r6, sql, sql_seed_key, table

TRAIN, TEST, REPLICATES = 40, 50, 5


def _sql_key(salt: str, seed: str) -> str:
    return sql_seed_key("CAST(row_id AS VARCHAR)", f"'{salt}|' || {seed}")


def sql_splits(
    rows: str, num_train: int, num_test: int, replicates: int, stratify: bool = True,
    seed: str = "(42 + subsample_idx)",
) -> str:
    """Splits of the rows of a building block ``(dataset, row_id, label)``."""
    stratum = "label" if stratify else "0"
    order = lambda salt: f"{_sql_key(salt, seed)}, md5({seed} || '|' || row_id), row_id"
    return f"""
  SELECT dataset, subsample_idx, row_id, label, role FROM (
    SELECT *, CASE WHEN is_train THEN 'train'
                   WHEN place <= {num_test} THEN 'extra' WHEN place <= {2 * num_test} THEN 'test' END AS role
    FROM (
      SELECT *, row_number() OVER (PARTITION BY dataset, subsample_idx, is_train ORDER BY {order('rest')}) AS place
      FROM (
        SELECT *, row_number() OVER (PARTITION BY dataset, subsample_idx, {stratum} ORDER BY {order('train')})
                  <= floor({num_train} / k) AS is_train
        FROM (SELECT r.dataset, r.row_id, r.label, c.k, CAST(i AS INTEGER) AS subsample_idx
              FROM {rows} AS r
              JOIN (SELECT dataset, count(DISTINCT {stratum}) AS k FROM {rows} GROUP BY 1) AS c USING (dataset)
              CROSS JOIN range(1, {replicates} + 1) AS s(i)) AS e) AS t) AS p) AS x
  WHERE role IS NOT NULL"""


CTES["splits"] = sql_splits("datasets", TRAIN, TEST, REPLICATES)
SPLITS = ("docs", "quality", "datasets", "splits")


def splits(spark, sf_dir):
    return sampling.replicate_splits(datasets(spark, sf_dir), TRAIN, TEST, REPLICATES, by=["dataset"])


@query("replicate_splits", sql("SELECT dataset, subsample_idx, row_id, label, role FROM splits", *SPLITS))
def replicate_splits(spark, sf_dir):
    return splits(spark, sf_dir).select("dataset", "subsample_idx", "row_id", "label", "role")


CTES["one"] = "SELECT 'languages' AS dataset, row_id, label FROM docs"
CTES["two"] = "SELECT 'quality' AS dataset, row_id, label FROM quality"


@query("stratified_sample", sql(f"""
SELECT row_id, label FROM ({sql_splits('one', 100, 0, 1, seed='42')}) AS s""",
    "docs", "one"))
def stratified_sample(spark, sf_dir):
    return sampling.stratified_sample(documents(spark, sf_dir), 100).select("row_id", "label")


@query("three_way_split", sql(f"""
SELECT row_id, label, role FROM ({sql_splits('two', 50, 100, 1, seed='42')}) AS s""",
    "quality", "two"))
def three_way_split(spark, sf_dir):
    return sampling.three_way_split(quality(spark, sf_dir), 50, 100).select("row_id", "label", "role")


@query("split_sizes", sql(f"""
SELECT 40 AS num_train, row_id, label, role FROM ({sql_splits('one', 40, 50, 1, seed='42')}) AS s
UNION ALL SELECT 80, row_id, label, role FROM ({sql_splits('one', 80, 50, 1, seed='42')}) AS s""", "docs", "one"))
def split_sizes(spark, sf_dir):
    """The extra and test rows depend on the number of training rows, as they are drawn from what is left."""
    docs = documents(spark, sf_dir)
    cut = lambda m: sampling.three_way_split(docs, m, 50).select(F.lit(m).alias("num_train"), "row_id", "label", "role")
    return cut(40).unionByName(cut(80))


CTES["vectors"] = "SELECT 'vectors' AS dataset, vec_id AS row_id, label FROM embeddings"


def vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("row_id"), "label", "embedding")


@query("split_unstratified", sql(f"""
SELECT subsample_idx, row_id, role FROM ({sql_splits('vectors', 50, 100, 10, stratify=False)}) AS s""", "vectors"))
def split_unstratified(spark, sf_dir):
    drawn = sampling.replicate_splits(vectors(spark, sf_dir), 50, 100, 10, stratify=False)
    return drawn.select("subsample_idx", "row_id", "role")


def sql_down(size: int) -> str:
    return f"""
SELECT lm_type, dataset, num_train, num_test, subsample_idx, round(base, 6) AS base
FROM (SELECT *, row_number() OVER (PARTITION BY lm_type, dataset
        ORDER BY md5('down|42|' || lm_type || '|' || dataset || '|' || num_train || '|' || num_test || '|' || subsample_idx)) AS n FROM accuracies) AS d
WHERE n <= {size}"""


DOWN_KEY = ["num_train", "num_test", "subsample_idx"]


def _down(spark, sf_dir, size):
    sample = sampling.down_sample(accuracies(spark, sf_dir), DOWN_KEY, size)
    return sample.select("lm_type", "dataset", *DOWN_KEY, r6("base").alias("base"))


@query("down_sample", sql(sql_down(1), *ACC))
def down_sample(spark, sf_dir):
    return _down(spark, sf_dir, 1)


@query("down_sample_several", sql(sql_down(5), *ACC))
def down_sample_several(spark, sf_dir):
    return _down(spark, sf_dir, 5)


@query("random_example", sql("""
SELECT dataset, row_id, label FROM (
  SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY md5('example|' || row_id)) AS n FROM datasets) AS e
WHERE n = 1""", "docs", "quality", "datasets"))
def random_example(spark, sf_dir):
    rows = datasets(spark, sf_dir).select("dataset", "row_id", "label")
    key = order_key("example", F.col("row_id"))
    return rows.groupBy("dataset").agg(*[F.min_by(c, key).alias(c) for c in ("row_id", "label")])
