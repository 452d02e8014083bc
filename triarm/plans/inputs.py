"""Inputs derived from the test tables, in Spark and as SQL.

Everything covers whole tables. Keys and outcomes come from the hex digits of an
MD5, which Spark and the checking engine compute alike.
"""

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from triarm.functions.draws import DIGITS, HEX, PRIME, digit
from triarm.functions.fixed_values import EFFECTS
from triarm.operators import scoring, summary

LANGS = ("de", "en", "es", "fr")
LANG_NAMES = ("German", "English", "Spanish", "French")
LANG_TASK = "The text is a document. Answer with its language."


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(column: str | Column) -> Column:
    col = F.col(column) if isinstance(column, str) else column
    return F.round(col.cast("double"), 6)


def per_effect(make: Callable[[str], DataFrame]) -> DataFrame:
    """What ``make`` gives for each effect, with the effect's name."""
    return reduce(DataFrame.unionByName, [make(e).withColumn("effect", F.lit(e)) for e in EFFECTS])


def sql_per_effect(make: Callable[[str, str, str], str]) -> str:
    """Union of ``make(effect, treatment, control)``."""
    return " UNION ALL ".join(make(e, t, c) for e, (t, c) in EFFECTS.items())


# --- SQL building blocks ---------------------------------------------------

def sql_digit(key: str, position: int = 1) -> str:
    return f"(instr('{HEX}', substr({key}, {position}, 1)) - 1)"


def sql_word(key: str) -> str:
    return f"CAST('0x' || substr({key}, 1, 8) AS BIGINT)"


def _sql_part(digest: str, i: int) -> str:
    return f"CAST('0x' || substr({digest}, {1 + DIGITS * i}, {DIGITS}) AS BIGINT)"


def sql_row_word(row: str, i: int) -> str:
    """Number ``i`` of a row that is hashed once; ``row`` is the text that is hashed."""
    return _sql_part(f"md5({row})", i)


def sql_seed_key(row: str, seed: str) -> str:
    """Key of a row under a seed; ``seed`` is the text that is hashed, salt included."""
    a, b, c = (_sql_part(f"md5({seed})", i) for i in range(3))
    return f"(({a} * {sql_row_word(row, 0)} + {b} * {sql_row_word(row, 1)} + {c}) % {PRIME})"


CTES: dict[str, str] = {}


def sql(body: str, *ctes: str) -> str:
    """A query over the named building blocks, which are listed in order.

    A body that starts with a comma adds building blocks of its own.
    """
    if not ctes:
        return body
    blocks = ",\n".join(f"{name} AS ({CTES[name]})" for name in dict.fromkeys(ctes))
    return f"WITH {blocks}\n{body.strip()}"


# --- Predictions: events as scored test rows -------------------------------

def predictions(spark: SparkSession, sf_dir: str, keep: Sequence[str] = ()) -> DataFrame:
    """Every event is a test row of one replicate, scored by three arms; ``keep`` are columns of the event.

    The right answer comes with chance 9/16 in base, 11/16 in extra and test: a
    boost of 0.125 and no bias are planted.
    """
    key = F.md5(F.col("event_id").cast("string"))
    events = table(spark, sf_dir, "events").withColumn("k", key)
    label = (F.col("user_id") % 3).cast("int")
    wrong = ((F.col("user_id") + 1) % 3).cast("int")
    pred = lambda position, cut: F.when(digit(F.col("k"), position) < cut, label).otherwise(wrong)
    return events.select(
        F.when(digit(F.col("k"), 1) < 8, 50).otherwise(100).alias("num_train"),
        F.when(digit(F.col("k"), 2) < 8, 50).otherwise(100).alias("num_test"),
        F.when(F.col("event_id") % 2 == 0, "lm_a").otherwise("lm_b").alias("lm_type"),
        F.col("event_type").alias("dataset"),
        (digit(F.col("k"), 3) + 1).cast("int").alias("subsample_idx"),
        F.col("event_id").alias("row_id"),
        label.alias("label"),
        pred(4, 9).alias("pred_base"),
        pred(5, 11).alias("pred_extra"),
        pred(6, 11).alias("pred_test"),
        *keep,
    )


def _sql_pred(position: int, cut: int) -> str:
    right = "CAST(user_id % 3 AS INTEGER)"
    wrong = "CAST((user_id + 1) % 3 AS INTEGER)"
    return f"CASE WHEN {sql_digit('k', position)} < {cut} THEN {right} ELSE {wrong} END"


CTES["predictions"] = f"""
  SELECT CASE WHEN {sql_digit('k', 1)} < 8 THEN 50 ELSE 100 END AS num_train,
         CASE WHEN {sql_digit('k', 2)} < 8 THEN 50 ELSE 100 END AS num_test,
         CASE WHEN event_id % 2 = 0 THEN 'lm_a' ELSE 'lm_b' END AS lm_type,
         event_type AS dataset, CAST({sql_digit('k', 3)} + 1 AS INTEGER) AS subsample_idx,
         event_id AS row_id, CAST(user_id % 3 AS INTEGER) AS label,
         {_sql_pred(4, 9)} AS pred_base, {_sql_pred(5, 11)} AS pred_extra, {_sql_pred(6, 11)} AS pred_test
  FROM (SELECT *, md5(CAST(event_id AS VARCHAR)) AS k FROM events) AS e"""


# --- Accuracies -------------------------------------------------------------

def accuracies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per replicate."""
    return scoring.accuracies(predictions(spark, sf_dir))


def full_accuracies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with the constants of the dataset, which need another pass over it."""
    rows = predictions(spark, sf_dir)
    return scoring.with_dataset_constants(scoring.accuracies(rows), rows)


CTES["accuracies"] = """
  SELECT a.*, c.num_classes, c.majority_all
  FROM (SELECT num_train, num_test, lm_type, dataset, subsample_idx,
               sum(base) / sum(n) AS base, sum(extra) / sum(n) AS extra, sum(test) / sum(n) AS test,
               max(n) / sum(n) AS majority
        FROM (SELECT num_train, num_test, lm_type, dataset, subsample_idx, label,
                     CAST(count(*) AS DOUBLE) AS n,
                     CAST(count(*) FILTER (WHERE pred_base = label) AS DOUBLE) AS base,
                     CAST(count(*) FILTER (WHERE pred_extra = label) AS DOUBLE) AS extra,
                     CAST(count(*) FILTER (WHERE pred_test = label) AS DOUBLE) AS test
              FROM predictions GROUP BY 1, 2, 3, 4, 5, 6) AS l
        GROUP BY 1, 2, 3, 4, 5) AS a
  JOIN (SELECT dataset, max(n) / sum(n) AS majority_all, CAST(count(*) AS INTEGER) AS num_classes
        FROM (SELECT dataset, label, CAST(count(*) AS DOUBLE) AS n FROM predictions GROUP BY 1, 2) AS d
        GROUP BY 1) AS c USING (dataset)"""

ACC = ("predictions", "accuracies")


def num_correct(spark: SparkSession, sf_dir: str, rows=accuracies) -> DataFrame:
    return summary.num_correct(rows(spark, sf_dir), F.col("num_test"))


def _sql_count(column: str) -> str:
    return f"CAST(trunc({column} * num_test) AS BIGINT) AS {column}"


CTES["num_correct"] = f"""
  SELECT num_train, num_test, lm_type, dataset, subsample_idx, num_classes,
         {', '.join(map(_sql_count, ('base', 'extra', 'test', 'majority', 'majority_all')))}
  FROM accuracies"""

NUM = (*ACC, "num_correct")


# --- Documents as labelled text ----------------------------------------------

def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents labelled by their language: the multi-class dataset."""
    docs = table(spark, sf_dir, "documents")
    names = F.array(*[F.lit(x) for x in LANGS])
    label = (F.array_position(names, F.col("lang")) - 1).cast("int")
    return docs.select(F.col("doc_id").alias("row_id"), "text", label.alias("label"))


_LANG_CASE = "CASE lang " + " ".join(f"WHEN '{x}' THEN {i}" for i, x in enumerate(LANGS)) + " END"
CTES["docs"] = f"SELECT doc_id AS row_id, text, CAST({_LANG_CASE} AS INTEGER) AS label FROM documents"


def quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents labelled by their quality: the binary dataset."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("int").alias("label"))
    return docs.join(labels, "doc_id").select(F.col("doc_id").alias("row_id"), "text", "label")


CTES["quality"] = """
  SELECT d.doc_id AS row_id, d.text, CAST(l.quality AS INTEGER) AS label
  FROM documents AS d JOIN labels AS l ON d.doc_id = l.doc_id"""


def datasets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both datasets in one table."""
    langs = documents(spark, sf_dir).withColumn("dataset", F.lit("languages"))
    return langs.unionByName(quality(spark, sf_dir).withColumn("dataset", F.lit("quality")))


CTES["datasets"] = """
  SELECT row_id, text, label, 'languages' AS dataset FROM docs
  UNION ALL SELECT row_id, text, label, 'quality' FROM quality"""
