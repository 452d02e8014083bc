"""Scans by column expression: the steps that make text and label, and the checks."""

from pyspark.sql import functions as F

from triarm.functions import naming, prompts
from triarm.operators import validate
from triarm.plans.catalog import query
from triarm.plans.inputs import (
    ACC, LANG_NAMES, LANG_TASK, accuracies, datasets, documents, quality, sql, table,
)
from triarm.sources.datasets import canonical, load_dataset
from triarm.sources.specs import REGISTRY, DatasetSpec, dataset_names, specs_frame

# Specs of the labelled tables at hand. Sources are columns of the raw tables.
LANGUAGES = DatasetSpec(
    "tables/languages", LANG_NAMES, LANG_TASK,
    label="map('de', 0, 'en', 1, 'es', 2, 'fr', 3)[lang]",
    loader=lambda spark, sf_dir: None,
)
ORDER_STATUS = DatasetSpec(
    "tables/order_status", ("F", "O", "P"), "The text is an order. Answer with its status.",
    text="concat(o_orderpriority, '\\n', cast(o_orderdate as string))",
    label="map('F', 0, 'O', 1, 'P', 2)[o_orderstatus]",
)
LINE_NUMBER = DatasetSpec(
    "tables/line_number", tuple("1234567"), "The text is an order line. Answer with its number.",
    text="concat(l_returnflag, l_linestatus)", label="l_linenumber - 1",
)


def languages_spec(sf_dir):
    """The documents, read from ``sf_dir`` with the key ``doc_id``."""
    return DatasetSpec(
        "tables/languages", LANG_NAMES, LANG_TASK, label=LANGUAGES.label,
        loader=lambda spark, _: table(spark, sf_dir, "documents").withColumnRenamed("doc_id", "row_id"),
    )


@query("canonical_dataset", """
SELECT doc_id AS row_id, text, CASE lang WHEN 'de' THEN 0 WHEN 'en' THEN 1 WHEN 'es' THEN 2 WHEN 'fr' THEN 3 END
       AS label FROM documents""")
def canonical_dataset(spark, sf_dir):
    return load_dataset(spark, languages_spec(sf_dir)).select("row_id", "text", "label")


@query("dataset_registry", """
SELECT 'languages' AS dataset, count(DISTINCT lang) AS n_labels, count(*) AS n_rows,
       'German, English, Spanish, French' AS class_names FROM documents
UNION ALL SELECT 'order_status', count(DISTINCT o_orderstatus), count(*), 'F, O, P' FROM orders
UNION ALL SELECT 'line_number', count(DISTINCT l_linenumber), count(*), '1, 2, 3, 4, 5, 6, 7' FROM lineitem""")
def dataset_registry(spark, sf_dir):
    """Canonical tables of several specs, described by their spec."""
    raws = {LANGUAGES: "documents", ORDER_STATUS: "orders", LINE_NUMBER: "lineitem"}
    rows = None
    for spec, name in raws.items():
        one = canonical(table(spark, sf_dir, name), spec).select(F.lit(spec.name).alias("dataset"), "label")
        rows = one if rows is None else rows.unionByName(one)
    counts = rows.groupBy("dataset").agg(
        F.count_distinct("label").alias("n_labels"), F.count(F.lit(1)).alias("n_rows")
    )
    known = specs_frame(spark, [*REGISTRY.values(), *raws])
    return counts.join(known, "dataset").select(
        "dataset", "n_labels", "n_rows", F.array_join("class_names", ", ").alias("class_names")
    )


@query("proc_rename", "SELECT l_orderkey AS row_id, l_linenumber AS part, l_returnflag AS text, l_linestatus AS label FROM lineitem")
def proc_rename(spark, sf_dir):
    spec = DatasetSpec("lines", ("F", "O"), "", text="l_returnflag", label="l_linestatus")
    raw = table(spark, sf_dir, "lineitem")
    return spec.process(raw).select(
        F.col("l_orderkey").alias("row_id"), F.col("l_linenumber").alias("part"), "text", "label"
    )


@query("proc_label_offset", "SELECT l_orderkey, l_linenumber, l_linenumber - 1 AS label FROM lineitem")
def proc_label_offset(spark, sf_dir):
    rows = canonical(table(spark, sf_dir, "lineitem"), LINE_NUMBER)
    return rows.select("l_orderkey", "l_linenumber", "label")


@query("proc_label_map", """
SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 WHEN 'P' THEN 2 END AS label,
       CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 END AS partial_label FROM orders""")
def proc_label_map(spark, sf_dir):
    rows = canonical(table(spark, sf_dir, "orders"), ORDER_STATUS)
    partial = naming.label_of(F.col("o_orderstatus"), {"F": 0, "O": 1})
    return rows.select("o_orderkey", "label", partial.alias("partial_label"))


@query("proc_boolean_label", "SELECT event_id, CAST(value > 50 AS INTEGER) AS label FROM events")
def proc_boolean_label(spark, sf_dir):
    spec = DatasetSpec("values", ("low", "high"), "", text="event_type", label="value > 50")
    return canonical(table(spark, sf_dir, "events"), spec).select("event_id", "label")


@query("proc_len_filter", "SELECT doc_id, text FROM documents WHERE length(text) < 1000")
def proc_len_filter(spark, sf_dir):
    spec = DatasetSpec("short", ("any",), "", label="0", keep=REGISTRY["ccdv/patent-classification"].keep)
    return spec.process(table(spark, sf_dir, "documents")).select("doc_id", "text")


@query("proc_nonempty", """
, raw AS (SELECT doc_id, CASE source WHEN 'src0' THEN NULL WHEN 'src1' THEN '' ELSE text END AS text FROM documents)
SELECT 'not null' AS kept, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM raw WHERE text IS NOT NULL
UNION ALL SELECT 'not empty', count(*), CAST(sum(length(text)) AS BIGINT) FROM raw WHERE length(coalesce(text, '')) > 0
""".replace(", raw", "WITH raw", 1))
def proc_nonempty(spark, sf_dir):
    """Blank out two sources, then keep what is not NULL, and what is not empty."""
    text = F.when(F.col("source") == "src0", None).when(F.col("source") == "src1", "").otherwise(F.col("text"))
    raw = table(spark, sf_dir, "documents").select("doc_id", text.alias("text"), F.lit(0).alias("label"))
    parts = []
    for kept, location in (("not null", "aladar/craigslist_bargains"), ("not empty", "SetFit/enron_spam")):
        rows = REGISTRY[location].process(raw)
        parts.append(rows.agg(
            F.lit(kept).alias("kept"), F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("n_chars")
        ))
    return parts[0].unionByName(parts[1])


@query("proc_concat", """
SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN NULL ELSE p_name || chr(10) || p_type END AS text FROM part""")
def proc_concat(spark, sf_dir):
    content = F.when(F.col("p_size") % 5 != 0, F.col("p_type"))
    raw = table(spark, sf_dir, "part").select(
        "p_partkey", F.col("p_name").alias("question_title"), content.alias("question_content"),
        F.lit(0).alias("topic"),
    )
    return REGISTRY["yahoo_answers_topics"].process(raw).select("p_partkey", "text")


@query("label_to_class", """
SELECT doc_id AS row_id, CASE lang WHEN 'de' THEN 'German' WHEN 'en' THEN 'English' WHEN 'es' THEN 'Spanish'
       WHEN 'fr' THEN 'French' END AS class_name FROM documents""")
def label_to_class(spark, sf_dir):
    names = F.array(*[F.lit(n) for n in LANG_NAMES])
    return documents(spark, sf_dir).select("row_id", prompts.class_name(names, F.col("label")).alias("class_name"))


@query("dataset_names_check", """
SELECT split_part(name, '/', 2) AS dataset, count(*) AS n_locations
FROM (SELECT DISTINCT source || '/' || lang AS name FROM documents) AS n GROUP BY 1 HAVING count(*) > 1""")
def dataset_names_check(spark, sf_dir):
    """Short names that several owners (here: sources) use."""
    dataset_names()
    docs = table(spark, sf_dir, "documents")
    return validate.duplicate_names(docs.select(F.concat_ws("/", "source", "lang").alias("location")))


# --- Checks --------------------------------------------------------------------

_BROKEN = """
WITH raw AS (SELECT doc_id % 900 AS row_id,
                    CASE source WHEN 'src0' THEN NULL WHEN 'src1' THEN '' ELSE text END AS text,
                    CASE lang WHEN 'de' THEN 0 WHEN 'en' THEN 1 WHEN 'es' THEN -1 WHEN 'fr' THEN 5 END AS label
             FROM documents)"""


def broken(spark, sf_dir):
    """The documents with planted faults of every kind."""
    text = F.when(F.col("source") == "src0", None).when(F.col("source") == "src1", "").otherwise(F.col("text"))
    label = naming.label_of(F.col("lang"), {"de": 0, "en": 1, "es": -1, "fr": 5})
    docs = table(spark, sf_dir, "documents")
    return docs.select((F.col("doc_id") % 900).alias("row_id"), text.alias("text"), label.alias("label"))


def _found(spark, sf_dir, *checks):
    return validate.violations(broken(spark, sf_dir), len(LANG_NAMES)).where(F.col("check").isin(*checks))


@query("validate_text", _BROKEN + """
SELECT 'null_text' AS "check", count(*) AS n_bad FROM raw WHERE text IS NULL
UNION ALL SELECT 'empty_text', count(*) FROM raw WHERE text = ''""")
def validate_text(spark, sf_dir):
    return _found(spark, sf_dir, "null_text", "empty_text")


@query("validate_unique_id", _BROKEN + """
SELECT 'duplicate_key' AS "check", count(*) - count(DISTINCT row_id) AS n_bad FROM raw""")
def validate_unique_id(spark, sf_dir):
    return _found(spark, sf_dir, "duplicate_key")


@query("validate_label_gaps", _BROKEN + """
, stray AS (SELECT DISTINCT CASE WHEN row_id = 7 THEN 2147483647 ELSE label END AS label FROM raw),
  gaps AS (SELECT coalesce(lag(label) OVER (ORDER BY label), -1) + 1 AS first_label, label - 1 AS last_label FROM stray WHERE label >= 0)
SELECT CAST(first_label AS BIGINT) AS first_label, CAST(last_label AS BIGINT) AS last_label FROM gaps WHERE first_label <= last_label""")
def validate_label_gaps(spark, sf_dir):
    """With one stray label far above the others."""
    rows = broken(spark, sf_dir)
    return validate.missing_labels(rows.withColumn("label", F.when(F.col("row_id") == 7, 2**31 - 1).otherwise(F.col("label"))))


@query("validate_labels", _BROKEN + """
SELECT 'null_label' AS "check", count(*) AS n_bad FROM raw WHERE label IS NULL
UNION ALL SELECT 'negative_label', count(*) FROM raw WHERE label < 0
UNION ALL SELECT 'missing_label', max(label) + 1 - count(DISTINCT label) FILTER (WHERE label >= 0) FROM raw""")
def validate_labels(spark, sf_dir):
    return _found(spark, sf_dir, "null_label", "negative_label", "missing_label")


@query("validate_class_count", """
SELECT 'class_count_off' AS "check", abs(4 - count(DISTINCT quality)) AS n_bad FROM labels""")
def validate_class_count(spark, sf_dir):
    rows = quality(spark, sf_dir)
    return validate.violations(rows, len(LANG_NAMES)).where("check = 'class_count_off'")


@query("validate_replicates", sql("""
SELECT n_replicates, count(*) AS n_groups
FROM (SELECT count(*) AS n_replicates FROM accuracies GROUP BY num_train, num_test, lm_type, dataset) AS g
GROUP BY 1""", *ACC))
def validate_replicates(spark, sf_dir):
    return validate.replicate_counts(accuracies(spark, sf_dir))


@query("validate_same_datasets", """
WITH a AS (SELECT DISTINCT source || '/' || lang AS dataset FROM documents WHERE n_chars >= 2000),
     b AS (SELECT DISTINCT source || '/' || lang AS dataset FROM documents WHERE n_chars < 2000)
SELECT dataset, 'left' AS only_in FROM a WHERE dataset NOT IN (SELECT dataset FROM b)
UNION ALL SELECT dataset, 'right' FROM b WHERE dataset NOT IN (SELECT dataset FROM a)""")
def validate_same_datasets(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("dataset", F.concat_ws("/", "source", "lang"))
    return validate.dataset_differences(docs.where("n_chars >= 2000"), docs.where("n_chars < 2000"))


@query("describe_datasets", sql("""
, firsts AS (SELECT dataset, min_by(substr(text, 1, 30), md5('example|' || row_id)) AS example FROM datasets GROUP BY 1)
SELECT d.dataset, count(*) AS n_rows, count(DISTINCT label) AS num_classes,
       CAST(trunc(quantile_cont(length(text), 0.25)) AS BIGINT) AS length_25,
       CAST(trunc(quantile_cont(length(text), 0.75)) AS BIGINT) AS length_75, f.example
FROM datasets AS d JOIN firsts AS f ON d.dataset = f.dataset GROUP BY d.dataset, f.example""",
    "docs", "quality", "datasets"))
def describe_datasets(spark, sf_dir):
    from triarm.operators.describe import describe_texts

    return describe_texts(datasets(spark, sf_dir))


@query("class_range", sql("""
SELECT min(k) AS min_classes, max(k) AS max_classes, count(*) AS n_datasets
FROM (SELECT dataset, count(DISTINCT label) AS k FROM datasets GROUP BY 1) AS c""", "docs", "quality", "datasets"))
def class_range(spark, sf_dir):
    from triarm.operators import describe

    return describe.class_range(describe.describe_texts(datasets(spark, sf_dir)))
