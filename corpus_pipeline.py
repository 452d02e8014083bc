"""Cleaning of a corpus in five stages: toxicity, near-duplicates, repeated passages, benchmark text, encoding.

Each stage takes what the one before kept. All but the last return documents with all of their columns.
"""

from pyspark.sql import DataFrame, SparkSession, functions as F

from triarm.llm import bucket_refinement, lsh_forest, piece_edges, segments, spaced_seeds
from triarm.llm.queries import VOCABULARY, table
from triarm.plans.catalog import Query
from triarm.sources.scratch import stored


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that are called toxic. The model learns from the labelled among the documents."""
    model = segments.fit(docs, table(spark, sf_dir, "labels"))
    return segments.reject(docs, model)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that of the smallest id; documents without an id stay."""
    return lsh_forest.drop_near_duplicates(docs)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 400 bytes and more that are found twice go from all texts; all documents stay."""
    return bucket_refinement.remove_repeats(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that overlap an item of the benchmark."""
    return spaced_seeds.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, lang, source, n_ids, ids`` and whether the ids decode to the text."""
    vocabulary = piece_edges.Vocabulary.load(VOCABULARY)
    rows = piece_edges.encode(docs.select("doc_id", "lang", "source", "text"), vocabulary, check="round_trip")
    return rows.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_ids"), "ids", "round_trip")


STAGES = [
    ("toxicity", toxicity),
    ("near_dedup", near_dedup),
    ("suffix_dedup", suffix_dedup),
    ("decontamination", decontamination),
    ("encoding", encoding),
]

# The first stage learns a model and the last reads a vocabulary, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs, f"stage-{name}")
    return docs


PIPELINE = Query(run, ORACLE_SQL)
