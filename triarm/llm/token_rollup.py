"""Token totals kept up to date by signed changes.

Totals by (source, lang, tokenizer) are sums, so a batch of changes becomes a small table of signed deltas,
and totals are the sum over all committed batches. A batch is committed by writing its folder; its
``_SUCCESS`` file is the commit. A batch that is sent again, after a crash or by an at-least-once sender,
finds the file and changes nothing; a folder without the file is a failed try and is written anew.
"""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from triarm.llm.text import words

KEYS = ("source", "lang", "tokenizer")
DELTA = "source STRING, lang STRING, tokenizer STRING, d_docs BIGINT, d_tokens BIGINT, d_changes BIGINT"

# Tokenizer versions that are plain expressions; others come as a column of counts.
TOKENIZERS = {
    "words-1": lambda text: F.size(words(text)).cast("long"),
    "words-2": lambda text: F.size(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("[A-Za-z0-9\\x{80}-\\x{10FFFF}]+|[!-/:-@\\[-`{-~]"), F.lit(0))).cast("long"),
}


def count_tokens(text: Column, tokenizer: str) -> Column:
    """Tokens of a text under a named version; 0 for NULL."""
    return TOKENIZERS[tokenizer](text)


def deltas(changes: DataFrame) -> DataFrame:
    """Signed deltas of a batch, one row per group.

    ``changes`` has ``kind`` (insert, delete, revise), ``source``, ``lang``, ``tokenizer``, ``n_tokens`` (new
    count; for a delete the count that goes) and ``old_tokens`` (revise: the count that is replaced). A NULL
    count is 0, a NULL group column a group of its own. Every row is one change, also if rows are equal.
    A row of another kind fails the batch. The sums start on the map side, so a hot source costs one row
    per task; other columns are not read.
    """
    kind, n = F.col("kind"), F.coalesce(F.col("n_tokens"), F.lit(0))
    known = F.when(kind.isin("insert", "delete", "revise"), kind).otherwise(
        F.raise_error(F.concat(F.lit("unknown kind of change: "), F.coalesce(kind, F.lit("NULL")))))
    docs = F.when(known == "insert", 1).when(known == "delete", -1).otherwise(0)
    tokens = F.when(kind == "insert", n).when(kind == "delete", -n).otherwise(
        n - F.coalesce(F.col("old_tokens"), F.lit(0)))
    return changes.groupBy(*KEYS).agg(
        F.sum(docs).cast("long").alias("d_docs"), F.sum(tokens).cast("long").alias("d_tokens"),
        F.count("*").alias("d_changes"))


class TokenRollup:
    """Rollup in the folder ``path``, which all executors reach."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _exists(self, path: str) -> bool:
        jvm = self.spark._jvm
        place = jvm.org.apache.hadoop.fs.Path(path)
        return place.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(place)

    def committed(self, batch_id: str) -> bool:
        return self._exists(f"{self.path}/batch={batch_id}/_SUCCESS")

    def commit(self, batch_id: str, changes: DataFrame) -> bool:
        """Apply a batch once; False if it was applied before. Batch ids are letters, digits, ``-`` and ``_``."""
        if not batch_id.replace("-", "").replace("_", "").isalnum():
            raise ValueError(f"not a batch id: {batch_id!r}")
        if self.committed(batch_id):
            return False
        deltas(changes).write.mode("overwrite").parquet(f"{self.path}/batch={batch_id}")
        return True

    def totals(self) -> DataFrame:
        """``source, lang, tokenizer, n_docs, n_tokens, n_changes`` over all committed batches.

        Groups whose documents were all deleted stay, with zeros.
        """
        jvm = self.spark._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        system = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        folders = [s.getPath().toString() for s in system.listStatus(root)] if system.exists(root) else []
        done = sorted(f for f in folders if "/batch=" in f and self._exists(f"{f}/_SUCCESS"))
        rows = self.spark.read.schema(DELTA).parquet(*done) if done else self.spark.createDataFrame([], DELTA)
        return rows.groupBy(*KEYS).agg(
            F.sum("d_docs").alias("n_docs"), F.sum("d_tokens").alias("n_tokens"),
            F.sum("d_changes").alias("n_changes"))
