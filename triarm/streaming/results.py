"""Results as they arrive.

Prediction files of several runs are read as a stream, in any order and at any distance in time. The state of the
stream, in the state store on disk, has one slot for each row key, so a row that is delivered again is dropped where it
arrives. What is new is summed up per replicate and label, and a batch adds these sums to the running table
once, however often it is retried. Work for a batch follows the batch; neither the rows nor the table so far are read again.
"""

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from triarm.functions.fixed_values import ARMS, REPLICATE_GROUP
from triarm.operators import scoring
from triarm.sources.scratch import file_system

KEY = (*REPLICATE_GROUP, "subsample_idx")
ROW_KEY = (*KEY, "row_id")


def read_predictions(spark: SparkSession, path: str, schema: StructType, files_per_batch: int = 64) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


class RunningAccuracies:
    """Accuracy table of a stream of predictions, in the folder ``path``.

    Sums of batches are kept as runs, like the digits of a binary number: batch ``b`` is merged with the runs before it
    that make ``b + 1`` end in fewer ones. So a sum is written again once for each doubling of the number of batches, a table
    is read from at most ``log2`` of them, and a batch that is retried writes the same run anew from the same runs. Runs that
    were merged go when the next batch comes, which shows that the merge is committed.

    Rows need the columns of ``row_key``, ``label``, and one ``pred_<arm>`` per arm. Of rows with one key the first
    counts.
    """

    def __init__(self, spark: SparkSession, path: str, key: Sequence[str] = KEY, row_key: Sequence[str] = ROW_KEY, arms: Sequence[str] = ARMS):
        self.spark, self.path, self.key, self.row_key, self.arms = spark, path.rstrip("/"), list(key), list(row_key), list(arms)

    # --- Runs ---------------------------------------------------------------

    @staticmethod
    def cover(batches: int) -> list[tuple[int, int]]:
        """First and last batch of the runs that hold the first ``batches`` batches: its binary digits."""
        runs, start = [], 0
        for bit in reversed(range(batches.bit_length())):
            if batches >> bit & 1:
                runs.append((start, start + (1 << bit) - 1))
                start += 1 << bit
        return runs

    def _run(self, run: tuple[int, int]) -> str:
        return f"{self.path}/runs/{run[0]:09d}-{run[1]:09d}"

    def _merged_by(self, batch: int) -> list[tuple[int, int]]:
        """Runs that go into the run of this batch."""
        first = self.cover(batch + 1)[-1][0]
        return [run for run in self.cover(batch) if run[0] >= first]

    def _add(self, rows: DataFrame, batch: int) -> None:
        """Sums of the batch and of the runs it completes, as one run."""
        hits = [F.count_if(F.col("label") == F.col(f"pred_{arm}")).alias(arm) for arm in self.arms]
        sums = rows.groupBy(*self.key, "label").agg(F.count(F.lit(1)).alias("_n"), *hits)
        parts = [rows.sparkSession.read.schema(sums.schema).parquet(self._run(r)) for r in self._merged_by(batch)]
        if parts:
            sums = self._total(reduce(DataFrame.unionByName, parts, sums))
        sums.write.mode("overwrite").parquet(self._run(self.cover(batch + 1)[-1]))
        files = file_system(self.spark, self.path)
        for run in self._merged_by(batch - 1) if batch else ():
            files.remove(self._run(run))

    def _total(self, sums: DataFrame) -> DataFrame:
        return sums.groupBy(*self.key, "label").agg(*[F.sum(c).alias(c) for c in ("_n", *self.arms)])

    # --- Stream and table -------------------------------------------------------

    def start(self, stream: DataFrame):
        """Start the stream over what is there now; it goes on from where it was."""
        fresh = stream.dropDuplicates(self.row_key)
        return (
            fresh.writeStream.foreachBatch(self._add).outputMode("append").trigger(availableNow=True)
            .option("checkpointLocation", f"{self.path}/checkpoint").start()
        )

    def drain(self, stream: DataFrame, timeout: int | None = None) -> None:
        """Process what is there now and stop. With a ``timeout`` in seconds, a stream that takes longer is stopped and fails."""
        run = self.start(stream)
        if timeout is None:
            run.awaitTermination()
        elif not run.awaitTermination(timeout):
            run.stop()
            raise TimeoutError(f"the stream did not finish within {timeout} seconds")

    def batches(self) -> int:
        """Batches that are committed, as the stream's own log tells."""
        names = file_system(self.spark, self.path).names(f"{self.path}/checkpoint/commits")
        return max((int(n) + 1 for n in names if n.isdigit()), default=0)

    def accuracies(self) -> DataFrame:
        """The table after the last committed batch; as ``scoring.accuracies`` of all rows so far."""
        runs = self.cover(self.batches())
        if not runs:
            raise ValueError("no batch came yet")
        parts = [self.spark.read.parquet(self._run(run)) for run in runs]
        return scoring.accuracies_of_sums(reduce(DataFrame.unionByName, parts), self.key, self.arms)
