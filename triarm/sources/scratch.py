"""Shared working folder for tables that are written and read again."""

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, functions as F

CHECKPOINT_DIR = "spark.checkpoint.dir"


_LOCAL_DIRS: dict[str, str] = {}
_MADE: list[str] = []  # paths that were handed out while a ``working`` block is open
_OPEN = [0]


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    Only a session whose driver is its only process (a test) may do without: it gets a temporary folder.
    """
    folder = spark.conf.get(CHECKPOINT_DIR, None)
    if folder:
        return folder.rstrip("/")
    context = spark.sparkContext
    if context.master != "local" and not context.master.startswith("local["):
        raise ValueError(f"set {CHECKPOINT_DIR} to a folder all executors can reach")
    if context.applicationId not in _LOCAL_DIRS:
        _LOCAL_DIRS[context.applicationId] = tempfile.mkdtemp(prefix="run-")
    return _LOCAL_DIRS[context.applicationId]


def new_path(spark: SparkSession, name: str) -> str:
    """A path nobody has written to yet."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if _OPEN[0]:
        _MADE.append(path)
    return path


@contextmanager
def working(spark: SparkSession) -> Iterator[None]:
    """Owner of the tables that are stored inside the block: they go when it ends.

    So results must be written within. Stored tables of no block stay, as a caller may still read them.
    """
    start = len(_MADE)
    _OPEN[0] += 1
    try:
        yield
    finally:
        _OPEN[0] -= 1
        made = _MADE[start:]
        del _MADE[start:]
        for path in made:
            file_system(spark, path).remove(path)


class FileSystem:
    """The few things the library asks of a path, wherever it is."""

    def __init__(self, spark: SparkSession, path: str):
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._files = self._path(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def names(self, path: str) -> list[str]:
        """Names in a folder; none if there is no such folder."""
        folder = self._path(path)
        return [f.getPath().getName() for f in self._files.listStatus(folder)] if self._files.exists(folder) else []

    def remove(self, path: str) -> None:
        self._files.delete(self._path(path), True)


def file_system(spark: SparkSession, path: str) -> FileSystem:
    return FileSystem(spark, path)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table that several later steps read, and read it back.

    The copy is in the shared folder, so it outlives the executors that made it.
    """
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def rounds(spark: SparkSession) -> Callable[[DataFrame, str], DataFrame]:
    """``stored`` for the tables of a loop, where each round reads what the one before stored, and nobody else does.

    A table that is stored takes the place of the one before, which goes. The last one stays.
    """
    last: list[str] = []

    def store(df: DataFrame, name: str) -> DataFrame:
        path = new_path(spark, name)
        df.write.parquet(path)
        while last:
            old = last.pop()
            file_system(spark, old).remove(old)
        last.append(path)
        return spark.read.schema(df.schema).parquet(path)

    return store


# Broadcast only what provably stays below this many rows of ids and short keys.
BROADCAST_ROWS = 500_000


def broadcast_bounded(df: DataFrame, max_rows: int) -> DataFrame:
    """Broadcast ``df`` if its row bound allows it, else let the join shuffle."""
    return F.broadcast(df) if max_rows <= BROADCAST_ROWS else df


def spread(df: DataFrame, *columns: str) -> DataFrame:
    """Share out few rows over all shuffle partitions before they turn into many.

    The explicit number keeps adaptive execution from merging the small partitions.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *columns)
