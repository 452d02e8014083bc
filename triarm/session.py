"""A session with the settings the operators count on."""

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

PACKAGE = Path(__file__).resolve().parent
# The packed file of each application, which goes when the driver ends.
_SHIPPED: dict[str, tempfile.TemporaryDirectory] = {}

# Runtime re-planning: broadcast by measured size, split skewed joins, merge small
# partitions. UTC keeps times comparable. State of streams lives on disk.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def build_session(name: str, master: str | None = None, **settings: str) -> SparkSession:
    """Session with the defaults above; ``settings`` come last."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **settings}.items():
        builder = builder.config(key, value)
    session = builder.getOrCreate()
    ship(session)
    return session


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once an application, so that they need no installation.

    The driver packs it into a file that Spark serves to them.
    """
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    folder = _SHIPPED[context.applicationId] = tempfile.TemporaryDirectory()
    path = f"{folder.name}/{PACKAGE.name}-{context.applicationId}.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as packed:
        for source in sorted(PACKAGE.rglob("*.py")):
            packed.write(source, source.relative_to(PACKAGE.parent))
    context.addPyFile(path)
