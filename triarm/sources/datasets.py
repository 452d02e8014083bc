"""Dataset scans and the canonical table."""

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from triarm.operators.validate import require_valid
from triarm.sources.specs import DatasetSpec

# The split that is read, and the one read where it is unknown.
SPLITS = ("train", "test")


def scan_split(spark: SparkSession, root: str, fmt: str = "parquet", subset: str | None = None) -> DataFrame:
    """Rows of split ``train``; of split ``test`` only where the table has no ``train``.

    Tables are laid out as ``root[/subset=..]/split=..``, so naming the split and
    subset reads their files alone. Errors other than an unknown split are raised.
    """
    folder = root if subset is None else f"{root}/subset={subset}"
    try:
        return spark.read.format(fmt).option("basePath", root).load(f"{folder}/split={SPLITS[0]}")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
    return spark.read.format(fmt).option("basePath", root).load(f"{folder}/split={SPLITS[1]}")


def with_row_id(df: DataFrame) -> DataFrame:
    """Give a Parquet scan the stable key ``path:position``."""
    position = F.col("_metadata.row_index").cast("string")
    return df.withColumn("row_id", F.concat_ws(":", F.col("_metadata.file_path"), position))


def canonical(raw: DataFrame, spec: DatasetSpec) -> DataFrame:
    """Process and cast, without the checks."""
    df = spec.process(raw)
    casts = {c: F.col(c).cast(t) for c, t in (("text", "string"), ("label", "int")) if c in df.columns}
    return df.withColumns(casts) if casts else df


def load_dataset(spark: SparkSession, spec: DatasetSpec, root: str | None = None) -> DataFrame:
    """Scan, process and validate one dataset.

    The scan is ``spec.loader`` or the split layout below ``root/<location>``. A
    table without ``row_id`` gets one from its files.
    """
    if spec.loader is not None:
        raw = spec.loader(spark, spec.location)
    elif root is not None:
        raw = scan_split(spark, f"{root}/{spec.location}", subset=spec.subset)
    else:
        raise ValueError(f"{spec.location}: give a loader or the root of the tables")
    if "row_id" not in raw.columns:
        raw = with_row_id(raw)
    df = canonical(raw, spec)
    require_valid(df, spec.class_names)
    return df
