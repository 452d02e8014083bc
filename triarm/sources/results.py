"""Result tables: accuracy trees, runs, predictions, manifests, draws."""

from collections.abc import Sequence
from dataclasses import asdict, dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from triarm.functions.fixed_values import REPLICATE_GROUP

# Layout m{num_train}/n{num_test}/{lm_type}/{dataset}/accuracies.csv, with
# or without "name=" in front of the values; run folders are run-{time}[-{name}].
TREE_KEYS = r"/m=?(\d+)/n=?(\d+)/(?:lm_type=)?([^/]+)/(?:dataset=)?([^/]+)/[^/]+$"
RUN_KEY = r"/run=?-?(\d{4}-\d{2}-\d{2}_\d{2}-\d{2}-\d{2})"
RUN_TIME = "yyyy-MM-dd_HH-mm-ss"
ACCURACY_FIELDS = {
    "base": "double", "extra": "double", "test": "double", "majority": "double",
    "num_classes": "int", "majority_all": "double",
}


def tree_keys(path: Column) -> list[Column]:
    """The keys a result file has in its path."""
    part = lambda i: F.regexp_extract(path, TREE_KEYS, i)
    return [
        part(1).cast("int").alias("num_train"), part(2).cast("int").alias("num_test"),
        part(3).alias("lm_type"), part(4).alias("dataset"),
    ]


def run_time(path: Column) -> Column:
    """Start time of the run a file belongs to, from its folder; NULL without one."""
    stamp = F.nullif(F.regexp_extract(path, RUN_KEY, 1), F.lit(""))
    return F.to_timestamp(stamp, RUN_TIME)


def read_accuracy_tree(
    spark: SparkSession, home: str, num_train: int | None = None, num_test: int | None = None,
    lm_type: str | None = None, runs: str = "",
) -> DataFrame:
    """Every accuracy file below ``home`` in one scan, keys taken from the paths.

    A file with the column ``subsample_idx`` says which subsample a row is; in others it
    is the row's number, so files are read whole: they hold one row per subsample of one
    dataset. Fixed keys narrow the path, so other files are not even listed. Columns go
    by the header of each file.
    """
    size = lambda name, value: f"{name}*" if value is None else f"{{{name}{value},{name}={value}}}"
    model = "*" if lm_type is None else f"{{{lm_type},lm_type={lm_type}}}"
    leaf = f"{size('m', num_train)}/{size('n', num_test)}/{model}/*"
    files = (
        spark.read.option("pathGlobFilter", "{accuracies,part-}*.csv")
        .text("/".join(x for x in (home, runs, leaf) if x), wholetext=True)
    )
    lines = F.filter(F.split("value", "\r?\n"), lambda line: line != "")
    rows = files.select(F.col("_metadata.file_path").alias("path"), lines.alias("lines")).select(
        "path", F.split(F.get("lines", F.lit(0)), ",").alias("header"), F.posexplode("lines").alias("line_no", "line")
    ).where("line_no > 0")
    fields = F.map_from_arrays("header", F.split("line", ","))
    parsed = rows.select("path", "line_no", fields.alias("fields"))
    index = F.coalesce(F.try_element_at("fields", F.lit("subsample_idx")), F.col("line_no").cast("string")).cast("int")
    values = [F.col("fields")[name].cast(kind).alias(name) for name, kind in ACCURACY_FIELDS.items()]
    return parsed.select(*tree_keys(F.col("path")), index.alias("subsample_idx"), *values, run_time(F.col("path")).alias("run_time"))


def latest_runs(df: DataFrame, key: Sequence[str] = REPLICATE_GROUP) -> DataFrame:
    """Where runs hold results of the same group, keep those of the latest run.

    Results outside of a run folder (no ``run_time``) count as older than all runs.
    """
    dated = df.withColumn("_when", F.coalesce("run_time", F.lit(datetime(1900, 1, 1))))
    newest = dated.groupBy(*key).agg(F.max("_when").alias("_when"))
    return dated.join(newest, [*key, "_when"], "left_semi").drop("_when")


def write_accuracy_tree(df: DataFrame, path: str) -> None:
    """One CSV per replicate group, rows in subsample order. Existing results are not overwritten.

    The last column is ``subsample_idx``, so groups with gaps keep their numbers.
    """
    keys = [F.col("num_train").alias("m"), F.col("num_test").alias("n"), "lm_type", "dataset"]
    leaf = ["m", "n", "lm_type", "dataset"]
    rows = df.select(*keys, *ACCURACY_FIELDS, "subsample_idx")
    ordered = rows.repartition(*leaf).sortWithinPartitions(*leaf, "subsample_idx")
    ordered.write.mode("errorifexists").partitionBy(*leaf).option("header", True).csv(path)


def write_partitioned(df: DataFrame, path: str, keys: Sequence[str]) -> None:
    """Parquet in folders by key. Rebalancing makes few files per folder and splits a hot one."""
    df.hint("rebalance", *keys).write.mode("errorifexists").partitionBy(*keys).parquet(path)


def write_accuracies(df: DataFrame, path: str) -> None:
    write_partitioned(df, path, REPLICATE_GROUP)


def write_predictions(df: DataFrame, path: str) -> None:
    """Test rows with probabilities, by dataset and replicate; ``row_id`` keeps the source row."""
    write_partitioned(df, path, ("dataset", "subsample_idx"))


def write_predictions_csv(df: DataFrame, path: str) -> None:
    keys = ("dataset", "subsample_idx")
    df.hint("rebalance", *keys).write.mode("errorifexists").partitionBy(*keys).option("header", True).csv(path)


def write_train_metrics(df: DataFrame, path: str) -> None:
    """Records ``(dataset, subsample_idx, split, train_type, global_step, metrics)``."""
    write_partitioned(df, path, ("dataset", "subsample_idx"))


def train_record(split: Column, train_type: Column, global_step: Column | None = None, metrics: Column | None = None) -> Column:
    """What a training step reports; step and metrics stay empty where nothing was trained."""
    step = F.lit(None).cast("bigint") if global_step is None else global_step.cast("bigint")
    values = F.create_map().cast("map<string,double>") if metrics is None else metrics
    return F.struct(
        split.alias("split"), train_type.alias("train_type"), step.alias("global_step"), values.alias("metrics")
    )


def write_draws(df: DataFrame, path: str) -> None:
    write_partitioned(df, path, ("effect", "num_test"))


def read_draws(spark: SparkSession, path: str, effect: str | None = None, num_test: int | None = None) -> DataFrame:
    """Draws; effect and test size are folders, so others are not read."""
    draws = spark.read.parquet(path)
    if effect is not None:
        draws = draws.where(F.col("effect") == effect)
    return draws if num_test is None else draws.where(F.col("num_test") == num_test)


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """Files below a result folder; only their metadata is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", "length", "modificationTime")


# --- Transfers -----------------------------------------------------------------------

def group_sums(df: DataFrame, key: Sequence[str] = REPLICATE_GROUP) -> DataFrame:
    """What a result table holds of each group: ``(*key, n_rows, checksum)``.

    The checksum is a sum over the rows, so it depends neither on files nor on order, and a group that came twice has it twice.
    """
    others = sorted(c for c in df.columns if c not in key)
    row = F.xxhash64(*[F.col(f"`{c}`") for c in others]).cast("decimal(20,0)")
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("n_rows"), F.sum(row).alias("checksum"))


def transfer_outcomes(source: DataFrame, target: DataFrame, key: Sequence[str] = REPLICATE_GROUP) -> DataFrame:
    """What became of each group of ``source`` in ``target``: ``(*key, n_rows, n_found, outcome)``.

    The outcome is complete, missing, unexpected (not in the source), doubled (a whole number of times there), truncated (fewer
    rows) or changed. Only sums per group meet.
    """
    sums = lambda df, name: group_sums(df, key).select(
        F.struct(*key).alias("_group"), F.struct("n_rows", "checksum").alias(name))
    both = sums(source, "_a").join(sums(target, "_b"), "_group", "full")
    a, b = F.col("_a"), F.col("_b")
    times = F.call_function("div", b["n_rows"], a["n_rows"])
    repeated = (b["n_rows"] % a["n_rows"] == 0) & (b["checksum"] == a["checksum"] * times)
    outcome = (
        F.when(b.isNull(), "missing").when(a.isNull(), "unexpected").when(repeated & (times == 1), "complete")
        .when(repeated, "doubled").when(b["n_rows"] < a["n_rows"], "truncated").otherwise("changed"))
    return both.select("_group.*", a["n_rows"].alias("n_rows"), b["n_rows"].alias("n_found"), outcome.alias("outcome"))


LEADERBOARD = {"Rank": "int", "Submitter": "string", "Overall": "double"}


def read_leaderboard(spark: SparkSession, path: str, columns: dict[str, str] = LEADERBOARD) -> DataFrame:
    """Tab-separated ranking, best first, its columns by the names in the header, in lower case.

    A cell that is no number is NULL; rows with damaged or missing later cells are kept. A column
    that the header lacks fails.
    """
    rows = spark.read.option("sep", "\t").option("header", True).option("mode", "PERMISSIVE").csv(path)
    found = {name.strip().lower(): name for name in rows.columns}
    if missing := [name for name in columns if name.lower() not in found]:
        raise ValueError(f"the header of {path} lacks {missing}")
    cells = [F.trim(F.col(f"`{found[name.lower()]}`")).try_cast(kind).alias(name.lower().replace(" ", "_"))
             for name, kind in columns.items()]
    return rows.select(*cells).orderBy(F.col("overall").desc_nulls_last(), "rank")


# --- Run manifests -----------------------------------------------------------------

# Names and defaults of the settings, as published manifests hold them. A run here uses the names, sizes and LM type.
@dataclass(frozen=True)
class Experiment:
    """Settings of a run, as they are written next to its results."""

    lm_type: str
    run_name: str = ""
    dataset_names: tuple[str, ...] = ()
    num_subsamples: int = 50
    num_train: int = 100
    num_test: int = 200
    per_device_train_batch_size_pretrain: int = 16
    per_device_train_batch_size_classification: int = 16
    per_device_eval_batch_size_classification: int = 64
    num_train_epochs_classification: int = 3
    num_train_epochs_pretrain: int = 2
    keep_models: bool = False

    def run_id(self, now: datetime) -> str:
        name = f"-{self.run_name}" if self.run_name else ""
        return f"run-{now:%Y-%m-%d_%H-%M-%S}{name}"

    def results_path(self, run_id: str, dataset: str) -> str:
        short = dataset.rsplit("/", 1)[-1]
        return f"{run_id}/accuracies/m{self.num_train}/n{self.num_test}/{self.lm_type}/{short}"


def results_path(run_id: Column) -> Column:
    """The same for each row of a result table."""
    short = F.substring_index("dataset", "/", -1)
    return F.concat(run_id, F.lit("/accuracies/m"), "num_train", F.lit("/n"), "num_test", F.lit("/"), "lm_type", F.lit("/"), short)


_SPARK_TYPES = {str: T.StringType(), int: T.IntegerType(), bool: T.BooleanType()}
MANIFEST_SCHEMA = T.StructType([
    T.StructField(name, T.ArrayType(T.StringType()) if name == "dataset_names" else _SPARK_TYPES[kind])
    for name, kind in Experiment.__annotations__.items()
])


def write_manifest(spark: SparkSession, experiment: Experiment, path: str) -> None:
    """One JSON row."""
    values = asdict(experiment)
    values["dataset_names"] = list(experiment.dataset_names)
    spark.createDataFrame([values], MANIFEST_SCHEMA).write.mode("errorifexists").json(path)


def read_manifests(spark: SparkSession, path: str) -> DataFrame:
    """One row per file; a manifest may be one line or indented."""
    return spark.read.schema(MANIFEST_SCHEMA).option("multiLine", True).json(path)
