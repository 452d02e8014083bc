"""Dataset specs: what to read, and which expressions make text and label."""

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F

from triarm.functions.fixed_values import RAW_COLUMNS, SUBSETS, TASKS


@dataclass(frozen=True)
class DatasetSpec:
    """A labelled text dataset.

    ``text``, ``label`` and ``keep`` are Spark SQL over the raw columns, so the
    filter and the columns reach the scan. ``processor`` takes over where SQL is
    not enough; ``loader`` replaces the table scan.
    """

    location: str
    class_names: tuple[str, ...]
    task: str
    subset: str | None = None
    text: str = "text"
    label: str = "label"
    keep: str | None = None
    processor: Callable[[DataFrame], DataFrame] | None = field(default=None, compare=False)
    loader: Callable[[SparkSession, str], DataFrame] | None = field(default=None, compare=False)

    def __post_init__(self):
        if not self.location:
            raise ValueError("a dataset needs a location")
        if not self.class_names or not all(self.class_names):
            raise ValueError(f"{self.location}: class names cannot be empty")

    @property
    def name(self) -> str:
        return self.location.rsplit("/", 1)[-1]

    def process(self, raw: DataFrame) -> DataFrame:
        """Canonical ``text`` and ``label`` next to the raw columns."""
        if self.processor is not None:
            return self.processor(raw)
        kept = raw if self.keep is None else raw.where(self.keep)
        return kept.withColumns({"text": F.expr(self.text), "label": F.expr(self.label)})


def _spec(location: str, class_names: tuple[str, ...], task: str) -> DatasetSpec:
    text, label, keep = RAW_COLUMNS.get(location, ("text", "label", None))
    return DatasetSpec(location, class_names, task, SUBSETS.get(location), text, label, keep)


REGISTRY: dict[str, DatasetSpec] = {task[0]: _spec(*task) for task in TASKS}


def dataset_names(names: Iterable[str] | None = None) -> list[str]:
    """Names sorted without owner; two owners may not share a short name."""
    chosen = list(REGISTRY if names is None else names)
    short = [n.rsplit("/", 1)[-1] for n in chosen]
    if len(set(short)) < len(short):
        raise ValueError("datasets of different owners share a name, which is not allowed")
    return sorted(chosen, key=lambda n: n.rsplit("/", 1)[-1])


def specs_frame(spark: SparkSession, specs: Iterable[DatasetSpec]) -> DataFrame:
    """Specs as a table: one row per dataset."""
    rows = [(s.name, s.location, s.subset, list(s.class_names), s.task) for s in specs]
    schema = "dataset string, location string, subset string, class_names array<string>, task string"
    return spark.createDataFrame(rows, schema)
