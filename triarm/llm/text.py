"""Words and substring hashes of many texts at once, for native plans and for Arrow batches.

A word is a run of bytes other than the space and the control characters 9 to 13. In UTF-8 these
bytes never belong to another character, so cutting bytes is cutting characters.
"""

import ctypes
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from triarm.session import ship

SPACE = "[\\x09-\\x0D\\x20]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Bytes of text that are worked on together. Some ten arrays of eight times that size are alive.
SLICE_BYTES = 1 << 18

HASH_SEED = 20_240_229


# Bytes of an Arrow batch, where the session has Spark's own limit.
ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES, SPARK_BYTES = 4 << 20, "67108864b"

# What operators keep in a worker process for its next task, by module: how to forget it.
KEPT: dict[str, Callable[[], None]] = {}


def _give_back() -> None:
    """Return freed memory to the machine; workers are reused by other operators."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def _tidily(run: Callable, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for module, forget in KEPT.items():
        if module != run.__module__:
            forget()
    try:
        yield from run(batches)
    finally:
        _give_back()


def map_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``df.mapInArrow(run, schema)`` in batches of bounded size.

    A worker process serves many tasks: one that starts on an operator forgets what the others kept, and one that ends
    gives its memory back.
    """
    spark = df.sparkSession
    ship(spark)
    if spark.conf.get(ARROW_BYTES) == SPARK_BYTES:
        spark.conf.set(ARROW_BYTES, f"{BATCH_BYTES}b")
    return df.mapInArrow(lambda batches: _tidily(run, batches), schema)


def words(text: Column) -> Column:
    """Words of a text in order; no words for NULL."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, however often ``use`` refers to it."""
    return F.transform(F.array(value), use)[0]


def crc_fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; 0 for NULL."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds, F.lit(0))


def unused(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``df`` does not have."""
    while name.lower() in (c.lower() for c in df.columns):
        name += "_"
    return name


def text_key(text: Column) -> Column:
    """16 bytes that stand for a text; NULL counts as the empty text."""
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2^64."""
    base = 0x9E3779B97F4A7C15
    inverse = pow(base, -1, 1 << 64)
    out = []
    for x in (base, inverse):
        steps = np.full(n + 1, x, dtype=np.uint64)
        steps[0] = 1
        out.append(np.multiply.accumulate(steps))
    return out[0], out[1]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """At least ``n + 1`` powers; sizes are rounded up so that few tables are made."""
    return _powers(max(SLICE_BYTES, 1 << (n - 1).bit_length() if n else 0))


@cache
def _byte_values(fold_case: bool) -> np.ndarray:
    values = np.random.default_rng(HASH_SEED).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    if fold_case:
        values[65:91] = values[97:123]
    return values


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the output."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class SubstringHashes:
    """64-bit hashes of any substrings of ``data``; equal bytes give equal hashes wherever they are."""

    def __init__(self, data: np.ndarray, fold_case: bool = False):
        self.power, self.inverse = powers(len(data))
        self.sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(_byte_values(fold_case)[data] * self.power[:len(data)], out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.inverse[starts] + (ends - starts).astype(np.uint64))


@dataclass
class Slice:
    """Texts ``rows`` of a batch as one byte array; text ``i`` is ``data[offsets[i]:offsets[i + 1]]``."""

    rows: slice
    data: np.ndarray
    offsets: np.ndarray


def slices(texts: pa.Array, max_bytes: int = SLICE_BYTES) -> Iterator[Slice]:
    """Cut a column of texts into runs of whole texts of about ``max_bytes``; NULL is the empty text."""
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    n = len(texts)
    if not n:
        return
    _, offset_buffer, data_buffer = texts.buffers()
    offsets = np.frombuffer(offset_buffer, dtype=np.int64)[texts.offset:texts.offset + n + 1]
    data = np.frombuffer(data_buffer, dtype=np.uint8) if data_buffer else np.zeros(0, dtype=np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + max_bytes, "right")) - 1)
        part = offsets[first:last + 1]
        yield Slice(slice(first, last), data[part[0]:part[-1]], part - part[0])
        first = last


@cache
def separators(letters_only: bool) -> np.ndarray:
    """Which bytes end a word: white space, or all of ASCII but letters and digits."""
    table = np.zeros(256, dtype=bool)
    table[[32, *range(9, 14)]] = True
    if letters_only:
        table[:128] = True
        for low, high in ((48, 58), (65, 91), (97, 123)):
            table[low:high] = False
    return table


@dataclass
class Words:
    """Words of a slice: where they are, their text's number, their hash, and the first word of each text."""

    starts: np.ndarray
    ends: np.ndarray
    doc: np.ndarray
    hashes: np.ndarray
    first: np.ndarray


def cut_words(part: Slice, letters_only: bool = False) -> Words:
    """Words of the slice, hashed with A-Z in lower case."""
    n = len(part.data)
    inside = ~separators(letters_only)[part.data]
    begin, end = inside.copy(), inside.copy()
    if n:
        begin[1:] &= ~inside[:-1]
        end[:-1] &= ~inside[1:]
        heads = part.offsets[:-1][part.offsets[:-1] < n]
        begin[heads] |= inside[heads]
        tails = part.offsets[1:][part.offsets[1:] > 0] - 1
        end[tails] |= inside[tails]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    first = np.searchsorted(starts, part.offsets)
    doc = np.repeat(np.arange(len(part.offsets) - 1), np.diff(first))
    return Words(starts, ends, doc, SubstringHashes(part.data, fold_case=True).of(starts, ends), first)


def binary_column(rows: list[bytes]) -> pa.Array:
    return pa.array(rows, type=pa.binary())


def signed(x: np.ndarray) -> np.ndarray:
    """64-bit hashes as Spark's longs."""
    return np.ascontiguousarray(x).view(np.int64)
