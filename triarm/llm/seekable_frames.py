"""Fill-in-middle over texts that are kept as seekable compressed frames.

A text is cut into frames of bounded size, each a zstandard frame of its own, with the units, code points and
bytes that lie before it. A cut after ``k`` units is found by the counts alone but for the one frame it lies in, which
is decompressed; everything else is streamed in order, a frame at a time, into a digest or into the frames of the
output. So new cuts (another seed, another rate) cost no second pass over the raw texts, and no more of a text
than a frame is in the clear at once.

Units are words together with the white space before them; white space after the last word is one more.

Odd rows. A NULL text is empty, and an empty text stays plain with no units. A NULL id draws as the empty id. Equal
rows give equal rows. Only ``doc_id`` and ``text`` are read, so further columns may have any names. A text without
white space is one unit, however many frames it fills. An empty table gives an empty table.
"""

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from triarm.llm.text import map_arrow, separators

FRAME_BYTES = 1 << 16
LEVEL = 3

# What stands before a part of the output.
MARKERS = {"prefix": b"<P>", "suffix": b"<S>", "middle": b"<M>"}
ORDERS = {"psm": ("prefix", "suffix", "middle"), "spm": ("suffix", "prefix", "middle")}

FRAME = "STRUCT<units: BIGINT, chars: BIGINT, bytes: BIGINT, data: BINARY>"
FRAME_ARROW = pa.struct([
    ("units", pa.int64()), ("chars", pa.int64()), ("bytes", pa.int64()), ("data", pa.binary())])
FRAMED = f"n BIGINT, n_chars BIGINT, n_bytes BIGINT, marked BOOLEAN, frames ARRAY<{FRAME}>"

# Rows are passed on when their frames reach this size.
BATCH_BYTES = 8 << 20


def _inside(data: np.ndarray) -> np.ndarray:
    return ~separators(False)[data]


def _is_start(data: np.ndarray) -> np.ndarray:
    """Which bytes begin a code point."""
    return (data & 0xC0) != 0x80


@dataclass(frozen=True)
class Cut:
    """A place in a text: the bytes and the code points before it."""

    bytes: int
    chars: int


class Frames:
    """A text as its frames; ``units`` of a frame are those that end before it."""

    def __init__(self, rows: list[dict], n_bytes: int):
        self.rows, self.n_bytes = rows, n_bytes
        self._open = zstandard.ZstdDecompressor().decompress

    @classmethod
    def of(cls, pieces: Iterator[bytes], pack: Callable[[bytes], bytes]) -> tuple["Frames", int, int]:
        """Frames of the text that ``pieces`` add up to, its units and its code points."""
        rows, n_bytes, units, chars, rest = [], 0, 0, 0, b""
        before = False  # whether the byte before the frame is in a word

        def add(part: bytes) -> None:
            nonlocal n_bytes, units, chars, before
            data = np.frombuffer(part, dtype=np.uint8)
            inside = _inside(data)
            units += int(before and not inside[0])  # a word that ended with the frame before
            rows.append({"units": units, "chars": chars, "bytes": n_bytes, "data": pack(part)})
            units += int(np.count_nonzero(inside[:-1] & ~inside[1:]))
            chars += int(np.count_nonzero(_is_start(data)))
            n_bytes += len(part)
            before = bool(inside[-1])

        for piece in pieces:
            rest = rest + piece if rest else piece
            while len(rest) >= FRAME_BYTES + 4:
                end = FRAME_BYTES
                while rest[end] & 0xC0 == 0x80:  # a code point stays whole
                    end -= 1
                add(rest[:end])
                rest = rest[end:]
        if rest:
            add(rest)
        # The last word, or white space after it, is the last unit.
        return cls(rows, n_bytes), units + bool(n_bytes), chars

    def frame(self, i: int) -> bytes:
        return self._open(self.rows[i]["data"])

    def stream(self, start: int = 0, end: int | None = None) -> Iterator[bytes]:
        """The bytes of ``[start, end)``, a frame at a time."""
        end = self.n_bytes if end is None else end
        for i, row in enumerate(self.rows):
            after = self.rows[i + 1]["bytes"] if i + 1 < len(self.rows) else self.n_bytes
            if row["bytes"] < end and after > start:
                yield self.frame(i)[max(0, start - row["bytes"]):end - row["bytes"]]

    def after_units(self, k: int, n: int, n_chars: int) -> Cut:
        """The place after ``k`` of ``n`` units; decompresses the one frame it lies in."""
        if k == 0:
            return Cut(0, 0)
        if k == n:
            return Cut(self.n_bytes, n_chars)
        i = max(j for j, row in enumerate(self.rows) if row["units"] < k)
        row = self.rows[i]
        data = np.frombuffer(self.frame(i), dtype=np.uint8)
        inside = _inside(data)
        ends = np.flatnonzero(inside[:-1] & ~inside[1:]) + 1
        j = k - row["units"] - 1
        end = int(ends[j]) if j < len(ends) else len(data)  # the last may end with the frame
        return Cut(row["bytes"] + end, row["chars"] + int(np.count_nonzero(_is_start(data[:end]))))

    def find(self, wanted: bytes, start: int) -> int:
        """Where ``wanted`` is first found from byte ``start`` on."""
        kept, at = b"", start
        for piece in self.stream(start):
            place = (kept + piece).find(wanted)
            if place >= 0:
                return at - len(kept) + place
            at += len(piece)
            kept = (kept + piece)[1 - len(wanted):]
        raise ValueError(f"no {wanted!r} in this output")


def digest(pieces: Iterator[bytes]) -> str:
    found = hashlib.sha256()
    for piece in pieces:
        found.update(piece)
    return found.hexdigest()


def rearranged(text: Frames, form: str, first: Cut, second: Cut) -> Iterator[bytes]:
    """The output of a text in order, a frame at a time."""
    parts = {"prefix": (0, first.bytes), "middle": (first.bytes, second.bytes), "suffix": (second.bytes, text.n_bytes)}
    if form == "plain":
        yield from text.stream()
        return
    for name in ORDERS[form]:
        yield MARKERS[name]
        yield from text.stream(*parts[name])


def rebuilt(output: Frames, form: str) -> Iterator[bytes]:
    """The text that an output was made of, from the output and its form alone."""
    if form == "plain":
        yield from output.stream()
        return
    order = ORDERS[form]
    starts = [0]
    for name in order[1:]:
        starts.append(output.find(MARKERS[name], starts[-1]))
    ends = [*starts[1:], output.n_bytes]
    parts = {name: (s + len(MARKERS[name]), e) for name, s, e in zip(order, starts, ends)}
    for name in ("prefix", "middle", "suffix"):
        yield from output.stream(*parts[name])


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: Callable[[tuple], int]) -> Iterator[pa.RecordBatch]:
    """Rows as record batches of about ``BATCH_BYTES``."""
    held, held_bytes = [], 0
    for row in rows:
        held.append(row)
        held_bytes += size(row)
        if held_bytes >= BATCH_BYTES or len(held) >= 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, held_bytes = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def _pieces(text: bytes) -> Iterator[bytes]:
    return (text[i:i + FRAME_BYTES] for i in range(0, len(text), FRAME_BYTES))


def to_frames(docs: DataFrame) -> DataFrame:
    """``doc_id, n`` (units), ``n_chars, n_bytes, marked`` (holds a marker)``, frames``; one row for each document."""
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {FRAMED}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=LEVEL).compress
        for batch in batches:
            names = pa.schema([
                ("doc_id", batch.schema.field("doc_id").type), ("n", pa.int64()), ("n_chars", pa.int64()), ("n_bytes", pa.int64()),
                ("marked", pa.bool_()), ("frames", pa.list_(FRAME_ARROW))])

            def rows(batch=batch) -> Iterator[tuple]:
                for key, cell in zip(batch.column("doc_id"), batch.column("text")):
                    text = cell.as_py()
                    frames, n, n_chars = Frames.of(_pieces(text), pack)
                    marked = any(m in text for m in MARKERS.values())
                    yield key.as_py(), n, n_chars, len(text), marked, frames.rows

            yield from _batches(rows(), names, lambda r: sum(len(f["data"]) for f in r[-1]))

    return docs.transform(map_arrow, run, schema)


def choose_cuts(framed: DataFrame, seed: int, percent: int, spm_percent: int) -> DataFrame:
    """With ``form, first, second``: how a text is rearranged, and after how many units its prefix and middle end.

    Draws are hashes of seed and id, so reruns agree, in whatever order. A text that is empty or holds a marker stays plain.
    """
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    draw = lambda i: F.conv(F.substring("_draw_", 8 * i + 1, 8), 16, 10).cast("long")
    a, b = (F.pmod(draw(i), F.col("n") + 1) for i in (0, 1))
    plain = (F.col("n") == 0) | F.col("marked") | (draw(2) % 100 >= percent)
    return framed.withColumn("_draw_", h).withColumns({
        "form": F.when(plain, "plain").when(draw(3) % 100 < spm_percent, "spm").otherwise("psm"),
        "first": F.least(a, b), "second": F.greatest(a, b)}).drop("_draw_")


ROW = "n BIGINT, form STRING, prefix_chars BIGINT, middle_chars BIGINT"


def _outputs(cuts: DataFrame, extra: dict[str, pa.DataType], extra_ddl: str, use: Callable[[Frames, str], tuple]) -> DataFrame:
    """``doc_id``, the columns of ``ROW``, and what ``use(frames of the output, form)`` gives."""
    schema = f"doc_id {cuts.schema['doc_id'].dataType.simpleString()}, {ROW}, {extra_ddl}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Outputs are read once and dropped, so they are packed fast.
        pack = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            names = pa.schema([
                ("doc_id", batch.schema.field("doc_id").type), ("n", pa.int64()), ("form", pa.string()),
                ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), *extra.items()])

            def rows(batch=batch) -> Iterator[tuple]:
                columns = [batch.column(c) for c in ("doc_id", "n", "n_chars", "n_bytes", "form", "first", "second", "frames")]
                for cells in zip(*columns):
                    key, n, n_chars, n_bytes, form, first, second, frames = (c.as_py() for c in cells)
                    text = Frames(frames, n_bytes)
                    if form == "plain":
                        yield key, n, form, None, None, *use(text, form)
                        continue
                    cut, after = text.after_units(first, n, n_chars), text.after_units(second, n, n_chars)
                    output, *_ = Frames.of(rearranged(text, form, cut, after), pack)
                    yield key, n, form, cut.chars, after.chars - cut.chars, *use(output, form)

            yield from _batches(rows(), names, lambda r: sum(len(x) for x in r if isinstance(x, str)))

    return cuts.transform(map_arrow, run, schema)


def outputs(cuts: DataFrame) -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars`` (code points; NULL if plain) and the whole ``output``."""
    return _outputs(cuts, {"output": pa.string()}, "output STRING",
                    lambda output, form: (b"".join(output.stream()).decode(),))


def digests(cuts: DataFrame) -> DataFrame:
    """As ``outputs``, with the sha256 of the output and that of the text rebuilt from it, both streamed."""
    both = {"output_sha256": pa.string(), "restored_sha256": pa.string()}
    return _outputs(cuts, both, "output_sha256 STRING, restored_sha256 STRING",
                    lambda output, form: (digest(output.stream()), digest(rebuilt(output, form))))


def restore(rows: DataFrame) -> DataFrame:
    """``doc_id, text`` from ``doc_id, output, form``; the inverse of ``outputs``."""
    rows = rows.select("doc_id", F.col("output").cast("binary").alias("output"), "form")
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text STRING"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            names = pa.schema([("doc_id", batch.schema.field("doc_id").type), ("text", pa.string())])

            def texts(batch=batch) -> Iterator[tuple]:
                for key, output, form in zip(*(batch.column(c) for c in ("doc_id", "output", "form"))):
                    frames, *_ = Frames.of(_pieces(output.as_py()), pack)
                    yield key.as_py(), b"".join(rebuilt(frames, form.as_py())).decode()

            yield from _batches(texts(), names, lambda r: len(r[1]))

    return rows.transform(map_arrow, run, schema)
