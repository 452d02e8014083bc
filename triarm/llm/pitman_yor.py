"""Language-model scores by a hierarchical Pitman-Yor process.

Every context is a restaurant whose customers are the tokens seen after it and whose tables are dishes (tokens)
ordered from the parent restaurant: one customer there for each table. The context of a token is the whole word
before, its parent that word's last two bytes, whose parent is nothing; the root orders from a uniform base over the
known tokens and one for all others. How many tables a dish has is sampled by Gibbs steps: the customers of a dish are
seated anew, each at a table of its dish or, with a probability that grows with the parent's belief in the dish, at a
new one. The predictive probabilities of several samples are averaged.

Everything about a token lies in one part of the model (parts are ranges of word hashes), so a sweep is a map over
parts. What parts share is the number of customers and tables per restaurant. Those of the root and the parents, 65,537
at most, go through the driver. Those of the words before grow with the vocabulary and stay distributed: each
part sends the sums of its contexts to ranges of context hashes, where they are added up and sent back, one row per
part and range, so that a frequent context is one number of each part. Documents meet the parts as blocks of
counts, one block per part and batch of documents, and the sums of the parts come back per batch.
"""

import math
import pickle
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyspark
from pyspark.sql import DataFrame, functions as F

from triarm.llm.text import SLICE_BYTES, Slice, crc_fold, cut_words, map_arrow, slices
from triarm.sources.scratch import rounds

FOLDS = 10
PARENTS = 1 << 16  # a context is 47 bits of the hash of the word before, and its last two bytes
START = 0  # the context of a text's first token
END = np.uint64(0x0E2D0E2D0E2D0E2D)  # stands for the token that ends a text
STRENGTH = (1.0, 1.0, 1.0)  # of the root, the parents, the contexts
BURN_IN, SAMPLES = 2, 2
SEED = 4
# Text that a part of the model stands for, and text whose counts make one block.
PART_BYTES = 12 << 20
MAX_PARTS = 20_000
BLOCK_BYTES = 16 << 20
# Counts a task gathers before it adds up equal ones.
MERGE_ROWS = 4_000_000
_CODEC = "zstd"


# Arrays of as many values have each place of their bytes compressed by itself.
_LONG = 2048


def _pack(*values) -> bytes:
    """Values as bytes, with the bytes of arrays compressed place by place."""
    buffers: list[pickle.PickleBuffer] = []
    head = pickle.dumps(values, protocol=5, buffer_callback=buffers.append)
    arrays = []
    for buffer in buffers:
        raw, width = np.frombuffer(buffer.raw(), dtype=np.uint8), memoryview(buffer).itemsize
        places = np.ascontiguousarray(raw.reshape(-1, width).T)
        runs = places if places.shape[1] >= _LONG else [places]
        arrays.append((places.shape, [pa.compress(run, codec=_CODEC, asbytes=True) for run in runs]))
    return pickle.dumps((head, arrays), protocol=5)


def _unpack(data: bytes) -> tuple:
    head, arrays = pickle.loads(data)
    buffers = []
    for (width, n), runs in arrays:
        size = width * n // len(runs)
        raw = b"".join(pa.decompress(run, decompressed_size=size, codec=_CODEC, asbytes=True) for run in runs)
        buffers.append(np.ascontiguousarray(np.frombuffer(raw, dtype=np.uint8).reshape(width, n).T))
    return pickle.loads(head, buffers=buffers)


def _thin(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes in order as differences of their first 48 bits, and their last 16, which are letters in a context."""
    x = x.astype(np.uint64)
    return np.diff(x >> np.uint64(16), prepend=np.uint64(0)), x.astype(np.uint16)


def _full(thin: tuple[np.ndarray, np.ndarray], dtype=np.int64) -> np.ndarray:
    steps, last = thin
    return (np.cumsum(steps, dtype=np.uint64) << np.uint64(16) | last).astype(dtype)


def _thin_pairs(number: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers in order, and those in order for each of them, as differences."""
    first = np.diff(number, prepend=-1) != 0
    return _small(np.diff(number, prepend=0)), _small(np.where(first, at, np.diff(at, prepend=0)))


def _full_pairs(thin: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    number, at = (np.cumsum(x, dtype=np.int64) for x in thin)
    _, starts, ends = _runs(number)
    return number, at - np.repeat(at[starts] - thin[1][starts], ends - starts)


def _numbered(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different values in order, and the number of each value: ``np.unique`` that sorts only the different ones."""
    coded = pa.array(x).dictionary_encode()
    kinds = coded.dictionary.to_numpy()
    order = np.argsort(kinds)
    rank = np.empty(len(kinds), dtype=np.int32)
    rank[order] = np.arange(len(kinds), dtype=np.int32)
    return kinds[order], rank[coded.indices.to_numpy()]


def parent_of(context: np.ndarray) -> np.ndarray:
    return context % PARENTS


def tokens(part: Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token hashes, contexts and text numbers: each text's words and its end."""
    words = cut_words(part)
    texts = len(part.offsets) - 1
    n = len(words.hashes) + texts
    end = words.first[1:] + np.arange(texts)
    place = np.arange(len(words.hashes)) + words.doc
    token, doc = np.empty(n, dtype=np.uint64), np.empty(n, dtype=np.int64)
    token[place], token[end] = words.hashes, END
    doc[place], doc[end] = words.doc, np.arange(texts)
    fold = np.arange(256)
    fold[65:91] += 32
    last = fold[part.data[words.ends - 1]] if len(words.ends) else np.zeros(0, dtype=np.int64)
    longer = words.ends - words.starts > 1
    other = np.where(longer, fold[part.data[np.maximum(words.ends - 2, 0)]], 0) if len(words.ends) else last
    context = np.full(n, START, dtype=np.int64)
    context[place + 1] = (words.hashes >> np.uint64(17) << np.uint64(16)).astype(np.int64) | other * 256 + last
    return token, context, doc


def _part_of(token: np.ndarray, parts: int) -> np.ndarray:
    """Parts are ranges of hashes, so tokens in order have parts in order."""
    return (((token >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)).astype(np.int64)


def _range_of(context: np.ndarray, parts: int) -> np.ndarray:
    return _part_of(context.astype(np.uint64) << np.uint64(1), parts)


def _count(held: list, by_text: bool = True) -> tuple:
    """Different tokens and contexts in order; different (token number, context number, text) in order, and their counts.

    ``held`` has the token arrays of slices and is emptied; few arrays of its whole size are alive at a time.
    """
    (words, which), (contexts, at) = (_numbered(np.concatenate([x[i] for x in held])) for i in (0, 1))
    doc = np.concatenate([x[2] for x in held]) if by_text else np.zeros(len(at), dtype=np.int64)
    held.clear()
    docs = np.uint64(int(doc.max()) + 1 if len(doc) else 1)
    kinds = np.uint64(max(len(contexts), 1))
    keys = which.astype(np.uint64)
    for times, plus in ((kinds, at), (docs, doc)):
        keys *= times
        keys += plus.view(np.uint64) if plus.itemsize == 8 else plus.astype(np.uint64)
    del which, at, doc
    keys, counts = np.unique(keys, return_counts=True)
    pair = keys // docs
    return (words, contexts, (pair // kinds).astype(np.int64), (pair % kinds).astype(np.int64),
            (keys % docs).astype(np.int64), counts)


def _blocks(batch: pa.RecordBatch) -> Iterator[tuple[slice, list]]:
    """Runs of rows of about ``BLOCK_BYTES`` with the token arrays of their slices."""
    held, size, first = [], 0, 0
    for part in slices(batch.column("text"), SLICE_BYTES):
        token, context, doc = tokens(part)
        held.append((token, context, doc + part.rows.start - first))
        size += len(part.data)
        if size >= BLOCK_BYTES:
            yield slice(first, part.rows.stop), held
            held, size, first = [], 0, part.rows.stop
    if held:
        yield slice(first, batch.num_rows), held


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of ``BLOCK_BYTES`` at least, but for the last, of smaller ones."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= BLOCK_BYTES:
            whole, held, size = pa.concat_batches(held), [], 0
            yield whole
    if held:
        yield pa.concat_batches(held)


def _split(words, number, parts: int) -> Iterator[tuple[int, slice, slice]]:
    """Part, its words, and its rows of ``number`` (token numbers in order)."""
    part = _part_of(words, parts)
    for p, a, b in zip(*_runs(part)):
        yield int(p), slice(a, b), slice(*np.searchsorted(number, [a, b]))


def _runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if not len(x):
        return x, x, x
    starts = np.concatenate([[0], np.flatnonzero(np.diff(x)) + 1])
    return x[starts], starts, np.append(starts[1:], len(x))


def _small(x: np.ndarray) -> np.ndarray:
    return x.astype(np.min_scalar_type(int(x.max()) if len(x) else 0))


def _count_training(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _gathered(batches):
            for _, held in _blocks(batch):
                words, contexts, number, at, _, counts = _count(held, by_text=False)
                rows = []
                for p, w, r in _split(words, number, parts):
                    own, local = _numbered(at[r])
                    rows.append((p, _pack(_thin(words[w]), _thin(contexts[own]), _thin_pairs(number[r] - w.start, local), _small(counts[r]))))
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in rows], type=pa.int32()),
                                                  pa.array([x[1] for x in rows], type=pa.binary())], names=["part", "data"])
    return run


@dataclass
class Part:
    """Tokens and contexts in order; pairs of their numbers in order with their customers, and tables per sample."""

    words: np.ndarray
    contexts: np.ndarray
    number: np.ndarray
    at: np.ndarray
    customers: np.ndarray
    tables: list[tuple[np.ndarray, np.ndarray, np.ndarray]]  # of pairs, of (token, parent) pairs, of tokens

    @cached_property
    def parents(self) -> tuple[np.ndarray, np.ndarray]:
        """Different (token number * PARENTS + parent), and which of them each pair belongs to."""
        return _numbered(self.number * PARENTS + parent_of(self.contexts)[self.at])

    @cached_property
    def keys(self) -> np.ndarray:
        return self.number * len(self.contexts) + self.at

    @cached_property
    def seen(self) -> np.ndarray:
        """Training count of each token."""
        return np.bincount(self.number, self.customers, minlength=len(self.words)).astype(np.int64)

    @cached_property
    def inner(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """Per sample the customers of (token, parent) pairs, and of tokens in the root: tables of the level above."""
        pairs, which = self.parents
        return [(np.bincount(which, t2, minlength=len(pairs)).astype(np.int64),
                 np.bincount(pairs // PARENTS, t1, minlength=len(self.words)).astype(np.int64)) for t2, t1, _ in self.tables]

    def pack(self) -> bytes:
        return _pack(_thin(self.words), _thin(self.contexts), _thin_pairs(self.number, self.at), _small(self.customers),
                     [tuple(_small(t) for t in s) for s in self.tables])

    @staticmethod
    def unpack(data: bytes) -> "Part":
        words, contexts, pairs, customers, tables = _unpack(data)
        return Part(_full(words, np.uint64), _full(contexts), *_full_pairs(pairs), customers.astype(np.int64),
                    [tuple(t.astype(np.int64) for t in s) for s in tables])


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Add up the blocks of each part, which stand together; every dish has one table at first."""
    part, held, size = None, [], 0

    def merge():
        token, context, counts = (np.concatenate(x) for x in zip(*held))
        (words, which), (contexts, at) = _numbered(token), _numbered(context)
        keys, back = _numbered(which.astype(np.int64) * len(contexts) + at)
        total = np.bincount(back, counts).astype(np.int64)
        return words, contexts, keys // len(contexts), keys % len(contexts), total

    def done():
        here = Part(*merge(), [])
        here.tables = [tuple(np.ones(n, np.int64) for n in (len(here.number), len(here.parents[0]), len(here.words)))]
        return _state(part, here)

    for batch in batches:
        for p, data in zip(batch.column("part").to_pylist(), batch.column("data")):
            if part is not None and p != part:
                yield done()
                held, size = [], 0
            part = p
            words, contexts, pairs, counts = _unpack(data.as_py())
            number, at = _full_pairs(pairs)
            held.append((_full(words, np.uint64)[number], _full(contexts)[at], counts.astype(np.int64)))
            size += len(number)
            if size > MERGE_ROWS:
                words, contexts, number, at, counts = merge()
                held, size = [(words[number], contexts[at], counts)], 0
    if held:
        yield done()


STATE = "part INT, data BINARY, sums BINARY"


def _state(p: int, part: Part) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p], type=pa.int32()), pa.array([part.pack()], type=pa.binary()),
                                       pa.array([_pack(*_sums_of(part))], type=pa.binary())], names=["part", "data", "sums"])


def _sums_of(part: Part) -> list[np.ndarray]:
    """``level, context, customers, tables`` of the last sample; of all contexts only START and, as -1, their sum.

    Counts of counts are levels 3 to 5.
    """
    pairs, _ = part.parents
    t2, t1, t0 = part.tables[-1]
    c1, c0 = part.inner[-1]
    first = part.contexts[part.at] == START
    customers, tables = (np.bincount(pairs % PARENTS, x, minlength=PARENTS).astype(np.int64) for x in (c1, t1))
    parents = np.flatnonzero(customers)  # each has a customer for every table
    rows = [
        (2, START, part.customers[first].sum(), t2[first].sum()), (2, -1, part.customers.sum(), t2.sum()), (0, 0, c0.sum(), t0.sum()),
        *((level, k, (c == k).sum(), len(part.words)) for level, c in ((3, c0), (4, c1), (5, part.customers)) for k in (1, 2))]
    few = np.array(rows, dtype=np.int64).T
    return [np.concatenate(x) for x in zip(few, (np.ones(len(parents), dtype=np.int64), parents, customers[parents], tables[parents]))]


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for data in batch.column("sums"):
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in _unpack(data.as_py())], names=["level", "context", "customers", "tables"])


@dataclass
class Totals:
    """Customers and tables of the root, of each parent and of START; discounts; different tokens; tokens."""

    customers: list[np.ndarray]
    tables: list[np.ndarray]
    discounts: list[float]
    kinds: int
    tokens: int

    @staticmethod
    def of(parts: DataFrame, discounts: list[float] | None = None) -> "Totals":
        """Collects one row for each of the root, the parents and START."""
        rows = parts.select("sums").transform(map_arrow, _sums, "level BIGINT, context BIGINT, customers BIGINT, tables BIGINT").groupBy(
            "level", "context").agg(F.sum("customers").alias("c"), F.sum("tables").alias("t")).collect()
        sizes = (1, PARENTS, 1)
        customers, tables = ([np.zeros(n, dtype=np.int64) for n in sizes] for _ in range(2))
        ones, kinds, tokens = np.zeros((3, 3)), 0, 0
        for r in rows:
            if r["context"] == -1:
                tokens = r["c"]
            elif r["level"] < 3:
                customers[r["level"]][r["context"]], tables[r["level"]][r["context"]] = r["c"], r["t"]
            else:
                ones[r["level"] - 3, r["context"]] = r["c"]
                kinds = r["t"]
        if discounts is None:  # by the counts of ones and twos
            discounts = [min(0.95, max(0.05, n[1] / max(n[1] + 2 * n[2], 1.0))) for n in ones]
        return Totals(customers, tables, discounts, kinds, tokens)


LINK = "part INT, source INT, data BINARY"


def _links(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    part, source, data = zip(*rows) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(part, type=pa.int32()), pa.array(source, type=pa.int32()),
                                       pa.array(data, type=pa.binary())], names=["part", "source", "data"])


def _to_ranges(contexts: np.ndarray, values, source: int, parts: int) -> pa.RecordBatch:
    """Contexts in order, with their values if there are any, by range; ``source`` is the part that wants an answer."""
    cut = lambda a, b: None if values is None else [_small(v[a:b]) for v in values]
    return _links([(int(q), source, _pack(_thin(contexts[a:b]), cut(a, b))) for q, a, b in zip(*_runs(_range_of(contexts, parts)))])


def _seats(part: Part, seats: list[np.ndarray]) -> list[np.ndarray]:
    return [np.bincount(part.at, x, minlength=len(part.contexts)).astype(np.int64) for x in seats]


def _offer(parts: int):
    """Tables of each part's contexts in the last sample, to be answered."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p, data in zip(batch.column("part").to_pylist(), batch.column("data")):
                part = Part.unpack(data.as_py())
                yield _to_ranges(part.contexts, _seats(part, [part.tables[-1][0]]), p, parts)
    return run


def _ask(parts: int):
    """Customers and tables of each part's contexts in all samples, and the other contexts of its blocks, which stand behind it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, own, held, size = None, None, [], 0
        others = lambda: _to_ranges(np.unique(np.concatenate(held)), None, part, parts)
        for batch in batches:
            for p, kind, data, contexts in zip(batch.column("part").to_pylist(), batch.column("kind").to_pylist(),
                                               batch.column("data"), batch.column("contexts")):
                if part is not None and p != part:
                    if held:
                        yield others()
                    own, held, size = None, [], 0
                part = p
                if kind == 0:
                    continue
                if kind == 1:
                    here = Part.unpack(data.as_py())
                    own = here.contexts
                    yield _to_ranges(own, _seats(here, [here.customers, *(t2 for t2, _, _ in here.tables)]), p, parts)
                    continue
                asked = _full(_unpack(contexts.as_py())[0])
                if own is not None:
                    asked = asked[own[np.minimum(np.searchsorted(own, asked), len(own) - 1)] != asked]
                held.append(asked)
                size += len(asked)
                if size > MERGE_ROWS:
                    held = [np.unique(np.concatenate(held))]
                    size = len(held[0])
        if held:
            yield others()
    return run


def _answer(n_values: int):
    """Add up the values of each range, whose rows stand together, and send the sums to the parts that want them.

    A part that sent values has its contexts, and gets the range and the sums in the order of what it sent.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owner, held = None, []

        def answers():
            contexts, at = np.unique(np.concatenate([c for _, c, _ in held]), return_inverse=True)
            at = np.split(at, np.cumsum([len(c) for _, c, _ in held])[:-1])
            total = np.zeros((n_values, len(contexts)), dtype=np.int64)
            for (_, _, values), places in zip(held, at):
                for i, v in enumerate(values or ()):
                    total[i, places] += v  # a row has a context once
            for (source, own, values), places in zip(held, at):
                if source >= 0:
                    about = _thin(own) if values is None else owner
                    yield _links([(source, owner, _pack(about, [_small(t[places]) for t in total]))])

        for batch in batches:
            for q, source, data in zip(*(batch.column(c).to_pylist() for c in ("part", "source", "data"))):
                if owner is not None and q != owner:
                    yield from answers()
                    held = []
                owner = q
                contexts, values = _unpack(data)
                held.append((source, _full(contexts), values))
        if held:
            yield from answers()
    return run


def _answered(links: DataFrame, parts: int, n_values: int) -> DataFrame:
    return links.repartition(parts, "part").sortWithinPartitions("part", "source").transform(map_arrow, _answer(n_values), LINK).select(
        "part", "data")


class Guests:
    """Customers and tables of contexts, as the ranges answered; those of a part's ``own`` contexts come without their hashes."""

    def __init__(self, answers: list[bytes], own: np.ndarray = np.zeros(0, dtype=np.int64)):
        found = [_unpack(x) for x in answers]
        mine = sorted((x for x in found if isinstance(x[0], int)), key=lambda x: x[0])
        others = [x for x in found if not isinstance(x[0], int)]
        contexts = np.concatenate([own, *(_full(c) for c, _ in others)])
        values = [np.concatenate(v) for v in zip(*(v for _, v in mine + others))]
        if any(len(v) != len(contexts) for v in values):
            raise ValueError("a context came without its totals")
        order = np.argsort(contexts, kind="stable")
        self.contexts = contexts[order]
        self.values = [v[order].astype(np.int64) for v in values]

    def of(self, contexts: np.ndarray) -> list[np.ndarray]:
        at = np.searchsorted(self.contexts, contexts)
        if len(contexts) and (at.max() >= len(self.contexts) or (self.contexts[at] != contexts).any()):
            raise ValueError("a context came without its totals")
        return [v[at] for v in self.values]


def _belief(c, t, customers, tables, discount, strength, above):
    """Predictive probability of dishes with c customers at t tables in restaurants of the given sizes."""
    return (c - discount * t + (strength + discount * tables) * above) / (strength + customers)


def seat(customers: np.ndarray, pull: np.ndarray, discount: float, rng: np.random.Generator) -> np.ndarray:
    """Sample tables: ``pull`` is the weight of a new table, k - discount * t that of the old ones.

    The first ten customers of a dish are seated one by one, later ones in groups of a tenth of those seated.
    """
    tables = np.minimum(customers, 1)
    live, seated = np.flatnonzero(customers > 1), 1
    while len(live):
        group = max(1, seated // 10)
        size = np.minimum(group, customers[live] - seated)
        new = pull[live] / (pull[live] + seated - discount * tables[live])
        tables[live] += rng.binomial(size, np.clip(new, 0.0, 1.0))
        seated += group
        live = live[customers[live] > seated]
    return tables


def resample(part: Part, totals: Totals, m2: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tables of a part after one Gibbs sweep from the outer restaurants to the root; ``m2`` are tables of its contexts."""
    pairs, which = part.parents
    _, t1, t0 = part.tables[-1]
    token, parent = pairs // PARENTS, pairs % PARENTS
    c1, c0 = part.inner[-1]
    (n0, n1, _), (m0, m1, _), (d0, d1, d2) = totals.customers, totals.tables, totals.discounts
    base = 1.0 / (totals.kinds + 1)
    p0 = _belief(c0, t0, n0[0], m0[0], d0, STRENGTH[0], base)
    p1 = _belief(c1, t1, n1[parent], m1[parent], d1, STRENGTH[1], p0[token])
    new2 = seat(part.customers, (STRENGTH[2] + d2 * m2[part.at]) * p1[which], d2, rng)
    c1 = np.bincount(which, new2, minlength=len(pairs)).astype(np.int64)
    new1 = seat(c1, (STRENGTH[1] + d1 * m1[parent]) * p0[token], d1, rng)
    c0 = np.bincount(token, new1, minlength=len(part.words)).astype(np.int64)
    new0 = seat(c0, np.full(len(c0), (STRENGTH[0] + d0 * m0[0]) * base), d0, rng)
    return new2, new1, new0


def _sweep(totals: Totals, sweep: int, keep: bool):
    """The answers to a part stand before it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        answers = []
        for batch in batches:
            for p, kind, data in zip(batch.column("part").to_pylist(), batch.column("kind").to_pylist(), batch.column("data")):
                if kind == 0:
                    answers.append(_unpack(data.as_py()))
                    continue
                part = Part.unpack(data.as_py())
                m2 = np.concatenate([x[0] for _, x in sorted(answers, key=lambda a: a[0])]).astype(np.int64)
                if len(m2) != len(part.contexts):
                    raise ValueError("a context came without its tables")
                tables = resample(part, totals, m2, np.random.default_rng([SEED, sweep, p]))
                answers = []
                part.tables = [*part.tables, tables] if keep else [tables]
                del part.inner  # was made from the tables before
                yield _state(p, part)
    return run


@dataclass
class Model:
    """Parts of the model as a stored table, and the totals of the samples that are averaged."""

    parts: DataFrame
    count: int
    samples: list[Totals]


def _kind_1(parts: DataFrame) -> DataFrame:
    return parts.select("part", F.lit(1).alias("kind"), "data")


def fit(documents: DataFrame, burn_in: int = BURN_IN, samples: int = SAMPLES) -> Model:
    """Learn from the texts of ``documents``: all of their tokens. No documents give a model of the base alone."""
    size = documents.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = min(MAX_PARTS, max(8, -(-size // PART_BYTES)))
    blocks = documents.select("text").transform(map_arrow, _count_training(count), "part INT, data BINARY")
    store = rounds(documents.sparkSession)
    parts = store(blocks.repartition(count, "part").sortWithinPartitions("part").transform(map_arrow, _gather, STATE), "parts")
    totals = Totals.of(parts)
    kept = []
    for sweep in range(burn_in + samples):
        guests = _answered(parts.transform(map_arrow, _offer(count), LINK), count, 1).withColumn("kind", F.lit(0))
        both = guests.unionByName(_kind_1(parts)).repartition(count, "part").sortWithinPartitions("part", "kind")
        parts = store(both.transform(map_arrow, _sweep(totals, sweep, sweep > burn_in), STATE), "parts")
        totals = Totals.of(parts, totals.discounts)
        if sweep >= burn_in:
            kept.append(totals)
    return Model(parts, count, kept)


BLOCK = "part INT, kind INT, batch BINARY, data BINARY, contexts BINARY"


def _count_documents(parts: int):
    """Blocks of kind 2 per part, as kind 0 is its head, which gets the answers, and 1 the part itself; that of part 0 is there always and has the documents' ids and sizes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = pyspark.TaskContext.get().partitionId()
        turn = 0
        for batch in _gathered(batches):
            for rows, held in _blocks(batch):
                ids = batch.column("doc_id")[rows.start:rows.stop]
                sizes = sum(np.bincount(doc, minlength=len(ids)) for _, _, doc in held)
                words, contexts, number, at, doc, counts = _count(held)
                empty = np.zeros(0, dtype=np.int64)
                out = {0: (_thin(empty), (empty, empty), empty, empty)}
                own = {0: empty}
                for p, w, r in _split(words, number, parts):
                    some, local = _numbered(at[r])
                    out[p] = (_thin(words[w]), _thin_pairs(number[r] - w.start, local), _small(doc[r]), _small(counts[r]))
                    own[p] = contexts[some]
                name = b"%d/%d" % (task, turn)
                turn += 1
                about = lambda p: (len(ids), ids.to_pylist() if p == 0 else None, sizes if p == 0 else None)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(out), type=pa.int32()), pa.array([2] * len(out), type=pa.int32()),
                     pa.array([name] * len(out), type=pa.binary()),
                     pa.array([_pack(*about(p), *x) for p, x in out.items()], type=pa.binary()),
                     pa.array([_pack(_thin(own[p])) for p in out], type=pa.binary())],
                    names=["part", "kind", "batch", "data", "contexts"])
    return run


def log_probabilities(part: Part | None, samples: list[Totals], words, number, context,
                      guests: Guests | None = None, at=slice(None)) -> tuple[np.ndarray, np.ndarray]:
    """Averaged probability of each (token, context), and the training count of each token (not per pair).

    ``at`` are the rows' places in ``context``, which else has one for each row. Without ``guests`` the contexts, but for
    START, are taken as never seen.
    """
    base = 1.0 / (samples[0].kinds + 1)
    known = np.zeros(len(words), dtype=bool)
    seen = np.zeros(len(words), dtype=np.int64)
    at_word = np.zeros(len(words), dtype=np.int64)
    parent = parent_of(context)[at]
    if part is not None and len(part.words):
        at_word = np.minimum(np.searchsorted(part.words, words), len(part.words) - 1)
        known = part.words[at_word] == words
        pairs, _ = part.parents
        seen = np.where(known, part.seen[at_word], 0)
        at_context = np.minimum(np.searchsorted(part.contexts, context), len(part.contexts) - 1)
        has_context = part.contexts[at_context] == context
        ask = at_word[number] * len(part.contexts) + at_context[at]
        at2 = np.minimum(np.searchsorted(part.keys, ask), len(part.keys) - 1)
        has2 = known[number] & has_context[at] & (part.keys[at2] == ask)
        ask = at_word[number] * PARENTS + parent
        at1 = np.minimum(np.searchsorted(pairs, ask), len(pairs) - 1)
        has1 = known[number] & (pairs[at1] == ask)
    total = np.zeros(len(number))
    at_start = (context == START).astype(np.int64)
    n2, *m2s = (x[at] for x in (guests.of(context) if guests else (
        x * at_start for x in (samples[0].customers[2], *(s.tables[2] for s in samples)))))
    for i, (s, m2) in enumerate(zip(samples, m2s)):
        (n0, n1, _), (m0, m1, _), (d0, d1, d2) = s.customers, s.tables, s.discounts
        if part is not None and len(part.words):
            t2, t1, t0 = part.tables[i]
            c1, c0 = part.inner[i]
            pick = lambda x, at, has: np.where(has, x[at], 0)
            p0 = _belief(pick(c0, at_word, known), pick(t0, at_word, known), n0[0], m0[0], d0, STRENGTH[0], base)[number]
            p1 = _belief(pick(c1, at1, has1), pick(t1, at1, has1), n1[parent], m1[parent], d1, STRENGTH[1], p0)
            total += _belief(pick(part.customers, at2, has2), pick(t2, at2, has2), n2, m2, d2, STRENGTH[2], p1)
        else:
            p0 = _belief(0, 0, n0[0], m0[0], d0, STRENGTH[0], base)
            p1 = _belief(0, 0, n1[parent], m1[parent], d1, STRENGTH[1], p0)
            total += _belief(0, 0, n2, m2, d2, STRENGTH[2], p1)
    return total / len(samples), seen


def _score_blocks(samples: list[Totals]):
    """For each block the sums of its documents; the blocks of a part stand behind the part, this behind the answers to it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, owner, answers, guests = None, None, None, None
        scale = math.log10(samples[0].tokens + 0.1 * (samples[0].kinds + 1))
        for batch in batches:
            out = []
            for p, kind, name, data, contexts, found in zip(
                    *(batch.column(c) for c in ("part", "kind", "batch", "data", "contexts", "answers"))):
                if owner != p.as_py():
                    part, owner, answers, guests = None, p.as_py(), None, None  # perhaps no training token lies in this part
                if kind.as_py() == 0:
                    answers = found.as_py()
                    continue
                if kind.as_py() == 1:
                    part = Part.unpack(data.as_py())
                    continue
                if answers:
                    guests, answers = Guests(answers, *([] if part is None else [part.contexts])), None
                docs, ids, sizes, words, pairs, doc, counts = _unpack(data.as_py())
                number, at = _full_pairs(pairs)
                doc, counts = doc.astype(np.int64), counts.astype(np.int64)
                chance, seen = log_probabilities(
                    part, samples, _full(words, np.uint64), number, _full(_unpack(contexts.as_py())[0]), guests, at)
                sums = [np.bincount(doc, w, minlength=docs) for w in (
                    counts * np.log10(chance), counts * (np.log10(seen + 0.1) - scale)[number], counts * (seen > 0)[number])]
                out.append((name.as_py(), 0 if ids is not None else 1, _pack(ids, sizes, *sums)))
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[0] for x in out], type=pa.binary()), pa.array([x[1] for x in out], type=pa.int32()),
                 pa.array([x[2] for x in out], type=pa.binary())], names=["batch", "kind", "data"])
    return run


SCORED = "doc_id BIGINT, n_tokens BIGINT, n_known BIGINT, base_score DOUBLE, score DOUBLE"


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of each batch; its sums stand behind the list of its documents."""
    name = None

    def rows():
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, type=pa.int64()), pa.array(sizes.astype(np.int64)), pa.array(np.rint(known).astype(np.int64)),
             pa.array(base), pa.array(score)], names=["doc_id", "n_tokens", "n_known", "base_score", "score"])

    for batch in batches:
        for own, kind, data in zip(*(batch.column(c).to_pylist() for c in ("batch", "kind", "data"))):
            if own != name:
                if name is not None:
                    yield rows()
                if kind != 0:
                    raise ValueError("a batch came without its documents")
                name = own
                ids, sizes, score, base, known = _unpack(data)
            else:
                if kind == 0:
                    raise ValueError("two batches have one name")
                _, _, a, b, c = _unpack(data)
                score, base, known = score + a, base + b, known + c
    if name is not None:
        yield rows()


def score(documents: DataFrame, model: Model) -> DataFrame:
    """``doc_id, n_tokens, n_known, base_score, score``: one row per row of ``documents``, log10 of probabilities.

    ``n_known`` are tokens that occur in the training text; ``base_score`` is that of smoothed single tokens.
    NULL and empty texts have the token that ends them. Rows with equal ids are rows of their own.
    """
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    nothing = F.lit(None).cast("binary")
    blocks = docs.transform(map_arrow, _count_documents(model.count), BLOCK)
    known = _kind_1(model.parts).select("part", "kind", F.lit(b"").alias("batch"), "data", nothing.alias("contexts"))
    heads = documents.sparkSession.range(model.count).select(
        F.col("id").cast("int").alias("part"), F.lit(0).alias("kind"), F.lit(b"").alias("batch"), nothing.alias("data"), nothing.alias("contexts"))
    # Both readers of these rows name all of their columns, so documents are counted and sent to the parts once.
    both = blocks.union(known).union(heads).repartition(model.count, "part")
    links = both.sortWithinPartitions("part", "kind").transform(map_arrow, _ask(model.count), LINK)
    answers = _answered(links, model.count, 1 + len(model.samples)).repartition(model.count, "part").groupBy("part").agg(
        F.collect_list("data").alias("answers")).withColumnRenamed("part", "asker")
    rows = both.join(answers.hint("shuffle_hash"), (both["part"] == answers["asker"]) & (both["kind"] == 0), "left").drop("asker")
    sums = rows.sortWithinPartitions("part", "kind", "batch").transform(
        map_arrow, _score_blocks(model.samples), "batch BINARY, kind INT, data BINARY")
    return sums.repartition("batch").sortWithinPartitions("batch", "kind").transform(map_arrow, _add_up, SCORED)


def held_out(doc_id: str = "doc_id"):
    """Whether a document is kept from training; one without an id is."""
    return crc_fold(F.col(doc_id), FOLDS) == 0
