"""Logistic regression on token counts whose coefficients never stand in one place.

The objective is that of Spark ML: mean log loss plus an L2 penalty on the coefficients of standardized, centred
features, minimized by L-BFGS (ten corrections, strong Wolfe line search) from zero coefficients. All that L-BFGS
visits are sums of gradients, which are ``X'R`` with the residuals ``R`` of some iterate. So the driver has the few
weights of these sums, training rows their margins ``X X'R`` per gradient, and scalar products are sums over rows.
Tokens are dealt out to parts by their hash and rows to blocks; a part's cells compute its share of the margins.
"""

import math
import pickle
import sys
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyspark
from pyspark import StorageLevel, cloudpickle
from pyspark.sql import DataFrame, functions as F

from triarm.sources.scratch import new_path, file_system, stored

# Send the small functions below with the task, as executors may not have the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

TRAIN, EXTRA, TEST = ROLES = ("train", "extra", "test")
BLOCK_ROWS = 4096
PART_BYTES = 96 << 20  # text whose tokens make one part
MIN_PARTS = 6
STATS = -1  # stands for a block: the sums of a part's tokens
CORRECTIONS, TOLERANCE, VALUES = 10, 1e-6, 20
# A part's cells and residuals are joined by part and block where they are, dealt out by part alone.
BY_PART = ("spark.sql.requireAllClusterKeysForCoPartition", "false")
CELLS = "part INT, block BIGINT, data BINARY"
BLOCKS = "block BIGINT, kind INT, data BINARY"


def _pack(*arrays) -> bytes:
    raw = pickle.dumps(arrays, protocol=5)
    return len(raw).to_bytes(8, "big") + pa.compress(raw, codec="zstd", asbytes=True)


def _unpack(data: bytes) -> tuple:
    return pickle.loads(pa.decompress(data[8:], decompressed_size=int.from_bytes(data[:8], "big"), codec="zstd", asbytes=True))


def _small(x: np.ndarray) -> np.ndarray:
    return x.astype(np.min_scalar_type(int(x.max()) if len(x) else 0))


def _rows(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"INT": pa.int32(), "BIGINT": pa.int64(), "BINARY": pa.binary(), "DOUBLE": pa.float64()}
    names, types = zip(*(c.split() for c in schema.split(", ")))
    columns = list(zip(*rows)) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, type=kinds[t]) for c, t in zip(columns, types)], names=list(names))


def _each(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(n).to_pylist() for n in names))


def _cut(parts: int):
    """Cells of each block of rows by part, with the part's words; as part -1 the block's labels."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = pyspark.TaskContext.get().partitionId() << 32
        for batch in batches:
            for begin in range(0, batch.num_rows, BLOCK_ROWS):
                rows = batch.slice(begin, BLOCK_ROWS)
                words = rows.column("words")
                if words.null_count:
                    raise ValueError("a text is NULL")
                label = rows.column("label").to_numpy(zero_copy_only=False).astype(float)
                role = rows.column("role").to_numpy()
                if np.isnan(label[role == 0]).any():
                    raise ValueError("a label of a training row is NULL")
                coded = words.flatten().dictionary_encode()
                names = coded.dictionary.to_pylist()
                row = np.repeat(np.arange(len(rows)), pc.list_value_length(words).to_numpy())
                keys, counts = np.unique(row * max(len(names), 1) + coded.indices.to_numpy(), return_counts=True)
                row, code = np.divmod(keys, max(len(names), 1))
                owner = np.array([zlib.crc32(w.encode()) % parts for w in names], dtype=np.int64)
                within = np.zeros(len(rows), dtype=np.int64)
                for r in range(len(ROLES)):
                    within[role == r] = np.arange((role == r).sum())
                order = np.argsort(owner[code], kind="stable")
                row, code, counts, home = row[order], code[order], counts[order], owner[code][order]
                out = [(-1, block, _pack(label[role == 0], label[role == 2], int((role == 1).sum())))]
                for p in np.unique(home):
                    here = slice(*np.searchsorted(home, [p, p + 1]))
                    own, local = np.unique(code[here], return_inverse=True)
                    of, at, tf = role[row[here]], within[row[here]], counts[here]
                    seen = [_small(np.bincount(local[of == r], minlength=len(own))) for r in range(len(ROLES))]
                    cells = [tuple(_small(x[of == r]) for x in (local, at, tf)) for r in (0, 2)]
                    out.append((int(p), block, _pack([names[i] for i in own], seen, cells)))
                block += 1
                yield _rows(CELLS, out)
    return run


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number the words of each part, whose blocks stand together; behind them the sums of its words."""
    part, ids, sums = None, {}, np.zeros((5, 0))

    def stats():
        return _rows(CELLS, [(part, STATS, _pack(sums[:, :len(ids)]))])

    for p, block, data in _each(batches, "part", "block", "data"):
        if part is not None and p != part:
            yield stats()
            ids, sums = {}, np.zeros((5, 0))
        part = p
        names, seen, cells = _unpack(data)
        number = np.array([ids.setdefault(w, len(ids)) for w in names], dtype=np.int64)
        if len(ids) > sums.shape[1]:
            sums = np.concatenate([sums, np.zeros((5, max(len(ids), 2 * sums.shape[1]) - sums.shape[1]))], axis=1)
        local, _, tf = cells[0]
        tf = tf.astype(float)
        sums[:, number] += [*seen, *(np.bincount(local, w, minlength=len(names)) for w in (tf, tf * tf))]
        yield _rows(CELLS, [(p, block, _pack(_small(number), *cells))])
    if part is not None:
        yield stats()


def _scale(sums: np.ndarray, n_train: int, ignored: tuple[int, int] | None) -> np.ndarray:
    """One over the variance of each token; 0 if it does not vary or its weight is 0.

    ``ignored`` are a role and its rows: tokens of all of them have an inverse document frequency of 0.
    """
    spread = np.maximum(sums[4] - sums[3] ** 2 / n_train, 0.0) / max(n_train - 1, 1)
    out = np.divide(1.0, spread, out=np.zeros(len(spread)), where=spread > 0)
    if ignored is not None:
        out[sums[ignored[0]] == ignored[1]] = 0.0
    return out


def _margins(n_train: int, ignored: tuple[int, int] | None, which: int, classes: int):
    """Each part's share of ``X X'R``, for training rows (``which`` 0) or test rows (1), as kind 1."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, scale, sums = None, [], None, None

        def shares():
            by_token = sums * scale[:, None]
            for block, number, (local, at, tf) in held:
                if len(at):
                    own, tf = by_token[number], tf.astype(float)
                    share = [np.bincount(at, tf * own[local, k]) for k in range(classes)]
                    yield _rows(BLOCKS, [(block, 1, _pack(np.stack(share, axis=1)))])

        for p, block, data, residual in _each(batches, "part", "block", "data", "residual"):
            if p != part:
                if part is not None:
                    yield from shares()
                if block != STATS:
                    raise ValueError("a part came without its sums")
                scale = _scale(_unpack(data)[0], n_train, ignored)
                part, held, sums = p, [], np.zeros((len(scale), classes))
                continue
            number, *cells = _unpack(data)
            number = number.astype(np.int64)
            rows, (local, at, tf) = _unpack(residual)[0], cells[0]
            if len(at):
                tf = tf.astype(float)
                for k in range(classes):
                    sums[number, k] += np.bincount(local, tf * rows[at, k], minlength=len(number))
            held.append((block, number, cells[which]))
        if part is not None:
            yield from shares()
    return run


@dataclass
class Point:
    """A sum of gradients without their penalties, by weight, and the intercepts."""

    weights: np.ndarray
    intercepts: np.ndarray

    def plus(self, other: "Point", times: float) -> "Point":
        return Point(self.weights + times * other.weights, self.intercepts + times * other.intercepts)

    def times(self, x: float) -> "Point":
        return Point(self.weights * x, self.intercepts * x)


def _combine(margins: list[np.ndarray], means: list[np.ndarray], point: Point, rows: int) -> np.ndarray:
    out = np.zeros((rows, len(point.intercepts)))
    for w, m, mean in zip(point.weights, margins, means):
        if w:
            out += w * (m - mean)
    return out


def _residuals(scores: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probabilities less outcomes, and the log loss of each row; one column is the log odds of class 1."""
    if scores.shape[1] == 1:
        m = scores[:, 0]
        return (0.5 * (1 + np.tanh(m / 2)) - labels)[:, None], np.logaddexp(0.0, m) - labels * m
    shifted = scores - scores.max(axis=1, keepdims=True) if len(scores) else scores
    exps = np.exp(shifted)
    total = exps.sum(axis=1)
    each = np.arange(len(scores)), labels.astype(np.int64)
    loss = np.log(total) - shifted[each]
    out = exps / total[:, None]
    out[each] -= 1.0
    return out, loss


@dataclass
class Problem:
    """What the driver knows: rows as a stored table of blocks, and numbers whose count grows with the steps only."""

    cells: DataFrame
    parts: int
    rows: DataFrame
    n_train: int
    classes: int
    penalty: float
    ignored: tuple[int, int] | None
    means: list[np.ndarray] = field(default_factory=list)  # of each gradient's margins
    products: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    spent: list[str] = field(default_factory=list)

    def _sum(self, row_sums) -> np.ndarray:
        """Sums over blocks of what ``row_sums(labels, margins)`` gives."""
        def run(batches):
            for (data,) in _each(batches, "data"):
                labels, _, margins = _unpack(data)
                yield _rows("k INT, v DOUBLE", list(enumerate(float(x) for x in row_sums(labels, margins))))
        out = self.rows.mapInArrow(run, "k INT, v DOUBLE").groupBy("k").agg(F.sum("v").alias("v")).collect()
        return np.array([r["v"] for r in sorted(out, key=lambda r: r["k"])])

    def dot(self, a: Point, b: Point) -> float:
        return float(a.weights @ self.products @ b.weights + a.intercepts @ b.intercepts)

    def along(self, point: Point, direction: Point, t: float) -> tuple[float, float, np.ndarray]:
        """Value and slope at ``point + t * direction``, and the sums of the residuals there."""
        n, means, at = self.n_train, self.means, point.plus(direction, t)

        def row_sums(labels, margins):
            residual, loss = _residuals(_combine(margins, means, at, len(labels)) + at.intercepts, labels)
            towards = _combine(margins, means, direction, len(labels))
            return [loss.sum(), (residual * towards).sum(), *residual.sum(axis=0)]

        loss, slope, *residual = self._sum(row_sums)
        residual = np.array(residual)
        flat = lambda x: Point(x.weights, np.zeros(self.classes))
        value = loss / n + self.penalty / 2 * self.dot(flat(at), flat(at))
        return value, (slope + residual @ direction.intercepts) / n + self.penalty * self.dot(flat(at), flat(direction)), residual

    def _spread(self, residuals: DataFrame, which: int) -> DataFrame:
        """Shares of the margins of ``residuals``, one row per block."""
        everywhere = residuals.select(F.explode(F.sequence(F.lit(0), F.lit(self.parts - 1))).alias("part"), "block",
                                      F.col("data").alias("residual")).repartition(self.parts, "part")
        return self.cells.join(everywhere, ["part", "block"], "left").sortWithinPartitions("part", "block").mapInArrow(
            _margins(self.n_train, self.ignored, which, self.classes), BLOCKS)

    def add_gradient(self, point: Point, residual: np.ndarray) -> None:
        """Margins of the residuals at ``point``, whose sums are ``residual``, go to the rows."""
        means, middle, n = self.means, residual / self.n_train, self.n_train

        def at_point(labels, margins):
            return _residuals(_combine(margins, means, point, len(labels)) + point.intercepts, labels)[0] - middle

        def residuals(batches):
            for block, data in _each(batches, "block", "data"):
                labels, _, margins = _unpack(data)
                yield _rows(BLOCKS, [(block, 0, _pack(at_point(labels, margins)))])

        def append(batches):
            for block, (labels, others, margins), share in _added(batches, self_classes, 0):
                yield _rows(BLOCKS, [(block, 0, _pack(labels, others, [*margins, share]))])

        self_classes = self.classes
        shares = self._spread(self.rows.mapInArrow(residuals, BLOCKS), 0)
        both = self.rows.union(shares).repartition("block").sortWithinPartitions("block", "kind")
        path = new_path(self.rows.sparkSession, "rows")
        both.mapInArrow(append, BLOCKS).write.parquet(path)
        # The rows before are of no use any more.
        for old in self.spent:
            file_system(self.rows.sparkSession, old).remove(old)
        self.spent, self.rows = [path], self.rows.sparkSession.read.schema(self.rows.schema).parquet(path)

        def row_sums(labels, margins):
            return [*margins[-1].sum(axis=0), *((at_point(labels, margins[:-1]) * m).sum() for m in margins)]

        sums = self._sum(row_sums)
        self.means = [*means, sums[:self.classes] / n]
        # Residuals sum to 0 here, so it is all the same whether margins are centred.
        new = sums[self.classes:]
        self.products = np.block([[self.products, new[:-1, None]], [new[None, :]]])


def _added(batches: Iterator[pa.RecordBatch], classes: int, which: int) -> Iterator[tuple]:
    """Blocks with the sum of their shares, which stand behind them; ``which`` labels the shares are for."""
    block, content, total = None, None, None
    for b, kind, data in _each(batches, "block", "kind", "data"):
        if kind == 0:
            if block is not None:
                yield block, content, total
            block, content = b, _unpack(data)
            total = np.zeros((len(content[which]), classes))
        else:
            if b != block:
                raise ValueError("a share came without its block")
            share = _unpack(data)[0]
            total[:len(share)] += share
    if block is not None:
        yield block, content, total


class NoStep(Exception):
    """The line search has failed."""


def _cubic(left: tuple, right: tuple) -> float:
    (t0, f0, s0), (t1, f1, s1) = left, right
    d1 = s0 + s1 - 3 * (f0 - f1) / (t0 - t1)
    d2 = math.sqrt(max(d1 * d1 - s0 * s1, 0.0))
    t = t1 - (t1 - t0) * (s1 + d2 - d1) / (s1 - s0 + 2 * d2)
    return min(max(t, t0 + 0.1 * (t1 - t0)), t0 + 0.9 * (t1 - t0))


def _step(phi, start: tuple, first: float, c1: float = 1e-4, c2: float = 0.9, tries: int = 10) -> float:
    """Step that meets the strong Wolfe conditions; ``phi(t)`` is value and slope, ``start`` those at 0."""
    _, value, slope = low = (0.0, *start)
    if slope > 0:
        raise NoStep

    def zoom(low, high):
        for _ in range(tries):
            t = _cubic(*sorted([low, high], key=lambda x: x[0]))
            here = (t, *phi(t))
            if here[1] > value + c1 * t * slope or here[1] >= low[1]:
                high = here
            else:
                if abs(here[2]) <= c2 * abs(slope):
                    return t
                if here[2] * (high[0] - low[0]) >= 0:
                    high = low
                low = here
        raise NoStep

    t = first
    for i in range(tries):
        here = (t, *phi(t))
        if not math.isfinite(here[1]):
            t /= 2
            continue
        if here[1] > value + c1 * t * slope or (here[1] >= low[1] and i > 0):
            return zoom(low, here)
        if abs(here[2]) <= c2 * abs(slope):
            return t
        if here[2] >= 0:
            return zoom(here, low)
        low, t = here, t * 1.5
    raise NoStep


def _descent(problem: Problem, gradient: Point, history: list[tuple[Point, Point]]) -> Point:
    """Direction by the latest steps and changes of the gradient, newest first."""
    out, factors = gradient, []
    for step, change in history:
        rho = problem.dot(step, change)
        factors.append((problem.dot(step, out) / rho, rho))
        out = out.plus(change, -factors[-1][0])
    if history:
        out = out.times(factors[0][1] / problem.dot(history[0][1], history[0][1]))
    for (step, change), (a, rho) in reversed(list(zip(history, factors))):
        out = out.plus(step, a - problem.dot(change, out) / rho)
    return out.times(-1.0)


def _longer(x: Point) -> Point:
    return Point(np.append(x.weights, 0.0), x.intercepts)


def minimize(problem: Problem, intercepts: np.ndarray, max_iter: int) -> tuple[list[tuple[Point, np.ndarray]], Point, list[float]]:
    """Points whose gradients were added with the sums of their residuals, the last point, and the values on the way."""
    none = Point(np.zeros(0), np.zeros(problem.classes))
    x = Point(np.zeros(0), intercepts)
    value, _, residual = problem.along(x, none, 0.0)
    visited, history, values, failed = [], [], [value], False
    gradient = None
    for iteration in range(max_iter):
        if gradient is None or len(visited) < iteration + 1:
            problem.add_gradient(x, residual)
            visited.append((x, residual))
            x = _longer(x)
            history = [(_longer(a), _longer(b)) for a, b in history]
            weights = problem.penalty * x.weights
            weights[-1] += 1 / problem.n_train
            new = Point(weights, residual / problem.n_train)
            if gradient is not None:
                before = _longer(gradient)
                history = [(x.plus(_longer(last), -1.0), new.plus(before, -1.0)), *history][:CORRECTIONS]
            gradient = new
            size = math.sqrt(max(problem.dot(gradient, gradient), 0.0))
            if size <= max(TOLERANCE * value, 1e-8) or (
                    len(values) > 1 and abs(value - max(values[-VALUES - 1:-1])) <= TOLERANCE * abs(values[0])):
                break
        while True:
            direction = _descent(problem, gradient, history)
            seen = {}

            def phi(t):
                seen[t] = problem.along(x, direction, t)
                return seen[t][:2]

            try:
                length = math.sqrt(max(problem.dot(direction, direction), 1e-300))
                t = _step(phi, (value, problem.dot(gradient, direction)), 1.0 if history or iteration else 1.0 / length)
                if t * size < 1e-10:
                    raise NoStep
                break
            except NoStep:  # once more without the history
                if failed:
                    return visited, x, values
                failed, history = True, []
        failed = False
        value, _, residual = seen[t]
        last, x = x, x.plus(direction, t)
        values.append(value)
    return visited, x, values


def predictions(problem: Problem, visited: list[tuple[Point, np.ndarray]], x: Point) -> DataFrame:
    """``label, pred`` of the test rows."""
    means, classes, n = problem.means, problem.classes, problem.n_train

    def weighted(batches):
        for block, data in _each(batches, "block", "data"):
            labels, _, margins = _unpack(data)
            out = np.zeros((len(labels), classes))
            for w, (point, sums) in zip(x.weights, visited):
                out += w * (_residuals(_combine(margins, means, point, len(labels)) + point.intercepts, labels)[0] - sums / n)
            yield _rows(BLOCKS, [(block, 0, _pack(out))])

    offset = x.intercepts - sum((w * m for w, m in zip(x.weights, means)), np.zeros(classes))

    def score(batches):
        for _, (_, labels, _), total in _added(batches, classes, 1):
            total = total + offset
            best = (total[:, 0] > 0) if classes == 1 else total.argmax(axis=1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(labels, from_pandas=True, type=pa.float64()), pa.array(best.astype(float))], names=["label", "pred"])

    shares = problem._spread(problem.rows.mapInArrow(weighted, BLOCKS), 1)
    both = problem.rows.union(shares).repartition("block").sortWithinPartitions("block", "kind")
    return both.mapInArrow(score, "label DOUBLE, pred DOUBLE")


def arms_of(words: DataFrame, max_iter: int, penalty: float) -> dict[str, DataFrame]:
    """``label, pred`` of the test rows by arm, from ``label, role`` (a number in ``ROLES``), ``words, n_bytes``.

    Standardizing a feature undoes any weight of its token but zero. So an arm's inverse document frequencies take
    from the features the tokens that are in all of its rows, and arms that lose none have one fit in common.
    """
    size = words.agg(F.sum("n_bytes")).first()[0] or 0
    parts = max(MIN_PARTS, -(-size // PART_BYTES))
    blocks = stored(words.select("label", "role", "words").mapInArrow(_cut(parts), CELLS), "blocks")
    cells = blocks.where("part >= 0").repartition(parts, "part").sortWithinPartitions("part", "block").mapInArrow(_number, CELLS)
    cells = stored(cells, "cells").repartition(parts, "part").sortWithinPartitions("part", "block").persist(StorageLevel.DISK_ONLY)

    def headers(batches):
        for block, data in _each(batches, "block", "data"):
            labels, others, _ = _unpack(data)
            yield _rows(BLOCKS, [(block, 0, _pack(labels, others, []))])

    def count(batches):
        for (data,) in _each(batches, "data"):
            labels, others, extra = _unpack(data)
            kinds, n = np.unique(labels, return_counts=True)
            yield _rows("k INT, v DOUBLE", [(-2, float(extra)), (-3, float(len(others))), *((int(k), float(c)) for k, c in zip(kinds, n))])

    heads = blocks.where("part < 0")
    rows = stored(heads.mapInArrow(headers, BLOCKS), "rows")
    counts = {r["k"]: int(r["v"]) for r in heads.mapInArrow(count, "k INT, v DOUBLE").groupBy("k").agg(F.sum("v").alias("v")).collect()}
    n_of = {EXTRA: counts.pop(-2, 0), TEST: counts.pop(-3, 0)}
    if not counts:
        raise ValueError("there are no training rows")
    n_train = sum(counts.values())
    histogram = [counts.get(k, 0) for k in range(max(counts) + 1)]

    def everywhere(batches):
        for (data,) in _each(batches, "data"):
            sums = _unpack(data)[0]
            lost = lambda arm: float(((sums[0] > 0) & (sums[ROLES.index(arm)] == n_of[arm])).sum())
            yield _rows("k INT, v DOUBLE", [(ROLES.index(arm), lost(arm)) for arm in n_of])

    lost = {r["k"]: r["v"] for r in cells.where(F.col("block") == STATS).mapInArrow(everywhere, "k INT, v DOUBLE").groupBy("k").agg(
        F.sum("v").alias("v")).collect()}
    out, fits, conf = {}, {}, words.sparkSession.conf
    before = conf.get(BY_PART[0], None)
    conf.set(*BY_PART)
    try:
        for arm in ("base", EXTRA, TEST):
            ignored = (ROLES.index(arm), n_of[arm]) if arm != "base" and lost.get(ROLES.index(arm)) else None
            if arm != "base" and not n_of[arm]:
                raise ValueError(f"there are no rows to weigh the tokens of arm {arm}")
            if ignored not in fits:
                if len(counts) == 1:  # one class only
                    label = float(max(counts))
                    fits[ignored] = _constant(rows, label)
                else:
                    binary = len(histogram) == 2
                    start = np.log1p(np.array(histogram, dtype=float))
                    start = np.array([math.log(histogram[1] / histogram[0])]) if binary else start - start.mean()
                    problem = Problem(cells, parts, rows, n_train, len(start), penalty, ignored)
                    visited, x, _ = minimize(problem, start, max_iter)
                    fits[ignored] = stored(predictions(problem, visited, x), "predictions")
            out[arm] = fits[ignored]
    finally:
        cells.unpersist()
        conf.unset(BY_PART[0]) if before is None else conf.set(BY_PART[0], before)
    return out


def _constant(rows: DataFrame, label: float) -> DataFrame:
    def run(batches):
        for (data,) in _each(batches, "data"):
            others = _unpack(data)[1]
            yield pa.RecordBatch.from_arrays([pa.array(others, from_pandas=True, type=pa.float64()), pa.array(np.full(len(others), label))],
                                             names=["label", "pred"])
    return rows.mapInArrow(run, "label DOUBLE, pred DOUBLE")
