"""Many weighted logistic regressions on the same rows at once: a pass over the rows serves all of them.

Spark ML makes one pass for each step of each fit and caches the rows once per fit, so a search over folds and
parameters reads and holds them dozens of times.  Here the rows lie in blocks, cached once; a task adds up the losses
and gradients of all models that are still moving, and the driver, which holds coefficients only, takes their next steps.

The loss, the penalty, the greatest number of steps and the tolerance are those of ``models.logistic``: the optimum is
the same, and steps are taken along scaled columns too (limited memory, for l1 kept to one orthant).
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Generator, Iterator, Mapping, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Numbers in a block of rows.
CELLS = 1 << 17
#: Steps that a model remembers, and values over which it must still fall.
MEMORY, WINDOW = 10, 20


def row_blocks(rows: DataFrame, label: str, width: int) -> DataFrame:
    """``rows`` (label, fold, features) as blocks: features, folds and labels of some rows in one cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if any(c.null_count for c in batch.columns):
                raise ValueError("a row without label, fold or features")
            x = batch["x"].flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, width)
            y, fold = batch["y"].to_numpy(), batch["fold"].to_numpy()
            if not np.isin(y, (0.0, 1.0)).all():
                raise ValueError("labels must be 0 or 1")
            step = max(1, CELLS // width)
            cut = [slice(i, i + step) for i in range(0, len(y), step)]
            made = [x[s].tobytes() + fold[s].astype(np.int32).tobytes() + y[s].astype(np.int8).tobytes() for s in cut]
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary())], names=["block"])

    cells = rows.select(F.col(label).cast("double").alias("y"), "fold", vector_to_array("features").alias("x"))
    return cells.mapInArrow(run, "block binary")


def _rows_of(block: pa.Scalar, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    data = block.as_buffer()
    n = data.size // (8 * width + 5)
    x = np.frombuffer(data, np.float64, n * width).reshape(n, width)
    return x, np.frombuffer(data, np.int32, n, 8 * n * width), np.frombuffer(data, np.int8, n, 8 * n * width + 4 * n)


def _summed(blocks: DataFrame, width: int, part: Callable[..., np.ndarray]) -> np.ndarray:
    """Sum over all blocks of what ``part`` makes of their features, folds and labels; an array per task travels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for block in batch["block"]:
                made = part(*_rows_of(block, width))
                total = made if total is None else total + made
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["total"])

    rows = blocks.mapInArrow(run, "total binary").toArrow()["total"]
    return reduce(np.add, [np.frombuffer(r.as_buffer()) for r in rows])


def descent(start: np.ndarray, l1: np.ndarray, max_iter: int, tol: float) -> Generator[np.ndarray, tuple[float, np.ndarray], np.ndarray]:
    """Smallest value of a smooth convex function plus ``l1`` times absolute values: yields points, is sent the smooth
    part's value and gradient there, and returns the last point.  Steps by limited memory; where a coordinate has a
    penalty, a step does not cross zero in it."""
    x, bent = start, l1 > 0
    smooth, g = yield x
    value = smooth + l1 @ np.abs(x)
    first, values, steps = value, deque([value], WINDOW), deque(maxlen=MEMORY)
    for _ in range(max_iter):
        # Slope of the steepest way down: at zero the penalty holds a coordinate whose slope is smaller.
        side = np.where(x != 0, np.sign(x), -np.sign(g))
        pull = np.where((x == 0) & (np.abs(g) <= l1), 0.0, g + l1 * side)
        if np.linalg.norm(pull) <= max(tol * abs(value), 1e-8):
            break
        way, past = pull.copy(), []
        for s, d in reversed(steps):
            past.append((s @ way) / (s @ d))
            way -= past[-1] * d
        if steps:
            s, d = steps[-1]
            way *= (s @ d) / (d @ d)
        for (s, d), a in zip(steps, reversed(past)):
            way += (a - (d @ way) / (s @ d)) * s
        way = -way
        way[bent & (way * pull >= 0)] = 0.0
        if way @ pull >= 0:
            steps.clear()
            way = -pull
        length = 1.0 if steps else 1.0 / np.linalg.norm(way)
        orthant = np.where(x != 0, np.sign(x), np.sign(-pull))
        for _ in range(40):
            there = x + length * way
            there[bent & (np.sign(there) != orthant)] = 0.0
            smooth, slope = yield there
            lower = smooth + l1 @ np.abs(there)
            if lower <= value + 1e-4 * (pull @ (there - x)):
                break
            length /= 2
        else:
            break
        s, d = there - x, slope - g
        if s @ d > 1e-12 * (d @ d):
            steps.append((s, d))
        x, g, value = there, slope, lower
        if len(values) == WINDOW and max(values) - value <= tol * abs(first):
            break
        values.append(value)
    return x


def fit_folds(blocks: DataFrame, width: int, counts: Mapping[int, Mapping[int, int]], todo: Sequence[tuple[int, dict]],
              max_iter: int = 100, tol: float = 1e-6) -> np.ndarray:
    """Coefficients of each (fold, parameters) of ``todo``, one column each, the intercept last: fitted on the rows of
    all other folds, with balanced weights from ``counts`` (rows by class and fold)."""
    n = np.array([[sum(k for g, k in counts[c].items() if g != f) for f, _ in todo] for c in (0, 1)], float)
    total = n.sum(0)
    heavy = total / (2 * n)
    strength = np.array([1.0 / (p.get("C", 1.0) * t) for (_, p), t in zip(todo, total)])
    lasso = np.array([p.get("penalty", "l2") == "l1" for _, p in todo])
    folds = np.array([f for f, _ in todo])

    # Columns are centred and scaled for the steps only; the penalty is on the coefficients of the columns as they are.
    moments = _summed(blocks, width, lambda x, fold, y: np.concatenate([x.sum(0), [len(y)]]))
    mean = moments[:-1] / moments[-1]
    spread = np.sqrt(_summed(blocks, width, lambda x, fold, y: ((x - mean) ** 2).sum(0)) / moments[-1])
    # A column without spread has no coefficient.
    scale = np.divide(1.0, spread, out=np.zeros(width), where=spread > 0)

    def own(point: np.ndarray) -> np.ndarray:
        """The point in terms of the columns as they are."""
        w = point[:-1] * scale
        return np.append(w, point[-1] - mean @ w)

    moving = [descent(np.zeros(width + 1), np.append(strength[m] * scale, 0.0) if lasso[m] else np.zeros(width + 1), max_iter, tol)
              for m in range(len(todo))]
    points, done = {m: next(d) for m, d in enumerate(moving)}, {}
    while points:
        at = list(points)
        sides, weights, left_out = np.stack([own(points[m]) for m in at], 1), heavy[:, at], folds[at]

        def part(x, fold, y):
            sign = np.where(y == 1, 1.0, -1.0)[:, None]
            z = (x @ sides[:-1] + sides[-1]) * sign
            small = np.exp(-np.abs(z))
            w = weights[y] * (fold[:, None] != left_out)
            loss = w * (np.maximum(-z, 0.0) + np.log1p(small))
            pull = -sign * w * np.where(z > 0, small, 1.0) / (1.0 + small)
            return np.concatenate([loss.sum(0), (x.T @ pull).ravel(), pull.sum(0)])

        made = _summed(blocks, width, part).reshape(width + 2, len(at))
        for j, m in enumerate(at):
            loss, slopes, free = made[0, j] / total[m], made[1:-1, j] / total[m], made[-1, j] / total[m]
            slopes = (slopes - mean * free) * scale
            if not lasso[m]:
                w = points[m][:-1] * scale
                loss, slopes = loss + strength[m] / 2 * (w @ w), slopes + strength[m] * w * scale
            try:
                points[m] = moving[m].send((loss, np.append(slopes, free)))
            except StopIteration as end:
                done[m] = own(end.value)
                del points[m]
    return np.stack([done[m] for m in range(len(todo))], 1)


def held_out_scores(blocks: DataFrame, width: int, todo: Sequence[tuple[int, int]], fitted: np.ndarray, label: str) -> DataFrame:
    """(label, fold, params_id, proba) of every row by each model fitted without its fold; ``todo`` names the models."""
    folds, names = (np.array(x) for x in zip(*todo))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in batch["block"]:
                x, fold, y = _rows_of(block, width)
                row, model = np.nonzero(fold[:, None] == folds)
                p = 1.0 / (1.0 + np.exp(-np.clip(x @ fitted[:-1] + fitted[-1], -700.0, 700.0)))
                cells = [y[row].astype(np.int32), fold[row], names[model].astype(np.int32), p[row, model]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cells], names=[label, "fold", "params_id", "proba"])

    return blocks.mapInArrow(run, f"`{label}` int, fold int, params_id int, proba double")


def cached(blocks: DataFrame) -> DataFrame:
    return blocks.persist(StorageLevel.MEMORY_AND_DISK)
