"""Whitening of vectors by an incremental eigendecomposition.

Each partition keeps the mean of its rows and the eigendecomposition of their scatter.  A batch is centred on its own
mean and, where it has more rows than dimensions, condensed by an orthogonal triangularisation to one row per
dimension with the same scatter.  Every remaining row, and the difference of the means, is a centred rank-one update:
the secular equation gives the new eigenvalues, all at once, between the old ones; entries that change nothing and
equal eigenvalues are deflated first; eigenvectors come from the update that has exactly the computed eigenvalues
(Loewner's formula), so they stay orthogonal.  Two partitions combine in the same way: the eigenvectors of one, scaled
by the roots of their eigenvalues, are rank-one updates of the other.  Partitions combine in a tree of ``FAN``; a state
has the size of a matrix of dimensions, whatever the number of rows.

The result is a basis that is right but for the rounding of many updates.  Rayleigh-Ritz refinement removes that: a
pass over all rows multiplies the exact covariance with the basis, the small projected matrix is solved, and the basis
is multiplied again until the residuals of the wanted components vanish (at once where the basis spans everything).

Defined results: rows whose vector is null, empty, or holds null or non-finite entries, or entries of more than 2**30 in
size, are dropped; so are rows whose vector has not the commonest length (of equally common ones the longest).
Components whose variance is zero but for rounding cannot be whitened and are left out; so a single row, or equal
rows, and an empty table give an empty table.  Repeated rows and null ids are rows of their own.  ``deviation`` is
null where it is beyond a long.  Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ardoise.llm.common import release, to_spark
from ardoise.sources.workdir import materialise

SCALE, SHIFT, COMPONENTS = 1024, 100_000, 8
#: States that are combined by one task.
FAN = 16
#: Ritz vectors at most.
RITZ = 128
#: Rows that are condensed together.
ROWS = 8192
EPS = np.finfo(float).eps
#: A variance below this share of the largest is zero.
ZERO = 1e-12


def secular_roots(d: np.ndarray, z2: np.ndarray, rho: float) -> np.ndarray:
    """``d[j] - root[i]`` for the roots of 1 + rho * sum(z2 / (d - x)), one above each rising pole ``d``.

    Each root is found as its distance from the nearer pole, so the differences keep their relative precision.  The
    equation is replaced by one with a pole on either side and the same value and slopes; a step that leaves the
    bracket halves it instead.
    """
    n = len(d)
    if n == 1:
        return np.array([[-rho * z2[0]]])
    upper = np.append(d[1:], d[-1] + rho * z2.sum())
    gap = upper - d
    below = np.tri(n, dtype=bool)
    middle = 1 + rho * (z2 / (d[None, :] - (d + gap / 2)[:, None])).sum(1)
    # Nearer to the upper pole when the function is still negative half way.
    near = (middle < 0) & (np.arange(n) < n - 1)
    origin = np.where(near, upper, d)
    poles = d[None, :] - origin[:, None]
    first, second = d - origin, upper - origin
    low, high = np.where(middle < 0, first + gap / 2, first), np.where(middle < 0, second, first + gap / 2)
    x = (low + high) / 2
    for _ in range(100):
        delta = poles - x[:, None]
        part = rho * z2 / delta
        value = 1 + part.sum(1)
        slope = part / delta
        left = np.where(below, slope, 0).sum(1)
        right = slope.sum(1) - left
        low, high = np.where(value < 0, x, low), np.where(value < 0, high, x)
        d1, d2 = first - x, second - x
        a = (d1 + d2) * value - d1 * d2 * (left + right)
        b = d1 * d2 * value
        c = value - d1 * left - d2 * right
        root = np.sqrt(np.maximum(a * a - 4 * b * c, 0))
        with np.errstate(divide="ignore", invalid="ignore"):
            step = np.where(a <= 0, (a - root) / (2 * c), 2 * b / (a + root))
        new = x + step
        new = np.where((new > low) & (new < high), new, (low + high) / 2)
        # As near as the function's rounding can tell.
        done = (np.abs(value) <= n * EPS * (1 + np.abs(part).sum(1))) | (np.abs(new - x) <= 4 * EPS * np.abs(x))
        x = np.where(done, x, new)
        if done.all():
            break
    return poles - x[:, None]


def rank_one(values: np.ndarray, vectors: np.ndarray, update: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (rising) and eigenvectors (columns) of ``vectors diag(values) vectors' + update update'``."""
    z = vectors.T @ update
    rho = float(z @ z)
    if rho == 0:
        return values, vectors
    z = z / np.sqrt(rho)
    tol = 8 * EPS * max(np.abs(values).max(), rho)
    values, vectors = values.copy(), vectors.copy()
    # Deflation: entries that change nothing, and of equal eigenvalues all but one, by rotation.
    live: list[int] = []
    for j in np.flatnonzero(rho * np.abs(z) > tol).tolist():
        if live and values[j] - values[live[-1]] <= tol:
            i = live.pop()
            r = np.hypot(z[i], z[j])
            c, s = z[j] / r, z[i] / r
            z[i], z[j] = 0.0, r
            a, b = vectors[:, i].copy(), vectors[:, j].copy()
            vectors[:, i], vectors[:, j] = c * a - s * b, s * a + c * b
        live.append(j)
    if not live:
        return values, vectors
    d, w = values[live], z[live]
    delta = secular_roots(d, w * w, rho)
    # The update that has exactly these roots.
    apart = d[:, None] - d[None, :]
    np.fill_diagonal(apart, 1.0)
    ratio = -delta / apart
    own = np.diag(-delta).copy()
    np.fill_diagonal(ratio, 1.0)
    exact = np.sqrt(np.maximum(ratio.prod(0) * own / rho, 0)) * np.where(w < 0, -1.0, 1.0)
    u = exact[None, :] / delta
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    values[live] = d - np.diag(delta)
    vectors[:, live] = vectors[:, live] @ u.T
    order = np.argsort(values, kind="stable")
    return values[order], vectors[:, order]


@dataclass
class Spectrum:
    """Number and mean of some rows and the eigendecomposition of their scatter."""

    n: int
    mean: np.ndarray
    values: np.ndarray
    vectors: np.ndarray

    @staticmethod
    def empty(size: int) -> Spectrum:
        return Spectrum(0, np.zeros(size), np.zeros(size), np.eye(size))

    def _shifted(self, n: int, mean: np.ndarray) -> np.ndarray:
        """Take further rows into number and mean; the update that their mean's distance makes."""
        apart, total = mean - self.mean, self.n + n
        update = apart * np.sqrt(self.n / total * n)
        self.mean = self.mean + apart * (n / total)
        self.n = total
        return update

    def _update(self, update: np.ndarray) -> None:
        self.values, self.vectors = rank_one(self.values, self.vectors, update)

    def add_rows(self, x: np.ndarray) -> None:
        """Centred rank-one updates for some rows, condensed to one per dimension."""
        mean = x.mean(0)
        centred = x - mean
        if len(x) > x.shape[1]:
            centred = np.linalg.qr(centred, mode="r")
        for row in (*centred, self._shifted(len(x), mean)):
            self._update(row)

    def add(self, other: Spectrum) -> None:
        """Another state, one rank-one update per eigenvector."""
        if not other.n:
            return
        if other.n > self.n:
            mine = Spectrum(self.n, self.mean, self.values, self.vectors)
            self.n, self.mean, self.values, self.vectors = other.n, other.mean, other.values, other.vectors
            other = mine
            if not other.n:
                return
        rows = (other.vectors * np.sqrt(np.maximum(other.values, 0))).T
        for row in (*rows[::-1], self._shifted(other.n, other.mean)):
            self._update(row)


STATE = pa.schema([("part", pa.int64()), ("n", pa.int64()), ("numbers", pa.list_(pa.float64()))])


def whole_numbers(batch: pa.RecordBatch, size: int) -> np.ndarray:
    """The vectors of a batch as whole numbers."""
    flat = batch["v"].flatten().to_numpy(zero_copy_only=False)
    return np.floor(SCALE * flat).astype(np.int64).reshape(-1, size) + SHIFT


def _state(part: int, n: int, numbers: np.ndarray) -> pa.RecordBatch:
    columns = [pa.array([part]), pa.array([n]), pa.array([numbers], STATE.field("numbers").type)]
    return pa.RecordBatch.from_arrays(columns, schema=STATE)


def fold(states: DataFrame, merge: Callable[[Iterator[tuple[int, np.ndarray]]], tuple[int, np.ndarray]]) -> tuple[int, np.ndarray]:
    """Combine the states of all partitions in a tree; the last one is the only one the driver sees."""

    def combine(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[tuple[int, np.ndarray]]:
            for batch in batches:
                lists = batch["numbers"]
                for k in range(batch.num_rows):
                    yield batch["n"][k].as_py(), lists[k].values.to_numpy(zero_copy_only=False)

        yield _state(key[0].as_py(), *merge(each()))

    while True:
        states = materialise(states, "states")
        count, most = states.agg(F.count(F.lit(1)), F.max("part")).first()
        if count <= 1:
            break
        # A later stage has fewer parts than partitions: their numbers close up by themselves.
        states = states.withColumn("part", F.floor(F.col("part") / FAN)).groupBy("part").applyInArrow(combine, to_spark(STATE))
    row = states.first()
    return (0, np.zeros(0)) if row is None else (row.n, np.array(row.numbers))


def _per_partition(f: Callable[[Iterator[pa.RecordBatch]], tuple[int, np.ndarray] | None]) -> Callable:
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = f(batch for batch in it if batch.num_rows)
        if out is not None:
            yield _state(TaskContext.get().partitionId(), *out)
        release()

    return run


def _pack(s: Spectrum) -> tuple[int, np.ndarray]:
    return s.n, np.concatenate([s.mean, s.values, s.vectors.ravel()])


def _unpack(n: int, numbers: np.ndarray, size: int) -> Spectrum:
    return Spectrum(n, numbers[:size], numbers[size : 2 * size], numbers[2 * size :].reshape(size, size))


def incremental(vectors: DataFrame, size: int) -> Spectrum:
    """The spectrum of all rows: updates within partitions, states combined in a tree."""

    def part(it: Iterator[pa.RecordBatch]) -> tuple[int, np.ndarray] | None:
        s = Spectrum.empty(size)
        for batch in it:
            x = whole_numbers(batch, size).astype(float)
            for k in range(0, len(x), ROWS):
                s.add_rows(x[k : k + ROWS])
        return _pack(s) if s.n else None

    def merge(states: Iterator[tuple[int, np.ndarray]]) -> tuple[int, np.ndarray]:
        s = Spectrum.empty(size)
        for n, numbers in states:
            s.add(_unpack(n, numbers, size))
        return _pack(s)

    return _unpack(*fold(vectors.mapInArrow(_per_partition(part), to_spark(STATE)), merge), size)


def _summed(states: Iterator[tuple[int, np.ndarray]]) -> tuple[int, np.ndarray]:
    n, total = next(states)
    total = total.copy()
    for m, numbers in states:
        n, total = n + m, total + numbers
    return n, total


def sums(vectors: DataFrame, f: Callable[[pa.RecordBatch], np.ndarray]) -> tuple[int, np.ndarray]:
    """Number of rows and the sum of ``f`` over all batches."""

    def part(it: Iterator[pa.RecordBatch]) -> tuple[int, np.ndarray] | None:
        n, total = 0, None
        for batch in it:
            more = f(batch).ravel()
            n, total = n + batch.num_rows, more if total is None else total + more
        return None if total is None else (n, total)

    return fold(vectors.mapInArrow(_per_partition(part), to_spark(STATE)), _summed)


@dataclass
class Centre:
    """Number and exact sums of the rows."""

    n: int
    sums: list[int]

    def apart(self, x: np.ndarray) -> np.ndarray:
        """n * x - S exactly: as long, or as objects where a long may not do."""
        top = max(int(np.abs(x).max(initial=0)) * self.n, *map(abs, self.sums))
        if top < 1 << 62:
            return x * self.n - np.array(self.sums)
        return x.astype(object) * self.n - np.array(self.sums, object)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return self.apart(x).astype(float) / self.n

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Sum of the squares of n * x - S, exactly; None beyond a long."""
        apart = self.apart(x)
        most = float(np.abs(apart).max(initial=0))
        if most * most * x.shape[1] < 2.0**62:
            return (apart.astype(np.int64) ** 2).sum(1).tolist()
        return [v if v < 1 << 63 else None for v in (apart.astype(object) ** 2).sum(1).tolist()]


@dataclass
class Whitening:
    """Components by falling variance; ``vectors`` has one column each."""

    size: int
    centre: Centre
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    def apply(self, x: np.ndarray) -> np.ndarray:
        return self.centre.centred(x) @ self.vectors / np.sqrt(self.values)


def usable(embeddings: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, v) of the rows whose vector has only finite numbers."""
    rows = embeddings.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    fine = F.forall("v", lambda c: F.coalesce(F.abs(c) <= F.lit(float(1 << 30)), F.lit(False)))
    return rows.where(F.col("v").isNotNull() & (F.size("v") > 0) & fine)


def commonest_size(rows: DataFrame) -> int | None:
    row = rows.groupBy(F.size("v").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    return None if row is None else row["size"]


def fit(rows: DataFrame, size: int, components: int = COMPONENTS, rounds: int = 100) -> Whitening | None:
    """Fit on all rows (id, v); None if nothing varies."""
    start = incremental(rows, size)
    # Exact sums: two halves of the number, each a sum of doubles below 2**53.
    low = 1 << 24

    def halves(batch: pa.RecordBatch) -> np.ndarray:
        x = whole_numbers(batch, size)
        return np.concatenate([(x // low).sum(0), (x % low).sum(0)]).astype(float)

    n, numbers = sums(rows, halves)
    centre = Centre(n, [int(h) * low + int(r) for h, r in zip(numbers[:size], numbers[size:])])
    basis = start.vectors[:, ::-1][:, : min(size, RITZ)]
    wanted = min(components, basis.shape[1])
    for _ in range(rounds):
        q = np.linalg.qr(basis)[0]

        def times(batch: pa.RecordBatch, q: np.ndarray = q) -> np.ndarray:
            x = centre.centred(whole_numbers(batch, size))
            return np.concatenate([(x.T @ (x @ q)).ravel(), [(x * x).sum()]])

        numbers = sums(rows, times)[1]
        product, trace = numbers[:-1].reshape(size, -1) / n, float(numbers[-1]) / n
        if trace <= 0:
            return None
        small = q.T @ product
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        vectors = q @ turn
        basis = product @ turn
        rest = np.linalg.norm(basis - vectors * values, axis=0)[:wanted].max()
        if q.shape[1] == size or rest <= 1e-14 * values[0]:
            break
    keep = int((values[:wanted] > ZERO * values[0]).sum())
    vectors = vectors[:, :keep]
    vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(0), np.arange(keep)])
    return Whitening(size, centre, values[:keep], vectors, trace)


WHITE = pa.schema(
    [("vec_id", pa.int64()), ("component", pa.int32()), ("n", pa.int64()), ("deviation", pa.int64()),
     ("whitened", pa.float64()), ("explained", pa.float64()), ("identity_error", pa.float64())]
)


def whiten(embeddings: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """Per row and component: exact deviation, whitened coordinate, share of the variance, and how far the whitened
    rows' covariance is from the identity."""
    rows = usable(embeddings, key, vector)
    size = commonest_size(rows)
    nothing = rows.sparkSession.createDataFrame([], to_spark(WHITE))
    if size is None:
        return nothing
    rows = rows.where(F.size("v") == size)
    model = fit(rows, size, components)
    if model is None:
        return nothing
    k = len(model.values)

    def moments(batch: pa.RecordBatch) -> np.ndarray:
        w = model.apply(whole_numbers(batch, size))
        return np.concatenate([(w.T @ w).ravel(), w.sum(0)])

    n, numbers = sums(rows, moments)
    mean = numbers[k * k :] / n
    error = float(np.abs(numbers[: k * k].reshape(k, k) / n - np.outer(mean, mean) - np.eye(k)).max())
    explained = model.values / model.trace

    def out(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            if not batch.num_rows:
                continue
            x = whole_numbers(batch, size)
            rows_, far = batch.num_rows, pa.array(model.centre.deviation(x), pa.int64())
            which = np.repeat(np.arange(rows_), k)
            columns = [
                batch["id"].take(pa.array(which)), np.tile(np.arange(1, k + 1, dtype=np.int32), rows_), np.full(rows_ * k, n),
                far.take(pa.array(which)), model.apply(x).ravel(), np.tile(explained, rows_), np.full(rows_ * k, error),
            ]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=WHITE)
        release()

    return rows.mapInArrow(out, to_spark(WHITE))
