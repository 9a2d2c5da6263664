"""Quality classifier: ordinal regression on graded ratings with hashed text.

A cumulative-link model: the log-odds that the grade of a text is at least k are ``w.x - t_k``, with one weight
vector ``w`` for all k and ordered thresholds ``t_k``.  ``x`` holds which words occur (hashed) and the shares
of word shapes (runs of small letters, capitals and digits become one sign each, so ``(ab9)`` has the shape
``(a9)``, hashed too).  Features enter the model when at least ``SEEN`` rated texts have them and the grades of
those differ from all grades by more than some standard errors: the number of ``APARTS`` under which texts that
were left out of the fit are likeliest.  The same texts give the probability from which a text is kept, the
highest one that keeps ``KEPT`` of those of the highest grade.

The model is fitted by one task on at most ``RATED`` rated texts, chosen by a hash of the key; features of the
rated texts and the scores of all rows are made where the rows lie, without a shuffle.

Defined results: a null or empty text has no features and gets the probabilities of the thresholds alone.
Repeated rows are scored alike; a text that is rated several times has its lowest grade.  Ratings with a null
grade or key are left out; ratings without two different grades give no model: probability 1 and keep, grade
null.  An empty table gives an empty table.  Whole texts are read; only the named columns are.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ardoise.llm.common import release, texts, to_spark
from ardoise.sources.workdir import materialise

#: Rated texts that the model is fitted on, at most (about; a hash chooses them).
RATED = 20_000
WORDS, SHAPES = 1 << 17, 1 << 12
SEEN, APARTS = 3, (2.5, 2.0, 3.0, 4.0, 5.0)
#: Parts of the rated texts that are left out in turn, until so many have been left out.
FOLDS, HELD = 4, 2_000
ROUNDS, BATCH, RATE, PENALTY = 40, 64, 0.3, 1e-3
#: Value of a word that occurs, and of a shape that all words have.
OCCURS, SHARE = 1.0, 16.0
#: A text is kept when it has the highest grade with at least the probability that keeps this share of held-out
#: texts of that grade; with fewer than 100 such texts the share cannot be told, and ``SURE`` is taken.
KEPT, SURE = 0.99, 0.5
#: Remembered words of a worker process; all are forgotten beyond it, to bound the memory.
REMEMBERED = 300_000

LETTERS = re.compile(r"[^\W\d_]+")
RUNS = [(re.compile(r"[a-zß-öø-ÿ]+"), "a"), (re.compile(r"[A-ZÀ-ÖØ-Þ]+"), "A"), (re.compile(r"[0-9]+"), "9")]


def grade(quality: str = "quality", toxic: str = "toxic") -> Column:
    """0: poor; 1: well-formed but toxic; 2: good."""
    return F.when(F.col(quality) == 0, 0).when((F.col(quality) == 1) & (F.col(toxic) == 1), 1).when(F.col(quality) == 1, 2)


def word_features(word: str) -> tuple[int, int]:
    """Numbers of the word and of its shape."""
    core = "".join(LETTERS.findall(word)).lower()
    for run, sign in RUNS:
        word = run.sub(sign, word)
    return zlib.crc32(core.encode()) % WORDS, WORDS + zlib.crc32(word.encode()) % SHAPES


class _Codes(dict):
    """Both numbers of a word in one, remembered; numbers without a weight become 0."""

    def __init__(self, slot: np.ndarray | None = None):
        super().__init__()
        self.slot = slot

    def __missing__(self, word: str) -> int:
        a, b = word_features(word)
        if self.slot is not None:
            a, b = int(self.slot[a]), int(self.slot[b])
        self[word] = code = a << 20 | b
        return code

    def of(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Words that occur, shapes, and the shapes' shares."""
        if len(self) > REMEMBERED:
            self.clear()
        words = text.split()
        codes = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        shapes, times = np.unique(codes & 0xFFFFF, return_counts=True)
        return np.unique(codes >> 20), shapes, times / max(1, len(words))


def _odds(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit_ordinal(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, top: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered thresholds of the likeliest model, found by scaled gradient steps.

    ``rows``: feature numbers and values of each text; ``y``: grades from 0 to ``top``.
    """
    w, scale = np.zeros(size), np.full(size, 1e-2)
    share = np.clip([(y >= k).mean() for k in range(1, top + 1)], 1e-3, 1 - 1e-3)
    t, t_scale = -np.log(share / (1 - share)), np.full(top, 1e-2)
    rng = np.random.default_rng(7)
    for _ in range(ROUNDS):
        order = rng.permutation(len(rows))
        for at in range(0, len(rows), BATCH):
            part = order[at : at + BATCH]
            index = np.concatenate([rows[i][0] for i in part])
            value = np.concatenate([rows[i][1] for i in part])
            row = np.repeat(np.arange(len(part)), [len(rows[i][0]) for i in part])
            margin = np.bincount(row, w[index] * value, len(part))
            # tail[k] is the probability of a grade of at least k; the grade's own lies between two tails.
            tail = np.ones((len(part), top + 2))
            tail[:, 1:-1], tail[:, -1] = _odds(margin[:, None] - t), 0
            slope, each, own = tail * (1 - tail), np.arange(len(part)), y[part]
            p = np.maximum(tail[each, own] - tail[each, own + 1], 1e-9)
            g = np.bincount(index, ((slope[each, own + 1] - slope[each, own]) / p)[row] * value, size)
            used = np.unique(index)
            step = g[used] / len(part) + PENALTY * w[used]
            scale[used] += step**2
            w[used] -= RATE * step / np.sqrt(scale[used])
            k = np.arange(1, top + 1)
            t_step = np.where(own[:, None] == k, slope[:, 1:-1] / p[:, None], 0) - np.where(own[:, None] == k - 1, slope[:, 1:-1] / p[:, None], 0)
            t_step = t_step.mean(0)
            t_scale += t_step**2
            t = np.maximum.accumulate(t - RATE * t_step / np.sqrt(t_scale))
    return w, t


def telling(rows: list[np.ndarray], y: np.ndarray, top: int, least: float) -> np.ndarray:
    """Which features enter the model."""
    size = WORDS + SHAPES
    index, length = np.concatenate(rows), [len(r) for r in rows]
    seen, apart = np.bincount(index, minlength=size), np.zeros(size)
    for k in range(1, top + 1):
        high = (y >= k).astype(float)
        p = high.mean()
        hits = np.bincount(index, np.repeat(high, length), size)
        apart = np.maximum(apart, np.abs(hits - seen * p) / np.sqrt(seen * p * (1 - p) + 1))
    return np.flatnonzero((seen >= SEEN) & (apart > least))


Rows = list[tuple[np.ndarray, np.ndarray]]


def fit_telling(rows: Rows, y: np.ndarray, top: int, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The features that enter, their weights, and the thresholds."""
    chosen = telling([i for i, _ in rows], y, top, least)
    slot = np.full(WORDS + SHAPES, -1)
    slot[chosen] = np.arange(len(chosen))
    kept = [slot[i] >= 0 for i, _ in rows]
    w, t = fit_ordinal([(slot[i][k], v[k].astype(float)) for (i, v), k in zip(rows, kept)], y, top, max(1, len(chosen)))
    return chosen, w[: len(chosen)], t


def calibrate(rows: Rows, y: np.ndarray, top: int) -> tuple[float, float]:
    """Standard errors for features to enter, and the probability to keep a text, from texts left out of the fit."""
    if (y == top).sum() < 100:
        return APARTS[0], SURE
    fold = np.random.default_rng(8).permutation(len(rows)) % FOLDS
    folds = min(FOLDS, -(-HELD * FOLDS // len(rows)))
    held = np.concatenate([np.flatnonzero(fold == f) for f in range(folds)])
    own, best = y[held], (-np.inf, APARTS[0], SURE)
    for least in APARTS:
        tails = []
        for f in range(folds):
            fitted = np.flatnonzero(fold != f)
            chosen, w, t = fit_telling([rows[i] for i in fitted], y[fitted], top, least)
            weight = np.zeros(WORDS + SHAPES)
            weight[chosen] = w
            margin = np.array([weight[rows[i][0]] @ rows[i][1] for i in np.flatnonzero(fold == f)])
            tails.append(_odds(margin[:, None] - t))
        tail = np.ones((len(held), top + 2))
        tail[:, 1:-1], tail[:, -1] = np.concatenate(tails), 0
        each = np.arange(len(held))
        likely = np.log(np.maximum(tail[each, own] - tail[each, own + 1], 1e-9)).mean()
        if likely > best[0]:
            best = likely, least, float(np.quantile(tail[own == top, -2], 1 - KEPT, method="lower"))
    return best[1:]


RATED_ROWS = pa.schema([("id", pa.int64()), ("y", pa.int32()), ("index", pa.list_(pa.int32())), ("value", pa.list_(pa.float32()))])
MODEL = pa.schema([("index", pa.list_(pa.int32())), ("weight", pa.list_(pa.float64())), ("thresholds", pa.list_(pa.float64())), ("sure", pa.float64())])
SCORES = pa.schema([("id", pa.int64()), ("expected_grade", pa.float64()), ("p_top", pa.float64()), ("keep", pa.bool_())])


def _rated(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    codes = _Codes()
    for batch in it:
        found = [codes.of(x.as_py()) for x in batch["text"]]
        index = [np.concatenate([a, b]).astype(np.int32) for a, b, _ in found]
        value = [np.concatenate([np.full(len(a), OCCURS), SHARE * s]).astype(np.float32) for a, _, s in found]
        yield pa.RecordBatch.from_arrays(
            [batch["id"], batch["y"], pa.array(index, RATED_ROWS.field("index").type), pa.array(value, RATED_ROWS.field("value").type)],
            schema=RATED_ROWS,
        )


def _fit(top: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for batch in it:
            rows += zip(batch["id"].to_pylist(), batch["y"].to_pylist(), batch["index"], batch["value"])
        if not rows:
            return
        rows.sort(key=lambda r: r[:2])
        y = np.array([r[1] for r in rows])
        found = [(r[2].values.to_numpy(), r[3].values.to_numpy()) for r in rows]
        least, sure = calibrate(found, y, top)
        chosen, w, t = fit_telling(found, y, top, least)
        yield pa.RecordBatch.from_pydict({"index": [chosen], "weight": [w], "thresholds": [t], "sure": [sure]}, schema=MODEL)

    return run


@dataclass
class Grader:
    """A fitted model; without thresholds everything is kept."""

    grades: list[int]
    index: np.ndarray
    weight: np.ndarray
    thresholds: np.ndarray
    sure: float = SURE

    def _tails(self):
        """A function from texts to the probabilities of reaching each threshold."""
        slot = np.zeros(WORDS + SHAPES, np.int64)
        slot[self.index] = np.arange(1, len(self.index) + 1)
        weight, thresholds = np.concatenate([[0.0], self.weight]), self.thresholds

        def tails(codes: _Codes, many: Iterable[str]) -> np.ndarray:
            found = [codes.of(x) for x in many]
            margin = np.array([OCCURS * weight[a].sum() + SHARE * (weight[b] @ s) for a, b, s in found])
            return _odds(margin[:, None] - thresholds)

        return slot, tails

    def score(self, df: DataFrame, key: str = "doc_id", text: str = "text", sure: float | None = None) -> DataFrame:
        """``key``, expected grade, probability of the highest grade, and whether the text is kept."""
        (slot, tails), grades, fitted = self._tails(), np.array(self.grades, float), len(self.thresholds) > 0
        sure = self.sure if sure is None else sure

        def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            codes = _Codes(slot)
            for batch in it:
                if fitted:
                    p = tails(codes, (x.as_py() for x in batch["text"])) if batch.num_rows else np.zeros((0, len(grades) - 1))
                    expected, top = pa.array(grades[0] + p @ np.diff(grades)), p[:, -1]
                else:
                    expected, top = pa.nulls(batch.num_rows, pa.float64()), np.ones(batch.num_rows)
                yield pa.RecordBatch.from_arrays([batch["id"], expected, pa.array(top), pa.array(top >= sure)], schema=SCORES)

        rows = texts(df, key, text).select(F.col("id").cast("long"), "text")
        return rows.mapInArrow(run, to_spark(SCORES)).withColumnRenamed("id", key)

    def keeps(self, text: Column, sure: float | None = None) -> Column:
        """Whether a text is kept, as a condition on the rows where they lie."""
        slot, tails = self._tails()
        sure = self.sure if sure is None else sure
        if not len(self.thresholds):
            return F.lit(True)

        @F.pandas_udf("boolean")
        def kept(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            codes = _Codes(slot)
            for part in parts:
                yield pd.Series(tails(codes, part)[:, -1] >= sure if len(part) else [], dtype=bool)
            codes.clear()
            release()

        return kept(F.coalesce(text, F.lit("")))


def fit_grader(
    df: DataFrame, ratings: DataFrame, key: str = "doc_id", text: str = "text", grade: str = "grade", rated: int = RATED
) -> Grader:
    """Fit on the rows of ``df`` that ``ratings`` (``key``, ``grade``) has."""
    none = Grader([], np.zeros(0, int), np.zeros(0), np.zeros(0))
    known = ratings.where(F.col(key).isNotNull() & F.col(grade).isNotNull())
    known = known.groupBy(F.col(key).alias("id")).agg(F.min(F.col(grade).cast("int")).alias("grade"))
    found = known.groupBy("grade").count().collect()  # a row per grade
    grades, n = sorted(r["grade"] for r in found), sum(r["count"] for r in found)
    if len(grades) < 2:
        return none
    if n > rated:
        known = known.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < int((1 << 20) * rated / n))
    place = F.array_position(F.array([F.lit(g) for g in grades]), F.col("grade")) - 1
    # The rated rows are bounded by ``rated``, whatever the table's size.
    sample = texts(df, key, text).join(F.broadcast(known), "id").select(F.col("id").cast("long"), place.cast("int").alias("y"), "text")
    rows = materialise(sample.mapInArrow(_rated, to_spark(RATED_ROWS)), "rated")
    made = rows.coalesce(1).mapInArrow(_fit(len(grades) - 1), to_spark(MODEL)).collect()
    if not made:
        return none
    return Grader(grades, np.array(made[0]["index"], int), np.array(made[0]["weight"], float), np.array(made[0]["thresholds"], float), made[0]["sure"])
