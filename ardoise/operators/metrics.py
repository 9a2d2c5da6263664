"""Evaluation of scores as aggregations: every measure is one or two small ``groupBy`` over the scored
rows, whatever their number."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ardoise.functions.exprs import ACCEPTED, REJECTED, above
from ardoise.operators.profile import class_share
from ardoise.operators.ranges import running_totals
from ardoise.sources.workdir import materialise

# Thresholds 0.00 to 0.99, each the product i * 0.01.
THRESHOLDS = 100
THRESHOLD_STEP = 0.01


def _positive(label: str) -> Column:
    return F.col(label).cast("int") == 1


def roc_auc(scored: DataFrame, label: str, score: str, by: Sequence[str] = (), ranges: int | None = None) -> DataFrame:
    """Exact area under the ROC curve with ties counted half, per ``by`` group.

    Equal scores shrink to one row each; the running count of negatives over them works in ranges of the
    score, so no task holds the whole ordering.  NULL when a class is absent.
    """
    by = list(by)
    ties = scored.groupBy(*by, score).agg(
        F.count_if(_positive(label)).alias("_pos"), F.count_if(~_positive(label)).alias("_neg")
    )
    # Written once: cutting it into ranges reads it several times, and scoring again would cost more.
    return auc_of_ties(materialise(ties, "ties"), score, by, ranges)


def auc_of_ties(ties: DataFrame, score: str, by: Sequence[str] = (), ranges: int | None = None) -> DataFrame:
    """The area from one row per score with its numbers of positives and negatives."""
    cum = running_totals(ties, score, ["_neg"], by, ranges)
    # Doubles: products of counts leave the range of long integers on very large tables.
    below, pos, neg = [c.cast("double") for c in (F.col("_neg_upto") - F.col("_neg"), F.col("_pos"), F.col("_neg"))]
    wins = F.sum(pos * (2 * below + neg))
    pairs = 2 * F.sum(pos) * F.sum(neg)
    return cum.groupBy(*by).agg(
        F.sum("_pos").alias("n_pos"),
        F.sum("_neg").alias("n_neg"),
        F.try_divide(wins, pairs).alias("auc"),
    )


def outcome_counts(scored: DataFrame, label: str, predicted: str, by: Sequence[str] = ()) -> DataFrame:
    """True and false positives and negatives."""
    actual, said = _positive(label), F.col(predicted).cast("int") == 1
    return scored.groupBy(*by).agg(
        F.count_if(actual & said).alias("tp"),
        F.count_if(~actual & said).alias("fp"),
        F.count_if(actual & ~said).alias("fn"),
        F.count_if(~actual & ~said).alias("tn"),
    )


def _ratio(n: Column, d: Column) -> Column:
    return F.when(d == 0, F.lit(0.0)).otherwise(F.try_divide(n.cast("double"), d.cast("double")))


def with_rates(counts: DataFrame, beta: float = 1.0) -> DataFrame:
    """Recall, precision and F-beta from the outcome counts; a zero denominator gives 0."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    b2 = F.lit(float(beta) * float(beta))
    name = "f1" if beta == 1.0 else "fbeta"
    return counts.withColumns(
        {
            "recall": _ratio(tp, tp + fn),
            "precision": _ratio(tp, tp + fp),
            name: _ratio((b2 + 1) * tp, (b2 + 1) * tp + b2 * fn + fp),
        }
    )


def score_row(scored: DataFrame, label: str, score: str, predicted: str, model: str) -> DataFrame:
    """One row per model: AUC, F1, recall, precision, each to two digits."""
    tagged = scored.select(F.lit(model).alias("model"), label, score, predicted)
    rates = with_rates(outcome_counts(tagged, label, predicted, ["model"]))
    area = roc_auc(tagged, label, score, ["model"])
    # One row on each side.
    return rates.join(area, "model").select(
        "model",
        F.round("auc", 2).alias("auc"),
        F.round("f1", 2).alias("f1"),
        F.round("recall", 2).alias("recall"),
        F.round("precision", 2).alias("precision"),
    )


def score_table(scored: DataFrame, label: str, scores: Mapping[str, tuple[str, str]]) -> DataFrame:
    """One row per model, all models in one pass: AUC, F1, recall and precision to two digits.

    ``scores`` maps a model's name to its columns of score and prediction.
    """
    cells = [
        F.struct(F.lit(m).alias("model"), F.col(s).cast("double").alias("_s"), F.col(p).cast("int").alias("_p")) for m, (s, p) in scores.items()
    ]
    long = scored.select(label, F.inline(F.array(*cells)))
    # Rows of equal score and prediction meet once; both measures are sums over them.
    ties = materialise(
        long.groupBy("model", "_s", "_p").agg(F.count_if(_positive(label)).alias("_y1"), F.count_if(~_positive(label)).alias("_y0")), "ties"
    )
    hit, said = F.col("_p") == 1, F.col("_p") == 0
    counts = ties.groupBy("model").agg(
        F.sum(F.when(hit, F.col("_y1")).otherwise(0)).alias("tp"), F.sum(F.when(hit, F.col("_y0")).otherwise(0)).alias("fp"),
        F.sum(F.when(said, F.col("_y1")).otherwise(0)).alias("fn"), F.sum(F.when(said, F.col("_y0")).otherwise(0)).alias("tn"),
    )
    area = auc_of_ties(ties.groupBy("model", "_s").agg(F.sum("_y1").alias("_pos"), F.sum("_y0").alias("_neg")), "_s", ["model"])
    # One row per model on each side.
    joined = with_rates(counts).join(area, "model")
    return joined.select("model", *[F.round(c, 2).alias(c) for c in ("auc", "f1", "recall", "precision")])


def confusion_matrix(scored: DataFrame, label: str, predicted: str, normalize: bool = False) -> DataFrame:
    """Rows are true classes, columns predicted ones; missing cells are 0.  Normalised by true class on
    request."""
    said = F.col(predicted).cast("int")
    cells = {f"predicted_{v}": F.count_if(said == v) for v in (0, 1)}
    counts = scored.groupBy(F.col(label).cast("int").alias("actual")).agg(
        *[c.alias(n) for n, c in cells.items()]
    )
    if not normalize:
        return counts
    total = F.col("predicted_0") + F.col("predicted_1")
    return counts.select("actual", *[_ratio(F.col(n), total).alias(n) for n in cells])


def thresholds_below(score: Column) -> Column:
    """How many of the thresholds lie strictly below the score.  The guess from multiplication is checked
    against its neighbours, because ``i * 0.01`` is not always the nearest double of the decimal."""
    guess = F.floor(score / F.lit(THRESHOLD_STEP)).cast("int")
    passed = F.lit(0)
    for shift in (-1, 0, 1):
        i = guess + F.lit(shift)
        passed = passed + (score > i * F.lit(THRESHOLD_STEP)).cast("int")
    return F.least(F.greatest(guess - 1 + passed, F.lit(0)), F.lit(THRESHOLDS))


def f1_curve(scored: DataFrame, label: str, score: str) -> DataFrame:
    """F1, recall and precision for every threshold.

    Each row falls into one of 101 bins and the curve is a running sum over the bins: one pass with map
    side counts, not one pass (or one copy of the rows) per threshold.
    """
    bins = scored.groupBy(thresholds_below(F.col(score)).alias("bin")).agg(
        F.count_if(_positive(label)).alias("p"), F.count_if(~_positive(label)).alias("n")
    )
    spark = scored.sparkSession
    steps = spark.range(0, THRESHOLDS + 1, 1, 1).select(F.col("id").cast("int").alias("bin"))
    full = steps.join(bins, "bin", "left").select(
        "bin", F.coalesce("p", F.lit(0)).alias("p"), F.coalesce("n", F.lit(0)).alias("n")
    )
    # 101 rows: a bin counts for every threshold below it.
    higher = Window.orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0)
    everyone = Window.orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    curve = full.select(
        (F.col("bin") - 1).alias("step"),
        F.sum("p").over(higher).alias("tp"),
        F.sum("n").over(higher).alias("fp"),
        (F.sum("p").over(everyone) - F.sum("p").over(higher)).alias("fn"),
    ).where(F.col("step") >= 0)
    return with_rates(
        curve.withColumn("threshold", F.col("step") * F.lit(THRESHOLD_STEP)).select(
            "step", "threshold", "tp", "fp", "fn"
        )
    )


def best_threshold(curve: DataFrame) -> DataFrame:
    """The lowest threshold with the highest F1."""
    return curve.orderBy(F.desc("f1"), "threshold").limit(1).select("threshold", "f1")


def share_at(scored: DataFrame, score: str, threshold: float) -> DataFrame:
    """Class shares after applying a threshold."""
    return class_share(scored.select(above(score, threshold).alias("TARGET")), "TARGET")


def exact_quantiles(df: DataFrame, column: str, shares: Sequence[float]) -> list[float]:
    """Quantiles by linear interpolation between ranks; missing values do not count.  Equal values shrink to one
    row each, their running numbers work in ranges of the column, and only the values at the ranks come back."""
    counted = df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("double").alias("v"))
    counted = materialise(counted.agg(F.count(F.lit(1)).alias("k")), "counted")
    n = counted.agg(F.sum("k")).first()[0]
    if not n:
        return []
    places = [(n - 1) * s for s in shares]
    ranks = sorted({r for p in places for r in (math.floor(p), math.ceil(p))})
    upto = running_totals(counted, "v", ["k"])
    held = [(F.col("k_upto") > r) & (F.col("k_upto") - F.col("k") <= r) for r in ranks]
    row = upto.agg(*[F.max(F.when(h, F.col("v"))) for h in held]).first()
    at = dict(zip(ranks, row))
    return [at[math.floor(p)] + (p - math.floor(p)) * (at[math.ceil(p)] - at[math.floor(p)]) for p in places]


def auto_bins(scored: DataFrame, score: str) -> tuple[float, float, int]:
    """Range and number of equal bins by the larger of the Sturges and Freedman-Diaconis rules, from the
    count, the extremes and the quartiles."""
    row = scored.agg(F.count(score).alias("n"), F.min(score).alias("lo"), F.max(score).alias("hi")).first()
    if not row["n"] or row["hi"] == row["lo"]:
        return (row["lo"] or 0.0, row["hi"] or 0.0, 1)
    span = row["hi"] - row["lo"]
    lower, upper = exact_quantiles(scored, score, [0.25, 0.75])
    sturges = span / (math.log2(row["n"]) + 1)
    fd = 2.0 * (upper - lower) / row["n"] ** (1 / 3)
    width = min(fd, sturges) if fd > 0 else sturges
    return row["lo"], row["hi"], max(1, math.ceil(span / width))


def _bucket(c: Column, low: float, high: float, bins: int) -> Column:
    """The number of an equal bin; the last one is closed."""
    if low == high:
        return F.when(c.isNotNull(), 1).cast("int")
    return F.least(F.width_bucket(c, F.lit(low), F.lit(high), F.lit(bins)), F.lit(bins)).cast("int")


def marked_histogram(scored: DataFrame, score: str, key: str, individual) -> DataFrame:
    """series, bin, low (its lower edge), n and marked for both class probabilities in automatic bins.

    ``marked`` tells the bins that hold the individual, of whom there may be several rows or none.  Rows without a
    score are left out; an empty table has no bins.
    """
    low, high, bins = auto_bins(scored, score)
    p, me = F.col(score).cast("double"), F.coalesce(F.col(key) == F.lit(individual), F.lit(False)).alias("me")
    # The other class has the mirrored range, and as many bins.
    sides = {ACCEPTED: (1 - p, 1 - high, 1 - low), REJECTED: (p, low, high)}
    cells = [
        F.struct(F.lit(name).alias("series"), _bucket(c, lo, hi, bins).alias("bin"), F.lit(lo).alias("lo"), F.lit((hi - lo) / bins).alias("width"))
        for name, (c, lo, hi) in sides.items()
    ]
    both = scored.where(F.col(score).isNotNull()).select(me, F.inline(F.array(*cells)))
    counts = both.groupBy("series", "bin", "lo", "width").agg(F.count(F.lit(1)).alias("n"), F.bool_or("me").alias("marked"))
    return counts.select("series", "bin", (F.col("lo") + (F.col("bin") - 1) * F.col("width")).alias("low"), "n", "marked")


def score_histogram(scored: DataFrame, score: str, bins: int, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """Counts of both class probabilities in equal bins; the last bin is closed."""
    p = F.col(score)
    both = scored.select(
        F.inline(
            F.array(
                F.struct(F.lit(ACCEPTED).alias("series"), _bucket(1 - p, low, high, bins).alias("bin")),
                F.struct(F.lit(REJECTED).alias("series"), _bucket(p, low, high, bins).alias("bin")),
            )
        )
    )
    return both.groupBy("series", "bin").agg(F.count(F.lit(1)).alias("n"))


def best_per_metric(scores: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """The best model for each metric; ties go to the first name."""
    long = scores.select(
        F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value"), "model") for m in metrics]))
    )
    best = F.min_by(F.struct("model", "value"), F.struct((-F.col("value")).alias("v"), F.col("model")))
    return long.groupBy("metric").agg(best.alias("b")).select("metric", "b.model", "b.value")
