"""Personal data: generators propose spans, boosted trees judge them, calibrated thresholds decide.

Generators of high recall propose overlapping candidates of each kind: the base forms (see ``base_spans``),
base forms that fail their check, numbers written like phone or card numbers without a plus, long hex address
groups, and e-mail addresses with the signs spelt out.  A gradient-boosted ensemble (Spark ML) gives each
candidate a score from its format and its context.

Nobody labelled candidates, so the trees learn from the corpus itself: base spans are examples of personal
data, also in altered views (the plus taken off, the at-sign spelt out), and the same spans with a broken
format (a wrong check digit, an octet too large, a part missing) are counter-examples.  They come from all
documents, each key and text once; equal examples are merged into one with a weight where there are very many.
Half of the examples train the trees; on the other half a threshold per kind is set where the chosen examples are
right with the wanted precision.

Base spans always stay.  Other candidates are added from the likeliest down when they pass the threshold of
their kind and do not overlap a span that is already in.

Defined results: a null or empty text has no spans.  With fewer than ``LEAST`` examples of either class there
are no trees and only base spans.  Repeated rows have equal spans.  Texts of any length are searched whole.
Offsets are code points, the end exclusive.  Only the named columns are read.
"""

from __future__ import annotations

import bisect
import hashlib
import math
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ardoise.llm.common import release, texts, to_spark
from ardoise.sources.workdir import materialise

KINDS = ("email", "ip", "card", "phone")

# The base forms.
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

#: Further candidates.
SPELT = re.compile(r"(?: ?[\[({]at[\])}] ?| at )[A-Za-z0-9-]{1,63}(?:(?: ?[\[({]dot[\])}] ?| dot |\.)[A-Za-z0-9-]{1,63}){1,8}", re.I)
NUMBER = re.compile(r"(?<![\w+.-])\(?[0-9]{2,4}\)?[ .-][0-9]{2,4}[ .-][0-9]{3,4}(?![\w.-])")
GROUPS = re.compile(r"(?<![\w:])(?:[0-9A-Fa-f]{1,4}:){4,7}[0-9A-Fa-f]{1,4}(?![\w:])")
CONTEXT = [
    re.compile(x, re.I)
    for x in (r"mail|contact|write|address", r"\bip\b|host|server|addr", r"card|visa|credit|pay|iban", r"tel|phone|call|fax|mobile|whats")
]
#: Characters before a candidate that count as its context.
NEAR = 30

#: Examples beyond which equal ones are merged, into about as many rows; more only where more of them differ.
MOST_EXAMPLES = 200_000
#: Examples that a task writes at once.
AT_ONCE = 4_096
LEAST = 50
TREES, DEPTH = 16, 4
#: A threshold gives at least this precision on held-out examples, and at least this probability by the trees.
PRECISION, SURE = 0.98, 0.9


def luhn(digits: str) -> bool:
    return sum(d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for k, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def only_digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def holds(kind: str, s: str) -> bool:
    """Whether a match of the base form passes the check of its kind."""
    if kind == "ip":
        return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in s.split("."))
    if kind == "card":
        return 12 <= len(d := only_digits(s)) <= 19 and luhn(d)
    return kind == "email" or 9 <= len(only_digits(s)) <= 15


def base_matches(text: str) -> Iterator[tuple[int, int, str]]:
    """Leftmost matches of the base forms that do not overlap within their kind, checked or not."""
    if "@" in text:
        done = 0
        for m in DOMAIN.finditer(text):
            # The local part is the whole run before the sign, as far back as the match before.
            at = m.start()
            while at > done and (text[at - 1].isascii() and text[at - 1].isalnum() or text[at - 1] in "._%+-"):
                at -= 1
            if at < m.start():
                done = m.end()
                yield at, done, "email"
    for kind, form in (("ip", IP), ("card", CARD), ("phone", PHONE)):
        for m in form.finditer(text):
            yield m.start(), m.end(), kind


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Checked base spans by start, then kind."""
    found = [(s, e, k) for s, e, k in base_matches(text) if holds(k, text[s:e])]
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[2])))


def candidates(text: str) -> Iterator[tuple[int, int, str]]:
    """Further spans, which may overlap each other."""
    for s, e, k in base_matches(text):
        if not holds(k, text[s:e]) and (k != "card" or e - s >= 9):
            yield s, e, k
    for m in SPELT.finditer(text):
        at = m.start()
        while at > 0 and m.start() - at < 64 and (text[at - 1].isascii() and text[at - 1].isalnum() or text[at - 1] in "._%+-"):
            at -= 1
        if at < m.start():
            yield at, m.end(), "email"
    for m in NUMBER.finditer(text):
        if 9 <= len(only_digits(m[0])) <= 15:
            yield m.start(), m.end(), "phone"
    for m in GROUPS.finditer(text):
        yield m.start(), m.end(), "ip"


def describe(kind: str, span: str, before: str, after: str) -> list[float]:
    """Format and context of a candidate."""
    d = only_digits(span)
    parts = re.split(r"[^0-9A-Za-z]+", span.strip())
    octets = [int(p) for p in span.split(".") if p.isdigit() and len(p) < 6]
    tail = re.split(r"[.\s]", span)[-1]
    return [
        *(float(kind == k) for k in KINDS),
        float(len(span)), float(len(d)), float(len(set(d))), float(len(parts)), float(max(map(len, parts), default=0)),
        float(luhn(d)) if 12 <= len(d) <= 19 else -1.0,
        float(max(octets, default=0)), float(len(octets)),
        float("+" in span), float("(" in span), float(span.count(".")), float(len(tail) if tail.isalpha() else 0),
        float(before[-1:].isalnum()), float(after[:1].isalnum()),
        float(bool(CONTEXT[KINDS.index(kind)].search(before))),
        float(sum(c.isalpha() for c in span)),
    ]


def views(kind: str, span: str, coin: int) -> list[tuple[str, float]]:
    """Views of a base span: as it is and altered (1), and with a broken format (0)."""
    out, d = [(span, 1.0)], only_digits(span)
    if kind == "email":
        name, host = span.split("@", 1)
        style = ((" at ", " dot "), ("[at]", "[dot]"), (" (at) ", " (dot) "))[coin % 3]
        out += [(name + style[0] + host.replace(".", style[1]), 1.0), (f"{name} at {host.split('.')[0]}.{'The' if coin % 2 else 'a'}", 0.0)]
    elif kind == "ip":
        parts = span.split(".")
        parts[coin % 4] = str(256 + coin % 700)
        out += [(".".join(parts), 0.0)]
    elif kind == "card":
        out += [(" ".join(d[k : k + 4] for k in range(0, len(d), 4)), 1.0), (d[:-1] + str((int(d[-1]) + 1 + coin % 9) % 10), 0.0)]
    else:
        local = re.sub(r"^\+[0-9]{1,3}[ .-]?", "", span)
        out += [(local, 1.0)] if len(only_digits(local)) >= 9 else []
        out += [(span[: 4 + coin % 5], 0.0), ("-".join((d[:4], d[4:6], d[6:8] + "00")), 0.0)]
    return out


EXAMPLES = pa.schema([("kind", pa.string()), ("x", pa.list_(pa.float64())), ("label", pa.float64()), ("half", pa.int32()), ("h", pa.int64()), ("at", pa.int64()), ("view", pa.int32())])
FOUND = pa.schema([("id", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS), ("base_sha256", pa.string()), ("spans", pa.string()), ("n_added", pa.int64())])


def _examples(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(EXAMPLES)], schema=EXAMPLES)

    rows: list[tuple] = []
    for batch in it:
        for h, text in zip(batch["h"].to_pylist(), map(lambda x: x.as_py(), batch["text"])):
            if not MAYBE.search(text):
                continue
            for s, e, kind in base_spans(text):
                before, after = text[max(0, s - NEAR) : s], text[e : e + 1]
                coin = int.from_bytes(hashlib.md5(f"{before}{text[s:e]}".encode()).digest()[:4])
                seen = enumerate(views(kind, text[s:e], coin >> 1))
                rows += [(kind, describe(kind, v, before, after), y, coin & 1, h, s, k) for k, (v, y) in seen]
                if len(rows) >= AT_ONCE:
                    yield batch_of(rows)
                    rows = []
            for s, e, kind in base_matches(text):
                if not holds(kind, text[s:e]) and (kind != "card" or e - s >= 9):
                    coin = int.from_bytes(hashlib.md5(text[s:e].encode()).digest()[:4])
                    rows.append((kind, describe(kind, text[s:e], text[max(0, s - NEAR) : s], text[e : e + 1]), 0.0, coin & 1, h, s, -1))
    if rows:
        yield batch_of(rows)
    release()


class Trees:
    """The fitted ensemble as plain arrays, and a threshold per kind.  It goes with the tasks."""

    def __init__(self, trees: list[list[tuple]], weights: list[float], thresholds: dict[str, float]):
        self.trees, self.weights, self.thresholds = trees, weights, thresholds

    def margin(self, x: list[float]) -> float:
        total = 0.0
        for nodes, weight in zip(self.trees, self.weights):
            at = 0
            while nodes[at][0] >= 0:
                feature, limit, left, right = nodes[at]
                at = left if x[feature] <= limit else right
            total += weight * nodes[at][1]
        return total


CONDITION = re.compile(r"^( *)(If|Else) \(feature (\d+) (<=|>) (\S+)\)|^( *)Predict: (\S+)")


def parse_tree(text: str) -> list[tuple]:
    """Nodes of one printed tree: (feature, limit, left, right), or (-1, value, 0, 0)."""
    lines = [m for m in map(CONDITION.match, text.splitlines()) if m]
    nodes: list = []

    def read(at: int) -> tuple[int, int]:
        me = len(nodes)
        nodes.append(None)
        m = lines[at]
        if m[7] is not None:
            nodes[me] = (-1, float(m[7]), 0, 0)
            return me, at + 1
        left, at_else = read(at + 1)
        right, end = read(at_else + 1)
        nodes[me] = (int(m[3]), float(m[5]), left, right)
        return me, end

    read(0)
    return nodes


def sample(df: DataFrame, key: str, text: str, sampled: int) -> DataFrame:
    """About ``sampled`` texts at most: a share of the different (key, text), by their hash, each once.

    So neither rows without a key nor a key or text on a third of all rows can fill the sample.
    """
    n = df.count()
    rows = texts(df, key, text).withColumn("h", F.xxhash64("id", "text"))
    if n > sampled:
        rows = rows.where(F.pmod("h", F.lit(1 << 20)) < int((1 << 20) * sampled / n))
    # Copies go before they are shuffled.
    return rows.groupBy("h").agg(F.first("text").alias("text")).select("h", "text")


def examples(df: DataFrame, key: str, text: str) -> DataFrame:
    """Examples of all documents with weights: kind, x, label, half, weight.

    Copies of a (key, text) count once; their examples meet, the texts do not travel.  Beyond ``MOST_EXAMPLES`` equal ones
    are merged into about that many rows: a fit sums weights, so it is that of all examples.
    """
    rows = texts(df, key, text).select(F.xxhash64("id", "text").alias("h"), "text")
    made = rows.mapInArrow(_examples, to_spark(EXAMPLES)).dropDuplicates(["h", "at", "kind", "view"])
    made = materialise(made, "examples")
    same = ["kind", "x", "label", "half"]
    if made.count() <= MOST_EXAMPLES:
        return made.select(*same, F.lit(1.0).alias("weight"))
    part = F.pmod(F.xxhash64("h", "at"), F.lit(max(1, MOST_EXAMPLES // made.select(*same).distinct().count())))
    merged = made.groupBy(*same, part.alias("part")).agg(F.count(F.lit(1)).cast("double").alias("weight"))
    return materialise(merged.drop("part"), "merged")


def train(df: DataFrame, key: str = "doc_id", text: str = "text") -> Trees | None:
    """Trees and thresholds from the examples of all documents."""
    made = examples(df, key, text)
    classes = {r["label"]: r["n"] for r in made.where("half = 0").groupBy("label").agg(F.sum("weight").alias("n")).collect()}  # two rows
    if min(classes.get(0.0, 0), classes.get(1.0, 0)) < LEAST:
        return None
    vectors = made.withColumn("features", array_to_vector("x"))
    booster = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=7, maxBins=64, cacheNodeIds=False, weightCol="weight")
    model = booster.fit(vectors.where("half = 0").select("features", "label", "weight"))
    trees = Trees([parse_tree(t.toDebugString) for t in model.trees], list(model.treeWeights), {})
    # Calibration: per kind, the precision of the held-out examples from each score up; scores in hundredths.
    def scores(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            bins = [math.floor(trees.margin(x) * 100) for x in batch["x"].to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in ("kind", "label", "weight")), pa.array(bins, pa.int64())], ["kind", "label", "weight", "bin"])
        release()

    binned = made.where("half = 1").select("kind", "label", "weight", "x").mapInArrow(scores, "kind string, label double, weight double, bin bigint")
    for kind in KINDS:
        trees.thresholds[kind] = float("inf")
    right: dict[str, list[float]] = {k: [0.0, 0.0] for k in KINDS}
    for r in binned.groupBy("kind", "bin").agg(F.sum(F.col("label") * F.col("weight")).alias("good"), F.sum("weight").alias("all")).orderBy(F.desc("bin")).collect():
        good = right[r["kind"]]
        good[0] += r["good"]
        good[1] += r["all"]
        if good[0] >= PRECISION * good[1]:
            trees.thresholds[r["kind"]] = max(r["bin"] / 100, math.log(SURE / (1 - SURE)) / 2)
    return trees


def add_spans(text: str, base: list[tuple[int, int, str]], trees: Trees) -> list[tuple[int, int, str]]:
    """Base spans and the chosen candidates, by start, then kind."""
    judged = []
    for s, e, kind in candidates(text):
        m = trees.margin(describe(kind, text[s:e], text[max(0, s - NEAR) : s], text[e : e + 1]))
        if m >= trees.thresholds[kind]:
            judged.append((-m, s, e, kind))
    if not judged:
        return base
    taken, merged = sorted((s, e) for s, e, _ in base), []
    for s, e in taken:  # base spans of different kinds may overlap
        if merged and s < merged[-1][1]:
            merged[-1] = (merged[-1][0], max(e, merged[-1][1]))
        else:
            merged.append((s, e))
    added = []
    for _, s, e, kind in sorted(judged):
        at = bisect.bisect_left(merged, (s, e))
        if (at == len(merged) or merged[at][0] >= e) and (at == 0 or merged[at - 1][1] <= s):
            merged.insert(at, (s, e))
            added.append((s, e, kind))
    return sorted([*base, *added], key=lambda x: (x[0], KINDS.index(x[2])))


def _written(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


MAYBE = re.compile(r"[0-9@]|[\[({ ]at[\])} ]|:", re.I)


def find_pii(df: DataFrame, trees: Trees | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, counts of base spans, their digest, all spans as text, and how many were added, for every row."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            rows = []
            for x in batch["text"]:
                t = x.as_py()
                base = base_spans(t) if MAYBE.search(t) else []
                spans = add_spans(t, base, trees) if trees is not None and MAYBE.search(t) else base
                kinds = [k for _, _, k in base]
                digest = hashlib.sha256(_written(base).encode()).hexdigest()
                rows.append((*map(kinds.count, KINDS), digest, _written(spans), len(spans) - len(base)))
            cols = [batch["id"], *(pa.array(c, f.type) for c, f in zip(zip(*rows), list(FOUND)[1:]))]
            yield pa.RecordBatch.from_arrays(cols, schema=FOUND)
        release()

    out = texts(df, key, text).select(F.col("id").cast("long"), "text").mapInArrow(run, to_spark(FOUND))
    return out.withColumnRenamed("id", key)


def redact(df: DataFrame, trees: Trees | None, text: str = "text") -> DataFrame:
    """The rows with every span of ``text`` replaced by its kind in angle brackets; null stays null."""

    @F.pandas_udf("string")
    def replaced(column: pd.Series) -> pd.Series:
        def one(t: str | None) -> str | None:
            if t is None or not MAYBE.search(t):
                return t
            base = base_spans(t)
            out, done = [], 0
            for s, e, kind in add_spans(t, base, trees) if trees is not None else base:
                if s >= done:
                    out += [t[done:s], f"<{kind}>"]
                done = max(done, e)
            return "".join([*out, t[done:]])

        return column.map(one)

    return df.withColumn(text, replaced(F.col(text)))
