"""Synthetic minority rows: points between a minority row and one of its nearest minority neighbours."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ardoise.functions.exprs import hash_bucket
from ardoise.operators.neighbours import distinct_points, nearest_points, point
from ardoise.operators.ranges import running_totals
from ardoise.operators.skew import skew_join
from ardoise.sources.workdir import materialise

# Fixed value: neighbours to choose from.
NEIGHBOURS = 5
_FINE = 1_000_000_007


def synthetic_points(
    df: DataFrame, label: str, key: str, features: Sequence[str], k: int = NEIGHBOURS, minority: int = 1
) -> DataFrame | None:
    """As many new minority points as the classes differ by: (source, n, neighbour, u, point), None if there are none.

    Every minority row is used equally often; ``n`` counts its uses.  The neighbour and the position ``u`` between the two
    points come from hashes of the key, so a re-run gives the same rows.  A missing neighbour is a copy of the source.
    """
    counts = {r[0]: r[1] for r in df.groupBy(F.col(label).cast("int")).agg(F.count(F.lit(1))).collect()}
    few = counts.get(minority, 0)
    missing = sum(n for c, n in counts.items() if c != minority) - few
    if few < 2 or missing <= 0:
        return None
    rows = df.where(F.col(label).cast("int") == minority)
    points = materialise(distinct_points(rows, key, features), "points")
    near = nearest_points(points, k)

    # Copies of a point are neighbours at distance 0 and come before all others.
    numbered = running_totals(rows.select(F.col(key).cast("bigint").alias("source")).withColumn("_one", F.lit(1)),
                              "source", ["_one"])
    # Whole numbers: shares in doubles would lose a row now and then.
    upto = f"cast(_one_upto as decimal(19,0)) * {missing}BD div {few}"
    before = f"cast(_one_upto - 1 as decimal(19,0)) * {missing}BD div {few}"
    times = F.expr(f"cast(({upto}) - ({before}) as int)")
    # A point is known by the digest of its digits: rows travel without its numbers or their text to find its neighbours, and
    # a hot one can be named in a condition.
    digest = F.sha2(F.array_join(F.col("x").cast("array<string>"), ","), 256)
    bases = rows.select(F.col(key).cast("bigint").alias("source"), point(features).alias("x")).select("source", digest.alias("_at"))
    bases = bases.join(numbered.select("source", times.alias("times")), "source")
    # All copies of a point look up the same neighbours: a hot point is met by broadcast.
    lists = points.withColumn("_at", digest).join(near, "id", "left").select(
        "_at", "x", (F.least(F.col("copies") - 1, F.lit(k))).cast("int").alias("twins"),
        F.transform(F.coalesce("near", F.array()), lambda e: e["neighbour"]).alias("others"),
    )
    lists = lists.withColumn("choices", F.least(F.col("twins") + F.size("others"), F.lit(k)))
    new = skew_join(bases, lists, "_at", "left")
    new = new.where((F.col("choices") > 0) & (F.col("times") > 0)).select(
        "source", "x", "twins", "others", "choices",
        F.explode(F.sequence(F.lit(1), F.col("times"))).alias("n"),
    )
    tag = F.concat_ws("|", F.col("source").cast("string"), F.col("n").cast("string"))
    pick = F.pmod(hash_bucket(tag, _FINE, "neighbour"), F.col("choices"))
    new = new.withColumns({"pick": pick, "u": hash_bucket(tag, _FINE, "position") / F.lit(float(_FINE))})
    twin = F.col("pick") < F.col("twins")
    other = F.when(~twin, F.get("others", (F.col("pick") - F.col("twins")).cast("int")))
    new = new.select("source", "n", "x", "u", other.alias("id"))
    partner = points.select("id", F.col("x").alias("y"))
    # A point that is everybody's neighbour is a hot key of this join.
    paired = skew_join(new, partner, "id", "left")
    between = F.when(
        F.col("y").isNotNull(),
        F.zip_with("x", "y", lambda a, b: a + F.col("u") * (b - a)),
    ).otherwise(F.col("x"))
    return paired.select("source", "n", F.col("id").alias("neighbour"), "u", between.alias("point"))


def synthetic_rows(
    df: DataFrame, label: str, key: str, features: Sequence[str], k: int = NEIGHBOURS, minority: int = 1
) -> DataFrame:
    """The new points as rows: (source key, label, features)."""
    made = synthetic_points(df, label, key, features, k, minority)
    if made is None:
        return df.select(key, label, *features).limit(0)
    cells = [F.col("point")[j].alias(c) for j, c in enumerate(features)]
    return made.select(F.col("source").alias(key), F.lit(minority).alias(label), *cells)


def oversample(df: DataFrame, label: str, key: str, features: Sequence[str], k: int = NEIGHBOURS) -> DataFrame:
    """The rows together with the synthetic ones: both classes are equally large."""
    new = synthetic_rows(df, label, key, features, k)
    base = df.select(key, F.col(label).cast("int").alias(label), *[F.col(c).cast("double").alias(c) for c in features])
    return base.unionByName(new.select(F.col(key).cast(dict(base.dtypes)[key]).alias(key), label, *features))
