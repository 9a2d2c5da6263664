"""Exact neighbours in many dimensions: equality with brute force and the number of visits."""

import numpy as np
import pandas as pd
import pytest

from ardoise.operators import neighbours


def visits_and_neighbours(spark, monkeypatch, v, block_rows, k=5):
    """Visits per point, number of blocks, and the neighbours found."""
    seen, blocks, trips = [], [], neighbours.trips

    def counted(bounded, b, first, k):
        out = trips(bounded, b, first, k)
        seen.append(out.count())
        blocks.append(int(b.cuts.sum()))
        return out

    monkeypatch.setattr(neighbours, "trips", counted)
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(v)], "id bigint, x array<double>")
    got = {r.id: [(e.distance, e.neighbour) for e in r.near] for r in neighbours.nearest_points(df, k, block_rows).collect()}
    return sum(seen) / len(v), blocks[0] if blocks else 1, got


def brute(v, k=5):
    d = np.sqrt(((v[:, None] - v[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    return {i: [(d[i, j], j) for j in np.lexsort((np.arange(len(v)), d[i]))[:k] if np.isfinite(d[i, j])] for i in range(len(v))}


def clusters(rng):
    """Forty groups in sixty dimensions."""
    return np.concatenate([c + 0.3 * rng.standard_normal((40, 60)) for c in rng.standard_normal((40, 60)) * 2])


def plane(rng):
    """Sixty features that depend on three."""
    return rng.random((1500, 3)) @ rng.standard_normal((3, 60))


@pytest.mark.parametrize("make,most", [(clusters, 3), (plane, 8)])
def test_few_visits_in_many_dimensions(spark, monkeypatch, make, most):
    v = make(np.random.default_rng(0))
    visits, blocks, got = visits_and_neighbours(spark, monkeypatch, v, 64)
    assert blocks >= 20 and visits <= most
    assert {i: [n for _, n in g] for i, g in got.items()} == {i: [n for _, n in g] for i, g in brute(v).items()}


@pytest.mark.parametrize(
    "v",
    [
        np.concatenate([np.eye(50) * 3, np.random.default_rng(1).standard_normal((150, 50)) * 0.01]),  # equally far from a pivot
        np.random.default_rng(2).random((300, 50)),  # nothing can be ruled out
        np.array([[1.0, 2.0]]), np.array([[1.0, 2.0], [3.0, 4.0], [0.0, 0.0]]),
    ],
)
def test_hard_cases_equal_brute_force(spark, monkeypatch, v):
    got, want = visits_and_neighbours(spark, monkeypatch, v, 16)[2], brute(v)
    for i in want:
        np.testing.assert_allclose([d for d, _ in got.get(i, [])], [d for d, _ in want[i]], rtol=1e-12)


def test_no_points(spark):
    assert neighbours.nearest_points(spark.createDataFrame([], "id bigint, x array<double>")).count() == 0


def test_visits_leave_in_small_pieces():
    # Ten thousand points that every one of thirty blocks may hold a neighbour of: 300,000 copies of 250 numbers.
    rng = np.random.default_rng(3)
    d, many, points = 250, 30, 10_000
    blocks = neighbours.Blocks(rng.random((many, d)), np.arange(many), np.zeros(many, int), np.zeros(many), np.full(many, 99.0), np.full(many, 2))
    rows = pd.DataFrame({"id": np.arange(points), "x": list(rng.random((points, d))), "cell": np.arange(points) % many,
                         "shell": 0, "cut": 0, "bound": np.inf, "before": 0.0})

    class Rows:
        def select(self, *_):
            return self

        def mapInPandas(self, f, _):
            return [len(b) for b in f(iter([rows]))]

    sizes = neighbours.trips(Rows(), blocks, None, 5)
    assert max(sizes) * (d + 1) <= neighbours.VISIT_NUMBERS
    # Every block in both its parts but the own part; the most promising ones were met before.
    assert sum(sizes) > points * 2 * (many - neighbours.PROMISING - 2)


def test_visitors_in_slices_find_the_same(monkeypatch):
    rng = np.random.default_rng(4)
    x = rng.random((900, 8))
    frame = pd.DataFrame({"id": np.arange(900), "x": list(x), "bound": np.inf})
    whole = neighbours.block_candidates(frame, frame, 5)
    monkeypatch.setattr(neighbours, "AT_ONCE", 100)
    assert neighbours.block_candidates(frame, frame, 5).equals(whole)
    want = brute(x)
    for i, near in whole.groupby("id"):
        assert near["neighbour"].tolist() == [n for _, n in want[i]]


def test_visits_travel_in_parts_and_are_written_without_coordinates(spark, monkeypatch):
    rng, written, materialise = np.random.default_rng(5), [], neighbours.materialise
    v = rng.random((300, 30))
    monkeypatch.setattr(neighbours, "MOVED", 1 << 18)
    monkeypatch.setattr(neighbours, "materialise", lambda df, name: written.append((name, df.columns)) or materialise(df, name))
    got = visits_and_neighbours(spark, monkeypatch, v, 32)[2]
    want = brute(v)
    assert all([n for _, n in got[i]] == [n for _, n in want[i]] for i in want)
    assert all("x" not in columns for name, columns in written if name == "visits")
    assert len([name for name, _ in written if name == "near"]) > 5
    # Two points of one key go where each of them is sent, and meet a point once.
    twice = spark.createDataFrame([(i // 2, r.tolist()) for i, r in enumerate(v)], "id bigint, x array<double>")
    for row in neighbours.nearest_points(twice, 5, 32).collect():
        at = [2 * row.id, 2 * row.id + 1]
        d = np.sqrt(((v[at][:, None] - v[None]) ** 2).sum(2))
        d[:, at] = np.inf
        assert np.allclose([e.distance for e in row.near], np.sort(d.ravel())[:5])
