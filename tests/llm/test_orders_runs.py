"""Fingerprints, periodic runs and whitening against plain versions and on odd rows."""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
import pytest
from clashes import with_clashes
from hypothesis import given, settings
from hypothesis import strategies as st

from ardoise.llm import orderhash, periods, queries, whitening
from ardoise.llm.common import table

NAN, INF = float("nan"), float("inf")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


# -- runs


def plain_runs(words, least=periods.LEAST, times=periods.TIMES):
    """All runs, period by period."""
    found = {}
    for q in range(1, len(words) // times + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, times * q):
                found.setdefault((i, j + q - i), q)
            i = max(j, i + 1)
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def plain_digest(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2])) if runs else (None,) * 3
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    return (doc_id, len(runs), *best, best[1] * 1000 // best[2] if runs else None, sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(kept))


@settings(max_examples=300, deadline=None)
@given(
    st.lists(st.lists(st.integers(0, 2), max_size=40) | st.tuples(st.lists(st.integers(0, 2), min_size=1, max_size=7), st.integers(2, 9)).map(lambda x: x[0] * x[1]), min_size=1, max_size=4),
    st.sampled_from([(6, 4), (2, 2), (5, 3)]),
)
def test_runs_of_small_alphabets(many, limits):
    codes = np.array([c for w in many for c in w], np.int64)
    text = np.repeat(np.arange(len(many)), [len(w) for w in many])
    want, base = [], 0
    for w in many:
        want += [(s + base, n, q) for s, n, q in plain_runs(w, *limits)]
        base += len(w)
    got = periods.maximal_runs(codes, text, *limits) if len(codes) else []
    assert got == sorted(want, key=lambda r: (r[0], r[2]))


def test_long_runs():
    codes = np.concatenate([np.zeros(50_000), np.arange(1, 9), np.arange(50_000) % 7 + 20]).astype(np.int64)
    got = periods.maximal_runs(codes, np.zeros(len(codes), np.int64))
    assert got == [(0, 50_000, 1), (50_008, 50_000, 7)]


def test_runs_across_blocks_of_places():
    # Wherever the run lies, its two places may be the only ones of their blocks.
    block = 1 << periods.SHIFT
    for before in range(block - 12, block + 2):
        for period in (1, 3, 5):
            words = [*range(100, 100 + before), *(i % period for i in range(6 * period)), 99]
            got = periods.maximal_runs(np.array(words, np.int64), np.zeros(len(words), np.int64))
            assert got == [(before, 6 * period, period)]


def test_a_common_phrase_is_not_quadratic():
    # 20,000 copies of a phrase after different words: two hundred million pairs, none near enough.
    rng = np.random.default_rng(5)
    codes = np.concatenate([[10 + rng.integers(0, 1000), *range(9), *(5000 + rng.integers(0, 9000, 9))] for _ in range(20_000)])
    assert periods.maximal_runs(codes.astype(np.int64), np.zeros(len(codes), np.int64)) == []


def test_run_digests(spark, folder):
    documents = table(spark, folder, "documents")
    want = sorted(plain_digest(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect())
    got = queries.QUERIES["op13_periodic_runs"](spark, folder)
    assert sorted(map(tuple, got.collect()), key=lambda r: r[0]) == want
    assert sum(r[1] for r in want) > 10


def test_run_digests_of_odd_rows(spark, odd, nothing):
    rows = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    got = sorted(map(tuple, periods.run_digests(odd).collect()), key=str)
    assert len(got) == len(rows)
    assert sorted((r for r in got if r[0] != 4), key=str) == sorted((plain_digest(*r) for r in rows if r[0] != 4), key=str)
    assert [r[1:6] for r in got if r[0] == 4] == [(1, 0, 40_000, 1, 40_000_000)]
    assert periods.run_digests(nothing).count() == 0
    runs = periods.runs_of(odd).collect()
    assert [tuple(r) for r in runs] == [(4, 0, 40_000, 1)]


# -- fingerprints


def plain_print(text, kmer=orderhash.KMER, take=orderhash.TUPLE, size=orderhash.SIZE):
    """One text, one element and one point at a time."""
    width = min(len(text), kmer)
    _, kmers, hashes = orderhash.elements([text], kmer)
    seen, number = {}, []
    for i in range(len(text) - width + 1 if text else 0):
        gram = text[i : i + width]
        number.append(seen.get(gram, 0))
        seen[gram] = number[-1] + 1
    u = np.uint64
    assert (hashes == orderhash.mix(kmers + np.array(number, u) * orderhash.ODD)).all()
    assert len({k: v for k, v in zip(kmers.tolist(), number) if v == 0}) == len(seen)
    times = np.full((len(hashes), size), INF)
    for e, h in enumerate(hashes):
        time, step = 0.0, 0
        while step < 4 or np.isinf(times[e]).any():
            random = orderhash.mix(np.array([h], u) + np.array([step], u) * orderhash.ODD)[0] if step else h
            time += -np.log((float(random >> u(11)) + 0.5) * 2.0**-53) / size
            cell = int(random & u(0x7FF)) % size
            times[e, cell] = min(times[e, cell], time)
            step += 1
    out = []
    for j in range(size):
        first = sorted(np.argsort(times[:, j], kind="stable")[:take].tolist())
        total = np.zeros(1, u)
        for k in range(take):
            # Fewer elements than wanted stand in front as a fixed one.
            place = ([-1] * (take - len(first)) + first)[k]
            total = orderhash.mix(total * u(0xD1342543DE82EF95) + (kmers[place] if place >= 0 else u(7)) + u(1))
        out.append(int(total[0] >> u(48)))
    return out


TEXTS = ["", "a", "abcdefgh", "abcdefghi", "aaaaaaaaaaaaaaaaaaaaaaaa", "the cat and the cat and the dog", "naïve 😀 日本語 text text text"]


def test_fingerprints_equal_plain_ones():
    got = orderhash.fingerprints(TEXTS)
    for t, g in zip(TEXTS, got):
        assert g.tolist() == plain_print(t)
        assert (orderhash.fingerprints([t])[0] == g).all()


def test_fingerprints_feel_order():
    rng = np.random.default_rng(3)
    words = ["".join(map(chr, rng.integers(97, 123, 6))) for _ in range(400)]
    text, moved = " ".join(words), " ".join(words[200:] + words[:200])
    a, b, c = orderhash.fingerprints([text, moved, text[: len(text) // 2] + "x" + text[len(text) // 2 :]], size=2048)
    # Half of all pairs change their order when the halves change places; one letter changes little.
    assert 0.4 < orderhash.likeness(a, b) < 0.6 and orderhash.likeness(a, c) > 0.95
    far = " ".join("".join(map(chr, rng.integers(97, 123, 6))) for _ in range(400))
    # A share 1/3 of common k-mers: a pair is common with 1/9.
    half = orderhash.fingerprints([" ".join(words), " ".join([*words[:200], *far.split()[200:]])], size=2048)
    assert abs(orderhash.likeness(*half) - 1 / 9) < 0.03


def plain_edited(rows):
    """Result rows but for the fingerprints, in the order of ids."""
    rows = [(i, t or "") for i, t in rows]
    rows.sort(key=lambda r: (orderhash._key(r[0], r[1].encode()), r[1]))
    out = []
    for (i, t), (_, following) in zip(rows, rows[1:] + rows[:1]):
        q = len(t) // 4
        out.append((i, t, t[: len(t) - q] + following[:q], following))
    return out


def check_edited(got, rows):
    plain = plain_edited(rows)
    prints = {t: orderhash.fingerprints([t])[0] for row in plain for t in row[1:]}
    want = [
        (i, len(t), sha(e), prints[t].tobytes().hex(), prints[e].tobytes().hex(), float(np.mean(prints[t] == prints[e])), float(np.mean(prints[t] == prints[f])))
        for i, t, e, f in plain
    ]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    return want


@pytest.mark.parametrize("part_bytes", [orderhash.PART_BYTES, 20_000])
def test_edited_fingerprints(spark, folder, part_bytes):
    documents = table(spark, folder, "documents")
    rows = [tuple(r) for r in documents.select("doc_id", "text").collect()]
    want = check_edited(orderhash.edited_fingerprints(documents.repartition(5), part_bytes=part_bytes).collect(), rows)
    assert np.mean([w[5] for w in want]) > 0.25 and np.mean([w[6] for w in want]) < 0.05


@pytest.mark.parametrize("part_bytes", [orderhash.PART_BYTES, 500])
def test_edited_fingerprints_of_odd_rows(spark, odd, nothing, part_bytes):
    rows = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    check_edited(orderhash.edited_fingerprints(odd, part_bytes=part_bytes).collect(), rows)
    # A third of all rows without key and text, a key with many texts.
    many = [(None, None)] * 70 + [(3, f"text number {k % 40} of one key") for k in range(70)] + [(k, f"own text {k}") for k in range(70)]
    check_edited(orderhash.edited_fingerprints(spark.createDataFrame(many, "doc_id bigint, text string").repartition(4), part_bytes=part_bytes).collect(), many)
    assert orderhash.edited_fingerprints(nothing, part_bytes=part_bytes).count() == 0
    check_edited(orderhash.edited_fingerprints(odd.where("doc_id = 5")).collect(), [r for r in rows if r[0] == 5])


# -- whitening


def plain_whitening(rows):
    x = np.floor(1024 * np.array([v for _, v in rows], np.float32).astype(float)).astype(np.int64) + 100_000
    n, s = len(x), x.sum(0)
    far = [sum((n * int(c) - int(t)) ** 2 for c, t in zip(r, s)) for r in x]
    c = (n * x - s).astype(float) / n
    values, vectors = np.linalg.eigh(c.T @ c / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    k = min(8, int((values > 1e-12 * values[0]).sum()))
    return n, far, c @ vectors[:, :k] / np.sqrt(values[:k]), values[:k] / values.sum()


def check_whitening(got, rows):
    n, far, white, share = plain_whitening(rows)
    k = len(share)
    assert len(got) == k * len(rows)
    got = sorted(got, key=lambda r: (str(r.vec_id), r.deviation, r.component))
    want = sorted(((i, c + 1, n, far[j], white[j, c], share[c]) for j, (i, _) in enumerate(rows) for c in range(k)), key=lambda r: (str(r[0]), r[3], r[1]))
    assert [(r.vec_id, r.component, r.n, r.deviation) for r in got] == [r[:4] for r in want]
    w, v, c = np.array([r.whitened for r in got]), np.array([r[4] for r in want]), np.array([r.component for r in got])
    for j in range(1, k + 1):
        sign = np.sign((w * v)[c == j].sum())
        np.testing.assert_allclose(w[c == j] * sign, v[c == j], rtol=0, atol=1e-9)
    np.testing.assert_allclose([r.explained for r in got], [r[5] for r in want], rtol=1e-9)
    w = np.stack([w[c == j] for j in range(1, k + 1)], 1)
    error = {r.identity_error for r in got}
    assert len(error) == 1 and abs(error.pop() - np.abs(w.T @ w / n - np.eye(k)).max()) < 1e-9


def test_rank_one_updates():
    rng = np.random.default_rng(0)
    for size, n in ((1, 5), (2, 9), (5, 40), (24, 200)):
        x = np.floor(rng.standard_normal((n, size)) @ rng.standard_normal((size, size)) * 300) + 100_000
        one, a, b = (whitening.Spectrum.empty(size) for _ in range(3))
        for row in x:
            one.add_rows(row[None])
        a.add_rows(x[: n // 3])
        b.add_rows(x[n // 3 :])
        a.add(b)
        c = x - x.mean(0)
        m = c.T @ c
        for s in (one, a):
            assert s.n == n and np.abs(s.vectors.T @ s.vectors - np.eye(size)).max() < 1e-12
            assert np.abs(s.vectors * s.values @ s.vectors.T - m).max() < 1e-12 * np.trace(m)
            np.testing.assert_allclose(s.values, np.linalg.eigvalsh(m), rtol=0, atol=1e-12 * np.trace(m))


def test_equal_eigenvalues_are_deflated():
    rng = np.random.default_rng(1)
    for x in (np.repeat(rng.integers(-5, 5, (4, 6)).astype(float), 7, 0), np.eye(6)[np.arange(600) % 6] * 100.0, np.zeros((9, 6))):
        s = whitening.Spectrum.empty(6)
        for row in x:
            s.add_rows(row[None])
        c = x - x.mean(0)
        assert np.abs(s.vectors * s.values @ s.vectors.T - c.T @ c).max() <= 1e-12 * max(1.0, np.trace(c.T @ c))


def test_whitening(spark, folder):
    rows = [(r.vec_id, list(r.embedding)) for r in table(spark, folder, "embeddings").collect()]
    check_whitening(queries.QUERIES["op11_whitening"](spark, folder).collect(), rows)


VECTORS = "vec_id bigint, embedding array<float>, label int"


def test_whitening_with_fewer_ritz_vectors(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = [(i, (rng.standard_normal(24) * 0.7 ** np.arange(24)).tolist(), 1) for i in range(300)]
    monkeypatch.setattr(whitening, "RITZ", 12)
    got = whitening.whiten(spark.createDataFrame(rows, VECTORS).repartition(40)).collect()
    check_whitening(got, [r[:2] for r in rows])


def test_whitening_of_odd_rows(spark):
    bad = [(101, None, 1), (103, [1.0, None, 0.0], 1), (104, [NAN, 0.0, 1.0], 1), (105, [INF, 0.0, 1.0], 1), (106, [], 1), (107, [1.0, 2.0], 1), (108, [3e9, 0.0, 0.0], 1)]
    # Zero vectors and repeated rows take part; one direction does not vary.
    good = [(1, [0.0, 0.0, 0.5], 1), (1, [0.0, 0.0, 0.5], 1), (None, [0.25, -1.0, 0.5], None), (2, [2.0, 1.0, 0.5], 1), (3, [-0.5, 0.125, 0.5], 2)]
    df = with_clashes(spark, bad + good, VECTORS)
    check_whitening(whitening.whiten(df).collect(), [r[:2] for r in good])
    for none in (df.limit(0), df.where("vec_id > 100"), df.where("vec_id = 1"), df.where("vec_id = 2")):
        assert whitening.whiten(none).count() == 0
    # A third of the rows are one vector.
    rng = np.random.default_rng(4)
    hot = [(i, [1.0, 2.0, 3.0], 1) if i % 3 == 0 else (i, rng.standard_normal(3).tolist(), 1) for i in range(300)]
    check_whitening(whitening.whiten(spark.createDataFrame(hot, VECTORS).repartition(30)).collect(), [r[:2] for r in hot])


def test_deviation_beyond_a_long():
    x = np.array([[0, 1 << 40], [5, 0]])
    small, large = whitening.Centre(2, [5, 1 << 40]), whitening.Centre(1 << 30, [5 << 29, 1 << 69])
    assert small.deviation(x) == [None, None]
    assert small.deviation(np.array([[3, 1 << 39]])) == [1]
    assert large.deviation(np.array([[2, 1 << 39]])) == [(2 * (1 << 30) - (5 << 29)) ** 2]
