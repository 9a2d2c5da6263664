"""Vectors, urls, pages and the pipeline against plain versions and on odd rows."""

from __future__ import annotations

import numpy as np
import pytest
from clashes import with_clashes
from pyspark.sql import functions as F

import corpus_pipeline
from ardoise.llm import components, neighbours, pages, queries, urls, vectordedup
from ardoise.llm.common import table

NAN, INF = float("nan"), float("inf")
VECTORS = "vec_id bigint, embedding array<float>, label int"
BAD = [(101, None, 1), (102, [0.0] * 4, 1), (103, [1.0, None, 0.0, 0.0], 1), (104, [NAN, 0.0, 0.0, 1.0], 1), (105, [INF, 0.0, 0.0, 1.0], 1), (106, [], 1)]


def near_copies(n, rng):
    out = []
    for i in range(n):
        center = rng.standard_normal(16) if i % 5 == 0 else center  # noqa: F821
        out.append((i, (center + rng.standard_normal(16) * 0.11 * (i % 5)).tolist(), int(rng.integers(0, 2)) if i % 7 else None))
    return out


@pytest.mark.parametrize("block", [vectordedup.BLOCK, 16])
def test_near_vectors(spark, block):
    rng = np.random.default_rng(1)
    rows = near_copies(300, rng) + [(400 + k, [1.0 + 0.001 * k] + [1.0] * 15, 0) for k in range(60)] + [(500, [1.0] * 16, 0)]
    got = {r.vec_id: r for r in vectordedup.near_vectors(spark.createDataFrame(rows, VECTORS), block=block).collect()}
    v = np.array([r[1] for r in rows], np.float32).astype(float)
    ids, label = np.array([r[0] for r in rows]), np.array([-1 if r[2] is None else r[2] for r in rows])
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    link = (unit @ unit.T >= 0.93) & (label[:, None] == label) & (label >= 0)[:, None]
    np.fill_diagonal(link, False)
    low = ids.copy()
    for _ in range(len(ids)):
        low = np.array([min(low[k], low[link[k]].min(initial=10**9)) for k in range(len(ids))])
    for k, i in enumerate(ids):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (link[k].sum(), low[k], low[k] == i)


def test_near_vectors_on_odd_rows(spark):
    rows = [*BAD, (1, [1.0, 0.0, 0.0, 0.0], 1), (2, [2.0, 0.0, 0.0, 0.0], 1), (2, [2.0, 0.0, 0.0, 0.0], 1), (3, [1.0, 0.0], 1), (None, [1.0, 0.0, 0.0, 0.0], 1), (4, [1.0, 0.0, 0.0, 0.0], None)]
    df = with_clashes(spark, rows, VECTORS)
    got = vectordedup.near_vectors(df).collect()
    assert len(got) == len(rows)
    assert {(r.n_links, r.component_id, r.kept) for r in got if r.vec_id in (*range(101, 107), 3, 4)} == {(0, i, True) for i in (*range(101, 107), 3, 4)}
    assert {(r.n_links, r.component_id) for r in got if r.vec_id in (1, 2)} == {(2, 1)}
    assert vectordedup.near_vectors(df.limit(0)).count() == 0


def test_near_vectors_with_one_id_on_many_vectors(spark):
    rng = np.random.default_rng(12)
    rows = []
    for k in range(20):
        v = rng.standard_normal(16)
        rows += [(50, v.tolist(), 1), (3 + k, (v + 0.01).tolist(), 1), (50, (v + 0.02).tolist(), 1)][: 1 + k % 3]
    unit = np.array([np.array(v, np.float32) / np.linalg.norm(v) for _, v, _ in rows])
    link = unit @ unit.T >= 0.93
    ids = np.array([r[0] for r in rows])
    want = sorted((i, int(link[k].sum()) - 1, int(ids[link[k]].min())) for k, i in enumerate(ids.tolist()))
    got = vectordedup.near_vectors(spark.createDataFrame(rows, VECTORS)).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == want
    assert sum(r.kept for r in got) == 20


def test_components_of_a_long_path(spark):
    rng = np.random.default_rng(2)
    order = rng.permutation(60).tolist()
    edges = [(a, b) for a, b in zip(order, order[1:])] + [(100, 101), (102, 101), (7, 7)]
    got = {r.id: r.component for r in components.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(1, 60)}, 101: 100, 102: 100}


def recall(got, ids, v, wanted):
    hits = total = 0
    for q in {r.query_id for r in got}:
        d = np.sqrt(((v - v[ids == q][0]) ** 2).sum(1))
        d[ids == q] = np.inf
        best = np.lexsort((ids, d))[: min(wanted, len(ids) - 1)]
        mine = sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)
        assert [r.rank for r in mine] == list(range(1, len(best) + 1))
        assert all(a.score < b.score or a.score == b.score and a.vec_id < b.vec_id for a, b in zip(mine, mine[1:]))
        for r in mine:
            assert abs(r.score - d[ids == r.vec_id][0]) < 1e-12
        hits += len({r.vec_id for r in mine} & set(ids[best].tolist()))
        total += len(best)
    return hits / total


def test_nearest_recall(spark):
    folder = "/root/testdata/sf0.1"
    rows = table(spark, folder, "embeddings").collect()
    ids, v = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    got = queries.QUERIES["op10_nearest"](spark, folder).collect()
    assert {r.query_id for r in got} == {int(i) for i in ids if i % 100 == 0}
    assert recall(got, ids, v, 10) >= 0.9


def test_nearest_on_odd_rows(spark):
    rows = [*BAD, *[(100 * k, [1.0 * k, 1.0, 0.0, 0.0], None) for k in range(1, 7)], (100, [1.0, 1.0, 0.0, 0.0], None), (None, [1.0] * 4, 0), (700, [1.0] * 3, 0)]
    df = with_clashes(spark, rows, VECTORS)
    got = neighbours.nearest(df, F.col("id") % 100 == 0).collect()
    assert {r.query_id for r in got} == {100, 200, 300, 400, 500, 600}
    two = [(r.vec_id, r.score) for r in sorted(got, key=lambda r: r.rank) if r.query_id == 300]
    assert two == [(200, 1.0), (400, 1.0), (100, 2.0), (100, 2.0), (500, 2.0), (600, 3.0)]
    assert neighbours.nearest(df.limit(0), F.col("id") % 100 == 0).count() == 0


def test_url_parts_and_rules(spark):
    cases = [
        ("http://WWW.Example.COM/en/x?y#z", "www.example.com", "/en/x", "www.example.com/en/", "allow"),
        ("https://a.example.com/en/", "a.example.com", "/en/", "example.com/en/", "block"),
        ("ftp://badexample.com/en/", "badexample.com", "/en/", "com/", "allow"),
        ("http://x.net?/es/", "x.net", "", None, None), ("http://x.net/es/1", "x.net", "/es/1", "net/es/", "block"),
        ("no scheme", "", "", None, None), (None, "", "", None, None), ("http://É.COM/", "É.com", "/", "com/", "allow"),
    ]
    df = spark.createDataFrame([(k, c[0], None) for k, c in enumerate(cases)], "page_id bigint, url string, bad int")
    got = {r.page_id: r for r in urls.judge_urls(df).collect()}
    for k, (_, host, path, rule, verdict) in enumerate(cases):
        assert (got[k].host, got[k].path, got[k].rule) == (host, path, rule)
        assert got[k].verdict == (verdict or "allow")


def test_reputation_shrinks(spark):
    rows = [("bad.example.org", 1)] * 60 + [("good.example.org", 0)] * 300 + [("new.example.org", 1)] + [("other.org", 0)] * 40 + [("none.org", None)]
    got = {r.host: r for r in urls.host_reputation(spark.createDataFrame(rows, "host string, bad int")).collect()}
    assert got["bad.example.org"].verdict == "block" and got["good.example.org"].verdict == "allow"
    assert got["new.example.org"].verdict == "allow" and got["new.example.org"].mean < 1
    assert 0 < got["none.org"].mean < 1 and got["none.org"].n == 0
    assert urls.host_reputation(spark.createDataFrame([], "host string, bad int")).count() == 0


PAGE = """<html><body><header><h1>Site</h1></header><nav class="menu"><a href=/>Home</a></nav><div class="cookie-notice">Cookies!</div>
<div class="content{n}"><article><h2>Title &amp; more</h2><p>First   <b>bold</b>ed text.<p>Second<br>line<script>var a="</p>";</script>
<form><input><button>Send</button></form><div class=ad>Buy</div><section class="comments"><p>A reader comment that is much longer than the whole article is, and longer still, really.</p></section></article></div>
<aside>Side</aside><div id="footer">Foot</div></body></html>"""


def test_page_text():
    assert pages.main_text(PAGE, None) == "Title & more First bolded text. Second line"
    path = pages.best_container(PAGE)[0]
    assert path == "html>body>div.content{n}>article"
    assert pages.main_text("<p>just text</p>", path) == "just text"
    for odd in ("", "<", "<div", "</div></p>", "<script>never closed", "<!-- open", "<p class='x>", "&#0;&bogus;", "a" * 100_000):
        assert isinstance(pages.main_text(odd, "html>body"), str)


@pytest.mark.parametrize(
    "page, text",
    [
        ('<article><p class="ad">Buy now<p>Real text.<p>More.</article>', "Real text. More."),
        ('<article><ul><li class="share">Share<li>Real item<li>Other</ul></article>', "Real item Other"),
        ('<article><ul><li class=promo>Buy<ol><li>x</li></ol></li><li>Real</li></ul></article>', "Real"),
        ('<article><p>One <span class="advert">BUY <span>THIS</span> AD</span> two.</p></article>', "One two."),
        ('<article><p>One <a class="ad" href=x>BUY</p><p>two.</p></article>', "One two."),
        ('<article><section id="social-policy"><p>Policy.</p></section><p>End.</article>', "Policy. End."),
        ('<article><p class="search-term">A term.</p></article>', "A term."),
        ('<article><p>Tick <label for=a>the box</label> twice.</p></article>', "Tick the box twice."),
        ('<article><div class="share-buttons">Tweet</div><pre><span class="comment"># c</span> x=1</pre></article>', "# c x=1"),
        ('<article><p>Text.</p><ul class="related-reading"><li><a href=x>One</a><li><a href=y>Two</a></ul></article>', "Text."),
        ('<article><p class="related-work">Long work that <a href=x>one</a> did.</p></article>', "Long work that one did."),
        ("<html><head><title>T</title><meta name=a><body><div><p>Body.<p>End.", "Body. End."),
        ("<article><table><tr><td class=ad>Buy<td>One<tr><td>Two</table></article>", "One Two"),
        ("<article><dl><dt>T<dd class=promo>Buy<dt>U<dd>Def</dl></article>", "T U Def"),
        ("<article><p>One<select><option>a<option>b</select> two.</p></article>", "One two."),
        ('<div class="a>b"><p>Kept &lt;all&gt;&nbsp;of it</div>', "Kept <all> of it"),
    ],
)
def test_whole_text_of_pages(page, text):
    assert pages.main_text(page, None) == text
    assert pages.main_text(page, pages.best_container(page)[0]) == text


def test_very_deep_pages():
    for tag in ("div", "x", "p", "li", "span class=ad"):
        assert pages.main_text("<p>Start</p>" + f"<{tag}>" * 20_000 + "</q></p>" * 1000, "html").startswith("Start")


def test_pages_on_odd_rows(spark):
    rows = [(1, None, None), (2, "", ""), (3, "http://a.b/", PAGE.replace("{n}", "7")), (3, "http://a.b/", PAGE.replace("{n}", "8")), (None, "x", "<p>hi</p>"), (5, "http://a.b/", "<nav>menu</nav>")]
    df = with_clashes(spark, rows, "page_id bigint, url string, html string")
    got = sorted((r.page_id or 0, r.text, r.n_chars) for r in pages.extract_pages(df).collect())
    want = "Title & more First bolded text. Second line"
    assert got == [(0, "hi", 2), (1, "", 0), (2, "", 0), (3, want, len(want)), (3, want, len(want)), (5, "", 0)]
    assert pages.extract_pages(df.limit(0)).count() == 0


def test_page_texts_hold_their_documents(spark, folder):
    got = queries.QUERIES["op8_html_text"](spark, folder)
    number = F.regexp_extract("url", "/([0-9]+)", 1).cast("long")
    both = got.join(table(spark, folder, "documents").select(F.col("doc_id"), F.col("text").alias("d")), F.col("doc_id") == number)
    rows = both.collect()
    assert rows and all(" ".join(r.d.split()) in r.text for r in rows)


def test_pipeline_stages(spark, folder):
    docs = table(spark, folder, "documents")
    before = {r.doc_id: r for r in docs.collect()}
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        new = stage(spark, docs, folder)
        assert new.columns == docs.columns
        rows = {r.doc_id: r for r in new.collect()}
        assert set(rows) <= set(before) and (k < 2 or set(rows) == set(before))
        if k == 3:
            assert not any("@mail" in (r.text or "") for r in rows.values())
        before = rows
        docs = spark.createDataFrame(list(rows.values()), docs.schema)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, folder)
    assert {r.doc_id for r in packed.collect()} == set(before)


def test_pipeline_on_nothing(spark, folder):
    docs = table(spark, folder, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
    assert docs.count() == 0


def test_every_query_reads_whole_tables(spark, folder):
    documents, vectors = table(spark, folder, "documents").count(), table(spark, folder, "embeddings").count()
    for name, rows in (("op7_near_documents", documents), ("op9_quality", documents), ("op5_vector_dedup", vectors)):
        assert queries.QUERIES[name](spark, folder).count() == rows
