"""The registered queries of this folder, each beside its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ardoise.llm import neighbours, orderhash, packing
from ardoise.llm import pages as web
from ardoise.llm import passages, periods, pieces, pii
from ardoise.llm import quality, textdedup
from ardoise.llm import urls, vectordedup, whitening
from ardoise.llm.common import table

#: Files of the public tokenizers, by name.
PIECES, BYTES = "piece_bpe_32k.model", "byte_bpe_50k.json"


def vocabulary(name: str) -> bytes:
    """The contents of a tokenizer's file, read by the driver and sent with the tasks; a few MB at most."""
    import public_tokenizers

    return Path(public_tokenizers.path(name)).read_bytes()


Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[name] = f
        if oracle is not None:
            ORACLES[name] = oracle
        return f

    return register


URLS_SQL = """
with cut as (
    select page_id, case when strpos(u, '://') > 0 then substr(u, strpos(u, '://') + 3) else '' end rest
    from (select page_id, coalesce(url, '') u from pages)),
parts as (
    select page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') host,
        regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') path
    from cut),
marks as (select doc_id, max(case when quality = 0 or toxic = 1 then 1 else 0 end) bad from labels group by doc_id),
outcomes as (
    select p.*, m.bad from parts p left join marks m
        on m.doc_id = try_cast(regexp_extract(p.path, '/([0-9]{1,18})(?:[./]|$)', 1) as bigint)),
hosts as (
    select host, count(bad) n, coalesce(sum(bad), 0) bad, split_part(host, '.', -1) suffix,
        case when strpos(host, '.') > 0 then split_part(host, '.', -2) || '.' || split_part(host, '.', -1) else host end as domain
    from outcomes group by host),
domains as (select domain, suffix, sum(n) dn, sum(bad) dbad from hosts group by all),
suffixes as (select suffix, sum(dn) sn, sum(dbad) sbad from domains group by all),
whole as (select (coalesce(sum(sbad), 0) + 1.0::double) / (coalesce(sum(sn), 0) + 2.0::double) r from suffixes),
pairs as (
    select 'd' lev, dn::double n, dbad::double bad, sn::double pn, sbad::double pbad from domains join suffixes using (suffix)
    union all
    select 'h', n, bad, dn, dbad from hosts join domains using (domain, suffix)),
sums as (
    select lev, sum(n * power(bad / n - p, 2)) s, sum(v - v * n / pn) noise, sum(v * (n - n * n / pn) - (v - v * n / pn)) room
    from (select *, pbad / pn p, pbad / pn * (1 - pbad / pn) v from pairs where n > 0) group by lev),
rho as (select lev, case when room > 0 then (s - noise) / room else 0 end r from sums),
strength as (
    select coalesce(max(case when lev = 'd' then m end), 1000) md, coalesce(max(case when lev = 'h' then m end), 1000) mh
    from (select lev, least(greatest(case when r > 0 then 1 / r - 1 else 1000 end, 1), 1000) m from rho)),
means as (
    select domain, suffix, (dbad + md * ((sbad + r) / (sn + 1))) / (dn + md) d_mean
    from domains join suffixes using (suffix), strength, whole),
posterior as (
    select host, (bad + mh * d_mean) / (n + mh) mean, n + mh total from hosts join means using (domain, suffix), strength),
method as (
    select host, case when mean - 1.645 * sqrt(mean * (1 - mean) / (total + 1)) > 0.5 then 'block' else 'allow' end verdict
    from posterior),
ruled as (
    select *, case when ('.' || host) like '%.www.example.com' and path like '/en/%' then 'www.example.com/en/'
        when ('.' || host) like '%.example.com' and path like '/en/%' then 'example.com/en/'
        when ('.' || host) like '%.net' and path like '/es/%' then 'net/es/'
        when ('.' || host) like '%.net' and path like '/fr/%' then 'net/fr/'
        when ('.' || host) like '%.com' and path like '/%' then 'com/' end as rule
    from outcomes)
select page_id, host, path, rule,
    case when rule in ('www.example.com/en/', 'com/') then 'allow' when rule is not null then 'block' else verdict end verdict
from ruled join method using (host)
"""


@query("op4_url_filter", URLS_SQL)
def url_filter(spark: SparkSession, folder: str) -> DataFrame:
    """Every page's verdict; a page is bad when the labelled document whose number its path names is poor or toxic."""
    marks = table(spark, folder, "labels").groupBy("doc_id").agg(
        F.max(F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).otherwise(0)).alias("bad")
    )
    number = F.regexp_extract(urls.url_parts(F.col("url"))[1], "/([0-9]{1,18})(?:[./]|$)", 1)
    pages = table(spark, folder, "pages").select("page_id", "url", F.when(number != "", number.cast("long")).alias("doc_id"))
    return urls.judge_urls(pages.join(marks, "doc_id", "left"))


@query("op8_html_text")
def html_text(spark: SparkSession, folder: str) -> DataFrame:
    """The main text of every page."""
    return web.extract_pages(table(spark, folder, "pages"))


@query("op2_sentencepiece")
def sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    """Pieces of every document, decoded again; digests of ids, decoded text and source spans."""
    return pieces.piece_digests(table(spark, folder, "documents"), vocabulary(PIECES))


@query("op3_packing")
def best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    """All documents packed into sequences of 2048 tokens."""
    return packing.pack(table(spark, folder, "documents"), vocabulary(BYTES))


def document_ratings(spark: SparkSession, folder: str) -> DataFrame:
    """Grades of the labelled documents."""
    return table(spark, folder, "labels").select("doc_id", quality.grade().alias("grade"))


@query("op9_quality")
def quality_grades(spark: SparkSession, folder: str) -> DataFrame:
    """Expected grade, probability of the best grade, and decision for every document."""
    documents = table(spark, folder, "documents")
    return quality.fit_grader(documents, document_ratings(spark, folder)).score(documents)


@query("op1_pii")
def personal_data(spark: SparkSession, folder: str) -> DataFrame:
    """Personal data in every document."""
    documents = table(spark, folder, "documents")
    return pii.find_pii(documents, pii.train(documents))


@query("op10_nearest")
def nearest_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """The ten nearest vectors of every hundredth vector."""
    return neighbours.nearest(table(spark, folder, "embeddings"), F.col("id") % 100 == 0)


VECTORS_SQL = """
with recursive v as (
    select vec_id, label, cast(embedding as double[]) e from embeddings
    where label is not null and vec_id is not null and embedding is not null
        and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
links as (
    select a.vec_id a, b.vec_id b from v a join v b on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e)
    where list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e)) / sqrt(list_dot_product(b.e, b.e)) >= 0.93),
reach(a, b) as (select a, b from links union select r.a, l.b from reach r join links l on l.a = r.b),
low as (select a, min(b) c from reach group by a),
n as (select a, count(*) n from links group by a)
select vec_id, coalesce(n.n, 0) n_links, coalesce(least(vec_id, c), vec_id) component_id, coalesce(least(vec_id, c), vec_id) = vec_id kept
from embeddings left join n on n.a = vec_id left join low on low.a = vec_id
"""


@query("op5_vector_dedup", VECTORS_SQL)
def vector_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Links, component and decision of every vector, among vectors of its label."""
    return vectordedup.near_vectors(table(spark, folder, "embeddings"))


NEAR_SQL = """
with recursive w as (
    select doc_id, list_filter(string_split_regex(coalesce(text, ''), '[ \\t\\n\\r\\v\\f]+'), lambda x: x <> '') w from documents),
s as (select doc_id, unnest(list_transform(range(1, greatest(1, len(w) - 4) + 1), lambda i: array_to_string(w[i:i+4], ' '))) x from w where len(w) > 0),
bag as (select doc_id, x, count(*) k from s group by all),
total as (select doc_id, sum(k) t from bag group by all),
pairs as (
    select a.doc_id a, b.doc_id b, sum(least(a.k, b.k)) o from bag a join bag b on a.x = b.x and a.doc_id <> b.doc_id group by all),
links as (
    select a, b from pairs join total p on p.doc_id = a join total q on q.doc_id = b where o * 10 >= 8 * (p.t + q.t - o)),
reach(a, b) as (select a, b from links union select r.a, l.b from reach r join links l on l.a = r.b),
low as (select a, min(b) c from reach group by a),
n as (select a, count(*) n from links group by a)
select doc_id, coalesce(least(doc_id, c), doc_id) class_id, coalesce(n.n, 0) n_links, coalesce(least(doc_id, c), doc_id) = doc_id kept
from documents left join n on n.a = doc_id left join low on low.a = doc_id
"""


@query("op7_near_documents", NEAR_SQL)
def near_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Class, links and decision of every document."""
    return textdedup.near_documents(table(spark, folder, "documents")).drop("h", "g")


@query("op6_repeated_passages")
def repeated_passages(spark: SparkSession, folder: str) -> DataFrame:
    """What repeated strings of 100 bytes take away from every document."""
    return passages.remove_repeats(table(spark, folder, "documents"))


@query("op11_whitening")
def whitening_components(spark: SparkSession, folder: str) -> DataFrame:
    """Whitened coordinates of every vector."""
    return whitening.whiten(table(spark, folder, "embeddings"))


@query("op12_order_minhash")
def order_minhash(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprints of every document and of its edited form."""
    return orderhash.edited_fingerprints(table(spark, folder, "documents"))


@query("op13_periodic_runs")
def periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Periodic runs of words in every document."""
    return periods.run_digests(table(spark, folder, "documents"))
