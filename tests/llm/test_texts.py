"""Text operators against plain versions and on odd rows."""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ardoise.llm import anchors, packing, passages, pieces, pii, quality, queries, suffixes, textdedup
from ardoise.llm.common import table

MODEL = Path(public_tokenizers.path(queries.PIECES)).read_bytes()
VOCABULARY = Path(public_tokenizers.path(queries.BYTES)).read_bytes()


def sha(x: bytes) -> str:
    return hashlib.sha256(x).hexdigest()


def texts_of(spark, folder):
    return {r.doc_id: r.text or "" for r in table(spark, folder, "documents").select("doc_id", "text").collect()}


# Personal data


FORMS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    found = [(m.start(), m.end(), k) for k in pii.KINDS for m in re.finditer(FORMS[k], text) if pii.holds(k, m[0])]
    return sorted(found, key=lambda x: (x[0], pii.KINDS.index(x[2])))


def test_base_spans_equal_the_plain_forms():
    rng = np.random.default_rng(1)
    signs = list("a.@0123459+- ()é%_") + ["4111 1111 1111 1111", "+1 (555) 123-4567", "10.0.0.255", "joe@mail.example.com"]
    for _ in range(8000):
        text = "".join(rng.choice(signs, rng.integers(0, 30)))
        assert pii.base_spans(text) == plain_spans(text), text


def test_personal_data_query(spark, folder):
    got = {r.doc_id: r for r in queries.QUERIES["op1_pii"](spark, folder).collect()}
    for i, text in texts_of(spark, folder).items():
        base = [f"{k}:{s}:{e}" for s, e, k in plain_spans(text)]
        assert got[i].base_sha256 == sha(",".join(base).encode())
        assert not set(base) - set(got[i].spans.split(","))
        assert [got[i][f"n_{k}"] for k in pii.KINDS] == [sum(b.startswith(f"{k}:") for b in base) for k in pii.KINDS]


def test_trees_add_and_printed_trees_read_back(spark):
    rows = [(i, f"mail joe{i}@mail{i % 7}.example.com or call +1 ({200 + i % 700}) 555-{i % 9000 + 1000} from 10.1.{i % 250}.7") for i in range(400)]
    trees = pii.train(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert trees is not None and len(trees.trees) == pii.TREES
    text = "call (219) 555-0563 now"
    found = pii.add_spans(text, pii.base_spans(text), trees)
    assert all(0 <= s < e <= len(text) for s, e, _ in found)
    nodes = pii.parse_tree("Tree\n  If (feature 3 <= 0.5)\n   Predict: -1.0\n  Else (feature 3 > 0.5)\n   If (feature 0 <= 2.0)\n    Predict: 0.5\n   Else (feature 0 > 2.0)\n    Predict: 1.5\n")
    t = pii.Trees([nodes], [2.0], {})
    assert [t.margin([a, 0, 0, b]) for a, b in ((0, 0), (1, 1), (3, 1))] == [-2.0, 1.0, 3.0]


def test_personal_data_on_odd_rows(spark, odd, nothing):
    assert pii.find_pii(odd, None).count() == odd.count()
    assert all(r.spans == "" for r in pii.find_pii(odd, None).collect())
    assert pii.train(nothing) is None and pii.find_pii(nothing, None).count() == 0
    out = pii.redact(spark.createDataFrame([(1, "to a@b.c, 10.0.0.1"), (2, None)], "doc_id bigint, text string"), None)
    assert sorted((r.doc_id, r.text) for r in out.collect()) == [(1, "to <email>, <ip>"), (2, None)]


# SentencePiece


def test_pieces_query(spark, folder):
    model = sentencepiece.SentencePieceProcessor(model_proto=MODEL)
    texts = texts_of(spark, folder)
    got = queries.QUERIES["op2_sentencepiece"](spark, folder).collect()
    assert len(got) == len(texts)
    for r in got:
        proto = model.encode(texts[r.doc_id], return_type="proto").pieces
        ids = [p.id for p in proto]
        assert r.n_tokens == len(ids) and r.ids_sha256 == sha(",".join(map(str, ids)).encode())
        assert r.decoded_sha256 == sha(model.decode(ids).encode())
        assert r.spans_sha256 == sha(np.array([[p.begin, p.end] for p in proto], "<i4").reshape(-1, 2).tobytes())


def test_pieces_on_odd_rows(spark, odd, nothing):
    model = sentencepiece.SentencePieceProcessor(model_proto=MODEL)
    got = pieces.encode_pieces(odd, MODEL).collect()
    want = Counter((i, tuple(model.encode(t or ""))) for i, t in [(r.doc_id, r.text) for r in odd.collect()])
    assert Counter((r.doc_id, tuple(r.ids)) for r in got) == want
    assert pieces.piece_digests(nothing, MODEL).count() == 0


def double_array(rules: dict[bytes, int]) -> bytes:
    """A double array of byte strings, as character maps have it."""
    tree: dict = {}
    for key, value in rules.items():
        node = tree
        for b in key:
            node = node.setdefault(b, {})
        node[-1] = value
    units, used = defaultdict(int), set()

    def place(node: dict, at: int) -> None:
        labels = [0 if k == -1 else k for k in node]
        base = next(b for b in range(1, 1 << 20) if all((b ^ c) not in used and (b ^ c) != 0 for c in labels) and (b ^ at) < 1 << 21)
        used.update(base ^ c for c in labels)
        units[at] = units[at] & 0x800000FF | (base ^ at) << 10 | (256 if -1 in node else 0)
        for k, below in node.items():
            if k == -1:
                units[base] = below | 1 << 31
            else:
                units[base ^ k] = k
        for k, below in node.items():
            if k != -1:
                place(below, base ^ k)

    used.add(0)
    place(tree, 0)
    n = (max(units) | 255) + 1
    return struct.pack(f"<{n}I", *(units[i] for i in range(n)))


@pytest.mark.parametrize("squeeze", [False, True])
def test_character_map_follows_the_library(squeeze):
    rules = {"ﬁ": "fi", "Ａ": "A", "①": "1", "１": "1", "½": "1/2", " ": " ", "　": " ", "Á": "Á", "A": "a", "​": "", "\t": " "}
    blob, places = b"", {}
    for k, v in rules.items():
        places[k.encode()] = len(blob)
        blob += v.encode() + b"\0"
    trie = double_array(places)
    charsmap = struct.pack("<I", len(trie)) + trie + blob
    model = MODEL + pieces.submessage(3, pieces.submessage(2, charsmap) + bytes([0x18, 1, 0x20, int(squeeze), 0x28, 1]))
    library, own = sentencepiece.SentencePieceProcessor(model_proto=model), pieces.Encoder(model)
    rng = np.random.default_rng(3)
    signs = [*rules, "b", "é", " ", "  ", "word", "😀", "́", "\n"]
    for n in range(600):
        text = "".join(rng.choice(signs, rng.integers(0, 14)))
        ((ids, spans),) = own.encode([text])
        proto = library.encode(text, return_type="proto").pieces
        assert ids.tolist() == [p.id for p in proto], text
        assert spans.tolist() == [[p.begin, p.end] for p in proto], text


# Packing


def test_packing_query(spark, folder):
    library = Tokenizer.from_str(VOCABULARY.decode())
    want = {i: [*library.encode(t, add_special_tokens=False).ids, 0] for i, t in texts_of(spark, folder).items()}
    got = queries.QUERIES["op3_packing"](spark, folder).collect()
    rows, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        rows[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    for i, ids in want.items():
        parts = sorted(rows[i], key=lambda r: r.piece)
        assert [r.piece for r in parts] == list(range(len(parts))) and all(r.length == 2048 for r in parts[1:])
        done = 0
        for r in parts:
            assert r.start == done and r.ids_crc32 == zlib.crc32(np.array(ids[done : done + r.length], "<u4").tobytes())
            done += r.length
        assert done == len(ids)
    for held in sequences.values():
        held.sort()
        assert [o for o, _ in held] == list(np.cumsum([0] + [n for _, n in held])[:-1]) and sum(n for _, n in held) <= 2048
    assert len(sequences) <= -(-sum(map(len, want.values())) // 2048) * 1.01 + 1


def test_plan_uses_every_piece_once():
    rng = np.random.default_rng(5)
    for n in (0, 1, 3, 400):
        count = [0, *rng.integers(0, 3, 60).tolist()] if n else [0] * 61
        made = packing.plan(count, 60)
        used = Counter()
        for pattern, times in made:
            assert 0 < sum(pattern.elements()) <= 60 and times > 0
            for k, c in pattern.items():
                used[k] += c * times
        assert used == Counter({k: c for k, c in enumerate(count) if c})


def test_tokens_follow_the_library():
    library, own = Tokenizer.from_str(VOCABULARY.decode()), packing.tokens(VOCABULARY)
    rng = np.random.default_rng(6)
    signs = [" ", "  ", "\n", "\t", "a", "don't", "é", "😀", "12", ".", " ", "　", "<|endoftext|>", "日本"]
    for _ in range(3000):
        text = "".join(rng.choice(signs, rng.integers(0, 12)))
        assert np.frombuffer(own.ids(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_packing_on_odd_rows(odd, nothing):
    got = packing.pack(odd, VOCABULARY).collect()
    assert sum(r.piece == 0 for r in got) == odd.count()
    assert next(r.length for r in got if r.doc_id == 1) == 1
    assert packing.pack(nothing, VOCABULARY).count() == 0


# Repeated passages


def plain_removed(rows, length):
    seen, out = set(), {}
    for i, text in sorted(rows):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for s in range(len(data) - length + 1):
            w = data[s : s + length]
            if w in seen:
                gone[s : s + length] = b"\1" * length
            seen.add(w)
        spans = sum(gone[k] and not (k and gone[k - 1]) for k in range(len(gone)))
        out[i] = (len(data), sum(gone), spans, sha(bytes(b for b, g in zip(data, gone) if not g)))
    return out


@pytest.mark.parametrize("many", [passages.MANY, 3])
def test_repeated_passages(spark, folder, many):
    documents = table(spark, folder, "documents")
    got = {r.doc_id: tuple(r)[1:] for r in passages.remove_repeats(documents, many=many).collect()}
    assert got == plain_removed(texts_of(spark, folder).items(), 100)


def test_repeated_passages_made_hard(spark):
    rng = np.random.default_rng(8)
    passage = ["".join(rng.choice(list("abc é"), 130)) for _ in range(4)]
    rows = [(i, "".join(rng.choice([*passage, *(p[k : k + 110] for p in passage for k in (0, 9, 20)), "aaaa" * 40, "xyz"], 4))) for i in range(150)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(7)
    got = {r.doc_id: tuple(r)[1:] for r in passages.remove_repeats(df).collect()}
    assert got == plain_removed(rows, 100)
    left = {r.doc_id: r.text for r in passages.kept_texts(df).collect()}
    for i, text in left.items():
        assert len(text.encode()) <= got[i][0] - got[i][1]


def test_repeated_passages_on_odd_rows(odd, nothing):
    got = passages.remove_repeats(odd).collect()
    assert len(got) == odd.count() and len({tuple(r) for r in got if r.doc_id == 6}) == 1
    long = next(r for r in got if r.doc_id == 4)
    assert long.n_removed > 199_000 and long.n_spans == 1
    assert passages.remove_repeats(nothing).count() == 0
    assert passages.kept_texts(odd).columns == odd.columns and passages.kept_texts(nothing).count() == 0


@pytest.mark.parametrize("many", [passages.MANY, 0])
def test_repeated_passages_of_texts_with_one_short_hash(spark, many):
    rng = np.random.default_rng(16)
    passage, other = ("".join(rng.choice(list("abcdefgh"), 160)) for _ in range(2))
    made = spark.range(200_000).withColumn("t", F.concat(F.lpad(F.col("id").cast("string"), 8, "0"), F.when(F.col("id") % 2 == 0, passage).otherwise(other)))
    one = made.groupBy(F.hash("t")).agg(F.min("id").alias("a"), F.max("id").alias("b")).where("(a + b) % 2 = 1").orderBy("a").first()
    texts = [r.t for r in made.where(F.col("id").isin(one.a, one.b)).collect()]
    for key in (None, 7):
        # The passage stands earlier, the other text nowhere else.
        rows = [(1 if key else None, "before " + passage), (key, texts[0]), (key, texts[1])]
        df = spark.createDataFrame(rows, "doc_id bigint, text string")
        got = passages.remove_repeats(df, many=many).where("n_bytes = 168").collect()
        left = [r.text for r in passages.kept_texts(df, many=many).collect()]
        clean = next(t for t in texts if other in t)
        assert clean in left and sha(clean.encode()) in {r.kept_sha256 for r in got}
        assert sum(r.n_removed > 0 for r in passages.remove_repeats(df, many=many).collect()) == 1


@pytest.mark.parametrize("many", [passages.MANY, 0])
def test_repeated_rows_are_read_once(spark, many):
    rng = np.random.default_rng(5)
    common, other = ("".join(rng.choice(list("abcdefgh"), 300)) for _ in range(2))
    hot = "hot " + common + " end " + common[:150]
    # A null key with one text on a third of the rows, and one key on several texts and copies.
    rows = [(None, hot)] * 300 + [(i % 50, f"{i % 100} " + other + common[i % 100 : i % 100 + 150]) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(7)
    ids = passages._keyed(df, "doc_id", "text")
    assert passages._once(ids).count() == 101 == passages._once(ids).distinct().count()
    # The plain version over different rows, under keys that order them as key and tie do.
    order = [(r.id, r.tie, r.text) for r in ids.distinct().orderBy("id", "tie").collect()]
    plain = plain_removed([(k, t) for k, (_, _, t) in enumerate(order)], 100)
    want = Counter((None if i == passages.NULL else i, *plain[k]) for k, (i, _, t) in enumerate(order) for _ in range(300 if i == passages.NULL else 6))
    assert Counter(tuple(r) for r in passages.remove_repeats(df, many=many).collect()) == want
    left = passages.kept_texts(df, many=many)
    assert Counter((r.doc_id, sha(r.text.encode())) for r in left.collect()) == Counter((x[0], x[-1]) for x in want.elements())


def test_suffix_arrays():
    rng = np.random.default_rng(9)
    for _ in range(600):
        text = rng.integers(0, rng.choice([1, 2, 6]) + 1, rng.integers(1, 60)).astype(np.uint8)
        data, hashes = text.tobytes(), anchors.Hashes(text)
        array = suffixes.suffix_array(text, hashes)
        want = sorted(range(len(data)), key=lambda i: data[i:])
        assert array.tolist() == want
        shared = suffixes.common_prefixes(text, array, hashes, np.zeros(0, int))
        for k in range(1, len(data)):
            a, b = data[want[k - 1] :], data[want[k] :]
            assert shared[k] == next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


# Near duplicates


def plain_links(rows, limit=0.8):
    bags = {}
    for i, text in rows:
        w = re.split(r"[ \t\n\r\v\f]+", (text or "").strip(" \t\n\r\v\f"))
        w = [x for x in w if x]
        bags[i] = Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else Counter()
    links, above = Counter(), {i: i for i in bags}

    def top(i):
        while above[i] != i:
            i = above[i]
        return i

    ids = sorted(bags)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            both = sum((bags[a] & bags[b]).values())
            if both and both >= limit * (sum(bags[a].values()) + sum(bags[b].values()) - both):
                links[a] += 1
                links[b] += 1
                x, y = sorted((top(a), top(b)))
                above[y] = x
    return {i: (top(i), links[i]) for i in ids}


@pytest.mark.parametrize("block", [textdedup.BLOCK, 8])
def test_near_documents(spark, folder, block):
    rng = np.random.default_rng(10)
    base = [str(x) for x in rng.integers(0, 400, 90)]
    copies = []
    for i in range(60):
        words = list(base)
        for k in rng.integers(0, 90, rng.integers(0, 4)):
            words[k] = f"n{i}"
        copies.append((10_000 + i, " ".join(words)))
    rows = [*list(texts_of(spark, folder).items())[:120], *copies, (20_000, copies[0][1])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: (r.class_id, r.n_links) for r in textdedup.near_documents(df, block=block).collect()}
    assert got == plain_links(rows)


def test_near_documents_on_odd_rows(odd, nothing):
    got = textdedup.near_documents(odd).collect()
    assert len(got) == odd.count()
    assert {r.class_id for r in got if r.doc_id in (6, 7)} == {6} and [r.n_links for r in got if r.doc_id == 7] == [2]
    assert all(r.kept and r.n_links == 0 for r in got if r.doc_id in (1, 2, 3, None))
    left = textdedup.one_of_each(odd)
    assert left.columns == odd.columns and sorted(r.doc_id or 0 for r in left.collect()) == [0, 1, 2, 3, 4, 5, 6, 8]
    assert textdedup.near_documents(nothing).count() == 0 and textdedup.one_of_each(nothing).count() == 0


@pytest.mark.parametrize("block", [textdedup.BLOCK, 8])
def test_near_documents_with_one_key_on_many_texts(spark, block):
    rng = np.random.default_rng(14)
    groups = [[str(x) for x in rng.integers(0, 400, 90)] for _ in range(30)]
    rows = []
    for k, base in enumerate(groups):
        rows += [(50, " ".join(base)), (3 + k, " ".join([*base[:-1], "other"])), (50, " ".join([*base[:-1], "again"]))][: 1 + k % 3]
    rows += [(2, rows[1][1]), (50, rows[4][1])]
    want = plain_links(list(enumerate(t for _, t in rows)))
    least = {}
    for n, (top, _) in want.items():
        least[top] = min(least.get(top, 10**9), rows[n][0])
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = textdedup.near_documents(df, block=block).select("doc_id", "class_id", "n_links").collect()
    assert Counter(map(tuple, got)) == Counter((rows[n][0], least[top], links) for n, (top, links) in want.items())
    left = {(r.doc_id, r.text) for r in textdedup.one_of_each(df, block=block).collect()}
    assert Counter(want[rows.index(r)][0] for r in left) == Counter(least.keys())


def test_signatures_are_unbiased():
    rng, error = np.random.default_rng(11), []
    for _ in range(120):
        a = rng.integers(0, 9, 80)
        b = np.where(rng.random(80) < 0.7, a, rng.integers(0, 30, 80))
        key, has = np.tile(rng.integers(0, 2**63, 80).astype(np.uint64), 2), np.concatenate([a, b])
        text = np.repeat([0, 1], 80)
        best = textdedup.bag_minhash(text[has > 0], key[has > 0], has[has > 0], 2, 512)
        error.append((best[0] == best[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum())
    assert abs(np.mean(error)) < 4 * np.std(error) / np.sqrt(len(error))


# Quality


def test_quality_on_held_out_ratings(spark):
    folder = "/root/testdata/sf0.1"
    documents, ratings = table(spark, folder, "documents"), queries.document_ratings(spark, folder)
    held = ratings.where("pmod(xxhash64(doc_id), 4) = 0")
    grader = quality.fit_grader(documents, ratings.where("pmod(xxhash64(doc_id), 4) > 0"))
    got = grader.score(documents.join(held.select("doc_id"), "doc_id", "left_semi")).join(held, "doc_id").toPandas()
    assert got[got.grade == 2].keep.mean() > 0.98
    assert got[got.grade == 0].keep.mean() < 0.1 and got[got.grade == 1].keep.mean() < 0.6
    means = got.groupby("grade").expected_grade.mean()
    assert means[0] < means[1] < means[2]
    assert (np.diff(grader.thresholds) >= 0).all()


def test_quality_learns_rare_telling_words(spark):
    rng = np.random.default_rng(15)
    rows = []
    for i in range(800):
        words = [f"w{k}" for k in "abcdefghij"[:2]] + [chr(97 + a) + chr(97 + b) + "x" for a, b in rng.integers(0, 20, (60, 2))]
        if i % 10 == 0:
            words += ["bad" + "abcdefghij"[k] for k in rng.choice(10, 3, False)]
        rows.append((i, " ".join(words), 1 if i % 10 == 0 else 2))
    df = spark.createDataFrame(rows, "doc_id bigint, text string, grade int")
    grader = quality.fit_grader(df, df.where("doc_id < 400").select("doc_id", "grade"))
    got = grader.score(df).where("doc_id >= 400").join(df, "doc_id").toPandas()
    assert got[got.grade == 1].keep.mean() < 0.3 and got[got.grade == 2].keep.mean() > 0.95


def test_quality_on_odd_rows(spark, odd, nothing):
    ratings = spark.createDataFrame([(1, 0), (2, None), (None, 1), (4, 2), (4, 1), (5, 2)], "doc_id bigint, grade int")
    grader = quality.fit_grader(odd, ratings)
    got = grader.score(odd).collect()
    assert len(got) == odd.count() and all(0 <= r.p_top <= 1 and 0 <= r.expected_grade <= 2 for r in got)
    assert odd.where(grader.keeps(odd.text)).count() == sum(r.keep for r in got)
    none = quality.fit_grader(odd, ratings.where("grade = 2"))
    assert all(r.keep and r.p_top == 1 and r.expected_grade is None for r in none.score(odd).collect())
    assert quality.fit_grader(nothing, ratings).score(nothing).count() == 0


def test_the_sample_of_texts_is_bounded(spark):
    n = 60_000
    ids = F.when(F.col("id") % 3 == 0, F.lit(None)).when(F.col("id") % 3 == 1, F.lit(7)).otherwise(F.col("id"))
    own = spark.range(n).select(ids.alias("doc_id"), F.concat(F.lit("text "), F.col("id")).alias("text"))
    # Texts of their own under no key, one key, and many keys: all are sampled alike.
    got = pii.sample(own, "doc_id", "text", 2_000).count()
    assert 1_700 < got < 2_300
    # One text on two thirds of the rows, once without a key and once under one: two texts at most.
    same = own.withColumn("text", F.when(F.col("doc_id").isNull() | (F.col("doc_id") == 7), F.lit("one")).otherwise(F.col("text")))
    assert pii.sample(same, "doc_id", "text", 2_000).count() < 900
    assert pii.sample(same, "doc_id", "text", n).count() == n // 3 + 2


def test_the_examples_are_bounded(spark, monkeypatch):
    one = " ".join(f"mail a{k}@b.org or +33 1 22 33 {k % 90 + 10} 55" for k in range(3_000))
    monkeypatch.setattr(pii, "MOST_EXAMPLES", 3_000)
    seen, fit = [], pii.GBTClassifier.fit
    monkeypatch.setattr(pii.GBTClassifier, "fit", lambda self, rows: (seen.append(rows.count()), fit(self, rows))[1])
    trees = pii.train(spark.createDataFrame([(1, one), (2, one), (None, one)], "doc_id bigint, text string"))
    assert trees is not None and 500 < seen[0] < 3_600


def test_all_documents_give_examples(spark, monkeypatch):
    n = 21_000
    docs = spark.range(n).selectExpr("id as doc_id", "concat('mail a', id, '@b.org or +33 1 22 33 ', id % 90 + 10, ' 55') as text")
    docs = docs.unionByName(docs.where("doc_id < 500"))  # copies count once
    lists = {"h": list(range(n)), "text": [f"mail a{k}@b.org or +33 1 22 33 {k % 90 + 10} 55" for k in range(n)]}
    want = sum(b["half"].to_pylist().count(0) for b in pii._examples(iter([pa.RecordBatch.from_pydict(lists)])))
    monkeypatch.setattr(pii, "MOST_EXAMPLES", 3_000)
    seen, fit = [], pii.GBTClassifier.fit
    monkeypatch.setattr(pii.GBTClassifier, "fit", lambda self, rows: (seen.append(rows.agg(F.sum("weight"), F.count("*")).first()), fit(self, rows))[1])
    assert pii.train(docs) is not None
    assert seen[0][0] == want and seen[0][1] <= 3_000


def test_a_task_gives_its_memory_back(spark):
    """Freed memory of a worker process goes back when its task is done, whoever held it."""

    def run(it):
        from ardoise.llm.common import release

        def size() -> int:
            return int(Path("/proc/self/statm").read_text().split()[1]) >> 8  # MB of 4 KB pages

        rows = sum(b.num_rows for b in it)
        held = [bytes(50_000 + k % 7) for k in range(4_000)]
        pin, held = held[-1], held[:-1]
        full = size()
        del held
        release()
        yield pa.RecordBatch.from_pydict({"rows": [rows], "back": [full - size() + 0 * len(pin)]})

    assert spark.range(10).coalesce(1).mapInArrow(run, "rows bigint, back bigint").first()["back"] > 120


def test_kept_texts_of_missing_and_empty_ones(spark):
    long = "".join(hashlib.md5(str(k).encode()).hexdigest() for k in range(12))
    df = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (3, long + "é", "c"), (4, "é" + long, "d"), (None, None, "e")], "doc_id bigint, text string, x string")
    got = {r["x"]: r["text"] for r in passages.kept_texts(df).collect()}
    assert got == {"a": None, "b": "", "c": long + "é", "d": "é", "e": None}
