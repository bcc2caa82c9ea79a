"""Lexical search, hard negatives and record files against brute force over the awkward tables."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from changelens.llm import hard_negatives, lexical_search, records
from changelens.llm.common import prepared
from changelens.llm.queries import word_vocabulary
from changelens.llm.word_pieces import WordEncoder
from changelens.scratch import fresh_path
from tests.llm import fixtures

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


@pytest.fixture(scope="module")
def docs(spark):
    prepared(spark)
    return fixtures.documents(spark).repartition(3).cache()


def terms(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in TERM.findall(text or "")]


def searched(given, items, count):
    """Every item against every document by the definition."""
    texts = [(d, Counter(terms(t))) for d, t in given]
    texts = [(d, c, sum(c.values())) for d, c in texts if c]
    number, total = len(texts), sum(n for _, _, n in texts)
    frequency = Counter(t for _, c, _ in texts for t in c)
    asked = defaultdict(set)
    for item, text in items:
        asked[item] |= set(terms(text))
    found = []
    for item, wanted in asked.items():
        scored = []
        for doc, counts, n in texts:
            m = 100 - 90 + (90 * n * number) // total
            score = sum(
                math.floor(1000 * math.log((2 * number + 2) / (2 * frequency[t] + 1))) * ((10**9 * counts[t]) // (1000 * counts[t] + 8 * m))
                for t in wanted if t in counts
            )
            if score > 0:
                scored.append((-score, doc is None, doc or 0, doc))
        found += [(item, k + 1, doc, -minus) for k, (minus, _, _, doc) in enumerate(sorted(scored, key=lambda s: s[:3])[:count])]
    return sorted(found, key=repr)


@pytest.mark.parametrize("settings", [{}, {"SHARD": 2000, "ITEMS": 2, "PART": 50}])
def test_search(spark, docs, monkeypatch, settings):
    for name, value in settings.items():
        monkeypatch.setattr(lexical_search, name, value)
    items = fixtures.benchmark(spark).withColumn("block", F.lit(5)).withColumn("slots", F.lit("x"))
    expected = searched([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()], 4)
    found = lexical_search.search(docs, items, 4, owners=3)
    assert sorted((tuple(r) for r in found.collect()), key=repr) == expected and len(expected) > 12


def test_search_without_rows(spark, docs):
    items = fixtures.benchmark(spark)
    for given, asked in ((fixtures.empty(docs), items), (docs, fixtures.empty(items)), (docs.filter("text = ''"), items)):
        assert lexical_search.search(given, asked).collect() == []


def vectors(spark, rows=260, dims=11):
    rng = random.Random(3)
    made = []
    for k in range(rows):
        label = rng.choice([0, 0, 0, 1, 2])
        center = [math.sin(label * 7 + d) * 0.2 for d in range(dims)]
        made.append((k, [c + rng.gauss(0, 0.15) for c in center], label, "x", 1))
    made += [(k, made[0][1], 0, "copy", 2) for k in (300, 301, 302, 350)]
    made += [(50, made[50][1], made[50][2], "again", 3), (None, made[3][1], 1, None, None), (400, None, 1, None, None), (401, [0.1] * dims, None, None, None)]
    made += [(402, [float("nan")] * dims, 1, None, None), (403, [float("inf")] + [0.0] * 10, 1, None, None), (404, [None] + [0.1] * 10, 1, None, None)]
    made += [(450, [], 1, None, None), (451, [0.5], 1, None, None), (452, [1.0] * dims, 9, None, None), (500, [-0.9] * dims, 8, None, None)]
    return spark.createDataFrame(made, "vec_id long, embedding array<float>, label int, row string, cell int")


def mined(given, positives, negatives):
    rows = [
        (i, label, [math.floor(256 * float(x)) for x in v]) for i, v, label in given
        if label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    found = []

    def first(scored, count):
        return sorted(scored, key=lambda s: (-s[0], s[1] is None, s[1] or 0))[:count]

    for own, (anchor, label, vector) in enumerate(rows):
        if anchor is None or anchor % 50:
            continue
        scored = [(sum(a * b for a, b in zip(vector, v)), i, kind) for k, (i, kind, v) in enumerate(rows) if k != own]
        for score, positive, _ in first([s for s in scored if s[2] == label], positives):
            fitting = [s for s in scored if s[2] != label and 50 * score <= 100 * s[0] <= 95 * score]
            found += [(anchor, positive, k + 1, i, score, value) for k, (value, i, _) in enumerate(first(fitting, negatives))]
    return sorted(found, key=repr)


@pytest.mark.parametrize("settings", [{}, {"BLOCK": 7, "TOGETHER": 3, "ANCHORS": 2, "LANES": 1}])
def test_hard_negatives(spark, monkeypatch, settings):
    for name, value in settings.items():
        monkeypatch.setattr(hard_negatives, name, value)
    given = vectors(spark).repartition(3)
    expected = mined([(r.vec_id, r.embedding, r.label) for r in given.collect()], 5, 3)
    found = hard_negatives.mine(given, F.col("vec_id") % 50 == 0)
    assert sorted((tuple(r) for r in found.collect()), key=repr) == expected and len(expected) > 20
    for none in (fixtures.empty(given), given.filter("vec_id = 400"), given.filter("vec_id % 50 > 0")):
        assert hard_negatives.mine(none, F.col("vec_id") % 50 == 0).collect() == []


def test_scores_are_exact_at_any_size(spark):
    rng = np.random.default_rng(2)
    for largest in (3, 255, 100_000):
        numbers = rng.integers(-largest, largest + 1, (40, 16))
        numbers[0], numbers[1] = -largest, largest
        bits = int(largest).bit_length() + 1
        planes = np.stack([np.packbits((numbers >> p & 1).astype(np.uint8), axis=1, bitorder="little").T for p in range(bits)])
        tables = hard_negatives.subset_sums(numbers[:9], np.int64)
        assert (hard_negatives.scores(tables, planes) == numbers @ numbers[:9].T).all()
    huge = spark.createDataFrame([(0, [1e30], 1)], "vec_id long, embedding array<float>, label int")
    with pytest.raises(ValueError, match="too large"):
        hard_negatives.mine(huge, F.col("vec_id") == 0)


def odd_texts():
    rng = random.Random(8)
    signs = [" ", "\n", "\t", "\r\n", "\x0b", "\x0c", "\x1c", "\x85", "\xa0", " ", "　", "'s", "'", "a", "B", "é", "é", "̈", "Σ", "ς", "İ", "ß", "7", "٣", "½", "!", "#x", "…", "日本", "𝒳", "<|endoftext|>", "<|startoftext|>", "<|end", "\0", "don't", "I'LL"]
    return ["".join(rng.choice(signs) for _ in range(rng.randint(0, 30))) for _ in range(3000)]


def exact_ids(texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(word_vocabulary())
    return [x.ids for x in tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_remembered_words_give_the_same_numbers(monkeypatch):
    texts = odd_texts() + [t for t in fixtures.texts() if t]
    for remembered in (500_000, 50):
        monkeypatch.setattr(WordEncoder, "REMEMBERED", remembered)
        encoder = WordEncoder(word_vocabulary())
        assert [np.frombuffer(encoder.encode(t.encode()), f"<u{encoder.width}").tolist() for t in texts] == exact_ids(texts)


@pytest.fixture(scope="module")
def written(spark, docs):
    folder = fresh_path(spark, "records")
    records.write(docs, folder, word_vocabulary(), end=2, file_bytes=3000)
    return folder


def test_files_hold_every_document_in_order(spark, docs, written):
    assert records.manifest(spark, written).count() > 4
    given = [(r.doc_id, r.text) for r in docs.collect()]
    found = [tuple(r) for r in records.read(spark, written).orderBy("start").collect()]
    ids = dict(zip(given, exact_ids([t for _, t in given])))
    assert [r[0] for r in found] == sorted((d for d, _ in given), key=lambda d: (d is not None, d))
    digest = sorted((repr(d), len(i) + 1, zlib.crc32(np.array([*i, 2], "<u4").tobytes())) for (d, t), i in ids.items() for _ in range(given.count((d, t))))
    assert sorted((repr(d), n, c) for d, _, n, c in found) == digest
    assert [r[1] for r in found] == np.cumsum([0, *(r[2] for r in found)])[:-1].tolist()
    starts = records.with_starts(records.manifest(spark, written), group=2)
    assert {tuple(r) for r in starts.collect()} == {tuple(r) for r in records.with_starts(records.manifest(spark, written)).collect()}


def test_shuffled_reads_by_the_index(spark, docs, written):
    first = records.read_shuffled(spark, written, seed=1, readers=3).collect()
    again = records.read_shuffled(spark, written, seed=1, readers=3).collect()
    other = records.read_shuffled(spark, written, seed=2, readers=3).collect()
    key = lambda r: (repr(r.doc_id), r.ids)
    assert [key(r) for r in first] == [key(r) for r in again] != [key(r) for r in other]
    assert sorted(map(key, first)) == sorted(map(key, other)) and len(first) == docs.count()


def test_broken_files_are_noticed(tmp_path):
    payload = records._payload(-5, 2, b"\x01\x00\x02\x00")
    whole = records.frame(payload) + records.frame(records._payload(None, 4, b""))
    assert [records._parsed(p)[0] for p in records._frames(pa.BufferReader(whole), len(whole), "x")] == [-5, None]
    for at in range(len(whole)):
        broken = bytearray(whole)
        broken[at] ^= 4
        with pytest.raises(ValueError, match="x"):
            list(records._frames(pa.BufferReader(bytes(broken)), len(whole), "x"))
    with pytest.raises(ValueError, match="ends inside"):
        list(records._frames(pa.BufferReader(whole[:-3]), len(whole), "x"))


def test_no_documents(spark, docs):
    folder = fresh_path(spark, "records")
    records.write(fixtures.empty(docs), folder, word_vocabulary(), end=2)
    assert records.read(spark, folder).collect() == [] and records.index(spark, folder).collect() == []
    assert records.read_shuffled(spark, folder, seed=1, readers=2).collect() == []
