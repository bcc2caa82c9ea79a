"""Operators with exactly defined results, against brute force over the awkward tables."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from changelens.llm import decontaminate, lm_bloom, packing, quality_rules, simhash, suffix_dedup
from changelens.llm.common import prepared
from tests.llm import fixtures

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


@pytest.fixture(scope="module")
def docs(spark):
    prepared(spark)
    return fixtures.documents(spark).repartition(3).cache()


@pytest.fixture(scope="module")
def given(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


def by_key(frame):
    found = defaultdict(list)
    for row in frame.collect():
        found[row.doc_id].append(row)
    return found


def fingerprint(text):
    words = WORD.findall(lowered(text))
    shingles = [" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def least_reachable(prints):
    """Component ids by flooding; ``prints``: list of (doc_id, fingerprint)."""
    left, named = set(range(len(prints))), {}
    while left:
        reached, todo = set(), [left.pop()]
        while todo:
            own = todo.pop()
            reached.add(own)
            near = {k for k in left if (prints[k][1] ^ prints[own][1]).bit_count() <= 4}
            left -= near
            todo += near
        ids = [prints[k][0] for k in reached if prints[k][0] is not None]
        named.update({k: min(ids, default=None) for k in reached})
    return named


def test_simhash_components(docs, given):
    prints = [(d, fingerprint(t)) for d, t in given]
    named = least_reachable(prints)
    expected = sorted((str(d), f"{f:016x}", str(named[k])) for k, (d, f) in enumerate(prints))
    found = simhash.near_duplicates(docs)
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in found.collect()) == expected
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {d for k, (d, _) in enumerate(prints) if d == named[k]}


def test_hamming_balls_find_every_close_pair(spark):
    rng = np.random.default_rng(1)
    own = [int(x) for x in rng.integers(-(2**63), 2**63, 60)]
    for base in own[:20]:
        for bits in (1, 2, 4, 5):
            flipped = base
            for b in rng.choice(64, bits, replace=False).tolist():
                flipped ^= (1 << b) if b < 63 else -(1 << 63)
            own.append(flipped)
    own = sorted(set(own))
    expected = {(a, b) for i, a in enumerate(own) for b in own[i + 1 :] if ((a ^ b) & (2**64 - 1)).bit_count() <= 4}
    for segments in (2, 3, 4):
        found = simhash.close_pairs(spark.createDataFrame([(x,) for x in own], "fp long"), 4, segments)
        assert {(r.a, r.b) for r in found.collect()} == expected


def test_statistics(docs, given):
    found = by_key(quality_rules.statistics(docs))
    for doc_id, text in given:
        words = WORD.findall(text or "")
        places = defaultdict(list)
        for k in range(len(words) - 4):
            places[tuple(words[k : k + 5])].append(k)
        repeated = {k + j for own in places.values() if len(own) > 1 for k in own for j in range(5)}
        lines = [x for x in (text or "").split("\n") if WORD.search(x)]
        expected = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(repeated))
        row = found[doc_id][0]
        assert (row.n_words, row.word_chars, row.n_symbols, row.n_dup_lines, row.n_repeat_words) == expected, doc_id


@pytest.mark.parametrize("block_bytes", [decontaminate.BLOCK_BYTES, 6000])
def test_contamination(spark, docs, given, monkeypatch, block_bytes):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block_bytes)
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = defaultdict(set)
    items = fixtures.benchmark(spark)
    for row in items.collect():
        words = pattern.findall(lowered(row.text))
        width = min(13, len(words))
        for k in range(len(words) - width + 1 if width else 0):
            windows[tuple(words[k : k + width])].add("" if row.item_id is None else str(row.item_id))
    expected = []
    for doc_id, text in given:
        words = pattern.findall(lowered(text))
        hit, names = set(), set()
        for width in {len(w) for w in windows}:
            for k in range(len(words) - width + 1):
                if own := windows.get(tuple(words[k : k + width])):
                    hit |= set(range(k, k + width))
                    names |= own
        digest = hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
        expected.append((str(doc_id), len(words), len(hit), len(names), digest, bool(hit) and 20 * len(hit) >= len(words)))
    found = decontaminate.contamination(docs, items)
    assert sorted((str(r.doc_id), r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in found.collect()) == sorted(expected)
    bad = {e[0] for e in expected if e[5]}
    kept = decontaminate.drop_contaminated(docs, items)
    assert bad and {str(r.doc_id) for r in kept.collect()} == {str(d) for d, _ in given} - bad


def test_longest_match_and_no_benchmark(spark, docs):
    item = " ".join(f"w{k}" for k in range(40))
    own = spark.createDataFrame([(1, f"zz {item} yy"), (2, " ".join(item.split()[5:25]))], "doc_id long, text string")
    found = {r.doc_id: r for r in decontaminate.contamination(own, spark.createDataFrame([(9, item)], "item_id long, text string")).collect()}
    assert (found[1].longest_words, found[1].longest_at, found[1].longest_item) == (40, 1, "9")
    assert (found[2].longest_words, found[2].longest_at) == (20, 0)
    none = decontaminate.contamination(docs, fixtures.empty(fixtures.benchmark(spark)))
    assert none.filter("n_hit > 0 OR contaminated").count() == 0 and none.count() == docs.count()


def _cut_by_hand(given, least=50):
    seen, texts, cut = set(), set(), {}
    order = sorted(given, key=lambda x: (x[0] is not None, x[0] or 0))
    for doc_id, text in order:
        words = WORD.findall(text or "")
        if (doc_id, text) in cut:
            continue
        if text in texts:
            gone = set(range(len(words))) if len(words) >= least else set()
        else:
            texts.add(text)
            gone = set()
            for k in range(len(words) - least + 1):
                key = tuple(words[k : k + least])
                if key in seen:
                    gone |= set(range(k, k + least))
                seen.add(key)
        cut[(doc_id, text)] = [w for k, w in enumerate(words) if k not in gone]
    return cut


def test_repeated_passages(docs, given):
    expected = _cut_by_hand(given)
    found = suffix_dedup.cut_repeats(docs)
    assert found.columns == [c for c in docs.columns if c != "cut_words"] + ["cut_words", "cut_spans"]
    rows = found.collect()
    assert len(rows) == len(given)
    wanted = sorted((str(d), expected[(d, t)]) for d, t in given)
    assert sorted((str(r.doc_id), WORD.findall(r.text or "")) for r in rows) == wanted
    assert sum(r.cut_words for r in rows) > 200
    assert {r.text_key for r in rows} == {"k", None}


def test_packing(docs, given):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    plain = Tokenizer.from_file(path)
    rows = packing.pack(docs, path, window=64, open_windows=3, slack=4).collect()
    ids_of = lambda t: plain.encode(t or "", add_special_tokens=False).ids + [1]
    pieces = defaultdict(list)
    for r in rows:
        ids = np.frombuffer(bytes(r.ids), "<u4").tolist()
        assert r.length == len(ids) and r.ids_crc32 == zlib.crc32(bytes(r.ids))
        pieces[r.doc_id, r.doc_tokens].append((r.start, ids))
    expected = Counter()
    for doc_id, text in given:
        ids = ids_of(text)
        expected.update(((doc_id, len(ids)), k, x) for k, x in enumerate(ids))
    assert Counter((key, start + k, x) for key, own in pieces.items() for start, ids in own for k, x in enumerate(ids)) == expected
    fill = defaultdict(list)
    for r in rows:
        fill[r.sequence_id].append((r.offset, r.length))
    padding = 0
    for own in fill.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 64
        padding += 64 - at if at & (at - 1) else 0
    assert padding <= 0.05 * sum(expected.values())


def test_vocabulary_runs_like_its_own_library(monkeypatch):
    import public_tokenizers
    from hypothesis import given as cases
    from hypothesis import settings
    from hypothesis import strategies as st
    from changelens.llm import tokens

    encoder = tokens.Encoder(public_tokenizers.path("byte_bpe_50k.json"))

    @settings(max_examples=300, deadline=None)
    @cases(st.text(alphabet=" \n\t  \x1c\x85ab'sé1!ñ漢", max_size=30), st.sampled_from([1, 3, 8, 100]))
    def check(text, longest):
        monkeypatch.setattr(tokens, "LONGEST", longest)
        assert encoder.encode([text])[0] == encoder.slowly(text)

    check()
    for text in fixtures.texts():
        assert encoder.encode([text or ""])[0] == encoder.slowly(text or "")


@pytest.mark.parametrize("max_bits", [lm_bloom.MAX_BITS, 20_000])
def test_language_model_baseline(docs, given, max_bits):
    tokens = [(d, (t or "").encode().lower().split() + [None], lm_bloom.is_held_out(d)) for d, t in given]
    counts = Counter(w for _, own, held in tokens if not held for w in own)
    total, known = sum(counts.values()), len(counts)
    expected = sorted((str(d), held, len(own), sum(counts[w] > 0 for w in own), total, round(sum(np.log10((counts[w] + 1) / (total + known + 1)) for w in own), 6)) for d, own, held in tokens)
    rows = lm_bloom.score(docs, max_bits=max_bits).collect()
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in rows) == expected
    assert all(r.score < 0 for r in rows)
    # What was seen in training is likelier under bigrams than under words alone.
    seen = [r for r in rows if not r.held_out and r.n_tokens > 20]
    assert sum(r.score for r in seen) > sum(r.base_score for r in seen)


def test_language_model_equals_a_plain_bigram_model(docs, given):
    """With so many bits that no probe hits by chance, the score is that of quantised counts kept in dictionaries."""
    def quantised(n):
        level = np.frexp(float(n))[1] if n else 0
        return 0.0 if not n else 1.0 if level == 1 else 1.5 * 2.0 ** (level - 1) - 0.5

    tokens = [(d, (t or "").encode().lower().split() + [None], lm_bloom.is_held_out(d)) for d, t in given]
    train = [own for _, own, held in tokens if not held]
    words, pairs = Counter(w for own in train for w in own), Counter(p for own in train for p in zip(["start", *own], own))
    total, seen = sum(words.values()), len(words)
    words["start"] = len(train)
    expected = []
    for doc, own, _ in tokens:
        score = 0.0
        for before, word in zip(["start", *own], own):
            context = quantised(words[before])
            plain = (quantised(words[word]) + 1) / (total + seen + 1)
            score += np.log10((min(quantised(pairs[before, word]), context) + lm_bloom.STRENGTH * plain) / (context + lm_bloom.STRENGTH))
        expected.append((str(doc), round(score, 5)))
    for max_bits in (1 << 30, 1000):
        found = lm_bloom.score(docs, max_bits=max_bits, bits_per_entry=600)
        assert sorted((str(r.doc_id), round(r.score, 5)) for r in found.collect()) == sorted(expected)


def test_a_filter_in_sections_scores_like_a_broadcast_one(docs, monkeypatch):
    monkeypatch.setattr(lm_bloom, "_GRAMS_PER_SECTION", 300)
    monkeypatch.setattr(lm_bloom, "BLOCK_BYTES", 3000)
    whole, dealt = (sorted((str(r.doc_id), r.n_tokens, r.score) for r in lm_bloom.score(docs, max_bits=bits).collect()) for bits in (lm_bloom.MAX_BITS, 1000))
    assert whole == dealt


@pytest.mark.parametrize("sections", [8, 9, 68, 820])
def test_keys_at_the_edge_of_a_section_are_dealt_where_they_are_probed(sections):
    """Some of them lie between the edge and the next multiple of 2^32: a few dozen of all n-grams of 6 GB of text."""
    edges = [(k << 64) // sections for k in range(1, sections)]
    keys = np.unique(np.array([key for e in edges for key in (e - 1, e, e | 0xFFFFFFFF, (e | 0xFFFFFFFF) + 1)], np.uint64))
    cuts = lm_bloom._bounds(keys, sections)
    width = 512
    dealt = np.repeat(np.arange(sections), np.diff(cuts))
    assert (lm_bloom._spots(keys, 1, 0, sections, width) // np.uint64(width) == dealt).all()
    for k in (0, sections // 2, sections - 1):
        own = keys[cuts[k] : cuts[k + 1]]
        sums = np.arange(1, len(own) + 1, dtype=np.uint64)
        group = pa.table({"section": [k], "block": [5], "keys": [lm_bloom._packed(own)], "sums": [lm_bloom._packed(sums)]})
        assert (np.frombuffer(lm_bloom._answer(group, sections, width).column("levels")[0].as_py(), np.uint8) > 0).all()


def test_filter_reads_back_quantised_counts(spark):
    text = " ".join(["a b"] * 37 + ["c d"] * 5 + ["e f"])
    code = lm_bloom.coded(spark.createDataFrame([(2, text)], "doc_id long, text string"))
    table = lm_bloom.build_filter(code, 8, 1 << 13)
    key = lambda a, b: lm_bloom._pair_keys(*(np.array([xxhash.xxh64_intdigest(x)], np.uint64) for x in (a, b)))
    assert [table.counts(key(a, b))[0] for a, b in ((b"a", b"b"), (b"c", b"d"), (b"e", b"f"))] == [47.5, 5.5, 1.0]
    assert sum(table.counts(key(b"a", b"x%d" % k))[0] > 0 for k in range(500)) < 25


def test_empty_tables(spark, docs):
    import public_tokenizers

    none = fixtures.empty(docs)
    assert simhash.near_duplicates(none).count() == 0
    assert suffix_dedup.cut_repeats(none).count() == 0
    assert decontaminate.contamination(none, fixtures.benchmark(spark)).count() == 0
    assert lm_bloom.score(none).count() == 0
    assert packing.pack(none, public_tokenizers.path("byte_bpe_50k.json")).count() == 0
    assert quality_rules.judge(none, fixtures.labels(spark)).count() == 0


def _repeated_ids(spark):
    """Null and repeated ids under different texts; a bad, a benchmark and two near copies among them."""
    rng = random.Random(9)
    x, y, z, clean, leaked = (fixtures.sentence(rng, 60) for _ in range(5))
    rows = [(5, x), (8, x), (5, y), (3, y), (None, z), (None, z), (None, z + "\n"), (None, clean), (None, "bad"), (7, clean + " "), (7, "bad"), (9, leaked), (9, fixtures.sentence(rng, 60)), (None, leaked)]
    return spark.createDataFrame([(d, t, k % 2) for k, (d, t) in enumerate(rows)], "doc_id long, text string, other int").repartition(3), (x, y, z, clean, leaked)


def test_stages_decide_on_rows_not_ids(spark):
    frame, (x, y, z, clean, leaked) = _repeated_ids(spark)
    given = Counter((r.doc_id, r.text) for r in frame.collect())
    none = fixtures.empty(fixtures.labels(spark))
    kept = quality_rules.drop_rejected(frame, none)
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter({k: n for k, n in given.items() if k[1] != "bad"})
    items = spark.createDataFrame([(1, leaked)], "item_id long, text string")
    kept = decontaminate.drop_contaminated(frame, items)
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter({k: n for k, n in given.items() if k[1] != leaked})
    kept = simhash.drop_near_duplicates(frame).select(frame.columns)
    once = Counter(r.text.strip() for r in kept.collect())
    assert once == Counter({t.strip(): 1 for _, t in given})
    ids = {r.text.strip(): r.doc_id for r in kept.collect()}
    assert (ids[x], ids[y], ids[z], ids[clean], ids[leaked], ids["bad"]) == (5, 3, None, 7, 9, 7)


def test_one_row_stays_whatever_its_columns(spark):
    rows = [(1, "a b c d e", 7, {"x": k % 2}, k) for k in range(4)] + [(2, "a b c d e", 8, None, 9), (3, "other words of its own", 1, {}, 0)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, doubled_key int, key map<string,int>, gone_key int").withColumn("row", F.struct("gone_key"))
    kept = simhash.drop_near_duplicates(frame)
    assert kept.columns == frame.columns and sorted(r.doc_id for r in kept.collect()) == [1, 3]
    assert simhash.drop_near_duplicates(fixtures.empty(frame)).count() == 0
