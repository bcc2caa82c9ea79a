"""Repeated passages by sparse suffix arrays.

1. **Sparse suffixes.**  Of the suffixes of every text those are retained that start at minimisers: in each
   window of ``MIN_WORDS`` words, at the ``ANCHOR`` words with the least hash.  The choice depends on content
   alone, so equal passages of ``MIN_WORDS`` words retain the same suffix.
2. **Sort, compare neighbours.**  Suffixes are range-sorted by their first words (the order within equal first
   words spreads a very frequent passage over many tasks); neighbours that agree are candidates.  The ends
   of each sorted partition count as candidates too, so no comparison crosses tasks.  Copies of a whole text
   are neighbours there and go on as one.
3. **Extend.**  For each candidate the text is followed left and right: every window of ``MIN_WORDS`` words
   that is anchored at it gets a hash.  Candidates with all windows equal are a class; only where a suffix has
   several classes are single windows compared.  All of these are grouped sums and minima.
4. **Cut.**  The first occurrence of a passage, by (doc_id, hash of text, place), stays; the words of every
   later one are cut out.  Later whole copies of a text with ``MIN_WORDS`` words or more are cut wholly.

Windows and texts are compared by 64-bit hashes (windows only within an equal suffix hash).

Defined cases: null and empty texts stay as they are; a shorter text than ``MIN_WORDS`` words is never cut;
a null doc_id comes before all others; rows equal in doc_id and text are one document and are cut alike; a
passage repeated inside one text is cut after its first occurrence; other columns are kept as they are.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changelens.llm.bitmap import Bitmap
from changelens.llm.common import pieces, raw_texts
from changelens.scratch import settle

MIN_WORDS = 50
ANCHOR = 16

_BASE = 0x9E3779B97F4A7C15
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def _grams(words: np.ndarray, length: int) -> np.ndarray:
    """Hash of every run of ``length`` words, put together from runs of powers of two."""
    done, made, power, size = 0, None, words, 1
    while True:
        if length & size:
            tail = power[done:]
            made = tail if made is None else made[: len(tail)] * np.uint64(pow(_BASE, size, 1 << 64)) + tail
            done += size
        if done == length:
            return made
        power = power[:-size] * np.uint64(pow(_BASE, size, 1 << 64)) + power[size:]
        size *= 2


def _scrambled(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def _anchors(text: bytes, min_words: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """Hashes of words, hash of every ``anchor`` words, and for each window the place of its minimiser."""
    words = text.split()
    if len(words) < min_words:
        return None
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    keys = _scrambled(_grams(hashes, anchor))
    width = min_words - anchor + 1
    view = np.lib.stride_tricks.sliding_window_view(keys, width)
    places = np.concatenate([view[low : low + 65536].argmin(axis=1) for low in range(0, len(view), 65536)])
    return hashes, keys, places + np.arange(len(view))


def _suffixes(batches: Iterator[pa.RecordBatch], min_words: int, anchor: int) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, "text"):
        owner, keys, places = [], [], []
        for row, text in enumerate(raw_texts(batch.column("text"))):
            found = _anchors(text, min_words, anchor)
            if found is not None:
                own = np.unique(found[2])
                owner.append(np.full(len(own), row))
                keys.append(found[1][own])
                places.append(own)
        if owner:
            at = pa.array(np.concatenate(owner))
            columns = [pa.array(np.concatenate(keys).view(np.int64)), batch.column("doc_id").take(at), batch.column("text_key").take(at), pa.array(np.concatenate(places).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, ["suffix", "doc_id", "text_key", "place"])


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of sorted suffixes those that agree with a neighbour of another text or place; copies go on as one."""
    kept: pa.RecordBatch | None = None
    flagged = True  # whether the held last row is a candidate already; the first of a partition is
    for batch in batches:
        whole = batch if kept is None else pa.concat_batches([kept, batch])
        columns = [whole.column(c).to_numpy(zero_copy_only=False) for c in ("suffix", "text_key", "place")]
        fresh = np.ones(len(whole), bool)
        fresh[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
        whole = whole.filter(pa.array(fresh))
        suffix = whole.column("suffix").to_numpy()
        same = suffix[1:] == suffix[:-1]
        mark = np.concatenate([[flagged], same]) | np.concatenate([same, [False]])
        if len(whole) > 1:
            yield whole.slice(0, len(whole) - 1).filter(pa.array(mark[:-1]))
        kept, flagged = whole.slice(len(whole) - 1), bool(mark[-1])
    if kept is not None:
        yield kept


def _windows(batches: Iterator[pa.RecordBatch], min_words: int, anchor: int) -> Iterator[pa.RecordBatch]:
    """For each candidate suffix its windows: where the first starts, their hashes, and a hash of them all."""
    for batch in pieces(batches, "text"):
        owner, suffix, kind, first, own = [], [], [], [], []
        wanted = batch.column("places").to_pylist()
        for row, text in enumerate(raw_texts(batch.column("text"))):
            found = _anchors(text, min_words, anchor)
            if found is None:
                continue
            hashes, keys, places = found
            windows = _scrambled(_grams(hashes, min_words))
            for place in sorted(set(wanted[row])):
                low, high = np.searchsorted(places, place), np.searchsorted(places, place, "right")
                part = windows[low:high]
                owner.append(row)
                suffix.append(int(keys[place].view(np.int64)))
                kind.append(xxhash.xxh64_intdigest(part.tobytes(), place - int(low)))
                first.append(int(low))
                own.append(part.view(np.int64))
        if owner:
            at = pa.array(owner)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(x) for x in own])]).astype(np.int32)), pa.array(np.concatenate(own)))
            columns = [batch.column("doc_id").take(at), batch.column("text_key").take(at), pa.array(suffix, pa.int64()), pa.array(np.array(kind, np.uint64).view(np.int64)), pa.array(first, pa.int32()), lists]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_key", "suffix", "kind", "first", "windows"])


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text").withColumn("text_key", F.xxhash64("text"))


def _document() -> Column:
    return F.xxhash64("doc_id", "text_key")


def repeated_windows(docs: DataFrame, min_words: int = MIN_WORDS, anchor: int = ANCHOR) -> DataFrame:
    """Per document with something to cut: doc_id, text_key, ``whole`` (a later copy of a whole text) and
    ``starts``, the places of the windows of ``min_words`` words that occurred before."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    keyed = _keyed(docs)
    # 1, 2: sparse suffixes, sorted; neighbours compared.
    suffixes = settle(keyed.mapInArrow(lambda b: _suffixes(b, min_words, anchor), f"suffix long, doc_id {kind}, text_key long, place int"))
    order = ["suffix", "text_key", "place", "doc_id"]
    ordered = suffixes.repartitionByRange(*order).sortWithinPartitions(*order)
    candidates = settle(ordered.mapInArrow(_neighbours, suffixes.schema))
    # 3: extension over the texts of the candidates.
    wanted = candidates.groupBy("doc_id", "text_key").agg(F.collect_list("place").alias("places"))
    some = keyed.filter(Bitmap(candidates, _document()).may_hold(_document()))
    mine = wanted.select(F.col("doc_id").alias("d"), F.col("text_key").alias("k"), "places")
    texts = some.join(mine, some["doc_id"].eqNullSafe(mine["d"]) & (some["text_key"] == mine["k"])).select("doc_id", "text_key", "text", "places")
    schema = f"doc_id {kind}, text_key long, suffix long, kind long, first int, windows array<long>"
    extended = settle(texts.mapInArrow(lambda b: _windows(b, min_words, anchor), schema))
    place = F.struct("doc_id", "text_key", "first").alias("place")
    classes = settle(extended.groupBy("suffix", "kind").agg(F.count_distinct(place).alias("times"), F.min(place).alias("earliest"), F.any_value("windows").alias("windows")))
    several = classes.groupBy("suffix").agg(F.count("*").alias("classes"))
    classes = classes.join(several, "suffix").filter("classes > 1 OR times > 1")
    alone = classes.filter("classes = 1").select("suffix", "kind", "earliest", F.expr("sequence(0, size(windows) - 1)").alias("repeated"), F.expr("sequence(0, size(windows) - 1)").alias("leading"))
    spread = classes.filter("classes > 1").select("suffix", "kind", "times", "earliest", F.posexplode("windows").alias("offset", "window"))
    spread = settle(spread.withColumn("at", F.struct("earliest.doc_id", "earliest.text_key", (F.col("earliest.first") + F.col("offset")).alias("first"))))
    found = spread.groupBy("suffix", "window").agg(F.sum("times").alias("total"), F.min("at").alias("origin")).filter("total > 1")
    judged = spread.join(found, ["suffix", "window"])
    mixed = judged.groupBy("suffix", "kind").agg(
        F.min("earliest").alias("earliest"),
        F.collect_list("offset").alias("repeated"),
        F.collect_list(F.when(F.col("at") == F.col("origin"), F.col("offset"))).alias("leading"),
    )
    verdict = alone.unionByName(mixed)
    hits = extended.select("doc_id", "text_key", "suffix", "kind", "first").distinct().join(verdict, ["suffix", "kind"])
    leads = F.struct("doc_id", "text_key", "first").eqNullSafe(F.col("earliest"))
    later = F.when(leads, F.array_except("repeated", "leading")).otherwise(F.col("repeated"))
    starts = hits.select("doc_id", "text_key", F.transform(later, lambda x: x + F.col("first")).alias("starts")).filter("size(starts) > 0")
    cut = starts.groupBy("doc_id", "text_key").agg(F.array_distinct(F.flatten(F.collect_list("starts"))).alias("starts"), F.lit(False).alias("whole"))
    # Later copies of whole texts.
    narrow = keyed.filter("text IS NOT NULL").select("doc_id", "text_key").distinct()
    firsts = narrow.groupBy("text_key").agg(F.min(F.struct("doc_id")).alias("least"), F.count("*").alias("copies")).filter("copies > 1")
    later_copies = narrow.join(firsts, "text_key").filter(~F.struct("doc_id").eqNullSafe(F.col("least")))
    whole = later_copies.select("doc_id", "text_key", F.array().cast("array<int>").alias("starts"), F.lit(True).alias("whole"))
    both = cut.unionByName(whole).groupBy("doc_id", "text_key")
    return both.agg(F.flatten(F.collect_list("starts")).alias("starts"), F.max("whole").alias("whole"))


def _spans(starts: list[int], words: int, min_words: int) -> list[tuple[int, int]]:
    """Runs of words under the windows."""
    spans: list[list[int]] = []
    for start in sorted(starts):
        if spans and start <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], start + min_words)
        else:
            spans.append([start, start + min_words])
    return [(a, min(b, words)) for a, b in spans]


def _cut(batches: Iterator[pa.RecordBatch], min_words: int) -> Iterator[pa.RecordBatch]:
    names = None
    for batch in pieces(batches, "text"):
        names = batch.schema.names
        texts, counts, lists = batch.column("text").to_pylist(), [], []
        starts, whole = batch.column("starts").to_pylist(), batch.column("whole").to_pylist()
        for row, raw in enumerate(raw_texts(batch.column("text"))):
            spans: list[tuple[int, int]] = []
            if starts[row] or whole[row]:
                words = [m.span() for m in _WORD.finditer(raw)]
                if whole[row]:
                    spans = [(0, len(words))] if len(words) >= min_words else []
                else:
                    spans = _spans(starts[row], len(words), min_words)
                if spans:
                    kept, at = [], 0
                    for low, high in spans:
                        kept.append(raw[at : words[low][0]])
                        at = words[high][0] if high < len(words) else len(raw)
                    texts[row] = b"".join([*kept, raw[at:]]).decode()
            counts.append(sum(b - a for a, b in spans))
            lists.append([{"start": a, "end": b} for a, b in spans])
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        rest = [c for c in names if c not in ("text", "starts", "whole")]
        columns = [batch.column(c) for c in rest] + [pa.array(texts, pa.string()), pa.array(counts, pa.int64()), pa.array(lists, kind)]
        yield pa.RecordBatch.from_arrays(columns, [*rest, "text", "cut_words", "cut_spans"])


def cut_repeats(docs: DataFrame, min_words: int = MIN_WORDS, anchor: int = ANCHOR) -> DataFrame:
    """Every row with its text after cutting, with ``cut_words`` (how many) and ``cut_spans`` (from which
    word up to which); input columns of these two names are replaced."""
    docs = docs.drop("cut_words", "cut_spans")
    order = docs.columns
    inner = {c: c if c in ("doc_id", "text") else f"other_{i}" for i, c in enumerate(order)}
    docs = docs.toDF(*inner.values())
    found = settle(repeated_windows(docs, min_words, anchor))
    keyed = docs.withColumn("text_key", F.xxhash64("text"))
    held = Bitmap(found, _document()).may_hold(_document())
    mine = found.select(F.col("doc_id").alias("d"), F.col("text_key").alias("k"), "starts", "whole")
    same = keyed["doc_id"].eqNullSafe(mine["d"]) & (keyed["text_key"] == mine["k"])
    touched = keyed.filter(held).join(mine, same, "left").drop("d", "k", "text_key")
    spans = "array<struct<start:int,end:int>>"
    rest = [f for f in docs.schema.fields if f.name != "text"]
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in rest), f"text string, cut_words long, cut_spans {spans}"])
    changed = touched.mapInArrow(lambda b: _cut(b, min_words), schema)
    untouched = keyed.filter(~held).drop("text_key").withColumns({"cut_words": F.lit(0).cast("long"), "cut_spans": F.array().cast(spans)})
    outer = [F.col(inner[c]).alias(c) for c in order]
    return changed.unionByName(untouched).select(*outer, "cut_words", "cut_spans")
