"""Benchmark decontamination with suffix arrays over the training texts.

The documents are cut into shards (slices of Arrow batches).  A shard becomes one sequence of word numbers,
its suffixes are sorted, and every benchmark suffix is looked up by binary search.  Only words of the
benchmark get numbers; a suffix that cannot agree with any benchmark window, because too few of its first
words are benchmark words, can never be found and is left out of the array before sorting.  Ranges found in
the array are the verbatim occurrences; runs of them along one item give the longest matches.

The benchmark is the stated query set.  It is sent to the tasks in blocks of at most ``BLOCK_BYTES`` bytes,
one pass over the documents for each block, so what is broadcast has a fixed bound.

Defined cases: words are ASCII letters, digits and all characters beyond ASCII, A-Z lower-cased; a null text
has no words; an item of fewer words than the window is one window of its whole length, one without words is
nothing; items of equal text are all reported; rows of one doc_id are each judged; a null doc_id is kept;
other columns are ignored; with an empty benchmark nothing is hit.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changelens.llm.bitmap import row_id, without
from changelens.llm.common import pieces, raw_texts, starts_of
from changelens.scratch import settle

WINDOW = 13
#: Bytes that the windows and words of a block of items take at most (an item alone may take more), and what a word
#: takes as a window and as an entry of the word list.
BLOCK_BYTES = 96 << 20
_WINDOW_BYTES, _ENTRY_BYTES = 65, 140

_TO_WORDS = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256)
)


def split_words(text: bytes) -> list[bytes]:
    return text.translate(_TO_WORDS).split()


class Needles:
    """The sorted windows of some benchmark items, and where each comes from: items and places as flat arrays."""

    def __init__(self, items: list[tuple[object, bytes]], window: int):
        self.window = window
        self.numbers: dict[bytes, int] = {}
        self.names: list[str] = []
        held = [np.zeros(0, np.uint32)]
        for item, text in items:
            words = [self.numbers.setdefault(w, len(self.numbers) + 1) for w in split_words(text)]
            if words:
                held.append(np.array(words, np.uint32))
                self.names.append("" if item is None else str(item))
        lengths = np.array([len(x) for x in held[1:]], np.int64)
        words = np.concatenate([*held, np.zeros(window, np.uint32)])
        widths = np.minimum(lengths, window)
        counts = lengths - widths + 1
        item = np.repeat(np.arange(len(lengths), dtype=np.int32), counts)
        at = (np.arange(len(item)) - np.repeat(starts_of(counts), counts)).astype(np.int32)
        keys = words[(starts_of(lengths)[item] + at)[:, None] + np.arange(window, dtype=np.int32)]
        short = np.flatnonzero(widths[item] < window)
        keys[short] *= np.arange(window) < widths[item[short]][:, None]
        keys = self._as_keys(keys)
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        new = np.concatenate([[True], keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, bool)
        self.low = keys[new]
        self.starts = np.append(np.flatnonzero(new), len(keys))
        self.item, self.at = item[order], at[order]
        self.width = widths[self.item[self.starts[:-1]]]
        self.shortest = int(self.width.min()) if len(self.width) else 0
        # Windows of short items stand for all suffixes that begin like them.
        self.open = np.flatnonzero(self.width < window)
        ends = self.low[self.open].view(">u4").reshape(-1, window).copy()
        ends[np.arange(window) >= self.width[self.open][:, None]] = 0xFFFFFFFF
        self.open_high = self._as_keys(ends)

    def _as_keys(self, rows: np.ndarray) -> np.ndarray:
        return np.ascontiguousarray(rows.astype(">u4")).view(f"S{4 * self.window}").reshape(-1)

    def uses(self, needle: int) -> Iterator[tuple[int, int]]:
        """Items and places of a window."""
        here = slice(self.starts[needle], self.starts[needle + 1])
        return zip(self.item[here].tolist(), self.at[here].tolist())

    def ends(self, keys: np.ndarray) -> np.ndarray:
        """Where the keys that begin with each window end in sorted ``keys``."""
        high = np.searchsorted(keys, self.low, "right")
        high[self.open] = np.searchsorted(keys, self.open_high, "right")
        return high


def _suffix_array(ids: np.ndarray, window: int, shortest: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and sorted first ``window`` words of the suffixes that can match at all."""
    known = np.concatenate([ids != 0, [False]])
    gap = np.where(known, len(known), np.arange(len(known)))
    run = np.minimum.accumulate(gap[::-1])[::-1] - np.arange(len(known))
    places = np.flatnonzero(run[:-1] >= shortest)
    padded = np.concatenate([ids, np.zeros(window, ids.dtype)])
    keys = np.ascontiguousarray(padded[places[:, None] + np.arange(window)].astype(">u4")).view(f"S{4 * window}").reshape(-1)
    order = np.argsort(keys, kind="stable")
    return places[order], keys[order]


def _search(ids: np.ndarray, needles: Needles) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (place in the shard, number of the window found there)."""
    places, keys = _suffix_array(ids, needles.window, needles.shortest)
    low = np.searchsorted(keys, needles.low, "left")
    high = needles.ends(keys)
    count = np.maximum(high - low, 0)
    needle = np.repeat(np.arange(len(count)), count)
    at = np.arange(len(needle)) - np.repeat(starts_of(count), count) + np.repeat(low, count)
    return places[at], needle


def _longest(place: list[int], needle: list[int], needles: Needles) -> tuple[int, int, str]:
    """Longest run of window hits along one item: (words, first place, item)."""
    ahead: dict[tuple[int, int], tuple[int, int]] = {}
    best = (0, 0, "")
    for p, k in sorted(zip(place, needle)):
        for item, at in needles.uses(k):
            begun = ahead.get((item, p - at), (-2, 0))
            start = begun[1] if begun[0] == p - 1 else p
            ahead[(item, p - at)] = (p, start)
            words = p - start + int(needles.width[k])
            if words > best[0]:
                best = (words, start, needles.names[item])
    return best


_SCHEMA = "text_key binary, n_words long, hit_places binary, item_names array<string>, longest_words long, longest_at long, longest_item string"


def _scan(batches: Iterator[pa.RecordBatch], needles: Needles) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, "text"):
        texts = raw_texts(batch.column("text"))
        words = [split_words(text) for text in texts]
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        ids = np.zeros(int(lengths.sum()) + len(words), np.uint32)
        starts = starts_of(lengths + 1)
        number = needles.numbers.get
        for start, own in zip(starts.tolist(), words):
            ids[start : start + len(own)] = [number(w, 0) for w in own]
        rows: list[list] = [[], [], [], [], []]
        place, needle = _search(ids, needles) if len(needles.width) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        doc = np.searchsorted(starts, place, "right") - 1
        order = np.argsort(doc, kind="stable")
        edges = np.searchsorted(doc[order], np.arange(len(words) + 1))
        for d in range(len(words)):
            own = order[edges[d] : edges[d + 1]]
            if not len(own):
                for column, value in zip(rows, (b"", [], 0, None, None)):
                    column.append(value)
                continue
            at = place[own] - starts[d]
            depth = np.zeros(int(lengths[d]) + 1, np.int64)
            np.add.at(depth, at, 1)
            np.subtract.at(depth, at + needles.width[needle[own]], 1)
            names = {needles.names[i] for k in np.unique(needle[own]).tolist() for i, _ in needles.uses(k)}
            longest = _longest(at.tolist(), needle[own].tolist(), needles)
            hit = np.flatnonzero(np.cumsum(depth)[:-1] > 0).astype("<u4").tobytes()
            for column, value in zip(rows, (hit, sorted(names), longest[0], int(longest[1]), longest[2])):
                column.append(value)
        kinds = (pa.binary(), pa.list_(pa.string()), pa.int64(), pa.int64(), pa.string())
        keys = pa.array([hashlib.blake2b(t, digest_size=16).digest() for t in texts], pa.binary())
        columns = [batch.column("doc_id"), keys, pa.array(lengths, pa.int64()), *(pa.array(c, k) for c, k in zip(rows, kinds))]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_key", "n_words", "hit_places", "item_names", "longest_words", "longest_at", "longest_item"])


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[object, bytes]]]:
    """Items in blocks of bounded size, streamed from Spark one partition at a time."""
    block, size = [], 0
    for row in benchmark.select("item_id", "text").toLocalIterator():
        text = (row["text"] or "").encode()
        words = split_words(text)
        own = len(words) * _WINDOW_BYTES + sum(len(w) + _ENTRY_BYTES for w in set(words))
        if block and size + own > BLOCK_BYTES:
            yield block
            block, size = [], 0
        block.append((row["item_id"], text))
        size += own
    yield block


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts and digest of each row's joined findings."""
    for batch in batches:
        hits = [len({bytes(h[i : i + 4]) for h in parts for i in range(0, len(h), 4)}) if len(parts) > 1 else len(parts[0]) // 4 for parts in batch.column("hits").to_pylist()]
        items = [sorted({i for part in parts for i in part}) for parts in batch.column("items").to_pylist()]
        digest = [hashlib.sha256(",".join(x).encode()).hexdigest() for x in items]
        columns = [batch.column(c) for c in ("doc_id", "n_words", "longest_words", "longest_at", "longest_item")]
        columns += [pa.array(hits, pa.int64()), pa.array([len(x) for x in items], pa.int64()), pa.array(digest, pa.string()), pa.array(items, pa.list_(pa.string()))]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "longest_words", "longest_at", "longest_item", "n_hit", "n_items", "items_sha256", "items"])


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: int = 20) -> DataFrame:
    """Per row: doc_id, n_words, n_hit, n_items, items_sha256, contaminated; and the items, with the length,
    place (in words) and item of the longest verbatim match of ``window`` words or more (null where none)."""
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    scanned, blocks = None, 0
    for block in _blocks(benchmark):
        needles = spark.sparkContext.broadcast(Needles(block, window))

        def run(batches, needles=needles):
            return _scan(batches, needles.value)

        found = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {_SCHEMA}")
        found = found.withColumn("first_block", F.lit(blocks == 0))
        scanned, blocks = found if scanned is None else scanned.unionByName(found.filter("longest_words > 0")), blocks + 1
    if blocks > 1:
        # What several blocks found in one row is brought together; equal rows stay as many as they were.
        grouped = scanned.groupBy("doc_id", "text_key").agg(
            F.max("n_words").alias("n_words"),
            F.max_by(F.struct("longest_words", "longest_at", "longest_item"), "longest_words").alias("best"),
            F.collect_set("hit_places").alias("hits"),
            F.collect_set("item_names").alias("items"),
            F.count_if("first_block").alias("copies"),
        )
        copies = F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int")))
        gathered = grouped.select("doc_id", "n_words", "best.*", "hits", "items", copies).drop("col")
    else:
        gathered = scanned.select("doc_id", "n_words", "longest_words", "longest_at", "longest_item", F.array("hit_places").alias("hits"), F.array("item_names").alias("items"))
    merged = gathered.mapInArrow(_merge, f"doc_id {kind}, n_words long, longest_words long, longest_at long, longest_item string, n_hit long, n_items long, items_sha256 string, items array<string>")
    bad = F.expr(f"n_hit > 0 AND {int(share)} * n_hit >= n_words").alias("contaminated")
    return merged.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", bad, "items", "longest_words", "longest_at", "longest_item")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **settings) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, each judged by its own text; all columns stay."""
    found = contamination(docs.select(row_id().alias("doc_id"), "text"), benchmark, **settings)
    return without(docs, settle(found.filter("contaminated").select("doc_id").distinct()), row_id())
