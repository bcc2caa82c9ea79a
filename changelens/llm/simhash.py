"""SimHash near-duplicates by multi-index hashing.

A fingerprint is cut into segments.  If two fingerprints differ in at most d bits, then by the pigeonhole
principle some segment differs in at most its own small radius (the radii add up so that one more
difference in every segment would exceed d).  Each fingerprint therefore probes, for each segment, the
table of that segment with all keys of a small Hamming ball; what it meets is verified on all 64 bits
inside the join.  Equal fingerprints are one entry, so copies are never paired with each other.

Defined cases: a null or wordless text has fingerprint zero and is linked like any other; fewer words than
a shingle make one shingle; repeated shingles count each time; rows of one doc_id are each judged and
returned; a null doc_id never names a component unless the component has no other id (then null); other
columns are ignored.  ``drop_near_duplicates`` keeps exactly one row of a component, whatever ids its rows
have.  An empty table gives an empty result.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changelens.llm.bitmap import keep_one, row_id
from changelens.llm.common import pieces, raw_texts
from changelens.llm.components import roots
from changelens.scratch import settle

SEED = 42
CHUNK = 1 << 16


def _fingerprint(text: bytes, shingle: int) -> int:
    words = text.lower().split()
    if not words:
        return 0
    joined = memoryview(b" ".join(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    first = np.concatenate([[0], ends]).tolist()
    width = min(shingle, len(words))
    digest = xxhash.xxh64_intdigest
    set_bits = np.zeros(64, np.int64)
    total = len(words) - width + 1
    for low in range(0, total, CHUNK):
        high = min(low + CHUNK, total)
        hashes = [digest(joined[a : b - 1], SEED) for a, b in zip(first[low:high], first[low + width : high + width])]
        flat = np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8)
        set_bits += np.unpackbits(flat, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(set_bits * 2 > total, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """``doc_id`` and ``fp`` (the 64 bits as a long) of every row."""

    def run(batches):
        for batch in pieces(batches, "text"):
            values = [_fingerprint(text, shingle) for text in raw_texts(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(values, pa.int64())], ["doc_id", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, fp long")


def _segments(count: int, distance: int) -> list[tuple[int, int, int]]:
    """(lowest bit, width, radius) with the sum of radius + 1 equal to distance + 1."""
    found, low = [], 0
    for k in range(count):
        width = 64 // count + (k < 64 % count)
        radius = (distance + 1) // count + (k < (distance + 1) % count) - 1
        found.append((low, width, radius))
        low += width
    return [x for x in found if x[2] >= 0]


def _keys(fps: DataFrame, segments: list[tuple[int, int, int]], ball: bool) -> DataFrame:
    """A row for each segment and each key of the fingerprint's ball there (or its own key alone)."""
    made = []
    for number, (low, width, radius) in enumerate(segments):
        part = F.shiftrightunsigned("fp", low).bitwiseAND(F.lit((1 << width) - 1)).bitwiseOR(F.lit(number << 58))
        flips = [sum(1 << i for i in bits) for r in range(radius + 1 if ball else 1) for bits in combinations(range(width), r)]
        made.append(F.array(*[part.bitwiseXOR(F.lit(x).cast("long")) for x in flips]))
    return fps.select("fp", F.explode(F.concat(*made)).alias("key"))


def close_pairs(fps: DataFrame, distance: int = 4, segments: int = 3) -> DataFrame:
    """Pairs a < b of distinct fingerprints that differ in at most ``distance`` bits."""
    plan = _segments(segments, distance)
    probes = _keys(fps, plan, True).select("key", F.col("fp").alias("a"))
    index = _keys(fps, plan, False).select("key", F.col("fp").alias("b"))
    close = F.expr(f"a < b AND bit_count(a ^ b) <= {int(distance)}")
    return probes.hint("merge").join(index, "key").filter(close).select("a", "b").distinct()


def near_duplicates(docs: DataFrame, shingle: int = 4, distance: int = 4, segments: int = 3) -> DataFrame:
    """``doc_id``, ``fingerprint`` (16 hex digits), ``component_id`` (least doc_id reachable) per row."""
    prints = settle(fingerprints(docs, shingle))
    entries = settle(prints.groupBy("fp").agg(F.min("doc_id").alias("least_id")))
    linked = roots(settle(close_pairs(entries.select("fp"), distance, segments)))
    named = entries.join(linked, entries.fp == linked.node, "left").select("fp", "least_id", F.coalesce("root", "fp").alias("root"))
    named = settle(named)
    chosen = named.groupBy("root").agg(F.min("least_id").alias("component_id"))
    classes = named.join(chosen, "root").select("fp", "component_id")
    return prints.join(classes, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, **settings) -> DataFrame:
    """One row of ``docs`` for each component, with all columns: that of the least doc_id (null after all
    others), then of the least hash of the text."""
    return keep_one(docs, settle(near_duplicates(docs.select(row_id().alias("doc_id"), "text"), **settings)))
