"""Ranked lexical search by pipelined term partitioning.

Documents are indexed in shards of bounded text; each term has an owner, and the posting lists of a shard are dealt
out by owner.  A query does not ask all owners at once: a bundle of items goes from owner to owner.  At every
stage it meets, by cogroup, the lists that this owner holds of the bundle's terms, adds their whole-number
contributions to the sparse accumulators it carries (document and score so far), and travels on to the next
owner.  After the last stage the best documents of the shard are selected, and the shards are merged in two steps.

A bundle is a block of about ``ITEMS`` items in one shard, so no group grows with the frequency of a term, with the
number of items or with the table.  Only terms that some item asks for get posting lists; a bitmap of fixed size
lets them through while texts are read (it never stops an asked term, and the join with the items decides).

Defined cases: a null or empty text has no terms, is not counted in N and is never found; an item without terms finds
nothing; rows of one item_id (null is one) are one item with the terms of all its texts; every document row is
ranked on its own, and equal scores go by doc_id, null last; very long texts are split into words in parts; other
columns are ignored; empty tables give an empty result.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from changelens.llm.bitmap import BITS, Bitmap
from changelens.llm.common import first_rows, one_list, pieces, raw_texts
from changelens.scratch import settle, settle_at

#: Bytes of text in a shard, items in a bundle, owners in the pipeline, splits of a term's lists in the join.
SHARD, ITEMS, OWNERS, SPLITS = 4 << 20, 128, 4, 8
PART = 4 << 20

_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Byte by byte: letters A-Z lowered, what is no letter, digit or part of a longer character becomes a space.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

_INDEX = "shard long, owner int, term string, docs array<bigint>, counts array<bigint>, lengths array<bigint>"
_BUNDLE = "block int, shard long, slot int, docs array<bigint>, scores array<bigint>"
_FOUND = "block int, shard long, slot int, doc_id long, score long"


def _words(text: bytes) -> Iterator[bytes]:
    folded = text.translate(_FOLD)
    low = 0
    while low < len(folded):
        high = folded.find(b" ", low + PART)
        high = len(folded) if high < 0 else high
        yield from folded[low:high].split()
        low = high


class _Asked(dict):
    """Numbers of the words that some item may ask for, -1 for all others."""

    def __init__(self, bits: np.ndarray):
        self.bits, self.terms, self.owners = bits, [], []

    def __missing__(self, word: bytes) -> int:
        digest = xxhash.xxh64_intdigest(word, 42)
        spot = digest & (BITS - 1)
        code = -1
        if self.bits[spot >> 3] >> (spot & 7) & 1:
            code = len(self.terms)
            self.terms.append(word)
            self.owners.append(digest >> 32)
        self[word] = code
        return code


def _lists(values: np.ndarray, starts: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(values, pa.int64()))


def index(docs: DataFrame, terms: Bitmap, owners: int = OWNERS) -> DataFrame:
    """Posting lists by shard and term; a row without a term holds a shard's documents and their lengths."""
    sent = terms.sent

    def run(batches):
        bits = np.frombuffer(zlib.decompress(sent.value), np.uint8)
        part, number = TaskContext.get().partitionId(), 0
        for piece in pieces(batches, "text", SHARD):
            asked, found, lengths = _Asked(bits), [], []
            for text in raw_texts(piece.column("text")):
                codes = np.fromiter(map(asked.__getitem__, _words(text)), np.int64)
                lengths.append(len(codes))
                found.append(codes[codes >= 0])
            shard, lengths, rows = part << 32 | number, np.array(lengths, np.int64), piece.num_rows
            number += 1
            key = np.concatenate(found) * rows + np.repeat(np.arange(rows), list(map(len, found)))
            key, counts = np.unique(key, return_counts=True)
            code, doc = key // rows, key % rows
            starts = np.concatenate([[0], np.flatnonzero(np.diff(code)) + 1, [len(code)]]) if len(code) else np.array([0])
            held = code[starts[:-1]]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(held) + 1, shard)),
                    pa.array([None, *(asked.owners[k] % owners for k in held)], pa.int32()),
                    pa.array([None, *(asked.terms[k] for k in held)], pa.binary()).cast(pa.string()),
                    pa.concat_arrays([one_list(piece.column("doc_id").cast(pa.int64())), _lists(doc, starts)]),
                    pa.concat_arrays([pa.array([None], pa.list_(pa.int64())), _lists(counts, starts)]),
                    pa.concat_arrays([_lists(lengths, np.array([0, rows])), _lists(lengths[doc], starts)]),
                ],
                ["shard", "owner", "term", "docs", "counts", "lengths"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, _INDEX)


def item_terms(items: DataFrame) -> DataFrame:
    """Distinct ``item_id, term``."""
    words = F.regexp_extract_all(F.translate(F.coalesce("text", F.lit("")), _UPPER, _LOWER), F.lit(_TERM), F.lit(0))
    return items.select("item_id", F.explode(words).alias("term")).distinct()


def _values(column: pa.ChunkedArray) -> list[np.ndarray]:
    """Every row's list as an array; the lists hold no nulls."""
    whole = column.combine_chunks()
    flat, ends = whole.flatten().to_numpy(zero_copy_only=False), whole.offsets.to_numpy()
    return [flat[a - ends[0] : b - ends[0]] for a, b in zip(ends, ends[1:])]


def _visit(documents: int, terms: int, last: int):
    """What an owner does to the bundle of one block and shard.  ``last``: how many documents to select, 0 to travel on."""

    def run(key, bundle: pa.Table, owned: pa.Table) -> pa.Table:
        block, shard = (k.as_py() for k in key)
        slots = bundle.column("slot").to_numpy()
        head = int(np.flatnonzero(slots < 0)[0])
        ids = bundle.column("docs")[head].values
        asked = _values(owned.column("slots"))
        width = 1 + max([int(slots.max()), *(int(x.max()) for x in asked)])
        scores = np.zeros((width, len(ids)), np.int64)
        carried, so_far = bundle.filter(pa.array(slots >= 0)), slots[slots >= 0]
        for slot, at, value in zip(so_far, _values(carried.column("docs")), _values(carried.column("scores"))):
            scores[slot, at] = value
        weights = owned.column("weight").to_numpy()
        lists = [_values(owned.column(c)) for c in ("docs", "counts", "lengths")]
        for items, weight, at, count, length in zip(asked, weights, *lists):
            share = 100 - 90 + (90 * length * documents) // terms
            scores[np.ix_(items, at)] += weight * ((1_000_000_000 * count) // (1000 * count + 8 * share))
        if last:
            return _selected(block, shard, ids, scores, last)
        slot, at = np.nonzero(scores)
        held = np.unique(slot)
        starts = np.concatenate([np.searchsorted(slot, held), [len(slot)]])
        none = pa.array([None], pa.list_(pa.int64()))
        return pa.table(
            {
                "block": pa.array(np.full(len(held) + 1, block), pa.int32()),
                "shard": pa.array(np.full(len(held) + 1, shard), pa.int64()),
                "slot": pa.array([-1, *held], pa.int32()),
                "docs": pa.concat_arrays([one_list(ids), _lists(at, starts)]),
                "scores": pa.concat_arrays([none, _lists(scores[slot, at], starts)]),
            }
        )

    return run


def _selected(block: int, shard: int, ids: pa.Array, scores: np.ndarray, count: int) -> pa.Table:
    """Best documents of a shard for each item of a block; equal scores by doc_id, null last."""
    turn = np.lexsort((ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_null().to_numpy(zero_copy_only=False)))
    place = np.empty(len(turn), np.int64)
    place[turn] = np.arange(len(turn))
    slots, found, values = [], [], []
    for slot, own in enumerate(scores):
        at = np.flatnonzero(own > 0)
        if len(at) > count:
            at = at[own[at] >= np.partition(own[at], len(at) - count)[len(at) - count]]
        at = at[np.lexsort((place[at], -own[at]))[:count]]
        slots += [slot] * len(at)
        found += at.tolist()
        values += own[at].tolist()
    rows = len(slots)
    return pa.table(
        {
            "block": pa.array(np.full(rows, block), pa.int32()), "shard": pa.array(np.full(rows, shard), pa.int64()),
            "slot": pa.array(slots, pa.int32()), "doc_id": ids.take(pa.array(found, pa.int64())), "score": pa.array(values, pa.int64()),
        }
    )


def search(docs: DataFrame, items: DataFrame, count: int = 10, owners: int = OWNERS) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``count`` best documents of every item with a score above 0.

    ``docs``: ``doc_id`` (an integer), ``text``; ``items``: ``item_id, text``.
    """
    wanted = settle(item_terms(items))
    place = settle_at(index(docs, Bitmap(wanted, F.xxhash64("term")), owners))
    heads, postings = (docs.sparkSession.read.schema(_INDEX).parquet(place).filter(kind) for kind in ("term IS NULL", "term IS NOT NULL"))
    sizes = heads.selectExpr("size(filter(lengths, n -> n > 0)) AS documents", "aggregate(lengths, 0L, (sum, n) -> sum + n) AS terms")
    documents, terms = (found or 0 for found in sizes.agg(F.sum("documents"), F.sum("terms")).first())

    spread = max(1, math.ceil(wanted.select("item_id").distinct().count() / ITEMS))
    numbered = wanted.select("item_id").distinct().withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(spread)).cast("int"))
    numbered = settle(numbered.withColumn("slot", (F.row_number().over(Window.partitionBy("block").orderBy("item_id")) - 1).cast("int")))
    frequency = postings.groupBy("term").agg(F.sum(F.size("docs")).alias("df"))
    weight = F.floor(1000 * F.log(F.lit(float(2 * documents + 2)) / (2 * F.col("df") + 1).cast("double")))
    asked = wanted.join(numbered, wanted["item_id"].eqNullSafe(numbered["item_id"])).select("term", "block", F.col("slot").cast("bigint").alias("slot"))
    asked = settle(asked.groupBy("block", "term").agg(F.collect_list("slot").alias("slots")).join(frequency, "term").select("block", "term", "slots", weight.alias("weight")))
    asked = asked.withColumn("split", F.explode(F.sequence(F.lit(0), F.lit(SPLITS - 1))))

    every = F.explode(F.sequence(F.lit(0), F.lit(spread - 1))).alias("block")
    no_scores = F.lit(None).cast("array<bigint>").alias("scores")
    bundles = heads.select(every, "shard", F.lit(-1).alias("slot"), "docs", no_scores)
    for owner in range(owners):
        mine = postings.filter(F.col("owner") == owner).withColumn("split", F.pmod("shard", F.lit(SPLITS)).cast("int"))
        owned = mine.join(asked, ["term", "split"]).select("block", "shard", "slots", "weight", "docs", "counts", "lengths")
        at_last = count if owner == owners - 1 else 0
        met = bundles.groupBy("block", "shard").cogroup(owned.groupBy("block", "shard"))
        bundles = met.applyInArrow(_visit(int(documents), int(terms), at_last), _FOUND if at_last else _BUNDLE)
    best = first_rows(bundles, ["block", "slot"], [F.desc("score"), F.asc_nulls_last("doc_id")], count, F.pmod("shard", F.lit(64)))
    return best.join(numbered, ["block", "slot"]).select("item_id", "rank", "doc_id", "score")
