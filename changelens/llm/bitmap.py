"""A bitmap of fixed size for a set of 64-bit keys, to leave most rows out before they are shuffled.

It only saves work: a key that is in the set always passes, others pass by chance, and the join that
follows decides.  When the set outgrows the bitmap everything passes and the join does all the work.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changelens.scratch import settle

BITS = 1 << 27
_SECTION = 1 << 17


def _section(group: pa.Table) -> pa.Table:
    bits = np.zeros(_SECTION, bool)
    bits[group.column("place").to_numpy()] = True
    packed = np.packbits(bits, bitorder="little").tobytes()
    return pa.table({"section": group.column("section")[:1], "bits": pa.array([packed], pa.binary())})


class Bitmap:
    """``BITS`` bits, whatever the number of keys; that is what is collected; it is broadcast
    compressed, as every executor keeps a copy on disk."""

    def __init__(self, keys: DataFrame, key: Column):
        spots = keys.select(F.pmod(key, F.lit(BITS)).alias("spot")).distinct()
        dealt = spots.select(F.shiftright("spot", 17).alias("section"), F.col("spot").bitwiseAND(F.lit(_SECTION - 1)).alias("place"))
        bits = bytearray(BITS // 8)
        for row in dealt.groupBy("section").applyInArrow(_section, "section long, bits binary").toLocalIterator():
            at = row["section"] * _SECTION // 8
            bits[at : at + _SECTION // 8] = row["bits"]
        self.sent = keys.sparkSession.sparkContext.broadcast(zlib.compress(bytes(bits), 1))

    def may_hold(self, key: Column) -> Column:
        """Whether the key may be in the set."""
        sent = self.sent

        @F.pandas_udf("boolean")
        def held(spots: Iterator[pd.Series]) -> Iterator[pd.Series]:
            bits = np.frombuffer(zlib.decompress(sent.value), np.uint8)
            for spot in spots:
                at = spot.to_numpy()
                yield pd.Series(bits[at >> 3] >> (at & 7).astype(np.uint8) & 1 == 1)

        return held(F.pmod(key, F.lit(BITS)))


def row_id() -> Column:
    """Names a row by doc_id (null comes last) and text; only rows equal in both share it."""
    return F.struct(F.col("doc_id").isNull().alias("nameless"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("text"))


def without(docs: DataFrame, dropped: DataFrame, key: Column) -> DataFrame:
    """Rows of ``docs`` whose ``key`` is not in ``dropped`` (one column; null is a key like any other).  Only
    rows that the bitmap cannot acquit are shuffled."""
    gone = dropped.toDF("gone_key")
    may_go = Bitmap(gone, F.xxhash64("gone_key")).may_hold(F.xxhash64(key))
    decided = docs.filter(may_go).join(gone, key.eqNullSafe(gone["gone_key"]), "left_anti")
    return docs.filter(~may_go).unionByName(decided)


def keep_one(docs: DataFrame, found: DataFrame) -> DataFrame:
    """One row of ``docs`` for each component; ``found``: ``doc_id`` (the ``row_id`` of each row) and
    ``component_id`` (the least one of its component).  Of rows equal in doc_id and text that with the least
    hash of all columns stays."""
    dropped = found.filter("doc_id <> component_id").select("doc_id").distinct()
    doubled = settle(found.filter("doc_id = component_id").groupBy("doc_id").agg(F.count("*").alias("times")).filter("times > 1").select("doc_id"))
    left = without(docs, settle(dropped), row_id())
    if doubled.isEmpty():
        return left
    again = doubled.toDF("key")
    copies = left.join(again, row_id().eqNullSafe(again["key"]), "left_semi")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    # As text, since columns of some types have no hash.
    whole = F.xxhash64(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}))
    single = copies.groupBy(row_id()).agg(F.min_by(F.struct(*columns), whole)).toDF("key", "row")
    return without(left, doubled, row_id()).unionByName(single.select("row.*"))
