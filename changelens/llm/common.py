"""What the training-data operators share: tables, Arrow batches, words, seeded sampling."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows and bytes that one Arrow batch may hold, so that Python workers stay small with very long texts.
BATCH_SETTINGS = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.execution.arrow.maxBytesPerBatch": "16m",
}


def prepared(spark: SparkSession) -> SparkSession:
    """Bound the Arrow batches of this session."""
    for key, value in BATCH_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepared(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def raw_texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null becomes empty."""
    return [value or b"" for value in column.cast(pa.binary()).to_pylist()]


def pieces(batches: Iterator[pa.RecordBatch], text: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches into slices of about ``limit`` bytes of text, one row at least."""
    for batch in batches:
        sizes = np.array([0 if n is None else n for n in pc.binary_length(batch.column(text)).to_pylist()], np.int64)
        part = np.cumsum(sizes) // limit
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for start, end in zip(cuts, cuts[1:]):
            if end > start:
                yield batch.slice(start, end - start)


def blocks(batches: Iterator[pa.RecordBatch], text: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Join neighbouring slices into blocks of about ``limit`` bytes of text."""
    held, size = [], 0
    for piece in pieces(batches, text, limit):
        held.append(piece)
        size += pc.sum(pc.binary_length(piece.column(text))).as_py() or 0
        if size >= limit:
            yield pa.concat_batches(held)
            held, size = [], 0
    if held:
        yield pa.concat_batches(held)


def starts_of(lengths: np.ndarray) -> np.ndarray:
    """Start of each run when runs of these lengths lie one after the other."""
    return np.cumsum(lengths) - lengths


def one_list(values: pa.Array) -> pa.ListArray:
    """A column of one row that holds ``values``."""
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def bounded_sample(df: DataFrame, key: str, rows: int) -> DataFrame:
    """At most ``rows`` rows, those with the lowest hash of ``key``: the same ones on every run."""
    return df.orderBy(F.xxhash64(F.lit("sample"), F.col(key)), key).limit(rows)


def first_rows(df: DataFrame, keys: list[str], order: list[Column], count: int, salt: Column) -> DataFrame:
    """The first ``count`` rows of each key with their ``rank`` from 1.  ``salt`` splits a key: the first rows of
    every split (reduced before the shuffle as well) meet in the second step."""
    split = Window.partitionBy(*keys, "_salt").orderBy(*order)
    some = df.withColumn("_salt", salt).withColumn("rank", F.row_number().over(split)).filter(F.col("rank") <= count)
    whole = Window.partitionBy(*keys).orderBy(*order)
    return some.drop("_salt").withColumn("rank", F.row_number().over(whole)).filter(F.col("rank") <= count)
