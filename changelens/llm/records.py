"""Token numbers as length-delimited binary records, with a separate offset index for shuffled reads.

A folder holds data files, index files and a manifest.

* Data file: one frame after another.  A frame is the payload's length (8 bytes), a masked checksum of those 8 bytes
  (4), the payload, and a masked checksum of the payload (4).  A payload is a flag byte (bit 0: no doc_id; bit 1:
  four-byte numbers, else two-byte), the doc_id (8 bytes, signed) and the token numbers.  All numbers are little-endian.
* Index file: 24 bytes for each record in turn: place of the frame in the data file, payload length, token numbers
  before it in the file.  With it any record can be read alone, in any order, without reading the others.
* Manifest: a Parquet table with a row for each data file: ``part, file, records, tokens, size``.

Checksums are CRC-32 of ``zlib``, masked so that a checksum stored inside checked data does no harm.

Writing: documents are dealt out by ranges of doc_id (text hash and row break ties, so one frequent id spreads over many
files) and sorted inside a range.  A task encodes its range and streams it into one file under a name of its own attempt,
which it reports only when it is closed; files of lost attempts are in no manifest, so nobody reads them.  Token numbers
are as good as incompressible, so they are written once, in the files, and never shuffled.  Files are reached through ``pyarrow.fs``, which knows local and
shared mounts, HDFS and object stores by their address.

Defined cases: a null text is empty (only the end number); a null doc_id comes first; repeated ids are ordered by
the hash of their text, equal rows are interchangeable; very long texts are one record; other columns are ignored; an
empty table has an empty manifest and reads back empty.  A frame that does not match its checksums raises ``ValueError``.
"""

from __future__ import annotations

import math
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from changelens.llm.common import pieces, raw_texts
from changelens.llm.word_pieces import WordEncoder

#: Bytes of text in a data file, bytes read at once, records looked up in one go.
FILE_BYTES, READ_BYTES, LOOKUPS = 64 << 20, 4 << 20, 4096

# Fixed value: the public masking rule of this kind of record file.
_MASK = 0xA282EAD8
_HEAD, _ENTRY, _HEAD_SIZE, _ENTRY_SIZE = "<QI", "<QQQ", 12, 24
_NO_ID, _WIDE = 1, 2

_MANIFEST = "part int, file string, records long, tokens long, size long"
_RECORD = "doc_id long, start long, n_tokens long, ids_crc32 long"


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + _MASK) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    length = struct.pack("<Q", len(payload))
    return b"".join([length, struct.pack("<I", masked(length)), payload, struct.pack("<I", masked(payload))])


def _opened(address: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(address)


def _payload(doc_id: int | None, width: int, ids: bytes) -> bytes:
    flags = (_NO_ID if doc_id is None else 0) | (_WIDE if width == 4 else 0)
    return struct.pack("<Bq", flags, doc_id or 0) + ids


def _parsed(payload: bytes) -> tuple[int | None, np.ndarray]:
    flags, doc_id = struct.unpack_from("<Bq", payload)
    return None if flags & _NO_ID else doc_id, np.frombuffer(payload, "<u4" if flags & _WIDE else "<u2", offset=9)


def _checked(length: bytes, payload: bytes, sums: tuple[int, int], where: str) -> bytes:
    if (masked(length), masked(payload)) != sums:
        raise ValueError(f"broken record in {where}")
    return payload


def _writer(folder: str, vocabulary: str, end: int):
    def run(batches):
        encoder = WordEncoder.of(vocabulary)
        last = np.array([end], f"<u{encoder.width}").tobytes()
        store, place = _opened(folder)
        part = TaskContext.get().partitionId()
        name = f"part-{part:06d}-{uuid.uuid4().hex}"
        records = tokens = size = 0
        data = index = None
        for batch in pieces(batches, "text"):
            if data is None:
                store.create_dir(place, recursive=True)
                data, index = store.open_output_stream(f"{place}/{name}.rec"), store.open_output_stream(f"{place}/{name}.idx")
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), raw_texts(batch.column("text"))):
                ids = encoder.encode(text) + last
                payload = _payload(doc_id, encoder.width, ids)
                data.write(frame(payload))
                index.write(struct.pack(_ENTRY, size, len(payload), tokens))
                size += len(payload) + _HEAD_SIZE + 4
                tokens += len(ids) // encoder.width
                records += 1
        if data is not None:
            data.close()
            index.close()
            yield pa.RecordBatch.from_pylist([{"part": part, "file": name, "records": records, "tokens": tokens, "size": size}], pa.schema([("part", pa.int32()), ("file", pa.string()), ("records", pa.int64()), ("tokens", pa.int64()), ("size", pa.int64())]))

    return run


def write(docs: DataFrame, folder: str, vocabulary: str, end: int, file_bytes: int = FILE_BYTES) -> None:
    """Encode ``docs`` (``doc_id, text``) and write them to ``folder`` in ascending doc_id order, in files of about
    ``file_bytes`` of text."""
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tie"), "text")
    size = given.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    order = ["doc_id", "tie", F.monotonically_increasing_id()]
    dealt = given.repartitionByRange(max(1, math.ceil(size / file_bytes)), *order).sortWithinPartitions("doc_id", "tie")
    written = dealt.select("doc_id", "text").mapInArrow(_writer(f"{folder}/data", vocabulary, end), _MANIFEST)
    written.write.parquet(f"{folder}/manifest")


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(_MANIFEST).parquet(f"{folder}/manifest")


def with_starts(files: DataFrame, group: int = 1024) -> DataFrame:
    """``part, start``: token numbers in all files before, by groups of files and then inside each group."""
    grouped = files.select("part", "tokens", F.floor(F.col("part") / group).alias("group"))
    before = Window.orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    groups = grouped.groupBy("group").agg(F.sum("tokens").alias("all")).select("group", F.coalesce(F.sum("all").over(before), F.lit(0)).alias("ahead"))
    inside = Window.partitionBy("group").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return grouped.join(groups, "group").select("part", (F.col("ahead") + F.coalesce(F.sum("tokens").over(inside), F.lit(0))).alias("start"))


def _frames(stream, size: int, where: str) -> Iterator[bytes]:
    """Payloads of a data file in turn, read in large parts."""
    held, done = memoryview(b""), 0

    def take(count: int) -> bytes:
        nonlocal held, done
        if len(held) < count:
            held = memoryview(bytes(held) + stream.read(max(READ_BYTES, count - len(held))))
        if len(held) < count:
            raise ValueError(f"{where} ends inside a record")
        found, held = bytes(held[:count]), held[count:]
        done += count
        return found

    while done < size:
        head = take(_HEAD_SIZE)
        length, sum_of_length = struct.unpack(_HEAD, head)
        if masked(head[:8]) != sum_of_length:
            raise ValueError(f"broken length in {where}")
        payload = take(length)
        yield _checked(head[:8], payload, (sum_of_length, struct.unpack("<I", take(4))[0]), where)


def _described(start: int, payload: bytes) -> tuple:
    doc_id, ids = _parsed(payload)
    return doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())


def _table(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], ["doc_id", "start", "n_tokens", "ids_crc32"])


def _in_order(folder: str):
    def run(batches):
        store, place = _opened(folder)
        for batch in batches:
            for row in batch.to_pylist():
                made, at, before = [], 0, 0
                with store.open_input_stream(f"{place}/{row['file']}.rec") as data, store.open_input_stream(f"{place}/{row['file']}.idx") as index:
                    for payload in _frames(data, row["size"], row["file"]):
                        if struct.unpack(_ENTRY, index.read(_ENTRY_SIZE)) != (at, len(payload), before):
                            raise ValueError(f"{row['file']}: index and data differ at {at}")
                        made.append(_described(row["start"] + before, payload))
                        at += len(payload) + _HEAD_SIZE + 4
                        before += made[-1][2]
                        if len(made) == 10_000:
                            yield _table(made)
                            made = []
                if made:
                    yield _table(made)

    return run


def read(spark: SparkSession, folder: str) -> DataFrame:
    """Every record of the files, read from end to end and checked: ``doc_id, start, n_tokens, ids_crc32``."""
    files = manifest(spark, folder)
    placed = files.join(with_starts(files), "part").repartition(max(1, files.count()), "part")
    return placed.mapInArrow(_in_order(f"{folder}/data"), _RECORD)


def index(spark: SparkSession, folder: str) -> DataFrame:
    """The offset index as rows: ``part, file, place, length, before``."""

    def run(batches):
        store, place = _opened(f"{folder}/data")
        for batch in batches:
            for row in batch.to_pylist():
                with store.open_input_stream(f"{place}/{row['file']}.idx") as stream:
                    left = row["records"]
                    while left:
                        some = min(left, 100_000)
                        numbers = np.frombuffer(stream.read(some * _ENTRY_SIZE), "<i8").reshape(some, 3)
                        names = [pa.array(np.full(some, row["part"]), pa.int32()), pa.array([row["file"]] * some)]
                        yield pa.RecordBatch.from_arrays([*names, *(pa.array(c.copy()) for c in numbers.T)], ["part", "file", "place", "length", "before"])
                        left -= some

    files = manifest(spark, folder)
    return files.repartition(max(1, files.count()), "part").mapInArrow(run, "part int, file string, place long, length long, before long")


def read_shuffled(spark: SparkSession, folder: str, seed: int, readers: int) -> DataFrame:
    """All records in an order that only ``seed`` decides: ``reader, turn, doc_id, ids``.

    Only index entries are shuffled; each reader then fetches its records one by one from wherever they lie.
    """

    def run(batches):
        store, place = _opened(f"{folder}/data")
        reader, turn, opened = TaskContext.get().partitionId(), 0, {}
        for batch in batches:
            for low in range(0, batch.num_rows, LOOKUPS):
                rows = []
                for row in batch.slice(low, LOOKUPS).to_pylist():
                    if row["file"] not in opened:
                        if len(opened) > 64:
                            opened.pop(next(iter(opened))).close()
                        opened[row["file"]] = store.open_input_file(f"{place}/{row['file']}.rec")
                    found = opened[row["file"]].read_at(row["length"] + _HEAD_SIZE + 4, row["place"])
                    payload = found[_HEAD_SIZE : -4]
                    sums = (struct.unpack_from(_HEAD, found)[1], struct.unpack("<I", found[-4:])[0])
                    doc_id, ids = _parsed(_checked(found[:8], payload, sums, row["file"]))
                    rows.append({"reader": reader, "turn": turn, "doc_id": doc_id, "ids": ids.tolist()})
                    turn += 1
                yield pa.RecordBatch.from_pylist(rows, pa.schema([("reader", pa.int32()), ("turn", pa.int64()), ("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))]))

    lot = F.xxhash64(F.lit(seed), "part", "place")
    dealt = index(spark, folder).withColumn("lot", lot).repartition(readers, "lot").sortWithinPartitions("lot", "part", "place")
    return dealt.mapInArrow(run, "reader int, turn long, doc_id long, ids array<int>")
