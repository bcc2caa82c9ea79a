"""Bounded-space online packing of whole documents into training windows.

Every partition streams its documents past a fixed number of open windows.  What of a document fills whole
windows goes out at once; the rest is placed where it fits best.  When it fits nowhere, the fullest window
is emitted: as it is if at most ``slack`` tokens are missing, else filled up exactly with the head of the
piece, whose tail is then placed.  The windows still open at the end are merged: in rounds of ``FAN_IN``
partitions (or groups of the round before) their pieces are run together into full windows, until one window
is left, which is cut at powers of two.  A round holds at most FAN_IN * open_windows windows in one task.

Defined cases: a null or empty text is its end token alone; a null doc_id is kept; rows of one doc_id are
packed as documents of their own; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changelens.llm.common import pieces
from changelens.llm.tokens import Encoder
from changelens.scratch import settle

WINDOW = 2048
OPEN_WINDOWS = 64
SLACK = 16
END_ID = 1
FAN_IN = 64
_NUMBERS = 24

_NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "open", "ids"]
_SCHEMA = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, open boolean, ids binary"

#: doc_id, start, tokens of the document, ids
Piece = tuple[object, int, int, bytes]


class _Rows:
    """Finished pieces on their way out."""

    def __init__(self, first_id: int, kind: pa.DataType, with_ids: bool):
        self.next_id, self.kind, self.with_ids = first_id, kind, with_ids
        self.rows: list[tuple] = []

    def window(self, own: list[Piece], still_open: bool = False) -> None:
        offset = 0
        for doc_id, start, tokens, ids in own:
            length = len(ids) // 4
            kept = ids if still_open or self.with_ids else None
            self.rows.append((doc_id, start, length, zlib.crc32(ids), tokens, self.next_id, offset, still_open, kept))
            offset += length
        self.next_id += 1

    def batch(self) -> pa.RecordBatch:
        kinds = [self.kind, *[pa.int64()] * 6, pa.bool_(), pa.binary()]
        columns = list(zip(*self.rows)) or [()] * len(kinds)
        self.rows = []
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], _NAMES)


class _OpenWindows:
    """At most ``count`` open windows, by free space."""

    def __init__(self, count: int, window: int, slack: int, rows: _Rows):
        self.count, self.window, self.slack, self.rows = count, window, slack, rows
        self.free: list[tuple[int, int]] = []
        self.held: dict[int, list[Piece]] = {}
        self.named = 0

    def place(self, piece: Piece) -> None:
        doc_id, start, tokens, ids = piece
        while ids:
            length = len(ids) // 4
            at = bisect_left(self.free, (length, -1))
            if at < len(self.free):
                space, name = self.free.pop(at)
                self.held[name].append((doc_id, start, tokens, ids))
                if space == length:
                    self.rows.window(self.held.pop(name))
                else:
                    insort(self.free, (space - length, name))
                return
            if len(self.free) < self.count:
                self.named += 1
                self.held[self.named] = []
                insort(self.free, (self.window, self.named))
                continue
            space, name = self.free.pop(0)
            own = self.held.pop(name)
            if space > self.slack:
                own.append((doc_id, start, tokens, ids[: 4 * space]))
                start, ids = start + space, ids[4 * space :]
            self.rows.window(own)


def _pack(batches: Iterator[pa.RecordBatch], path: str, window: int, count: int, slack: int, with_ids: bool) -> Iterator[pa.RecordBatch]:
    encoder = Encoder.of(path)
    rows = windows = None
    end = END_ID.to_bytes(4, "little")
    for batch in pieces(batches, "text", 2 << 20):
        if rows is None:
            rows = _Rows(TaskContext.get().partitionId() << _NUMBERS, batch.column("doc_id").type, with_ids)
            windows = _OpenWindows(count, window, slack, rows)
        texts = [text or "" for text in batch.column("text").to_pylist()]
        for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encoder.encode(texts)):
            ids += end
            tokens = len(ids) // 4
            whole = tokens // window * window
            for start in range(0, whole, window):
                rows.window([(doc_id, start, tokens, ids[4 * start : 4 * (start + window)])])
            windows.place((doc_id, whole, tokens, ids[4 * whole :]))
        yield rows.batch()
    if rows is not None:
        for own in windows.held.values():
            rows.window(own, still_open=True)
        yield rows.batch()


def _refill(group: pa.Table, level: int, window: int, last: bool, with_ids: bool) -> pa.Table:
    """Run the pieces of a group's open windows together into full ones; the rest stays open, or in the
    last round is cut at powers of two."""
    group = group.sort_by([("sequence_id", "ascending"), ("offset", "ascending")])
    number = group.column("group")[0].as_py()
    rows = _Rows((level << 56) | (number << _NUMBERS), group.column("doc_id").type, with_ids)
    stream = zip(*(group.column(c).to_pylist() for c in ("doc_id", "start", "doc_tokens", "ids")))
    left = sum(group.column("length").to_pylist())
    sizes = [window] * (left // window)
    rest = left % window
    sizes += [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1] if last else [rest] * bool(rest)
    own, space, at = [], sizes[0] if sizes else 0, 0
    for doc_id, start, tokens, ids in stream:
        while ids:
            part = ids[: 4 * space]
            own.append((doc_id, start, tokens, part))
            start, ids, space = start + len(part) // 4, ids[len(part) :], space - len(part) // 4
            if not space:
                at += 1
                rows.window(own, still_open=not last and at == len(sizes) and bool(rest))
                own, space = [], sizes[at] if at < len(sizes) else 0
    return pa.Table.from_batches([rows.batch()])


def _merging(level: int, window: int, last: bool, with_ids: bool):
    return lambda group: _refill(group, level, window, last, with_ids)


def pack(docs: DataFrame, path: str, window: int = WINDOW, open_windows: int = OPEN_WINDOWS, slack: int = SLACK, with_ids: bool = True) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and with
    ``with_ids`` the piece's ids as little-endian unsigned 32-bit numbers."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, {_SCHEMA}"
    first = docs.select("doc_id", "text").mapInArrow(lambda b: _pack(b, path, window, open_windows, slack, with_ids), schema)
    current = settle(first)
    done = current.filter("NOT open")
    level = 0
    top = current.agg(F.max(F.shiftright("sequence_id", _NUMBERS))).first()[0]
    groups = 0 if top is None else top + 1
    while groups:
        level += 1
        last = groups <= FAN_IN
        number = F.shiftright(F.col("sequence_id").bitwiseAND(F.lit((1 << 56) - 1)), _NUMBERS)
        opened = current.filter("open").withColumn("group", F.floor(number / FAN_IN))

        current = settle(opened.groupBy("group").applyInArrow(_merging(level, window, last, with_ids), schema))
        done = done.unionByName(current.filter("NOT open"))
        groups = 0 if last else -(-groups // FAN_IN)
    return done.drop("open") if with_ids else done.drop("open", "ids")
