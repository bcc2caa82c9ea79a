"""Hard negatives by Four-Russians scoring.

Vectors become whole numbers.  For every group of eight dimensions of an anchor a table holds the sums of all
256 subsets of its eight components.  A candidate is kept as bit planes: one byte for each plane and group, the
bits of its eight components.  Such a byte is an index into the anchor's table, so the inner product is a sum of
looked-up values for each plane, and the planes are added up with shifts (the highest plane counts negative, as
in two's complement).  The scores are full and exact; nothing is approximated or left out.

All anchors meet all rows in blocks: cells of at most about ``ANCHORS`` anchors and ``TOGETHER`` candidate blocks
are the groups of one cogrouped step, whose size does not depend on the number of rows with one label.  A cell
gives the best few rows of each anchor, which are merged in two steps.  The first round finds the positives, the
second the negatives between the bounds that the positives set.

Defined cases: rows with a null label, a null vector or a component that is null or not finite take no part;
vectors of fewer dimensions count as padded with zeros (an empty vector scores zero everywhere); a null vec_id
comes after all others on ties; repeated rows are rows of their own (a copy of the anchor is an ordinary other
row), and an anchor row that occurs twice is answered twice; other columns are ignored; empty tables, or no
anchors, give an empty result.  Components so large that a score could leave 63 bits are refused with a
``ValueError`` before any work.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changelens.llm.common import first_rows, one_list
from changelens.scratch import settle

#: Candidates in a packed block, blocks and anchors in a cell, anchors scored together.
BLOCK, TOGETHER, ANCHORS, LANES = 1000, 8, 512, 64
NONE = np.iinfo(np.int64).min

_BLOCKS = "block long, ids array<bigint>, labels array<bigint>, planes binary, anchors array<boolean>"
_ANCHORS = "row long, vec_id long, label long, vector binary"
_COLUMNS = ["anchor_row", "anchor_id", "positive_row", "positive_id", "positive_score", "row", "id", "score"]
_FOUND = "cell int, " + ", ".join(f"{name} long" for name in _COLUMNS)


def whole_numbers(vectors: DataFrame, scale: float = 256.0) -> DataFrame:
    """``vec_id, label, numbers``: components as ``floor(scale * x)``; rows that take no part are left out."""
    usable = "label IS NOT NULL AND embedding IS NOT NULL AND forall(embedding, x -> x IS NOT NULL AND abs(CAST(x AS double)) < double('infinity'))"
    number = F.transform("embedding", lambda x: F.floor(F.lit(scale) * x.cast("double")))
    return vectors.filter(usable).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), number.alias("numbers"))


def _matrix(column: pa.ListArray, dims: int) -> np.ndarray:
    lengths = np.diff(column.offsets.to_numpy())
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    found = np.zeros((len(column), dims), np.int64)
    found[np.arange(dims)[None, :] < lengths[:, None]] = values
    return found


def _ids(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values (0 for null) and which are null."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.fill_null(0).to_numpy(zero_copy_only=False), column.is_null().to_numpy(zero_copy_only=False)


def _packer(bits: int, dims: int):
    def run(batches):
        part, number = TaskContext.get().partitionId(), 0
        for batch in batches:
            for low in range(0, batch.num_rows, BLOCK):
                rows = batch.slice(low, BLOCK)
                ids, null = _ids(rows.column("vec_id"))
                rows = rows.take(pa.array(np.lexsort((ids, null))))
                numbers = _matrix(rows.column("numbers"), dims)
                planes = [np.packbits((numbers >> p & 1).astype(np.uint8), axis=1, bitorder="little").T for p in range(bits)]
                made = [pa.array([part << 32 | number], pa.int64())]
                made += [one_list(rows.column(c)) for c in ("vec_id", "label")]
                made += [pa.array([np.stack(planes).tobytes()], pa.binary()), one_list(rows.column("anchor"))]
                yield pa.RecordBatch.from_arrays(made, ["block", "ids", "labels", "planes", "anchors"])
                number += 1

    return run


class _Block:
    """A packed block, taken apart."""

    def __init__(self, row: dict, bits: int, dims: int):
        ids = row["ids"]
        self.planes = np.frombuffer(row["planes"], np.uint8).reshape(bits, dims // 8, len(ids))
        self.labels = np.array(row["labels"], np.int64)
        self.null = np.array([x is None for x in ids])
        self.ids = np.array([x or 0 for x in ids], np.int64)
        self.rows = row["block"] * BLOCK + np.arange(len(ids))

    def vectors(self) -> np.ndarray:
        bits = [np.unpackbits(plane.T.copy(), axis=1, bitorder="little").astype(np.int64) for plane in self.planes]
        return sum(x << p for p, x in enumerate(bits[:-1])) - (bits[-1] << len(bits) - 1)


def _anchor_rows(bits: int, dims: int):
    def run(batches):
        for batch in batches:
            for given in batch.to_pylist():
                at = np.flatnonzero(np.array([bool(x) for x in given["anchors"]]))
                if not len(at):
                    continue
                block = _Block(given, bits, dims)
                made = [pa.array(block.rows[at]), pa.array(block.ids[at], mask=block.null[at]), pa.array(block.labels[at])]
                made.append(pa.array([v.astype("<i8").tobytes() for v in block.vectors()[at]], pa.binary()))
                yield pa.RecordBatch.from_arrays(made, ["row", "vec_id", "label", "vector"])

    return run


_SUBSETS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little")


def subset_sums(vectors: np.ndarray, kind: type) -> np.ndarray:
    """For each group of eight dimensions, all 256 subset sums of each anchor: (groups, 256, anchors)."""
    groups = vectors.reshape(len(vectors), -1, 8).transpose(1, 2, 0)
    return np.einsum("sd,gda->gsa", _SUBSETS.astype(np.int64), groups).astype(kind)


def scores(tables: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """Exact inner products (candidates, anchors) by look-ups and shifts.  ``planes``: (bits, groups, candidates)."""
    total, held = None, np.empty((planes.shape[2], tables.shape[2]), tables.dtype)
    for plane in planes[::-1]:
        part = np.zeros_like(held)
        for table, index in zip(tables, plane):
            part += np.take(table, index, axis=0, out=held, mode="clip")
        if total is None:
            total = -part
        else:
            total <<= 1
            total += part
    return total.astype(np.int64)


def _best(keys: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the ``count`` greatest keys of every column, without ``NONE``."""
    if len(keys) > count:
        at = np.argpartition(keys, len(keys) - count, axis=0)[len(keys) - count :]
    else:
        at = np.broadcast_to(np.arange(len(keys))[:, None], keys.shape)
    column = np.broadcast_to(np.arange(keys.shape[1]), at.shape)
    real = keys[at, column] != NONE
    return at[real], column[real]


class _Cell:
    """Scores the anchors of a cell against its blocks."""

    def __init__(self, bits: int, dims: int, kind: str):
        self.bits, self.dims, self.kind = bits, dims, np.dtype(kind).type

    def lanes(self, anchors: pa.Table):
        """Anchors by label, a few at a time, with their tables."""
        anchors = anchors.sort_by("label")
        for low in range(0, anchors.num_rows, LANES):
            some = anchors.slice(low, LANES)
            vectors = np.frombuffer(b"".join(some.column("vector").to_pylist()), "<i8").reshape(-1, self.dims)
            yield some, subset_sums(vectors, self.kind)

    def blocks(self, given: pa.Table) -> list[_Block]:
        return [_Block(row, self.bits, self.dims) for row in given.to_pylist()]


def _spread(values: np.ndarray) -> np.ndarray:
    """Keys whose order is that of the scores, and of the places where scores are equal."""
    return values * len(values) + np.arange(len(values) - 1, -1, -1)[:, None]


def _rows(cell: int, parts: dict[str, list]) -> pa.Table:
    made = {name: pa.concat_arrays(parts[name]) if name in parts else pa.array([], pa.int64()) for name in _COLUMNS}
    return pa.table({"cell": pa.array(np.full(len(made["row"]), cell), pa.int32()), **made})


def _finder(bits: int, dims: int, kind: str, count: int):
    """Best rows of the same label for each anchor of a cell."""
    tools = _Cell(bits, dims, kind)

    def run(key, anchors: pa.Table, given: pa.Table) -> pa.Table:
        parts: dict[str, list] = {}
        blocks = tools.blocks(given)
        for some, tables in tools.lanes(anchors):
            rows, labels = some.column("row").to_numpy(), some.column("label").to_numpy()
            for block in blocks:
                like = np.flatnonzero(np.isin(block.labels, labels))
                if not len(like):
                    continue
                keys = _spread(scores(tables, block.planes[:, :, like]))
                keys[(block.labels[like][:, None] != labels) | (block.rows[like][:, None] == rows)] = NONE
                at, lane = _best(keys, count)
                value = (keys[at, lane] - (len(keys) - 1 - at)) // len(keys)
                at = like[at]
                for name, found in {
                    "anchor_row": pa.array(rows[lane]), "anchor_id": some.column("vec_id").combine_chunks().take(pa.array(lane)),
                    "row": pa.array(block.rows[at]), "id": pa.array(block.ids[at], mask=block.null[at]), "score": pa.array(value),
                    **{name: pa.nulls(len(at), pa.int64()) for name in ("positive_row", "positive_id", "positive_score")},
                }.items():
                    parts.setdefault(name, []).append(found)
        return _rows(key[1].as_py(), parts)

    return run


def _miner(bits: int, dims: int, kind: str, count: int, low: int, high: int):
    """Best rows of another label between the bounds of each positive of each anchor of a cell."""
    tools = _Cell(bits, dims, kind)

    def run(key, anchors: pa.Table, given: pa.Table) -> pa.Table:
        parts: dict[str, list] = {}
        blocks = tools.blocks(given)
        for some, tables in tools.lanes(anchors):
            rows, labels = some.column("row").to_numpy(), some.column("label").to_numpy()
            positives = some.column("positives").to_pylist()
            for block in blocks:
                values = scores(tables, block.planes)
                other = block.labels[:, None] != labels
                spread = _spread(values)
                for turn in range(max(map(len, positives))):
                    own = [p[turn] if turn < len(p) else None for p in positives]
                    least = np.array([-(-low * p["score"] // 100) if p else 1 for p in own], np.int64)
                    most = np.array([high * p["score"] // 100 if p else 0 for p in own], np.int64)
                    keys = np.where(other & (values >= least) & (values <= most), spread, NONE)
                    at, lane = _best(keys, count)
                    chosen = [own[k] for k in lane.tolist()]
                    for name, found in {
                        "anchor_row": pa.array(rows[lane]), "anchor_id": some.column("vec_id").combine_chunks().take(pa.array(lane)),
                        "positive_row": pa.array([p["row"] for p in chosen], pa.int64()), "positive_id": pa.array([p["id"] for p in chosen], pa.int64()),
                        "positive_score": pa.array([p["score"] for p in chosen], pa.int64()),
                        "row": pa.array(block.rows[at]), "id": pa.array(block.ids[at], mask=block.null[at]), "score": pa.array(values[at, lane]),
                    }.items():
                        parts.setdefault(name, []).append(found)
        return _rows(key[1].as_py(), parts)

    return run


def mine(vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: float = 256.0) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    An anchor's positives are its best ``positives`` other rows of the same label; the negatives of each are the
    best ``negatives`` rows of other labels whose score lies between ``low`` and ``high`` percent of the positive's.
    ``vectors`` has ``vec_id, label, embedding``.
    """
    numbers = whole_numbers(vectors, scale).withColumn("anchor", F.coalesce(is_anchor, F.lit(False)))
    length, least, most = (found or 0 for found in numbers.agg(F.max(F.size("numbers")), F.min(F.array_min("numbers")), F.max(F.array_max("numbers"))).first())
    dims, largest = max(8, -(-length // 8) * 8), max(1, most, -least)
    if dims * largest**2 * BLOCK >= 1 << 62:
        raise ValueError("vector components are too large for exact 64-bit scores")
    bits = int(largest).bit_length() + 1
    kind = "i4" if dims * largest**2 < 1 << 30 else "i8"
    packed = settle(numbers.mapInArrow(_packer(bits, dims), _BLOCKS))
    anchors = settle(packed.mapInArrow(_anchor_rows(bits, dims), _ANCHORS))
    cells = max(1, math.ceil(packed.count() / TOGETHER))
    stripes = max(1, math.ceil(anchors.count() / ANCHORS))

    def cell(number: Column, count: int) -> Column:
        return F.pmod(F.xxhash64(number), F.lit(count)).cast("int")

    def every(count: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(count - 1)))

    blocks = packed.drop("anchors").withColumn("cell", cell(F.col("block"), cells)).withColumn("stripe", every(stripes))

    def met(asking: DataFrame, step) -> DataFrame:
        dealt = asking.withColumn("stripe", cell(F.col("row"), stripes)).withColumn("cell", every(cells))
        return dealt.groupBy("stripe", "cell").cogroup(blocks.groupBy("stripe", "cell")).applyInArrow(step, _FOUND)

    order = [F.desc("score"), F.asc_nulls_last("id"), F.asc("row")]
    salt = F.col("cell") % 64
    near = first_rows(met(anchors, _finder(bits, dims, kind, positives)), ["anchor_row"], order, positives, salt)
    listed = near.groupBy("anchor_row").agg(F.collect_list(F.struct("row", "id", "score")).alias("positives"))
    asking = settle(anchors.join(listed, F.col("row") == F.col("anchor_row")).drop("anchor_row"))
    hard = first_rows(met(asking, _miner(bits, dims, kind, negatives, low, high)), ["anchor_row", "positive_row"], order, negatives, salt)
    return hard.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
