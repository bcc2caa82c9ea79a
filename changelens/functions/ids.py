"""Ids as bytes: commits and contributors are known by hexadecimal digests, which are half as long without the spelling.

Any text may be packed: what is no lower-case hexadecimal number keeps its characters, and a first byte tells which it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TEXT, _DIGITS = b"\x00", b"\x01"


def packed(id_: Column) -> Column:
    """The id as bytes, different for different ids; null stays null."""
    digits = F.unhex(id_)
    return F.when(F.lower(F.hex(digits)) == id_, F.concat(F.lit(_DIGITS), digits)).otherwise(F.concat(F.lit(_TEXT), id_.cast("binary")))


def unpacked(id_: Column) -> Column:
    """The id that :func:`packed` was given."""
    rest = F.substring(id_, 2, 2**31 - 1)
    return F.when(F.substring(id_, 1, 1) == F.lit(_DIGITS), F.lower(F.hex(rest))).otherwise(rest.cast("string"))


def with_packed_ids(rows: DataFrame, *ids: str) -> DataFrame:
    """``rows`` with those of the columns ``ids`` that they have packed."""
    return rows.select(*[packed(F.col(c)).alias(c) if c in ids else c for c in rows.columns])


def ids_as_text(rows: DataFrame) -> DataFrame:
    """``rows`` with every packed id as it was; no other column may be binary."""
    return rows.select(*[unpacked(F.col(f.name)).alias(f.name) if isinstance(f.dataType, T.BinaryType) else f.name for f in rows.schema])
