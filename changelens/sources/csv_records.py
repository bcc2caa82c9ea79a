"""CSV files with line breaks inside cells, read in splits.

A line break ends a row exactly if the number of quotes before it in the file is even (quotes inside cells come in
pairs).  So the files are read as plain lines, which any number of tasks can share, in two steps:

1. Every block (the stretch of a file that one task reads) tells whether it holds an odd number of quotes and how many
   rows start in it if it begins outside, or inside, of a quoted cell.  A prefix sum over the blocks of each file then
   tells in which state a block begins and to which row its first lines belong.  This table has one row per block.
2. The lines are read again and meet the row of their block.  A line that is a row of its own is one; the lines of
   longer rows, also across blocks, are put together.

Rows are shaped by their own file's header: the table of blocks holds the places of the wanted columns, so files
with any number of different headers are one scan.

The files follow RFC 4180: cells that hold quotes, separators or line breaks are quoted, quotes inside are doubled, rows
end with ``\\n`` or ``\\r\\n``.  Blank lines and files without a row are left out, missing cells are blank, surplus cells
are ignored.  A quote that is never closed makes the rest of its file one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from changelens.scratch import settle

_BLOCK = ["file", "block"]


def _lines(spark: SparkSession, path: str | list[str], pattern: str | None) -> DataFrame:
    """``file, block, at, value, quotes, inside, turn_0, turn_1``: every line, how many quotes are before it in its
    block, and how many rows have begun in the block up to it if the block begins outside (0) or inside (1) of a cell."""
    reader = spark.read.option("lineSep", "\n")
    given = (reader.option("pathGlobFilter", pattern) if pattern else reader).text(path)
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"')))
    lines = given.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"), "value", quotes.alias("quotes"),
    )
    in_block = Window.partitionBy(*_BLOCK).orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = lines.withColumn("inside", F.sum("quotes").over(in_block) - F.col("quotes"))
    begun = [F.count_if(F.col("inside") % 2 == state).over(in_block).alias(f"turn_{state}") for state in (0, 1)]
    return counted.select("*", *begun)


def _even(count: Column) -> Column:
    return count % 2 == 0


def _cells(text: Column, count: int, sep: str) -> Column:
    """The cells of a row's text as an array of ``count`` texts."""
    schema = ", ".join(f"c{k} string" for k in range(count))
    parsed = F.from_csv(text, schema, {"sep": sep, "quote": '"', "escape": '"', "multiLine": "true", "nullValue": ""})
    return F.transform(F.array(parsed), lambda row: F.array(*[row[f"c{k}"] for k in range(count)]))[0]


def blocks(lines: DataFrame) -> DataFrame:
    """``file, block, state, owner, turn, header``: quotes before the block, the block and number of the row that is
    open when it begins, and the header of its file."""
    first_row = F.when((F.col("block") == 0) & (F.col("turn_0") == 1), F.struct("at", "value"))
    summed = lines.groupBy(*_BLOCK).agg(
        F.sum("quotes").alias("quotes"), F.max("turn_0").alias("even_rows"), F.max("turn_1").alias("odd_rows"),
        F.array_join(F.transform(F.array_sort(F.collect_list(first_row)), lambda line: line["value"]), "\n").alias("header"),
    )
    by_file = Window.partitionBy("file").orderBy("block")
    before = by_file.rowsBetween(Window.unboundedPreceding, -1)
    stated = summed.withColumn("state", F.coalesce(F.sum("quotes").over(before), F.lit(0)))
    rows = F.when(_even(F.col("state")), F.col("even_rows")).otherwise(F.col("odd_rows"))
    open_row = F.last(F.when(rows > 0, F.struct(F.col("block"), rows.alias("rows"))), ignorenulls=True).over(before)
    return stated.select(
        *_BLOCK, "state", open_row["block"].alias("owner"), open_row["rows"].alias("turn"),
        F.first(_unmarked(F.col("header"))).over(by_file).alias("header"),
    )


def _unmarked(header: Column) -> Column:
    """A header without byte order mark and carriage return."""
    return F.regexp_replace(header, "\\A\ufeff|\\r\\z", "")


def _rows(lines: DataFrame, known: DataFrame) -> DataFrame:
    """``places, row``: the text of every row after the header."""
    nth = F.when(_even(F.col("state")), F.col("turn_0")).otherwise(F.col("turn_1"))
    before = F.col("state") + F.col("inside")
    named = lines.join(known, _BLOCK).select(
        *_BLOCK, "at", "value", "places", _even(before).alias("starts"), _even(before + F.col("quotes")).alias("ends"),
        F.when(nth > 0, F.col("block")).otherwise(F.col("owner")).alias("row_block"),
        F.when(nth > 0, nth).otherwise(F.col("turn")).alias("row_turn"),
    ).filter("row_block > 0 OR row_turn > 1")
    single = named.filter("starts AND ends").select("places", F.col("value").alias("row"))
    ordered = F.array_sort(F.collect_list(F.struct("block", "at", "value")))
    longer = named.filter("NOT (starts AND ends)").groupBy("file", "row_block", "row_turn").agg(F.first("places").alias("places"), ordered.alias("parts"))
    longer = longer.select("places", F.array_join(F.transform("parts", lambda line: line["value"]), "\n").alias("row"))
    return single.unionByName(longer)


def read_rows(
    spark: SparkSession, path: str | list[str], pattern: str | None = None, columns: list[str] | None = None, sep: str = ",", mixed_headers: bool = True
) -> DataFrame:
    """All files of ``path`` as text columns, blanks and missing cells as ``''``.

    Without ``columns`` every column of every header is read.  With ``mixed_headers`` off, different headers are an error.
    """
    known = settle(blocks(_lines(spark, path, pattern)))
    headers = known.select("header").distinct()
    width, different = headers.agg(F.max(F.length("header") - F.length(F.replace("header", F.lit(sep)))), F.count("*")).first()
    if different > 1 and not mixed_headers:
        raise ValueError(f"{different} different headers in {path}")
    width = (width or 0) + 1
    names = _cells(F.col("header"), width, sep)
    if columns is None:
        listed = headers.select(F.posexplode(names).alias("place", "name")).filter("name IS NOT NULL").groupBy("name").agg(F.min("place").alias("place"))
        columns = [row.name for row in listed.orderBy("place", "name").toLocalIterator()]
    placed = known.select(*_BLOCK, "state", "owner", "turn", F.array(*[F.array_position(names, F.lit(c)).cast("int") - 1 for c in columns]).alias("places"))
    rows = _rows(_lines(spark, path, pattern), placed).select("places", F.regexp_replace("row", "\\r\\z", "").alias("row")).filter("row <> ''")
    cells = rows.select("places", _cells(F.col("row"), width, sep).alias("cells"))
    return cells.select(*[F.coalesce(F.get("cells", F.get("places", F.lit(k))), F.lit("")).alias(c) for k, c in enumerate(columns)])
