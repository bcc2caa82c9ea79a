"""Interchange files: CSV tables with blanks for missing values.

Files are read in splits whatever their cells hold (``csv_records``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from changelens.functions.text import join_list, slug_to_file_stem, slug_to_folder, split_list
from changelens.functions.times import issue_time
from changelens.sources.csv_records import read_rows
from changelens.sources.schemas import TABLES

_WRITE = {
    "header": True, "quote": '"', "escape": '"', "encoding": "UTF-8", "nullValue": "", "emptyValue": "",
    "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False,
}


def read_folder(
    spark: SparkSession,
    folder: str,
    pattern: str = "*.csv",
    columns: list[str] | None = None,
    sep: str = ",",
    mixed_headers: bool = False,
) -> DataFrame:
    """All CSV files of a folder that match ``pattern``, as text columns with blanks as ``''``.

    Files are expected to share one header, else that is an error.  With ``mixed_headers`` they are put together by
    column name, blank where a file lacks a column; any number of different headers is one scan.
    """
    return read_rows(spark, folder, pattern, columns, sep, mixed_headers)


def _typed(column: Column, kind: str) -> Column:
    if kind == "string":
        return column
    if kind == "array<string>":
        return split_list(column)
    if kind == "issue_time":
        return issue_time(column)
    if kind == "timestamp":
        return F.try_to_timestamp(column)
    if kind == "boolean":
        return F.lower(column).try_cast("boolean")
    return column.try_cast(kind)


def read_table(spark: SparkSession, folder: str, table: str, pattern: str | None = None) -> DataFrame:
    """A known interchange table with typed, native columns; ``;``-lists become arrays."""
    fields = TABLES[table]
    text = read_folder(spark, folder, pattern or f"*_{table}.csv", [name for _, name, _ in fields])
    return text.select(*[_typed(F.col(name), kind).alias(native) for native, name, kind in fields])


def read_rejected(spark: SparkSession, folder: str, table: str, pattern: str | None = None) -> DataFrame:
    """Rows of a known table, as text, with ``rejected``: columns whose cell is neither blank nor of its type."""
    fields = TABLES[table]
    text = read_folder(spark, folder, pattern or f"*_{table}.csv", [name for _, name, _ in fields])
    broken = [
        F.when(~F.col(name).isin("", "None") & _typed(F.col(name), kind).isNull(), F.lit(name))
        for _, name, kind in fields
        if kind not in ("string", "array<string>")
    ]
    return text.withColumn("rejected", F.array_compact(F.array(*broken))).filter("size(rejected) > 0")


def as_interchange(df: DataFrame, table: str) -> DataFrame:
    """Native rows as text columns under file names; arrays ``;``-joined, missing values blank."""
    columns = []
    for native, name, kind in TABLES[table]:
        value = F.col(native)
        if kind == "array<string>":
            value = join_list(value)
        elif isinstance(df.schema[native].dataType, T.BooleanType):
            value = F.initcap(value.cast("string"))
        elif kind == "issue_time":
            value = F.coalesce(value.cast("string"), F.lit("None"))
        columns.append(F.coalesce(value.cast("string"), F.lit("")).alias(name))
    return df.select(*columns)


def write_table(df: DataFrame, folder: str, table: str) -> None:
    """Write an interchange table as CSV, one folder level per project.

    Rows are rebalanced on the project first: a task then writes few projects,
    and adaptive execution splits a project that is too large for one task.
    :func:`read_written` reads the files back.
    """
    text = as_interchange(df, table).withColumn("project", slug_to_folder(F.col("SLUG")))
    text.hint("rebalance", F.col("project")).write.mode("overwrite").options(**_WRITE).partitionBy("project").csv(f"{folder}/{table}")


def read_written(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """Read back what :func:`write_table` wrote."""
    return read_table(spark, f"{folder}/{table}", table, "part-*.csv")


def write_report(df: DataFrame, path: str) -> None:
    """A report as CSV with a header, in the order of its rows."""
    df.write.mode("overwrite").options(**_WRITE).csv(path)


def write_delimited(df: DataFrame, path: str) -> None:
    """``;``-delimited audit file."""
    df.write.mode("overwrite").options(**_WRITE, sep=";").csv(path)


def read_delimited(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """``;``-delimited file with a known schema; blanks are null."""
    fields = T.StructType.fromDDL(schema).fields
    text = read_rows(spark, path, "part-*.csv", [f.name for f in fields], ";")
    return text.select(*[F.nullif(F.col(f"`{f.name}`"), F.lit("")).try_cast(f.dataType).alias(f.name) for f in fields])


def read_project_list(spark: SparkSession, path: str) -> DataFrame:
    """``slug, folder, file_stem`` from a text file with one ``owner/name`` per line."""
    slug = F.btrim("value")
    lines = spark.read.text(path).select(slug.alias("slug")).filter("slug <> ''")
    return lines.select(
        "slug", slug_to_folder(F.col("slug")).alias("folder"), slug_to_file_stem(F.col("slug")).alias("file_stem")
    )
