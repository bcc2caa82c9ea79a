"""Classification of files and changed lines as DataFrame operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changelens.functions.files import file_label, line_label
from changelens.functions.text import extension, root_name
from changelens.sources.catalogs import EXTENSION, FILE_NAME, builtin_catalog, first_listed

AMBIGUOUS = "ambiguous"


def classify_files(df: DataFrame, path_col: str = "path", out_col: str = "label") -> DataFrame:
    """Add the role of the file named in ``path_col``."""
    return df.withColumn(out_col, file_label(F.col(path_col)))


def label_lines(df: DataFrame, line_col: str = "content", out_col: str = "line_label") -> DataFrame:
    """Add whether the changed line in ``line_col`` is code or comment."""
    return df.withColumn(out_col, line_label(F.col(line_col)))


def guess_language(
    df: DataFrame, file_col: str = "file", out_col: str = "language", catalog: DataFrame | None = None
) -> DataFrame:
    """Add the first language, in catalog order, that lists the file.

    A file with an extension belongs to the languages that list its extension
    or, as an extension, its root; one without belongs to those that list its
    name.  The built-in catalog has a fixed size, so it is sent to every executor
    and the rows of ``df`` stay where they are; a catalog that is passed is of any
    size, so adaptive execution decides by measuring it.
    """
    small = F.broadcast if catalog is None else (lambda side: side)
    catalog = builtin_catalog(df.sparkSession) if catalog is None else first_listed(catalog)
    entry = F.struct("pos", "language")
    by_extension = small(
        catalog.filter(F.col("kind") == EXTENSION).select(F.col("value").alias("_ext"), entry.alias("_hit_ext"))
    )
    by_root = small(
        catalog.select(F.col("kind").alias("_kind"), F.col("value").alias("_root"), entry.alias("_hit_root"))
    )
    name = F.col(file_col)
    ext = extension(name)
    return (
        df.withColumn("_ext", ext)
        .withColumn("_root", root_name(name))
        .withColumn("_kind", F.when(ext == "", FILE_NAME).otherwise(EXTENSION))
        .join(by_extension, "_ext", "left")
        .join(by_root, ["_kind", "_root"], "left")
        .withColumn(out_col, F.coalesce(F.least("_hit_ext", "_hit_root").getField("language"), F.lit(AMBIGUOUS)))
        .drop("_ext", "_root", "_kind", "_hit_ext", "_hit_root")
    )
