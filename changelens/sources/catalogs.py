"""Language catalogs: the built-in one and full ones read from a file.

A catalog is a small DataFrame ``(kind, value, pos, language)`` with one row
per file extension or file name, naming the first language, in catalog order,
that lists it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from changelens.functions import fixed_values as V

CATALOG_SCHEMA = "kind string, value string, pos int, language string"
EXTENSION, FILE_NAME = "extension", "filename"


def builtin_catalog(spark: SparkSession) -> DataFrame:
    """The popular languages and the most common other formats, some 200 entries kept as plain values.

    Larger catalogs are a parameter: read one with :func:`read_catalog`.  What a catalog does not list
    is ``ambiguous`` under it."""
    entries = [(lang, EXTENSION, ext) for table in (V.POPULAR_EXTENSIONS, V.OTHER_EXTENSIONS)
               for lang, exts in table.items() for ext in exts]
    entries += [(lang, FILE_NAME, name) for lang, names in V.FILE_NAMES.items() for name in names]
    order = {lang: pos for pos, lang in enumerate(sorted({entry[0] for entry in entries}))}
    rows = [(kind, value, order[lang], lang) for lang, kind, value in entries]
    return first_listed(spark.createDataFrame(rows, CATALOG_SCHEMA))


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """Read a full catalog in the public Linguist ``languages.yml`` layout.

    Languages are the top-level keys, in file order; only their ``extensions``
    and ``filenames`` lists are used.
    """
    text = spark.read.text(path, wholetext=True)
    blocks = text.select(F.posexplode(F.split("value", r"\n(?=[^\s#-][^\n]*:[ \t]*(?:\n|$))")).alias("pos", "block"))
    named = blocks.select(
        "pos",
        F.regexp_extract("block", r"""\A["']?([^\s#"'-][^"'\n]*?)["']?:[ \t]*(?:\n|\z)""", 1).alias("language"),
        F.create_map(
            F.lit(EXTENSION), F.regexp_extract("block", r"\n  extensions:[ \t]*\n((?:  +-[^\n]*(?:\n|\z))+)", 1),
            F.lit(FILE_NAME), F.regexp_extract("block", r"\n  filenames:[ \t]*\n((?:  +-[^\n]*(?:\n|\z))+)", 1),
        ).alias("lists"),
    ).filter("language <> ''")
    lists = named.select("pos", "language", F.explode("lists").alias("kind", "items"))
    entries = lists.select(
        "kind",
        F.explode(
            F.regexp_extract_all("items", F.lit(r"""-[ \t]+["']?([^"'\n]*[^"'\s])"""), F.lit(1))
        ).alias("value"),
        "pos",
        "language",
    )
    return first_listed(entries)


def first_listed(entries: DataFrame) -> DataFrame:
    """One row per extension or file name: the first language that lists it."""
    return (
        entries.groupBy("kind", "value")
        .agg(F.min(F.struct("pos", "language")).alias("first"))
        .select("kind", "value", "first.pos", "first.language")
    )
