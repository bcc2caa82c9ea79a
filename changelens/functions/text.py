"""Text, path and list expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FOLDER_MARK = "_____"
LIST_SEPARATOR = ";"

# Characters a Python ``str.strip()`` removes.
BLANKS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def stripped(text: Column) -> Column:
    """``text`` without leading and trailing white space of any kind."""
    return F.btrim(text, F.lit(BLANKS))


def slug_to_folder(slug: Column) -> Column:
    """``owner/name`` as a folder name."""
    return F.replace(slug, F.lit("/"), F.lit(FOLDER_MARK))


def folder_to_slug(path: Column, join_value: str = "/") -> Column:
    """Slug held by the last segment of a folder path; one trailing slash is ignored."""
    whole = F.when(F.endswith(path, F.lit("/")), F.left(path, F.length(path) - 1)).otherwise(path)
    return F.replace(last_segment(whole), F.lit(FOLDER_MARK), F.lit(join_value))


def slug_to_file_stem(slug: Column) -> Column:
    """``owner/name`` as the stem of an interchange file."""
    return F.replace(slug, F.lit("/"), F.lit("_"))


def last_segment(path: Column) -> Column:
    """Base name: what follows the last slash."""
    return F.substring_index(path, "/", -1)


def extension(base_name: Column) -> Column:
    """Last dotted part of a base name; leading dots never start an extension."""
    body = F.ltrim(base_name, F.lit("."))
    return F.when(F.contains(body, F.lit(".")), F.concat(F.lit("."), F.substring_index(body, ".", -1))).otherwise(
        F.lit("")
    )


def root_name(base_name: Column) -> Column:
    """Base name without its extension."""
    return F.left(base_name, F.length(base_name) - F.length(extension(base_name)))


def first_line(text: Column) -> Column:
    return F.substring_index(text, "\n", 1)


def one_line(text: Column) -> Column:
    """Stripped text with carriage returns and line feeds removed."""
    return F.translate(stripped(text), "\r\n", "")


def split_list(joined: Column) -> Column:
    """``a;b`` as an array, blank as null."""
    return F.when(joined != "", F.split(joined, LIST_SEPARATOR))


def join_list(items: Column) -> Column:
    """Array as ``a;b``, null as blank."""
    return F.coalesce(F.array_join(items, LIST_SEPARATOR), F.lit(""))
