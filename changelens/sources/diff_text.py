"""Unified-diff text to rows.

A diff is taken apart inside its own row with array functions: patches, then
hunks, then lines, whose numbers follow from the hunk header and the line's
place on its side.  Nothing is shuffled and no header has to be carried from
row to row.  :func:`read_patches` gives such rows, one for each patch, from files
of any number of commits and patches, which any number of tasks share.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from changelens.functions.text import folder_to_slug
from changelens.scratch import settle

_PATCH_HEAD = "diff --git "
# Inside a patch every line starts with a sign, so a line that starts like this is between patches.
_COMMIT_LINE = r"(?s)\A(?:.*\n)?commit ([0-9a-f]{7,64})(?![0-9a-f])"
_FROM_COMMIT_LINE = r"(?s)(?:\A|\n)commit [0-9a-f]{7,64}(?![0-9a-f]).*"

_HUNK_HEADER = r"\A@@ -(\d+)(?:,\d+)? \+(\d+)(?:,\d+)? @@"


# A path in double quotes, with escapes, as diffs give names that hold unusual characters.
_QUOTED = r'"[^"\\\n]*+(?:\\.[^"\\\n]*+)*+"'
# The path that both sides of a patch's first line name.
_SAME_PATH = r"\Adiff --git a/([^\n]+?) b/\1(?:\n|\z)"
_ESCAPES = {"a": "07", "b": "08", "t": "09", "n": "0A", "v": "0B", "f": "0C", "r": "0D"}


def unquoted(path: Column) -> Column:
    """A path without its quotes; octal escapes are bytes of UTF-8, others as in C.  Plain paths stay."""
    body = F.substring(path, F.lit(2), F.length(path) - 2)
    tokens = F.regexp_extract_all(body, F.lit(r"(?s)\\[0-3][0-7]{2}|\\.|[^\\]+"), F.lit(0))

    def as_hex(token: Column) -> Column:
        mark = F.substring(token, 2, 1)
        named = F.hex(mark.cast("binary"))
        for letter, code in _ESCAPES.items():
            named = F.when(mark == letter, F.lit(code)).otherwise(named)
        octal = F.lpad(F.conv(F.substring(token, 2, 3), 8, 16), 2, "0")
        escaped = F.when(F.length(token) == 4, octal).otherwise(named)
        return F.when(F.startswith(token, F.lit("\\")), escaped).otherwise(F.hex(token.cast("binary")))

    decoded = F.make_valid_utf8(F.unhex(F.array_join(F.transform(tokens, as_hex), "")).cast("string"))
    return F.when(F.startswith(path, F.lit('"')), decoded).otherwise(path)


def _extracted(text: Column, pattern: str, mark: str | None = None) -> Column:
    """First group of the pattern, empty if it is not found; only texts with ``mark`` are searched, if it is given."""
    group = F.regexp_extract(text, pattern, 1)
    return group if mark is None else F.when(F.contains(text, F.lit(mark)), group).otherwise("")


def _quoted_path(head: Column, side_mark: str, rename_mark: str, prefix: str) -> Column:
    """Path on one side of a head that holds quotes; hardly any does."""

    def found(pattern: str) -> Column:
        return F.nullif(F.regexp_extract(head, pattern, 1), F.lit(""))

    def after_prefix(path: Column) -> Column:
        return F.substring(path, 3, 2147483647)

    renamed = unquoted(found(rf"\nrename {rename_mark} ({_QUOTED}|[^\n]+)"))
    marked = after_prefix(unquoted(found(rf'\n{side_mark} ({_QUOTED}|{prefix}/[^\n\t"]+)')))
    quoted = after_prefix(unquoted(found(rf"\Adiff --git (?={_QUOTED} {_QUOTED}(?:\n|\z))({_QUOTED})")))
    return F.coalesce(renamed, marked, found(_SAME_PATH), quoted)


def _with_paths(rows: DataFrame) -> DataFrame:
    """``rows`` with ``old_path, new_path`` of their ``head``: rename line, side line, or the patch's first line, whichever is there.

    Each step is a projection of its own, so that no pattern is searched twice, and none that an earlier one makes needless.
    """
    head = F.col("head")
    sides = {"old": ("---", "from", "a"), "new": (r"\+\+\+", "to", "b")}
    for side, (side_mark, rename_mark, prefix) in sides.items():
        renamed = _extracted(head, rf"\nrename {rename_mark} ([^\n]+)", "\nrename ")
        marked = _extracted(head, rf"\n{side_mark} {prefix}/([^\n\t]+)")
        rows = rows.withColumn(f"_{side}_renamed", renamed).withColumn(f"_{side}_marked", marked)
    neither = [(F.col(f"_{side}_renamed") == "") & (F.col(f"_{side}_marked") == "") for side in sides]
    rows = rows.withColumn("_same", F.when(neither[0] | neither[1], _extracted(head, _SAME_PATH)).otherwise(""))
    for side, (side_mark, rename_mark, prefix) in sides.items():
        plain = F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in (f"_{side}_renamed", f"_{side}_marked", "_same")])
        quoted = _quoted_path(head, side_mark, rename_mark, prefix)
        rows = rows.withColumn(f"_{side}", F.when(F.contains(head, F.lit('"')), quoted).otherwise(plain))
    old, new = F.col("_old"), F.col("_new")
    return rows.withColumn("old_path", F.coalesce(old, new)).withColumn("new_path", F.coalesce(new, old))


def patches(diffs: DataFrame, text_col: str = "diff") -> DataFrame:
    """``slug, sha, patch_pos, old_path, new_path, is_binary, hunks`` per patch.

    ``diffs`` has ``slug, sha`` and a text against the first parent.  A very
    large diff may be stored in several rows that each start with a patch; a
    ``first_patch`` column then tells the position of the row's first one.
    """
    first = F.col("first_patch") if "first_patch" in diffs.columns else F.lit(0)
    texts = diffs.select("slug", "sha", first.alias("first"), F.col(text_col).alias("text"))
    several = F.contains("text", F.lit(f"\n{_PATCH_HEAD}"))
    found = F.when(several, F.split("text", rf"\n(?={_PATCH_HEAD})")).otherwise(F.array("text"))
    split = texts.select("slug", "sha", "first", F.posexplode(found).alias("at", "patch"))
    split = split.filter(F.startswith("patch", F.lit(_PATCH_HEAD)))
    parts = F.split("patch", r"\n(?=@@ -\d)")
    cut = split.select("slug", "sha", (F.col("first") + F.col("at")).alias("patch_pos"), parts.alias("parts")).select(
        "slug", "sha", "patch_pos",
        F.element_at("parts", 1).alias("head"),
        F.slice("parts", F.lit(2), F.size("parts")).alias("hunks"),
    )
    is_binary = F.contains("head", F.lit("\nBinary files ")) | F.contains("head", F.lit("\nGIT binary patch"))
    return _with_paths(cut).select("slug", "sha", "patch_pos", "old_path", "new_path", is_binary.alias("is_binary"), "hunks")


def read_patches(spark: SparkSession, folder: str, pattern: str = "*.diff") -> DataFrame:
    """``slug, sha, first_patch, diff``: one row per patch of the log files below ``folder``.

    A file is a log with patches (``commit <sha>``, author, message, then the commit's patches, and so on) and lies
    in the folder of its project (``owner_____name``).  Files are read as records that end before a line ``diff --git``, so
    any number of tasks share a file; a compressed file that cannot be cut is one block.  The commit line stands at the end of the
    record before a commit's first patch; from record to record it is carried inside each block as a task reads it, so that texts are
    not shuffled, and from block to block by a table of one row for each block but the first of a file.
    """
    given = spark.read.option("lineSep", "\n" + _PATCH_HEAD).option("pathGlobFilter", pattern).text(f"{folder}/*")
    block = ["file", "block"]
    # Most records end where the next patch of the same commit begins.
    may_end = F.contains("value", F.lit("commit "))
    next_sha = F.nullif(F.when(may_end, F.regexp_extract("value", _COMMIT_LINE, 1)).otherwise(""), F.lit(""))
    file, start = F.col("_metadata.file_path"), F.col("_metadata.file_block_start")
    marked = given.withColumns({"file": file, "block": start, "next_sha": next_sha})

    # Only files of several blocks have something to carry over.
    parted = marked.filter(F.col("_metadata.file_block_length") < F.col("_metadata.file_size"))
    # A task reads a block from end to end, so its records have consecutive numbers and need not be put in order to be counted.
    parted = parted.select(*block, "next_sha", F.monotonically_increasing_id().alias("at"))
    last = F.max_by("next_sha", F.when(F.col("next_sha").isNotNull(), F.col("at")))
    last_at = F.max(F.when(F.col("next_sha").isNotNull(), F.col("at")))
    summed = parted.groupBy(*block).agg(F.count("*").alias("n"), last.alias("sha"), (last_at - F.min("at") + 1).alias("nth"))
    summed = summed.select(*block, "n", F.when(F.col("sha").isNotNull(), F.struct("sha", "nth")).alias("commit"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    ahead = summed.withColumn("ahead", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    carried = F.when(F.col("commit").isNotNull(), F.struct(F.col("commit.sha").alias("sha"), (F.col("ahead") + F.col("commit.nth")).alias("nth")))
    blocks = ahead.select(*block, "ahead", F.last(carried, ignorenulls=True).over(earlier).alias("open"))
    blocks = settle(blocks.filter("block > 0"))

    text = F.when(may_end, F.regexp_replace("value", _FROM_COMMIT_LINE, "")).otherwise(F.col("value"))
    records = marked.select(
        F.xxhash64("file").alias("file_hash"), F.when(F.col("block") > 0, F.col("file")).alias("file"), "block",
        folder_to_slug(F.regexp_replace("file", "/[^/]*$", "")).alias("slug"), "next_sha", text.alias("text"),
    )
    mine = records.mapInArrow(_carried, "file string, block long, slug string, text string, nth long, sha string, sha_nth long")
    mine = mine.join(F.broadcast(blocks), block, "left").withColumn("ahead", F.coalesce("ahead", F.lit(0)))
    place = F.col("ahead") + F.col("nth")
    start = F.coalesce(F.col("ahead") + F.col("sha_nth"), F.col("open.nth"))
    first = (F.col("block") == 0) & (F.col("nth") == 1)
    found = mine.select(
        "slug", F.coalesce("sha", "open.sha").alias("sha"),
        (place - start - 1).cast("int").alias("first_patch"), F.concat(F.lit(_PATCH_HEAD), "text", F.lit("\n")).alias("diff"), first.alias("_first"),
    )
    return found.filter("NOT _first AND sha IS NOT NULL").drop("_first")


def _carried(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds ``nth``, a record's place in its block from 1, and the last commit line before it there: ``sha``, and its place ``sha_nth``.

    Records come as they are read, block after block; texts are passed on as they are.
    """
    block, n, sha, sha_nth = None, 0, None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        at, shas = np.arange(batch.num_rows), batch.column("next_sha")
        names = np.stack([batch.column(c).to_numpy() for c in ("file_hash", "block")])
        begins = np.concatenate([[block is None or (names[:, 0] != block).any()], (names[:, 1:] != names[:, :-1]).any(axis=0)])
        begin = np.maximum.accumulate(np.where(begins, at, -1))
        nth = at - begin + np.where(begin < 0, n, 1)
        marks = np.maximum.accumulate(np.where(shas.is_valid().to_numpy(zero_copy_only=False), at, -1))
        before = np.concatenate([[-1], marks[:-1]])
        # Place 0 of what is looked up is the line carried from the batch before.
        known = (before >= begin) & ((before >= 0) | (sha is not None))
        spots = pa.array(before + 1, mask=~known)
        lines = pa.concat_arrays([pa.array([sha], shas.type), shas])
        places = pa.array(np.concatenate([[sha_nth], nth]))
        kept = [batch.column(c) for c in ("file", "block", "slug", "text")]
        yield pa.RecordBatch.from_arrays(
            [*kept, pa.array(nth), lines.take(spots), places.take(spots)], ["file", "block", "slug", "text", "nth", "sha", "sha_nth"]
        )
        block, n = names[:, -1], int(nth[-1])
        if marks[-1] >= max(begin[-1], 0):
            sha, sha_nth = shas[int(marks[-1])].as_py(), int(nth[marks[-1]])
        elif begin[-1] >= 0:
            sha, sha_nth = None, 0


def _side(hunk: Column, origin: str) -> Column:
    """A hunk's header and its lines on the side of ``origin``: neither empty ones nor those of the other side, nor remarks."""
    other = "+" if origin == "-" else "-"
    return F.regexp_replace(hunk, rf"\n(?:[{other}\\][^\n]*+)?+(?=\n|\z)", "")


def diff_lines(diffs: DataFrame, text_col: str = "diff") -> DataFrame:
    """Added and removed lines with their numbers; one row with a null origin for a patch without lines.

    A line's number follows from its place among the lines of its side, which are split from a text without the other
    side's lines.  A hunk that has no lines on a side is not split for it.
    """
    kept = ["slug", "sha", "patch_pos", "hunk_pos", "old_path", "new_path", "is_binary"]
    hunks = patches(diffs, text_col).select("*", F.posexplode_outer("hunks").alias("hunk_pos", "hunk")).drop("hunks")
    starts = [F.regexp_extract("hunk", _HUNK_HEADER, group).alias(name) for group, name in ((1, "old"), (2, "new"))]
    placed = hunks.select(*kept, "hunk", *starts)
    origins = {"-": "old", "+": "new"}
    has = {origin: F.coalesce(F.contains("hunk", F.lit(f"\n{origin}")), F.lit(False)) for origin in origins}

    def side(origin: str) -> Column:
        start = F.nullif(F.col(origins[origin]), F.lit("")).cast("int")
        return F.struct(F.lit(origin).alias("origin"), start.alias("start"), _side(F.col("hunk"), origin).alias("text"))

    nothing = F.struct(F.lit(None).cast("string").alias("origin"), F.lit(None).cast("int").alias("start"), F.lit("").alias("text"))
    sides = [F.when(has[origin], side(origin)) for origin in origins]
    empty = F.when(~has["-"] & ~has["+"], nothing)
    by_side = placed.select(*kept, F.explode(F.array(*sides, empty)).alias("side")).filter("side IS NOT NULL").select(*kept, "side.*")
    lines = by_side.select(*kept, "origin", "start", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    on_side = lines.filter(F.col("origin").isNull() | F.startswith("line", "origin"))

    def number(origin: str) -> Column:
        return F.when(F.col("origin") == origin, F.col("start") + F.col("at") - 1)

    content = F.when(F.col("origin").isNotNull(), F.substring("line", 2, 2147483647))
    return on_side.select(*kept, "origin", number("-").alias("old_lineno"), number("+").alias("new_lineno"), content.alias("content"))


def file_changes_from_diffs(diffs: DataFrame, text_col: str = "diff") -> DataFrame:
    """Patch totals straight from the text, without a row per line and without a shuffle."""

    def count(origin: str) -> Column:
        return F.aggregate(
            "hunks",
            F.lit(0).cast("bigint"),
            lambda total, hunk: total
            + F.size(F.filter(F.split(hunk, "\n"), lambda line: F.startswith(line, F.lit(origin)))),
        )

    return patches(diffs, text_col).select(
        "slug", "sha", "patch_pos", "old_path", "new_path", "is_binary", count("+").alias("loc_ins"), (-count("-")).alias("loc_del")
    )
