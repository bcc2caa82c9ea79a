"""Facts about commits, the files they touch and the people behind them.

``file_changes`` has one row per patch of a commit: ``slug, sha, patch_pos,
old_path, new_path, is_binary, loc_ins, loc_del`` with ``loc_del`` <= 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changelens.functions.files import file_label, is_doc
from changelens.functions.people import contributor_id
from changelens.functions.text import first_line, last_segment, stripped
from changelens.operators.links import with_parents

COMMIT = ["slug", "sha"]

# Files per row of ``commit_file_lists``; longer lists continue in the next row.
LIST_PART = 1000


def file_changes(diff_lines: DataFrame) -> DataFrame:
    """Count the added and removed lines of each patch.

    A patch without text lines (binary, or a mode change) has a single row in
    ``diff_lines`` with a null ``origin``.
    """
    return diff_lines.groupBy(*COMMIT, "patch_pos").agg(
        F.min("old_path").alias("old_path"),
        F.min("new_path").alias("new_path"),
        F.bool_or("is_binary").alias("is_binary"),
        F.count_if(F.col("origin") == "+").alias("loc_ins"),
        (-F.count_if(F.col("origin") == "-")).alias("loc_del"),
    )


def commit_files(changes: DataFrame) -> DataFrame:
    """Base name, line counts and role of each patch; the role is that of the base name alone."""
    base = last_segment(F.col("new_path"))
    return changes.select(
        *COMMIT, "patch_pos", base.alias("commit_file"), "loc_ins", "loc_del", file_label(base).alias("lang")
    )


def is_source() -> Column:
    """Text patches whose full path is not documentation; tests and configuration count."""
    return ~F.col("is_binary") & ~is_doc(F.col("new_path"))


def commit_file_entries(changes: DataFrame) -> DataFrame:
    """The file list of each commit, one row per text patch, with a source flag."""
    return changes.filter(~F.col("is_binary")).select(
        *COMMIT, "patch_pos", last_segment(F.col("new_path")).alias("file"), is_source().alias("is_src")
    )


def commit_file_lists(changes: DataFrame, part_size: int = LIST_PART) -> DataFrame:
    """File and source-file lists in patch order, in parts of bounded length.

    ``part`` 0 holds the patches at positions below ``part_size``, part 1 the
    following ones and so on, so that no commit, however large, ends up in one
    array.  An ordinary commit has just part 0.
    """
    parts = commit_file_entries(changes).withColumn(
        "part", F.floor(F.col("patch_pos") / part_size).cast("int")
    )
    ordered = F.array_sort(F.collect_list(F.struct("patch_pos", "file", "is_src")))
    return (
        parts.groupBy(*COMMIT, "part")
        .agg(ordered.alias("_files"))
        .select(
            *COMMIT,
            "part",
            F.transform("_files", lambda f: f["file"]).alias("files"),
            F.transform(F.filter("_files", lambda f: f["is_src"]), lambda f: f["file"]).alias("src_files"),
        )
    )


def change_totals(changes: DataFrame) -> DataFrame:
    """Totals of each commit's patches; deleted lines are positive here."""
    source = F.col("is_src")
    return changes.withColumn("is_src", is_source()).groupBy(*COMMIT).agg(
        F.sum("loc_ins").alias("num_additions"),
        F.sum(-F.col("loc_del")).alias("num_deletions"),
        F.count("*").alias("num_files_changed"),
        F.sum(F.when(source, F.col("loc_ins")).otherwise(0)).alias("src_loc_added"),
        F.sum(F.when(source, -F.col("loc_del")).otherwise(0)).alias("src_loc_deleted"),
        F.count_if(source).alias("num_src_files_touched"),
    )


TOTALS = [
    "num_additions", "num_deletions", "num_files_changed", "src_loc_added", "src_loc_deleted", "num_src_files_touched",
]


def commit_facts(commits: DataFrame, changes: DataFrame) -> DataFrame:
    """One row per non-root commit with ids, clean message and change totals.

    ``commits`` has ``slug, sha, ts, author_name, author_email,
    committer_name, committer_email, message, num_parents``; ``ts`` is the
    author time.  Of repeated rows of a commit the greatest stands for all, so
    that results do not depend on the order in which they arrive.
    """
    read = ["ts", "author_name", "author_email", "committer_name", "committer_email", "message", "num_parents"]
    known = with_parents(commits).groupBy(*COMMIT).agg(F.max(F.struct(*read)).alias("_c")).select(*COMMIT, "_c.*")
    return known.join(change_totals(changes), COMMIT, "left").select(
        *COMMIT,
        "ts",
        contributor_id(F.col("author_name"), F.col("author_email")).alias("author_id"),
        contributor_id(F.col("committer_name"), F.col("committer_email")).alias("committer_id"),
        stripped(F.col("message")).alias("message"),
        "num_parents",
        *[F.coalesce(total, F.lit(0)).alias(total) for total in TOTALS],
    )


def with_first_line_messages(commits: DataFrame) -> DataFrame:
    """Commits with only the first line of their message, unstripped, as kept for origin commits."""
    return commits.withColumn("message", first_line(F.col("message")))


def contributors(*commit_tables: DataFrame) -> DataFrame:
    """Distinct authors and committers per project over any number of commit tables."""
    people = None
    for commits in commit_tables:
        # Both people of a commit in one row, so that they fall together before they are shuffled if they are the same.
        both = [
            F.struct(contributor_id(name, email).alias("contributor_id"), F.lower(name).alias("name"), F.lower(email).alias("email"))
            for name, email in ((F.col(f"{role}_name"), F.col(f"{role}_email")) for role in ("author", "committer"))
        ]
        side = with_parents(commits).select("slug", F.explode(F.array_distinct(F.array(*both))).alias("_p")).select("slug", "_p.*")
        people = side if people is None else people.unionByName(side)
    return one_record_per_contributor(people)


def one_record_per_contributor(people: DataFrame) -> DataFrame:
    """One name and address per ``(slug, contributor_id)``; the greatest pair stands for the last one seen."""
    return (
        people.groupBy("slug", "contributor_id")
        .agg(F.max(F.struct("name", "email")).alias("_p"))
        .select("slug", "contributor_id", "_p.name", "_p.email")
    )
