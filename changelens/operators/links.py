"""From commit messages to issues, and from issues to bug-fixing commits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changelens.functions.mentions import mentioned_issues
from changelens.functions.times import seconds_between

# Labels that mark an issue as a bug report.
VALID_LABELS = ("fix", "bug-fix", "retain")


def with_parents(commits: DataFrame) -> DataFrame:
    """Commits that are not the root of their history."""
    return commits.filter(F.col("num_parents") > 0)


def issue_mentions(commits: DataFrame) -> DataFrame:
    """``(slug, sha, ts, line_num, number)``: issues named in each message line, lines counted from 1."""
    lines = commits.select("slug", "sha", "ts", F.posexplode(F.split("message", "\n")).alias("_at", "_line"))
    may_mention = F.contains("_line", F.lit("#")) | F.contains("_line", F.lit("GH-"))
    return lines.filter(may_mention).select(
        "slug", "sha", "ts", (F.col("_at") + 1).alias("line_num"), F.explode(mentioned_issues(F.col("_line"))).alias("number")
    )


def latest_issues(issues: DataFrame, order_col: str | None = None) -> DataFrame:
    """One row per ``(slug, number)``; the last by ``order_col`` wins.

    An aggregate, not a window: partial results keep one row per key and task,
    so an issue fetched very often does not pile up anywhere.
    """
    keys = ["slug", "number"]
    rest = [c for c in issues.columns if c not in keys]
    ranked = F.struct(*([order_col] if order_col else []), *rest)
    return (
        issues.groupBy(*keys)
        .agg(F.max_by(F.struct(*rest), ranked).alias("_last"))
        .select(*keys, *[F.col("_last")[c].alias(c) for c in rest])
    )


def issue_links(commits: DataFrame, issues: DataFrame, *more: str) -> DataFrame:
    """Each mention of a known issue, with the seconds since it was opened and closed.

    ``issues`` holds one row per ``(slug, number)`` (see :func:`latest_issues`).
    ``delta_closed`` is null for an issue that was never closed.  ``more`` names columns of the issue to be kept.
    """
    known = issues.select("slug", "number", "created_at", "closed_at", "is_pl", *more)
    return (
        issue_mentions(with_parents(commits))
        .join(known, ["slug", "number"])
        .select(
            "slug",
            F.col("sha").alias("commit_sha"),
            "line_num",
            F.col("number").alias("issue_number"),
            F.col("is_pl").alias("issue_is_pl"),
            seconds_between(F.col("ts"), F.col("created_at")).alias("delta_open"),
            seconds_between(F.col("ts"), F.col("closed_at")).alias("delta_closed"),
            *more,
        )
    )


def judged_links(commits: DataFrame, issues: DataFrame, valid_labels: Sequence[str] = VALID_LABELS) -> DataFrame:
    """Links with ``is_fix``: what :func:`fixing_commits` asks, without meeting the issues again."""
    found = issue_links(commits, issues, "labels")
    return found.withColumn("is_fix", is_bug_fix(F.col("labels"), valid_labels)).drop("labels")


def is_bug_fix(labels: Column, valid_labels: Sequence[str] = VALID_LABELS) -> Column:
    """Whether a link closes a bug: made while the issue was open, not a pull request, labels fit.

    An issue without labels fits; one that is still open does not.
    """
    unlabelled = labels.isNull() | (F.size(labels) == 0)
    labels_fit = unlabelled | F.arrays_overlap(labels, F.array(*[F.lit(label) for label in valid_labels]))
    while_open = (F.col("delta_open") > 0) & (F.col("delta_closed") <= 0)
    return F.coalesce(while_open & ~F.col("issue_is_pl") & labels_fit, F.lit(False))


def fixing_commits(links: DataFrame, issues: DataFrame, valid_labels: Sequence[str] = VALID_LABELS) -> DataFrame:
    """``(slug, sha)`` of commits with at least one bug-fixing link; ``issues.labels`` is an array."""
    if "is_fix" in links.columns:
        return links.filter("is_fix").select("slug", F.col("commit_sha").alias("sha")).distinct()
    labelled = issues.select("slug", F.col("number").alias("issue_number"), "labels")
    return (
        links.join(labelled, ["slug", "issue_number"])
        .filter(is_bug_fix(F.col("labels"), valid_labels))
        .select("slug", F.col("commit_sha").alias("sha"))
        .distinct()
    )


def pending_issues(wanted: DataFrame, done: DataFrame) -> DataFrame:
    """Distinct wanted ``(slug, number)`` that were not processed yet."""
    keys = ["slug", "number"]
    return wanted.select(*keys).distinct().join(done.select(*keys), keys, "left_anti")
