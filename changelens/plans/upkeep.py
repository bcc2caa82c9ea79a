"""Keeping a history up to date: a change set rewrites what it touches and reads nothing else.

What is known of a project's history depends on that project alone, so the unit of upkeep is the project: the inputs
of the touched projects are read (as a partition filter), the change set is put over them (a later record of one commit
or issue replaces the earlier one), their tables are derived anew, and all is published as one version that replaces
those projects only.  A change set that repeats what is known touches nothing.

Identities know no projects, so the alias map is derived from all contributors, which is a small table.  Projects whose
developers got another representative are reported anew as well, without deriving their history.  Reports are kept
in units of project and year; of the reported projects only units whose rows differ from the published ones are
written.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from changelens.at_once import at_once
from changelens.functions.text import slug_to_folder
from changelens.operators import activity as A
from changelens.operators import links as L
from changelens.operators.aliases import AliasResolution
from changelens.operators.changes import COMMIT
from changelens.plans.bug_history import analyse_history, keeper
from changelens.plans.report import PROJECT_REPORT
from changelens.scratch import settle
from changelens.sources.tables import PROJECT, Draft, published, read_native, write_aliases

#: What a change set may hold, and the columns by which a later record replaces an earlier one.
INPUTS = {"commits": COMMIT, "issues": ["slug", "number"], "diff_lines": COMMIT, "blame_hunks": ["slug", "fix_sha"], "file_changes": COMMIT}
_SMALL_FIRST = ("issues", "commits", "file_changes", "blame_hunks", "diff_lines")
_UNIT = [PROJECT, "year"]


def _input(name: str) -> str:
    return f"given_{name}"


#: Types whose values are hashed as they are; others are hashed as JSON.
_PLAIN = (T.IntegralType, T.StringType, T.BooleanType, T.DateType, T.TimestampType, T.BinaryType)


def _row_hash(df: DataFrame) -> Column:
    """Hash of a row's values that tells nulls apart; whole numbers of any width are alike."""
    parts = []
    for field in sorted(df.schema.fields, key=lambda f: f.name):
        value = F.col(field.name)
        if isinstance(field.dataType, T.IntegralType):
            value = value.cast("bigint")
        elif not isinstance(field.dataType, _PLAIN):
            value = F.to_json(F.struct(value), {"ignoreNullFields": "false"})
        parts += [value, F.isnull(field.name)]
    return F.xxhash64(*parts)


def _sums(df: DataFrame, keys: list[str]) -> DataFrame:
    """Number and hash sum of the rows of each key, the sum in halves of 32 bits that cannot overflow."""
    high, low = F.shiftright("_row", 32), F.col("_row").bitwiseAND(F.lit(0xFFFFFFFF))
    hashed = df.select(*keys, _row_hash(df).alias("_row"))
    return hashed.groupBy(*keys).agg(F.struct(F.count("*").alias("n"), F.sum(high).alias("high"), F.sum(low).alias("low")).alias("_sum"))


def differing(new: DataFrame, old: DataFrame, keys: list[str], only_new: bool) -> DataFrame:
    """Keys whose rows are not the same in both tables; with ``only_new``, of keys that ``new`` has."""
    both = _sums(new, keys).withColumnRenamed("_sum", "_new_sum").join(_sums(old, keys), keys, "left" if only_new else "full")
    return both.filter(~F.col("_new_sum").eqNullSafe(F.col("_sum"))).select(*keys)


def _put_over(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of both; a key that ``new`` has is taken from there alone."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def update(
    spark: SparkSession, folder: str, changes: dict[str, DataFrame], issue_order: str, **settings
) -> DataFrame:
    """Put a change set over the history in ``folder`` (empty at first) and publish the result as one version.

    ``changes`` has some of ``INPUTS``; ``commits``, ``issues`` and ``diff_lines`` must be there the first time, and
    the other two then or never.  ``issue_order`` tells the later of two records of an issue.  Returns the touched projects (``project_folder``).
    """
    known = {row.table for row in published(spark, folder)}
    inputs = dict(changes)
    if "issues" in inputs:
        inputs["issues"] = L.latest_issues(inputs["issues"], issue_order)
    first = _input("commits") not in known
    draft = Draft(spark, folder)
    with at_once(spark) as begin:
        # If all is new, what the draft holds of an input is what it is read from.
        begun = {name: begin(keeper(draft), inputs[name], _input(name)) if first else begin(settle, inputs[name]) for name in INPUTS if name in inputs}
        inputs = {name: step.result() for name, step in begun.items()}
    merged = dict(inputs) if first else {}
    projects = _in_any(inputs) if first else _differing_projects(spark, folder, inputs)
    touched = settle(projects.select("slug", slug_to_folder(F.col("slug")).alias(PROJECT)).distinct())
    units = None if first else touched.select(PROJECT)
    if touched.isEmpty():
        return touched.select(PROJECT)

    keep = keeper(draft, units)

    def merge(name: str) -> DataFrame:
        old = read_native(spark, folder, _input(name), units=units)
        new = inputs.get(name)
        if new is not None and name == "issues":
            # A record that came late may be older than the one that is known.
            rows = L.latest_issues(old.unionByName(new, allowMissingColumns=True), issue_order).join(touched.select("slug"), "slug", "left_semi")
        elif new is not None:
            rows = _put_over(old, new.join(touched.select("slug"), "slug", "left_semi"), INPUTS[name])
        else:
            rows = old
        return keep(rows, _input(name))

    if not first:
        with at_once(spark) as begin:
            begun = {name: begin(merge, name) for name in INPUTS if _input(name) in known}
            merged = {name: step.result() for name, step in begun.items()}

    def keep_and_resolve(table: DataFrame, name: str) -> DataFrame:
        """Identities are resolved over all contributors as soon as these are known."""
        kept = keep(table, name)
        if name == "contributors":
            write_aliases(AliasResolution(draft.read("contributors")), draft)
        return kept

    analyse_history(
        merged["commits"], merged["issues"], merged["diff_lines"], merged.get("blame_hunks"),
        issue_order=issue_order, file_changes=merged.get("file_changes"), keep=keep_and_resolve, **settings,
    )
    reported = _with_renamed(spark, folder, draft, touched.select(PROJECT), first)
    _report(spark, folder, draft, reported, first)
    draft.publish()
    return touched.select(PROJECT)


def _in_any(inputs: dict[str, DataFrame]) -> DataFrame:
    """Projects that any of the inputs has."""
    return reduce(DataFrame.unionByName, [df.select("slug").distinct() for df in inputs.values()])


def _differing_projects(spark: SparkSession, folder: str, inputs: dict[str, DataFrame]) -> DataFrame:
    """Projects of which any of the inputs has what is not known yet; small inputs decide first, larger ones about the projects left."""
    found = None
    for name in (name for name in _SMALL_FIRST if name in inputs):
        df = inputs[name] if found is None else inputs[name].join(found, "slug", "left_anti")
        mine = df.select(slug_to_folder(F.col("slug")).alias(PROJECT)).distinct()
        old = read_native(spark, folder, _input(name), units=mine).select(*df.columns)
        new = differing(df, old, INPUTS[name], only_new=True).select("slug").distinct()
        found = settle(new if found is None else found.unionByName(new).distinct())
    return found


def _with_renamed(spark: SparkSession, folder: str, draft: Draft, touched: DataFrame, first: bool) -> DataFrame:
    """The touched projects and those where a representative changed."""
    if first:
        return touched
    before = read_native(spark, folder, "alias_map").select("uid", F.col("rep").alias("old_rep"))
    changed = draft.written("alias_map").join(before, "uid", "full").filter(~F.col("rep").eqNullSafe(F.col("old_rep"))).select("uid")
    people = draft.read("contributors").select("slug", F.col("contributor_id").alias("uid"))
    moved = people.join(changed, "uid", "left_semi").select(slug_to_folder(F.col("slug")).alias(PROJECT))
    return settle(touched.unionByName(moved).distinct())


def _report(spark: SparkSession, folder: str, draft: Draft, reported: DataFrame, first: bool) -> None:
    """The daily project report of some projects, written in the units that differ."""
    aliases = draft.written("alias_map")
    names = ("blames_commit", "blamed_commit", "issue_links", "contributors")
    units = None if first else reported
    induced = settle(A.induced_bugs(*(draft.read(t, units) for t in names), aliases))
    report = A.activity_by_project(draft.read("commits", units), draft.read("file_changes", units), induced, aliases)
    report = report.withColumn(PROJECT, slug_to_folder(F.col("project"))).withColumn("year", F.year("day"))
    if first:
        draft.write(report, PROJECT_REPORT, None, _UNIT)
        return
    report = settle(report)
    old = draft.read(PROJECT_REPORT, reported, drop=False).select(*report.columns)
    changed = settle(differing(report, old, _UNIT, only_new=False))
    draft.write(report.join(changed, _UNIT, "left_semi"), PROJECT_REPORT, changed, _UNIT)
