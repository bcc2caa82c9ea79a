"""Report run: written history and alias map to activity and cross-reference tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from changelens.operators import activity as A
from changelens.operators import activity_state as S
from changelens.operators.changes import COMMIT
from changelens.operators.references import cross_references
from changelens.scratch import settle, settle_by
from changelens.sources.csv_tables import write_report, write_table
from changelens.functions.ids import ids_as_text, with_packed_ids
from changelens.functions.times import PERIODS
from changelens.sources.tables import Draft, read_native, write_native

PROJECT_REPORT = "user_project_date_totalcommits"
LANGUAGE_REPORT = "user_language_date_totalcommits"


#: Columns with ids of commits, which are shuffled as bytes.
COMMIT_IDS = ("sha", "commit_sha", "bug_fixing_commit", "blamed_commit")


def by_commit(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Commits and file changes of the published history as every report reads them: dealt out by commit once, ids packed."""
    tables = [with_packed_ids(read_native(spark, folder, t), *COMMIT_IDS) for t in ("commits", "file_changes")]
    return tuple(spark.table(settle_by(table.drop("message", "committer_id", "old_path"), *COMMIT)) for table in tables)


def induced_bugs(spark: SparkSession, folder: str, aliases: DataFrame, units: DataFrame | None = None) -> DataFrame:
    """Who induced which bug, from the published history (of some ``units`` only, if they are given)."""
    tables = ("blames_commit", "blamed_commit", "issue_links", "contributors")
    return A.induced_bugs(*(with_packed_ids(read_native(spark, folder, t, units=units), *COMMIT_IDS) for t in tables), aliases)


def write_reports(
    spark: SparkSession, folder: str, period: str = "day", compat: bool = False, catalog: DataFrame | None = None,
    interchange: str | None = None,
) -> None:
    """Write both activity reports next to the history they come from.

    Weeks and months get their own tables.  ``compat`` concerns the daily
    project report only.  ``interchange`` names a folder for the CSV form, sorted
    as the report files are.
    """
    (facts, changes), aliases = by_commit(spark, folder), read_native(spark, folder, "alias_map")
    induced = settle(induced_bugs(spark, folder, aliases))
    if compat:
        by_project = A.activity_by_project_compat(facts, changes, induced, aliases)
    else:
        by_project = A.activity_by_project(facts, changes, induced, aliases, period)
    by_language = A.activity_by_language(facts, changes, aliases, period, catalog)
    draft = Draft(spark, folder)
    names = [_name(PROJECT_REPORT, period), _name(LANGUAGE_REPORT, period)]
    for report, name in zip((by_project, by_language), names):
        draft.write(report, name)
    draft.publish()
    if interchange:
        for name in names:
            write_report(A.in_report_order(read_native(spark, folder, name)), f"{interchange}/{name}")


def _name(report: str, period: str) -> str:
    return report if period == "day" else f"{report}_{period}"


def write_every_period(spark: SparkSession, folder: str, catalog: DataFrame | None = None) -> None:
    """Write both reports for days, weeks and months, and the daily state that they are merged from, in one version.

    Commits and files are read once for each report; every period comes from the written state.
    """
    (facts, changes), aliases = by_commit(spark, folder), read_native(spark, folder, "alias_map")
    induced = settle(induced_bugs(spark, folder, aliases))
    draft = Draft(spark, folder)
    states = {PROJECT_REPORT: S.project_state(facts, changes, induced, aliases), LANGUAGE_REPORT: S.language_state(facts, changes, aliases, catalog)}
    for name, state in states.items():
        draft.write(ids_as_text(state.sums), f"{name}_sums")
        draft.write(ids_as_text(state.sets), f"{name}_sets")
        state.sums, state.sets = draft.written(f"{name}_sums"), draft.written(f"{name}_sets")
        for period in PERIODS:
            draft.write(S.roll_up(state, period), _name(name, period))
    draft.publish()


def write_cross_references(spark: SparkSession, folder: str, messages: str = "commits", interchange: str | None = None) -> None:
    """Write the references found in commit messages and in the ``comments`` table, as CSV too if a folder is named."""
    texts = read_native(spark, folder, messages)
    write_native(cross_references(texts, read_native(spark, folder, "comments")), folder, "cross_references")
    if interchange:
        write_table(read_native(spark, folder, "cross_references"), interchange, "cross_references")
