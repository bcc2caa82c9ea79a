"""Bug-origin run: commits, files, links, origins and contributors of any number of projects."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from changelens.at_once import at_once
from changelens.functions.ids import ids_as_text, with_packed_ids
from changelens.operators import changes as C
from changelens.operators import links as L
from changelens.operators import origins as O
from changelens.sources.csv_tables import write_table
from changelens.sources.tables import Draft


@dataclass
class History:
    """Result tables of a run; all lazy."""

    commits: DataFrame
    file_changes: DataFrame
    commit_files: DataFrame
    issue_links: DataFrame
    blames_commit: DataFrame
    blamed_commit: DataFrame
    contributors: DataFrame


def analyse_history(
    commits: DataFrame,
    issues: DataFrame,
    diff_lines: DataFrame,
    blame_hunks: DataFrame | None = None,
    valid_labels: Sequence[str] = L.VALID_LABELS,
    max_files: int = O.MAX_FILES,
    max_new_lines: int = O.MAX_NEW_LINES,
    compat: bool = False,
    issue_order: str | None = None,
    file_changes: DataFrame | None = None,
    keep: Callable[[DataFrame, str], DataFrame] = lambda table, name: table,
) -> History:
    """Derive all result tables.

    ``issue_order`` names the column by which the last of several rows of one
    issue is known; without it the greatest row stands.  ``file_changes`` are the
    totals of each patch where they are known already.  Every result passes
    through ``keep`` with its name before later ones are derived from it (from given
    ``file_changes`` as they are); as it is, all results stay lazy (see :func:`run_history`).  Results that need not wait
    for each other are kept at once.

    Without ``blame_hunks`` the origin of a line is found by its content.
    ``compat`` gives one blame row per origin commit, as historically written;
    it needs ``committed_at`` on ``commits``.  Give a written table as
    ``diff_lines``: it is read for file totals and for origins.
    """
    issues = L.latest_issues(issues, issue_order)
    with at_once(commits.sparkSession) as begin:
        people = begin(keep, C.contributors(commits), "contributors")
        linked = begin(keep, L.issue_links(commits, issues), "issue_links")
        changes = C.file_changes(diff_lines) if file_changes is None else file_changes
        kept_changes = begin(keep, changes, "file_changes")
        if file_changes is None:
            changes = kept_changes.result()
        facts = begin(keep, C.commit_facts(commits, changes), "commits")
        files = begin(keep, C.commit_files(changes), "commit_files")
        linked, facts = linked.result(), facts.result()
        removed = O.removed_lines(L.fixing_commits(linked, issues, valid_labels), diff_lines)
        if blame_hunks is not None:
            lines = O.lines_with_origin(removed, blame_hunks)
        else:
            times = commits.select("slug", "sha", "ts")
            added = diff_lines.filter("origin = '+'").select("slug", "sha", F.col("new_path").alias("path"), "content")
            lines = O.lines_with_latest_addition(removed, times, added.join(times, ["slug", "sha"]))
        plausible = O.plausible_origins(facts, max_files, max_new_lines)
        if compat:
            blames = O.bug_origins_compat(lines, plausible, commits.select("slug", "sha", "committed_at"))
        else:
            blames = O.bug_origins(lines, plausible)
        blames = keep(blames, "blames_commit")
        blamed = C.with_first_line_messages(commits).join(
            blames.select("slug", F.col("blamed_commit").alias("sha")).distinct(), ["slug", "sha"], "left_semi"
        )
        # Facts hold stripped messages; origin commits keep their first line as it is.
        first_lines = blamed.groupBy(*C.COMMIT).agg(F.max("message").alias("first_line"))
        blamed_facts = facts.join(first_lines, ["slug", "sha"]).withColumn("message", F.col("first_line")).drop("first_line")
        blamed_facts = keep(blamed_facts, "blamed_commit")
        return History(facts, kept_changes.result(), files.result(), linked, blames, blamed_facts, people.result())


def run_history(folder: str, commits: DataFrame, issues: DataFrame, diff_lines: DataFrame, *args, interchange: str | None = None, **settings) -> History:
    """Derive and write all result tables, each computed once, and publish them together.

    A table is written as soon as it is derived and what follows reads it back, so nothing is derived twice
    and a lost executor costs at most one table.
    """
    draft = Draft(commits.sparkSession, folder)
    history = analyse_history(commits, issues, diff_lines, *args, **settings, keep=keeper(draft))
    draft.publish()
    history = History(**{name: ids_as_text(table) for name, table in vars(history).items()})
    if interchange:
        write_interchange(history, interchange)
    return history


def keeper(draft: Draft, units: DataFrame | None = None) -> Callable[[DataFrame, str], DataFrame]:
    """Writes each result to ``draft`` (of some ``units`` only, if they are given) and goes on from what is written.

    Packed ids (``functions.ids``) are written as text and packed again when they are read.
    """

    def keep(table: DataFrame, name: str) -> DataFrame:
        draft.write(table, name, units, spelled=ids_as_text)
        ids = [f.name for f in table.schema if isinstance(f.dataType, T.BinaryType)]
        return with_packed_ids(draft.written(name).select(*table.columns), *ids)

    return keep


def with_file_cells(facts: DataFrame, changes: DataFrame) -> DataFrame:
    """Commits with their file lists in one cell each, as the CSV format wants them.

    Only for interchange: the native tables keep files as rows.  Lists are put
    together from bounded parts; one commit's list is one CSV cell by format.
    """
    parts = C.commit_file_lists(changes)
    ordered = F.array_sort(F.collect_list(F.struct("part", "files", "src_files")))
    cells = parts.groupBy(*C.COMMIT).agg(ordered.alias("p")).select(
        *C.COMMIT,
        F.flatten(F.transform("p", lambda part: part["files"])).alias("files"),
        F.flatten(F.transform("p", lambda part: part["src_files"])).alias("src_files"),
    )
    return facts.join(cells, C.COMMIT, "left")


def write_history(history: History, folder: str, interchange: str | None = None) -> None:
    """Write and publish the tables of a lazy history and, if a second folder is named, write the CSV ones too.

    Each table is derived from the inputs again; :func:`run_history` derives each once.
    """
    draft = Draft(history.commits.sparkSession, folder)
    for table, df in vars(history).items():
        draft.write(df, table)
    draft.publish()
    if interchange:
        write_interchange(history, interchange)


def write_interchange(history: History, folder: str) -> None:
    """The CSV tables of a history."""
    lists = history.file_changes
    write_table(with_file_cells(history.commits, lists), folder, "commits")
    write_table(with_file_cells(history.blamed_commit, lists), folder, "blamed_commit")
    for table in ("commit_files", "issue_links", "blames_commit", "contributors"):
        write_table(getattr(history, table), folder, table)
