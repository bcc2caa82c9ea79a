"""Reports: bugs induced per developer, and activity per developer, project, language and period.

Commits, files and bugs are dealt out by the report's keys in one shuffle, and
every measure is taken there.  Distinct counts come from grouping by the counted value first, so no
list of files or issues is ever gathered, however busy a developer, project or
day is.  The rows of one row of a report are counted in one task, which spills.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from changelens.functions import fixed_values as V
from changelens.functions.files import is_doc
from changelens.functions.ids import packed, unpacked
from changelens.functions.people import is_platform
from changelens.functions.text import last_segment
from changelens.functions.times import activity_period
from changelens.operators.changes import COMMIT, commit_file_entries, is_source
from changelens.operators.classify import guess_language
from changelens.scratch import settle_by

PROJECT_MEASURES = [
    "num_commits", "num_file_touches", "num_src_file_touches", "num_files_touched", "num_src_files_touched",
    "loc_added", "src_loc_added", "loc_deleted", "src_loc_deleted", "num_bugs_induced", "num_bug_inducing_commits",
]

LANGUAGE_MEASURES = [
    "num_commits", "num_src_file_touches", "num_src_files_touched", "src_loc_added", "src_loc_deleted", "num_distinct_commits",
]

# Measures that add up, and the facts they are sums of.
TOTALS_OF = {"loc_added": "num_additions", "src_loc_added": "src_loc_added", "loc_deleted": "num_deletions", "src_loc_deleted": "src_loc_deleted"}

# Patch positions per step when a commit's files are numbered.
NUMBERING_STEP = 1000


def with_representative(df: DataFrame, aliases: DataFrame, id_col: str, out_col: str = "user_id") -> DataFrame:
    """Replace an identity by its representative; an unknown one stands for itself."""
    reps = aliases.select(F.col("uid").alias(id_col), F.col("rep").alias("_rep"))
    return _represented(df, reps, id_col, out_col)


def _represented(df: DataFrame, reps: DataFrame, id_col: str, out_col: str) -> DataFrame:
    return df.join(reps, id_col, "left").withColumn(out_col, F.coalesce("_rep", id_col)).drop("_rep")


def with_packed_representative(df: DataFrame, aliases: DataFrame, id_col: str, out_col: str = "user_id") -> DataFrame:
    """The same with packed identities (``functions.ids``), as they are shuffled."""
    reps = aliases.select(packed(F.col("uid")).alias(id_col), packed(F.col("rep")).alias("_rep"))
    return _represented(df.withColumn(id_col, packed(F.col(id_col))), reps, id_col, out_col)


def induced_bugs(
    blames: DataFrame, origin_commits: DataFrame, links: DataFrame, contributors: DataFrame, aliases: DataFrame
) -> DataFrame:
    """``user_id, slug, sha, issue_number, fixing_sha, times``: who induced which bug, in which commit.

    Blames on documentation, unknown authors and the hosting platform's own
    identity are left out.  ``times`` counts the blame rows and message lines
    behind a row, which the history keeps as repeated list entries.
    """
    known = contributors.groupBy("slug", F.col("contributor_id").alias("author_id")).agg(
        F.min(F.struct("name", "email")).alias("who")
    )
    # Identities are resolved for people, who are fewer than commits, and looked up for commits that are blamed.
    people = with_packed_representative(known.filter(~is_platform(F.col("who.name"), F.col("who.email"))), aliases, "author_id")
    authors = origin_commits.select("slug", F.col("sha").alias("blamed_commit"), packed(F.col("author_id")).alias("author_id"))
    authors = authors.dropDuplicates(["slug", "blamed_commit"])
    blamed = (
        blames.filter(F.col("type") != V.DOC)
        .groupBy("slug", "bug_fixing_commit", "blamed_commit")
        .agg(F.count("*").alias("blame_rows"))
        .join(authors, ["slug", "blamed_commit"])
        .join(people.select("slug", "author_id", "user_id"), ["slug", "author_id"])
    )
    # Dealt out once, by what they are counted by and met by.
    linked = links.select("slug", F.col("commit_sha").alias("bug_fixing_commit"), "issue_number").repartition("slug", "bug_fixing_commit")
    linked = linked.groupBy("slug", "bug_fixing_commit", "issue_number").agg(F.count("*").alias("link_rows"))
    return blamed.join(linked, ["slug", "bug_fixing_commit"]).select(
        unpacked(F.col("user_id")).alias("user_id"), "slug", F.col("blamed_commit").alias("sha"), "issue_number",
        F.col("bug_fixing_commit").alias("fixing_sha"), (F.col("blame_rows") * F.col("link_rows")).alias("times"),
    )


def induced_bugs_per_commit(induced: DataFrame) -> DataFrame:
    """Per bug-inducing commit: distinct issues, and the length of the list of fixes behind them."""
    per_issue = induced.groupBy("user_id", "slug", "sha", "issue_number").agg(F.sum("times").alias("times"))
    return per_issue.groupBy("user_id", "slug", "sha").agg(
        F.count("*").alias("num_issues"), F.sum("times").alias("num_fixes")
    )


def packed_commits(facts: DataFrame, aliases: DataFrame, period: str, columns: list[str]) -> DataFrame:
    """Commits with ``user_id`` (packed), project, report period and ``columns``, written once and bucketed by commit.

    Narrow, and read by every measure; identities are joined once.
    """
    dated = facts.select(*COMMIT, "author_id", activity_period(F.col("ts"), period).alias(period), *columns)
    found = with_packed_representative(dated, aliases, "author_id").drop("author_id")
    return facts.sparkSession.table(settle_by(found, *COMMIT)).withColumn("project", F.col("slug"))


def distinct_bugs(induced: DataFrame, user_id: Column) -> DataFrame:
    """Developer, commit and issue, dealt out by commit."""
    return induced.select(user_id.alias("user_id"), *COMMIT, "issue_number").repartition(*COMMIT).distinct()


def add_up(parts: list[DataFrame], keys: list[str], measures: list[str]) -> DataFrame:
    """Sum partial reports over ``keys``; a measure missing from a part counts as 0 there."""
    whole = None
    for part in parts:
        missing = [F.lit(0).cast("bigint").alias(m) for m in measures if m not in part.columns]
        present = [F.col(m).cast("bigint").alias(m) for m in measures if m in part.columns]
        padded = part.select(*keys, *present, *missing).select(*keys, *measures)
        whole = padded if whole is None else whole.unionByName(padded)
    return whole.groupBy(*keys).agg(*[F.sum(m).alias(m) for m in measures])


def commit_measures(commits: DataFrame, keys: list[str]) -> DataFrame:
    return commits.groupBy(*keys).agg(
        F.count("*").alias("num_commits"),
        F.sum("num_additions").alias("loc_added"),
        F.sum("src_loc_added").alias("src_loc_added"),
        F.sum("num_deletions").alias("loc_deleted"),
        F.sum("src_loc_deleted").alias("src_loc_deleted"),
    )


def activity_by_project(
    facts: DataFrame, changes: DataFrame, induced: DataFrame, aliases: DataFrame, period: str = "day"
) -> DataFrame:
    """Activity per developer, project and day, week or month.

    ``facts`` and ``changes`` come from ``operators.changes``, ``induced`` from
    :func:`induced_bugs`.  For weeks and months the distinct measures are
    counted anew from the files and issues; they are not sums of days.
    """
    keys = ["user_id", "project", period]
    once = project_rows(facts, changes, induced, aliases, period, lambda rows: rows.repartition(*keys))
    return count_project_rows(once, keys, PROJECT_MEASURES).withColumn("user_id", unpacked(F.col("user_id")))


def project_rows(
    facts: DataFrame, changes: DataFrame, induced: DataFrame, aliases: DataFrame, period: str, deal: Callable[[DataFrame], DataFrame]
) -> DataFrame:
    """What the report by project counts, a row for each different ``value`` of a ``kind`` (commit, file, issue) in each of its rows.

    ``n`` is the number of commits, touches or bugs behind a row and ``flag`` that of source files or of bug-inducing
    commits; ``user_id`` is packed.  ``deal`` brings together what is counted together: one shuffle for all measures.
    """
    keys = ["user_id", "project", period]
    totals = TOTALS_OF
    commits = packed_commits(facts, aliases, period, list(totals.values()))
    spot = commits.select(*COMMIT, *keys)

    def counted(rows: DataFrame, kind: str, value: Column, flag: Column) -> DataFrame:
        """Rows of one kind: ``value`` is what is counted once, ``flag`` what is added up."""
        sums = [(F.col(c) if c in rows.columns else F.lit(0)).cast("bigint").alias(m) for m, c in totals.items()]
        return rows.select(*keys, F.lit(kind).alias("kind"), value.cast("string").alias("value"), flag.cast("bigint").alias("flag"), *sums)

    files = commit_file_entries(changes).select(*COMMIT, "file", "is_src").join(spot, COMMIT)
    # A bug counts for a commit only under the developer that commit is filed under.
    bugs = distinct_bugs(induced, packed(F.col("user_id"))).join(spot, [*COMMIT, "user_id"])
    in_commit = Window.partitionBy(*COMMIT, *keys).orderBy("issue_number")
    bugs = bugs.withColumn("first", F.row_number().over(in_commit) == 1)
    rows = (
        counted(commits, "commit", F.lit(None), F.lit(0))
        .unionByName(counted(files, "file", F.col("file"), F.col("is_src").cast("int")))
        .unionByName(counted(bugs, "issue", F.col("issue_number"), F.col("first").cast("int")))
    )
    return deal(rows).groupBy(*keys, "kind", "value").agg(
        F.count("*").alias("n"), F.sum("flag").alias("flag"), *[F.sum(m).alias(m) for m in totals]
    )


def count_project_rows(once: DataFrame, keys: list[str], measures: list[str]) -> DataFrame:
    """``measures`` of the report from its :func:`project_rows`."""

    def of(kind: str) -> Column:
        return F.col("kind") == kind

    def total(kind: str, column: str) -> Column:
        return F.sum(F.when(of(kind), F.col(column)).otherwise(0))

    found = [
        total("commit", "n").alias("num_commits"),
        total("file", "n").alias("num_file_touches"),
        total("file", "flag").alias("num_src_file_touches"),
        F.count_if(of("file")).alias("num_files_touched"),
        F.count_if(of("file") & (F.col("flag") > 0)).alias("num_src_files_touched"),
        *[F.sum(m).alias(m) for m in TOTALS_OF],
        F.count_if(of("issue")).alias("num_bugs_induced"),
        total("issue", "flag").alias("num_bug_inducing_commits"),
    ]
    return once.groupBy(*keys).agg(*found).select(*keys, *measures)


def _numbered_files(changes: DataFrame) -> DataFrame:
    """File entries with their rank among the commit's text patches, 1 for the first.

    Ranks are taken inside steps of ``NUMBERING_STEP`` positions and shifted
    by the size of the steps before, so a huge commit is not sorted in one task.
    """
    entries = commit_file_entries(changes).withColumn("step", F.floor(F.col("patch_pos") / NUMBERING_STEP))
    before = Window.partitionBy(*COMMIT).orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy(*COMMIT, "step").orderBy("patch_pos")
    counted = Window.partitionBy(*COMMIT, "step", "is_src").orderBy("patch_pos")
    steps = (
        entries.groupBy(*COMMIT, "step")
        .agg(F.count("*").alias("n"), F.count_if("is_src").alias("n_src"))
        .select(
            *COMMIT, "step",
            F.coalesce(F.sum("n").over(before), F.lit(0)).alias("skip"),
            F.coalesce(F.sum("n_src").over(before), F.lit(0)).alias("skip_src"),
        )
    )
    return (
        entries.withColumn("rank", F.row_number().over(inside))
        .withColumn("src_rank", F.row_number().over(counted))
        .join(steps, [*COMMIT, "step"])
        .select(
            *COMMIT, "file", "is_src", (F.col("rank") + F.col("skip")).alias("rank"),
            (F.col("src_rank") + F.col("skip_src")).alias("src_rank"),
        )
    )


def _fingerprint(member: Column, *parts: Column) -> list[Column]:
    """Number of members, and two sums of independent 64-bit hashes: equal for equal collections of rows."""
    wide = "decimal(20,0)"
    return [F.count_if(member), *[F.sum(F.when(member, F.xxhash64(F.lit(seed), *parts)).cast(wide)) for seed in ("left", "right")]]


def activity_by_project_compat(
    facts: DataFrame, changes: DataFrame, induced: DataFrame, aliases: DataFrame
) -> DataFrame:
    """The daily report as historically written, where each non-empty list counts as one entry.

    A commit's file list, source-file list and issue list are then single
    values: touches count commits with a list, distinct measures count
    different lists.  A list is told apart by its length and a 128-bit sum of
    hashes over rank and file (issues: the issue), so it need not be gathered.
    """
    keys = ["user_id", "project", "day"]
    totals = TOTALS_OF
    commits = packed_commits(facts, aliases, "day", list(totals.values()))

    def digest(member: Column, *value: Column) -> Column:
        """One value for each list; null for an empty one."""
        length, left, right = _fingerprint(member, *value)
        return F.when(length > 0, F.unhex(F.md5(F.concat_ws(" ", length, left, right))))

    files = _numbered_files(changes).groupBy(*COMMIT).agg(
        digest(F.lit(True), F.col("rank"), F.col("file")).alias("file"),
        digest(F.col("is_src"), F.col("src_rank"), F.col("file")).alias("src_file"),
    )
    bugs = distinct_bugs(induced, packed(F.col("user_id"))).join(commits.select(*COMMIT, "user_id"), [*COMMIT, "user_id"])
    issues = bugs.groupBy(*COMMIT).agg(digest(F.lit(True), F.col("issue_number")).alias("issue"))
    kinds = ["file", "src_file", "issue"]
    rows = commits.join(files, COMMIT, "left").join(issues, COMMIT, "left")
    # Every measure is taken where its row of the report is: one shuffle for all of them.
    whole = [F.struct(F.lit("commit").alias("kind"), F.lit(None).cast("binary").alias("value"), *[F.col(c).alias(m) for m, c in totals.items()])]
    nothing = [F.lit(0).cast("bigint").alias(m) for m in totals]
    lists = [F.when(F.col(k).isNotNull(), F.struct(F.lit(k).alias("kind"), F.col(k).alias("value"), *nothing)) for k in kinds]
    once = (
        rows.select(*keys, *totals.values(), *kinds).repartition(*keys)
        .select(*keys, F.explode(F.array_compact(F.array(*whole, *lists))).alias("row")).select(*keys, "row.*")
        .groupBy(*keys, "kind", "value").agg(F.count("*").alias("n"), *[F.sum(m).alias(m) for m in totals])
    )

    def touches(kind: str) -> Column:
        return F.sum(F.when(F.col("kind") == kind, F.col("n")).otherwise(0))

    def different(kind: str) -> Column:
        return F.count_if(F.col("kind") == kind)

    return once.groupBy(*keys).agg(
        touches("commit").alias("num_commits"),
        touches("file").alias("num_file_touches"), touches("src_file").alias("num_src_file_touches"),
        different("file").alias("num_files_touched"), different("src_file").alias("num_src_files_touched"),
        *[F.sum(m).alias(m) for m in totals],
        different("issue").alias("num_bugs_induced"), touches("issue").alias("num_bug_inducing_commits"),
    ).select(unpacked(F.col("user_id")).alias("user_id"), *keys[1:], *PROJECT_MEASURES)


def source_file_rows(changes: DataFrame) -> DataFrame:
    """Source files of each commit with the line counts of the first patch of that base name.

    A base name touched n times as a source file has ``rows`` = n.  Files whose
    first patch counts as documentation by base name are left out.
    """
    base = last_segment(F.col("new_path"))
    patches = changes.select(
        *COMMIT, base.alias("file"), "patch_pos", is_source().alias("is_src"),
        F.struct("loc_ins", "loc_del", is_doc(base).alias("is_doc")).alias("counts"),
    )
    return (
        patches.groupBy(*COMMIT, "file")
        .agg(F.count_if("is_src").alias("rows"), F.min_by("counts", "patch_pos").alias("first"))
        .filter((F.col("rows") > 0) & ~F.col("first.is_doc"))
        .select(*COMMIT, "file", "rows", "first.loc_ins", "first.loc_del")
    )


def activity_by_language(
    facts: DataFrame,
    changes: DataFrame,
    aliases: DataFrame,
    period: str = "day",
    catalog: DataFrame | None = None,
) -> DataFrame:
    """Activity per developer, language and day, week or month.

    ``num_commits`` counts file rows, as the report always did;
    ``num_distinct_commits`` counts commits.  Deleted lines are negative.
    """
    keys = ["user_id", "language", period]
    dated = facts.select(*COMMIT, "author_id", activity_period(F.col("ts"), period).alias(period))
    spot = with_packed_representative(dated, aliases, "author_id").drop("author_id")
    rows = guess_language(source_file_rows(changes).join(spot, COMMIT), "file", "language", catalog)
    rows = first_in_commit(rows, keys)
    summed = ["rows", "loc_ins", "loc_del", "first"]
    by_file = rows.select(*keys, "file", "rows", *[(F.col("rows") * F.col(c)).alias(c) for c in summed[1:3]], "first")
    return (
        by_file.repartition(*keys).groupBy(*keys, "file").agg(*[F.sum(c).alias(c) for c in summed])
        .groupBy(*keys)
        .agg(
            F.sum("rows").alias("num_commits"),
            F.sum("rows").alias("num_src_file_touches"),
            F.count("*").alias("num_src_files_touched"),
            F.coalesce(F.sum("loc_ins"), F.lit(0)).alias("src_loc_added"),
            F.coalesce(F.sum("loc_del"), F.lit(0)).alias("src_loc_deleted"),
            F.sum("first").alias("num_distinct_commits"),
        )
        .select(unpacked(F.col("user_id")).alias("user_id"), *keys[1:], *LANGUAGE_MEASURES)
    )


def first_in_commit(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``first``: 1 for one file row of each commit in a row of the report, so that commits are counted beside files."""
    in_commit = Window.partitionBy(*COMMIT, *keys).orderBy("file")
    return rows.withColumn("first", (F.row_number().over(in_commit) == 1).cast("bigint"))


def language_sums(rows: DataFrame, keys: list[str]) -> DataFrame:
    """What adds up over the file rows (:func:`first_in_commit`) of a report by language."""
    return rows.groupBy(*keys).agg(
        F.sum("rows").alias("num_commits"),
        F.sum("rows").alias("num_src_file_touches"),
        F.coalesce(F.sum(F.col("rows") * F.col("loc_ins")), F.lit(0)).alias("src_loc_added"),
        F.coalesce(F.sum(F.col("rows") * F.col("loc_del")), F.lit(0)).alias("src_loc_deleted"),
        F.sum("first").alias("num_distinct_commits"),
    )


def in_report_order(report: DataFrame) -> DataFrame:
    """Rows as the report files list them: by time, then developer, then project or language."""
    by, period = report.columns[1], report.columns[2]
    return report.orderBy(period, "user_id", by)
