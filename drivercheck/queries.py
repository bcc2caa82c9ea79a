"""Registered queries: each runs library operators over whole tables of a folder."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from changelens.functions import people, text, times
from changelens.functions.ids import ids_as_text
from changelens.operators import activity, activity_state, aliases, changes, ingest, links, origins, references
from changelens.operators.classify import classify_files, guess_language, label_lines
from changelens.scratch import fresh_path, settle, settle_by
from changelens.sources import csv_tables, diff_text, tables
from drivercheck.views import WrittenHistory, view

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(run: Query) -> Query:
    QUERIES[run.__name__] = run
    return run


def _as_text(moment: str) -> Column:
    """Dates and times in one spelling, whatever the engine's own."""
    return F.date_format(moment, "yyyy-MM-dd HH:mm:ss").alias(moment)


# Inputs shared by several queries -------------------------------------------------


class Steps:
    """Lazily derived inputs of one query, from views that are named but not run here."""

    def __init__(self, named: Callable[[str], DataFrame]):
        self.named = named

    @cached_property
    def commits(self) -> DataFrame:
        return self.named("vw_commits")

    @cached_property
    def issues(self) -> DataFrame:
        known = links.latest_issues(self.named("vw_issues"), "version")
        return known.withColumn("labels", text.split_list(F.col("labels")))

    @cached_property
    def links(self) -> DataFrame:
        return links.issue_links(self.commits, self.issues)

    def judged_links(self) -> DataFrame:
        """Links that tell fixes, written once and bucketed by commit: fixes and induced bugs both start from them."""
        found = links.judged_links(self.commits, self.issues).select("slug", "commit_sha", "issue_number", "is_fix")
        return found.sparkSession.table(settle_by(found, "slug", "commit_sha"))

    @cached_property
    def fixes(self) -> DataFrame:
        return links.fixing_commits(self.links, self.issues)

    @cached_property
    def changes(self) -> DataFrame:
        return self.named("vw_file_changes").drop("ts", "l_orderkey", "l_partkey", "qty")

    @cached_property
    def facts(self) -> DataFrame:
        return changes.commit_facts(self.commits, self.changes)

    def facts_by_commit(self) -> DataFrame:
        """What reports and origins need of the facts, written once and bucketed by commit."""
        facts = self.facts.drop("message", "committer_id")
        return facts.sparkSession.table(settle_by(facts, *changes.COMMIT))

    @cached_property
    def diff_lines(self) -> DataFrame:
        return self.named("vw_diff_lines")

    @cached_property
    def removed(self) -> DataFrame:
        return origins.removed_lines(self.fixes, self.diff_lines)

    @cached_property
    def blamed_lines(self) -> DataFrame:
        return origins.lines_with_origin(self.removed, self.named("vw_blame_hunks"))

    @cached_property
    def plausible(self) -> DataFrame:
        return origins.plausible_origins(self.facts)

    @cached_property
    def blames(self) -> DataFrame:
        return origins.bug_origins(self.blamed_lines, self.plausible)

    @cached_property
    def aliases(self) -> DataFrame:
        return self.named("vw_aliases")

    @cached_property
    def induced(self) -> DataFrame:
        people_ = changes.contributors(self.commits)
        return activity.induced_bugs(self.blames, self.facts, self.links, people_, self.aliases)


def _given(spark: SparkSession, sf_dir: str) -> Steps:
    """Straight from the given tables."""
    return Steps(lambda name: view(spark, sf_dir, name))


def _written(spark: SparkSession, sf_dir: str) -> Steps:
    """With commits and file changes written once and ids of commits packed, for queries of many steps."""
    return Steps(WrittenHistory(spark, sf_dir, packed=True).view)


def _report_inputs(steps: Steps) -> tuple[DataFrame, ...]:
    """Facts, changes, induced bugs, aliases; what a report reads repeatedly is settled first."""
    steps.facts, steps.links = steps.facts_by_commit(), steps.judged_links()
    steps.aliases = settle(steps.aliases)
    steps.induced = settle(steps.induced)
    return steps.facts, steps.changes, steps.induced, steps.aliases


def _resolution(spark: SparkSession, sf_dir: str) -> aliases.AliasResolution:
    return aliases.AliasResolution(view(spark, sf_dir, "vw_contributors"))


# Names, paths, lines --------------------------------------------------------------


@query
def slug_folder_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    slug = F.col("slug")
    folder = text.slug_to_folder(slug)
    return (
        _given(spark, sf_dir).commits
        .groupBy(slug)
        .agg(F.count("*").alias("num_commits"))
        .select(
            slug,
            folder.alias("folder"),
            text.slug_to_file_stem(slug).alias("file_stem"),
            text.folder_to_slug(F.concat(F.lit("/data/repos/"), folder, F.lit("/"))).alias("back"),
            "num_commits",
        )
    )


@query
def file_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = classify_files(_given(spark, sf_dir).changes, "new_path", "label")
    base = text.last_segment(F.col("new_path"))
    return labelled.select(
        "sha", "patch_pos", "new_path", base.alias("base"), text.extension(base).alias("ext"),
        text.root_name(base).alias("root"), "label",
    )


@query
def file_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _given(spark, sf_dir).changes.select("sha", "patch_pos", text.last_segment(F.col("new_path")).alias("file"))
    return guess_language(files, "file", "language")


@query
def line_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = view(spark, sf_dir, "vw_diff_lines").filter("origin is not null")
    return (
        label_lines(lines, "content", "line_label")
        .groupBy("origin", "content", "line_label")
        .agg(F.count("*").alias("n"))
    )


@query
def period_indexes(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = times.commit_day(F.col("ts"))
    return _given(spark, sf_dir).commits.select(
        "sha", day.cast("string").alias("day"),
        times.period_index(day, "week").alias("week"), times.period_index(day, "month").alias("month"),
    )


# Links and fixes ------------------------------------------------------------------


@query
def issue_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.issue_mentions(links.with_parents(_given(spark, sf_dir).commits)).drop("ts")


@query
def issue_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    # An issue that was never closed has no second difference; -1 stands for that here.
    return _given(spark, sf_dir).links.withColumn("delta_closed", F.coalesce("delta_closed", F.lit(-1.0)))


@query
def fixing_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _given(spark, sf_dir).fixes


@query
def pending_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = view(spark, sf_dir, "vw_issues").select("slug", "number")
    worked_on = _given(spark, sf_dir).links.filter("delta_open > 0 and delta_closed <= 0")
    return links.pending_issues(wanted, worked_on.select("slug", F.col("issue_number").alias("number")))


# Commits, files, people -----------------------------------------------------------


@query
def commit_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = _given(spark, sf_dir).facts
    return facts.select(*[c for c in facts.columns if c != "ts"], _as_text("ts"))


@query
def commit_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.commit_files(_given(spark, sf_dir).changes)


@query
def commit_file_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = changes.commit_file_lists(_given(spark, sf_dir).changes)
    return lists.select(
        "slug", "sha", "part", text.join_list(F.col("files")).alias("files"),
        text.join_list(F.col("src_files")).alias("src_files"),
    )


@query
def file_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.file_changes(view(spark, sf_dir, "vw_diff_lines"))


@query
def contributor_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.contributors(_given(spark, sf_dir).commits)


# Origins --------------------------------------------------------------------------


@query
def bug_origins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ids_as_text(_written(spark, sf_dir).blames)


@query
def line_origins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Removed lines inside blame hunks of a few to ten million lines."""
    steps = _written(spark, sf_dir)
    found = origins.lines_with_origin(steps.removed, steps.named("vw_wide_hunks"))
    spans = found.groupBy("slug", "fix_sha", "path", "blamed_sha").agg(
        F.count("*").alias("lines"), F.min("old_lineno").alias("first_line"), F.max("old_lineno").alias("last_line")
    )
    return ids_as_text(spans)


@query
def bug_origins_compat(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = _written(spark, sf_dir)
    when = steps.commits.select("slug", "sha", F.col("ts").alias("committed_at"))
    return ids_as_text(origins.bug_origins_compat(steps.blamed_lines, steps.plausible, when))


@query
def bug_origins_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = _written(spark, sf_dir)
    added = steps.diff_lines.filter("origin = '+'")
    lines = origins.lines_with_latest_addition(
        steps.removed,
        steps.commits.select("slug", "sha", "ts"),
        added.select("slug", F.col("new_path").alias("path"), "content", "sha", "ts"),
    )
    return ids_as_text(origins.bug_origins(lines, steps.plausible))


@query
def line_origins_renamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Origins by content of files that change their names again and again."""
    steps = _written(spark, sf_dir)
    moves = settle(steps.named("vw_moves"))
    removed = moves.select("slug", F.col("sha").alias("fix_sha"), F.col("old_path").alias("path"), "patch_pos", F.col("removed").alias("content"))
    added = moves.select("slug", F.col("new_path").alias("path"), F.col("added").alias("content"), "sha", "ts")
    found = origins.lines_with_latest_addition(removed, steps.commits.select("slug", "sha", "ts"), added, moves.select("slug", "old_path", "new_path", "ts"))
    return ids_as_text(found.select("slug", "fix_sha", "path", "patch_pos", "content", "blamed_sha"))


# Identities -----------------------------------------------------------------------


@query
def email_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = aliases.identities(view(spark, sf_dir, "vw_contributors"))
    none = F.lit("(null)")
    return found.select(
        "uid", "name", "is_real", F.coalesce("email", none).alias("email"), F.coalesce("prefix", none).alias("prefix"),
        F.coalesce("domain", none).alias("domain"),
        F.coalesce(people.is_composite(F.col("prefix")), F.lit(False)).alias("is_composite"),
    )


@query
def identity_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = aliases.identities(view(spark, sf_dir, "vw_contributors"))
    return aliases.bucket_sizes(aliases.identity_keys(found))


@query
def identity_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = aliases.identities(view(spark, sf_dir, "vw_contributors"))
    return aliases.pair_clues(aliases.clues(aliases.identity_keys(found)))


@query
def email_pair_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = aliases.identities(view(spark, sf_dir, "vw_contributors"))
    return aliases.email_credits(found, aliases.email_buckets(found))


@query
def alias_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _resolution(spark, sf_dir).clusters


@query
def alias_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _resolution(spark, sf_dir).groups


@query
def alias_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _resolution(spark, sf_dir).map()


@query
def alias_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _resolution(spark, sf_dir).members().withColumn("email", F.coalesce("email", F.lit("(null)")))


@query
def alias_shared_email(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _resolution(spark, sf_dir).shared_emails().withColumn("email", F.coalesce("email", F.lit("(null)")))


# Cross references -----------------------------------------------------------------


@query
def cross_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    return references.cross_references(_given(spark, sf_dir).commits, view(spark, sf_dir, "vw_comments"))


# Reports --------------------------------------------------------------------------


@query
def induced_bugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ids_as_text(_induced(spark, sf_dir))


def _induced(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = _written(spark, sf_dir)
    steps.facts, steps.links = steps.facts_by_commit(), steps.judged_links()
    return steps.induced


@query
def induced_bugs_per_commit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ids_as_text(activity.induced_bugs_per_commit(_induced(spark, sf_dir)))


def _project_report(spark: SparkSession, sf_dir: str, period: str) -> DataFrame:
    return activity.activity_by_project(*_report_inputs(_written(spark, sf_dir)), period)


def _day_as_text(report: DataFrame) -> DataFrame:
    return report.withColumn("day", F.col("day").cast("string"))


@query
def activity_by_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _day_as_text(activity.in_report_order(_project_report(spark, sf_dir, "day")))


@query
def activity_by_project_compat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _day_as_text(activity.activity_by_project_compat(*_report_inputs(_written(spark, sf_dir))))


@query
def activity_weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _project_report(spark, sf_dir, "week")


@query
def activity_monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _project_report(spark, sf_dir, "month")


def _language_report(spark: SparkSession, sf_dir: str, period: str) -> DataFrame:
    steps = _given(spark, sf_dir)
    return activity.activity_by_language(steps.facts, steps.changes, steps.aliases, period)


@query
def activity_by_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _day_as_text(_language_report(spark, sf_dir, "day"))


@query
def activity_by_language_monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _language_report(spark, sf_dir, "month")


def _every_period(state: activity_state.ActivityState) -> DataFrame:
    """Day, week and month reports of one state, with the period's value as text."""
    state.sums, state.sets = (part.sparkSession.table(settle_by(part, *state.group)) for part in (state.sums, state.sets))
    reports = [
        activity_state.roll_up(state, period).withColumn("value", F.col(period).cast("string")).drop(period).withColumn("period", F.lit(period))
        for period in times.PERIODS
    ]
    return reports[0].unionByName(reports[1]).unionByName(reports[2])


@query
def activity_every_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _every_period(activity_state.project_state(*_report_inputs(_written(spark, sf_dir))))


@query
def activity_by_language_every_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = _written(spark, sf_dir)
    return _every_period(activity_state.language_state(steps.facts, steps.changes, steps.aliases))


@query
def activity_whole_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links, fixes, origins, identities and the daily report in one go."""
    steps = _written(spark, sf_dir)
    steps.aliases = _resolution(spark, sf_dir).map()
    return _day_as_text(activity.activity_by_project(*_report_inputs(steps)))


# Ingest and files -----------------------------------------------------------------


def _issue_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as the JSON objects a code-hosting API would deliver."""
    tables_ = spark.read.parquet(f"{sf_dir}/events.parquet")
    at = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    person = F.struct(F.concat(F.lit("user"), F.col("user_id")).alias("login"), F.col("user_id").alias("id"))
    login_only = F.struct(F.concat(F.lit("user"), F.col("user_id") + 1).alias("login"))
    payload = F.struct(
        F.col("event_id").alias("id"),
        (F.col("event_id") % 1000).cast("int").alias("number"),
        F.when(F.col("event_type") == "signup", "open").otherwise("closed").alias("state"),
        at.alias("created_at"),
        at.alias("closed_at"),
        F.when(F.col("user_id") % 7 != 0, person).alias("user"),
        F.when(F.col("user_id") % 3 != 0, login_only).alias("closed_by"),
        F.concat(F.lit("  Report\r\n on "), "props", F.lit(" \n")).alias("title"),
        (F.col("event_id") % 9).cast("int").alias("comments"),
        F.when(F.col("event_id") % 2 == 0, F.array(F.struct(F.col("event_type").alias("name")), F.struct(F.lit("ui").alias("name"))))
        .otherwise(F.array(F.struct(F.col("event_type").alias("name"))))
        .alias("labels"),
        F.when(F.col("event_type") == "purchase", F.struct(F.lit("https://pulls").alias("url"))).alias("pull_request"),
    )
    slug = F.concat(F.lit("org"), F.col("event_id") % 5, F.lit("/proj"), F.col("event_id") % 25)
    return tables_.select(slug.alias("slug"), F.to_json(payload).alias("payload"))


@query
def normalise_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.lit("(null)")
    found = ingest.normalise_issues(_issue_payloads(spark, sf_dir))
    return found.select(
        "slug", "id", "number", "state", _as_text("created_at"), _as_text("closed_at"),
        F.coalesce("created_by_login", none).alias("created_by_login"),
        F.coalesce("closed_by_login", none).alias("closed_by_login"),
        F.coalesce("assignee_login", none).alias("assignee_login"),
        "title", "num_comments", text.join_list(F.col("labels")).alias("labels"), "is_pl",
    )


def _comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as discussion, documents as reviews, both as JSON objects."""

    def payloads(rows: DataFrame, key: str, comment_id: Column, user: Column, anonymous: Column) -> DataFrame:
        person = F.struct(F.concat(F.lit("user"), user).alias("login"), user.alias("id"))
        payload = F.struct(
            comment_id.alias("id"), F.concat(F.lit(" \n"), "text", F.lit("\t\n")).alias("body"),
            F.lit("2020-01-02T03:04:05Z").alias("created_at"), F.lit("2020-01-02T03:04:06Z").alias("updated_at"),
            F.when(~anonymous, person).alias("user"),
        )
        slug = F.concat(F.lit("org"), F.col(key) % 5, F.lit("/proj"), F.col(key) % 25)
        return rows.select(
            slug.alias("slug"), F.col(key).alias("issue_id"), F.col(key).cast("int").alias("issue_number"),
            F.to_json(payload).alias("payload"),
        )

    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return ingest.normalise_comments(
        payloads(turns, "conv_id", F.col("conv_id") * 1000 + F.col("turn"), F.col("turn"), F.lit(False)),
        payloads(documents, "doc_id", F.col("doc_id"), F.col("n_chars"), F.col("doc_id") % 5 == 0),
    )


@query
def normalise_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _comments(spark, sf_dir)
    return found.select(
        *[c for c in found.columns if c not in ("created_at", "updated_at")], _as_text("created_at"), _as_text("updated_at")
    )


@query
def comments_per_issue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.comments_per_issue(view(spark, sf_dir, "vw_comments"))


@query
def diff_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = diff_text.diff_lines(view(spark, sf_dir, "vw_diff_text"))
    none = F.lit("(null)")
    return found.select(
        "slug", "sha", "patch_pos", "old_path", "new_path", "is_binary",
        F.coalesce("hunk_pos", F.lit(-1)).alias("hunk_pos"), F.coalesce("origin", none).alias("origin"),
        F.coalesce("old_lineno", F.lit(-1)).alias("old_lineno"), F.coalesce("new_lineno", F.lit(-1)).alias("new_lineno"),
        F.coalesce("content", none).alias("content"),
    )


def _log_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patches as text, a row each; the rows of a commit follow each other in one file.  Dealt out once, as log files need them."""
    texts = view(spark, sf_dir, "vw_diff_text").select(text.slug_to_folder(F.col("slug")).alias("folder"), "slug", "sha", "first_patch", "diff")
    first = F.lag("sha").over(Window.partitionBy("folder", "sha", "slug").orderBy("first_patch")).isNull()
    head = F.when(first, F.concat(F.lit("commit "), "sha", F.lit("\nAuthor: A <a@x.org>\n\n    commit message\n    diff --git\n\n"))).otherwise("")
    rows = texts.repartition("folder", "sha").select("folder", "sha", "first_patch", F.concat(head, F.rtrim("diff", F.lit("\n"))).alias("value"))
    return rows.sortWithinPartitions("folder", "sha", "first_patch").select("folder", "value")


@query
def diff_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Diff lines from log files of many commits and patches."""
    folder = fresh_path(spark, "logs")
    _log_rows(spark, sf_dir).write.partitionBy("folder").option("compression", "gzip").text(folder)
    found = diff_text.diff_lines(diff_text.read_patches(spark, folder, "part-*"))
    named = found.withColumn("slug", F.replace("slug", F.lit("folder="), F.lit("")))
    none = F.lit("(null)")
    numbered = named.withColumn("patch_pos", (F.col("patch_pos") + 1).cast("bigint"))
    return numbered.select(
        "slug", "sha", "patch_pos", "old_path", "new_path", "is_binary",
        F.coalesce("hunk_pos", F.lit(-1)).alias("hunk_pos"), F.coalesce("origin", none).alias("origin"),
        F.coalesce("old_lineno", F.lit(-1)).alias("old_lineno"), F.coalesce("new_lineno", F.lit(-1)).alias("new_lineno"),
        F.coalesce("content", none).alias("content"),
    )


@query
def file_changes_from_diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff_text.file_changes_from_diffs(view(spark, sf_dir, "vw_diff_text"))


@query
def csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comments, line breaks and all, through the interchange files and back."""
    folder = fresh_path(spark, "csv")
    csv_tables.write_table(_comments(spark, sf_dir), folder, "comments")
    back = csv_tables.read_written(spark, folder, "comments")
    return back.select(
        *[c for c in back.columns if c not in ("created_at", "updated_at")], _as_text("created_at"), _as_text("updated_at")
    )


@query
def delimited_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contributors through a ``;``-delimited file and back."""
    path = fresh_path(spark, "delimited")
    csv_tables.write_delimited(view(spark, sf_dir, "vw_contributors"), path)
    return csv_tables.read_delimited(spark, path, "slug string, contributor_id string, name string, email string")


@query
def native_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issue links through the native partitioned table and back."""
    folder = fresh_path(spark, "native")
    tables.write_native(_given(spark, sf_dir).links, folder, "issue_links")
    back = tables.read_native(spark, folder, "issue_links")
    return back.withColumn("delta_closed", F.coalesce("delta_closed", F.lit(-1.0)))


@query
def typed_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues through the interchange files, missing times as ``None``, and the last row of each issue."""
    given = view(spark, sf_dir, "vw_issues")
    none = F.lit(None).cast("string")
    rows = given.select(
        "slug", F.col("version").alias("id"), F.col("number").cast("int").alias("number"), F.lit("closed").alias("state"), "created_at", "closed_at",
        none.alias("created_by_login"), none.alias("closed_by_login"), none.alias("assignee_login"), F.lit("a, \"b\"\nc").alias("title"),
        F.lit(0).alias("num_comments"), text.split_list(F.col("labels")).alias("labels"), "is_pl",
    )
    folder = fresh_path(spark, "issues")
    csv_tables.write_table(rows, folder, "issues")
    back = links.latest_issues(csv_tables.read_table(spark, f"{folder}/issues", "issues", "part-*.csv"), "id")
    never = F.lit("(null)")
    return back.select(
        "slug", "number", "id", "title", text.join_list(F.col("labels")).alias("labels"), "is_pl", _as_text("created_at"),
        F.coalesce(F.date_format("closed_at", "yyyy-MM-dd HH:mm:ss"), never).alias("closed_at"),
    )


@query
def folder_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contributors from files of which some lack a column and have the others in another order."""
    folder = fresh_path(spark, "scan")
    people_ = view(spark, sf_dir, "vw_contributors")
    csv_tables.write_report(people_.filter("length(name) % 2 = 0").select("slug", "contributor_id", "name", "email"), f"{folder}/kind=a")
    csv_tables.write_report(people_.filter("length(name) % 2 = 1").select("name", "slug", "contributor_id"), f"{folder}/kind=b")
    return csv_tables.read_folder(spark, folder, "part-*.csv", ["slug", "contributor_id", "name", "email"], mixed_headers=True)


@query
def project_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Projects from a text file with blanks around names and lines without one."""
    path = fresh_path(spark, "projects")
    slugs = view(spark, sf_dir, "vw_commits").select("slug").distinct()
    lines = slugs.select(F.explode(F.array(F.concat(F.lit("  "), "slug", F.lit(" ")), F.lit("   "))).alias("value"))
    lines.write.text(path)
    return csv_tables.read_project_list(spark, path)


@query
def cross_reference_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cross references through their written table and its interchange file."""
    from changelens.plans import report

    folder = fresh_path(spark, "references")
    draft = tables.Draft(spark, folder)
    draft.write(view(spark, sf_dir, "vw_commits").select("slug", "sha", "message"), "commits")
    draft.write(view(spark, sf_dir, "vw_comments"), "comments")
    draft.publish()
    report.write_cross_references(spark, folder, interchange=f"{folder}/files")
    return csv_tables.read_written(spark, f"{folder}/files", "cross_references")


@query
def alias_audit_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three audit files of an identity run, read back and told apart."""
    from changelens.plans import people as people_plan

    folder = fresh_path(spark, "audit")
    tables.write_native(view(spark, sf_dir, "vw_contributors"), folder, "contributors")
    people_plan.resolve_identities(spark, folder, f"{folder}/audit")
    mapped = csv_tables.read_delimited(spark, f"{folder}/audit/idm_map", "uid string, rep string")
    found = mapped.select(F.lit("map").alias("file"), F.lit("").alias("cluster"), "rep", "uid", F.lit("").alias("rules"), F.lit("").alias("email"))
    for name in ("log", "maybe"):
        listed = csv_tables.read_delimited(spark, f"{folder}/audit/idm_{name}", "cluster string, rules string, rep string, uid string, name string, email string")
        found = found.unionByName(listed.select(F.lit(name).alias("file"), "cluster", "rep", "uid", "rules", F.coalesce("email", F.lit("")).alias("email")))
    return found


@query
def author_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Author times from epoch seconds."""
    commits = view(spark, sf_dir, "vw_commits").select("sha", times.seconds(F.col("ts")).alias("epoch"))
    return commits.select("sha", F.date_format(times.utc_time(F.col("epoch")), "yyyy-MM-dd HH:mm:ss").alias("ts"))


@query
def rejected_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issue payloads, some of them cut short, without id, missing, or with an impossible time."""
    given = _issue_payloads(spark, sf_dir)
    number = F.get_json_object("payload", "$.id").cast("bigint")
    broken = (
        F.when(number % 11 == 0, F.left("payload", F.length("payload") - 3))
        .when(number % 11 == 1, F.replace("payload", F.lit('"id":'), F.lit('"key":')))
        .when(number % 11 == 2, F.lit(None))
        .when(number % 11 == 3, F.regexp_replace("payload", '"created_at":"[^"]*"', '"created_at":"2020-99-01T00:00:00Z"'))
        .otherwise(F.col("payload"))
    )
    found = ingest.rejected_payloads(given.select("slug", broken.alias("payload")), ingest.ISSUE_PAYLOAD)
    return found.groupBy("slug", "reason").agg(F.count("*").alias("n"))


@query
def whole_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole plan through written tables: history, identities and the daily project report."""
    from changelens.plans import bug_history, people as people_plan, report

    folder = fresh_path(spark, "history")
    steps = _written(spark, sf_dir)
    commits = steps.commits.withColumn("committed_at", F.col("ts"))
    issues = view(spark, sf_dir, "vw_issues").withColumn("labels", text.split_list(F.col("labels")))
    bug_history.run_history(
        folder, commits, issues, steps.diff_lines, steps.named("vw_blame_hunks"), issue_order="version", file_changes=steps.changes,
    )
    people_plan.resolve_identities(spark, folder)
    report.write_reports(spark, folder)
    return _day_as_text(tables.read_native(spark, folder, report.PROJECT_REPORT))


@query
def history_in_two_halves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The daily project report after two change sets: the even projects with all their issues but without some commits,
    then the rest; the second reads and rewrites only the projects it touches."""
    from changelens.plans import report, upkeep

    folder = fresh_path(spark, "upkeep")
    whole = WrittenHistory(spark, sf_dir)
    commits = whole.view("vw_commits")
    issues = whole.view("vw_issues").withColumn("labels", text.split_list(F.col("labels")))
    # Of projects 0 to 11 the first set lacks a third of the commits, of the later ones it has none.
    early = F.substring_index("slug", "proj", -1).cast("int") < 12
    third = F.pmod(F.xxhash64("sha"), F.lit(3)) == 0
    shas = settle(commits.select("slug", "sha", (early & ~third).alias("first")))
    for half, named in whole.parts(shas, "first").items():
        steps = Steps(named)
        upkeep.update(spark, folder, {
            "commits": steps.commits.withColumn("committed_at", F.col("ts")), "issues": issues.filter(early == half),
            "diff_lines": steps.diff_lines, "blame_hunks": steps.named("vw_blame_hunks"), "file_changes": steps.changes,
        }, issue_order="version")
    return _day_as_text(tables.read_native(spark, folder, report.PROJECT_REPORT).drop("year"))
