"""Whole runs through written tables, on the smallest given tables."""

import os

import pytest

from changelens.functions.ids import ids_as_text
from changelens.operators import activity, activity_state, changes, links, origins
from changelens.scratch import settle_by
from changelens.plans import bug_history, people, report
from changelens.session import CO_PARTITIONED, apply_settings
from changelens.sources import csv_tables, tables
from drivercheck.queries import Steps, _log_rows
from drivercheck.views import WrittenHistory, view
from tests.conftest import rows

GIVEN = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(GIVEN), reason="given tables are absent")
def test_runs_one_after_another(spark, tmp_path):
    from pyspark.sql import functions as F

    from changelens.functions.text import split_list
    from drivercheck.queries import QUERIES

    folder, files = str(tmp_path / "native"), str(tmp_path / "files")
    commits = view(spark, GIVEN, "vw_commits").withColumn("committed_at", F.col("ts"))
    issues = view(spark, GIVEN, "vw_issues").withColumn("labels", split_list(F.col("labels")))
    issues = issues.select("slug", "number", "version", "created_at", "closed_at", "labels", "is_pl")
    history = bug_history.run_history(
        folder, commits, issues, view(spark, GIVEN, "vw_diff_lines"), view(spark, GIVEN, "vw_blame_hunks"),
        issue_order="version", interchange=files,
    )
    links = QUERIES["issue_links"](spark, GIVEN).count()
    assert tables.read_native(spark, folder, "issue_links").count() == links
    back = csv_tables.read_written(spark, files, "commits")
    assert rows(back, "slug", "sha", "message", "num_additions") == rows(history.commits, "slug", "sha", "message", "num_additions")
    listed = {r.sha: len(r.files or []) for r in back.select("sha", "files").collect()}
    assert sum(listed.values()) == history.file_changes.join(history.commits, ["slug", "sha"], "left_semi").filter("not is_binary").count()

    aliases = people.resolve_identities(spark, folder, str(tmp_path / "audit"))
    assert aliases.count() == aliases.select("uid").distinct().count() > 0
    shared = tables.read_native(spark, folder, "alias_shared_emails").agg(F.sum("members"), F.count("*")).first()
    written = csv_tables.read_delimited(spark, f"{tmp_path}/audit/idm_map", "uid string, rep string").count()
    assert written == aliases.filter("uid <> rep").count() + (shared[0] or 0) - shared[1]
    report.write_reports(spark, folder, interchange=files)
    daily = tables.read_native(spark, folder, report.PROJECT_REPORT)
    assert daily.agg(F.sum("num_commits")).first()[0] == history.commits.count()
    tables.write_native(view(spark, GIVEN, "vw_comments"), folder, "comments")
    report.write_cross_references(spark, folder, interchange=files)
    references = csv_tables.read_table(spark, f"{files}/cross_references", "cross_references", "part-*.csv")
    assert rows(references) == rows(tables.read_native(spark, folder, "cross_references").select("slug", "ref", "type"))
    listed = spark.read.option("header", True).csv(f"{files}/{report.PROJECT_REPORT}")
    assert listed.columns == daily.select("user_id", *[c for c in daily.columns if c != "user_id"]).columns and listed.count() == daily.count()
    assert tables.read_native(spark, folder, "cross_references").count() > 0
    assert {"blames_commit", "alias_groups", report.LANGUAGE_REPORT} <= {row.table for row in tables.published(spark, folder)}
    by_language = rows(tables.read_native(spark, folder, report.LANGUAGE_REPORT).select("user_id", "language", "day", "num_src_files_touched", "num_distinct_commits"))
    report.write_reports(spark, folder, "week")
    weekly = rows(tables.read_native(spark, folder, f"{report.PROJECT_REPORT}_week").select("user_id", "project", "week", "num_files_touched", "num_bugs_induced"))
    report.write_every_period(spark, folder)
    again = tables.read_native(spark, folder, report.PROJECT_REPORT).select(*daily.columns)
    assert rows(again) == rows(daily)
    assert rows(tables.read_native(spark, folder, report.LANGUAGE_REPORT).select("user_id", "language", "day", "num_src_files_touched", "num_distinct_commits")) == by_language
    assert rows(tables.read_native(spark, folder, f"{report.PROJECT_REPORT}_week").select("user_id", "project", "week", "num_files_touched", "num_bugs_induced")) == weekly


def test_upkeep_touches_only_what_changes(spark, table, tmp_path):
    import datetime as dt

    from changelens.plans import upkeep

    folder, day = str(tmp_path / "kept"), lambda n: dt.datetime(2020, 1, 1) + dt.timedelta(days=n)
    commit = ("slug string, sha string, ts timestamp, author_name string, author_email string, committer_name string, committer_email string, "
              "message string, num_parents int")
    line = ("slug string, sha string, patch_pos int, hunk_pos int, old_path string, new_path string, is_binary boolean, origin string, old_lineno int, "
            "new_lineno int, content string")
    issue = "slug string, number bigint, version int, created_at timestamp, closed_at timestamp, labels array<string>, is_pl boolean"

    def commits(*given):
        return table([(p, s, day(n), who, f"{who}@x.org", who, f"{who}@x.org", m, 1) for p, s, n, who, m in given], commit)

    def lines(*given):
        return table([(p, s, 0, 0, path, path, False, o, 1 if o == "-" else None, 1 if o == "+" else None, c) for p, s, path, o, c in given], line)

    def issues(*given):
        return table([(p, n, v, day(0), day(c), ["fix"], False) for p, n, v, c in given], issue)

    def published_report():
        return rows(tables.read_native(spark, folder, report.PROJECT_REPORT).select("project", "day", "num_commits", "loc_added", "num_bugs_induced"))

    first = {
        "commits": commits(("o/p", "a1", 1, "Ann", "x"), ("o/p", "a2", 400, "Ann", "fix #1"), ("o/q", "b1", 1, "Bob", "x"), ("o/r", "c1", 1, "Cy", "x")),
        "issues": issues(("o/p", 1, 1, 100)),
        "diff_lines": lines(("o/p", "a1", "f.py", "+", "x = 1"), ("o/p", "a2", "f.py", "-", "x = 1"), ("o/q", "b1", "g.py", "+", "y"), ("o/r", "c1", "h.py", "+", "z")),
    }
    touched = upkeep.update(spark, folder, first, issue_order="version")
    assert touched.count() == 3
    before = published_report()
    assert [r[-1] for r in before if r[0] == "o/p"] == [0, 0]
    versions = len(tables.published(spark, folder))
    assert upkeep.update(spark, folder, first, issue_order="version").count() == 0 and len(tables.published(spark, folder)) == versions

    # A later record of the issue makes a2 a fix; an older one that comes late changes nothing.
    later = {"issues": issues(("o/p", 1, 2, 500)), "commits": commits(("o/q", "b2", 2, "Bob", "y")), "diff_lines": lines(("o/q", "b2", "g.py", "+", "y2"))}
    assert rows(upkeep.update(spark, folder, later, issue_order="version")) == [("o_____p",), ("o_____q",)]
    after = published_report()
    assert [r[-1] for r in after if r[0] == "o/p"] == [1, 0] and len([r for r in after if r[0] == "o/q"]) == 2
    assert [r for r in after if r[0] == "o/r"] == [r for r in before if r[0] == "o/r"]
    newest = max(row.version for row in tables.published(spark, folder))
    place = {row.table: row for row in tables.published(spark, folder) if row.version == newest}
    assert place["commits"].some and not place["alias_map"].some
    written = spark.read.parquet(f"{folder}/{place[report.PROJECT_REPORT].place}/{report.PROJECT_REPORT}")
    assert rows(written.select(tables.PROJECT, "year").distinct()) == [("o_____p", 2020), ("o_____q", 2020)]
    upkeep.update(spark, folder, {"issues": issues(("o/p", 1, 1, 100))}, issue_order="version")
    assert published_report() == after


def test_lines_of_projects_that_commits_tell_apart_are_not_compared(spark, table, tmp_path, monkeypatch):
    from changelens.plans import upkeep

    folder = str(tmp_path / "kept")
    known = {"commits": table([("o/p", "a", "x"), ("o/q", "b", "x")], "slug string, sha string, message string"),
             "diff_lines": table([("o/p", "a", 1), ("o/q", "b", 1), ("o/r", "c", 1)], "slug string, sha string, patch_pos int")}
    draft = tables.Draft(spark, folder)
    for name, given in known.items():
        draft.write(given, f"given_{name}")
    draft.publish()
    compared, plain = [], upkeep.differing

    def watched(new, old, keys, only_new):
        compared.append((rows(new.select("slug").distinct()), rows(old.select("slug").distinct())))
        return plain(new, old, keys, only_new)

    monkeypatch.setattr(upkeep, "differing", watched)
    later = {"commits": table([("o/p", "a", "y"), ("o/q", "b", "x"), (None, "n", "x")], known["commits"].schema),
             "diff_lines": table([("o/p", "a", 2), ("o/q", "b", 1), ("o/r", "c", 3), ("o/s", "d", 1), (None, "n", 1)], known["diff_lines"].schema)}
    found = upkeep._differing_projects(spark, folder, later)
    assert rows(found) == sorted([(None,), ("o/p",), ("o/r",), ("o/s",)], key=repr)
    assert compared[1] == (sorted([("o/q",), ("o/r",), ("o/s",), (None,)], key=repr), [("o/q",), ("o/r",)])


def test_independent_steps_run_at_once(spark):
    import threading

    from changelens.at_once import at_once

    both = threading.Barrier(2)

    def step(n):
        both.wait(60)
        return spark.range(n).count()

    with at_once(spark) as begin:
        begun = [begin(step, n) for n in (3, 4)]
    assert [one.result() for one in begun] == [3, 4]
    with pytest.raises(ZeroDivisionError):
        with at_once(spark) as begin:
            begin(lambda: 1 // 0)
    # Results of a history that need not wait for each other are kept at once.
    commits = view(spark, GIVEN, "vw_commits")
    issues = view(spark, GIVEN, "vw_issues").selectExpr("* except (labels)", "split(labels, ';') as labels")
    waiting = threading.Barrier(5)

    def keep(made, name):
        if name in ("contributors", "issue_links", "file_changes", "commits", "commit_files"):
            waiting.wait(60)
        return made

    bug_history.analyse_history(commits, issues, view(spark, GIVEN, "vw_diff_lines"), view(spark, GIVEN, "vw_blame_hunks"),
                                issue_order="version", file_changes=view(spark, GIVEN, "vw_file_changes"), keep=keep)


def test_a_cluster_must_name_its_shared_folder():
    from types import SimpleNamespace

    import pytest

    from changelens.scratch import shared_folder

    nothing = SimpleNamespace(get=lambda *_: None)
    context = SimpleNamespace(getConf=lambda: nothing, getCheckpointDir=lambda: None, master="spark://host:7077")
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(SimpleNamespace(sparkContext=context, conf=nothing))


def test_rows_that_differ_are_told_apart(spark, table):
    from changelens.plans.upkeep import differing

    known = table(
        [(1, "2020-01-01 00:00:00.000001", "x", None, ["a"]), (2, "2020-01-01 00:00:00.000001", "x", None, ["a"]),
         (3, None, "x", None, ["a", None]), (4, None, "x", None, None), (5, None, None, None, [])],
        "k int, at string, left string, right string, list array<string>",
    ).selectExpr("k", "cast(at as timestamp) as at", "left", "right", "list")
    later = known.selectExpr(
        "cast(k as bigint) as k", "if(k = 1, at + interval 1 microsecond, at) as at", "if(k = 4, null, left) as left",
        "if(k = 4, left, right) as right", "if(k = 3, array('a'), list) as list",
    )
    assert rows(differing(later, known, ["k"], only_new=False)) == [(1,), (3,), (4,)]
    assert rows(differing(known, known, ["k"], only_new=True)) == []


@pytest.fixture
def small_history(spark, tmp_path):
    """Own rows: an order and a part that come twice, keys that are null, lines without order or part."""
    tables_ = {
        "customer": ([(1, 2, "AUTO"), (2, 3, "BUILDING"), (3, 2, "AUTO")], "c_custkey bigint, c_nationkey int, c_mktsegment string"),
        "orders": (
            [(k, 1 + k % 3, f"2020-01-0{1 + k % 5}", "1-URGENT") for k in range(1, 30)] + [(4, 1, "2020-02-01", "2-HIGH"), (None, 1, "2020-02-02", None)],
            "o_orderkey bigint, o_custkey bigint, day string, o_orderpriority string",
        ),
        "lineitem": (
            [(k, line, 1 + (k + line) % 4, 3.0 + line) for k in range(1, 35) for line in (1, 2, 2)] + [(None, 1, 1, 2.0), (5, None, 2, 2.0), (6, 7, None, 2.0)],
            "l_orderkey bigint, l_linenumber int, l_partkey bigint, l_quantity double",
        ),
        "part": ([(1, "red ink"), (2, "blue pen"), (2, "blue pen"), (3, "cap"), (None, "none")], "p_partkey bigint, p_name string"),
    }
    for name, (given, schema) in tables_.items():
        made = spark.createDataFrame(given, schema)
        if name == "orders":
            made = made.selectExpr("* except (day)", "cast(day as timestamp) as o_orderdate")
        made.write.parquet(f"{tmp_path}/{name}.parquet")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield str(tmp_path)
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    apply_settings(spark)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_written_history_lies_by_commit(spark, small_history):
    whole = WrittenHistory(spark, small_history)
    for name in ("vw_commits", "vw_file_changes"):
        assert rows(whole.view(name)) == rows(view(spark, small_history, name))
    commits, changes_ = whole.view("vw_commits"), whole.view("vw_file_changes")
    assert "Exchange" not in _plan(changes_.join(commits.select("slug", "sha", "message"), ["slug", "sha"]))
    assert "Exchange" not in _plan(changes_.groupBy("slug", "sha").count())


def test_report_by_language_shuffles_its_rows_once(spark, small_history):
    steps = Steps(lambda name: view(spark, small_history, name))
    report_ = activity.activity_by_language(steps.facts, steps.changes, steps.aliases, "month")
    assert _plan(report_).count("hashpartitioning(user_id") == 1
    assert report_.selectExpr("sum(num_commits)").first()[0] > 0


def test_judged_links_tell_the_fixes(table):
    commits = table(
        [("a/b", "x", 10, "see #1 #2", 1), ("a/b", "y", 10, "see #2\n to #1", 1), ("a/b", "z", 10, "to #3", 1), ("a/b", "r", 10, "to #1", 0)],
        "slug string, sha string, at long, message string, num_parents int",
    ).selectExpr("* except (at)", "timestamp_seconds(at) as ts")
    issues = table(
        [("a/b", 1, 5, 20, ["fix"], False), ("a/b", 2, 5, 20, ["ui"], False), ("a/b", 3, 5, None, [], False)],
        "slug string, number long, o long, c long, labels array<string>, is_pl boolean",
    ).selectExpr("* except (o, c)", "timestamp_seconds(o) as created_at", "timestamp_seconds(c) as closed_at")
    plain, judged = links.issue_links(commits, issues), links.judged_links(commits, issues)
    assert rows(judged.drop("is_fix")) == rows(plain)
    assert rows(links.fixing_commits(judged, issues)) == rows(links.fixing_commits(plain, issues)) == [("a/b", "x"), ("a/b", "y")]


def _report_inputs(spark, folder):
    steps = Steps(WrittenHistory(spark, folder, packed=True).view)
    induced = spark.createDataFrame([], "user_id string, slug string, sha binary, issue_number bigint, fixing_sha binary, times bigint")
    return steps, (steps.facts, steps.changes, induced, steps.aliases)


def test_packed_history_has_the_same_rows(spark, small_history):
    packed_ = WrittenHistory(spark, small_history, packed=True)
    for name in ("vw_commits", "vw_file_changes", "vw_blame_hunks", "vw_diff_lines"):
        given = view(spark, small_history, name).drop("author_id")
        assert rows(ids_as_text(packed_.view(name)).select(*given.columns)) == rows(given)


def test_reports_of_a_written_history(spark, small_history):
    steps, inputs = _report_inputs(spark, small_history)
    plain = Steps(lambda name: view(spark, small_history, name))
    induced = inputs[2].selectExpr("* except (sha, fixing_sha)", "string(sha) as sha", "string(fixing_sha) as fixing_sha")
    for report_ in (activity.activity_by_project, activity.activity_by_project_compat):
        found = report_(*inputs)
        assert _plan(found).count("hashpartitioning(user_id") == 1
        assert rows(found) == rows(report_(plain.facts, plain.changes, induced, plain.aliases))


def test_periods_are_merged_where_the_state_lies(spark, small_history):
    steps, inputs = _report_inputs(spark, small_history)
    daily = {"project": activity.activity_by_project(*inputs), "language": activity.activity_by_language(steps.facts, steps.changes, steps.aliases)}
    states = {"project": activity_state.project_state(*inputs), "language": activity_state.language_state(steps.facts, steps.changes, steps.aliases)}
    for name, state in states.items():
        state.sums, state.sets = (spark.table(settle_by(part, *state.group)) for part in (state.sums, state.sets))
        found = activity_state.roll_up(state, "day")
        assert "Exchange" not in _plan(found)
        assert rows(found) == rows(daily[name]) != []


def test_patches_are_dealt_out_once_for_log_files(spark, small_history):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    texts = view(spark, small_history, "vw_diff_text")
    assert _plan(_log_rows(spark, small_history)).count("Exchange") == _plan(texts).count("Exchange") + 1
    assert _log_rows(spark, small_history).count() == texts.count() > 0
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_log_files_are_compressed(spark, small_history):
    import glob

    from changelens.scratch import shared_folder
    from drivercheck.queries import QUERIES

    pattern = f"{shared_folder(spark)}/logs-*/folder=*/part-*"
    before = set(glob.glob(pattern))
    lines = QUERIES["diff_files"](spark, small_history)
    files = set(glob.glob(pattern)) - before
    assert files and all(file.endswith(".gz") for file in files)
    assert lines.filter("origin = '+'").count() > 0


def test_history_of_packed_ids_is_written_as_text(spark, small_history, tmp_path):
    issues = view(spark, small_history, "vw_commits").select("slug").distinct().selectExpr(
        "slug", "explode(sequence(0L, 100L)) as number", "1 as version", "timestamp '1980-01-01' as created_at", "timestamp '2050-01-01' as closed_at",
        "cast(null as array<string>) as labels", "false as is_pl")
    written = {}
    for kind, named in (("plain", lambda name: view(spark, small_history, name)), ("packed", WrittenHistory(spark, small_history, packed=True).view)):
        steps, folder = Steps(named), str(tmp_path / kind)
        written[kind] = vars(bug_history.run_history(
            folder, steps.commits, issues, steps.diff_lines, steps.named("vw_blame_hunks"), issue_order="version", file_changes=steps.changes))
        for name, found in written[kind].items():
            assert rows(tables.read_native(spark, folder, name).select(*found.columns)) == rows(found)
    for name, found in written["plain"].items():
        again = written["packed"][name].select(*found.columns)
        assert again.dtypes == found.dtypes and rows(again) == rows(found), name
    assert rows(written["packed"]["issue_links"]) != []
    # Reports read what was written once, where it lies by commit.
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    facts, changes_ = report.by_commit(spark, str(tmp_path / "packed"))
    assert "Exchange" not in _plan(facts.join(changes_, changes.COMMIT))
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    apply_settings(spark)


def test_people_of_a_commit_are_read_once(spark, small_history):
    steps, _ = _report_inputs(spark, small_history)
    assert "Union" not in _plan(changes.contributors(steps.commits))


def test_latest_additions_are_dealt_out_once(spark, table):
    removed = table([("a/b", "f", "p", "x"), ("a/b", "f", "p", "y"), ("a/b", "f", None, "x"), ("a/b", "f", "px", "")], "slug string, fix_sha string, path string, content string")
    fixed = table([("a/b", "f", 100)], "slug string, sha string, at long").selectExpr("slug", "sha", "timestamp_seconds(at) as ts")
    added = table(
        [("a/b", "p", "x", "c1", 10), ("a/b", "p", "x", "c2", 90_000), ("a/b", "p", "x", "c0", 50), ("a/b", "p", "x", "c3", 50), ("a/b", "p", "x", "c4", 100),
         ("a/b", "p", "y", "c5", 100), (None, "p", "y", "c6", 5), ("a/b", None, "x", "c7", 5), ("a/b", "p", "x", "c8", 200), ("a/b", "p", "y", None, 5), ("a/b", "p", "y", "c9", None)],
        "slug string, path string, content string, sha string, at long",
    ).selectExpr("* except (at)", "timestamp_seconds(at) as ts")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set(CO_PARTITIONED, "false")
    found = origins.lines_with_latest_addition(removed, fixed, added)
    assert _plan(found).count("Exchange hashpartitioning") == 1
    assert rows(found) == [("a/b", "f", "p", "x", "c3")]
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    apply_settings(spark)
