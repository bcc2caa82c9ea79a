"""Links, changes, origins, reports and files on small histories."""

import csv
import datetime as dt
import random
from collections import Counter

import pytest

from changelens.operators import activity, changes, ingest, links, origins, references
from changelens.sources import csv_tables, diff_text, tables
from tests.conftest import rows

T0 = dt.datetime(2020, 1, 1)


def day(n):
    return T0 + dt.timedelta(days=n)


COMMIT = (
    "slug string, sha string, ts timestamp, author_name string, author_email string, committer_name string, "
    "committer_email string, message string, num_parents int"
)
CHANGE = (
    "slug string, sha string, patch_pos int, old_path string, new_path string, is_binary boolean, loc_ins bigint, "
    "loc_del bigint"
)


def commit(sha, n, message="m", who="Ann", parents=1, slug="o/p"):
    return (slug, sha, day(n), who, f"{who}@x.org", who, f"{who}@x.org", message, parents)


def test_links_and_fixes(table):
    commits = table(
        [commit("c1", 5, "fix #1"), commit("c2", 5, "see #2, #3\nand GH-1"), commit("c3", 50, "late #1"),
         commit("c4", 5, "open #4"), commit("root", 5, "fix #1", parents=0), commit("c5", 5, "fix #1", slug="o/q")],
        COMMIT,
    )
    issues = table(
        [("o/p", 1, 1, day(1), day(10), None, False), ("o/p", 2, 1, day(1), day(10), ["ui"], False),
         ("o/p", 2, 2, day(1), day(10), ["ui", "retain"], False), ("o/p", 3, 1, day(1), day(10), None, True),
         ("o/p", 4, 1, day(1), None, None, False)],
        "slug string, number bigint, version int, created_at timestamp, closed_at timestamp, labels array<string>, is_pl boolean",
    )
    latest = links.latest_issues(issues, "version")
    assert rows(latest.filter("number = 2"), "labels") == [(["ui", "retain"],)]
    found = links.issue_links(commits, latest)
    assert rows(found, "commit_sha", "line_num", "issue_number") == [
        ("c1", 1, 1), ("c2", 1, 2), ("c2", 1, 3), ("c2", 2, 1), ("c3", 1, 1), ("c4", 1, 4)]
    first = found.filter("commit_sha = 'c1'").first()
    assert (first.delta_open, first.delta_closed) == (4 * 86400.0, -5 * 86400.0)
    assert rows(links.fixing_commits(found, latest)) == [("o/p", "c1"), ("o/p", "c2")]
    none_fit = links.fixing_commits(found.filter("line_num = 1 and commit_sha = 'c2'"), latest, ["bug"])
    assert rows(none_fit) == []
    assert rows(links.pending_issues(issues, table([("o/p", 1), ("o/p", 3)], "slug string, number bigint"))) == [
        ("o/p", 2), ("o/p", 4)]


def test_commit_facts_and_files(table):
    commits = table([commit("c1", 1, " a \n"), commit("c1", 1, " a \n"), commit("c2", 1), commit("r", 1, parents=0)], COMMIT)
    patches = table(
        [("o/p", "c1", 0, "src/a.py", "src/a.py", False, 3, -1), ("o/p", "c1", 1, "docs/b.py", "docs/b.py", False, 2, -2),
         ("o/p", "c1", 2, "x.png", "x.png", True, 0, 0), ("o/p", "c1", 3, "lib/a.py", "lib/a.py", False, 5, 0)], CHANGE)
    facts = changes.commit_facts(commits, patches)
    assert rows(facts, "sha", "message", *changes.TOTALS) == [("c1", "a", 10, 3, 3 + 1, 8, 1, 2), ("c2", "m", 0, 0, 0, 0, 0, 0)]
    assert rows(changes.commit_files(patches), "patch_pos", "commit_file", "lang") == [
        (0, "a.py", 0), (1, "b.py", 0), (2, "x.png", 2), (3, "a.py", 0)]
    assert rows(changes.commit_file_lists(patches), "part", "files", "src_files") == [
        (0, ["a.py", "b.py", "a.py"], ["a.py", "a.py"])]
    assert rows(changes.commit_file_lists(patches, 2), "part", "files") == [(0, ["a.py", "b.py"]), (1, ["a.py"])]
    assert rows(activity.source_file_rows(patches), "file", "rows", "loc_ins", "loc_del") == [("a.py", 2, 3, -1)]
    people = changes.contributors(commits)
    assert rows(people, "name", "email") == [("ann", "ann@x.org")]


LINE = (
    "slug string, sha string, patch_pos int, hunk_pos int, old_path string, new_path string, is_binary boolean, "
    "origin string, old_lineno int, new_lineno int, content string"
)


def removed_row(sha, path, lineno, content, patch=0, hunk=0):
    return ("o/p", sha, patch, hunk, path, path, False, "-", lineno, None, content)


def test_origins_and_compat(table):
    lines = table(
        [removed_row("f1", "a.py", 1, "x"), removed_row("f1", "a.py", 2, "# note"), removed_row("f1", "a.py", 3, "y"),
         removed_row("f1", "test_a.py", 1, "x", 1), removed_row("f1", "docs/a.py", 1, "x", 2),
         removed_row("f2", "b.py", 9, "# only"), removed_row("f3", "a.py", 1, "z"), removed_row("no", "a.py", 1, "x"),
         ("o/p", "f1", 3, 0, "n.py", "n.py", False, "+", None, 1, "x")], LINE)
    fixes = table([("o/p", "f1"), ("o/p", "f2"), ("o/p", "f3")], "slug string, sha string")
    hunks = table(
        [("o/p", "f1", "a.py", 1, 2, "b1"), ("o/p", "f1", "a.py", 3, 1, "big"), ("o/p", "f2", "b.py", 1, 9000, "b1"),
         ("o/p", "f3", "a.py", 1, 1, "b1")],
        "slug string, fix_sha string, path string, start_line int, num_lines int, blamed_sha string")
    sizes = table([("o/p", "b1", 1, 3, 199), ("o/p", "big", 1, 50, 1), ("o/p", "root", 0, 1, 1)],
                  "slug string, sha string, num_parents int, num_files_changed bigint, num_additions bigint")
    found = origins.lines_with_origin(origins.removed_lines(fixes, lines), hunks)
    kept = origins.plausible_origins(sizes)
    assert rows(kept) == [("o/p", "b1")]
    assert rows(origins.bug_origins(found, kept)) == [
        ("o/p", "f1", "a.py", 0, "b1", 1), ("o/p", "f3", "a.py", 0, "b1", 1)]
    # The newest fix comes first and takes the row, though its only line is a comment.
    when = table([("o/p", "f1", day(1)), ("o/p", "f2", day(3)), ("o/p", "f3", day(2))],
                 "slug string, sha string, committed_at timestamp")
    assert rows(origins.bug_origins_compat(found, kept, when)) == [("o/p", "f2", "b.py", 0, "b1", 2)]


def test_lines_in_hunks_of_any_length(table):
    draw = random.Random(4)
    lengths = [1, 1, 2, 63, 64, 65, 511, 512, 513, 4096, 40_000, 300_000, 10_000_000, 0, -3, 2_000_000_000]
    hunks = [("o/p", f"f{draw.randrange(2)}", draw.choice("ab"), draw.choice([1, 5, 64, 500, 70_000, 9_000_000]), n, f"b{k}")
             for k, n in enumerate(lengths * 4)]
    ends = [edge for _, _, _, start, n, _ in hunks for edge in (start - 1, start, start + n - 1, start + n) if 0 < edge < 2**31]
    lines = [("o/p", f"f{draw.randrange(3)}", draw.choice("abc"), draw.choice(ends)) for _ in range(400)]
    given = table(hunks, "slug string, fix_sha string, path string, start_line int, num_lines int, blamed_sha string")
    removed = table(lines, "slug string, fix_sha string, path string, old_lineno int")
    expected = [(*line, h[5]) for line in lines for h in hunks if line[:3] == h[:3] and h[3] <= line[3] < h[3] + h[4]]
    assert rows(origins.lines_with_origin(removed, given)) == sorted(expected, key=repr) and len(expected) > 300
    assert origins.binned_hunks(given).count() <= (origins.COARSER + 1) * len(hunks)
    ordinary = table([("o/p", "f", "a", k * 3, 3, f"b{k}") for k in range(1, 200)], ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in given.schema))
    assert origins.levels_in_use(ordinary) == [0] and origins.levels_in_use(ordinary.limit(0)) == []
    assert rows(origins.lines_with_origin(removed, ordinary.limit(0))) == []


def test_latest_addition_equals_brute_force(table):
    draw = random.Random(9)
    when = {f"c{i:03d}": T0 + dt.timedelta(hours=draw.randrange(24 * 12)) for i in range(150)}
    added = [(f"p{draw.randrange(2)}", draw.choice("xyz"), sha) for sha in when for _ in range(2)]
    removed = [(sha, f"p{draw.randrange(2)}", draw.choice("xyz"), n) for n, sha in enumerate(when)]
    expected = Counter()
    for sha, path, content, n in removed:
        earlier = [(when[s], s) for p, c, s in added if (p, c) == (path, content) and when[s] < when[sha]]
        if earlier:
            expected[(sha, path, n, max(earlier)[1])] += 1
    lines = table([("o/p", s, p, 0, 0, 0, n, c, True) for s, p, c, n in removed],
                  "slug string, fix_sha string, path string, type int, patch_pos int, hunk_pos int, old_lineno int, content string, is_code boolean")
    times = table([("o/p", s, t) for s, t in when.items()], "slug string, sha string, ts timestamp")
    additions = table([("o/p", p, c, s, when[s]) for p, c, s in added],
                      "slug string, path string, content string, sha string, ts timestamp")
    found = origins.lines_with_latest_addition(lines, times, additions)
    assert Counter(tuple(r) for r in found.select("fix_sha", "path", "old_lineno", "blamed_sha").collect()) == expected


def test_origins_follow_renames(table):
    def at(n):
        return T0 + dt.timedelta(hours=n)

    # a -> b at 10 -> c at 20 -> d at 30; another a begins at 12, d is swapped with e at 40.
    moves = [("a", "b", 10), ("b", "c", 20), ("c", "d", 30), ("d", "e", 40), ("e", "d", 40), ("z", "y", 50), ("z", "x", 50), ("q", "q", 60)]
    renames = table([("o/p", old, new, at(n)) for old, new, n in moves], "slug string, old_path string, new_path string, ts timestamp")
    added = [("a", "one", 1), ("a", "other", 12), ("b", "two", 10), ("c", "three", 25), ("e", "five", 5), ("z", "six", 45), ("q", "seven", 55)]
    asked = [("d", "one", 35), ("d", "two", 35), ("d", "three", 40), ("d", "other", 35), ("a", "one", 35), ("a", "other", 35), ("a", "one", 10),
             ("e", "one", 41), ("d", "five", 41), ("e", "five", 41), ("b", "two", 10), ("b", "two", 11), ("x", "six", 60), ("y", "six", 60), ("q", "seven", 70)]
    answers = [1, 10, 25, None, None, 12, 1, 1, 5, None, None, 10, 45, None, 55]
    additions = table([("o/p", p, c, f"s{n}", at(n)) for p, c, n in added], "slug string, path string, content string, sha string, ts timestamp")
    removed = table([("o/p", f"f{n}", p, c) for p, c, n in asked], "slug string, fix_sha string, path string, content string")
    times = table(sorted({("o/p", f"f{n}", at(n)) for _, _, n in asked}), "slug string, sha string, ts timestamp")
    found = origins.lines_with_latest_addition(removed, times, additions, renames)
    expected = sorted((f"f{n}", p, c, f"s{s}") for (p, c, n), s in zip(asked, answers) if s is not None)
    assert rows(found, "fix_sha", "path", "content", "blamed_sha") == expected
    nothing = origins.lines_with_latest_addition(removed, times, additions, renames.limit(0))
    assert rows(nothing) == rows(origins.lines_with_latest_addition(removed, times, additions))


@pytest.fixture
def history(table):
    """Two people, three commits on two days, one bug induced twice."""
    commits = table([commit("c1", 1), commit("c2", 1), commit("c3", 2, who="Bob")], COMMIT)
    patches = table(
        [("o/p", "c1", 0, "a.py", "a.py", False, 3, -1), ("o/p", "c1", 1, "lib/a.py", "lib/a.py", False, 1, 0),
         ("o/p", "c2", 0, "a.py", "a.py", False, 2, 0), ("o/p", "c2", 1, "x.md", "x.md", False, 7, 0),
         ("o/p", "c3", 0, "b.rb", "b.rb", False, 4, -4)], CHANGE)
    facts = changes.commit_facts(commits, patches)
    blames = table([("o/p", "f1", "a.py", 0, "c1", 2), ("o/p", "f1", "b.py", 0, "c1", 1), ("o/p", "f2", "a.py", 0, "c2", 1),
                    ("o/p", "f2", "r.md", 2, "c3", 1)],
                   "slug string, bug_fixing_commit string, path string, type int, blamed_commit string, num_blamed_lines bigint")
    linked = table([("o/p", "f1", 1, 7), ("o/p", "f1", 2, 7), ("o/p", "f2", 1, 7), ("o/p", "f2", 1, 8)],
                   "slug string, commit_sha string, line_num int, issue_number int")
    ids = {r.sha: r.author_id for r in facts.collect()}
    aliases = table([(ids["c1"], "ann")], "uid string, rep string")
    induced = activity.induced_bugs(blames, facts, linked, changes.contributors(commits), aliases)
    return facts, patches, induced, aliases, ids


def test_induced_bugs(history):
    facts, patches, induced, aliases, ids = history
    assert rows(induced) == [
        ("ann", "o/p", "c1", 7, "f1", 4), ("ann", "o/p", "c2", 7, "f2", 1), ("ann", "o/p", "c2", 8, "f2", 1)]
    assert rows(activity.induced_bugs_per_commit(induced), "sha", "num_issues", "num_fixes") == [("c1", 1, 4), ("c2", 2, 2)]


def test_reports(history):
    facts, patches, induced, aliases, ids = history
    report = activity.in_report_order(activity.activity_by_project(facts, patches, induced, aliases))
    assert report.columns == ["user_id", "project", "day", *activity.PROJECT_MEASURES]
    assert [tuple(r) for r in report.collect()] == [
        ("ann", "o/p", day(1).date(), 2, 4, 3, 2, 1, 13, 6, 1, 1, 2, 2),
        (ids["c3"], "o/p", day(2).date(), 1, 1, 1, 1, 1, 4, 4, 4, 4, 0, 0)]
    compat = activity.activity_by_project_compat(facts, patches, induced, aliases).filter("user_id = 'ann'")
    assert [tuple(r) for r in compat.collect()] == [("ann", "o/p", day(1).date(), 2, 2, 2, 2, 2, 13, 6, 1, 1, 2, 2)]
    monthly = activity.activity_by_project(facts, patches, induced, aliases, "month").filter("user_id = 'ann'")
    assert rows(monthly, "month", "num_commits", "num_files_touched") == [(361, 2, 2)]
    languages = activity.activity_by_language(facts, patches, aliases)
    assert rows(languages.drop("user_id", "day")) == [("Python", 3, 3, 1, 8, -2, 2), ("Ruby", 1, 1, 1, 4, -4, 1)]
    with pytest.raises(ValueError):
        activity.activity_by_project(facts, patches, induced, aliases, "year")


def test_cross_references(table):
    messages = table([("a/b", "see (c/d#1) and a/b#2"), ("a/b", "c/d#1 [x/y@12ab]")], "slug string, message string")
    comments = table([("a/b", "c/d#1")], "slug string, body string")
    assert rows(references.cross_references(messages, comments)) == [
        ("a/b", "c/d#1", "commit"), ("a/b", "c/d#1", "commit"), ("a/b", "c/d#1", "issue/pr"), ("a/b", "x/y@12", "commit")]


DIFF = """diff --git a/a.py b/a.py
index 1..2 100644
--- a/a.py
+++ b/a.py
@@ -3,2 +3 @@ def f
-old one
--- old two
+new
@@ -9,0 +9,2 @@
+@@ -1 +1 @@
+last
\\ No newline at end of file
diff --git a/new.py b/new.py
new file mode 100644
index 0..1
--- /dev/null
+++ b/new.py
@@ -0,0 +1 @@
+x
diff --git a/p.png b/p.png
index 1..2 100644
Binary files a/p.png and b/p.png differ
diff --git a/o.txt b/n.txt
similarity index 100%
rename from o.txt
rename to n.txt
"""


def test_diff_text(table):
    diffs = table([("o/p", "c1", DIFF)], "slug string, sha string, diff string")
    found = diff_text.diff_lines(diffs)
    assert rows(found, "patch_pos", "hunk_pos", "old_path", "new_path", "is_binary", "origin", "old_lineno", "new_lineno", "content") == sorted([
        (0, 0, "a.py", "a.py", False, "-", 3, None, "old one"), (0, 0, "a.py", "a.py", False, "-", 4, None, "-- old two"),
        (0, 0, "a.py", "a.py", False, "+", None, 3, "new"), (0, 1, "a.py", "a.py", False, "+", None, 9, "@@ -1 +1 @@"),
        (0, 1, "a.py", "a.py", False, "+", None, 10, "last"), (1, 0, "new.py", "new.py", False, "+", None, 1, "x"),
        (2, None, "p.png", "p.png", True, None, None, None, None),
        (3, None, "o.txt", "n.txt", False, None, None, None, None)], key=repr)
    totals = [(0, 3, -2), (1, 1, 0), (2, 0, 0), (3, 0, 0)]
    assert rows(diff_text.file_changes_from_diffs(diffs), "patch_pos", "loc_ins", "loc_del") == totals
    assert rows(changes.file_changes(found), "patch_pos", "loc_ins", "loc_del") == totals


def test_lines_of_odd_hunks_are_split_without_lambdas(spark, table):
    head = "diff --git a/f b/f\n--- a/f\n+++ b/f\n"
    texts = [
        head + "@@ -5,9 +7,9 @@ where\n ctx\n-a\n\n\\ No newline\n--\n++\n+b\n ctx\n-c\n", head + "@@ -1 +1 @@\n ctx\n@@ -9\n-z\n+", head + "@@ -3\n+only\n\n",
        "diff --git a/x b/y\nrename from x\nrename to y\n@@ -2 +2 @@\n-\n", None, "", "junk",
    ]
    found = diff_text.diff_lines(table([("o/p", str(n), t) for n, t in enumerate(texts)], "slug string, sha string, diff string"))
    # Paths aside, whose quotes are taken off by one.
    assert "lambda" not in found.select("origin", "old_lineno", "new_lineno", "content")._jdf.queryExecution().optimizedPlan().toString()
    assert rows(found, "sha", "hunk_pos", "old_path", "new_path", "origin", "old_lineno", "new_lineno", "content") == sorted([
        ("0", 0, "f", "f", "-", 6, None, "a"), ("0", 0, "f", "f", "-", 7, None, "-"), ("0", 0, "f", "f", "-", 9, None, "c"),
        ("0", 0, "f", "f", "+", None, 8, "+"), ("0", 0, "f", "f", "+", None, 9, "b"),
        ("1", 0, "f", "f", None, None, None, None), ("1", 1, "f", "f", "-", None, None, "z"), ("1", 1, "f", "f", "+", None, None, ""),
        ("2", 0, "f", "f", "+", None, None, "only"), ("3", 0, "x", "y", "-", 2, None, "")], key=repr)


def test_quoted_paths(spark, table):
    from changelens.operators.classify import classify_files

    names = {'"a/\\303\\261.py"': "a/ñ.py", "plain.py": "plain.py", '"t\\ta\\"b\\\\c\\nd"': 't\ta"b\\c\nd', '"é\\001"': "é\x01", '""': "", '"\\377x"': "\ufffdx"}
    given = table(list(names.items()), "path string, expected string")
    assert [r.expected for r in given.collect()] == [r.found for r in given.select(diff_text.unquoted(given.path).alias("found")).collect()]
    diff = ('diff --git "a/src/\\303\\261.py" "b/src/\\303\\261.py"\nindex 1..2 100644\n--- "a/src/\\303\\261.py"\n+++ "b/src/\\303\\261.py"\n@@ -1 +1 @@\n-x\n+y\n'
            'diff --git a/old.txt "b/n\\303\\251w.txt"\nsimilarity index 100%\nrename from old.txt\nrename to "n\\303\\251w.txt"\n'
            'diff --git "a/\\303\\251.bin" "b/\\303\\251.bin"\nindex 1..2\nBinary files "a/\\303\\251.bin" and "b/\\303\\251.bin" differ\n'
            'diff --git a/new.py b/new.py\nnew file mode 100644\n--- /dev/null\n+++ b/new.py\n@@ -0,0 +1 @@\n+z\n')
    patches = diff_text.patches(table([("o/p", "c", diff)], "slug string, sha string, diff string"))
    assert rows(patches, "patch_pos", "old_path", "new_path", "is_binary") == [
        (0, "src/ñ.py", "src/ñ.py", False), (1, "old.txt", "néw.txt", False), (2, "é.bin", "é.bin", True), (3, "new.py", "new.py", False)]
    assert classify_files(patches, "new_path", "label").filter("patch_pos = 0").first().label == 0


@pytest.mark.parametrize("split", [90, 1 << 20])
def test_log_files_are_read_in_splits(spark, tmp_path, split):
    draw, expected = random.Random(split), []
    for project in ("o_____p", "o_____q"):
        (tmp_path / project).mkdir()
        text = ""
        for c in range(30):
            sha = f"{draw.randrange(16**12):012x}" + "0" * 28
            text += f"commit {sha}\nAuthor: A\n\n    message\n    commit 1234567\n\n"
            for n in range(draw.choice([0, 1, 1, 4])):
                body = "".join(f"{draw.choice('+- ')}commit abcdef0{k} diff --git\n" for k in range(draw.choice([1, 2, 20])))
                patch = f"diff --git a/f{n} b/f{n}\n--- a/f{n}\n+++ b/f{n}\n@@ -1,9 +1,9 @@\n{body}"
                expected.append((project.replace("_____", "/"), sha, n, patch))
                text += patch
            text += "\n" if draw.random() < 0.5 else ""
        (tmp_path / project / "all.diff").write_text(text)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
    try:
        found = [(s, c, n, d.rstrip("\n") + "\n") for s, c, n, d in diff_text.read_patches(spark, str(tmp_path)).collect()]
        assert sorted(found) == sorted(expected)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_texts_of_log_files_are_not_shuffled(spark, tmp_path):
    """Commit lines are carried from batch to batch, also over a compressed file, an empty one and one that has no commit line."""
    import gzip

    expected = []
    for project, last in (("o_____p", 9), ("o_____q", 4)):
        (tmp_path / project).mkdir()
        text = ""
        for c in range(last):
            sha = f"{c:040x}"
            text += f"commit {sha}\nAuthor: A\n\n    message\n\n"
            for n in range(c % 5):
                text += f"diff --git a/f{n} b/f{n}\n+{c}\n"
                expected.append((project.replace("_____", "/"), sha, n, f"diff --git a/f{n} b/f{n}\n+{c}"))
        with gzip.open(tmp_path / project / "b.diff.gz", "wt") as file:
            file.write(text)
        (tmp_path / project / "c.diff.gz").write_bytes(gzip.compress(b""))
        (tmp_path / project / "d.diff.gz").write_bytes(gzip.compress(b"diff --git a/lost b/lost\n+lost\n" * 3))
        (tmp_path / project / "e.diff").write_text(text.replace("commit 000", "commit eee"))
    expected += [(slug, sha.replace("000", "eee", 1), n, patch) for slug, sha, n, patch in expected]
    for records in (1, 3, 10_000):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(records))
        found = diff_text.read_patches(spark, str(tmp_path), "*.diff*")
        assert "Exchange hashpartitioning" not in found._jdf.queryExecution().executedPlan().toString()
        assert sorted((s, c, n, d.rstrip("\n")) for s, c, n, d in found.collect()) == sorted(expected)
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_payloads_are_parsed_once(table):
    given = table(
        [(1, '{"id":1,"state":"closed","more":{"x":[1]},"created_at":"2020-99-01T00:00:00Z"}'), (2, "[1]"), (3, '{"id":'), (4, None), (5, '{"id":null}'),
         (6, '{"id":7,"state":"closed","labels":null,"pull_request":null,"user":{"login":null}}'), (7, '"text"')], "slug int, payload string")
    read = ingest.read_payloads(given, ingest.ISSUE_PAYLOAD)
    assert rows(read, "slug", "reason") == [(1, "unreadable time"), (2, "malformed"), (3, "malformed"), (4, "missing"), (5, "no id"), (6, None), (7, "malformed")]
    assert read.filter("slug = 1").selectExpr("try_variant_get(object, '$.more.x[0]', 'int') AS x").first().x == 1
    kept, lost = ingest.issue_rows(read), read.filter("reason IS NOT NULL")
    assert rows(kept, "id", "created_at", "labels", "is_pl", "created_by_login") == [(1, None, None, False, None), (7, None, None, False, None)]
    for part in (kept, lost):
        plan = part._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("parse_json") + plan.count("parsejson") + plan.count("parseJson") == 1, plan


def test_payloads(table):
    issues = table(
        [("o/p", '{"id":1,"number":2,"state":"closed","created_at":"2020-01-02T03:04:05Z","closed_at":null,"user":null,'
                 '"closed_by":{"login":"bob"},"title":" a\\r\\nb ","comments":3,"labels":[{"name":"x"},{"name":"y"}],"pull_request":{}}'),
         ("o/p", '{"id":2,"number":3,"state":"open","labels":[]}')], "slug string, payload string")
    got = ingest.normalise_issues(issues).collect()
    assert [tuple(r) for r in got] == [("o/p", 1, 2, "closed", dt.datetime(2020, 1, 2, 3, 4, 5), None, None, "bob", None, "ab", 3, ["x", "y"], True)]
    shape = "slug string, issue_id bigint, issue_number int, payload string"
    talk = table([("o/p", 1, 2, '{"id":5,"body":" hi\\n","user":{"login":"u","id":9}}')], shape)
    review = table([("o/p", 7, 2, '{"id":6,"body":"x","user":null}'), ("o/p", 7, 2, '{"id":8,"body":"y","user":{"login":"v","id":1}}')], shape)
    both = ingest.normalise_comments(talk, review)
    assert rows(both, "issue_id", "comment_id", "body", "user_login") == [(1, 5, "hi", "u"), (7, 8, "y", "v")]
    assert rows(ingest.comments_per_issue(both)) == [("o/p", 2, 2)]


def test_interchange_files(spark, table, tmp_path):
    people = table([("o/p", "1", 'q"uo,te', "a\nb"), ("o/q", "2", "", " s;p ")],
                   "slug string, contributor_id string, name string, email string")
    csv_tables.write_table(people, str(tmp_path / "w"), "contributors")
    assert rows(csv_tables.read_written(spark, str(tmp_path / "w"), "contributors")) == rows(people)
    csv_tables.write_delimited(people, str(tmp_path / "d"))
    assert rows(csv_tables.read_delimited(spark, str(tmp_path / "d"), people.schema.simpleString()[7:-1].replace(":", " ")), "slug") == [("o/p",), ("o/q",)]
    tables.write_native(people, str(tmp_path / "n"), "contributors")
    assert rows(tables.read_native(spark, str(tmp_path / "n"), "contributors", ["o/q"])) == [("o/q", "2", "", " s;p ")]


def test_reading_folders(spark, tmp_path):
    (tmp_path / "a_issues.csv").write_text(
        "SLUG,ID,NUMBER,STATE,CREATED_AT,CLOSED_AT,CREATED_BY_LOGIN,CLOSED_BY_LOGIN,ASSIGNEE_LOGIN,TITLE,NUM_COMMENTS,LABELS,IS_PL\n"
        'o/p,1,2,closed,2020-01-02 03:04:05,None,ann,,,"t, ""x""",3,a;b,False\n')
    (tmp_path / "b_issues.csv").write_text(
        "SLUG,ID,NUMBER,STATE,CREATED_AT,CLOSED_AT,CREATED_BY_LOGIN,CLOSED_BY_LOGIN,ASSIGNEE_LOGIN,TITLE,NUM_COMMENTS,LABELS,IS_PL\n"
        "o/q,2,3,closed,2020-01-02 03:04:05,2020-01-03 00:00:00,,,,t,0,,True\n")
    (tmp_path / "x_extra.csv").write_text("SLUG,OTHER\no/r,9\n")
    issues = csv_tables.read_table(spark, str(tmp_path), "issues")
    assert rows(issues, "slug", "number", "closed_at", "title", "labels", "is_pl") == [
        ("o/p", 2, None, 't, "x"', ["a", "b"], False), ("o/q", 3, dt.datetime(2020, 1, 3), "t", None, True)]
    mixed = csv_tables.read_folder(spark, str(tmp_path), columns=["SLUG", "NUMBER", "OTHER"], mixed_headers=True)
    assert rows(mixed) == [("o/p", "2", ""), ("o/q", "3", ""), ("o/r", "", "9")]
    (tmp_path / "projects.txt").write_text("o/p \n\n o/q\n")
    assert rows(csv_tables.read_project_list(spark, str(tmp_path / "projects.txt"))) == [
        ("o/p", "o_____p", "o_p"), ("o/q", "o_____q", "o_q")]


@pytest.mark.parametrize("split", [150, 1 << 20])
@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_a_file_is_read_in_splits(spark, tmp_path, split, end):
    draw = random.Random(split)
    cells = ["", "plain", 'a "word"', '"', '""', "x,y", "two\nlines", "\n", "\n\n\n", "r\r\nn", ' sp ', "é" * 5, 'long "\n' * 60, ",", '"\n"']
    for name, header in (("a", ["k", "one", "two"]), ("b", ["two", "k"]), ("c", ["k", 'odd "\nname', "two", "three"])):
        with open(tmp_path / f"{name}.csv", "w", newline="", encoding="utf-8-sig" if name == "b" else "utf-8") as file:
            writer = csv.writer(file, lineterminator=end)
            writer.writerow(header)
            for k in range(70):
                writer.writerow([f"{name}{k}" if h == "k" else draw.choice(cells) for h in header])
                if k % 40 == 0:
                    file.write(end)
            writer.writerow([f"{name}-short"] if name != "b" else ["", "b-short"])
    (tmp_path / "none.csv").write_text("")
    (tmp_path / "head.csv").write_text("k,four")
    expected = []
    for name in "abc":
        with open(tmp_path / f"{name}.csv", newline="", encoding="utf-8-sig") as file:
            for row in csv.DictReader(file):
                expected.append((row["k"], row.get("one") or "", row.get("two") or "", row.get("three") or "", row.get('odd "\nname') or ""))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
    try:
        names = ["k", "one", "two", "three", 'odd "\nname']
        found = csv_tables.read_folder(spark, str(tmp_path), columns=names, mixed_headers=True)
        assert rows(found) == sorted(expected, key=repr)
        if split == 150:
            assert spark.read.option("lineSep", "\n").text(str(tmp_path)).rdd.getNumPartitions() > 30
        whole = csv_tables.read_folder(spark, str(tmp_path), mixed_headers=True)
        assert set(whole.columns) == {*names, "four"} and whole.count() == len(expected)
        one = spark.read.options(header=True, multiLine=True, quote='"', escape='"', nullValue="").csv(str(tmp_path / "a.csv"))
        breaks = lambda table: [tuple(c.replace("\r\n", "\n") for c in row) for row in rows(table)]
        assert sorted(breaks(csv_tables.read_folder(spark, str(tmp_path), "a.csv"))) == sorted(breaks(one.na.fill("")))
        with pytest.raises(ValueError, match="different headers"):
            csv_tables.read_folder(spark, str(tmp_path))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
