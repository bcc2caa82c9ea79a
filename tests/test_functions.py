"""Column expressions against hand-made cases and Python's own behaviour."""

import datetime as dt
import os
import random
import re

from pyspark.sql import functions as F

from changelens.functions import files, ids, mentions, people, text, times
from changelens.functions import fixed_values as V
from changelens.operators.classify import guess_language
from changelens.sources.catalogs import read_catalog


def apply(spark, expression, values, kind="string"):
    """Values of an expression over column ``x``, in input order."""
    df = spark.createDataFrame(list(enumerate(values)), f"i int, x {kind}")
    return [r.y for r in df.select("i", expression(F.col("x")).alias("y")).orderBy("i").collect()]


def test_issue_mentions(spark):
    cases = {
        "fix #12": [12], "#12 at start": [], "(#12),#13": [12, 13], "a/b#3 see #4": [4], "GH-7 xGH-8 GH-9a": [7],
        "fix ##6": [], " #2 #1 #2 GH-1": [1, 2], " #12a": [], " #012": [12], " #99999999999999999999": [],
    }
    assert apply(spark, mentions.mentioned_issues, list(cases)) == list(cases.values())


def test_packed_ids_come_back(spark):
    given = ["", "00", "0a1f" * 10, "abc", "ABCD", "Ab", "zz", "\x01", "\x00ab", "é", "0x1f", " 12", None]
    assert apply(spark, lambda x: ids.unpacked(ids.packed(x)), given) == given
    sizes = apply(spark, lambda x: F.length(ids.packed(x)), given)
    assert sizes[2] == 21 and sizes[3] == 4
    assert len(set(apply(spark, lambda x: F.hex(ids.packed(x)), given))) == len(given)


def test_digits_of_other_scripts_are_numbers(spark):
    lines = {"x #१२": [12], "GH-٣٤ #5": [5, 34], "a #𝟗9": [99], "a #²": []}
    found = spark.createDataFrame([(k,) for k in lines], "line string").select("line", mentions.mentioned_issues(F.col("line")).alias("n"))
    assert {r.line: r.n for r in found.collect()} == lines


def test_reference_tokens_equal_the_greedy_pattern(spark):
    # Fixed value: the reference pattern that must match.
    pattern = re.compile(r"(\S+\/\S+)(#\d+|@\d+)", re.MULTILINE)
    draw = random.Random(7)
    cases = [
        "see acme/anvil#123 and (someone/things@70460b4b)", "a/b#1,c/d#2", "x/y@abc12", "/foo#1", "/a/b#1", "a/#1",
        "a/b#1/c", "no\x1cbreak a/b\x1c#1", " a/b#1 c/d@2", "",
    ]
    cases += ["".join(draw.choice("a/b#@12 \n(") for _ in range(draw.randrange(25))) for _ in range(3000)]
    expected = [[m.group(0) for m in pattern.finditer(c)] for c in cases]
    assert apply(spark, mentions.reference_tokens, cases) == expected


def test_long_reference_run_is_linear(spark):
    run = "a/" * 200_000
    assert apply(spark, mentions.reference_tokens, [run, run + "#7"]) == [[], [run + "#7"]]


def test_extension_and_root_equal_splitext(spark):
    draw = random.Random(3)
    names = [".bashrc", "a.tar.gz", "a.", "..", "...", "..a.b", ""]
    names += ["".join(draw.choice("ab.c\n ") for _ in range(draw.randrange(9))) for _ in range(3000)]
    assert apply(spark, text.extension, names) == [os.path.splitext(n)[1] for n in names]
    assert apply(spark, text.root_name, names) == [os.path.splitext(n)[0] for n in names]


def test_file_labels(spark):
    cases = {
        "docs/a.py": 2, "src/test_a.py": 1, "/src/x.zzz": 0, "a.py": 0, "a.cfg": 3, "x/.git/y": -1, "README": 2,
        "x/README.foo": 2, "x/README.a.foo": 3, "x/.README": 3, "a/media/x.py": 2, "media/x.py": 0, "x.md": 2, ".md": 3,
        "a.cljs.hl": 3, "a/b.unittest/c.py": 1, "x/specs-a/y": 1, "": 3, "a/b.py/c": 3, "x/y.PY": 3, "lib/..a.rb": 0,
    }
    assert apply(spark, files.file_label, list(cases)) == list(cases.values())


def test_file_label_follows_the_rule_lists(spark):
    """The patterns against the rules read literally."""
    from changelens.functions import fixed_values as V

    popular = {e for exts in V.POPULAR_EXTENSIONS.values() for e in exts}

    def literal(path):
        root, ext = os.path.splitext(os.path.basename(path))
        if "/.git/" in path:
            return -1
        if any(p in path for p in V.MEDIA_PATHS + V.DOC_PATHS) or ext in V.DOC_EXTENSIONS or root in V.DOC_NAMES:
            return 2
        if any(p in path for p in V.TEST_PATHS):
            return 1
        return 0 if any(p in path for p in V.SOURCE_PATHS) or ext in popular else 3

    draw = random.Random(11)
    pieces = V.MEDIA_PATHS + V.DOC_PATHS + V.TEST_PATHS + V.SOURCE_PATHS + V.DOC_NAMES + sorted(popular) + V.DOC_EXTENSIONS
    pieces += ["a", "b/", "/", ".", "x.y", "/.git/", "spec", "test", "\n"]
    paths = ["".join(draw.choice(pieces) for _ in range(draw.randrange(4))) for _ in range(4000)]
    paths += ["".join(draw.choice("ab/._-tes") for _ in range(draw.randrange(12))) for _ in range(2000)]
    assert apply(spark, files.file_label, paths) == [literal(p) for p in paths]


def test_line_labels(spark):
    pattern = re.compile(r"^([ \t]*(#|(\\\*)|(\*\*)|(//)|(/\*))|[ \t]*$)")
    cases = ["  # x", " * x", "** x", "", "#include", "x = 1", "\\* a", "/* b", "// c", "\t ", "\r\n", "a # b", " "]
    expected = [1 if pattern.match(c.replace("\r", "").replace("\n", "")) else 0 for c in cases]
    assert apply(spark, files.line_label, cases) == expected
    assert expected[:6] == [1, 0, 1, 1, 1, 0]


def test_languages(spark):
    names = ["a.h", "a.m", "a.md", "a.R", "Makefile", "a.py", "x.rb", ".vimrc", ".py.zzz", "a.php", "nothing"]
    df = guess_language(spark.createDataFrame([(n,) for n in names], "file string"))
    found = {r.file: r.language for r in df.collect()}
    assert found == {
        "a.h": "C", "a.m": "Limbo", "a.md": "GCC Machine Description", "a.R": "ambiguous", "Makefile": "Makefile",
        "a.py": "Python", "x.rb": "Ruby", ".vimrc": "Vim script", ".py.zzz": "Python", "a.php": "Hack",
        "nothing": "ambiguous",
    }


def test_full_catalog_from_file(spark, tmp_path):
    path = tmp_path / "languages.yml"
    path.write_text(
        "# comment\n---\nAlpha:\n  type: programming\n  extensions:\n  - \".a\"\n  - \".x\"\n  filenames:\n  - Alphafile\n"
        "  aliases:\n  - \".zz\"\nB++:\n  color: \"#00\"\n  extensions:\n  - \".x\"\n  - \".b\"\nGamma ray:\n  filenames:\n"
        "  - Rayfile\n  - \"Ray file\"\n"
    )
    catalog = read_catalog(spark, str(path))
    assert sorted((r.kind, r.value, r.language) for r in catalog.collect()) == [
        ("extension", ".a", "Alpha"), ("extension", ".b", "B++"), ("extension", ".x", "Alpha"),
        ("filename", "Alphafile", "Alpha"), ("filename", "Ray file", "Gamma ray"), ("filename", "Rayfile", "Gamma ray"),
    ]
    df = spark.createDataFrame([("q.x",), ("q.b",), ("Rayfile",), ("q.zz",)], "file string")
    got = {r.file: r.language for r in guess_language(df, catalog=catalog).collect()}
    assert got == {"q.x": "Alpha", "q.b": "B++", "Rayfile": "Gamma ray", "q.zz": "ambiguous"}


def test_strip_equals_python(spark):
    cases = [" a ", "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0   　x y  ", "", " \n", "a​ "]
    assert apply(spark, text.stripped, cases) == [c.strip() for c in cases]
    assert apply(spark, text.one_line, [" a\r\nb \n"]) == ["ab"]


def test_slugs(spark):
    assert apply(spark, text.slug_to_folder, ["a/b", None]) == ["a_____b", None]
    assert apply(spark, text.folder_to_slug, ["/x/a_____b/", "a_____b", None]) == ["a/b", "a/b", None]
    assert apply(spark, text.slug_to_file_stem, ["a/b"]) == ["a_b"]
    assert apply(spark, text.split_list, ["a;b", "", "a"]) == [["a", "b"], None, ["a"]]
    assert apply(spark, text.join_list, [["a", "b"], None], "array<string>") == ["a;b", ""]


def test_weeks_and_months_equal_strftime(spark):
    days = [dt.date(1990, 1, 1) + dt.timedelta(n) for n in range(0, 40 * 365, 3)]
    weeks = apply(spark, lambda d: times.period_index(d, "week"), days, "date")
    assert weeks == [(d.year - 1990) * 52 + int(d.strftime("%U")) for d in days]
    months = apply(spark, lambda d: times.period_index(d, "month"), days, "date")
    assert months == [(d.year - 1990) * 12 + d.month for d in days]
    assert apply(spark, lambda d: times.period_index(d, "year"), days[:1], "date") == [None]


def test_issue_times(spark):
    cases = ["2017-03-01 10:11:12", "2017-03-01T10:11:12Z", "2017-03-01 10:11:12.9+05:00", "None", ""]
    at = dt.datetime(2017, 3, 1, 10, 11, 12)
    assert apply(spark, times.issue_time, cases) == [at, at, at, None, None]
    assert apply(spark, times.utc_time, [0], "bigint") == [dt.datetime(1970, 1, 1)]


def test_emails(spark):
    cases = {
        " Ann@Host.org ": "ann@host.org", "None": None, "": None, "x@y.(none)": None, "a@b.co.(none)": "a@b.co.(none)",
        "a@server.fake": None, "a@example.com": None, "a@email.com": None, "a@server.com": None, "nonsense": "nonsense",
        "a@b@c": "a@b@c",
    }
    assert apply(spark, people.clean_email, list(cases)) == list(cases.values())
    assert apply(spark, people.email_prefix, ["a@b@c", "@c", "plain", "a@"]) == ["a", None, None, "a"]
    assert apply(spark, people.email_domain, ["a@b@c", "@c", "plain", "a@"]) == ["c", "c", None, None]
    assert apply(spark, people.is_fake_login, ["ABCDEFGH", "ABCDEFG", "abcdefgh", "ABCDEFGHI", "ABCDEFGH\n"]) == [
        True, False, False, False, True]


def test_doc_and_test_paths_are_told_as_by_the_label(spark):
    paths = [
        "docs/a.py", "src/a.md", "/.git/docs/x", "a/.git/README", "test/a.py", "test/README", "docs/test/a", "src/test_a.py", "README", "LICENSE.txt",
        "a/media/x.png", "", "NOTICE", "lib/x.c", "tests/docs/a.py", "x/.gittest/test/a", None,
    ]
    labels = apply(spark, files.file_label, paths)
    assert apply(spark, files.is_doc, paths) == [label == V.DOC for label in labels]
    assert apply(spark, files.is_test, paths) == [label == V.TEST for label in labels]
