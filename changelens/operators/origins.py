"""From the removed lines of a bug fix to the commits that introduced them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from changelens.functions import fixed_values as V
from changelens.functions.files import file_label, is_doc, is_test, line_label
from changelens.functions.text import last_segment
from changelens.functions.times import micros, seconds
from changelens.scratch import deal, settle, settle_by

# An origin commit at or beyond these sizes says nothing about a bug.
MAX_FILES, MAX_NEW_LINES = 50, 200

# Lines in a bin at the finest level, and how much longer bins are from level to level; the last level
# takes hunks of any length that a line number can have.
FINEST_BIN, COARSER = 64, 8
LEVELS = range(9)
SECONDS_PER_DAY = 86_400


def removed_lines(fixes: DataFrame, diff_lines: DataFrame) -> DataFrame:
    """Removed lines of fixing commits, outside tests, binaries and documentation.

    The test rule looks at the base name of the new path, the documentation
    rule at the full old path.  Gives ``slug, fix_sha, path, type, patch_pos,
    hunk_pos, old_lineno, content, is_code``.
    """
    not_test = ~is_test(last_segment(F.col("new_path")))
    not_doc = ~is_doc(F.col("old_path"))
    removed = diff_lines.filter((F.col("origin") == "-") & ~F.col("is_binary") & not_test & not_doc)
    return removed.join(fixes.select("slug", "sha"), ["slug", "sha"], "left_semi").select(
        "slug",
        F.col("sha").alias("fix_sha"),
        F.col("old_path").alias("path"),
        file_label(F.col("old_path")).alias("type"),
        "patch_pos",
        "hunk_pos",
        "old_lineno",
        "content",
        (line_label(F.col("content")) == V.CODE).alias("is_code"),
    )


def _bin_size(level: int) -> int:
    return FINEST_BIN * COARSER**level


def _hunk_level() -> Column:
    """Finest level at which a hunk is at most ``COARSER`` bins long."""
    level = F.lit(len(LEVELS) - 1)
    for k in reversed(LEVELS[:-1]):
        level = F.when(F.col("num_lines") <= COARSER * _bin_size(k), F.lit(k)).otherwise(level)
    return level


def _bins(low: Column, high: Column, level: Column) -> Column:
    """Bins that a span of lines touches at its level."""
    size = F.lit(FINEST_BIN) * F.pow(F.lit(COARSER), level).cast("bigint")
    return F.sequence(F.floor(low / size), F.floor(high / size))


def binned_hunks(blame_hunks: DataFrame) -> DataFrame:
    """Hunks under the bins of lines they touch: ``slug, fix_sha, path, level, bin, first, last, blamed_sha``.

    Bins are ``FINEST_BIN`` lines long at level 0 and ``COARSER`` times longer from level to level.  A hunk
    lies at the level that suits its length, so it is copied to at most ``COARSER`` + 1 bins however many
    lines it has, and a bin of a coarse level holds few hunks.
    """
    first = F.col("start_line").cast("bigint")
    spans = blame_hunks.filter(F.col("num_lines") > 0).select(
        "slug", "fix_sha", "path", "blamed_sha", first.alias("first"), (first + F.col("num_lines") - 1).alias("last"), _hunk_level().alias("level")
    )
    return spans.withColumn("bin", F.explode(_bins(F.col("first"), F.col("last"), F.col("level"))))


def levels_in_use(blame_hunks: DataFrame) -> list[int]:
    """Levels at which hunks lie; ordinary histories have one or two."""
    used = blame_hunks.filter(F.col("num_lines") > 0).agg(F.bit_or(F.call_function("shiftleft", F.lit(1), _hunk_level()))).first()[0] or 0
    return [k for k in LEVELS if used >> k & 1]


def lines_with_origin(removed: DataFrame, blame_hunks: DataFrame) -> DataFrame:
    """Removed lines with the commit that last wrote them; lines without one fall out.

    An interval join on equal keys: a line looks into one bin at each level in use, and whether it lies inside a
    hunk is checked there.  Neither side is spread over the lines of a hunk.
    """
    line = F.col("old_lineno").cast("bigint")
    places = [F.struct(F.lit(k).alias("level"), F.floor(line / _bin_size(k)).alias("bin")) for k in levels_in_use(blame_hunks) or [0]]
    looking = removed.withColumn("_at", F.explode(F.array(*places))).select(*removed.columns, "_at.level", "_at.bin")
    met = looking.join(binned_hunks(blame_hunks), ["slug", "fix_sha", "path", "level", "bin"])
    return met.filter(line.between(F.col("first"), F.col("last"))).select(*removed.columns, "blamed_sha")


def _day_of(at: Column) -> Column:
    return F.floor(at / SECONDS_PER_DAY)


def last_before(asked: DataFrame, known: DataFrame, key: list[str], same: bool = False) -> DataFrame:
    """``key, at, value``: for each asked second the value of the last known second before it, if there is one.

    ``asked`` is ``key, at`` and ``known`` is ``key, at, value``, both distinct by ``key, at``.  With ``same`` a value at
    the asked second counts too.  The value is looked up inside a day (at most 86,400 seconds on each side) and,
    failing that, carried over from the last earlier day that has one, so no window grows with a key's history.
    """
    questions = asked.select(*key, "at", F.lit(None).cast(known.schema["value"].dataType).alias("value"), F.lit(True).alias("asked"))
    points = known.select(*key, "at", "value", F.lit(False).alias("asked")).unionByName(questions).withColumn("day", _day_of(F.col("at")))
    in_day = (
        Window.partitionBy(*key, "day")
        .orderBy("at", F.asc("asked") if same else F.desc("asked"))
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    same_day = points.withColumn("same_day", F.last("value", ignorenulls=True).over(in_day)).filter("asked")
    before_day = Window.partitionBy(*key).orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    days = (
        points.groupBy(*key, "day")
        .agg(F.max_by("value", F.when(~F.col("asked"), F.col("at"))).alias("last_of_day"))
        .withColumn("carried", F.last("last_of_day", ignorenulls=True).over(before_day))
        .drop("last_of_day")
    )
    found = same_day.join(days, [*key, "day"]).select(*key, "at", F.coalesce("same_day", "carried").alias("value"))
    return found.filter("value IS NOT NULL")


def lines_with_latest_addition(removed: DataFrame, fix_times: DataFrame, additions: DataFrame, renames: DataFrame | None = None) -> DataFrame:
    """Origins by content, for histories without blame hunks.

    The origin of a removed line is the last earlier commit that added the
    same text to the same file.  This is a published variant of the search,
    not the exact result of a blame, so prefer :func:`lines_with_origin`.

    ``fix_times`` is ``(slug, sha, ts)``; ``additions`` is ``(slug, path,
    content, sha, ts)``.  A file is a path, or with ``renames`` (see
    :func:`file_lineage`) whatever has been that file under its earlier names.
    File and text travel as one digest.  Both sides are dealt out by it once, as
    one row for each second, and the last addition before a line is looked up
    there; seconds of one text in one file are sorted in one task, which spills.
    Lines and additions without a time have no origin and are none.
    """
    times = fix_times.select("slug", F.col("sha").alias("fix_sha"), seconds(F.col("ts")).alias("at"))
    timed = removed.join(times, ["slug", "fix_sha"])
    added = additions.select("slug", "path", "content", "sha", seconds(F.col("ts")).alias("at"))
    file = ["path"]
    if renames is not None:
        file = ["file", "since"]
        lineage = settle(file_lineage(renames))
        timed, added = with_file(timed, lineage, same=False), with_file(added, lineage, same=True)
    # Null if the file or the text is.
    text = F.unhex(F.md5(F.concat(F.md5("content"), *[F.md5(F.col(c).cast("string")) for c in file]))).alias("text")
    key = ["slug", "text"]
    timed = timed.sparkSession.table(settle_by(timed.select(*removed.columns, "at", text), *key))
    asked = timed.select(*key, "at", F.lit(None).cast(added.schema["sha"].dataType).alias("value"), F.lit(True).alias("asked"))
    points = added.select("slug", text, "at", F.col("sha").alias("value"), F.lit(False).alias("asked")).unionByName(asked)
    at_second = deal(points.filter("at IS NOT NULL"), *key).groupBy(*key, "at").agg(F.max("value").alias("value"), F.bool_or("asked").alias("asked"))
    before = Window.partitionBy(*key).orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    answers = at_second.withColumn("blamed_sha", F.last("value", ignorenulls=True).over(before)).filter("asked AND blamed_sha IS NOT NULL")
    return timed.join(answers.select(*key, "at", "blamed_sha"), [*key, "at"]).select(*removed.columns, "blamed_sha")


#: ``since`` of a file that was there before any rename.
ALWAYS = -(1 << 62)


def file_lineage(renames: DataFrame) -> DataFrame:
    """``slug, path, at, file, since``: from second ``at`` on (to the path's next row) what lies at ``path`` is the file
    that began as path ``file`` at second ``since``.

    ``renames`` is ``(slug, old_path, new_path, ts)``.  A rename ends the file at its old path, where a new one may
    begin, and goes on with it at the new path; commits are taken in the order of their times.  If a path is renamed to
    several at one second, the least continues the file; if several come to one path, the least old path does.
    Earlier names are found by following pointers, which double their length in every round.
    """
    named = renames.filter("old_path <> new_path").select("slug", "old_path", "new_path", seconds(F.col("ts")).alias("at"))
    moves = settle(named.groupBy("slug", "old_path", "at").agg(F.min("new_path").alias("new_path")))
    began = moves.select("slug", F.col("new_path").alias("path"), "at", F.col("old_path").alias("before"))
    ended = moves.select("slug", F.col("old_path").alias("path"), "at", F.lit(None).cast("string").alias("before"))
    # A path that something else was moved to at the same second has begun anew as that, else as an empty file.
    starts = settle(began.unionByName(ended).groupBy("slug", "path", "at").agg(F.min("before").alias("before")))
    known = starts.select("slug", "path", "at", F.col("at").alias("value"))
    asked = starts.filter("before IS NOT NULL").select("slug", F.col("before").alias("path"), "at").distinct()
    earlier = last_before(asked, known, ["slug", "path"]).select("slug", F.col("path").alias("before"), "at", F.col("value").alias("before_at"))
    state = starts.join(earlier, ["slug", "before", "at"], "left").select(
        "slug", "path", "at",
        F.when(F.col("before").isNull(), F.col("path")).otherwise(F.col("before")).alias("file"),
        F.when(F.col("before").isNull(), F.col("at")).otherwise(F.coalesce("before_at", F.lit(ALWAYS))).alias("since"),
    )
    state = settle(state)
    moved = 1
    while moved:
        step = state.select("slug", F.col("path").alias("file"), F.col("at").alias("since"), F.col("file").alias("next_file"), F.col("since").alias("next_since"))
        joined = state.join(step, ["slug", "file", "since"], "left").select(
            "slug", "path", "at", F.coalesce("next_file", "file").alias("file"), F.coalesce("next_since", "since").alias("since"),
            (F.col("next_since") < F.col("since")).alias("moved"),
        )
        state = settle(joined)
        moved = state.filter("moved").count()
        state = state.drop("moved")
    return state


def with_file(rows: DataFrame, lineage: DataFrame, same: bool) -> DataFrame:
    """``rows`` (``slug, path, at``) with the ``file, since`` that lies at the path just before ``at`` (``same``: at it).

    Only paths that take part in renames are looked up.
    """
    key = ["slug", "path"]
    known = lineage.select(*key, "at", F.struct("file", "since").alias("value"))
    moved = lineage.select(*key).distinct()
    asked = rows.select(*key, "at").distinct().join(moved, key, "left_semi")
    found = last_before(asked, known, key, same)
    return rows.join(found, [*key, "at"], "left").select(
        *rows.columns, F.coalesce("value.file", "path").alias("file"), F.coalesce("value.since", F.lit(ALWAYS)).alias("since")
    )


def plausible_origins(commit_sizes: DataFrame, max_files: int = MAX_FILES, max_new_lines: int = MAX_NEW_LINES) -> DataFrame:
    """``(slug, blamed_sha)`` of non-root commits small enough to be an origin.

    ``commit_sizes`` has ``slug, sha, num_parents, num_files_changed,
    num_additions``.
    """
    small = (
        (F.col("num_parents") > 0)
        & (F.col("num_files_changed") < max_files)
        & (F.coalesce("num_additions", F.lit(0)) < max_new_lines)
    )
    return commit_sizes.filter(small).select("slug", F.col("sha").alias("blamed_sha")).distinct()


def bug_origins(lines: DataFrame, origins: DataFrame) -> DataFrame:
    """Code lines per fix, file and origin commit.

    ``lines`` comes from one of the two ``lines_with_*`` functions.  Lines are
    counted before origins are looked up, so a commit that is the origin of
    very many lines costs few rows there.
    """
    counted = (
        lines.filter("is_code")
        .groupBy("slug", "fix_sha", "path", "type", "blamed_sha")
        .agg(F.count("*").alias("num_blamed_lines"))
    )
    return counted.join(origins, ["slug", "blamed_sha"], "left_semi").select(
        "slug", F.col("fix_sha").alias("bug_fixing_commit"), "path", "type",
        F.col("blamed_sha").alias("blamed_commit"), "num_blamed_lines",
    )


def bug_origins_compat(lines: DataFrame, origins: DataFrame, commit_times: DataFrame) -> DataFrame:
    """One row per origin commit, credited to the first hunk that reached it.

    The historic single-process output: code lines are counted over all fixes
    and put down to the hunk met first when fixes are visited newest first,
    comment-only hunks included.  ``commit_times`` is ``(slug, sha,
    committed_at)``.
    """
    per_hunk = lines.groupBy("slug", "fix_sha", "path", "type", "patch_pos", "hunk_pos", "blamed_sha").agg(
        F.count_if("is_code").alias("code_lines")
    )
    visited = per_hunk.join(origins, ["slug", "blamed_sha"], "left_semi").join(
        commit_times.select("slug", F.col("sha").alias("fix_sha"), "committed_at"), ["slug", "fix_sha"]
    )
    turn = F.struct(-micros(F.col("committed_at")), F.col("fix_sha"), F.col("patch_pos"), F.col("hunk_pos"))
    return (
        visited.groupBy("slug", "blamed_sha")
        .agg(
            F.min_by(F.struct("fix_sha", "path", "type"), turn).alias("first"),
            F.sum("code_lines").alias("num_blamed_lines"),
        )
        .filter("num_blamed_lines > 0")
        .select(
            "slug", F.col("first.fix_sha").alias("bug_fixing_commit"), "first.path", "first.type",
            F.col("blamed_sha").alias("blamed_commit"), "num_blamed_lines",
        )
    )
