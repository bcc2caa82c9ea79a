"""Activity kept per day in a form that weeks and months are merged from.

Sums of days are sums of longer periods, but distinct counts are not.  So a day keeps its distinct files and issues as
exact sets: each value has a number inside its group (developer and project, or developer and language), and a set is
a table of words of 64 bits, ``(word, bits)``.  Sets are merged by ``bit_or`` and counted by ``bit_count``, both plain
aggregates with partial results.  Values are numbered in the order of the day they first occur on, so the values of a day
share few words; a set of any size is rows, never one cell.  (Spark's own ``bitmap_*`` aggregates do the same in units
of 4 KB each, a thousand times what a developer's day needs.)

The state is derived once from commits and files; reports of every period are then merges of it.  What a group counts is
written bucketed by the group, so its numbers, sets and reports need no further shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from changelens.functions.ids import ids_as_text
from changelens.functions.times import activity_period
from changelens.operators import activity as A
from changelens.operators.changes import COMMIT
from changelens.operators.classify import guess_language
from changelens.scratch import deal, settle_by

#: Splits of the values that occur first on one day, so that a day with very many is not numbered in one task.
SPLITS = 16

PROJECT_SETS = {"file": "num_files_touched", "src_file": "num_src_files_touched", "issue": "num_bugs_induced"}
LANGUAGE_SETS = {"src_file": "num_src_files_touched"}


@dataclass
class ActivityState:
    """``sums``: a row per group and day; ``sets``: ``kind, word, bits`` per group and day.

    The developer's id may be packed (``functions.ids``), as it is in a state that was just derived.
    """

    sums: DataFrame
    sets: DataFrame
    group: list[str]
    set_names: dict[str, str]
    measures: list[str]


def numbered(values: DataFrame, group: list[str]) -> DataFrame:
    """``group, value, number``: dense numbers from 0 inside each group, by first day.  ``values``: ``group, day, value``."""
    first = values.groupBy(*group, "value").agg(F.min("day").alias("since")).withColumn("split", F.pmod(F.xxhash64("value"), F.lit(SPLITS)))
    inside = Window.partitionBy(*group, "since", "split").orderBy("value")
    before = Window.partitionBy(*group).orderBy("since", "split").rowsBetween(Window.unboundedPreceding, -1)
    ahead = first.groupBy(*group, "since", "split").agg(F.count("*").alias("n"))
    ahead = ahead.withColumn("ahead", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    ranked = first.withColumn("rank", F.row_number().over(inside) - 1)
    return ranked.join(ahead, [*group, "since", "split"]).select(*group, "value", (F.col("rank") + F.col("ahead")).alias("number"))


def _sets(values: DataFrame, group: list[str]) -> DataFrame:
    """Words of the set of every day.  ``values``: ``group, day, value, kinds`` (array)."""
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.col("number") % 64).cast("int"))
    placed = values.join(numbered(values, group), [*group, "value"])
    return (
        placed.select(*group, "day", F.explode("kinds").alias("kind"), F.floor(F.col("number") / 64).alias("word"), bit.alias("bit"))
        .groupBy(*group, "day", "kind", "word")
        .agg(F.bit_or("bit").alias("bits"))
    )


def _kinds(flag: Column) -> Column:
    return F.when(flag, F.array(F.lit("file"), F.lit("src_file"))).otherwise(F.array(F.lit("file")))


def project_state(facts: DataFrame, changes: DataFrame, induced: DataFrame, aliases: DataFrame) -> ActivityState:
    """State of the report per developer and project."""
    group = ["user_id", "project"]
    keys = [*group, "day"]
    rows = A.project_rows(facts, changes, induced, aliases, "day", lambda found: deal(found, *group))
    once = facts.sparkSession.table(settle_by(rows, *group))
    sums = A.count_project_rows(once, keys, [m for m in A.PROJECT_MEASURES if m not in PROJECT_SETS.values()])
    kinds = F.when(F.col("kind") == "file", _kinds(F.col("flag") > 0)).otherwise(F.array(F.lit("issue")))
    # Files and issues are numbered each for themselves.
    values = once.filter("kind <> 'commit'").select(*group, F.col("kind").alias("of"), "day", "value", kinds.alias("kinds"))
    return ActivityState(sums, _sets(values, [*group, "of"]).drop("of"), group, PROJECT_SETS, A.PROJECT_MEASURES)


def language_state(facts: DataFrame, changes: DataFrame, aliases: DataFrame, catalog: DataFrame | None = None) -> ActivityState:
    """State of the report per developer and language."""
    group = ["user_id", "language"]
    keys = [*group, "day"]
    spot = A.packed_commits(facts, aliases, "day", []).select(*COMMIT, "user_id", "day")
    found = guess_language(A.source_file_rows(changes).join(spot, COMMIT), "file", "language", catalog)
    rows = facts.sparkSession.table(settle_by(found, *group))
    sums = A.language_sums(A.first_in_commit(rows, keys), keys)
    files = rows.select(*keys, F.col("file").alias("value")).distinct().withColumn("kinds", F.array(F.lit("src_file")))
    return ActivityState(sums, _sets(files, group), group, LANGUAGE_SETS, A.LANGUAGE_MEASURES)


def roll_up(state: ActivityState, period: str) -> DataFrame:
    """The report of a period, as ``operators.activity`` gives it, from the state alone."""
    keys = [*state.group, period]
    at = activity_period(F.col("day"), period)
    merged = state.sets.withColumn(period, at).groupBy(*keys, "kind", "word").agg(F.bit_or("bits").alias("bits"))
    sizes = merged.groupBy(*keys).agg(*[F.sum(F.when(F.col("kind") == kind, F.bit_count("bits")).otherwise(0)).alias(m) for kind, m in state.set_names.items()])
    added = [m for m in state.measures if m not in state.set_names.values()]
    sums = state.sums.withColumn(period, at).groupBy(*keys).agg(*[F.sum(m).alias(m) for m in added])
    # Whatever has a set has sums.  Both lie by group, so they meet there; a day may be unknown.
    same = F.col(f"s.{period}").eqNullSafe(F.col(f"n.{period}"))
    for column in state.group:
        same = same & (F.col(f"s.{column}") == F.col(f"n.{column}"))
    found = sums.alias("s").join(sizes.alias("n"), same, "left")
    counts = [F.coalesce(F.col(f"n.{m}") if m in state.set_names.values() else F.col(f"s.{m}"), F.lit(0)).cast("bigint").alias(m) for m in state.measures]
    return ids_as_text(found.select(*[F.col(f"s.{k}") for k in keys], *counts))
