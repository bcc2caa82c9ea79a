"""Versioned tables, and activity merged from its daily state."""

import datetime as dt
import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from changelens.operators import activity_state
from changelens.sources import tables
from tests.conftest import rows

SHAPE = "slug string, n int"


def test_a_failing_writer_leaves_the_old_version(spark, table, tmp_path):
    folder = str(tmp_path / "h")
    tables.write_native(table([("o/p", 1), ("o/q", 2)], SHAPE), folder, "facts")
    draft = tables.Draft(spark, folder)
    draft.write(table([("o/p", 9)], SHAPE), "facts")
    broken = table([("o/p", 1), ("o/q", 2)], SHAPE).repartition(2).withColumn("n", F.when(F.col("n") == 2, F.raise_error(F.lit("lost")).cast("int")).otherwise(F.col("n")))
    with pytest.raises(Exception, match="lost"):
        draft.write(broken, "more")
    assert rows(tables.read_native(spark, folder, "facts")) == [("o/p", 1), ("o/q", 2)]
    with pytest.raises(ValueError, match="no table more"):
        tables.read_native(spark, folder, "more")
    later = tables.Draft(spark, folder)
    later.write(table([("o/r", 3)], SHAPE), "facts")
    assert rows(later.read("facts")) == [("o/r", 3)] and rows(tables.read_native(spark, folder, "facts")) == [("o/p", 1), ("o/q", 2)]
    later.publish()
    assert rows(tables.read_native(spark, folder, "facts")) == [("o/r", 3)]
    with pytest.raises(Exception, match="(?i)exist"):
        draft.publish()


@pytest.mark.parametrize("named", [tables.NAMED_UNITS, 0])
def test_units_are_replaced_one_by_one(spark, table, tmp_path, monkeypatch, named):
    monkeypatch.setattr(tables, "NAMED_UNITS", named)
    folder, draw, held = str(tmp_path / "h"), random.Random(1), {}
    for turn in range(5):
        projects = [f"o/{k}" for k in range(8)] if turn in (0, 3) else draw.sample([f"o/{k}" for k in range(9)], 3)
        new = {p: [turn * 100 + k for k in range(draw.randrange(3))] for p in projects}
        held = new if turn in (0, 3) else held | new
        draft = tables.Draft(spark, folder)
        units = table([(p.replace("/", "_____"),) for p in projects], f"{tables.PROJECT} string")
        draft.write(table([(p, n) for p, ns in new.items() for n in ns], SHAPE), "facts", None if turn in (0, 3) else units)
        draft.publish()
        expected = sorted(((p, n) for p, ns in held.items() for n in ns), key=repr)
        assert rows(tables.read_native(spark, folder, "facts").select("slug", "n")) == expected
        some = tables.read_native(spark, folder, "facts", ["o/1", "o/2"]).select("slug", "n")
        assert rows(some) == [r for r in expected if r[0] in ("o/1", "o/2")]
    if named:
        assert re.search(r"PartitionFilters: \[[^\]]*project_folder", some._jdf.queryExecution().toString())


def test_sets_of_days_merge_to_any_period(spark, table):
    draw, first = random.Random(2), dt.date(2020, 1, 1)
    given = [("u", draw.choice("pq"), first + dt.timedelta(days=draw.randrange(60)), f"f{int(draw.expovariate(0.01))}") for _ in range(900)]
    values = table(given, "user_id string, project string, day date, value string").distinct().withColumn("kinds", F.array(F.lit("file")))
    numbers = rows(activity_state.numbered(values, ["user_id", "project"]).select("project", "number"))
    expected = defaultdict(set)
    for _, project, _, value in given:
        expected[project].add(value)
    assert numbers == sorted(((p, n) for p, v in expected.items() for n in range(len(v))), key=repr)
    state = activity_state.ActivityState(
        values.groupBy("user_id", "project", "day").agg(F.count("*").alias("touches")), activity_state._sets(values, ["user_id", "project"]),
        ["user_id", "project"], {"file": "files"}, ["touches", "files"])
    for period, key in (("day", lambda d: d), ("month", lambda d: (d.year - 1990) * 12 + d.month)):
        counted = defaultdict(set)
        for _, project, day, value in given:
            counted[project, key(day)].add(value)
        found = activity_state.roll_up(state, period)
        assert rows(found, "project", period, "files") == sorted(((*k, len(v)) for k, v in counted.items()), key=repr)
