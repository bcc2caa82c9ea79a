"""Native tables: Parquet in versions, partitioned by project where a table has one.

A folder holds ``data/<version>-<id>/<table>`` and ``published/version=<n>``.  A draft writes tables to a place of its own,
where no reader looks; publishing adds one small file that names them, moved into place as a whole.  So readers see all
tables of a draft or none, and a writer that is lost half-way leaves the published history as it was.  Two drafts begun
from one version cannot both be published.

A draft replaces a table, or only some of its *units* (values of its partition columns, such as projects).  A reader
takes each unit from the last version that replaced it.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from changelens.at_once import at_once
from changelens.functions.text import slug_to_folder
from changelens.operators.aliases import AliasResolution
from changelens.scratch import COMPRESSION

PROJECT = "project_folder"
#: Units that a reader names in a partition filter; more of them are looked up by a join.
NAMED_UNITS = 1000

_ROW = "table string, place string, parts string, some boolean, columns string"
_MANIFEST = f"version bigint, {_ROW}"


def published(spark: SparkSession, folder: str) -> list[Row]:
    """What has been published, oldest first: a row for each table that a version replaced, wholly or in ``some`` units."""
    try:
        return spark.read.schema(_MANIFEST).json(f"{folder}/published").orderBy("version", "table").collect()
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return []
        raise


class Draft:
    """Tables to be published together."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self.rows: list[tuple] = []
        self.version = max((row.version for row in published(spark, folder)), default=0) + 1
        self.place = f"data/{self.version}-{uuid.uuid4().hex}"

    def write(
        self, df: DataFrame, table: str, units: DataFrame | None = None, parts: list[str] | None = None,
        spelled: Callable[[DataFrame], DataFrame] = lambda rows: rows,
    ) -> None:
        """Write a table, partitioned by ``parts`` (else by project, if it has a ``slug``).

        Rows are rebalanced on the partition columns first, so that a task writes few projects and a large project is
        split among tasks by size.  ``units`` lists the units that this replaces, also those without rows now.
        ``spelled`` gives rows as they are to be written, after they were moved.
        """
        if parts is None:
            parts = [PROJECT] if "slug" in df.columns else []
        if PROJECT in parts and PROJECT not in df.columns:
            df = df.withColumn(PROJECT, slug_to_folder(F.col("slug" if "slug" in df.columns else "project")))
        path = f"{self.folder}/{self.place}/{table}"
        if parts:
            spelled(df.hint("rebalance", *[F.col(p) for p in parts])).write.option("compression", COMPRESSION).partitionBy(*parts).parquet(path)
        else:
            spelled(df).write.option("compression", COMPRESSION).parquet(path)
        if units is not None:
            units.select(*parts).distinct().write.parquet(f"{path}.units")
        self.rows.append((table, self.place, ",".join(parts), units is not None, spelled(df).schema.json()))

    def written(self, table: str) -> DataFrame:
        """What this draft holds of a table."""
        return _version(self.spark, self.folder, next(row for row in self._mine() if row.table == table))

    def read(self, table: str, units: DataFrame | None = None, drop: bool = True) -> DataFrame:
        """A table (of some ``units`` only, if they are given) as it will be once this draft is published."""
        found = _read(self.spark, self.folder, table, published(self.spark, self.folder) + self._mine(), units)
        return found.drop(PROJECT) if drop else found

    def _mine(self) -> list[Row]:
        return [Row(version=self.version, table=t, place=p, parts=k, some=s, columns=c) for t, p, k, s, c in self.rows]

    def publish(self) -> None:
        manifest = self.spark.createDataFrame(self.rows, _ROW)
        manifest.coalesce(1).write.json(f"{self.folder}/published/version={self.version}")


def _version(spark: SparkSession, folder: str, row: Row) -> DataFrame:
    """A table as one version wrote it; the manifest knows its columns, so a table without rows can be read too."""
    schema = T.StructType.fromJson(json.loads(row.columns))
    return spark.read.schema(schema).parquet(f"{folder}/{row.place}/{row.table}")


def _read(spark: SparkSession, folder: str, table: str, manifest: list[Row], units: DataFrame | None = None) -> DataFrame:
    rows = [row for row in manifest if row.table == table]
    whole = max((k for k, row in enumerate(rows) if not row.some), default=0)
    rows = rows[whole:]
    if not rows:
        raise ValueError(f"no table {table} has been published in {folder}")
    parts = [p for p in rows[0].parts.split(",") if p]
    versions = [_version(spark, folder, row) for row in rows]
    if units is not None and parts:
        wanted = units.select(*[p for p in parts if p in units.columns]).distinct()
        versions = [_of_units(version, wanted) for version in versions]
    if len(rows) == 1:
        return versions[0]
    replaced = [spark.read.parquet(f"{folder}/{row.place}/{table}.units").withColumn("_last", F.lit(row.version)) for row in rows[1:]]
    last = replaced[0]
    for more in replaced[1:]:
        last = last.unionByName(more)
    last = last.groupBy(*parts).agg(F.max("_last").alias("_last"))
    found = versions[0].withColumn("_version", F.lit(rows[0].version))
    for row, version in zip(rows[1:], versions[1:]):
        found = found.unionByName(version.withColumn("_version", F.lit(row.version)), allowMissingColumns=True)
    live = found.join(last, parts, "left").filter(F.coalesce("_last", F.lit(rows[0].version)) == F.col("_version"))
    return live.drop("_last", "_version")


def _of_units(df: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows of some units; few units become a filter on the partition columns, so other files are not opened."""
    names = wanted.limit(NAMED_UNITS + 1).collect()
    if len(names) > NAMED_UNITS:
        return df.join(wanted, wanted.columns, "left_semi")
    if len(wanted.columns) == 1:
        return df.filter(F.col(wanted.columns[0]).isin([row[0] for row in names]))
    matches = [F.struct(*[F.lit(value).alias(c) for c, value in row.asDict().items()]) for row in names]
    return df.filter(F.struct(*wanted.columns).isin(matches)) if matches else df.limit(0)


def write_native(df: DataFrame, folder: str, table: str) -> None:
    """Write and publish one table."""
    draft = Draft(df.sparkSession, folder)
    draft.write(df, table)
    draft.publish()


def read_native(spark: SparkSession, folder: str, table: str, slugs: list[str] | None = None, units: DataFrame | None = None) -> DataFrame:
    """Read a published table, optionally of some projects or ``units`` only (partition pruning)."""
    if slugs is not None:
        units = spark.createDataFrame([(slug.replace("/", "_____"),) for slug in slugs], f"{PROJECT} string")
    return _read(spark, folder, table, published(spark, folder), units).drop(PROJECT)


def write_aliases(resolution: AliasResolution, draft: Draft) -> None:
    """Alias map and its audit tables: groups with rule counts, members, shared-address groups; the others go on from the written groups."""
    draft.write(resolution.groups, "alias_groups")
    resolution.groups = draft.written("alias_groups")
    with at_once(draft.spark) as begin:
        begin(draft.write, resolution.map(), "alias_map")
        begin(draft.write, resolution.members(), "alias_members")
        begin(draft.write, resolution.shared_emails(), "alias_shared_emails")
