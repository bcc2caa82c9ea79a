"""Session settings the operators rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession

# "false": a join may use rows as they lie by some of its keys.  Set by those who read tables bucketed by commit.
CO_PARTITIONED = "spark.sql.requireAllClusterKeysForCoPartition"

SETTINGS = {
    # Wall-clock issue times and commit days are defined in UTC.
    "spark.sql.session.timeZone": "UTC",
    # Run-time re-planning: small sides become broadcasts by measured size,
    # hot join keys are split, small shuffle partitions are merged.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    CO_PARTITIONED: "true",
}


def build_session(app_name: str = "changelens", master: str | None = None, **extra: str) -> SparkSession:
    """Create (or reuse) a session with the settings above.

    ``extra`` takes further settings with ``_`` standing for ``.``.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    for key, value in extra.items():
        builder = builder.config(key.replace("_", "."), value)
    return builder.getOrCreate()


def apply_settings(spark: SparkSession) -> SparkSession:
    """Put the run-time settings on a session somebody else created."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark
