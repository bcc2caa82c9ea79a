"""Identity run: contributors to alias map and audit tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from changelens.functions.text import join_list
from changelens.operators.aliases import RULES, AliasResolution
from changelens.sources.csv_tables import write_delimited
from changelens.sources.tables import Draft, read_native, write_aliases


def resolve_identities(spark: SparkSession, folder: str, audit: str | None = None) -> DataFrame:
    """Resolve the contributors written to ``folder``, write the alias tables there, return the map.

    ``audit`` names a folder for ``;``-delimited audit files as well: the map,
    the groups with the rules that fired, and the members of uncertain groups.
    Members of an uncertain group that share an address are listed in the log and
    the map as a group of their own too.
    """
    resolution = AliasResolution(read_native(spark, folder, "contributors"))
    draft = Draft(spark, folder)
    write_aliases(resolution, draft)
    draft.publish()
    if audit:
        aliases = read_native(spark, folder, "alias_map")
        members = read_native(spark, folder, "alias_members")
        fired = [F.when(F.col(r) > 0, F.concat(F.lit(f"{r}="), F.col(r))) for r in RULES]
        groups = read_native(spark, folder, "alias_groups").withColumn("rules", join_list(F.array_compact(F.array(*fired))))
        log = members.join(groups.select("cluster", "rules"), "cluster")
        shared = read_native(spark, folder, "alias_shared_emails")
        same = (log["cluster"] == shared["cluster"]) & log["email"].eqNullSafe(shared["email"])
        parts = log.join(shared, same).select(log["cluster"], "rules", shared["rep"], "uid", "name", log["email"])
        both = aliases.filter("uid <> rep").unionByName(parts.filter("uid <> rep").select("uid", "rep"))
        write_delimited(both, f"{audit}/idm_map")
        columns = ["cluster", "rules", "rep", "uid", "name", "email"]
        write_delimited(log.filter("valid").select(*columns).unionByName(parts), f"{audit}/idm_log")
        write_delimited(log.filter("not valid").select(*columns), f"{audit}/idm_maybe")
    return read_native(spark, folder, "alias_map")
