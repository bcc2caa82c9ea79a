"""URL filters from a path-template tree, with DataFrame functions only.

Pages are first reduced to distinct (host, path) with counts, so no step handles one url twice and a host with
most pages is spread by path.  Then the tree is built level by level.  At a node (host and template so far) the
next segment, digits written as ``#``, becomes a branch of its own or the wildcard ``*``: a branch whose share of
good labels does not differ from the rest of its node by more than ``Z`` standard errors, after a continuity
correction that asks for enough labels, is merged with the others.  This is the only rule, at every node and
depth, so how many other branches there are changes nothing.  The tree goes on, to any depth, where a node has
good and bad labels below it; what lies below the others is one wildcard ``**``.  A template is rejected if its
share of good labels, smoothed towards the overall share by ``PRIOR_WEIGHT`` labels, is below ``LEAST_PURITY``.

Fixed rules (host, path, verdict) come first: a rule fits its host and all subdomains if the path begins with
its path; of several the longest wins, of equal length the one listed first.

Defined cases: a null url or one without ``://`` has empty host and path, and no rule but one with both empty
can fit; pages without a label count towards the tree, not towards purity; a page with several labels is good
only if all are; without any label everything is allowed; equal rows are each judged; other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changelens.scratch import settle

Z = 2.0
PRIOR_WEIGHT = 10.0
LEAST_PURITY = 0.5

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


@dataclass(frozen=True)
class UrlRule:
    allow: bool
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path

    def fits(self) -> Column:
        host = F.col("host")
        return ((host == self.host) | host.endswith("." + self.host)) & F.col("path").startswith(self.path)


def with_parts(pages: DataFrame) -> DataFrame:
    """page_id, url, host and path."""
    at = F.instr("url", "://")
    rest = F.when(F.coalesce(at, F.lit(0)) > 0, F.substr("url", at + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    tail = F.substr(rest, F.length(host) + 1)
    return pages.select("page_id", "url", F.translate(host, _UPPER, _UPPER.lower()).alias("host"), F.regexp_extract(tail, r"^[^?#]*", 0).alias("path"))


def first_rule(rules: list[UrlRule]) -> Column:
    """The longest rule that fits as a struct (rule, allow), or null."""
    made = F.lit(None).cast("struct<rule:string,allow:boolean>")
    for rule in sorted(reversed(rules), key=lambda r: len(r.name)):
        made = F.when(rule.fits(), F.struct(F.lit(rule.name).alias("rule"), F.lit(rule.allow).alias("allow"))).otherwise(made)
    return made


def templates(paths: DataFrame, z: float = Z) -> DataFrame:
    """``paths``: host, path, n, labelled, good.  Adds ``template``."""
    # The first part is what stands before the first slash: nothing, in a path that has one.
    parts = F.split(F.regexp_replace("path", "[0-9]+", "#"), "/")
    current = settle(paths.select("*", parts.alias("parts"), F.lit("").alias("template")))
    columns = paths.columns
    level, done = 0, []
    while True:
        level += 1
        current = current.withColumn("segment", F.try_element_at("parts", F.lit(level + 1)))
        key = ["host", "template", "segment"]
        # Only nodes with good and bad labels below them can be told apart further.
        below = current.filter("segment IS NOT NULL").groupBy("host", "template").agg(F.sum("labelled").alias("all"), F.sum("good").alias("all_good"))
        open_nodes = below.filter("all_good > 0 AND all_good < all").select(F.col("host").alias("open_host"), F.col("template").alias("open_template"))
        ahead = current.join(open_nodes, (F.col("host") == F.col("open_host")) & (F.col("template") == F.col("open_template")), "left")
        goes_on = F.col("segment").isNotNull() & F.col("open_host").isNotNull()
        ahead = settle(ahead.select(*columns, "parts", "template", "segment", goes_on.alias("goes_on")))
        deeper = F.when(F.col("segment").isNotNull(), F.lit("/**")).otherwise(F.lit(""))
        done.append(ahead.filter("NOT goes_on").select(*columns, F.concat("template", deeper).alias("template")))
        current = ahead.filter("goes_on").drop("goes_on")
        if current.isEmpty():
            break
        branches = current.filter("segment IS NOT NULL").groupBy(*key).agg(F.sum("labelled").alias("ours"), F.sum("good").alias("our_good"))
        nodes = branches.groupBy("host", "template").agg(F.sum("ours").alias("all"), F.sum("our_good").alias("all_good"))
        both = branches.join(nodes, ["host", "template"])
        others, other_good = F.col("all") - F.col("ours"), F.col("all_good") - F.col("our_good")
        share = F.col("all_good") / F.greatest(F.col("all"), F.lit(1))
        apart = F.abs(F.col("our_good") / F.greatest("ours", F.lit(1)) - other_good / F.greatest(others, F.lit(1)))
        error = F.sqrt(share * (1 - share) * (1 / F.greatest("ours", F.lit(1)) + 1 / F.greatest(others, F.lit(1))))
        half_step = 0.5 * (1 / F.greatest("ours", F.lit(1)) + 1 / F.greatest(others, F.lit(1)))
        own = (F.col("ours") > 0) & (others > 0) & (apart - half_step > z * error)
        kept = both.filter(own).select(*[F.col(c).alias(f"kept_{c}") for c in key])
        same = (current["host"] == kept["kept_host"]) & (current["template"] == kept["kept_template"]) & (current["segment"] == kept["kept_segment"])
        joined = current.join(kept, same, "left")
        symbol = F.when(F.col("segment").isNull(), F.lit("")).otherwise(F.concat(F.lit("/"), F.coalesce("kept_segment", F.lit("*"))))
        current = settle(joined.select(*columns, "parts", F.concat("template", symbol).alias("template")))
    made = done[0]
    for other in done[1:]:
        made = made.unionByName(other)
    return made


def judge(pages: DataFrame, labels: DataFrame, rules: list[UrlRule], prior_weight: float = PRIOR_WEIGHT, least_purity: float = LEAST_PURITY, **settings) -> DataFrame:
    """``labels``: page_id, good.  Per page: page_id, host, path, rule, verdict, template, purity."""
    parts = settle(with_parts(pages).drop("url"))
    known = labels.filter("page_id IS NOT NULL AND good IS NOT NULL").groupBy("page_id").agg(F.min("good").alias("good"))
    marked = parts.join(known.withColumnRenamed("page_id", "label_id"), F.col("page_id") == F.col("label_id"), "left")
    paths = marked.groupBy("host", "path").agg(F.count("*").alias("n"), F.count("good").alias("labelled"), F.count_if("good").alias("good"))
    tree = settle(templates(paths, **settings))
    overall = tree.agg(F.sum("good") / F.nullif(F.sum("labelled"), F.lit(0))).first()[0]
    prior = 1.0 if overall is None else float(overall)
    sums = tree.groupBy("host", "template").agg(F.sum("labelled").alias("of"), F.sum("good").alias("ok"))
    purity = ((F.col("ok") + prior_weight * prior) / (F.col("of") + prior_weight)).alias("purity")
    rated = tree.select("host", "path", "template").join(sums.select("host", "template", purity), ["host", "template"])
    found = parts.join(rated, ["host", "path"]).withColumn("first_rule", first_rule(rules))
    allowed = F.coalesce(F.col("first_rule.allow"), F.col("purity") >= least_purity)
    return found.select("page_id", "host", "path", F.col("first_rule.rule").alias("rule"), F.when(allowed, "allow").otherwise("block").alias("verdict"), "template", "purity")
