"""Merging the several identities of one developer.

Steps: one identity per uid; the keys an identity can be found by; clues, that
is pairs of identities sharing a key; a decision per pair; clusters by first
touch; validity of each cluster; the alias map.

Buckets of a key are limited to nine identities by the rules themselves, with
two exceptions that are handled without listing pairs or groups: buckets of
equal e-mail addresses (see :func:`email_edges`, :func:`email_credits`) and
the login side of a cross-space clue, which is streamed against at most nine
partners.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from changelens.functions.people import (
    clean_email,
    email_domain,
    email_prefix,
    is_composite,
    is_fake_login,
    is_platform,
    login_keys,
    name_keys,
)
from changelens.functions.text import stripped
from changelens.scratch import settle

# A usable bucket has more than one and fewer than ten members,
# and a usable address prefix has at least three characters.
BUCKET_LIMIT = 10
MIN_PREFIX = 3

# The rules a pair can satisfy, in the order they are tried.
EMAIL = "EMAIL"
COMP_EMAIL_PREFIX = "COMP_EMAIL_PREFIX"
SIMPLE_EMAIL_PREFIX = "SIMPLE_EMAIL_PREFIX"
PREFIX_LOGIN = "PREFIX_LOGIN"
PREFIX_NAME = "PREFIX_NAME"
LOGIN_NAME = "LOGIN_NAME"
FULL_NAME = "FULL_NAME"
SIMPLE_NAME = "SIMPLE_NAME"
EMAIL_DOMAIN = "EMAIL_DOMAIN"
PAIR_RULES = [
    COMP_EMAIL_PREFIX, SIMPLE_EMAIL_PREFIX, PREFIX_LOGIN, PREFIX_NAME, LOGIN_NAME, FULL_NAME, SIMPLE_NAME, EMAIL_DOMAIN,
]
RULES = [EMAIL, *PAIR_RULES]

# Key spaces.  Words (logins, names, simple prefixes) can meet across spaces,
# so they share one realm; composite prefixes and domains stand alone.
LOGIN, NAME, SIMPLE, COMPOSITE, DOMAIN = "login", "name", "simple_prefix", "composite_prefix", "domain"
SPACES = [LOGIN, NAME, SIMPLE, COMPOSITE, DOMAIN]
BOUNDED = [NAME, SIMPLE, COMPOSITE, DOMAIN]

# Characters of the uid that split a bucket of equal e-mail addresses for ranking.
RANK_PREFIX = 4


def identities(contributors: DataFrame) -> DataFrame:
    """One identity per uid: ``uid, login, name, is_real, email, prefix, domain``.

    ``contributors`` has ``contributor_id, name, email``; login and name are
    the same field.  The hosting platform's own identity is left out.  Of
    several records with one uid the greatest (name, email) counts.
    """
    records = (
        contributors.na.fill("", ["name", "email"])
        .filter(~is_platform(F.col("name"), F.col("email")))
        .groupBy(F.col("contributor_id").alias("uid"))
        .agg(F.max(F.struct("name", "email")).alias("r"))
    )
    cleaned = records.select(
        "uid",
        stripped(F.col("r.name")).alias("login"),
        stripped(F.col("r.name")).alias("name"),
        (~is_fake_login(F.col("r.name"))).alias("is_real"),
        clean_email(F.col("r.email")).alias("email"),
    )
    return cleaned.select(
        "*", email_prefix(F.col("email")).alias("prefix"), email_domain(F.col("email")).alias("domain")
    )


def identity_keys(people: DataFrame) -> DataFrame:
    """Inverted index in long form: ``realm, key, space, uid, email``, each row once."""

    def entries(realm: str, space: str, keys: Column) -> Column:
        return F.transform(
            keys, lambda k: F.struct(F.lit(realm).alias("realm"), k.alias("key"), F.lit(space).alias("space"))
        )

    composite = is_composite(F.col("prefix"))
    one = lambda column: F.array_compact(F.array(column))
    every = F.concat(
        entries("word", LOGIN, login_keys(F.col("login"), F.col("is_real"))),
        entries("word", NAME, name_keys(F.col("name"))),
        entries("word", SIMPLE, one(F.when(~composite, F.col("prefix")))),
        entries("composite", COMPOSITE, one(F.when(composite, F.col("prefix")))),
        entries("domain", DOMAIN, one(F.col("domain"))),
    )
    return people.select("uid", "email", F.explode(every).alias("e")).select("e.realm", "e.key", "e.space", "uid", "email")


def bucket_sizes(keys: DataFrame) -> DataFrame:
    """Identities per key and space: ``realm, key`` and one ``n_<space>`` column each."""
    return keys.groupBy("realm", "key").agg(*[F.count_if(F.col("space") == s).alias(f"n_{s}") for s in SPACES])


def _members(space: str) -> Column:
    return F.col(f"m_{space}")


def _clue(rule: Column | str, a: Column, b: Column) -> Column:
    rule = F.lit(rule) if isinstance(rule, str) else rule
    return F.struct(
        a["uid"].alias("a"), b["uid"].alias("b"), rule.alias("rule"),
        F.coalesce(a["email"] == b["email"], F.lit(False)).alias("same_email"),
    )


def _within(rule: Column | str, members: Column) -> Column:
    """Clues between all members of a bucket of at most nine, sorted by uid."""
    return F.flatten(
        F.transform(
            members,
            lambda a, at: F.transform(F.slice(members, at + 2, BUCKET_LIMIT), lambda b: _clue(rule, a, b)),
        )
    )


def _across(rule: str, lower: Column, upper: Column) -> Column:
    """Clues from one bucket to another, only where the first uid is the smaller."""
    product = F.flatten(F.transform(lower, lambda a: F.transform(upper, lambda b: _clue(rule, a, b))))
    return F.filter(product, lambda c: c["a"] < c["b"])


def clues(keys: DataFrame) -> DataFrame:
    """All clues but equal e-mail: ``a, b, rule, same_email`` with ``a`` < ``b``.

    A pair may have one rule more than once, through different keys.
    """
    keys = settle(keys)
    # Only the names of oversized buckets meet the rows, so what is in them is never brought together.
    bounded = keys.filter(F.col("space") != LOGIN)
    oversized = bounded.groupBy("realm", "key", "space").count().filter(F.col("count") >= BUCKET_LIMIT)
    person = F.struct("uid", "email")
    buckets = (
        bounded.join(oversized, ["realm", "key", "space"], "left_anti")
        .groupBy("realm", "key")
        .agg(
            *[
                F.sort_array(F.collect_list(F.when(F.col("space") == s, person))).alias(f"m_{s}")
                for s in BOUNDED
            ],
        )
    )
    long_enough = F.length("key") >= MIN_PREFIX
    nothing = F.array().cast("array<struct<a:string,b:string,rule:string,same_email:boolean>>")
    name_rule = F.when(F.contains("key", F.lit(" ")), FULL_NAME).otherwise(SIMPLE_NAME)
    bounded_clues = buckets.select(
        F.explode(
            F.concat(
                F.when(long_enough, _within(COMP_EMAIL_PREFIX, _members(COMPOSITE))).otherwise(nothing),
                F.when(long_enough, _within(SIMPLE_EMAIL_PREFIX, _members(SIMPLE))).otherwise(nothing),
                _across(PREFIX_NAME, _members(NAME), _members(SIMPLE)),
                _within(name_rule, _members(NAME)),
                _within(EMAIL_DOMAIN, _members(DOMAIN)),
            )
        ).alias("c")
    )
    # Logins are not limited: each row meets the at most nine names and nine
    # prefixes of its key, and the bucket itself is never gathered.
    login = F.array(F.struct("uid", "email"))
    partners = buckets.filter((F.col("realm") == "word")).select("key", f"m_{NAME}", f"m_{SIMPLE}")
    login_clues = (
        keys.filter((F.col("space") == LOGIN) & (F.col("key") != ""))
        .join(partners, "key")
        .select(
            F.explode(
                F.concat(
                    _across(PREFIX_LOGIN, login, _members(SIMPLE)),
                    _across(LOGIN_NAME, _members(NAME), login),
                )
            ).alias("c")
        )
    )
    return bounded_clues.unionByName(login_clues).select("c.*")


def pair_clues(found: DataFrame) -> DataFrame:
    """One row per pair without a common address: how often each rule fired.

    A simple-prefix clue silences the three cross-space rules of its pair.
    """
    counted = (
        found.filter(~F.col("same_email"))
        .groupBy("a", "b")
        .agg(*[F.count_if(F.col("rule") == r).alias(r) for r in PAIR_RULES])
    )
    silent = F.col(SIMPLE_EMAIL_PREFIX) > 0
    for rule in (PREFIX_LOGIN, PREFIX_NAME, LOGIN_NAME):
        counted = counted.withColumn(rule, F.when(silent, F.lit(0).cast("bigint")).otherwise(F.col(rule)))
    return counted


def decided_pairs(pairs: DataFrame) -> DataFrame:
    """Pairs that hold: with two clues or more all apply, alone only a full name or composite prefix does."""
    total = sum((F.col(r) for r in PAIR_RULES[1:]), F.col(PAIR_RULES[0]))
    return pairs.filter((total >= 2) | (F.col(FULL_NAME) > 0) | (F.col(COMP_EMAIL_PREFIX) > 0))


def email_buckets(people: DataFrame) -> DataFrame:
    """``email, first_uid, members`` of each address used by more than one identity."""
    return (
        people.filter(F.col("email").isNotNull())
        .groupBy("email")
        .agg(F.min("uid").alias("first_uid"), F.count("*").alias("members"))
        .filter("members > 1")
    )


def email_edges(people: DataFrame, buckets: DataFrame) -> DataFrame:
    """Equal-address pairs that matter for clustering: each identity with its bucket's first.

    Clustering uses only the smallest neighbour below and above an identity.
    Below, that is the bucket's first uid for all others; above, it is asked
    of the first only, and is the second.  So n - 1 pairs stand for n(n-1)/2.
    """
    return (
        people.filter(F.col("email").isNotNull())
        .join(buckets, "email")
        .filter(F.col("uid") != F.col("first_uid"))
        .select(F.col("first_uid").alias("a"), F.col("uid").alias("b"))
    )


def email_credits(people: DataFrame, buckets: DataFrame) -> DataFrame:
    """``uid, EMAIL``: equal-address pairs in which the identity is the smaller one.

    That is the number of greater uids in the bucket, found without listing
    pairs: a bucket is split by the first characters of the uid, the sizes of
    the greater splits are added up, and only inside a split are rows ranked.
    """
    split = people.join(buckets.select("email"), "email").select(
        "email", F.left("uid", F.lit(RANK_PREFIX)).alias("part"), "uid"
    )
    greater_parts = Window.partitionBy("email").orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, -1)
    beyond = (
        split.groupBy("email", "part")
        .agg(F.count("*").alias("n"))
        .select("email", "part", F.coalesce(F.sum("n").over(greater_parts), F.lit(0)).alias("beyond"))
    )
    in_part = Window.partitionBy("email", "part").orderBy(F.desc("uid"))
    return (
        split.withColumn("above", F.row_number().over(in_part) - 1)
        .join(beyond, ["email", "part"])
        .select("uid", (F.col("above") + F.col("beyond")).alias(EMAIL))
        .filter(F.col(EMAIL) > 0)
    )


def first_touch_clusters(edges: DataFrame) -> DataFrame:
    """``uid, cluster`` for edges ``a`` < ``b`` taken in sorted order.

    A pair with one clustered end pulls in the other, two clustered ends stay
    where they are, two free ends found a cluster named after ``a``.  This is
    not the same as connected components.  It equals following, from each uid,
    a pointer to its smallest neighbour below; or else to its smallest
    neighbour above, if that one has a neighbour below the uid; or else the
    uid is a root.  Pointers are doubled until they all end at a root, which
    takes a number of rounds logarithmic in the longest chain.
    """
    absent = F.lit(None).cast("string")
    ends = edges.select(F.col("a").alias("uid"), absent.alias("lo"), F.col("b").alias("hi")).unionByName(
        edges.select(F.col("b").alias("uid"), F.col("a").alias("lo"), absent.alias("hi"))
    )
    near = settle(ends.groupBy("uid").agg(F.min("lo").alias("lo"), F.min("hi").alias("hi")))
    above = near.select(F.col("uid").alias("hi"), F.col("lo").alias("lo_of_hi"))
    starts = near.filter("lo is null").join(above, "hi", "left")
    pointers = near.filter("lo is not null").select("uid", F.col("lo").alias("cluster")).unionByName(
        starts.select("uid", F.when(F.col("lo_of_hi") < F.col("uid"), F.col("hi")).otherwise(F.col("uid")).alias("cluster"))
    )
    pointers = settle(pointers)
    while True:
        onward = pointers.select(F.col("uid").alias("cluster"), F.col("cluster").alias("next"))
        moved = settle(
            pointers.join(onward, "cluster").select(
                "uid", F.col("next").alias("cluster"), (F.col("next") != F.col("cluster")).alias("moved")
            )
        )
        pointers = moved.select("uid", "cluster")
        if moved.filter("moved").isEmpty():
            return pointers


def rule_counts(clusters: DataFrame, pairs: DataFrame, credits: DataFrame) -> DataFrame:
    """How often each rule fired per cluster; a pair counts for the cluster of its smaller uid."""
    none = F.lit(0).cast("bigint")
    fired = pairs.select(F.col("a").alias("uid"), none.alias(EMAIL), *PAIR_RULES).unionByName(
        credits.select("uid", EMAIL, *[none.alias(r) for r in PAIR_RULES])
    )
    per_uid = fired.groupBy("uid").agg(*[F.sum(r).alias(r) for r in RULES])
    return per_uid.join(clusters, "uid").groupBy("cluster").agg(*[F.sum(r).alias(r) for r in RULES])


def cluster_emails(clusters: DataFrame, people: DataFrame) -> DataFrame:
    """``cluster, email`` with member counts and smallest uid; no address is one value of its own."""
    return (
        clusters.join(people.select("uid", "is_real", "email"), "uid")
        .groupBy("cluster", "email")
        .agg(F.count("*").alias("members"), F.count_if("is_real").alias("real_members"), F.min("uid").alias("first_uid"))
    )


def cluster_facts(emails: DataFrame) -> DataFrame:
    """Members, real members, distinct addresses of the real ones, and representative, per cluster."""
    return emails.groupBy("cluster").agg(
        F.sum("members").alias("members"),
        F.sum("real_members").alias("real_members"),
        F.count_if(F.col("real_members") > 0).alias("real_emails"),
        F.min("first_uid").alias("rep"),
    )


def _is_valid() -> Column:
    """Whether a cluster's members are surely one person."""
    others = F.col("members") - 1
    few_real = F.col("real_members") <= 1
    kinds = sum(((F.col(r) > 0).cast("int") for r in RULES[1:]), (F.col(RULES[0]) > 0).cast("int"))
    least = F.least(*[F.when(F.col(r) > 0, F.col(r)) for r in RULES])
    full, comp = F.col(FULL_NAME), F.col(COMP_EMAIL_PREFIX)
    return (
        (F.col(EMAIL) >= others)
        | (F.col("real_emails") == 1)
        | (few_real & (kinds > 1) & (least >= others))
        | (few_real & (kinds == 1) & ((comp > 0) | (full > 0)))
        | ((full >= others) & (F.col(EMAIL_DOMAIN) >= others))
        | ((F.col("real_members") == 0) & ((comp >= others) | (full >= others)))
    )


def alias_groups(facts: DataFrame, counts: DataFrame) -> DataFrame:
    """One row per cluster: facts, one count per rule, and whether it is certain."""
    return facts.join(counts, "cluster").withColumn("valid", F.coalesce(_is_valid(), F.lit(False)))


def shared_email_groups(groups: DataFrame, emails: DataFrame) -> DataFrame:
    """Inside uncertain clusters with an equal-address clue: members sharing one address, with their own first."""
    uncertain = groups.filter(~F.col("valid") & (F.col(EMAIL) > 0)).select("cluster")
    return (
        emails.filter("members > 1")
        .join(uncertain, "cluster")
        .select("cluster", "email", "members", F.col("first_uid").alias("rep"))
    )


def alias_map(people: DataFrame, clusters: DataFrame, groups: DataFrame) -> DataFrame:
    """``uid, rep`` for every identity: the first of its cluster, certain or not, or itself."""
    reps = clusters.join(groups.select("cluster", "rep"), "cluster").select("uid", "rep")
    return people.select("uid").join(reps, "uid", "left").select("uid", F.coalesce("rep", "uid").alias("rep"))


def alias_members(people: DataFrame, clusters: DataFrame, groups: DataFrame) -> DataFrame:
    """Audit rows: each clustered identity with its name, address and the certainty of its cluster."""
    return (
        clusters.join(groups.select("cluster", "rep", "valid"), "cluster")
        .join(people.select("uid", "name", "email"), "uid")
        .select("cluster", "valid", "rep", "uid", "name", "email")
    )


class AliasResolution:
    """The whole chain over one contributors table, each part a DataFrame.

    The identities and decided pairs are settled, since several later steps
    read them.
    """

    def __init__(self, contributors: DataFrame):
        self.people = settle(identities(contributors))
        self.pairs = settle(decided_pairs(pair_clues(clues(identity_keys(self.people)))))
        buckets = email_buckets(self.people)
        edges = self.pairs.select("a", "b").unionByName(email_edges(self.people, buckets))
        self.clusters = first_touch_clusters(edges)
        self.emails = cluster_emails(self.clusters, self.people)
        counts = rule_counts(self.clusters, self.pairs, email_credits(self.people, buckets))
        self.groups = alias_groups(cluster_facts(self.emails), counts)

    def map(self) -> DataFrame:
        return alias_map(self.people, self.clusters, self.groups)

    def members(self) -> DataFrame:
        return alias_members(self.people, self.clusters, self.groups)

    def shared_emails(self) -> DataFrame:
        return shared_email_groups(self.groups, self.emails)


def unmask_aliases(contributors: DataFrame) -> DataFrame:
    """``uid, rep`` for every contributor identity."""
    return AliasResolution(contributors).map()
