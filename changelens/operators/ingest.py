"""Shaping of issue and comment payloads as delivered by a code-hosting API."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changelens.functions.text import one_line, stripped
from changelens.functions.times import issue_time

# Fields that are read from a payload: path and type.
_ISSUE = {
    "id": ("id", "bigint"), "number": ("number", "int"), "state": ("state", "string"), "created_at": ("created_at", "string"),
    "closed_at": ("closed_at", "string"), "created_by_login": ("user.login", "string"), "closed_by_login": ("closed_by.login", "string"),
    "assignee_login": ("assignee.login", "string"), "title": ("title", "string"), "num_comments": ("comments", "int"),
}
_COMMENT = {
    "id": ("id", "bigint"), "body": ("body", "string"), "created_at": ("created_at", "string"), "updated_at": ("updated_at", "string"),
    "user_login": ("user.login", "string"), "user_id": ("user.id", "bigint"),
}
ISSUE_PAYLOAD, COMMENT_PAYLOAD = "issue", "comment"
_KINDS = {ISSUE_PAYLOAD: _ISSUE, COMMENT_PAYLOAD: _COMMENT}
_TIMES = ("created_at", "closed_at", "updated_at")
CLOSED = "closed"


def read_payloads(payloads: DataFrame, kind: str, payload_col: str = "payload") -> DataFrame:
    """Every row of ``payloads`` with ``fields`` (those read from the object), ``object`` (all of it, a VARIANT with
    the fields that are not read too) and ``reason``, why it cannot be used (null if it can).

    The JSON text is parsed once, whatever is made of the rows then.  A payload is rejected if it is missing, is no
    JSON object, has no ``id``, or has a time that cannot be read.
    """
    # One-element arrays keep the optimizer from copying the parsing into every place that uses its result.
    parsed = payloads.select("*", F.explode(F.array(F.try_parse_json(payload_col))).alias("object"))
    fields = [F.try_variant_get("object", f"$.{path}", type_).alias(name) for name, (path, type_) in _KINDS[kind].items()]
    if kind == ISSUE_PAYLOAD:
        request = F.try_variant_get("object", "$.pull_request", "variant")
        fields.append(_label_names().alias("labels"))
        fields.append((request.isNotNull() & ~F.is_variant_null(request)).alias("is_pl"))
    read = parsed.select("*", F.explode(F.array(F.struct(*fields))).alias("fields"))
    given = [F.col(f"fields.{name}") for name in _TIMES if name in _KINDS[kind]]
    unread = [F.coalesce(text != "", F.lit(False)) & issue_time(text).isNull() for text in given]
    is_object = F.startswith(F.schema_of_variant("object"), F.lit("OBJECT"))
    reason = (
        F.when(F.col(payload_col).isNull(), "missing")
        .when(~F.coalesce(is_object, F.lit(False)), "malformed")
        .when(F.col("fields.id").isNull(), "no id")
        .when(F.array_contains(F.array(*unread), True), "unreadable time")
    )
    return read.withColumn("reason", reason)


def _label_names() -> Column:
    labels = F.try_variant_get("object", "$.labels", "array<variant>")
    return F.transform(labels, lambda label: F.try_variant_get(label, "$.name", "string"))


def rejected_payloads(payloads: DataFrame, kind: str, payload_col: str = "payload") -> DataFrame:
    """Rows that cannot be used, as they came, with the ``reason``; the readers below make an unreadable time null and lose the others."""
    return read_payloads(payloads, kind, payload_col).filter("reason IS NOT NULL").select(*payloads.columns, "reason")


def normalise_issues(payloads: DataFrame, payload_col: str = "payload") -> DataFrame:
    """Closed issues from ``slug`` and one JSON object per row.

    Missing people become null logins, labels a list, and the presence of a
    ``pull_request`` object a flag.
    """
    return issue_rows(read_payloads(payloads, ISSUE_PAYLOAD, payload_col))


def issue_rows(read: DataFrame) -> DataFrame:
    """Closed issues of what :func:`read_payloads` gives."""
    return read.filter(F.col("fields.state") == CLOSED).select(
        "slug",
        *[F.col(f"fields.{name}") for name in ("id", "number", "state")],
        *[issue_time(F.col(f"fields.{name}")).alias(name) for name in ("created_at", "closed_at")],
        *[F.col(f"fields.{name}") for name in ("created_by_login", "closed_by_login", "assignee_login")],
        one_line(F.col("fields.title")).alias("title"),
        *[F.col(f"fields.{name}") for name in ("num_comments", "labels", "is_pl")],
    )


def _comment_rows(payloads: DataFrame, payload_col: str) -> DataFrame:
    return read_payloads(payloads, COMMENT_PAYLOAD, payload_col).select(
        "slug",
        "issue_id",
        "issue_number",
        F.col("fields.id").alias("comment_id"),
        stripped(F.col("fields.body")).alias("body"),
        *[issue_time(F.col(f"fields.{name}")).alias(name) for name in ("created_at", "updated_at")],
        "fields.user_login",
        "fields.user_id",
    )


def normalise_comments(discussion: DataFrame, reviews: DataFrame, payload_col: str = "payload") -> DataFrame:
    """Discussion and review comments in one table.

    Both inputs have ``slug, issue_id, issue_number`` and one JSON object per
    row; for reviews the id and number are the pull request's.  Review
    comments without a user are dropped.
    """
    review_rows = _comment_rows(reviews, payload_col).filter(F.col("user_login").isNotNull())
    return _comment_rows(discussion, payload_col).unionByName(review_rows)


def comments_per_issue(comments: DataFrame) -> DataFrame:
    """``slug, issue_number, num_comments`` counted from the comments themselves."""
    return comments.groupBy("slug", "issue_number").agg(F.count("*").alias("num_comments"))
