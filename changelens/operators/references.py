"""Cross-project references in commit messages and discussions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changelens.functions.mentions import reference_tokens, without_brackets

FROM_COMMIT, FROM_DISCUSSION = "commit", "issue/pr"


def references_in(texts: DataFrame, text_col: str, kind: str) -> DataFrame:
    """``(slug, ref, type)`` for each reference in ``text_col`` that leaves the row's own project.

    Own-project references are told by the untouched token; brackets are
    removed afterwards.
    """
    tokens = texts.select("slug", F.explode(reference_tokens(F.col(text_col))).alias("_token"))
    return tokens.filter(~F.contains("_token", "slug")).select(
        "slug", without_brackets(F.col("_token")).alias("ref"), F.lit(kind).alias("type")
    )


def cross_references(messages: DataFrame, comments: DataFrame) -> DataFrame:
    """References from ``messages.message`` and ``comments.body``; repeated ones are kept.

    Pass full commit messages, or the first-line messages of origin commits.
    """
    return references_in(messages, "message", FROM_COMMIT).unionByName(
        references_in(comments, "body", FROM_DISCUSSION)
    )
