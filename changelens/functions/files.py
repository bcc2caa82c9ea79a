"""Role of a file and of a changed line."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from changelens.functions import fixed_values as V

POPULAR_EXTENSION_SET = sorted({ext for exts in V.POPULAR_EXTENSIONS.values() for ext in exts})

_COMMENT_LINE = r"\A[ \t]*(?:#|\\\*|\*\*|//|/\*|\z)"


def _shared_heads(parts: Iterable[str]) -> str:
    """Pattern for any of the parts that branches character by character.

    At most positions of a path it fails on the first character, whereas a
    plain alternation tries every part.
    """
    tails: dict[str, list[str]] = {}
    for part in parts:
        tails.setdefault(part[0], []).append(part[1:])
    branches = []
    for head, rest in tails.items():
        longer = [tail for tail in rest if tail]
        branch = _shared_heads(longer) if longer else ""
        ends_here = len(longer) < len(rest)
        branches.append(re.escape(head) + (f"(?:{branch})?" if branch and ends_here else branch))
    return branches[0] if len(branches) == 1 else f"(?:{'|'.join(branches)})"


def _contains_any(text: Column, parts: list[str]) -> Column:
    """Whether any part occurs; one scan, and short generated code where labels meet in one plan."""
    first = "".join(sorted({re.escape(part[0]) for part in parts}))
    return F.rlike(text, F.lit(f"(?=[{first}]){_shared_heads(parts)}"))


def _last_name(inner: str) -> str:
    """Pattern for a whole base name, tried only where a path segment starts."""
    return rf"(?:\A|/)(?:{inner})\z"


def _with_extension(extensions: Iterable[str]) -> str:
    """Base names with one of the extensions.

    Something other than a dot has to precede the last dot.  An extension
    with a dot inside is never the last dotted part, so it cannot match.
    """
    last_parts = [ext[1:] for ext in extensions if "." not in ext[1:]]
    return rf"\.*[^./][^/]*\.{_shared_heads(last_parts)}"


_DOC_NAME = _last_name(rf"{_with_extension(V.DOC_EXTENSIONS)}|{_shared_heads(V.DOC_NAMES)}(?:\.[^./]*)?")


def file_label(path: Column, popular_extensions: list[str] | None = None) -> Column:
    """Role of a file, by the first rule that applies.

    Path rules look for a part of the path exactly as it is passed in, case
    and leading slash included.  Every rule names ``path`` once, so that a
    computed path stays cheap to plan.
    """
    popular = _last_name(_with_extension(popular_extensions or POPULAR_EXTENSION_SET))
    return (
        F.when(F.contains(path, F.lit("/.git/")), V.GIT_INTERNAL)
        .when(_contains_any(path, V.MEDIA_PATHS + V.DOC_PATHS), V.DOC)
        .when(F.rlike(path, F.lit(_DOC_NAME)), V.DOC)
        .when(_contains_any(path, V.TEST_PATHS), V.TEST)
        .when(_contains_any(path, V.SOURCE_PATHS), V.SRC)
        .when(F.rlike(path, F.lit(popular)), V.SRC)
        .otherwise(V.CFG_BUILD_OTHER)
    )


def is_doc(path: Column) -> Column:
    """Whether :func:`file_label` says DOC; the rules after that one are not tried."""
    named = _contains_any(path, V.MEDIA_PATHS + V.DOC_PATHS) | F.rlike(path, F.lit(_DOC_NAME))
    return F.coalesce(~F.contains(path, F.lit("/.git/")) & named, F.lit(False))


def is_test(path: Column) -> Column:
    """Whether :func:`file_label` says TEST; most paths fail the first rule tried here."""
    found = _contains_any(path, V.TEST_PATHS) & ~F.contains(path, F.lit("/.git/"))
    return F.coalesce(found, F.lit(False)) & ~is_doc(path)


def line_label(line: Column) -> Column:
    """COMMENT for blank lines and lines opening with a comment mark, else CODE."""
    return F.when(F.rlike(F.translate(line, "\r\n", ""), F.lit(_COMMENT_LINE)), V.COMMENT).otherwise(V.CODE)
