"""Issue mentions and cross-project references inside free text."""

from __future__ import annotations

import sys
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# The two ways a commit message names an issue.
HASH_MENTION = r"(?U)[^a-zA-Z0-9_#/]#(\d+)\b"
GH_MENTION = r"(?U)\bGH-(\d+)\b"

# Every decimal digit of Unicode beyond ASCII, and what it stands for.
_OTHER_DIGITS = [chr(c) for c in range(128, sys.maxunicode + 1) if unicodedata.category(chr(c)) == "Nd"]
_DIGITS = "".join(_OTHER_DIGITS), "".join(str(unicodedata.decimal(c)) for c in _OTHER_DIGITS)

# A white-space-free run up to its last "#digits" or "@digits".  The look-behind
# lets a match start only where a run starts, so a run is scanned once.
_NON_BLANK = r"[^\s\x1c-\x1f]"
_RUN_WITH_NUMBER = rf"(?U)(?<!{_NON_BLANK}){_NON_BLANK}+[#@]\d+"
# In such a run: some text, a slash, some text, then the number.
_HAS_SLASH_BEFORE_NUMBER = r"(?Us)\A.[^/]*/.+[#@]\d+\z"


def _ascii_digits(digits: Column) -> Column:
    """Decimal digits of any script as 0 to 9."""
    other = F.rlike(digits, F.lit("[^0-9]"))
    return F.when(other, F.translate(digits, *_DIGITS)).otherwise(digits)


def mentioned_issues(line: Column) -> Column:
    """Distinct issue numbers named in one line of a message, ascending.

    ``#n`` needs a preceding character, so it does not count at the start of a line.
    """
    def digits_after(mark: str, pattern: str) -> Column:
        found = F.regexp_extract_all(line, F.lit(pattern), F.lit(1))
        return F.when(F.contains(line, F.lit(mark)), found).otherwise(F.array().cast("array<string>"))

    digits = F.concat(digits_after("#", HASH_MENTION), digits_after("GH-", GH_MENTION))
    numbers = F.transform(digits, lambda d: _ascii_digits(d).try_cast("bigint"))
    return F.array_sort(F.array_distinct(F.array_compact(numbers)))


def reference_tokens(text: Column) -> Column:
    """Every ``owner/name#12`` or ``owner/name@12`` run of a text, in order.

    Same tokens as the greedy pattern ``\\S+/\\S+`` followed by ``#digits`` or
    ``@digits``: that pattern can only match from the start of a run to the
    run's last number.
    """
    runs = F.regexp_extract_all(text, F.lit(_RUN_WITH_NUMBER), F.lit(0))
    return F.filter(runs, lambda run: F.rlike(run, F.lit(_HAS_SLASH_BEFORE_NUMBER)))


def without_brackets(token: Column) -> Column:
    return F.translate(token, "()[]", "")
