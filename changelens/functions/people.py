"""Expressions over names, logins and e-mail addresses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from changelens.functions.text import stripped

# The hosting platform's own identity and addresses that identify nobody.
PLATFORM_NAME = "github"
PLATFORM_EMAIL = "noreply@github.com"
VOID_SUFFIX = ".(none)"
VOID_DOMAINS = ("@server.fake", "@server.com", "@example.com", "@email.com")

_LABEL = "[a-z0-9](?:[a-z0-9-]*[a-z0-9])?"
# One address character, "@", a dotted host: enough to tell that a text holds an address.
_HOLDS_ADDRESS = rf"[a-z0-9!#$%&'*+/=?^_`{{|}}~-]@(?:{_LABEL}\.)+[a-z0-9]"


def contributor_id(name: Column, email: Column) -> Column:
    """md5 over lower-case name and address, with nothing between them."""
    return F.md5(F.concat(F.lower(name), F.lower(email)))


def is_platform(name: Column, email: Column) -> Column:
    return F.coalesce((name == PLATFORM_NAME) & (email == PLATFORM_EMAIL), F.lit(False))


def clean_email(email: Column) -> Column:
    """Lower-case address, or null where it is blank or says nothing about its owner."""
    low = F.lower(stripped(email))
    void = low.isin("", "none") | (F.endswith(low, F.lit(VOID_SUFFIX)) & ~F.rlike(low, F.lit(_HOLDS_ADDRESS)))
    for domain in VOID_DOMAINS:
        void = void | F.endswith(low, F.lit(domain))
    return F.when(~void, low)


def email_prefix(email: Column) -> Column:
    """What precedes the first ``@``; null when blank or when there is no ``@``."""
    return F.when(F.contains(email, F.lit("@")), F.nullif(F.substring_index(email, "@", 1), F.lit("")))


def email_domain(email: Column) -> Column:
    """What follows the last ``@``; null when blank or when there is no ``@``."""
    return F.when(F.contains(email, F.lit("@")), F.nullif(F.substring_index(email, "@", -1), F.lit("")))


def is_fake_login(raw_login: Column) -> Column:
    """Exactly eight capitals: a placeholder made by an anonymiser."""
    return F.rlike(raw_login, F.lit(r"\A[A-Z]{8}\n?\z"))


def is_composite(prefix: Column) -> Column:
    return F.contains(prefix, F.lit(".")) | F.contains(prefix, F.lit("_"))


def login_keys(login: Column, is_real: Column) -> Column:
    """The login as it stands and, for real people, in lower case."""
    return F.array_distinct(F.when(is_real, F.array(login, F.lower(login))).otherwise(F.array(login)))


def name_keys(name: Column) -> Column:
    """The name as it stands and, when it is a single word, in lower case; none for a blank name."""
    return (
        F.when(name == "", F.array().cast("array<string>"))
        .when(F.contains(name, F.lit(" ")), F.array(name))
        .otherwise(F.array_distinct(F.array(name, F.lower(name))))
    )
