"""Row rules: a name, the condition that breaks it, and the outcome code it carries."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, functions as F

INVALID = 422
DATA_ERROR = 500

# Fixed value: how a stored bcrypt hash starts.
BCRYPT_PREFIX = r"^\$2[abxy]\$"
# An approximation of the e-mail format check, not the full address grammar.
EMAIL_FORM = r"^[^@\s]+@[^@\s.]+(\.[^@\s.]+)+$"


@dataclass(frozen=True)
class Rule:
    name: str
    broken: Column
    code: int = INVALID


def required(column: str) -> Rule:
    return Rule(f"{column} is required", F.col(column).isNull())


def between(column: str, low: float, high: float) -> Rule:
    """Null passes."""
    return Rule(f"{column} must be {low}..{high}", ~F.col(column).between(low, high))


def max_length(column: str, n: int) -> Rule:
    """Length in characters; the store itself refuses longer text."""
    return Rule(f"{column} is longer than {n}", F.char_length(column) > n, DATA_ERROR)


def max_bytes(column: str, n: int) -> Rule:
    """Length in UTF-8 bytes, as unbounded text columns of the store limit it."""
    return Rule(f"{column} is longer than {n} bytes", F.octet_length(column) > n, DATA_ERROR)


def matches(column: str, pattern: str, name: str | None = None) -> Rule:
    return Rule(name or f"{column} has the wrong form", ~F.col(column).rlike(pattern))


def hashed_password(column: str = "password") -> Rule:
    return matches(column, BCRYPT_PREFIX, f"{column} is not a bcrypt hash")


def email_form(column: str = "email") -> Rule:
    return matches(column, EMAIL_FORM, f"{column} is not an e-mail address")


def first_broken(rules: Iterable[Rule]) -> Column:
    """Name of the first broken rule, null when the row passes all."""
    names = [F.when(r.broken, F.lit(r.name)) for r in rules]
    return F.coalesce(*names, F.lit(None).cast("string"))
