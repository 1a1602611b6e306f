"""Equality that ignores case and accents, as the unique text keys need it."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F

CI_AI = "UNICODE_CI_AI"


def ci(col: Column | str) -> Column:
    """The column under the case- and accent-insensitive collation."""
    return F.collate(F.col(col) if isinstance(col, str) else col, CI_AI)


def plain(col: Column | str) -> Column:
    """Back to an ordinary binary string, for results."""
    return (F.col(col) if isinstance(col, str) else col).cast("string")


def match_columns(
    df: DataFrame, columns: Iterable[str], text: Iterable[str] = (), prefix: str = "_k"
) -> list[Column]:
    """Comparison columns `_k0, _k1, ...` for a key, collated where `text` says so."""
    text = set(text)
    return [
        (ci(df[c]) if c in text else df[c]).alias(f"{prefix}{i}")
        for i, c in enumerate(columns)
    ]


def match_names(columns: Iterable[str], prefix: str = "_k") -> list[str]:
    return [f"{prefix}{i}" for i, _ in enumerate(columns)]


def match_spellings(
    requests: DataFrame, column: str, table: DataFrame, table_column: str, carry: Iterable[Column]
) -> DataFrame:
    """Each distinct spelling in the requests (`_spelling`) with the rows it equals.

    Comparing under a collation costs far more per row than comparing bytes, so it is
    done once per spelling; the requests are then joined on the spelling itself.
    """
    asked = requests.select(plain(column).alias("_spelling")).where("_spelling IS NOT NULL").distinct()
    known = table.select(ci(table_column).alias("_class"), *carry)
    return asked.join(known, ci("_spelling") == F.col("_class")).drop("_class")
