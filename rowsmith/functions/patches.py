"""Parsing of partial-update bodies: which keys are present, and with which values.

An absent key leaves a column alone; a key with null sets it to null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

SET, NEW = "set_", "new_"


def _typed(doc: Column, inner: Column, field: T.StructField, at: str) -> tuple[Column, Column]:
    """Value of one key and whether its JSON type is acceptable for the column."""
    if isinstance(field.dataType, T.StringType):
        return F.try_variant_get(doc, at, "string"), F.to_json(inner).startswith('"')
    if isinstance(field.dataType, T.IntegralType):
        # JSON integers, whole decimals, booleans and integer text all count as integers.
        whole = F.try_variant_get(doc, at, "bigint")
        return whole, F.try_variant_get(doc, at, "double") == whole.cast("double")
    if isinstance(field.dataType, T.FractionalType):
        number = F.try_variant_get(doc, at, "double")
        return number, number.isNotNull()
    raise TypeError(f"no patch form for {field.dataType.simpleString()}")


def parse_patch(df: DataFrame, json_col: str, schema: T.StructType) -> DataFrame:
    """Add `set_<c>` and `new_<c>` per column of `schema`, `body_ok` and `is_json`.

    `is_json` is false when the body is not JSON at all, `body_ok` is false when it is
    not an object or a known key has a value of the wrong type. Unknown keys are
    ignored. Of a repeated key the last value counts, with the setting that `tune` makes.
    """
    doc = F.col("_doc")
    parsed = df.withColumn("_doc", F.try_parse_json(json_col))
    picks, good = [], [F.col(json_col).rlike(r"^\s*\{")]
    for field in schema.fields:
        at = f"$.{field.name}"
        inner = F.variant_get(doc, at, "variant")
        value, fits = _typed(doc, inner, field, at)
        picks.append(inner.isNotNull().alias(SET + field.name))
        picks.append(value.alias(NEW + field.name))
        good.append(inner.isNull() | F.is_variant_null(inner) | F.coalesce(fits, F.lit(False)))
    ok = good[0]
    for g in good[1:]:
        ok = ok & g
    return parsed.select(
        *[df[c] for c in df.columns],
        doc.isNotNull().alias("is_json"),
        F.coalesce(doc.isNotNull() & ok, F.lit(False)).alias("body_ok"),
        *picks,
    )


def nothing_set(columns: list[str]) -> Column:
    """True when the body sets none of the columns."""
    empty = F.lit(True)
    for c in columns:
        empty = empty & ~F.col(SET + c)
    return empty
