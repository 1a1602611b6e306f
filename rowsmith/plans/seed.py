"""Seed rows of the two label tables."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

from ..operators.upserts import resolve_label
from ..session import Stage, no_stage
from .application import put

# Fixed values: (Korean label, English label).
CATEGORIES = [
    ("알레르겐", "ALLERGEN"),
    ("식이제한", "DIET"),
]

# Fixed values: (Korean label, English label, English label of the category).
ITEMS = [
    ("우유(우유)", "ALG_MILK", "ALLERGEN"),
    ("달걀(계란)", "ALG_EGGS", "ALLERGEN"),
    ("대두(콩)", "ALG_SOY", "ALLERGEN"),
    ("땅콩(땅콩)", "ALG_PEANUTS", "ALLERGEN"),
    ("견과류(아몬드, 호두, 캐슈넛)", "ALG_TREE_NUTS", "ALLERGEN"),
    ("밀/글루텐(밀, 보리, 호밀)", "ALG_CEREALS_GLUTEN", "ALLERGEN"),
    ("생선(고등어, 갈치, 꽁치)", "ALG_FISH", "ALLERGEN"),
    ("갑각류(새우, 게, 랍스터)", "ALG_CRUSTACEANS", "ALLERGEN"),
    ("연체동물(오징어, 문어, 조개)", "ALG_MOLLUSCS", "ALLERGEN"),
    ("참깨(참깨)", "ALG_SESAME", "ALLERGEN"),
    ("겨자(머스터드)", "ALG_MUSTARD", "ALLERGEN"),
    ("셀러리(셀러리)", "ALG_CELERY", "ALLERGEN"),
    ("아황산염(와인, 건과일, 식초)", "ALG_SULPHITES", "ALLERGEN"),
    ("루핀(루핀콩)", "ALG_LUPIN", "ALLERGEN"),
    ("비건", "DIET_VEGAN", "DIET"),
    ("베지테리언", "DIET_VEGETARIAN", "DIET"),
    ("할랄", "DIET_HALAL", "DIET"),
]


def load_seed(
    spark: SparkSession, tables: Mapping[str, DataFrame], stage: Stage = no_stage
) -> dict[str, DataFrame]:
    """Tables with the seed rows in them. Loading again changes nothing.

    The second table builds on the first; `stage` may write each one before it is used.
    """
    categories = spark.createDataFrame(
        [(i, *c) for i, c in enumerate(CATEGORIES)],
        "seq bigint, category_label_ko string, category_label_en string",
    )
    items = spark.createDataFrame(
        [(i, *c) for i, c in enumerate(ITEMS)],
        "seq bigint, item_label_ko string, item_label_en string, category string",
    )
    out = dict(tables)
    out["restriction_category"] = stage(
        put(out, "restriction_category", categories, ["category_label_ko"]).table
    )
    items = resolve_label(
        items, out["restriction_category"], "category", "category_label_en", "category_id",
        "category_id",
    )
    out["restriction_items"] = stage(
        put(out, "restriction_items", items, ["item_label_ko", "category_id"]).table
    )
    return out
