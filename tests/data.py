"""Small application tables for the tests."""

from datetime import datetime

from rowsmith.schemas import TABLES

T0 = datetime(2024, 3, 1, 8, 0, 0)
NOW = datetime(2024, 5, 1, 12, 0, 0)
HASH = "$2b$12$abcdefghijklmnopqrstuv"

ROWS = {
    "member": [
        (1, "ann@x.com", HASH, "Ann", None, "KR", T0, T0),
        (2, "Bob@x.com", HASH, "Bob", "m", None, T0, T0),
        (3, "strasse@x.com", HASH, "Cé", None, None, T0, T0),
    ],
    "restriction_category": [(1, "알레르겐", "ALLERGEN"), (2, "식이제한", "DIET"), (3, "기타", "OTHER")],
    "restriction_items": [(1, "우유", "MILK", 1), (2, "비건", "VEGAN", 2), (3, "달걀", "EGGS", 1)],
    "member_restrictions": [(1, 1, 1), (2, 2, 1), (3, 1, 2)],
    "review": [
        (1, "t1", "c1", 5, "Seoul", T0, 1),
        (2, "t2", "c2", None, None, T0, 1),
        (3, "t3", "c3", 1, None, T0, 2),
    ],
    "community": [(1, "hello", 1), (2, None, 3)],
}


def app_tables(spark, rows=ROWS):
    return {n: spark.createDataFrame(rows[n], t.schema) for n, t in TABLES.items()}


def listed(df, *order):
    return [tuple(r) for r in df.orderBy(*(order or df.columns[:1])).collect()]


def codes(changes):
    return {r["seq"]: r["code"] for r in changes.outcomes.collect()}
