"""Contracts at the edges: key types, absent columns, long text, repeated keys, own values."""

import pytest
from data import NOW, app_tables, codes, listed
from pyspark.sql import functions as F
from rowsmith.operators.skew import join_facts
from rowsmith.operators.ocr import translate_distinct
from rowsmith.plans.application import create, patch, remove_category, remove_with_children, renumber_keys
from rowsmith.schemas import TABLES
from test_changes import check_patch


@pytest.mark.parametrize("requests_kind, table_kind", [("bigint", "int"), ("int", "bigint"), ("smallint", "int")])
def test_keys_of_different_integer_types(spark, requests_kind, table_kind):
    def widened(df):
        return df.select(*[F.col(f.name).cast(table_kind) if f.dataType.simpleString() == "int" else f.name for f in df.schema.fields])

    tables = {n: widened(t) for n, t in app_tables(spark).items()}
    left = remove_with_children(tables, "member", spark.createDataFrame([(1,)], f"member_id {requests_kind}"))
    assert [len(listed(left[n])) for n in ("member", "review", "member_restrictions", "community")] == [2, 1, 1, 1]
    asked = spark.createDataFrame([(1, 1), (2, 3), (3, 9)], f"seq bigint, target_id {requests_kind}")
    assert codes(remove_category(tables, asked)) == {1: 409, 2: 200, 3: 404}
    moved, outcomes = renumber_keys(tables, "member", spark.createDataFrame([(1, 10)], f"old {requests_kind}, new {requests_kind}"))
    assert outcomes.first()["code"] == 200 and [r[6] for r in listed(moved["review"])] == [10, 10, 2]


def test_keys_of_other_types_are_refused(spark):
    with pytest.raises(TypeError):
        join_facts(spark.range(1), spark.createDataFrame([("1",)], "k string"), ["id"], ["k"])


def test_collated_keys_are_compared_not_hashed(spark):
    rows = spark.createDataFrame([("É",)], "a string").select(F.collate("a", "UNICODE_CI_AI").alias("a"))
    facts = spark.createDataFrame([("e", 1)], "b string, v int").select(F.collate("b", "UNICODE_CI_AI").alias("b"), "v")
    assert join_facts(rows, facts, ["a"], ["b"]).count() == 1


@pytest.mark.parametrize("name", sorted(TABLES))
def test_absent_columns_count_as_null(spark, name):
    spec = TABLES[name]
    needed = [c for c in spec.create if c in spec.required]
    values = {"int": 3, "string": "new"}
    columns = needed or ["member_id"]
    row = tuple(values[spec.schema[c].dataType.simpleString()] for c in columns)
    schema = ", ".join(f"{c} {spec.schema[c].dataType.simpleString()}" for c in columns)
    asked = spark.createDataFrame([(1, *row)], f"seq bigint, {schema}")
    assert codes(create(app_tables(spark), name, asked, NOW)) == {1: 200}
    if needed:
        # Without a required column the request is refused, whatever else it has.
        assert codes(create(app_tables(spark), name, asked.drop(needed[0]), NOW)) == {1: 422}


def test_long_text_in_bytes(spark):
    fits, over = "é" * 32_767, "é" * 32_768
    rows = [(1, "t", fits, 1), (2, "t", over, 1), (3, over, "c", 1)]
    asked = spark.createDataFrame(rows, "seq bigint, review_title string, review_content string, member_id int")
    assert codes(create(app_tables(spark), "review", asked, NOW)) == {1: 200, 2: 500, 3: 500}
    bodies = [(1, 1, f'{{"review_content": "{fits}"}}'), (2, 1, f'{{"review_content": "{over}"}}')]
    asked = spark.createDataFrame(bodies, "seq bigint, target_id int, body string")
    assert codes(patch(app_tables(spark), "review", asked)) == {1: 200, 2: 500}


def test_repeated_json_keys_keep_the_last(spark):
    check_patch(spark, "review", [(1, 1, '{"rating": 9, "rating": 2}'), (2, 2, '{"location": "a", "location": null}')])


def test_a_row_may_claim_its_own_value_again(spark):
    body = '{"item_label_en": "%s"}'
    check_patch(spark, "restriction_items", [(1, 1, body % "A"), (2, 2, body % "a"), (3, 1, body % "A")])
    # Also the value that it has held before the batch.
    check_patch(spark, "restriction_items", [(1, 2, body % "MILK"), (2, 1, body % "milk")])


def test_translations_lose_all_white_space_at_their_ends(spark):
    items = spark.createDataFrame([(1, "a"), (2, "b")], "id int, ko string")
    words = spark.createDataFrame([("a", "\n"), ("b", "　Soup \t of day\n\x1c")], "ko string, en string")
    assert [r["en"] for r in translate_distinct(items, words).orderBy("id").collect()] == ["", "Soup \t of day"]
