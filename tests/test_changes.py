import json
import random

import pytest
from data import NOW, ROWS, T0, app_tables, codes, listed
from pyspark.sql import functions as F, types as T
from rowsmith.operators import claims as claims_module
from rowsmith.operators.claims import settle_claims
from rowsmith.operators.deletes import Edge, cascade_delete, restrict_delete
from rowsmith.operators.ids import assign_ids
from rowsmith.operators.patching import fold_patches
from rowsmith.functions.patches import parse_patch
from rowsmith.plans.application import (
    create, delete, patch, put, remove_category, remove_with_children, renumber_keys,
)
from rowsmith.plans.seed import load_seed
from rowsmith.schemas import TABLES
from rowsmith.sources.tables import read_version, write_version
from serial import Store


def requests(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def create_schema(name):
    spec = TABLES[name]
    return "seq bigint, " + ", ".join(
        f"{c} {spec.schema[c].dataType.simpleString()}" for c in spec.create
    )


def check_create(spark, name, rows):
    store = Store(ROWS, NOW)
    fields = TABLES[name].create
    want = {}
    for r in sorted(rows):
        want[r[0]] = store.create(name, dict(zip(fields, r[1:])))
    got = create(app_tables(spark), name, requests(spark, rows, create_schema(name)), NOW)
    outcomes = {r["seq"]: (r["code"], r["id"]) for r in got.outcomes.collect()}
    assert outcomes == want
    assert listed(got.table) == store.listed(name)
    assert got.table.schema.fieldNames() == TABLES[name].schema.fieldNames()


def test_create_members(spark):
    long = "x" * 51
    rows = [
        (1, "ÀNN@X.COM", "p", "dup", None, None),
        (2, "new@x.com", "p", "one", None, None),
        (3, "NÈW@x.com", "p", "dup in batch", None, None),
        (4, None, "p", "no mail", None, None),
        (5, "long@x.com", "p", long, None, None),
        (6, "LONG@x.com", "p", "free, since 5 failed", "f", "KR"),
        (7, "straße@x.com", "p", "dup by sharp s", None, None),
        (8, "new@x.com ", "p", "trailing space differs", None, None),
        (9, "new2@x.com", "", "empty password", None, "KR"),
    ]
    check_create(spark, "member", rows)


def test_create_member_restrictions(spark):
    rows = [
        (10, 9, 9), (11, 9, 1), (12, 1, 9), (13, 3, 2), (14, 3, 2), (15, 1, 1), (16, None, 1),
        (9, 2, 3), (8, 2, 9),
    ]
    check_create(spark, "member_restrictions", rows)
    got = create(
        app_tables(spark), "member_restrictions",
        requests(spark, rows, create_schema("member_restrictions")), NOW,
    )
    details = {r["seq"]: r["detail"] for r in got.outcomes.collect()}
    assert details[10] == "Invalid member_id" and details[12] == "Invalid item_id"


def test_duplicate_whose_first_copy_fails(spark):
    rows = [(1, "k", "NEW", 9), (2, "k", "new", 1), (3, "k", "New", 1)]
    check_create(spark, "restriction_items", rows)


def test_create_reviews(spark):
    rows = [(n, "t", "c", r, loc, m) for n, (r, loc, m) in enumerate(
        [(0, None, 1), (1, "x" * 101, 1), (5, "x" * 100, 2), (6, None, 9), (None, None, 9), (None, None, 3)]
    )]
    check_create(spark, "review", rows)


def test_create_into_empty_table(spark):
    tables = app_tables(spark)
    tables["community"] = tables["community"].limit(0)
    got = create(tables, "community", requests(spark, [(5, "a", 1), (2, None, 2)], create_schema("community")), NOW)
    assert listed(got.table) == [(1, None, 2), (2, "a", 1)]


@pytest.mark.parametrize("seed", [1, 2])
def test_create_random(spark, seed):
    rnd = random.Random(seed)
    pairs = [(n, rnd.choice([1, 2, 3, 4, None]), rnd.choice([1, 2, 3, 4])) for n in rnd.sample(range(10**12), 40)]
    check_create(spark, "member_restrictions", pairs)
    names = ["ann@x.com", "ÁNN@x.com", "n1@x", "N1@X", "n2@x", None, "y" * 256, "z" * 255]
    members = [(n, rnd.choice(names), "p", "n", None, None) for n in range(40)]
    check_create(spark, "member", members)


def check_patch(spark, name, rows, exact=True):
    """rows: (seq, target, body[, sub])"""
    store, want = Store(ROWS, NOW), {}
    for r in sorted(rows):
        want[r[0]] = store.patch(name, r[1], r[2], *r[3:])
    schema = "seq bigint, target_id int, body string" + (", sub string" if TABLES[name].owned else "")
    got = patch(app_tables(spark), name, requests(spark, rows, schema), NOW)
    if exact:
        assert codes(got) == want
        assert listed(got.table) == store.listed(name)
    return got


def test_patch_reviews(spark):
    bodies = [
        (1, "{}"), (1, '{"rating": 6}'), (1, '{"rating": 0}'), (1, '{"rating": null}'),
        (1, '{"location": null, "review_title": "new"}'), (2, '{"review_title": null}'),
        (2, '{"member_id": 9}'), (2, '{"member_id": null}'), (2, '{"member_id": 3, "rating": 4}'),
        (9, '{"rating": 3}'), (9, '{"rating": 9}'), (2, "not json"), (2, "[1]"), (3, '{"review_title": 5}'),
        (3, '{"unknown": 1}'), (3, '{"review_content": "last"}'), (3, '{"review_content": "really last"}'),
        (3, json.dumps({"location": "x" * 101})), (3, json.dumps({"location": "한" * 100})),
    ]
    check_patch(spark, "review", [(n, *b) for n, b in enumerate(bodies)])


def test_patch_two_columns_of_one_row(spark):
    rows = [(2, 1, '{"location": "B"}'), (1, 1, '{"rating": 2, "location": "A"}')]
    got = check_patch(spark, "review", rows)
    assert listed(got.table)[0][3:5] == (2, "B")


def test_patch_items(spark):
    rows = [
        (1, 1, '{"category_id": 9, "item_label_en": "TAKEN"}'), (2, 2, '{"item_label_en": "taken"}'),
        (3, 1, '{"category_id": null}'), (4, 1, '{"item_label_en": "mílk"}'),
        (5, 3, '{"item_label_en": "Milk"}'), (6, 3, '{"item_label_ko": null}'),
        (7, 8, '{"item_label_en": "TAKEN2"}'), (8, 3, '{"item_label_en": "taken2"}'),
        (9, 1, '{"item_label_en": "TAKEN2"}'), (10, 2, '{"item_label_en": null}'),
    ]
    check_patch(spark, "restriction_items", rows)


def test_patch_members(spark):
    rows = [
        (1, 1, '{"country": null}', "1"), (2, 1, '{"nickname": null}', "1"), (3, 1, '{"nickname": "A"}', "2"),
        (4, 1, '{"nickname": "A"}', "x"), (5, 2, '{"nickname": "Bob"}', " 2 "), (6, 2, "{}", "2"),
        (7, 2, '{"email": "ANN@x.com"}', "2"), (8, 3, '{"email": "STRASSE@x.com"}', "+3"),
        (9, 3, '{"nickname": 5}', "7"), (10, 3, '{"nickname": 5}', "1"), (11, 3, "nope", "7"),
        (12, 1, '{"gender": "f"}', None), (13, 9, '{"gender": "f"}', "9"), (14, 9, '{"gender": "f"}', "1"),
    ]
    got = check_patch(spark, "member", rows)
    stamps = {r["member_id"]: r["modify_member"] for r in got.table.collect()}
    # Member 2 only set the value it had; the spelling of an e-mail is a change.
    assert stamps == {1: NOW, 2: T0, 3: NOW}


def test_value_changed_and_changed_back_counts_as_change(spark):
    rows = [(1, 2, '{"nickname": "X"}', "2"), (2, 2, '{"nickname": "Bob"}', "2")]
    check_patch(spark, "member", rows)


def test_values_given_up_in_the_batch_are_free_at_once(spark):
    rows = [(1, 1, '{"item_label_en": "FREED"}'), (2, 2, '{"item_label_en": "MILK"}')]
    assert codes(check_patch(spark, "restriction_items", rows)) == {1: 200, 2: 200}
    rows = [
        (1, 1, '{"item_label_en": "A"}'), (2, 2, '{"item_label_en": "A"}'),
        (3, 2, '{"item_label_en": "B"}'), (4, 1, '{"item_label_en": "B"}'),
        (5, 1, '{"item_label_en": "a"}'), (6, 1, '{"item_label_en": "c"}'), (7, 2, '{"item_label_en": "Á"}'),
    ]
    assert codes(check_patch(spark, "restriction_items", rows)) == {1: 200, 2: 409, 3: 200, 4: 409, 5: 200, 6: 200, 7: 200}


def serial_claims(table, claims):
    """Granted arrival numbers, one claim at a time."""
    value = {k: v.lower() for k, v in table if v is not None}
    holder = {v: k for k, v in value.items()}
    granted = []
    for seq, row, v in sorted(claims):
        if v is not None and holder.get(v.lower(), row) == row:
            holder.pop(value.get(row), None)
            holder[v.lower()], value[row] = row, v.lower()
            granted.append(seq)
    return granted


@pytest.mark.parametrize("seed", range(8))
def test_claims_as_one_at_a_time(spark, seed):
    rnd = random.Random(seed)
    rows, values = rnd.choice([(3, 3), (4, 7), (12, 12), (40, 9)])
    table = [(n, f"v{n}") for n in range(rows)]
    claims = [(s, rnd.randrange(rows), rnd.choice("vV") + str(rnd.randrange(values + 2))) for s in rnd.sample(range(-10**6, 10**9), 150)]
    if seed % 2:
        claims = [(s, r, v if rnd.random() < 0.6 else "hot") for s, r, v in claims] + [(5 * 10**9, 1, None)]
    held = spark.createDataFrame(table, "id int, name string")
    asked = spark.createDataFrame(claims, "seq bigint, target_id bigint, name string")
    got = settle_claims(asked, held, "name", "id")
    assert sorted(r["seq"] for r in got.collect()) == serial_claims(table, claims)


def test_a_chain_as_long_as_the_batch(spark):
    """Each row takes the value that the one before has just left."""
    table = [(n, f"v{n}") for n in range(7)]
    claims = [(0, 0, "new")] + [(n, n, f"v{n - 1}") for n in range(1, 7)] + [(9, 0, "v6"), (10, 3, "V6")]
    held = spark.createDataFrame(table, "id int, name string")
    got = settle_claims(spark.createDataFrame(claims, "seq bigint, target_id int, name string"), held, "name", "id")
    assert sorted(r["seq"] for r in got.collect()) == serial_claims(table, claims) == [*range(7), 9]
    none = spark.createDataFrame([], "seq bigint, target_id int, name string")
    assert settle_claims(none, held, "name", "id").count() == 0


def test_values_that_nobody_leaves_take_no_round(spark, monkeypatch):
    monkeypatch.setattr(claims_module, "_pass", None)
    held = spark.createDataFrame([(n, f"v{n}") for n in range(500)], "id int, name string")
    hot = spark.range(20_000).selectExpr("id AS seq", "cast(id % 499 AS int) AS target_id", "'Wanted' AS name")
    assert sorted(r["seq"] for r in settle_claims(hot, held, "name", "id").collect()) == list(range(0, 20_000, 499))


@pytest.mark.parametrize("seed", [3, 4])
def test_patch_random_unique(spark, seed):
    rnd = random.Random(seed)
    labels = ["MILK", "milk", "EGG", "Égg", "A", "a", "B", "C", None, "x" * 101]
    rows = []
    for n in rnd.sample(range(10**9), 60):
        body = {"item_label_en": rnd.choice(labels)} if rnd.random() < 0.9 else {"item_label_ko": "k"}
        rows.append((n, rnd.choice([1, 2, 3, 4]), json.dumps(body)))
    check_patch(spark, "restriction_items", rows)


@pytest.mark.parametrize("seed", [1, 2])
def test_patch_random(spark, seed):
    rnd = random.Random(seed)
    rows = []
    for n in rnd.sample(range(10**9), 60):
        body = {}
        for c, values in {
            "review_title": ["a", "b", None], "rating": [1, 5, 6, None], "location": ["S", None, "x" * 101],
            "member_id": [1, 2, 3, 9, None],
        }.items():
            if rnd.random() < 0.35:
                body[c] = rnd.choice(values)
        rows.append((n, rnd.choice([1, 2, 3, 4]), json.dumps(body)))
    check_patch(spark, "review", rows)


def test_patch_refused_for_tables_without_patch(spark):
    with pytest.raises(ValueError):
        patch(app_tables(spark), "community", None)
    with pytest.raises(ValueError):
        delete(app_tables(spark), "member", None)


def test_parse_patch(spark):
    bodies = [
        (1, '{"rating": 3.0}'), (2, '{"rating": 3.5}'), (3, '{"rating": "4"}'), (4, '{"rating": true}'),
        (5, '{"rating": [1]}'), (6, '{"location": {"a": 1}}'), (7, '{"location": "\\"q"}'), (8, ""), (9, None),
        (10, ' {"location": null}'), (11, "null"), (12, '"{"'),
    ]
    df = spark.createDataFrame(bodies, "seq int, body string")
    schema = T.StructType([TABLES["review"].schema[c] for c in ("rating", "location")])
    out = parse_patch(df, "body", schema)
    got = {r["seq"]: r for r in out.collect()}
    assert [n for n, r in got.items() if r["body_ok"]] == [1, 3, 4, 7, 10]
    assert [n for n, r in got.items() if r["is_json"]] == [1, 2, 3, 4, 5, 6, 7, 10, 11, 12]
    assert (got[1]["new_rating"], got[3]["new_rating"], got[4]["new_rating"]) == (3, 4, 1)
    assert got[10]["set_location"] and got[10]["new_location"] is None
    assert not got[10]["set_rating"]


def test_fold_keeps_null_apart_from_not_set(spark):
    df = spark.createDataFrame(
        [(1, 7, True, "a", False, None), (2, 7, True, None, False, None)],
        "seq int, target_id int, set_a boolean, new_a string, set_b boolean, new_b string",
    )
    row = fold_patches(df, ["a", "b"]).first()
    assert row["_last_a"] is not None and row["_last_a"]["v"] is None and row["_last_b"] is None


@pytest.mark.parametrize("bits", [1, 3, 20])
def test_assign_ids(spark, bits):
    rnd = random.Random(bits)
    seqs = rnd.sample(range(-(10**6), 10**6), 500) + [2**62, 2**62 + 1, -(2**62), 10**14]
    df = spark.createDataFrame([(s,) for s in seqs], "seq bigint")
    got = assign_ids(df, 5, bucket_bits=bits).orderBy("id").collect()
    assert [(r["seq"], r["id"]) for r in got] == [(s, 5 + n) for n, s in enumerate(sorted(seqs))]


def test_delete(spark):
    rows = [(5, 1), (4, 1), (6, 9), (7, 3)]
    store = Store(ROWS, NOW)
    want = {n: store.delete("review", k) for n, k in sorted(rows)}
    got = delete(app_tables(spark), "review", requests(spark, rows, "seq bigint, target_id int"))
    assert codes(got) == want == {4: 200, 5: 404, 6: 404, 7: 200}
    assert listed(got.table) == store.listed("review")


def test_seed_twice(spark, tmp_path):
    steps = iter(range(9))

    def written(df):
        path = str(tmp_path / "tables")
        n = next(steps)
        write_version(df, path, n)
        return read_version(spark, path, n, df.schema)

    empty = {n: spark.createDataFrame([], t.schema) for n, t in TABLES.items()}
    once = load_seed(spark, empty, written)
    assert listed(once["restriction_category"]) == [(1, "알레르겐", "ALLERGEN"), (2, "식이제한", "DIET")]
    items = listed(once["restriction_items"])
    assert len(items) == 17 and items[0][1:] == ("우유(우유)", "ALG_MILK", 1)
    assert items[16] == (17, "할랄", "DIET_HALAL", 2)
    twice = load_seed(spark, once, written)
    assert listed(twice["restriction_items"]) == items


def test_upsert(spark):
    src = requests(
        spark,
        [(1, "a", "mílk", 2), (2, "b", "NEW", 1), (3, "c", "new", 3), (4, "d", "lost", None), (5, "e", "Vegan", 2)],
        "seq bigint, item_label_ko string, item_label_en string, category_id int",
    )
    got = put(app_tables(spark), "restriction_items", src, ["item_label_ko"])
    assert listed(got.table) == [(1, "a", "MILK", 1), (2, "e", "VEGAN", 2), (3, "달걀", "EGGS", 1), (4, "c", "NEW", 1)]
    assert listed(got.outcomes) == [
        (1, 200, "updated", 1), (2, 200, "inserted", 4), (3, 200, "updated", 4),
        (4, 409, "category_id must not be null", None), (5, 200, "updated", 2),
    ]


def test_cascade(spark):
    left = remove_with_children(app_tables(spark), "member", spark.createDataFrame([(1,)], "member_id int"))
    assert [r[0] for r in listed(left["member"])] == [2, 3]
    assert [r[0] for r in listed(left["review"])] == [3]
    assert [r[0] for r in listed(left["community"])] == [2]
    assert [r[0] for r in listed(left["member_restrictions"])] == [3]
    left = remove_with_children(app_tables(spark), "restriction_items", spark.createDataFrame([(1,)], "item_id int"))
    assert [r[0] for r in listed(left["member_restrictions"])] == [2]
    assert len(listed(left["review"])) == 3


def test_cascade_over_two_paths_of_different_length(spark):
    def df(rows, cols):
        return spark.createDataFrame(rows, cols)

    tables = {
        "r": df([(1,), (2,)], "r int"), "a": df([(1, 1), (2, 2)], "a int, r int"),
        "c": df([(1, 2, 1), (2, 1, 2), (3, 2, 2)], "c int, r int, a int"),
        "e": df([(1, 1), (2, 2), (3, 3)], "e int, c int"),
    }
    edges = [Edge("c", "r", "r", "r"), Edge("e", "c", "c", "c"), Edge("a", "r", "r", "r"), Edge("c", "a", "a", "a")]
    left = cascade_delete(tables, "r", df([(1,)], "r int"), edges, "r")
    assert listed(left["c"]) == [(3, 2, 2)] and listed(left["e"]) == [(3, 3)]


def test_restrict(spark):
    asked = requests(spark, [(1, 1), (2, 3), (3, 3), (4, 9)], "seq bigint, target_id int")
    got = remove_category(app_tables(spark), asked)
    assert codes(got) == {1: 409, 2: 200, 3: 404, 4: 404}
    assert [r[0] for r in listed(got.table)] == [1, 2]


def test_renumber(spark):
    mapping = spark.createDataFrame(
        [(1, 10), (2, 3), (3, 11), (7, 12)], "old int, new int"
    )
    tables, outcomes = renumber_keys(app_tables(spark), "member", mapping)
    assert {r["old"]: r["code"] for r in outcomes.collect()} == {1: 200, 2: 409, 3: 200, 7: 404}
    assert [r[0] for r in listed(tables["member"])] == [2, 10, 11]
    assert [r[6] for r in listed(tables["review"])] == [10, 10, 2]
    assert [r[2] for r in listed(tables["community"])] == [10, 11]
    clash = spark.createDataFrame([(1, 10), (2, 10)], "old int, new int")
    assert {r["code"] for r in renumber_keys(app_tables(spark), "member", clash)[1].collect()} == {409}


def test_claims_are_computed_once(spark):
    """What follows reads them several times; requests parsed from JSON would be parsed each time."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("bigint")
    def counted(seq):
        seen.add(1)
        return seq

    held = spark.createDataFrame([(n, f"n{n}") for n in range(20)], "id int, name string")
    rows = [(n, n % 20, f"n{(n * 7) % 25}") for n in range(100)]
    plain = spark.createDataFrame(rows, "seq bigint, target_id int, name string")
    want = sorted(r["seq"] for r in settle_claims(plain, held, "name", "id").collect())
    asked = plain.select(counted("seq").alias("seq"), "target_id", "name")
    assert sorted(r["seq"] for r in settle_claims(asked, held, "name", "id").collect()) == want
    assert seen.value == len(rows)


def test_restricted_deletes_are_parted_by_size(spark):
    """More keys go to more partitions than the session shuffles into by itself."""
    settings = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "32k", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {name: spark.conf.get(name) for name in settings}
    parent = spark.range(300_000).select(F.col("id").alias("id"))
    child = spark.range(600_000).select((F.col("id") % 150_000 * 2).alias("of"))
    asked = spark.range(200_000).select(F.col("id").alias("seq"), (F.col("id") % 160_000).cast("int").alias("target_id"))
    try:
        for name, value in settings.items():
            spark.conf.set(name, value)
        left = restrict_delete(parent, child, asked, "id", "of").table
        assert left.rdd.getNumPartitions() > int(spark.conf.get("spark.sql.shuffle.partitions"))
        assert left.count() == 300_000 - 80_000
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
