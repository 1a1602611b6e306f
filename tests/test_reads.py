import pytest
from data import T0, app_tables, listed
from pyspark.sql import functions as F
from rowsmith.functions.rules import email_form, hashed_password
from rowsmith.operators.checks import check_fk, check_owner, check_rows, resolve_actor
from rowsmith.operators.reads import member_restriction_view, nest_children
from rowsmith.plans.application import find, find_account, listing


def test_lists(spark):
    tables = app_tables(spark)
    assert [r["review_id"] for r in listing(tables, "review").collect()] == [3, 2, 1]
    assert [r["review_id"] for r in listing(tables, "review", 1).collect()] == [2, 1]
    assert [r["community_id"] for r in listing(tables, "community").collect()] == [2, 1]
    assert [r["member_id"] for r in listing(tables, "member").collect()] == [1, 2, 3]
    assert "password" not in listing(tables, "member").columns
    assert listing(tables, "member_restrictions").columns == ["member_restrictions_id", "member_id", "item_id"]
    assert [r["item_id"] for r in listing(tables, "restriction_items", 1).collect()] == [1, 3]
    with pytest.raises(ValueError):
        listing(tables, "member", 1)


def test_find(spark):
    tables = app_tables(spark)
    asked = spark.createDataFrame([(1, 2), (2, 9), (3, 2)], "seq int, target_id int")
    got = listed(find(tables, "member", asked).select("seq", "code", "nickname"))
    assert got == [(1, 200, "Bob"), (2, 404, None), (3, 200, "Bob")]
    assert "password" not in find(tables, "member", asked).columns
    with pytest.raises(ValueError):
        find(tables, "member_restrictions", asked)


def test_find_account(spark):
    asked = spark.createDataFrame(
        [(1, "ÄNN@X.com"), (2, "bob@x.com "), (3, "STRAßE@x.com"), (4, None)], "seq int, email string"
    )
    got = find_account(app_tables(spark), asked)
    assert listed(got.select("seq", "code", "member_id")) == [(1, 200, 1), (2, 401, None), (3, 200, 3), (4, 401, None)]
    assert got.schema["email"].dataType.simpleString() == "string"
    # The stored spelling stays beside the one that was asked for.
    assert [r["stored_email"] for r in got.orderBy("seq").collect()] == ["ann@x.com", None, "strasse@x.com", None]


def test_account_audits(spark):
    df = spark.createDataFrame(
        [(1, "a@b.co", "$2b$12$x"), (2, "a@b", "$2y$x"), (3, "a@b.co", ""), (4, "a b@c.d", "plain"), (5, "@b.c", "$2a$x")],
        "n int, email string, password string",
    )
    got = dict(listed(check_rows(df, [hashed_password(), email_form()]).select("n", "failed_rule")))
    bad_hash, bad_mail = "password is not a bcrypt hash", "email is not an e-mail address"
    assert got == {1: None, 2: bad_mail, 3: bad_hash, 4: bad_hash, 5: bad_mail}


def test_actor_and_owner(spark):
    df = spark.createDataFrame(
        [(1, "1", 1), (2, " +2 ", 2), (3, "x", 1), (4, "5.0", 5), (5, "9", 9), (6, "3", 1), (7, None, 1), (8, "", 1),
         (9, "99999999999999", 1)],
        "seq int, sub string, target_id int",
    )
    got = check_owner(resolve_actor(df, app_tables(spark)["member"]))
    code = F.coalesce("actor_code", "owner_code", F.lit(200))
    assert dict(listed(got.select("seq", code))) == {
        1: 200, 2: 200, 3: 401, 4: 401, 5: 401, 6: 403, 7: 401, 8: 401, 9: 401
    }


def test_fk(spark):
    df = spark.createDataFrame([(1, 1), (2, 9), (3, None)], "seq int, member_id int")
    got = check_fk(df, app_tables(spark)["member"], "member_id", "member_id")
    assert dict(listed(got.select("seq", "fk_code"))) == {1: None, 2: 400, 3: 400}


def test_navigation(spark):
    t = app_tables(spark)
    view = member_restriction_view(t["member"], t["member_restrictions"], t["restriction_items"], t["restriction_category"])
    assert listed(view.select("member_restrictions_id", "email", "item_label_en", "category_label_en")) == [
        (1, "ann@x.com", "MILK", "ALLERGEN"), (2, "ann@x.com", "VEGAN", "DIET"), (3, "Bob@x.com", "MILK", "ALLERGEN"),
    ]


def test_nest(spark):
    t = app_tables(spark)
    got = nest_children(t["member"].select("member_id"), t["review"], "member_id", "review_id")
    rows = {r["member_id"]: [c["review_id"] for c in r["children"]] for r in got.collect()}
    assert rows == {1: [1, 2], 2: [3], 3: []}
    first = got.where("member_id = 2").first()["children"][0]
    assert (first["rating"], first["create_review"]) == (1, T0)


@pytest.mark.parametrize("step", [1, 3, 5000, 2**41])
def test_nest_by_rank(spark, step):
    """Children of all parents are numbered by one counter, so one parent's keys are far apart."""
    child = spark.range(-10, 90).select(
        (F.col("id") * step).alias("id"), F.when(F.col("id") < 75, 1).when(F.col("id") < 89, 2).alias("p"), F.lit("x").alias("v")
    )
    parent = spark.createDataFrame([(1,), (2,), (3,)], "p int")
    got = nest_children(parent, child, "p", "id", width=30).orderBy("p", "part").collect()
    assert [(r["p"], r["part"], len(r["children"])) for r in got] == [(1, 0, 30), (1, 1, 30), (1, 2, 25), (2, 0, 14), (3, 0, 0)]
    assert [c["id"] for r in got for c in r["children"]] == [n * step for n in range(-10, 89)]
