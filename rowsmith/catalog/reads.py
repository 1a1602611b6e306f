"""Lists, lookups, rules and reference checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.collation import ci, plain
from ..functions.rules import between, email_form, hashed_password, matches, max_length
from ..operators.checks import (
    Reference, check_fk, check_owner, check_references, check_rows, resolve_actor,
)
from ..operators.reads import (
    CHILD_RANGE, follow, list_rows, lookup, lookup_ci, nest_children, public_view,
)
from ..operators.upserts import resolve_label
from ..session import tune
from . import inputs as i

QUERIES, ORACLE = {}, {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__] = lambda spark, folder: f(tune(spark), folder)
        ORACLE[f.__name__] = sql
        return f

    return register


@query("SELECT * FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderkey DESC")
def q01_list_filtered(spark: SparkSession, d: str) -> DataFrame:
    orders = i.table(spark, d, "orders")
    return list_rows(orders, "o_orderkey", desc=True, o_orderstatus="F", o_custkey=None)


@query("SELECT * FROM customer ORDER BY c_custkey")
def q02_list_all(spark: SparkSession, d: str) -> DataFrame:
    return list_rows(i.table(spark, d, "customer"), "c_custkey")


@query(f"""WITH {i.REQUESTS_SQL}
SELECT seq, target_id, c_name, c_mktsegment,
       CAST(CASE WHEN c_custkey IS NULL THEN 404 ELSE 200 END AS BIGINT) AS code
FROM requests LEFT JOIN customer ON c_custkey = target_id""")
def q03_lookup(spark: SparkSession, d: str) -> DataFrame:
    asked = i.requests(spark, d).select("seq", "target_id")
    found = lookup(asked, i.table(spark, d, "customer"), "c_custkey")
    return found.select(
        "seq", "target_id", "c_name", "c_mktsegment", F.col("code").cast("bigint").alias("code")
    )


@query(f"""WITH {i.REQUESTS_SQL}, {i.NAMES_SQL}
SELECT seq, name, c_custkey,
       CAST(CASE WHEN c_custkey IS NULL THEN 401 ELSE 200 END AS BIGINT) AS code
FROM named LEFT JOIN customer ON lower(c_name) = lower(name)""")
def q04_ci_lookup(spark: SparkSession, d: str) -> DataFrame:
    asked = i.named(spark, d).select("seq", "name")
    found = lookup_ci(asked, i.table(spark, d, "customer"), "c_name", on="name")
    return found.select("seq", "name", "c_custkey", F.col("code").cast("bigint").alias("code"))


@query(r"""SELECT min(w) AS spelling, CAST(count(*) AS BIGINT) AS n
FROM (SELECT unnest(string_split_regex(text, '[ \n\t\r]+')) AS w FROM documents)
GROUP BY replace(lower(strip_accents(w)), 'ß', 'ss')""")
def q35_ci_classes(spark: SparkSession, d: str) -> DataFrame:
    docs = i.documents(spark, d, "text")
    words = docs.select(F.explode(F.split("text", r"[ \n\t\r]+")).alias("w"))
    # Equal spellings are counted first, by hash; only the distinct ones are collated.
    spelled = words.groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    classes = spelled.groupBy(ci("w").alias("class")).agg(
        F.min(plain("w")).alias("spelling"), F.sum("n").cast("bigint").alias("n")
    )
    return classes.select("spelling", "n")


@query("SELECT c_custkey, c_name, c_nationkey, c_mktsegment FROM customer")
def q05_public(spark: SparkSession, d: str) -> DataFrame:
    return public_view(
        i.table(spark, d, "customer"), ["c_custkey", "c_name", "c_nationkey", "c_mktsegment"]
    )


@query("""SELECT coalesce(CASE
    WHEN l_quantity < 5 OR l_quantity > 40 THEN 'l_quantity must be 5..40'
    WHEN length(l_returnflag) > 1 THEN 'l_returnflag is longer than 1'
    WHEN NOT regexp_matches(l_linestatus, '^[OP]$') THEN 'status has the wrong form' END,
    'passed') AS rule, CAST(count(*) AS BIGINT) AS n
FROM lineitem GROUP BY rule""")
def q06_rules(spark: SparkSession, d: str) -> DataFrame:
    rules = [
        between("l_quantity", 5, 40),
        max_length("l_returnflag", 1),
        matches("l_linestatus", "^[OP]$", "status has the wrong form"),
    ]
    checked = check_rows(i.table(spark, d, "lineitem"), rules)
    return checked.groupBy(F.coalesce("failed_rule", F.lit("passed")).alias("rule")).agg(
        F.count(F.lit(1)).cast("bigint").alias("n")
    )


@query(f"""WITH {i.REQUESTS_SQL}
SELECT seq, CAST(CASE WHEN EXISTS (SELECT 1 FROM customer WHERE c_custkey = target_id)
                 THEN 200 ELSE 400 END AS BIGINT) AS code
FROM requests""")
def q07_fk(spark: SparkSession, d: str) -> DataFrame:
    asked = i.requests(spark, d).select("seq", "target_id")
    checked = check_fk(asked, i.table(spark, d, "customer"), "target_id", "c_custkey", "code")
    return checked.select("seq", F.coalesce("code", F.lit(200)).cast("bigint").alias("code"))


@query("""WITH asked AS (
  SELECT l_orderkey * 2 AS order_key, l_partkey + 20 * l_linenumber AS part_key, l_quantity
  FROM lineitem
)
SELECT CASE WHEN o_orderkey IS NULL THEN 'order_key'
            WHEN p_partkey IS NULL THEN 'part_key' ELSE 'none' END AS missing,
       CAST(count(*) AS BIGINT) AS n, CAST(sum(l_quantity) AS BIGINT) AS quantity
FROM asked LEFT JOIN orders ON o_orderkey = order_key LEFT JOIN part ON p_partkey = part_key
GROUP BY missing""")
def q08_fk_ordered(spark: SparkSession, d: str) -> DataFrame:
    orders, parts = i.table(spark, d, "orders"), i.table(spark, d, "part")
    rows = i.table(spark, d, "lineitem").select(
        (F.col("l_orderkey") * 2).alias("order_key"),
        (F.col("l_partkey") + 20 * F.col("l_linenumber")).alias("part_key"), "l_quantity",
    )
    checked = check_references(
        rows,
        [Reference("order_key", orders, "o_orderkey"), Reference("part_key", parts, "p_partkey")],
        "missing",
    )
    return checked.groupBy(F.coalesce("missing", F.lit("none")).alias("missing")).agg(
        F.count(F.lit(1)).cast("bigint").alias("n"),
        F.sum("l_quantity").cast("bigint").alias("quantity"),
    )


@query(f"""WITH {i.REQUESTS_SQL}, asked AS (
  SELECT seq, user_id * 20 + k % 50 AS target_id,
         CASE event_type WHEN 'error' THEN concat('u', target_id)
              WHEN 'view' THEN concat(' +', target_id, ' ') ELSE CAST(target_id AS VARCHAR) END AS sub
  FROM requests
)
SELECT seq, c_custkey AS actor_id,
       CAST(CASE WHEN c_custkey IS NULL THEN 401 WHEN c_custkey <> target_id THEN 403
                 ELSE 200 END AS BIGINT) AS code
FROM asked LEFT JOIN customer ON c_custkey = TRY_CAST(replace(trim(sub), '+', '') AS BIGINT)""")
def q11_actor_owner(spark: SparkSession, d: str) -> DataFrame:
    user = F.col("target_id").cast("string")
    sub = (
        F.when(F.col("event_type") == "error", F.concat(F.lit("u"), user))
        .when(F.col("event_type") == "view", F.concat(F.lit(" +"), user, F.lit(" ")))
        .otherwise(user)
    )
    asked = i.requests(spark, d).select(
        "seq", (F.col("user_id") * 20 + F.col("k") % 50).alias("target_id"), sub.alias("sub")
    )
    known = check_owner(resolve_actor(asked, i.table(spark, d, "customer"), "sub", "c_custkey"))
    code = F.coalesce("actor_code", "owner_code", F.lit(200))
    return known.select("seq", "actor_id", code.cast("bigint").alias("code"))


@query(f"""WITH {i.REQUESTS_SQL}, {i.NAMES_SQL}
SELECT seq, name, c_custkey AS customer_id
FROM named LEFT JOIN customer ON lower(c_name) = lower(name)""")
def q39_resolve_label(spark: SparkSession, d: str) -> DataFrame:
    asked = i.named(spark, d).select("seq", "name")
    customers = i.table(spark, d, "customer")
    return resolve_label(asked, customers, "name", "c_name", "c_custkey", "customer_id")


@query("""SELECT l_orderkey, l_linenumber, l_quantity, c_name, o_orderdate, p_name
FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey
JOIN part ON p_partkey = l_partkey""")
def q22_navigate(spark: SparkSession, d: str) -> DataFrame:
    lines = i.table(spark, d, "lineitem")
    return follow(
        lines,
        ("l_orderkey", i.table(spark, d, "orders"), "o_orderkey"),
        ("o_custkey", i.table(spark, d, "customer"), "c_custkey"),
        ("l_partkey", i.table(spark, d, "part"), "p_partkey"),
    ).select("l_orderkey", "l_linenumber", "l_quantity", "c_name", "o_orderdate", "p_name")


_NEST_SQL = """WITH ranked AS (
  SELECT o_custkey, o_orderkey, o_orderstatus,
         (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) // {width} AS part
  FROM orders
), nested AS (
  SELECT o_custkey, part, string_agg(concat(o_orderkey, ':', o_orderstatus), ',' ORDER BY o_orderkey) AS orders,
         count(*) AS n
  FROM ranked GROUP BY o_custkey, part
)
SELECT c_custkey, CAST(coalesce(part, 0) AS BIGINT) AS part, coalesce(orders, '') AS orders,
       CAST(coalesce(n, 0) AS BIGINT) AS n
FROM customer LEFT JOIN nested ON o_custkey = c_custkey"""


def _nest(spark: SparkSession, d: str, width: int) -> DataFrame:
    orders = i.table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    nested = nest_children(
        i.table(spark, d, "customer"), orders, "c_custkey", "o_orderkey", "o_custkey",
        "orders", width,
    )
    line = F.transform("orders", lambda o: F.concat_ws(":", o["o_orderkey"], o["o_orderstatus"]))
    return nested.select(
        "c_custkey", "part", F.array_join(line, ",").alias("orders"),
        F.size("orders").cast("bigint").alias("n"),
    )


@query(_NEST_SQL.format(width=CHILD_RANGE))
def q23_nest(spark: SparkSession, d: str) -> DataFrame:
    return _nest(spark, d, CHILD_RANGE)


@query(_NEST_SQL.format(width=3))
def q55_nest_parts(spark: SparkSession, d: str) -> DataFrame:
    """Arrays of three, so that most parents have several."""
    return _nest(spark, d, 3)


@query(rf"""WITH {i.REQUESTS_SQL}, accounts AS (
  SELECT seq, CASE event_type WHEN 'view' THEN '$2b$12$' || k WHEN 'click' THEN '$2x$' || k
           WHEN 'signup' THEN '' ELSE '$3b$' || k END AS password,
         CASE k % 5 WHEN 0 THEN 'u' || k WHEN 1 THEN 'u ' || k || '@x.org' WHEN 2 THEN 'u@x'
           ELSE 'u' || user_id || '@mail.x.org' END AS email
  FROM requests
)
SELECT seq, CASE WHEN NOT regexp_matches(password, '^\$2[abxy]\$') THEN 'password is not a bcrypt hash'
  WHEN NOT regexp_matches(email, '^[^@\s]+@[^@\s.]+(\.[^@\s.]+)+$') THEN 'email is not an e-mail address'
  END AS failed_rule
FROM accounts""")
def q47_account_audits(spark: SparkSession, d: str) -> DataFrame:
    kind, k = F.col("event_type"), F.col("k").cast("string")
    password = (
        F.when(kind == "view", F.concat(F.lit("$2b$12$"), k)).when(kind == "click", F.concat(F.lit("$2x$"), k))
        .when(kind == "signup", "").otherwise(F.concat(F.lit("$3b$"), k))
    )
    rest = F.col("k") % 5
    email = (
        F.when(rest == 0, F.concat(F.lit("u"), k)).when(rest == 1, F.concat(F.lit("u "), k, F.lit("@x.org")))
        .when(rest == 2, "u@x").otherwise(F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit("@mail.x.org")))
    )
    accounts = i.requests(spark, d).select("seq", password.alias("password"), email.alias("email"))
    return check_rows(accounts, [hashed_password(), email_form()]).select("seq", "failed_rule")
