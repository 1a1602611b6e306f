"""Inserts, patches, deletes, upserts and key changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.patches import parse_patch
from ..functions.rules import between, max_length
from ..operators.checks import Reference
from ..operators.deletes import Edge, cascade_delete, delete_rows, restrict_delete
from ..operators.ids import assign_ids, next_id
from ..operators.inserts import Changes, Unique, insert_rows
from ..operators.patching import fold_patches, patch_rows
from ..operators.claims import settle_claims
from ..operators.unique import free_claims, new_keys
from ..operators.upserts import renumber, upsert
from ..sources.tables import latest_version, read_growing, read_version, write_version
from ..streaming.changes import apply_inserts, apply_stream
from ..session import Stage, tune
from . import inputs as i

QUERIES, ORACLE = {}, {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__] = lambda spark, folder: f(tune(spark), folder)
        ORACLE[f.__name__] = sql
        return f

    return register


def _code(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("bigint") for c in ("code", "id")})


# -- unique keys, ids, inserts -----------------------------------------------------

_NEW_SQL = f"""{i.PAIRS_SQL}, ranked AS (
  SELECT a.seq, a.user_id, a.event_type, e.id IS NOT NULL AS held,
         row_number() OVER (PARTITION BY a.user_id, a.event_type ORDER BY a.seq) AS place
  FROM arriving a LEFT JOIN existing e USING (user_id, event_type)
)"""


@query(f"""WITH {_NEW_SQL}
SELECT seq, NOT held AND place = 1 AS is_new FROM ranked""")
def q09_unique(spark: SparkSession, d: str) -> DataFrame:
    late = i.arriving(spark, d)
    fresh = new_keys(late, i.existing(spark, d), ["user_id", "event_type"])
    marked = late.join(fresh.withColumn("_new", F.lit(True)), "seq", "left")
    return marked.select("seq", F.coalesce("_new", F.lit(False)).alias("is_new"))


@query(f"""WITH {_NEW_SQL}
SELECT seq, CAST((SELECT max(id) FROM existing) + row_number() OVER (ORDER BY seq) AS BIGINT) AS id
FROM ranked WHERE NOT held AND place = 1""")
def q10_ids(spark: SparkSession, d: str) -> DataFrame:
    late, early = i.arriving(spark, d), i.existing(spark, d)
    fresh = new_keys(late, early, ["user_id", "event_type"])
    return assign_ids(fresh, next_id(early, "id"))


@query("""SELECT event_id, CAST(9 + row_number() OVER (ORDER BY event_id) AS BIGINT) AS id
FROM events""")
def q43_ids_all(spark: SparkSession, d: str) -> DataFrame:
    events = i.table(spark, d, "events").select("event_id")
    return assign_ids(events, 10, "event_id", "id", bucket_bits=6)


_INSERT_SQL = f"""{i.PAIRS_SQL}, checked AS (
  SELECT seq, user_id, event_type, value,
         CASE WHEN value < 1 OR value > 60 THEN 422
              WHEN NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = user_id) THEN 400
              WHEN length(event_type) > 6 THEN 500 END AS fail
  FROM arriving
), ranked AS (
  SELECT c.seq, c.user_id, c.event_type, c.value, e.id IS NOT NULL AS held,
         row_number() OVER (PARTITION BY c.user_id, c.event_type ORDER BY c.seq) AS place
  FROM checked c LEFT JOIN existing e USING (user_id, event_type) WHERE fail IS NULL
), accepted AS (
  SELECT seq, user_id, event_type, value,
         (SELECT max(id) FROM existing) + row_number() OVER (ORDER BY seq) AS id
  FROM ranked WHERE NOT held AND place = 1
)"""


def _pair_table(spark: SparkSession, d: str) -> DataFrame:
    created = F.lit(i.BEFORE).cast("timestamp_ntz")
    return i.existing(spark, d).select(
        "id", "user_id", "event_type", F.lit(None).cast("double").alias("value"),
        created.alias("created"),
    )


def _insert(table: DataFrame, requests: DataFrame, parents: DataFrame, stage: Stage) -> Changes:
    return insert_rows(
        table, requests, key="id",
        rules=[between("value", 1, 60), max_length("event_type", 6)],
        fks=[Reference("user_id", parents, "c_custkey")],
        unique=Unique(("user_id", "event_type"), (), "already there"),
        now=i.NOW, stamps=["created"], stage=stage,
    )


@query(f"""WITH {_INSERT_SQL}
SELECT c.seq, CAST(coalesce(fail, CASE WHEN a.id IS NULL THEN 409 ELSE 200 END) AS BIGINT) AS code,
       CASE fail WHEN 422 THEN 'value must be 1..60' WHEN 400 THEN 'Invalid user_id'
                 WHEN 500 THEN 'event_type is longer than 6'
                 ELSE CASE WHEN a.id IS NULL THEN 'already there' END END AS detail,
       CAST(a.id AS BIGINT) AS id
FROM checked c LEFT JOIN accepted a ON a.seq = c.seq""")
def q12_insert(spark: SparkSession, d: str) -> DataFrame:
    table = _pair_table(spark, d)
    return _code(_insert(table, i.arriving(spark, d), i.table(spark, d, "customer"), i.stage(spark)).outcomes)


_INSERTED_SQL = f"""WITH {_INSERT_SQL}
SELECT CAST(id AS BIGINT) AS id, user_id, event_type, NULL::DOUBLE AS value,
       TIMESTAMP '{i.BEFORE}' AS created FROM existing
UNION ALL
SELECT CAST(id AS BIGINT), user_id, event_type, value, TIMESTAMP '{i.NOW}' FROM accepted"""


@query(_INSERTED_SQL)
def q36_insert_table(spark: SparkSession, d: str) -> DataFrame:
    table = _pair_table(spark, d)
    return _insert(table, i.arriving(spark, d), i.table(spark, d, "customer"), i.stage(spark)).table


@query(_INSERTED_SQL)
def q44_insert_stream(spark: SparkSession, d: str) -> DataFrame:
    """The insert of q36 with its requests arriving as a stream, read back as a version."""
    folder = i.scratch(spark, "stream")
    write_version(_pair_table(spark, d), f"{folder}/table", 0)
    late = i.late(i.pairs(_event_stream(spark, d)))
    parents = i.table(spark, d, "customer")
    apply_inserts(
        late, lambda table, batch, stage: _insert(table, batch, parents, stage),
        f"{folder}/table", f"{folder}/outcomes", f"{folder}/checkpoint",
    ).awaitTermination()
    return read_growing(spark, f"{folder}/table", latest_version(spark, f"{folder}/table"))


def _event_stream(spark: SparkSession, d: str) -> DataFrame:
    """The given events as a stream of files."""
    files = spark.readStream.schema(i.table(spark, d, "events").schema)
    return files.option("pathGlobFilter", "events.parquet").parquet(d)


def _streamed(spark: SparkSession, d: str, requests: DataFrame, operation) -> DataFrame:
    """The customers after a stream of requests of one kind."""
    folder = i.scratch(spark, "stream")
    write_version(i.table(spark, d, "customer"), f"{folder}/table", 0)
    apply_stream(requests, operation, f"{folder}/table", f"{folder}/outcomes", f"{folder}/checkpoint").awaitTermination()
    return read_version(spark, f"{folder}/table", latest_version(spark, f"{folder}/table"))


# -- patches -----------------------------------------------------------------------

_PATCHED = ["c_nationkey", "c_mktsegment"]


@query(f"""WITH {i.REQUESTS_SQL}, {i.BODY_SQL}
SELECT seq, is_json, body_ok, set_c_nationkey, new_c_nationkey, set_c_mktsegment, new_c_mktsegment
FROM patches""")
def q13_patch_parse(spark: SparkSession, d: str) -> DataFrame:
    schema = i.table(spark, d, "customer").select(*_PATCHED).schema
    return parse_patch(i.patch_bodies(spark, d), "body", schema).drop("target_id", "body")


@query(f"""WITH {i.REQUESTS_SQL}, {i.BODY_SQL}, folded AS (
  SELECT target_id, max_by({{'v': new_c_nationkey}}, seq) FILTER (set_c_nationkey) AS n,
         max_by({{'v': new_c_mktsegment}}, seq) FILTER (set_c_mktsegment) AS m
  FROM patches WHERE body_ok GROUP BY target_id
)
SELECT target_id, n IS NOT NULL AS has_nation, n.v AS nation,
       m IS NOT NULL AS has_segment, m.v AS segment FROM folded""")
def q14_patch_fold(spark: SparkSession, d: str) -> DataFrame:
    schema = i.table(spark, d, "customer").select(*_PATCHED).schema
    parsed = parse_patch(i.patch_bodies(spark, d), "body", schema).where("body_ok")
    nation, segment = F.col("_last_c_nationkey"), F.col("_last_c_mktsegment")
    return fold_patches(parsed, _PATCHED).select(
        "target_id", nation.isNotNull().alias("has_nation"), nation["v"].alias("nation"),
        segment.isNotNull().alias("has_segment"), segment["v"].alias("segment"),
    )


_PATCH_SQL = f"""{i.REQUESTS_SQL}, {i.BODY_SQL}, judged AS (
  SELECT p.*, CASE
    WHEN NOT is_json OR NOT body_ok THEN 422
    WHEN c_custkey IS NULL THEN 404
    WHEN NOT set_c_nationkey AND NOT set_c_mktsegment THEN 200
    WHEN new_c_nationkey IS NOT NULL AND n_nationkey IS NULL THEN 400
    WHEN set_c_mktsegment AND new_c_mktsegment IS NULL THEN 409
    WHEN length(new_c_mktsegment) > 4 THEN 500 END AS code
  FROM patches p LEFT JOIN customer ON c_custkey = target_id
  LEFT JOIN nation ON n_nationkey = new_c_nationkey
)"""


def _patch(spark: SparkSession, d: str) -> Changes:
    modified = F.lit(i.BEFORE).cast("timestamp_ntz")
    table = i.table(spark, d, "customer").withColumn("modified", modified)
    return patch_rows(
        table, i.patch_bodies(spark, d), key="c_custkey", columns=_PATCHED,
        required=["c_mktsegment"], lengths={"c_mktsegment": 4},
        fks=[Reference("c_nationkey", i.table(spark, d, "nation"), "n_nationkey")],
        touch="modified", now=i.NOW,
    )


@query(f"""WITH {_PATCH_SQL}, folded AS (
  SELECT target_id, max_by({{'v': new_c_nationkey}}, seq) FILTER (set_c_nationkey) AS n,
         max_by({{'v': new_c_mktsegment}}, seq) FILTER (set_c_mktsegment) AS m
  FROM judged WHERE code IS NULL GROUP BY target_id
), moved AS (
  SELECT DISTINCT target_id FROM judged JOIN customer ON c_custkey = target_id
  WHERE code IS NULL AND (set_c_nationkey AND new_c_nationkey IS DISTINCT FROM c_nationkey
                       OR set_c_mktsegment AND new_c_mktsegment IS DISTINCT FROM c_mktsegment)
)
SELECT c_custkey, c_name, CASE WHEN n IS NULL THEN c_nationkey ELSE n.v END::INT AS c_nationkey,
       c_acctbal, CASE WHEN m IS NULL THEN c_mktsegment ELSE m.v END AS c_mktsegment,
       CASE WHEN c_custkey IN (SELECT target_id FROM moved) THEN TIMESTAMP '{i.NOW}'
            ELSE TIMESTAMP '{i.BEFORE}' END AS modified
FROM customer LEFT JOIN folded ON target_id = c_custkey""")
def q15_patch_apply(spark: SparkSession, d: str) -> DataFrame:
    return _patch(spark, d).table


@query(f"""WITH {_PATCH_SQL}
SELECT seq, CAST(coalesce(code, 200) AS BIGINT) AS code, target_id AS id,
       CASE code WHEN 422 THEN CASE WHEN is_json THEN 'body has a value of the wrong type' ELSE 'body is not JSON' END
         WHEN 404 THEN 'not found' WHEN 400 THEN 'Invalid c_nationkey' WHEN 409 THEN 'c_mktsegment must not be null'
         WHEN 500 THEN 'c_mktsegment is longer than 4' END AS detail
FROM judged""")
def q37_patch_outcomes(spark: SparkSession, d: str) -> DataFrame:
    return _code(_patch(spark, d).outcomes)


@query(f"""WITH {i.REQUESTS_SQL}, {i.BODY_SQL}, asked AS (
  SELECT seq, user_id * 20 + k % 50 AS target, CASE event_type WHEN 'error' THEN concat('u', target_id)
           ELSE concat(' ', target_id) END AS sub
  FROM requests
)
SELECT seq, target AS id, CAST(CASE
    WHEN NOT is_json THEN 422 WHEN c_custkey IS NULL THEN 401 WHEN NOT body_ok THEN 422
    WHEN c_custkey <> target THEN 403
    WHEN NOT set_c_nationkey AND NOT set_c_mktsegment THEN 200
    WHEN new_c_nationkey IS NOT NULL AND n_nationkey IS NULL THEN 400
    WHEN set_c_mktsegment AND new_c_mktsegment IS NULL THEN 409
    WHEN length(new_c_mktsegment) > 4 THEN 500 ELSE 200 END AS BIGINT) AS code
FROM patches JOIN asked USING (seq) LEFT JOIN customer ON c_custkey = TRY_CAST(trim(sub) AS BIGINT)
LEFT JOIN nation ON n_nationkey = new_c_nationkey""")
def q48_patch_actor(spark: SparkSession, d: str) -> DataFrame:
    """Patches of owned rows: only the subject itself may change its row."""
    subject = F.when(F.col("event_type") == "error", F.concat(F.lit("u"), "target_id")).otherwise(F.concat(F.lit(" "), "target_id"))
    asked = i.requests(spark, d).select("seq", (F.col("user_id") * 20 + F.col("k") % 50).alias("target"), subject.alias("sub"))
    bodies = i.patch_bodies(spark, d).select("seq", "body").join(asked, "seq")
    customers = i.table(spark, d, "customer")
    changes = patch_rows(
        customers, bodies, key="c_custkey", columns=_PATCHED, target="target", members=customers,
        required=["c_mktsegment"], lengths={"c_mktsegment": 4},
        fks=[Reference("c_nationkey", i.table(spark, d, "nation"), "n_nationkey")],
    )
    return _code(changes.outcomes).select("seq", "code", "id")


_CLAIMS_SQL = f"""{i.REQUESTS_SQL}, {i.NAMES_SQL}, claims AS (
  SELECT seq, target_id, lower(CASE event_type
           WHEN 'view' THEN name WHEN 'signup' THEN concat('Customer#', lpad(k::VARCHAR, 9, '0'))
           WHEN 'click' THEN concat('FRESH#', target_id) WHEN 'error' THEN concat('fresh#', k)
           ELSE concat('fresh#', target_id) END) AS v
  FROM named JOIN customer ON c_custkey = target_id
), steady AS (
  SELECT target_id, count(DISTINCT v) = 1 AS steady FROM claims GROUP BY target_id
), firsts AS (
  SELECT c.*, steady,
         coalesce(c_custkey, first_value(target_id) OVER (PARTITION BY v ORDER BY seq)) AS first_row
  FROM claims c JOIN steady USING (target_id) LEFT JOIN customer ON lower(c_name) = v
), rivals AS (
  SELECT v, min(seq) AS rival FROM firsts WHERE target_id <> first_row GROUP BY v
)"""


@query(f"""WITH {_CLAIMS_SQL}
SELECT seq, target_id = first_row AND (rival IS NULL OR seq < rival OR steady) AS granted
FROM firsts LEFT JOIN rivals USING (v)""")
def q16_patch_unique(spark: SparkSession, d: str) -> DataFrame:
    claims, customers = _claims(spark, d)
    granted = free_claims(claims, customers, "c_name", "c_custkey")
    marked = claims.join(granted.withColumn("_ok", F.lit(True)), "seq", "left")
    return marked.select("seq", F.coalesce("_ok", F.lit(False)).alias("granted"))


def _claims(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    customers = i.table(spark, d, "customer")
    kind, k, target = F.col("event_type"), F.col("k"), F.col("target_id")
    value = (
        F.when(kind == "view", F.col("name"))
        .when(kind == "signup", F.concat(F.lit("Customer#"), F.lpad(k.cast("string"), 9, "0")))
        .when(kind == "click", F.concat(F.lit("FRESH#"), target))
        .when(kind == "error", F.concat(F.lit("fresh#"), k))
        .otherwise(F.concat(F.lit("fresh#"), target))
    )
    known = customers.select(F.col("c_custkey").alias("target_id"))
    claims = i.named(spark, d).join(known, "target_id").select(
        "seq", "target_id", value.alias("c_name")
    )
    return claims, customers


@query(f"""WITH RECURSIVE {_CLAIMS_SQL[:_CLAIMS_SQL.index(', steady AS')]}, starts AS (
  SELECT -1 AS seq, c_custkey AS row, lower(c_name) AS v FROM customer
), rounds AS (
  SELECT 0 AS n, seq, target_id AS row, v, false AS was, true AS ok FROM claims
  UNION ALL
  (WITH told AS (
    SELECT n, seq, row, v, true AS asked, was, ok FROM rounds
    UNION ALL
    SELECT max(n), s.seq, s.row, s.v, false, true, true FROM rounds, starts s GROUP BY s.seq, s.row, s.v
  ), timed AS (
    SELECT *, min(seq) FILTER (ok) OVER (PARTITION BY row ORDER BY seq
        ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS until FROM told
  )
  SELECT c.n + 1, c.seq, c.row, c.v, c.ok, NOT EXISTS (
    SELECT 1 FROM timed h WHERE h.ok AND h.v = c.v AND h.row <> c.row AND h.seq < c.seq
      AND (h.until IS NULL OR h.until >= c.seq))
  FROM timed c WHERE c.asked AND EXISTS (SELECT 1 FROM rounds WHERE was <> ok))
)
SELECT seq, max_by(ok, n) AS granted FROM rounds GROUP BY seq""")
def q54_exact_claims(spark: SparkSession, d: str) -> DataFrame:
    """The claims of q16 with values free as soon as they are left."""
    claims, customers = _claims(spark, d)
    granted = settle_claims(claims, customers, "c_name", "c_custkey")
    marked = claims.join(granted.withColumn("_ok", F.lit(True)), "seq", "left")
    return marked.select("seq", F.coalesce("_ok", F.lit(False)).alias("granted"))


# -- deletes -----------------------------------------------------------------------


@query(f"""WITH {i.REQUESTS_SQL}
SELECT seq, CAST(CASE WHEN c_custkey IS NOT NULL AND
         row_number() OVER (PARTITION BY target_id ORDER BY seq) = 1 THEN 200 ELSE 404 END
       AS BIGINT) AS code, target_id AS id, CASE WHEN code = 404 THEN 'not found' END AS detail
FROM requests LEFT JOIN customer ON c_custkey = target_id""")
def q17_delete(spark: SparkSession, d: str) -> DataFrame:
    asked = i.requests(spark, d).select("seq", "target_id")
    changes = delete_rows(i.table(spark, d, "customer"), asked, "c_custkey")
    return _code(changes.outcomes)


@query(f"""WITH {i.REQUESTS_SQL}
SELECT * FROM customer WHERE c_custkey NOT IN (SELECT target_id FROM requests)""")
def q38_delete_table(spark: SparkSession, d: str) -> DataFrame:
    asked = i.requests(spark, d).select("seq", "target_id")
    return delete_rows(i.table(spark, d, "customer"), asked, "c_custkey").table


_GRAPH = [
    Edge("orders", "o_custkey", "customer", "c_custkey"),
    Edge("lineitem", "l_orderkey", "orders", "o_orderkey"),
]


@query("""WITH c AS (SELECT c_custkey FROM customer WHERE c_acctbal >= 0),
     o AS (SELECT * FROM orders WHERE o_custkey NOT IN
             (SELECT c_custkey FROM customer WHERE c_acctbal < 0)),
     l AS (SELECT * FROM lineitem WHERE l_orderkey NOT IN
             (SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM o)))
SELECT 'customer' AS name, CAST(count(*) AS BIGINT) AS n, CAST(sum(c_custkey) AS BIGINT) AS total
FROM c
UNION ALL SELECT 'orders', count(*), CAST(sum(o_orderkey) AS BIGINT) FROM o
UNION ALL SELECT 'lineitem', count(*), CAST(sum(l_orderkey) AS BIGINT) FROM l""")
def q19_cascade(spark: SparkSession, d: str) -> DataFrame:
    tables = {n: i.table(spark, d, n) for n in ("customer", "orders", "lineitem")}
    doomed = tables["customer"].where("c_acctbal < 0").select(F.col("c_custkey").cast("int"))
    left = cascade_delete(tables, "customer", doomed, _GRAPH, "c_custkey")
    keys = {"customer": "c_custkey", "orders": "o_orderkey", "lineitem": "l_orderkey"}
    counts = [
        left[name].agg(
            F.lit(name).alias("name"), F.count(F.lit(1)).cast("bigint").alias("n"),
            F.sum(key).cast("bigint").alias("total"),
        )
        for name, key in keys.items()
    ]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


@query(f"""WITH {i.REQUESTS_SQL}, lines AS (
  SELECT DISTINCT l_orderkey FROM lineitem
), judged AS (
  SELECT seq, target_id,
         CAST(CASE WHEN o_orderkey IS NULL THEN 404 WHEN l_orderkey IS NOT NULL THEN 409
           WHEN row_number() OVER (PARTITION BY target_id ORDER BY seq) = 1 THEN 200 ELSE 404 END
         AS BIGINT) AS code
  FROM requests LEFT JOIN orders ON o_orderkey = target_id LEFT JOIN lines ON l_orderkey = target_id
)
SELECT seq, code, target_id AS id,
       CASE code WHEN 404 THEN 'not found' WHEN 409 THEN 'blocked by referring rows' END AS detail
FROM judged""")
def q20_restrict(spark: SparkSession, d: str) -> DataFrame:
    """Orders without lines may go; the requests have narrower keys than the table."""
    asked = i.requests(spark, d).select("seq", F.col("target_id").cast("int").alias("target_id"))
    orders, lines = i.table(spark, d, "orders"), i.table(spark, d, "lineitem")
    changes = restrict_delete(orders, lines, asked, "o_orderkey", "l_orderkey")
    return _code(changes.outcomes)


@query(f"""WITH {i.REQUESTS_SQL}
SELECT o_orderkey FROM orders
WHERE o_orderkey NOT IN (SELECT target_id FROM requests) OR o_orderkey IN (SELECT l_orderkey FROM lineitem)""")
def q49_restrict_table(spark: SparkSession, d: str) -> DataFrame:
    asked = i.requests(spark, d).select("seq", F.col("target_id").cast("int").alias("target_id"))
    orders, lines = i.table(spark, d, "orders"), i.table(spark, d, "lineitem")
    return restrict_delete(orders, lines, asked, "o_orderkey", "l_orderkey").table.select("o_orderkey")


@query(f"""WITH {i.REQUESTS_SQL}
SELECT * FROM customer WHERE c_custkey NOT IN (SELECT target_id FROM requests)""")
def q51_delete_stream(spark: SparkSession, d: str) -> DataFrame:
    """The deletes of q38 with their requests arriving as a stream."""
    asked = i.as_requests(_event_stream(spark, d)).select("seq", "target_id")
    return _streamed(spark, d, asked, lambda table, batch, stage: delete_rows(table, batch, "c_custkey"))


@query(f"""WITH {i.REQUESTS_SQL}, folded AS (
  SELECT target_id, max_by(k, seq) AS nation FROM requests GROUP BY target_id
)
SELECT c_custkey, c_name, coalesce(nation, c_nationkey)::INT AS c_nationkey, c_acctbal, c_mktsegment
FROM customer LEFT JOIN folded ON target_id = c_custkey""")
def q52_patch_stream(spark: SparkSession, d: str) -> DataFrame:
    """Patches that arrive as a stream."""
    body = F.concat(F.lit('{"c_nationkey": '), F.col("k"), F.lit("}"))
    asked = i.as_requests(_event_stream(spark, d)).select("seq", "target_id", body.alias("body"))
    return _streamed(spark, d, asked, lambda table, batch, stage: patch_rows(table, batch, key="c_custkey", columns=["c_nationkey"], stage=stage))


# -- upsert and renumbering ---------------------------------------------------------


@query(f"""WITH {i.REQUESTS_SQL}, {i.NAMES_SQL}, folded AS (
  SELECT lower(name) AS v, min_by(name, seq) AS name, min_by(k, seq) AS k,
         max_by(event_type, seq) AS segment, min(seq) AS seq
  FROM named GROUP BY lower(name)
)
SELECT c_custkey, c_name, c_nationkey, c_acctbal,
       CASE WHEN v IS NULL THEN c_mktsegment ELSE segment END AS c_mktsegment
FROM customer LEFT JOIN folded ON lower(c_name) = v
UNION ALL
SELECT CAST((SELECT max(c_custkey) FROM customer) + row_number() OVER (ORDER BY seq) AS BIGINT),
       name, CAST(k AS INT), NULL, segment
FROM folded WHERE v NOT IN (SELECT lower(c_name) FROM customer)""")
def q18_upsert(spark: SparkSession, d: str) -> DataFrame:
    return _upsert(spark, d).table


@query(f"""WITH {i.REQUESTS_SQL}, {i.NAMES_SQL}, folded AS (
  SELECT lower(name) AS v, min(seq) AS first FROM named GROUP BY lower(name)
), fresh AS (
  SELECT v, first, CAST((SELECT max(c_custkey) FROM customer) + row_number() OVER (ORDER BY first) AS BIGINT) AS born
  FROM folded WHERE v NOT IN (SELECT lower(c_name) FROM customer)
)
SELECT seq, CAST(200 AS BIGINT) AS code, CASE WHEN first = seq THEN 'inserted' ELSE 'updated' END AS detail,
       coalesce(c_custkey, born) AS id
FROM named LEFT JOIN fresh ON v = lower(name) LEFT JOIN customer ON lower(c_name) = lower(name)""")
def q50_upsert_outcomes(spark: SparkSession, d: str) -> DataFrame:
    return _code(_upsert(spark, d).outcomes)


def _upsert(spark: SparkSession, d: str) -> Changes:
    src = i.named(spark, d).select(
        "seq", F.col("name").alias("c_name"), F.col("k").cast("int").alias("c_nationkey"),
        F.col("event_type").alias("c_mktsegment"),
    )
    return upsert(
        i.table(spark, d, "customer"), src, ["c_name"], ["c_mktsegment"], key="c_custkey",
        text=["c_name"], stage=i.stage(spark),
    )


_MAPPING_SQL = """mapping AS (
  SELECT c_custkey::INT AS old, (c_custkey + 700)::INT AS new FROM customer WHERE c_acctbal < 0
), judged AS (
  SELECT old, new, CASE WHEN new IN (SELECT c_custkey FROM customer) THEN 409 ELSE 200 END AS code
  FROM mapping
)"""


def _renumber(spark: SparkSession, d: str) -> tuple[dict[str, DataFrame], DataFrame]:
    tables = {n: i.table(spark, d, n) for n in ("customer", "orders", "lineitem")}
    mapping = tables["customer"].where("c_acctbal < 0").select(
        F.col("c_custkey").cast("int").alias("old"), (F.col("c_custkey") + 700).cast("int").alias("new")
    )
    return renumber(tables, "customer", "c_custkey", mapping, _GRAPH)


@query(f"""WITH {_MAPPING_SQL}
SELECT o_orderkey, coalesce(new, o_custkey) AS o_custkey
FROM orders LEFT JOIN judged ON old = o_custkey AND code = 200""")
def q21_renumber(spark: SparkSession, d: str) -> DataFrame:
    return _renumber(spark, d)[0]["orders"].select("o_orderkey", "o_custkey")


@query(f"WITH {_MAPPING_SQL} SELECT old, new, CAST(code AS BIGINT) AS code FROM judged")
def q40_renumber_outcomes(spark: SparkSession, d: str) -> DataFrame:
    return _renumber(spark, d)[1].withColumn("code", F.col("code").cast("bigint"))
