"""Request batches and OCR items that Spark derives from the driver's tables.

The SQL text of each input is the same thing for the oracle, as a common table expression.
"""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.text import keep_script
from ..session import Stage, checkpoint_stage, no_stage

# Events before this moment are the table that exists, the later ones are requests.
CUT = "2024-01-02 00:00:00"
NOW = "2026-01-15 09:30:00"
BEFORE = "2020-01-01 00:00:00"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def stage(spark: SparkSession) -> Stage:
    """Intermediate results go to the shared folder if the session has one."""
    return checkpoint_stage(spark) if spark.conf.get("spark.checkpoint.dir", None) else no_stage


def scratch(spark: SparkSession, kind: str) -> str:
    """A new folder below the shared one."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base}/{kind}-{uuid4()}"


# -- events as requests -----------------------------------------------------------

K = "CAST(json_extract_string(props, '$.k') AS BIGINT)"

REQUESTS_SQL = f"""
requests AS (
  SELECT event_id AS seq, ts, user_id, event_type, value, {K} AS k,
         user_id * 20 + {K} AS target_id
  FROM events
)"""


def requests(spark: SparkSession, folder: str) -> DataFrame:
    """Events as requests on customers; some targets exist, many are asked for often."""
    return as_requests(table(spark, folder, "events"))


def as_requests(events: DataFrame) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("bigint")
    return events.select(
        F.col("event_id").alias("seq"), "ts", "user_id", "event_type", "value", k.alias("k"),
        (F.col("user_id") * 20 + k).alias("target_id"),
    )


PAIRS_SQL = f"""
pairs AS (
  SELECT event_id, ts, user_id * 20 + {K} % 2 AS user_id, event_type, value FROM events
), existing AS (
  SELECT user_id, event_type, min(event_id) AS id
  FROM pairs WHERE ts < TIMESTAMP '{CUT}' GROUP BY user_id, event_type
), arriving AS (
  SELECT event_id AS seq, user_id, event_type, value
  FROM pairs WHERE ts >= TIMESTAMP '{CUT}'
)"""


def pairs(events: DataFrame) -> DataFrame:
    """Events as a customer and a kind; many pairs occur often, and many customers don't exist."""
    k = F.get_json_object("props", "$.k").cast("bigint")
    return events.select(
        "event_id", "ts", (F.col("user_id") * 20 + k % 2).alias("user_id"), "event_type", "value"
    )


def existing(spark: SparkSession, folder: str) -> DataFrame:
    early = pairs(table(spark, folder, "events")).where(F.col("ts") < F.lit(CUT).cast("timestamp_ntz"))
    return early.groupBy("user_id", "event_type").agg(F.min("event_id").alias("id"))


def arriving(spark: SparkSession, folder: str) -> DataFrame:
    return late(pairs(table(spark, folder, "events")))


def late(events: DataFrame) -> DataFrame:
    """The pairs that arrive after the cut, as requests."""
    events = events.where(F.col("ts") >= F.lit(CUT).cast("timestamp_ntz"))
    return events.select(F.col("event_id").alias("seq"), "user_id", "event_type", "value")


BODY_SQL = """
bodies AS (
  SELECT seq, target_id, CASE event_type
    WHEN 'view' THEN '{}'
    WHEN 'click' THEN concat('{"c_nationkey": ', k, '}')
    WHEN 'signup' THEN '{"c_mktsegment": null, "other": 1}'
    WHEN 'purchase' THEN concat('{"c_mktsegment": "SEG', k, '", "c_nationkey": null}')
    ELSE CASE WHEN k < 25 THEN 'not json' WHEN k < 50 THEN '[1]'
              WHEN k < 75 THEN '{"c_mktsegment": 5}' ELSE '{"c_nationkey": "7"}' END
    END AS body
  FROM requests
), parsed AS (
  SELECT seq, target_id, json_valid(body) AS is_json,
         CASE WHEN json_valid(body) THEN body ELSE 'null' END AS doc
  FROM bodies
), patches AS (
  SELECT seq, target_id, is_json,
         is_json AND json_type(doc) = 'OBJECT'
           AND coalesce(json_type(doc, '$.c_mktsegment') IN ('VARCHAR', 'NULL'), true) AS body_ok,
         coalesce(list_contains(json_keys(doc), 'c_nationkey'), false) AS set_c_nationkey,
         CAST(json_extract_string(doc, '$.c_nationkey') AS BIGINT) AS new_c_nationkey,
         coalesce(list_contains(json_keys(doc), 'c_mktsegment'), false) AS set_c_mktsegment,
         json_extract_string(doc, '$.c_mktsegment') AS new_c_mktsegment
  FROM parsed
)"""


def patch_bodies(spark: SparkSession, folder: str) -> DataFrame:
    """Requests with a JSON body: empty, null, wrong type, not JSON, repeated keys, plain values."""
    k = F.col("k")
    body = (
        F.when(F.col("event_type") == "view", "{}")
        .when(F.col("event_type") == "click", F.concat(F.lit('{"c_nationkey": '), k, F.lit("}")))
        .when(F.col("event_type") == "signup", '{"c_mktsegment": "first", "c_mktsegment": null, "other": 1}')
        .when(
            F.col("event_type") == "purchase",
            F.concat(F.lit('{"c_mktsegment": "SEG'), k, F.lit('", "c_nationkey": null}')),
        )
        .when(k < 25, "not json")
        .when(k < 50, "[1]")
        .when(k < 75, '{"c_mktsegment": 5}')
        .otherwise('{"c_nationkey": "7"}')
    )
    return requests(spark, folder).select("seq", "target_id", body.alias("body"))


NAMES_SQL = """
named AS (
  SELECT seq, target_id, k, event_type,
         CASE WHEN event_type IN ('view', 'click')
              THEN concat('CUSTOMER#', lpad(CAST(target_id AS VARCHAR), 9, '0'))
              ELSE concat('customer#', lpad(CAST(target_id AS VARCHAR), 9, '0')) END AS name
  FROM requests
)"""


def named(spark: SparkSession, folder: str) -> DataFrame:
    """Requests that give the customer by name, in upper or lower case."""
    digits = F.lpad(F.col("target_id").cast("string"), 9, "0")
    upper = F.col("event_type").isin("view", "click")
    name = F.concat(F.when(upper, "CUSTOMER#").otherwise("customer#"), digits)
    return requests(spark, folder).select("seq", "target_id", "k", "event_type", name.alias("name"))


def documents(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """Documents dealt out by their key, as work on words costs far more than moving the text.

    Always into as many parts as the session shuffles into, however the file is split.
    """
    docs = table(spark, folder, "documents").select("doc_id", *columns)
    return docs.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "doc_id")


# -- documents and embeddings as OCR results --------------------------------------

# The character class stands in for a script: the documents hold Latin text only.
LETTERS = "a-zé"
# White space as the text cleaning sees it, for an engine whose \s is ASCII only.
SPACES = (
    r"\x{09}-\x{0d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)


def clean_sql(column: str) -> str:
    kept = f"regexp_replace({column}, '[^{LETTERS}{SPACES}]+', '', 'g')"
    return f"coalesce(trim(regexp_replace({kept}, '[{SPACES}]+', ' ', 'g')), '')"


WORDS_SQL = r"""
docs AS (
  SELECT doc_id, lang, string_split_regex(text, '[ \n\t\r]+') AS words, n_chars FROM documents
), items AS (
  SELECT doc_id, lang, n_chars, word AS text, CAST(pos - 1 AS BIGINT) AS pos, len(words) AS n,
         CAST(length(word) AS DOUBLE) AS w
  FROM (SELECT doc_id, lang, n_chars, words, unnest(words) AS word,
               unnest(range(1, len(words) + 1)) AS pos FROM docs)
)"""


def ocr_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as OCR results: a text per word, polygons for all, boxes for the first half.

    The place of a word is its position and length, in half pixels.
    """
    docs = documents(spark, folder, "text", "lang", "n_chars")
    words = F.split("text", r"[ \n\t\r]+")
    rows = docs.select("doc_id", "lang", "n_chars", words.alias("rec_texts"))

    def box(word: Column, i: Column) -> Column:
        x, w = i.cast("double") * 1.5, F.char_length(word).cast("double")
        return F.array(x, w + 0.5, x + w * 2.5, w * 3.0)

    def poly(word: Column, i: Column) -> Column:
        x, w = i.cast("double") * 1.5, F.char_length(word).cast("double")
        corners = F.array(F.array(x, w), F.array(x + w, w), F.array(x + w, w + 2.5))
        return F.when(w > 3, F.concat(corners, F.array(F.array(x, w + 2.5)))).otherwise(corners)

    half = F.slice("rec_texts", F.lit(1), F.floor(F.size("rec_texts") / 2).cast("int"))
    return rows.select(
        "*", F.transform("rec_texts", poly).alias("rec_polys"),
        F.transform(half, box).alias("rec_boxes"),
    )


PLACED_SQL = """
placed AS (
  SELECT doc_id, lang, n_chars, pos, text, w > 3 AS quad, w,
         pos * 1.5::DOUBLE AS x,
         CASE WHEN pos < n // 2 THEN pos * 1.5::DOUBLE ELSE trunc(pos * 1.5::DOUBLE) END AS x1,
         CASE WHEN pos < n // 2 THEN w + 0.5::DOUBLE ELSE w END AS y1,
         CASE WHEN pos < n // 2 THEN pos * 1.5::DOUBLE + w * 2.5::DOUBLE
              ELSE trunc(pos * 1.5::DOUBLE + w) END AS x2,
         CASE WHEN pos < n // 2 THEN w * 3.0::DOUBLE ELSE trunc(w + 2.5::DOUBLE) END AS y2
  FROM items
)"""


DICTIONARY_SQL = f"""
dictionary AS (
  SELECT ko, max(CASE WHEN length(ko) <= 2 THEN chr(10) ELSE concat(chr(9), upper(ko), chr(12288), chr(10)) END) AS en
  FROM (SELECT {clean_sql('word')} AS ko
        FROM (SELECT unnest(string_split_regex(text, '[ \\n\\t\\r]+')) AS word FROM benchmark))
  WHERE ko <> '' GROUP BY ko
)"""


def dictionary(spark: SparkSession, folder: str) -> DataFrame:
    """The words of the benchmark texts, translated to capitals; short ones to white space."""
    texts = table(spark, folder, "benchmark")
    words = texts.select(F.explode(F.split("text", r"[ \n\t\r]+")).alias("word"))
    words = words.select(keep_script("word", LETTERS).alias("ko"))
    short = F.char_length("ko") <= 2
    en = F.when(short, "\n").otherwise(F.concat(F.lit("\t"), F.upper("ko"), F.lit("\u3000\n")))
    return words.where("ko <> ''").distinct().withColumn("en", en)


IMAGES_SQL = """
images AS (
  SELECT doc_id, CAST(n_chars // 4 AS DOUBLE) AS width, CAST(40 AS DOUBLE) AS height,
         CASE lang WHEN 'en' THEN 'max' WHEN 'fr' THEN 'min' END AS limit_type,
         CAST(1000 AS DOUBLE) AS limit_side_len
  FROM documents
)"""


def document_images(spark: SparkSession, folder: str) -> DataFrame:
    """The documents as OCR results with an image size and detector limits."""
    limit_type = F.when(F.col("lang") == "en", "max").when(F.col("lang") == "fr", "min")
    return ocr_documents(spark, folder).select(
        "*", F.floor(F.col("n_chars") / 4).cast("int").alias("width"),
        F.lit(40).alias("height"), limit_type.alias("limit_type"),
        F.lit(1000).alias("limit_side_len"),
    )


SCALE_SQL = """CASE
    WHEN coalesce(limit_side_len, 0) <= 0 THEN 1.0::DOUBLE
    WHEN coalesce(limit_type, 'max') = 'max' AND greatest(width, height) > limit_side_len
      THEN limit_side_len / greatest(width, height)
    WHEN limit_type = 'min' AND least(width, height) < limit_side_len
      THEN limit_side_len / least(width, height)
    ELSE 1.0::DOUBLE END"""


SHAPES_SQL = """
vectors AS (
  SELECT vec_id, label, list_transform(embedding, lambda v: v::DOUBLE * 1000) AS e FROM embeddings
), shapes AS (
  SELECT vec_id, label, e,
         [e[i] FOR i IN range(1, len(e) + 1) IF i % 2 = 1] AS xs,
         [e[i] FOR i IN range(1, len(e) + 1) IF i % 2 = 0] AS ys
  FROM vectors
), boxed AS (
  SELECT *, label < 3 AS given,
         CASE WHEN label < 3 THEN least(e[1], e[-2]) ELSE trunc(list_min(xs)) END AS x1,
         CASE WHEN label < 3 THEN least(e[2], e[-1]) ELSE trunc(list_min(ys)) END AS y1,
         CASE WHEN label < 3 THEN greatest(e[1], e[-2]) ELSE trunc(list_max(xs)) END AS x2,
         CASE WHEN label < 3 THEN greatest(e[2], e[-1]) ELSE trunc(list_max(ys)) END AS y2
  FROM shapes
)"""


def shapes(spark: SparkSession, folder: str) -> DataFrame:
    """Vectors as polygons of all their numbers; four-number boxes for some labels only."""
    e = F.transform("embedding", lambda v: v.cast("double") * 1000)
    rows = table(spark, folder, "embeddings").select("vec_id", "label", e.alias("e"))
    points = F.transform(
        F.sequence(F.lit(0), F.floor(F.size("e") / 2).cast("int") - 1),
        lambda i: F.array(F.get("e", i * 2), F.get("e", i * 2 + 1)),
    )
    xa, ya = F.element_at("e", 1), F.element_at("e", 2)
    xb, yb = F.element_at("e", -2), F.element_at("e", -1)
    box = F.array(F.least(xa, xb), F.least(ya, yb), F.greatest(xa, xb), F.greatest(ya, yb))
    odd = F.array(xa, ya, xb)
    given = F.when(F.col("label") < 3, box).when(F.col("label") < 6, odd)
    return rows.select("vec_id", "label", points.alias("poly"), given.alias("box"))
