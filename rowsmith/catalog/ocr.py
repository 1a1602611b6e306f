"""Text cleaning, geometry, translation and replacement plans."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.geometry import choose_box, coord_space, det_scale, map_box, map_poly
from ..functions.text import keep_script, output_name, stem, uri_path
from ..operators.ocr import (
    drop_untranslated, image_facts, ocr_items, place_items, placed_images, replacement_plan,
    run_counters, translate_distinct,
)
from ..sources.contents import write_contents
from ..sources.ocr_files import latest_file, match_files, path_tail, read_ocr_columnar, read_ocr_list
from ..sources.tables import write_json
from ..session import tune
from . import inputs as i

QUERIES, ORACLE = {}, {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__] = lambda spark, folder: f(tune(spark), folder)
        ORACLE[f.__name__] = sql
        return f

    return register


@query(f"""WITH {i.SHAPES_SQL} SELECT vec_id, x1, y1, x2, y2 FROM boxed""")
def q24_bbox(spark: SparkSession, d: str) -> DataFrame:
    placed = i.shapes(spark, d).withColumn("b", choose_box("box", "poly"))
    return placed.select("vec_id", "b.x1", "b.y1", "b.x2", "b.y2")


@query(f"""WITH {i.WORDS_SQL}
SELECT doc_id, CAST(count(*) AS BIGINT) AS items,
       CAST(count(*) FILTER (pos < n // 2) AS BIGINT) AS boxes,
       CAST(sum(pos * length(text)) AS BIGINT) AS weight,
       sum(pos * 4.5::DOUBLE + w * 5 + 2.5::DOUBLE
         + CASE WHEN w > 3 THEN pos * 1.5::DOUBLE + w + 2.5::DOUBLE ELSE 0 END) AS corners
FROM items GROUP BY doc_id""")
def q25_items(spark: SparkSession, d: str) -> DataFrame:
    items = ocr_items(i.ocr_documents(spark, d), "doc_id")
    return items.groupBy("doc_id").agg(
        F.count(F.lit(1)).cast("bigint").alias("items"),
        F.count("box").cast("bigint").alias("boxes"),
        F.sum(F.col("pos").cast("bigint") * F.char_length("text")).cast("bigint").alias("weight"),
        F.sum(F.aggregate(F.flatten("poly"), F.lit(0.0), lambda a, v: a + v)).alias("corners"),
    )


@query(f"""SELECT p_partkey, {i.SCALE_SQL} AS scale FROM (
  SELECT p_partkey, p_size * 40.0::DOUBLE AS width, floor(p_retailprice) AS height,
         CASE p_type WHEN 'ECONOMY' THEN 'min' WHEN 'STANDARD' THEN 'max' WHEN 'PROMO' THEN 'fit' END
           AS limit_type,
         CASE WHEN p_size < 45 THEN 1000.0::DOUBLE WHEN p_size < 48 THEN 0 END AS limit_side_len
  FROM part)""")
def q26_scale(spark: SparkSession, d: str) -> DataFrame:
    kind = F.col("p_type")
    limit_type = (
        F.when(kind == "ECONOMY", "min").when(kind == "STANDARD", "max").when(kind == "PROMO", "fit")
    )
    limit = F.when(F.col("p_size") < 45, 1000.0).when(F.col("p_size") < 48, 0.0)
    scale = det_scale(F.col("p_size") * 40, F.floor("p_retailprice"), limit_type, limit)
    return i.table(spark, d, "part").select("p_partkey", scale.alias("scale"))


@query(f"""WITH {i.SHAPES_SQL}
SELECT label, max(x2) AS max_x, max(y2) AS max_y,
       CASE WHEN max(x2) <= (300 + label * 20) * 1.10::DOUBLE AND max(y2) <= 400 * 1.10::DOUBLE
            THEN 'orig' ELSE 'scaled' END AS space
FROM boxed GROUP BY label""")
def q27_space(spark: SparkSession, d: str) -> DataFrame:
    placed = place_items(i.shapes(spark, d))
    sides = placed.groupBy("label").agg(
        F.max("bbox.x2").alias("max_x"), F.max("bbox.y2").alias("max_y")
    )
    space = coord_space("max_x", "max_y", F.lit(300) + F.col("label") * 20, F.lit(400))
    return sides.withColumn("space", space)


_MAPPED_SQL = f"""{i.SHAPES_SQL}, scaled AS (
  SELECT *, CASE WHEN label = 0 THEN 1.0::DOUBLE WHEN label = 1 THEN 1.0::DOUBLE
                 ELSE label / 4.0::DOUBLE END AS s FROM boxed
)"""


@query(f"""WITH {_MAPPED_SQL}
SELECT vec_id, round_even(x1 / s, 0)::INT AS x1, round_even(y1 / s, 0)::INT AS y1,
       round_even(x2 / s, 0)::INT AS x2, round_even(y2 / s, 0)::INT AS y2,
       list_sum([round_even(v / s, 0)::BIGINT FOR v IN xs])::BIGINT AS sum_x,
       list_sum([round_even(v / s, 0)::BIGINT FOR v IN ys])::BIGINT AS sum_y
FROM scaled""")
def q28_map(spark: SparkSession, d: str) -> DataFrame:
    space = F.when(F.col("label") == 1, "orig").otherwise("scaled")
    placed = place_items(i.shapes(spark, d)).select(
        "*", space.alias("space"), (F.col("label") / F.lit(4.0)).alias("scale")
    )
    mapped = placed.select(
        "vec_id", map_box("bbox", "space", "scale").alias("b"),
        map_poly("poly", "space", "scale").alias("p"),
    )

    def total(axis: str):
        return F.aggregate(f"p.{axis}", F.lit(0).cast("bigint"), lambda a, v: a + v)

    return mapped.select(
        "vec_id", "b.x1", "b.y1", "b.x2", "b.y2", total("x").alias("sum_x"),
        total("y").alias("sum_y"),
    )


@query(f"SELECT doc_id, {i.clean_sql('text')} AS text FROM documents")
def q29_text(spark: SparkSession, d: str) -> DataFrame:
    docs = i.documents(spark, d, "text")
    return docs.select("doc_id", keep_script("text", i.LETTERS).alias("text"))


_WORDED_SQL = f"""{i.WORDS_SQL}, {i.DICTIONARY_SQL}, cleaned AS (
  SELECT *, {i.clean_sql('text')} AS clean FROM items
), worded AS (
  SELECT c.*, regexp_replace(en, '^[{i.SPACES}]+|[{i.SPACES}]+$', '', 'g') AS tr FROM cleaned c LEFT JOIN dictionary ON ko = clean
)"""


def _worded(spark: SparkSession, d: str) -> DataFrame:
    items = ocr_items(i.ocr_documents(spark, d), "doc_id")
    return items.withColumn("ko", keep_script("text", i.LETTERS))


@query(f"""WITH {_WORDED_SQL}
SELECT clean AS ko, tr AS en, CAST(count(*) AS BIGINT) AS n FROM worded
WHERE clean <> '' AND coalesce(tr, '') <> '' GROUP BY ALL""")
def q30_translate(spark: SparkSession, d: str) -> DataFrame:
    done = drop_untranslated(translate_distinct(_worded(spark, d), i.dictionary(spark, d)))
    return done.groupBy("ko", "en").agg(F.count(F.lit(1)).cast("bigint").alias("n"))


@query(f"""WITH {_WORDED_SQL}
SELECT doc_id, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT upper(clean)) AS BIGINT) AS words,
       max(upper(clean)) AS last
FROM worded WHERE clean <> '' GROUP BY doc_id""")
def q42_translate_fn(spark: SparkSession, d: str) -> DataFrame:
    # A local function travels by value: workers need not have this package.
    def capitals(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"ko": frame["ko"], "en": " " + frame["ko"].str.upper()})

    # The stage writes what it is given: places of words are not asked for here.
    words = _worded(spark, d).select("doc_id", "ko")
    done = drop_untranslated(translate_distinct(words, fn=capitals, stage=i.stage(spark)))
    return done.groupBy("doc_id").agg(
        F.count(F.lit(1)).cast("bigint").alias("n"),
        F.count_distinct("en").cast("bigint").alias("words"), F.max("en").alias("last"),
    )


@query(f"""WITH {_WORDED_SQL}, {i.PLACED_SQL}, {i.IMAGES_SQL}, facts AS (
  SELECT m.doc_id, {i.SCALE_SQL} AS scale,
         CASE WHEN coalesce(max(x2) <= width * 1.10::DOUBLE AND max(y2) <= height * 1.10::DOUBLE, true)
              THEN 'orig' ELSE 'scaled' END AS space
  FROM images m LEFT JOIN placed p ON p.doc_id = m.doc_id
  GROUP BY m.doc_id, width, height, limit_type, limit_side_len
), mapped AS (
  SELECT p.doc_id, p.pos, quad, clean AS ko, tr AS en,
         CASE WHEN space = 'orig' OR scale = 0 THEN 1.0::DOUBLE ELSE scale END AS s,
         x, p.w, x1, y1, x2, y2
  FROM placed p JOIN worded USING (doc_id, pos) JOIN facts f ON f.doc_id = p.doc_id
  WHERE clean <> '' AND coalesce(tr, '') <> ''
), rounded AS (
  SELECT doc_id, pos, quad, ko, en, s, x, w, round_even(x1 / s, 0)::INT AS x1, round_even(y1 / s, 0)::INT AS y1,
         round_even(x2 / s, 0)::INT AS x2, round_even(y2 / s, 0)::INT AS y2
  FROM mapped
)
SELECT doc_id, pos, CASE WHEN quad THEN 'polygon' ELSE 'rectangle' END AS shape,
       CASE WHEN quad THEN concat(round_even(x / s, 0)::INT, ',', round_even(w / s, 0)::INT, ' ',
         round_even((x + w) / s, 0)::INT, ',', round_even(w / s, 0)::INT, ' ',
         round_even((x + w) / s, 0)::INT, ',', round_even((w + 2.5::DOUBLE) / s, 0)::INT, ' ',
         round_even(x / s, 0)::INT, ',', round_even((w + 2.5::DOUBLE) / s, 0)::INT) END AS polygon,
       x1, y1, x2, y2, greatest(1, x2 - x1)::INT AS width, greatest(1, y2 - y1)::INT AS height, ko, en
FROM rounded""")
def q31_plan(spark: SparkSession, d: str) -> DataFrame:
    items = placed_images(i.document_images(spark, d), "doc_id", char_class=i.LETTERS)
    plan = replacement_plan(items, i.dictionary(spark, d), image_id="doc_id")
    points = F.transform("polygon", lambda p: F.concat_ws(",", p["x"], p["y"]))
    return plan.withColumns(
        {"polygon": F.array_join(points, " "), "pos": F.col("pos").cast("bigint")}
    )


@query(f"""WITH {i.WORDS_SQL}, {i.PLACED_SQL}, {i.IMAGES_SQL}
SELECT m.doc_id, {i.SCALE_SQL} AS scale,
       CASE WHEN coalesce(max(x2) <= width * 1.10::DOUBLE AND max(y2) <= height * 1.10::DOUBLE, true)
            THEN 'orig' ELSE 'scaled' END AS space
FROM images m LEFT JOIN placed p ON p.doc_id = m.doc_id
GROUP BY m.doc_id, width, height, limit_type, limit_side_len""")
def q45_facts(spark: SparkSession, d: str) -> DataFrame:
    """Space and scale of images whose items come as rows."""
    images = i.document_images(spark, d)
    placed = place_items(ocr_items(images, "doc_id"))
    return image_facts(placed, images, "doc_id").select("doc_id", "scale", "space")


@query(f"""WITH {_WORDED_SQL}
SELECT doc_id, CAST(count(*) FILTER (clean <> '' AND coalesce(tr, '') <> '') AS BIGINT) AS replaced,
       CAST(count(DISTINCT clean) FILTER (clean <> '') AS BIGINT) AS looked_up
FROM worded GROUP BY doc_id""")
def q32_counters(spark: SparkSession, d: str) -> DataFrame:
    items = translate_distinct(_worded(spark, d), i.dictionary(spark, d))
    counted = run_counters(items, "doc_id")
    return counted.select(
        "doc_id", F.col("replaced").cast("bigint").alias("replaced"),
        F.col("looked_up").cast("bigint").alias("looked_up"),
    )


@query("""SELECT user_id, max_by(event_id, {'t': ts, 'e': event_id}) AS event_id
FROM events GROUP BY user_id""")
def q33_latest(spark: SparkSession, d: str) -> DataFrame:
    return latest_file(i.table(spark, d, "events"), "user_id", "event_id", "ts")


@query(r"""WITH named AS (
  SELECT page_id, url, regexp_extract(url, '([^/\\]+)[/\\]*$', 1) AS base FROM pages
), stems AS (
  SELECT page_id, url, CASE WHEN regexp_matches(base, '^.+\.[^.]+$')
    THEN regexp_replace(base, '\.[^.]+$', '') ELSE base END AS stem FROM named
)
SELECT page_id, stem, concat(stem, '_translated_replace_on_original.jpg') AS output,
       array_to_string(list_slice(string_split_regex(url, '[/\\]+'), -2, -1), '/') AS tail
FROM stems""")
def q34_names(spark: SparkSession, d: str) -> DataFrame:
    return i.table(spark, d, "pages").select(
        "page_id", stem("url").alias("stem"), output_name("url").alias("output"),
        path_tail("url", 2).alias("tail"),
    )


@query(r"""WITH named AS (
  SELECT page_id, url, regexp_extract(url, '([^/\\]+)[/\\]*$', 1) AS base,
         regexp_replace(regexp_replace(url, '[/\\]+', '/', 'g'), '^[A-Za-z][A-Za-z0-9+.-]+:/', '/') AS whole
  FROM pages
), counted AS (
  SELECT page_id, count(*) OVER (PARTITION BY base) AS same_base, count(*) OVER (PARTITION BY whole) AS same_whole
  FROM named
)
SELECT page_id, CASE WHEN same_whole = 1 THEN page_id END AS by_path, same_whole > 1 AS path_twice,
       CASE WHEN same_base = 1 THEN page_id END AS by_name, same_base > 1 AS name_twice
FROM counted""")
def q46_match_files(spark: SparkSession, d: str) -> DataFrame:
    """Pages matched to files by full path, written in another way, and by name."""
    pages = i.table(spark, d, "pages").select("page_id", "url")
    files = pages.select(
        F.col("page_id").alias("file_id"),
        F.regexp_replace(F.regexp_replace("url", "^https?:", "store:"), "/", r"\\\\").alias("path"),
    )
    by_path = match_files(pages, files, "url")
    by_path = by_path.select("page_id", "url", F.col("file.file_id").alias("by_path"), F.col("same_name").alias("path_twice"))
    by_name = match_files(by_path, files, "url", by_name=True)
    return by_name.select(
        "page_id", "by_path", "path_twice", F.col("file.file_id").alias("by_name"), F.col("same_name").alias("name_twice")
    )


@query(r"""WITH named AS (
  SELECT page_id, url, concat(regexp_replace(url, '^https?:', 'store:'), '/차림 표+', page_id % 7, '%41.json') AS path FROM pages
)
SELECT page_id, path, count(*) OVER (PARTITION BY path) = 1 AS found FROM named""")
def q53_uri_paths(spark: SparkSession, d: str) -> DataFrame:
    """Paths with blanks, Hangul, + and % matched to the URIs by which Spark names the files."""
    name = F.concat(F.lit("/차림 표+"), (F.col("page_id") % 7).cast("string"), F.lit("%41.json"))
    pages = i.table(spark, d, "pages").select(
        "page_id", F.concat(F.regexp_replace("url", "^https?:", "store:"), name).alias("path")
    )
    # A URI has %xx for all signs but these; a blank is no +.
    encoded = F.regexp_replace(F.regexp_replace(F.url_encode("path"), r"\+", "%20"), "%2B", "+")
    plain = F.regexp_replace(F.regexp_replace(encoded, "%2F", "/"), "%3A", ":")
    files = pages.select(uri_path(plain).alias("path"))
    both = match_files(pages, files, "path")
    return both.select("page_id", "path", F.col("file").isNotNull().alias("found"))


def _result_files(spark: SparkSession, d: str, listed: bool) -> str:
    """A folder with one result file per page, of the words of its url, in one of the two layouts."""
    words = F.filter(F.split("url", r"[/.:_-]+"), lambda w: w != "")
    # Files are dealt out by their key, however the table is split; lines of one page and split are one file.
    pages = i.table(spark, d, "pages").select("page_id", "url", F.spark_partition_id().alias("split"))
    dealt = pages.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "split", "page_id")
    pages = dealt.sortWithinPartitions("split", "page_id").select("page_id", "split", words.alias("words"))
    number = lambda n: n.cast("double")

    def box(w, n):
        return F.array(number(n) * 10 + 0.5, number(n), number(n) * 10 + 8, number(n) + F.length(w))

    def poly(w, n):
        b = box(w, n)
        return F.array(F.array(b[0], b[1]), F.array(b[2], b[1]), F.array(b[2], b[3]), F.array(b[0], b[3]))

    if listed:
        entry = F.transform("words", lambda w, n: F.struct(w.alias("text"), F.lit(0.5).alias("confidence"), poly(w, n).alias("bbox")))
        body = F.to_json(entry)
    else:
        # Every third page has no boxes, every other box is short.
        boxes = F.transform("words", lambda w, n: F.when(n % 2 == 0, box(w, n)).otherwise(F.array(number(n))))
        side = F.struct(F.lit("min").alias("limit_type"), F.col("page_id").cast("double").alias("limit_side_len"))
        body = F.to_json(F.struct(
            F.col("words").alias("rec_texts"), F.transform("words", poly).alias("rec_polys"),
            F.when(F.col("page_id") % 3 > 0, boxes).alias("rec_boxes"), side.alias("text_det_params"),
        ))
    folder = i.scratch(spark, "results")
    page = F.coalesce(F.col("page_id").cast("string"), F.lit("null"))
    name = F.concat(F.lit("page_id="), page, F.lit("-"), "split", F.lit(".json"))
    write_contents(pages.select(name.alias("name"), body.alias("content")), folder)
    return folder


def _page_id() -> Column:
    return F.regexp_extract("path", r"/page_id=(\d+)-\d+\.json$", 1).cast("bigint").alias("page_id")


_FILES_SQL = """WITH w AS (
  SELECT page_id, unnest(list_filter(string_split_regex(url, '[/.:_-]+'), lambda x: x <> '')) AS text,
         generate_subscripts(list_filter(string_split_regex(url, '[/.:_-]+'), lambda x: x <> ''), 1) - 1 AS pos
  FROM pages
)
"""


@query(_FILES_SQL + """SELECT page_id, CAST(pos AS BIGINT) AS pos, text,
  CASE WHEN page_id % 3 > 0 AND pos % 2 = 0 THEN pos * 10 + 0.5::DOUBLE ELSE pos * 10 END::DOUBLE AS x1,
  CAST(pos AS DOUBLE) AS y1, CAST(pos * 10 + 8 AS DOUBLE) AS x2, CAST(pos + length(text) AS DOUBLE) AS y2,
  CAST(page_id AS DOUBLE) AS side FROM w""")
def q56_read_columnar(spark: SparkSession, d: str) -> DataFrame:
    """Result files of parallel arrays, written and read back: boxes where they are whole, else polygons."""
    read = read_ocr_columnar(spark, _result_files(spark, d, False))
    items = place_items(ocr_items(read, "path", "text_det_params"))
    return items.select(
        _page_id(), F.col("pos").cast("bigint").alias("pos"), "text",
        "bbox.x1", "bbox.y1", "bbox.x2", "bbox.y2", F.col("text_det_params.limit_side_len").alias("side"),
    )


@query(_FILES_SQL + """SELECT page_id, CAST(pos AS BIGINT) AS pos, text, 0.5::DOUBLE AS confidence,
  CAST(pos * 10 AS DOUBLE) AS x1, CAST(pos + length(text) AS DOUBLE) AS y2 FROM w""")
def q57_read_list(spark: SparkSession, d: str) -> DataFrame:
    """Result files that are lists of entries, written and read back."""
    items = place_items(read_ocr_list(spark, _result_files(spark, d, True)))
    return items.select(
        _page_id(), F.col("pos").cast("bigint").alias("pos"), "text", "confidence", "bbox.x1", "bbox.y2"
    )


@query("""SELECT c_custkey, c_name, CAST(CASE WHEN c_nationkey > 9 THEN c_nationkey END AS INT) AS nation,
  concat('메뉴 "', c_mktsegment, '" é') AS text FROM customer""")
def q58_write_json(spark: SparkSession, d: str) -> DataFrame:
    """Rows written as JSON lines, read back as text: every line has every key, and text as it is."""
    text = F.concat(F.lit('메뉴 "'), "c_mktsegment", F.lit('" é'))
    rows = i.table(spark, d, "customer").select(
        "c_custkey", "c_name", F.when(F.col("c_nationkey") > 9, F.col("c_nationkey")).cast("int").alias("nation"), text.alias("text")
    )
    folder = i.scratch(spark, "json")
    write_json(rows, folder)
    lines = spark.read.text(folder).where(F.array_size(F.json_object_keys("value")) == 4)
    read = lines.where(F.col("value").contains("메뉴")).select(F.from_json("value", rows.schema).alias("r"))
    return read.select("r.*")
