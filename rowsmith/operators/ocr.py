"""OCR items: from result rows to a replacement plan per image."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.geometry import (
    choose_box, coord_space, det_scale, map_box, map_poly,
)
from ..functions.text import HANGUL, keep_script, strip_space
from ..session import Stage, no_stage
from .skew import join_facts

TranslateFn = Callable[[Iterable], Iterable]


def ocr_items(df: DataFrame, *keep: str) -> DataFrame:
    """One row per recognized text: keep columns, pos, text, poly, box (null where missing).

    The texts array decides how many items there are. Each entry is put together before
    the arrays are spread over rows, so that no row carries more than its own item.
    """

    def entry(text: Column, i: Column) -> Column:
        return F.struct(
            text.alias("text"), F.get("rec_polys", i).alias("poly"),
            F.get("rec_boxes", i).alias("box"),
        )

    # The outer form: the inner one makes Spark filter on the size of the array first, and
    # that filter would build all entries once more, below the columns they come from.
    entries = F.posexplode_outer(F.transform("rec_texts", entry)).alias("pos", "_e")
    spread = df.select(*keep, entries).where(F.col("pos").isNotNull())
    return spread.select(*keep, "pos", "_e.text", "_e.poly", "_e.box")


def place_items(items: DataFrame) -> DataFrame:
    """Give each item its `bbox`; items with neither box nor polygon are dropped."""
    placed = items.withColumn("bbox", choose_box("box", "poly")).drop("box")
    return placed.where(F.col("bbox").isNotNull())


def placed_images(
    images: DataFrame, *keep: str, char_class: str = HANGUL
) -> DataFrame:
    """Placed and cleaned items of whole images, with the image's space and scale.

    `images` has one row per image: the result arrays, width, height, limit_type and
    limit_side_len. Everything about an image stays in its row until the items are
    spread at the end, so there is nothing to group or to join back, and each text is
    cleaned once.
    """

    def entry(text: Column, i: Column) -> Column:
        poly, box = F.get("rec_polys", i), F.get("rec_boxes", i)
        return F.struct(
            i.alias("pos"), text.alias("text"), keep_script(text, char_class).alias("ko"),
            poly.alias("poly"), choose_box(box, poly).alias("bbox"),
        )

    def largest(side: str) -> Column:
        return F.array_max(F.transform("_items", lambda e: e["bbox"][side]))

    rows = images.withColumn("_items", F.transform("rec_texts", entry)).select(
        *keep, "_items",
        coord_space(largest("x2"), largest("y2"), "width", "height").alias("space"),
        det_scale("width", "height", "limit_type", "limit_side_len").alias("scale"),
    )
    # The outer form, for the same reason as in `ocr_items`.
    spread = rows.select(*keep, "space", "scale", F.inline_outer("_items"))
    return spread.where(F.col("bbox").isNotNull())


def image_facts(items: DataFrame, images: DataFrame, image_id: str = "image_id") -> DataFrame:
    """Coordinate space and detector scale of each image.

    For items that come as rows; `placed_images` needs no grouping. `images` has
    (image_id, width, height, limit_type, limit_side_len). The space is judged over all
    items, whatever their text. The largest sides are partial
    aggregates, so an image with very many items costs no more.
    """
    sides = items.groupBy(image_id).agg(
        F.max("bbox.x2").alias("_max_x"), F.max("bbox.y2").alias("_max_y")
    )
    return images.join(sides, image_id, "left").select(
        image_id,
        coord_space("_max_x", "_max_y", "width", "height").alias("space"),
        det_scale("width", "height", "limit_type", "limit_side_len").alias("scale"),
    )


def translations(
    items: DataFrame, fn: TranslateFn, ko: str = "ko", stage: Stage = no_stage
) -> tuple[DataFrame, DataFrame]:
    """What `fn` makes of each distinct non-empty string, and where it did not answer once.

    The first frame has (ko, en), one row per answered string, the smallest answer of several. The
    second has (ko, problem): missing, doubled, or not asked for. `stage` may write the answers, so
    that the function runs once for both.
    """
    strings = items.where(F.col(ko) != "").select(F.col(ko).alias("ko")).distinct()
    answers = stage(strings.mapInPandas(fn, "ko string, en string"))
    counted = answers.groupBy("ko").agg(F.min("en").alias("en"), F.count(F.lit(1)).alias("_n"))
    both = strings.withColumn("_asked", F.lit(True)).join(counted, "ko", "full_outer")
    problem = (
        F.when(F.col("_asked").isNull(), "not asked for")
        .when(F.col("_n").isNull(), "missing")
        .when(F.col("_n") > 1, "doubled")
    )
    problems = both.select("ko", problem.alias("problem")).where("problem IS NOT NULL")
    return counted.select("ko", "en"), problems


def translate_distinct(
    items: DataFrame, dictionary: DataFrame | None = None, fn: TranslateFn | None = None,
    ko: str = "ko", en: str = "en", stage: Stage = no_stage,
) -> DataFrame:
    """Translate each distinct non-empty string once and attach it to all its items.

    Either `dictionary` has one row (ko, en) per string, or `fn` maps pandas frames with
    the column ko to frames with (ko, en); it runs once per partition of the distinct
    strings, so a model is loaded once there. Items are never multiplied by a string that `fn`
    answers twice; `translations` reports such strings. Translations are trimmed.

    With `fn` the items are read for the strings and for the result: `stage` may write them, so
    that they are cleaned once.
    """
    if (dictionary is None) == (fn is None):
        raise ValueError("give a dictionary or a function")
    if dictionary is None:
        items = stage(items)
        dictionary, _ = translations(items, fn, ko)
    words = dictionary.where("ko <> ''").select(F.col("ko").alias("_ko"), strip_space("en").alias(en))
    both = join_facts(items, words, [ko], ["_ko"], "left")
    return both.select(*[items[c] for c in items.columns], en)


def drop_untranslated(items: DataFrame, ko: str = "ko", en: str = "en") -> DataFrame:
    return items.where((F.col(ko) != "") & (F.coalesce(en, F.lit("")) != ""))


def run_counters(
    items: DataFrame, image_id: str = "image_id", ko: str = "ko", en: str = "en"
) -> DataFrame:
    """Items replaced and distinct strings looked up per image, from the translated items.

    A string whose translation is empty was looked up; the empty string was not.
    """
    wanted = F.col(ko) != ""
    return items.groupBy(image_id).agg(
        F.count_if(wanted & (F.coalesce(en, F.lit("")) != "")).alias("replaced"),
        F.count_distinct(F.when(wanted, F.col(ko))).alias("looked_up"),
    )


def replacement_plan(
    items: DataFrame, dictionary: DataFrame | None = None, fn: TranslateFn | None = None,
    image_id: str = "image_id", stage: Stage = no_stage,
) -> DataFrame:
    """What to erase and write on each image.

    `items` are those of `placed_images`, or placed item rows with `ko` joined to
    `image_facts`. The polygon is erased when it has at least four points, else the
    rectangle.
    """
    worded = drop_untranslated(translate_distinct(items.where(F.col("ko") != ""), dictionary, fn, stage=stage))
    mapped = worded.select(
        image_id, "pos", "ko", "en",
        map_box("bbox", "space", "scale").alias("b"),
        F.when(F.size("poly") >= 4, map_poly("poly", "space", "scale")).alias("polygon"),
    )
    return mapped.select(
        image_id, "pos",
        F.when(F.col("polygon").isNotNull(), "polygon").otherwise("rectangle").alias("shape"),
        "polygon", "b.x1", "b.y1", "b.x2", "b.y2",
        F.greatest(F.lit(1), F.col("b.x2") - F.col("b.x1")).alias("width"),
        F.greatest(F.lit(1), F.col("b.y2") - F.col("b.y1")).alias("height"),
        "ko", "en",
    )
