"""From OCR files to a replacement plan per image."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, functions as F

from ..functions.text import full_path, keep_script, output_name
from ..operators.ocr import (
    TranslateFn, image_facts, place_items, placed_images, replacement_plan, run_counters,
    translate_distinct,
)
from ..operators.skew import join_facts
from ..session import Stage, no_stage
from ..sources.ocr_files import match_files, pair_runs


def run_images(
    manifests: DataFrame, results: DataFrame, sizes: DataFrame,
    roots: Mapping[str, str] | None = None, by_name: bool = False,
) -> DataFrame:
    """One row per manifest: image, size, limits, result arrays, output file, outcome.

    `results` are rows of `read_ocr_columnar`, `sizes` of `read_image_sizes`. The image is known
    by its full path, in `image_id`. A run without result or without image has a reason in
    `outcome` and no arrays; see `match_files` for `roots` and `by_name`.
    """
    runs = pair_runs(manifests, results, roots, by_name).drop("path")
    runs = match_files(runs, sizes, "input_image", "path", roots, by_name)
    outcome = (
        F.when(F.col("outcome") != "ok", F.col("outcome"))
        .when(F.col("same_name"), "several images of this name")
        .when(F.col("file").isNull(), "no image")
        .otherwise(F.coalesce("file.error", F.lit("ok")))
    )
    separator = F.when(F.col("out_dir").contains("\\"), "\\").otherwise("/")
    return runs.select(
        full_path("input_image", roots).alias("image_id"), "file.width", "file.height",
        F.col("text_det_params.limit_type").alias("limit_type"),
        F.col("text_det_params.limit_side_len").alias("limit_side_len"),
        "rec_texts", "rec_polys", "rec_boxes",
        F.concat("out_dir", separator, output_name("input_image")).alias("output"),
        outcome.alias("outcome"),
    )


def plan_runs(
    runs: DataFrame, dictionary: DataFrame | None = None, fn: TranslateFn | None = None,
    stage: Stage = no_stage,
) -> DataFrame:
    """Replacement plan of the runs that `run_images` gives with outcome ok."""
    items = placed_images(runs.where("outcome = 'ok'"), "image_id")
    return replacement_plan(items, dictionary, fn, stage=stage)


def plan_entries(
    items: DataFrame, images: DataFrame, dictionary: DataFrame | None = None,
    fn: TranslateFn | None = None, stage: Stage = no_stage,
) -> DataFrame:
    """Replacement plan from item rows with an image id, as the list layout gives them."""
    placed = place_items(items).withColumn("ko", keep_script("text"))
    facts = image_facts(placed, images).withColumnRenamed("image_id", "_image")
    whole = join_facts(placed, facts, ["image_id"], ["_image"]).drop("_image")
    return replacement_plan(whole, dictionary, fn, stage=stage)


def count_runs(
    runs: DataFrame, dictionary: DataFrame | None = None, fn: TranslateFn | None = None,
    stage: Stage = no_stage,
) -> DataFrame:
    """Items replaced and strings looked up, for every run, also those without items or result.

    A manifest that could not be read has no image, and its row no counts to find.
    """
    items = placed_images(runs.where("outcome = 'ok'"), "image_id").select("image_id", "ko")
    counted = run_counters(translate_distinct(items, dictionary, fn, stage=stage))
    return runs.select("image_id", "output", "outcome").join(counted, "image_id", "left").select(
        "image_id", "output",
        F.coalesce("replaced", F.lit(0)).alias("replaced"),
        F.coalesce("looked_up", F.lit(0)).alias("looked_up"), "outcome",
    )
