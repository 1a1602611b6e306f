"""OCR result files, run manifests and images."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..functions.text import base_name, full_path
from .contents import read_contents
from .listing import files

NUMBERS = T.ArrayType(T.DoubleType())
POINTS = T.ArrayType(NUMBERS)

COLUMNAR = T.StructType(
    [
        T.StructField("rec_texts", T.ArrayType(T.StringType())),
        T.StructField("rec_polys", T.ArrayType(POINTS)),
        T.StructField("rec_boxes", T.ArrayType(NUMBERS)),
        T.StructField(
            "text_det_params",
            T.StructType(
                [
                    T.StructField("limit_type", T.StringType()),
                    T.StructField("limit_side_len", T.DoubleType()),
                ]
            ),
        ),
    ]
)

ENTRIES = T.ArrayType(
    T.StructType(
        [
            T.StructField("text", T.StringType()),
            T.StructField("confidence", T.DoubleType()),
            T.StructField("bbox", POINTS),
        ]
    )
)

MANIFEST = T.StructType(
    [
        T.StructField("input_image", T.StringType()),
        T.StructField("json_path", T.StringType()),
        T.StructField("out_dir", T.StringType()),
        T.StructField(
            "paddleocr_config",
            T.StructType(
                [
                    T.StructField("use_doc_unwarping", T.BooleanType()),
                    T.StructField("use_textline_orientation", T.BooleanType()),
                    T.StructField("det_limit_type", T.StringType()),
                    T.StructField("det_limit_side_len", T.IntegerType()),
                ]
            ),
        ),
    ]
)


def _texts(spark: SparkSession, path: str, pattern: str | None) -> DataFrame:
    """(path, value) of whole files; a file of no bytes has an empty value."""
    read = read_contents(spark, path, pattern)
    return read.select("path", F.col("content").cast("string").alias("value"))


def _opens(sign: str) -> Column:
    return F.col("value").rlike(rf"^[\s\x{{FEFF}}]*\{sign}")


def _error(bad: Column, why: str) -> Column:
    return F.when(bad, F.when(F.col("value") == "", "empty file").otherwise(why)).alias("error")


def _entries() -> Column:
    """The entries of a list file; null where the file is not such a list."""
    return F.when(_opens("["), F.from_json("value", ENTRIES))


def read_ocr_columnar(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """Result files as one row of parallel arrays each; `error` says why a file has none.

    A file holds one object with the arrays, or a list of entries, whose polygons are
    `rec_polys` and which has no boxes. A detector's limit type that is written as null is empty
    text, one that is absent is null.
    """
    corrupt = T.StructField("_corrupt", T.StringType())
    kind = T.StructType([*COLUMNAR.fields, corrupt])
    read = F.from_json("value", kind, {"columnNameOfCorruptRecord": "_corrupt"})
    results = _texts(spark, path, pattern).select(
        "path", "value", F.when(_opens("{"), read).alias("whole"), _entries().alias("list")
    )
    bad = F.col("list").isNull() & (F.col("whole").isNull() | F.col("whole._corrupt").isNotNull())
    listed = {"rec_texts": "text", "rec_polys": "bbox"}

    # A limit_type that is written as null is no limit type; one that is absent is the default.
    det = "whole.text_det_params"
    keys = F.json_object_keys(F.get_json_object("value", "$.text_det_params"))
    written = F.col(f"{det}.limit_type").isNull() & F.array_contains(keys, "limit_type")
    params = F.when(
        F.col(det).isNotNull(),
        F.struct(F.when(written, "").otherwise(F.col(f"{det}.limit_type")).alias("limit_type"), F.col(f"{det}.limit_side_len").alias("limit_side_len")),
    )

    def value(c: str) -> Column:
        own = F.when(~bad, params if c == "text_det_params" else F.col(f"whole.{c}"))
        return F.coalesce(own, F.transform("list", lambda e: e[listed[c]])) if c in listed else own

    return results.select(
        "path", *[value(c).alias(c) for c in COLUMNAR.fieldNames()],
        _error(bad, "not a result file"),
    )


def read_ocr_list(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """Result files that hold an array of entries: one row per entry, as `ocr_items` gives.

    The entry's polygon is `poly`; this layout has no boxes. A file that is no such list is one
    row with `error` and no position.
    """
    # The outer form: the inner one would parse each file twice, once to test the size.
    entries = _texts(spark, path, pattern).select("path", "value", _entries().alias("list"))
    entries = entries.select(
        "path", _error(F.col("list").isNull(), "not a list of entries"),
        F.posexplode_outer("list").alias("pos", "entry"),
    ).where(F.col("pos").isNotNull() | F.col("error").isNotNull())
    return entries.select(
        "path", "pos", "entry.text", F.col("entry.bbox").alias("poly"),
        F.lit(None).cast(NUMBERS).alias("box"), "entry.confidence", "error",
    )


def read_manifests(
    spark: SparkSession, path: str, pattern: str = "*_run_meta.json"
) -> DataFrame:
    """One row per manifest with its own path in `manifest`; `error` where it is not one."""
    kind = T.StructType([*MANIFEST.fields, T.StructField("_corrupt", T.StringType())])
    read = F.from_json("value", kind, {"columnNameOfCorruptRecord": "_corrupt"})
    manifests = _texts(spark, path, pattern).select(F.col("path").alias("manifest"), "value", read.alias("m"))
    bad = F.col("m").isNull() | F.col("m._corrupt").isNotNull() | F.col("m.json_path").isNull()
    return manifests.select(
        "manifest", *[F.when(~bad, F.col(f"m.{c}")).alias(c) for c in MANIFEST.fieldNames()],
        _error(bad, "not a manifest"),
    )


def path_tail(path: Column | str, parts: int = 1) -> Column:
    """The last parts of a path with / or \\ as separator, joined by /."""
    path = F.col(path) if isinstance(path, str) else path
    if parts == 1:
        return base_name(path)
    return F.array_join(F.slice(F.split(path, r"[/\\]+"), -parts, parts), "/")


def match_files(
    asked: DataFrame, files: DataFrame, path: str, found: str = "path",
    roots: Mapping[str, str] | None = None, by_name: bool = False,
) -> DataFrame:
    """Each row of `asked` once, with the file that its `path` names as struct `file`.

    Files are known by their full path; `roots` says which folder here is which there. Where only
    names are known (`by_name`), a name that several rows or several files have matches none,
    and `same_name` is true: pairs are not multiplied.
    """
    def key(c: str, mapping: Mapping[str, str] | None = None) -> Column:
        return base_name(c) if by_name else full_path(c, mapping)

    left, right = asked.withColumn("_file", key(path, roots)), files.withColumn("_file", key(found))
    sides = left.select("_file", F.lit(1).alias("_a"), F.lit(0).alias("_f"))
    sides = sides.unionAll(right.select("_file", F.lit(0), F.lit(1)))
    several = (F.sum("_f") > 1) | (F.lit(by_name) & (F.sum("_a") > 1) & (F.sum("_f") > 0))
    clear = sides.where("_file IS NOT NULL").groupBy("_file").agg(several.alias("same_name"))
    single = clear.where("NOT same_name").select("_file")
    held = right.join(single, "_file", "left_semi").select("_file", F.struct(*[files[c] for c in files.columns]).alias("file"))
    marked = left.join(clear.where("same_name"), "_file", "left").join(held, "_file", "left")
    return marked.select(*[left[c] for c in asked.columns], "file", F.coalesce("same_name", F.lit(False)).alias("same_name"))


def pair_runs(
    manifests: DataFrame, results: DataFrame, roots: Mapping[str, str] | None = None,
    by_name: bool = False,
) -> DataFrame:
    """Every manifest once, with the result that it names and an `outcome`.

    The outcome is ok, or why there is no result. See `match_files` for the matching.
    """
    both = match_files(manifests.withColumnRenamed("error", "_error"), results, "json_path", "path", roots, by_name)
    outcome = (
        F.when(F.col("_error").isNotNull(), F.col("_error"))
        .when(F.col("same_name"), "several files of this name")
        .when(F.col("file").isNull(), "no result")
        .when(F.col("file.error").isNotNull(), F.col("file.error"))
        .otherwise("ok")
    )
    kept = [c for c in manifests.columns if c != "error"]
    taken = [F.col(f"file.{c}").alias(c) for c in results.columns if c != "error"]
    return both.select(*kept, *taken, outcome.alias("outcome"))


def list_files(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """(path, directory, modificationTime) of files below a folder; contents are not read."""
    return files(spark, path, pattern, recursive=True).select("path", "directory", "modificationTime")


def latest_file(
    files: DataFrame, group_col: str, path: str = "path", modified: str = "modificationTime"
) -> DataFrame:
    """Newest file of each group; the larger path among equally new ones."""
    newest = F.max_by(path, F.struct(modified, path)).alias(path)
    return files.groupBy(group_col).agg(newest)


def read_image_sizes(spark: SparkSession, path: str) -> DataFrame:
    """(path, width, height, error) of every file; a file that is no image has an error.

    Only headers are read: a file that ends after its header still has a size.
    """
    return files(spark, path, images=True)
