"""Table files: fixed-schema reads, JSON output and table versions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, types as T

from ..schemas import TABLES

#: Versions of a growing table that are folded into one run, and such runs into one more.
FOLD = 8


def read_table(
    spark: SparkSession, name: str, path: str, schema: T.StructType | None = None
) -> DataFrame:
    """Parquet table `name` below `path`; the schema is given, not inferred."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.parquet(f"{path.rstrip('/')}/{name}.parquet")


def jdbc_options(name: str, url: str, partitions: int = 1, **options: str) -> dict[str, str]:
    """Reader options of one of the application's tables over JDBC, without the key's bounds.

    The columns have the types of the fixed schema, whatever the driver makes of them.
    """
    spec = TABLES[name]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spec.schema.fields)
    return {
        "url": url, "dbtable": name, "customSchema": fields, "preferTimestampNTZ": "true",
        "partitionColumn": spec.key, "numPartitions": str(partitions), **options,
    }


def jdbc_bounds(name: str, options: Mapping[str, str]) -> dict[str, str]:
    """Reader options for the one row that tells the smallest and the largest key."""
    key = TABLES[name].key
    kept = {k: v for k, v in options.items() if k not in ("dbtable", "customSchema", "partitionColumn", "numPartitions")}
    return {**kept, "query": f"SELECT min({key}) AS low, max({key}) AS high FROM {name}"}


def read_jdbc_table(
    spark: SparkSession, name: str, url: str, partitions: int = 1, **options: str
) -> DataFrame:
    """A live table over JDBC, read in ranges of its key. Needs the driver on the class path.

    The ranges lie between the smallest and the largest key, asked for once; they only share out
    the work, so rows added meanwhile are read as well. An empty table is one range.
    """
    asked = jdbc_options(name, url, partitions, **options)
    found = spark.read.format("jdbc").options(**jdbc_bounds(name, asked)).load().first()
    low, high = (found[0], found[1]) if found and found[0] is not None else (0, 1)
    ranges = {"lowerBound": str(low), "upperBound": str(max(high, low + 1))}
    return spark.read.format("jdbc").options(**asked, **ranges).load()


def write_json(df: DataFrame, path: str) -> None:
    """JSON lines in UTF-8, text as it is; null fields are written."""
    df.write.option("ignoreNullFields", False).json(path)


def version_path(path: str, version: int) -> str:
    return f"{path.rstrip('/')}/version={version}"


def write_version(df: DataFrame, path: str, version: int) -> str:
    """Write one version of a table. Writing the same number again replaces it.

    The version a job reads must never be the one it writes.
    """
    target = version_path(path, version)
    df.write.mode("overwrite").parquet(target)
    return target


def read_version(
    spark: SparkSession, path: str, version: int, schema: T.StructType | None = None
) -> DataFrame:
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.parquet(version_path(path, version))


def _folder(spark: SparkSession, path: str):
    """The Hadoop file system and path of a folder, which may be in any store that Spark writes."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    return root.getFileSystem(spark._jsc.hadoopConfiguration()), root


def _written(spark: SparkSession, path: str) -> set[str]:
    """Names of the folders below a table whose write was completed."""
    fs, root = _folder(spark, path)
    if not fs.exists(root):
        return set()
    child = spark._jvm.org.apache.hadoop.fs.Path
    paths = [status.getPath() for status in fs.listStatus(root)]
    return {p.getName() for p in paths if "=" in p.getName() and fs.exists(child(p, "_SUCCESS"))}


def _run(first: int, last: int) -> str:
    return f"version={last}" if first == last else f"run={first}-{last}"


def _covering(version: int, known: set[str], fold: int) -> list[str]:
    """Folders that hold the rows of version 0 and of 1 to `version`: the longest runs there are."""
    found, done = [_run(0, 0)], 0
    while done < version:
        size = 1
        while done % (size * fold) == 0 and done + size * fold <= version:
            size *= fold
        while size > 1 and _run(done + 1, done + size) not in known:
            size //= fold
        found.append(_run(done + 1, done + size))
        done += size
    return found


def growing_folders(spark: SparkSession, path: str, version: int, fold: int = FOLD) -> list[str]:
    """The folders that `read_growing` reads."""
    return [f"{path.rstrip('/')}/{n}" for n in _covering(version, _written(spark, path), fold)]


def read_growing(
    spark: SparkSession, path: str, version: int, schema: T.StructType | None = None,
    fold: int = FOLD,
) -> DataFrame:
    """A table whose version folders each hold only the rows that were added: all up to one.

    Folded versions (`fold_versions`) are read from their run, so the number of folders grows
    with the logarithm of the number of versions.
    """
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.parquet(*growing_folders(spark, path, version, fold))


def fold_versions(spark: SparkSession, path: str, version: int, fold: int = FOLD) -> None:
    """Write each run that ends with this version: `fold` folders, or runs of that many, as one.

    A row is rewritten once per power of `fold`, not once per run of the table's size. Running it
    again writes the same; what has been folded stays until `remove_folded`.
    """
    size = fold
    while version and version % size == 0:
        known, first = _written(spark, path), version - size + 1
        if _run(first, version) not in known:
            step = size // fold
            parts = [f"{path.rstrip('/')}/{_run(n, n + step - 1)}" for n in range(first, version + 1, step)]
            spark.read.parquet(*parts).write.mode("overwrite").parquet(f"{path.rstrip('/')}/{_run(first, version)}")
        size *= fold


def remove_folded(spark: SparkSession, path: str, version: int, keep: int = 1, fold: int = FOLD) -> None:
    """Remove folders that no version from version - keep on is read from."""
    known = _written(spark, path)
    wanted = {n for v in range(max(0, version - keep), version + 1) for n in _covering(v, known, fold)}
    # The last version's own folder tells its number (`latest_version`).
    wanted |= {n for n in known if n.startswith("version=") and int(n.removeprefix("version=")) >= version}
    fs, _ = _folder(spark, path)
    for name in known - wanted:
        fs.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/{name}"), True)


def remove_versions(spark: SparkSession, path: str, before: int) -> None:
    """Remove whole versions with a smaller number."""
    fs, _ = _folder(spark, path)
    for name in _written(spark, path):
        if name.startswith("version=") and int(name.removeprefix("version=")) < before:
            fs.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/{name}"), True)


def latest_version(spark: SparkSession, path: str) -> int | None:
    """Largest version whose write was completed, null if there is none."""
    names = _written(spark, path)
    return max((int(n.removeprefix("version=")) for n in names if n.startswith("version=")), default=None)
