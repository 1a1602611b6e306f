"""Whole files as Spark's own reader gives them, in few tasks, and result files written without a folder each."""

import os
from pathlib import Path

import pyarrow as pa
import pytest
from pyspark.errors import AnalysisException, PythonException
from pyspark.sql import functions as F
from rowsmith.catalog import ocr
from rowsmith.functions.text import uri_path
from rowsmith.sources import contents
from rowsmith.sources.contents import read_contents, write_contents
from rowsmith.sources.ocr_files import read_ocr_columnar, read_ocr_list


def read(spark, folder, pattern=None):
    return {r["path"].removeprefix(f"file:{folder}/"): bytes(r["content"]) for r in read_contents(spark, str(folder), pattern).collect()}


def sparks(spark, folder, pattern=None):
    reader = spark.read.option("pathGlobFilter", pattern) if pattern else spark.read
    rows = reader.text(str(folder), wholetext=True).select(uri_path("_metadata.file_path").alias("file_path"), F.col("value").cast("binary").alias("value")).collect()
    return {r["file_path"].partition(f"{folder}/")[2]: bytes(r["value"]) for r in rows}


@pytest.mark.parametrize("codec", ["none", "gzip", "bzip2", "deflate", "snappy", "lz4"])
def test_compressed_files(spark, tmp_path, codec):
    # More than one block, and text that repeats nearby and far away.
    lines = spark.range(0, 60_000, numPartitions=1).select(F.concat(F.lit("메뉴 aaaaaaaaaaaaaaaaaaaaaaaa "), F.sha2(F.col("id").cast("string"), 256)))
    lines.write.option("compression", codec).text(str(tmp_path / "out"))
    lines.limit(1).write.mode("append").option("compression", codec).text(str(tmp_path / "out"))
    got = read(spark, tmp_path / "out")
    assert len(got) == 2 and got == sparks(spark, tmp_path / "out")


def test_zstandard_and_cut_files():
    packed = pa.Codec("zstd").compress(b"menu" * 99, asbytes=True)
    assert contents.plain("/x.y/a.json.zst", packed) == b"menu" * 99 and contents.plain("/x.gz/zst", packed) == packed
    assert contents.plain("a.gz", b"") == b""
    with pytest.raises(EOFError):
        contents.plain("a.snappy", b"\0\0\0\x09\0\0\0\x09abc")


def test_names_and_bytes(spark, tmp_path):
    names = ["a.json", "b.json", "b.txt", "ab1.json", "[x].json", "a^.json", ".hidden", "_hidden", "_k=1", "x._COPYING_", "a,b.json", "{z}.json"]
    for name in names:
        (tmp_path / name).write_bytes(b"\xef\xbb\xbf\xff " + name.encode())
    for pattern in (None, "*.json", "[ab].json", "[!a]*.json", "[^a]*.json", "{a,ab?}.json", "\\[x\\].json", "?.*", "a^.json", "*,*", "\\{z\\}.json", "_*"):
        assert read(spark, tmp_path, pattern) == sparks(spark, tmp_path, pattern), pattern
    assert list(read(spark, tmp_path / "a.json").values()) == [b"\xef\xbb\xbf\xff a.json"]
    with pytest.raises(AnalysisException):
        read_contents(spark, str(tmp_path / "gone"))


def test_folders_of_keys(spark, tmp_path):
    for n in range(7):
        (tmp_path / f"k={n}" / "l=x").mkdir(parents=True)
        (tmp_path / f"k={n}" / "l=x" / "f.json").write_text(f'[{{"text": "{n}"}}]')
    assert read(spark, tmp_path) == sparks(spark, tmp_path) == {f"k={n}/l=x/f.json": f'[{{"text": "{n}"}}]'.encode() for n in range(7)}
    # One of no bytes is a row there, too; other folders are not read.
    (tmp_path / "k=0" / "none.json").write_bytes(b"")
    (tmp_path / "other").mkdir()
    (tmp_path / "other" / "f.json").write_text("[]")
    errors = [r["error"] for r in read_ocr_list(spark, str(tmp_path)).collect()]
    assert sorted(e or "" for e in errors) == [""] * 7 + ["empty file"]
    assert read_ocr_columnar(spark, str(tmp_path)).where("error = 'empty file'").count() == 1


def test_tasks_are_as_many_as_files_and_bytes_ask_for(monkeypatch, tmp_path):
    monkeypatch.setattr(contents, "FILES_PER_TASK", 4)
    monkeypatch.setattr(contents, "BYTES_PER_TASK", 1000)
    monkeypatch.setattr(contents, "BATCH_ROWS", 3)
    for n in range(10):
        (tmp_path / f"k={n}").mkdir()
        (tmp_path / f"k={n}" / "f.json").write_text(f"{n}")
    (tmp_path / "large.json").write_text("x" * 5000)
    reader = contents.Reader({"path": str(tmp_path)})
    groups = reader.partitions()
    assert max(len(g.names) for g in groups) == 4 and {"/": ["large.json"]} in [g.names for g in groups]
    batches = [b.column("content").to_pylist() for g in groups for b in reader.read(g)]
    assert max(map(len, batches)) == 3
    assert sorted(v for b in batches for v in b) == [*(b"%d" % n for n in range(10)), b"x" * 5000]
    assert [g.names for g in contents.Reader({"path": str(tmp_path), "pattern": "none"}).partitions()] == [{}]


def test_writing(spark, tmp_path):
    rows = [("a", "1"), ("a", None), ("b", "é"), ("c", "")]
    df = spark.createDataFrame(rows, "name string, content string").coalesce(1)
    write_contents(df, str(tmp_path / "o"))
    (folder,) = (tmp_path / "o").iterdir()
    assert {f.name: f.read_text() for f in folder.iterdir()} == {"a": "1\n\n", "b": "é\n", "c": "\n"}
    write_contents(df.limit(0), str(tmp_path / "none"))
    assert read(spark, tmp_path / "none") == {}
    with pytest.raises(PythonException, match="follow one another"):
        write_contents(df.union(df).coalesce(1), str(tmp_path / "o"))
    assert [f.name for f in (tmp_path / "o").iterdir()] == [folder.name]


def test_folders_of_other_attempts_are_removed(monkeypatch, tmp_path):
    class Task:
        n = 0

        def taskAttemptId(self):
            self.n += 1
            return self.n

    monkeypatch.setattr(contents.TaskContext, "get", lambda task=Task(): task)
    batch = pa.RecordBatch.from_arrays([pa.array(["a"]), pa.array([b"1"])], names=["name", "content"])
    (tmp_path / "part=other-1").mkdir()
    writer = contents.Writer(str(tmp_path))
    first, second = writer.write(iter([batch])), writer.write(iter([batch]))
    assert first != second and len(os.listdir(tmp_path)) == 3
    writer.commit([second])
    assert sorted(os.listdir(tmp_path)) == sorted(["part=other-1", second.folder])
    writer.abort([second, None])
    assert os.listdir(tmp_path) == ["part=other-1"]


def pages(spark, folder, rows, parts=1):
    spark.createDataFrame(rows, "page_id bigint, url string").coalesce(parts).write.parquet(f"{folder}/pages.parquet")
    return str(folder)


def written(monkeypatch):
    """The folder that a query writes."""
    made, scratch = [], ocr.i.scratch
    monkeypatch.setattr(ocr.i, "scratch", lambda *a: made.append(scratch(*a)) or made[-1])
    return made


def test_q56_needs_no_folder_per_page(spark, tmp_path, monkeypatch):
    made = written(monkeypatch)
    rows = ocr.q56_read_columnar(spark, pages(spark, tmp_path, [(n, f"http://h{n}/a") for n in range(300)], 3))
    assert rows.rdd.getNumPartitions() <= 2
    got = {(r["page_id"], r["pos"]): tuple(r)[2:] for r in rows.collect()}
    assert len(got) == 900 and got[299, 1] == ("h299", 10.0, 1.0, 18.0, 5.0, 299.0)
    assert got[298, 2] == ("a", 20.5, 2.0, 28.0, 3.0, 298.0) and got[297, 0][1] == 0.0
    top = Path(made[0].removeprefix("file:"))
    files = [f.name for f in top.rglob("*.json")]
    assert len(files) == 300 and len([f for f in top.iterdir() if f.is_dir()]) <= int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_q57_needs_few_tasks(spark, tmp_path, monkeypatch):
    made = written(monkeypatch)
    rows = [(n, f"http://h{n}") for n in range(300)] + [(300, None), (301, "//"), (302, "a"), (302, "b")]
    pages(spark, tmp_path, rows)
    # Rows of a page are lines of one file, of which the first counts, but other parts of the table write others.
    spark.createDataFrame([(303, "c"), (303, "c"), (0, "d")], "page_id bigint, url string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/pages.parquet")
    items = ocr.q57_read_list(spark, str(tmp_path))
    assert items.rdd.getNumPartitions() <= 2
    got = sorted(tuple(r) for r in items.collect())
    assert got[:3] == [(0, 0, "d", 0.5, 0.0, 1.0), (0, 0, "http", 0.5, 0.0, 4.0), (0, 1, "h0", 0.5, 10.0, 3.0)]
    assert [r[:3] for r in got[-2:]] == [(302, 0, "a"), (303, 0, "c")] and len(got) == 603
    top = Path(made[0].removeprefix("file:"))
    assert len([*top.rglob("*.json")]) == 305 and len([f for f in top.iterdir() if f.is_dir()]) <= 8
    assert [f.read_text() for f in top.rglob("page_id=300-*.json")] == ["\n"]
