import json

import pytest
from data import NOW, app_tables, listed
from rowsmith.plans.application import create, delete, patch, put
from rowsmith.schemas import TABLES
from rowsmith.session import SKEW_SETTINGS, checkpoint_stage, no_stage, tune
from rowsmith.operators.inserts import Changes
from rowsmith.sources.tables import (
    fold_versions, growing_folders, jdbc_bounds, jdbc_options, latest_version, read_growing, read_table,
    read_version, remove_folded, write_json, write_version,
)
from rowsmith.streaming.changes import apply_inserts, apply_stream


def test_read_table_uses_the_given_schema(spark, tmp_path):
    app_tables(spark)["review"].write.parquet(str(tmp_path / "review.parquet"))
    got = read_table(spark, "review", str(tmp_path), TABLES["review"].schema)
    assert got.schema.fieldNames() == TABLES["review"].schema.fieldNames() and got.count() == 3


def test_write_json_keeps_text_and_nulls(spark, tmp_path):
    write_json(spark.createDataFrame([(1, "한글 é", None)], "a int, b string, c string").coalesce(1), str(tmp_path / "o"))
    (part,) = (tmp_path / "o").glob("part-*.json")
    raw = part.read_text(encoding="utf-8")
    assert "한글 é" in raw and json.loads(raw) == {"a": 1, "b": "한글 é", "c": None}


def test_versions(spark, tmp_path):
    path = str(tmp_path / "t")
    assert latest_version(spark, path) is None
    write_version(spark.range(3), path, 0)
    write_version(read_version(spark, path, 0).where("id > 0"), path, 10)
    write_version(spark.range(1), path, 10)
    (tmp_path / "t" / "version=11").mkdir()
    assert latest_version(spark, path) == 10 and read_version(spark, path, 10).count() == 1


@pytest.mark.parametrize("kind", ["create", "patch", "delete"])
def test_stream(spark, tmp_path, kind):
    tables = app_tables(spark)
    schema = {
        "create": "seq bigint, review_title string, review_content string, rating int, location string, member_id int",
        "patch": "seq bigint, target_id int, body string",
        "delete": "seq bigint, target_id int",
    }[kind]
    batches = {
        "create": [[(1, "a", "b", 3, None, 1), (2, "a", "b", 9, None, 1)], [(3, "c", "d", None, None, 2)]],
        "patch": [[(1, 1, '{"rating": 2}')], [(2, 1, '{"location": "B"}'), (3, 8, "{}")]],
        "delete": [[(1, 1)], [(2, 1), (3, 2)]],
    }[kind]
    run = {
        "create": lambda t, r, stage=no_stage: create({**tables, "review": t}, "review", r, NOW, stage=stage),
        "patch": lambda t, r, stage=no_stage: patch({**tables, "review": t}, "review", r, stage=stage),
        "delete": lambda t, r, stage=no_stage: delete({**tables, "review": t}, "review", r),
    }[kind]
    store, out = str(tmp_path / "store"), str(tmp_path / "out")
    write_version(tables["review"], store, 0)
    current, codes = tables["review"], []
    for n, rows in enumerate(batches):
        batch = spark.createDataFrame(rows, schema)
        batch.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        apply_stream(stream, run, store, out, str(tmp_path / "check")).awaitTermination()
        want = run(current, batch)
        assert listed(read_version(spark, store, n + 1)) == listed(want.table)
        assert listed(read_version(spark, out, n + 1)) == listed(want.outcomes)
        current = read_version(spark, store, n + 1)
    assert latest_version(spark, store) == 2


def test_insert_stream_writes_only_new_rows(spark, tmp_path):
    tables = app_tables(spark)
    schema = "seq bigint, review_title string, review_content string, rating int, location string, member_id int"
    batches = [[(1, "a", "b", 3, None, 1), (2, "a", "b", 9, None, 1)], [(3, "c", "d", None, None, 2)]]
    store, out = str(tmp_path / "store"), str(tmp_path / "out")
    write_version(tables["review"], store, 0)
    current = tables["review"]
    for n, rows in enumerate(batches):
        batch = spark.createDataFrame(rows, schema)
        batch.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        op = lambda t, r, stage: create({**tables, "review": t}, "review", r, NOW, stage=stage)
        apply_inserts(stream, op, store, out, str(tmp_path / "check")).awaitTermination()
        current = create({**tables, "review": current}, "review", batch, NOW).table
        assert listed(read_growing(spark, store, n + 1)) == listed(current)
        assert read_version(spark, store, n + 1).count() == 1
    assert listed(read_growing(spark, store, 0)) == listed(tables["review"])


def test_fifty_batches_are_read_from_few_folders(spark, tmp_path):
    store, out, seen = str(tmp_path / "store"), str(tmp_path / "out"), []
    write_version(spark.range(5).coalesce(1), store, 0)
    for n in range(50):
        spark.range(100 + n, 101 + n).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def op(table, batch, stage):
        seen.append(len({f.rsplit("/", 1)[0] for f in table.inputFiles()}))
        added = batch.coalesce(1)
        return Changes(table.union(added), added.selectExpr("id AS seq", "200 AS code"), added)

    stream = spark.readStream.schema("id bigint").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    apply_inserts(stream, op, store, out, str(tmp_path / "check"), keep=2, fold=4).awaitTermination()
    assert latest_version(spark, store) == 50 and len(seen) == 50
    # The first table, and at most three runs of each length 16, 4 and 1.
    assert len(growing_folders(spark, store, 50, 4)) == 1 + 3 + 0 + 2 and max(seen) == 1 + 2 + 3 + 3
    assert sorted(r["id"] for r in read_growing(spark, store, 50, fold=4).collect()) == [*range(5), *range(100, 150)]
    for version in (48, 49, 50):
        assert read_growing(spark, store, version, fold=4).count() == 5 + version
    assert len(list((tmp_path / "store").glob("*=*"))) <= 12
    assert len(list((tmp_path / "out.stage").glob("*"))) <= 1


def test_folding_again_after_a_failure_changes_nothing(spark, tmp_path):
    store = str(tmp_path / "t")
    for n in range(10):
        write_version(spark.range(n, n + 1).coalesce(1), store, n)
        fold_versions(spark, store, n, 3)
        # A batch that is run again writes, folds and removes once more.
        write_version(spark.range(n, n + 1).coalesce(1), store, n)
        fold_versions(spark, store, n, 3)
        remove_folded(spark, store, n, 1, 3)
        (tmp_path / "t" / "run=1-27").mkdir(exist_ok=True)
        for version in range(max(0, n - 1), n + 1):
            assert sorted(r["id"] for r in read_growing(spark, store, version, fold=3).collect()) == list(range(version + 1))
    assert [f.rsplit("/", 1)[1] for f in growing_folders(spark, store, 9, 3)] == ["version=0", "run=1-9"]
    with pytest.raises(ValueError):
        apply_inserts(None, None, store, store, store, keep=0)


def test_whole_versions_are_removed(spark, tmp_path):
    schema, store = "seq bigint, target_id int", str(tmp_path / "store")
    write_version(spark.range(9).coalesce(1), store, 0)
    for n in range(5):
        spark.createDataFrame([(n, n)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def op(table, batch, stage):
        judged = stage(batch)
        left = table.join(judged, table["id"] == judged["target_id"], "left_anti")
        return Changes(left, judged.selectExpr("seq", "200 AS code"))

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    apply_stream(stream, op, store, str(tmp_path / "out"), str(tmp_path / "check"), keep=2).awaitTermination()
    assert sorted(p.name for p in (tmp_path / "store").glob("v*")) == ["version=3", "version=4", "version=5"]
    assert [r["id"] for r in read_version(spark, store, 5).orderBy("id").collect()] == [5, 6, 7, 8]


def test_checks_run_once_per_batch(spark, tmp_path):
    """With a stage, neither outcomes nor rows read the parents' tables again."""
    tables, plans = app_tables(spark), []
    asked = spark.createDataFrame([(5, 1, 3), (6, 9, 1), (7, 1, 3)], "seq bigint, member_id int, item_id int")
    asked.write.parquet(str(tmp_path / "in"))
    tables["member"].write.parquet(str(tmp_path / "member"))
    tables["member"] = spark.read.parquet(str(tmp_path / "member"))
    write_version(tables["member_restrictions"], str(tmp_path / "store"), 0)

    def op(table, batch, stage):
        done = create({**tables, "member_restrictions": table}, "member_restrictions", batch, NOW, stage=stage)
        plans.extend(d._jdf.queryExecution().optimizedPlan().toString() for d in (done.outcomes, done.added))
        return done

    stream = spark.readStream.schema(asked.schema).parquet(str(tmp_path / "in"))
    apply_inserts(stream, op, str(tmp_path / "store"), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    assert len(plans) == 2 and not any("password" in p or "nickname" in p for p in plans)
    want = create({**tables, "member_restrictions": app_tables(spark)["member_restrictions"]}, "member_restrictions", asked, NOW)
    assert listed(read_version(spark, str(tmp_path / "out"), 1)) == listed(want.outcomes)
    assert listed(read_growing(spark, str(tmp_path / "store"), 1)) == listed(want.table)


def test_upsert_reads_its_table_once(spark, tmp_path):
    spark.createDataFrame([(1, "K", "Milk", 1)], TABLES["restriction_items"].schema).write.parquet(str(tmp_path / "t"))
    spark.sparkContext.setCheckpointDir(str(tmp_path / "c"))
    table, staged = spark.read.parquet(str(tmp_path / "t")), []

    def stage(df):
        staged.append(df._jdf.queryExecution().executedPlan().toString().count("FileScan"))
        return df.checkpoint()

    src = spark.createDataFrame([(1, "a", "MILK", 1), (2, "b", "egg", 1)], "seq bigint, item_label_ko string, item_label_en string, category_id int")
    done = put({"restriction_items": table}, "restriction_items", src, ["item_label_ko"], stage=stage)
    after = [d._jdf.queryExecution().executedPlan().toString().count("FileScan") for d in done[:2]]
    assert sum(staged) == 1 and after == [0, 0]
    assert listed(done.table) == [(1, "a", "Milk", 1), (2, "b", "egg", 1)]
    assert listed(done.outcomes) == [(1, 200, "updated", 1), (2, 200, "inserted", 2)]


def test_jdbc_options():
    """Without a connection: a test of the read would need a database."""
    got = jdbc_options("review", "jdbc:x", 8, user="u")
    assert got["customSchema"].startswith("`review_id` int, `review_title` string") and "`create_review` timestamp_ntz" in got["customSchema"]
    assert (got["partitionColumn"], got["numPartitions"], got["dbtable"], got["user"]) == ("review_id", "8", "review", "u")
    bounds = jdbc_bounds("review", got)
    assert bounds["query"] == "SELECT min(review_id) AS low, max(review_id) AS high FROM review"
    assert not {"dbtable", "partitionColumn", "numPartitions", "customSchema"} & set(bounds) and bounds["user"] == "u"


def test_stage_cuts_the_plan_in_the_shared_folder(spark, tmp_path):
    if spark.sparkContext.getCheckpointDir() is None and not spark.conf.get("spark.checkpoint.dir", None):
        with pytest.raises(ValueError):
            checkpoint_stage(spark)
        spark.sparkContext.setCheckpointDir(str(tmp_path))
    rows = [(5, 1, 3), (6, 9, 1), (7, 1, 3)]
    asked = spark.createDataFrame(rows, "seq bigint, member_id int, item_id int")
    staged = create(app_tables(spark), "member_restrictions", asked, NOW, stage=checkpoint_stage(spark))
    lazy = create(app_tables(spark), "member_restrictions", asked, NOW)
    assert listed(staged.outcomes) == listed(lazy.outcomes) and listed(staged.table) == listed(lazy.table)


def test_tune(spark):
    tune(spark)
    assert all(spark.conf.get(k) == v for k, v in SKEW_SETTINGS.items())
