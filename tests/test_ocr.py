import json
import os

import pandas as pd
import pytest
from data import listed
from pyspark.sql import functions as F
from rowsmith.functions.geometry import (
    choose_box, coord_space, det_scale, map_box, map_poly, poly_to_bbox,
)
from rowsmith.functions.text import base_name, keep_script, output_name, stem
from rowsmith.operators.ocr import (
    drop_untranslated, image_facts, ocr_items, place_items, run_counters, translate_distinct, translations,
)
from rowsmith.plans.replacement import count_runs, plan_entries, plan_runs, run_images
from rowsmith.sources import listing
from rowsmith.sources.ocr_files import (
    COLUMNAR, latest_file, list_files, pair_runs, read_image_sizes, read_manifests,
    read_ocr_columnar, read_ocr_list,
)



def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_keep_script(spark):
    cases = {
        None: "", "": "", "  불고기  ": "불고기", "김치 (2인분) 9,000원": "김치 인분 원", "ㅋㅋ한ㅏ": "한",
        "가\u00a0나\u3000다": "가 나 다", "가\u001c\u001f나": "가 나", "abc 123": "", "가\t\n 나": "가 나",
        "\u3000가\u0085": "가", "가-나": "가나",
    }
    df = spark.createDataFrame([(k, v) for k, v in cases.items()], "raw string, want string")
    got = df.select("raw", "want", keep_script("raw").alias("got")).collect()
    assert [r for r in got if r["got"] != r["want"]] == []


def test_keep_script_agrees_with_python_on_all_white_space(spark):
    chars = [chr(c) for c in range(1, 0x3100)]
    df = spark.createDataFrame([(c, f"가{c}나") for c in chars], "c string, s string")
    got = {r["c"]: r["k"] for r in df.select("c", keep_script("s").alias("k")).collect()}
    assert got == {c: "가 나" if c.isspace() else "가나" for c in chars}


def test_names(spark):
    cases = {
        r"C:\a\b\image_1.jpg": "image_1", "/x/y/menu.v2.png": "menu.v2", "plain": "plain",
        "/x/.hidden": ".hidden", "/x/dir/": "dir", "end.": "end.",
    }
    df = spark.createDataFrame(list(cases.items()), "p string, want string")
    assert all(r[0] == r[1] for r in df.select(stem("p"), "want").collect())
    assert one(spark, output_name(F.lit("a/b.c.jpg"))) == ("b.c_translated_replace_on_original.jpg",)
    assert one(spark, base_name(F.lit("C:\\a/b.jpg"))) == ("b.jpg",)


def lit_array(values):
    return F.lit(None) if values is None else F.array(*[
        F.array(*[F.lit(float(x)) for x in v]) if isinstance(v, list) else F.lit(float(v)) for v in values
    ])


def test_boxes(spark):
    poly = [[-1.7, 2.9], [10.9, 2.2], [3.0, -0.5]]
    assert tuple(one(spark, poly_to_bbox(lit_array(poly)))[0]) == (-1, 0, 10, 2)

    def chosen(box, poly):
        df = spark.createDataFrame([(box, poly)], "b array<double>, p array<array<double>>")
        got = df.select(choose_box("b", "p").alias("x")).first()["x"]
        return None if got is None else tuple(got)

    assert chosen([1.5, 2.5, 3.5, 4.5], poly) == (1.5, 2.5, 3.5, 4.5)
    assert chosen([1.0, 2.0, 3.0], poly) == (-1.0, 0.0, 10.0, 2.0)
    assert chosen(None, poly) == (-1.0, 0.0, 10.0, 2.0)
    assert chosen(None, None) is None and chosen([], []) is None


@pytest.mark.parametrize(
    "w, h, kind, limit, want",
    [
        (100, 50, "max", 0, 1.0), (100, 50, "max", None, 1.0), (100, 50, "max", -3, 1.0), (100, 50, "max", 100, 1.0),
        (100, 50, "max", 80, 0.8), (100, 50, None, 80, 0.8), (100, 50, "min", 50, 1.0), (100, 50, "min", 60, 1.2),
        (100, 50, "other", 10, 1.0),
    ],
)
def test_det_scale(spark, w, h, kind, limit, want):
    got = one(spark, det_scale(F.lit(w), F.lit(h), F.lit(kind).cast("string"), F.lit(limit).cast("double")))
    assert got == (want,)


def test_coord_space(spark):
    def space(x, y):
        return one(spark, coord_space(F.lit(x).cast("double"), F.lit(y).cast("double"), F.lit(100), F.lit(1000)))[0]

    assert space(100 * 1.10, 1000 * 1.10) == "orig"
    assert space(110.1, 1.0) == "scaled" and space(1.0, 1100.5) == "scaled"
    assert space(None, None) == "orig"


def test_mapping_rounds_half_to_even(spark):
    box = F.struct(*[F.lit(v).alias(n) for n, v in zip(("x1", "y1", "x2", "y2"), (0.5, 1.5, 2.5, -0.5))])
    assert tuple(one(spark, map_box(box, F.lit("orig"), F.lit(0.5)))[0]) == (0, 2, 2, 0)
    assert tuple(one(spark, map_box(box, F.lit("scaled"), F.lit(0.5)))[0]) == (1, 3, 5, -1)
    assert tuple(one(spark, map_box(box, F.lit("scaled"), F.lit(0.0)))[0]) == (0, 2, 2, 0)
    got = one(spark, map_poly(lit_array([[2.5, 3.5], [1.0, 7.0]]), F.lit("scaled"), F.lit(2.0)))[0]
    assert [tuple(p) for p in got] == [(1, 2), (0, 4)]


def test_items_follow_the_texts(spark):
    docs = [
        ("a", ["x", "y", "z"], [[[0.0, 0.0]]], [[1.0, 2.0, 3.0, 4.0], [1.0, 2.0]]),
        ("b", ["x"], None, None), ("c", [], None, None), ("d", None, None, None),
        ("e", ["x"], [[[0.0, 1.0]], [[5.0, 5.0]]], None),
    ]
    df = spark.createDataFrame(
        docs, "id string, rec_texts array<string>, rec_polys array<array<array<double>>>, rec_boxes array<array<double>>"
    )
    items = ocr_items(df, "id")
    got = [tuple(r) for r in items.orderBy("id", "pos").collect()]
    assert got == [
        ("a", 0, "x", [[0.0, 0.0]], [1.0, 2.0, 3.0, 4.0]), ("a", 1, "y", None, [1.0, 2.0]), ("a", 2, "z", None, None),
        ("b", 0, "x", None, None), ("e", 0, "x", [[0.0, 1.0]], None),
    ]
    assert [(r["id"], r["pos"]) for r in place_items(items).orderBy("id").collect()] == [("a", 0), ("e", 0)]


def test_translation_once_per_string(spark):
    items = spark.createDataFrame(
        [("i1", 0, "밥"), ("i1", 1, "밥"), ("i2", 0, "밥"), ("i2", 1, "국"), ("i2", 2, ""), ("i2", 3, "물"), ("i3", 0, "")],
        "image_id string, pos int, ko string",
    )
    words = spark.createDataFrame([("밥", " rice "), ("국", "  "), ("", "never")], "ko string, en string")
    done = translate_distinct(items, words)
    assert {(r["ko"], r["en"]) for r in done.collect()} == {("밥", "rice"), ("국", ""), ("", None), ("물", None)}
    assert drop_untranslated(done).count() == 3
    counted = {r["image_id"]: (r["replaced"], r["looked_up"]) for r in run_counters(done).collect()}
    assert counted == {"i1": (2, 1), "i2": (1, 3), "i3": (0, 0)}

    def fn(frames):
        for frame in frames:
            assert "" not in set(frame["ko"]) and frame["ko"].is_unique
            yield pd.DataFrame({"ko": frame["ko"], "en": frame["ko"] + "! "})

    by_fn = translate_distinct(items, fn=fn)
    assert {(r["ko"], r["en"]) for r in by_fn.collect()} == {("밥", "밥!"), ("국", "국!"), ("물", "물!"), ("", None)}
    with pytest.raises(ValueError):
        translate_distinct(items)


def test_strings_that_are_not_answered_once(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    items = spark.createDataFrame([(n, w) for n, w in enumerate(["a", "b", "c", "a", "", "b"])], "n int, ko string")

    def fn(frames):
        for frame in frames:
            asked = [w for w in frame["ko"] if w != "c"]
            answers = asked + ["b"] * ("b" in asked) + ["zz"] * ("a" in asked)
            yield pd.DataFrame({"ko": answers, "en": [f"{w} {n}" for n, w in enumerate(answers)]})

    staged = []

    def stage(df):
        staged.append(df.columns)
        return df.checkpoint()

    words, problems = translations(items, fn, stage=stage)
    assert sorted(tuple(r) for r in problems.collect()) == [("b", "doubled"), ("c", "missing"), ("zz", "not asked for")]
    assert words.count() == 3
    done = translate_distinct(items, fn=fn, stage=stage)
    assert staged == [["ko", "en"], ["n", "ko"]]
    assert done.count() == 6 and {r["ko"] for r in done.where("en IS NULL").collect()} == {"c", ""}


def test_limit_type_null_and_absent(spark, tmp_path):
    kinds = {"null": {"limit_type": None, "limit_side_len": 50}, "absent": {"limit_side_len": 50}, "max": {"limit_type": "max", "limit_side_len": 50}, "none": None}
    for name, params in kinds.items():
        doc = {"rec_texts": ["x"]} | ({"text_det_params": params} if params else {})
        (tmp_path / f"{name}.json").write_text(json.dumps(doc))
    read = read_ocr_columnar(spark, str(tmp_path)).select(
        stem("path").alias("name"), det_scale(F.lit(100), F.lit(60), "text_det_params.limit_type", "text_det_params.limit_side_len").alias("s"), "error"
    )
    assert {r["name"]: (r["s"], r["error"]) for r in read.collect()} == {"null": (1.0, None), "absent": (0.5, None), "max": (0.5, None), "none": (1.0, None)}


RESULTS = {
    "menu_res.json": {
        "rec_texts": ["비빔밥 9,000", "2인", "물냉면", "비빔밥", "없음", "김치"],
        "rec_polys": [
            [[10, 10], [50, 10], [50, 30], [10, 30]], [[0, 0], [1, 0], [1, 1]], [[5, 5], [9.5, 5], [9, 9.5]],
            [[12.5, 13.5], [13, 13], [13, 14], [12, 14]], [[0, 0], [1, 1], [2, 2], [3, 3]],
        ],
        "rec_boxes": [[10, 10, 50, 30], [0, 0, 1], [5.5, 5, 9.5, 9]],
        "text_det_params": {"limit_type": "max", "limit_side_len": 100},
    },
    "empty_res.json": {"rec_texts": []},
}


def write_runs(folder):
    for d in ("meta", "res", "img"):
        (folder / d).mkdir()
    for name, doc in RESULTS.items():
        (folder / "res" / name).write_text(json.dumps(doc, ensure_ascii=False), encoding="utf-8")
        base = name.removesuffix("_res.json")
        meta = {"input_image": f"C:\\in\\{base}.bmp", "json_path": f"C:\\out\\{name}", "out_dir": "C:\\out",
                "paddleocr_config": {"det_limit_type": "max", "det_limit_side_len": 100}}
        (folder / "meta" / f"{base}_run_meta.json").write_text(json.dumps(meta, indent=2), encoding="utf-8")
        # A plain bitmap of 200 x 20 pixels, 24 bits each.
        w, h = 200, 20
        row = b"\x00" * (w * 3)
        size = 54 + len(row) * h
        head = b"BM" + size.to_bytes(4, "little") + bytes(4) + (54).to_bytes(4, "little")
        head += (40).to_bytes(4, "little") + w.to_bytes(4, "little") + h.to_bytes(4, "little")
        head += (1).to_bytes(2, "little") + (24).to_bytes(2, "little") + bytes(24)
        (folder / "img" / f"{base}.bmp").write_bytes(head + row * h)


def test_files_to_plan(spark, tmp_path):
    write_runs(tmp_path)
    sizes = read_image_sizes(spark, str(tmp_path / "img"))
    assert {(r["path"].rsplit("/", 1)[1], r["width"], r["height"], r["error"]) for r in sizes.collect()} == {("menu.bmp", 200, 20, None), ("empty.bmp", 200, 20, None)}
    manifests = read_manifests(spark, str(tmp_path / "meta"))
    results = read_ocr_columnar(spark, str(tmp_path / "res"))
    assert results.schema["rec_polys"].dataType == COLUMNAR["rec_polys"].dataType
    roots = {"C:\\out": str(tmp_path / "res"), "C:\\in": str(tmp_path / "img")}
    assert [r["outcome"] for r in pair_runs(manifests, results, roots).collect()] == ["ok", "ok"]
    assert {r["outcome"] for r in pair_runs(manifests, results).collect()} == {"no result"}
    runs = run_images(manifests, results, sizes, roots)
    words = spark.createDataFrame([("비빔밥", "Bibimbap "), ("물냉면", "Cold noodles"), ("없음", "")], "ko string, en string")
    # y reaches 30 on an image 20 high, so the boxes are in detector pixels: scale 100/200.
    plan = {r["pos"]: r for r in plan_runs(runs, words).collect()}
    assert sorted(plan) == [0, 2, 3]
    first = plan[0]
    assert first["shape"] == "polygon" and first["en"] == "Bibimbap"
    assert [tuple(p) for p in first["polygon"]] == [(20, 20), (100, 20), (100, 60), (20, 60)]
    assert (first["x1"], first["y1"], first["x2"], first["y2"], first["width"], first["height"]) == (20, 20, 100, 60, 80, 40)
    assert plan[2]["shape"] == "rectangle" and plan[2]["polygon"] is None
    assert (plan[2]["x1"], plan[2]["y1"], plan[2]["x2"], plan[2]["y2"]) == (11, 10, 19, 18)
    assert (plan[3]["x1"], plan[3]["width"]) == (24, 2)
    counted = {r["image_id"]: tuple(r)[1:] for r in count_runs(runs, words).collect()}
    assert counted == {
        f"{tmp_path}/img/menu.bmp": ("C:\\out\\menu_translated_replace_on_original.jpg", 3, 4, "ok"),
        f"{tmp_path}/img/empty.bmp": ("C:\\out\\empty_translated_replace_on_original.jpg", 0, 0, "ok"),
    }
    by_name = run_images(manifests, results, sizes, by_name=True)
    assert listed(plan_runs(by_name, words).drop("image_id"), "pos") == listed(plan_runs(runs, words).drop("image_id"), "pos")


def test_every_manifest_has_an_outcome(spark, tmp_path):
    """Corrupt, missing and repeated inputs are rows with a reason, and no pairs multiply."""
    good = {"rec_texts": ["밥"], "rec_polys": [[[1, 1], [9, 1], [9, 5], [1, 5]]]}
    entries = [{"text": "밥", "confidence": 0.9, "bbox": [[1, 1], [9, 1], [9, 5], [1, 5]]}]
    for d in ("a", "b"):
        write_runs(tmp_path / d) if not (tmp_path / d).mkdir() else None
    res, img = tmp_path / "a" / "res", tmp_path / "a" / "img"
    (res / "broken_res.json").write_text('{"rec_texts": ["x"')
    (res / "list_res.json").write_text(json.dumps(entries, ensure_ascii=False), encoding="utf-8")
    (res / "noimage_res.json").write_text(json.dumps(good, ensure_ascii=False), encoding="utf-8")
    (res / "badimage_res.json").write_text(json.dumps(good, ensure_ascii=False), encoding="utf-8")
    (img / "list.bmp").write_bytes((img / "menu.bmp").read_bytes())
    (img / "badimage.bmp").write_bytes(b"not an image")
    for base in ("broken", "list", "noimage", "badimage", "gone"):
        meta = {"input_image": f"{img}/{base}.bmp", "json_path": f"{res}/{base}_res.json", "out_dir": "/out"}
        (tmp_path / "a" / "meta" / f"{base}_run_meta.json").write_text(json.dumps(meta))
    (tmp_path / "a" / "meta" / "bad_run_meta.json").write_text("{")
    manifests = read_manifests(spark, str(tmp_path / "a" / "meta"))
    results = read_ocr_columnar(spark, str(tmp_path / "a" / "res")).unionByName(read_ocr_columnar(spark, str(tmp_path / "b" / "res")))
    sizes = read_image_sizes(spark, str(img))
    roots = {"C:\\out": str(res), "C:\\in": str(img)}
    runs = run_images(manifests, results, sizes, roots)
    got = {(r["image_id"] or "/?").rsplit("/", 1)[1]: r["outcome"] for r in runs.collect()}
    assert got == {
        "menu.bmp": "ok", "empty.bmp": "ok", "list.bmp": "ok", "broken.bmp": "not a result file", "noimage.bmp": "no image",
        "badimage.bmp": "not an image", "gone.bmp": "no result", "?": "not a manifest",
    }
    # The list layout goes from file to plan as well.
    plan = plan_runs(runs, spark.createDataFrame([("밥", "rice")], "ko string, en string")).collect()
    assert [r["image_id"].rsplit("/", 1)[1] for r in plan] == ["list.bmp"]
    assert len(count_runs(runs, spark.createDataFrame([], "ko string, en string")).collect()) == 8
    # By name, files of one name in two folders match nothing rather than everything.
    both = manifests.unionByName(read_manifests(spark, str(tmp_path / "b" / "meta")))
    named = pair_runs(both, results, by_name=True)
    assert named.count() == 10
    assert named.where("outcome = 'several files of this name'").count() == 4
    broken = read_ocr_list(spark, str(res), "broken*").collect()
    assert [(r["pos"], r["error"]) for r in broken] == [(None, "not a list of entries")]


NAMES = ["plain", "메뉴 1", "a%20b", "a+b", "100%", "#1 ?x=&y", "[z]*"]


def test_runs_pair_whatever_signs_their_paths_have(spark, tmp_path):
    folder = tmp_path / "차림 표+%41"
    folder.mkdir()
    write_runs(folder)
    res, img, meta = folder / "res", folder / "img", folder / "meta"
    for name in NAMES:
        (res / f"{name}_res.json").write_bytes((res / "menu_res.json").read_bytes())
        (img / f"{name}.bmp").write_bytes((img / "menu.bmp").read_bytes())
        doc = {"input_image": f"{img}/{name}.bmp", "json_path": f"{res}/{name}_res.json", "out_dir": str(res)}
        (meta / f"{name}_run_meta.json").write_text(json.dumps(doc))
    manifests, results = read_manifests(spark, str(meta)), read_ocr_columnar(spark, str(res))
    assert {r["manifest"] for r in manifests.collect()} >= {f"file:{meta}/{n}_run_meta.json" for n in NAMES}
    runs = run_images(manifests, results, read_image_sizes(spark, str(img)), {"C:\\out": str(res), "C:\\in": str(img)})
    got = {(r["image_id"], r["outcome"], r["width"]) for r in runs.collect()}
    assert got == {(f"{img}/{n}.bmp", "ok", 200) for n in [*NAMES, "menu", "empty"]}
    assert {r["path"] for r in read_ocr_list(spark, str(res), "메뉴*").collect()} == {f"file:{res}/메뉴 1_res.json"}
    newest = latest_file(list_files(spark, str(folder), "*_res.json"), "directory").collect()
    assert [r["directory"] for r in newest] == [f"file:{res}"]


def test_files_of_no_bytes_are_rows(spark, tmp_path):
    write_runs(tmp_path)
    for place in ("meta/none_run_meta.json", "meta/nores_run_meta.json", "res/none_res.json", "img/none.png", "meta/_hidden_run_meta.json"):
        (tmp_path / place).write_bytes(b"")
    doc = {"input_image": f"{tmp_path}/img/none.png", "json_path": f"{tmp_path}/res/none_res.json", "out_dir": "/o"}
    (tmp_path / "meta" / "ask_run_meta.json").write_text(json.dumps(doc))
    doc["json_path"] = f"{tmp_path}/res/menu_res.json"
    (tmp_path / "meta" / "img_run_meta.json").write_text(json.dumps(doc))
    manifests = read_manifests(spark, str(tmp_path / "meta"))
    results, sizes = read_ocr_columnar(spark, str(tmp_path / "res")), read_image_sizes(spark, str(tmp_path / "img"))
    assert (manifests.count(), results.count(), sizes.count()) == (6, 3, 3)
    assert listed(sizes.where("path LIKE '%none%'").select("width", "height", "error"), "error") == [(None, None, "empty file")]
    runs = run_images(manifests, results, sizes, {"C:\\out": f"{tmp_path}/res", "C:\\in": f"{tmp_path}/img"})
    assert sorted(r["outcome"] for r in runs.collect()) == ["empty file"] * 4 + ["ok"] * 2
    found = read_ocr_list(spark, str(tmp_path / "res"), "none*").collect()
    assert [(r["pos"], r["error"]) for r in found] == [(None, "empty file")]
    (tmp_path / "new").mkdir()
    assert read_image_sizes(spark, str(tmp_path / "new")).count() == 0
    (tmp_path / "new" / "only_run_meta.json").write_bytes(b"")
    assert [r["error"] for r in read_manifests(spark, str(tmp_path / "new")).collect()] == ["empty file"]
    assert read_image_sizes(spark, str(tmp_path / "img" / "menu.bmp")).first()["width"] == 200


def test_empty_files_count_as_newest(spark, tmp_path):
    for n, name in enumerate(["old.json", "new.json"]):
        (tmp_path / name).write_text("{}" if n == 0 else "")
        os.utime(tmp_path / name, (1_700_000_000 + n, 1_700_000_000 + n))
    (row,) = latest_file(list_files(spark, str(tmp_path)), "directory").collect()
    assert row["path"].endswith("/new.json")


def test_sizes_from_headers_are_those_of_decoded_images(spark, tmp_path):
    jvm = spark._jvm
    for kind in ("png", "jpg", "gif", "bmp"):
        for w, h in ((1, 1), (300, 7), (641, 1025)):
            image = jvm.java.awt.image.BufferedImage(w, h, 5)
            assert jvm.javax.imageio.ImageIO.write(image, kind, jvm.java.io.File(f"{tmp_path}/{w}x{h}.{kind}"))
    # Segments that are longer together than any fixed head, fill bytes, and a restart marker.
    jpeg = (tmp_path / "300x7.jpg").read_bytes()
    segment = b"\xff\xe1" + (60_000).to_bytes(2, "big") + b"\xff\xc0" * 29_999
    (tmp_path / "exif.jpg").write_bytes(jpeg[:2] + segment * 4 + b"\xff\xff\xd0" + jpeg[2:])
    decoded = spark.read.format("image").load(str(tmp_path)).select(F.element_at(F.split("image.origin", "/"), -1), "image.width", "image.height")
    sizes = read_image_sizes(spark, str(tmp_path)).select(F.element_at(F.split("path", "/"), -1).alias("name"), "width", "height", "error")
    got = {r[0]: r[1:3] for r in sizes.collect()}
    assert got.pop("exif.jpg") == (300, 7)
    assert {r[0]: tuple(r[1:]) for r in decoded.where("image.origin NOT LIKE '%exif%'").collect()} == got and len(got) == 12
    for name, raw in {"cut.jpg": jpeg[:20], "cut.png": b"\x89PNG\r\n\x1a\n", "sos.jpg": b"\xff\xd8\xff\xda\x00\x08", "zero.gif": b"GIF89a\0\0\0\0"}.items():
        (tmp_path / name).write_bytes(raw)
    bad = read_image_sizes(spark, str(tmp_path)).where("error = 'not an image' AND width IS NULL")
    assert bad.count() == 4


def test_large_folders_are_several_partitions(monkeypatch, tmp_path):
    monkeypatch.setattr(listing, "FILES_PER_TASK", 3)
    for d in ("a", "a/b", "a/.c"):
        (tmp_path / d).mkdir()
        for n in range(10):
            (tmp_path / d / f"f{n}.json").write_bytes(b"x" * (n % 2))
    reader = listing.Reader({"path": str(tmp_path), "recursive": "true", "pattern": "*.json"})
    shares = reader.partitions()
    found = [p for s in shares for batch in reader.read(s) for p in batch.column("path").to_pylist()]
    assert len(shares) == 8 and sorted(found) == sorted(f"file:{tmp_path}/{d}/f{n}.json" for d in ("a", "a/b") for n in range(10))
    with pytest.raises(FileNotFoundError):
        listing.Reader({"path": str(tmp_path / "gone")}).partitions()


def test_list_layout(spark, tmp_path):
    entries = [
        {"text": "밥", "confidence": 0.9, "bbox": [[1, 1], [9, 1], [9, 5], [1, 5]]},
        {"text": "x", "confidence": 0.5, "bbox": [[0, 0], [300.0, 0], [1, 5], [1, 5]]},
    ]
    (tmp_path / "m_ocr.json").write_text(json.dumps(entries, ensure_ascii=False, indent=1), encoding="utf-8")
    items = read_ocr_list(spark, str(tmp_path)).withColumn("image_id", stem("path"))
    assert [(r["pos"], r["text"]) for r in items.orderBy("pos").collect()] == [(0, "밥"), (1, "x")]
    images = spark.createDataFrame(
        [("m_ocr", 100, 100, "min", 200.0)], "image_id string, width int, height int, limit_type string, limit_side_len double"
    )
    words = spark.createDataFrame([("밥", "rice")], "ko string, en string")
    (row,) = plan_entries(items, images, words).collect()
    assert (row["x1"], row["x2"], row["shape"]) == (0, 4, "polygon")


def test_sample(spark, tmp_path):
    """A list file of the usual size, with repeated and foreign texts."""
    entries = [
        {"text": f"{'메뉴' if n % 3 else 'menu'} {n % 70}", "confidence": 0.5 + n / 250, "bbox": [[n, 2 * n], [n + 50.5, 2 * n], [n + 50.5, 2 * n + 20], [n, 2 * n + 20]]}
        for n in range(105)
    ]
    (tmp_path / "sample_ocr.json").write_text(json.dumps(entries, ensure_ascii=False), encoding="utf-8")
    items = read_ocr_list(spark, str(tmp_path))
    placed = place_items(items)
    assert (items.count(), placed.count(), items.select("text").distinct().count()) == (105, 105, len({e["text"] for e in entries}))
    assert placed.where(keep_script("text") != "").count() == 70
    assert placed.agg(F.max("bbox.x2"), F.max("bbox.y2")).first()[:] == (154.0, 228.0)


def test_image_without_items_has_facts(spark):
    items = spark.createDataFrame([], "image_id string, bbox struct<x1 double,y1 double,x2 double,y2 double>")
    images = spark.createDataFrame(
        [("a", 10, 10, None, None)], "image_id string, width int, height int, limit_type string, limit_side_len double"
    )
    assert tuple(image_facts(items, images).first()) == ("a", "orig", 1.0)


def test_latest_file(spark, tmp_path):
    for n, (d, f, t) in enumerate([("a", "1.json", 50), ("a", "2.json", 90), ("b", "3.json", 10), ("b", "4.json", 10)]):
        (tmp_path / d).mkdir(exist_ok=True)
        (tmp_path / d / f).write_text("{}")
        os.utime(tmp_path / d / f, (1_700_000_000 + t, 1_700_000_000 + t))
    newest = latest_file(list_files(spark, str(tmp_path), "*.json"), "directory")
    assert sorted(r["path"].rsplit("/", 1)[1] for r in newest.collect()) == ["2.json", "4.json"]


def test_q42_stages_words_only(spark, tmp_path, monkeypatch):
    from rowsmith.catalog import ocr

    staged = []
    monkeypatch.setattr(ocr.i, "stage", lambda _: lambda df: (staged.append(df.columns), df)[1])
    docs = spark.createDataFrame([(1, "One two, two", "en", 12), (2, None, "en", 0)], "doc_id bigint, text string, lang string, n_chars bigint")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    rows = ocr.q42_translate_fn(spark, str(tmp_path)).collect()
    assert staged == [["doc_id", "ko"]]
    assert [tuple(r) for r in rows] == [(1, 3, 2, "TWO")]


def test_keep_script_leaves_whole_words(spark):
    from rowsmith.functions.text import keep_script

    texts = ["abc", "", "a\n", "\n", "aé", "a b", " a", "A", None]
    rows = spark.createDataFrame([(n, t) for n, t in enumerate(texts)], "n int, t string")
    got = {r["n"]: r["k"] for r in rows.select("n", keep_script("t", "a-zé").alias("k")).collect()}
    assert [got[n] for n in range(len(texts))] == ["abc", "", "a", "", "aé", "a b", "a", "", ""]
