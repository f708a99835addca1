import pytest
from pyspark.sql import functions as F

from boardlake.functions import files as ff
from boardlake.functions.documents import document_diff, flatten
from boardlake.operators import curation as op
from boardlake.operators import inspections as ins
from boardlake.sources import labelled_files as lf


def text_frame(spark, rows, names):
    return spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names))


def test_profile_types(spark):
    df = text_frame(spark, [("pass", "0.95", "true"), ("fail", "", "false")], ["label", "score", "enabled"])
    got = {r["column_name"]: r for r in op.column_profile(df, df.columns).collect()}
    assert [got[c]["data_type"] for c in ("label", "score", "enabled")] == ["text", "number", "boolean"]
    assert got["score"]["missing_count"] == 1 and got["score"]["unique_count"] == 1


def test_profile_reads_numbers_as_python_does(spark):
    values = ["nan", "-Infinity", "1e-3", "+.5", "1_000"]
    df = text_frame(spark, [(v,) for v in values], ["n"])
    assert op.column_profile(df, ["n"]).first()["data_type"] == "number"
    assert op.column_profile(text_frame(spark, [("1,5",)], ["n"]), ["n"]).first()["data_type"] == "text"


def test_split_and_distribution(spark):
    df = spark.createDataFrame([(i, "pass" if i < 2 else "fail") for i in range(4)], "i bigint, label string")
    parts = op.ordered_split(df, "i", 0.5, 0.25).groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in parts} == {"train": 2, "validation": 1, "test": 1}
    assert {r["target"]: r["n"] for r in op.label_distribution(df, "label").collect()} == {"pass": 2, "fail": 2}
    with pytest.raises(ValueError):
        op.ordered_split(df, "i", 0.9, 0.2)


def test_scaling_is_fitted_on_train_only(spark):
    df = spark.createDataFrame([(0, 1.0), (1, 3.0), (2, 100.0), (3, 200.0)], "i bigint, score double")
    train = df.where("i < 2")
    fit = op.fit_numeric(train, ["score"]).first()
    assert (fit["mean"], fit["median"], fit["scale"]) == (2.0, 1.0, 1.0)
    done = op.apply_preprocessing(df, train, ["score"], [], {"scaling": "standard"}).orderBy("i").collect()
    assert done[0]["score"] == -1.0 and done[3]["score"] == 198.0


def test_all_empty_column_fills_zero(spark):
    df = spark.createDataFrame([(0, None), (1, None)], "i bigint, score double")
    fit = op.fit_numeric(df, ["score"]).first()
    assert (fit["mean"], fit["median"], fit["scale"], fit["missing_count"]) == (0.0, 0.0, 1.0, 2)
    with pytest.raises(ValueError):
        op.apply_preprocessing(df, df, ["score"], [], {"numeric_missing": "error"})


def test_policy_is_checked():
    with pytest.raises(ValueError):
        op.check_policy({"scaling": "robust"}, ["a"], [])
    with pytest.raises(ValueError):
        op.check_policy({"scaling": "standard"}, [], ["b"])
    with pytest.raises(ValueError):
        op.check_policy({"categorical_encoding": "one-hot"}, ["a"], [])
    with pytest.raises(ValueError):
        op.check_policy({"colour": "red"}, ["a"], [])


def test_most_frequent_tie_takes_smallest(spark):
    df = text_frame(spark, [("b",), ("a",), ("c",), ("",)], ["v"])
    got = op.fit_categories(df, "v").orderBy("code").collect()
    assert [r["value"] for r in got] == ["a", "b", "c"]
    assert [r["is_most_frequent"] for r in got] == [True, False, False]


def test_delimiter_detection(spark, tmp_path):
    assert lf.detect_delimiter("a;b;c\n1;2;3") == ";"
    with pytest.raises(ValueError):
        lf.detect_delimiter("abc")
    (tmp_path / "x.csv").write_text("﻿id\tname\n1\t\" a \"\n2\t\n", encoding="utf-8")
    rows = lf.read_csv(spark, str(tmp_path / "x.csv")).orderBy("id").collect()
    assert [tuple(r) for r in rows] == [("1", "a"), ("2", "")]
    (tmp_path / "y.csv").write_text("id,id\n1,2\n")
    with pytest.raises(ValueError):
        lf.read_csv(spark, str(tmp_path / "y.csv"))


def test_csv_records(spark, tmp_path):
    (tmp_path / "q.csv").write_text('id,note\n1,"x\ny"\n , \n2\n3,a,b\n')
    rows = lf.read_csv(spark, str(tmp_path / "q.csv")).orderBy("id").collect()
    assert [tuple(r) for r in rows] == [("1", "x\ny"), ("2", ""), ("3", "a")]
    (tmp_path / "s.csv").write_text('1,"x\ny"\n,\n2\n3,a,b\n')
    assert tuple(lf.csv_shape(spark, str(tmp_path / "s.csv"), ",", 2).first()) == (3, 1, 2)
    names = [f"column_{i:04d}" for i in range(1000)]
    (tmp_path / "w.csv").write_text(",".join(names) + "\n" + ",".join(map(str, range(1000))) + "\n")
    wide = lf.read_csv(spark, str(tmp_path / "w.csv"))
    assert wide.columns == names and wide.first()["column_0999"] == "999"
    (tmp_path / "b.csv").write_bytes(b"id,n\n1,\xff\n")
    with pytest.raises(ValueError):
        lf.read_csv(spark, str(tmp_path / "b.csv"))


def test_jpeg_frames():
    frame = b"\xff\xc2" + (17).to_bytes(2, "big") + b"\x08" + (5).to_bytes(2, "big") + (9).to_bytes(2, "big") + bytes(10)
    comment = b"\xff\xfe" + (4).to_bytes(2, "big") + b"hi"
    assert ff._frame_size(b"\xff\xd8" + comment + b"\xff\xff" + frame) == (9, 5)
    assert ff._frame_size(b"\xff\xd8" + b"\xff" * 200 + frame[1:]) == (9, 5)
    assert ff._frame_size(b"\xff\xd8" + comment + frame[:8]) is None
    assert ff._frame_size(b"\xff\xd8\xff\xda" + frame) is None and ff._frame_size(b"") is None


def test_tree_scan_keeps_files_without_category(spark, tmp_path):
    for path in ("boards/a.PNG", "boards/ok/b.Jpg", "boards/.x/c.png"):
        file = tmp_path / path
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_bytes(b"x")
    got = lf.scan_tree(spark, f"file:{tmp_path}", ["png", "jpg"]).orderBy("filename").collect()
    assert [(r["category"], r["filename"]) for r in got] == [(None, "a.PNG"), ("ok", "b.Jpg")]


def test_tree_scan_leaves_out_hidden_and_reserved(spark, tmp_path):
    for path in ("boards/ok/a.png", "boards/ok/.hidden.png", "boards/ng/b.png", "boards/artifacts/c.png", "boards/ok/d.txt"):
        file = tmp_path / path
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_bytes(b"\x89PNG" + bytes(12) + (5).to_bytes(4, "big") + (7).to_bytes(4, "big"))
    files = lf.scan_tree(spark, f"file:{tmp_path}", ["png", "jpg"], with_content=True)
    got = ff.with_image_header(files, "filename").orderBy("filename").collect()
    assert [(r["category"], r["filename"], r["width"], r["height"]) for r in got] == [("ok", "a.png", 5, 7), ("ng", "b.png", 5, 7)]


def test_tampered_file_is_reported(spark):
    declared = spark.createDataFrame([("train", "aa", 2), ("test", "bb", 3), ("gone", "cc", 1)], "name string, sha256 string, byte_length bigint")
    actual = spark.createDataFrame([("train", "aa", 2), ("test", "xx", 4)], "name string, sha256 string, byte_length bigint")
    got = {(r["name"], r["issue"]) for r in op.manifest_issues(declared, actual, "name").collect()}
    assert got == {("test", "checksum-mismatch"), ("test", "length-mismatch"), ("gone", "missing")}


def test_running_limit_on_a_large_source(spark):
    df = spark.range(100).select("id", F.lit("s").alias("source"), F.lit(10).alias("size"))
    for hot in (1000, 7):
        got = op.running_limit(df, ["source"], ["id"], F.col("size"), 555, 1000, hot_rows=hot).groupBy("state").count().collect()
        assert {r["state"]: r["count"] for r in got} == {"accepted": 55, "byte-limit-exceeded": 1, "skipped": 44}


def test_document_diff_reports_shallowest_path(spark):
    rows = [(1, '{"a": {"b": 1}, "l": [1, 2, 3], "x": null}', '{"a": 5, "l": [1, 9], "y": {"z": []}, "x": null}')]
    df = spark.createDataFrame(rows, "id bigint, s string, c string")
    got = {(r["path"], r["submitted"], r["current"]) for r in document_diff(df, "id", "s", "c").collect()}
    assert got == {("$.a", '{"b":1}', "5"), ("$.l[1]", "2", "9"), ("$.l[2]", "3", None), ("$.y", None, '{"z":[]}')}
    leaves = {(r["path"], r["value"]) for r in flatten(df, ["id"], "c").collect()}
    assert leaves == {("$.a", "5"), ("$.l[0]", "1"), ("$.l[1]", "9"), ("$.y.z", "[]"), ("$.x", "null")}


def test_evidence_pages_keep_everything(spark):
    results = spark.createDataFrame([(1,), (2,)], "id bigint")
    evidence = spark.range(25).select(F.lit(1).cast("bigint").alias("result_id"), F.col("id").alias("at"))
    pages = ins.evidence_pages(results, evidence, ["at"], F.col("at"), rows_per_page=10).orderBy("id", "page").collect()
    assert [(r["id"], r["page"], len(r["items"] or [])) for r in pages] == [(1, 0, 10), (1, 1, 10), (1, 2, 5), (2, None, 0)]
    assert sum((r["items"] for r in pages[:3]), []) == list(range(25))


def test_yield_rounds_half_up_and_empty_is_zero(spark):
    schema = "result string, defect_count int, review_decision string"
    rows = [("PASS", 0, None)] * 1 + [("FAIL", 1, None)] * 15
    assert ins.kpis(spark.createDataFrame(rows, schema)).first()["first_pass_yield"] == 6.3
    empty = ins.kpis(spark.createDataFrame([], schema)).first()
    assert (empty["total_inspections"], empty["first_pass_yield"], empty["total_defects"]) == (0, 0.0, 0)


def test_document_diff_with_a_document_on_one_side_only(spark):
    df = spark.createDataFrame([(1, '{"a": 1}', None), (2, None, "[1]"), (3, None, None), (4, "null", None)], "id int, s string, c string")
    got = {tuple(r) for r in document_diff(df, "id", "s", "c").collect()}
    assert got == {(1, "$", '{"a":1}', None), (2, "$", None, "[1]"), (4, "$", "null", None)}


def test_wide_categories_are_encoded_without_a_list(spark):
    n = 100_000
    rows = spark.range(n).select((F.col("id") % 90_000).cast("string").alias("v"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("w"))
    done = op.sparse_one_hot(rows, rows, ["v", "w"])
    assert done.select("encoded.size").distinct().collect() == [(90_002,)]
    assert done.agg(F.min(F.size("encoded.indices")), F.countDistinct(F.col("encoded.indices")[0])).first() == (2, 90_000)
    with pytest.raises(ValueError):
        op.vocabulary(rows, "v")


def test_sparse_codes_follow_the_training_rows(spark):
    train = spark.createDataFrame([("b", "x"), ("a", "y"), ("b", None)], "v string, w string")
    df = spark.createDataFrame([(1, "a", "y"), (2, "new", "x"), (3, None, ""), (4, "b", "new")], "id int, v string, w string")
    got = {r["id"]: (r["encoded"]["size"], r["encoded"]["indices"], r["encoded"]["values"]) for r in op.sparse_one_hot(df, train, ["v", "w"]).collect()}
    assert got == {1: (4, [0, 3], [1.0, 1.0]), 2: (4, [2], [1.0]), 3: (4, [1, 2], [1.0, 1.0]), 4: (4, [1], [1.0])}
    assert op.sparse_one_hot(df, train, []).select("encoded.size").first()[0] == 0


def test_documents_by_level(spark):
    from boardlake.functions.documents import document_diff, flatten

    rows = [
        (1, '{"a":{"b":[1,{"c":null}],"d":{}},"e":"x\\"{[","f":[]}', '{"a":{"b":[1,{"c":2},3],"d":[]},"g":1}'),
        (2, "3", "3.0"), (3, None, '{"a":1}'), (4, "[1,2]", '{"a":1}'), (5, "null", "null"), (6, "null", None), (7, None, None),
        (8, '{"k":1000}', '{"k":1e3}'), (9, "[[[]]]", "[[[1]]]"), (10, '{"a":"12"}', '{"a":12}'), (11, '{"z":{"y":[]}, "a":"é"}', '{"a":"é","z":{"y":[]}}'),
    ]
    df = spark.createDataFrame(rows, "id int, s string, c string")
    flat = flatten(df, ["id"], "s")
    assert {tuple(r) for r in flat.collect()} == {
        (1, "$.a.b[0]", "1"), (1, "$.a.b[1].c", "null"), (1, "$.a.d", "{}"), (1, "$.e", '"x\\"{["'), (1, "$.f", "[]"), (2, "$", "3"),
        (4, "$[0]", "1"), (4, "$[1]", "2"), (5, "$", "null"), (6, "$", "null"), (8, "$.k", "1000"), (9, "$[0][0]", "[]"), (10, "$.a", '"12"'),
        (11, "$.z.y", "[]"), (11, "$.a", '"é"'),
    }
    found = document_diff(df, "id", "s", "c")
    assert {tuple(r) for r in found.collect()} == {
        (1, "$.a.b[1].c", "null", "2"), (1, "$.a.b[2]", None, "3"), (1, "$.a.d", "{}", "[]"), (1, "$.e", '"x\\"{["', None), (1, "$.f", "[]", None),
        (1, "$.g", None, "1"), (3, "$", None, '{"a":1}'), (4, "$", "[1,2]", '{"a":1}'), (6, "$", "null", None), (9, "$[0][0][0]", None, "1"), (10, "$.a", '"12"', "12"),
    }
    for made in (flat, found):
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Pandas" not in plan and "Exchange" not in plan
    assert flatten(df.limit(0), ["id"], "s").count() == document_diff(df.limit(0), "id", "s", "c").count() == 0


def test_files_with_other_headers_are_refused(spark, tmp_path):
    folder = tmp_path / "many"
    folder.mkdir()
    (folder / "a.csv").write_text("a,b\n1,2\n")
    (folder / "b.csv").write_text("a,b\n3,4\n")
    assert sorted(tuple(r) for r in lf.read_csv(spark, str(folder)).collect()) == [("1", "2"), ("3", "4")]
    (folder / "c.csv").write_text("b,a\n5,6\n")
    with pytest.raises(Exception, match="CSV"):
        lf.read_csv(spark, str(folder)).collect()


def test_empty_lines_are_blank_rows(spark, tmp_path):
    (tmp_path / "x.csv").write_text("1,2\n\n,\n   \n3,4\n")
    assert tuple(lf.csv_shape(spark, str(tmp_path / "x.csv"), ",", 2).first()) == (2, 3, 0)


def test_only_files_of_datasets_and_categories_are_listed(spark, tmp_path):
    for name in ("top.png", "d/one.png", "d/cat/two.png", "d/cat/deep/three.png"):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(b"x")
    got = {(r["dataset"], r["category"], r["filename"]) for r in lf.scan_tree(spark, str(tmp_path), ["png"]).collect()}
    assert got == {("d", None, "one.png"), ("d", "cat", "two.png")}
    (tmp_path / "d" / "cat" / "_x.png").write_bytes(b"x")
    with pytest.raises(ValueError, match="_x.png"):
        lf.scan_tree(spark, str(tmp_path), ["png"])
