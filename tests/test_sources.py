import math

import numpy as np
import pytest

from assaylake.sources import readers as R
from assaylake.sources import writers as W
from assaylake.streaming.scoring import stream_stouffer, stream_z


def test_wide_file(spark, tmp_path):
    p = tmp_path / "wide.csv"
    p.write_text("Name,Area: posneg_MZ25_36_25230101131_1.raw (F1),Area: QC3_2.raw (F2)\nGlucose,10,x\nLow,1,\n", encoding="utf-8")
    got = {(r.feature, r.sample_id): r.value for r in R.read_wide(spark, str(p), 5.0).collect()}
    assert got == {("Glucose", "posneg_MZ25_36_25230101131"): 10.0, ("Glucose", "QC3"): None}


def test_encodings(spark, tmp_path):
    run = "Input Files\tFile Name\tCreation Date\nF1\tC:\\d\\S1_1.raw\t02-01-2024 10:00:00\nF2\tS1_2.raw\t01-01-2024 10:00:00\nF3\tS2.raw\tbad\n"
    for enc in ("utf-16", "utf-8"):
        p = tmp_path / f"run_{enc}.txt"
        p.write_text(run, encoding=enc)
        got = {r.name: r.injection_order for r in R.read_run_metadata(spark, str(p)).collect()}
        assert got == {"S1": 0, "S2": 1}
    p = tmp_path / "latin.csv"
    p.write_bytes("Monster;Oordeel targeted;Classification\nPatiënt;1;0\n".encode("latin-1"))
    r = R.read_labels(spark, str(p)).first()
    assert (r.sample_id, r.oordeel, r.classification, r.non_treated) == ("Patiënt", 1.0, 0.0, None)


def test_matrix_keeps_first(spark, tmp_path):
    p = tmp_path / "m.csv"
    p.write_text("Sample,Classification,f1\ns1,0,1\ns1,1,2\ns2,,3\n")
    assert [tuple(r) for r in R.read_matrix(spark, str(p), ["Classification"]).collect()] == [("s1", 0.0, "f1", 1.0)]


def test_reference_files(spark, tmp_path):
    x = tmp_path / "h.xml"
    x.write_text('<hmdb xmlns="http://www.hmdb.ca"><metabolite><accession>HMDB0000001</accession><name>One</name><synonyms><synonym>Uno</synonym></synonyms></metabolite><metabolite><accession>bad</accession><name>Two</name></metabolite></hmdb>')
    assert [tuple(r) for r in R.read_compound_xml(spark, str(x)).collect()] == [("HMDB0000001", "One", ["Uno"])]
    p = tmp_path / "p.csv"
    p.write_text("pathway_id,hmdb_id,species\nSMP1, hmdb1 ,Homo sapiens\nSMP1,HMDB1,Homo sapiens\nSMP1,,Homo sapiens\nSMP2,HMDB2,Mus\n")
    assert [tuple(r)[:3] for r in R.read_pathway_metabolites(spark, str(p), "Homo sapiens").collect()] == [("SMP1", "SMP1", "HMDB1")]
    assert R.read_attachments(spark, str(tmp_path / "no.csv")).count() == 0
    d = spark.createDataFrame([("D1", "Octanoylcarnitine ↑; Glucose ↓", "Octanoylcarnitine (HMDB0000215); Glucose (HMDB0000122; x)", "see SMP0000001"), ("D2", "none", "none", None)], ["Disease", "Biochemical_Markers", "HMDB codes of named metabolites", "SMPDB code (SMP)"])
    got = [(r.marker, r.direction, r.hmdb_ids, r.smp_id) for r in R.parse_diseases(d).collect()]
    assert got == [("Octanoylcarnitine", "up", ["HMDB0000215"], "SMP0000001"), ("Glucose", "down", ["HMDB0000122"], "SMP0000001")]


def test_settings():
    c = R.Config({"a": {"b": 1, "n": None}, "l": "x"})
    assert (c.get("a.b"), c.get("a.n", 5), c.get("z.z", 7), c.get_list("l"), c.get_float("a.b", 0.0)) == (1, 5, 7, ["x"], 1.0)
    c.set("q.r", 2)
    assert c.get("q.r") == 2
    assert R.scorer_options("k=5, flag=true, name=x") == {"k": 5, "flag": True, "name": "x"}
    assert R.sniff_delimiter("a\tb\n1\t2\n") == "\t"


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([("a", "s", 1.0), ("b", "s", 2.0)], "feature string, sample string, value double")
    assert W.widen(df, "sample", "feature", "value").first().asDict() == {"sample": "s", "a": 1.0, "b": 2.0}
    W.write_table(df, str(tmp_path / "t"), ["feature"])
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2
    W.save_model(spark, str(tmp_path / "m"), "pca", mean=np.arange(3.0), axes=np.eye(3)[:2])
    kind, arrays = W.load_model(spark, str(tmp_path / "m"))
    assert kind == "pca" and arrays["axes"].shape == (2, 3) and np.allclose(arrays["mean"], [0, 1, 2])
    W.write_json({"x": np.float64(1.5)}, str(tmp_path / "x.json"))
    assert "| feature |" in W.markdown_report("T", {"rows": df})
    (tmp_path / "src.csv").write_text("x")
    assert R.cached(spark, lambda: df, str(tmp_path / "src.csv"), str(tmp_path / "cache")).count() == 2


def test_streaming_scores(spark, tmp_path):
    rows = [(f"s{i}", f"f{j}", float(i + 1), "2024-01-01 00:00:00") for i in range(2) for j in range(4)] * 2
    spark.createDataFrame(rows, "sample string, feature string, value double, t string").selectExpr("sample", "feature", "value", "cast(t as timestamp) at").write.parquet(str(tmp_path / "in"))
    ref = spark.createDataFrame([(f"f{j}", 0.0, 1.0) for j in range(4)], "feature string, median double, scale double")
    links = spark.createDataFrame([(f"f{j}", "P") for j in range(4)], "feature string, smp_id string")
    cells = spark.readStream.schema("sample string, feature string, value double, at timestamp").parquet(str(tmp_path / "in"))
    q = stream_stouffer(stream_z(cells, ref), links).writeStream.format("memory").queryName("scored").outputMode("update").start()
    try:
        q.processAllAvailable()
        got = {r["sample"]: (r.k, r.z_stouffer) for r in spark.sql("select * from scored").collect()}
    finally:
        q.stop()
    assert got == {"s0": (4, pytest.approx(2.0)), "s1": (4, pytest.approx(8 / math.sqrt(4)))}


def test_files_wider_than_a_plan(spark, tmp_path):
    # Beyond the 10,000 values of a pivot and the 20,480 columns of Spark's CSV reader; a quoted name, a missing and a repeated cell.
    n, p = 25_000, str(tmp_path / "wide")
    cells = spark.range(n).selectExpr("'a, \"b\\\\' as Name", "'F' as Formula", "'1.5' as `RT [min]`", "concat('Area: S', id, '.raw (F1)') as c", "cast(id as double) + 0.5 as value")
    more = spark.createDataFrame([("x", "F", "1.5", f"Area: S{n - 2}.raw (F1)", v) for v in (3.0, 3.0)] + [("x", "F", "1.5", "Area: S7.raw (F1)", None), ("none", None, "1.5", "Area: S7.raw (F1)", None)], "Name string, Formula string, `RT [min]` string, c string, value double")
    W.write_wide(cells.unionByName(more), ["Name", "Formula", "RT [min]"], "c", "value", p)
    got = R.read_wide(spark, p)
    assert got.count() == 3 * n
    want = {('a, "b\\', f"S{i}"): i + 0.5 for i in range(n)} | {("x", f"S{n - 2}"): 3.0}
    assert {(r.feature, r.sample_id): r.value for r in got.where("value is not null").collect()} == want
    got = R.read_batch_file(spark, p)
    want = {('a, "b\\_F_1.5', f"Area: S{i}.raw (F1)"): i + 0.5 for i in range(n)} | {("x_F_1.5", f"Area: S{n - 2}.raw (F1)"): 3.0}
    assert got.count() == 2 * n
    assert {(r.feature, r.original_col): r.value for r in got.where("value is not null").collect()} == want


def test_lines_of_wide_files(spark, tmp_path):
    text = 'Formula;Name;RT;Area: 1;Area: 1;Area: "2\nF1;"a;""b""";1.5;1;2;\nF1;"a;""b""";1.5;"3";;x;9\n\nF2;c\nF2;;2;;;7\r\n'
    for enc, sep in (("utf-8", ";"), ("utf-16", ";"), ("latin-1", "\t")):
        (tmp_path / enc).write_bytes(text.replace("c\n", "é\n").replace(";", sep).encode(enc))
        got = {(r.feature, r.original_col): r.value for r in R.read_batch_file(spark, str(tmp_path / enc)).collect()}
        a, cols = f'a{sep}"b"_F1_1.5', ("Area: 13", "Area: 14", 'Area: "2')
        want = {a: (1.0, 2.0, None), f"{a} 2": (3.0, None, None), "é_F2": (None, None, None), "_F2_2": (None, None, 7.0)}
        assert got == {(f, c): v for f, vs in want.items() for c, v in zip(cols, vs, strict=True)}


def test_wide_file_without_rows(spark, tmp_path):
    df = spark.createDataFrame([], "Name string, c string, value double")
    W.write_wide(df, ["Name"], "c", "value", str(tmp_path / "none"))
    assert R.read_wide(spark, str(tmp_path / "none")).count() == 0
