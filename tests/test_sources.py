"""Sources and sinks: round trips, header rules, typed cells; streams that store."""

import gzip

import pytest
from pyspark.sql import functions as F

from fathom.config import FieldConfig, IndexConfig, QueryError
from fathom.operators import store
from fathom.sources import readers as R
from fathom.sources import writers as W
from fathom.streaming import nrt


def test_headers():
    assert R.header_names([" a ", "", "a", "a", None]) == ["a", "column2", "a_2", "a_3", "column5"]
    for bad in (["a", "a"], ["a", ""]):
        with pytest.raises(QueryError):
            R.header_names(bad, strict=True)


def test_delimited(spark, tmp_path):
    p = tmp_path / "x.csv"
    p.write_text('id,tags,id\n1,"a; b;;c","x, ""y"""\n2,,z\n')
    df = R.read_sheet(spark, str(p))
    assert df.columns == ["id", "tags", "id_2"]
    rows = df.select(R.as_list(F.col("tags")), "id_2").collect()
    assert rows[0][0] == ["a", "b", "c"] and rows[0][1] == 'x, "y"' and rows[1][0] is None
    with gzip.open(tmp_path / "y.tsv.gz", "wt") as f:
        f.write("a\tb\n1\tyes\n")
    assert R.read_sheet(spark, str(tmp_path / "y.tsv.gz")).select(R.typed(F.col("a"), "int", 0), R.as_bool(F.col("b"))).first() == (1, True)
    assert R.read_csv(spark, str(p), header=False).count() == 3
    got = spark.createDataFrame([("1", "x", "2014-01-02"), ("q", "T", None)], "a string, b string, c string").select(R.typed(F.col("a"), "long", -1), R.typed(F.col("b"), "bool", False), R.typed(F.col("c"), "date").cast("date").cast("string")).collect()
    assert [tuple(r) for r in got] == [(1, False, "2014-01-02"), (-1, True, None)]
    with pytest.raises(QueryError):
        R.read_sheet(spark, "x.pdf")


def test_json(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"a": 1}\n{bad\n{"a": 2}\n')
    assert R.read_json_lines(spark, str(tmp_path / "a.jsonl"), skip_bad=True, schema="a int").count() == 2
    with pytest.raises(Exception):  # noqa: B017
        R.read_json_lines(spark, str(tmp_path / "a.jsonl"), schema="a int").collect()
    (tmp_path / "b.json").write_text('[{"a": 1, "b": {"c": [1]}}, {"a": 2}]')
    assert sorted(r.a for r in R.read_sheet(spark, str(tmp_path / "b.json")).collect()) == [1, 2]
    (tmp_path / "c.json").write_text("[1, 2]")
    with pytest.raises(Exception):  # noqa: B017
        R.read_json_array(spark, str(tmp_path / "c.json")).collect()


def test_excel(spark, tmp_path):
    df = spark.createDataFrame([(1, "a <b>", True, 2.5, None)], "n int, s string, b boolean, d double, e string")
    W.write_sheet(df, str(tmp_path / "x.xlsx"))
    back = R.read_sheet(spark, str(tmp_path / "x.xlsx"))
    assert back.columns == ["n", "s", "b", "d", "e"] and tuple(back.first()) == ("1", "a <b>", "true", "2.5", None)
    with pytest.raises(QueryError):
        R.sheet_rows(W.workbook(["a"], [[1]]), "other")


def test_written_cells(spark, tmp_path):
    df = spark.createDataFrame([(1, 1.23456, True, ["a", "b"], ("t", "http://x"))], "n long, d double, b boolean, l array<string>, u struct<label:string,href:string>")
    assert tuple(W.as_text(df).first()) == ("1", "1.235", "True", "a;b", "http://x")
    W.write_sheet(df, str(tmp_path / "o.csv"))
    with pytest.raises(Exception):  # noqa: B017
        W.write_sheet(df, str(tmp_path / "o.csv"))
    W.write_sheet(df, str(tmp_path / "o.csv"), overwrite=True)
    assert R.read_csv(spark, str(tmp_path / "o.csv")).first().l == "a;b"
    W.write_sheet(df, str(tmp_path / "o.jsonl"))
    assert spark.read.json(str(tmp_path / "o.jsonl")).first().n == 1


def test_dump_and_restore(spark, tmp_path):
    c = IndexConfig("i", "id", (FieldConfig("id", "LONG"),))
    store.dump(spark.range(5), c, str(tmp_path / "d"))
    df, back = store.restore(spark, str(tmp_path / "d"))
    assert df.count() == 5 and back == c
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "a.bin").write_bytes(b"xyz")
    assert store.files_table(spark, str(tmp_path / "f")).select("filename", "length").first() == ("a.bin", 3)


def test_tallies(spark):
    df = spark.createDataFrame([(1, {"x": 1}, '{"k": 1}'), (2, None, '{"k": "s", "m": null}')], "id int, d struct<x:int>, j string")
    got = {(r.path, r.kind): r.docs for r in store.schema_tally(df).collect()}
    assert got[("d", "document")] == 1 and got[("d.x", "int")] == 1 and got[("id", "int")] == 2
    assert sum(r.docs for r in store.json_tally(df, "j").where("key = 'k'").collect()) == 2


def test_streamed_store(spark, tmp_path):
    src, table = str(tmp_path / "in"), str(tmp_path / "t")
    for i, rows in enumerate(([(1, 1, "a", False), (2, 1, "b", False)], [(1, 2, "c", False), (2, 2, "b", True)])):
        spark.createDataFrame(rows, "id int, ts int, v string, gone boolean").coalesce(1).write.mode("append").json(src)
        changes = spark.readStream.schema("id int, ts int, v string, gone boolean").json(src)
        nrt.store_stream(changes, table, str(tmp_path / "cp")).awaitTermination()
        now = {r.id: r.v for r in nrt.current(spark, table, "id", "ts", "gone").collect()}
        assert now == ({1: "a", 2: "b"} if i == 0 else {1: "c"})
    nrt.compact(spark, table, str(tmp_path / "t2"), "id", "ts")
    assert nrt.current(spark, str(tmp_path / "t2"), "id", "ts").count() == 2
