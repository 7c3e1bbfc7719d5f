"""Single files written by all tasks: content, order, what a failure leaves."""

import csv
import json
import zipfile
from xml.etree import ElementTree

import pytest
from pyspark.sql import functions as F

from lumenweft import fixed
from lumenweft.sources import files, sinks

ROWS = [(3, 'a "q", é<&>\'', None), (1, "line\nbreak\t", "x"), (2, "", " y "), (4, "\\ end", "}],")]


@pytest.fixture
def table(spark):
    return spark.createDataFrame(ROWS, "`n` int, `te xt` string, `k\"` string").repartition(3).orderBy("n")


def expected():
    return [[str(n), a or "", b or ""] for n, a, b in sorted(ROWS)]


def test_json_arrays_and_envelopes(spark, table, tmp_path):
    sinks.write_json_array(table, f"{tmp_path}/a.json")
    text = (tmp_path / "a.json").read_text()
    assert text == json.dumps([dict(zip(table.columns, r, strict=True)) for r in expected()], ensure_ascii=False, indent=2)
    sinks.write_json_array(table.where("false"), f"{tmp_path}/a.json")  # takes the place of the other
    assert json.loads((tmp_path / "a.json").read_text()) == []
    sinks.write_enveloped(table, f"{tmp_path}/e.json", "results", '"total": 4')
    assert [list(r.values()) for r in json.loads((tmp_path / "e.json").read_text())["results"]] == expected()
    assert sorted(p.name for p in tmp_path.iterdir() if not p.name.startswith(".")) == ["a.json", "e.json"]


def test_delimited_file(spark, table, tmp_path):
    sinks.write_delimited_file(table, f"{tmp_path}/a.tsv", "\t")
    with open(tmp_path / "a.tsv", encoding="utf-8-sig", newline="") as f:
        assert list(csv.reader(f, delimiter="\t")) == [table.columns, *expected()]
    assert files.read_csv(spark, f"{tmp_path}/a.tsv", "\t").columns == table.columns


def test_workbooks(spark, table, tmp_path):
    sinks.write_spreadsheet_xml({"A & B": table, "none": table.where("false")}, f"{tmp_path}/a.xml")
    name = f"{{{fixed.SPREADSHEET}}}"
    sheets = {s.get(f"{name}Name"): [[d.text or "" for d in row.iter(f"{name}Data")] for row in s.iter(f"{name}Row")] for s in ElementTree.parse(tmp_path / "a.xml").iter(f"{name}Worksheet")}
    assert sheets == {"A & B": [table.columns, *expected()], "none": [[]]}
    assert sorted(r.cells for r in sinks.read_sheet_rows(spark, f"{tmp_path}/a.xml").collect()) == sorted([table.columns, *expected(), []])
    sinks.write_xlsx({"A & B": table, "none": table.where("false")}, f"{tmp_path}/a.xlsx")
    main = f"{{{fixed.OFFICE}/spreadsheetml/2006/main}}"
    with zipfile.ZipFile(tmp_path / "a.xlsx") as z:
        assert z.testzip() is None
        assert [s.get("name") for s in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{main}sheet")] == ["A & B", "none"]
        read = lambda k: [["".join(t.text or "" for t in c.iter(f"{main}t")) for c in row.iter(f"{main}c")] for row in ElementTree.fromstring(z.read(f"xl/worksheets/sheet{k}.xml")).iter(f"{main}row")]
        assert read(1) == [table.columns, *expected()] and read(2) == [table.columns]
    assert sorted(r.cells for r in sinks.read_xlsx_rows(spark, f"{tmp_path}/a.xlsx").collect()) == sorted([table.columns, *expected()])
    with pytest.raises(ValueError):
        sinks.read_xlsx_rows(spark, f"{tmp_path}/a.xlsx", 3)


def test_a_million_rows(spark, tmp_path):
    df = spark.range(1_000_000, numPartitions=8).select(F.col("id").cast("string").alias("n"), F.md5(F.col("id").cast("string")).alias("h"))
    sinks.write_json_array(df, f"{tmp_path}/m.json")
    seen = files.read_json_array(spark, f"{tmp_path}/m.json", "n string, h string").agg(F.count("*"), F.sum(F.col("n").cast("long")), F.count_if(F.md5("n") == F.col("h"))).first()
    assert tuple(seen) == (1_000_000, 499_999_500_000, 1_000_000)


def test_what_fails_leaves_nothing(spark, tmp_path):
    sinks.write_json_array(spark.range(3), f"{tmp_path}/a.json")
    before = (tmp_path / "a.json").read_bytes()
    bad = spark.range(1000, numPartitions=4).select(F.when(F.col("id") == 700, F.raise_error(F.lit("no"))).otherwise(F.col("id").cast("string")).alias("x"))
    for write in (lambda: sinks.write_json_array(bad, f"{tmp_path}/a.json"), lambda: sinks.write_xlsx({"s": bad}, f"{tmp_path}/b.xlsx")):
        with pytest.raises(Exception):  # noqa: B017  the reader's own
            write()
    assert (tmp_path / "a.json").read_bytes() == before
    assert sorted(p.name for p in tmp_path.iterdir() if not p.name.startswith(".")) == ["a.json"]


def test_sheets_are_bounded(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sinks, "MOST_ROWS", 3)
    df = spark.range(4).select(F.col("id").cast("string").alias("x"))
    sinks.write_xlsx({"a": df.limit(3)}, f"{tmp_path}/a.xlsx")
    for write in (sinks.write_xlsx, sinks.write_spreadsheet_xml):
        with pytest.raises(ValueError, match="3"):
            write({"a": df}, f"{tmp_path}/b")
    assert not (tmp_path / "b").exists()
