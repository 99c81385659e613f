"""Workbooks and Stata files are made and read in tasks: no rows on the driver, however many there are."""

import io
import re
import zipfile
from itertools import islice
from xml.etree import ElementTree

import pandas as pd
import pytest
from loomfield.plans import containers
from loomfield.sources import sinks
from loomfield.sources.codebook import Variable
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from compare import assert_same, connect


@pytest.fixture
def no_rows_on_driver(monkeypatch):
    """Fetching a frame's rows as a whole or by partition is an error."""

    def refuse(*_):
        raise MemoryError("rows on the driver")

    for c in {DataFrame, *DataFrame.__subclasses__()}:
        for name in ("toPandas", "toLocalIterator", "toArrow"):
            monkeypatch.setattr(c, name, refuse)


def rows_of(spark, n, parts=3):
    odd = F.when(F.col("id") % 3 == 0, "").when(F.col("id") % 3 == 1, "nan").otherwise(F.concat(F.lit("ä<&"), F.col("id").cast("string")))
    return spark.range(0, n, 1, parts).select(F.col("id").cast("string").alias("key"), odd.alias("te-xt"), F.lit("").alias("none"))


def without_time(raw):
    return re.sub(rb"<timestamp>.*?</timestamp>", b"", raw, flags=re.S)


@pytest.mark.parametrize("n", [0, 1, 1000])
def test_stata_in_tasks_gives_the_bytes_of_one_frame(spark, tmp_path, n, no_rows_on_driver):
    df = rows_of(spark, n)
    got = sinks.write_table(df, str(tmp_path), "t", ["stata"], [(Variable("key", "Key"), "char")])
    assert "error" not in got["stata"], got
    cells = [["" if v == "nan" else v for v in r] for r in df.collect()]
    want = io.BytesIO()
    pd.DataFrame(cells, columns=["key", "te_xt", "none"]).astype(str).to_stata(want, write_index=False, variable_labels={"key": "Key"}, version=117)
    assert without_time((tmp_path / "t.dta").read_bytes()) == without_time(want.getvalue())
    assert [p.name for p in tmp_path.iterdir()] == ["t.dta"]


def test_stata_long_texts(spark, tmp_path, no_rows_on_driver):
    long = F.when(F.col("id") % 2 == 0, F.repeat(F.col("id").cast("string"), 3000)).otherwise("")
    df = spark.range(0, 40, 1, 4).select(F.col("id").cast("string").alias("key"), long.alias("long"))
    assert "error" not in sinks.write_table(df, str(tmp_path), "t", ["stata"])["stata"]
    assert pd.read_stata(tmp_path / "t.dta").values.tolist() == [list(r) for r in df.collect()]


def test_stata_refuses_what_it_cannot_hold(spark, tmp_path):
    got = sinks.write_table(spark.createDataFrame([("日本",)], "a string"), str(tmp_path), "t", ["stata"])
    assert "error" in got["stata"] and not list(tmp_path.iterdir())


def cells_of(path, number):
    """Rows of a sheet as (place -> text)."""
    with zipfile.ZipFile(path) as z:
        root = ElementTree.fromstring(z.read(f"xl/worksheets/sheet{number}.xml"))
    ns = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
    return [{c.get("r"): "".join(c.itertext()) for c in row} for row in root.iter(ns + "row")]


@pytest.mark.parametrize("n, want", [(0, [0]), (99, [99]), (100, [100]), (101, [100, 1]), (1000, [100] * 10)])
def test_rows_beyond_a_sheet_go_on_in_the_next(spark, tmp_path, n, want, no_rows_on_driver, monkeypatch):
    monkeypatch.setattr(sinks, "SHEET_ROOM", 100)
    df = rows_of(spark, n, 7).withColumn("number", F.col("key").cast("long"))
    got = sinks.write_table(df, str(tmp_path), "t", ["excel"], [(Variable("key", "Key"), "char")])
    assert "error" not in got["excel"], got
    with zipfile.ZipFile(tmp_path / "t.xlsx") as z:
        assert z.testzip() is None
        names = re.findall(r'sheet name="([^"]*)" sheetId="\d+" r:id="rId(\d+)"', z.read("xl/workbook.xml").decode())
    assert names == [("Data", "1"), *[(f"Data {i}", str(i + 1)) for i in range(2, len(want) + 1)], ("Variables", "2")]
    rows, all_cells = df.collect(), []
    for k, number in zip(want, sinks.data_sheets(len(want))):
        labels, heads, *more = cells_of(tmp_path / "t.xlsx", number)
        assert labels == {"A1": "Key", "B1": "te-xt", "C1": "none", "D1": "number"} and heads["A2"] == "key" and len(more) == k
        all_cells += [[c.get(f"{x}{r}", "") for x in "ABCD"] for r, c in enumerate(more, 3)]
    assert all_cells == [[str(x) for x in r] for r in rows]
    assert [p.name for p in tmp_path.iterdir()] == ["t.xlsx"]


def test_cells_of_a_workbook_lose_signs_that_xml_cannot_hold(spark, tmp_path):
    df = spark.createDataFrame([("a\0\x01b\tc <&>\n", None, 1.5, 2)], "a string, b string, c double, d int")
    sinks.write_table(df, str(tmp_path), "t", ["excel"])
    assert cells_of(tmp_path / "t.xlsx", 1)[2] == {"A3": "ab\tc <&>\n", "C3": "1.5", "D3": "2"}


@pytest.fixture
def workbook(spark, tmp_path, monkeypatch):
    """(path, rows) of a workbook with rows in three sheets."""
    monkeypatch.setattr(sinks, "SHEET_ROOM", 100)
    df = rows_of(spark, 250)
    return sinks.write_table(df, str(tmp_path), "t", ["excel"])["excel"]["path"], [tuple(r) for r in df.collect()]


def refuse(*_, **__):
    raise MemoryError("rows on the driver")


def test_head_rows_come_before_the_rest_is_read(tmp_path):
    xml = sinks._SHEET + "".join(sinks._sheet_row(r, ["a", "b"]) for r in range(1, 20_000))  # without an end
    with zipfile.ZipFile(tmp_path / "t.xlsx", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("xl/worksheets/sheet1.xml", xml)
    assert list(islice(containers._sheet(str(tmp_path / "t.xlsx"), 1), 2)) == [["a", "b"]] * 2


def test_sheets_are_read_in_tasks(spark, workbook, monkeypatch):
    path, rows = workbook
    monkeypatch.setattr(containers, "_target", lambda *_: (path, ["key", "text", "none"]))
    monkeypatch.setattr(SparkSession, "createDataFrame", refuse)
    assert [tuple(r) for r in containers.converted_excel(spark, "").collect()] == rows


def test_stata_rows_are_read_in_tasks(spark, tmp_path, monkeypatch):
    df = rows_of(spark, 250)
    path = sinks.write_table(df, str(tmp_path), "t", ["stata"])["stata"]["path"]
    monkeypatch.setattr(containers, "_target", lambda *_: (path, []))
    monkeypatch.setattr(containers, "READ_ROWS", 64)
    monkeypatch.setattr(SparkSession, "createDataFrame", refuse)
    got = containers.converted_stata(spark, "")
    assert got.columns == ["key", "te_xt", "none"]
    assert [tuple(r) for r in got.collect()] == [tuple("" if v == "nan" else v for v in r) for r in df.collect()]


@pytest.fixture(scope="module")
def alone(spark, tiny, tmp_path_factory):
    """The tables at a path of their own, so that conversions are made anew: fetching rows ends the test, and only what a query needs is written."""
    d = tmp_path_factory.mktemp("alone") / "sf"
    d.symlink_to(tiny)

    def refuse(*_):
        pytest.fail("rows on the driver")

    with pytest.MonkeyPatch.context() as m:
        for c in {DataFrame, *DataFrame.__subclasses__()}:
            for name in ("toPandas", "toLocalIterator", "toArrow"):
                m.setattr(c, name, refuse)
        yield str(d)


@pytest.mark.parametrize(
    "name, formats",
    [
        ("convert_console", set(sinks.FORMATS)),
        ("convert_report", set(sinks.FORMATS)),
        ("convert_checks", {"parquet"}),
        ("convert_errors", {"parquet"}),
        ("converted_csv", {"csv"}),
        ("converted_tsv", {"tsv"}),
        ("converted_jsonl", {"jsonl"}),
        ("converted_fwf", {"fwf"}),
        ("converted_parquet", {"parquet"}),
        ("excel_variables", {"excel"}),
        ("stata_labels", {"stata"}),
    ],
)
def test_query_fetches_no_rows_and_writes_what_it_needs(spark, tiny, alone, name, formats, monkeypatch):
    asked = []
    converted = containers._converted
    monkeypatch.setattr(containers, "_converted", lambda s, d, f=tuple(sinks.FORMATS): asked.append(set(f)) or converted(s, d, f))
    assert_same(containers.QUERIES[name](spark, alone), connect(tiny).sql(containers.ORACLE[name]))
    assert asked == [formats]
