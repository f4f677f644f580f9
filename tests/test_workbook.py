"""Workbooks: what is written is read back; files as other programs write them; jobs that fail leave nothing."""

import datetime as dt
import os
import zipfile
from decimal import Decimal
from xml.etree import ElementTree

import pytest
from pyspark.sql import functions as F

from scoreloom.sources import knowledge
from scoreloom.sources.workbook import read_workbook, sheet_names, write_workbook

ODD = ['say "hi"', "a\nb\r\n\tc", "  edges  ", "<b>&amp;</b>", "\x00\x01\x1f", "_x0041_ _x005F_", "漢字 😀 é", "=1+1", "", None, "x" * 32_767, "007"]


def test_values_come_back(spark, tmp_path):
    path = str(tmp_path / "book.xlsx")
    schema = "t string, n long, d double, b boolean, day date, at timestamp_ntz, m decimal(20,4), tags array<string>"
    rows = [(x, k * 10**14, k / 7, k % 2 == 0, dt.date(1999, 12, 31) + dt.timedelta(k), dt.datetime(2024, 2, 29, 13, 5, k), Decimal(k) / 8, ["a", None]) for k, x in enumerate(ODD)]
    rows.append((None,) * 8)
    df = spark.createDataFrame(rows, schema).repartition(4)
    empty = spark.createDataFrame([], "a string, `a.b` int")
    write_workbook({"odd: values": df, "odd? values": df.limit(1), "none": empty}, path)
    assert [s for s in os.listdir(tmp_path)] == ["book.xlsx"]
    back = read_workbook(spark, path, "odd_ values", schema.replace("array<string>", "string"))
    key = lambda r: repr(r)
    want = [(*r[:-1], '["a",null]' if r[-1] else None) for r in rows]
    # An empty text is a cell with an empty text.
    assert sorted(map(tuple, back.collect()), key=key) == sorted(want, key=key)
    assert read_workbook(spark, path, "none").columns == ["a", "a.b"] and read_workbook(spark, path, "none").count() == 0
    text = read_workbook(spark, path, "odd_ values").filter("t = '007'").first()
    assert (text.n, text.b, text.day, text.at) == (str(11 * 10**14), "false", "2000-01-11", "2024-02-29 13:05:11")
    assert read_workbook(spark, path, "odd_ values").rdd.getNumPartitions() == 1
    with zipfile.ZipFile(path) as book:
        assert book.testzip() is None and all(ElementTree.fromstring(book.read(n)) is not None for n in book.namelist())


def test_order_is_that_of_the_partitions(spark, tmp_path):
    path = str(tmp_path / "long.xlsx")
    write_workbook({"n": spark.range(20_000).repartitionByRange(7, "id").sortWithinPartitions("id")}, path)
    rows = read_workbook(spark, path, schema="id long").withColumn("at", F.monotonically_increasing_id())
    assert [r.id for r in rows.orderBy("at").collect()] == list(range(20_000))


def foreign(path, sheets, strings="", styles="", book=""):
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(path, "w") as out:
        named = "".join(f'<sheet name="{n}" sheetId="{k}" r:id="r{k}"/>' for k, n in enumerate(sheets))
        out.writestr("xl/workbook.xml", f'<workbook {main} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships">{book}<sheets>{named}</sheets></workbook>')
        links = "".join(f'<Relationship Id="r{k}" Target="{"/xl/" if k else ""}worksheets/s{k}.xml"/>' for k in range(len(sheets)))
        out.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{links}</Relationships>')
        for k, rows in enumerate(sheets.values()):
            out.writestr(f"xl/worksheets/s{k}.xml", f"<worksheet {main}><cols><col/></cols><sheetData>{rows}</sheetData><mergeCells/></worksheet>")
        if strings:
            out.writestr("xl/sharedStrings.xml", f"<sst {main}>{strings}</sst>")
        if styles:
            out.writestr("xl/styles.xml", f"<styleSheet {main}>{styles}</styleSheet>")


def test_files_of_other_programs(spark, tmp_path):
    strings = "<si><t>Company</t></si><si><r><t>Rich </t></r><r><rPr/><t xml:space='preserve'>text </t></r><rPh><t>no</t></rPh></si><si><t/></si>"
    styles = '<numFmts><numFmt numFmtId="170" formatCode="yyyy\\-mm"/><numFmt numFmtId="171" formatCode="0.0&quot;days&quot;"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="170"/><xf numFmtId="171"/></cellXfs>'
    one = (
        '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="inlineStr"><is><t>When</t></is></c><c r="D1" t="s"><v>0</v></c></row>'
        '<row r="3"><c r="A3" t="s"><v>1</v></c><c r="C3" s="1"><v>45351.5</v></c><c r="D3" s="2"><v>2.50</v></c></row>'
        '<row r="4"><c r="B4" t="str"><f>A1</f><v>made</v></c><c r="C4" t="e"><v>#N/A</v></c><c r="D4" t="b"><v>1</v></c><c r="AB4"><v>1</v></c></row>'
    )
    foreign(tmp_path / "a.xlsx", {"First": one, "Second": '<row><c t="inlineStr"><is><t>Company</t></is></c></row><row><c><v>12</v></c></row>'}, strings, styles)
    df = read_workbook(spark, str(tmp_path / "a.xlsx"))
    assert df.columns == ["Company", "_c1", "When", "Company.1"]
    assert [tuple(r) for r in df.collect()] == [(None,) * 4, ("Rich text ", None, "2024-02-29 12:00:00", "2.5"), (None, "made", None, "true")]
    foreign(tmp_path / "b.xlsx", {"Second": '<row><c t="inlineStr"><is><t>Company</t></is></c><c t="inlineStr"><is><t>Day</t></is></c></row><row><c><v>1E3</v></c><c s="1"><v>1</v></c></row>'}, styles=styles, book='<workbookPr date1904="1"/>')
    both = read_workbook(spark, str(tmp_path), "Second", "Day date, Company string")
    assert both.rdd.getNumPartitions() == 2 and {tuple(r) for r in both.collect()} == {(None, "12"), (dt.date(1904, 1, 2), "1000")}
    assert read_workbook(spark, str(tmp_path / "a.xlsx"), "*", "Company string").count() == 4
    kb = knowledge.read_kb(spark, str(tmp_path / "a.xlsx"), "workbook")
    assert [(r.row_id, r.Company) for r in kb.orderBy("row_id").collect()] == [(1, "Rich text"), (2, None)]
    with pytest.raises(Exception, match="no sheet"):
        read_workbook(spark, str(tmp_path / "a.xlsx"), "Third")
    with pytest.raises(Exception, match="another program"):
        spark.range(1).write.format("workbook").mode("append").save(str(tmp_path / "a.xlsx"))
    assert sorted(os.listdir(tmp_path)) == ["a.xlsx", "b.xlsx"]


def test_failures_leave_the_workbook_as_it_was(spark, tmp_path):
    path = str(tmp_path / "w.xlsx")
    write_workbook({"a": spark.range(3), "b": spark.range(2)}, path)
    with pytest.raises(Exception, match="cut it first"):
        spark.createDataFrame([("ok",), ("x" * 40_000,)], "t string").write.format("workbook").mode("overwrite").save(path)
    with pytest.raises(Exception, match="name of a sheet"):
        spark.range(1).write.format("workbook").option("sheet", "a/b").mode("append").save(path)
    assert read_workbook(spark, path).count() == 3 and os.listdir(tmp_path) == ["w.xlsx"]
    spark.range(9).write.format("workbook").option("sheet", "a").mode("append").save(path)  # replaces this sheet only
    assert read_workbook(spark, path, "a").count() == 9 and read_workbook(spark, path, "b").count() == 2


def test_names_of_sheets():
    assert sheet_names(["m:1", "m/1", "x" * 40, "x" * 50, "X" * 31]) == {"m:1": "m_1", "m/1": "m_1~2", "x" * 40: "x" * 31, "x" * 50: "x" * 29 + "~2", "X" * 31: "X" * 29 + "~3"}
