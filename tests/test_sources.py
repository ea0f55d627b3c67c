"""Readers of every format, and the command line's exit codes."""

from __future__ import annotations

import gzip
import zipfile

import pytest

from tablewarden.cli import main
from tablewarden.contract.model import Field
from tablewarden.sources import ReadOptions, SourceError, jdbc_source, open_source
from tablewarden.sources.options import detect


def rows(spark, path, **options):
    return [tuple(r) for r in open_source(spark, str(path), ReadOptions(**options)).frame.collect()]


def test_detection():
    assert detect("a/b.csv.gz") == ("csv", "gzip") and detect("x.jsonl.zst") == ("ndjson", "zstd") and detect("x.dat", "xml") == ("xml", None)
    with pytest.raises(SourceError):
        detect("x.dat")


def test_csv(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text('a,b,b\n1,"",\n2,"x, y",é\n')
    assert rows(spark, p) == [("1", "", None), ("2", "x, y", "é")]
    (tmp_path / "a.csv.gz").write_bytes(gzip.compress(p.read_bytes()))
    assert rows(spark, tmp_path / "a.csv.gz") == rows(spark, p)
    (tmp_path / "b.csv").write_text("title\n\nx;y\n1;2\n")
    assert rows(spark, tmp_path / "b.csv", delimiter=";", skip_rows=2) == [("1", "2")]
    (tmp_path / "c.tsv").write_text("1\t2\n")
    source = open_source(spark, str(tmp_path / "c.tsv"), ReadOptions(has_header=False))
    assert source.frame.columns == ["column_1", "column_2"] and source.frame.count() == 1
    (tmp_path / "e.csv").write_text("")
    with pytest.raises(SourceError, match="empty"):
        rows(spark, tmp_path / "e.csv")


def test_csv_with_quoted_line_breaks(spark, tmp_path):
    want = [("1", "a\nb"), ("2", 'say "x",\n\ny'), ("3", "é")]
    body = '1,"a\nb"\n2,"say ""x"",\n\ny"\n3,é\n'
    (tmp_path / "a.csv").write_text("k,v\n" + body)
    assert rows(spark, tmp_path / "a.csv") == want
    (tmp_path / "b.csv").write_text('k,"a\nname"\n' + body)
    assert rows(spark, tmp_path / "b.csv") == want
    assert open_source(spark, str(tmp_path / "b.csv")).frame.columns == ["k", "a\nname"]
    (tmp_path / "c.csv").write_text("title\n\nk,v\n" + body)
    assert rows(spark, tmp_path / "c.csv", skip_rows=2) == want
    assert rows(spark, tmp_path / "a.csv", has_header=False)[1:] == want
    # told otherwise, lines are records
    assert len(rows(spark, tmp_path / "a.csv", multi_line=False)) > 3
    (tmp_path / "d.csv").write_text("k,v\n1,x\n")
    assert rows(spark, tmp_path / "d.csv", multi_line=True) == [("1", "x")]


def test_lines_are_dropped_across_splits(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text("".join(f"note {i}\n" for i in range(500)) + "k,v\n" + "".join(f"{i},x\n" for i in range(500)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        assert rows(spark, p, skip_rows=500) == [(str(i), "x") for i in range(500)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_xml_records_far_into_the_file(spark, tmp_path):
    note = "<note>text</note>\n" * 200_000
    (tmp_path / "a.xml").write_text(f"<all>{note}<Row><a>1</a></Row><Row><a>2</a></Row></all>")
    assert rows(spark, tmp_path / "a.xml", xml_record="row") == [("1",), ("2",)]
    (tmp_path / "c.xml").write_text("<all xmlns:x='u'><x:Row><x:a>1</x:a></x:Row><x:Row><x:a>2</x:a></x:Row></all>")
    assert rows(spark, tmp_path / "c.xml", xml_record="row") == rows(spark, tmp_path / "c.xml") == [("1",), ("2",)]
    one_line = f"<all>{note}<deep><row><a>1</a></row></deep></all>".replace("\n", "")
    (tmp_path / "b.xml.gz").write_bytes(gzip.compress(one_line.encode()))
    assert rows(spark, tmp_path / "b.xml.gz", xml_record="deep/row") == [("1",)]
    with pytest.raises(SourceError, match="no element"):
        rows(spark, tmp_path / "a.xml", xml_record="nothing")


def test_database_tables(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    driver = "org.apache.derby.jdbc.EmbeddedDriver"
    spark.range(100).selectExpr("cast(id as int) as k", "concat('v', id) as v").write.format("jdbc").options(url=url, dbtable="t", driver=driver).save()
    source = jdbc_source(spark, url, "t", split_by="k", parts=4, driver=driver)
    assert source.typed and source.frame.rdd.getNumPartitions() == 4 and source.frame.count() == 100
    assert jdbc_source(spark, url, '(select "k" from t where "k" < 5) x', driver=driver).frame.count() == 5


def test_json(spark, tmp_path):
    (tmp_path / "a.ndjson").write_text('{"a": 1, "b": true}\n\n{"a": 2.5}\n')
    assert rows(spark, tmp_path / "a.ndjson") == [("1", "true"), ("2.5", None)]
    (tmp_path / "a.json").write_text('[{"a": 1},\n {"a": 2}]')
    assert rows(spark, tmp_path / "a.json") == [("1",), ("2",)]
    (tmp_path / "b.json").write_text('{"data": {"items": [{"a": 1}], "one": {"a": 5}}}')
    assert rows(spark, tmp_path / "b.json", json_path="$.data.items") == [("1",)]
    assert rows(spark, tmp_path / "b.json", json_path="data.one") == [("5",)]
    with pytest.raises(SourceError, match="keys there: items, one"):
        rows(spark, tmp_path / "b.json", json_path="data.nothing")
    with pytest.raises(SourceError):
        rows(spark, tmp_path / "a.ndjson", json_path="x")


def test_fixed_width(spark, tmp_path):
    (tmp_path / "a.fwf").write_text("0001Ada Lovelace     12.50\r\n\n0002Zoë\n")
    layout = (Field("id", 1, 4), Field("name", width=16), Field("amount", width=6))
    assert rows(spark, tmp_path / "a.fwf", fixed_width=layout, has_header=False) == [("0001", "Ada Lovelace", "12.50"), ("0002", "Zoë", None)]
    with pytest.raises(SourceError, match="layout"):
        rows(spark, tmp_path / "a.fwf")


def test_xml(spark, tmp_path):
    (tmp_path / "a.xml").write_text(
        '<list><order id="1"><who>A &amp; B</who><address><city>X</city></address><amount currency="EUR">3</amount><item>1</item><item>2</item><note/></order>'
        '<order id="2"><who>C</who><amount currency="USD">4</amount></order></list>'
    )
    source = open_source(spark, str(tmp_path / "a.xml"), ReadOptions(xml_record="ORDER"))
    got = [r.asDict() for r in source.frame.orderBy("id").collect()]
    assert got[0] == {"id": "1", "who": "A & B", "address.city": "X", "amount": "3", "amount.currency": "EUR", "item": "1", "note": None}
    assert got[1]["item"] is None and source.frame.count() == 2
    assert open_source(spark, str(tmp_path / "a.xml")).frame.count() == 2
    with pytest.raises(SourceError):
        rows(spark, tmp_path / "a.xml", xml_record="nothing")


def workbook(path):
    main_ns = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    rel_ns = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main_ns}" xmlns:r="{rel_ns}"><sheets><sheet name="First" sheetId="1" r:id="r1"/><sheet name="Report" sheetId="2" r:id="r2"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="worksheets/s1.xml"/><Relationship Id="r2" Target="worksheets/s2.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{main_ns}"><si><t>id</t></si><si><t>when</t></si></sst>')
        z.writestr("xl/styles.xml", f'<styleSheet xmlns="{main_ns}"><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>')
        z.writestr("xl/worksheets/s1.xml", f'<worksheet xmlns="{main_ns}"><sheetData/></worksheet>')
        body = '<row r="1"><c r="A1" t="inlineStr"><is><t>Title</t></is></c></row><row r="3"><c r="A3" t="s"><v>0</v></c><c r="B3" t="s"><v>1</v></c><c r="D3" t="s"><v>0</v></c></row>'
        body += '<row r="4"><c r="A4"><v>1</v></c><c r="B4" s="1"><v>46204</v></c><c r="C4" t="b"><v>1</v></c></row><row r="5"/><row r="6"><c r="A6"><v>2.5</v></c><c r="B6" s="1"><v>46204.5</v></c></row>'
        z.writestr("xl/worksheets/s2.xml", f'<worksheet xmlns="{main_ns}"><sheetData>{body}</sheetData></worksheet>')


def test_workbook(spark, tmp_path):
    workbook(tmp_path / "a.xlsx")
    source = open_source(spark, str(tmp_path / "a.xlsx"), ReadOptions(sheet="report", skip_rows=2))
    assert source.frame.columns == ["id", "when", "column_3", "id_2"]
    assert [tuple(r) for r in source.frame.collect()] == [("1", "2026-07-01", "true", None), ("2.5", "2026-07-01T12:00:00", None, None)]
    with pytest.raises(SourceError, match="First, Report"):
        rows(spark, tmp_path / "a.xlsx", sheet="x")


CONTRACT = "apiVersion: v1\ndataset: d\ncolumns:\n  a: { type: int, checks: [{ min: %s }] }\n"


def test_exit_codes(spark, tmp_path, monkeypatch, capsys):
    monkeypatch.setattr("tablewarden.cli._session", lambda: spark)
    data, c, strict = tmp_path / "a.csv", tmp_path / "c.yaml", tmp_path / "d.yaml"
    data.write_text("a\n1\n2\n")
    c.write_text(CONTRACT % "1")
    strict.write_text(CONTRACT % "2, severity: warn")
    assert main(["check", str(data), "-c", str(c)]) == 0
    assert main(["check", str(data), "-c", str(strict)]) == 0
    assert main(["check", str(data), "-c", str(strict), "--strict", "--format", "junit"]) == 1
    assert main(["check", str(data), "-c", str(tmp_path / "none.yaml")]) == 2
    assert main(["diff", str(c), str(c)]) == 0
    c2 = tmp_path / "c2.yaml"
    c2.write_text(CONTRACT % "5")
    assert main(["diff", str(c), str(c2), "--format", "json"]) == 1
    assert main(["validate-contract", str(c)]) == 0
    c2.write_text("apiVersion: v1\ndataset: d\n")
    assert main(["validate-contract", str(c2)]) == 2
    for to in ("dlt-sql", "dlt-python", "dbt", "dbt-tests", "odcs", "json-schema"):
        assert main(["export", str(c), "--to", to]) == 0
    assert main(["init", str(data), "-o", str(tmp_path / "draft.yaml")]) == 0
    assert main(["check", str(data), "-c", str(tmp_path / "draft.yaml")]) == 0
    assert main(["nothing"]) == 2
