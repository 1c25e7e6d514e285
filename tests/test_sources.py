"""Files, parsers, sinks and streams on generated inputs."""

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from quernstone.sources import cursor, files, parsers, sinks
from quernstone.streaming import events


def office(parts):
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return buf.getvalue()


W = 'xmlns:w="http://w"'
DOCX = office({"word/document.xml": f"<w:document {W}><w:body><w:p><w:r><w:t>Hello</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:t>a</w:t></w:p></w:tc><w:tc><w:p><w:t>b</w:t></w:p></w:tc></w:tr></w:tbl></w:body></w:document>", "word/header1.xml": f"<w:hdr {W}><w:p><w:t>Top</w:t></w:p></w:hdr>"})
PPTX = office({"ppt/slides/slide1.xml": '<p:sld xmlns:p="p" xmlns:a="a" show="0"><a:p><a:t>Title</a:t></a:p><a:p><a:t>Line</a:t></a:p></p:sld>', "ppt/notesSlides/notesSlide1.xml": '<p:n xmlns:p="p" xmlns:a="a"><a:p><a:t>Note</a:t></a:p></p:n>'})
XLSX = office({
    "xl/workbook.xml": '<workbook xmlns:r="r"><sheets><sheet name="S" sheetId="1" r:id="x1" state="hidden"/></sheets></workbook>',
    "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="x1" Target="worksheets/sheet1.xml"/></Relationships>',
    "xl/sharedStrings.xml": "<sst><si><t>name</t></si><si><t>Ann</t></si></sst>",
    "xl/worksheets/sheet1.xml": '<worksheet><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1"><v>7</v></c></row><row r="2"><c r="A2" t="s"><v>1</v></c><c r="B2"><f>B1*2</f><v>14</v></c></row></sheetData></worksheet>',
})


@pytest.fixture
def folder(tmp_path):
    for name, raw in {"a.txt": "héllo".encode(), "k.txt": "한글 문서".encode("cp949"), "b.docx": DOCX, "c.pptx": PPTX, "d.xlsx": XLSX, "e.csv": b"# note\nx;y\n1;2\n3;4;5\n", "f.txt": b"\x00\x01bin", "g.docx": b"no archive", "h.bin": b"?", "big.txt": b"x" * 5000}.items():
        (tmp_path / name).write_bytes(raw)
    return str(tmp_path)


def test_scan_and_parse(spark, folder):
    found = files.scan(spark, folder, ["txt", "docx", "pptx", "xlsx", "csv"], max_bytes=4000)
    skipped = {r["path"].rpartition("/")[2]: r["skipped"] for r in found.where("skipped is not null").collect()}
    assert skipped == {"h.bin": "extension", "big.txt": "too_large"}
    inv = {r["extension"]: r["files"] for r in files.inventory(found).collect()}
    assert inv["txt"] == 4 and inv["docx"] == 2
    assert files.hashed(found).count() == 8
    rows = files.parsed(found).collect()
    by = {}
    for r in rows:
        by.setdefault(r["path"].rpartition("/")[2], []).append(r)
    assert by["a.txt"][0]["body"] == "héllo" and by["k.txt"][0]["body"] == "한글 문서"
    assert [r["body"] for r in by["b.docx"]] == ["Hello", "a | b", "Top"]
    assert [r["unit_type"] for r in by["c.pptx"]] == ["slide", "notes"] and json.loads(by["c.pptx"][0]["locator"])["hidden"]
    assert by["d.xlsx"][0]["body"] == "name\nAnn" and by["d.xlsx"][0]["title"] == "S"
    assert by["e.csv"][0]["body"] == "# note\nx;y\n1;2\n3;4;5" and json.loads(by["e.csv"][0]["locator"])["ragged"] == 3
    assert by["f.txt"][0]["status"] == "failed" and by["g.docx"][0]["status"] == "failed"
    cells = {(r["row"], r["col"]): (r["value"], r["type"], r["formula"]) for r in files.xlsx_range(found.where("extension = 'xlsx'"), "S", "A2:B2").collect()}
    assert cells == {(2, 1): ("Ann", "string", None), (2, 2): ("14", "number", "B1*2")}


def test_chunks_cover_the_text():
    text = "".join(f"line {i}\n" for i in range(3000))
    pieces = list(parsers.chunks(text))
    assert all(len(p) <= 4000 for _, p in pieces) and all(text[s : s + len(p)] == p for s, p in pieces)
    assert pieces[0][0] == 0 and pieces[-1][0] + len(pieces[-1][1]) == len(text)
    assert all(a[0] + len(a[1]) - b[0] == 400 for a, b in zip(pieces, pieces[1:], strict=False))
    assert list(parsers.chunks("")) == []


def test_paragraphs_are_never_divided():
    ps = ["p" * n for n in (10, 5000, 3000, 900, 200)]
    assert "\n".join(t for _, _, t in parsers.gathered(ps)) == "\n".join(ps)


def test_zip_bomb():
    with pytest.raises(parsers.Unreadable):
        parsers.archive(office({"x": "0" * 5_000_000}))


def test_csv_chunks_repeat_the_header():
    raw = ("id,text\n" + "".join(f"{i},{'w' * 90}\n" for i in range(200))).encode()
    units = list(parsers.csv_units(raw))
    assert len(units) > 1 and all(u[2].startswith("id,text\n") and len(u[2]) <= 4000 for u in units)
    assert units[0][3]["end"] + 1 == units[1][3]["start"]


def test_store_writes_once(spark, tmp_path):
    df = spark.createDataFrame([(b"a",), (b"a",), (b"b",)], "content binary")
    assert sinks.store(df, str(tmp_path / "s")) is not None
    sinks.store(df, str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).count() == 2


def test_export(spark, tmp_path):
    a = spark.createDataFrame([(2, "x"), (1, None)], "id int, v string")
    sinks.export({"t": (a, "id")}, str(tmp_path / "e"))
    lines = [r[0] for r in spark.read.text(str(tmp_path / "e")).collect()]
    assert sorted(lines) == ['{"type":"t","data":{"id":1,"v":null}}', '{"type":"t","data":{"id":2,"v":"x"}}']
    assert "| id | v |" in sinks.report(a, str(tmp_path / "r"))


def run(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
    q.processAllAvailable()
    q.stop()


def test_sessions_given_out_are_closed_ones(spark, sf, tmp_path):
    batch = spark.read.parquet(f"{sf}/events.parquet")
    batch.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
    run(events.sessions(stream, "user_id"), "sessions")
    got = spark.table("sessions").count()
    want = batch.groupBy("user_id", F.session_window("ts", "30 minutes")).count().count()
    assert 0 < got <= want
    run(events.windows(stream, "event_type"), "windows")
    assert spark.table("windows").count() > 0


def test_events_fold(spark, tmp_path):
    rows = [(1, "2024-01-01 00:00:00", "a"), (1, "2024-01-01 00:00:00", "a"), (1, "2024-01-01 00:10:00", "b"), (2, "2024-01-01 00:00:00", "c")]
    df = spark.createDataFrame(rows, "k int, t string, v string").select("k", F.to_timestamp("t").alias("ts"), "v")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    q = events.once(stream, "ts", "1 hour", "k", "v").writeStream.foreachBatch(events.folding(out, "k", "ts", "v")).option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    got = {r["k"]: r["v"] for r in events.folded(spark.read.parquet(out), "k", "ts", "v").collect()}
    assert got == {1: "b", 2: "c"}


def test_absences_stream(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, True), ("a", 2, False), ("a", 3, False), ("b", 3, True)], "path string, scan_id long, present boolean")
    df.write.parquet(str(tmp_path / "in"))
    run(events.absences(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))), "absences")
    assert {(r["path"], r["scan_id"]): r["is_deleted"] for r in spark.table("absences").collect()} == {("a", 1): False, ("a", 2): False, ("a", 3): True, ("b", 3): False}


def test_cursor_source(spark, tmp_path):
    (tmp_path / "m.jsonl").write_text('{"uid": 1, "thread": "t", "text": "one"}\n{"uid": 2, "thread": "t", "text": "two"}\n{"uid": 3, "thread": "d", "text": "x", "deleted": true}\n')
    spark.dataSource.register(cursor.CursorSource)
    run(spark.readStream.format("cursor").option("path", str(tmp_path)).load(), "pulled")
    got = {r["thread"]: (r["body"], r["is_deleted"]) for r in cursor.threads(spark.table("pulled")).collect()}
    assert got == {"t": ("one\n\ntwo", False), "d": ("", True)}


def test_csv_keeps_rows_and_quotes():
    (u,) = parsers.csv_units(b'tag,n\n#rust,3\n"a\n\nb",1\n"x, y",2\n')
    assert u[2] == 'tag,n\n#rust,3\n"a\n\nb",1\n"x, y",2' and not u[3]["partial"]
    many = list(parsers.csv_units(("a,b\n" + "1234567890,1234567890\n" * 500).encode()))
    assert len(many) > 1 and all(m[3]["partial"] for m in many)


def test_a_report_is_whole(spark, tmp_path):
    assert sinks.report(spark.range(3), str(tmp_path / "r")).count("\n") == 4
    with pytest.raises(ValueError):
        sinks.report(spark.range(30), str(tmp_path / "s"), most=20)


def test_docx_tables_keep_their_grid():
    cell = lambda t, pr="": f"<w:tc><w:tcPr>{pr}</w:tcPr><w:p><w:r><w:t>{t}</w:t></w:r></w:p></w:tc>"
    inner = f"<w:tbl><w:tr>{cell('in1')}{cell('in2')}</w:tr></w:tbl>"
    rows = [
        cell("wide", '<w:gridSpan w:val="2"/>') + cell("c"),
        cell("tall", '<w:vMerge w:val="restart"/>') + cell("b2") + cell("c2"),
        cell("", "<w:vMerge/>") + f"<w:tc><w:p><w:t>own</w:t></w:p>{inner}</w:tc>" + cell("c3"),
    ]
    body = "".join(f"<w:tr>{r}</w:tr>" for r in rows) + f'<w:tr><w:trPr><w:gridBefore w:val="1"/></w:trPr>{cell("late")}</w:tr>'
    (unit,) = parsers.docx_units(office({"word/document.xml": f"<w:document {W}><w:body><w:tbl>{body}</w:tbl></w:body></w:document>"}))
    assert unit[2] == "wide |  | c\ntall | b2 | c2\n | own [in1 | in2] | c3\n | late | "
    assert unit[3] == {"type": "docx_table", "table": 1, "rows": 4, "columns": 3, "nested": 1}


def test_pptx_tables_charts_diagrams_and_comments():
    a = 'xmlns:a="a" xmlns:p="p" xmlns:c="c"'
    tc = lambda t, more="": f"<a:tc {more}><a:txBody><a:p><a:t>{t}</a:t></a:p></a:txBody></a:tc>"
    table = f'<a:tbl><a:tr>{tc("head", "gridSpan='2'")}{tc("gone", "hMerge='1'")}</a:tr><a:tr>{tc("x")}{tc("y")}</a:tr></a:tbl>'
    point = lambda i, v: f'<c:pt idx="{i}"><c:v>{v}</c:v></c:pt>'
    chart = f"<c:chart {a}><c:title><a:t>Sales</a:t></c:title><c:ser><c:tx>{point(0, 'north')}</c:tx><c:cat>{point(0, 'Q1')}{point(2, 'Q3')}</c:cat><c:val>{point(0, 4)}{point(1, 5)}</c:val></c:ser></c:chart>"
    rel = lambda i, kind, to: f'<Relationship Id="r{i}" Type="http://x/{kind}" Target="{to}"/>'
    units = list(parsers.pptx_units(office({
        "ppt/slides/slide1.xml": f"<p:sld {a}><a:p><a:t>Title</a:t></a:p>{table}</p:sld>",
        "ppt/slides/_rels/slide1.xml.rels": "<Relationships>" + rel(1, "chart", "../charts/chart1.xml") + rel(2, "diagramData", "/ppt/diagrams/data1.xml") + rel(3, "comments", "../comments/comment1.xml") + rel(4, "chart", "../charts/none.xml") + "</Relationships>",
        "ppt/charts/chart1.xml": chart, "ppt/diagrams/data1.xml": f"<d {a}><a:p><a:t>Step</a:t></a:p></d>", "ppt/comments/comment1.xml": f"<p:cmLst {a}><p:cm><p:text>Check this</p:text></p:cm></p:cmLst>",
    })))
    assert [(u[0], u[2]) for u in units] == [("slide", "Title"), ("table", "head | \nx | y"), ("chart", "Sales\nnorth: Q1=4, 2=5, Q3="), ("diagram", "Step"), ("comment", "Check this")]
    assert units[1][3] == {"type": "pptx_table", "slide": 1, "table": 1, "rows": 2, "columns": 2}


def test_xlsx_cells_tell_of_merged_hidden_and_filtered_places():
    c = lambda ref, v: f'<c r="{ref}"><v>{v}</v></c>'
    sheet = f'<worksheet><cols><col min="3" max="3" hidden="1"/></cols><sheetData><row r="1">{c("A1", 1)}{c("C1", 2)}</row><row r="2" hidden="1">{c("A2", 3)}</row><row r="9" hidden="true">{c("A9", 4)}</row></sheetData><autoFilter ref="A1:C5"/><mergeCells><mergeCell ref="A1:B1"/></mergeCells></worksheet>'
    raw = office({"xl/workbook.xml": '<workbook xmlns:r="r"><sheets><sheet name="S" r:id="x1"/></sheets></workbook>', "xl/_rels/workbook.xml.rels": '<R><Relationship Id="x1" Target="worksheets/sheet1.xml"/></R>', "xl/worksheets/sheet1.xml": sheet})
    got = {x[:2]: x[5:] for x in parsers.xlsx_cells(raw, "S", "A1:D20")}
    assert got == {(1, 1): ("A1:B1", False, False), (1, 3): (None, True, False), (2, 1): (None, True, True), (9, 1): (None, True, False)}
