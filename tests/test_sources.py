import zipfile

from pyspark.sql import functions as F

from tidemark.operators import chunking
from tidemark.sources import office, tables

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
S = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'


def test_office_files(spark, tmp_path):
    p = lambda text, style="": f'<w:p><w:pPr><w:pStyle w:val="{style}"/></w:pPr><w:r><w:t>{text}</w:t></w:r></w:p>'
    cell = lambda t: f"<w:tc>{p(t)}</w:tc>"
    body = p("Rules", "Heading1") + p("Be kind.") + f"<w:tbl><w:tr>{cell('a')}{cell('b')}</w:tr><w:tr>{cell('1')}{cell('2')}</w:tr></w:tbl>"
    with zipfile.ZipFile(tmp_path / "x.docx", "w") as z:
        z.writestr("word/document.xml", f"<w:document {W}><w:body>{body}</w:body></w:document>")
    with zipfile.ZipFile(tmp_path / "y.xlsx", "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {S}><si><t>name</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {S}><sheetData><row><c t="s"><v>0</v></c></row><row><c><v>7</v></c></row></sheetData></worksheet>')
    (tmp_path / "bad.docx").write_bytes(b"no zip")
    got = {r.path.rsplit("/", 1)[-1]: r.elements for r in office.office_files(spark, str(tmp_path)).collect()}
    assert [(e.kind, e.level, e.text) for e in got["x.docx"][:2]] == [("heading", 1, "Rules"), ("paragraph", None, "Be kind.")]
    assert (got["x.docx"][2].header, got["x.docx"][2].rows) == (["a", "b"], [["1", "2"]])
    assert (got["y.xlsx"][0].header, got["y.xlsx"][0].rows) == (["name"], [["7"]]) and got["bad.docx"] == []


def test_area_csv_and_dispatch(spark, tmp_path):
    (tmp_path / "area.csv").write_text("id,name,type,parentId\n1,中国,1,0\n2,北京,2,1\n", encoding="utf-8")
    assert [tuple(r) for r in tables.area_csv(spark, str(tmp_path / "area.csv")).orderBy("id").collect()] == [(1, "中国", 1, 0), (2, "北京", 2, 1)]
    docs = spark.createDataFrame([(1, "md", "# a\nb"), (2, "txt", "c\n\nd"), (3, None, "e")], "id int, type string, text string")
    out = tables.dispatch(docs, {"MD": lambda df: df.select("id", chunking.parse_markdown(F.col("text")).alias("e")), "*": lambda df: df.select("id", chunking.parse_plain(F.col("text")).alias("e"))})
    assert {r.id: len(r.e) for r in out.collect()} == {1: 2, 2: 2, 3: 1}
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "a.txt").write_text("x\n\ny")
    assert tables.text_files(spark, str(tmp_path / "t")).first().text == "x\n\ny"


def test_layout_json(spark):
    j = '[{"page_idx":0,"md":"# T\\ntext"},{"page_idx":1,"md":"![x](y.png)\\nmore"}]'
    got = spark.createDataFrame([(j,)], "j string").select(chunking.parse_layout(F.col("j")).alias("e")).first().e
    assert [(e.kind, e.text) for e in got] == [("heading", "T"), ("paragraph", "text"), ("paragraph", "[image]"), ("paragraph", "more")]


def test_typed_sheets(spark, tmp_path):
    import datetime as dt
    from decimal import Decimal

    from tidemark.sources.sheets import read_sheets

    r = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    cells = {
        1: '<c r="A1" t="s"><v>0</v></c><c r="B1" t="inlineStr"><is><t>price</t></is></c><c r="D1" t="s"><v>1</v></c><c r="E1" t="inlineStr"><is><t>ok</t></is></c><c r="F1" t="inlineStr"><is><t>unread</t></is></c><c r="G1" t="inlineStr"><is><t>n</t></is></c><c r="H1" t="inlineStr"><is><t>at</t></is></c>',
        2: '<c r="A2" t="s"><v>2</v></c><c r="B2"><v>12.5</v></c><c r="D2" s="1"><v>45322</v></c><c r="E2" t="b"><v>1</v></c><c r="F2"><v>1</v></c><c r="G2"><v>7</v></c><c r="H2" s="2"><v>45322.75</v></c>',
        3: '<c r="A3"><v>42</v></c><c r="B3" t="inlineStr"><is><t> 3.25 </t></is></c><c r="D3" t="inlineStr"><is><t>2024-02-29</t></is></c><c r="E3" t="inlineStr"><is><t>FALSE</t></is></c><c r="G3"><v>7.5</v></c>',
        4: "",
        6: '<c r="B6" t="inlineStr"><is><t>dear</t></is></c><c r="D6"><v>45322</v></c><c r="E6" t="inlineStr"><is><t>maybe</t></is></c><c r="G6"><v>99999999999</v></c>',
    }
    sheet = f"<worksheet {S}><sheetData>{''.join(f'<row r=\"{n}\">{c}</row>' for n, c in cells.items())}</sheetData></worksheet>"
    styles = f'<styleSheet {S}><numFmts><numFmt numFmtId="170" formatCode="&quot;day&quot; yyyy-mm-dd hh:mm"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="170"/></cellXfs></styleSheet>'
    with zipfile.ZipFile(tmp_path / "a.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {S} {r}><sheets><sheet name="Prices" r:id="x"/><sheet name="More" r:id="y"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="x" Target="worksheets/sheet7.xml"/><Relationship Id="y" Target="/xl/worksheets/sheet8.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {S}><si><t>name</t></si><si><r><t>da</t></r><r><t>y</t></r></si><si><t>bolt</t></si></sst>")
        z.writestr("xl/styles.xml", styles)
        z.writestr("xl/worksheets/sheet7.xml", sheet)
        z.writestr("xl/worksheets/sheet8.xml", f'<worksheet {S}><sheetData><row><c t="inlineStr"><is><t>name</t></is></c></row><row><c t="inlineStr"><is><t>nut</t></is></c></row></sheetData></worksheet>')
    (tmp_path / "bad.xlsx").write_bytes(b"no zip")
    (tmp_path / "other.txt").write_text("x")
    schema = "name string, price decimal(10,2), day date, ok boolean, n int, at timestamp, missing string"
    got = {(x.path.rsplit("/", 1)[-1], x.row): tuple(x)[3:] for x in read_sheets(spark, str(tmp_path), schema).collect()}
    assert got == {
        ("a.xlsx", 2): ("bolt", Decimal("12.50"), dt.date(2024, 1, 31), True, 7, dt.datetime(2024, 1, 31, 18), None, []),
        ("a.xlsx", 3): ("42", Decimal("3.25"), dt.date(2024, 2, 29), False, None, None, None, ["n"]),
        ("a.xlsx", 6): (None, None, None, None, None, None, None, ["price", "day", "ok", "n"]),
        ("bad.xlsx", None): (None,) * 7 + (["*"],),
    }
    more = read_sheets(spark, str(tmp_path / "a.xlsx"), "name string", "More").collect()
    assert [(x.sheet, x.row, x.name, x.bad) for x in more] == [("More", 2, "nut", [])]
    assert [x.bad for x in read_sheets(spark, str(tmp_path / "a.xlsx"), "name string", "None").collect()] == [["*"]]
