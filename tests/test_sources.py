import datetime
import io
import json
import zipfile

import pytest
from marlstone.operators import tables as t
from marlstone.sources import archive, decode
from marlstone.sources.files import parse_file, parse_files, pdf_paragraphs, read_files
from marlstone.sources.markdown import blocks_of, front_matter
from marlstone.sources.store import commit, current, read_graph_csv


def texts(name, data):
    found = parse_file(name, data if isinstance(data, bytes) else data.encode())
    return [b["text"] for b in found["blocks"]], found["error"]


def test_csv_files():
    orders = parse_file("orders.csv", "订单号,客户,金额\nA001,张三,100\n".encode())["blocks"]
    assert orders == [{"kind": "table_row", "text": "订单号：A001；客户：张三；金额：100", "meta": {"sheet": "CSV", "row": 2, "headers": ["订单号", "客户", "金额"]}}]
    quoted = parse_file("q.csv", '名称;备注\n甲;"一\n二"\n乙;三\n'.encode())["blocks"]
    assert [b["meta"]["row"] for b in quoted] == [3, 4]
    assert texts("one.csv", "name\nalice\n") == (["name：alice"], None)
    assert texts("n.csv", "左,中,右\nA,,C\n,,\n") == (["左：A；右：C"], None)
    ragged = parse_file("r.csv", "甲,列3\nA,B,C\n".encode())["blocks"][0]
    assert ragged["meta"]["headers"] == ["甲", "列3", "列3_2"] and ragged["text"] == "甲：A；列3：B；列3_2：C"
    assert texts("bad.csv", 'a,b\n"x') == ([], "CSV_MALFORMED")
    assert texts("bad.csv", b"\xff\xfe\xfd") == ([], "CSV_ENCODING_UNCERTAIN")


def test_dispatch_and_text():
    assert texts("x.EXE", "a") == ([], "UNSUPPORTED_FILE_TYPE") and texts("noext", "a") == ([], "UNSUPPORTED_FILE_TYPE")
    assert texts("x.txt", " \n \n") == ([], "NO_EXTRACTABLE_TEXT")
    blocks = parse_file("x.TXT", b"\n\na\r\nb\r\n \r\nc")["blocks"]
    assert [(b["text"], b["meta"]) for b in blocks] == [("a\nb", {"line_start": 3, "line_end": 4}), ("c", {"line_start": 6, "line_end": 6})]
    assert texts("corrupt.pdf", "This is not a PDF file.") == ([], "PDF_MALFORMED")
    assert texts("x.png", b"\x89PNG\r\n\x1a\n") == ([], "OCR_NOT_ENABLED")


def test_decoding():
    assert decode.decode_text("﻿é".encode()) == ("é", "utf-8-sig")
    text = "Plain words in a longer text, so that detection is sure of it.\nSecond line.\n" * 5
    assert decode.decode_text(text.encode("utf-16-le"))[0] == text
    for bad in (b"\x00\x01\x02" * 50, b"\xff\xff\xff", "xy�".encode()):
        with pytest.raises(decode.ParseError):
            decode.decode_text(bad)


def test_markdown():
    source = "---\ntitle: T\ndate: 2024-01-02\n---\n# A *b*\n\nText with [link](http://x/y) and `code`\nnext line\n\n- one\n- two\n  more\n\n## C\n\n```python x\na = 1\n```\n\n| h | i |\n|---|---|\n| 1 | 2 |\n\n    indented\n\n<div>html</div>\n\nSetext\n---\n\nend"
    found = parse_file("m.md", source.encode())
    got = [(b["kind"], b["text"], b["meta"]["heading_path"]) for b in found["blocks"]]
    assert got == [
        ("heading", "A b", ["A b"]), ("paragraph", "Text with link and code\nnext line", ["A b"]), ("list_item", "one", ["A b"]), ("list_item", "two\nmore", ["A b"]),
        ("heading", "C", ["A b", "C"]), ("code", "a = 1\n", ["A b", "C"]), ("table_row", "h | i", ["A b", "C"]), ("table_row", "1 | 2", ["A b", "C"]), ("heading", "Setext", ["A b", "Setext"]), ("paragraph", "end", ["A b", "Setext"]),
    ]
    assert found["metadata"]["links"] == ["http://x/y"] and found["metadata"]["front_matter"] == {"title": "T", "date": "2024-01-02"}
    code = next(b for b in found["blocks"] if b["kind"] == "code")
    assert code["meta"]["language"] == "python" and found["blocks"][0]["meta"]["line_start"] == 5
    assert blocks_of("")[0] == []


def test_front_matter_limits():
    for raw in ("a: &x 1\nb: *x", "a: 1\na: 2", "a: .nan", "a: [" + "[" * 30, "? [k]\n: v", "a: " + "x" * 17_000):
        assert "front_matter_raw" in front_matter(f"---\n{raw}\n---\nbody")[1]
    assert front_matter("---\nno end") == ("---\nno end", {}, 0)


def xlsx(sheets, shared=(), extra=""):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        names = "".join(f'<sheet name="{n}" sheetId="{k}" r:id="r{k}"{s}/>' for k, (n, s, _) in enumerate(sheets))
        z.writestr("xl/workbook.xml", f'<workbook xmlns="m" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets>{names}</sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="r{k}" Target="worksheets/s{k}.xml"/>' for k in range(len(sheets))) + "</Relationships>")
        z.writestr("xl/sharedStrings.xml", "<sst>" + "".join(f"<si><t>{s}</t></si>" for s in shared) + "</sst>")
        z.writestr("xl/styles.xml", '<styleSheet xmlns="m"><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>')
        for k, (_, _, body) in enumerate(sheets):
            z.writestr(f"xl/worksheets/s{k}.xml", f'<worksheet xmlns="m"><sheetData>{body}</sheetData>{extra}</worksheet>')
    return out.getvalue()


def test_xlsx():
    head = "".join(f'<c r="{c}1" t="s"><v>{k}</v></c>' for k, c in enumerate("ABC")) + '<c r="E1" t="s"><v>2</v></c>'
    row = '<c r="A2" s="1"><v>46265</v></c><c r="B2" t="b"><v>1</v></c><c r="C2"><v>100.0</v></c><c r="D2" t="inlineStr"><is><t>保留</t></is></c><c r="E2"><f>SUM(1,2)</f></c>'
    data = xlsx([("数据", "", f"<row>{head}</row><row>{row}</row>"), ("隐藏", ' state="hidden"', ""), ("空", "", "")], ("日期", "开关", "名称"))
    found = parse_file("x.xlsx", data)
    assert [b["text"] for b in found["blocks"]] == ["日期：2026-08-31；开关：true；名称：100；列4：保留；名称_2：=SUM(1,2)"]
    assert [w["code"] for w in found["warnings"]] == ["FORMULA_CACHE_MISSING", "SHEET_HIDDEN", "SHEET_EMPTY"]
    assert parse_file("x.xlsx", b"no zip")["error"] == "XLSX_MALFORMED"
    assert parse_file("x.xlsx", xlsx([("s", "", '<row><c r="ZZZZ1"/></row>')]))["error"] == "XLSX_MALFORMED"
    assert parse_file("x.xlsx", xlsx([("s", "", "")], extra='<mergeCell ref="A1:Z100000"/>'))["error"] == "TABLE_MERGED_CELL_LIMIT_EXCEEDED"


def test_docx():
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = lambda text, style="": f'<w:p><w:pPr>{f"""<w:pStyle w:val="{style}"/>""" if style else ""}</w:pPr><w:r><w:t>{text}</w:t></w:r></w:p>'
    cells = lambda *xs: "<w:tr>" + "".join(f"<w:tc>{p(x)}</w:tc>" for x in xs) + "</w:tr>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{p('Top', 'h1')}{p('Body')}{p('item', 'lb')}<w:tbl>{cells('k', 'v')}{cells('a', ' b  c ')}</w:tbl>{p('Next', 'h1')}{p(' ')}</w:body></w:document>")
        z.writestr("word/styles.xml", f'<w:styles {w}><w:style w:styleId="h1"><w:name w:val="heading 1"/></w:style><w:style w:styleId="lb"><w:name w:val="List Bullet"/></w:style></w:styles>')
    got = [(b["kind"], b["text"], b["meta"]["heading_path"]) for b in parse_file("d.docx", out.getvalue())["blocks"]]
    assert got == [("heading", "Top", ["Top"]), ("paragraph", "Body", ["Top"]), ("list_item", "item", ["Top"]), ("table_row", "k：a；v：b c", ["Top"]), ("heading", "Next", ["Next"])]
    assert parse_file("d.docx", b"PK")["error"] == "DOCX_MALFORMED"


def test_cells_and_headers():
    d = datetime.datetime
    assert [t.cell_text(v) for v in (d(2024, 1, 2), d(2024, 1, 2, 3), datetime.date(2024, 1, 2), True, 3.0, 3.5, "x")] == ["2024-01-02", "2024-01-02T03:00:00", "2024-01-02", "true", "3", "3.5", "x"]
    assert t.unique_headers(["a", None, "a", "a_2", "a"]) == ["a", "列2", "a_2", "a_2_2", "a_3"]
    for rows, limits, code in (([(1, ["a"]), (2, ["b"])], (1, 9, 9), "ROW"), ([(1, ["a", "b"])], (9, 1, 9), "COLUMN"), ([(1, ["abc"])], (9, 9, 2), "CELL_CHARACTER")):
        with pytest.raises(t.TableError) as e:
            t.table_rows(rows, "s", limits)
        assert e.value.code == f"TABLE_{code}_LIMIT_EXCEEDED"


def test_pdf_paragraphs():
    assert pdf_paragraphs("one  exam-\nple\nline\n \t\n\n  two \n") == ["one example line", "two"]


def zipped(**files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for n, d in files.items():
            z.writestr(n, d)
    return out.getvalue()


def test_archive_codes():
    assert decode.archive_code(b"x") == "INVALID_FILE_SIGNATURE" and decode.archive_code(zipped(a="b")) is None
    assert decode.archive_code(zipped(**{"../a": "b"})) == "ARCHIVE_UNSAFE_PATH" == decode.archive_code(zipped(**{"/a": "b"}))
    assert decode.archive_code(zipped(a="0" * 500_000)) == "ARCHIVE_COMPRESSION_RATIO_EXCEEDED"
    assert decode.archive_code(zipped(a="0123456789" * 9), 10) == "ARCHIVE_EXPANSION_LIMIT_EXCEEDED"


def test_export_and_import():
    docs = [{"id": "d1", "name": "a/b?.txt", "position": 1, "object_key": "k"}, {"id": "d2", "name": "..", "position": 2}]
    revisions = [{"document_id": "d1", "version": 1, "segments": {"items": [{"id": "p", "parent_id": None}, {"id": "c", "parent_id": "p"}]}}]
    out = io.BytesIO()
    archive.export_archive(out, {"id": "s", "name": "N"}, {"top_k": 5}, docs, revisions, lambda i: f"body {i}".encode())
    got = archive.import_archive(out.getvalue())
    assert [d["content"] for d in got["documents"]] == [b"body d1", b"body d2"] and got["dataset"]["id"] != "s"
    items = got["documents"][0]["revisions"][0]["segments"]["items"]
    assert items[1]["parent_id"] == items[0]["id"] != "p" and got["documents"][0]["imported_document_id"] == "d1"
    z = zipfile.ZipFile(io.BytesIO(out.getvalue()))
    files = {n: z.read(n) for n in z.namelist()}
    assert "files/d1/b_.txt" in files and "files/d2/file" in files
    for change, code in (({"files/d1/b_.txt": b"x"}, "ARCHIVE_HASH_MISMATCH"), ({"manifest.json": b"{}"}, "ARCHIVE_INVALID"), ({"../x": b""}, "ARCHIVE_UNSAFE_PATH")):
        with pytest.raises(decode.ParseError) as e:
            archive.import_archive(zipped(**{**files, **change}))
        assert e.value.code == code
    with pytest.raises(decode.ParseError):
        archive.import_archive(zipped(**{k: v for k, v in files.items() if k != "dataset.json"}))


def test_files_in_spark(spark, tmp_path):
    (tmp_path / "a.txt").write_text("x\n\ny")
    (tmp_path / "b.bin").write_bytes(b"\0")
    got = parse_files(read_files(spark, str(tmp_path))).collect()
    assert sorted((r.document_id.rsplit("/")[-1], r.text, r.error) for r in got) == [("a.txt", "x", None), ("a.txt", "y", None), ("b.bin", None, "UNSUPPORTED_FILE_TYPE")]
    assert json.loads(got[0].metadata or "{}") is not None


def test_versioned_store(spark, tmp_path):
    root = str(tmp_path / "t")
    assert current(spark, root) is None
    commit(spark.range(3), root)
    commit(spark.range(5), root)
    assert current(spark, root).count() == 5


def test_graph_csv(spark, tmp_path):
    (tmp_path / "nodes.csv").write_text('nodeId,name\n1,"a ""b"""\n2,c\n')
    got = read_graph_csv(spark, str(tmp_path / "nodes.csv"), ("nodeId", "name", "labels")).collect()
    assert [tuple(r) for r in got] == [("1", 'a "b"', None), ("2", "c", None)]
