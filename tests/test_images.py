"""Images and scanned pages, with engines, decoders and page openers that stand in for the libraries."""

import struct
from dataclasses import replace
from types import SimpleNamespace

import pytest
from marlstone.sources import images as I
from marlstone.sources.decode import ParseError
from marlstone.sources.files import parse_file

FILE = "doc string, name string, content binary, pages array<int>"


def png(width, height):
    return b"\x89PNG\r\n\x1a\n" + struct.pack(">I", 13) + b"IHDR" + struct.pack(">II", width, height) + b"\x08\x02\0\0\0"


def jpeg(width, height):
    return b"\xff\xd8\xff\xe0\x00\x04ab\xff\xff\xc4\x00\x03x\xff\xc2\x00\x0b\x08" + struct.pack(">HH", height, width) + b"\x01\x01\x11\x00"


def code(call):
    with pytest.raises(ParseError) as e:
        call()
    return e.value.code


def test_sizes_in_headers():
    assert I.image_size(png(70000, 3)) == (70000, 3) and I.image_size(jpeg(640, 480)) == (640, 480)
    assert [I.image_size(d) for d in (b"", b"\xff\xd8", b"\xff\xd8\xff\xe0\x00\x04ab", png(1, 1)[:20], b"GIF89a")] == [None] * 5


def test_decode_guard():
    loaded = []

    def decoder(data):
        loaded.append(data)
        return SimpleNamespace(width=5, height=4)

    for size in ((12_001, 1), (1, 12_001), (8_000, 8_000), (0, 5)):
        assert code(lambda s=size: I.decode_image(png(*s), decoder=decoder)) == "IMAGE_DIMENSION_LIMIT_EXCEEDED"
    assert loaded == []  # refused before anything was loaded
    assert I.decode_image(png(5, 4), decoder=decoder).width == 5
    assert code(lambda: I.decode_image(b"?", replace(I.Limits(), pixels=19), decoder)) == "IMAGE_DIMENSION_LIMIT_EXCEEDED"
    assert code(lambda: I.decode_image(b"?", decoder=lambda d: 1 / 0)) == "IMAGE_MALFORMED"
    assert parse_file("x.png", png(12_001, 1))["error"] == "IMAGE_DIMENSION_LIMIT_EXCEEDED" and parse_file("x.jpg", jpeg(9, 9))["error"] == "OCR_NOT_ENABLED"


def test_render_page():
    page = SimpleNamespace(get_size=lambda: (100.2, 50), render=lambda scale: ("drawn", scale))
    assert I.render_page(page) == ("drawn", 2.0) and I.render_page(page, replace(I.Limits(), dpi=36)) == ("drawn", 0.5)
    assert code(lambda: I.render_page(page, replace(I.Limits(), width=200))) == "IMAGE_DIMENSION_LIMIT_EXCEEDED"  # 200.4 points round up
    assert I.render_page(page, replace(I.Limits(), width=201)) == ("drawn", 2.0)
    assert code(lambda: I.render_page(SimpleNamespace(get_size=lambda: (1, 1)))) == "PDF_RENDER_FAILED"


def test_missing_libraries():
    for call in (lambda: I.decode_image(png(1, 1)), lambda: I.open_pdf(b"%PDF-"), I.paddle_engine()):
        try:
            call()
        except ParseError as e:
            assert e.code in ("OCR_DEPENDENCY_MISSING", "OCR_INITIALIZATION_FAILED", "IMAGE_MALFORMED", "PDF_MALFORMED")
        except Exception as e:  # the library is installed and refuses the bytes
            assert type(e).__name__ == "PdfiumError"
    with pytest.raises(ValueError):
        I.paddle_engine("tpu")


def stand_ins():
    """Images are their own text: a line a row, |-separated pages in PDF files, each 100 points high and drawn at 144 dpi."""

    def decoder(data):
        return SimpleNamespace(width=30, height=200, content=data.decode())

    def page(content):
        def render(scale):
            if content == "torn":
                raise OSError
            return SimpleNamespace(width=30, height=200, content=content)

        return SimpleNamespace(get_size=lambda: (15, 100), render=render)

    def engine():
        def recognise(image):
            if image.content == "boom":
                raise RuntimeError
            for k, line in enumerate(filter(None, image.content.split("\n"))):
                yield line, 0.1 if line == "noise" else 0.9, [[0.0, 5.0 + 40 * k], [9.0, 15.0 + 40 * k]]

        return recognise

    return engine, decoder, lambda data: [page(p) for p in data.decode().split("|")]


def test_documents(spark):
    engine, decoder, opener = stand_ins()
    rows = [
        ("img", "a.PNG", b"first\nnoise\nthird", None), ("none", "b.jpg", b"", None), ("bad", "c.png", b"\xff", None), ("big", "d.png", png(12_001, 1), None), ("boom", "e.png", b"boom", None), ("null", "f.png", None, None),
        ("pdf", "g.pdf", b"Head\nbody one|Head\nbody two|torn|", None), ("some", "h.pdf", b"p1|p2|p3", [2, 9]), ("fail", "i.pdf", b"torn|torn", None), ("long", "j.pdf", b"a\nb|c\nd", None), ("pages", "k.pdf", b"a|b|c|d|e", None), ("odd", "l.exe", b"x", None),
    ]
    files = spark.createDataFrame(rows, FILE)
    limits = replace(I.Limits(), lines=5, pages=4)
    lines = I.recognised_lines(files, engine, limits, decoder, opener)
    assert sorted((r.doc, r.page, r.ord) for r in lines.where("doc = 'img'").collect()) == [("img", 1, 0), ("img", 1, 1), ("img", 1, 2)]
    blocks = {}
    for r in I.ocr_blocks(lines).orderBy("document_id", "ord").collect():
        blocks.setdefault(r.document_id, []).append((r.ord, r.page, r.text, r.image_width, r.image_height) if r.error is None else r.error)
    assert blocks == {
        "img": [(0, 1, "first", 30, 200), (1, 1, "third", 30, 200)], "none": ["OCR_NO_EXTRACTABLE_TEXT"], "bad": ["IMAGE_MALFORMED"], "big": ["IMAGE_DIMENSION_LIMIT_EXCEEDED"], "boom": ["OCR_FAILED"], "null": ["OCR_NO_EXTRACTABLE_TEXT"],
        "pdf": [(0, 1, "body one", 30, 200), (1, 2, "body two", 30, 200)], "some": [(0, 2, "p2", 30, 200)], "fail": ["PDF_RENDER_FAILED"], "long": [(k, 1 + k // 2, t, 30, 200) for k, t in enumerate("abcd")],
        "pages": ["PDF_PAGE_LIMIT_EXCEEDED"], "odd": ["UNSUPPORTED_FILE_TYPE"],
    }
    summary = {r.document_id: (r.ocr_page_count, r.ocr_filtered_line_count, [tuple(f) for f in r.failed_pages]) for r in I.ocr_summary(lines).collect()}
    assert summary["img"] == (1, 1, []) and summary["pdf"] == (3, 0, [(3, "PDF_RENDER_FAILED")]) and summary["fail"] == (0, 0, [(1, "PDF_RENDER_FAILED"), (2, "PDF_RENDER_FAILED")])
    few = I.recognised_lines(files.where("doc = 'long'"), engine, replace(limits, lines=3), decoder, opener)
    assert [(r.page, r.error) for r in few.collect()] == [(None, "OCR_LINE_LIMIT_EXCEEDED")]
    assert [r.error for r in I.recognised_lines(files.where("doc = 'img'"), None).collect()] == ["OCR_NOT_ENABLED"]
    assert I.ocr_blocks(I.recognised_lines(files.limit(0), engine)).count() == 0


def test_blank_pages(spark):
    warned = '[{"code": "PDF_EMPTY_PAGE", "metadata": {"page": 2}}, {"code": "OTHER", "metadata": {}}]'
    parsed = spark.createDataFrame([("a", 0, warned), ("a", 1, warned), ("b", 0, "[]"), ("c", 0, None)], "document_id string, ord int, warnings string")
    assert [tuple(r) for r in I.blank_pages(parsed).collect()] == [("a", [2])]
