"""Files to blocks: dispatch by extension, text, CSV and optional formats."""

from __future__ import annotations

import csv
import io
import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import is_blank, normalise_newlines
from ..operators.segmentation import BATCH_CHARACTERS, BATCH_ROWS
from ..operators.tables import TableError, table_rows
from ..shipping import bound_batches, ship_package
from .decode import ParseError, decode_text, normalise
from .images import Limits, image_size
from .markdown import blocks_of, front_matter
from .office import parse_docx, parse_xlsx

BLOCKS = "document_id string, source_type string, ord int, kind string, text string, meta string, metadata string, warnings string, error string"
#: Separators that CSV files are tried for, within their first characters.
SEPARATORS, SNIFFED = ",;\t|", 8192


def text_blocks(text: str) -> list[dict]:
    """S4 for one text: runs of lines that aren't blank."""
    blocks: list[dict] = []
    run: list[str] = []
    for number, line in enumerate([*text.split("\n"), ""], 1):
        if line.strip():
            run.append(line)
        elif run:
            blocks.append({"kind": "paragraph", "text": "\n".join(run), "meta": {"line_start": number - len(run), "line_end": number - 1}})
            run = []
    return blocks


def text_blocks_native(texts: DataFrame) -> DataFrame:
    """S4 over a table (document_id, text), by gaps and islands on lines, without Python: document_id, ord, text, line_start, line_end."""
    lines = texts.select("document_id", F.posexplode(F.split(normalise_newlines(F.col("text")), "\n")).alias("p", "line")).where(~is_blank(F.col("line")))
    within = Window.partitionBy("document_id").orderBy("p")
    runs = lines.withColumn("run", F.col("p") - F.row_number().over(within))
    joined = runs.groupBy("document_id", "run").agg(F.array_sort(F.collect_list(F.struct("p", "line"))).alias("l"), (F.min("p") + 1).alias("line_start"), (F.max("p") + 1).alias("line_end"))
    order = F.row_number().over(Window.partitionBy("document_id").orderBy("line_start"))
    return joined.select("document_id", order.alias("ord"), F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("text"), "line_start", "line_end")


def csv_dialect(text: str):
    """The separator of the first characters, comma if none is certain."""
    if any(s in text for s in SEPARATORS):
        try:
            return csv.Sniffer().sniff(text[:SNIFFED], delimiters=SEPARATORS)
        except csv.Error:
            pass
    return csv.excel


def parse_csv(data: bytes) -> tuple[list[dict], dict]:
    """Rows carry the physical line on which their record ends."""
    try:
        text, encoding = decode_text(data)
    except ParseError as e:
        raise ParseError("CSV_ENCODING_UNCERTAIN") from e
    reader = csv.reader(io.StringIO(text, newline=""), dialect=csv_dialect(text), strict=True)
    try:
        return table_rows([(reader.line_num, [v or None for v in row]) for row in reader], "CSV")[0], {"encoding": encoding}
    except csv.Error as e:
        raise ParseError("CSV_MALFORMED") from e


def _text(data: bytes):
    text, encoding = decode_text(data)
    return text_blocks(normalise(text)), {"encoding": encoding}, []


def _markdown(data: bytes):
    text, encoding = decode_text(data)
    rest, meta, offset = front_matter(normalise(text))
    blocks, links = blocks_of(rest, offset)
    return blocks, {"encoding": encoding} | meta | ({"links": links} if links else {}), []


def _csv(data: bytes):
    blocks, meta = parse_csv(data)
    return blocks, meta, []


def _xlsx(data: bytes):
    blocks, warnings = parse_xlsx(data)
    return blocks, {}, warnings


def _xls(data: bytes):
    try:
        import xlrd
    except ImportError as e:
        raise ParseError("PARSER_DEPENDENCY_MISSING") from e
    try:
        book = xlrd.open_workbook(file_contents=data)
    except Exception as e:
        raise ParseError("XLS_MALFORMED") from e
    blocks, warnings, used = [], [], 0
    for sheet in book.sheets():
        if sheet.visibility:
            warnings.append({"code": "SHEET_HIDDEN", "metadata": {"sheet": sheet.name}})
            continue

        def value(cell):
            if cell.ctype in (xlrd.XL_CELL_EMPTY, xlrd.XL_CELL_BLANK) or cell.ctype == xlrd.XL_CELL_TEXT and cell.value == "":
                return None
            if cell.ctype == xlrd.XL_CELL_DATE:
                return xlrd.xldate_as_datetime(cell.value, book.datemode)
            return bool(cell.value) if cell.ctype == xlrd.XL_CELL_BOOLEAN else cell.value

        own, used = table_rows([(r + 1, [value(c) for c in sheet.row(r)]) for r in range(sheet.nrows)], sheet.name, used=used)
        if not own:
            warnings.append({"code": "SHEET_EMPTY", "metadata": {"sheet": sheet.name}})
        blocks += own
    return blocks, {}, warnings


def _pdf(data: bytes, max_pages: int = Limits.pages):
    try:
        import pypdf
    except ImportError as e:
        if not data.startswith(b"%PDF-"):
            raise ParseError("PDF_MALFORMED") from e
        raise ParseError("PARSER_DEPENDENCY_MISSING") from e
    try:
        reader = pypdf.PdfReader(io.BytesIO(data), strict=False)
        if reader.is_encrypted and not reader.decrypt(""):
            raise ParseError("PDF_ENCRYPTED")
        pages = list(reader.pages)
    except ParseError:
        raise
    except Exception as e:
        raise ParseError("PDF_MALFORMED") from e
    if len(pages) > max_pages:
        raise ParseError("PDF_PAGE_LIMIT_EXCEEDED")
    blocks, warnings = [], []
    for number, page in enumerate(pages, 1):
        found = [{"kind": "paragraph", "text": t, "meta": {"page": number}} for t in pdf_paragraphs(page.extract_text() or "")]
        if not found:
            warnings.append({"code": "PDF_EMPTY_PAGE", "metadata": {"page": number}})
        blocks += found
    return blocks, {}, warnings


def pdf_paragraphs(text: str) -> list[str]:
    """S11/F18 for Python strings: joined lines, hyphens at line ends closed."""
    import re

    out = []
    for raw in re.split(r"\n[ \t]*\n", normalise(text)):
        joined = ""
        for line in filter(None, map(str.strip, raw.split("\n"))):
            joined = joined[:-1] + line if joined.endswith("-") else f"{joined} {line}" if joined else line
        joined = re.sub(r"[ \t]+", " ", joined).strip()
        if joined:
            out.append(joined)
    return out


def _image(data: bytes):
    """Images have no text layer: recognised_lines() and ocr_blocks() of images.py read them with an engine."""
    if image_size(data):
        Limits().check(*image_size(data))
    raise ParseError("OCR_NOT_ENABLED")


#: Extension to parser and source type.
PARSERS: dict[str, tuple[Callable, str]] = {
    ".txt": (_text, "text"), ".md": (_markdown, "markdown"), ".markdown": (_markdown, "markdown"), ".csv": (_csv, "csv"), ".xls": (_xls, "xls"), ".xlsx": (_xlsx, "xlsx"),
    ".docx": (lambda d: (parse_docx(d), {}, []), "docx"), ".pdf": (_pdf, "pdf"), ".png": (_image, "image"), ".jpg": (_image, "image"), ".jpeg": (_image, "image"),
}


def parse_file(name: str, data: bytes, parsers: dict | None = None) -> dict:
    """source_type, blocks, metadata, warnings, error of one file; errors are values, not exceptions."""
    extension = "." + name.strip().lower().rpartition(".")[2] if "." in name else ""
    parser, kind = (parsers or PARSERS).get(extension, (None, ""))
    out = {"source_type": kind, "blocks": [], "metadata": {}, "warnings": [], "error": None}
    if parser is None:
        return out | {"error": "UNSUPPORTED_FILE_TYPE"}
    try:
        blocks, meta, warnings = parser(data)
    except (ParseError, TableError) as e:
        return out | {"error": e.code}
    return out | {"blocks": blocks, "metadata": meta, "warnings": warnings, "error": None if blocks else "NO_EXTRACTABLE_TEXT"}


def read_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Path, content and length of files in any store that Hadoop reads."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)


def parse_files(files: DataFrame, id_col: str = "path", name_col: str = "path", content_col: str = "content") -> DataFrame:
    """A row for each block of each file; a file without blocks gives one row with its error."""
    ship_package(files.sparkSession)
    bound_batches(files.sparkSession)
    schema = pa.schema([(name, pa.int32() if kind == "int" else pa.string()) for name, kind in (c.split() for c in BLOCKS.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[dict] = []
        held = 0
        for batch in batches:
            for row in range(batch.num_rows):
                doc, name, data = (batch.column(k)[row].as_py() for k in range(3))
                found = parse_file(name or "", data if data is not None else b"")
                common = {"document_id": doc, "source_type": found["source_type"], "metadata": json.dumps(found["metadata"], ensure_ascii=False, sort_keys=True), "warnings": json.dumps(found["warnings"], ensure_ascii=False, sort_keys=True)}
                for k, b in enumerate(found["blocks"]):
                    rows.append(common | {"ord": k, "kind": b["kind"], "text": b["text"], "meta": json.dumps(b["meta"], ensure_ascii=False, sort_keys=True)})
                    held += len(b["text"])
                    if len(rows) >= BATCH_ROWS or held >= BATCH_CHARACTERS:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, held = [], 0
                if not found["blocks"]:
                    rows.append(common | {"error": found["error"]})
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)

    return files.select(F.col(id_col).cast("string").alias("document_id"), F.col(name_col).alias("name"), F.col(content_col).alias("content")).mapInArrow(run, BLOCKS)


def gathered(blocks: DataFrame) -> DataFrame:
    """Blocks of parse_files() as one row a document, for segmentation."""
    items = F.array_sort(F.collect_list(F.struct("ord", "kind", "text", "meta")))
    return blocks.where(F.col("error").isNull()).groupBy("document_id", "source_type").agg(items.alias("blocks"))
