"""Images and scanned pages to recognised lines, lines to blocks.

Decoders, renderers and engines are injected (or found, where their libraries are installed) and run in the
task that holds the file, one image at a time, after its size is checked; clean-up, repeated furniture and
paragraphs are the joins and windows of operators/ocr.py.
"""

from __future__ import annotations

import io
import math
import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import ocr as O
from ..shipping import ship_package
from .decode import MAGIC, ParseError

LINES = "doc string, page int, ord int, text string, confidence double, box array<array<double>>, width int, height int, error string"
BLOCKS = "document_id string, ord int, kind string, text string, page int, confidence double, boxes int, image_width int, image_height int, error string"
IMAGES = (".png", ".jpg", ".jpeg")


@dataclass(frozen=True)
class Limits:
    """Bounds of an image, of the lines and pages of a document, and dots an inch of a rendered page."""

    width: int = 12_000
    height: int = 12_000
    pixels: int = 40_000_000
    lines: int = 20_000
    pages: int = 500
    dpi: int = 144

    def check(self, width: int, height: int) -> None:
        """An error for an image without area or beyond a bound."""
        if min(width, height) < 1 or width > self.width or height > self.height or width * height > self.pixels:
            raise ParseError("IMAGE_DIMENSION_LIMIT_EXCEEDED")


def image_size(data: bytes) -> tuple[int, int] | None:
    """Width and height as the header of a PNG or JPEG file gives them, nothing being decoded; None without such a header."""
    if data.startswith(MAGIC[".png"][0]):
        return struct.unpack(">II", data[16:24]) if data[12:16] == b"IHDR" and len(data) >= 24 else None
    at = 2 if data.startswith(b"\xff\xd8") else len(data)
    while at + 9 <= len(data) and data[at] == 0xFF:
        marker = data[at + 1]
        if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            height, width = struct.unpack(">HH", data[at + 5 : at + 9])
            return width, height
        if marker == 0xFF:
            at += 1
        elif marker == 0x01 or 0xD0 <= marker <= 0xD8:
            at += 2
        else:
            at += 2 + int.from_bytes(data[at + 2 : at + 4], "big")
    return None


def decode_image(data: bytes, limits: Limits = Limits(), decoder: Callable | None = None):
    """The RGB image of a file. Its size is checked in the header before it is loaded, and again after."""
    size = image_size(data)
    if size:
        limits.check(*size)
    try:
        image = decoder(data) if decoder else _pillow(data, limits)
        size = int(image.width), int(image.height)
    except ParseError:
        raise
    except Exception as e:
        raise ParseError("IMAGE_MALFORMED") from e
    limits.check(*size)
    return image


def _pillow(data: bytes, limits: Limits):
    try:
        from PIL import Image
    except ImportError as e:
        raise ParseError("OCR_DEPENDENCY_MISSING") from e
    with Image.open(io.BytesIO(data)) as source:
        limits.check(*source.size)
        return source.convert("RGB")


def open_pdf(data: bytes):
    """The pages of a PDF file by pypdfium2, where it is installed."""
    try:
        import pypdfium2
    except ImportError as e:
        raise ParseError("OCR_DEPENDENCY_MISSING") from e
    return pypdfium2.PdfDocument(data)


def render_page(page, limits: Limits = Limits()):
    """The image of a page (get_size() in points, render(scale=)) at limits.dpi; its size is checked before it is drawn."""
    try:
        scale = limits.dpi / 72
        limits.check(*(math.ceil(points * scale) for points in page.get_size()))
        drawn = page.render(scale=scale)
        return drawn.to_pil() if hasattr(drawn, "to_pil") else drawn
    except ParseError:
        raise
    except Exception as e:
        raise ParseError("PDF_RENDER_FAILED") from e


def paddle_engine(device: str = "cpu", language: str = "ch", **options) -> Callable:
    """A factory of engines for recognised_lines(): PaddleOCR, where it is installed. options go to its constructor."""
    if device not in ("cpu", "gpu"):
        raise ValueError("device must be cpu or gpu")

    def make() -> Callable:
        try:
            import numpy as np
            from paddleocr import PaddleOCR
        except ImportError as e:
            raise ParseError("OCR_DEPENDENCY_MISSING") from e
        try:
            model = PaddleOCR(lang=language, device="gpu:0" if device == "gpu" else "cpu", **options)
        except Exception as e:
            raise ParseError("OCR_INITIALIZATION_FAILED") from e

        def recognise(image):
            # the model takes blue, green, red
            pixels = np.ascontiguousarray(np.asarray(image)[:, :, ::-1])
            for found in model.predict(pixels):
                boxes = found.get("rec_polys")
                yield from zip(found["rec_texts"], found["rec_scores"], boxes if boxes is not None else [None] * len(found["rec_texts"]), strict=True)

        return recognise

    return make


def _lines_of(images: Iterator[tuple[int, Callable]], recognise: Callable, limits: Limits, whole: bool) -> list[dict]:
    """Rows of one document's images; a page that fails is one row with its error (whole: the document's error)."""
    rows, count = [], 0
    for page, load in images:
        try:
            image = load()
            shape = {"page": page, "width": int(image.width), "height": int(image.height)}
            try:
                found = list(recognise(image))
            except ParseError:
                raise
            except Exception as e:
                raise ParseError("OCR_FAILED") from e
        except ParseError as e:
            if whole:
                raise
            rows.append({"page": page, "error": e.code})
            continue
        count += len(found)
        if count > limits.lines:
            raise ParseError("OCR_LINE_LIMIT_EXCEEDED")
        rows += [shape | {"ord": k, "text": text, "confidence": float(score), "box": None if box is None else [[float(x) for x in p] for p in box]} for k, (text, score, box) in enumerate(found)] or [shape]
    return rows


def recognised_lines(files: DataFrame, engine: Callable | None, limits: Limits = Limits(), decoder: Callable | None = None, opener: Callable = open_pdf) -> DataFrame:
    """The lines that an engine reads in images and PDF pages.

    files: doc, name, content and, if only some pages of PDF files are wanted, pages (array of int from 1; null: all).
    engine() makes, once a task, a function from an image to (text, confidence, box) triples. Failures are rows: with a
    page for a page of a PDF file, without one for a document (too many lines or pages, nothing to open, no engine,
    null or undecodable bytes). An image without lines is a row without text. Empty files table: no rows.
    """
    ship_package(files.sparkSession)
    names = [c.split()[0] for c in LINES.split(", ")]
    some = F.col("pages").cast("array<int>") if "pages" in files.columns else F.lit(None).cast("array<int>")

    def document(recogniser: Callable, name: str, data: bytes, pages) -> list[dict]:
        if engine is None:
            raise ParseError("OCR_NOT_ENABLED")
        suffix = "." + name.strip().lower().rpartition(".")[2]
        if suffix in IMAGES:
            return _lines_of(iter([(1, lambda: decode_image(data, limits, decoder))]), recogniser(), limits, True)
        if suffix != ".pdf":
            raise ParseError("UNSUPPORTED_FILE_TYPE")
        try:
            opened = opener(data)
            count = len(opened)
        except ParseError:
            raise
        except Exception as e:
            raise ParseError("PDF_MALFORMED") from e
        if count > limits.pages:
            raise ParseError("PDF_PAGE_LIMIT_EXCEEDED")
        wanted = range(1, count + 1) if pages is None else [int(p) for p in pages if 1 <= p <= count]
        return _lines_of(((p, lambda p=p: render_page(opened[p - 1], limits)) for p in wanted), recogniser(), limits, False)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made: list[Callable] = []

        def recogniser() -> Callable:
            if not made:
                made.append(engine())
            return made[0]

        for frame in frames:
            for doc, name, data, pages in zip(*(frame[c] for c in ("doc", "name", "content", "pages")), strict=True):
                try:
                    rows = document(recogniser, name or "", bytes(data) if data is not None else b"", pages)
                except ParseError as e:
                    rows = [{"error": e.code}]
                out = pd.DataFrame([{"doc": doc} | r for r in rows], columns=names).astype(object)
                yield out.where(out.notna(), None).astype({c: "Int32" for c in ("page", "ord", "width", "height")})

    return files.select(F.col("doc").cast("string").alias("doc"), "name", "content", some.alias("pages")).mapInPandas(run, LINES)


def ocr_blocks(lines: DataFrame) -> DataFrame:
    """Paragraphs of recognised_lines() in page order, with the size of their image, without noise and repeated furniture.

    A document without any paragraph is one row with its error: its own, its first page's, or OCR_NO_EXTRACTABLE_TEXT.
    lines are read several times: pass a written table where the engine is costly.
    """
    sizes = lines.where("width is not null").select("doc", "page", "width", "height").distinct()
    read = O.adapt_lines(lines.where("text is not null").drop("width", "height", "error"))
    furniture = O.repeated_furniture(read, sizes.select("doc", "page", "height"))
    found = O.paragraphs(O.kept_lines(read, furniture)).join(sizes, ["doc", "page"])
    order = F.row_number().over(Window.partitionBy("doc").orderBy("page", "paragraph")) - 1
    blocks = found.select(F.col("doc").alias("document_id"), order.alias("ord"), F.lit("paragraph").alias("kind"), "text", "page", "confidence", "boxes", F.col("width").alias("image_width"), F.col("height").alias("image_height"))
    failed = lines.groupBy("doc").agg(F.min_by("error", F.struct(F.col("error").isNull(), "page")).alias("error")).join(found.select("doc").distinct(), "doc", "left_anti")
    errors = failed.select(F.col("doc").alias("document_id"), F.coalesce("error", F.lit("OCR_NO_EXTRACTABLE_TEXT")).alias("error"))
    return blocks.unionByName(errors, allowMissingColumns=True).select(*[F.col(c.split()[0]).cast(c.split()[1]) for c in BLOCKS.split(", ")])


def ocr_summary(lines: DataFrame) -> DataFrame:
    """What a document's metadata and warnings say: pages read, lines dropped as noise, failed pages (page, error_code)."""
    failed = F.array_sort(F.collect_list(F.when(F.col("error").isNotNull() & F.col("page").isNotNull(), F.struct("page", F.col("error").alias("error_code")))))
    seen = lines.groupBy("doc").agg(F.countDistinct(F.when(F.col("error").isNull(), F.col("page"))).alias("ocr_page_count"), F.count("text").alias("n"), failed.alias("failed_pages"))
    kept = O.kept_lines(O.adapt_lines(lines.where("text is not null")), lines.select("doc", "page", "text").limit(0)).groupBy("doc").agg(F.count("*").alias("k"))
    return seen.join(kept, "doc", "left").select(F.col("doc").alias("document_id"), "ocr_page_count", (F.col("n") - F.coalesce("k", F.lit(0))).alias("ocr_filtered_line_count"), "failed_pages")


def blank_pages(parsed: DataFrame) -> DataFrame:
    """document_id, pages of PDF files without a text layer, from the warnings of parse_files(): what recognised_lines() is to read."""
    warned = parsed.select("document_id", F.from_json("warnings", "array<struct<code string, metadata struct<page int>>>").alias("w")).distinct()
    pages = F.transform(F.filter("w", lambda w: w["code"] == "PDF_EMPTY_PAGE"), lambda w: w["metadata"]["page"])
    return warned.select("document_id", pages.alias("pages")).where(F.size("pages") > 0)
