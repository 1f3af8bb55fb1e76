"""OCR clean-up and page furniture (P12, A10, A11, W4, W6, S13) and bounded warnings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normalise_ocr
from ..functions.vectors import clamp

#: Fixed values of the clean-up.
LEAST_CONFIDENCE, LONGEST_FURNITURE, GAP, MOST_BOXES, EDGE = 0.5, 80, 0.75, 100, 0.1


def adapt_lines(raw: DataFrame) -> DataFrame:
    """Text, confidence in 0..1 and polygon of recognised lines; rows with a number that isn't finite are dropped."""
    number = F.col("confidence").cast("double")
    finite = F.coalesce(~F.isnan(number) & (F.abs(number) < float("inf")), F.lit(False))
    points = F.forall(F.coalesce("box", F.array().cast("array<array<double>>")), lambda p: F.forall(p, lambda x: ~F.isnan(x) & (F.abs(x) < float("inf"))))
    return raw.where(finite & points & F.col("text").isNotNull()).withColumn("confidence", clamp(number))


def kept_lines(lines: DataFrame, repeated: DataFrame) -> DataFrame:
    """Lines (doc, page, ord, text, confidence, box) without noise and without repeated first and last lines."""
    n = lines.withColumn("text", normalise_ocr(F.col("text")))
    punctuation = ~F.col("text").rlike(r"(?U)[^\p{P}\s]")
    n = n.where((F.col("text") != "") & ~punctuation & (F.col("confidence") >= LEAST_CONFIDENCE))
    page = Window.partitionBy("doc", "page")
    edge = (F.col("ord") == F.min("ord").over(page)) | (F.col("ord") == F.max("ord").over(page))
    furniture = repeated.select("doc", "page", normalise_ocr(F.col("text")).alias("text"), F.lit(True).alias("__again")).distinct()
    marked = n.withColumn("__edge", edge).join(furniture, ["doc", "page", "text"], "left")
    drop = F.col("__edge") & F.coalesce("__again", F.lit(False)) & (F.length("text") <= LONGEST_FURNITURE)
    return marked.where(~drop).select(*lines.columns)


def paragraphs(lines: DataFrame) -> DataFrame:
    """Lines joined while the gap above them is at most 0.75 of the taller line; mean confidence."""
    ys = F.transform("box", lambda p: F.get(p, 1))
    page = Window.partitionBy("doc", "page").orderBy("ord")
    top, bottom = F.array_min(ys), F.array_max(ys)
    shaped = lines.withColumns({"__t": top, "__b": bottom}).withColumns({"__pt": F.lag("__t").over(page), "__pb": F.lag("__b").over(page)})
    jump = F.coalesce(F.col("__t") - F.col("__pb") > GAP * F.greatest(F.col("__pb") - F.col("__pt"), F.col("__b") - F.col("__t")), F.lit(False))
    numbered = shaped.withColumn("paragraph", F.sum(jump.cast("int")).over(page))
    rows = F.array_sort(F.collect_list(F.struct("ord", "text", "box")))
    joined = numbered.groupBy("doc", "page", "paragraph").agg(rows.alias("r"), F.round(F.avg("confidence"), 4).alias("confidence"))
    return joined.select("doc", "page", "paragraph", F.array_join(F.transform("r", lambda x: x["text"]), " ").alias("text"), "confidence", F.size(F.filter("r", lambda x: x["box"].isNotNull())).alias("boxes"))


def repeated_furniture(lines: DataFrame, heights: DataFrame) -> DataFrame:
    """Short first and last lines in the outer tenth of their page, on two pages or more of a document."""
    page = Window.partitionBy("doc", "page")
    edge = (F.col("ord") == F.min("ord").over(page)) | (F.col("ord") == F.max("ord").over(page))
    ys = F.transform("box", lambda p: F.get(p, 1))
    at = lines.withColumns({"__edge": edge, "text": normalise_ocr(F.col("text"))}).join(heights, ["doc", "page"])
    outer = (F.array_max(ys) <= EDGE * F.col("height")) | (F.array_min(ys) >= (1 - EDGE) * F.col("height"))
    found = at.where(F.col("__edge") & outer & (F.col("text") != "") & (F.length("text") <= LONGEST_FURNITURE)).select("doc", "page", "text").distinct()
    often = found.groupBy("doc", "text").agg(F.count("*").alias("n")).where("n >= 2").select("doc", "text")
    return found.join(often, ["doc", "text"], "left_semi").select("doc", "page", "text")


def bounded_warnings(warnings: DataFrame, limit: int) -> DataFrame:
    """A document's first limit - 1 warnings, and one that counts the others. warnings: doc, ord, code, omitted."""
    summary = F.col("code") == "WARNINGS_TRUNCATED"
    plain = warnings.where(~summary).withColumn("n", F.row_number().over(Window.partitionBy("doc").orderBy("ord")))
    kept = plain.where(F.col("n") < limit).select("doc", "ord", "code", F.lit(None).cast("long").alias("omitted"))
    own = F.when(F.coalesce("omitted", F.lit(0)) > 0, F.col("omitted")).otherwise(1)
    lost = plain.where(F.col("n") >= limit).select("doc", F.lit(1).cast("long").alias("k")).unionAll(warnings.where(summary).select("doc", own.cast("long").alias("k")))
    folded = lost.groupBy("doc").agg(F.sum("k").alias("omitted")).select("doc", F.lit(2147483647).cast("long").alias("ord"), F.lit("WARNINGS_TRUNCATED").alias("code"), "omitted")
    return kept.withColumn("ord", F.col("ord").cast("long")).unionByName(folded)
