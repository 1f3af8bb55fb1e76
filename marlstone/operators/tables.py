"""Table shaping: headers, rows, blocks, row groups."""

from __future__ import annotations

from datetime import date, datetime, time

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..dealing import dealt

#: Names of blank columns, and the marks between and inside pairs.
BLANK_COLUMN, PAIR, NEXT = "列", "：", "；"
MAX_ROWS, MAX_COLUMNS, MAX_CELL = 100_000, 1_000, 100_000


class TableError(ValueError):
    def __init__(self, code: str):
        super().__init__(code)
        self.code = code


def cell_text(value) -> str:
    """P6 for Python cells: dates without a midnight, small booleans, whole floats as integers."""
    if isinstance(value, datetime) and value.time() == time.min:
        return value.date().isoformat()
    if isinstance(value, (date, time)):
        return value.isoformat()
    if isinstance(value, bool):
        return str(value).lower()
    return str(int(value)) if isinstance(value, float) and value.is_integer() else str(value)


def cell_text_column(column: Column, kind: str) -> Column:
    """P6 for a typed column."""
    if kind.startswith("timestamp"):
        midnight = F.date_format(column, "HH:mm:ss.SSSSSS") == "00:00:00.000000"
        return F.when(midnight, F.date_format(column, "yyyy-MM-dd")).otherwise(F.date_format(column, "yyyy-MM-dd'T'HH:mm:ss"))
    if kind in ("double", "float"):
        return F.when(column == F.floor(column), F.format_string("%d", column.cast("long"))).otherwise(column.cast("string"))
    return column.cast("string")


def unique_headers(values: list) -> list[str]:
    """Blank names by position, repeated ones numbered from 2 against all names used so far."""
    names: list[str] = []
    for k, v in enumerate(values, 1):
        base = (cell_text(v).strip() if v is not None else "") or f"{BLANK_COLUMN}{k}"
        name, n = base, 1
        while name in names:
            n += 1
            name = f"{base}_{n}"
        names.append(name)
    return names


def unique_headers_column(values: Column) -> Column:
    """P4 as an expression over an array of names."""
    based = F.transform(values, lambda v, k: F.when(F.coalesce(F.trim(v), F.lit("")) == "", F.concat(F.lit(BLANK_COLUMN), (k + 1).cast("string"))).otherwise(F.trim(v)))

    def step(used: Column, base: Column) -> Column:
        numbered = F.transform(F.sequence(F.lit(1), F.size(used) + 1), lambda n: F.when(n == 1, base).otherwise(F.concat(base, F.lit("_"), n.cast("string"))))
        return F.array_append(used, F.filter(numbered, lambda c: ~F.array_contains(used, c))[0])

    return F.aggregate(based, F.array().cast("array<string>"), step)


def row_text(headers: list[str], values: list) -> str:
    """Header and value of every cell that isn't null."""
    label = lambda k: (headers[k].strip() if k < len(headers) else "") or f"{BLANK_COLUMN}{k + 1}"
    return NEXT.join(f"{label(k)}{PAIR}{cell_text(v).strip()}" for k, v in enumerate(values) if v is not None)


def row_text_column(headers: Column, values: Column) -> Column:
    """P7 as an expression over arrays of headers and texts."""
    pairs = F.zip_with(headers, values, lambda h, v: F.when(v.isNotNull(), F.concat(h, F.lit(PAIR), F.trim(v))))
    return F.concat_ws(NEXT, F.array_compact(pairs))


def table_rows(rows: list[tuple[int, list]], sheet: str, limits: tuple[int, int, int] = (MAX_ROWS, MAX_COLUMNS, MAX_CELL), used: int = 0) -> tuple[list[dict], int]:
    """Blocks of one table and the data rows used so far; its first row with text names the columns."""
    most_rows, most_columns, most_cell = limits
    kept: list[tuple[int, list]] = []
    for number, values in rows:
        values = list(values)
        while values and values[-1] is None:
            values.pop()
        if not any(v is not None and cell_text(v).strip() for v in values):
            continue
        used += 1
        if used > most_rows:
            raise TableError("TABLE_ROW_LIMIT_EXCEEDED")
        if len(values) > most_columns:
            raise TableError("TABLE_COLUMN_LIMIT_EXCEEDED")
        if any(v is not None and len(cell_text(v)) > most_cell for v in values):
            raise TableError("TABLE_CELL_CHARACTER_LIMIT_EXCEEDED")
        kept.append((number, values))
    if not kept:
        return [], used
    width = max(len(v) for _, v in kept)
    headers = unique_headers(kept[0][1] + [None] * (width - len(kept[0][1])))
    blocks = [{"kind": "table_row", "text": text, "meta": {"sheet": sheet, "row": number, "headers": headers}} for number, values in kept[1:] if (text := row_text(headers, values))]
    return blocks, used


def tables_to_blocks(cells: DataFrame) -> DataFrame:
    """P5/P8 over a table of rows (sheet, row, values array<string>): sheet, row, text, headers."""
    trimmed = F.slice(F.col("values"), F.lit(1), F.coalesce(F.array_max(F.transform("values", lambda v, k: F.when(v.isNotNull(), k + 1))), F.lit(0)))
    meaningful = cells.withColumn("values", trimmed).where(F.exists("values", lambda v: v.isNotNull() & (F.trim(v) != "")))
    shape = meaningful.groupBy("sheet").agg(F.min_by("values", "row").alias("__head"), F.min("row").alias("__first"), F.max(F.size("values")).alias("__width"))
    padded = F.transform(F.sequence(F.lit(0), F.col("__width") - 1), lambda k: F.get(F.col("__head"), k))
    headed = meaningful.join(shape.select("sheet", "__first", unique_headers_column(padded).alias("headers")), "sheet").where(F.col("row") > F.col("__first"))
    rows = headed.select("sheet", "row", row_text_column(F.slice("headers", F.lit(1), F.size("values")), F.col("values")).alias("text"), "headers")
    return rows.where(F.col("text") != "")


def grouped_rows(blocks: DataFrame, tasks: int | None = None) -> DataFrame:
    """Sheet, group, first_row, last_row of adjacent rows, by gaps and islands within each sheet. tasks: 1 for blocks that are dealt by sheet."""
    blocks = dealt(blocks, "sheet", tasks=tasks)
    island = F.col("row") - F.row_number().over(Window.partitionBy("sheet").orderBy("row"))
    return blocks.withColumn("__g", island).groupBy("sheet", "__g").agg(F.min("row").alias("first_row"), F.max("row").alias("last_row"), F.count("*").alias("rows")).drop("__g")
