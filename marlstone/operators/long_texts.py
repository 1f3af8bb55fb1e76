"""F1 for texts of any length: the boundary cuts of one text, found by several tasks.

Where a cut ends depends on one window of the text alone, so "the next start" is a function of the start. A long text is dealt as
stretches of equal length, each with one window more. A task computes the function for every place of its stretch at
once, in numpy, and follows it from every place where the first cut of a stretch may start (less than one window). That gives,
for each entry of a stretch, the entry to the next one and the number of segments between. These tables are composed along the text,
and each stretch then lists the cuts from its true entry. No guess can fail, and a text without boundaries costs no more than others.

Texts of up to one stretch are cut where they lie, without a shuffle; long ones are shuffled once by (document_id, stretch). A group holds one
stretch, or the entry tables of one text (some kB a stretch).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship_package
from .segmentation import Config, Cutter, SegmentationError

#: Code points of a stretch.
STRETCH = 65_536
#: A start behind every text: the cut before it ended the text.
STOP = np.iinfo(np.int64).max
#: White space of str.isspace, as a table over code points; the last entry stands for all beyond.
SPACE = np.array([chr(c).isspace() for c in range(0x3001)] + [False])
FIELDS = ("position", "start", "end", "content")


@dataclass
class Cuts:
    """For every start of a stretch: where its cut ends, where the next one starts (or STOP), and whether it shows any text."""

    ends: np.ndarray
    nexts: np.ndarray
    shown: np.ndarray


def latest_ends(codes: np.ndarray, mark: str) -> np.ndarray:
    """For every place, 0 to len(codes): the largest end of an occurrence of mark that is not behind it, or -1."""
    ends, places = np.full(len(codes) + 1, -1, np.int32), len(codes) - len(mark) + 1
    if places > 0:
        hit = np.logical_and.reduce([codes[k : k + places] == ord(c) for k, c in enumerate(mark)])
        at = np.flatnonzero(hit) + len(mark)
        ends[at] = at
    return np.maximum.accumulate(ends)


def cuts_of(text: str, left: int, config: Config, stretch: int) -> Cuts:
    """The cuts from each of the first `stretch` places of a text; left: code points from its start to the document's end."""
    codes = np.frombuffer(text.encode("utf-32-le"), dtype="<u4")
    starts = np.arange(min(stretch, len(codes)), dtype=np.int32)
    limits = np.minimum(starts + config.max_length, len(codes))
    visible = np.where(SPACE[np.minimum(codes, len(SPACE) - 1)], len(codes), np.arange(len(codes), dtype=np.int32))
    visible = np.minimum.accumulate(visible[::-1])[::-1][: len(starts)]
    mark = np.full(len(starts), -1, np.int32)
    for marks in dict.fromkeys(Cutter(config.separator).classes):
        best = np.full(len(starts), -1, np.int32)
        for m in marks:
            ends = latest_ends(codes, m)[limits]
            best = np.maximum(best, np.where((ends - len(m) >= starts) & (ends > visible), ends, -1))
        mark = np.where(mark < 0, best, mark)
    step = max(1, (config.max_length - config.overlap + 1) // 2)
    ends = np.where((mark >= 0) & (mark - config.overlap - starts >= step), mark, starts + config.max_length)
    last = starts + config.max_length >= left
    ends = np.where(last, left, ends.astype(np.int64))
    return Cuts(ends, np.where(last, STOP, ends - config.overlap), visible < ends)


def passage(cuts: Cuts, entries: int, stretch: int) -> tuple[np.ndarray, np.ndarray]:
    """For each entry: the entry to the next stretch, -1 where the text ends before, and the number of segments on the way."""
    places = len(cuts.ends)
    at, count = np.arange(entries), np.zeros(entries, np.int64)
    live = np.flatnonzero(at < places)
    while len(live):
        now = at[live]
        count[live] += cuts.shown[now]
        at[live] = cuts.nexts[now]
        live = live[at[live] < places]
    return np.where((at == STOP) | (at < stretch), -1, at - stretch), count


def _dealt(texts: DataFrame, stretch: int, window: int) -> DataFrame:
    """document_id, n, k, text: stretch k of each text with one window more.

    One pass of a possessive pattern, which does not backtrack, cuts the text; substr for each stretch would read all text before it.
    """
    parts = texts.select("document_id", "n", F.regexp_extract_all("text", F.lit(f"(?s).{{1,{stretch}}}+"), F.lit(0)).alias("parts"))
    widened = F.transform("parts", lambda x, k: F.concat(x, F.coalesce(F.substring(F.get("parts", k + 1), 1, window), F.lit(""))))
    return parts.select("document_id", "n", F.posexplode(widened).alias("k", "text"))


def cut_texts(texts: DataFrame, config: Config, stretch: int = STRETCH) -> DataFrame:
    """document_id, position, start, end (code points), content: the general segments of texts (document_id, text).

    The same cuts as segment() gives for one block, without its budgets. document_id is unique and not null. Ranges of white space alone
    are left out and positions count the others; null, empty and blank texts have no row. Extra columns are not read.
    """
    config.check()
    if config.mode != "general":
        raise SegmentationError("texts are cut in general mode")
    if stretch < config.max_length:
        raise SegmentationError("a stretch holds at least one segment")
    ship_package(texts.sparkSession)
    kind = texts.schema["document_id"].dataType.simpleString()
    entries = config.max_length - config.overlap
    texts = texts.select("document_id", "text", F.length("text").cast("long").alias("n"))

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            origin: list[int] = []
            for k, text in enumerate(batch.column(1).to_pylist()):
                kept = [(s, e) for s, e in Cutter(config.separator, len(text) + 1, 1 << 62).ranges(text, config.max_length, config.overlap) if text[s:e].strip()]
                rows += [(p, s, e, text[s:e]) for p, (s, e) in enumerate(kept)]
                origin += [k] * len(kept)
            ids = batch.column(0).take(pa.array(origin, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, *_columns(rows)], ["document_id", *FIELDS])

    def tabled(part: pa.Table) -> pa.Table:
        k, left, text = _stretch_of(part, stretch)
        exits, counts = passage(cuts_of(text, left, config, stretch), entries if k else 1, stretch)
        lists = [pa.array([x.astype(np.int32)], pa.list_(pa.int32())) for x in (exits, counts)]
        return pa.Table.from_arrays([part.column("document_id"), part.column("k"), *lists], ["document_id", "k", "exits", "counts"])

    def listed(part: pa.Table) -> pa.Table:
        k, left, text = _stretch_of(part, stretch)
        cuts, at, position = cuts_of(text, left, config, stretch), part.column("entry")[0].as_py(), part.column("base")[0].as_py()
        rows: list[tuple] = []
        while at < len(cuts.ends):
            end = int(cuts.ends[at])
            if cuts.shown[at]:
                rows.append((position + len(rows), k * stretch + at, k * stretch + end, text[at:end]))
            at = int(cuts.nexts[at])
        ids = part.column("document_id").take(pa.array([0] * len(rows), pa.int64()))
        return pa.Table.from_arrays([ids, *_columns(rows)], ["document_id", *FIELDS])

    schema = f"document_id {kind}, position long, start long, end long, content string"
    near = texts.where(F.col("n") <= stretch).select("document_id", "text").mapInArrow(short, schema)
    # the join asks for keys that are not null: said here, so that both readers share one shuffle; a given number of partitions is
    # not joined again, as texts that compress well are small there and yet long to cut
    tasks = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = _dealt(texts.where((F.col("n") > stretch) & F.col("document_id").isNotNull()), stretch, config.max_length).where("k is not null").repartition(tasks, "document_id", "k")
    tables = parts.groupBy("document_id", "k").applyInArrow(tabled, f"document_id {kind}, k int, exits array<int>, counts array<int>")
    return near.unionByName(parts.join(_entries(tables), ["document_id", "k"]).groupBy("document_id", "k").applyInArrow(listed, schema))


def _stretch_of(part: pa.Table, stretch: int) -> tuple[int, int, str]:
    """Number, code points up to the document's end, and text of a group's only row."""
    k = part.column("k")[0].as_py()
    return k, part.column("n")[0].as_py() - k * stretch, part.column("text")[0].as_py()


def _columns(rows: list[tuple]) -> list[pa.Array]:
    fields = zip(*rows, strict=True) if rows else ((), (), (), ())
    return [pa.array(list(x), t) for x, t in zip(fields, (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)]


def _entries(tables: DataFrame) -> DataFrame:
    """document_id, k, entry, base: where the first cut of each stretch starts, and how many segments come before it."""
    ordered = F.array_sort(F.collect_list(F.struct("k", "exits", "counts")))
    start = F.struct(F.lit(0).alias("entry"), F.lit(0).cast("long").alias("base"), F.array().cast("array<struct<k:int,entry:int,base:bigint>>").alias("seen"))

    def pass_on(so_far, x):
        seen = F.array_append(so_far["seen"], F.struct(x["k"].alias("k"), so_far["entry"].alias("entry"), so_far["base"].alias("base")))
        entry, base = F.get(x["exits"], so_far["entry"]), so_far["base"] + F.get(x["counts"], so_far["entry"])
        return F.when(so_far["entry"] < 0, so_far).otherwise(F.struct(entry.alias("entry"), base.alias("base"), seen.alias("seen")))

    walked = tables.groupBy("document_id").agg(F.aggregate(ordered, start, pass_on).alias("walk"))
    return walked.select("document_id", F.inline("walk.seen"))
