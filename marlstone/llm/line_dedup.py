"""Line dedup by site-relative frequency.

A line's ratio is the number of pages of a host that contain it, divided by the host's
pages. Lines above the boilerplate ratio, on enough pages, are dropped from that host's
pages. One shuffle counts (host, line digest), combined on the map side. The list of a
host is bounded by its mean number of lines a page divided by the ratio, whatever the number of
pages. All lists are broadcast where their total size allows; else the hosts with more than
1 / HOT_HOSTS of all pages (less than HOT_HOSTS) are, and only the pages of others, none of
them large, are shuffled to their lists.

Defined cases: null text is dropped from counts and stays null; a null host is a host of
its own; blank lines are never boilerplate; a page whose every line is boilerplate is left
with an empty text, which n_lines_dropped shows (keep_whole, off unless asked for, lets pages of
boilerplate and blank lines alone keep their text); pages of hosts without boilerplate keep theirs. Repeated rows count as pages of their own. An
empty table gives an empty result; texts are used whole, however long; other columns are kept, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, let, materialize

#: Digests (16 bytes each) in all lists up to which all are broadcast.
BROADCAST_DIGESTS = 1_000_000
HOT_HOSTS = 1_000


def _digest(line: Column) -> Column:
    """128 bits of a trimmed line."""
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit(7), line).alias("b"))


def _trimmed(line: Column) -> Column:
    return F.btrim(line, F.lit(" \t\n\x0b\x0c\r"))


def _host(host_col: str) -> Column:
    return F.coalesce(F.col(host_col).cast("string"), F.lit("\0"))


def boilerplate(docs: DataFrame, host_col: str = "source", text_col: str = "text", ratio: float = 0.08, min_pages: int = 5) -> DataFrame:
    """host, pages, bad (array of boilerplate line digests, maybe empty) of every host."""
    pages = docs.where(F.col(text_col).isNotNull()).select(_host(host_col).alias("host"), F.col(text_col).alias("t"))
    lines = pages.select("host", F.explode(F.array_distinct(F.filter(F.transform(F.split("t", "\n"), _trimmed), lambda x: x != ""))).alias("line"))
    counted = lines.select("host", _digest(F.col("line")).alias("d")).groupBy("host", "d").agg(F.count("*").alias("n"))
    totals = materialize(pages.groupBy("host").agg(F.count("*").alias("pages")), "host-pages")
    # count first: lines on fewer than min_pages pages never reach the join
    frequent = counted.where(F.col("n") >= min_pages).join(totals, "host").where(F.col("n") > ratio * F.col("pages"))
    return totals.join(frequent.groupBy("host").agg(F.collect_list("d").alias("bad")), "host", "left")


def _with_lists(docs: DataFrame, hosts: DataFrame, host: str, at: str) -> DataFrame:
    """docs plus its host's list as column at (null where there is none)."""
    lists = hosts.select(F.col("host").alias(host), F.col("bad").alias(at)).where(F.col(at).isNotNull())
    size = lists.agg(F.coalesce(F.sum(F.size(at)), F.lit(0))).first()[0]
    if size <= BROADCAST_DIGESTS:
        return docs.join(F.broadcast(lists), host, "left")
    total = hosts.agg(F.sum("pages")).first()[0]
    hot = hosts.where(F.col("pages") * HOT_HOSTS > total).select(F.col("host").alias(host), F.coalesce("bad", F.array().cast(hosts.schema["bad"].dataType)).alias("hot"))
    mark = fresh("hot", docs)
    marked = docs.join(F.broadcast(hot.withColumnRenamed("hot", mark)), host, "left")
    # pages of large hosts have their list; they are dealt evenly under keys that no host has
    key = fresh("key", marked)
    keyed = marked.withColumn(key, F.when(F.col(mark).isNull(), F.col(host)).otherwise(F.concat(F.lit("\0hot"), F.pmod(F.monotonically_increasing_id(), F.lit(HOT_HOSTS)))))
    joined = keyed.join(lists.withColumnRenamed(host, key), key, "left")
    return joined.withColumn(at, F.coalesce(at, mark)).drop(key, mark)


def drop_boilerplate(docs: DataFrame, host_col: str = "source", text_col: str = "text", ratio: float = 0.08, min_pages: int = 5, keep_whole: bool = False) -> DataFrame:
    """docs with boilerplate lines removed from text, plus n_lines_dropped (replaced if present)."""
    columns = [c for c in docs.columns if c != "n_lines_dropped"]
    hosts = materialize(boilerplate(docs, host_col, text_col, ratio, min_pages), "host-lines")
    host, at, done = fresh("host", docs), fresh("bad", docs), fresh("cleaned", docs)
    joined = _with_lists(docs.select(*columns, _host(host_col).alias(host)), hosts, host, at)

    def cleaned(lines: Column) -> Column:
        kept = F.filter(lines, lambda x: ~F.array_contains(F.col(at), _digest(_trimmed(x))))
        alive = lambda k: F.exists(k, lambda x: _trimmed(x) != "") if keep_whole else F.lit(True)
        return let(kept, lambda k: F.when(alive(k), F.struct(F.array_join(k, "\n").alias("t"), (F.size(lines) - F.size(k)).cast("long").alias("n"))))

    work = F.when(F.col(at).isNotNull() & F.col(text_col).isNotNull(), let(F.split(text_col, "\n"), cleaned))
    out = joined.withColumn(done, work)
    new = {text_col: F.coalesce(F.col(f"{done}.t"), F.col(text_col)).alias(text_col)}
    return out.select(*[new.get(c, F.col(c)) for c in columns], F.coalesce(F.col(f"{done}.n"), F.lit(0).cast("long")).alias("n_lines_dropped"))
