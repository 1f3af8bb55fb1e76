"""Quality rules with risk-controlled thresholds (DataFrame functions only).

Every document gets base measures and three rule scores (symbols a word, share of
repeated lines, share of repeated words among all words). A cutoff for each (stratum,
rule) is learnt on labelled holdouts: walking from the most lenient cutoff to stricter
ones, a cutoff is certified while the exact (Clopper-Pearson) upper bound of its false
rejection rate stays within the stratum's risk budget. The walk stops at the first
failure (fixed-sequence testing), so no correction is needed along it; the error level is
divided by the number of (stratum, rule) walks (Bonferroni). Among certified cutoffs the
one with the best trade of bad against good rejections is used; with none, the rule is off.

Defined cases: null or empty text has no words and fails the base rule; a null stratum is
the stratum ''; null or missing labels take no part; several labels of one document count
once (the lowest); with no labels every learnt rule is off; empty tables give empty results; other columns are
kept, whatever their names. Texts are used whole, however long.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, fresh, let, words_of

#: Fixed values of the base measures.
SYMBOLS = "#*$%&|<>"
WINDOW = 5

#: rule -> cutoffs from lenient to strict; a document is rejected above the cutoff.
GRIDS = {
    "symbol_ratio": [3.0, 2.5, 2.0, 1.5, 1.0, 0.8, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1, 0.05],
    "dup_line_ratio": [0.95, 0.9, 0.85, 0.8, 0.75, 0.7, 0.65, 0.6, 0.55, 0.5, 0.45, 0.4, 0.35, 0.3],
    "same_word_ratio": [0.98, 0.95, 0.9, 0.85, 0.8, 0.75, 0.7, 0.65, 0.6, 0.55, 0.5],
}


@dataclass(frozen=True)
class Cutoff:
    stratum: str
    rule: str
    cutoff: float
    holdout: int
    false_rejections: int
    bound: float


def _covered_words(hashed: Column) -> Column:
    """Words (given as hashes) inside 5-word windows that occur twice or more, the first included."""

    def windows(h: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(h) - WINDOW)
        return F.transform(starts, lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)]))

    def repeated(marks: Column) -> Column:
        ordered = F.sort_array(F.transform(marks, lambda m, i: F.struct(m.alias("h"), i.alias("i"))))
        twin = lambda s, k, x: F.coalesce(F.get(s, k)["h"] == x["h"], F.lit(False))
        starts = let(ordered, lambda s: F.transform(s, lambda x, k: F.when(twin(s, k - 1, x) | twin(s, k + 1, x), x["i"])))
        starts = F.sort_array(F.array_compact(starts))
        gaps = let(starts, lambda r: F.transform(r, lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get(r, k + 1) - p, F.lit(WINDOW)))))
        return F.aggregate(gaps, F.lit(0), lambda a, b: a + b)

    def count(h: Column) -> Column:
        return F.when(
            F.size(h) >= WINDOW,
            let(windows(h), lambda m: F.when(F.size(F.array_distinct(m)) == F.size(m), F.lit(0)).otherwise(repeated(m))),
        ).otherwise(F.lit(0))

    return let(hashed, count)


def measure(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs plus n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, rule scores and base_failed.

    Columns of these names in the input are replaced.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    keep = [c for c in docs.columns if c not in {*GRIDS, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"}]

    w, li = fresh("words", docs), fresh("lines", docs)

    def gathered(words: Column) -> Column:
        of_hashes = lambda h: F.struct(F.size(F.array_distinct(h)).alias("d"), _covered_words(h).alias("r"))
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
            let(F.transform(words, lambda w: F.xxhash64(w)), of_hashes).alias("h"),
        )

    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
    line_counts = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), F.size(F.array_distinct(x)).cast("long").alias("d")))
    out = docs.select(
        *keep,
        let(words_of(text), gathered).alias(w),
        line_counts.alias(li),
        F.when(text.rlike(f"[{SYMBOLS}]"), F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).otherwise(F.lit(0)).cast("long").alias("n_symbols"),
    )
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    out = out.select(
        *keep,
        F.col(f"{w}.n_words").alias("n_words"),
        F.col(f"{w}.word_chars").alias("word_chars"),
        "n_symbols",
        (F.col(f"{li}.n") - F.col(f"{li}.d")).alias("n_dup_lines"),
        F.col(f"{w}.h.r").cast("long").alias("n_repeat_words"),
        ratio(F.col("n_symbols"), F.col(f"{w}.n_words")).alias("symbol_ratio"),
        ratio(F.col(f"{li}.n") - F.col(f"{li}.d"), F.col(f"{li}.n")).alias("dup_line_ratio"),
        ratio(F.col(f"{w}.n_words") - F.col(f"{w}.h.d"), F.col(f"{w}.n_words")).alias("same_word_ratio"),
    )
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return out.withColumn("base_failed", failed)


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X <= k) of n draws at rate p, all terms included: the incomplete beta function by its continued fraction."""
    if k >= n or p <= 0:
        return 1.0
    if k < 0 or p >= 1:
        return 0.0
    # P(X <= k) is I(1 - p; n - k, k + 1); the fraction converges fast on the near side of the mean
    a, b, x = n - k, k + 1, 1 - p
    swapped = x > (a + 1) / (a + b + 2)
    if swapped:
        a, b, x = b, a, p
    front = math.exp(math.lgamma(n + 1) - math.lgamma(a) - math.lgamma(b) + a * (math.log(x) if swapped else math.log1p(-p)) + b * (math.log1p(-p) if swapped else math.log(p))) / a
    least, value, c, d = 1e-300, 1.0, 1.0, 0.0
    for m in range(1_000_000):
        h = m // 2
        term = 1.0 if m == 0 else h * (b - h) * x / ((a + 2 * h - 1) * (a + 2 * h)) if m % 2 == 0 else -(a + h) * (a + b + h) * x / ((a + 2 * h) * (a + 2 * h + 1))
        d = 1 / ((1 + term * d) or least)
        c = 1 + term / c if m else math.inf
        c = c or least
        value = d if m == 0 else value * c * d
        if m and abs(c * d - 1) < 1e-15:
            break
    tail = front * value
    return min(1.0, max(0.0, 1 - tail if swapped else tail))


def binomial_upper(k: int, n: int, delta: float) -> float:
    """Clopper-Pearson: the rate p at which P(X <= k | n, p) = delta."""
    if n == 0 or k >= n:
        return 1.0
    low, high = k / n, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if binomial_tail(k, n, mid) > delta else (low, mid)
    return high


def calibrate(measured: DataFrame, labels: DataFrame, stratum_col: str = "lang", risk: float = 0.03, delta: float = 0.05, penalty: float = 20.0) -> list[Cutoff]:
    """Learn one cutoff for each (stratum, rule) from labelled documents that pass the base rule.

    labels: doc_id, quality (1 good, 0 bad). Only counts by stratum, rule and cutoff reach the driver.
    """
    truth = labels.where(F.col("quality").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("__quality"))
    scored = measured.where(~F.col("base_failed")).select("doc_id", F.coalesce(F.col(stratum_col).cast("string"), F.lit("")).alias("__stratum"), *GRIDS)
    good, bad = F.col("__quality") == 1, F.col("__quality") == 0
    counts = [F.count_if(good).alias("good"), F.count_if(bad).alias("bad")]
    for rule, grid in GRIDS.items():
        for k, cut in enumerate(grid):
            counts += [F.count_if(good & (F.col(rule) > cut)).alias(f"g_{rule}_{k}"), F.count_if(bad & (F.col(rule) > cut)).alias(f"b_{rule}_{k}")]
    rows = scored.join(truth, "doc_id").groupBy("__stratum").agg(*counts).orderBy("__stratum").collect()
    found, level = [], delta / max(1, len(rows) * len(GRIDS))
    for row in rows:
        for rule, grid in GRIDS.items():
            certified = []
            for k, cut in enumerate(grid):
                false, hits = row[f"g_{rule}_{k}"], row[f"b_{rule}_{k}"]
                bound = binomial_upper(false, row["good"], level)
                if bound > risk / len(GRIDS):
                    break
                gain = hits / max(1, row["bad"]) - penalty * false / max(1, row["good"])
                certified.append((gain, -k, Cutoff(row["__stratum"], rule, cut, row["good"], false, bound)))
            if certified and (best := max(certified, key=lambda x: x[:2]))[0] > 0:
                found.append(best[2])
    return found


def judge(measured: DataFrame, cutoffs: list[Cutoff], stratum_col: str = "lang") -> DataFrame:
    """measured plus kept: false where the base rule or a learnt rule of the row's stratum rejects."""
    stratum, rejected = F.coalesce(F.col(stratum_col).cast("string"), F.lit("")), F.lit(False)
    for rule in GRIDS:
        own = [c for c in cutoffs if c.rule == rule]
        if own:
            table = F.create_map(*[F.lit(x) for c in own for x in (c.stratum, c.cutoff)])
            rejected = rejected | F.coalesce(F.col(rule) > table[stratum], F.lit(False))
    return measured.withColumn("kept", ~F.col("base_failed") & ~rejected)
