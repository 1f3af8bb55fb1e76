"""Words of CJK runs, which have no spaces, by a dictionary counted from a corpus and a word graph.

`dictionary` counts every run's character n-grams in Spark. An n-gram is a word where it holds together and is free at both ends: its
least cohesion over all cuts, n * N / (f(left) * f(right)), and its least branching entropy of neighbouring characters
(a run's end is a neighbour too) reach their bounds. Single characters are words always.

`dictionary_cutter` makes such a dictionary, or any table of (word, n), the cutter that the keyword functions take. A run becomes
a graph: an edge for each dictionary word that starts at a position, found along a trie of prefixes, and for each single
character. The path of the largest product of word probabilities is found from the end backwards; of equal paths the one with the longer
first word is taken. The cutter joins back to its run exactly.
"""

from __future__ import annotations

from collections.abc import Callable
from math import log

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import CJK
from ..shipping import ship_package

LONGEST = 4
#: Words of a dictionary that the cutter takes, by count: some 50 MB in each task. A documented bound of the model, not of the texts.
MOST_WORDS = 500_000
#: Stand for the ends of a run among the neighbours.
_HEAD, _TAIL = "^", "$"


def gram_counts(texts: DataFrame, text_col: str = "text", longest: int = LONGEST) -> DataFrame:
    """gram, before, after, n: n-grams of 1 to longest characters of all CJK runs, with their neighbours."""
    runs = texts.select(F.explode(F.regexp_extract_all(F.col(text_col), F.lit(f"[{CJK}]+"), F.lit(0))).alias("run"))
    padded = runs.select(F.concat(F.lit(_HEAD), F.col("run"), F.lit(_TAIL)).alias("p"))
    placed = padded.select("p", F.explode(F.sequence(F.lit(2), F.length("p") - 1)).alias("i"))
    sized = placed.select("p", "i", F.explode(F.sequence(F.lit(1), F.least(F.lit(longest), F.length("p") - F.col("i")))).alias("k"))
    cut = lambda a, b: F.substring("p", a, b)
    return sized.select(cut(F.col("i"), F.col("k")).alias("gram"), cut(F.col("i") - 1, F.lit(1)).alias("before"), cut(F.col("i") + F.col("k"), F.lit(1)).alias("after")).groupBy("gram", "before", "after").agg(F.count("*").alias("n"))


def dictionary(texts: DataFrame, text_col: str = "text", least: int = 5, cohesion: float = 20.0, entropy: float = 0.5, longest: int = LONGEST) -> DataFrame:
    """word, n, cohesion, entropy (null for single characters) of the words that the texts of text_col show."""
    from ..streaming.ingest import shared_folder

    spark, path = texts.sparkSession, shared_folder(texts.sparkSession, "cjk-grams")
    gram_counts(texts, text_col, longest).write.parquet(path)
    grams = spark.read.parquet(path)
    counts = grams.groupBy("gram").agg(F.sum("n").alias("n"))
    total = counts.where(F.length("gram") == 1).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))

    def branching(side: str) -> DataFrame:
        near = grams.groupBy("gram", side).agg(F.sum("n").cast("double").alias("m"))
        return near.groupBy("gram").agg((F.log(F.sum("m")) - F.sum(F.col("m") * F.log("m")) / F.sum("m")).alias(f"{side}_entropy"))

    likely = counts.where((F.length("gram") > 1) & (F.col("n") >= least))
    cuts = likely.select("gram", "n", F.explode(F.sequence(F.lit(1), F.length("gram") - 1)).alias("k"))
    cuts = cuts.select("gram", "n", F.expr("substring(gram, 1, k)").alias("a"), F.expr("substring(gram, k + 1)").alias("b"))
    part = lambda name: counts.select(F.col("gram").alias(name), F.col("n").cast("double").alias(f"n_{name}"))
    joined = cuts.join(part("a"), "a").join(part("b"), "b").join(F.broadcast(total), F.lit(True))
    held = joined.groupBy("gram", "n").agg(F.min(F.col("n") * F.col("total") / (F.col("n_a") * F.col("n_b"))).alias("cohesion"))
    free = held.where(F.col("cohesion") >= cohesion).join(branching("before"), "gram").join(branching("after"), "gram")
    words = free.select("gram", "n", "cohesion", F.least("before_entropy", "after_entropy").alias("entropy")).where(F.col("entropy") >= entropy)
    none = F.lit(None).cast("double")
    return words.unionByName(counts.where(F.length("gram") == 1).select("gram", "n", none.alias("cohesion"), none.alias("entropy"))).withColumnRenamed("gram", "word")


class WordGraph:
    """Cuts runs by the best path through the dictionary words in them."""

    def __init__(self, words: dict[str, int]) -> None:
        total = log(max(1, sum(words.values())))
        self.unknown = -total
        #: log probability of each word; prefixes of words that are none themselves have null: a trie by its keys.
        self.trie: dict[str, float | None] = {}
        for word, n in words.items():
            for k in range(1, len(word)):
                self.trie.setdefault(word[:k], None)
            self.trie[word] = log(n) - total

    def edges(self, run: str, i: int) -> list[tuple[int, float]]:
        """End and weight of every word that starts at i."""
        found, j = [], i + 1
        while j <= len(run) and run[i:j] in self.trie:
            weight = self.trie[run[i:j]]
            if weight is not None:
                found.append((j, weight))
            j += 1
        if not found or found[0][0] > i + 1:
            found.insert(0, (i + 1, self.unknown))
        return found

    def __call__(self, run: str) -> list[str]:
        best, onward = [0.0] * (len(run) + 1), [0] * len(run)
        for i in range(len(run) - 1, -1, -1):
            best[i], onward[i] = max((weight + best[j], j) for j, weight in self.edges(run, i))
        words, i = [], 0
        while i < len(run):
            words.append(run[i : onward[i]])
            i = onward[i]
        return words


def dictionary_cutter(words: DataFrame, most: int = MOST_WORDS) -> Callable[[], WordGraph]:
    """A function that opens the cutter in a task, for `ranked_terms` and `cut_cjk`; words: word, n. The most frequent `most` are taken."""
    ship_package(words.sparkSession)
    kept = {r["word"]: r["n"] for r in words.select("word", "n").orderBy(F.desc("n"), "word").limit(most).collect()}
    # the graph itself is shared: a worker holds one trie, not a dictionary and a trie for each task
    shared = words.sparkSession.sparkContext.broadcast(WordGraph(kept))
    return lambda: shared.value
