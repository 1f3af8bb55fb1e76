import itertools
import random
from math import log

import pytest
from marlstone.operators import cjk_words as C
from marlstone.operators import keywords as K
from pyspark.sql import functions as F

WORDS = ["订单", "客户", "发票", "华东", "发货", "属于", "需要", "仓库", "计算机", "人工智能", "已", "的"]
ALPHABET = "甲乙丙丁戊"


def brute(words, run):
    """The best of all cuts; of equal ones that with the longer first words."""
    total = log(max(1, sum(words.values())))
    cuts = []
    for marks in itertools.product((0, 1), repeat=max(0, len(run) - 1)):
        parts, at = [], 0
        for k, m in enumerate(marks, 1):
            if m:
                parts.append(run[at:k])
                at = k
        parts.append(run[at:])
        if all(p in words or len(p) == 1 for p in parts):
            cuts.append((sum(log(words[p]) - total if p in words else -total for p in parts), parts))
    best = max(s for s, _ in cuts)
    return max(([len(p) for p in parts], parts) for s, parts in cuts if s > best - 1e-9)[1]


def test_best_path_equals_all_cuts():
    rng = random.Random(2)
    words = {"".join(rng.choice(ALPHABET) for _ in range(rng.randint(1, 4))): rng.randint(1, 40) for _ in range(40)}
    graph = C.WordGraph(words)
    for _ in range(300):
        run = "".join(rng.choice(ALPHABET + "己") for _ in range(rng.randint(1, 9)))
        got = graph(run)
        score = lambda parts: sum(log(words[p]) if p in words else 0 for p in parts) - len(parts) * log(sum(words.values()))
        assert "".join(got) == run and score(got) == pytest.approx(score(brute(words, run)))
    assert graph("") == []


@pytest.fixture(scope="module")
def learnt(spark):
    rng = random.Random(9)
    rows = [("".join(rng.choice(WORDS) for _ in range(rng.randint(3, 9))) + rng.choice(["。", " A001 ", ""]),) for _ in range(1500)]
    return C.dictionary(spark.createDataFrame([*rows, (None,), ("",), ("latin only",)], "text string"), cohesion=6.0).cache()


def test_a_corpus_shows_its_words(learnt):
    found = {r.word for r in learnt.where(F.length("word") > 1).collect()}
    assert {w for w in WORDS if len(w) > 1} <= found
    assert not found & {"单客", "智能", "工智", "人工", "计算"}  # parts and seams of words


def test_keywords_of_runs_are_words(spark, learnt):
    cutter = C.dictionary_cutter(learnt)

    def terms(text, limit):
        return spark.createDataFrame([(text,)], "t string").select(K.ranked_terms(F.col("t"), limit, cutter).alias("k")).first()["k"]

    assert terms("订单 A001 已发货。订单 A001 属于华东客户，客户需要发票。", 5)[:3] == ["A001", "客户", "订单"]
    assert terms("订单A001 beta beta beta beta", 3) == ["beta", "A001", "订单"]
    assert terms("订单", 15) == ["订单"] and terms("订单 客户", 2) == ["客户", "订单"]
    assert terms("\U00020000A001 beta beta beta beta", 3) == ["beta", "A001", "\U00020000"]


def test_empty_corpus_and_bounded_dictionary(spark, learnt):
    none = spark.createDataFrame([], "text string")
    assert C.dictionary(none).count() == 0 and C.dictionary_cutter(C.dictionary(none))()("订单") == ["订", "单"]
    few = C.dictionary_cutter(learnt, 3)()
    assert sum(v is not None for v in few.trie.values()) == 3
