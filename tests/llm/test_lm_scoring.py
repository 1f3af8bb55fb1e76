import math
import random
import re
import zlib
from collections import Counter

import pytest
from marlstone.llm import lm_scoring as lm
from marlstone.llm import queries
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string"


def held_column():
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(7)) == 2


def held(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 7 == 2


def tokens(text):
    lowered = "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in text or "")
    return [*re.findall("[^\x20\x09-\x0d]+", lowered), 1]


def brute(rows, order):
    """The recursive definition of the model, n-gram by n-gram."""
    grams = [Counter() for _ in range(order + 1)]
    for doc_id, text in rows:
        if not held(doc_id):
            t = [0, *tokens(text)]
            for n in range(1, order + 1):
                grams[n].update(tuple(t[i - n + 1 : i + 1]) for i in range(max(1, n - 1), len(t)))
    total, distinct = sum(grams[1].values()), len(grams[1])
    context, followers, discount = Counter(), Counter(), [0, 0]
    for n in range(2, order + 1):
        once, twice = (sum(c == k for c in grams[n].values()) for k in (1, 2))
        discount.append(once / (once + 2 * twice) if once and twice else 0.5)
        for g, c in grams[n].items():
            context[g[:-1]] += c
            followers[g[:-1]] += 1

    def p(g):
        if len(g) == 1:
            return (grams[1][g] + 1) / (total + distinct + 1)
        h, d = g[:-1], discount[len(g)]
        if not context[h]:
            return p(g[1:])
        return max(grams[len(g)][g] - d, 0) / context[h] + d * followers[h] / context[h] * p(g[1:])

    out = []
    for doc_id, text in rows:
        t = [0, *tokens(text)]
        score = sum(math.log10(p(tuple(t[max(0, i - order + 1) : i + 1]))) for i in range(1, len(t)))
        base = sum(math.log10(p((w,))) for w in t[1:])
        out.append((doc_id, held(doc_id), len(t) - 1, sum(grams[1][(w,)] > 0 for w in t[1:]), total, base, score))
    return out


def same(got, expected):
    got, expected = (sorted(map(tuple, x), key=lambda r: (repr(r[:5]), r[6])) for x in (got, expected))
    assert [r[:5] for r in got] == [r[:5] for r in expected]
    for a, b in zip(got, expected, strict=True):
        assert a[5] == pytest.approx(b[5], abs=1e-7) and a[6] == pytest.approx(b[6], abs=1e-7)


def rows_of(seed, n):
    rng = random.Random(seed)
    words = ["The", "cat", "sat", "on", "a", "mat", "über", "x\x1cy", "日本", "dog"]
    rows = []
    for k in range(n):
        w = [rng.choice(words)]
        for _ in range(rng.randint(0, 40)):
            w.append(words[(words.index(w[-1]) + rng.choice([1, 1, 1, 2, 5])) % len(words)])
        rows.append((k, rng.choice([" ", "\n", "\t "]).join(w) + (f" rare{k}" if k % 5 == 0 else "")))
    return rows


@pytest.mark.parametrize("order", [1, 2, 3])
def test_equals_the_recursive_definition(spark, order):
    rows = [*rows_of(2, 90), (500, None), (501, ""), (7, "The cat sat"), (7, "The cat sat"), (None, "nameless cat"), (2, "unseen words alone")]
    got = lm.score_documents(spark.createDataFrame(rows, SCHEMA).repartition(4), held_column(), order).collect()
    same(got, brute(rows, order))
    assert any(r.held_out for r in got) and not all(r.held_out for r in got)


def test_held_out_texts_gain_from_context(spark):
    got = lm.score_documents(spark.createDataFrame(rows_of(4, 400), SCHEMA).repartition(3), held_column()).where("held_out")
    base, score, n = got.agg(F.sum("base_score"), F.sum("score"), F.sum("n_tokens")).first()
    assert (score - base) / n > 0.15


def test_without_training_documents_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "")], SCHEMA).selectExpr("*", "1 AS chunk", "2 AS held", "3 AS keys", "4 AS score")
    assert sorted(map(tuple, lm.score_documents(docs, F.lit(True)).collect())) == [(1, True, 3, 0, 0, 0.0, 0.0), (2, True, 1, 0, 0, 0.0, 0.0)]
    assert lm.score_documents(docs.limit(0), held_column()).count() == 0


def test_very_long_text_and_the_query_s_folds(spark, tmp_path):
    rows = [(k, "alpha beta " * (300_000 if k == 3 else 5)) for k in range(20)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    same(queries.op13_lm_scoring(spark, str(tmp_path)).collect(), brute(rows, 2))
