import random
import re
import zlib
from collections import Counter

import numpy as np
from marlstone.llm import spelling as s

SCHEMA = "doc_id long, text string"


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) == len(short) + 1 and any(long[:k] + long[k + 1 :] == short for k in range(len(long)))


def brute(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    counts = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    close = {w: [x for x in counts if near(w, x)] for w in counts}
    forms = {}
    for w, others in close.items():
        best = min(others, key=lambda x: (-counts[x], x), default=None)
        if best is not None and counts[best] >= 2 * counts[w]:
            forms[w] = best

    def root(w):
        return root(forms[w]) if w in forms else w

    return sorted(((w, forms.get(w), root(w), n, len(close[w]), counts.get(forms.get(w))) for w, n in counts.items()), key=repr)


def rows_of(seed, n):
    rng = random.Random(seed)
    stems = ["letter", "lettre", "läufer", "strasse", "straße", "maison", "Maisons", "aaaaa", "aaaaaa", "×÷×÷×", "çàéèù", "word"]

    def bent(w):
        k, x = rng.randrange(len(w)), rng.choice("abéÿz")
        return rng.choice([w, w, w, w[:k] + w[k + 1 :], w[:k] + x + w[k:], w[:k] + x + w[k + 1 :]])

    return [(k, " ".join(bent(rng.choice(stems)) + rng.choice(["", ".", "1", "日"]) for _ in range(rng.randint(1, 80)))) for k in range(n)]


def got(spark, rows):
    return sorted(map(tuple, s.spelling_variants(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()), key=repr)


def test_equals_brute_force(spark):
    rows = [*rows_of(3, 300), (900, None), (901, ""), (902, "tiees tieed " * 4), (902, "tiees tieed " * 4), (None, "nameless " * 5 + "namelesz " * 11 + "nameless1")]
    # a chain of forms
    rows += [(1000 + k, " ".join(["abcdefgh"] * 64 + ["abcdefg"] * 20 + ["abcdef"] * 8 + ["abcde"] * 3)) for k in range(2)]
    expected = brute(rows)
    assert got(spark, rows) == expected
    assert max(r[4] for r in expected) > 3 and any(r[1] != r[2] and r[1] for r in expected)


def test_many_rounds_and_shards_give_the_same(spark, monkeypatch):
    rows = rows_of(8, 120)
    monkeypatch.setattr(s, "ROUND_BYTES", 1)
    monkeypatch.setattr(s, "SHARD_WORDS", 40)
    assert got(spark, rows) == brute(rows)


def test_trie_and_automaton_against_all_pairs(monkeypatch):
    rng = random.Random(5)
    words = sorted({bytes(rng.choice(b"ab\xe9") for _ in range(rng.randint(1, 6))) for _ in range(400)})
    monkeypatch.setattr(s, "BLOCK_STATES", 640)
    w, number = s.neighbours(s.Trie(words, [1] * len(words)), words)
    expected = {(a, b) for a, x in enumerate(words) for b, y in enumerate(words) if near(x, y)}
    assert set(zip(w.tolist(), number.tolist(), strict=True)) == expected and len(w) == len(expected)
    assert len(s.neighbours(s.Trie([], []), words)[0]) == 0 and not np.any(s.Trie([b"abc"], [2]).ends[:3] >= 0)


def test_long_words_clashing_columns_and_empty_table(spark):
    rows = [(1, ("x" * 20_000 + " ") * 3 + ("x" * 20_001 + " ") * 6)]
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS word", "2 AS n", "3 AS form", "4 AS root")
    assert sorted(map(tuple, s.spelling_variants(docs).collect()), key=repr) == brute(rows)
    assert s.spelling_variants(docs.limit(0)).count() == 0
