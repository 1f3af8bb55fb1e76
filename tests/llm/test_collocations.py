import random
import re
from collections import Counter, defaultdict

import pytest
from marlstone.llm import collocations as c

SCHEMA = "doc_id long, text string, lang string"


def brute(rows, least, per_lang=2000, contained=80):
    counts, totals = defaultdict(Counter), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        lowered = "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", lowered):
            w = re.findall("[^\x20\t]+", piece)
            totals[lang] += len(w)
            for m in range(1, 5):
                counts[lang].update(tuple(w[i : i + m]) for i in range(len(w) - m + 1))
    out = []
    for lang, f in counts.items():
        often = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        longer = Counter()
        for p, a in often.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    longer[p[i : i + m]] = max(longer[p[i : i + m]], a)
        found = []
        for p, a in often.items():
            if p in longer and 100 * longer[p] >= contained * a:
                continue
            score, k = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:per_lang], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, totals[lang], -score))
    return sorted(out)


def texts(seed, n):
    rng = random.Random(seed)
    words = ["the", "of", "The", "über", "naïve", "x\x1cy", "a b", "ﬁn", "日本", "𝄞", "of"]
    ends = [" ", " ", " ", "\t", "  ", ". ", ",", "\n", "\r\n", "\x0b", " ; "]
    return [(k, "".join(rng.choice(words) + rng.choice(ends) for _ in range(rng.randint(0, 60))), rng.choice(["en", "en", "de", None, ""])) for k in range(n)]


@pytest.mark.parametrize("hot", [2, 50_000])
def test_equals_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(c, "HOT_WINDOWS", hot)
    rows = [*texts(1, 120), (500, None, "en"), (501, "", "fr"), (502, "and and and and " * 40, "en"), (502, "and and and and " * 40, "en"), (None, "Tie one two. tie one two " * 12, None)]
    for least, per_lang in ((5, 2000), (12, 7)):
        got = c.collocations(spark.createDataFrame(rows, SCHEMA).repartition(3), least, per_lang)
        assert sorted(map(tuple, got.collect())) == brute(rows, least, per_lang)


def test_long_text_clashing_columns_and_empty_table(spark):
    rows = [(1, "alpha beta gamma delta epsilon. " * 60_000, "en")]
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS phrase", "2 AS n", "3 AS prefix", "4 AS rank", "5 AS a")
    assert sorted(map(tuple, c.collocations(docs).collect())) == brute(rows, 30)
    assert c.collocations(docs.limit(0)).count() == 0


def test_products_beyond_64_bits(spark, monkeypatch):
    big = 6 * 10**15
    words = spark.createDataFrame([("en", "a", big), ("en", "b", big + 1), ("en", "c", big)], "lang string, phrase string, n long")
    phrases = spark.createDataFrame([("en", "a b", big - 1), ("en", "a b c", big - 2)], "lang string, phrase string, n long")
    monkeypatch.setattr(c, "frequent_phrases", lambda *_: (words, phrases.unionByName(spark.createDataFrame([("en", "b c", big)], phrases.schema))))
    got = {r.phrase: (r.a, r.l, r.r, r.score) for r in c.collocations(words, contained=200).collect()}
    assert got["a b"] == (big - 1, big, big + 1, 2_000_000 * (big - 1) // (2 * big + 1))
    assert got["a b c"] == (big - 2, big, big, 2_000_000 * (big - 2) // (2 * big))


def test_growth_is_depth_first_and_stops_below_the_support():
    rows = [(["a", "b", "c", "d"], 3), (["a", "b", "c", "e"], 2), (["a", "b", "x"], 1), (["a", "b"], 9)]
    assert list(c.grow(rows, 2, 2)) == [("a b c", 5), ("a b c d", 3), ("a b c e", 2)]
