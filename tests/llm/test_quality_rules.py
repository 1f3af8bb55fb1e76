import math
import random
from collections import Counter

from marlstone.llm import quality_rules as q

from .conftest import words


def brute(text):
    text = text or ""
    w = words(text)
    windows = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {p for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for p in range(i, i + 5)}
    lines = [x for x in text.split("\n") if words(x)]
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_measures_match_brute_force(spark, prose):
    a = prose(1, 40)
    texts = [None, "", " \n\t ", "a b c d", "a b c d e", "a a a a a a a a a a a", f"{a}\n{a}\n\n \n{a}", f"{a} x {a[: len(a) // 2]}", "#*$ %& | <> é中 x y z", prose(2, 5000), "line\r\nline\nline"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in q.measure(df).collect()}
    assert got == {i: brute(t) for i, t in enumerate(texts)}


def test_base_rule_limits(spark, prose):
    twenty = prose(3, 80)
    df = spark.createDataFrame([(1, "a b c d e f g h i"), (2, "a b c d e f g h i j"), (3, twenty + " " + " ".join(twenty.split()[:10]))], "doc_id long, text string")
    got = {r.doc_id: (r.base_failed, r.n_words, r.n_repeat_words) for r in q.measure(df).collect()}
    assert got == {1: (True, 9, 0), 2: (False, 10, 0), 3: (True, 90, 20)}


def test_binomial_bound():
    assert abs(q.binomial_upper(0, 100, 0.05) - (1 - 0.05 ** (1 / 100))) < 1e-9
    assert q.binomial_upper(5, 5, 0.05) == 1.0 and q.binomial_upper(0, 0, 0.05) == 1.0
    assert 0.05 < q.binomial_upper(5, 100, 0.05) < 0.12


def test_binomial_tail_sums_all_terms():
    from fractions import Fraction

    for n, k in ((1, 0), (10, 3), (50, 49), (300, 7), (400, 200)):
        for p in (Fraction(1, 100), Fraction(1, 3), Fraction(9, 10)):
            exact = sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
            assert abs(q.binomial_tail(k, n, float(p)) - float(exact)) <= 1e-9 * max(float(exact), 1e-9)
    # far beyond 2,000 rejections: within the normal approximation
    for n, k in ((1_000_000, 50_000), (50_000_000, 1_000_000)):
        rate, z = k / n, 1.6448536
        assert abs(q.binomial_upper(k, n, 0.05) - (rate + z * math.sqrt(rate * (1 - rate) / n))) < 0.02 * z * math.sqrt(rate * (1 - rate) / n) + 2 / n


def test_calibration_matches_brute_force(spark, prose):
    rng, rows, labels = random.Random(3), [], []
    for k in range(900):
        bad = rng.random() < 0.4
        odd = rng.random() < (0.8 if bad else 0.01)
        rows.append((k, ("en", "de", None)[k % 3], " ".join(w + ("%" if odd and rng.random() < 0.9 else "") for w in prose(k, 25).split())))
        labels.append((k, int(not bad)))
    m = q.measure(spark.createDataFrame(rows, "doc_id long, lang string, text string"))
    got = {(c.stratum, c.rule): c.cutoff for c in q.calibrate(m, spark.createDataFrame(labels, "doc_id long, quality int"), risk=0.2)}
    data = {}
    for r in m.collect():
        if not r.base_failed:
            data.setdefault(r.lang or "", []).append((labels[r.doc_id][1], r.asDict()))
    expected, level = {}, 0.05 / (len(data) * len(q.GRIDS))
    for stratum, own in data.items():
        for rule, grid in q.GRIDS.items():
            options, good, bad = [], [x for y, x in own if y], [x for y, x in own if not y]
            for cut in grid:
                false, hits = sum(x[rule] > cut for x in good), sum(x[rule] > cut for x in bad)
                at = 0.2 / len(q.GRIDS)  # the bound is within the budget where so few rejections are this unlikely at the budget's rate
                if sum(math.comb(len(good), i) * at**i * (1 - at) ** (len(good) - i) for i in range(false + 1)) > level:
                    break
                options.append((hits / len(bad) - 20 * false / len(good), cut))
            if options and max(options)[0] > 0:
                expected[stratum, rule] = max(options)[1]
    assert got == expected and len(got) >= 2


def test_columns_of_any_name_are_kept(spark):
    got = q.measure(spark.createDataFrame([(1, "a b", 2, 3)], "doc_id long, text string, Words int, lines int")).first()
    assert (got.doc_id, got.Words, got.lines, got.n_words) == (1, 2, 3, 2)


def test_cutoffs_bound_false_rejections(spark, prose):
    rows, labels = [], []
    for k in range(1200):
        junk = k % 4 == 0
        rows.append((k, "en", " ".join(w + ("%%%" if junk else "") for w in prose(k, 30).split())))
        labels.append((k, 0 if junk else 1))
    rows += [(5000, None, prose(1, 30)), (5001, "de", " ".join(w + "###" for w in prose(2, 30).split())), (5002, "en", None)]
    labels += [(0, 0), (7777, 1), (5000, None)]
    docs, lab = spark.createDataFrame(rows, "doc_id long, lang string, text string"), spark.createDataFrame(labels, "doc_id long, quality int")
    m = q.measure(docs)
    cutoffs = q.calibrate(m, lab)
    assert {(c.stratum, c.rule) for c in cutoffs} >= {("en", "symbol_ratio")} and all(c.bound <= 0.03 / len(q.GRIDS) for c in cutoffs)
    kept = {r.doc_id: r.kept for r in q.judge(m, cutoffs).collect()}
    assert all(kept[k] == bool(k % 4) for k in range(1200))
    assert kept[5000] and kept[5001] and not kept[5002]  # no cutoff without labels in the stratum


def test_no_labels_and_empty_table(spark):
    docs, none = spark.createDataFrame([], "doc_id long, lang string, text string, kept string, n_words int"), spark.createDataFrame([], "doc_id long, quality int")
    m = q.measure(docs)
    assert q.calibrate(m, none) == [] and q.judge(m, []).count() == 0
