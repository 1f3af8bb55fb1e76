import random
from collections import Counter, defaultdict

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from marlstone.llm import ngram_join as nj
from marlstone.llm.components import connected_components

from .conftest import words


def shingles(text):
    w = words("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute(rows):
    sets, at = {d: shingles(t) for d, t in rows}, defaultdict(list)
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for d, s in sets.items():
        for g in s:
            at[g].append(d)
    for d, s in sets.items():
        for e, o in Counter(e for g in s for e in at[g] if e < d).items():
            if 100 * o >= 75 * (len(s) + len(sets[e]) - o):
                a, b = find(d), find(e)
                root[max(a, b)] = min(a, b)
    return {d: (len(s), find(d)) for d, s in sets.items()}


def check(spark, texts, parts=3):
    rows = list(enumerate(texts))
    df = spark.createDataFrame([(d, t, 0) for d, t in rows], "doc_id long, text string, component_id int").repartition(parts)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in nj.ngram_components(df).collect()}
    assert got == brute(rows)


def corpus(seed):
    rng, out = random.Random(seed), []
    lexicon = [f"w{i}" for i in range(2000)]
    for size, copies, changes in ((30, 5, 1), (80, 60, 2), (200, 40, 6), (1200, 6, 8)):
        base = [rng.choice(lexicon) for _ in range(size)]
        for _ in range(copies):
            w = list(base)
            for _ in range(rng.randint(0, changes)):
                w[rng.randrange(size)] = rng.choice(lexicon)
            out.append(" ".join(w))
    track = [rng.choice(lexicon) for _ in range(300)]
    out += [" ".join(track[k : k + 60]) for k in range(0, 200, 4)]  # a chain of links
    passage = " ".join(rng.choice(lexicon) for _ in range(60))
    out += [passage + " " + " ".join(rng.choice(lexicon) for _ in range(rng.choice([5, 18, 19, 20, 21, 100]))) for _ in range(80)]
    out += [None, "", " \n ", "a b", "A  B", "a b c d", "a b c d e", "a b c d e", "x"]
    rng.shuffle(out)
    return out


def test_components_match_brute_force(spark):
    check(spark, corpus(3))


def test_large_buckets_and_leaders(spark, monkeypatch):
    monkeypatch.setattr(nj, "SMALL_BUCKET", 3)
    monkeypatch.setattr(nj, "CHUNK_LEAST", 2)
    check(spark, corpus(5), 2)


def test_heavily_edited_copies_in_parted_buckets(spark, monkeypatch):
    """Groups whose members link only with some others: leaders, blocks and both later rounds, at all sketch lengths."""
    monkeypatch.setattr(nj, "SMALL_BUCKET", 2)
    monkeypatch.setattr(nj, "CHUNK_LEAST", 2)
    monkeypatch.setattr(nj, "SALT_ROWS", 10)
    monkeypatch.setattr(nj, "BLOCK", 8)
    rng, texts = random.Random(21), []
    for size, copies, changes in ((60, 40, 3), (900, 50, 30), (2500, 30, 70)):
        base = [f"v{rng.randrange(5000)}" for _ in range(size)]
        for _ in range(copies):
            w = list(base)
            for _ in range(rng.randint(0, changes)):
                w[rng.randrange(size)] = f"v{rng.randrange(5000)}"
            texts.append(" ".join(w))
    check(spark, texts, 4)


def test_sketches_bound_the_difference_of_large_sets():
    import numpy as np

    rng = np.random.default_rng(4)
    for n in (100, 700, 900, 3000, 7000):
        a = np.unique(rng.integers(0, 2**64 - 1, n, np.uint64))
        b = np.unique(np.concatenate([a[n // 9 :], rng.integers(0, 2**64 - 1, n // 7, np.uint64)]))
        folded = nj._popcounts(np.fromiter([nj._sketch(a), nj._sketch(b)], object, 2))
        words = min(len(nj._sketch(a)), len(nj._sketch(b)))
        rows = folded[(words // nj.SKETCH_LEAST).bit_length() - 1].view(np.uint64)
        assert 0 < np.bitwise_count(rows[0] ^ rows[1]).sum() <= len(np.setxor1d(a, b))


def test_sizes_and_places_are_packed_apart():
    import numpy as np

    k = nj._packed(1 << 29, (1 << 30) - 1, np.array([0, (1 << 30) - 1]))
    assert nj._size(k).tolist() == [(1 << 30) - 1] * 2 and nj._place(k).tolist() == [0, (1 << 30) - 1] and (k >= 0).all()


def test_null_and_repeated_ids_are_told_apart_by_text(spark):
    t, u = " ".join(f"w{i}" for i in range(40)), " ".join(f"u{i}" for i in range(40))
    rows = [(None, t), (None, t), (5, t), (5, t), (5, u), (6, u + " x"), (None, None), (None, ""), (7, None), (7, None)]
    got = nj.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in got) == sorted([(5, t), (5, u), (0, ""), (0, ""), (7, ""), (7, "")])
    only_null = spark.createDataFrame([(None, t), (None, t + " y"), (None, t)], "doc_id long, text string")
    assert nj.drop_near_duplicates(only_null).count() == 1


def test_tiny_and_empty_tables(spark):
    check(spark, ["a b c d e f"])
    assert nj.ngram_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_one_of_each_component_stays(spark):
    t = " ".join(f"w{i}" for i in range(40))
    df = spark.createDataFrame([(5, t), (3, t + " more"), (9, "other text here"), (None, "no id"), (7, None), (8, "")], "doc_id long, text string")
    assert {r.doc_id for r in nj.drop_near_duplicates(df).collect()} == {3, 9, None, 7, 8}


def test_components_of_chains_and_hubs(spark):
    links = [(k, k + 1) for k in range(100, 140)] + [(1, k) for k in range(50, 90)] + [(7, 7), (None, 3), (2, 1), (2, 1)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {k: 100 for k in range(100, 141)} | {k: 1 for k in (1, 2, *range(50, 90))}


@settings(max_examples=200, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.sets(st.integers(0, 60), min_size=1), st.sets(st.integers(0, 60), min_size=1))
def test_bounds_lose_no_link(a, b):
    """Prefixes of linked sets share a shingle, and the position and sketch bounds hold."""
    import numpy as np

    x, y = np.array(sorted(a), np.uint64) << np.uint64(9), np.array(sorted(b), np.uint64) << np.uint64(9)
    o = len(a & b)
    if 100 * o < 75 * (len(a) + len(b) - o):
        return
    p, q = x[: len(x) - nj._need(len(x), 75) + 1], y[: len(y) - nj._need(len(y), 75) + 1]
    shared = sorted(set(p.tolist()) & set(q.tolist()))
    assert shared
    i, j = p.tolist().index(shared[0]), q.tolist().index(shared[0])
    assert nj._possible(np.int64(len(x)), np.int64(i), np.int64(len(y)), np.int64(j), 75)
    differing = sum(int(v).bit_count() for v in (nj._sketch(x) ^ nj._sketch(y)).view(np.uint64))
    assert differing <= len(a ^ b) and abs(int(nj._band(np.array([len(a)]), 75)[0] - nj._band(np.array([len(b)]), 75)[0])) <= 1
