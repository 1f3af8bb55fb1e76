import itertools
import math
import random

from marlstone.llm import decontaminate as d


def test_finds_substituted_copies_and_leaves_others(spark, prose):
    items = [(i, prose(1000 + i, 15 + 3 * i)) for i in range(10)] + [(90, "too short"), (91, None), (92, "")]
    rows, planted, rng = [], set(), random.Random(4)
    for k in range(40):
        text = prose(k, 60)
        if k % 2:
            item = items[k % 10]
            w = item[1].split()
            if k % 4 == 3:
                w[rng.randrange(len(w))] = "OTHER"
            text = text + " " + " ".join(w).upper().replace(" ", ", ") + ". " + prose(k + 200, 30)
            planted.add((k, item[0]))
        rows.append((k, text))
    rows += [(100, None), (101, ""), (102, items[3][1]), (102, items[3][1]), (103, " ".join(items[4][1].split()[: len(items[4][1].split()) // 2]))]
    planted.add((102, 3))
    got = d.find_leaks(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert [(r.doc_id, r.item_id) for r in got.orderBy("doc_id", "item_id").collect()] == sorted(planted)
    assert got.where("matched_words < item_words").count() >= 5


def test_copies_cut_by_the_end_of_the_text(spark, prose):
    w = prose(7, 40).split()
    docs = spark.createDataFrame([(1, " ".join(w[4:]) + " tail of it"), (2, " ".join(w[:36])), (3, " ".join(w[20:]))], "doc_id long, text string")
    got = d.find_leaks(docs, spark.createDataFrame([(1, " ".join(w))], "item_id long, text string"))
    assert sorted((r.doc_id, r.matched_words, r.doc_offset) for r in got.collect()) == [(1, 36, -4), (2, 36, 0)]


def test_drop_and_empty_tables(spark, prose):
    docs = spark.createDataFrame([(1, prose(1, 20)), (2, prose(2, 20)), (None, prose(3, 20))], "doc_id long, text string")
    items = spark.createDataFrame([(5, prose(2, 20))], "item_id long, text string")
    assert {r.doc_id for r in d.drop_leaks(docs, items).collect()} == {1, None}
    assert d.drop_leaks(docs, items.limit(0)).count() == 3 and d.find_leaks(docs.limit(0), items).count() == 0


def test_shuffle_join_gives_the_same(spark, prose, monkeypatch):
    docs, items = spark.createDataFrame([(1, prose(2, 50)), (2, prose(3, 50))], "doc_id long, text string"), spark.createDataFrame([(5, " ".join(prose(2, 50).split()[10:40]))], "item_id long, text string")
    monkeypatch.setattr(d, "BROADCAST_ROWS", 0)
    assert [(r.doc_id, r.item_id, r.doc_offset) for r in d.find_leaks(docs, items).collect()] == [(1, 5, 10)]


def test_recall_is_whole_at_every_item_length(spark, prose):
    rng, items, rows, planted = random.Random(12), {n: prose(5000 + n, n).split() for n in range(1, 46)}, [], {}
    for n, item in items.items():
        for trial in range(4):
            w, allowed = list(item), n - math.ceil(0.8 * n)
            spots = [(k + 1) * n // (allowed + 1) for k in range(allowed)] if trial == 0 else rng.sample(range(n), allowed)
            for p in spots:
                w[p] = "OTHER"
            planted[len(rows)] = n
            rows.append((len(rows), f"{prose(9000 + len(rows), 12)} {' '.join(w)} {prose(7000 + len(rows), 12)}"))
    expected = set()
    for k, text in rows:
        t = text.split()
        for n, item in items.items():
            best = max(sum(t[o + p] == item[p] for p in range(max(0, -o), min(n, len(t) - o))) for o in range(1 - n, len(t)))
            if best >= math.ceil(0.8 * n):
                expected.add((k, n, best))
    found = d.find_leaks(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(n, " ".join(w)) for n, w in items.items()], "item_id long, text string"))
    got = {(r.doc_id, r.item_id, r.matched_words) for r in found.collect()}
    pairs = {g[:2] for g in got}
    recall = {n: sum((k, n) in pairs for k in planted if planted[k] == n) / 4 for n in items}
    assert recall == dict.fromkeys(items, 1.0)
    assert got == expected


def test_seeds_follow_the_threshold(spark, prose):
    item = prose(31, 12).split()
    docs = spark.createDataFrame([(1, " ".join(w if k % 2 else "OTHER" for k, w in enumerate(item))), (2, " ".join(item))], "doc_id long, text string")
    bench = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    found = {m: sorted(r.doc_id for r in d.find_leaks(docs, bench, m).collect()) for m in (0.5, 1.0)}
    assert found == {0.5: [1, 2], 1.0: [2]}


def test_ids_that_repeat_with_other_texts(spark, prose, monkeypatch):
    item = prose(77, 30)
    rows = [(7, f"{item} tail"), (7, " ".join(item.split()[:12])), (None, f"x {item}"), (None, prose(3, 40)), (8, None), (None, None)]
    bench = spark.createDataFrame([(5, item), (5, prose(6, 20)), (None, prose(9, 20)), (6, "")], "item_id long, text string")
    for bound in (d.BROADCAST_ROWS, 0):
        monkeypatch.setattr(d, "BROADCAST_ROWS", bound)
        for order in (1, -1):
            docs = spark.createDataFrame(rows[::order], "doc_id long, text string").repartition(2)
            found = {(r.doc_id, r.item_id, r.matched_words, r.doc_offset) for r in d.find_leaks(docs, bench).collect()}
            assert found == {(7, 5, 30, 0), (None, 5, 30, 1)}
            kept = [(r.doc_id, r.text) for r in d.drop_leaks(docs, bench).collect()]
            assert sorted(kept, key=repr) == sorted([(7, " ".join(item.split()[:12])), (None, rows[3][1]), (8, None), (None, None)], key=repr)


def test_very_long_text_and_clashing_columns(spark, prose):
    item = prose(5, 25)
    long = f"{prose(1, 60_000)} {item} {prose(2, 60_000)}"
    docs = spark.createDataFrame([(1, long, 0, 0, 0)], "doc_id long, text string, h int, key int, item_id int")
    bench = spark.createDataFrame([(9, item, 1)], "item_id long, text string, doc_id int")
    assert [(r.doc_id, r.item_id, r.doc_offset) for r in d.find_leaks(docs, bench).collect()] == [(1, 9, 60_000)]
    assert d.drop_leaks(docs, bench).count() == 0


def test_masks_cover_every_set_of_substitutions():
    """Exhaustively for short items, by random and adversarial sets for longer ones."""
    rng = random.Random(6)
    for min_match in (0.5, 0.8, 0.9, 1.0):
        for n in range(1, 60):
            lost, placed = n - d.needed(n, min_match), d.masks(n, min_match)
            spots = [frozenset(j + p for p in offsets) for offsets, count in placed for j in range(count)]
            assert all(max(s) < n and min(s) >= 0 for s in spots)
            if math.comb(n, lost) <= 20_000:
                sets = itertools.combinations(range(n), lost)
            else:
                step = lost + 1
                sets = [rng.sample(range(n), lost) for _ in range(500)] + [[(k * step + r) % n for k in range(lost)] for r in range(step)] + [list(range(r, r + lost)) for r in range(n - lost + 1)]
            assert all(any(s.isdisjoint(gone) for s in spots) for gone in map(frozenset, sets)), (n, min_match)


def test_masks_ignore_positions_and_lengths_share_them():
    for n in range(5, 60):
        for offsets, _ in d.masks(n, 0.8):
            assert offsets[0] == 0 and max(offsets) >= len(offsets), "a position between the first and the last is ignored"
    assert len({o for n in range(1, 60) for o, _ in d.masks(n, 0.8)}) < 30
    assert [len(d.masks(n, 0.8)[0][0]) for n in (10, 15, 20, 40)] == [4, 6, 6, 4]
