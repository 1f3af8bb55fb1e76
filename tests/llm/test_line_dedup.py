from marlstone.llm import line_dedup


def test_boilerplate_by_host(spark, prose):
    rows = [(k, "a", f"{prose(k, 8)}\n  Subscribe now \n{prose(k + 500, 8)}", 1) for k in range(20)]
    rows += [(100 + k, "b", f"{prose(k, 9)}\nSubscribe now" if k < 4 else prose(k, 9), 1) for k in range(60)]
    rows += [(300, "a", "Subscribe now", 1), (301, None, "x\ny", 1), (302, "a", None, 1), (303, "a", "", 1), (304, "a", "Subscribe now\n\nSubscribe now", 1), (305, "a", "Subscribe now\nown line", 1)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, n_lines_dropped int")
    got = {r.doc_id: (r.text, r.n_lines_dropped) for r in line_dedup.drop_boilerplate(df).collect()}
    assert got[0] == (f"{prose(0, 8)}\n{prose(500, 8)}", 1)
    assert got[100] == (f"{prose(0, 9)}\nSubscribe now", 0)  # 4 of 60 pages are too few
    assert got[300] == ("", 1) and got[304] == ("", 2)  # nothing else on the page
    assert got[305] == ("own line", 1)
    assert got[301] == ("x\ny", 0) and got[302] == (None, 0) and got[303] == ("", 0)
    assert len(got) == len(rows)


def test_repeated_rows_and_empty_table(spark):
    rows = [(1, "s", "common\nrest")] * 6 + [(k, "s", f"only {k}") for k in range(2, 5)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = line_dedup.drop_boilerplate(df).collect()
    assert len(got) == 9 and sum(r.text == "" and r.n_lines_dropped == 2 for r in got) == 6
    assert line_dedup.drop_boilerplate(df.limit(0)).count() == 0


def test_split_hosts_give_the_same(spark, prose, monkeypatch):
    rows = [(k, ("big", "big", "big", None, f"s{k % 7}")[k % 5], f"{prose(k, 6)}\nFollow us\n{prose(k + 900, 5)}" if k % 2 else prose(k, 7)) for k in range(300)]
    df = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "doc_id long, source string, text string, host int, bad int, cleaned int")
    plain = sorted(map(tuple, line_dedup.drop_boilerplate(df).collect()))
    monkeypatch.setattr(line_dedup, "BROADCAST_DIGESTS", 0)
    monkeypatch.setattr(line_dedup, "HOT_HOSTS", 4)
    assert sorted(map(tuple, line_dedup.drop_boilerplate(df).collect())) == plain and sum(r[-1] for r in plain) > 100
    assert all(r[3:6] == (1, 2, 3) for r in plain)


def test_pages_of_boilerplate_alone_keep_their_text_on_request(spark):
    df = spark.createDataFrame([(k, "s", "common\nown" + str(k) if k else "common") for k in range(8)], "doc_id long, source string, text string")
    assert {(r.text, r.n_lines_dropped) for r in line_dedup.drop_boilerplate(df).where("doc_id = 0").collect()} == {("", 1)}
    assert {r.text for r in line_dedup.drop_boilerplate(df, keep_whole=True).where("doc_id = 0").collect()} == {"common"}


def test_very_long_page(spark):
    text = "\n".join(f"line {k}" for k in range(50_000))
    df = spark.createDataFrame([(k, "s", "shared\n" + (text if k == 0 else f"x{k}")) for k in range(6)], "doc_id long, source string, text string")
    assert {r.doc_id: r.n_lines_dropped for r in line_dedup.drop_boilerplate(df).collect()} == dict.fromkeys(range(6), 1)
