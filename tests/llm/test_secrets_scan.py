import math
import random
import re
import time

from marlstone.llm import secrets_scan as s

ASSIGN = re.compile(r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def brute(text):
    text, out = text or "", []
    out += [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(out)


def test_base_spans_match_brute_force(spark):
    rng = random.Random(2)
    alphabet = ["password", "Token", "api_key", "APIKEY", "secret", "passwd", "=", ":", " ", '"', "'", "AKIA", "AKIAAAAAAAAAAAAAAA", "0123456789abcdef", "abcdef", "Z", "é", "𝔘", "\n", "x" * 12, "9" * 15, ".", "="]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(400)] + [None, "", "token: secret:abcdefghijklmno", "secret=" + "a" * 5000, "AKIA" * 10, "password=short, password='longenough12'", "f" * 100_000]
    df = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, spans string")
    got = {r.doc_id: [(x.start, x.ord, x.kind, x.end) for x in r.spans if x.kind != "random"] for r in s.find_secrets(df).collect()}
    assert got == {k: brute(t) for k, t in enumerate(texts)}


def test_battery_finds_random_keys_and_leaves_words(spark, prose):
    rng = random.Random(6)
    key = lambda n, a: "".join(rng.choice(a) for _ in range(n))
    base64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    rows = [(k, f"{prose(k, 30)} {key(64, base64)} end") for k in range(20)]
    rows += [(100 + k, f"{prose(k, 20)} antidisestablishmentarianistically-{'the-end-of-it-all-' * 4}{k}") for k in range(40)]
    got = {r.doc_id: [x.kind for x in r.spans] for r in s.find_secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(got[k] == ["random"] for k in range(20)) >= 18
    assert not any(got[k] for k in range(100, 140))


def test_battery_judges_runs_behind_an_equals_sign(spark, prose):
    rng = random.Random(8)
    base64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    rows, expected = [], {}
    for k in range(30):
        before, value = prose(k, 10) + (" aws_key=", " GET /x?sig=", " aws_secret_access_key=")[k % 3], "".join(rng.choice(base64) for _ in range(60)) + "=" * (k % 2)
        rows.append((k, f"{before}{value}&x=1 end"))
        expected[k] = [(len(before), len(before) + len(value), "random")]
    rows += [(100 + k, f"{prose(k, 20)} name={'the-end-of-it-all-' * 4}{k}") for k in range(10)]
    got = {r.doc_id: [(x.start, x.end, x.kind) for x in r.spans] for r in s.find_secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(got[k] == expected[k] for k in range(30)) >= 27
    assert not any(got[k] for k in range(100, 110))


def phi(x):
    return math.erfc(x / math.sqrt(2)) / 2


def judged(run):
    """The battery by its definitions: p that a random string is as odd, -log10 p that text is as uniform, length."""
    body = run.rstrip("=")
    if body.isdigit():
        return None
    e = next((k for k, x in enumerate(s.ENCODINGS) if x[1] and re.search(x[1], body)), len(s.ENCODINGS) - 1)
    alphabet, excess = s.ENCODINGS[e][2:]
    x = [alphabet.index(c) for c in (body.translate(str.maketrans("-_", "+/")) if e == len(s.ENCODINGS) - 1 else body.lower())]
    n, k = len(x), len(alphabet)
    chi = sum((x.count(v) - n / k) ** 2 / (n / k) for v in range(k))
    up = [2 * v >= k for v in x]
    a = sum(up)
    mu, runs = 2 * a * (n - a) / n + 1, 1 + sum(p != q for p, q in zip(up, up[1:], strict=False))
    var = (mu - 1) * (mu - 2) / (n - 1)
    mean = sum(x) / n
    total, joint = sum((v - mean) ** 2 for v in x), sum((p - mean) * (q - mean) for p, q in zip(x, x[1:], strict=False))
    z = [(runs - mu) / math.sqrt(var) if var > 0 else 30, (joint / total + 1 / n) * math.sqrt(n) if total > 0 else 30]
    df = k - 1
    zc = ((chi / df) ** (1 / 3) - 1 + 2 / (9 * df)) / math.sqrt(2 / (9 * df))
    ps = [phi(zc) if zc > 0 else 0.5, *(min(1, 2 * phi(abs(v))) for v in z)]
    combined = 0.5 - math.atan(sum(math.tan((0.5 - min(max(p, 1e-12), 1 - 1e-12)) * math.pi) for p in ps) / 3) / math.pi
    zt = (chi - df - n * excess) / math.sqrt(2 * df + 4 * n * excess)
    return combined, min(-math.log10(max(phi(-zt), 1e-300)), s.MOST_DECADES) if zt < 0 else 0.0, n


def test_battery_matches_its_definitions(spark):
    rng = random.Random(12)
    alphabets = [x[2] for x in s.ENCODINGS] + ["ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "ab", "0123456789", "the-end_of_it"]
    runs = ["".join(rng.choice(a) for _ in range(n)) for a in alphabets for n in (20, 33, 64, 500)] + ["A" * 40, "abc" * 30 + "==", "Zz" * 900, "a" * 25 + "B"]
    rows = spark.createDataFrame([(k, r) for k, r in enumerate(runs)], "k long, run string").select("k", s._battery(s.F.col("run")).alias("t")).collect()
    assert len(rows) == len(runs)
    for row in rows:
        expected = judged(runs[row.k])
        assert (row.t is None) == (expected is None)
        if expected:
            assert row.t.n == expected[2] and abs(row.t.random - expected[0]) < 1e-4 and abs(row.t.log_p - expected[1]) < 1e-3 * (1 + expected[1])


def test_long_runs_and_many_matches_take_linear_time(spark):
    rng = random.Random(13)
    base64 = s.ENCODINGS[-1][2]
    blob = "".join(rng.choice(base64) for _ in range(200_000))
    many = "".join(f"token=abcdefghijkl{k:06d} " for k in range(20_000))
    df = spark.createDataFrame([(1, "start " + blob + " end"), (2, many), (3, "word" * 50_000)], "doc_id long, text string")
    began = time.time()
    got = {r.doc_id: r.spans for r in s.find_secrets(df).collect()}
    assert time.time() - began < 60
    assert [(x.start, x.end, x.kind) for x in got[1]] == [(6, 200_006, "random")] and got[3] == []
    assert [(x.start, x.end) for x in got[2]] == [(25 * k, 25 * k + 24) for k in range(20_000)]


def test_columns_of_any_name_are_kept(spark):
    got = s.find_secrets(spark.createDataFrame([(1, "token=abcdefabcdefabcdef", "b", 2), (None, None, None, None)], "doc_id long, text string, base string, Runs long")).collect()
    assert [(r.doc_id, r.base, r.Runs, len(r.spans)) for r in got] == [(1, "b", 2, 2), (None, None, None, 0)]


def test_span_string_and_empty_table(spark):
    df = spark.createDataFrame([(1, "token=abcdefabcdefabcdef")], "doc_id long, text string")
    row = s.find_secrets(df).select(s.span_string(s.F.col("spans")).alias("t")).first()
    assert row.t == "assign:0:24,hex:6:24"
    assert s.find_secrets(df.limit(0)).count() == 0
