"""Secret scan: fixed patterns plus a battery of randomness tests (DataFrame functions only).

Patterns give the base spans. The battery judges every run of 20 or more token
characters. "=" is no token character: a run after it (name=value, ?sig=value) is a run of
its own, and "=" belongs to a run only as padding at its end. The encoding of a run is
inferred from its characters, and three tests are made over that encoding's alphabet:
chi-squared uniformity, Wald-Wolfowitz runs about the middle of the alphabet, and lag-1
serial correlation. A run is a finding when the three
together (Cauchy combination) don't reject randomness, and when its chi-squared lies too
low for natural text of its length (noncentral chi-squared, normal approximation). The
latter p-values are controlled by Benjamini-Hochberg within each length band over the
whole corpus, on histograms of log p, so that long runs don't pay for short
ones. A histogram has at most a few hundred bins a band, whatever the corpus.

Every sum of the battery is one pass over a run, so a run of any length costs time in proportion.

Defined cases: null text is the empty text without spans; an empty table gives an empty result; repeated rows
give repeated results; texts are scanned whole, however long; positions are code points, the end exclusive; other
columns are kept, whatever their names, but for spans. Findings that overlap a base span add nothing.
Runs of digits alone are left to the patterns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, let

#: The base patterns in the order of their kinds.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{16,}"
ASSIGN_MIN = 12
KINDS = ("assign", "access", "hex", "random")

#: Runs that the battery judges.
RUN = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}=*"
#: Encoding, its pattern, its alphabet, and the excess sum of squares of natural
#: text over it (alphabet size times the sum of squared letter rates of about 0.066, less 1).
ENCODINGS = (
    ("hex", "^([0-9a-f]+|[0-9A-F]+)$", "0123456789abcdef", 1.00),
    ("base32", "^[A-Z2-7]+$", "abcdefghijklmnopqrstuvwxyz234567", 1.11),
    ("lower", "^[a-z]+$", "abcdefghijklmnopqrstuvwxyz", 0.72),
    ("base36", "^[0-9a-z]+$", "0123456789abcdefghijklmnopqrstuvwxyz", 1.38),
    ("base64", "", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", 3.22),
)
BINS_A_DECADE, MOST_DECADES = 20, 40
#: The polynomial of the usual approximation to the normal tail.
TAIL = (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)


#: Matches are placed in chunks of so many, as an array grows by copying.
CHUNK = 1_000
_SPANS = "array<struct<start:int,ord:int,kind:string,end:int,hit:string>>"


def _spans(text: Column, pattern: str, kind: str, value_group: int = 0, least: int = 0) -> Column:
    """Spans of a pattern's leftmost matches whose group has the least length, by the gaps between matches."""
    none = F.array().cast(_SPANS)

    def placed(found: Column) -> Column:
        values = F.regexp_extract_all(text, F.lit(pattern), F.lit(value_group)) if value_group else found
        gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found))
        return let(F.arrays_zip(gaps.alias("gap"), found.alias("hit"), values.alias("value")), walked)

    def step(state: Column, part: Column) -> Column:
        start = state["at"] + F.length(part["gap"])
        end = start + F.length(part["hit"])
        span = F.struct(start.alias("start"), F.lit(KINDS.index(kind)).alias("ord"), F.lit(kind).alias("kind"), end.alias("end"), part["hit"].alias("hit"))
        spans = F.when(F.length(part["value"]) >= least, F.array_append(state["spans"], span)).otherwise(state["spans"])
        return F.struct(end.alias("at"), spans.alias("spans"))

    def walked(parts: Column) -> Column:
        def chunk(state: Column, first: Column) -> Column:
            inner = F.aggregate(F.slice(parts, first, F.lit(CHUNK)), F.struct(state["at"].alias("at"), none.alias("spans")), step)
            return let(inner, lambda x: F.struct(x["at"].alias("at"), F.array_append(state["chunks"], x["spans"]).alias("chunks")))

        start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{_SPANS}>").alias("chunks"))
        return F.flatten(F.aggregate(F.sequence(F.lit(1), F.size(parts), F.lit(CHUNK)), start, chunk)["chunks"])

    return F.when(text.rlike(pattern), let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)).otherwise(none)


def _log10_tail(x: Column) -> Column:
    """log10 of the normal tail beyond x >= 0."""
    t = 1 / (1 + 0.2316419 * x)
    poly = F.lit(0.0)
    for c in reversed(TAIL):
        poly = (poly + c) * t
    return (-x * x / 2 - 0.9189385332046727) / 2.302585092994046 + F.log10(poly)


def _two_sided(z: Column) -> Column:
    return F.least(F.lit(1.0), 2 * F.pow(F.lit(10.0), _log10_tail(F.abs(z))))


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, b: a + b)


def _moments(plain: Column, alphabet: Column, bits: Column) -> Column:
    """Sums over the letters' places x in the alphabet, each in one pass over the run.

    n, squares (of letter counts), s (sum of x), ss (of x * x), lagged (of neighbours' products), first, last,
    high (letters of the upper half), runs (of halves).
    """
    absent = lambda text, part: F.length(text) - F.length(F.replace(text, part, F.lit("")))
    counts = F.transform(F.sequence(F.lit(1), F.length(alphabet)), lambda j: absent(plain, F.substr(alphabet, j, F.lit(1))).cast("double"))
    places = F.transform(F.split(plain, ""), lambda c: F.instr(alphabet, c).cast("double") - 1)

    def sums(m: Column) -> Column:
        n, x, halves = m["counts"], m["places"], m["halves"]
        lagged = F.zip_with(F.slice(x, F.lit(1), F.size(x) - 1), F.slice(x, F.lit(2), F.size(x) - 1), lambda a, b: a * b)
        return F.struct(
            F.size(x).cast("double").alias("n"), _total(F.transform(n, lambda c: c * c)).alias("squares"), _total(F.transform(n, lambda c, j: c * j)).alias("s"),
            _total(F.transform(n, lambda c, j: c * j * j)).alias("ss"), _total(lagged).alias("lagged"), F.get(x, F.lit(0)).alias("first"), F.get(x, F.size(x) - 1).alias("last"),
            absent(halves, F.lit("1")).cast("double").alias("high"), (1 + absent(halves, F.lit("01")) / 2 + absent(halves, F.lit("10")) / 2).alias("runs"),
        )

    return let(F.struct(counts.alias("counts"), places.alias("places"), F.call_function("translate", plain, alphabet, bits).alias("halves")), sums)


def _battery(run: Column) -> Column:
    """struct(random: p that a random string is as odd, log_p: -log10 p that text is as uniform, n) of a run."""
    pick = lambda e, values: F.element_at(F.array(*[F.lit(v) for v in values]), e + 1)
    halves = ["0" * ((len(x[2]) + 1) // 2) + "1" * (len(x[2]) // 2) for x in ENCODINGS]

    def encoded(body: Column) -> Column:
        encoding = F.lit(len(ENCODINGS) - 1)
        for k, (_, pattern, _, _) in reversed(list(enumerate(ENCODINGS[:-1]))):
            encoding = F.when(body.rlike(pattern), F.lit(k)).otherwise(encoding)

        def judged(e: Column) -> Column:
            plain = F.when(e == len(ENCODINGS) - 1, F.translate(body, "-_", "+/")).otherwise(F.lower(body))
            moments = let(plain, lambda t: _moments(t, pick(e, [x[2] for x in ENCODINGS]), pick(e, halves)))
            return let(moments, lambda m: _tests(m, pick(e, [float(len(x[2])) for x in ENCODINGS]), pick(e, [x[3] for x in ENCODINGS])))

        return F.when(~body.rlike("^[0-9]+$"), let(encoding, judged))

    return let(F.rtrim(run, F.lit("=")), encoded)


def _tests(m: Column, k: Column, excess: Column) -> Column:
    """The three tests of a run's moments over an alphabet of k letters, and the text test."""
    n, high = m["n"], m["high"]
    chi = k / n * m["squares"] - n
    both = 2 * high * (n - high)
    spread = both * (both - n) / (n * n * (n - 1))
    z_runs = F.when(spread > 0, (m["runs"] - both / n - 1) / F.sqrt(spread)).otherwise(F.lit(30.0))
    mean = m["s"] / n
    total = m["ss"] - m["s"] * mean
    joint = m["lagged"] - mean * (2 * m["s"] - m["first"] - m["last"]) + (n - 1) * mean * mean
    z_serial = F.when(total > 0, (joint / total + 1 / n) * F.sqrt(n)).otherwise(F.lit(30.0))
    # Wilson-Hilferty for the upper tail of chi-squared
    df = k - 1
    z_chi = (F.pow(F.greatest(chi, F.lit(0.0)) / df, F.lit(1 / 3)) - 1 + 2 / (9 * df)) / F.sqrt(2 / (9 * df))
    p_chi = F.when(z_chi > 0, F.pow(F.lit(10.0), _log10_tail(z_chi))).otherwise(F.lit(0.5))
    cauchy = lambda p: F.tan((0.5 - F.least(F.greatest(p, F.lit(1e-12)), F.lit(1 - 1e-12))) * 3.141592653589793)
    combined = 0.5 - F.atan((cauchy(p_chi) + cauchy(_two_sided(z_runs)) + cauchy(_two_sided(z_serial))) / 3) / 3.141592653589793
    z_text = (chi - df - n * excess) / F.sqrt(2 * df + 4 * n * excess)
    log_p = F.when(z_text < 0, -_log10_tail(-z_text)).otherwise(F.lit(0.0))
    return F.struct(combined.alias("random"), F.least(log_p, F.lit(float(MOST_DECADES))).alias("log_p"), n.cast("int").alias("n"))


def _band(n: Column) -> Column:
    """Length bands: a factor of two each."""
    return F.floor(F.log2(n)).cast("int")


def text_thresholds(docs: DataFrame, text_col: str = "text", q: float = 0.01) -> dict[int, float]:
    """Least -log10 p that Benjamini-Hochberg at level q accepts, by length band, over all runs of all texts."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    runs = docs.select(F.explode(F.when(text.rlike(RUN), F.regexp_extract_all(text, F.lit(RUN), F.lit(0)))).alias("run"))
    tested = runs.select(_battery(F.col("run")).alias("t")).where(F.col("t.n") >= 20)
    binned = tested.groupBy(_band(F.col("t.n")).alias("band"), F.floor(F.col("t.log_p") * BINS_A_DECADE).cast("int").alias("bin")).count()
    bands: dict[int, dict[int, int]] = {}
    for row in binned.collect():  # at most bands times bins rows
        bands.setdefault(row["band"], {})[row["bin"]] = row["count"]
    found = {}
    for band, bins in bands.items():
        total, beyond = sum(bins.values()), 0
        for b in sorted(bins, reverse=True):
            beyond += bins[b]
            if 10 ** (-b / BINS_A_DECADE) * total <= q * beyond:
                found[band] = b / BINS_A_DECADE
    return found


def find_secrets(docs: DataFrame, text_col: str = "text", q: float = 0.01, random_level: float = 0.001) -> DataFrame:
    """docs plus spans: array of struct(start, ord, kind, end, hit) by start, then kind (a column of that name is replaced)."""
    limits = text_thresholds(docs, text_col, q)
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = F.concat(_spans(text, ASSIGN, "assign", 2, ASSIGN_MIN), _spans(text, ACCESS, "access"), _spans(text, HEX, "hex"))
    keep = [c for c in docs.columns if c != "spans"]
    base_at, runs_at = fresh("base", docs), fresh("runs", docs)
    out = docs.select(*keep, base.alias(base_at), (_spans(text, RUN, "random") if limits else F.array().cast(_SPANS)).alias(runs_at))
    extra = F.col(runs_at)
    if limits:
        table = F.create_map(*[F.lit(x) for band, least in sorted(limits.items()) for x in (band, least)])

        def finding(span: Column) -> Column:
            apart = F.forall(F.col(base_at), lambda b: (b["end"] <= span["start"]) | (span["end"] <= b["start"]))
            odd = let(_battery(span["hit"]), lambda t: (t["random"] >= random_level) & (F.floor(t["log_p"] * BINS_A_DECADE) / BINS_A_DECADE >= table[_band(t["n"])]))
            return apart & F.coalesce(odd, F.lit(False))

        extra = F.filter(extra, finding)
    return out.select(*keep, F.sort_array(F.concat(base_at, extra)).alias("spans"))


def span_string(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
