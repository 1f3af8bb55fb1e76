"""URL filter: host and path rules, and gradient-boosted trees for all other URLs (DataFrame functions only).

The trees see lexical features alone: lengths, path depth, digit ratio, character entropy,
counts of parameters, hyphens and labels, and the smoothed block rate of the host's
public suffix, backed off to its last label and to the prior. They are trained here from labelled URLs: features are cut into at most
BINS bins, gradients are summed by (node, feature, bin) in one aggregation a level, and the
driver sees only these sums to choose splits. A finished model is a sum of CASE expressions.

Training takes at most max_rows labelled rows (default 20,000, the first by hash), documented
bound of the sample; scoring covers every row. Defined cases: a null url or one without ://
has empty host and path, fits no rule and is judged by the model like any other text;
repeated rows give repeated results; an empty table gives an empty result; other columns are kept, whatever their
names, but for those that judge() returns. URLs are used whole, however long.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, fresh, let, materialize

#: The rules (host and path, verdict); the longest that fits wins.
RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))

FEATURES = ("length", "host_length", "depth", "digit_ratio", "host_entropy", "path_entropy", "parameters", "hyphens", "labels", "longest_label", "suffix_rate")
BINS = 16
#: Hosts below a pair of labels that make it a public suffix, and rows that a suffix's prior counts for.
PUBLIC_HOSTS, BACKING = 20, 20


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty for null or without ://."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    some = F.coalesce(url, F.lit(""))
    return ascii_lower(F.regexp_extract(some, pattern, 1)), F.regexp_extract(some, pattern, 2)


def fitting_rule(host: Column, path: Column, rules=RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits, or null. Cost grows with the host's labels, not with the rules."""
    by_host: dict[str, list[tuple[str, str, str]]] = {}
    for rule, verdict in rules:
        name, _, rest = rule.partition("/")
        by_host.setdefault(name, []).append((f"/{rest}", rule, verdict))
    if not by_host:
        return F.lit(None).cast("struct<rule:string,verdict:string>")
    entry = lambda r: F.struct(F.lit(len(r[1])).alias("n"), F.lit(r[0]).alias("path"), F.lit(r[1]).alias("rule"), F.lit(r[2]).alias("verdict"))
    table = F.create_map(*[x for name, own in by_host.items() for x in (F.lit(name), F.array(*map(entry, own)))])
    suffixes = let(F.split(host, r"\."), lambda labels: F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    candidates = F.flatten(F.filter(F.transform(suffixes, lambda s: table[s]), lambda x: x.isNotNull()))
    best = F.array_max(F.filter(candidates, lambda r: F.startswith(path, r["path"])))
    return F.when(best.isNotNull(), F.struct(best["rule"].alias("rule"), best["verdict"].alias("verdict")))


def _entropy(text: Column) -> Column:
    """Bits a character."""

    def bits(chars: Column) -> Column:
        n = F.size(chars)
        shares = F.transform(F.array_distinct(chars), lambda c: F.size(F.filter(chars, lambda x: x == c)) / n)
        return F.aggregate(shares, F.lit(0.0), lambda a, p: a - p * F.log2(p))

    return F.when(F.length(text) > 0, let(F.split(text, ""), bits)).otherwise(F.lit(0.0))


def feature_prefix(urls: DataFrame) -> str:
    """The start of the feature columns' names, which no column of urls shares."""
    prefix = "f_"
    while any(c.lower().startswith(prefix) for c in urls.columns):
        prefix += "_"
    return prefix


def features(urls: DataFrame, suffix_rates: dict[str, float], prior: float, url_col: str = "url") -> DataFrame:
    """urls plus a column for each feature: its name behind feature_prefix(urls)."""
    url = F.coalesce(F.col(url_col), F.lit(""))
    host, path = parts(F.col(url_col))
    query = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)
    labels = F.split(host, r"\.")
    rates = F.lit(None).cast("double")
    if suffix_rates:
        rates = F.create_map(*[F.lit(x) for k, v in sorted(suffix_rates.items()) for x in (k, v)])
        rates = F.coalesce(rates[F.concat_ws(".", F.slice(labels, F.greatest(F.lit(1), F.size(labels) - 1), F.lit(2)))], rates[F.element_at(labels, -1)])
    columns = {
        "length": F.length(url),
        "host_length": F.length(host),
        "depth": F.size(F.filter(F.split(path, "/"), lambda x: x != "")),
        "digit_ratio": (F.length(url) - F.length(F.regexp_replace(url, "[0-9]+", ""))) / F.greatest(F.lit(1), F.length(url)),
        "host_entropy": _entropy(host),
        "path_entropy": _entropy(path),
        "parameters": F.size(F.filter(F.split(query, "&"), lambda x: x != "")),
        "hyphens": F.length(host) - F.length(F.regexp_replace(host, "-+", "")),
        "labels": F.size(labels),
        "longest_label": F.array_max(F.transform(labels, lambda x: F.length(x))),
        "suffix_rate": F.coalesce(rates, F.lit(prior)),
    }
    prefix = feature_prefix(urls)
    return urls.withColumns({f"{prefix}{k}": v.cast("double") for k, v in columns.items()})


@dataclass(frozen=True)
class Model:
    prior: float
    suffix_rates: dict
    base: float
    trees: tuple  # of nested (feature, cut, left, right) or leaf values

    def score(self, prefix: str = "f_") -> Column:
        """Log odds of block over the feature columns."""

        def walk(node) -> Column:
            if isinstance(node, float):
                return F.lit(node)
            name, cut, left, right = node
            return F.when(F.col(f"{prefix}{name}") <= cut, walk(left)).otherwise(walk(right))

        total = F.lit(self.base)
        for tree in self.trees:
            total = total + walk(tree)
        return total


#: Kinds of hosts and paths in the built-in labelled set: those to block, then the others.
BLOCKED = ("generated", "redirect", "doorway", "lookalike")
ORDINARY = ("news", "shop", "manual", "society", "personal")


def labelled_urls(spark: SparkSession, n: int = 8000, start: int = 0, kinds: tuple[str, ...] = BLOCKED + ORDINARY) -> DataFrame:
    """url, kind, label (1: block): rows start to start + n of a built-in labelled set, made by rule; kinds: those that hosts may have.

    It follows how unwanted URLs are known to look, not any table: hosts made by generators (long labels of mixed letters and
    digits), redirects with many long parameters, doorway pages on deep subdomains, and lookalikes that join words by hyphens. The
    ordinary kinds have hyphens, digits, depth and parameters too: dated news, product numbers, manuals, hyphenated
    societies. No single sign decides: host, path and suffix are drawn apart, and each is one of the other side in a fifth of the
    rows. train() takes any table of url and label.
    """
    words = ["river", "garden", "school", "music", "travel", "recipe", "weather", "museum", "science", "house", "light", "stone", "market", "letter", "window", "harbor", "forest", "winter", "letterbox", "cloud"]
    salted = lambda salt: F.xxhash64("id", F.lit(salt))
    number = lambda salt, most: F.pmod(salted(salt), F.lit(most))
    pick = lambda of, salt: F.element_at(F.array(*map(F.lit, of)), (number(salt, len(of)) + 1).cast("int"))
    noise = lambda salt, size: F.substring(F.md5(salted(salt).cast("string")), 1, size)
    join = lambda sep, *x: F.concat_ws(sep, *x)
    word = lambda salt: pick(words, salt)
    date = join("/", number("y", 12) + 2012, number("m", 12) + 1, number("d", 28) + 1)
    hosts = {
        "generated": F.concat(noise("h1", 9), F.lpad(noise("h2", 8), 12, "qzx")),
        "redirect": F.concat(pick(["go", "r", "out", "ref"], "s"), F.lit("."), word("a"), noise("h1", 3)),
        "doorway": join(".", word("a"), word("b"), noise("h1", 4), word("c")),
        "lookalike": F.concat(join("-", word("a"), word("b"), word("c")), F.lit("-"), noise("h1", 2)),
        "news": F.concat(word("a"), word("b")),
        "shop": F.concat(pick(["www.", "", "shop."], "s"), word("a"), pick(["", "-", "24"], "t"), word("b")),
        "manual": F.concat(F.lit("docs."), word("a")),
        "society": join("-", word("a"), word("b")),
        "personal": F.concat(word("a"), pick(["", "", "7", "blog"], "t")),
    }
    paths = {
        "generated": F.concat(F.lit("/"), noise("p1", 5)),
        "redirect": F.concat(F.lit("/c?uid="), noise("p1", 24), F.lit("&sub="), noise("p2", 12), F.lit("&cid="), number("k", 999_999), F.lit("&to="), noise("p3", 16)),
        "doorway": F.concat(F.lit("/"), join("/", word("d"), word("e"), word("f"), word("g")), F.lit(".php")),
        "lookalike": F.concat(F.lit("/"), join("-", word("d"), word("e")), pick(["", "/login", "?verify=1"], "t")),
        "news": F.concat(F.lit("/"), date, F.lit("/"), join("-", word("d"), word("e"), word("f")), pick(["", ".html"], "t")),
        "shop": F.concat(F.lit("/item/"), number("k", 99_999), pick(["", "?size=4", "?size=4&color=2"], "u")),
        "manual": F.concat(F.lit("/v"), number("k", 9), F.lit("/"), join("/", word("d"), word("e"), word("f")), pick(["", "#usage"], "t")),
        "society": F.concat(F.lit("/"), word("d"), pick(["", "/members", ".html"], "t")),
        "personal": pick(["/", "", "/about", "/photos/12"], "u"),
    }
    bad = number("side", 2) == 0
    swapped = lambda salt: bad != (number(salt, 5) == 0)
    either = lambda blocked, ordinary, salt: F.when(swapped(f"swap-{salt}"), pick(blocked, salt)).otherwise(pick(ordinary, salt))
    kind = either(*([k for k in side if k in kinds] or list(side) for side in (BLOCKED, ORDINARY)), "host")
    path = either(BLOCKED, ORDINARY, "path")
    suffix = either(["xyz", "top", "click", "info", "biz", "co.at"], ["org", "edu", "com", "net", "de", "ac.uk"], "suffix")
    of = lambda table, which: F.coalesce(*[F.when(which == k, table[k]) for k in table])
    url = F.concat(pick(["http://", "https://"], "scheme"), of(hosts, kind), F.lit("."), suffix, of(paths, path))
    return spark.range(start, start + n).select(url.alias("url"), kind.alias("kind"), bad.cast("int").alias("label"))


def _suffix_rates(rows: DataFrame) -> tuple[float, dict[str, float]]:
    """Prior block rate, and the rate of every last label, backed off to the prior, and of every public pair of labels, backed off to the last.

    A pair is public where PUBLIC_HOSTS hosts at least stand below it. There are no more suffixes than labelled rows, which are bounded.
    """
    host, _ = parts(F.col("url"))
    labels = F.split(host, r"\.")
    named = rows.select("label", host.alias("host"), F.element_at(labels, -1).alias("last"), F.when(F.size(labels) > 2, F.concat_ws(".", F.slice(labels, -2, 2))).alias("pair"))
    sums = [F.sum("label").alias("bad"), F.count("*").alias("n")]
    lasts = named.groupBy("last").agg(*sums).collect()
    pairs = named.where("pair IS NOT NULL").groupBy("pair").agg(*sums, F.countDistinct("host").alias("hosts")).where(F.col("hosts") >= PUBLIC_HOSTS).collect()
    prior = (sum(r["bad"] for r in lasts) + 1) / (sum(r["n"] for r in lasts) + 2)
    rates = {r["last"]: (r["bad"] + BACKING * prior) / (r["n"] + BACKING) for r in lasts}
    return prior, rates | {r["pair"]: (r["bad"] + BACKING * rates[r["pair"].rpartition(".")[2]]) / (r["n"] + BACKING) for r in pairs}


def train(labelled: DataFrame, trees: int = 10, depth: int = 3, rate: float = 0.4, least: int = 8, max_rows: int = 20_000, without: tuple[str, ...] = ()) -> Model:
    """Fit the trees on (url, label) rows; rows without label take no part. without: features that the trees may not use."""
    rows = labelled.where("url IS NOT NULL AND label IS NOT NULL").select("url", F.col("label").cast("double").alias("label"))
    rows = materialize(rows.orderBy(F.xxhash64("url"), "url", "label").limit(max_rows), "labelled-urls")
    prior, rates = _suffix_rates(rows)
    table = features(rows, rates, prior)
    quantiles = table.agg(*[F.percentile_approx(f"f_{f}", [k / BINS for k in range(1, BINS)], 1000).alias(f) for f in FEATURES]).first()
    cuts = {f: sorted(set(quantiles[f] or [])) for f in FEATURES}
    binned = [F.struct(F.lit(f).alias("f"), F.array_position(F.array(*[F.col(f"f_{f}") <= c for c in cuts[f]], F.lit(True)), F.lit(True)).cast("int").alias("b")) for f in FEATURES]
    table = materialize(table.select("label", *[f"f_{f}" for f in FEATURES], F.array(*binned).alias("bins")), "url-bins")
    base = math.log(prior / (1 - prior))
    model = Model(prior, rates, base, ())
    for _ in range(trees):
        # the level's nodes are paths of left (0) and right (1) steps
        splits: dict[str, tuple] = {}
        sums: dict[str, tuple[float, float]] = {}
        level = [""]
        for d in range(depth + 1):
            node = F.lit("")
            if splits:
                for path in sorted(splits, key=len):
                    f, cut = splits[path]
                    node = F.when(node == path, F.concat(F.lit(path), F.when(F.col(f"f_{f}") <= cut, F.lit("0")).otherwise(F.lit("1")))).otherwise(node)
            p = 1 / (1 + F.exp(-model.score()))
            graded = table.select(node.alias("node"), (F.col("label") - p).alias("g"), (p * (1 - p)).alias("h"), "bins")
            if d == depth:
                for r in graded.groupBy("node").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect():
                    sums[r["node"]] = (r["g"], r["h"])
                break
            cells = graded.select("node", "g", "h", F.explode("bins").alias("x")).groupBy("node", "x.f", "x.b").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.count("*").alias("n")).collect()
            following = []
            for path in level:
                best = None
                for f in [f for f in FEATURES if f not in without]:
                    own = sorted((c["b"], c["g"], c["h"], c["n"]) for c in cells if c["node"] == path and c["f"] == f)
                    g, h, n = (sum(c[k] for c in own) for k in (1, 2, 3))
                    gl = hl = nl = 0
                    for b, gi, hi, ni in own[:-1]:
                        gl, hl, nl = gl + gi, hl + hi, nl + ni
                        if min(nl, n - nl) >= least:
                            gain = gl * gl / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g * g / (h + 1)
                            if gain > 1e-6 and (best is None or gain > best[0] + 1e-9):
                                best = (gain, f, cuts[f][b - 1])
                if best:
                    splits[path] = best[1:]
                    following += [path + "0", path + "1"]
            level = following
            if not level:
                for r in graded.groupBy("node").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect():
                    sums[r["node"]] = (r["g"], r["h"])
                break

        def build(path: str):
            if path in splits:
                return (*splits[path], build(path + "0"), build(path + "1"))
            g, h = sums.get(path, (0.0, 1.0))
            return round(rate * g / (h + 1), 6)

        model = Model(prior, rates, base, (*model.trees, build("")))
        if not splits:
            break
    return model


_DEFAULT: list[Model] = []


def default_model(spark: SparkSession) -> Model:
    """The model of the built-in labelled set, trained once a driver process."""
    if not _DEFAULT:
        _DEFAULT.append(train(labelled_urls(spark)))
    return _DEFAULT[0]


def judge(pages: DataFrame, rules=RULES, model: Model | None = None, url_col: str = "url", level: float = 0.5) -> DataFrame:
    """pages plus host, path, rule, verdict and block_probability (columns of these names are replaced)."""
    model = model or default_model(pages.sparkSession)
    keep = [c for c in pages.columns if c not in {"host", "path", "rule", "verdict", "block_probability"}]
    host, path = parts(F.col(url_col))
    given = pages.select(*keep)
    fits = fresh("rule", given)
    out = features(given, model.suffix_rates, model.prior, url_col)
    out = out.select(*keep, host.alias("host"), path.alias("path"), (1 / (1 + F.exp(-model.score(feature_prefix(given))))).alias("block_probability"))
    out = out.withColumn(fits, fitting_rule(F.col("host"), F.col("path"), rules))
    learnt = F.when(F.col("block_probability") >= level, F.lit("block")).otherwise(F.lit("allow"))
    return out.select(*keep, "host", "path", F.col(f"{fits}.rule").alias("rule"), F.coalesce(F.col(f"{fits}.verdict"), learnt).alias("verdict"), "block_probability")
