"""The registered queries of the training-data operators: each applies one to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline

from . import bpe, collocations, decontaminate, html_main_text, line_dedup, lm_scoring, ngram_join, quality_rules, secrets_scan, spelling, token_counts, url_filter, warc
from .common import materialize, scratch_dir, table


def vocabulary(name: str) -> str:
    """Path of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    found = html_main_text.extract(table(spark, sf_dir, "pages"))
    return found.withColumn("n_chars", F.length("text").cast("long"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and spans of the secrets of every document."""
    found = secrets_scan.find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "spans")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"] != "random")
    return found.select(
        "doc_id", *map(count, secrets_scan.KINDS), F.sha2(secrets_scan.span_string(base), 256).alias("base_sha256"), secrets_scan.span_string(F.col("spans")).alias("spans")
    )


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document, and whether it exceeds 512 tokens."""
    counted = token_counts.count_tokens(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))
    return counted.withColumn("over_limit", F.col("n_tokens") > 512)


def op4_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's token ids and of the text that they decode to."""
    coded = bpe.encode(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), decoded=True)
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archive every page, then read the archives back."""
    folder = scratch_dir(spark, "warc")
    manifest = materialize(warc.write_archives(table(spark, sf_dir, "pages"), folder), "warc-manifest")
    found = warc.read_archives(spark, folder, manifest, with_payload=False)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP5_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (SELECT page_id, strlen(body) AS payload_bytes, sha1(body) AS payload_digest FROM p),
w AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS response FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND response <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND response <> page_id THEN response END AS refers_to
FROM w
"""


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shingle count and near-duplicate component of every document."""
    return ngram_join.ngram_components(table(spark, sf_dir, "documents"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, fitting rule and verdict of every page's url."""
    judged = url_filter.judge(table(spark, sf_dir, "pages").select("page_id", "url"))
    return judged.select("page_id", "host", "path", "rule", "verdict", "block_probability")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text without boilerplate lines of its source, n_lines_dropped."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return line_dedup.drop_boilerplate(docs).select("doc_id", "text", "n_lines_dropped")


OP8_SQL = r"""
WITH lines AS (
  SELECT doc_id, source, pos, line, trim(line, E' \t\n\x0b\x0c\r') AS key
  FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line,
               generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents)
), pages AS (SELECT source, count(*) AS total FROM documents GROUP BY source),
bad AS (
  SELECT source, key FROM (SELECT source, key, count(DISTINCT doc_id) AS n FROM lines WHERE key <> '' GROUP BY source, key)
  JOIN pages USING (source) WHERE n >= 5 AND n > 0.08 * total
), marked AS (SELECT l.*, b.key IS NOT NULL AS dropped FROM lines l LEFT JOIN bad b ON l.source = b.source AND l.key = b.key),
folded AS (
  SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped) AS cleaned,
         count(*) FILTER (WHERE dropped) AS n
  FROM marked GROUP BY doc_id
)
SELECT d.doc_id, CASE WHEN n > 0 THEN coalesce(cleaned, '') ELSE d.text END AS text, n AS n_lines_dropped
FROM documents d JOIN folded USING (doc_id)
"""


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each (doc_id, item_id) where the document holds the benchmark item."""
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base measures of every document and its verdict under risk-controlled cutoffs."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    measured = materialize(quality_rules.measure(docs).drop("text"), "quality-measures")
    cutoffs = quality_rules.calibrate(measured, table(spark, sf_dir, "labels"))
    return quality_rules.judge(measured, cutoffs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2,000 phrases of each language with their counts and scores."""
    return collocations.collocations(table(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), worded AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces),
places AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM worded),
grams AS (SELECT lang, w[i:i + m - 1] AS p, m FROM places, (SELECT unnest([1, 2, 3, 4]) AS m) WHERE i + m - 1 <= len(w)),
f AS (SELECT lang, p, m, count(*) AS n FROM grams GROUP BY lang, p, m HAVING count(*) >= 30),
totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM worded GROUP BY lang),
cuts AS (SELECT lang, p, m, n AS a, unnest(range(1, m)) AS k FROM f WHERE m >= 2),
scored AS (
  SELECT c.lang, c.p, c.a, c.k, x.n AS l, y.n AS r, CAST(2000000 AS HUGEINT) * c.a // (CAST(x.n AS HUGEINT) + y.n) AS score
  FROM cuts c JOIN f x ON x.lang = c.lang AND x.p = c.p[1:c.k] JOIN f y ON y.lang = c.lang AND y.p = c.p[c.k + 1:c.m]
), best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1),
inner_spans AS (
  SELECT f.lang, f.n, f.p[i:i + z - 1] AS p FROM f, (SELECT unnest([2, 3]) AS z), (SELECT unnest([1, 2, 3]) AS i) WHERE z < f.m AND i + z - 1 <= f.m
), longest AS (SELECT lang, p, max(n) AS longer FROM inner_spans GROUP BY lang, p),
free AS (
  SELECT b.* FROM best b LEFT JOIN longest g ON g.lang = b.lang AND g.p = b.p
  WHERE g.longer IS NULL OR CAST(100 AS HUGEINT) * g.longer < CAST(80 AS HUGEINT) * b.a
), ranked AS (SELECT *, array_to_string(p, ' ') AS phrase, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(p, ' ')) AS rank FROM free)
SELECT r.lang, r.rank, r.phrase, r.a, r.l, r.r, t.n, CAST(r.score AS BIGINT) AS score FROM ranked r JOIN totals t ON t.lang = r.lang WHERE r.rank <= 2000
"""


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, near words, form and root of every word of the documents."""
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))


def op13_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram and model log-probabilities of every document, learnt from six of seven folds."""
    held_out = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(7)) == 2
    return lm_scoring.score_documents(table(spark, sf_dir, "documents"), held_out)


QUERIES = {
    "op1_html_main_text": op1_html_main_text,
    "op2_secret_scan": op2_secret_scan,
    "op3_token_counts": op3_token_counts,
    "op4_bpe_round_trip": op4_bpe_round_trip,
    "op5_warc": op5_warc,
    "op6_ngram_join": op6_ngram_join,
    "op7_url_filter": op7_url_filter,
    "op8_line_dedup": op8_line_dedup,
    "op9_decontaminate": op9_decontaminate,
    "op10_quality_rules": op10_quality_rules,
    "op11_collocations": op11_collocations,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_lm_scoring": op13_lm_scoring,
    "pipeline": corpus_pipeline.run,
}
ORACLE_SQL = {"op5_warc": OP5_SQL, "op8_line_dedup": OP8_SQL, "op11_collocations": OP11_SQL}
