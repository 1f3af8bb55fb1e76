"""Queries over texts, vectors, tables and graphs, each with an independent SQL statement where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..dealing import dealt
from ..functions import identity as I
from ..functions import text as T
from ..functions import vectors as V
from ..operators import graph as G
from ..operators import keywords as K
from ..operators import long_texts as L
from ..operators import ocr as O
from ..operators import retrieval as R
from ..operators import segmentation as S
from ..operators import tables as B
from ..operators.keyword_index import keyword_recall
from .model import read

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query and, where given, its oracle."""

    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


# --- keywords -----------------------------------------------------------------------------------------------

STOP = ", ".join(f"'{w}'" for w in K.STOPWORDS)
KEYWORD_CTES = f"""
toks AS (SELECT id, unnest(regexp_extract_all(body, '[\\p{{L}}\\p{{N}}]+(?:[._-][\\p{{L}}\\p{{N}}]+)*')) AS tok FROM texts),
norm AS (SELECT id, CASE WHEN regexp_full_match(tok, '[A-Za-z0-9][A-Za-z0-9._-]*') AND regexp_matches(tok, '[A-Za-z]') AND regexp_matches(tok, '[0-9]') THEN upper(tok) ELSE lower(tok) END AS term,
  regexp_full_match(tok, '[A-Za-z0-9][A-Za-z0-9._-]*') AND regexp_matches(tok, '[A-Za-z]') AND regexp_matches(tok, '[0-9]') AS ident FROM toks),
tf AS (SELECT id, term, count(*) + CASE WHEN bool_or(ident) THEN 2 ELSE 0 END AS rank FROM norm WHERE term NOT IN ({STOP}) AND length(term) <= 255 GROUP BY 1, 2),
ordered AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY rank DESC, term) AS pos FROM tf)
"""


@query("a8_o8_f3_keywords", f"""WITH texts AS (SELECT doc_id AS id, text AS body FROM documents), {KEYWORD_CTES}
  SELECT id AS doc_id, string_agg(term, ',' ORDER BY pos) AS keywords FROM ordered WHERE pos <= 15 GROUP BY 1""")
def keywords(spark, sf):
    return read(spark, sf, "documents").select("doc_id", F.array_join(K.ranked_terms(F.col("text")), ",").alias("keywords")).where("keywords <> ''")


@query("f2_tokens", f"""WITH texts AS (SELECT doc_id AS id, text AS body FROM documents), {KEYWORD_CTES} SELECT id AS doc_id, count(*) AS tokens, count(DISTINCT tok) AS distinct_tokens FROM toks GROUP BY 1""")
def tokens(spark, sf):
    t = read(spark, sf, "documents").select("doc_id", T.tokens(F.col("text")).alias("t")).where(F.size("t") > 0)
    return t.select("doc_id", F.size("t").cast("long").alias("tokens"), F.size(F.array_distinct("t")).cast("long").alias("distinct_tokens"))


#: Ideographs that stand for the letters a to z where the tables' texts are written without spaces, as CJK text is.
HAN = "天地人山水火木金土日月星云雨风花草鸟鱼马牛羊车舟门石"
LETTERS = "abcdefghijklmnopqrstuvwxyz"


def _unspaced(spark, sf):
    """Every conversation turn in ideographs: letters are mapped, spaces go, so that words must be found again."""
    t = read(spark, sf, "conversations")
    return t.select("conv_id", "turn", F.translate(F.regexp_replace(F.lower("text"), "[ \t]+", ""), LETTERS, HAN).alias("text"))


@query("d24_cjk_dictionary", rf"""WITH runs AS (SELECT '^' || unnest(regexp_extract_all(translate(regexp_replace(lower(text), '[ \t]+', '', 'g'), '{LETTERS}', '{HAN}'), '[\x{{4e00}}-\x{{9fff}}]+')) || '$' AS p FROM conversations),
  placed AS (SELECT p, unnest(range(2, length(p))) AS i FROM runs),
  occ AS (SELECT substr(p, i, k) AS gram, substr(p, i - 1, 1) AS before, substr(p, i + k, 1) AS after FROM placed, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE i + k <= length(p)),
  counts AS (SELECT gram, count(*) AS n FROM occ GROUP BY 1), total AS (SELECT sum(n) AS total FROM counts WHERE length(gram) = 1),
  cuts AS (SELECT gram, n, substr(gram, 1, k) AS a, substr(gram, k + 1) AS b FROM counts, (SELECT unnest([1, 2, 3]) AS k) WHERE k < length(gram) AND n >= 5),
  held AS (SELECT c.gram, c.n, min(c.n * CAST(total AS DOUBLE) / (CAST(x.n AS DOUBLE) * y.n)) AS cohesion FROM cuts c JOIN counts x ON x.gram = a JOIN counts y ON y.gram = b, total GROUP BY 1, 2),
  l AS (SELECT gram, ln(sum(m)) - sum(m * ln(m)) / sum(m) AS e FROM (SELECT gram, before, CAST(count(*) AS DOUBLE) AS m FROM occ GROUP BY 1, 2) GROUP BY 1),
  r AS (SELECT gram, ln(sum(m)) - sum(m * ln(m)) / sum(m) AS e FROM (SELECT gram, after, CAST(count(*) AS DOUBLE) AS m FROM occ GROUP BY 1, 2) GROUP BY 1)
  SELECT gram AS word, n, round(cohesion, 4) AS cohesion, round(least(l.e, r.e), 4) AS entropy FROM held JOIN l USING (gram) JOIN r USING (gram) WHERE cohesion >= 20 AND least(l.e, r.e) >= 0.5
  UNION ALL SELECT gram, n, NULL, NULL FROM counts WHERE length(gram) = 1""")
def d24_dictionary(spark, sf):
    from ..operators import cjk_words as C

    words = C.dictionary(_unspaced(spark, sf))
    return words.select("word", "n", F.round("cohesion", 4).alias("cohesion"), F.round("entropy", 4).alias("entropy"))


@query("f2_d24_cjk_keywords")
def f2_cjk(spark, sf):
    """Keywords of every turn in ideographs, cut by the dictionary of all turns."""
    from ..operators import cjk_words as C

    texts = _unspaced(spark, sf)
    cutter = C.dictionary_cutter(C.dictionary(texts))
    return texts.select("conv_id", "turn", F.array_join(K.ranked_terms(F.col("text"), open_cutter=cutter), ",").alias("keywords")).where("keywords <> ''")


def _documents(spark, sf) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """One dataset and index: documents as segments; quality 0 disables and toxic 1 archives a document; every fifth is a parent of the next four."""
    from .model import read as r

    d = r(spark, sf, "documents")
    labels = r(spark, sf, "labels").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    docs = d.select("doc_id", "source").join(labels, "doc_id", "left").select(
        F.col("doc_id").alias("id"), F.lit(1).cast("long").alias("dataset_id"), F.col("source").alias("name"), (F.coalesce("quality", F.lit(1)) != 0).alias("enabled"), (F.coalesce("toxic", F.lit(0)) == 1).alias("archived"), F.lit(False).alias("deleted")
    )
    k = F.col("doc_id")
    segs = d.select(
        k.alias("id"), k.alias("document_id"), F.lit(1).cast("long").alias("dataset_id"), F.lit(1).cast("long").alias("dataset_index_id"), F.when(k % 5 > 0, k - k % 5).alias("parent_id"), F.col("text").alias("content"),
        K.ranked_terms(F.col("text")).alias("keywords"), F.when(k % 5 == 0, "parent").otherwise("child").alias("index_type"), F.when(k % 35 == 0, "indexing").otherwise("completed").alias("status"), F.lit(False).alias("deleted"),
    )
    one = spark.range(1)
    indexes = one.select(F.lit(1).cast("long").alias("id"), F.lit(1).cast("long").alias("dataset_id"), F.lit("active").alias("status"), F.lit(False).alias("deleted"))
    datasets = one.select(F.lit(1).cast("long").alias("id"), F.lit(False).alias("deleted"))
    return segs, docs, indexes, datasets


def _query_terms(spark, sf) -> list[str]:
    """Terms of the first benchmark item: one row reaches the driver."""
    return read(spark, sf, "benchmark").orderBy("item_id").limit(1).select(K.ranked_terms(F.col("text"), K.QUERY_LIMIT).alias("t")).first()["t"]


def _query_vector(spark, sf) -> list[float]:
    return read(spark, sf, "embeddings").where("vec_id = 0").first()["embedding"]


_KEYWORD_INDEXES: dict = {}


def _keyword_index(spark, sf):
    """The stored keyword index of the completed segments: built from the tables at first use, read by later questions."""
    from ..operators import keyword_index as X
    from ..streaming.ingest import shared_folder

    key = spark.sparkContext.applicationId, sf
    if key not in _KEYWORD_INDEXES:
        live = _documents(spark, sf)[0].where("status = 'completed' AND NOT deleted").select("id", "keywords")
        _KEYWORD_INDEXES[key] = X.build(live.repartition(spark.sparkContext.defaultParallelism), shared_folder(spark, "keyword-index"))
    return _KEYWORD_INDEXES[key]


def _vectors(spark, sf, options: R.Options) -> DataFrame:
    return R.vector_hits(read(spark, sf, "embeddings"), _query_vector(spark, sf), 4 * options.top_k, "vec_id")


RETRIEVAL_CTES = f"""
lab AS (SELECT doc_id, min(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY 1),
shown AS (SELECT d.doc_id AS id FROM documents d LEFT JOIN lab USING (doc_id) WHERE coalesce(quality, 1) <> 0 AND coalesce(toxic, 0) <> 1 AND d.doc_id % 35 <> 0),
texts AS (SELECT doc_id AS id, text AS body FROM documents UNION ALL SELECT -1, text FROM benchmark WHERE item_id = (SELECT min(item_id) FROM benchmark)), {KEYWORD_CTES},
q AS (SELECT term FROM ordered WHERE id = -1 AND pos <= 100),
kw AS (SELECT o.id, count(*) / (SELECT greatest(1, count(*)) FROM q) AS score FROM ordered o JOIN q USING (term) WHERE o.id >= 0 AND o.pos <= 15 AND o.id % 35 <> 0 GROUP BY 1),
sem AS (SELECT e.vec_id AS id, greatest(0.0, least(1.0, list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(z.embedding AS DOUBLE[])))) AS score
  FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) z ORDER BY score DESC, id LIMIT 40)
"""
CONTEXT_SQL = """, cand AS (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS before_rank FROM fused WHERE score >= {t}),
ctx AS (SELECT c.*, CASE WHEN c.id % 5 > 0 AND (c.id - c.id % 5) % 35 <> 0 AND EXISTS (SELECT 1 FROM documents p WHERE p.doc_id = c.id - c.id % 5) THEN c.id - c.id % 5 ELSE c.id END AS context_id FROM cand c),
firsts AS (SELECT *, row_number() OVER (PARTITION BY context_id ORDER BY {rank}) AS f FROM ctx)
SELECT x.id, x.context_id, round(x.score, 6) AS score, match_type, substr(d.text, 1, 40) AS content FROM firsts x JOIN documents d ON d.doc_id = x.context_id WHERE f = 1 ORDER BY {rank} LIMIT 10"""


def _shown(df: DataFrame) -> DataFrame:
    """Result columns as the oracles name them."""
    return df.select("id", F.when(F.col("parent_id").isNotNull() & (F.col("parent_id") % 35 != 0), F.col("parent_id")).otherwise(F.col("id")).alias("context_id"), "score", "match_type", "content")


def retrieval_query(name: str, sql: str):
    """Register name, whose SQL shows the first 40 characters of each content, and name_whole with the whole of it."""

    def register(whole):
        def preview(spark, sf):
            return whole(spark, sf).withColumn("content", F.substring("content", 1, 40))

        query(name, sql)(preview)
        query(f"{name}_whole", sql.replace("substr(d.text, 1, 40) AS content", "d.text AS content"))(whole)
        return whole

    return register


@retrieval_query("r2_full_text", f"""WITH {RETRIEVAL_CTES}, fused AS (SELECT kw.id, kw.score / (SELECT max(score) FROM kw) AS score, 'keyword' AS match_type FROM kw JOIN shown USING (id))
  {CONTEXT_SQL.format(t=0.3, rank="before_rank")}""")
def r2(spark, sf):
    options = R.Options("full_text", 10)
    return _shown(R.retrieve(*_documents(spark, sf), options, query_terms=_query_terms(spark, sf), keyword_index=_keyword_index(spark, sf)))


@retrieval_query("r1_o1_o2_vector", f"""WITH {RETRIEVAL_CTES}, fused AS (SELECT sem.id, sem.score, 'vector' AS match_type FROM sem JOIN shown USING (id)) {CONTEXT_SQL.format(t=0.05, rank="before_rank")}""")
def r1(spark, sf):
    options = R.Options("vector", 10, 0.05)
    return _shown(R.retrieve(*_documents(spark, sf), options, _vectors(spark, sf, options)))


HYBRID_SQL = f"""WITH {RETRIEVAL_CTES}, both_hits AS (SELECT coalesce(sem.id, kw.id) AS id, coalesce(sem.score, 0) / (SELECT max(score) FROM sem) AS s, coalesce(kw.score, 0) / (SELECT max(score) FROM kw) AS k FROM sem FULL JOIN kw ON sem.id = kw.id),
  fused AS (SELECT id, 0.7 * s + 0.3 * k AS score, CASE WHEN s <> 0 AND k <> 0 THEN 'hybrid' WHEN s <> 0 THEN 'vector' ELSE 'keyword' END AS match_type FROM both_hits JOIN shown USING (id))"""


@retrieval_query("r3_j4_hybrid", HYBRID_SQL + CONTEXT_SQL.format(t=0.05, rank="before_rank"))
def r3(spark, sf):
    options = R.Options("hybrid", 10, 0.05)
    return _shown(R.retrieve(*_documents(spark, sf), options, _vectors(spark, sf, options), _query_terms(spark, sf), keyword_index=_keyword_index(spark, sf)))


@retrieval_query("r5_o13_rerank", HYBRID_SQL + CONTEXT_SQL.format(t=0.05, rank="(id * 7) % 101 DESC, before_rank"))
def r5(spark, sf):
    options = R.Options("hybrid", 10, 0.05)
    tables = _documents(spark, sf)
    rerank = tables[0].select("id", ((F.col("id") * 7) % 101).cast("double").alias("score"))
    return _shown(R.retrieve(*tables, options, _vectors(spark, sf, options), _query_terms(spark, sf), rerank=rerank, keyword_index=_keyword_index(spark, sf)))


@query("w3_o3_rank_trace", HYBRID_SQL + """, cand AS (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS before_rank FROM fused WHERE score >= 0.05)
  SELECT id, before_rank, row_number() OVER (ORDER BY (id * 7) % 101 DESC, before_rank) AS after_rank, round(score, 6) AS score FROM cand""")
def w3(spark, sf):
    options = R.Options("hybrid", 10, 0.05)
    segs, docs, indexes, datasets = _documents(spark, sf)
    semantic = _vectors(spark, sf, options)
    hits = keyword_recall(spark, _keyword_index(spark, sf), _query_terms(spark, sf), options.mode, options.score_threshold, options.keyword_weight, semantic)
    fused = R.fuse(semantic, hits, None, R.visible_segments(segs, docs, indexes, datasets), options)
    rerank = segs.select("id", ((F.col("id") * 7) % 101).cast("double").alias("score"))
    out = R.ranked(fused, rerank)
    return out.select("id", F.col("before_rank").cast("long").alias("before_rank"), F.col("after_rank").cast("long").alias("after_rank"), V.result_score(F.col("score")).alias("score"))


@retrieval_query("r6_w2_o4_context", f"""WITH {RETRIEVAL_CTES}, fused AS (SELECT id, 1.0 / (1 + id % 97) AS score, 'graph' AS match_type FROM shown) {CONTEXT_SQL.format(t=0.0, rank="before_rank")}""")
def r6(spark, sf):
    segs, docs, indexes, datasets = _documents(spark, sf)
    graph = segs.select("id", (1 / (1 + F.col("id") % 97)).alias("score"))
    return _shown(R.retrieve(segs, docs, indexes, datasets, R.Options("graph", 10, 0.0), graph=graph))


@query("j7_u2_keyword_overlap", f"WITH {RETRIEVAL_CTES} SELECT o.id, count(*) AS shared FROM ordered o JOIN q USING (term) WHERE o.id >= 0 AND o.pos <= 15 GROUP BY 1")
def j7(spark, sf):
    segs = _documents(spark, sf)[0]
    terms = F.array(*map(F.lit, _query_terms(spark, sf)))
    return K.overlap_candidates(K.inverted_index(segs), terms)


@query("u1_u3_candidate_union", "SELECT DISTINCT id FROM (SELECT vec_id AS id FROM embeddings UNION ALL SELECT doc_id FROM documents WHERE doc_id % 3 = 0)")
def u1(spark, sf):
    return R.candidate_ids(read(spark, sf, "embeddings").select(F.col("vec_id").alias("id")), read(spark, sf, "documents").where("doc_id % 3 = 0").select(F.col("doc_id").alias("id")))


@query("o1_top_k_many", """SELECT query_id, id, rank, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM (
  SELECT a.vec_id AS query_id, b.vec_id AS id, greatest(0.0, least(1.0, list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])))) AS score
  FROM embeddings a, embeddings b WHERE a.vec_id < 5)) WHERE rank <= 10""")
def o1(spark, sf):
    e = read(spark, sf, "embeddings")
    queries = e.where("vec_id < 5").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    top = R.top_k_per_query(e.select(F.col("vec_id").alias("id"), "embedding"), queries, 10)
    return top.select("query_id", "id", F.col("rank").cast("long").alias("rank"), V.result_score(F.col("score")).alias("score"))


@query("o1_top_k_every_20th", """SELECT query_id, id, rank, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM (
  SELECT a.vec_id AS query_id, b.vec_id AS id, greatest(0.0, least(1.0, list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])))) AS score
  FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0)) WHERE rank <= 10""")
def o1_every_20th(spark, sf):
    """The whole query set: every row whose id is divisible by 20, against all rows."""
    e = read(spark, sf, "embeddings")
    queries = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    top = R.top_k_per_query(e.select(F.col("vec_id").alias("id"), "embedding"), queries, 10)
    return top.select("query_id", "id", F.col("rank").cast("long").alias("rank"), V.result_score(F.col("score")).alias("score"))


@query("o1_index_top_k")
def o1_index(spark, sf):
    """The same query set through an inverted-file index over every row; hits bear exact scores, recall is measured in the tests."""
    from ..operators import vector_index as X
    from ..streaming.ingest import shared_folder

    rows = read(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    queries = rows.where("id % 20 = 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("vector"))
    index = X.build(X.fit(rows), rows, shared_folder(spark, "vector-index"))
    top = X.search(index, rows, queries, 10)
    return top.select("query_id", "id", F.col("rank").cast("long").alias("rank"), V.result_score(F.col("score")).alias("score"))


@query("f11_f12_f14_cosine", """SELECT a.vec_id, round(greatest(0.0, least(1.0, list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])))), 6) AS score
  FROM embeddings a, (SELECT embedding FROM embeddings WHERE vec_id = 1) b""")
def f11(spark, sf):
    e = read(spark, sf, "embeddings")
    other = e.where("vec_id = 1").select(F.col("embedding").alias("b"))
    return e.join(F.broadcast(other), F.lit(True)).select("vec_id", V.result_score(V.clamp(V.cosine("embedding", "b"))).alias("score"))


@query("o12_preview_cap", """SELECT conv_id, turn, (SELECT count(*) FROM conversations) AS total, (SELECT count(*) FROM conversations) > 100 AS truncated FROM conversations ORDER BY conv_id, turn LIMIT 100""")
def o12(spark, sf):
    rows = read(spark, sf, "conversations").select(F.col("conv_id").alias("ord"), F.col("turn").alias("position"), "conv_id", "turn")
    return R.capped_preview(rows, 100).select("conv_id", "turn", "total", "truncated")


@query("s22_t6_references", "SELECT row_number() OVER (ORDER BY vec_id) AS reference, vec_id FROM embeddings WHERE vec_id < 20")
def s22(spark, sf):
    rows = read(spark, sf, "embeddings").where("vec_id < 20").select("vec_id", F.col("vec_id").alias("after_rank"))
    return R.referenced(rows).select("reference", "vec_id")


@query("s22_t6_references_all", "SELECT row_number() OVER (ORDER BY vec_id) AS reference, vec_id FROM embeddings")
def s22_all(spark, sf):
    rows = read(spark, sf, "embeddings").select("vec_id", F.col("vec_id").alias("after_rank"))
    return R.referenced_all(rows).select("reference", "vec_id")


# --- text functions ---------------------------------------------------------------------------------------------


@query("s3_s4_w4_text_blocks", r"""WITH l AS (SELECT doc_id, unnest(string_split(replace(text, '. ', E'.\n \n'), chr(10))) AS line, generate_subscripts(string_split(replace(text, '. ', E'.\n \n'), chr(10)), 1) AS n FROM documents),
  b AS (SELECT *, count(*) FILTER (WHERE trim(line) = '') OVER (PARTITION BY doc_id ORDER BY n) AS blanks FROM l),
  g AS (SELECT doc_id, blanks, string_agg(line, chr(10) ORDER BY n) AS text, min(n) AS line_start, max(n) AS line_end FROM b WHERE trim(line) <> '' GROUP BY 1, 2)
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY line_start) AS ord, md5(text) AS digest, line_start, line_end FROM g""")
def s4(spark, sf):
    from ..sources.files import text_blocks_native

    texts = read(spark, sf, "documents").select(F.col("doc_id").alias("document_id"), F.replace("text", F.lit(". "), F.lit(".\r\n \n")).alias("text"))
    b = text_blocks_native(texts)
    return b.select(F.col("document_id").alias("doc_id"), F.col("ord").cast("long").alias("ord"), F.md5("text").alias("digest"), F.col("line_start").cast("long").alias("line_start"), F.col("line_end").cast("long").alias("line_end"))


@query("f4_normalise", r"SELECT doc_id, md5(nfc_normalize(replace(replace(text || E'é\r\nx\r', E'\r\n', E'\n'), E'\r', E'\n'))) AS digest FROM documents")
def f4(spark, sf):
    return read(spark, sf, "documents").select("doc_id", F.md5(T.normalise_content(F.concat("text", F.lit("é\r\nx\r")))).alias("digest"))


@query("f5_f6_content_hash", """SELECT doc_id, sha256('{"content":' || CAST(to_json(text) AS VARCHAR) || ',"source_metadata":{"line_start":1,"source":"' || source || '"}}') AS hash FROM documents""")
def f6(spark, sf):
    meta = F.concat(F.lit('{"source":"'), F.col("source"), F.lit('","line_start":1}'))
    return read(spark, sf, "documents").select("doc_id", I.content_hash(F.col("text"), meta).alias("hash"))


@query("f7_stable_id", """WITH h AS (SELECT l_orderkey, l_linenumber, l_partkey, sha1(unhex('cbd3960d2c2d52e8b4de5f37e8e9dc75') || encode('["idx","doc-' || l_orderkey || '",' || CASE WHEN l_linenumber > 3 THEN 'null' ELSE '"p' || l_linenumber || '"' END || ',' || l_linenumber || ',"' || l_partkey || '"]')) AS d FROM lineitem)
  SELECT l_orderkey, l_linenumber, l_partkey, substr(d, 1, 12) || '5' || substr(d, 14, 3) || substr('89ab', CAST((strpos('0123456789abcdef', substr(d, 17, 1)) - 1) % 4 AS INT) + 1, 1) || substr(d, 18, 15) AS id FROM h""")
def f7(spark, sf):
    parent = F.when(F.col("l_linenumber") <= 3, F.concat(F.lit("p"), F.col("l_linenumber")))
    found = I.stable_segment_id(F.lit("idx"), F.concat(F.lit("doc-"), F.col("l_orderkey")), parent, F.col("l_linenumber"), F.col("l_partkey").cast("string"))
    return read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", found.alias("id"))


@query("f8_config_hash", """SELECT c_custkey, sha256('{"max":' || (c_custkey % 7) || ',"separator":"\\n"}') AS hash FROM customer""")
def f8(spark, sf):
    return read(spark, sf, "customer").select("c_custkey", I.config_hash(F.concat(F.lit('{"max":'), F.col("c_custkey") % 7, F.lit(',"separator":"\\n"}'))).alias("hash"))


@query("f9_j12_fingerprints", """SELECT doc_id, sha256('["sig", "model", 4000, ' || CAST(to_json(text) AS VARCHAR) || ']') AS fingerprint FROM documents WHERE doc_id % 3 > 0""")
def f9(spark, sf):
    rows = read(spark, sf, "documents").select(F.col("doc_id").alias("id"), I.extraction_fingerprint(F.lit("sig"), F.lit("model"), 4000, F.col("text")).alias("fingerprint"))
    return G.remaining_extractions(rows, rows.where("id % 3 = 0")).select(F.col("id").alias("doc_id"), "fingerprint")


@query("f10_f13_entity_id", """SELECT n_nationkey, sha256('idx' || chr(0) || lower(n_name)) AS id FROM nation""")
def f10(spark, sf):
    return read(spark, sf, "nation").select("n_nationkey", I.entity_id(F.lit("idx"), F.col("n_name")).alias("id"))


@query("f15_f16_safe_names", r"""SELECT page_id, substr('kb_' || regexp_replace(url, '[^0-9A-Za-z_]', '_', 'g'), 1, 255) AS collection,
  coalesce(nullif(regexp_replace(regexp_replace(regexp_extract(url, '([^/\\]*)$', 1), '[^A-Za-z0-9_. -]', '_', 'g'), '^[. ]+|[. ]+$', '', 'g'), ''), 'file') AS filename FROM pages""")
def f15(spark, sf):
    return read(spark, sf, "pages").select("page_id", T.safe_collection(F.col("url")).alias("collection"), T.safe_filename(F.col("url")).alias("filename"))


@query("f17_ocr_text", r"SELECT conv_id, turn, trim(regexp_replace(text, '\s+', ' ', 'g')) AS text FROM conversations")
def f17(spark, sf):
    noisy = F.concat(F.lit("​ \x07"), F.col("text"), F.lit("\t \x00"))
    return read(spark, sf, "conversations").select("conv_id", "turn", T.normalise_ocr(noisy).alias("text"))


@query("f18_pdf_paragraphs", r"""SELECT doc_id, md5(trim(regexp_replace(replace(replace(regexp_replace(text, E'[ \\t]*\\n[ \\t]*', E'\n', 'g'), E'-\n', ''), E'\n', ' '), '[ \t]+', ' ', 'g'))) AS digest, 1 AS paragraphs FROM documents""")
def f18(spark, sf):
    p = T.pdf_paragraphs(F.col("text"))
    return read(spark, sf, "documents").select("doc_id", F.md5(F.array_join(p, "|")).alias("digest"), F.size(p).alias("paragraphs"))


@query("f19_f20_f21_lengths", "SELECT doc_id, trim(text) = '' AS blank, length(text) AS n, sha256(text) AS digest FROM documents")
def f19(spark, sf):
    return read(spark, sf, "documents").select("doc_id", T.is_blank(F.col("text")).alias("blank"), F.length("text").cast("long").alias("n"), F.sha2("text", 256).alias("digest"))


@query("f22_suffix", r"SELECT page_id, lower(regexp_extract(url, '[^./\\](\.[^./\\]*)$', 1)) AS suffix FROM pages")
def f22(spark, sf):
    return read(spark, sf, "pages").select("page_id", T.suffix(F.col("url")).alias("suffix"))


@query("f24_f25_minutes", """SELECT p_partkey, p_size + p_size % 7 AS minutes, CASE p_size % 6 WHEN 0 THEN 0 ELSE p_size % 6 END AS level FROM part""")
def f24(spark, sf):
    s = F.col("p_size")
    stars = F.element_at(F.array(*map(F.lit, ("?", "一星", "二星", "三星", "四星", "五星"))), s % 6 + 1)
    total = T.total_minutes(F.concat(s.cast("string"), F.lit("分钟左右")), F.concat((s % 7).cast("string"), F.lit("分钟")))
    return read(spark, sf, "part").select("p_partkey", total.alias("minutes"), T.difficulty_level(stars).alias("level"))


@query("f26_embedding_text", "SELECT p_partkey, p_name || ' ' || p_brand || ' ' AS text FROM part")
def f26(spark, sf):
    return read(spark, sf, "part").select("p_partkey", T.embedding_text(F.col("p_name"), F.col("p_brand"), F.lit(None).cast("string")).alias("text"))


@query("f30_flatten_attributes", "SELECT p_partkey, 'brand: ' || p_brand || '|size: ' || p_size AS attributes FROM part")
def f30(spark, sf):
    m = F.create_map(F.lit("brand"), F.col("p_brand"), F.lit("size"), F.col("p_size").cast("string"))
    return read(spark, sf, "part").select("p_partkey", F.array_join(I.flatten_attributes(m), "|").alias("attributes"))


# --- segmentation -----------------------------------------------------------------------------------------------


@query("f1_hard_ranges", """WITH RECURSIVE r AS (SELECT doc_id, length(text) AS n, 0 AS position, 0 AS start FROM documents WHERE length(text) > 0
  UNION ALL SELECT doc_id, n, position + 1, start + 180 FROM r WHERE start + 200 < n)
  SELECT doc_id, CAST(position AS BIGINT) AS position, CAST(start AS BIGINT) AS start, CAST(least(n, start + 200) AS BIGINT) AS "end" FROM r""")
def f1_hard(spark, sf):
    t = read(spark, sf, "documents").select(F.col("doc_id").alias("document_id"), "text")
    return S.hard_ranges(t, 200, 20).select(F.col("document_id").alias("doc_id"), *[F.col(c).cast("long").alias(c) for c in ("position", "start", "end")])


#: str.isspace as a class, and F1's boundary classes for the separator "\\n", each up to its rightmost mark.
_BLANK = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_MARKED = "".join(f"WHEN length(regexp_extract(w, '(?s)^.*{m}')) > lead THEN length(regexp_extract(w, '(?s)^.*{m}')) " for m in (r"\n", r"\n\n", "[。！？；]", "[.!?;]", r"[ \t]"))


@query("f1_boundary_ranges", f"""WITH RECURSIVE t AS (SELECT doc_id, text, length(text) AS n FROM documents WHERE length(text) > 0),
  r AS (SELECT doc_id, n, CAST(NULL AS BIGINT) AS s, CAST(50 AS BIGINT) AS e FROM t
  UNION ALL SELECT doc_id, n, s, CASE WHEN s + 500 >= n THEN n WHEN mark - 50 >= 225 THEN s + mark ELSE s + 500 END
    FROM (SELECT *, CASE {_MARKED} END AS mark FROM (SELECT *, length(regexp_extract(w, '^[{_BLANK}]*')) AS lead
      FROM (SELECT r.doc_id, r.n, r.e - 50 AS s, substr(t.text, r.e - 49, 500) AS w FROM r JOIN t USING (doc_id) WHERE r.s IS NULL OR r.e < r.n))))
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY s) - 1 AS position, s AS start, e AS "end", sha256(content) AS digest
  FROM (SELECT r.doc_id, s, e, substr(text, s + 1, e - s) AS content FROM r JOIN t USING (doc_id) WHERE s IS NOT NULL) WHERE regexp_matches(content, '[^{_BLANK}]')""")
def f1_boundaries(spark, sf):
    texts = read(spark, sf, "documents").select(F.col("doc_id").alias("document_id"), "text")
    found = L.cut_texts(texts, S.Config(max_length=500, overlap=50))
    return found.select(F.col("document_id").alias("doc_id"), "position", "start", "end", F.sha2("content", 256).alias("digest"))


def _blocks(spark, sf) -> DataFrame:
    block = F.struct(F.lit(0).alias("ord"), F.lit("paragraph").alias("kind"), F.col("text"), F.lit('{"line_start": 1}').alias("meta"))
    return read(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("document_id"), F.lit("text").alias("source_type"), F.array(block).alias("blocks"))


@query("f1_reconstruction", "SELECT CAST(doc_id AS VARCHAR) AS document_id, md5(text) AS digest, length(text) AS n FROM documents WHERE trim(text) <> ''")
def f1_rebuilt(spark, sf):
    found = S.segment_documents(_blocks(spark, sf), S.Config(max_length=500, overlap=0)).where("error is null")
    parts = F.array_sort(F.collect_list(F.struct("position", "content")))
    whole = found.groupBy("document_id").agg(F.array_join(F.transform(parts, lambda x: x["content"]), "").alias("t"))
    return whole.select("document_id", F.md5("t").alias("digest"), F.length("t").cast("long").alias("n"))


@query("f1_a9_general")
def f1_general(spark, sf):
    """Segments of every document with 1,024 characters and 100 of overlap."""
    return S.segment_documents(_blocks(spark, sf), S.Config()).drop("warning")


@query("f1_d27_parent_child")
def f1_parents(spark, sf):
    """Parents and children of every document in full-document mode, with the bounded fallback."""
    return S.segment_documents(_blocks(spark, sf), S.Config("parent_child", parent_mode="full_document", parent_length=2000, child_length=400, child_overlap=40))


# --- tables -----------------------------------------------------------------------------------------------------


@query("p4_headers", """SELECT p_partkey, '列1|' || p_brand || '|' || p_brand || '_2|' || p_brand || '_3|列5' AS headers FROM part""")
def p4(spark, sf):
    values = F.array(F.lit(None).cast("string"), F.col("p_brand"), F.col("p_brand"), F.concat("p_brand", F.lit(" ")), F.lit("  "))
    return read(spark, sf, "part").select("p_partkey", F.array_join(B.unique_headers_column(values), "|").alias("headers"))


@query("p6_cell_text", """SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day, CASE WHEN o_orderkey % 2 = 0 THEN 'true' ELSE 'false' END AS flag, CAST(o_custkey AS VARCHAR) AS number FROM orders""")
def p6(spark, sf):
    return read(spark, sf, "orders").select("o_orderkey", B.cell_text_column(F.col("o_orderdate"), "timestamp").alias("day"), B.cell_text_column(F.col("o_orderkey") % 2 == 0, "boolean").alias("flag"), B.cell_text_column(F.col("o_custkey").cast("double"), "double").alias("number"))


@query("p7_row_text", "SELECT p_partkey, 'name：' || p_name || '；size：' || p_size AS text FROM part")
def p7(spark, sf):
    values = F.array(F.col("p_name"), F.lit(None).cast("string"), F.concat(F.lit(" "), F.col("p_size").cast("string")))
    return read(spark, sf, "part").select("p_partkey", B.row_text_column(F.array(*map(F.lit, ("name", "none", "size"))), values).alias("text"))


@query("p5_p8_table_blocks", """WITH r AS (SELECT p_brand AS sheet, p_partkey AS n, p_name, p_type FROM part WHERE p_partkey % 5 > 0), h AS (SELECT sheet, arg_min(p_name, n) AS h1, arg_min(p_type, n) AS h2, min(n) AS first FROM r GROUP BY 1)
  SELECT r.sheet, r.n AS "row", h1 || '：' || p_name || '；' || CASE WHEN h2 = h1 THEN h2 || '_2' ELSE h2 END || '：' || p_type AS text FROM r JOIN h USING (sheet) WHERE n > first""")
def p8(spark, sf):
    p = read(spark, sf, "part")
    blank = F.array(F.lit(None).cast("string"), F.lit(" "))
    cells = p.select(F.col("p_brand").alias("sheet"), F.col("p_partkey").alias("row"), F.when(F.col("p_partkey") % 5 == 0, blank).otherwise(F.array("p_name", "p_type", F.lit(None).cast("string"))).alias("values"))
    return B.tables_to_blocks(cells).select("sheet", "row", "text")


@query("p9_row_groups", """WITH r AS (SELECT DISTINCT l_suppkey AS sheet, l_partkey AS n FROM lineitem), g AS (SELECT *, n - row_number() OVER (PARTITION BY sheet ORDER BY n) AS k FROM r)
  SELECT sheet, min(n) AS first_row, max(n) AS last_row, count(*) AS rows FROM g GROUP BY sheet, k""")
def p9(spark, sf):
    rows = read(spark, sf, "lineitem").select(F.col("l_suppkey").alias("sheet"), F.col("l_partkey").alias("row"))
    return B.grouped_rows(dealt(rows, "sheet").distinct(), tasks=1)


# --- OCR and warnings ---------------------------------------------------------------------------------------------


def _lines(spark, sf) -> DataFrame:
    """Conversation turns as recognised lines: three pages a conversation, boxes 10 high and 12 apart, a wider gap before every fourth."""
    t = F.col("turn")
    top = t * 12 + F.floor(t / 4) * 30
    box = F.array(F.array(F.lit(0.0), top.cast("double")), F.array(F.lit(9.0), (top + 10).cast("double")))
    text = F.when(t < 3, F.lit("Running head")).otherwise(F.col("text"))
    return read(spark, sf, "conversations").select(F.col("conv_id").alias("doc"), (t % 3).alias("page"), t.alias("ord"), text.alias("text"), (1 - (t % 7) / 10).alias("confidence"), box.alias("box"))


LINES_SQL = r"""l AS (SELECT conv_id AS doc, turn % 3 AS page, turn AS ord, trim(regexp_replace(CASE WHEN turn < 3 THEN 'Running head' ELSE text END, '\s+', ' ', 'g')) AS text, 1 - (turn % 7) / 10 AS confidence,
    turn * 12 + (turn // 4) * 30 AS top, turn * 12 + (turn // 4) * 30 + 10 AS bottom FROM conversations)"""
KEPT_SQL = f"""{LINES_SQL}, n AS (SELECT * FROM l WHERE text <> '' AND NOT regexp_full_match(text, '[\\p{{P}}\\s]+') AND confidence >= 0.5),
  m AS (SELECT *, ord = min(ord) OVER (PARTITION BY doc, page) OR ord = max(ord) OVER (PARTITION BY doc, page) AS edge FROM n),
  kept AS (SELECT * FROM m WHERE NOT (edge AND text = 'Running head'))"""


def _repeated(spark, sf) -> DataFrame:
    return _lines(spark, sf).select("doc", "page").distinct().withColumn("text", F.lit("Running  head"))


@query("p12_w6_s13_ocr_lines", f"WITH {KEPT_SQL} SELECT doc, page, ord, text FROM kept")
def p12(spark, sf):
    return O.kept_lines(O.adapt_lines(_lines(spark, sf)), _repeated(spark, sf)).select("doc", "page", "ord", F.trim(T.normalise_ocr(F.col("text"))).alias("text"))


@query("a10_ocr_paragraphs", f"""WITH {KEPT_SQL}, j AS (SELECT *, CASE WHEN top - lag(bottom) OVER (PARTITION BY doc, page ORDER BY ord) > 7.5 THEN 1 ELSE 0 END AS jump FROM kept),
  p AS (SELECT *, sum(jump) OVER (PARTITION BY doc, page ORDER BY ord) AS paragraph FROM j)
  SELECT doc, page, CAST(paragraph AS BIGINT) AS paragraph, string_agg(text, ' ' ORDER BY ord) AS text, round(avg(confidence), 4) AS confidence, count(*) AS boxes FROM p GROUP BY 1, 2, 3""")
def a10(spark, sf):
    kept = O.kept_lines(_lines(spark, sf), _repeated(spark, sf)).withColumn("text", T.normalise_ocr(F.col("text")))
    return O.paragraphs(kept).withColumns({"paragraph": F.col("paragraph").cast("long"), "boxes": F.col("boxes").cast("long")})


@query("a11_page_furniture", f"""WITH {LINES_SQL}, e AS (SELECT *, ord = min(ord) OVER (PARTITION BY doc, page) OR ord = max(ord) OVER (PARTITION BY doc, page) AS edge FROM l),
  f AS (SELECT DISTINCT doc, page, text FROM e WHERE edge AND text <> '' AND length(text) <= 80 AND (bottom <= 50 OR top >= 450)),
  o AS (SELECT doc, text FROM f GROUP BY 1, 2 HAVING count(*) >= 2) SELECT doc, page, text FROM f JOIN o USING (doc, text)""")
def a11(spark, sf):
    lines = _lines(spark, sf)
    return O.repeated_furniture(lines, lines.select("doc", "page").distinct().withColumn("height", F.lit(500.0)))


@query("p21_bounded_warnings", """WITH w AS (SELECT l_orderkey AS doc, l_partkey * 10 + l_linenumber AS ord, CASE WHEN l_suppkey % 9 = 0 THEN 'WARNINGS_TRUNCATED' ELSE 'W' || l_linenumber END AS code, CASE WHEN l_suppkey % 9 = 0 THEN l_linenumber - 1 END AS omitted FROM lineitem),
  p AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY ord, code) AS n FROM w WHERE code <> 'WARNINGS_TRUNCATED'),
  lost AS (SELECT doc, 1 AS k FROM p WHERE n >= 3 UNION ALL SELECT doc, CASE WHEN omitted > 0 THEN omitted ELSE 1 END FROM w WHERE code = 'WARNINGS_TRUNCATED')
  SELECT doc, ord, code, CAST(NULL AS BIGINT) AS omitted FROM p WHERE n < 3 UNION ALL SELECT doc, 2147483647, 'WARNINGS_TRUNCATED', CAST(sum(k) AS BIGINT) FROM lost GROUP BY 1""")
def p21(spark, sf):
    n = F.col("l_linenumber")
    summary = F.col("l_suppkey") % 9 == 0
    w = read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("doc"), (F.col("l_partkey") * 10 + n).alias("ord"), F.when(summary, "WARNINGS_TRUNCATED").otherwise(F.concat(F.lit("W"), n)).alias("code"), F.when(summary, n - 1).alias("omitted"))
    return O.bounded_warnings(w, 3)


# --- graph ------------------------------------------------------------------------------------------------------


def _payloads(spark, sf) -> DataFrame:
    """Suppliers as segments: their text names their nation; the payload also claims things that the text doesn't hold."""
    s, n = read(spark, sf, "supplier"), read(spark, sf, "nation")
    attributes = F.create_map(F.lit(" key "), F.lit(" v "), F.lit("empty"), F.lit(" "))
    entity = lambda name, kind: F.struct(name.alias("name"), F.lit(kind).alias("type"), attributes.alias("attributes"))
    relation = lambda a, b, t: F.struct(a.alias("source"), b.alias("target"), F.lit(t).alias("type"))
    nation, name = F.concat(F.lit(" "), F.col("n_name")), F.col("s_name")
    return s.join(F.broadcast(n), s["s_nationkey"] == n["n_nationkey"]).select(
        F.col("s_suppkey").alias("segment_id"), F.concat(F.lower("s_name"), F.lit(" is of "), F.lower("n_name")).alias("text"),
        F.array(entity(nation, "nation"), entity(name, "supplier"), entity(F.lit("Atlantis"), "nation"), entity(F.col("n_name"), "again"), entity(F.lit(" "), "x")).alias("entities"),
        F.array(relation(name, nation, "in"), relation(name, nation, "in "), relation(name, F.lit("Atlantis"), "in"), relation(nation, name, " ")).alias("relations"),
    )


@query("p10_grounded_entities", "SELECT s_suppkey AS segment_id, n_name AS name, 'nation' AS type, 'key=v' AS attributes FROM supplier JOIN nation ON s_nationkey = n_nationkey UNION ALL SELECT s_suppkey, s_name, 'supplier', 'key=v' FROM supplier")
def p10(spark, sf):
    e = G.grounded_entities(_payloads(spark, sf))
    return e.select("segment_id", "name", "type", F.array_join(F.transform("attributes", lambda x: F.concat(x["key"], F.lit("="), x["value"])), ",").alias("attributes"))


@query("p11_valid_relations", "SELECT s_suppkey AS segment_id, s_name AS source, n_name AS target, 'in' AS type FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def p11(spark, sf):
    p = _payloads(spark, sf)
    return G.valid_relations(p, G.grounded_entities(p))


def _graph(spark, sf) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Entities: nations; related: nations of one region in key order; mentions: suppliers mention their nation."""
    n = read(spark, sf, "nation")
    entities = n.select(F.col("n_nationkey").alias("entity_id"), F.col("n_name").alias("name"))
    following = F.lead("n_nationkey").over(Window.partitionBy("n_regionkey").orderBy("n_nationkey"))
    related = n.select(F.col("n_nationkey").alias("source_id"), following.alias("target_id")).where("target_id is not null")
    mentions = read(spark, sf, "supplier").select(F.col("s_suppkey").alias("segment_id"), F.col("s_nationkey").alias("entity_id"), (F.col("s_suppkey") % 10).alias("document_id"))
    return entities, related, mentions


GRAPH_SQL = """rel AS (SELECT n_nationkey AS a, lead(n_nationkey) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS b FROM nation),
seeds AS (SELECT n_nationkey AS id FROM nation WHERE length(n_name) >= 2 AND contains(lower((SELECT string_agg(n_name, ' and ' ORDER BY n_nationkey) FROM nation WHERE n_nationkey IN (3, 7))), lower(n_name)))"""


def _question(spark, sf) -> str:
    rows = read(spark, sf, "nation").where("n_nationkey in (3, 7)").orderBy("n_nationkey").collect()
    return " AND ".join(r["n_name"] for r in rows)


@query("j10_mentioned_entities", f"WITH {GRAPH_SQL} SELECT id AS entity_id FROM seeds")
def j10(spark, sf):
    return G.mentioned_entities(_graph(spark, sf)[0], _question(spark, sf)).select("entity_id")


@query("j10_turn_mentions", r"""WITH names AS (SELECT min(doc_id) AS entity_id, name FROM (SELECT doc_id, regexp_extract(lower(text), '^[^a-z]*[a-z]+[^a-z]+([a-z]+)', 1) AS name FROM documents) WHERE name <> '' GROUP BY name)
  SELECT conv_id, turn, entity_id FROM conversations JOIN names ON contains(lower(text), name) WHERE length(name) >= 2""")
def j10_turns(spark, sf):
    """Every conversation turn against the second word of every document as entity names."""
    from ..operators.mentions import mentions

    name = F.regexp_extract(F.lower("text"), "^[^a-z]*[a-z]+[^a-z]+([a-z]+)", 1).alias("name")
    entities = read(spark, sf, "documents").select("doc_id", name).where("name <> ''").groupBy("name").agg(F.min("doc_id").alias("entity_id"))
    return mentions(read(spark, sf, "conversations").select("conv_id", "turn", "text"), entities)


@query("j11_o11_r4_graph_hits", f"""WITH {GRAPH_SQL}, reach AS (SELECT id FROM seeds UNION SELECT b FROM rel WHERE a IN (SELECT id FROM seeds) AND b IS NOT NULL UNION SELECT a FROM rel WHERE b IN (SELECT id FROM seeds))
  SELECT DISTINCT s_suppkey AS id, CAST(1 AS DOUBLE) AS score FROM supplier WHERE s_nationkey IN (SELECT id FROM reach) ORDER BY id LIMIT 20""")
def j11(spark, sf):
    entities, related, mentions = _graph(spark, sf)
    return G.graph_hits(G.mentioned_entities(entities, _question(spark, sf)), related, mentions, 20)


@query("j13_orphan_entities", "SELECT n_nationkey AS entity_id FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_suppkey % 4 = 0)")
def j13(spark, sf):
    entities, _, mentions = _graph(spark, sf)
    return G.orphan_entities(entities, mentions.where("segment_id % 4 = 0")).select("entity_id")


@query("j14_exclusive_entities", """SELECT DISTINCT s_nationkey AS entity_id FROM supplier a WHERE s_suppkey % 10 IN (1, 2, 3) AND NOT EXISTS (SELECT 1 FROM supplier b WHERE b.s_nationkey = a.s_nationkey AND b.s_suppkey % 10 NOT IN (1, 2, 3))""")
def j14(spark, sf):
    mentions = _graph(spark, sf)[2]
    return G.exclusive_entities(mentions, mentions.where("document_id in (1, 2, 3)").select("document_id"))


@query("m10_graph_upsert", """WITH o AS (SELECT s_suppkey AS segment_id, s_nationkey AS entity_id FROM supplier), n AS (SELECT s_suppkey AS segment_id, (s_nationkey + 1) % 25 AS entity_id FROM supplier WHERE s_suppkey % 3 = 0)
  SELECT DISTINCT segment_id, entity_id FROM (SELECT * FROM o WHERE segment_id % 3 > 0 UNION ALL SELECT * FROM n)""")
def m10(spark, sf):
    entities, related, mentions = _graph(spark, sf)
    m = mentions.select("segment_id", "entity_id")
    named = entities.withColumn("type", F.lit("nation"))
    none = spark.createDataFrame([], "segment_id long, source_id int, target_id int, type string")
    old = {"segments": m.select("segment_id").distinct(), "mentions": m, "related": none, "entities": named}
    fresh = m.where("segment_id % 3 = 0").select("segment_id", ((F.col("entity_id") + 1) % 25).alias("entity_id"))
    new = {"segments": fresh.select("segment_id").distinct(), "mentions": fresh, "related": none, "entities": named.where("entity_id < 5")}
    return G.upsert_facts(old, new)["mentions"]


@query("d20_duplicate_ids", "SELECT l_orderkey * 10 + l_linenumber AS id, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) > 1")
def d20(spark, sf):
    return G.duplicate_ids(read(spark, sf, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id")), "id")


def _nodes(spark, sf) -> DataFrame:
    return read(spark, sf, "part").select(F.col("p_partkey").alias("nodeId"), F.col("p_type").alias("label"), F.col("p_brand").alias("category"), F.col("p_size").alias("size"))


@query("j15_similar_pairs", """SELECT category, label, a, b FROM (SELECT x.p_brand AS category, x.p_type AS label, x.p_partkey AS a, y.p_partkey AS b FROM part x JOIN part y ON x.p_brand = y.p_brand AND x.p_type = y.p_type AND x.p_partkey <> y.p_partkey) ORDER BY category, label, a, b LIMIT 1000""")
def j15(spark, sf):
    return G.pairs_with_equal(_nodes(spark, sf), "category", also=("label",))


@query("j17_same_tool", "SELECT size, a, b FROM (SELECT x.p_size AS size, x.p_partkey AS a, y.p_partkey AS b FROM part x JOIN part y ON x.p_size = y.p_size AND x.p_partkey <> y.p_partkey) ORDER BY size, a, b LIMIT 1000")
def j17(spark, sf):
    return G.pairs_with_equal(_nodes(spark, sf), "size")


@query("j16_next_steps", "SELECT DISTINCT x.l_orderkey AS recipe, x.l_linenumber AS a, y.l_linenumber AS b FROM lineitem x JOIN lineitem y ON x.l_orderkey = y.l_orderkey AND y.l_linenumber = x.l_linenumber + 1")
def j16(spark, sf):
    steps = read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("recipe"), F.col("l_linenumber").alias("nodeId"), F.col("l_linenumber").alias("step")).distinct()
    return G.next_steps(steps)


@query("j18_difficulty", "SELECT p_partkey AS nodeId, CAST(p_size AS INT) AS level, r_name AS name FROM part JOIN region ON r_regionkey = CAST(p_size AS INT)")
def j18(spark, sf):
    recipes = read(spark, sf, "part").select(F.col("p_partkey").alias("nodeId"), (F.col("p_size") + 0.5).alias("difficulty"))
    levels = read(spark, sf, "region").select(F.col("r_regionkey").alias("level"), F.col("r_name").alias("name"))
    return G.difficulty_edges(recipes, F.broadcast(levels)).select("nodeId", "level", "name")


@query("a16_a19_label_histogram", "SELECT p_type AS label, count(*) AS n FROM part WHERE p_type NOT LIKE '%ZZZ%' GROUP BY 1")
def a16(spark, sf):
    return G.label_histogram(_nodes(spark, sf))


@query("a17_edge_histogram", "SELECT l_returnflag || l_linestatus AS type, count(*) AS n FROM lineitem GROUP BY 1")
def a17(spark, sf):
    return G.edge_histogram(read(spark, sf, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("type")))


@query("a18_j19_degrees", "SELECT o_orderkey AS nodeId, count(l_orderkey) AS steps FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_linenumber > 4 GROUP BY 1")
def a18(spark, sf):
    nodes = read(spark, sf, "orders").select(F.col("o_orderkey").alias("nodeId"))
    return G.degree(nodes, read(spark, sf, "lineitem").where("l_linenumber > 4").select(F.col("l_orderkey").alias("nodeId")), "steps")


@query("s19_d23_nodes", """SELECT CAST(p_partkey * 1000000 AS VARCHAR) AS nodeId, p_name AS name, CAST(p_partkey * 1000000 AS VARCHAR) < '200000000' AS is_hierarchy, p_size % 3 = 2 AS has_synonyms FROM part WHERE p_size % 5 > 0""")
def s19(spark, sf):
    rows = read(spark, sf, "part").select((F.col("p_partkey") * 1_000_000).cast("string").alias("nodeId"), F.when(F.col("p_size") % 5 > 0, F.col("p_name")).alias("name"), F.element_at(F.array(F.lit(""), F.lit("[]"), F.lit("x")), F.col("p_size") % 3 + 1).alias("synonyms"))
    return G.load_nodes(rows).select("nodeId", "name", "is_hierarchy", "has_synonyms")


@query("s20_edges", """SELECT l_orderkey AS startNodeId, l_partkey AS endNodeId, CASE l_linenumber WHEN 1 THEN 'REQUIRES' WHEN 3 THEN 'CONTAINS_STEP' WHEN 4 THEN 'BELONGS_TO_CATEGORY' ELSE 'HAS_DIFFICULTY_LEVEL' END AS type,
  CASE WHEN l_suppkey % 2 = 0 THEN CAST(l_linenumber AS DOUBLE) END AS step_order FROM lineitem WHERE l_linenumber IN (1, 3, 4, 5) AND l_orderkey IN (SELECT p_partkey FROM part WHERE p_partkey % 2 = 1) AND l_partkey IN (SELECT p_partkey FROM part WHERE p_partkey % 2 = 1)""")
def s20(spark, sf):
    nodes = read(spark, sf, "part").where("p_partkey % 2 = 1").select(F.col("p_partkey").alias("nodeId"))
    n = F.col("l_linenumber")
    rows = read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("startNodeId"), F.col("l_partkey").alias("endNodeId"), F.concat(F.lit("80100000"), n).alias("relationshipType"), F.when(F.col("l_suppkey") % 2 == 0, n.cast("string")).otherwise("soon").alias("step_order"))
    return G.load_edges(rows, nodes).select("startNodeId", "endNodeId", "type", "step_order")


@query("d22_f23_category_edges", """SELECT DISTINCT p_partkey AS nodeId, trim(c) AS category FROM (SELECT p_partkey, unnest(string_split(p_brand || ', ' || p_type || ',,' || p_brand, ',')) AS c FROM part) WHERE trim(c) <> ''""")
def d22(spark, sf):
    rows = read(spark, sf, "part").select(F.col("p_partkey").alias("nodeId"), F.concat_ws(",", "p_brand", F.concat(F.lit(" "), F.col("p_type")), F.lit(""), "p_brand").alias("category"))
    return G.category_edges(rows)


@query("d22_concept_types", "SELECT DISTINCT p_type AS conceptType FROM part WHERE p_partkey % 7 > 0")
def d22_types(spark, sf):
    return G.concept_types(read(spark, sf, "part").select(F.when(F.col("p_partkey") % 7 > 0, F.col("p_type")).otherwise("").alias("conceptType")))


# --- sources, guards, streams --------------------------------------------------------------------------------------


@query("s1_s5_parse_files")
def s1(spark, sf):
    """Every document as a file of three kinds, parsed to blocks."""
    from ..sources.files import parse_files

    k = F.col("doc_id") % 3
    name = F.concat(F.col("doc_id").cast("string"), F.element_at(F.array(*map(F.lit, (".txt", ".md", ".csv"))), (k + 1).cast("int")))
    body = F.when(k == 1, F.concat(F.lit("# Title\n\n"), F.col("text"))).when(k == 2, F.concat(F.lit("id,source,text\n"), F.col("doc_id"), F.lit(","), F.col("source"), F.lit(',"'), F.replace(F.col("text"), F.lit('"'), F.lit('""')), F.lit('"\n'))).otherwise(F.col("text"))
    files = read(spark, sf, "documents").select(F.col("doc_id"), name.alias("name"), F.encode(body, "UTF-8").alias("content"))
    return parse_files(files, "doc_id", "name").drop("metadata", "warnings")


@query("s16_upload_codes", """SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'INVALID_FILE_SIGNATURE' WHEN 2 THEN 'UNSUPPORTED_FILE_TYPE' ELSE 'BINARY_TEXT_CONTENT' END AS code, sha256(CASE WHEN doc_id % 4 = 3 THEN repeat(chr(1), 3) || 'abcd' ELSE text END) AS digest FROM documents""")
def s16(spark, sf):
    from ..sources.decode import upload_code

    k = F.col("doc_id") % 4
    suffix = F.element_at(F.array(*map(F.lit, (".txt", ".pdf", ".exe", ".md"))), (k + 1).cast("int"))
    content = F.encode(F.when(k == 3, F.lit("\x01\x01\x01abcd")).otherwise(F.col("text")), "UTF-8")
    return read(spark, sf, "documents").select("doc_id", upload_code(suffix, content).alias("code"), F.sha2(content, 256).alias("digest"))


@query("s15_s21_versioned_store", "SELECT source, count(*) AS n FROM documents GROUP BY 1")
def s15(spark, sf):
    from ..sources.store import commit, current
    from ..streaming.ingest import shared_folder

    root = shared_folder(spark, "store")
    counts = read(spark, sf, "documents").groupBy("source").agg(F.count("*").alias("n"))
    commit(counts.limit(1), root)
    commit(counts, root)
    return current(spark, root)


@query("d10_command_violations", """SELECT c_custkey AS id, CASE WHEN c_custkey % 5 = 0 THEN 'INVALID_IDENTIFIER' WHEN c_custkey % 3 = 0 AND c_custkey % 2 = 0 THEN 'ECONOMY_MODE' WHEN c_custkey % 7 = 0 THEN 'INVALID_BATCH' END AS code FROM customer""")
def d10(spark, sf):
    from ..operators.guards import command_code

    k = F.col("c_custkey")
    rows = read(spark, sf, "customer").select(
        k.alias("id"), F.when(k % 5 == 0, " ").otherwise("d").alias("document_id"), F.when(k % 3 == 0, "economy").otherwise("high_quality").alias("technique"), F.when(k % 2 == 0, "parent_child").otherwise("general").alias("mode"),
        F.when(k % 3 > 0, "model").alias("model"), F.when(k % 7 == 0, 0).otherwise(16).alias("batch"),
    )
    return rows.select("id", command_code().alias("code"))


@query("d12_preview_validation", "SELECT doc_id || ':s-000001' AS chunk_id, doc_id FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id < 20)")
def d12(spark, sf):
    from ..operators.guards import preview_code, preview_ids

    ids = list(range(20)) + [3, 3]
    assert preview_code(ids) is None
    rows = read(spark, sf, "documents").where(F.col("doc_id").isin(*dict.fromkeys(ids)))
    return rows.select(preview_ids(F.col("doc_id"), F.lit("s-000001")).alias("chunk_id"), "doc_id")


@query("d13_schema_check", "SELECT true AS matches, 'dimension 32, expected 64' AS reason")
def d13(spark, sf):
    from ..operators.guards import collection_mismatch

    schema = read(spark, sf, "embeddings").schema
    good, bad = collection_mismatch(schema, schema, 64, 64), collection_mismatch(schema, schema, 32, 64)
    return spark.range(1).select(F.lit(good is None).alias("matches"), F.lit(bad).alias("reason"))


@query("d15_options_catalogue")
def d15(spark, sf):
    """Techniques, modes, defaults and limits, as rows."""
    from ..operators.guards import options_catalogue

    return options_catalogue(spark)


@query("x2_hash_embedder", "SELECT doc_id, 64 AS dimension, true AS unit FROM documents WHERE trim(text) <> ''")
def x2(spark, sf):
    from ..operators.providers import embed

    e = embed(read(spark, sf, "documents").where("trim(text) <> ''"), "text", 64)
    return e.select("doc_id", F.size("embedding").alias("dimension"), (F.abs(V.norm(F.col("embedding")) - 1) < 1e-4).alias("unit"))


@query("t5_t3_stream_ingest", "SELECT doc_id AS id, md5(text) AS digest FROM documents")
def t5(spark, sf):
    from ..streaming.ingest import ingest_available

    return ingest_available(spark, f"{sf}/documents.parquet").select("id", "digest")


@query("t1_stream_leases", """SELECT user_id AS id, count(*) AS beats, max(CAST(value AS BIGINT)) AS progress FROM events GROUP BY 1""")
def t1(spark, sf):
    from ..streaming.leases import progress_available

    return progress_available(spark, f"{sf}/events.parquet")
