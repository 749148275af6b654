"""Registered queries: lexical, dense and late-interaction search, fusion, reranking, evaluation, cases, prompts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scores import d, minmax, sigmoid
from ..functions.text import tokens
from ..operators import bm25, cases, dense, evaluate, fusion, prompts, routing
from ..operators.graph import holders
from ..sources.registry import Registry
from ..sources.shared import dealt, files_digest, shared_dir, spread
from .hybrid import Config, HybridSearch

TOK = "regexp_extract_all(lower(text), '[a-z0-9]+(?:''[a-z0-9]+)?')"


def docs(spark, sf) -> DataFrame:
    return spark.read.parquet(f"{sf}/documents.parquet")


def texts(spark, sf) -> DataFrame:
    """docs() for work on the texts: small files are dealt over all task slots."""
    return spread(docs(spark, sf), "doc_id")


def items(spark, sf) -> DataFrame:
    return spark.read.parquet(f"{sf}/benchmark.parquet").select(F.col("item_id").alias("query_id"), "text")


def vectors(spark, sf) -> DataFrame:
    return spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").alias("doc_id"), "embedding", "label")


BM25 = f"""
t AS (SELECT doc_id, len(toks) AS dl, unnest(toks) AS term FROM (SELECT doc_id, {TOK} AS toks FROM documents)),
post AS (SELECT term, doc_id, CAST(dl AS DOUBLE) AS dl, CAST(count(*) AS DOUBLE) AS tf FROM t GROUP BY term, doc_id, dl),
st AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(CAST(len({TOK}) AS DOUBLE)) AS avgdl FROM documents),
df AS (SELECT term, count(*) AS df FROM post GROUP BY term),
raw AS (SELECT term, df, ln(n - df + 5e-1) - ln(df + 5e-1) AS raw FROM df, st),
terms AS (SELECT term, df, CASE WHEN raw < 0 THEN 25e-2 * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw),
q AS (SELECT query_id, term, CAST(count(*) AS DOUBLE) AS qtf FROM (SELECT item_id AS query_id, unnest({TOK}) AS term FROM benchmark) GROUP BY query_id, term),
sc AS (SELECT query_id, doc_id, sum(qtf * idf * tf * 25e-1 / (tf + 15e-1 * (25e-2 + 75e-2 * dl / avgdl))) AS score
       FROM q JOIN terms USING (term) JOIN post USING (term), st GROUP BY query_id, doc_id),
lex AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM sc) WHERE rank <= 30)"""

DENSE = """
den AS (SELECT * FROM (
  SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank
  FROM (SELECT b.item_id AS query_id, c.vec_id AS doc_id, list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])) AS score
        FROM benchmark b JOIN embeddings a ON a.vec_id = b.item_id, embeddings c)) WHERE rank <= 30)"""

RUNS = f"""{BM25}, {DENSE},
runs AS (SELECT query_id, doc_id, 'bm25' AS channel, score FROM lex UNION ALL SELECT query_id, doc_id, 'dense', score FROM den)"""


def index(spark, sf):
    """The index of the documents: opened if a version for just these files is there, else built as that version. The
    texts are dealt by id first: that shuffles half as much as the postings, which are then counted where they arise."""
    registry, version = Registry(spark, f"{shared_dir(spark)}/quarry/lexical"), files_digest(spark, f"{sf}/documents.parquet")
    return bm25.Index.open(registry, version) if registry.complete(version) else bm25.Index(dealt(docs(spark, sf).select("doc_id", "text"), "doc_id"), registry=registry, version=version)


def bm25_term_stats(spark, sf):
    return index(spark, sf).terms.select("term", "df", F.round("idf", 6).alias("idf"))


def bm25_corpus_stats(spark, sf):
    return index(spark, sf).stats.select("n", F.round("avgdl", 6).alias("avgdl"))


def bm25_topk(spark, sf):
    """The ten best documents of every benchmark passage."""
    return index(spark, sf).search(items(spark, sf), 10).select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


def bm25_incremental(spark, sf):
    """Statistics after an incremental add: some sources are there, then all documents come in twice."""
    d0 = docs(spark, sf).select("doc_id", "text")
    old = d0.where("source <= 'src4'")
    both = bm25.extended(old, d0.unionByName(d0))
    return bm25.Index(both).terms.select("term", "df", F.round("idf", 6).alias("idf"))


def dense_topk(spark, sf):
    """The ten greatest inner products of every vector whose id 50 divides, over all vectors."""
    v = vectors(spark, sf)
    q = v.where("doc_id % 50 = 0").select(F.col("doc_id").alias("query_id"), "embedding")
    return dense.top_inner(q, v, 10).select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


def _runs(spark, sf, k=30):
    q = items(spark, sf)
    v = vectors(spark, sf)
    lex = index(spark, sf).search(q, k).select("query_id", "doc_id", F.lit("bm25").alias("channel"), "score")
    qv = q.select("query_id").join(v.select(F.col("doc_id").alias("query_id"), "embedding"), "query_id")
    den = dense.top_inner(qv, v, k).select("query_id", "doc_id", F.lit("dense").alias("channel"), "score")
    return lex.unionByName(den)


def _fused(method):
    def query(spark, sf):
        f = fusion.fuse(_runs(spark, sf), method)
        return f.select("query_id", "doc_id", F.round("score", 6).alias("score"), F.round("rrf_norm", 6).alias("rrf_norm"), F.round("weighted_sum", 6).alias("weighted_sum"), "rank")

    query.__name__ = f"fuse_{method}"
    return query


def _fuse_ctes(method):
    w = "CASE channel WHEN 'dense' THEN 6e-1 WHEN 'bm25' THEN 4e-1 ELSE 35e-2 END"
    a, b = {"weighted_sum": ("0e0", "1e0"), "rrf": ("1e0", "0e0"), "wrrf": ("1e0", "0e0"), "blend": ("5e-1", "5e-1")}[method]
    return f"""{RUNS},
r1 AS (SELECT *, row_number() OVER (PARTITION BY query_id, channel ORDER BY round(score, 9) DESC, doc_id) AS rk,
              min(score) OVER (PARTITION BY query_id, channel) AS lo, max(score) OVER (PARTITION BY query_id, channel) AS hi, {w} AS w FROM runs),
r2 AS (SELECT *, CASE WHEN hi - lo < 1e-12 THEN 0e0 ELSE (score - lo) / (hi - lo) END AS norm, {"w" if method == "wrrf" else "1e0"} / (60 + rk) AS rrf FROM r1),
g AS (SELECT query_id, doc_id, sum(rrf) AS total, sum(w * norm) AS ws FROM r2 GROUP BY query_id, doc_id),
g2 AS (SELECT *, CASE WHEN max(total) OVER p - min(total) OVER p < 1e-12 THEN 0e0 ELSE (total - min(total) OVER p) / (max(total) OVER p - min(total) OVER p) END AS rn FROM g WINDOW p AS (PARTITION BY query_id)),
f AS (SELECT *, {a} * rn + {b} * ws AS fs FROM g2),
fused AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(fs, 9) DESC, doc_id) AS rank FROM f)"""


def _fuse_sql(method):
    return f"WITH {_fuse_ctes(method)} SELECT query_id, doc_id, round(fs, 6) AS score, round(rn, 6) AS rrf_norm, round(ws, 6) AS weighted_sum, rank FROM fused"


def fuse_contrib(spark, sf):
    c = fusion.contributions(_runs(spark, sf))
    return c.select("query_id", "doc_id", "channel", F.round("contrib", 6).alias("contrib"))


def fuse_channels(spark, sf):
    """Channels of each fused hit by falling contribution."""
    return fusion.fuse(_runs(spark, sf)).select("query_id", "doc_id", F.array_join("channels", ",").alias("channels"))


def merged_channels(spark, sf):
    m = fusion.merged_channels(_runs(spark, sf), ["bm25", "dense", "colbert"])
    return m.select("query_id", "doc_id", *[F.round(c, 6).alias(c) for c in ("bm25", "dense", "colbert")], F.array_join("channels", ",").alias("channels"))


def dedup_keep_best(spark, sf):
    """Lexical and fused hits of each question together: best score, channels and contributions joined."""
    f = fusion.fuse(_runs(spark, sf)).select("query_id", "doc_id", "score", F.col("channels").alias("channel"), "contrib")
    lex = index(spark, sf).search(items(spark, sf), 5).select("query_id", "doc_id", (F.col("score") / d(100)).alias("score"), F.array(F.lit("bm25")).alias("channel"), F.create_map(F.lit("bm25"), F.col("score") / d(100)).alias("contrib"))
    b = fusion.keep_best(f.unionByName(lex))
    return b.select("query_id", "doc_id", F.round("score", 6).alias("score"), F.array_join("channel", ",").alias("channel"), F.round(F.try_element_at("contrib", F.lit("bm25")), 6).alias("bm25"), "rank")


DEDUP_SQL = f"""WITH {_fuse_ctes("blend")},
cc AS (SELECT r2.query_id, r2.doc_id, r2.channel, 5e-1 * f.rn * r2.rrf / f.total + 5e-1 * r2.w * r2.norm AS v, f.fs AS s FROM r2 JOIN f USING (query_id, doc_id)
       UNION ALL SELECT query_id, doc_id, 'bm25', score / 100, score / 100 FROM lex WHERE rank <= 5),
u AS (SELECT query_id, doc_id, channel, sum(v) AS v, max(s) AS s FROM cc GROUP BY query_id, doc_id, channel),
h AS (SELECT query_id, doc_id, max(s) AS s, string_agg(channel, ',' ORDER BY v DESC, channel) AS channel, max(CASE WHEN channel = 'bm25' THEN v END) AS bm25 FROM u GROUP BY query_id, doc_id)
SELECT query_id, doc_id, round(s, 6) AS score, channel, round(bm25, 6) AS bm25, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, doc_id) AS rank FROM h"""


def minmax_norm(spark, sf):
    v = vectors(spark, sf).withColumn("x", F.get("embedding", F.lit(0)).cast("double"))
    return v.select("doc_id", F.round(minmax(F.col("x"), "label"), 6).alias("norm"))


def sigmoid_norm(spark, sf):
    return vectors(spark, sf).select("doc_id", F.round(sigmoid(F.get("embedding", F.lit(0)).cast("double"), 0.5), 6).alias("norm"))


def min_score_filter(spark, sf):
    return fusion.fuse(_runs(spark, sf)).where(F.col("score") >= fusion.LEAST_SCORE).select("query_id", "doc_id", F.round("score", 6).alias("score"))


def rerank_blend(spark, sf):
    """The first ten fused hits rescored by word overlap, the others as they were."""
    f = fusion.fuse(_runs(spark, sf)).select("query_id", "doc_id", "score", "rank").join(docs(spark, sf).select("doc_id"), "doc_id", "left_semi")
    r = fusion.rerank(fusion.reranked_order(f), docs(spark, sf), items(spark, sf), window=10)
    return r.select("query_id", "doc_id", F.round("score", 6).alias("score"), F.round("raw", 6).alias("raw"), "rank")


RERANK_CTES = f"""{_fuse_ctes("blend")},
fd AS (SELECT query_id, doc_id, fs, row_number() OVER (PARTITION BY query_id ORDER BY round(fs, 9) DESC, doc_id) AS rank FROM fused WHERE doc_id IN (SELECT doc_id FROM documents)),
dt AS (SELECT doc_id, list_distinct({TOK}) AS dtok FROM documents),
qt AS (SELECT item_id AS query_id, list_distinct({TOK}) AS qtok FROM benchmark),
h AS (SELECT fd.*, CASE WHEN len(qtok) = 0 THEN 0e0 ELSE len(list_intersect(qtok, dtok)) / CAST(len(qtok) AS DOUBLE) END AS raw FROM fd JOIN dt USING (doc_id) JOIN qt USING (query_id) WHERE rank <= 10),
h2 AS (SELECT *, min(raw) OVER (PARTITION BY query_id) AS lo, max(raw) OVER (PARTITION BY query_id) AS hi FROM h),
h3 AS (SELECT query_id, doc_id, raw, 65e-2 * fs + 35e-2 * CASE WHEN hi - lo < 1e-12 THEN 0e0 ELSE (raw - lo) / (hi - lo) END AS s FROM h2
       UNION ALL SELECT query_id, doc_id, NULL, fs FROM fd WHERE rank > 10)"""
RERANK_SQL = f"WITH {RERANK_CTES} SELECT query_id, doc_id, round(s, 6) AS score, round(raw, 6) AS raw, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, doc_id) AS rank FROM h3"


def hybrid_search(spark, sf):
    """All questions through routing, both channels, fusion, floor, rerank and their own number of hits."""
    v = vectors(spark, sf).select("doc_id", "embedding")
    q = items(spark, sf).join(v.withColumnRenamed("doc_id", "query_id"), "query_id", "left")
    s = HybridSearch(docs(spark, sf), v.join(docs(spark, sf).select("doc_id"), "doc_id", "left_semi"), config=Config(rerank_window=30), index=index(spark, sf))
    return s.search(q, 10).select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank", F.array_join("channels", ",").alias("channels"))


def _contains(t, words):
    return "(" + " OR ".join(f"contains({t}, '{w.lower()}')" for w in words) + ")"


def hybrid_sql():
    from ..functions import rules

    dense_docs = DENSE.replace("embeddings c))", "embeddings c WHERE c.vec_id IN (SELECT doc_id FROM documents)))")
    ctes = _fuse_ctes("blend").replace(DENSE, dense_docs)
    return f"""WITH {ctes},
fl AS (SELECT query_id, doc_id, fs, row_number() OVER (PARTITION BY query_id ORDER BY round(fs, 9) DESC, doc_id) AS rank FROM fused WHERE fs >= 2e-1),
dt AS (SELECT doc_id, list_distinct({TOK}) AS dtok FROM documents),
qt AS (SELECT item_id AS query_id, list_distinct({TOK}) AS qtok,
       CASE WHEN {_contains("lower(trim(text))", rules.BROAD)} AND NOT regexp_matches(text, '(?i)\\barticle\\s+\\d{{1,4}}\\b') THEN 13 ELSE 10 END AS k FROM benchmark),
h AS (SELECT fl.*, CASE WHEN len(qtok) = 0 THEN 0e0 ELSE len(list_intersect(qtok, dtok)) / CAST(len(qtok) AS DOUBLE) END AS raw FROM fl JOIN dt USING (doc_id) JOIN qt USING (query_id) WHERE rank <= 30),
h2 AS (SELECT *, min(raw) OVER (PARTITION BY query_id) AS lo, max(raw) OVER (PARTITION BY query_id) AS hi FROM h),
h3 AS (SELECT query_id, doc_id, 65e-2 * fs + 35e-2 * CASE WHEN hi - lo < 1e-12 THEN 0e0 ELSE (raw - lo) / (hi - lo) END AS s FROM h2
       UNION ALL SELECT query_id, doc_id, fs FROM fl WHERE rank > 30),
h4 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, doc_id) AS rank FROM h3),
ch AS (SELECT query_id, doc_id, string_agg(channel, ',' ORDER BY channel) AS channels FROM runs GROUP BY query_id, doc_id)
SELECT query_id, doc_id, round(s, 6) AS score, rank, channels FROM h4 JOIN qt USING (query_id) JOIN ch USING (query_id, doc_id) WHERE rank <= k"""


def late_interaction(spark, sf):
    """MaxSim of each passage and its ten lexical candidates, over hashed character pairs of their distinct tokens."""
    q, dd = items(spark, sf), docs(spark, sf)
    cand = index(spark, sf).search(q, 10).select("query_id", "doc_id")
    qt = q.select("query_id", F.posexplode(F.array_distinct(tokens("text"))).alias("pos", "tok")).withColumn("qv", dense.char_vector(F.col("tok"))).drop("tok")
    dt = dd.join(cand.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", F.explode(F.array_distinct(tokens("text"))).alias("tok")).withColumn("dv", dense.char_vector(F.col("tok"))).drop("tok")
    s = dense.max_sim(qt, dt, cand, size=8)
    return s.select("query_id", "doc_id", F.round("score", 5).alias("score"))


LATE_SQL = f"""WITH {BM25},
vec AS (SELECT tok, list_transform(range(0, 8), lambda k: CAST(len(list_filter(ps, lambda p: p = k)) AS DOUBLE)) AS v FROM (
  SELECT tok, list_transform(range(1, len(tok) + 2), lambda i: CAST('0x' || left(md5(substring('^' || tok || '$', CAST(i AS BIGINT), 2)), 6) AS BIGINT) % 8) AS ps
  FROM (SELECT DISTINCT unnest({TOK}) AS tok FROM (SELECT text FROM documents UNION ALL SELECT text FROM benchmark)))),
cand AS (SELECT query_id, doc_id FROM lex WHERE rank <= 10),
qd AS (SELECT DISTINCT item_id AS query_id, unnest({TOK}) AS tok FROM benchmark),
dd AS (SELECT DISTINCT doc_id, unnest({TOK}) AS tok FROM documents WHERE doc_id IN (SELECT doc_id FROM cand)),
best AS (SELECT query_id, doc_id, qd.tok, max(list_dot_product(a.v, b.v) / ((sqrt(list_dot_product(a.v, a.v)) + 1e-8) * (sqrt(list_dot_product(b.v, b.v)) + 1e-8))) AS s
         FROM cand JOIN qd USING (query_id) JOIN vec a ON a.tok = qd.tok JOIN dd USING (doc_id) JOIN vec b ON b.tok = dd.tok GROUP BY query_id, doc_id, qd.tok)
SELECT query_id, doc_id, round(sum(s), 5) AS score FROM best GROUP BY query_id, doc_id"""


def _held(spark, sf):
    """(query_id, term, doc_id): documents that hold a passage, found through its rarest whole word in the index."""
    return holders(items(spark, sf).withColumnRenamed("text", "term"), docs(spark, sf), index=index(spark, sf))


def _gold(spark, sf):
    return _held(spark, sf).select("query_id", "doc_id").distinct()


def eval_metrics(spark, sf):
    """Metrics of three systems on the documents that hold each passage."""
    runs = _runs(spark, sf)
    r = fusion.ranked(runs).select(F.col("channel").alias("system"), "query_id", "doc_id", "rank")
    f = fusion.fuse(runs).select(F.lit("hybrid").alias("system"), "query_id", "doc_id", "rank")
    m = evaluate.metrics(r.unionByName(f), _gold(spark, sf), items(spark, sf))
    return m.select("system", "query_id", *[F.round(c, 6).alias(c) for c in m.columns[2:]])


def _eval_ctes():
    cols = []
    for k in (3, 5, 10):
        cols += [
            f"CAST(max(CASE WHEN g.doc_id IS NOT NULL AND rank <= {k} THEN 1 ELSE 0 END) AS DOUBLE) AS hit_{k}",
            f"CASE WHEN max(n_gold) > 0 THEN count(CASE WHEN g.doc_id IS NOT NULL AND rank <= {k} THEN 1 END) / CAST(max(n_gold) AS DOUBLE) ELSE 0e0 END AS recall_{k}",
            f"coalesce(1e0 / min(CASE WHEN g.doc_id IS NOT NULL AND rank <= {k} THEN rank END), 0e0) AS mrr_{k}",
            f"CASE WHEN max(n_gold) > 0 THEN coalesce(sum(CASE WHEN g.doc_id IS NOT NULL AND rank <= {k} THEN 1e0 / log2(rank + 1) END), 0e0) / list_sum(list_transform(range(1, CAST(least(max(n_gold), {k}) AS BIGINT) + 1), lambda i: 1e0 / log2(i + 1))) ELSE 0e0 END AS ndcg_{k}",
        ]
    return f"""{_fuse_ctes("blend")},
gold AS (SELECT item_id AS query_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)),
ng AS (SELECT b.item_id AS query_id, count(g.doc_id) AS n_gold FROM benchmark b LEFT JOIN gold g ON g.query_id = b.item_id GROUP BY b.item_id),
sys AS (SELECT channel AS system, query_id, doc_id, rk AS rank FROM r1 UNION ALL SELECT 'hybrid', query_id, doc_id, rank FROM fused),
allq AS (SELECT s.system, ng.query_id, ng.n_gold FROM (SELECT DISTINCT system FROM sys) s, ng),
m AS (SELECT a.system, a.query_id, {", ".join(cols)} FROM allq a LEFT JOIN sys s ON s.system = a.system AND s.query_id = a.query_id LEFT JOIN gold g ON g.query_id = s.query_id AND g.doc_id = s.doc_id GROUP BY a.system, a.query_id)"""


METRICS = [f"{m}_{k}" for k in (3, 5, 10) for m in ("hit", "recall", "mrr", "ndcg")]


def eval_summary(spark, sf):
    return evaluate.summary(eval_metrics(spark, sf), ["hit_3", "hit_10", "recall_5", "recall_10", "mrr_10", "ndcg_10"])


def eval_summary_sql():
    cs = ["hit_3", "hit_10", "recall_5", "recall_10", "mrr_10", "ndcg_10"]
    inner = ", ".join(f"round({c}, 6) AS {c}" for c in cs)
    return f"WITH {_eval_ctes()}, x AS (SELECT system, {inner} FROM m) SELECT system, count(*) AS n, " + ", ".join(f"round(avg({c}), 3) AS {c}_mean, round(coalesce(stddev_samp({c}), 0), 3) AS {c}_std" for c in cs) + " FROM x GROUP BY system"


def dense_label_eval(spark, sf):
    """Share of each query vector's ten nearest others that have its label."""
    v = vectors(spark, sf)
    q = v.where("doc_id % 50 = 0").select(F.col("doc_id").alias("query_id"), "embedding")
    t = dense.top_inner(q, v, 11).where("query_id <> doc_id").join(v.select("doc_id", F.col("label").alias("dl")), "doc_id").join(v.select(F.col("doc_id").alias("query_id"), F.col("label").alias("ql")), "query_id")
    return t.groupBy("query_id").agg(F.round(F.avg((F.col("dl") == F.col("ql")).cast("double")), 6).alias("share"), F.count("*").alias("n"))


def case_search(spark, sf):
    """Documents as cases: lexical and dense channels, fused, English ones of the sources whose name holds a 1."""
    c = docs(spark, sf).select(F.col("doc_id").alias("id"), "text", F.create_map(F.lit("lang"), F.col("lang"), F.lit("source"), F.col("source")).alias("attrs"))
    v = vectors(spark, sf)
    qv = items(spark, sf).select("query_id").join(v.select(F.col("doc_id").alias("query_id"), "embedding"), "query_id")
    den = dense.top_inner(qv, v, 30).join(c.select(F.col("id").alias("doc_id")), "doc_id", "left_semi").select("query_id", F.col("doc_id").alias("id"), "score")
    r = cases.search(items(spark, sf), c, 10, den, cases.matches({"lang": "en", "source": "1"}))
    return r.select("query_id", "id", F.round("score", 6).alias("score"), "rank")


CASE_SQL = f"""WITH {RUNS},
pos AS (SELECT * FROM runs WHERE (channel = 'dense' AND doc_id IN (SELECT doc_id FROM documents)) OR (channel = 'bm25' AND score > 0)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id, channel ORDER BY round(score, 9) DESC, doc_id) AS rk FROM pos),
s AS (SELECT query_id, doc_id, sum(1e0 / (60 + rk)) AS s FROM r GROUP BY query_id, doc_id),
c AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, doc_id) AS rk FROM s),
k AS (SELECT c.query_id, c.doc_id, c.s FROM c JOIN documents d USING (doc_id) WHERE rk <= 30 AND contains(d.lang, 'en') AND contains(d.source, '1')),
f AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, doc_id) AS rank FROM k)
SELECT query_id, doc_id AS id, round(s, 6) AS score, rank FROM f WHERE rank <= 10"""


def bm25_by_lang(spark, sf):
    """The ten best documents of each passage among those of one language, which its id deals to it."""
    lang = F.get(F.array(*[F.lit(x) for x in ("en", "fr", "de", "es")]), (F.col("query_id") % 4).cast("int"))
    return bm25.search_by_lang(items(spark, sf).withColumn("lang", lang), texts(spark, sf), 10).select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


BY_LANG_SQL = f"""WITH d AS (SELECT doc_id, lang, {TOK} AS toks FROM documents),
t AS (SELECT lang, doc_id, len(toks) AS dl, unnest(toks) AS term FROM d),
post AS (SELECT lang, term, doc_id, CAST(dl AS DOUBLE) AS dl, CAST(count(*) AS DOUBLE) AS tf FROM t GROUP BY lang, term, doc_id, dl),
st AS (SELECT lang, CAST(count(*) AS DOUBLE) AS n, avg(CAST(len(toks) AS DOUBLE)) AS avgdl FROM d GROUP BY lang),
df AS (SELECT lang, term, count(*) AS df FROM post GROUP BY lang, term),
raw AS (SELECT lang, term, ln(n - df + 5e-1) - ln(df + 5e-1) AS raw FROM df JOIN st USING (lang)),
mean AS (SELECT lang, avg(raw) AS mean FROM raw GROUP BY lang),
terms AS (SELECT lang, term, CASE WHEN raw < 0 THEN 25e-2 * mean ELSE raw END AS idf FROM raw JOIN mean USING (lang)),
q AS (SELECT query_id, lang, term, CAST(count(*) AS DOUBLE) AS qtf FROM (SELECT item_id AS query_id, ['en', 'fr', 'de', 'es'][item_id % 4 + 1] AS lang, unnest({TOK}) AS term FROM benchmark) GROUP BY query_id, lang, term),
sc AS (SELECT query_id, doc_id, sum(qtf * idf * tf * 25e-1 / (tf + 15e-1 * (25e-2 + 75e-2 * dl / avgdl))) AS score FROM q JOIN terms USING (lang, term) JOIN post USING (lang, term) JOIN st USING (lang) GROUP BY query_id, doc_id)
SELECT query_id, doc_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM sc) WHERE rank <= 10"""


def bm25_padded(spark, sf):
    """Hits of each passage with a positive score of 20 at least, filled up with documents of score 0 to ten."""
    q = items(spark, sf)
    hits = index(spark, sf).search(q, 10, least=20.0)
    return bm25.padded(hits, q, docs(spark, sf), 10).select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


PADDED_SQL = f"""WITH {BM25},
h AS (SELECT query_id, doc_id, score, 0 AS zero FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS n FROM sc WHERE score > 20) WHERE n <= 10),
z AS (SELECT item_id AS query_id, doc_id, 0e0 AS score, 1 AS zero FROM benchmark, documents WHERE (item_id, doc_id) NOT IN (SELECT query_id, doc_id FROM h))
SELECT query_id, doc_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY zero, round(score, 9) DESC, doc_id) AS rank FROM (SELECT * FROM h UNION ALL SELECT * FROM z)) WHERE rank <= 10"""


def eval_report(spark, sf):
    """Systems by falling recall at ten."""
    return evaluate.report(eval_metrics(spark, sf), ["recall_10", "mrr_10"]).select("system", "place", F.round("recall_10", 6).alias("recall_10"), F.round("mrr_10", 6).alias("mrr_10"))


def hybrid_graph_search(spark, sf):
    """Questions on the meaning of each passage: lexical, dense and late-interaction channels, fusion, a walk over the
    documents' edges from the first hits, rerank. No SQL; a test compares it with a plain model."""
    from .queries_graph import _edges

    v = vectors(spark, sf).select("doc_id", "embedding").join(docs(spark, sf).select("doc_id"), "doc_id", "left_semi")
    q = items(spark, sf).join(v.withColumnRenamed("doc_id", "query_id"), "query_id", "left").withColumn("text", F.concat(F.lit("what is meaning of "), F.col("text")))
    ix = index(spark, sf)
    return graph_search(q, docs(spark, sf), v, _edges(spark, sf), ix).select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank", F.array_join("channels", ",").alias("channels"))


def graph_search(questions: DataFrame, chunks: DataFrame, vecs: DataFrame, edges: DataFrame, ix: bm25.Index, k: int = 10, config: Config | None = None) -> DataFrame:
    """HybridSearch with every channel."""
    return HybridSearch(chunks, vecs, edges, config, ix, late=True).search(questions, k)


def prompt_context(spark, sf):
    hits = index(spark, sf).search(items(spark, sf), 3)
    return prompts.context(hits, docs(spark, sf))


PROMPT_SQL = f"""WITH {BM25}
SELECT query_id, string_agg('[' || rank || '] ' || source || chr(10) || left(trim(regexp_replace(text, '\\s+', ' ', 'g')), 800), chr(10) || chr(10) ORDER BY rank) AS context, CAST(count(*) AS INTEGER) AS n
FROM lex JOIN documents USING (doc_id) WHERE rank <= 3 GROUP BY query_id"""


def answer_degraded(spark, sf):
    p = prompt_context(spark, sf).withColumn("prompt", F.col("context"))
    return prompts.answered(p).select("query_id", "answer", F.length("prompt").alias("prompt_length"))


def hit_preview(spark, sf):
    h = index(spark, sf).search(items(spark, sf), 3).join(docs(spark, sf), "doc_id")
    return h.select("query_id", "doc_id", "rank", F.round("score", 2).alias("score"), prompts.previews("text").alias("preview"), "source", "lang")


def example_choice(spark, sf):
    """The best of four examples for each conversation turn by its route."""
    t = spark.read.parquet(f"{sf}/conversations.parquet").select(F.concat_ws("-", "conv_id", "turn").alias("query_id"), "text")
    q = routing.route(t).withColumn("lang", F.lit("en"))
    ex = spark.createDataFrame([(0, "en", ["judge_style"], "a"), (1, "en", ["other"], "b"), (2, "en", ["risk_alert", "contract_interpretation"], "c"), (3, "zh", ["judge_style"], "d")], "pos int, lang string, tags array<string>, content string")
    return prompts.chosen_examples(q, ex).select("query_id", "example")


QUERIES = {
    "bm25_term_stats": bm25_term_stats,
    "bm25_corpus_stats": bm25_corpus_stats,
    "bm25_topk": bm25_topk,
    "bm25_incremental": bm25_incremental,
    "dense_topk": dense_topk,
    "dense_label_eval": dense_label_eval,
    "late_interaction": late_interaction,
    **{f"fuse_{m}": _fused(m) for m in fusion.METHODS},
    "fuse_contrib": fuse_contrib,
    "fuse_channels": fuse_channels,
    "merged_channels": merged_channels,
    "dedup_keep_best": dedup_keep_best,
    "minmax_norm": minmax_norm,
    "sigmoid_norm": sigmoid_norm,
    "min_score_filter": min_score_filter,
    "rerank_blend": rerank_blend,
    "hybrid_search": hybrid_search,
    "eval_metrics": eval_metrics,
    "eval_summary": eval_summary,
    "eval_report": eval_report,
    "bm25_by_lang": bm25_by_lang,
    "bm25_padded": bm25_padded,
    "hybrid_graph_search": hybrid_graph_search,
    "case_search": case_search,
    "prompt_context": prompt_context,
    "answer_degraded": answer_degraded,
    "hit_preview": hit_preview,
    "example_choice": example_choice,
}

_C = _fuse_ctes("blend")
SQL = {
    "bm25_term_stats": f"WITH {BM25} SELECT term, df, round(idf, 6) AS idf FROM terms",
    "bm25_corpus_stats": f"WITH {BM25} SELECT n, round(avgdl, 6) AS avgdl FROM st",
    "bm25_topk": f"WITH {BM25} SELECT query_id, doc_id, round(score, 6) AS score, rank FROM lex WHERE rank <= 10",
    "bm25_incremental": f"WITH {BM25} SELECT term, df, round(idf, 6) AS idf FROM terms",
    "dense_topk": """SELECT query_id, doc_id, round(score, 6) AS score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM (
    SELECT a.vec_id AS query_id, b.vec_id AS doc_id, list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS score FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0)) WHERE rank <= 10""",
    "dense_label_eval": """SELECT query_id, round(avg(CASE WHEN dl = ql THEN 1e0 ELSE 0e0 END), 6) AS share, count(*) AS n FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM (
    SELECT a.vec_id AS query_id, b.vec_id AS doc_id, a.label AS ql, b.label AS dl, list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS score FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0))
WHERE rank <= 11 AND query_id <> doc_id GROUP BY query_id""",
    "late_interaction": LATE_SQL,
    **{f"fuse_{m}": _fuse_sql(m) for m in fusion.METHODS},
    "fuse_contrib": f"WITH {_C} SELECT r2.query_id, r2.doc_id, r2.channel, round(5e-1 * f.rn * r2.rrf / f.total + 5e-1 * r2.w * r2.norm, 6) AS contrib FROM r2 JOIN f USING (query_id, doc_id)",
    "fuse_channels": f"WITH {_C} SELECT r2.query_id, r2.doc_id, string_agg(r2.channel, ',' ORDER BY 5e-1 * f.rn * r2.rrf / f.total + 5e-1 * r2.w * r2.norm DESC, r2.channel DESC) AS channels FROM r2 JOIN f USING (query_id, doc_id) GROUP BY r2.query_id, r2.doc_id",
    "merged_channels": f"WITH {RUNS} SELECT query_id, doc_id, round(coalesce(max(CASE WHEN channel = 'bm25' THEN score END), 0), 6) AS bm25, round(coalesce(max(CASE WHEN channel = 'dense' THEN score END), 0), 6) AS dense, 0e0 AS colbert, string_agg(channel, ',' ORDER BY channel) AS channels FROM runs GROUP BY query_id, doc_id",
    "dedup_keep_best": DEDUP_SQL,
    "minmax_norm": "SELECT vec_id AS doc_id, round(CASE WHEN max(x) OVER p - min(x) OVER p < 1e-12 THEN 0 ELSE (x - min(x) OVER p) / (max(x) OVER p - min(x) OVER p) END, 6) AS norm FROM (SELECT *, CAST(embedding[1] AS DOUBLE) AS x FROM embeddings) WINDOW p AS (PARTITION BY label)",
    "sigmoid_norm": "SELECT vec_id AS doc_id, round(1 / (1 + exp(-CAST(embedding[1] AS DOUBLE) / 5e-1)), 6) AS norm FROM embeddings",
    "min_score_filter": f"WITH {_C} SELECT query_id, doc_id, round(fs, 6) AS score FROM fused WHERE fs >= 2e-1",
    "rerank_blend": RERANK_SQL,
    "hybrid_search": hybrid_sql(),
    "eval_metrics": f"WITH {_eval_ctes()} SELECT system, query_id, {', '.join(f'round({c}, 6) AS {c}' for c in METRICS)} FROM m",
    "eval_summary": eval_summary_sql(),
    "eval_report": f"WITH {_eval_ctes()}, x AS (SELECT system, avg(round(recall_10, 6)) AS r, avg(round(mrr_10, 6)) AS m FROM m GROUP BY system) SELECT system, CAST(row_number() OVER (ORDER BY r DESC, system) AS INTEGER) AS place, round(r, 6) AS recall_10, round(m, 6) AS mrr_10 FROM x",
    "bm25_by_lang": BY_LANG_SQL,
    "bm25_padded": PADDED_SQL,
    "case_search": CASE_SQL,
    "prompt_context": PROMPT_SQL,
    "answer_degraded": f"WITH c AS ({PROMPT_SQL}) SELECT query_id, '{prompts.DEGRADED}' AS answer, CAST(length(context) AS INTEGER) AS prompt_length FROM c",
    "hit_preview": f"WITH {BM25} SELECT query_id, doc_id, rank, round(score, 2) AS score, left(regexp_replace(text, '\\n', ' ', 'g'), 80) AS preview, source, lang FROM lex JOIN documents USING (doc_id) WHERE rank <= 3",
}

