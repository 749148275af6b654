"""Registered queries: languages, routing, text functions, parsing, sources, streaming."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import rules, text
from ..functions.scores import mean_pooled
from ..operators import cases, dense, fusion, graph, parse, routing
from ..sources.readers import first_by_id, page_links, page_text, preview
from ..sources.shared import shared_dir
from ..streaming.ingest import ingest, ingested_log
from .queries_search import docs, texts, vectors

ENDS = text.TERMINATORS + "."


def pages(spark, sf):
    return spark.read.parquet(f"{sf}/pages.parquet")


def turns(spark, sf):
    return spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "text")


def lang_detect(spark, sf):
    return texts(spark, sf).select("doc_id", text.detect_lang("text").alias("detected"), text.prompt_lang("text").alias("prompt"), text.ratio_lang("text").alias("ratio"))


def lang_stats(spark, sf):
    return docs(spark, sf).groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.regexp_count("text", F.lit("[A-Za-z]"))).alias("latin"), F.sum(F.length("text")).alias("chars"))


def route_questions(spark, sf):
    """Every conversation turn routed: mode, task, issue, tags, factor and number of hits."""
    r = routing.route(turns(spark, sf))
    return r.select("conv_id", "turn", "mode", "task_type", "issue_type", F.array_join("issue_tags", ",").alias("issue_tags"), "top_k_factor", "effective_k", "has_article_ref")


def route_documents(spark, sf):
    d = texts(spark, sf)
    return d.select("doc_id", routing.mode("text").alias("mode"), routing.task("text").alias("task"), routing.issue("text").alias("issue"), routing.part("text").alias("part"), routing.top_k_factor("text").alias("factor"))


def agent_scope(spark, sf):
    return turns(spark, sf).select("conv_id", "turn", routing.scope("text").alias("scope"))


def decompose(spark, sf):
    """Turns split on their joining word, which every third and sixth one has in Chinese."""
    t = F.when(F.col("turn") % 3 == 1, F.replace("text", F.lit(" and "), F.lit("并且"))).when(F.col("turn") % 3 == 2, F.replace("text", F.lit(" and "), F.lit(" 以及 "))).otherwise(F.col("text"))
    return turns(spark, sf).select("conv_id", "turn", F.posexplode(routing.decomposed(t)).alias("n", "part"))


def _asked(spark, sf):
    """Questions and what only looks like one, of nine forms, about each conversation turn."""
    n = F.col("turn") % 9
    forms = [
        F.concat(F.lit("Can the contract "), F.col("text"), F.lit("?")), F.concat(F.lit("plain words on the contract "), F.col("turn").cast("string")), F.concat(F.lit("What is number "), F.col("turn").cast("string"), F.lit("?")),
        F.concat(F.lit("依据本法规定，合同是否有效"), F.col("turn").cast("string"), F.lit("？")), F.concat(F.lit("上述合同如何处理"), F.col("turn").cast("string"), F.lit("？")), F.concat(F.lit("应当如何办"), F.col("turn").cast("string"), F.lit("？")),
        F.concat(F.lit("如何理解合同第十二条效力"), F.col("turn").cast("string")), F.concat(F.lit("什么情况下合同解除"), F.col("turn").cast("string"), F.lit("时")), F.lit("合同？"),
    ]
    q = F.coalesce(*[F.when(n == i, f) for i, f in enumerate(forms)])
    return turns(spark, sf).select("conv_id", "turn", q.alias("q"))


def usable_questions(spark, sf):
    return _asked(spark, sf).select("conv_id", "turn", routing.usable_question("q").alias("q"))


def _contains(t, words):
    return "(" + " OR ".join(f"contains({t}, '{w.lower()}')" for w in words) + ")"


def _count(t, words):
    return "(" + " + ".join(f"CAST(contains({t}, '{w.lower()}') AS INTEGER)" for w in words) + ")"


ART = "(regexp_matches(text, '第[一二三四五六七八九十百千万零0-9]{1,12}[条款项目]') OR regexp_matches(text, '(?i)\\barticle\\s+\\d{1,4}\\b'))"
LOW = "lower(trim(text))"
MODE = f"CASE WHEN {ART} OR {_contains(LOW, rules.INTERPRETIVE)} THEN 'GRAPH_AUGMENTED' ELSE 'RAG' END"
TASK = "CASE " + " ".join(f"WHEN {_contains(LOW, w)} THEN '{n}'" for n, w in rules.TASK_RULES) + " ELSE 'judge_style' END"
_BEST = "greatest(" + ", ".join(_count(LOW, w) for _, w in rules.PART_RULES) + ")"
PART = f"CASE WHEN {_BEST} = 0 THEN 'other' " + " ".join(f"WHEN {_count(LOW, w)} = {_BEST} THEN '{n}'" for n, w in rules.PART_RULES) + " END"
ISSUE = "CASE " + " ".join(f"WHEN {_contains(LOW, w)} THEN '{n}'" for n, w in rules.ISSUE_RULES) + f" ELSE {PART} END"
FACTOR = f"CASE WHEN {_contains(LOW, rules.BROAD)} AND NOT {ART} THEN 135e-2 ELSE 1e0 END"
BLANK = "trim(text) = ''"


def _route_sql():
    tag = "CASE " + " ".join("WHEN issue_type IN (" + ", ".join(f"'{n}'" for n in names) + f") THEN '{t}'" for t, names in rules.PART_OF.items()) + " ELSE '' END"
    return f"""WITH r AS (SELECT conv_id, turn, CASE WHEN {BLANK} THEN 'RAG' ELSE {MODE} END AS mode, CASE WHEN {BLANK} THEN 'judge_style' ELSE {TASK} END AS task_type,
  CASE WHEN {BLANK} THEN 'other' ELSE {ISSUE} END AS issue_type, CASE WHEN {BLANK} THEN 1e0 ELSE {FACTOR} END AS top_k_factor, {ART} AS has_article_ref FROM conversations)
SELECT *, array_to_string(list_filter([issue_type, {tag}], lambda x: x <> '' AND x <> 'other'), ',') AS issue_tags, CAST(least(greatest(trunc(10 * top_k_factor), 3), 30) AS INTEGER) AS effective_k FROM r"""


def _usable_sql():
    q = "trim(regexp_replace(replace('Can the contract ' || text || '?', '　', ' '), '\\s+', ' ', 'g'))"
    ok = f"length({q}) BETWEEN 6 AND 200 AND NOT regexp_matches({q}, '{'|'.join(rules.DEICTIC)}')"
    return f"""SELECT conv_id, turn, CASE turn % 9 WHEN 0 THEN CASE WHEN {ok} THEN {q} END WHEN 3 THEN '，合同是否有效' || turn || '？' WHEN 6 THEN '如何理解合同效力' || turn END AS q FROM conversations"""


def text_normalize(spark, sf):
    return texts(spark, sf).select("doc_id", text.normalised("text").alias("normalised"), text.one_line("text").alias("line"))


def sentence_split(spark, sf):
    return texts(spark, sf).select("doc_id", F.posexplode(text.sentences("text", ENDS)).alias("n", "sentence"))


def chunk_fixed(spark, sf):
    """Chunks of about 650 characters that share 90 with the next."""
    return texts(spark, sf).select("doc_id", F.posexplode(text.chunked("text", 650, 90, ENDS)).alias("n", "c")).select("doc_id", "n", "c.text", "c.start", "c.end")


CHUNK_SQL = f"""WITH RECURSIVE s AS (
  SELECT doc_id, list_filter(list_transform(regexp_extract_all(text, '[^{ENDS}]*[{ENDS}]|[^{ENDS}]+'), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') AS ss FROM documents),
r(doc_id, ss, i, buf, cur, start, ct, cs, ce) AS (
  SELECT doc_id, ss, 0, '', 0, 0, CAST(NULL AS VARCHAR), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT) FROM s
  UNION ALL
  SELECT doc_id, ss, i + 1,
    CASE WHEN length(nb) >= 650 THEN CASE WHEN length(tb) > 90 THEN right(tb, 90) ELSE '' END ELSE nb END, cur + length(ss[i + 1]),
    CASE WHEN length(nb) >= 650 AND length(tb) > 90 THEN st + length(tb) - 90 ELSE st END,
    CASE WHEN length(nb) >= 650 THEN tb END, CASE WHEN length(nb) >= 650 THEN st END, CASE WHEN length(nb) >= 650 THEN st + length(tb) END
  FROM (SELECT *, regexp_replace(nb, '^\\s+|\\s+$', '', 'g') AS tb FROM (SELECT *, buf || ss[i + 1] AS nb, CASE WHEN buf = '' THEN cur ELSE start END AS st FROM r WHERE i < len(ss)))),
out AS (SELECT doc_id, i, ct AS text, cs AS start, ce AS "end" FROM r WHERE ct IS NOT NULL
  UNION ALL SELECT doc_id, i + 1, regexp_replace(buf, '^\\s+|\\s+$', '', 'g'), start, start + length(regexp_replace(buf, '^\\s+|\\s+$', '', 'g')) FROM r WHERE i = len(ss) AND buf <> '')
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INTEGER) AS n, text, CAST(start AS INTEGER) AS start, CAST("end" AS INTEGER) AS "end" FROM out"""


def paragraph_split(spark, sf):
    """Lines as paragraphs (the tables have no blank lines, so each newline counts twice), with offsets."""
    d = texts(spark, sf).select("doc_id", F.posexplode(text.paragraphs(F.regexp_replace("text", "\\n", "\n\n"))).alias("n", "p"))
    return d.select("doc_id", "n", F.col("p.text").alias("text"), F.col("p.start").alias("start"), F.col("p.end").alias("end"))


PARA_SQL = """WITH l AS (SELECT doc_id, unnest(string_split_regex(replace(text, chr(10), chr(10) || chr(10)), '\\n{2,}')) AS t, generate_subscripts(string_split_regex(replace(text, chr(10), chr(10) || chr(10)), '\\n{2,}'), 1) AS i,
  list_concat([''], regexp_extract_all(replace(text, chr(10), chr(10) || chr(10)), '\\n{2,}')) AS gaps FROM documents),
o AS (SELECT doc_id, t, i, sum(length(t) + length(coalesce(gaps[i], ''))) OVER (PARTITION BY doc_id ORDER BY i) AS stop FROM l)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INTEGER) AS n, regexp_replace(t, '^\\s+|\\s+$', '', 'g') AS text, CAST(stop - length(t) AS INTEGER) AS start, CAST(stop AS INTEGER) AS "end"
FROM o WHERE regexp_replace(t, '^\\s+|\\s+$', '', 'g') <> ''"""


def label_head(spark, sf):
    """Labels of sentences, the nth repeat in a document with -n."""
    s = texts(spark, sf).select("doc_id", F.posexplode(text.sentences("text", ENDS)).alias("n", "sentence")).withColumn("label", text.head_label("sentence"))
    return parse.unique_labels(s, "label", ["n"]).select("doc_id", "n", "label")


LABEL_SQL = f"""WITH s AS (SELECT doc_id, unnest(ss) AS s, generate_subscripts(ss, 1) AS i FROM (
  SELECT doc_id, list_filter(list_transform(regexp_extract_all(text, '[^{ENDS}]*[{ENDS}]|[^{ENDS}]+'), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') AS ss FROM documents)),
l AS (SELECT doc_id, CAST(i - 1 AS INTEGER) AS n, nullif(regexp_extract(s, '^[^，,。；;:：\\s]*'), '') AS label FROM s)
SELECT doc_id, n, CASE WHEN label IS NULL OR row_number() OVER w = 1 THEN label ELSE label || '-' || row_number() OVER w END AS label FROM l WINDOW w AS (PARTITION BY doc_id, label ORDER BY n)"""


def doc_ids(spark, sf):
    return ingested_log(docs(spark, sf)).withColumn("text_len", F.col("text_len").cast("long"))


def title_helpers(spark, sf):
    d = texts(spark, sf)
    return d.select("doc_id", text.short_name("text").alias("short"), text.shortened(text.first_line("text")).alias("title"), text.heading_like("text").alias("heading"))


def html_extract(spark, sf):
    return pages(spark, sf).select("page_id", page_text("html").alias("text"))


def html_links(spark, sf):
    return pages(spark, sf).select("page_id", F.posexplode(page_links("html")).alias("n", "href"))


def _html_sql():
    t = "html"
    for tag in ("script", "style", "noscript", "nav", "head"):
        t = f"regexp_replace({t}, '(?is)<{tag}\\b.*?</{tag}\\s*>', ' ', 'g')"
    t = f"regexp_replace({t}, '(?i)<(?:br|/p|/div|/li|/h[1-6]|/tr)\\b[^>]*>', chr(10), 'g')"
    t = f"regexp_replace({t}, '(?s)<[^>]*>', ' ', 'g')"
    for a, b in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
        t = f"replace({t}, '{a}', '{b}')"
    t = f"regexp_replace({t}, '[ \\t\\r\\f]+', ' ', 'g')"
    return f"SELECT page_id, regexp_replace(regexp_replace({t}, ' ?\\n[ \\n]*', chr(10), 'g'), '^[ \\n]+|[ \\n]+$', '', 'g') AS text FROM pages"


LINK_SQL = """WITH l AS (SELECT page_id, unnest(hs) AS href, generate_subscripts(hs, 1) AS i FROM (SELECT page_id, regexp_extract_all(html, '(?i)<a\\b[^>]*?\\bhref\\s*=\\s*"([^"]*)"', 1) AS hs FROM pages)),
f AS (SELECT page_id, href, min(i) AS i FROM l GROUP BY page_id, href)
SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS INTEGER) AS n, href FROM f"""


def corpus_dedup(spark, sf):
    """The first document of each text."""
    d = docs(spark, sf).withColumn("h", F.sha2("text", 256))
    return first_by_id(d, "h", ["doc_id"]).select("doc_id", "source", "lang")


def sample_rows(spark, sf):
    """A hundred documents by a seeded hash."""
    return docs(spark, sf).orderBy(F.sha2(F.concat(F.lit("7:"), F.col("doc_id").cast("string")), 256)).limit(100).select("doc_id", "source")


def embedding_dedup(spark, sf):
    """Vectors a greedy pass keeps at cosine 0.85 within a label."""
    v = vectors(spark, sf).withColumnRenamed("doc_id", "vec_id")
    return dense.greedy_distinct(dense.similar_pairs(v, 0.85), v, "vec_id")


EMB_SQL = """WITH RECURSIVE p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id
  WHERE list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) >= 85e-2),
o AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) AS i FROM embeddings),
r(i, kept) AS (SELECT 0, CAST([] AS BIGINT[]) UNION ALL
  SELECT r.i + 1, CASE WHEN len(list_intersect(r.kept, (SELECT coalesce(list(p.a), []) FROM p WHERE p.b = o.vec_id))) > 0 THEN r.kept ELSE list_append(r.kept, o.vec_id) END
  FROM r JOIN o ON o.i = r.i + 1)
SELECT unnest(kept) AS vec_id FROM (SELECT kept FROM r ORDER BY i DESC LIMIT 1)"""


def quality_gate(spark, sf):
    """Sources as parsed documents: each text an article, its id the number."""
    d = docs(spark, sf)
    rec = d.select(F.col("source").alias("doc_id"), F.col("doc_id").cast("string").alias("article_id"), "text")
    size = d.groupBy(F.col("source").alias("doc_id")).agg(F.sum(F.length("text")).alias("text_len"))
    q = parse.quality(rec, size)
    return q.select("doc_id", "count", F.round("coverage", 6).alias("coverage"), F.round("avg_len_ratio", 6).alias("avg_len_ratio"), F.round("gap_ratio", 6).alias("gap_ratio"), "ok")


GATE_SQL = """WITH g AS (SELECT source AS doc_id, count(*) AS count, sum(length(text)) AS total, sum(length(text)) AS text_len, count(DISTINCT doc_id) AS nums, min(doc_id) AS lo, max(doc_id) AS hi FROM documents GROUP BY source),
m AS (SELECT doc_id, count, total / CAST(greatest(text_len, 1) AS DOUBLE) AS coverage, total / CAST(count AS DOUBLE) / CAST(greatest(text_len, 1) AS DOUBLE) AS a, CASE WHEN nums >= 5 THEN 1e0 - nums / CAST(hi - lo + 1 AS DOUBLE) END AS gap FROM g)
SELECT doc_id, count, round(coverage, 6) AS coverage, round(a, 6) AS avg_len_ratio, round(gap, 6) AS gap_ratio, NOT (count < 20 OR coverage < 3e-1 OR coalesce(gap > 5e-1, FALSE) OR a > 12e-2) AS ok FROM m"""


def stream_ingest(spark, sf):
    """Documents through the streaming file source into the chunk table, then once more: nothing is added twice."""
    root = f"{shared_dir(spark)}/quarry/ingest-{uuid.uuid4().hex}"
    schema = docs(spark, sf).schema
    for turn in ("one", "two"):
        ingest(spark, f"{sf}/documents.parqu[e]t", schema, root, f"{root}/state-{turn}").awaitTermination()
    return spark.read.parquet(f"{root}/chunks").select("doc_id", F.length("text").alias("n"), "source")


def stream_postings(spark, sf):
    """Terms and their documents in the index that the stream keeps."""
    root = f"{shared_dir(spark)}/quarry/ingest-{uuid.uuid4().hex}"
    ingest(spark, f"{sf}/documents.parqu[e]t", docs(spark, sf).schema, root, f"{root}/state").awaitTermination()
    return spark.read.parquet(f"{root}/postings").groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").cast("long").alias("tf"))


# Parsers and extractors run over texts of known structure that are made from the documents' columns; their SQL computes
# the parts from the same columns, so every expected value depends on the row.
def chinese(n):
    """A number under ten thousand in Chinese numerals (0: empty)."""
    digit = F.array(*[F.lit(x) for x in ("", *"一二三四五六七八九")])
    place = lambda k, unit: F.when(F.floor(n / 10**k) % 10 > 0, F.concat(F.get(digit, (F.floor(n / 10**k) % 10).cast("int")), F.lit(unit))).otherwise("")
    return F.concat(place(3, "千"), place(2, "百"), place(1, "十"), place(0, ""))


def made(spark, sf):
    """doc_id, source, n_chars and the small numbers a (1 to 900), b (1 to 97) and k (0 to 6) of each document."""
    return docs(spark, sf).select("doc_id", "source", "n_chars", (F.col("doc_id") % 900 + 1).alias("a"), (F.col("n_chars") % 97 + 1).alias("b"), (F.col("doc_id") % 7).alias("k"))


MADE = "m AS (SELECT doc_id, source, n_chars, doc_id % 900 + 1 AS a, n_chars % 97 + 1 AS b, doc_id % 7 AS k FROM documents)"


def numerals(spark, sf):
    """Lengths of the documents written as Chinese or decimal numerals, or as none, and read again."""
    n = F.col("n_chars") % 10000
    return made(spark, sf).select("doc_id", text.numeral(F.when(F.col("k") == 0, F.concat(F.lit("x"), n.cast("string"))).when(F.col("k") == 1, n.cast("string")).otherwise(chinese(n))).alias("n"))


NUMERAL_SQL = "SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN NULL WHEN doc_id % 7 = 1 THEN n_chars % 10000 ELSE nullif(n_chars % 10000, 0) END AS n FROM documents"


def citations(spark, sf):
    """References in texts with a range of sections, an article, a section id and a Chinese marker of each document."""
    t = F.format_string("See Section %d to %d and Article %d, also § %d-%d. 依照第%s条办理", "a", F.col("a") + F.col("k"), "b", "b", "a", chinese(F.col("a")))
    return graph.citations(made(spark, sf).select("doc_id", t.alias("text")), "doc_id")


CITE_SQL = f"""WITH {MADE}
SELECT doc_id AS src, 'section:' || unnest(range(a, a + k + 1)) AS ref, 85e-2 AS conf FROM m
UNION ALL SELECT doc_id, 'section:' || a, 85e-2 FROM m UNION ALL SELECT doc_id, 'article:' || b, 85e-2 FROM m
UNION ALL SELECT doc_id, 'section:' || b || '-' || a, 85e-2 FROM m UNION ALL SELECT doc_id, CAST(a AS VARCHAR), 9e-1 FROM m"""


def definitions(spark, sf):
    """Terms that texts define strongly, weakly or not at all, named by the document's numbers."""
    t = F.when(F.col("k") == 6, F.lit("本法所称合同，是指协议。The word Party means nothing here.")).otherwise(
        F.format_string("“Goods %d” means all things. Unit %d shall mean a measure. 本法所称动产%d号，是指可移动的财产。\n不动产%d是指土地。", "a", "b", "b", "k"))
    return graph.definitions(made(spark, sf).select("doc_id", t.alias("text")), "doc_id").withColumnRenamed("article_id", "doc_id")


DEF_SQL = f"""WITH {MADE}
SELECT doc_id, 'Goods ' || a AS term, 95e-2 AS conf FROM m WHERE k <> 6 UNION ALL SELECT doc_id, 'Unit ' || b, 7e-1 FROM m WHERE k <> 6
UNION ALL SELECT doc_id, '动产' || b || '号', 95e-2 FROM m WHERE k <> 6 UNION ALL SELECT doc_id, '不动产' || k, 6e-1 FROM m WHERE k <> 6
UNION ALL SELECT doc_id, 'The word Party', 7e-1 FROM m WHERE k = 6"""


def _by_source(spark, sf, piece, head=""):
    """One text a source: a head line, then a piece for each of its documents in order."""
    g = made(spark, sf).groupBy("source").agg(F.sort_array(F.collect_list(F.struct("doc_id", piece.alias("piece")))).alias("ps"))
    return g.select("source", F.concat(F.lit(head), F.array_join("ps.piece", "\n")).alias("text"))


def parse_articles_en(spark, sf):
    """Statutes of a section for each document of a source, a new part wherever its id is divisible by seven."""
    part = F.when(F.col("k") == 0, F.format_string("PART %d. GROUP %d\n", "a", "b")).otherwise("")
    t = _by_source(spark, sf, F.concat(part, F.format_string("§ %d-%d. Title %d. It applies\nto goods of kind %d.", "k", "doc_id", "b", "a")), "ARTICLE 2 - SALES\n")
    return parse.by_lines(parse.lines_of(t, "source"), "en", "source").select("source", "n", "chapter", "section", "article_no", "article_id", "text")


EN_SQL = f"""WITH {MADE}, o AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n, last_value(CASE WHEN k = 0 THEN 'Part ' || a || ' GROUP ' || b END IGNORE NULLS) OVER (PARTITION BY source ORDER BY doc_id) AS part FROM m)
SELECT source, n, 'Article 2 SALES' AS chapter, coalesce(part, '') AS section, '§ ' || k || '-' || doc_id AS article_no, k || '-' || doc_id AS article_id, 'Title ' || b || '. It applies to goods of kind ' || a || '.' AS text FROM o"""


def parse_articles_zh(spark, sf):
    """Laws of an article for each document of a source, with parts, chapters and a marker that a line break splits."""
    head = F.when(F.col("k") == 0, F.concat(F.lit("第"), chinese(F.col("b")), F.lit("编 分则\n"))).when(F.col("k") == 3, F.concat(F.lit("第"), chinese(F.col("a")), F.lit("章 规定\n"))).otherwise("")
    no = F.when(F.col("k") == 5, F.concat(F.lit("第一千\n"), chinese(F.col("a") % 99 + 1), F.lit("条"))).otherwise(F.concat(F.lit("第"), chinese(F.col("a")), F.lit("条")))
    t = _by_source(spark, sf, F.concat(head, no, F.lit(" "), F.format_string("本条有%d项，\n共%d款。", "b", "n_chars")))
    return parse.by_lines(parse.lines_of(t, "source"), "zh", "source").select("source", "n", F.regexp_replace("part", "第.*编", "编").alias("part"), F.col("chapter") != "", "article_id", "text").toDF("source", "n", "part", "in_chapter", "article_id", "text")


ZH_SQL = f"""WITH {MADE}, o AS (SELECT *, row_number() OVER w AS n, max(CASE WHEN k = 0 THEN doc_id END) OVER w AS part_at, max(CASE WHEN k = 3 THEN doc_id END) OVER w AS chapter_at FROM m WINDOW w AS (PARTITION BY source ORDER BY doc_id))
SELECT source, n, CASE WHEN part_at IS NULL THEN '' ELSE '编 分则' END AS part, chapter_at IS NOT NULL AND chapter_at > coalesce(part_at, -1) AS in_chapter,
       CAST(CASE WHEN k = 5 THEN 1000 + a % 99 + 1 ELSE a END AS VARCHAR) AS article_id, '本条有' || b || '项，共' || n_chars || '款。' AS text FROM o"""


def parse_by_scan(spark, sf):
    """Articles in running text without lines; a marker after 依照 cites and starts none."""
    g = made(spark, sf).groupBy("source").agg(F.sort_array(F.collect_list(F.struct("doc_id", F.concat(F.lit("第"), chinese(F.col("a")), F.format_string("条 内容%d。依照第九条办理。", "b")).alias("piece")))).alias("ps"))
    return parse.by_scan(g.select("source", F.array_join("ps.piece", "").alias("text")), "zh", "source").select("source", "n", "article_id", "text")


SCAN_SQL = f"""WITH {MADE} SELECT source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n, CAST(a AS VARCHAR) AS article_id, '内容' || b || '。依照第九条办理。' AS text FROM m"""


def layout_lines(spark, sf):
    """Words of a page for each document: two on a line that lie apart or touch, one below; given in any order."""
    w = lambda t, x0, x1, top: F.struct(t.alias("text"), x0.cast("double").alias("x0"), x1.cast("double").alias("x1"), top.cast("double").alias("top"), (top + 10).cast("double").alias("bottom"))
    a, b, k = F.col("a"), F.col("b"), F.col("k")
    words = F.array(w(F.concat(F.lit("w"), b.cast("string")), F.lit(20) + k, F.lit(50), F.lit(100.5)), w(F.concat(F.lit("v"), a.cast("string")), F.lit(0), F.lit(18), F.lit(100)), w(F.lit("low"), F.lit(0), F.lit(9), F.lit(103) + k))
    d = made(spark, sf).select(F.col("source"), F.col("doc_id").alias("page"), F.inline(words))
    return parse.layout_lines(d, page=["source", "page"]).select(F.col("page").alias("doc_id"), "line", "text")


LAYOUT_SQL = f"""WITH {MADE} SELECT doc_id, 1 AS line, 'v' || a || ' w' || b AS text FROM m UNION ALL SELECT doc_id, 2, 'low' FROM m"""


def line_merge(spark, sf):
    """Lines that go on, end a sentence, begin a list item or a heading, or are blank, joined into paragraphs."""
    n = F.col("b").cast("string")
    lines = F.array(F.concat(F.lit("the quick "), n), F.lit("brown fox."), F.concat(F.lit("合同是"), n), F.lit("协议"), F.when(F.col("k") < 3, "(a) one").when(F.col("k") < 5, "").otherwise("第一章 总则"), F.lit("end"))
    return made(spark, sf).select("doc_id", F.posexplode(text.merged_lines(lines)).alias("n", "p"))


MERGE_SQL = f"""WITH {MADE}, p AS (SELECT doc_id, CASE WHEN k < 3 THEN ['the quick ' || b || ' brown fox.', '合同是' || b || '协议', '(a) one end'] WHEN k < 5 THEN ['the quick ' || b || ' brown fox.', '合同是' || b || '协议', 'end']
  ELSE ['the quick ' || b || ' brown fox.', '合同是' || b || '协议', '第一章 总则end'] END AS ps FROM m)
SELECT doc_id, CAST(i - 1 AS INTEGER) AS n, ps[i] AS p FROM (SELECT doc_id, ps, unnest(range(1, len(ps) + 1)) AS i FROM p)"""


def model_answers(spark, sf):
    """Scores, objects, marked answers and list items read from answers made for each document."""
    j = F.when(F.col("k") == 0, "no number").when(F.col("k") == 1, F.format_string("about %d of 1000", "a")).otherwise(F.format_string('x {"score": %d.5, "id": %d} y', "k", "doc_id"))
    a = F.when(F.col("k") == 2, F.format_string("plain %d", "b")).otherwise(F.format_string("Thinking. Answer: %d  Answer: no", "b"))
    items = F.format_string("- first %d\n2) second\n\n* %d. third", "a", "b")
    return made(spark, sf).select("doc_id", text.first_score(j).alias("score"), text.json_object(j).alias("obj"), text.after_marker(a, "Answer:").alias("answer"), F.array_join(text.list_items(items), "|").alias("items"))


ANSWER_SQL = f"""WITH {MADE} SELECT doc_id, CASE WHEN k = 0 THEN 1e0 WHEN k = 1 THEN CAST(least(a, 10) AS DOUBLE) ELSE k + 5e-1 END AS score,
  CASE WHEN k > 1 THEN '{{"score": ' || k || '.5, "id": ' || doc_id || '}}' END AS obj, CASE WHEN k = 2 THEN 'plain ' || b ELSE b || '  Answer: no' END AS answer,
  'first ' || a || '|second|' || b || '. third' AS items FROM m"""

def partial_items(spark, sf):
    """The complete items of a list in an answer that breaks off within the list, behind it, or before it."""
    t = F.when(F.col("k") == 0, "no list").when(F.col("k") < 4, F.format_string('{"title": "x", "items": ["one \\"%d\\"", "two\\n%d", "thr', "a", "b")).otherwise(F.format_string('{"items": ["only %d"], "rest": ["a"', "b"))
    return made(spark, sf).select("doc_id", F.array_join(text.complete_items(t, "items"), "|").alias("items"))


PARTIAL_SQL = f"""WITH {MADE} SELECT doc_id, CASE WHEN k = 0 THEN '' WHEN k < 4 THEN 'one "' || a || '"|two' || chr(10) || b ELSE 'only ' || b END AS items FROM m"""


def record_text(spark, sf):
    """The text of records that keep it under one of three names, its width forms composed, and whether it mixes scripts."""
    wide = F.translate(F.format_string("No %d of ", "a"), "0123456789", "０１２３４５６７８９")
    d = made(spark, sf).select("doc_id", F.when(F.col("k") == 0, wide).alias("text"), F.when(F.col("k") < 3, F.concat(wide, F.lit("合同"))).otherwise(" ").alias("content"), F.when(F.col("k") < 6, F.lit("ﬁle")).alias("body"))
    one = text.coerced_text("text", "content", "body")
    return d.select("doc_id", text.nfkc(one).alias("text"), text.mixed_lang(one).alias("mixed"))


RECORD_SQL = f"""WITH {MADE} SELECT doc_id, CASE WHEN k = 0 THEN 'No ' || a || ' of ' WHEN k < 3 THEN 'No ' || a || ' of 合同' WHEN k < 6 THEN 'file' ELSE '' END AS text, k IN (1, 2) AS mixed FROM m"""


def first_rows(spark, sf):
    """The first fifty documents of those asked for, as a preview gives at most."""
    return preview(docs(spark, sf).select("doc_id", "source"), 500, ["source", "doc_id"])


def parse_chosen(spark, sf):
    """Two parses of each source, of which the choice keeps one whole."""
    rec = made(spark, sf).withColumn("n", F.col("doc_id")).withColumn("article_no", F.lit("")).withColumn("article_id", F.col("doc_id").cast("string"))
    line, scan = (rec.where(c).withColumn("text", F.lit(t)) for c, t in (("k < 4 and b % 2 = 0", "line"), ("k < 5 and a % 2 = 0", "scan")))
    return parse.chosen(line, scan, "source").select("source", "n", "text")


CHOSEN_SQL = f"""WITH {MADE}, l AS (SELECT source, doc_id FROM m WHERE k < 4 AND b % 2 = 0), s AS (SELECT source, doc_id FROM m WHERE k < 5 AND a % 2 = 0),
c AS (SELECT source, (SELECT count(*) FROM l WHERE l.source = x.source) AS nl, (SELECT count(*) FROM s WHERE s.source = x.source) AS ns FROM (SELECT DISTINCT source FROM m) x),
p AS (SELECT source, ns > 0 AND (nl < 10 OR ns > nl) AS scan FROM c)
SELECT source, doc_id AS n, 'scan' AS text FROM s JOIN p USING (source) WHERE scan UNION ALL SELECT source, doc_id, 'line' FROM l JOIN p USING (source) WHERE NOT scan"""


def header_footer(spark, sf):
    """Pages of a source, one for each document, with a running head, a page number and a line of their own."""
    line = lambda n, top, t: F.struct(F.lit(n).alias("line"), F.lit(float(top)).alias("top"), F.lit(top + 5.0).alias("bottom"), t.alias("text"))
    ls = F.array(line(1, 3, F.format_string("Report %d", "a")), line(2, 50, F.format_string("body of %d words", "n_chars")), line(3, 60, F.col("b").cast("string")), line(4, 94, F.concat(F.lit("foot "), F.col("source"))))
    m = made(spark, sf).withColumnRenamed("doc_id", "page")
    return parse.without_running_heads(m.select("source", "page", F.inline(ls)), m.select("source", "page", F.lit(100.0).alias("height")), key="source").select(F.col("page").alias("doc_id"), "line", "text")


HEAD_SQL = f"""WITH {MADE}, n AS (SELECT source, count(*) AS pages FROM m GROUP BY source)
SELECT doc_id, 2 AS line, 'body of ' || n_chars || ' words' AS text FROM m
UNION ALL SELECT doc_id, 1, 'Report ' || a FROM m JOIN n USING (source) WHERE pages < 2 UNION ALL SELECT doc_id, 4, 'foot ' || source FROM m JOIN n USING (source) WHERE pages < 2"""


def cite_resolve(spark, sf):
    """References of each document to the one before it, plain, by a subsection, or to nothing, against the documents."""
    before = (F.col("doc_id") - 1).cast("string")
    refs = made(spark, sf).select(F.col("doc_id").alias("src"), F.when(F.col("k") == 0, "none").when(F.col("k") == 1, F.concat(F.lit("section:"), before, F.lit(".2"))).otherwise(before).alias("ref"), F.lit(0.9).alias("conf"))
    name = F.col("doc_id").cast("string")
    keys = docs(spark, sf).select(F.explode(F.array(name, F.concat(F.lit("section:"), name))).alias("ref"), F.col("doc_id").alias("article_id"))
    return graph.resolved(refs, keys)


RESOLVE_SQL = f"""WITH {MADE}, r AS (SELECT m.doc_id AS src, d.doc_id AS dst FROM m JOIN documents d ON d.doc_id = m.doc_id - 1 WHERE k > 0)
SELECT src, dst, 'cite' AS relation, 9e-1 AS conf FROM r UNION ALL SELECT dst, src, 'cited', 9e-1 FROM r"""


def term_register(spark, sf):
    """The last document, by id, that defines each of the terms with enough confidence."""
    m = made(spark, sf)
    defs = m.select(F.col("doc_id").alias("article_id"), F.concat(F.lit("term "), F.col("b").cast("string")).alias("term"), F.when(F.col("k") < 2, 0.6).otherwise(0.95).alias("conf"))
    return graph.registered(defs, m.select(F.col("doc_id").alias("article_id"), (-F.col("doc_id")).alias("pos"))).withColumnRenamed("article_id", "doc_id")


TERM_SQL = f"WITH {MADE} SELECT 'term ' || b AS term, max(doc_id) AS doc_id FROM m WHERE k >= 2 GROUP BY b"


def router_override(spark, sf):
    """Routes of the conversation turns where a model's answer names another task, an unknown one, or breaks off."""
    n = F.col("turn") % 4
    a = F.when(n == 0, 'so {"task_type": "risk_alert", "issue_type": "mortgage", "top_k_factor": 5} ok').when(n == 1, '{"task_type": "unknown", "issue_type": "tort_liability", "top_k_factor": 0.1}').when(n == 2, '{"task_type": "risk').otherwise(F.lit(None).cast("string"))
    r = routing.overridden(routing.route(turns(spark, sf)).withColumn("answer", a), "answer")
    return r.select("conv_id", "turn", "task_type", "issue_type", "top_k_factor")


def small_helpers(spark, sf):
    """Section keys, case texts and judged scores of records made for each document."""
    m = made(spark, sf)
    d = m.select("doc_id", "k", F.format_string("%dA(B)(%d)", "a", "b").alias("no"), F.format_string(" T%d", "a").alias("title"), F.when(F.col("k") > 0, F.format_string("F%d", "b")).alias("facts"), F.lit(" ").alias("issue"), F.lit("H").alias("holding"))
    answer = F.when(F.col("k") == 0, "no score").when(F.col("k") < 3, F.format_string('{"score": 0.%d}', "k")).otherwise(F.format_string("score %d of 10", "k"))
    return d.select("doc_id", text.section_key("no").alias("section"), cases.case_text().alias("case_text"), fusion.parsed_judgement(answer).alias("judged"))


HELPER_SQL = f"""WITH {MADE} SELECT doc_id, a || 'a:b:' || b AS section, 'T' || a || CASE WHEN k > 0 THEN chr(10) || 'F' || b ELSE '' END || chr(10) || 'H' AS case_text,
  CASE WHEN k = 0 THEN 0e0 WHEN k < 3 THEN k / 10e0 ELSE 1e0 END AS judged FROM m"""


def mean_pool(spark, sf):
    """Each vector and its double under a mask that leaves out a third: their mean."""
    v = vectors(spark, sf).withColumn("e", F.transform("embedding", lambda x: x.cast("double")))
    pooled = mean_pooled(F.array("e", F.transform("e", lambda x: x * 2), F.transform("e", lambda x: x * 0 + 9)), F.array(F.lit(1), F.lit(1), F.lit(0)))
    return v.select("doc_id", F.round(F.get(pooled, F.lit(0)), 6).alias("first"), F.size(pooled).alias("n"))


STRUCTURED = {
    "parse_chosen": (parse_chosen, CHOSEN_SQL),
    "header_footer": (header_footer, HEAD_SQL),
    "cite_resolve": (cite_resolve, RESOLVE_SQL),
    "term_register": (term_register, TERM_SQL),
    "router_override": (router_override, f"""SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN 'risk_alert' ELSE task_type END AS task_type, CASE turn % 4 WHEN 0 THEN 'mortgage' WHEN 1 THEN 'tort_liability' ELSE issue_type END AS issue_type,
  CASE turn % 4 WHEN 0 THEN 2e0 WHEN 1 THEN 8e-1 ELSE top_k_factor END AS top_k_factor FROM ({_route_sql()})"""),
    "small_helpers": (small_helpers, HELPER_SQL),
    "mean_pool": (mean_pool, "SELECT vec_id AS doc_id, round(15e-1 * CAST(embedding[1] AS DOUBLE), 6) AS first, CAST(len(embedding) AS INTEGER) AS n FROM embeddings"),
    "partial_items": (partial_items, PARTIAL_SQL),
    "record_text": (record_text, RECORD_SQL),
    "first_rows": (first_rows, "SELECT doc_id, source FROM documents ORDER BY source, doc_id LIMIT 50"),
    "numerals": (numerals, NUMERAL_SQL),
    "citations": (citations, CITE_SQL),
    "definitions": (definitions, DEF_SQL),
    "parse_articles_zh": (parse_articles_zh, ZH_SQL),
    "parse_articles_en": (parse_articles_en, EN_SQL),
    "parse_by_scan": (parse_by_scan, SCAN_SQL),
    "layout_lines": (layout_lines, LAYOUT_SQL),
    "line_merge": (line_merge, MERGE_SQL),
    "model_answers": (model_answers, ANSWER_SQL),
}

QUERIES = {
    "lang_detect": lang_detect, "lang_stats": lang_stats, "route_questions": route_questions, "route_documents": route_documents, "agent_scope": agent_scope, "decompose": decompose, "usable_questions": usable_questions,
    "text_normalize": text_normalize, "sentence_split": sentence_split, "chunk_fixed": chunk_fixed, "paragraph_split": paragraph_split, "label_head": label_head, "doc_ids": doc_ids, "title_helpers": title_helpers,
    "html_extract": html_extract, "html_links": html_links, "corpus_dedup": corpus_dedup, "sample_rows": sample_rows, "embedding_dedup": embedding_dedup, "quality_gate": quality_gate, "stream_ingest": stream_ingest, "stream_postings": stream_postings,
    **{k: q for k, (q, _) in STRUCTURED.items()},
}
_ZH_N, _LA_N = "len(regexp_extract_all(text, '[\\x{4e00}-\\x{9fff}]'))", "len(regexp_extract_all(text, '[A-Za-z]'))"
SQL = {
    "lang_detect": f"SELECT doc_id, CASE WHEN {_LA_N} > {_ZH_N} THEN 'en' ELSE 'zh' END AS detected, CASE WHEN {_ZH_N} > 0 THEN 'zh' ELSE 'en' END AS prompt, CASE WHEN {_ZH_N} > 3e-1 * greatest(length(regexp_replace(text, '\\s', '', 'g')), 1) THEN 'zh' ELSE 'en' END AS ratio FROM documents",
    "lang_stats": f"SELECT lang, count(*) AS n, CAST(sum({_LA_N}) AS BIGINT) AS latin, CAST(sum(length(text)) AS BIGINT) AS chars FROM documents GROUP BY lang",
    "route_questions": _route_sql(),
    "example_choice": f"""SELECT conv_id || '-' || turn AS query_id, CASE WHEN a >= b AND a >= c THEN 'a' WHEN b >= c THEN 'b' ELSE 'c' END AS example FROM (
  SELECT conv_id, turn, CASE WHEN task_type = 'judge_style' THEN 3 ELSE 0 END AS a, CASE WHEN issue_type = 'other' THEN 2 ELSE 0 END AS b,
         CASE WHEN task_type = 'risk_alert' THEN 3 ELSE 0 END + CASE WHEN issue_type = 'contract_interpretation' THEN 2 ELSE 0 END AS c FROM ({_route_sql()}))""",
    "route_documents": f"SELECT doc_id, {MODE} AS mode, {TASK} AS task, {ISSUE} AS issue, {PART} AS part, {FACTOR} AS factor FROM documents",
    "agent_scope": f"SELECT conv_id, turn, CASE WHEN s > 0 AND k > 0 THEN 'both' WHEN k > s THEN 'case' ELSE 'statute' END AS scope FROM (SELECT conv_id, turn, {_count(LOW, rules.STATUTE_SIGNALS)} AS s, {_count(LOW, rules.CASE_SIGNALS)} + CAST({_contains(LOW, rules.FACT_SIGNALS)} AS INTEGER) AS k FROM conversations)",
    "decompose": """SELECT conv_id, turn, CAST(i - 1 AS INTEGER) AS n, part FROM (SELECT conv_id, turn, unnest(ps) AS part, generate_subscripts(ps, 1) AS i FROM (SELECT conv_id, turn, CASE WHEN turn % 3 > 0 OR contains(text, ' and ')
  THEN list_filter(list_transform(string_split(text, ' and '), lambda x: CASE WHEN contains(text, ' and ') THEN trim(x) ELSE x END), lambda x: x <> '') ELSE [text] END AS ps FROM conversations))""",
    "usable_questions": _usable_sql(),
    "text_normalize": "SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\\r\\n?', chr(10), 'g'), '[ \\t\\x0b\\f\\x{3000}]+', ' ', 'g'), ' *\\n *', chr(10), 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), '^[ \\n]+|[ \\n]+$', '', 'g') AS normalised, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS line FROM documents",
    "sentence_split": f"SELECT doc_id, CAST(i - 1 AS INTEGER) AS n, s AS sentence FROM (SELECT doc_id, unnest(ss) AS s, generate_subscripts(ss, 1) AS i FROM (SELECT doc_id, list_filter(list_transform(regexp_extract_all(text, '[^{ENDS}]*[{ENDS}]|[^{ENDS}]+'), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') AS ss FROM documents))",
    "chunk_fixed": CHUNK_SQL,
    "paragraph_split": PARA_SQL,
    "label_head": LABEL_SQL,
    "doc_ids": "SELECT left(sha1(source || '|' || left(sha1(text), 12)), 16) AS ingest_id, source, length(text) AS text_len FROM documents",
    "title_helpers": "SELECT doc_id, CASE WHEN regexp_replace(text, '\\s+', '', 'g') = '' THEN 'upload' ELSE left(regexp_replace(text, '\\s+', '', 'g'), 12) END AS short, CASE WHEN t = '' THEN 'upload' WHEN length(t) <= 20 THEN t ELSE left(t, 10) || '***' || right(t, 10) END AS title, regexp_matches(trim(text), '^(?:(?:ARTICLE|PART)\\s+[0-9A-Za-z-]+)') OR trim(text) = '' AS heading FROM (SELECT *, trim(regexp_replace(regexp_extract(text, '(?m)^.*\\S.*$'), '\\s+$', '')) AS t FROM documents)",
    "html_extract": _html_sql(),
    "html_links": LINK_SQL,
    "corpus_dedup": "SELECT doc_id, source, lang FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS n FROM documents) WHERE n = 1",
    "sample_rows": "SELECT doc_id, source FROM documents ORDER BY sha256('7:' || doc_id) LIMIT 100",
    "embedding_dedup": EMB_SQL,
    "quality_gate": GATE_SQL,
    "stream_ingest": "SELECT doc_id, length(text) AS n, source FROM documents",
    "stream_postings": "SELECT term, count(DISTINCT doc_id) AS df, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+(?:''[a-z0-9]+)?')) AS term FROM documents) GROUP BY term",
    **{k: s for k, (_, s) in STRUCTURED.items()},
}
