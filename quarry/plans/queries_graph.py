"""Registered queries: edges, budgets, walks and their scores."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import rules
from ..operators import fusion, graph
from ..sources.shared import stored
from .queries_search import BM25, TOK, _held, docs, index, items

DEPTHS, LIMIT, SEEDS = rules.WALK_DEPTHS, 800, 30


def graph_edges_seq(spark, sf):
    e = graph.sequence_edges(docs(spark, sf).select("doc_id", "source"), ["source"], ["doc_id"], bucket=F.floor(F.col("doc_id") / 4096))
    return e.select("src", "dst", "relation", "conf")


def graph_edges_contain(spark, sf):
    """The first document with a passage defines it for the others that hold it; ten passages a document."""
    held = stored(_held(spark, sf))
    first = held.groupBy("query_id").agg(F.min("doc_id").alias("article"))
    return graph.term_edges(held.join(first, "query_id").select("term", "article", F.col("query_id").alias("term_pos"), "doc_id"), 10)


def _edges(spark, sf):
    e = graph_edges_seq(spark, sf).unionByName(graph_edges_contain(spark, sf))
    return stored(e.withColumn("pos", F.row_number().over(Window.partitionBy("src").orderBy("relation", "dst"))))


def _seeds(spark, sf):
    return stored(index(spark, sf).search(items(spark, sf), SEEDS).select("query_id", F.col("doc_id").alias("node"), F.col("rank").alias("ord")))


def _walk(spark, sf, edges):
    return graph.walk(_seeds(spark, sf), edges, docs(spark, sf).select(F.col("doc_id").alias("node")), DEPTHS, LIMIT)


def graph_walk(spark, sf):
    """Walks from the thirty best lexical hits of every passage."""
    w = _walk(spark, sf, _edges(spark, sf))
    return w.select("query_id", "node", "depth", "parent", "relation", "ord")


def walk_filters(spark, sf):
    """Walks along next edges and strong definitions alone, to documents in English."""
    d = docs(spark, sf)
    w = graph.walk(_seeds(spark, sf), _edges(spark, sf), graph.searchable(d, "en"), DEPTHS, LIMIT, ["next", "defined_by"], 0.9)
    return w.select("query_id", "node", "depth", "parent", "relation")


def graph_neighbors(spark, sf):
    w = graph.neighbours(_seeds(spark, sf), _edges(spark, sf), docs(spark, sf).select(F.col("doc_id").alias("node")), 2)
    return w.select("query_id", "node", "depth")


def graph_score(spark, sf):
    w = _walk(spark, sf, _edges(spark, sf))
    t = w.join(items(spark, sf).withColumnRenamed("text", "q"), "query_id").join(docs(spark, sf).select(F.col("doc_id").alias("node"), F.col("text").alias("t")), "node")
    s = graph.scored(t, fusion.overlap_score(F.col("q"), F.col("t")))
    return s.select("query_id", "node", F.round("semantic", 6).alias("semantic"), F.round("score", 6).alias("score"))


def graph_induced(spark, sf):
    """The edges among all nodes of the walks; walks and result read the same edges, made once."""
    e = _edges(spark, sf)
    w = _walk(spark, sf, e)
    return graph.induced(e, stored(w.select("node").distinct())).select("src", "dst", "relation")


def graph_budget(spark, sf):
    """The edges of each document within the budgets: those within its source first, then those by passage."""
    e = _edges(spark, sf)
    c = e.withColumn("seq", F.when(F.col("relation").isin("prev", "next"), F.col("pos")).otherwise(F.col("pos") + 1000).cast("long"))
    return graph.budgeted(c).select("src", "dst", "relation", "conf", "pos")


GRAPH = f"""{BM25},
seq AS (SELECT doc_id, lag(doc_id) OVER w AS p, lead(doc_id) OVER w AS n FROM documents WINDOW w AS (PARTITION BY source ORDER BY doc_id)),
es AS (SELECT doc_id AS src, p AS dst, 'prev' AS relation, 1e0 AS conf FROM seq WHERE p IS NOT NULL UNION ALL SELECT doc_id, n, 'next', 1e0 FROM seq WHERE n IS NOT NULL),
gold AS (SELECT b.item_id, b.text, d.doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)),
art AS (SELECT item_id, text, min(doc_id) AS article FROM gold GROUP BY item_id, text),
pick AS (SELECT g.doc_id, a.article, a.text, row_number() OVER (PARTITION BY g.doc_id ORDER BY length(a.text) DESC, a.item_id) AS n FROM gold g JOIN art a USING (item_id) WHERE g.doc_id <> a.article),
ec AS (SELECT DISTINCT * FROM (SELECT doc_id AS src, article AS dst, 'defined_by' AS relation, CASE WHEN length(text) >= 4 THEN 9e-1 ELSE 85e-2 END AS conf FROM pick WHERE n <= 10
       UNION ALL SELECT article, doc_id, 'defines_term', CASE WHEN length(text) >= 4 THEN 9e-1 ELSE 85e-2 END FROM pick WHERE n <= 10)),
e AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY relation, dst) AS pos FROM (SELECT * FROM es UNION ALL SELECT * FROM ec)),
f0 AS (SELECT query_id, doc_id AS node, rank AS ord, CAST(NULL AS VARCHAR) AS relation FROM lex WHERE rank <= {SEEDS}),
v0 AS (SELECT query_id, node FROM f0)"""


def _levels(depths: dict, limit: int, levels: int, edges: str = "e", emitted: str = "TRUE") -> str:
    allowed = "CASE " + " ".join(f"WHEN relation = '{r}' THEN {n}" for r, n in depths.items() if r != "default") + f" ELSE {depths['default']} END" if len(depths) > 1 else str(depths["default"])
    out = GRAPH
    for i in range(levels):
        out += f""",
n{i} AS (SELECT * FROM (SELECT f.query_id, e.dst AS node, e.src AS parent, e.relation, e.conf, f.ord AS pord, e.pos, row_number() OVER (PARTITION BY f.query_id, e.dst ORDER BY f.ord, e.pos) AS rn
  FROM f{i} f JOIN {edges} e ON e.src = f.node WHERE (SELECT {allowed.replace("relation", "f.relation")}) > {i} AND (f.query_id, e.dst) NOT IN (SELECT query_id, node FROM v{i})) WHERE rn = 1),
l{i} AS (SELECT * FROM (SELECT query_id, node, {i + 1} AS depth, parent, relation, conf, row_number() OVER (PARTITION BY query_id ORDER BY pord, pos) AS k FROM n{i} WHERE {emitted}) WHERE k <= {limit}),
f{i + 1} AS (SELECT query_id, node, k AS ord, relation FROM l{i}),
v{i + 1} AS (SELECT * FROM v{i} UNION ALL SELECT query_id, node FROM n{i})"""
    return out + ",\nwalked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY depth, k) AS ord FROM (" + " UNION ALL ".join(f"SELECT * FROM l{i}" for i in range(levels)) + f")) WHERE ord <= {limit})"


WALK = _levels(DEPTHS, LIMIT, max(DEPTHS.values()))
FILTERED = _levels(DEPTHS, LIMIT, max(DEPTHS.values()), "(SELECT * FROM e WHERE relation IN ('next', 'defined_by') AND conf >= 9e-1)", "node IN (SELECT doc_id FROM documents WHERE lang = 'en' AND trim(text) <> '')")
QUERIES = {"walk_filters": walk_filters, "graph_edges_seq": graph_edges_seq, "graph_edges_contain": graph_edges_contain, "graph_walk": graph_walk, "graph_neighbors": graph_neighbors, "graph_score": graph_score, "graph_induced": graph_induced, "graph_budget": graph_budget}
SQL = {
    "walk_filters": f"WITH {FILTERED} SELECT query_id, node, depth, parent, relation FROM walked",
    "graph_edges_seq": f"WITH {GRAPH} SELECT * FROM es",
    "graph_edges_contain": f"WITH {GRAPH} SELECT * FROM ec",
    "graph_walk": f"WITH {WALK} SELECT query_id, node, depth, parent, relation, ord FROM walked",
    "graph_neighbors": f"WITH {_levels({'default': 2}, 2**31 - 1, 2)} SELECT query_id, node, depth FROM walked",
    "graph_score": f"""WITH {WALK},
dt AS (SELECT doc_id AS node, list_distinct({TOK}) AS dtok FROM documents), qt AS (SELECT item_id AS query_id, list_distinct({TOK}) AS qtok FROM benchmark),
s AS (SELECT w.*, CASE WHEN len(qtok) = 0 THEN 0e0 ELSE len(list_intersect(qtok, dtok)) / CAST(len(qtok) AS DOUBLE) END AS sem FROM walked w JOIN dt USING (node) JOIN qt USING (query_id))
SELECT query_id, node, round(sem, 6) AS semantic, round(sem * pow(1 + depth, -7e-1) * CASE relation WHEN 'defined_by' THEN 12e-1 WHEN 'defines_term' THEN 11e-1 ELSE 95e-2 END * conf, 6) AS score FROM s""",
    "graph_induced": f"WITH {WALK} SELECT src, dst, relation FROM e WHERE src IN (SELECT node FROM walked) AND dst IN (SELECT node FROM walked)",
    "graph_budget": f"""WITH RECURSIVE {GRAPH},
c AS (SELECT src, dst, relation, conf, row_number() OVER (PARTITION BY src ORDER BY CASE WHEN relation IN ('prev', 'next') THEN pos ELSE pos + 1000 END, dst, relation) AS i FROM e),
fold(src, i, size, dst, relation, conf, taken) AS (
  SELECT src, i, 1, dst, relation, conf, TRUE FROM c WHERE i = 1
  UNION ALL
  SELECT c.src, c.i, CASE WHEN f.size < CASE WHEN c.relation IN ('defined_by', 'defines_term') THEN {graph.CAPS['defined_by']} ELSE {graph.TOTAL_CAP} END THEN f.size + 1 ELSE f.size END, c.dst, c.relation, c.conf,
         f.size < CASE WHEN c.relation IN ('defined_by', 'defines_term') THEN {graph.CAPS['defined_by']} ELSE {graph.TOTAL_CAP} END
  FROM fold f JOIN c ON c.src = f.src AND c.i = f.i + 1)
SELECT src, dst, relation, conf, CAST(size - 1 AS INTEGER) AS pos FROM fold WHERE taken""",
}
