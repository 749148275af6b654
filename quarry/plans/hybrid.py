"""Hybrid search of a table of questions: route, channels, fuse, floor, graph, rerank, dedup, cut."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, fields

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.scores import d
from ..operators import bm25, dense, fusion, graph, routing
from ..sources.shared import stored


@dataclass
class Config:
    top_k: int = 10
    weights: dict = field(default_factory=lambda: dict(fusion.WEIGHTS))
    method: str = "blend"
    rrf_k: int = fusion.RRF_K
    alpha: float = fusion.ALPHA
    least_score: float = fusion.LEAST_SCORE
    seeds: int = 30
    walk_limit: int = 800
    depths: dict = field(default_factory=lambda: dict(rules.WALK_DEPTHS))
    gamma: float = 0.7
    rerank_window: int = fusion.RERANK_WINDOW
    beta: float = fusion.RERANK_BETA


    @classmethod
    def load(cls, spark, path: str) -> Config:
        """Settings from a JSON file anywhere Spark reads; fields it lacks keep their defaults, unknown ones are ignored."""
        known = {f.name for f in fields(cls)}
        return cls(**{k: v for k, v in json.loads(spark.read.text(path, wholetext=True).first()[0]).items() if k in known})


class HybridSearch:
    """chunks(doc_id, text), optional vectors(doc_id, embedding) and edges(src, dst, relation, conf, pos). With `late`, late
    interaction scores the candidates of the other channels; it maps a token column to a vector column (True: hashed
    character pairs)."""

    def __init__(self, chunks: DataFrame, vectors: DataFrame | None = None, edges: DataFrame | None = None, config: Config | None = None, index: bm25.Index | None = None, late=None):
        self.late = late
        self.chunks, self.vectors, self.edges, self.config = chunks, vectors, edges, config or Config()
        self.index = index or bm25.Index(chunks)

    def channels(self, questions: DataFrame, k: int) -> DataFrame:
        """(query, chunk, channel, score) of all channels."""
        runs = self.index.search(questions, k).select("query_id", "doc_id", F.lit("bm25").alias("channel"), "score")
        if self.vectors is not None and "embedding" in questions.columns:
            v = dense.top_inner(questions.select("query_id", "embedding"), self.vectors, k)
            runs = runs.unionByName(v.select("query_id", "doc_id", F.lit("dense").alias("channel"), "score"))
        if self.late:
            runs = stored(runs)
            found = dense.late_channel(questions.select("query_id", "text"), self.chunks, runs, k, vector=None if self.late is True else self.late)
            runs = runs.unionByName(found.select("query_id", "doc_id", F.lit("colbert").alias("channel"), "score"))
        return runs

    def search(self, questions: DataFrame, k: int | None = None) -> DataFrame:
        """(query_id, doc_id, score, rank, channels): the hits of each question, as many as its routing asks for.

        questions(query_id, text[, embedding]). Channels fetch the larger of k and the configured depth for all; the
        wanted number differs by question, so it is applied at the end. Texts join only the rerank window."""
        c = self.config
        k = k or c.top_k
        q = stored(routing.route(questions, base_k=k))
        fused = fusion.fuse(self.channels(q, max(30, c.top_k, k)), c.method, c.weights, c.rrf_k, c.alpha).where(F.col("score") >= c.least_score)
        hits = stored(fusion.reranked_order(fused.select("query_id", "doc_id", "score", "channels")))
        if self.edges is not None:
            hits = hits.unionByName(self.expanded(q, hits))
        hits = fusion.reranked_order(hits.groupBy("query_id", "doc_id").agg(F.max("score").alias("score"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("channels")))).alias("channels")))
        out = fusion.rerank(hits, self.chunks, q, window=c.rerank_window, beta=c.beta)
        return out.join(q.select("query_id", "effective_k"), "query_id").where(F.col("rank") <= F.col("effective_k")).select("query_id", "doc_id", "score", "rank", "channels")

    def expanded(self, q: DataFrame, hits: DataFrame) -> DataFrame:
        """Hits that a walk from the first `seeds` hits of graph-mode questions finds, scored by the share of question
        words a chunk has, its depth, relation and confidence."""
        c = self.config
        graph_q = q.where(F.col("mode") == "GRAPH_AUGMENTED").select("query_id", "text")
        seeds = hits.join(graph_q.select("query_id"), "query_id", "left_semi").where(F.col("rank") <= c.seeds)
        w = graph.walk(seeds.select("query_id", F.col("doc_id").alias("node"), F.col("rank").alias("ord")), self.edges, graph.searchable(self.chunks), c.depths, c.walk_limit)
        t = w.join(graph_q.withColumnRenamed("text", "__q"), "query_id").join(self.chunks.select(F.col("doc_id").alias("node"), F.col("text").alias("__t")), "node")
        s = graph.scored(t, fusion.overlap_score(F.col("__q"), F.col("__t")), c.gamma)
        return s.select("query_id", F.col("node").alias("doc_id"), "score", F.array(F.lit("graph")).alias("channels"), F.lit(0).alias("rank"))


__all__ = ["Config", "HybridSearch", "d"]
