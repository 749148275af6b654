"""Fusion of channel results, deduplication with provenance, reranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import d, minmax, sigmoid

WEIGHTS = {"dense": 0.6, "bm25": 0.4, "colbert": 0.35}
RRF_K, ALPHA = 60, 0.5
RERANK_WINDOW, RERANK_BETA = 30, 0.35
LEAST_SCORE = 0.2
METHODS = ("weighted_sum", "rrf", "wrrf", "blend")


def ranked(runs: DataFrame, qid: str = "query_id", key: str = "doc_id") -> DataFrame:
    """runs(query, key, channel, score) with the rank of each row in its query and channel."""
    w = Window.partitionBy(qid, "channel").orderBy(F.round("score", 9).desc(), key)
    return runs.withColumn("rank", F.row_number().over(w))


def _weight(weights: dict) -> Column:
    out = F.lit(None).cast("double")
    for c, w in weights.items():
        out = F.when(F.col("channel") == c, d(w)).otherwise(out)
    return F.coalesce(out, d(0))


def contributions(runs: DataFrame, method: str = "blend", weights: dict = WEIGHTS, k: int = RRF_K, alpha: float = ALPHA, qid: str = "query_id", key: str = "doc_id") -> DataFrame:
    """(query, key, channel, rank, norm, rrf, rrf_norm, weighted_sum, score, contrib): a row for each channel of each hit.

    Ranks and min-max norms are windows of one sort by (query, channel). One aggregate by (query, key) sums channels, one
    window by query normalises the reciprocal-rank total; the channels stay in an array meanwhile, so nothing is joined
    back. Methods: weighted_sum; rrf; wrrf (weighted reciprocal ranks), both as min-max of the total; blend of rrf and
    weighted_sum by alpha. The reciprocal-rank part of a score is split over channels by their shares of the total."""
    if method not in METHODS:
        raise ValueError(f"unknown fusion method {method}")
    r = ranked(runs, qid, key).withColumn("norm", minmax(F.col("score"), qid, "channel")).withColumn("w", _weight(weights))
    rrf = (F.col("w") if method == "wrrf" else d(1)) / (d(k) + F.col("rank").cast("double"))
    r = r.withColumn("rrf", rrf).withColumn("wn", F.col("w") * F.col("norm"))
    g = r.groupBy(qid, key).agg(F.sum("rrf").alias("total"), F.sum("wn").alias("weighted_sum"), F.collect_list(F.struct("channel", "rank", "norm", "rrf", "wn")).alias("c"))
    g = g.withColumn("rrf_norm", minmax(F.col("total"), qid))
    a = {"weighted_sum": 0.0, "rrf": 1.0, "wrrf": 1.0, "blend": alpha}[method]
    b = {"weighted_sum": 1.0, "rrf": 0.0, "wrrf": 0.0, "blend": 1.0 - alpha}[method]
    g = g.withColumn("score", d(a) * F.col("rrf_norm") + d(b) * F.col("weighted_sum"))
    part = d(a) * F.col("rrf_norm") * F.col("c.rrf") / F.col("total") + d(b) * F.col("c.wn")
    return g.withColumn("c", F.explode("c")).select(qid, key, F.col("c.channel").alias("channel"), F.col("c.rank").alias("rank"), F.col("c.norm").alias("norm"), F.col("c.rrf").alias("rrf"), "rrf_norm", "weighted_sum", "score", part.alias("contrib"))


def fuse(runs: DataFrame, method: str = "blend", weights: dict = WEIGHTS, k: int = RRF_K, alpha: float = ALPHA, qid: str = "query_id", key: str = "doc_id") -> DataFrame:
    """(query, key, score, rrf_norm, weighted_sum, channels, contrib, rank): channels by falling contribution, then name."""
    c = contributions(runs, method, weights, k, alpha, qid, key)
    g = c.groupBy(qid, key).agg(F.first("score").alias("score"), F.first("rrf_norm").alias("rrf_norm"), F.first("weighted_sum").alias("weighted_sum"), F.sort_array(F.collect_list(F.struct("contrib", "channel")), asc=False).alias("c"))
    g = g.select(qid, key, "score", "rrf_norm", "weighted_sum", F.col("c.channel").alias("channels"), F.map_from_arrays("c.channel", "c.contrib").alias("contrib"))
    return reranked_order(g, qid, key)


def reranked_order(hits: DataFrame, qid: str = "query_id", key: str = "doc_id") -> DataFrame:
    w = Window.partitionBy(qid).orderBy(F.round("score", 9).desc(), key)
    return hits.drop("rank").withColumn("rank", F.row_number().over(w))


def keep_best(hits: DataFrame, qid: str = "query_id", key: str = "doc_id") -> DataFrame:
    """hits(query, key, score, channel array, contrib map) -> the best score of each chunk, its channels joined, its
    contributions summed; channels by falling contribution, then name."""
    c = hits.select(qid, key, F.explode_outer("contrib").alias("ch", "v")).where("ch is not null").groupBy(qid, key, "ch").agg(F.sum("v").alias("v"))
    c = c.groupBy(qid, key).agg(F.collect_list(F.struct("v", "ch")).alias("sums"))
    g = hits.groupBy(qid, key).agg(F.max("score").alias("score"), F.array_distinct(F.flatten(F.collect_list(F.coalesce("channel", F.array().cast("array<string>"))))).alias("all"))
    g = g.join(c, [qid, key], "left").withColumn("sums", F.coalesce("sums", F.array().cast("array<struct<v:double,ch:string>>")))
    known = F.map_from_arrays("sums.ch", "sums.v")
    order = F.sort_array(F.transform("all", lambda x: F.struct((-F.coalesce(F.try_element_at(known, x), d(0))).alias("v"), x.alias("ch"))))
    return reranked_order(g.select(qid, key, "score", order["ch"].alias("channel"), known.alias("contrib")), qid, key)


def merged_channels(runs: DataFrame, channels: list[str], qid: str = "query_id", key: str = "doc_id") -> DataFrame:
    """One row a chunk with a score column for each channel, 0 where it is absent: a pivot, not a chain of outer joins."""
    return runs.groupBy(qid, key).agg(*[F.coalesce(F.max(F.when(F.col("channel") == c, F.col("score"))), d(0)).alias(c) for c in channels], F.sort_array(F.collect_set("channel")).alias("channels"))


def overlap_score(question, text) -> Column:
    """Stand-in for a model: share of the question's distinct tokens that the text has."""
    from ..functions.text import tokens

    q = F.array_distinct(tokens(question))
    return F.when(F.size(q) == 0, d(0)).otherwise(F.size(F.array_intersect(q, tokens(text))).cast("double") / F.size(q).cast("double"))


def normalised_scores(hits: DataFrame, how: str = "minmax", temperature: float = 1.0, qid: str = "query_id", raw: str = "raw") -> Column:
    if how == "minmax":
        return minmax(F.col(raw), qid)
    if how == "sigmoid":
        return sigmoid(F.col(raw), temperature)
    if how == "none":
        return F.col(raw)
    raise ValueError(f"unknown normalisation {how}")


def rerank(hits: DataFrame, chunks: DataFrame, questions: DataFrame, scorer=overlap_score, window: int = RERANK_WINDOW, beta: float = RERANK_BETA, how: str = "minmax", temperature: float = 1.0, qid: str = "query_id", key: str = "doc_id", text: str = "text") -> DataFrame:
    """hits(query, key, score, rank) with the first `window` rescored as (1 - beta) * score + beta * norm of the scorer
    over question and chunk text; the rest keep their scores; all are ranked anew. Texts join only those rows."""
    head = hits.where(F.col("rank") <= window)
    t = head.join(questions.select(qid, F.col(text).alias("__q")), qid).join(chunks.select(key, F.col(text).alias("__t")), key)
    t = t.withColumn("raw", scorer(F.col("__q"), F.col("__t"))).drop("__q", "__t")
    t = t.withColumn("norm", normalised_scores(t, how, temperature, qid))
    t = t.withColumn("score", d(1 - beta) * F.col("score") + d(beta) * F.col("norm"))
    tail = hits.where(F.col("rank") > window).withColumn("raw", F.lit(None).cast("double")).withColumn("norm", F.lit(None).cast("double"))
    return reranked_order(t.unionByName(tail), qid, key)


def scored_once(pairs: DataFrame, scorer, memo: DataFrame | None = None, question: str = "q", text: str = "t") -> tuple[DataFrame, DataFrame]:
    """(pairs with `raw`, memo): each distinct question and text is scored once, and not at all if the memo has it; the
    memo (q_hash, t_hash, raw) holds the old and the new scores. For scorers that cost more than two joins."""
    from ..sources.shared import stored

    own = pairs.columns
    p = pairs.withColumn("q_hash", F.sha2(F.coalesce(question, F.lit("")), 256)).withColumn("t_hash", F.sha2(F.coalesce(text, F.lit("")), 256))
    key = ["q_hash", "t_hash"]
    new = p.groupBy(*key).agg(F.first(question).alias(question), F.first(text).alias(text))
    if memo is not None:
        new = new.join(memo, key, "left_anti")
    new = stored(new.select(*key, scorer(F.col(question), F.col(text)).alias("raw")))
    memo = new if memo is None else memo.select(*key, "raw").unionByName(new)
    return p.join(memo, key).select(*own, "raw"), memo


def chosen_scorer(n: int, model=None, cross_encoder=None, most: int = 30):
    """The scorer of n hits a question: the language model if there is one and n is at most `most`, else the cross-encoder,
    else word overlap."""
    return model if model and n <= most else cross_encoder or overlap_score


def parsed_judgement(answer) -> Column:
    """Score in 0 to 1 from a model's answer: the JSON field `score`, else the first number, else 0."""
    from ..functions.text import json_object, text_of

    field = F.get_json_object(json_object(answer), "$.score").cast("double")
    number = F.nullif(F.regexp_extract(text_of(answer), "\\d+(?:\\.\\d+)?", 0), F.lit("")).cast("double")
    return F.least(F.greatest(F.coalesce(field, number, d(0)), d(0)), d(1))
