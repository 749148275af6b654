"""BM25 (Okapi) over an inverted index kept as tables."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.arrow import groups
from ..functions.scores import d
from ..functions.text import tokens
from ..sources.readers import first_by_id
from ..sources.registry import Registry
from ..sources.shared import stored

K1, B, EPSILON = 1.5, 0.75, 0.25
DEAL, DEAL_TOKENS, QUERY_BLOCK = 32_768, 2 << 20, 1024  # chunks of a deal, tokens of a deal and queries of a block, about


def postings(chunks: DataFrame, key: str = "doc_id", text: str = "text", tokenizer=tokens) -> DataFrame:
    """(term, key, tf, dl): one row for each term of each chunk. Tokens are counted before the shuffle; the chunk's
    length travels with them, so scoring needs no further join for it."""
    t = chunks.select(F.col(key), tokenizer(text).alias("t")).select(key, F.size("t").cast("double").alias("dl"), F.explode("t").alias("term"))
    return t.groupBy("term", key, "dl").agg(F.count("*").cast("double").alias("tf"))


def corpus_stats(chunks: DataFrame, post: DataFrame) -> DataFrame:
    """One row: n chunks, mean length. The lengths are those of the postings, so no text is read."""
    n = chunks.agg(F.count("*").cast("double").alias("n"))
    return n.crossJoin(F.broadcast(post.agg(F.coalesce(F.sum("tf"), d(0)).alias("all")))).select("n", F.try_divide("all", "n").alias("avgdl"))


def term_stats(post: DataFrame, stats: DataFrame, epsilon: float = EPSILON) -> DataFrame:
    """(term, df, idf): a negative idf becomes epsilon times the mean idf of all terms. Two one-row tables are joined in."""
    df = post.groupBy("term").agg(F.count("*").alias("df"))
    raw = df.crossJoin(F.broadcast(stats.select("n"))).withColumn("raw", F.log(F.col("n") - F.col("df") + d(0.5)) - F.log(F.col("df") + d(0.5)))
    mean = raw.agg(F.avg("raw").alias("mean_idf"))
    return raw.crossJoin(F.broadcast(mean)).select("term", "df", F.when(F.col("raw") < 0, d(epsilon) * F.col("mean_idf")).otherwise(F.col("raw")).alias("idf"))


def best(queries: DataFrame, post: DataFrame, terms: DataFrame, stats: DataFrame, k: int, qid: str = "query_id", key: str = "doc_id", text: str = "text", tokenizer=tokens, k1: float = K1, b: float = B, least: float | None = None, places: int = 9) -> DataFrame:
    """(query, chunk, score) of each query's k best chunks in each deal of chunks, and so of all its k best; scores over
    `least` only, if given. Repeated query tokens count each time.

    Postings and terms are cut to the queries' terms first. Chunks are dealt by hash of their key and queries by theirs;
    a task has the postings of a deal of chunks and the terms of a block of queries, sums what meets there as arrays and
    passes on k rows a query. So however common a term is, its postings are spread over the deals, and the pairs of query
    and chunk, nearly all there are, never leave a task. Deals are as many as the chunks or their tokens ask for, so long
    chunks don't make a task's arrays longer."""
    q = queries.select(F.col(qid), F.explode(tokenizer(text)).alias("term")).groupBy(qid, "term").agg(F.count("*").cast("double").alias("x"))
    q = stored(q)
    wanted = stored(q.select("term").distinct().withColumn("tid", F.monotonically_increasing_id()))
    size = stats.first()
    n, all_ = size.n or 0, (size.n or 0) * (size.avgdl or 0)
    deals, blocks = max(1, math.ceil(n / DEAL), math.ceil(all_ / DEAL_TOKENS)), max(1, math.ceil(q.select(qid).distinct().count() / QUERY_BLOCK))
    tf = F.col("tf")
    p = post.join(wanted, "term").join(terms.select("term", "idf").join(wanted.select("term"), "term", "left_semi"), "term")
    p = p.crossJoin(F.broadcast(stats.select("avgdl"))).withColumn("x", F.col("idf") * tf * d(k1 + 1) / (tf + d(k1) * (d(1 - b) + d(b) * F.col("dl") / F.col("avgdl"))))
    part = lambda c, m: F.pmod(F.xxhash64(c), F.lit(m)).cast("int")
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    none = lambda df, c: F.lit(None).cast(df.schema[c].dataType).alias(c)
    qs = q.join(wanted, "term").select(part(qid, blocks).alias("i"), every(deals).alias("j"), "tid", "x", F.col(qid).alias("__q"), none(post, key).alias("__k"))
    ps = p.select(every(blocks).alias("i"), part(key, deals).alias("j"), "tid", "x", none(queries, qid).alias("__q"), F.col(key).alias("__k"))
    rows = qs.unionByName(ps).repartition("i", "j").sortWithinPartitions("i", "j")
    out = T.StructType([T.StructField(qid, queries.schema[qid].dataType), T.StructField(key, post.schema[key].dataType), T.StructField("score", T.DoubleType())])

    def run(batches):
        for _, g in groups(batches, ["i", "j"]):
            is_q = pc.is_valid(g.column("__q")).to_numpy()
            tid, x = g.column("tid").to_numpy(), g.column("x").to_numpy()
            side = g.column("__q").filter(pa.array(is_q)).combine_chunks(), g.column("__k").filter(pa.array(~is_q)).combine_chunks()
            if not len(side[0]) or not len(side[1]):
                continue
            (names, at), (keys, doc) = (np.unique(c.to_numpy(zero_copy_only=False), return_inverse=True) for c in side)
            order = np.argsort(tid[~is_q], kind="stable")
            term, part_, doc = tid[~is_q][order], x[~is_q][order], doc[order]
            mine = np.argsort(at, kind="stable")
            at, wants, weight = at[mine], tid[is_q][mine], x[is_q][mine]
            lo, hi = np.searchsorted(term, wants, "left"), np.searchsorted(term, wants, "right")
            step = max(1, 2_000_000 // len(keys))
            for first in range(0, len(names), step):
                r = slice(*np.searchsorted(at, (first, first + step)))
                size = hi[r] - lo[r]
                post_ = np.repeat(lo[r] - (np.cumsum(size) - size), size) + np.arange(size.sum())
                cell = np.repeat(at[r] - first, size) * len(keys) + doc[post_]
                m = min(step, len(names) - first)
                total = np.bincount(cell, np.repeat(weight[r], size) * part_[post_], m * len(keys)).reshape(m, -1)
                met = np.bincount(cell, minlength=m * len(keys)).reshape(m, -1) > 0
                if least is not None:
                    met &= total > least
                for y in range(m):
                    found = np.flatnonzero(met[y])
                    rounded = np.round(total[y, found], places)
                    if len(found) > 4 * k:
                        some = rounded >= np.partition(rounded, -k)[-k]
                        found, rounded = found[some], rounded[some]
                    found = found[np.lexsort((found, -rounded))[:k]]
                    if len(found):
                        yield pa.RecordBatch.from_arrays([pa.array([names[first + y]] * len(found), side[0].type), pa.array(keys[found], side[1].type), pa.array(total[y, found])], names=[qid, key, "score"])

    return rows.mapInArrow(run, out)


def top(scores: DataFrame, k: int | Column, qid: str = "query_id", key: str = "doc_id", places: int = 9) -> DataFrame:
    """The k best of each query with their rank; equal scores (to `places`) by key."""
    w = Window.partitionBy(qid).orderBy(F.round("score", places).desc(), key)
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def padded(hits: DataFrame, queries: DataFrame, chunks: DataFrame, k: int, qid: str = "query_id", key: str = "doc_id") -> DataFrame:
    """hits(query, key, score, rank), at most k a query, filled up to k with chunks of score 0 in key order.

    A query has at most k hits, so its missing ones are among the 2k least keys; only these rows are broadcast."""
    least = chunks.select(key).distinct().orderBy(key).limit(2 * k)
    zero = queries.select(qid).distinct().crossJoin(F.broadcast(least)).join(hits.select(qid, key), [qid, key], "left_anti").withColumn("score", d(0))
    both = hits.select(qid, key, "score", F.lit(0).alias("zero")).unionByName(zero.withColumn("zero", F.lit(1)))
    w = Window.partitionBy(qid).orderBy("zero", F.round("score", 9).desc(), key)
    return both.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).drop("zero")


class Index:
    """Postings, terms and statistics of a set of chunks, written once as the tables that all searches read; texts are
    tokenised once. With a registry they are a version there, which open() reads again in any session."""

    def __init__(self, chunks: DataFrame, key: str = "doc_id", text: str = "text", tokenizer=tokens, registry: Registry | None = None, version: str = "v1"):
        self.key, self.tokenizer = key, tokenizer

        def write(name: str, df: DataFrame) -> DataFrame:
            if registry is None:
                return stored(df)
            registry.write(version, name, df)
            return registry.read(name, version)

        self.post = write("postings", postings(chunks, key, text, tokenizer))
        self.stats = write("stats", corpus_stats(chunks, self.post))
        self.terms = write("terms", term_stats(self.post, self.stats))
        if registry is not None:
            registry.finish(version)

    @classmethod
    def open(cls, registry: Registry, version: str | None = None, key: str = "doc_id", tokenizer=tokens) -> Index:
        """The index of a version, by default the active one; fresh tables are a new version, so nothing is reloaded."""
        out = cls.__new__(cls)
        out.key, out.tokenizer = key, tokenizer
        out.post, out.stats, out.terms = (registry.read(t, version) for t in ("postings", "stats", "terms"))
        return out

    def search(self, queries: DataFrame, k: int, qid: str = "query_id", text: str = "text", least: float | None = None) -> DataFrame:
        return top(best(queries, self.post, self.terms, self.stats, k, qid, self.key, text, self.tokenizer, least=least), k, qid, self.key)


def search_by_lang(queries: DataFrame, chunks: DataFrame, k: int, tokenizers: dict | None = None, qid: str = "query_id", key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(query, chunk, score, rank): each question among the chunks of its language alone, with that language's statistics
    and tokenizer (tokens() where `tokenizers` names none). One index a language; languages are those of the questions,
    a hundred at most."""
    langs = sorted(r[0] for r in queries.where(F.col(lang).isNotNull()).select(lang).distinct().limit(101).collect())
    if len(langs) > 100:
        raise ValueError("more than a hundred languages")
    out = None
    for x in langs:
        found = Index(chunks.where(F.col(lang) == x), key, text, (tokenizers or {}).get(x, tokens)).search(queries.where(F.col(lang) == x), k, qid, text)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else Index(chunks.limit(0), key, text).search(queries.limit(0), k, qid, text)


def extended(old: DataFrame, new: DataFrame, key: str = "doc_id") -> DataFrame:
    """Chunks after an incremental add: those of new whose key is not there yet, once each, appended."""
    fresh = first_by_id(new.join(old.select(key), key, "left_anti"), key)
    return old.unionByName(fresh.select(old.columns))
