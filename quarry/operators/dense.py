"""Exact vector search in blocks, and late interaction."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.arrow import groups
from ..functions.scores import d, dot

QUERY_BLOCK, CORPUS_BLOCK = 2048, 32_768


def top_inner(queries: DataFrame, corpus: DataFrame, k: int, qid: str = "query_id", key: str = "doc_id", vector: str = "embedding", places: int = 9) -> DataFrame:
    """(query, key, score, rank): the k greatest inner products of each query, in double precision.

    Both sides are dealt into blocks by hash; every pair of blocks is one matrix product that passes on its own k best,
    which a window merges. A query row is repeated once a corpus block and a corpus row once a query block, so the work
    is spread evenly whatever the keys, and no side is collected or broadcast."""
    nq, nc = (max(1, -(-df.count() // size)) for df, size in ((queries, QUERY_BLOCK), (corpus, CORPUS_BLOCK)))
    part = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    vec = F.col(vector).cast("array<double>").alias("v")
    q = queries.where(F.col(vector).isNotNull()).select(part(qid, nq).alias("i"), F.explode(F.sequence(F.lit(0), F.lit(nc - 1))).alias("j"), F.lit(0).alias("side"), F.col(qid).cast("long").alias("id"), vec)
    c = corpus.where(F.col(vector).isNotNull()).select(F.explode(F.sequence(F.lit(0), F.lit(nq - 1))).alias("i"), part(key, nc).alias("j"), F.lit(1).alias("side"), F.col(key).cast("long").alias("id"), vec)
    rows = q.unionByName(c).repartition("i", "j").sortWithinPartitions("i", "j")

    def run(batches):
        for _, g in groups(batches, ["i", "j"]):
            side, ids = g.column("side").to_numpy(), g.column("id").to_numpy()
            v = g.column("v").combine_chunks()
            x = v.flatten().to_numpy().reshape(g.num_rows, -1)
            a, b, qi, ci = x[side == 0], x[side == 1], ids[side == 0], ids[side == 1]
            if not len(a) or not len(b):
                continue
            for at in range(0, len(a), 256):
                s = a[at : at + 256] @ b.T
                r = np.round(s, places)
                order = np.lexsort((np.broadcast_to(ci, s.shape), -r), axis=1)[:, :k]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(qi[at : at + 256], order.shape[1])), pa.array(ci[order].ravel()), pa.array(np.take_along_axis(s, order, 1).ravel())], names=["q", "c", "score"])

    best = rows.mapInArrow(run, "q long, c long, score double")
    w = Window.partitionBy("q").orderBy(F.round("score", places).desc(), "c")
    out = best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return out.select(F.col("q").alias(qid), F.col("c").alias(key), "score", "rank")


def embedded(rows: DataFrame, model, text: str = "text", prefix: str = "", most: int = 512, name: str = "embedding") -> DataFrame:
    """rows with a vector of each text: `model` maps a text column to a vector column (a pandas_udf, say). Questions get an
    instruction as prefix, passages none; texts are cut to `most` words, as the model reads no more."""
    words = F.slice(F.split(F.trim(F.coalesce(F.col(text), F.lit(""))), "\\s+"), 1, most)
    return rows.withColumn(name, model(F.concat(F.lit(prefix), F.array_join(words, " "))))


def hashed_text(size: int = 8):
    """A model without weights for embedded(): the summed vectors of a text's tokens, of length 1."""
    from ..functions.text import tokens

    def model(c):
        zero = F.array(*[d(0)] * size)
        total = F.aggregate(F.transform(tokens(c), lambda t: char_vector(t, size)), zero, lambda a, v: F.zip_with(a, v, lambda x, y: x + y))
        norm = F.sqrt(F.aggregate(total, d(0), lambda a, x: a + x * x))
        return F.transform(total, lambda x: F.when(norm > 0, x / norm).otherwise(d(0)))

    return model


def add_vectors(new: DataFrame, folder: str, key: str = "doc_id") -> int:
    """Appends the vectors whose key the stored table lacks; how many."""
    from ..sources.readers import append_new

    return append_new(new, folder, key)


def token_vectors(chunks: DataFrame, key: str = "doc_id", text: str = "text", most: int = 220, vector=None) -> DataFrame:
    """(key, dv): the vectors of the distinct tokens among the first `most` of each chunk, what late interaction reads."""
    from ..functions.text import tokens

    t = chunks.select(key, F.explode(F.array_distinct(F.slice(tokens(text), 1, most))).alias("tok"))
    return t.select(key, (vector or char_vector)(F.col("tok")).alias("dv"))


def late_channel(questions: DataFrame, chunks: DataFrame, candidates: DataFrame, k: int, qid: str = "query_id", key: str = "doc_id", text: str = "text", vector=None, size: int | None = None) -> DataFrame:
    """(query, key, score): the k best of each question by late interaction among its candidates(query, key). Only the
    candidates' texts are read; each question token counts as often as it stands there."""
    from ..functions.text import tokens

    q = questions.select(qid, F.posexplode(tokens(text)).alias("pos", "tok")).select(qid, "pos", (vector or char_vector)(F.col("tok")).alias("qv"))
    c = candidates.select(qid, key).distinct()
    t = token_vectors(chunks.join(c.select(key).distinct(), key, "left_semi"), key, text, vector=vector)
    s = max_sim(q, t, c, qid, key, size or (8 if vector is None else None))
    w = Window.partitionBy(qid).orderBy(F.round("score", 9).desc(), key)
    return s.withColumn("n", F.row_number().over(w)).where(F.col("n") <= k).drop("n")


def char_vector(token, size: int = 8):
    """A vector of a token from its character pairs (feature hashing), for late interaction without a model."""
    padded = F.concat(F.lit("^"), token, F.lit("$"))
    pairs = F.transform(F.sequence(F.lit(1), F.length(padded) - 1), lambda i: F.pmod(F.conv(F.substring(F.md5(F.substring(padded, i, F.lit(2))), 1, 6), 16, 10).cast("long"), F.lit(size)))
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda k: F.size(F.filter(pairs, lambda p: p == k)).cast("double"))


def max_sim(query_tokens: DataFrame, doc_tokens: DataFrame, candidates: DataFrame, qid: str = "query_id", key: str = "doc_id", size: int | None = None, eps: float = 1e-8) -> DataFrame:
    """(query, key, score): for each query token its best cosine among the candidate's tokens, summed.

    query_tokens(query, pos, qv), doc_tokens(key, dv); candidates(query, key) bound which pairs meet. Vectors are divided
    by their norms before they meet; with `size`, their length, a product is plain arithmetic in compiled code."""
    n = lambda df, c: df.withColumn("__n", F.sqrt(dot(F.col(c), F.col(c))) + d(eps)).withColumn(c, F.transform(c, lambda x: x / F.col("__n"))).drop("__n")
    met = candidates.join(n(query_tokens, "qv"), qid).join(n(doc_tokens, "dv"), key)
    product = sum((F.get("qv", F.lit(i)) * F.get("dv", F.lit(i)) for i in range(size)), d(0)) if size else dot("qv", "dv")
    best = met.groupBy(qid, key, "pos").agg(F.max(product).alias("best"))
    return best.groupBy(qid, key).agg(F.sum("best").alias("score"))


def greedy_distinct(pairs: DataFrame, nodes: DataFrame, key: str = "vec_id") -> DataFrame:
    """Keys kept by a greedy pass in key order that drops a key similar to an earlier kept one; pairs(a, b), a < b.

    Rounds to a fixed point: a key falls if an earlier neighbour is kept, and is kept once all earlier neighbours have
    fallen; each round settles at least the first open key of every component. State is written to the shared folder."""
    open_ = nodes.select(F.col(key).alias("id"))
    from ..sources.shared import stored

    edges = stored(pairs.select("a", "b").distinct())
    kept = stored(open_.join(edges.select(F.col("b").alias("id")).distinct(), "id", "left_anti"))
    done_kept, todo = [kept], stored(open_.join(kept, "id", "left_anti"))
    while not todo.isEmpty():
        fallen = todo.join(edges.join(kept.withColumnRenamed("id", "a"), "a").select(F.col("b").alias("id")).distinct(), "id", "left_semi")
        fallen = stored(fallen)
        left = stored(todo.join(fallen, "id", "left_anti"))
        edges = stored(edges.join(left.withColumnRenamed("id", "a"), "a", "left_semi").join(left.withColumnRenamed("id", "b"), "b", "left_semi"))
        kept = stored(left.join(edges.select(F.col("b").alias("id")).distinct(), "id", "left_anti"))
        done_kept.append(kept)
        todo = stored(left.join(kept, "id", "left_anti"))
    out = done_kept[0]
    for k in done_kept[1:]:
        out = out.unionByName(k)
    return out.withColumnRenamed("id", key)


def similar_pairs(vectors: DataFrame, cosine_least: float, key: str = "vec_id", block: str = "label", vector: str = "embedding") -> DataFrame:
    """(a, b, sim), a < b, of vectors of one block whose cosine is at least the bound. Blocks are cut into pieces whose
    pairs are compared as matrix products, so a block of any size is spread over tasks."""
    v = vectors.select(F.col(block).alias("grp"), F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    size = v.groupBy("grp").agg(F.ceil(F.count("*") / 4096).cast("int").alias("parts"))
    v = v.join(size, "grp").withColumn("own", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    rows = v.withColumn("x", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("grp", F.least("x", "own").alias("i"), F.greatest("x", "own").alias("j"), "own", "id", "v").repartition("grp", "i", "j").sortWithinPartitions("grp", "i", "j")

    def run(batches):
        for (_, i, j), g in groups(batches, ["grp", "i", "j"]):
            x = g.column("v").combine_chunks().flatten().to_numpy().reshape(g.num_rows, -1)
            ids, own = g.column("id").to_numpy(), g.column("own").to_numpy()
            norm = np.linalg.norm(x, axis=1)
            s = x @ x.T / np.maximum(norm[:, None] * norm[None, :], 1e-300)
            ok = (s >= cosine_least) & (ids[:, None] < ids[None, :])
            if i != j:
                ok &= own[:, None] != own[None, :]
            a, b = np.nonzero(ok)
            yield pa.RecordBatch.from_arrays([pa.array(ids[a]), pa.array(ids[b]), pa.array(s[a, b])], names=["a", "b", "sim"])

    return rows.mapInArrow(run, T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType()), T.StructField("sim", T.DoubleType())]))


__all__ = ["top_inner", "char_vector", "max_sim", "greedy_distinct", "similar_pairs", "d"]
