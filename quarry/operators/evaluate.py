"""Ranking metrics of runs against gold sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import d


def distinct_ranks(runs: DataFrame, qid: str = "query_id", key: str = "doc_id") -> DataFrame:
    """runs(system, query, key, rank) with each key once, at its first place, ranked anew."""
    r = runs.groupBy("system", qid, key).agg(F.min("rank").alias("first"))
    return r.withColumn("rank", F.row_number().over(Window.partitionBy("system", qid).orderBy("first", key))).drop("first")


def metrics(runs: DataFrame, gold: DataFrame, questions: DataFrame, cutoffs: tuple[int, ...] = (3, 5, 10), qid: str = "query_id", key: str = "doc_id") -> DataFrame:
    """(system, query, hit@k, recall@k, mrr@k, ndcg@k) for every question and system, also those that found nothing.

    gold(query, key). Gains are binary; the ideal ranks min(k, gold size) first; no gold gives 0."""
    g = gold.select(qid, key).distinct()
    size = g.groupBy(qid).agg(F.count("*").alias("n_gold"))
    r = distinct_ranks(runs, qid, key).join(g.withColumn("gold", F.lit(1)), [qid, key], "left")
    hit = lambda k: F.col("gold").isNotNull() & (F.col("rank") <= k)
    agg = []
    for k in cutoffs:
        agg += [F.count(F.when(hit(k), 1)).alias(f"found_{k}"), F.min(F.when(hit(k), F.col("rank"))).alias(f"first_{k}"), F.coalesce(F.sum(F.when(hit(k), d(1) / F.log2(F.col("rank").cast("double") + d(1)))), d(0)).alias(f"dcg_{k}")]
    found = r.groupBy("system", qid).agg(*agg)
    all_ = questions.select(qid).join(F.broadcast(runs.select("system").distinct()))
    x = all_.join(found, ["system", qid], "left").join(size, qid, "left").withColumn("n_gold", F.coalesce("n_gold", F.lit(0)))
    out = []
    for k in cutoffs:
        ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.least(F.col("n_gold").cast("int"), F.lit(k)), F.lit(1))), d(0), lambda s, i: s + d(1) / F.log2(i.cast("double") + d(1)))
        out += [
            (F.coalesce(F.col(f"found_{k}"), F.lit(0)) > 0).cast("double").alias(f"hit_{k}"),
            F.when(F.col("n_gold") > 0, F.coalesce(F.col(f"found_{k}"), F.lit(0)).cast("double") / F.col("n_gold").cast("double")).otherwise(d(0)).alias(f"recall_{k}"),
            F.coalesce(d(1) / F.col(f"first_{k}").cast("double"), d(0)).alias(f"mrr_{k}"),
            F.when(F.col("n_gold") > 0, F.coalesce(F.col(f"dcg_{k}"), d(0)) / ideal).otherwise(d(0)).alias(f"ndcg_{k}"),
        ]
    return x.select("system", qid, *out)


def summary(m: DataFrame, columns: list[str], places: int = 3) -> DataFrame:
    """Mean, sample deviation and count of each metric by system."""
    return m.groupBy("system").agg(F.count("*").alias("n"), *[x for c in columns for x in (F.round(F.avg(c), places).alias(f"{c}_mean"), F.round(F.coalesce(F.stddev_samp(c), d(0)), places).alias(f"{c}_std"))])


def report(m: DataFrame, columns: list[str], by: str = "recall_10", order: list[str] | None = None) -> DataFrame:
    """Means of each metric by system with their place: in the order given (systems it lacks go last, by name), else by
    falling `by`."""
    g = m.groupBy("system").agg(*[F.avg(c).alias(c) for c in columns])
    if order:
        at = F.array_position(F.array(*[F.lit(x) for x in order]), F.col("system"))
        keys = [F.when(at == 0, F.lit(len(order) + 1)).otherwise(at), F.col("system")]
    else:
        keys = [F.col(by).desc(), F.col("system")]
    return g.withColumn("place", F.row_number().over(Window.orderBy(*keys)))  # a row a system


def compared(systems: dict[str, DataFrame], qid: str = "query_id", key: str = "doc_id") -> DataFrame:
    """runs(system, query, key, rank) of any number of systems' hits in one table, for one pass of metrics()."""
    out = None
    for name, hits in systems.items():
        r = hits.select(F.lit(name).alias("system"), qid, key, "rank")
        out = r if out is None else out.unionByName(r)
    return out
