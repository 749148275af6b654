"""Case search: filters, lexical and dense channels, reciprocal-rank fusion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scores import d
from . import bm25
from .fusion import ranked, reranked_order


def case_text() -> Column:
    return F.concat_ws("\n", *[F.nullif(F.trim(c), F.lit("")) for c in ("title", "facts", "issue", "holding")])


def matches(filters: dict[str, str], attrs: str = "attrs", lists: dict[str, str] | None = None) -> Column:
    """All filters hold: a list attribute holds the value, a scalar one contains it as text; a missing one fails."""
    ok = F.lit(True)
    for k, v in filters.items():
        if lists and k in lists:
            ok = ok & F.coalesce(F.array_contains(lists[k], v), F.lit(False))
        else:
            ok = ok & F.coalesce(F.try_element_at(F.col(attrs), F.lit(k)).contains(v), F.lit(False))
    return ok


def search(queries: DataFrame, cases: DataFrame, k: int = 10, dense: DataFrame | None = None, keep: Column | None = None, rrf_k: int = 60, qid: str = "query_id", key: str = "id", text: str = "text") -> DataFrame:
    """(query, case, score, rank): lexical hits with positive scores and `dense` hits (query, case, score), fused by
    reciprocal ranks to 3k, filtered, cut to k. The filter comes after the first cut, as a limit must not see it."""
    lexical = bm25.Index(cases, key, text).search(queries, 3 * k, qid, text, least=0.0).select(qid, key, F.lit("bm25").alias("channel"), "score")
    runs = lexical if dense is None else lexical.unionByName(dense.select(qid, key, F.lit("dense").alias("channel"), "score"))
    fused = ranked(runs, qid, key).groupBy(qid, key).agg(F.sum(d(1) / (d(rrf_k) + F.col("rank").cast("double"))).alias("score"))
    top = reranked_order(fused, qid, key).where(F.col("rank") <= 3 * k)
    if keep is not None:
        top = top.join(cases.where(keep).select(key), key, "left_semi")
    return reranked_order(top, qid, key).where(F.col("rank") <= k)


def add_cases(new: DataFrame, folder: str, key: str = "id") -> int:
    """Appends the cases whose id the stored table lacks; how many. A search after it indexes the table as it is then."""
    from ..sources.readers import append_new

    return append_new(new, folder, key)
