"""Score functions as column expressions. Every literal is a double, so no arithmetic turns decimal."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

#: Weights of relations in a walk.
RELATION_WEIGHT = {"defined_by": 1.20, "defines_term": 1.10, "cite": 1.15, "cited": 1.15, "ref": 1.15, "amend": 1.10, "next": 0.95, "prev": 0.95, "neighbor": 1.00}


def d(x: float) -> Column:
    return F.lit(float(x)).cast("double")


def minmax(score: Column, *keys: str) -> Column:
    """(score - least) / range within the keys; 0 where the range is under 1e-12."""
    w = Window.partitionBy(*keys)
    low, high = F.min(score).over(w), F.max(score).over(w)
    return F.when(high - low < d(1e-12), d(0)).otherwise((score - low) / (high - low))


def sigmoid(score: Column, temperature: float = 1.0) -> Column:
    return d(1) / (d(1) + F.exp(-score / d(temperature)))


def clip01(score: Column) -> Column:
    return F.least(F.greatest(score, d(0)), d(1))


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), d(0), lambda s, x: s + x)


def cosine(a, b, eps: float = 1e-8) -> Column:
    return dot(a, b) / ((F.sqrt(dot(a, a)) + d(eps)) * (F.sqrt(dot(b, b)) + d(eps)))


def depth_decay(depth: Column, gamma: float = 0.7) -> Column:
    return F.pow(d(1) + depth.cast("double"), d(-gamma))


def relation_weight(relations: Column) -> Column:
    """The greatest weight among the relations; 1 for others and for none."""
    table = F.create_map(*[x for k, v in RELATION_WEIGHT.items() for x in (F.lit(k), d(v))])
    return F.coalesce(F.array_max(F.transform(relations, lambda r: F.coalesce(F.try_element_at(table, r), d(1)))), d(1))


def mean_pooled(vectors: Column, mask: Column) -> Column:
    """Mean of the token vectors whose mask is 1, element by element; null if there is none."""
    kept = F.transform(F.filter(F.arrays_zip(vectors.alias("v"), mask.alias("m")), lambda x: x["m"] == 1), lambda x: x["v"])
    total = F.aggregate(F.slice(kept, 2, F.greatest(F.size(kept), F.lit(1))), F.transform(F.get(kept, F.lit(0)), lambda x: x.cast("double")), lambda a, v: F.zip_with(a, v, lambda x, y: x + y.cast("double")))
    return F.transform(total, lambda x: x / F.size(kept).cast("double"))
