"""Embedding near-dedup by the epsilon grid order join."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import components, groups, in_arrow, stored, table
from .jaccard import least_labels

COSINE = 0.93
BLOCK = 1024
LEADING = 8  # principal dimensions that order the grid
SAMPLE = 2000  # vectors the principal directions are taken from; any directions give the same result
FAN = 16  # intervals of one level in one of the level above
LEAF = 64  # vectors of an interval that isn't halved any more
PLACED = "sid long, grp string, copies long, embedding array<double>, proj array<double>, cells array<int>"


def _basis(vectors: DataFrame, sample: int, leading: int) -> dict[int, np.ndarray]:
    rows = vectors.select("embedding", F.size("embedding").alias("dim")).orderBy("h", "embedding").limit(sample).collect()
    out = {}
    for dim in {r.dim for r in rows}:
        x = np.array([r.embedding for r in rows if r.dim == dim], np.float64)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        out[dim] = np.linalg.svd(x - x.mean(0), full_matrices=False)[2][:leading].T.copy()
    return out


def _placed(vectors: DataFrame, basis: dict[int, np.ndarray], epsilon: float, leading: int) -> DataFrame:
    """vectors with their coordinates on the principal directions and grid cells of side epsilon."""

    def run(batches):
        for b in batches:
            v = b.column("embedding")
            proj = np.zeros((b.num_rows, leading))
            dim = np.diff(v.offsets.to_numpy())
            flat, at = v.flatten().to_numpy(), v.offsets.to_numpy() - v.offsets[0].as_py()
            for d in np.unique(dim):
                k = np.flatnonzero(dim == d)
                m = basis.get(int(d))
                if m is None:
                    continue
                x = flat[(at[k][:, None] + np.arange(d)[None, :])]
                x = x / np.linalg.norm(x, axis=1, keepdims=True)
                proj[k, : m.shape[1]] = x @ m
            cells = np.floor(proj / epsilon).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(proj.tolist(), pa.list_(pa.float64())), pa.array(cells.tolist(), pa.list_(pa.int32()))], names=[*b.schema.names, "proj", "cells"])

    return vectors.transform(in_arrow, run, PLACED)


def _sequence(placed: DataFrame, block: int) -> DataFrame:
    """Vectors in grid order (group, then cells lexicographically), cut into blocks of `block` within each group."""

    def run(batches):
        part, seen = TaskContext.get().partitionId(), {}
        for b in batches:
            rank = []
            for g in b.column("grp").to_pylist():
                seen[g] = seen.get(g, -1) + 1
                rank.append(seen[g])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([part] * b.num_rows, pa.int32()), pa.array(rank, pa.int64())], names=[*b.schema.names, "part", "rank"])

    order = ["grp", "cells", "sid"]
    seq = stored(placed.repartitionByRange(*order).sortWithinPartitions(*order).transform(in_arrow, run, f"{PLACED}, part int, rank long"))
    # rows: tasks times groups in them; a running sum over a group's tasks
    by = Window.partitionBy("grp").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = seq.groupBy("grp", "part").agg(F.count("*").alias("n")).select("grp", "part", F.coalesce(F.sum("n").over(by), F.lit(0)).alias("before"))
    return seq.join(before, ["grp", "part"]).select("sid", "grp", "copies", "embedding", "proj", F.floor((F.col("before") + F.col("rank")) / block).alias("blk"))


def _box(leading: int) -> list[str]:
    return [f"{e}{k}" for e in ("lo", "hi") for k in range(leading)]


def _near(leading: int, epsilon: float, a: str, b: str):
    """Whether two boxes are within epsilon of one another."""
    d = [F.greatest(F.lit(0.0), F.col(f"{a}.lo{k}") - F.col(f"{b}.hi{k}"), F.col(f"{b}.lo{k}") - F.col(f"{a}.hi{k}")) for k in range(leading)]
    return sum((x * x for x in d), F.lit(0.0)) <= (epsilon + 1e-6) ** 2


def _pairs(blocks: DataFrame, epsilon: float, leading: int, fan: int = FAN) -> DataFrame:
    """(grp, bi, bj), bi <= bj: blocks whose boxes are within epsilon.

    The recursive join of the sequence with itself: `fan` intervals of a level make one of the level above, up to a single
    interval a group. A pair of intervals that are near opens into the pairs of its parts; all others are skipped with all
    that is below them. A round takes one level of all groups; each is a join on the parts' parents, `fan` rows a key."""
    lows = [(F.min if c.startswith("lo") else F.max)(c).alias(c) for c in _box(leading)]
    levels = [blocks.withColumnRenamed("blk", "at").select("grp", "at", *_box(leading))]
    top = int(levels[0].agg(F.coalesce(F.max("at"), F.lit(0))).first()[0])
    while top:
        up = levels[-1].withColumn("at", F.floor(F.col("at") / fan)).groupBy("grp", "at").agg(*lows)
        levels.append(stored(up))
        top //= fan
    pairs = levels[-1].select("grp", F.col("at").alias("i"), F.col("at").alias("j"))
    for low in levels[-2::-1]:
        x = low.withColumn("up", F.floor(F.col("at") / fan))
        a, b = x.alias("a"), x.alias("b")
        p = pairs.alias("p").join(a, (F.col("p.grp") == F.col("a.grp")) & (F.col("p.i") == F.col("a.up"))).join(b, (F.col("p.grp") == F.col("b.grp")) & (F.col("p.j") == F.col("b.up")))
        p = p.where((F.col("a.at") <= F.col("b.at")) & _near(leading, epsilon, "a", "b"))
        pairs = stored(p.select(F.col("p.grp").alias("grp"), F.col("a.at").alias("i"), F.col("b.at").alias("j")))
    return pairs.toDF("grp", "bi", "bj")


def interval_join(place: np.ndarray, a: tuple[int, int], b: tuple[int, int], epsilon: float, leaf: int = LEAF):
    """Pairs of intervals (slices of two ranges of rows in grid order) that must be compared; a and b the same range, or
    apart. A pair whose boxes are over epsilon apart is skipped; of others the longer side is halved, down to `leaf`."""
    todo = [(a, b)]
    while todo:
        (s, e), (t, f) = todo.pop()
        x, y = place[s:e], place[t:f]
        gap = np.maximum(0.0, np.maximum(x.min(0) - y.max(0), y.min(0) - x.max(0)))
        if (gap * gap).sum() > (epsilon + 1e-6) ** 2:
            continue
        if max(e - s, f - t) <= leaf:
            yield slice(s, e), slice(t, f)
        elif (s, e) == (t, f):
            m = (s + e) // 2
            todo += [((s, m), (s, m)), ((s, m), (m, e)), ((m, e), (m, e))]
        elif e - s >= f - t:
            m = (s + e) // 2
            todo += [((s, m), (t, f)), ((m, e), (t, f))]
        else:
            m = (t + f) // 2
            todo += [((s, e), (t, m)), ((s, e), (m, f))]


def _compare(cosine: float, epsilon: float, basis: dict[int, np.ndarray]):
    def run(batches):
        for (_, bi, bj), g in groups(batches, ["grp", "bi", "bj"]):
            n = g.num_rows
            x = g.column("embedding").combine_chunks().flatten().to_numpy().reshape(n, -1)
            own, sid, copies = (g.column(c).to_numpy() for c in ("blk", "sid", "copies"))
            norm = np.linalg.norm(x, axis=1)
            m = basis.get(x.shape[1])
            place = x @ m / norm[:, None] if m is not None else np.zeros((n, 1))
            order = np.lexsort((*np.floor(place / epsilon).T[::-1], own == bj))
            x, own, sid, copies, norm, place = x[order], own[order], sid[order], copies[order], norm[order], place[order]
            half = n if bi == bj else int((own == bi).sum())
            links, found = np.zeros(n, np.int64), []
            if half and (bi == bj or half < n):
                for a, b in interval_join(place, (0, half), (0, n) if bi == bj else (half, n), epsilon):
                    near = x[a] @ x[b].T / (norm[a][:, None] * norm[b][None, :]) >= cosine
                    if a == b:
                        np.fill_diagonal(near, False)
                        links[a] += near @ copies[b]
                        i, j = np.nonzero(np.triu(near))
                    else:
                        links[a] += near @ copies[b]
                        links[b] += near.T @ copies[a]
                        i, j = np.nonzero(near)
                    found.append((i + a.start, j + b.start))
            if not found:
                continue
            lab = least_labels(n, np.concatenate([i for i, _ in found]), np.concatenate([j for _, j in found]))
            k = np.flatnonzero(links)
            if len(k):
                yield pa.RecordBatch.from_arrays([pa.array(sid[k]), pa.array(sid[lab[k]]), pa.array(links[k])], names=["sid", "to", "links"])

    return run


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, block: int = BLOCK, leading: int = LEADING, sample: int = SAMPLE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of vectors(vec_id, label, embedding).

    Vectors of one label (and size) are compared by cosine, which bounds the distance of their unit vectors by epsilon.
    They are sorted by the grid cells of side epsilon on the leading principal directions, and the sequence is joined
    with itself recursively: intervals of any level whose boxes are over epsilon apart are skipped, down to blocks (by
    joins of intervals) and within them (by halving); what remains is compared exactly in double precision. Equal vectors
    are one row with its copies, so copies never meet in pairs, and a pair of blocks gives a spanning forest and counts,
    not pairs. Vectors are the same if label, size and two 64-bit hashes are.

    n_links counts other rows, copies included; component_id is the least vec_id reachable. Null labels, and vectors that
    are null, empty, zero or hold null or non-finite components link with nothing. Repeated rows are copies; a null id is
    its own component of null; an empty table gives no rows; other columns are ignored."""
    epsilon = math.sqrt(2 - 2 * cosine)
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    odd = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    fit = F.col("label").isNotNull() & F.col("embedding").isNotNull() & ~F.coalesce(odd, F.lit(True)) & F.coalesce(F.exists("embedding", lambda x: x != 0), F.lit(False))
    v = v.withColumn("fit", F.coalesce(fit, F.lit(False)))
    same = ["grp", "h", "h2"]
    v = stored(v.select("vec_id", "fit", F.concat_ws(":", F.size("embedding").cast("string"), "label").alias("grp"), F.xxhash64("embedding").alias("h"), F.xxhash64(F.lit("2"), "embedding").alias("h2"), "embedding"))
    reps = v.where("fit").groupBy(*same).agg(F.min("vec_id").alias("vec"), F.count("*").alias("copies"), F.first("embedding").alias("embedding"))
    reps = stored(reps.withColumn("sid", F.monotonically_increasing_id()))
    basis = _basis(reps, sample, leading)
    seq = stored(_sequence(_placed(reps.select("sid", "grp", "copies", "embedding"), basis, epsilon, leading), block))
    boxes = stored(seq.groupBy("grp", "blk").agg(*[f(F.get("proj", F.lit(k))).alias(f"{e}{k}") for e, f in (("lo", F.min), ("hi", F.max)) for k in range(leading)]))
    pairs = _pairs(boxes, epsilon, leading)
    sides = pairs.withColumn("blk", F.explode(F.array_distinct(F.array("bi", "bj"))))
    keys = ["grp", "bi", "bj"]
    rows = sides.join(seq.select("grp", "blk", "sid", "copies", "embedding"), ["grp", "blk"]).select(*keys, "blk", "sid", "copies", "embedding")
    found = stored(rows.repartition(*keys).sortWithinPartitions(*keys).transform(in_arrow, _compare(cosine, epsilon, basis), "sid long, to long, links long"))
    comp = components(found.select(F.col("sid").alias("a"), F.col("to").alias("b"))).withColumnsRenamed({"id": "sid"})
    links = found.groupBy("sid").agg(F.sum("links").alias("links"))
    s = stored(reps.select("sid", *same, "vec", "copies").join(comp, "sid", "left").join(links, "sid", "left").select(*same, "vec", F.coalesce("component", "sid").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")))
    least = s.groupBy("component").agg(F.min("vec").alias("component_id"))
    s = s.join(least, "component").select(*same, "n_links", "component_id")
    joined = v.where("fit").select("vec_id", *same).join(s, same).select("vec_id", "n_links", "component_id")
    alone = v.where("not fit").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return joined.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op1_embedding_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings", "vec_id", "label", "embedding"))


OP1_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
      WHERE list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.93),
r(id, c) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT l.b, r.c FROM r JOIN l ON r.id = l.a)
SELECT e.vec_id, (SELECT count(*) FROM l WHERE l.a = e.vec_id) AS n_links, min(r.c) AS component_id, e.vec_id = min(r.c) AS kept
FROM embeddings e JOIN r ON r.id = e.vec_id GROUP BY e.vec_id
"""
