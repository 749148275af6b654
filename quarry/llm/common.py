"""Shared helpers: reading tables, tables in the shared folder, Arrow batches, connected components."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.arrow import groups
from ..sources.shared import discard, shared_dir, stored


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


BATCH_BYTES = 4 << 20  # of an Arrow batch that goes to a Python worker, about


def in_arrow(df: DataFrame, run, schema) -> DataFrame:
    """df.mapInArrow(run, schema) whose input batches are bounded by bytes, not by rows alone: ten thousand long texts
    are never one batch. The bound is a setting of the session (a smaller one stays)."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    conf = df.sparkSession.conf
    now = conf.get(key, None) or ""
    m = re.fullmatch(r"(\d+)([bkm]?)b?", now.strip().lower())
    if not m or not 0 < int(m[1]) << 10 * "bkm".index(m[2] or "b") <= BATCH_BYTES:
        conf.set(key, str(BATCH_BYTES))
    return df.mapInArrow(run, schema)


def slices(batches, column: str = "text", most: int = 2_000_000):
    """Even slices of Arrow batches, about `most` bytes of the column each (one longer row is a slice of its own), smaller
    batches joined: what Python holds of the texts at once stays small whatever the batch size. Freed memory goes back to
    the system now and then and at the task's end, as a worker that waits for its next task keeps what it holds."""
    import ctypes
    import gc

    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    try:
        trim = ctypes.CDLL(None).malloc_trim
    except (AttributeError, OSError):  # another C library
        trim = lambda _: 0
    place = lambda b: b.column(b.schema.get_field_index(column))

    def joined():
        held, size = [], 0
        for b in batches:
            if not b.num_rows:
                continue
            n = place(b).nbytes
            if held and size + n > 1.25 * most:
                yield held
                held, size = [], 0
            held.append(b)
            size += n
        if held:
            yield held

    def release():
        pa.default_memory_pool().release_unused()
        trim(0)

    passed = 0
    for held in joined():
        b = held[0] if len(held) == 1 else pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        size = np.cumsum(pc.fill_null(pc.binary_length(place(b)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 16)
        each = size[-1] / max(1, round(size[-1] / most))
        s = 0
        while s < b.num_rows:
            e = max(s + 1, int(np.searchsorted(size, (size[s - 1] if s else 0) + each + 16, "right")))
            yield b.slice(s, e - s)
            s = e
        passed += int(size[-1])
        if passed > 4 * BATCH_BYTES:
            passed = 0
            release()
    held = b = None
    gc.collect()
    release()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(id, component) for every id in edges(a, b), component being the smallest id reachable.

    Contraction: each round points every root at its smallest neighbouring root, shortens the pointers, renames the
    edges to the roots they now lead to and drops those that became loops. Everything stays distributed; each round
    is written to the shared folder, so lineage stays short. A hub with any number of neighbours is one partial
    minimum and one equi-join that adaptive execution can split."""
    e = stored(edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    both = lambda d: d.select("a", "b").unionByName(d.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = None
    for _ in range(max_rounds):
        if e.isEmpty():
            break
        p = both(e).groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.col("id")).alias("to"))
        q = p.select(F.col("id").alias("to"), F.col("to").alias("to2"))
        p = stored(p.join(q, "to", "left").select("id", F.least("to", F.coalesce("to2", "to")).alias("to")))
        q = p.select(F.col("id").alias("to"), F.col("to").alias("to2"))
        jumped = stored(p.join(q, "to", "left").select("id", F.coalesce("to2", "to").alias("to")))
        discard(p)
        pa_, pb = jumped.select(F.col("id").alias("a"), F.col("to").alias("a2")), jumped.select(F.col("id").alias("b"), F.col("to").alias("b2"))
        nxt = stored(e.join(pa_, "a").join(pb, "b").where("a2 <> b2").select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b")).distinct())
        discard(e)
        e = nxt
        if labels is None:
            labels = jumped.withColumnRenamed("to", "component")
            labels.stored_path = jumped.stored_path
        else:
            step = jumped.select(F.col("id").alias("component"), F.col("to").alias("c2"))
            new = stored(labels.join(step, "component", "left").select("id", F.coalesce("c2", "component").alias("component")))
            discard(labels)
            discard(jumped)
            labels = new
    else:
        raise RuntimeError("components did not settle")
    discard(e)
    if labels is None:
        return edges.sparkSession.createDataFrame([], "id long, component long")
    return labels


__all__ = ["components", "discard", "groups", "in_arrow", "shared_dir", "slices", "stored", "table"]
