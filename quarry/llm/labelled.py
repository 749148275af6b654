"""What the two text classifiers share: the held-out rule, a bounded sample of labelled rows, table-wide scoring."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_arrow, slices


def held_out(modulus: int, remainder: int):
    """crc32 of doc_id as text, mod modulus, is the remainder (a null id: of the empty text)."""
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(modulus)) == remainder


def training_rows(docs: DataFrame, labels: DataFrame, label: str, modulus: int, remainder: int, sample: int) -> DataFrame:
    """(text, y) of at most `sample` labelled rows outside the held-out part, the first by a hash of the id; equal
    texts with one label count once. The picked ids (`sample` rows at most) are broadcast to one scan of the texts."""
    picked = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(modulus, remainder))
    picked = picked.select("doc_id", F.col(label).cast("double").alias("y")).orderBy(F.xxhash64("doc_id", F.lit(label)), "doc_id", "y").limit(sample)
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(picked), "doc_id")
    return d.dropDuplicates(["text", "y"]).select("text", "y")


def scored(docs: DataFrame, scorer, broadcast_model, modulus: int, remainder: int, cut: float) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row; scorer(model, texts) -> scores, over whole texts."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(modulus, remainder).alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))

    def run(batches):
        for b in slices(batches):
            s = np.clip(scorer(broadcast_model.value, b.column("text").to_pylist()), 0.0, 1.0)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(s, pa.float64()), pa.array((s >= cut).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return d.transform(in_arrow, run, "doc_id long, held_out boolean, score double, predicted int")
