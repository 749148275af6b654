"""Micro-batch ingestion: new documents once each, into every index table, with a status log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import stable_id
from ..operators import bm25
from ..sources.readers import append_new


def add_batch(batch: DataFrame, root: str, batch_id: int = 0, key: str = "doc_id", text: str = "text") -> None:
    """Chunks and postings of a batch appended; what the chunk table has already is skipped, so a batch that is run again
    adds nothing. Each stage leaves a row in the status table, an error in place of a count if it failed."""
    spark = batch.sparkSession
    log = []

    def stage(name, work):
        try:
            log.append((batch_id, name, "done", int(work()), None))
        except Exception as e:  # the status must say what failed; the batch fails after all stages
            log.append((batch_id, name, "failed", 0, str(e)[:500]))

    stage("chunks", lambda: append_new(batch, f"{root}/chunks", key))

    def add_postings():
        # only this batch's chunks are tokenised, as the chunk table has them
        mine = spark.read.parquet(f"{root}/chunks").join(batch.select(key).distinct(), key, "left_semi")
        done = f"{root}/postings"
        try:
            mine = mine.join(spark.read.parquet(done).select(key), key, "left_anti")
        except Exception as e:  # nothing indexed yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
        from ..sources.shared import stored

        post = stored(bm25.postings(mine, key, text))
        n = post.select(key).distinct().count()
        if n:
            post.write.mode("append").parquet(done)
        return n

    stage("postings", add_postings)
    spark.createDataFrame(log, "batch long, stage string, state string, added long, error string").coalesce(1).write.mode("append").parquet(f"{root}/status")
    failed = [x for x in log if x[2] == "failed"]
    if failed:
        raise RuntimeError(f"ingest failed in {failed[0][1]}: {failed[0][4]}")


def ingest(spark: SparkSession, folder: str, schema, root: str, checkpoint: str, per_batch: int = 100, key: str = "doc_id", text: str = "text"):
    """A query that takes what is new in a folder of Parquet files, batch by batch, and stops when all is done."""
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).parquet(folder)
    return source.writeStream.foreachBatch(lambda df, n: add_batch(df, root, n, key, text)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingested_log(docs: DataFrame, name: str = "source", text: str = "text") -> DataFrame:
    """(ingest_id, source, text_len) of documents as they come in."""
    return docs.select(stable_id(name, text).alias("ingest_id"), F.col(name).alias("source"), F.length(text).alias("text_len"))
