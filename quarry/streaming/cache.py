"""Results kept for a while: a table of answered questions with the time they were put."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TTL_SECONDS = 15 * 60


class ResultCache:
    """Rows of results by question hash in an append-only table; a put is a new file, so readers never wait."""

    def __init__(self, spark: SparkSession, folder: str, ttl: int = TTL_SECONDS):
        self.spark, self.folder, self.ttl = spark, folder, ttl

    def put(self, results: DataFrame, question: str = "question", now=None) -> None:
        """results with a question column; `now` (a timestamp column) is the time of the put."""
        at = now if now is not None else F.current_timestamp()
        results.withColumn("__q", F.sha2(F.coalesce(question, F.lit("")), 256)).withColumn("__at", at).write.mode("append").parquet(self.folder)

    def get(self, questions: DataFrame, question: str = "question", now=None) -> DataFrame:
        """The rows of the latest put of each question that is no older than the time to live."""
        at = now if now is not None else F.current_timestamp()
        asked = questions.select(F.sha2(F.coalesce(question, F.lit("")), 256).alias("__q")).distinct()
        kept = self.spark.read.parquet(self.folder).where(F.col("__at") >= at - F.make_interval(secs=F.lit(self.ttl))).join(asked, "__q", "left_semi")
        last = kept.groupBy("__q").agg(F.max("__at").alias("__at"))
        return kept.join(last, ["__q", "__at"]).drop("__q", "__at")
