"""Tables in the cluster's shared folder: they cut lineage and survive lost executors."""

from __future__ import annotations

import hashlib
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; only where it is unset in local mode (tests) a temporary one is set.

    On a cluster a machine's own folder would not be seen by the others, so it must be set there."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the whole cluster shares")
        found = "file://" + tempfile.mkdtemp(prefix="quarry-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


SMALL, PART = 256 << 20, 8 << 20


def plan_bytes(df: DataFrame) -> int:
    """Bytes that the plan expects; of a scan, those of its files."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt over all task slots if its files are small: these may be one row group, which one task would read and
    work on alone. Larger ones keep the splits they have, so no large table is shuffled for this."""
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism, *keys) if plan_bytes(df) <= SMALL else df


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt by keys over all task slots, or in parts of about PART bytes where these are more; what is grouped by the
    keys and more is then not shuffled again. For rows that grow when they are worked on, as texts do into postings."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-plan_bytes(df) // PART)), *keys)


def files_digest(spark: SparkSession, path: str) -> str:
    """A digest of the names, lengths and times of the files below a path: another one once any of them changes."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = fs_path.getFileSystem(spark._jsc.hadoopConfiguration())
    found, listed = [], fs.listFiles(fs_path, True)
    while listed.hasNext():
        f = listed.next()
        found.append(f"{f.getPath()}:{f.getLen()}:{f.getModificationTime()}")
    return hashlib.sha256("\n".join(sorted(found)).encode()).hexdigest()[:32]


def stored(df: DataFrame) -> DataFrame:
    """df written as Parquet into the shared folder and read back."""
    path = f"{shared_dir(df.sparkSession)}/quarry/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_path = path
    return out


def discard(df: DataFrame) -> None:
    """Deletes what stored() wrote, once nothing will read it again."""
    if path := getattr(df, "stored_path", None):
        p = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)
