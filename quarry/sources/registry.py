"""Versioned index tables: a version is a folder, the active one is named in a pointer file."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


class Registry:
    """Versions below a root on any file system Spark knows."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def versions(self) -> list[str]:
        p = self._path(f"{self.root}/versions")
        return sorted(s.getPath().getName() for s in self._fs.listStatus(p)) if self._fs.exists(p) else []

    def path(self, version: str, table: str = "") -> str:
        return f"{self.root}/versions/{version}/{table}".rstrip("/")

    def write(self, version: str, table: str, df: DataFrame, by: list[str] | None = None) -> None:
        w = df.write.mode("overwrite")
        (w.partitionBy(*by) if by else w).parquet(self.path(version, table))

    def _put(self, path: str, content: str) -> None:
        """A small file that is there whole or not at all: written under another name, then renamed over the old one."""
        jvm = self.spark._jvm
        new = self._path(f"{path}.{uuid.uuid4().hex}")
        out = self._fs.create(new, True)
        out.write(bytearray(content, "utf-8"))
        out.close()
        kind = getattr(jvm, "org.apache.hadoop.fs.Options$Rename")
        options = self.spark.sparkContext._gateway.new_array(kind, 1)
        options[0] = kind.OVERWRITE
        target = self._fs.makeQualified(self._path(path))
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), self.spark._jsc.hadoopConfiguration()).rename(self._fs.makeQualified(new), target, options)

    def _get(self, path: str) -> str | None:
        p = self._path(path)
        if not self._fs.exists(p):
            return None
        source = self._fs.open(p)
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8")
        finally:
            source.close()

    def finish(self, version: str) -> None:
        """Marks a version whose tables are all written."""
        self._put(f"{self.path(version)}/COMPLETE", version)

    def complete(self, version: str) -> bool:
        return self._get(f"{self.path(version)}/COMPLETE") is not None

    def activate(self, version: str) -> None:
        """Readers see the old version until the pointer file is renamed over the old one."""
        if version not in self.versions():
            raise ValueError(f"no version {version}")
        self._put(f"{self.root}/ACTIVE", version)

    def active(self) -> str | None:
        return self._get(f"{self.root}/ACTIVE")

    def read(self, table: str, version: str | None = None) -> DataFrame:
        """A table of the version asked for, else of the active one, else one right below the root."""
        v = version or self.active()
        return self.spark.read.parquet(self.path(v, table) if v else f"{self.root}/{table}")
