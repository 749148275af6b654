"""Scans and sinks of chunks, raw texts, pages and graphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import text_of

CHUNK = T.StructType([T.StructField(n, T.StringType()) for n in ("id", "law_name", "chapter", "section", "article_no", "article_id", "text", "lang", "source")] + [T.StructField(n, T.IntegerType()) for n in ("start_char", "end_char")])


def raw_texts(spark: SparkSession, folder: str) -> DataFrame:
    """(path, source, text) of all .txt files below a folder; UTF-8, or GB18030 where that fails."""
    b = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").load(folder)
    utf8 = F.try_validate_utf8(F.col("content").cast("string"))

    @F.pandas_udf("string")
    def decoded(content):  # bytes that are no UTF-8; no JVM function decodes GB18030
        return content.map(lambda x: None if x is None else bytes(x).decode("gb18030", "replace"))

    return b.select("path", F.regexp_extract("path", "([^/]+)$", 1).alias("source"), F.coalesce(utf8, decoded(F.when(utf8.isNull(), F.col("content")))).alias("text"))


def chunks(spark: SparkSession, glob: str | list[str]) -> DataFrame:
    """Chunks of JSON lines with the file and place they come from; unknown fields are dropped."""
    d = spark.read.schema(CHUNK).json(glob)
    return d.select("*", F.col("_metadata.file_name").alias("file"), F.monotonically_increasing_id().alias("line")).withColumn("lang", F.coalesce("lang", F.lit("zh")))


def first_by_id(d: DataFrame, key: str, order: list[str] | None = None) -> DataFrame:
    """One row a key, the first in the order given; with none, the first as JSON, the same in every run."""
    w = Window.partitionBy(key).orderBy(*(order or [F.to_json(F.struct(*d.columns))]))
    return d.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def write_by_lang(d: DataFrame, folder: str, fmt: str = "parquet") -> None:
    d.write.mode("overwrite").partitionBy("lang").format(fmt).save(folder)


def append_new(d: DataFrame, folder: str, key: str = "id") -> int:
    """Appends the rows whose key the table lacks; how many."""
    spark = d.sparkSession
    from .shared import stored

    new = first_by_id(d, key)
    try:
        new = new.join(spark.read.parquet(folder).select(key), key, "left_anti")
    except Exception as e:  # a table that isn't there yet is empty
        if "PATH_NOT_FOUND" not in str(e):
            raise
    new = stored(new)
    n = new.count()
    if n:
        new.write.mode("append").parquet(folder)
    return n


def preview(d: DataFrame, n: int, order: list[str]) -> DataFrame:
    """The first n rows in order, n held between 1 and 50."""
    return d.orderBy(*order).limit(min(max(n, 1), 50))


def write_by_suffix(d: DataFrame, path: str) -> None:
    """d as CSV with a header where the path ends in .csv, else as JSON lines."""
    w = d.write.mode("overwrite")
    w.option("header", True).csv(path) if path.endswith(".csv") else w.json(path)


def page_text(html) -> Column:
    """Visible text of a page: without scripts, styles and navigation; blocks end lines; blank lines dropped."""
    t = F.regexp_replace(text_of(html), "(?is)<(script|style|noscript|nav|head)\\b.*?</\\1\\s*>", " ")
    t = F.regexp_replace(t, "(?i)<(?:br|/p|/div|/li|/h[1-6]|/tr)\\b[^>]*>", "\n")
    t = F.regexp_replace(t, "(?s)<[^>]*>", " ")
    for a, b in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(a), F.lit(b))
    t = F.regexp_replace(t, "[ \\t\\r\\f]+", " ")
    return F.regexp_replace(F.regexp_replace(t, " ?\\n[ \\n]*", "\n"), "^[ \\n]+|[ \\n]+$", "")


def page_links(html) -> Column:
    """Distinct link targets in the order of their first place."""
    return F.array_distinct(F.regexp_extract_all(text_of(html), F.lit("(?i)<a\\b[^>]*?\\bhref\\s*=\\s*\"([^\"]*)\""), F.lit(1)))


def prompt_registry(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(templates by task, examples with their place) of a prompt registry in JSON."""
    j = spark.read.option("multiLine", True).option("primitivesAsString", True).text(path, wholetext=True)
    reg = F.from_json(F.get_json_object("value", "$.registry"), "map<string,map<string,string>>")
    ex = F.from_json(F.get_json_object("value", "$.example_pool"), "array<struct<lang:string,tags:array<string>,content:string>>")
    t = j.select(F.explode(reg).alias("task_type", "fields")).select("task_type", *[F.try_element_at("fields", F.lit(k)).alias(k) for k in ("system", "user_prefix", "output_structure", "citation_rules", "format_constraints", "forbidden")])
    return t, j.select(F.posexplode(ex).alias("pos", "e")).select("pos", "e.lang", "e.tags", "e.content")
