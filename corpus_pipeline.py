"""Documents to training sequences: language ID, near-duplicates, secrets, source mix, packing.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame with the columns of documents, the last one the packed
pieces. A stage's result is written as Parquet and read again as the next one's docs. All stages work on whole texts and
ignore columns beside those of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import jaccard, language, mixing, packing, secrets
from quarry.llm.common import discard, stored, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is one of those declared in the corpus; texts without letters or in none of them go.

    Null and empty texts go; where no language is declared at all, texts with letters stay. Repeated rows stay or go
    together; very long texts are judged whole; an empty table gives none; columns beside those of documents go."""
    return language.kept(docs.select(COLUMNS))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates: that of the least id; the null id counts as least.

    Null text counts as empty, and texts without words are copies of one another; of repeated rows one stays, of rows of
    one id and text that differ elsewhere the first as JSON; an empty table gives none."""
    return jaccard.deduplicated(docs.select(COLUMNS))


def secret_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, every span of a secret replaced by a mark, n_chars recounted where one was.

    Null texts and ids stay null; spans that touch or overlap become one mark; repeated rows stay apart; an empty table
    gives none."""
    return secrets.redact(docs.select(COLUMNS))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it, 0 to 3.

    The null source is a source, the last; null texts and texts without words add nothing to a source and are taken as
    often as all of it; ties in the seeded order go by size; repeated rows are documents of their own; an empty table gives none."""
    d = stored(docs.select(*COLUMNS, *_measures()))
    out, _ = mixing.mix(d, "__members", "__size", "__place")
    return out.where("copies > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(COLUMNS)


def _measures() -> list:
    return [
        F.array("source").alias("__members"),
        F.coalesce(F.regexp_count("text", F.lit(mixing.WORD)), F.lit(0)).cast("long").alias("__size"),
        F.sha2(F.concat(F.lit("mix:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256).alias("__place"),
    ]


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 2048 tokens.

    A null or empty text is the end id alone; repeated rows are packed each; an empty table gives none."""
    return packing.pack(docs.select(COLUMNS))


STAGES = [("language_id", language_id), ("near_duplicates", near_duplicates), ("secrets", secret_spans), ("source_mix", source_mix), ("packing", pack)]

#: Near-duplicate classes by sampled paths and byte-level BPE have no SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        before, d = d, stored(stage(spark, d, sf_dir))
        discard(before)
    return STAGES[-1][1](spark, d, sf_dir)
