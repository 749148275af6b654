"""Prompt assembly, example choice, answers without a model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import after_marker, one_line, text_of

DEGRADED = "The language model is not available; the passages found are listed above."


def context(hits: DataFrame, chunks: DataFrame, most: int = 800, qid: str = "query_id", key: str = "doc_id", title: str = "source", text: str = "text") -> DataFrame:
    """(query, context, n): the hits' passages in rank order, numbered, cut to `most` characters each."""
    h = hits.select(qid, key, "rank").join(chunks.select(key, title, text), key)
    block = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), F.coalesce(title, F.lit("")), F.lit("\n"), F.substring(one_line(text), 1, most))
    g = h.groupBy(qid).agg(F.sort_array(F.collect_list(F.struct("rank", block.alias("b")))).alias("bs"))
    return g.select(qid, F.array_join("bs.b", "\n\n").alias("context"), F.size("bs").alias("n"))


def chosen_examples(questions: DataFrame, examples: DataFrame, qid: str = "query_id") -> DataFrame:
    """(query, example): of the examples in the question's language the one of most points, 3 for its task tag and 2 for
    its issue tag; the first of equals. examples(pos, lang, tags, content)."""
    j = questions.select(qid, "lang", "task_type", "issue_type").join(examples, "lang", "left")
    points = 3 * F.coalesce(F.array_contains("tags", F.col("task_type")), F.lit(False)).cast("int") + 2 * F.coalesce(F.array_contains("tags", F.col("issue_type")), F.lit(False)).cast("int")
    return j.groupBy(qid).agg(F.max_by("content", F.struct(points, -F.coalesce("pos", F.lit(0)))).alias("example"))


def messages(system: Column, question: Column, ctx: Column, example: Column, rules: Column) -> Column:
    """array<struct<role, content>>; empty parts are left out."""
    part = lambda label, c: F.when(F.coalesce(F.trim(c), F.lit("")) != "", F.concat(F.lit(label), c))
    user = F.concat_ws("\n\n", part("Context:\n", ctx), part("Example:\n", example), part("Rules:\n", rules), part("Question: ", question))
    return F.array(F.struct(F.lit("system").alias("role"), system.alias("content")), F.struct(F.lit("user").alias("role"), user.alias("content")))


def flat(msgs: Column) -> Column:
    return F.array_join(F.transform(msgs, lambda m: F.concat(m["role"], F.lit(": "), m["content"])), "\n")


def answered(prompts: DataFrame, prompt: str = "prompt", model=None, marker: str = "Answer:") -> DataFrame:
    """prompts with answer: `model` maps a prompt column to an answer column (a pandas_udf, say); a failed (null) or
    missing one gives the degraded answer."""
    raw = model(F.col(prompt)) if model else F.lit(None).cast("string")
    return prompts.withColumn("answer", F.when(raw.isNull(), DEGRADED).otherwise(after_marker(raw, marker)))


def previews(c, most: int = 80) -> Column:
    return F.substring(F.regexp_replace(text_of(c), "\\n", " "), 1, most)


def synthesised(chunks: DataFrame, roles: list[str], ask, judge, rewrite=None, least: float = 7.0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, role, question, score, rewritten): a question for each chunk and role, kept if it is usable and its judged
    score reaches `least`, after one rewrite where the first falls short.

    ask(role, text), judge(question, text) and rewrite(question, text) map columns to columns (pandas_udfs over a model,
    say); judge's answer is read by first_score()."""
    from ..functions.text import first_score
    from .routing import usable_question

    c = chunks.withColumn("role", F.explode(F.array(*[F.lit(r) for r in roles])))
    c = c.withColumn("question", usable_question(ask(F.col("role"), F.col(text)))).where("question is not null")
    c = c.withColumn("score", first_score(judge(F.col("question"), F.col(text)))).withColumn("rewritten", F.lit(False))
    if rewrite is not None:
        again = usable_question(rewrite(F.col("question"), F.col(text)))
        weak = c.where(F.col("score") < least).withColumn("question", again).where("question is not null")
        weak = weak.withColumn("score", first_score(judge(F.col("question"), F.col(text)))).withColumn("rewritten", F.lit(True))
        c = c.where(F.col("score") >= least).unionByName(weak)
    return c.where(F.col("score") >= least).select(key, "role", "question", "score", "rewritten")
