"""Question routing as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.scores import d
from ..functions.text import has_article_reference, json_object, text_of, without_citations


def has_any(text: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(w.lower()) for w in words])


def hits(text: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a + b, [text.contains(w.lower()).cast("int") for w in words])


def lowered(c) -> Column:
    return F.lower(F.trim(text_of(c)))


def mode(c) -> Column:
    return F.when(has_article_reference(c) | has_any(lowered(c), rules.INTERPRETIVE), "GRAPH_AUGMENTED").otherwise("RAG")


def task(c) -> Column:
    t = lowered(c)
    return F.coalesce(*[F.when(has_any(t, w), name) for name, w in rules.TASK_RULES], F.lit("judge_style"))


def top_k_factor(c) -> Column:
    return F.when(has_any(lowered(c), rules.BROAD) & ~has_article_reference(c), d(1.35)).otherwise(d(1))


def part(c) -> Column:
    """The part with most keywords, the first of equals; other if none has any."""
    t = lowered(c)
    scored = F.array(*[F.struct(hits(t, w).alias("n"), F.lit(-i).alias("first"), F.lit(name).alias("name")) for i, (name, w) in enumerate(rules.PART_RULES)])
    best = F.array_max(scored)
    return F.when(best["n"] > 0, best["name"]).otherwise("other")


def issue(c) -> Column:
    """First issue rule that matches; else the best part."""
    t = lowered(c)
    return F.coalesce(*[F.when(has_any(t, w), name) for name, w in rules.ISSUE_RULES], part(c))


def part_tag(issue_col: Column) -> Column:
    return F.coalesce(*[F.when(issue_col.isin(*names), tag) for tag, names in rules.PART_OF.items()], F.lit(""))


def effective_k(base: int, factor: Column) -> Column:
    return F.least(F.greatest((F.lit(base) * factor).cast("int"), F.lit(3)), F.lit(30))


def route(questions: DataFrame, text: str = "text", base_k: int = 10) -> DataFrame:
    """questions with mode, task_type, issue_type, issue_tags, top_k_factor, effective_k, has_article_ref."""
    blank = F.trim(text_of(text)) == ""
    q = questions.withColumns({
        "mode": F.when(blank, "RAG").otherwise(mode(text)),
        "task_type": F.when(blank, "judge_style").otherwise(task(text)),
        "issue_type": F.when(blank, "other").otherwise(issue(text)),
        "top_k_factor": F.when(blank, d(1)).otherwise(top_k_factor(text)),
        "has_article_ref": has_article_reference(text),
    })
    tag = part_tag(F.col("issue_type"))
    return q.withColumn("issue_tags", F.filter(F.array(F.col("issue_type"), tag), lambda x: (x != "") & (x != "other"))).withColumn("effective_k", effective_k(base_k, F.col("top_k_factor")))


def overridden(routed: DataFrame, answer: str) -> DataFrame:
    """Routing replaced where a model's JSON answer names known values; factors are held to 0.8 to 2."""
    j = json_object(answer)
    get = lambda k: F.get_json_object(j, f"$.{k}")
    tasks = [n for n, _ in rules.TASK_RULES] + ["other"]
    issues = sorted({n for names in rules.PART_OF.values() for n in names} | {"other"})
    factor = F.try_to_number(get("top_k_factor"), F.lit("9.99")).cast("double")
    f = F.when(factor.isNull(), F.col("top_k_factor")).otherwise(F.least(F.greatest(factor, d(0.8)), d(2)))
    return routed.withColumns({"task_type": F.when(get("task_type").isin(*tasks), get("task_type")).otherwise(F.col("task_type")), "issue_type": F.when(get("issue_type").isin(*issues), get("issue_type")).otherwise(F.col("issue_type")), "top_k_factor": f})


def scope(c) -> Column:
    """Whether a question asks for statutes, cases or both."""
    t = lowered(c)
    s, k = hits(t, rules.STATUTE_SIGNALS), hits(t, rules.CASE_SIGNALS) + has_any(t, rules.FACT_SIGNALS).cast("int")
    return F.when((s > 0) & (k > 0), "both").when(k > s, "case").otherwise("statute")


def decomposed(c) -> Column:
    """Parts of a question split on the first joining word that it holds."""
    t = text_of(c)
    cut = lambda w: F.filter(F.transform(F.split(t, w), lambda x: F.trim(x)), lambda x: x != "")
    return F.when(t.contains("并且"), cut("并且")).when(t.contains("以及"), cut("以及")).when(t.contains(" and "), cut(" and ")).otherwise(F.array(t))


def usable_question(c, least: int = 6, most: int = 200) -> Column:
    """The cleaned question, or null where it is no standalone, concrete question."""
    q = without_citations(c)
    low = F.lower(q)
    mark = q.rlike("[?？]")
    anchor = reduce(lambda a, b: a | b, [q.contains(w) for w in rules.ANCHORS_ZH] + [low.contains(w) for w in rules.ANCHORS_EN])
    article = q.rlike("第[一二三四五六七八九十百千零〇两0-9]+条") | (~mark & q.rlike("(?:" + "|".join(w.replace(".", "\\.") for w in rules.STATEMENT_ENDS) + ")$"))
    question = mark | q.rlike("^(?:" + "|".join(rules.QUESTION_STARTS_ZH) + ")") | q.rlike("(?i)^(?:" + "|".join(rules.QUESTION_STARTS_EN) + ")\\b")
    abstract = (q.rlike("|".join(rules.ABSTRACT)) & ~anchor) | (q.contains("权利") & q.contains("义务") & (q.contains("如何") | q.contains("应该")) & ~q.contains("合同"))
    ok = (F.length(q) >= least) & (F.length(q) <= most) & ~article & question & ~q.rlike("|".join(rules.DEICTIC)) & ~abstract & anchor
    return F.when(ok, q)
