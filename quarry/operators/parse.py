"""Statute parsing: lines to articles, by windows and ordered folds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import merged_lines, numeral, repaired_markers, text_of

# Endings of the text before a marker that make it a citation.
CITATION_PREFIXES = ["本法", "本章", "本节", "本条例", "本编", "本分编", "依照", "根据"]
GATE = {"count": 20, "coverage": 0.3, "gap_ratio": 0.5, "avg_len_ratio": 0.12}
_N = "[一二三四五六七八九十百千万〇零0-9]+"
_ZH = [("part", "编"), ("subpart", "分编"), ("chapter", "章"), ("section", "节")]
LEVELS = [k for k, _ in _ZH]


def lines_of(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, pos, line) with cleaned lines; broken article markers are repaired first."""
    clean = lambda x: F.trim(F.regexp_replace(x, "[ \\t\\u3000\\r]+", " "))
    return docs.select(key, F.posexplode(F.transform(F.split(repaired_markers(text), "\\n"), clean)).alias("pos", "line"))


def _last(value: Column, w) -> Column:
    return F.last(value, ignorenulls=True).over(w)


def by_lines(lines: DataFrame, lang: str = "zh", key: str = "doc_id") -> DataFrame:
    """(key, n, part, subpart, chapter, section, article_no, article_id, text) of the articles of each document.

    One window by document carries the running number of the article and, for each level, its last heading and where it
    stood; a level counts only if no higher heading came after it. An article ends at the next heading or article and is
    labelled by the headings at its start. Its lines are gathered in order and merged."""
    w = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    c = F.col("line")
    if lang == "zh":
        art = f"^(?:第\\s*)({_N})\\s*条"
        # a part ending reads 第三编; 第三分编 ends alike but is a subpart
        head = {k: (f"^(?:第\\s*)?({_N})\\s*{mark}(.*)$", mark) for k, mark in _ZH}
        label = lambda k: F.concat(F.lit("第"), F.regexp_extract(c, head[k][0], 1), F.lit(head[k][1]), F.when(F.trim(F.regexp_extract(c, head[k][0], 2)) != "", F.concat(F.lit(" "), F.trim(F.regexp_extract(c, head[k][0], 2)))).otherwise(""))
        is_head = {k: c.rlike(head[k][0]) & ~c.rlike(art) for k in LEVELS}
        no = F.concat(F.lit("第"), F.regexp_extract(c, art, 1), F.lit("条"))
        body = F.trim(F.regexp_replace(c, art, ""))
    else:
        art = "^§\\s*([0-9A-Za-z-]+)\\.?\\s*"
        head = {"chapter": ("(?i)^ARTICLE\\s+([0-9A-Za-z-]+)\\s*[-–—]\\s*(.*)$", "Article"), "section": ("(?i)^PART\\s+([0-9A-Za-z-]+)\\.?\\s*(.*)$", "Part")}
        label = lambda k: F.trim(F.concat(F.lit(head[k][1] + " "), F.regexp_extract(c, head[k][0], 1), F.lit(" "), F.trim(F.regexp_extract(c, head[k][0], 2))))
        is_head = {k: c.rlike(head[k][0]) if k in head else F.lit(False) for k in LEVELS}
        no = F.concat(F.lit("§ "), F.regexp_extract(c, art, 1))
        body = F.regexp_replace(c, art, "")
    any_head = reduce(lambda a, b: a | b, is_head.values())
    x = lines.withColumn("is_art", c.rlike(art) & (~any_head if lang != "zh" else F.lit(True))).withColumn("is_head", any_head)
    for k in LEVELS:
        x = x.withColumn(f"{k}_at", _last(F.when(is_head[k], F.col("pos")), w)).withColumn(f"{k}_s", _last(F.when(is_head[k], label(k)) if lang == "zh" or k in head else F.lit(None).cast("string"), w))
    for i, k in enumerate(LEVELS):
        above = [F.coalesce(F.col(f"{a}_at"), F.lit(-1)) for a in LEVELS[:i]]
        fresh = F.col(f"{k}_at") > (F.greatest(*above) if len(above) > 1 else above[0] if above else F.lit(-1))
        x = x.withColumn(k, F.coalesce(F.when(fresh, F.col(f"{k}_s")), F.lit("")))
    # text after a heading belongs to no article until the next one starts
    x = x.withColumn("n", F.sum(F.col("is_art").cast("int")).over(w)).withColumn("art_at", _last(F.when(F.col("is_art"), F.col("pos")), w)).withColumn("head_at", _last(F.when(F.col("is_head"), F.col("pos")), w))
    x = x.where((F.col("n") > 0) & (F.col("art_at") > F.coalesce("head_at", F.lit(-1))) & ~F.col("is_head"))
    x = x.withColumn("no", F.when(F.col("is_art"), no)).withColumn("body", F.when(F.col("is_art"), body).otherwise(c))
    start = F.col("is_art")
    g = x.groupBy(key, "n").agg(*[F.max(F.when(start, F.col(k))).alias(k) for k in LEVELS], F.max("no").alias("article_no"), F.sort_array(F.collect_list(F.struct("pos", "body"))).alias("ls"))
    g = g.withColumn("text", F.array_join(merged_lines(F.col("ls.body")), "\n")).where("text <> ''")
    return g.select(key, F.col("n").cast("long").alias("n"), *LEVELS, "article_no", article_id("article_no").alias("article_id"), "text")


def article_id(no) -> Column:
    """The marker's number as a decimal, or the section's id."""
    n = F.regexp_extract(text_of(no), f"第\\s*({_N})\\s*条", 1)
    return F.coalesce(numeral(n).cast("string"), F.nullif(F.regexp_extract(text_of(no), "§\\s*([0-9A-Za-z-]+)", 1), F.lit("")), text_of(no))


def by_scan(docs: DataFrame, lang: str = "zh", key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n, article_no, article_id, text): every marker in the running text starts an article, unless what stands
    before it makes it a citation; it ends at the next one. For texts whose lines are lost."""
    t = repaired_markers(text)
    if lang == "zh":
        # six characters of look-behind, as any of the prefixes may stand there
        bad = "|".join(CITATION_PREFIXES)
        marker = f"(?<![一二三四五六七八九十百千万〇零0-9])(?<!{bad})第\\s*{_N}\\s*条"
        first = f"^第\\s*({_N})\\s*条"
        no = F.concat(F.lit("第"), F.regexp_extract("seg", first, 1), F.lit("条"))
    else:
        marker = "(?m)^[ \\t]*§\\s*[0-9A-Za-z-]+\\."
        first = "^\\s*§\\s*([0-9A-Za-z-]+)\\."
        no = F.concat(F.lit("§ "), F.regexp_extract("seg", first, 1))
    seg = docs.select(key, F.posexplode(F.split(t, f"(?={marker})", -1)).alias("n", "seg")).where(F.col("seg").rlike(first))
    heads = f"^\\s*(?:第\\s*)?{_N}\\s*(?:分编|编|章|节)" if lang == "zh" else "(?i)^\\s*(?:ARTICLE|PART)\\s"
    body = F.array_join(merged_lines(F.filter(F.split(F.regexp_replace("seg", first, ""), "\\n"), lambda x: ~x.rlike(heads))), "\n")
    w = Window.partitionBy(key).orderBy("n")
    return seg.select(key, F.row_number().over(w).cast("long").alias("n"), no.alias("article_no"), article_id(no).alias("article_id"), body.alias("text"))


def chosen(line: DataFrame, scan: DataFrame, key: str = "doc_id") -> DataFrame:
    """Of each document the scan's articles if it found more than the lines, or the lines fewer than ten; else the lines'."""
    count = lambda df, n: df.groupBy(key).agg(F.count("*").alias(n))
    c = count(line, "nl").join(count(scan, "ns"), key, "full")
    use_scan = (F.coalesce("ns", F.lit(0)) > 0) & ((F.coalesce("nl", F.lit(0)) < 10) | (F.coalesce("ns", F.lit(0)) > F.coalesce("nl", F.lit(0))))
    picked = c.select(key, use_scan.alias("scan"))
    cols = [key, "n", "article_no", "article_id", "text"]
    return scan.join(picked.where("scan").select(key), key, "left_semi").select(cols).unionByName(line.join(picked.where("not scan").select(key), key, "left_semi").select(cols))


def quality(records: DataFrame, lengths: DataFrame, key: str = "doc_id", gate: dict = GATE) -> DataFrame:
    """(key, count, coverage, avg_len_ratio, gap_ratio, ok): whether a parse is good enough to use.

    records(key, article_id, text); lengths(key, text_len). gap_ratio needs five distinct numbers."""
    num = F.when(F.col("article_id").rlike("^[0-9]{1,18}$"), F.col("article_id").cast("long"))
    g = records.groupBy(key).agg(F.count("*").alias("count"), F.sum(F.length(text_of("text"))).alias("total"), F.countDistinct(num).alias("nums"), F.min(num).alias("lo"), F.max(num).alias("hi"))
    g = lengths.join(g, key, "left").withColumns({"count": F.coalesce("count", F.lit(0)), "total": F.coalesce("total", F.lit(0))})
    size = F.greatest(F.col("text_len"), F.lit(1)).cast("double")
    g = g.withColumn("coverage", F.col("total").cast("double") / size).withColumn("avg_len_ratio", F.col("total").cast("double") / F.greatest(F.col("count"), F.lit(1)).cast("double") / size)
    g = g.withColumn("gap_ratio", F.when(F.col("nums") >= 5, F.lit(1).cast("double") - F.col("nums").cast("double") / (F.col("hi") - F.col("lo") + 1).cast("double")))
    bad = (F.col("count") < gate["count"]) | (F.col("coverage") < gate["coverage"]) | F.coalesce(F.col("gap_ratio") > gate["gap_ratio"], F.lit(False)) | (F.col("avg_len_ratio") > gate["avg_len_ratio"])
    return g.select(key, "count", "coverage", "avg_len_ratio", "gap_ratio", (~bad).alias("ok"))


def unique_labels(rows: DataFrame, label: str, order: list[str], key: str = "doc_id") -> DataFrame:
    """The nth repeat of a label in a document gets -n."""
    n = F.row_number().over(Window.partitionBy(key, label).orderBy(*order))
    return rows.withColumn(label, F.when((n == 1) | F.col(label).isNull(), F.col(label)).otherwise(F.concat(label, F.lit("-"), n.cast("string"))))


def layout_lines(words: DataFrame, tolerance: float = 2.0, gap: float = 1.0, page: list[str] | None = None) -> DataFrame:
    """(page, line, top, bottom, text) of words(page, text, x0, x1, top, bottom): a word opens a line if its top is over
    `tolerance` from the line's first; words stand by x0, a blank where they are over `gap` apart."""
    keys = page or ["doc_id", "page"]
    ws = F.sort_array(F.collect_list(F.struct("top", "x0", "x1", "bottom", "text")))
    g = words.groupBy(*keys).agg(ws.alias("ws"))
    kind = "array<struct<top:double,line:int,x0:double,x1:double,bottom:double,text:string>>"
    fold = F.aggregate(
        "ws",
        F.struct(F.lit(0).alias("n"), F.lit(None).cast("double").alias("first"), F.array().cast(kind).alias("out")),
        lambda a, x: F.struct(
            F.when(a["first"].isNull() | (x["top"] - a["first"] > tolerance), a["n"] + 1).otherwise(a["n"]).alias("n"),
            F.when(a["first"].isNull() | (x["top"] - a["first"] > tolerance), x["top"]).otherwise(a["first"]).alias("first"),
            F.concat(a["out"], F.array(F.struct(x["top"].alias("top"), F.when(a["first"].isNull() | (x["top"] - a["first"] > tolerance), a["n"] + 1).otherwise(a["n"]).alias("line"), x["x0"].alias("x0"), x["x1"].alias("x1"), x["bottom"].alias("bottom"), x["text"].alias("text")))).alias("out"),
        ),
        lambda a: a["out"],
    )
    flat = g.select(*keys, F.inline(fold))
    line = flat.groupBy(*keys, "line").agg(F.min("top").alias("top"), F.max("bottom").alias("bottom"), F.sort_array(F.collect_list(F.struct("x0", "x1", "text"))).alias("ws"))
    text = F.aggregate("ws", F.struct(F.lit(None).cast("double").alias("end"), F.lit("").alias("t")), lambda a, x: F.struct(x["x1"].alias("end"), F.concat(a["t"], F.when(x["x0"] - a["end"] > gap, " ").otherwise(""), x["text"]).alias("t")), lambda a: a["t"])
    return line.select(*keys, "line", "top", "bottom", text.alias("text"))


def without_running_heads(lines: DataFrame, heights: DataFrame, edge: float = 0.12, share: float = 0.3, key: str = "doc_id") -> DataFrame:
    """lines(key, page, line, top, bottom, text) without headers and footers: texts (digits and blanks aside) that stand in
    the top or bottom `edge` of at least max(2, share of pages) pages, and lines of digits. heights(key, page, height)."""
    norm = F.lower(F.regexp_replace("text", "[\\d\\s]+", ""))
    x = lines.withColumn("k", norm).join(heights, [key, "page"])
    pages = heights.groupBy(key).agg(F.count("*").alias("pages"))
    marginal = x.where("k <> ''").withColumn("side", F.when(F.col("top") <= F.col("height") * edge, "h").when(F.col("bottom") >= F.col("height") * (1 - edge), "f")).where("side is not null")
    often = marginal.groupBy(key, "k", "side").agg(F.count("*").alias("n")).join(pages, key).where(F.col("n") >= F.greatest(F.lit(2), F.floor(F.col("pages") * share))).select(key, "k").distinct()
    return x.join(often, [key, "k"], "left_anti").where(~F.col("text").rlike("^\\d+$")).select(lines.columns)


def body_of_pages(text) -> Column:
    """Text without a leading table of contents: what follows the last line that ends in leader dots and a number, when
    such lines are in the first third; else the whole text."""
    t = text_of(text)
    toc = F.regexp_extract(F.substring(t, F.lit(1), (F.length(t) / 3).cast("int")), "(?s)^.*(?:\\.{3,}|…+|·{3,})\\s*\\d+[ \\t]*\\n", 0)
    return F.when(toc != "", F.substring(t, F.length(toc) + 1, F.length(t))).otherwise(t)


def corpus(raw: DataFrame, lang: str = "zh", gate: dict = GATE, target: int = 650, overlap: int = 90, key: str = "source", text: str = "text") -> DataFrame:
    """(key, n, article_no, article_id, text) of raw texts: by lines or by scan, whichever reads more; a text whose
    articles fail the quality gate is cut into chunks instead, numbered from 1."""
    from ..functions.text import chunked
    from ..sources.shared import stored

    found = stored(chosen(by_lines(lines_of(raw, key, text), lang, key), by_scan(raw, lang, key, text), key))
    ok = quality(found, raw.select(key, F.length(text_of(text)).alias("text_len")), key, gate).where("ok").select(key)
    pieces = raw.join(ok, key, "left_anti").select(key, F.posexplode(chunked(text, target, overlap)).alias("p", "c"))
    n = (F.col("p") + 1).cast("long")
    pieces = pieces.select(key, n.alias("n"), F.lit("").alias("article_no"), n.cast("string").alias("article_id"), F.col("c.text").alias("text"))
    return found.join(ok, key, "left_semi").select(pieces.columns).unionByName(pieces)
