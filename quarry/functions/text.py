"""Text functions as column expressions; all run on the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Sentence ends, numeral characters and what they stand for.
TERMINATORS = "。！？!?；;"
CN_NUMERAL = "[一二三四五六七八九十百千万〇零两0-9]+"
_DIGIT = {"零": 0, "〇": 0, "一": 1, "二": 2, "两": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9}
_UNIT = {"十": 10, "百": 100, "千": 1000, "万": 10000}


def text_of(c) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(c, F.lit(""))


def tokens(c) -> Column:
    """Lower-case word tokens with an inner apostrophe."""
    return F.regexp_extract_all(F.lower(text_of(c)), F.lit("[a-z0-9]+(?:'[a-z0-9]+)?"), F.lit(0))


def tokens_cjk(c) -> Column:
    """Pairs of neighbouring CJK characters, single ones where alone, and the word tokens of the rest."""
    t = text_of(c)
    runs = F.regexp_extract_all(t, F.lit("[\\u4e00-\\u9fff]+"), F.lit(0))
    pairs = F.transform(runs, lambda r: F.when(F.length(r) == 1, F.array(r)).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.length(r) - 1, F.lit(1))), lambda i: F.substring(r, i, F.lit(2)))))
    return F.concat(F.flatten(pairs), tokens(F.regexp_replace(t, "[\\u4e00-\\u9fff]+", " ")))


def tokens_by_lang(c) -> Column:
    return F.when(detect_lang(c) == "zh", tokens_cjk(c)).otherwise(tokens(c))


def detect_lang(c) -> Column:
    """en if Latin letters outnumber CJK characters, else zh (ties and empty texts too)."""
    t = text_of(c)
    return F.when(F.regexp_count(t, F.lit("[A-Za-z]")) > F.regexp_count(t, F.lit("[\\u4e00-\\u9fff]")), "en").otherwise("zh")


def prompt_lang(c) -> Column:
    return F.when(text_of(c).rlike("[\\u4e00-\\u9fff]"), "zh").otherwise("en")


def ratio_lang(c, least: float = 0.3) -> Column:
    t = text_of(c)
    n = F.length(F.regexp_replace(t, "\\s", ""))
    return F.when(F.regexp_count(t, F.lit("[\\u4e00-\\u9fff]")) > least * F.greatest(n, F.lit(1)), "zh").otherwise("en")


def one_line(c) -> Column:
    return F.trim(F.regexp_replace(text_of(c), "\\s+", " "))


def normalised(c) -> Column:
    """Unix newlines, single spaces, trimmed lines, at most one blank line, trimmed."""
    t = F.regexp_replace(text_of(c), "\\r\\n?", "\n")
    t = F.regexp_replace(t, "[ \\t\\u000b\\f\\u3000]+", " ")
    t = F.regexp_replace(t, " *\\n *", "\n")
    t = F.regexp_replace(t, "\\n{3,}", "\n\n")
    return F.regexp_replace(t, "^[ \\n]+|[ \\n]+$", "")


def nfkc(c) -> Column:
    """Compatibility-composed text (full-width forms, ligatures), for texts from page layouts. No JVM function composes,
    so the rows go through pandas in Arrow batches."""
    return _compose(text_of(c))


@F.pandas_udf(T.StringType())
def _compose(s):
    return s.str.normalize("NFKC")


def mixed_lang(c) -> Column:
    """Whether a text holds both CJK characters and Latin letters."""
    t = text_of(c)
    return t.rlike("[\u4e00-\u9fff]") & t.rlike("[A-Za-z]")


def coerced_text(*columns) -> Column:
    """The first of the columns that is neither null nor blank, empty if none is: a record's text under any of its names."""
    return F.coalesce(*[F.when(F.trim(F.col(c)) != "", F.col(c)) for c in columns], F.lit(""))


def complete_items(c, field: str) -> Column:
    """The complete strings of a JSON array named `field` in text that may break off: what a reader of a stream can show.

    A string counts once its closing quote is there; escapes are resolved by the JSON reader."""
    body = F.regexp_extract(text_of(c), f"(?s)\"{field}\"\\s*:\\s*\\[((?:\\s*\"(?:[^\"\\\\]|\\\\.)*+\"\\s*,?)*)", 1)
    whole = F.regexp_extract_all(body, F.lit("\"(?:[^\"\\\\]|\\\\.)*+\""), F.lit(0))
    return F.coalesce(F.from_json(F.concat(F.lit("["), F.array_join(whole, ","), F.lit("]")), "array<string>"), F.array().cast("array<string>"))


def sentences(c, terminators: str = TERMINATORS) -> Column:
    """Trimmed non-blank sentences, each with its terminator."""
    found = F.regexp_extract_all(text_of(c), F.lit(f"[^{terminators}]*[{terminators}]|[^{terminators}]+"), F.lit(0))
    return F.filter(F.transform(found, lambda s: F.regexp_replace(s, "^\\s+|\\s+$", "")), lambda s: s != "")


def paragraphs(c) -> Column:
    """array<struct<text, start, end>>: parts between blank lines, trimmed, with offsets (0-based, end exclusive)."""
    t = text_of(c)
    gaps = F.regexp_extract_all(t, F.lit("\\n{2,}"), F.lit(0))
    parts = F.split(t, "\\n{2,}", -1)
    kind = "array<struct<text:string,start:int,end:int>>"
    folded = F.aggregate(
        F.transform(parts, lambda p, i: F.struct(p.alias("p"), F.coalesce(F.length(F.get(gaps, i)), F.lit(0)).alias("g"))),
        F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("out")),
        lambda a, x: F.struct((a["at"] + F.length(x["p"]) + x["g"]).alias("at"), F.concat(a["out"], F.array(F.struct(F.regexp_replace(x["p"], "^\\s+|\\s+$", "").alias("text"), a["at"].alias("start"), (a["at"] + F.length(x["p"])).alias("end")))).alias("out")),
        lambda a: a["out"],
    )
    return F.filter(folded, lambda p: p["text"] != "")


def chunked(c, target: int = 650, overlap: int = 90, terminators: str = TERMINATORS) -> Column:
    """array<struct<text, start, end>>: sentences gathered until `target` characters, the last `overlap` carried over.

    Offsets count the trimmed sentences."""
    kind = "array<struct<text:string,start:int,end:int>>"
    trim = lambda s: F.regexp_replace(s, "^\\s+|\\s+$", "")

    def step(a, s):
        start = F.when(a["buf"] == "", a["cur"]).otherwise(a["start"])
        buf, cur = F.concat(a["buf"], s), a["cur"] + F.length(s)
        body = trim(buf)
        end = start + F.length(body)
        full = F.length(buf) >= target
        carry = full & (F.length(body) > overlap)
        return F.struct(
            F.when(carry, F.right(body, F.lit(overlap)) if overlap else F.lit("")).when(full, "").otherwise(buf).alias("buf"),
            cur.alias("cur"),
            F.when(carry, end - overlap).otherwise(start).alias("start"),
            F.when(full, F.concat(a["out"], F.array(F.struct(body.alias("text"), start.alias("start"), end.alias("end"))))).otherwise(a["out"]).alias("out"),
        )

    last = lambda a: F.when(a["buf"] == "", a["out"]).otherwise(F.concat(a["out"], F.array(F.struct(trim(a["buf"]).alias("text"), a["start"].alias("start"), (a["start"] + F.length(trim(a["buf"]))).alias("end")))))
    return F.aggregate(sentences(c, terminators), F.struct(F.lit("").alias("buf"), F.lit(0).alias("cur"), F.lit(0).alias("start"), F.array().cast(kind).alias("out")), step, last)


def stable_id(name, text) -> Column:
    """16 hex digits of sha1 over the name, a bar, and the first 12 of the text's sha1."""
    return F.substring(F.sha1(F.concat(text_of(name), F.lit("|"), F.substring(F.sha1(text_of(text)), 1, 12))), 1, 16)


def short_name(c, most: int = 12) -> Column:
    s = F.regexp_replace(text_of(c), "\\s+", "")
    return F.when(s == "", "upload").otherwise(F.substring(s, 1, most))


def first_line(c) -> Column:
    return F.trim(F.regexp_replace(F.regexp_extract(text_of(c), "(?m)^.*\\S.*$", 0), "\\s+$", ""))


def shortened(c, most: int = 20) -> Column:
    t = text_of(c)
    return F.when(t == "", "upload").when(F.length(t) <= most, t).otherwise(F.concat(F.substring(t, 1, 10), F.lit("***"), F.right(t, F.lit(10))))


def heading_like(c) -> Column:
    t = F.trim(text_of(c))
    return (t == "") | t.rlike("^(?:第[一二三四五六七八九十百千万〇零0-9]+(?:编|分编|章|节|条)|(?:ARTICLE|PART)\\s+[0-9A-Za-z-]+)")


def head_label(c) -> Column:
    """Label of a chunk: its article marker, else what stands before the first punctuation or blank of its first line."""
    head = first_line(c)
    num = F.regexp_extract(head, "^(?:第\\s*)?([一二三四五六七八九十百千万〇零0-9]+)\\s*条", 1)
    return F.when(num != "", F.concat(F.lit("第"), num, F.lit("条"))).otherwise(F.nullif(F.regexp_extract(head, "^[^，,。；;:：\\s]*", 0), F.lit("")))


def numeral(c) -> Column:
    """Chinese or decimal numeral as an integer; null where it is none or not positive."""
    t = F.trim(text_of(c))
    number = lambda m: F.create_map(*[F.lit(x) for kv in m.items() for x in kv])
    digit, unit = number(_DIGIT), number(_UNIT)

    def step(a, ch):
        d, u = F.try_element_at(digit, ch), F.try_element_at(unit, ch)
        cur = F.when(a["cur"] == 0, 1).otherwise(a["cur"])
        return F.struct(
            F.when(d.isNotNull(), a["total"]).when(u == 10000, (a["total"] + cur) * 10000).when(u.isNotNull(), a["total"] + cur * u).otherwise(a["total"]).cast("long").alias("total"),
            F.when(d.isNotNull(), d).otherwise(0).cast("long").alias("cur"),
        )

    zero = F.lit(0).cast("long")
    value = F.aggregate(F.filter(F.split(t, ""), lambda x: x != ""), F.struct(zero.alias("total"), zero.alias("cur")), step, lambda a: a["total"] + a["cur"])
    value = F.when(t.rlike("^[0-9]+$"), F.try_to_number(F.substring(t, 1, 18), F.lit("9" * 18)).cast("long")).when(t.rlike("^[零〇一二两三四五六七八九十百千万]+$"), value)
    return F.when(t.rlike("^[0-9]+$"), value).otherwise(F.nullif(value, zero))


def without_citations(c) -> Column:
    t = F.regexp_replace(text_of(c), "\\u3000", " ")
    t = F.regexp_replace(t, "第[一二三四五六七八九十百千零〇两0-9]+条|(?:依据|根据|依照)本法规定", "")
    return one_line(t)


def has_article_reference(c) -> Column:
    t = text_of(c)
    return t.rlike("第[一二三四五六七八九十百千万零0-9]{1,12}[条款项目]") | t.rlike("(?i)\\barticle\\s+\\d{1,4}\\b")


def json_object(c) -> Column:
    """From the first opening to the last closing brace, or null."""
    return F.nullif(F.regexp_extract(text_of(c), "(?s)\\{.*\\}", 0), F.lit(""))


def first_score(c, low: float = 1.0, high: float = 10.0) -> Column:
    """First number in the text, held between low and high; low where there is none."""
    n = F.regexp_extract(text_of(c), "\\d+(?:\\.\\d+)?", 0)
    return F.when(n == "", F.lit(low)).otherwise(F.least(F.greatest(n.cast("double"), F.lit(low)), F.lit(high)))


def after_marker(c, marker: str) -> Column:
    """What follows the marker (its first place), trimmed; the whole text if it is absent."""
    t = text_of(c)
    at = F.instr(t, marker)
    return F.trim(F.when(at > 0, F.substring(t, at + len(marker), F.length(t))).otherwise(t))


def list_items(c) -> Column:
    """Non-blank lines without list markers."""
    lines = F.transform(F.split(text_of(c), "\\r?\\n"), lambda x: F.trim(F.regexp_replace(x, "^\\s*(?:[-*•]|\\d+[.)、])\\s*", "")))
    return F.filter(lines, lambda x: x != "")


def repaired_markers(c) -> Column:
    """Article markers that line breaks split are joined again."""
    whole = F.regexp_replace(text_of(c), f"(第\\s*{CN_NUMERAL})\\s*\\n\\s*({CN_NUMERAL})\\s*条", "$1$2条")
    return F.regexp_replace(F.regexp_replace(whole, f"第\\s*({CN_NUMERAL})\\s*条", "第$1条"), f"第({CN_NUMERAL})[ \\t\\u3000]*(编|分编|章|节)", "第$1$2")


def merged_lines(lines: Column, hyphen: bool = False) -> Column:
    """Lines joined into paragraphs: a line ends one if it ends a sentence, or the next is blank, a list item or a heading.

    Latin neighbours are joined by a blank, others without; with `hyphen` a trailing hyphen joins without either."""
    clean = F.transform(lines, lambda x: F.trim(F.regexp_replace(F.coalesce(x, F.lit("")), "[ \\t\\u3000]+", " ")))
    starts = lambda x: x.rlike("^(?:[（(][一二三四五六七八九十0-9a-zA-Z]+[)）]|[0-9]+[.、)]|第[一二三四五六七八九十百千万〇零0-9]+(?:编|分编|章|节|条)|§)")
    ends = lambda x: x.rlike("[。！？；：.!?;:]$")

    def step(a, x):
        cur = a["cur"]
        fresh = (x == "") | (cur == "") | ends(cur) | starts(x)
        glue = F.when(F.lit(hyphen) & cur.rlike("[A-Za-z]-$"), F.concat(F.regexp_replace(cur, "-$", ""), x)).when(cur.rlike("[A-Za-z0-9,;)]$") & x.rlike("^[A-Za-z0-9(]"), F.concat(cur, F.lit(" "), x)).otherwise(F.concat(cur, x))
        return F.struct(F.when(fresh, x).otherwise(glue).alias("cur"), F.when(fresh & (cur != ""), F.concat(a["out"], F.array(cur))).otherwise(a["out"]).alias("out"))

    return F.aggregate(clean, F.struct(F.lit("").alias("cur"), F.array().cast("array<string>").alias("out")), step, lambda a: F.when(a["cur"] == "", a["out"]).otherwise(F.concat(a["out"], F.array(a["cur"]))))


def section_key(c) -> Column:
    """`12A(b)(1)` as `12a:b:1`; null where the text is no section number."""
    t = F.trim(text_of(c))
    ok = t.rlike("^\\d+[A-Za-z]?(?:\\([^)]+\\))*$")
    parts = F.concat(F.array(F.lower(F.regexp_extract(t, "^\\d+[A-Za-z]?", 0))), F.transform(F.regexp_extract_all(t, F.lit("\\(([^)]+)\\)"), F.lit(1)), lambda x: F.lower(F.trim(x))))
    return F.when(ok, F.array_join(parts, ":"))
