"""Secret scans by linking the parts of credentials. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

#: Base kinds: pattern, group whose length counts, least length. The patterns are fixed values.
BASE = [
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]{16,}", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
]
#: Weak candidates: pattern, and the role of the part in a credential.
WEAK = [
    ("endpoint", r"""(?:https?|ftp|ssh|jdbc:[a-z]+|postgres(?:ql)?|mysql|redis|amqps?|mongodb)://[^\x20\x09-\x0D"'<>]{3,}""", "place"),
    ("login", r"""(?i:\b(?:user(?:_?name)?|login|client_?id|account_?id|access_?key_?id))["']?\x20*[:=]\x20*["']?[A-Za-z0-9._@+-]{3,}""", "identifier"),
    ("opaque", r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])(?=[0-9+/_-]*+[A-Za-z])[A-Za-z0-9+/_-]{16,}+", "secret"),
]
ROLE = {"assign": "secret", "access": "identifier", "hex": "secret"} | {k: r for k, _, r in WEAK}
KINDS = [k for k, *_ in BASE] + [k for k, *_ in WEAK]
REACH = 160  # code points between parts that may share a line or lie in different blocks
BLANK = r"\n\s*\n"


def _hits(text, number: int, pattern: str, group: int, least: int):
    """array<struct<kind, seq, gap, len, lines, blanks, ok>>: for each match in order, the code points since the last one
    and its own, and the line ends and blank lines since the last one; no match holds a line end.

    Matches are taken by the same scan as the pieces between them, so gaps and lengths add up to positions."""
    # zipped first: what a lambda holds beside its own argument would be computed again for each match
    whole, pieces = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    found = F.arrays_zip(whole, pieces, F.regexp_extract_all(text, F.lit(pattern), F.lit(group))) if group else F.arrays_zip(whole, pieces)
    made = F.transform(
        found,
        lambda x, i: F.struct(F.lit(number).alias("kind"), i.cast("int").alias("seq"), F.length(x["1"]).cast("long").alias("gap"), F.length(x["0"]).cast("long").alias("len"), F.regexp_count(x["1"], F.lit(r"\n")).alias("lines"), F.regexp_count(x["1"], F.lit(BLANK)).alias("blanks"), (F.length(x["2" if group else "0"]) >= least).alias("ok")),
    )
    return F.when(text.rlike(pattern), F.filter(made, lambda x: x["len"].isNotNull()))


def _linked(docs: DataFrame, text: str, carried, reach: int) -> DataFrame:
    """(doc, n_assign, n_access, n_hex, spans) of each row: doc is the column `carried`, spans as in linked()."""
    t = F.col("t")
    found = F.concat(
        F.array(F.struct(F.lit(-1).alias("kind"), F.lit(0).alias("seq"), F.lit(0).cast("long").alias("gap"), F.lit(0).cast("long").alias("len"), F.lit(0).alias("lines"), F.lit(0).alias("blanks"), F.lit(False).alias("ok"))),
        *[F.coalesce(_hits(t, n, p, g, least), F.array()) for n, (_, p, g, least) in enumerate(BASE)],
        *[F.coalesce(_hits(t, n + len(BASE), p, 0, 0), F.array()) for n, (_, p, _) in enumerate(WEAK)],
    )
    rows = docs.select(F.monotonically_increasing_id().alias("row"), carried.alias("doc"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    rows = rows.select("row", "doc", F.inline(found))
    rows = rows.withColumn("doc", F.when(F.col("kind") == -1, F.col("doc")))
    order = Window.partitionBy("row", "kind").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    parts = rows.repartition("row").withColumn("end", F.sum(F.col("gap") + F.col("len")).over(order)).withColumn("start", F.col("end") - F.col("len"))
    parts = parts.withColumn("line", F.sum("lines").over(order)).withColumn("block", F.sum("blanks").over(order))
    parts = parts.where("kind = -1 or ok")
    base = F.col("kind").between(0, len(BASE) - 1)
    up = Window.partitionBy("row").orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, -1)
    down = Window.partitionBy("row").orderBy("start", "kind").rowsBetween(1, Window.unboundedFollowing)
    covered = (F.coalesce(F.max(F.when(base, F.col("end"))).over(up), F.lit(-1)) > F.col("start")) | (F.coalesce(F.min(F.when(base, F.col("start"))).over(down), F.lit(2**62)) < F.col("end"))
    parts = parts.withColumn("covered", covered).where(base | (F.col("kind") == -1) | ~F.col("covered"))
    role = F.element_at(F.array(*[F.lit(ROLE[k]) for k in KINDS]), F.greatest(F.col("kind") + 1, F.lit(1)))
    parts = parts.withColumn("role", F.when(F.col("kind") >= 0, role))
    first, last = Window.partitionBy("row").orderBy("start", "kind").rowsBetween(0, Window.unboundedFollowing), Window.partitionBy("row").orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, 0)
    block = Window.partitionBy("row", "block")

    def near(wanted):
        of = lambda c: F.when(wanted, F.col(c))
        close = (F.max(of("end")).over(last) >= F.col("start") - reach, F.min(of("start")).over(first) <= F.col("end") + reach)
        other_line = (F.min(of("line")).over(block) != F.col("line"), F.max(of("line")).over(block) != F.col("line"))
        return F.greatest(*[F.coalesce(c, F.lit(False)) for c in (*close, *other_line)])

    secret, other = near(F.col("role") == "secret"), near(F.col("role").isin("identifier", "place"))
    parts = parts.withColumn("linked", F.when(F.col("role") == "secret", other).otherwise(secret))
    parts = parts.where((F.col("kind") == -1) | base | F.col("linked"))
    parts = parts.withColumn("before", F.coalesce(F.max(F.when(F.col("kind") >= 0, F.col("end"))).over(up), F.lit(-1).cast("long")))
    count = lambda n: F.count(F.when(F.col("kind") == n, 1)).alias(f"n_{KINDS[n]}")
    spans = F.array_sort(F.collect_list(F.when(F.col("kind") >= 0, F.struct("start", "kind", "end", "before")))).alias("spans")
    return parts.groupBy("row").agg(F.max_by("doc", F.col("doc").isNotNull()).alias("doc"), count(0), count(1), count(2), spans).drop("row")


FOUND = ["n_assign", "n_access", "n_hex", "spans"]


def linked(docs: DataFrame, text: str = "text", carry: list[str] | None = None, reach: int = REACH) -> DataFrame:
    """One row a document: the columns in `carry`, n_assign, n_access, n_hex, and `spans`, an array of
    struct<start, kind, end, before> of all spans by start and kind (KINDS numbers the kinds), ends exclusive, in code
    points; before is the furthest end of the spans listed earlier, -1 for the first.

    Base spans always count. A weak candidate (endpoint, login, opaque run) counts only if a part with another role
    that makes a credential with it is near: an identifier or endpoint needs a secret, an opaque run an identifier or
    endpoint; weak parts may support one another. What a base span covers is no candidate.
    Near is another line of the same block of non-blank lines, however far; or, on one line or across blank lines, at
    most `reach` code points between the end of one and the start of the other, however long they are. Both are windows
    over each document's parts, so a document with very many parts costs their number times its logarithm.

    Each document also has an anchor row, which carries the columns: one shuffle brings parts and document together.
    Null text is empty; very long texts are scanned whole; repeated rows stay apart; of parts that start at one place the
    kind listed first comes first; documents without parts keep empty arrays; an empty table gives no rows; carried
    columns named as those added are replaced by them."""
    carry = [c for c in (carry if carry is not None else ["doc_id"]) if c not in FOUND]
    d = _linked(docs, text, F.struct(*carry) if carry else F.struct(F.lit(0).alias("none")), reach)
    return d.select(*[F.col("doc")[c].alias(c) for c in carry], *FOUND)


def _joined(spans):
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, mark: str = "[SECRET]", reach: int = REACH) -> DataFrame:
    """docs with every span of the text replaced by `mark` (spans that touch or overlap: by one), n_chars recounted if
    there; other columns, whatever their names, and rows unchanged. A null text stays null; texts of any length are
    searched whole; repeated rows are redacted alike; an empty table gives no rows."""
    own = docs.columns
    d = _linked(docs, "text", F.struct(*own), reach)
    text = F.col("doc")["text"]
    # a span that starts beyond all ends before it closes the stretch in between and opens a mark
    cut = F.transform("spans", lambda x: F.when(x["start"] > x["before"], F.concat(F.substring(text, (F.greatest(x["before"], F.lit(0)) + 1).cast("int"), (x["start"] - F.greatest(x["before"], F.lit(0))).cast("int")), F.lit(mark))).otherwise(""))
    end = F.array_max(F.transform("spans", lambda x: x["end"]))
    done = F.concat(F.array_join(cut, ""), F.substring(text, (end + 1).cast("int"), F.length(text)))
    found = F.size("spans") > 0
    d = d.select("doc", F.when(found, done).otherwise(text).alias("redacted"), found.alias("found"))
    out = []
    for c in own:
        x = F.col("doc")[c]
        if c == "text":
            x = F.col("redacted")
        elif c == "n_chars":
            x = F.when(F.col("found"), F.length("redacted").cast(docs.schema[c].dataType)).otherwise(x)
        out.append(x.alias(c))
    return d.select(out)


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans of every document; see linked() for odd rows."""
    d = linked(table(spark, sf_dir, "documents", "doc_id", "text"))
    base = F.filter("spans", lambda s: s["kind"] < len(BASE))
    return d.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))
