"""Language identification by Bayesian fusion of text, declared language, address suffix and host."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textops
from .common import in_arrow, slices, stored, table

BUCKETS = 1 << 15
SAMPLE = 6000  # labelled rows the text models are fitted on, shared evenly by the declared languages
FOLDS = 2  # a text is judged by counts of the other folds' texts alone, so no declaration tells about its own text
MOST_LANGUAGES = 1000  # more distinct declarations are refused: such a column doesn't declare languages
EVIDENCE = 80  # text counts as at most so many independent n-grams
FLAT = 0.1  # share of the flat model in each language's
TRUST = 0.9  # chance that a declared language is right
SMOOTH = 20.0  # rows that a host's parent level weighs in its prior
UNDETERMINED = "und"
#: Address suffixes that point to a language.
SUFFIX_LANG = {"de": "de", "at": "de", "fr": "fr", "es": "es", "mx": "es", "ar": "es", "uk": "en", "us": "en", "au": "en", "ie": "en", "it": "it", "pt": "pt", "br": "pt", "nl": "nl"}
U = np.uint64


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of each character trigram of the lower-cased text, number of them for each text).

    A trigram needs a letter at its middle; white space, digits and marks around it are one blank, so it tells word
    edges but not layout."""
    low = [" " + t.lower() + " " for t in texts]
    size = np.fromiter(map(len, low), np.int64, len(low))
    c = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = ((c >= 97) & (c <= 122)) | ((c >= 0xC0) & (c != 0xD7) & (c != 0xF7) & ~((c >= 0x2000) & (c < 0x2C00)) & ~((c >= 0x3000) & (c < 0x3040)) & (c < 0x1F000))
    x = np.where(letter, c, np.uint32(32)).astype(U)
    h = np.zeros(len(c), U)
    h[1:-1] = x[:-2] * textops.MIX[2] + x[1:-1] * textops.MIX[3] + x[2:] * textops.MIX[4]
    at = np.flatnonzero(letter)
    owner = np.searchsorted(np.cumsum(size), at, "right")
    return (textops.fmix(h[at]) >> U(49)).astype(np.int64), np.bincount(owner, minlength=len(texts))


def quota(sizes: dict[str, int], sample: int) -> int:
    """Rows a language that fit in `sample` if each gives as many or all it has; one at least."""
    left, order = sample, sorted(sizes.values())
    for i, n in enumerate(order):
        if n * (len(order) - i) > left:
            return max(1, left // (len(order) - i))
        left -= n
    return max(order, default=1)


def fitting_rows(labelled: DataFrame, sample: int = SAMPLE) -> tuple[list[str], DataFrame]:
    """All declared languages, and (text, lang) of at most `sample` rows (more only if there are more languages), of each
    language all or `quota`: the hash of id and text deals its rows over so many slots, the least hash of a slot counts.

    Slots are counted by language and slot before any text moves; their table has at most `sample` rows or one a language."""
    rows = labelled.where("lang is not null and text is not null")
    sizes = {r.lang: r["count"] for r in rows.groupBy("lang").count().collect()}
    if sum(sizes.values()) <= sample:
        return sorted(sizes), rows.select("text", "lang")
    q = quota(sizes, sample)
    small = sorted(x for x, n in sizes.items() if n <= q)
    rows = rows.select("text", "lang", F.xxhash64("doc_id", "text", F.lit("fit")).alias("h"))
    large = rows.where(~F.col("lang").isin(small)) if small else rows
    first = large.groupBy("lang", F.pmod("h", F.lit(q)).alias("slot")).agg(F.min("h").alias("h")).select("lang", "h")
    picked = large.join(F.broadcast(first), ["lang", "h"], "left_semi").dropDuplicates(["lang", "h"])
    if small:
        picked = picked.unionByName(rows.where(F.col("lang").isin(small)))
    return sorted(sizes), picked.select("text", "lang")


def fold(text: str | F.Column, folds: int = FOLDS) -> F.Column:
    """The fold of a text; equal texts share one."""
    return F.pmod(F.xxhash64(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), F.lit("fold")), F.lit(folds)).cast("int")


def fit(labelled: DataFrame, sample: int = SAMPLE, folds: int = FOLDS) -> tuple[list[str], np.ndarray]:
    """All declared languages of (doc_id, text, lang) and log-probabilities (folds, BUCKETS, languages + 1) from the
    fitting_rows, for each fold from the rows of the others (a language with texts in one fold alone: from those); the
    last column, for no known language, is flat. Counts are summed by language, fold and bucket on the executors; at most
    folds * BUCKETS rows a language come to the driver."""
    langs, rows = fitting_rows(labelled, sample)
    if len(langs) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} declared languages")

    def run(batches):
        for b in slices(batches):
            t, key = b.column("text").to_pylist(), list(zip(b.column("lang").to_pylist(), b.column("fold").to_pylist()))
            for one in sorted(set(key)):
                total = np.zeros(BUCKETS, np.int64)
                for _, part in textops.chunks([x for x, y in zip(t, key) if y == one]):
                    total += np.bincount(grams(part)[0], minlength=BUCKETS)
                k = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array([one[0]] * len(k), pa.string()), pa.array([one[1]] * len(k), pa.int32()), pa.array(k, pa.int32()), pa.array(total[k])], names=["lang", "fold", "bucket", "n"])

    found = in_arrow(rows.select("text", "lang", fold("text", folds).alias("fold")), run, "lang string, fold int, bucket int, n long").groupBy("lang", "fold", "bucket").agg(F.sum("n").alias("n")).collect()
    place = {x: i for i, x in enumerate(langs)}
    counts = np.zeros((folds, BUCKETS, len(langs) + 1))
    for r in found:
        counts[r.fold, r.bucket, place[r.lang]] += r.n
    if folds > 1:
        total = counts.sum(0)
        counts = total[None] - counts
        counts = np.where(counts.sum(1, keepdims=True) > 0, counts, total[None])
    counts += 1e-9
    counts[:, :, -1] = 1
    p = counts / counts.sum(1, keepdims=True)
    # an unseen trigram costs a language little against the flat model, so a short text of rare ones isn't rejected
    return langs, np.log((1 - FLAT) * p + FLAT / BUCKETS).astype(np.float32)


def text_evidence(texts: list[str], folds: list[int], logp: np.ndarray, evidence: int = EVIDENCE) -> tuple[np.ndarray, np.ndarray]:
    """(trigrams of each text, log-likelihood of each language and of the flat model, as of `evidence` trigrams at most)."""
    k = logp.shape[2] - 1
    n, ll = np.zeros(len(texts), np.int64), np.zeros((len(texts), k + 1))
    of = np.array(folds)
    for f in np.unique(of):
        rows = np.flatnonzero(of == f)
        for first, part in textops.chunks([texts[i] for i in rows], 500_000):
            g, m = grams(part)
            at, has = rows[first : first + len(part)], np.flatnonzero(m)
            n[at] = m
            if len(has):
                ll[at[has]] = np.add.reduceat(logp[f][g], (np.cumsum(m) - m)[has], axis=0, dtype=np.float64)
    return n, ll * (np.minimum(n, evidence) / np.maximum(n, 1))[:, None]


JUDGED = ["lang_id", "confidence", "text_lang", "keep"]


def identify(rows: DataFrame, model: tuple[list[str], np.ndarray], declared: str | None = None, host: str | None = None, suffix: str | None = None, parent: str | None = None, trust: float = TRUST, smooth: float = SMOOTH, evidence: int = EVIDENCE) -> DataFrame:
    """rows without text, with lang_id, confidence, text_lang and keep.

    log posterior = text + declared + suffix + host prior. Text: mean log-likelihood of the trigrams, times their number
    or `evidence`, whichever is less, against a flat model for no known language (und); the model knows nothing of the
    text's own fold. Declared language and suffix: right with chance `trust`, else evenly wrong; null or unknown ones
    say nothing. Host prior: share of languages among the host's other rows, as their text alone tells, smoothed by
    `smooth` rows of its parent's (registered domain's) share, that by the suffix's, that by all rows'; grouped
    aggregates, written down and joined back by host. Rows of a host are summed before the shuffle, so a host may have a
    third of all rows; the table of hosts is broadcast if its file is below Spark's bound, else the join is one that
    adaptive execution splits where a host is large.
    keep: a known language won. Null and empty texts, and texts without letters, are und and not kept. Where no language
    is known at all, nothing can be told: texts with letters are und and kept. Only text goes to Python, and only numbers
    come back; very long texts are judged whole. Equal scores: the first language by name. Repeated rows are judged
    alike, all of them given; an empty table gives no rows; columns named as those added are replaced, others kept."""
    langs, logp = model
    k = len(langs)
    own = [c for c in rows.columns if c != "text" and c not in JUDGED]
    made = rows.sparkSession.sparkContext.broadcast(logp)
    given = [(F.col(c) if c else F.lit(None)).cast("string").alias(n) for n, c in (("__d", declared), ("__h", host), ("__s", suffix), ("__p", parent))]
    carried = F.struct(*[F.col(c) for c in own]) if own else F.struct(F.lit(0).alias("__none"))
    base = rows.select(carried.alias("__doc"), "text", fold("text", logp.shape[0]).alias("__f"), *given)
    out_schema = T.StructType([*base.drop("text", "__f").schema.fields, T.StructField("__n", T.LongType()), T.StructField("__ll", T.ArrayType(T.DoubleType())), T.StructField("__t", T.IntegerType())])

    def run(batches):
        for b in slices(batches):
            n, ll = text_evidence([x or "" for x in b.column("text").to_pylist()], b.column("__f").to_pylist(), made.value, evidence)
            best = np.where(n > 0, ll.argmax(1), k)
            kept = b.drop_columns(["text", "__f"])
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(n), pa.array(ll.tolist(), pa.list_(pa.float64())), pa.array(best, pa.int32())], names=[*kept.schema.names, "__n", "__ll", "__t"])

    d = in_arrow(base, run, out_schema)
    if not k:  # nothing was declared
        return d.select(*[F.col("__doc")[c].alias(c) for c in own], F.lit(UNDETERMINED).alias("lang_id"), F.lit(1.0).alias("confidence"), F.lit(UNDETERMINED).alias("text_lang"), (F.col("__n") > 0).alias("keep"))
    d = stored(d)
    seen = [F.count(F.when(F.col("__t") == i, 1)).cast("double") for i in range(k)]
    by = stored(d.groupBy("__s", "__p", "__h").agg(F.array(*seen).alias("c")))
    total = by.agg(*[F.coalesce(F.sum(F.get("c", F.lit(i))), F.lit(0.0)).alias(f"n{i}") for i in range(k)]).first()
    level = [(total[i] + 1.0) / (sum(total) + k) for i in range(k)]
    prior = F.array(*[F.lit(x) for x in level])
    for keys in (["__s"], ["__s", "__p"]):  # sums of each level, joined to the hosts
        c = f"{keys[-1]}c"
        sums = by.groupBy(*keys).agg(F.array(*[F.sum(F.get("c", F.lit(i))) for i in range(k)]).alias(c))
        sums = sums.select(*[F.col(x).alias(f"r{x}") for x in keys], c)
        on = F.col(keys[0]).eqNullSafe(F.col(f"r{keys[0]}"))
        for x in keys[1:]:
            on = on & F.col(x).eqNullSafe(F.col(f"r{x}"))
        by = by.join(sums, on).drop(*[f"r{x}" for x in keys])
    folded = lambda c, p: F.transform(F.zip_with(c, p, lambda a, q: F.struct(a.alias("a"), q.alias("q"))), lambda z: (z["a"] + smooth * z["q"]) / (F.aggregate(c, F.lit(0.0), lambda x, y: x + y) + smooth))
    by = by.withColumn("p1", folded(F.col("__sc"), prior)).withColumn("p2", F.when(F.col("__p").isNull(), F.col("p1")).otherwise(folded(F.col("__pc"), F.col("p1"))))
    by = stored(by.select(F.col("__s").alias("hs"), F.col("__p").alias("hp"), F.col("__h").alias("hh"), "p2", F.col("c").alias("hc")))
    d = d.join(by, F.col("__s").eqNullSafe(F.col("hs")) & F.col("__p").eqNullSafe(F.col("hp")) & F.col("__h").eqNullSafe(F.col("hh")))
    others = F.transform(F.col("hc"), lambda x, i: F.when(F.col("__h").isNull(), F.lit(0.0)).otherwise(x - F.when(F.col("__t") == i, 1.0).otherwise(0.0)))
    d = d.withColumn("__prior", folded(others, F.col("p2")))
    suffix_lang = F.create_map(*[F.lit(x) for kv in SUFFIX_LANG.items() for x in kv])
    names = F.array(*[F.lit(x) for x in langs])
    right, wrong = float(np.log(trust)), float(np.log((1 - trust) / max(1, k - 1)))
    said = F.when(F.array_contains(names, F.col("__d")), F.col("__d")).otherwise(F.lower(F.substring_index(F.substring_index(F.trim("__d"), "-", 1), "_", 1)))
    tld = F.try_element_at(suffix_lang, F.lower(F.coalesce("__s", F.lit(""))))
    hint = lambda s, i: F.when(s.isNull() | ~F.array_contains(names, F.coalesce(s, F.lit(""))), 0.0).when(s == F.get(names, i), right).otherwise(wrong)
    score = F.transform(F.col("__prior"), lambda q, i: F.get(F.col("__ll"), i) + F.log(q) + hint(said, i) + hint(tld, i))
    # no known language: the flat model, a prior of one row in a thousand, hints right by chance
    d = d.withColumn("__score", F.concat(score, F.array(F.get(F.col("__ll"), F.lit(k)) + float(np.log(1e-3)))))
    d = d.withColumn("__top", F.array_max("__score"))
    d = d.withColumn("__at", F.when(F.col("__n") == 0, k).otherwise(F.array_position("__score", F.col("__top")).cast("int") - 1))
    conf = F.when(F.col("__n") == 0, 1.0).otherwise(1.0 / F.aggregate("__score", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("__top"))))
    every = F.array(*[F.lit(x) for x in [*langs, UNDETERMINED]])
    return d.select(*[F.col("__doc")[c].alias(c) for c in own], F.get(every, F.col("__at")).alias("lang_id"), conf.alias("confidence"), F.get(every, F.col("__t")).alias("text_lang"), (F.col("__at") < k).alias("keep"))


def pages_evidence(pages: DataFrame) -> DataFrame:
    """(page_id, text, declared, host, parent, suffix) of web pages: tags dropped, lang of the html tag, parts of the address."""
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1))
    html = F.coalesce("html", F.lit(""))
    text = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style|head)\b.*?</\1\s*>", " "), r"(?s)<[^>]*>", " ")
    d = pages.select("page_id", text.alias("text"), F.nullif(F.lower(F.regexp_extract(html, r"""(?is)<html\b[^>]*?\slang\s*=\s*["']?([a-z-]+)""", 1)), F.lit("")).alias("declared"), F.nullif(host, F.lit("")).alias("host"))
    return d.withColumn("suffix", F.substring_index("host", ".", -1)).withColumn("parent", F.substring_index("host", ".", -2))


def documents_identified(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """identify() over rows of documents: lang is the declared language, source the host."""
    return identify(docs, fit(docs.select("doc_id", "text", "lang"), sample), declared="lang", host="source")


def kept(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The rows of docs whose language is known, as they are.

    Texts don't pass through Python: rows of equal doc_id, text, lang and source are judged alike, so the rejected ones are
    written down as keys (a text by its MD5) and taken out by an anti-join, broadcast where their file is small."""
    key = lambda prefix: [F.col("doc_id").alias(f"{prefix}i"), F.md5(F.coalesce("text", F.lit(""))).alias(f"{prefix}t"), F.col("lang").alias(f"{prefix}l"), F.col("source").alias(f"{prefix}s")]
    rows = docs.select("text", "lang", "source", "doc_id", F.md5(F.coalesce("text", F.lit(""))).alias("md5"))
    out = documents_identified(rows, sample).where("not keep").select("doc_id", "md5", "lang", "source").distinct()
    out = stored(out.toDF("__ri", "__rt", "__rl", "__rs"))
    d = docs.select("*", *key("__k"))
    same = [F.col(f"__k{x}").eqNullSafe(F.col(f"__r{x}")) for x in "itls"]
    return d.join(out, same[0] & same[1] & same[2] & same[3], "left_anti").select(docs.columns)


def pages_identified(pages: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(page_id, declared, host, lang_id, confidence, text_lang, keep) of every row of pages(page_id, url, html): the
    text, the language declared in the markup, the address's suffix and the priors of host, domain and suffix.

    Null addresses have no host; null or empty pages are und; repeated rows are judged alike; an empty table gives none."""
    p = pages_evidence(pages)
    found = identify(p, fit(p.select(F.col("page_id").alias("doc_id"), "text", F.col("declared").alias("lang")), sample), declared="declared", host="host", suffix="suffix", parent="parent")
    return found.select("page_id", "declared", "host", *JUDGED)


def page_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages_identified(table(spark, sf_dir, "pages", "page_id", "url", "html"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, lang (declared), lang_id, confidence, text_lang and keep of every document."""
    d = documents_identified(table(spark, sf_dir, "documents", "doc_id", "text", "lang", "source"))
    return d.select("doc_id", "lang", *JUDGED)
