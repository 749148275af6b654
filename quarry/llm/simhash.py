"""Document fingerprints: SimHash votes of weighted term hashes; permuted block tables find near fingerprints."""

from __future__ import annotations

import hashlib
import json
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textops
from .common import groups, in_arrow, slices, stored, table

BITS = 256
TERM_WORDS = 3
RADIUS = 7  # differing bits of near fingerprints: a cosine of 0.996, about one changed word in a thousand
BUCKET = 1024  # of a larger bucket, pairs of blocks of about this size are compared
RUN_BYTES = 64 << 20  # of the files that one run of documents comes from, about
U = np.uint64
_LANES = np.array([sum(((b >> i) & 1) << (8 * i) for i in range(8)) for b in range(256)], U)


def fingerprints(texts: list[str], bits: int = BITS, k: int = TERM_WORDS) -> np.ndarray:
    """(len(texts), bits // 8) bytes. A term is a run of k words (all words, if fewer) and weighs its number of
    occurrences; each term's hash votes +weight or -weight on every bit. A text without words gets zeros.

    Votes are counted in eight byte-wide lanes of a 64-bit word, over at most 255 terms at a time, then widened."""
    out = np.zeros((len(texts), bits // 8), np.uint8)
    for first, run in textops.chunks(texts, 400_000):
        term, n = textops.shingles(*textops.words(run), k)
        if not len(term):
            continue
        parts = -(-n // 255)  # pieces of at most 255 terms
        owner = np.repeat(np.arange(len(run)), parts)
        begin = np.cumsum(n) - n
        at = np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)
        cuts = np.repeat(begin, parts) + 255 * at
        votes = np.zeros((len(run), bits), np.int32)
        doc_cut = np.flatnonzero(np.diff(owner, prepend=-1))
        has = owner[doc_cut]
        for j in range(bits // 64):
            h = (term if j == 0 else textops.fmix(term + U(j * int(textops.MIX[6]) % 2**64))).view(np.uint8).reshape(-1, 8)
            for b in range(8):
                lanes = np.add.reduceat(_LANES[h[:, b]], cuts).view(np.uint8).reshape(-1, 8)
                votes[has, j * 64 + b * 8 : j * 64 + b * 8 + 8] = np.add.reduceat(lanes.astype(np.int32), doc_cut, axis=0)
        out[first : first + len(run)] = np.packbits(2 * votes > n[:, None], axis=1)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The cosine of the weighted terms as the share of differing bits estimates it, at least 0; 1 for equal ones."""
    bits = a.shape[1] * 8
    differ = np.unpackbits(a ^ b, axis=1).sum(1)
    return np.maximum(0.0, np.where(differ == 0, 1.0, np.cos(np.pi * differ / bits)))


def fingerprint(df: DataFrame, text: str = "text", bits: int = BITS, k: int = TERM_WORDS, name: str = "fingerprint") -> DataFrame:
    """df with a hex fingerprint of each whole text (null: empty) as column `name`, which replaces one of that name."""
    spare = "__simhash_text"
    df = df.withColumn(spare, F.coalesce(F.col(text), F.lit(""))).drop(*([name] if name in df.columns and name != text else []))
    schema = df.drop(spare).schema.add(name, "string")

    def run(batches):
        for b in slices(batches, spare):
            t = b.column(b.schema.get_field_index(spare)).to_pylist()
            fp = pa.array([x.tobytes().hex() for x in fingerprints(t, bits, k)], pa.string())
            b = b.drop_columns([spare])
            yield pa.RecordBatch.from_arrays([*b.columns, fp], names=[*b.schema.names, name])

    return df.transform(in_arrow, run, schema)


def block_tables(df: DataFrame, fp: str = "fingerprint", bits: int = BITS, radius: int = 3, blocks: int | None = None) -> DataFrame:
    """Every row once for each of its permuted tables: column block_key holds which blocks lead and what they hold.

    The bits are cut into `blocks` (radius + 1 by default; more blocks make longer keys); two fingerprints within the
    radius differ in at most `radius` blocks, so they agree on all of the others, and on one key at least."""
    blocks = blocks or radius + 1
    if not radius < blocks <= bits // 4:
        raise ValueError("blocks must be over radius and leave 4 bits a block")
    digits = bits // 4
    cut = [round(i * digits / blocks) for i in range(blocks + 1)]
    keys = [F.concat(F.lit(f"{i}:"), *[F.substring(fp, cut[j] + 1, cut[j + 1] - cut[j]) for j in lead]) for i, lead in enumerate(combinations(range(blocks), blocks - radius))]
    return df.withColumn("block_key", F.explode(F.array(*keys)))


def distance(a: str, b: str, digits: int = BITS // 4) -> F.Column:
    """Hamming distance of two hex columns, on the JVM."""
    return sum((F.bit_count(F.conv(F.substring(a, i + 1, 8), 16, 10).cast("long").bitwiseXOR(F.conv(F.substring(b, i + 1, 8), 16, 10).cast("long"))) for i in range(0, digits, 8)), F.lit(0))


def near(queries: DataFrame, docs: DataFrame, id_col: str = "doc_id", radius: int = 3, bits: int = BITS, blocks: int | None = None) -> DataFrame:
    """All pairs (query fingerprint, fingerprint, distance) of fingerprints within the radius, found through the
    permuted block tables. Both sides are first reduced to their distinct fingerprints, so copies, however many, meet
    as one row; join the fingerprints back to the rows to name documents."""
    q = block_tables(queries.where(F.col("fingerprint").isNotNull()).select(F.col("fingerprint").alias("query_fingerprint")).distinct(), "query_fingerprint", bits, radius, blocks)
    d = block_tables(docs.where(F.col("fingerprint").isNotNull()).select("fingerprint").distinct(), "fingerprint", bits, radius, blocks)
    pairs = q.join(d, "block_key").withColumn("distance", distance("query_fingerprint", "fingerprint", bits // 4)).where(F.col("distance") <= radius)
    return pairs.select("query_fingerprint", "fingerprint", "distance").distinct()


def near_counts(prints: DataFrame, radius: int = RADIUS, bits: int = BITS, blocks: int | None = None, bucket: int = BUCKET) -> DataFrame:
    """(fingerprint, n_near) of each distinct fingerprint that has others within the radius: how many.

    Fingerprints meet in the buckets of the permuted block tables. A bucket's members are compared in matrices of
    distances; a pair counts in the first table in which it meets, so every pair counts once and only sums by fingerprint
    leave a bucket, never pairs. Buckets over twice `bucket` members are dealt as pairs of blocks over as many tasks."""
    blocks = blocks or radius + 1
    leads = list(combinations(range(blocks), blocks - radius))
    cut = [round(i * bits / 4 / blocks) for i in range(blocks + 1)]
    d = prints.where(F.col("fingerprint").isNotNull()).select("fingerprint").distinct()
    t = block_tables(d, "fingerprint", bits, radius, blocks)
    t = t.select(F.xxhash64("block_key").alias("bucket"), F.substring_index("block_key", ":", 1).cast("int").alias("lead"), F.unhex("fingerprint").alias("fp"))
    large = stored(t.groupBy("bucket").agg(F.count("*").alias("m")).where(F.col("m") > 2 * bucket))
    t = t.join(large, "bucket", "left").withColumn("nb", F.coalesce(F.ceil(F.col("m") / bucket), F.lit(1)).cast("int"))
    t = t.withColumn("own", F.pmod(F.xxhash64("fp"), F.col("nb")).cast("int")).withColumn("x", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    keys = ["bucket", "i", "j"]
    t = t.select("bucket", F.least("x", "own").alias("i"), F.greatest("x", "own").alias("j"), "own", "lead", "fp")

    def run(batches):
        for (_, i, j), g in groups(batches, keys):
            m = g.num_rows
            if m < 2:
                continue
            fp = np.frombuffer(b"".join(g.column("fp").to_pylist()), np.uint8).reshape(m, -1)
            lead, own = g.column("lead").to_numpy(), g.column("own").to_numpy()
            digits = np.stack([fp >> 4, fp & 15], 2).reshape(m, -1)
            part = np.ascontiguousarray(fp.view(np.uint64)) if fp.shape[1] % 8 == 0 else fp
            count = np.zeros(m, np.int64)
            for a in range(0, m, 256):
                rows = slice(a, a + 256)
                ok = lead[rows, None] == lead[None, :]
                ok &= np.arange(m)[rows, None] != np.arange(m)[None, :]
                if i != j:
                    ok &= own[rows, None] != own[None, :]
                p, q = np.nonzero(ok)
                apart = np.bitwise_count(part[p + a] ^ part[q]).sum(1)
                near = apart <= radius
                p, q = p[near], q[near]
                same = digits[p + a] == digits[q]
                agree = np.stack([same[:, cut[k] : cut[k + 1]].all(1) for k in range(blocks)], 1) if len(p) else np.zeros((0, blocks), bool)
                met = np.stack([agree[:, list(x)].all(1) for x in leads], 1) if len(p) else np.zeros((0, len(leads)), bool)
                first = met.argmax(1)
                good = met.any(1) & (first == lead[p + a])
                count[rows] += np.bincount(p[good], minlength=len(count[rows]))
            k = np.flatnonzero(count)
            if len(k):
                yield pa.RecordBatch.from_arrays([pa.array([fp[x].tobytes().hex() for x in k]), pa.array(count[k])], names=["fingerprint", "n"])

    found = t.repartition(*keys).sortWithinPartitions(*keys).transform(in_arrow, run, "fingerprint string, n long")
    return found.groupBy("fingerprint").agg(F.sum("n").alias("n_near"))


def _table(values: list, kind: str):
    """A constant array column, folded once when a query is planned; tens of thousands of values are one literal."""
    return F.from_json(F.lit(json.dumps(values)), f"array<{kind}>")


def _spread(spark: SparkSession, n: int) -> list[int]:
    """n numbers, the p-th of which hash partitioning over n partitions puts into partition p, so that each run has a
    task of its own."""
    found = spark.range(40 * n + 40).select(F.col("id").cast("int").alias("x")).groupBy(F.pmod(F.hash("x"), F.lit(n)).alias("p")).agg(F.min("x").alias("x")).collect()
    at = {r.p: r.x for r in found}
    return [at.get(p, p) for p in range(n)]


def in_runs(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """(p, mark, doc_id, text) dealt and sorted so that a stream of a task's rows meets each document before its next.

    Order: descending doc_id, nulls last, ties by a hash of the text, then the text. Splits of the ids, taken as
    quantiles, deal the rows into about `parts` runs (by default one for RUN_BYTES of the input's files, not fewer than
    the session's shuffle partitions or 32); an id that holds several quantiles is split further by the hash. The rows of
    each split's id also go, marked, to the run before theirs (those of the very first to the last run), so every run
    ends knowing its next document, and one shuffle of the texts is enough. Only the splits reach the driver."""
    spark = docs.sparkSession
    if parts is None:
        size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
        known = size < 1 << 60  # else the plan doesn't know its size
        parts = max(32, int(spark.conf.get("spark.sql.shuffle.partitions")), min(size // RUN_BYTES, 1 << 16) if known else 0)
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    order = F.coalesce(F.col("doc_id"), F.lit(-(2**63)))
    cuts = d.agg(F.percentile_approx(order, [i / parts for i in range(parts + 1)], 100 * parts).alias("cut"), F.count("*").alias("n")).first()
    if not cuts.n:
        return d.select(F.lit(0).alias("p"), F.lit(0).alias("mark"), "doc_id", "text")

    def place(ids, key):  # of a falling list, the last that is not below the key; -1 if all are
        block = F.size(F.filter(_table(ids[::64], "bigint"), lambda x: x >= key)) - 1
        return F.when(block < 0, -1).otherwise(block * 64 + F.size(F.filter(F.slice(_table(ids, "bigint"), block * 64 + 1, 64), lambda x: x >= key)) - 1)

    # quantiles are approximate, and rounded for very large ids: a run begins at the greatest id that it has
    ids = sorted((r.top for r in d.groupBy(place(sorted({*cuts.cut}, reverse=True), order)).agg(F.max(order).alias("top")).collect()), reverse=True)
    h, least = F.hash("text"), -(2**31)
    starts = {x: [least] for x in ids}  # of the rows of ids[i] itself: hashes at which its runs begin
    large = {r.x: r.n * parts // cuts.n for r in d.where(F.get(_table(ids, "bigint"), place(ids, order)) == order).groupBy(order.alias("x")).agg(F.count("*").alias("n")).where(F.col("n") * parts >= 2 * cuts.n).collect()}
    if large:
        grid = max(large.values())
        for r in d.where(order.isin([*large])).groupBy(order.alias("x")).agg(F.percentile_approx(h, [i / grid for i in range(1, grid)], 100 * grid).alias("q"), F.min(h).alias("low")).collect():
            found = sorted({*r.q} - {r.low})
            starts[r.x] += sorted({found[i * len(found) // large[r.x]] for i in range(large[r.x])}) if found else []
    base = [0]
    for x in ids:
        base.append(base[-1] + len(starts[x]))
    total = base[-1]
    rows = d.withColumn("i", place(ids, order)).withColumn("h", h).withColumn("own", F.get(_table(ids, "bigint"), F.col("i")) == order)
    within = F.size(F.filter(F.get(_table([starts[x] for x in ids], "array<int>"), F.col("i")), lambda x: x <= F.col("h"))) - 1
    rows = rows.withColumn("p", F.when(F.col("own"), F.get(_table(base, "int"), F.col("i")) + within).otherwise(F.get(_table(base, "int"), F.col("i") + 1) - 1))
    row = lambda p, mark: F.struct(p.alias("p"), F.lit(mark).alias("mark"))
    both = F.array(row(F.col("p"), 0), row(F.when(F.col("p") == 0, F.lit(total - 1)).otherwise(F.col("p") - 1), 1))
    rows = rows.select("doc_id", "text", "h", F.inline(F.when(F.col("own"), both).otherwise(F.array(row(F.col("p"), 0)))))
    rows = rows.withColumn("label", F.get(_table(_spread(spark, total), "int"), F.col("p"))).repartition(total, "label")
    return rows.sortWithinPartitions("p", "mark", F.col("doc_id").desc_nulls_last(), "h", "text").select("p", "mark", "doc_id", "text")


def op10_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every document, and
    near_fingerprints: how many other fingerprints of documents lie within RADIUS bits, found through the block tables.

    Nulls and empty texts fingerprint as zeros; an empty text edits to itself; repeated ids follow one another by their
    texts' hashes; a single document is its own next; very long texts are hashed whole; an empty table gives an empty
    result; columns beside doc_id and text are ignored."""
    return searched(edited_fingerprints(table(spark, sf_dir, "documents", "doc_id", "text")))


def searched(prints: DataFrame, radius: int = RADIUS, bits: int = BITS, blocks: int | None = None) -> DataFrame:
    """prints with near_fingerprints, which replaces a column of that name; rows without a fingerprint have 0."""
    own = [c for c in prints.columns if c != "near_fingerprints"]
    d = stored(prints.select(own))
    found = stored(near_counts(d.select("fingerprint"), radius, bits, blocks)).toDF("__fp", "__near")
    return d.join(found, F.col("fingerprint") == F.col("__fp"), "left").select(*own, F.coalesce("__near", F.lit(0)).cast("long").alias("near_fingerprints"))


def edited_fingerprints(docs: DataFrame, bits: int = BITS, k: int = TERM_WORDS, parts: int | None = None) -> DataFrame:
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def run(batches):
        prev, marked = None, None  # prev: the row that waits for its next, (run, doc_id, text, fingerprint)
        for b in slices(batches):
            texts = b.column("text").to_pylist()
            prints = fingerprints(texts, bits, k)
            ready, nxt = [], []
            for pp, mark, i, t, f in zip(b.column("p").to_pylist(), b.column("mark").to_pylist(), b.column("doc_id").to_pylist(), texts, prints):
                if mark and marked == pp:
                    continue  # of the next run only the first row counts
                if prev is not None:
                    ready.append(prev)
                    nxt.append((t, f))
                prev, marked = (None, pp) if mark else ((pp, i, t, f), marked)
            if not ready:
                continue
            e = []
            for (_, _, t, _), (u, _) in zip(ready, nxt):
                n = len(t) // 3
                e.append(t[: len(t) - n] + u[:n] if n else t)
            own, other, after = np.stack([r[3] for r in ready]), fingerprints(e, bits, k), np.stack([f for _, f in nxt])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([r[1] for r in ready], pa.int64()),
                    pa.array([len(r[2]) for r in ready], pa.int64()),
                    pa.array([hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest() for x in e]),
                    pa.array([x.tobytes().hex() for x in own]),
                    pa.array([x.tobytes().hex() for x in other]),
                    pa.array(likeness(own, other)),
                    pa.array(likeness(own, after)),
                ],
                names=[x.split()[0] for x in schema.split(", ")],
            )

    return in_runs(docs, parts).transform(in_arrow, run, schema)
