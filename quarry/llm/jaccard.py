"""N-gram Jaccard join by chosen paths: classes of near-duplicate documents, every link counted."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textops
from .common import components, discard, groups, in_arrow, slices, stored, table

WORDS = 5
THRESHOLD = 0.8
RECALL = 0.99
SPLIT = 256  # a bucket over this is split by one more sampled token
BLOCK = 512  # what is still larger is compared in pairs of blocks of about this size
TOKENS = 4_000_000  # of a block in the exact comparison, about: long texts make smaller blocks
BINS = 128  # of a sketch
SLACK = 0.15  # an estimate this far under the threshold still counts: over 4 standard errors
NULL_ID = -(2**63)
U = np.uint64


def runs_for(recall: float, threshold: float) -> int:
    """Runs until a pair at the threshold is missed with chance 1 - recall at most, if both its levels are sampled.

    A pair shares at least `threshold` of the larger set, and each token is chosen with 1 / (threshold * size), so it
    shares a Poisson number of choices of mean 1 or more at each level."""
    one = 1 - math.exp(-1)
    two = 1 - math.exp(-one)
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - two)))


def sets_of(texts: list[str], words: int) -> list[np.ndarray]:
    """Sorted distinct hashes of the word shingles of each whole text (fewer words than that: one shingle of all)."""
    out: list[np.ndarray] = []
    for _, part in textops.chunks(texts):
        h, n = textops.shingles(*textops.words(part), words)
        at = 0
        for m in n.tolist():
            out.append(np.unique(h[at : at + m]))
            at += m
    return out


def set_ids(sets: list[np.ndarray]) -> np.ndarray:
    """(len(sets), 2): 128 bits that tell sets apart."""
    return np.frombuffer(b"".join(hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets), np.int64).reshape(-1, 2)


def sketch(s: np.ndarray) -> bytes:
    """One-permutation sketch: of each of BINS ranges of hash values the least hash, as 1 to 255; 0 for an empty range."""
    out = np.zeros(BINS, np.uint8)
    if len(s):
        b = (s >> U(64 - BINS.bit_length() + 1)).astype(np.int64)
        first = np.flatnonzero(np.diff(b, prepend=-1))
        out[b[first]] = s[first] % U(255) + U(1)
    return out.tobytes()


def paths(s: np.ndarray, seeds: np.ndarray, threshold: float) -> list[dict]:
    """Chosen paths of a set: for each run the tokens whose hash under the run is below 1 / (threshold * size), with
    the keys one level deeper, chosen likewise under a hash that depends on the path so far."""
    if not len(s):
        return []
    limit = U(min(2**64 - 1, int(2**64 / (threshold * len(s)))))
    if len(s) * len(seeds) <= 1 << 16:  # all runs at once, which is faster for a short text
        r, t = np.nonzero(textops.fmix(s[None, :] ^ seeds[:, None]) <= limit)
    else:  # run by run: a very long text is never held more than a few times
        found = [np.flatnonzero(textops.fmix(s ^ seed) <= limit) for seed in seeds]
        r, t = np.repeat(np.arange(len(seeds)), [len(x) for x in found]), np.concatenate(found)
    keys = textops.fmix(s[t] * textops.MIX[4] + seeds[r])
    out = []
    for key in keys:
        u = np.flatnonzero(textops.fmix(s ^ key) <= limit)
        below = textops.fmix(s[u] * textops.MIX[5] + key)
        out.append({"k": int(key.view(np.int64)), "c": below.view(np.int64).tolist()})
    return out


def _described(docs: DataFrame, words: int, threshold: float, seeds: np.ndarray) -> DataFrame:
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"), F.coalesce("text", F.lit("")).alias("text"))
    path = T.ArrayType(T.StructType([T.StructField("k", T.LongType()), T.StructField("c", T.ArrayType(T.LongType()))]))
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("th", T.LongType()), T.StructField("s1", T.LongType()), T.StructField("s2", T.LongType()), T.StructField("n", T.LongType()), T.StructField("sketch", T.BinaryType()), T.StructField("paths", path)])
    arrow = pa.list_(pa.struct([("k", pa.int64()), ("c", pa.list_(pa.int64()))]))

    def run(batches):
        for b in slices(batches):
            sets = sets_of(b.column("text").to_pylist(), words)
            ids = set_ids(sets)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("th"), pa.array(ids[:, 0]), pa.array(ids[:, 1]), pa.array([len(s) for s in sets], pa.int64()), pa.array([sketch(s) for s in sets], pa.binary()), pa.array([paths(s, seeds, threshold) for s in sets], arrow)],
                names=schema.names,
            )

    return d.transform(in_arrow, run, schema)


def least_labels(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Of each of n nodes the least node it is connected with by edges (i, j)."""
    lab = np.arange(n)
    while len(i):
        m = np.minimum(lab[i], lab[j])
        new = lab.copy()
        np.minimum.at(new, i, m)
        np.minimum.at(new, j, m)
        new = new[new]
        if (new == lab).all():
            break
        lab = new
    return lab


def _bucket_edges(least: float, ratio: float):
    """Rows clustered by bucket, (bucket..., sid, n, sketch) -> (a, b): a spanning forest of the sketch-alike rows of
    each bucket, at most one row a member. Whole buckets of a batch are compared at once, by distance in the order."""

    def edges(key, sid, n, sk):
        i_all, j_all = [], []
        size = len(sid)
        for d in range(1, size):
            i = np.flatnonzero(key[d:] == key[:-d])
            if not len(i):
                break
            j = i + d
            small, large = np.minimum(n[i], n[j]), np.maximum(n[i], n[j])
            ok = (small >= ratio * large) & (sid[i] != sid[j])
            i, j = i[ok], j[ok]
            for at in range(0, len(i), 20_000):
                x, y = i[at : at + 20_000], j[at : at + 20_000]
                a, b = sk[x], sk[y]
                filled = ((a | b) != 0).sum(1)
                alike = ((a == b) & (a != 0)).sum(1) >= least * np.maximum(filled, 1)
                i_all.append(x[alike])
                j_all.append(y[alike])
        if not i_all:
            return None
        lab = least_labels(size, np.concatenate(i_all), np.concatenate(j_all))
        k = np.flatnonzero(lab != np.arange(size))
        return pa.RecordBatch.from_arrays([pa.array(sid[k]), pa.array(sid[lab[k]])], names=["a", "b"]) if len(k) else None

    def run(batches):
        held: list[pa.RecordBatch] = []

        def work(rows: pa.Table):
            key = rows.column("bucket").to_numpy()
            sk = np.frombuffer(b"".join(rows.column("sketch").to_pylist()), np.uint8).reshape(-1, BINS)
            return edges(key, rows.column("sid").to_numpy(), rows.column("n").to_numpy(), sk)

        for b in batches:
            if not b.num_rows:
                continue
            key = b.column("bucket").to_numpy()
            last = int(np.flatnonzero(key != key[-1])[-1]) + 1 if (key != key[-1]).any() else 0
            if held and held[0].column("bucket")[0].as_py() == key[0] and last == 0:
                held.append(b)
                continue
            done = pa.Table.from_batches([*held, b.slice(0, last)]) if held or last else None
            held = [b.slice(last)]
            if done is not None and done.num_rows > 1 and (out := work(done)) is not None:
                yield out
        if held and (out := work(pa.Table.from_batches(held))) is not None:
            yield out

    return run


def _candidates(reps: DataFrame, threshold: float) -> DataFrame:
    """Edges between sets that met in a bucket and look alike by sketch."""
    one = reps.select("sid", F.inline("paths"))
    count = lambda d, k: d.groupBy(k).agg(F.count("*").alias("m")).where("m > 1")
    first = one.join(count(one, "k"), "k")
    deep = first.where(F.col("m") > SPLIT).select("sid", F.explode("c").alias("k"))
    second = deep.join(count(deep, "k"), "k")
    leaves = first.where(F.col("m") <= SPLIT).select("sid", "k", "m").unionByName(second.select("sid", "k", "m"))
    blocks = F.when(F.col("m") > 2 * BLOCK, F.ceil(F.col("m") / BLOCK)).otherwise(1).cast("int")
    own = F.pmod(F.xxhash64("sid"), F.col("nb")).cast("int")
    both = F.transform(F.sequence(F.lit(0), F.col("nb") - 1), lambda x: F.xxhash64("k", F.least(x, F.col("own")), F.greatest(x, F.col("own"))))
    bucket = leaves.withColumn("nb", blocks).withColumn("own", own).select("sid", F.explode(F.when(F.col("nb") == 1, F.array("k")).otherwise(both)).alias("bucket"))
    rows = bucket.join(reps.select("sid", "n", "sketch"), "sid").repartition("bucket").sortWithinPartitions("bucket").select("bucket", "sid", "n", "sketch")
    return rows.transform(in_arrow, _bucket_edges(threshold - SLACK, threshold), "a long, b long")


def _verify(threshold: float):
    """Groups of (comp, i, j): one block, or two, of a candidate component's sets -> (sid, to, links).

    Every pair of the two blocks (of the block, if i = j) is compared exactly: intersections are products of 0/1
    matrices over the tokens that two sets or more hold, some thousand tokens at a time."""

    def run(batches):
        for (_, bi, bj), g in groups(batches, ["comp", "bi", "bj"]):
            sid, w, own = (g.column(c).to_numpy() for c in ("sid", "copies", "own"))
            pick = np.unique(sid, return_index=True)[1]  # a repeated row counts once
            if len(pick) < 2:
                continue
            order = pick[np.argsort(own[pick] == bj, kind="stable")] if bi != bj else pick
            raw = g.column("tokens")
            toks = [np.frombuffer(raw[int(k)].as_py(), U) for k in order]
            sid, w = sid[order], w[order]
            n = np.array([len(t) for t in toks])
            m = len(order)
            half = int((own[order] != bj).sum()) if bi != bj else 0
            at = np.repeat(np.arange(m), n)
            _, inv, cnt = np.unique(np.concatenate(toks), return_inverse=True, return_counts=True)
            many = cnt > 1
            new = np.cumsum(many) - 1
            use = many[inv]
            col, row = new[inv[use]], at[use]
            by = np.argsort(col, kind="stable")
            col, row = col[by], row[by]
            width = max(1, min(4096, 40_000_000 // (4 * m)))
            common = np.zeros((m, m), np.float32)
            for c0 in range(0, int(many.sum()), width):
                a, b = np.searchsorted(col, (c0, c0 + width))
                x = np.zeros((m, width), np.float32)
                x[row[a:b], col[a:b] - c0] = 1
                common += x @ x.T
            common = common.astype(np.float64)
            union = n[:, None] + n[None, :] - common
            linked = common >= threshold * union - 1e-9
            linked &= (union > 0) & ~np.eye(m, dtype=bool)
            if bi != bj:
                linked[:half, :half] = False
                linked[half:, half:] = False
            i, j = np.nonzero(np.triu(linked))
            lab = least_labels(m, i, j)
            links = (linked @ w).astype(np.int64)
            k = np.flatnonzero(links)
            if len(k):
                yield pa.RecordBatch.from_arrays([pa.array(sid[k]), pa.array(sid[lab[k]]), pa.array(links[k])], names=["sid", "to", "links"])

    return run


def classes(docs: DataFrame, words: int = WORDS, threshold: float = THRESHOLD, recall: float = RECALL, seed: int = 1) -> DataFrame:
    """(doc_id, th, class_id, n_links, kept) of every row; th is xxhash64 of the text.

    Words are runs of characters other than space and U+0009 to U+000D, as written. Documents of equal shingle sets are
    one set with that many copies. Chosen paths: each set samples tokens at rate 1 / (threshold * size) in each of
    several runs (as many as `recall` needs); sets that share a choice share a bucket; buckets over SPLIT members are
    split again by a second sampled token; small buckets are compared by brute force on sketches. Only a spanning
    forest of each bucket goes on, and its components (all candidates of a link lie within one) are then compared
    exactly, pair by pair, in blocks, so no link inside a component is missed and none below the threshold counted.
    A very common passage enters a set's choices only by its share of the set, so it makes no large bucket.

    n_links: other rows whose similarity is the threshold or more, copies included. class_id: the least doc_id reachable
    by links (null ids count as least of all and give a null class). kept: the row is its class's least; of repeated rows
    (same id and text) all are. Null text is empty; texts without words are copies of one another; texts of fewer words
    have one shingle; very long texts are compared whole; an empty table gives no rows; other columns are ignored. Sets
    are told apart by 128 bits."""
    seeds = textops.fmix((np.arange(runs_for(recall, threshold), dtype=U) + U(1)) * textops.MIX[6] + U(seed))
    d = stored(_described(docs, words, threshold, seeds))
    did = F.coalesce("doc_id", F.lit(NULL_ID))
    reps = d.groupBy("s1", "s2").agg(F.min(F.struct(did.alias("did"), F.col("th"))).alias("r"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.first("paths").alias("paths"))
    reps = stored(reps.select(F.monotonically_increasing_id().alias("sid"), "s1", "s2", "r.did", "r.th", "copies", "n", "sketch", "paths"))
    cand = components(_candidates(reps.where("n > 0"), threshold)).withColumnsRenamed({"id": "sid", "component": "comp"})
    members = stored(cand.join(reps.select("sid", "did", "th", "copies", "n"), "sid"))
    need = members.select("did", "th", "sid", "comp", "copies")
    text = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("did"), F.coalesce("text", F.lit("")).alias("text")).withColumn("th", F.xxhash64("text"))
    got = text.join(need.hint("shuffle_hash"), ["did", "th"]).select("sid", "comp", "copies", "text")

    def tokens(batches):
        for b in slices(batches):
            sets = sets_of(b.column("text").to_pylist(), words)
            yield pa.RecordBatch.from_arrays([b.column("sid"), b.column("comp"), b.column("copies"), pa.array([s.tobytes() for s in sets], pa.binary())], names=["sid", "comp", "copies", "tokens"])

    sets = got.transform(in_arrow, tokens, "sid long, comp long, copies long, tokens binary")
    size = members.groupBy("comp").agg(F.count("*").alias("m"), F.sum("n").alias("t"))
    by_rows = F.when(F.col("m") > 2 * BLOCK, F.ceil(F.col("m") / BLOCK)).otherwise(1)
    by_tokens = F.least(F.when(F.col("t") > 2 * TOKENS, F.ceil(F.col("t") / TOKENS)).otherwise(1), F.col("m"))
    sets = sets.join(size, "comp").withColumn("nb", F.greatest(by_rows, by_tokens).cast("int"))
    sets = sets.withColumn("own", F.pmod(F.xxhash64("sid"), F.col("nb")).cast("int"))
    sets = sets.withColumn("x", F.explode(F.sequence(F.lit(0), F.col("nb") - 1))).select("comp", F.least("x", "own").alias("bi"), F.greatest("x", "own").alias("bj"), "sid", "copies", "own", "tokens")
    keys = ["comp", "bi", "bj"]
    exact = stored(sets.repartition(*keys).sortWithinPartitions(*keys).transform(in_arrow, _verify(threshold), "sid long, to long, links long"))
    joined = components(exact.select(F.col("sid").alias("a"), F.col("to").alias("b"))).withColumnsRenamed({"id": "sid"})
    links = exact.groupBy("sid").agg(F.sum("links").alias("links"))
    sids = reps.select("sid", "s1", "s2", "did", "th", "copies").join(joined, "sid", "left").join(links, "sid", "left")
    sids = stored(sids.select("s1", "s2", "did", "th", F.coalesce("component", "sid").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")))
    least = sids.groupBy("component").agg(F.min(F.struct("did", "th")).alias("least"))
    by = sids.select("s1", "s2", "component", "n_links").join(least, "component").select("s1", "s2", "n_links", "least")
    discard(members)
    out = d.select("doc_id", "th", "s1", "s2").join(by, ["s1", "s2"])
    return out.select("doc_id", "th", F.nullif(F.col("least.did"), F.lit(NULL_ID)).alias("class_id"), "n_links", ((F.coalesce("doc_id", F.lit(NULL_ID)) == F.col("least.did")) & (F.col("th") == F.col("least.th"))).alias("kept"))


def deduplicated(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs that stay: of each class the row of the least id, once; of rows of that id and text that differ
    in other columns the first as JSON. All columns stay, whatever their names; for odd rows see classes()."""
    c = stored(classes(docs, **options).where("kept").groupBy(F.coalesce("doc_id", F.lit(NULL_ID)).alias("__did"), F.col("th").alias("__th")).agg(F.count("*").alias("__rows")))
    key = [F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)), F.xxhash64(F.coalesce("text", F.lit("")))]
    d = docs.withColumn("__did", key[0]).withColumn("__th", key[1]).join(c.hint("shuffle_hash"), ["__did", "__th"])
    once = d.where("__rows = 1").select(docs.columns)
    if c.where("__rows > 1").isEmpty():
        return once
    row = F.struct(*[F.col(x) for x in docs.columns])
    more = d.where("__rows > 1").groupBy("__did", "__th").agg(F.min_by(row, F.to_json(row)).alias("__row"))
    return once.unionByName(more.select(*[F.col("__row")[x].alias(x) for x in docs.columns]))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, class_id, n_links and kept of every document."""
    return classes(table(spark, sf_dir, "documents", "doc_id", "text")).select("doc_id", "class_id", "n_links", "kept")
