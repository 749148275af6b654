"""Token counts by trie-shared dynamic programming over distinct pre-tokens."""

from __future__ import annotations

import math
from collections import Counter as Words

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import in_arrow, slices, table

SPACE = "▁"  # stands before every pre-token
SCALE = 10_000  # scores are integers, so sums compare exactly
UNKNOWN = 10 * SCALE  # a character that is no piece costs this much more than the rarest piece
WIDE = 48  # pre-tokens below this are scored many at a time, longer ones one after the other; either way along a trie
_B = 0x9E3779B97F4A7C15 | 1
U = np.uint64
_MADE: dict = {}


def _model(path: str | None) -> bytes:
    """The sentencepiece file's bytes (about 0.5 MB), read on the driver and broadcast; path defaults to the public file."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    with open(path, "rb") as f:
        return f.read()


def _library(model: bytes):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_proto=model)


def _ordinary(sp) -> list[str]:
    return [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]


def unigram(docs: DataFrame, path: str | None = None) -> list[tuple[str, int]]:
    """(piece, score) of the ordinary pieces of a sentencepiece file: log of its share of all pieces in the whole corpus
    as the file's own merges cut it, counts raised by one, times SCALE. The pieces are the file's; only their shares are
    counted. Each task encodes its distinct pre-tokens once and gives a row a piece, so at most tasks times pieces rows
    are shuffled, and one row a piece comes to the driver."""
    model = _model(path)
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        sp = _library(shipped.value)
        words: Words = Words()
        pieces: Words = Words()

        def count():
            for w, ps in zip(words, sp.encode(list(words), out_type=str, num_threads=1)):
                for p in ps:
                    pieces[p] += words[w]
            words.clear()

        for b in slices(batches, most=4_000_000):
            _, which, found = pretokens(b.column("text"))
            for w, n in zip(found, np.bincount(which, minlength=len(found)).tolist()):
                if w:
                    words[w] += n
            if len(words) > 500_000:
                count()
        count()
        yield pa.RecordBatch.from_arrays([pa.array(list(pieces), pa.string()), pa.array(list(pieces.values()), pa.int64())], names=["piece", "n"])

    text = docs.where("text is not null").select("text")
    found = text.transform(in_arrow, run, "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n")).collect()
    n = {r.piece: r.n for r in found}
    kept = _ordinary(_library(model))
    total = sum(n.get(p, 0) + 1 for p in kept)
    return [(p, round(SCALE * math.log((n.get(p, 0) + 1) / total))) for p in kept]


class Counter:
    """Tokens of a pre-token: those of its best segmentation, by the sum of scores, then by the fewest tokens.

    Characters that are no piece count one token a UTF-8 byte."""

    def __init__(self, pieces: list[tuple[str, int]], most: int = 1_000_000):
        self.score = dict(pieces)
        self.longest = max(map(len, self.score), default=1)
        self.unknown = min(self.score.values(), default=0) - UNKNOWN
        self.by_length = {}
        for n in range(1, self.longest + 1):
            ps = [p for p in self.score if len(p) == n]
            if ps:
                h = np.array([self._hash(p) for p in ps], U)
                o = np.argsort(h)
                some = np.zeros(1 << 18, bool)  # whether any piece's hash begins with these bits
                some[h >> U(46)] = True
                self.by_length[n] = h[o], np.array([self.score[p] for p in ps], np.int64)[o], some
        self.most, self.known = most, {}
        self.pow = [pow(_B, i, 1 << 64) for i in range(WIDE + 2)]
        self.inv = [pow(pow(_B, -1, 1 << 64), i, 1 << 64) for i in range(WIDE + 2)]

    @staticmethod
    def _hash(s: str) -> int:
        return sum((ord(c) + 1) * pow(_B, i, 1 << 64) for i, c in enumerate(s)) % (1 << 64)

    def _one_by_one(self, words: list[str]) -> list[int]:
        """Counts of sorted words of any length: scores of what a word shares with the one before, its trie node's way
        from the root, stay; only the nodes beyond are scored."""
        lengths, out, last, best, count = [*self.by_length], [], "", [0], [0]
        for w in words:
            s = SPACE + w
            shared = next((i for i, (x, y) in enumerate(zip(s, last)) if x != y), min(len(s), len(last)))
            del best[shared + 1 :], count[shared + 1 :]
            for e in range(shared + 1, len(s) + 1):
                b, c = best[e - 1] + self.unknown, count[e - 1] + len(s[e - 1].encode("utf-8", "surrogatepass"))
                for n in lengths:
                    if n > e:
                        break
                    x = self.score.get(s[e - n : e])
                    if x is not None:
                        x += best[e - n]
                        if x > b or x == b and count[e - n] + 1 < c:
                            b, c = x, count[e - n] + 1
                best.append(b)
                count.append(c)
            out.append(count[-1])
            last = s
        return out

    def _sorted(self, words: list[str]) -> np.ndarray:
        """Counts of distinct sorted words of at most WIDE - 1 characters. Neighbours share their common prefix: a trie
        node is a row's first depth beyond what the row above shares; nodes of one depth are scored together, each once,
        and their scores go to all rows below that share the node. A word's count is stored when its end is met."""
        n = len(words)
        size = np.fromiter(map(len, words), np.int64, n) + 1
        wide = int(size.max())
        a = np.array([SPACE + w for w in words], f"U{wide}").view(np.uint32).reshape(n, wide)
        shared = np.zeros(n, np.int64)
        if n > 1:
            same = a[1:] == a[:-1]
            shared[1:] = np.minimum(np.where(same.all(1), wide, same.argmin(1)), np.minimum(size[1:], size[:-1]))
        h = np.zeros((wide + 1, n), U)
        for d in range(wide):
            h[d + 1] = h[d] + (a[:, d] + np.uint32(1)).astype(U) * U(self.pow[d])
        best, count, out = [np.zeros(n, np.int64)], [np.zeros(n, np.int32)], np.zeros(n, np.int32)
        row = np.arange(n)
        for d in range(1, wide + 1):
            alive = size >= d
            new = alive & (shared < d)
            at = np.flatnonzero(new)
            c = a[at, d - 1]
            b = best[d - 1][at] + self.unknown
            k = count[d - 1][at] + 1 + (c > 0x7F) + (c > 0x7FF) + (c > 0xFFFF)
            for m, (keys, scores, some) in self.by_length.items():
                if m > d:
                    break
                x = (h[d][at] - h[d - m][at]) * U(self.inv[d - m])
                hit = np.flatnonzero(some[x >> U(46)])
                i = np.minimum(np.searchsorted(keys, x[hit]), len(keys) - 1)
                real = keys[i] == x[hit]
                hit, i = hit[real], i[real]
                if not len(hit):
                    continue
                r = at[hit]
                s, t = best[d - m][r] + scores[i], count[d - m][r] + 1
                better = (s > b[hit]) | ((s == b[hit]) & (t < k[hit]))
                b[hit[better]], k[hit[better]] = s[better], t[better]
            bd, kd = np.zeros(n, np.int64), np.zeros(n, np.int32)
            bd[at], kd[at] = b, k
            owner = np.maximum.accumulate(np.where(new, row, 0))
            best.append(np.where(alive, bd[owner], 0))
            count.append(np.where(alive, kd[owner], 0))
            if d > self.longest:
                best[d - self.longest - 1] = count[d - self.longest - 1] = None
            end = size == d
            out[end] = count[d][end]
        return out

    def learn(self, words) -> None:
        new = [w for w in words if w not in self.known]
        if len(self.known) + len(new) > self.most:
            self.known.clear()
            new = list(words)
        short = sorted(w for w in new if len(w) < WIDE)
        for i in range(0, len(short), 20_000):
            part = short[i : i + 20_000]
            self.known.update(zip(part, self._sorted(part).tolist()))
        long = sorted(w for w in new if len(w) >= WIDE)
        self.known.update(zip(long, self._one_by_one(long)))

    def texts(self, texts: list[str] | pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(pre-tokens, tokens) of each text. Texts are split, and their distinct pre-tokens told apart, by Arrow."""
        column = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        ends, which, words = pretokens(column)
        self.learn([w for w in words if w])
        real = np.array([w != "" for w in words], bool)
        known = np.array([self.known[w] if w else 0 for w in words], np.int64)
        sums = (np.concatenate(([0], np.cumsum(x[which]))) for x in (real.astype(np.int64), known))
        return tuple(c[ends[1:]] - c[ends[:-1]] for c in sums)


def pretokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """(where each text's pre-tokens begin and the last one's end; the place of each among the distinct ones; these):
    runs without Unicode white space; an empty one, which is none, may stand before, after and for a blank text."""
    split = pc.utf8_split_whitespace(column)
    known = split.flatten().dictionary_encode()
    ends = split.offsets.to_numpy().astype(np.int64)
    return ends - ends[0], known.indices.to_numpy(), known.dictionary.to_pylist()


def token_counts(docs: DataFrame, path: str | None = None, pieces: list[tuple[str, int]] | None = None) -> DataFrame:
    """(doc_id, n_pretokens, n_tokens) of each whole text; pre-tokens are runs without Unicode white space. pieces: with
    scores, as unigram() counts them over docs where none are given. Counting needs no shuffle.

    Null and empty texts count 0; very long texts and pre-tokens of any length are scored whole; of segmentations of one
    score the one of fewest tokens counts; repeated rows and null ids are kept as they are; an empty table gives no rows;
    columns beside doc_id and text are ignored."""
    made = docs.sparkSession.sparkContext.broadcast(pieces if pieces is not None else unigram(docs, path))
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))

    def run(batches):
        counter = _MADE.get("counter")
        if counter is None or counter.score != dict(made.value):
            counter = _MADE["counter"] = Counter(made.value)
        for b in slices(batches, most=4_000_000):
            n, total = counter.texts(b.column("text"))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(total, pa.int64())], names=["doc_id", "n_pretokens", "n_tokens"])

    return d.transform(in_arrow, run, "doc_id long, n_pretokens long, n_tokens long")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents", "doc_id", "text"))
