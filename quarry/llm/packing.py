"""Harmonic packing of tokenised documents into fixed-length sequences."""

from __future__ import annotations

import heapq
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe
from .common import groups, in_arrow, slices, stored, table

CAPACITY = 2048
LEAST_GAP = 32  # a smaller rest of a bin stays padding
WAITING = 4  # bins' worth of rests that wait for a document before one is cut to fill them
TAILS = 64  # tasks whose last, incomplete bins are packed together
END_ID = 1
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, bin_class int"
STORED = f"{PIECES}, ids binary"  # ids of pieces that are to be packed once more


def tokenizer_file(path: str | None = None) -> bytes:
    """The vocabulary file's bytes (about 2 MB), read on the driver and broadcast; path defaults to the public file."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    with open(path, "rb") as f:
        return f.read()


class Bins:
    """One worker's bins. A unit is (doc, start, ids, tokens of the whole document).

    A unit of n tokens has class k = capacity div n; a bin of class k is filled with exactly k units of its class, which
    always fit. The rest of a filled bin, if it is not below least_gap, waits. When half of `waiting` bins' worth of rests
    wait, a unit that fits whole goes into the largest; when all of it waits, the next unit is cut to fill them. Documents over the capacity give full bins
    first, and what is left of them is a unit. All decisions are the worker's own; what it holds is bounded by waiting
    bins and one open bin a class."""

    def __init__(self, part: int, capacity: int = CAPACITY, least_gap: int = LEAST_GAP, waiting: int = WAITING):
        self.first, self.made, self.capacity, self.least = part << 33, 0, capacity, least_gap
        self.open: dict[int, list] = {}
        self.rests: list[tuple[int, int, list]] = []  # heap of (-rest, number, [(unit, class)])
        self.room, self.most = 0, waiting * capacity
        self.out: list[tuple] = []

    def _emit(self, units: list, sequence: int | None = None) -> None:
        if sequence is None:
            sequence = self.first + self.made
            self.made += 1
        at = 0
        for (doc, start, ids, tokens), k in units:
            self.out.append((doc, start, len(ids), zlib.crc32(ids), tokens, sequence, at, k, ids.tobytes() if sequence < 0 else None))
            at += len(ids)

    def _rest(self, gap: int, units: list) -> None:
        if gap < self.least:
            self._emit(units)
            return
        self.made += 1  # numbers tell equal rests apart; the bin's own number is taken when it is emitted
        heapq.heappush(self.rests, (-gap, self.made, units))
        self.room += gap

    def add(self, doc, ids: np.ndarray) -> None:
        start, tokens = 0, len(ids)
        while tokens - start >= self.capacity:
            self._emit([((doc, start, ids[start : start + self.capacity], tokens), 1)])
            start += self.capacity
        if start < tokens:
            self._place((doc, start, ids[start:], tokens))

    def _place(self, unit) -> None:
        doc, start, ids, tokens = unit
        while self.rests and len(ids) and self.room >= (self.most / 2 if -self.rests[0][0] >= len(ids) else self.most):
            gap, _, units = heapq.heappop(self.rests)
            self.room += gap
            m = min(-gap, len(ids))
            units.append(((doc, start, ids[:m], tokens), 0))
            self._rest(-gap - m, units)
            start, ids = start + m, ids[m:]
        if len(ids):
            k = self.capacity // len(ids)
            units = self.open.setdefault(k, [])
            units.append(((doc, start, ids.copy(), tokens), k))
            if len(units) == k:
                del self.open[k]
                self._rest(self.capacity - sum(len(u[0][2]) for u in units), units)

    def close(self) -> None:
        """Units of incomplete bins, and of bins whose rests still wait, are joined; the last bin, if not full, is emitted
        with the task's number as -1 - number, to be joined with those of others."""
        left = [u for *_, units in sorted(self.rests, key=lambda r: r[1]) for u, _ in units] + [u for k in sorted(self.open) for u, _ in self.open[k]]
        self.rests, self.open, self.room = [], {}, 0
        self.join(left, -1 - (self.first >> 33))

    def join(self, units: list, last: int) -> None:
        """Units one after the other, cut at the capacity; a last, incomplete bin has the sequence id `last`."""
        now, used = [], 0
        for doc, start, ids, tokens in units:
            while len(ids):
                m = min(self.capacity - used, len(ids))
                now.append(((doc, start, ids[:m], tokens), 0))
                start, ids, used = start + m, ids[m:], used + m
                if used == self.capacity:
                    self._emit(now)
                    now, used = [], 0
        if now:
            self._emit(now, last)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    fields = [x.split() for x in STORED.split(", ")]
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    columns = zip(*rows) if rows else [[]] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(list(c), kinds[k]) for c, (_, k) in zip(columns, fields)], names=[n for n, _ in fields])


def pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, least_gap: int = LEAST_GAP, waiting: int = WAITING) -> DataFrame:
    """Every piece in its place; those of each task's last, incomplete bin have sequence_id -1 - the task's number."""
    file = docs.sparkSession.sparkContext.broadcast(tokenizer_file(path))
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))

    def run(batches):
        enc = bpe.encoder(file.value)
        bins = Bins(TaskContext.get().partitionId(), capacity, least_gap, waiting)
        for b in slices(batches, most=4_000_000):
            for doc, ids in zip(b.column("doc_id").to_pylist(), enc.encode(b.column("text"))):
                bins.add(doc, np.append(ids, np.uint32(end_id)).astype("<u4"))
            yield _batch(bins.out)
            bins.out = []
        bins.close()
        yield _batch(bins.out)

    return d.transform(in_arrow, run, STORED)


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, least_gap: int = LEAST_GAP, waiting: int = WAITING) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, bin_class) of every piece.

    Harmonic packing, each worker on its own (see Bins): no shuffle of texts or ids, no count over all rows. bin_class is
    k for a piece that is one of the k of its class's bin, 0 for one that fills a rest. Only the last, incomplete bin of
    each task, under one capacity with its ids, is packed once more, with those of TAILS - 1 other tasks.
    Sequence ids are distinct, not dense. Null and empty texts have one piece, the end id; very long texts are cut into
    full sequences and a rest; repeated rows are packed again; equal lengths go in the order of the rows; an empty table
    gives no rows; columns beside doc_id and text are ignored."""
    names = [x.split()[0] for x in PIECES.split(", ")]
    p = stored(pieces(docs, path, capacity, end_id, least_gap, waiting))

    def fit(batches):
        for (group,), g in groups(batches, ["group"]):
            rows = sorted(zip(*(g.column(c).to_pylist() for c in ("sequence_id", "offset", "doc_id", "start", "doc_tokens", "ids"))), key=lambda r: (-r[0], r[1]))
            bins = Bins((1 << 28) + group, capacity, least_gap, waiting)
            bins.join([(doc, start, np.frombuffer(ids, "<u4"), tokens) for _, _, doc, start, tokens, ids in rows], bins.first + (1 << 32))
            yield _batch(bins.out)

    tails = p.where("sequence_id < 0").withColumn("group", F.floor((-1 - F.col("sequence_id")) / TAILS).cast("long"))
    tails = tails.repartition("group").sortWithinPartitions("group").transform(in_arrow, fit, STORED)
    return p.where("sequence_id >= 0").unionByName(tails).select(names)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents", "doc_id", "text"))
