import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import bpe, packing

TEXTS = ["Hello world, it's a  test.\n\n New line\tand more ", " leading", "", "trail ", "a b c　d été \U0001f600 'll don't 12345 $$$ ###", "x<|endoftext|>y z", "foo \x1cbar \x85baz", "\n\n", "   ", "the cat sat " * 900, "ciónjaadomente del 漢字 テスト " * 300, "a b\n c", "é" * 5000]


def test_ids_are_those_of_tokenizers():
    import public_tokenizers
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    enc = bpe.encoder(packing.tokenizer_file())
    for most in (200_000, 5):
        enc.most = most
        enc.clear()
        for t, ids in zip(TEXTS, enc.encode(TEXTS)):
            assert ids.tolist() == tk.encode(t, add_special_tokens=False).ids
    enc.most = 200_000


def test_ids_on_documents():
    import pyarrow.parquet as pq
    import public_tokenizers
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t = pq.read_table("/root/testdata/sf0.001/documents.parquet").column("text").to_pylist()
    for ids, want in zip(bpe.encoder(packing.tokenizer_file()).encode(t), tk.encode_batch(t, add_special_tokens=False)):
        assert ids.tolist() == want.ids


def checked(got, ids, capacity=2048):
    """Pieces of each document in order; asserts that each id is in one piece and every sequence is gapless."""
    seen, seqs = defaultdict(list), defaultdict(list)
    for r in got:
        a = ids[r.doc_id][r.start : r.start + r.length]
        assert len(a) == r.length <= capacity and r.doc_tokens == len(ids[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(a.astype("<u4").tobytes())
        seen[r.doc_id].append((r.start, r.length))
        seqs[r.sequence_id].append((r.offset, r.length, r.bin_class))
    padding = 0
    for s in seqs.values():
        at = 0
        for o, n, _ in sorted(s):
            assert o == at
            at += n
        assert at <= capacity
        padding += 0 if not at & (at - 1) else capacity - at
    return seen, seqs, padding


@pytest.mark.parametrize("copies", [1, 7])
def test_round_trip(spark, copies):
    rows = [(i if i != 3 else None, t) for i, t in enumerate(TEXTS)] * copies + [(99, None)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    enc = bpe.encoder(packing.tokenizer_file())
    ids = {i: np.append(enc.encode([t or ""])[0], np.uint32(1)) for i, t in rows}
    seen, _, padding = checked(got, ids)
    for i, p in seen.items():
        n = sum(1 for j, _ in rows if j == i)
        assert sorted(k for s, m in p for k in range(s, s + m)) == sorted([*range(len(ids[i]))] * n)
    assert padding <= max(2048, 0.02 * sum(r.length for r in got))


def test_documents_fill_class_bins_whole(spark):
    """Bins of class k hold k pieces of lengths in (capacity / (k + 1), capacity / k]; few documents are cut; little padding."""
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    enc = bpe.encoder(packing.tokenizer_file())
    rows = d.collect()
    ids = {r.doc_id: np.append(x, np.uint32(1)) for r, x in zip(rows, enc.encode([r.text for r in rows]))}
    got = packing.pack(d.coalesce(1)).collect()
    seen, seqs, padding = checked(got, ids)
    assert {i: sorted(k for s, m in p for k in range(s, s + m)) for i, p in seen.items()} == {i: [*range(len(x))] for i, x in ids.items()}
    assert padding <= 0.01 * sum(r.length for r in got)
    whole = 0
    for s in seqs.values():
        kinds = {k for *_, k in s if k}
        assert len(kinds) <= 1
        for k in kinds:
            lengths = [n for _, n, j in s if j]
            assert len(lengths) == k and all(2048 // n == k for n in lengths)
            whole += k
    assert whole > 0.3 * len(rows)
    cut = sum(1 for i, p in seen.items() if len(ids[i]) <= 2048 and len(p) > 1)
    assert cut < 0.25 * len(rows) and len(got) < 1.5 * len(rows)


def test_many_small_tasks_share_their_tails(spark):
    rows = [(i, "word " * (3 + i % 50)) for i in range(600)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string").repartition(60)).collect()
    enc = bpe.encoder(packing.tokenizer_file())
    ids = {i: np.append(enc.encode([t])[0], np.uint32(1)) for i, t in rows}
    _, seqs, padding = checked(got, ids)
    assert padding <= 2048 + 0.06 * sum(r.length for r in got)


def test_bins_in_small_capacity():
    """Against brute force: every unit placed once, whatever the order and lengths."""
    rnd = np.random.default_rng(4)
    for _ in range(200):
        bins, want = packing.Bins(3, 16, int(rnd.integers(1, 5)), int(rnd.integers(0, 4))), []
        for doc in range(int(rnd.integers(0, 60))):
            ids = np.full(int(rnd.integers(1, 40)), doc, "<u4")
            want += [(doc, k) for k in range(len(ids))]
            bins.add(doc, ids)
        bins.close()
        assert sorted((r[0], k) for r in bins.out for k in range(r[1], r[1] + r[2])) == want
        seqs = defaultdict(list)
        for r in bins.out:
            seqs[r[5]].append((r[6], r[2]))
        for s, p in seqs.items():
            assert sum(n for _, n in p) <= 16 and [o for o, _ in sorted(p)] == np.cumsum([0, *[n for _, n in sorted(p)]])[:-1].tolist()
        assert sum(s < 0 for s in seqs) <= 1


def test_edges(spark):
    """Nulls, empty and very long texts, ties, repeated rows, an empty table, columns of clashing names."""
    rows = [(None, None), (1, ""), (1, ""), (2, "a b " * 40_000), (None, "x"), (None, "x")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    for c in ("start", "length", "sequence_id", "offset", "group", "bin_class", "ids_crc32"):
        d = d.withColumn(c, F.lit("clash"))
    got = packing.pack(d).collect()
    total = sum(r.length for r in got)
    enc = bpe.encoder(packing.tokenizer_file())
    assert total == sum(len(enc.encode([t or ""])[0]) + 1 for _, t in rows) and sum(r.doc_id == 1 for r in got) == 2
    assert packing.pack(d.limit(0)).collect() == []
