import zlib
from collections import Counter

import corpus_pipeline
import numpy as np
from pyspark.sql import functions as F
from quarry.llm import bpe, packing
from quarry.llm.common import stored
from test_jaccard import brute
from test_secrets import brute as spans

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    before = [(r.doc_id, r.text) for r in d.collect()]
    d1 = stored(corpus_pipeline.language_id(spark, d, SF))
    kept1 = sorted((r.doc_id, r.text) for r in d1.collect())
    assert kept1 == sorted(before)  # all are in declared languages
    d2 = stored(corpus_pipeline.near_duplicates(spark, d1, SF))
    want = {c for c, _ in brute(kept1)}
    assert sorted(r.doc_id for r in d2.collect()) == sorted(want)
    d3 = stored(corpus_pipeline.secret_spans(spark, d2, SF))
    texts = dict(kept1)
    for r in d3.collect():
        assert ("[SECRET]" in r.text) == bool(spans(texts[r.doc_id])) and r.n_chars == len(r.text)
        assert not spans(texts[r.doc_id]) or not any(k in spans(r.text) for k in ("access:", "hex:"))
    d4 = stored(corpus_pipeline.source_mix(spark, d3, SF))
    n = Counter(r.doc_id for r in d4.collect())
    assert d4.columns == d3.columns == d.columns and max(n.values()) <= 3
    got = corpus_pipeline.pack(spark, d4, SF).collect()
    enc = bpe.encoder(packing.tokenizer_file())
    text = {r.doc_id: r.text for r in d4.collect()}
    total = Counter()
    for r in got:
        ids = np.append(enc.encode([text[r.doc_id]])[0], np.uint32(1))[r.start : r.start + r.length]
        assert zlib.crc32(ids.astype("<u4").tobytes()) == r.ids_crc32
        total[r.doc_id] += r.length
    assert all(total[i] == k * (len(enc.encode([text[i]])[0]) + 1) for i, k in n.items()) and set(total) == set(n)


ODD = [
    (None, None, None, None, None),
    (1, "", "en", "s", 0),
    (2, None, "en", None, None),
    (3, "the and of with that token=abcdef12 for", "en", "s", 39),
    (3, "the and of with that token=abcdef12 for", "en", "s", 39),
    (3, "the and of with that token=abcdef12 for", None, "t", 39),
    (None, "und der die nicht auch ist das", "de", None, 30),
    (5, "the and of with that " * 20_000, "en", "s", 420_000),
    (6, "12 34 +++", "en", "s", 9),
]


def odd_docs(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, columns of clashing names."""
    d = spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string, n_chars long")
    for c in ("keep", "lang_id", "spans", "n_hex", "copies", "sid", "th", "kind", "row", "size", "place", "__members", "__size", "start", "length", "sequence_id", "offset"):
        d = d.withColumn(c, F.lit("clash"))
    return d


def test_stages_on_odd_rows(spark):
    d = odd_docs(spark)
    stage = dict(corpus_pipeline.STAGES)
    show = lambda df: sorted((str(r.doc_id), str(r.text)[:12], str(r.source)) for r in df.collect())
    got = stage["language_id"](spark, d, SF)
    assert got.columns == corpus_pipeline.COLUMNS
    assert show(got) == [("3", "the and of w", "s"), ("3", "the and of w", "s"), ("3", "the and of w", "t"), ("5", "the and of w", "s"), ("None", "und der die ", "None")]
    got = stage["near_duplicates"](spark, d, SF)
    assert got.columns == corpus_pipeline.COLUMNS
    assert show(got) == [("3", "the and of w", "s"), ("5", "the and of w", "s"), ("6", "12 34 +++", "s"), ("None", "None", "None"), ("None", "und der die ", "None")]
    got = stage["secrets"](spark, d, SF)
    rows = got.collect()
    assert got.columns == corpus_pipeline.COLUMNS and len(rows) == len(ODD)
    assert Counter(r.text for r in rows if r.doc_id == 3) == {"the and of with that [SECRET] for": 3} and {r.n_chars for r in rows if r.doc_id == 3} == {33}
    assert sum(r.text is None for r in rows) == 2 and {(len(r.text), r.n_chars) for r in rows if r.doc_id == 5} == {(420_000, 420_000)}
    got = stage["source_mix"](spark, d, SF)
    n, there = (Counter((i, t, x) for i, t, _, x, _ in rows) for rows in (map(tuple, got.collect()), ODD))
    assert got.columns == corpus_pipeline.COLUMNS and set(n) <= set(there) and all(n[k] <= 3 * there[k] for k in n) and n[3, ODD[5][1], "t"] == 3
    got = stage["packing"](spark, d, SF).collect()
    enc = bpe.encoder(packing.tokenizer_file())
    assert sum(r.length for r in got) == sum(len(enc.encode([r[1] or ""])[0]) + 1 for r in ODD)


def test_stages_on_an_empty_table(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet").limit(0).withColumn("keep", F.lit(1))
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, d, SF)
        assert got.collect() == [] and (name == "packing" or got.columns == corpus_pipeline.COLUMNS)


def test_odd_rows_through_all_stages(spark, tmp_path):
    odd_docs(spark).write.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert got and {r.doc_id for r in got} <= {3, 5, None}


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0 and [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_duplicates", "secrets", "source_mix", "packing"]
