import math
import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from quarry.llm import quality, textops

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    got = quality.op6_quality(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("held_out").collect()
    assert len(got) > 50 and sum(r.predicted == r.quality for r in got) >= 0.97 * len(got)


def test_pairs_by_the_identity():
    rnd = np.random.default_rng(1)
    m = {"w0": 0.3, "w": rnd.normal(size=20), "v": rnd.normal(size=(20, 3))}
    index, value, number = np.array([1, 4, 7, 2, 4]), np.array([0.5, 1.0, 2.0, 1.0, -1.0]), np.array([3, 2])
    z, _ = quality.margins(m, index, value, number)
    for row, (a, b) in enumerate(((0, 3), (3, 5))):
        i, x = index[a:b], value[a:b]
        want = m["w0"] + m["w"][i] @ x + sum(m["v"][i[p]] @ m["v"][i[q]] * x[p] * x[q] for p in range(len(i)) for q in range(p))
        assert abs(z[row] - want) < 1e-9


def plain_stats(t):
    """The statistics of a text by their definitions, a character at a time."""
    kinds = []
    for ch in t:
        c = ord(ch)
        if c in (32, 9, 10, 11, 12, 13):
            kinds.append("blank")
        elif "a" <= ch <= "z":
            kinds.append("lower")
        elif "A" <= ch <= "Z" or 0xC0 <= c <= 0xDE and c != 0xD7:
            kinds.append("upper")
        elif "0" <= ch <= "9":
            kinds.append("digit")
        elif c >= 0xC0 and c not in (0xD7, 0xF7) and not 0x2000 <= c < 0x2C00:
            kinds.append("letter")
        else:
            kinds.append("mark")
    n = lambda *k: sum(x in k for x in kinds)
    words = [w for w in re.split("[ \\t-\\r]+", t) if w]
    letters, full, nw = max(1, n("lower", "upper", "letter")), max(1, len(t) - n("blank")), max(1, len(words))
    marks = [i for i, (k, ch) in enumerate(zip(kinds, t)) if k == "mark" and ch not in ".,'-"]
    lines = [x for x in t.split("\n") if x]
    fours = [tuple(words[i : i + 4]) for i in range(len(words) - 3)]
    ended = sum(i + 1 == len(t) or kinds[i + 1] == "blank" for i in marks)
    top = max(Counter(ord(t[i]) % 4096 for i in marks).values(), default=0)
    ascii_letters = sum(k in ("lower", "upper") and ord(ch) < 128 for k, ch in zip(kinds, t))
    return [
        n("upper") / letters, n("digit") / full, len(marks) / full, top / nw, t.count("|") / nw, ended / nw, full / nw, math.log1p(len(words)), math.log1p(len(t)),
        math.log1p(len(t) / max(1, len(lines))), 1 - len(set(words)) / len(words) if words else 0, 1 - len(set(lines)) / max(1, len(lines)), 1 - len(set(fours)) / len(fours) if len(words) >= 8 else 0,
        sum(len(w) > 18 for w in words) / nw, ascii_letters / letters,
    ]


def test_structure_equals_definitions():
    rnd = random.Random(4)
    texts = ["", " \n ", "A", "x | y | z!", "Ünïcode É ß 漢字 テスト “quoted” — dash…", "same line\nsame line\n\nother", "a b c d a b c d a b c d", "supercalifragilisticexpialidocious word", "1 2 3 $$$ %%% ###!"]
    texts += ["".join(rnd.choice("abcXYZé漢09 .,!|#\n\t—") for _ in range(rnd.randint(1, 400))) for _ in range(60)]
    got, buckets = quality.structure(texts)
    for t, row, b in zip(texts, got, buckets):
        assert np.allclose(row, plain_stats(t), atol=1e-9), (t, dict(zip(quality.STATS, zip(row, plain_stats(t)))))
        assert len(b) <= len(set(t.split())) and (b[:-1] < b[1:]).all()


def test_scores_equal_the_plain_sum_of_pairs(spark):
    """The query's score of a text by its model: all pairs of active features, one after the other."""
    d, lab = spark.read.parquet(f"{SF}/documents.parquet").where("n_chars < 300").limit(12), spark.read.parquet(f"{SF}/labels.parquet")
    m = quality.train(spark.read.parquet(f"{SF}/documents.parquet"), lab)
    rows = d.collect()
    got = quality.score(m, [r.text for r in rows])
    for r, s in zip(rows, got):
        stats, words = plain_stats(r.text), np.unique((textops.words([r.text])[0] >> np.uint64(50)).astype(int))
        active = [(int(w), len(words) ** -0.5) for w in words] + [(quality.WORDS + quality.BINS * k + sum(x > e for e in m["edges"][k]), 1.0) for k, x in enumerate(stats)]
        z = m["w0"] + sum(m["w"][i] * x for i, x in active) + sum(m["v"][i] @ m["v"][j] * x * y for n, (i, x) in enumerate(active) for j, y in active[:n])
        assert abs(s - 1 / (1 + math.exp(-z))) < 1e-9


def test_edges(spark):
    """Nulls, empty and very long texts, repeated rows, an empty table, columns of clashing names."""
    rows = [(1, None), (2, ""), (2, ""), (None, "a b"), (3, "x" * 200_000), (4, " \n "), (5, "é漢 😀")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    for c in ("y", "stats", "words", "score", "predicted", "held_out", "quality"):
        d = d.withColumn(c, F.lit("clash"))
    labels = spark.read.parquet(f"{SF}/labels.parquet").unionByName(spark.createDataFrame([(None, 1, None), (1, None, 0), (7, 5, 0)], "doc_id long, quality int, toxic int"))
    both = d.select("doc_id", "text").unionByName(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text"))
    got = quality.classify(both, labels).collect()
    assert len(got) == 1007 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    assert all(r["score"] is not None for r in quality.classify(d, labels).collect())
    none = quality.classify(d, labels.limit(0)).collect()
    assert len(none) == len(rows) and {r.score for r in none} == {0.5}
    assert quality.classify(d.limit(0), labels).collect() == []


def test_same_again(spark):
    a, b = (sorted((r.doc_id, r.score) for r in quality.op6_quality(spark, "/root/testdata/sf0.001").collect()) for _ in range(2))
    assert a == b
