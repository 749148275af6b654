import random

import numpy as np

from quarry.llm import jaccard
from quarry.llm.common import components
from pyspark.sql import functions as F


def brute(rows, threshold=0.8, k=5):
    """(class, links) of each row, by comparing all pairs."""
    sets = []
    for _, t in rows:
        w = (t or "").split()
        sets.append(frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset())
    n = len(rows)
    link = [[] for _ in range(n)]
    for i in range(n):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a == b or (a | b and len(a & b) >= threshold * len(a | b) - 1e-9):
                link[i].append(j)
                link[j].append(i)
    key = [-(2**63) if i is None else i for i, _ in rows]
    cls = list(key)
    todo = True
    while todo:
        todo = False
        for i in range(n):
            m = min([cls[i], *(cls[j] for j in link[i])])
            if m < cls[i]:
                cls[i], todo = m, True
    return [(None if c == -(2**63) else c, len(x)) for c, x in zip(cls, link)]


def corpus(seed, n):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(4))
    common = " ".join(word() for _ in range(12))
    out = []
    for _ in range(n):
        r = rnd.random()
        if out and r < 0.5:
            w = rnd.choice(out[-8:]).split()
            for _ in range(rnd.choice([0, 1, 2, 4])):
                if w:
                    w[rnd.randrange(len(w))] = word()
            out.append(" ".join(w))
        else:
            out.append(" ".join([word() for _ in range(rnd.choice([2, 5, 30, 80]))] + ([common] if r > 0.7 else [])))
    return [(i, t) for i, t in enumerate(out)]


def test_classes_equal_brute_force(spark, monkeypatch):
    rows = corpus(3, 250) + [(1000, None), (1001, ""), (1002, "  \n"), (None, "a b"), (1003, "a b"), (5, "dup id other text here one two"), (1000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("sid", F.lit(1)).withColumn("n", F.lit("x"))
    want = sorted(((str(i), *c) for (i, _), c in zip(rows, brute(rows))), key=str)
    for split, block, tokens in ((256, 512, 10**6), (2, 4, 10**6), (256, 512, 60)):
        monkeypatch.setattr(jaccard, "SPLIT", split)
        monkeypatch.setattr(jaccard, "BLOCK", block)
        monkeypatch.setattr(jaccard, "TOKENS", tokens)
        got = jaccard.classes(df, recall=0.9999).collect()
        assert sorted(((str(r.doc_id), r.class_id, r.n_links) for r in got), key=str) == want
    kept = jaccard.deduplicated(df, recall=0.9999).collect()
    assert len(kept) == len({c for c, _ in brute(rows)}) + 1 and len(kept[0]) == 4  # two classes have id 5


def test_documents_and_hot_group(spark):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in d.collect()]
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard.classes(d).collect()}
    assert [got[i] for i, _ in rows] == brute(rows)
    rnd = random.Random(9)
    base = [f"w{i}" for i in range(100)]
    hot = []
    for i in range(1500):
        w = list(base)
        w[rnd.randrange(100)] = f"x{i}"
        hot.append((i, " ".join(w)))
    got = jaccard.classes(spark.createDataFrame(hot, "doc_id long, text string")).collect()
    assert {r.class_id for r in got} == {0} and min(r.n_links for r in got) == 1499


def test_recall_of_links_at_the_threshold(spark):
    """Two thousand pairs of texts of 40 to 300 words, each with a similarity from 0.80 to 0.82 and no other link."""
    rnd = random.Random(12)
    rows, near = [], 0
    for i in range(2000):
        n = rnd.choice([40, 80, 150, 300])
        w = [f"{i}_{rnd.randrange(10**6)}" for _ in range(n)]
        shingles, v, k = n - 4, list(w), 0
        places = rnd.sample(range(0, n, 6), len(range(0, n, 6)))
        count = lambda a, b: (lambda x, y: len(x & y) / len(x | y))(*({tuple(z[j : j + 5]) for j in range(shingles)} for z in (a, b)))
        for p in places:  # change words apart from each other while the pair stays a link
            u = list(v)
            u[p] = f"new{i}_{p}"
            if count(w, u) < 0.8:
                continue
            v = u
        near += count(w, v) < 0.83
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(v))]
    assert near > 1000
    got = jaccard.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    found = sum(r.n_links == 1 and r.class_id == r.doc_id // 2 * 2 for r in got) / len(got)
    print("recall", found, "of", len(rows) // 2, "pairs,", near, "below 0.83")
    assert found >= 0.98


def test_edges(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, an empty table, columns of clashing names."""
    long = " ".join(f"w{i % 9973}x{i // 9973}" for i in range(60_000))
    rows = [(None, None, None), (None, None, "b"), (1, "", "a"), (2, long, "a"), (3, long + " end", None), (3, long + " end", "z"), (4, "a b c", None), (5, "c b a", "a")]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for c in ("sid", "s1", "comp", "th", "n", "copies", "kept", "class_id", "n_links", "own", "paths", "sketch"):
        d = d.withColumn(c, F.lit("clash"))
    got = sorted(((str(r.doc_id), r.class_id, r.n_links) for r in jaccard.classes(d).collect()), key=str)
    assert got == sorted([("None", None, 2), ("None", None, 2), ("1", None, 2), ("2", 2, 2), ("3", 2, 2), ("3", 2, 2), ("4", 4, 0), ("5", 5, 0)], key=str)
    for deal in (d, d.repartition(5), d.orderBy(F.desc("lang"))):
        kept = jaccard.deduplicated(deal).collect()
        assert sorted((str(r.doc_id), str(r.lang), r.sid) for r in kept) == [("2", "a", "clash"), ("4", "None", "clash"), ("5", "a", "clash"), ("None", "b", "clash")]
        assert kept[0].asDict().keys() == set(d.columns)


def test_paths_of_long_texts():
    rnd = np.random.default_rng(3)
    s = np.unique(rnd.integers(0, 2**64, 40_000, dtype=np.uint64))
    seeds = rnd.integers(0, 2**64, 8, dtype=np.uint64)
    together = [p for seed in seeds for p in jaccard.paths(s, seeds=np.array([seed]), threshold=0.8)]
    got = jaccard.paths(s, seeds, 0.8)
    assert len(s) * len(seeds) > 1 << 16 > len(s) and got == together and len(got) > 1


def test_empty(spark):
    d = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard.classes(d).collect() == [] == jaccard.deduplicated(d).collect()


def test_components(spark):
    rnd = random.Random(4)
    e = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(70)] + [(5, 5)]
    lab = jaccard.least_labels(1100, np.array([a for a, _ in e]), np.array([b for _, b in e]))
    got = {r.id: r.component for r in components(spark.createDataFrame(e, "a long, b long")).collect()}
    assert got == {i: int(lab[i]) for a, b in e if a != b for i in (a, b)}
