import math
import random

import numpy as np

from pyspark.sql import functions as F
from quarry.llm import toxicity

SF = "/root/testdata/sf0.1"


def distance(a, b):
    """Edits with swaps of neighbours (optimal string alignment)."""
    d = [[i + j if i * j == 0 else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


def test_automaton_equals_edit_distance():
    terms = [("scum", False, True), ("idiot", False, True), ("stupid", False, True), ("worthless", False, True), ("abcd", True, False), ("abba", False, True), ("weak", False, False)]
    auto = toxicity.Automaton(terms)
    rnd = random.Random(2)
    words = set()
    for _ in range(6000):
        w = list(rnd.choice(terms)[0])
        for _ in range(rnd.randint(0, 3)):
            k, i = rnd.randrange(4), rnd.randrange(len(w)) if w else 0
            if k == 0 and w:
                w.pop(i)
            elif k == 1:
                w.insert(i, rnd.choice("abcdeistuwx"))
            elif k == 2 and w:
                w[i] = rnd.choice("abcdeistuwx")
            elif len(w) > i + 1:
                w[i], w[i + 1] = w[i + 1], w[i]
        words.add("".join(w))
    for w in words:
        want = []
        for k, t in enumerate(terms):
            e = min(distance(w[:n], t[0]) for n in range(len(w) + 1)) if t[1] else distance(w, t[0])
            if e <= toxicity.edits(t):
                want.append((e, k))
        assert auto.match(w) == min(want, default=None), w


def test_quotation_scores_lower_and_misspellings_count(spark):
    m = toxicity.Matcher([("idiot", False, True), ("stupid", False, True)], frozenset({"idioms"}))
    plain, quoted, told, spelled, innocent, none = m.features(["you idiot you", 'they wrote "you idiot" there', "he said idiot once", "you idoit st*pid", "idioms", ""]).tolist()
    assert plain[0] > 0 == plain[2] and quoted[2] > 0 == quoted[0] and told[2] > 0 == told[0]
    assert spelled[1] > plain[1] == 0 and spelled[9] == 1 and not any(innocent) and not any(none)


def plain_features(t, terms, innocent):
    """The features of a text by their definitions: every word against every term by edit distance."""
    words, hits = t.split(), []
    for i, raw in enumerate(words):
        w, best = toxicity.bare(raw), None
        if len(w) > 2:
            for k, term in enumerate(terms):
                e = min(distance(w[:n], term[0]) for n in range(len(w) + 1)) if term[1] else distance(w, term[0])
                if e <= toxicity.edits(term) and (best is None or (e, k) < best):
                    best = (e, k)
        if best and (best[0] == 0 or w not in innocent):
            hits.append((i, *best))
    if not hits:
        return [0.0] * 11
    n, weak = [0, 0, 0, 0], []
    for i, e, k in hits:
        if not terms[k][2]:
            weak.append(words[i])
            continue
        before, after = words[max(0, i - toxicity.WINDOW) : i], words[i + 1 : i + 1 + toxicity.WINDOW]
        opened = sum(ch in toxicity.QUOTES for w in before for ch in w) % 2 == 1 or words[i][0] in toxicity.QUOTES
        closed = words[i].rstrip(".,;:!?")[-1] in toxicity.QUOTES if words[i].rstrip(".,;:!?") else False
        closed = closed or any(ch in toxicity.QUOTES for w in after for ch in w)
        told = any(toxicity.bare(w) in toxicity.REPORTING for w in before[-3:])
        n[(2 if opened and closed or told else 0) + (1 if e else 0)] += 1
    most = max(sum(i <= j <= i + toxicity.WINDOW for j, *_ in hits) for i, *_ in hits)
    logs = [math.log1p(x) for x in (*n, len(weak), len(set(weak)), len({k for *_, k in hits}), most)]
    return [*logs, 100 * len(hits) / len(words), float(n[0] + n[1] > 1), float(len(weak) > 1)]


def test_scores_equal_the_plain_computation(spark):
    """The query's scores by its own model: features and logistic score of each text, a word and a term at a time."""
    sf = "/root/testdata/sf0.01"
    d, lab = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    m = toxicity.train(d, lab)
    assert len(m["terms"]) > 3
    some = d.join(lab, "doc_id").where("n_chars < 900")
    texts = [r.text for r in some.where("toxic = 1").limit(12).unionByName(some.where("toxic = 0").limit(8)).collect()]
    strong = next(t for t, _, s in m["terms"] if s and len(t) > 3)
    texts += ["", f'he said "{strong}" twice', f"{strong} {strong[:-1]}x you {strong}!", f"«so {strong[1]}{strong[0]}{strong[2:]}» and on"]
    for t, s in zip(texts, toxicity.score(m, texts)):
        x = np.array([*plain_features(t, m["terms"], m["innocent"]), 1.0])
        assert abs(s - 1 / (1 + math.exp(-min(30, max(-30, x @ m["weights"]))))) < 1e-9, t[:80]


def test_held_out_accuracy(spark):
    d, lab = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    got = toxicity.classify(d.join(lab.select("doc_id"), "doc_id", "left_semi"), lab).join(lab, "doc_id").where("held_out").collect()
    tox, clean = [r for r in got if r.toxic == 1], [r for r in got if r.toxic == 0]
    assert sum(r.predicted for r in tox) >= 0.88 * len(tox) and sum(r.predicted for r in clean) <= 0.01 * len(clean)


def test_same_scores_however_rows_are_dealt(spark):
    sf = "/root/testdata/sf0.01"
    d, lab = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    a = sorted((r.doc_id, r.score) for r in toxicity.classify(d, lab).collect())
    spark.conf.set("spark.sql.shuffle.partitions", 3)
    try:
        b = sorted((r.doc_id, r.score) for r in toxicity.classify(d.repartition(7, "source"), lab.repartition(2)).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert a == b


def test_of_near_copies_the_same_stays(spark):
    rows = [(f"shared words of a passage here {x}", 1.0) for x in ("one", "two", "three")] + [("other text entirely", 0.0)]
    kept = {tuple(sorted(r.text for r in toxicity._distinct(spark.createDataFrame(rows[::k] if k > 0 else rows[::-1], "text string, y double")).collect())) for k in (1, -1)}
    assert len(kept) == 1


def test_long_words_are_matched_whole(spark):
    word = "verylongterm" * 4
    m = toxicity.Matcher([(word, False, True), ("scum", True, True)], frozenset())
    x = m.features([f"a {word} b", f"a {word[:-1]}x{word} b", "scum" + "z" * 5000, "z" * 300 + "scum"])
    assert x[0][0] > 0 and not x[1].any() and x[2][0] > 0 and not x[3].any()
    rows = [(i, f"clean words {i}", 0) for i in range(0, 900, 3)] + [(i, f"you {word} there {i}", 1) for i in range(1, 300)]
    d = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    terms = toxicity.train(d, d.select("doc_id", "toxic"))["terms"]
    assert any(t.startswith("very") for t, *_ in terms)


def test_edges(spark):
    """Nulls, empty and very long texts, repeated rows, an empty table, columns of clashing names."""
    rows = [(1, None), (2, ""), (2, ""), (None, "a b"), (3, "x " * 100_000), (5, "é漢 😀")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    for c in ("y", "least", "p", "pos", "neg", "score", "predicted", "held_out", "toxic", "label", "x"):
        d = d.withColumn(c, F.lit("clash"))
    lab = spark.createDataFrame([(1, 0), (3, 1), (5, None), (None, 1), (2, 7)], "doc_id long, toxic int")
    got = toxicity.classify(d, lab).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    assert {r.score for r in toxicity.classify(d, lab.limit(0)).collect()} == {0.5}
    assert toxicity.classify(d.limit(0), lab).collect() == []


def test_misspellings_of_words_below_a_strong_stem():
    counts = {"idio": (100, 1), "idiot": (100, 0), "idiot$": (60, 0), "idiots": (40, 0), "idiots$": (40, 0), "scum": (50, 0), "scum$": (50, 0)}
    terms = toxicity.choose(counts, 200, 2000)
    assert {("idiot", True, True), ("idiot", False, True), ("idiots", False, True), ("scum", False, True)} <= set(terms)
    found = {w: toxicity.Automaton(terms).match(w) for w in ("idiot", "idiotic", "idoit", "1diot", "idoits", "scmu", "sc*m", "idea", "such")}
    assert {w: m and m[0] for w, m in found.items()} == {"idiot": 0, "idiotic": 0, "idoit": 1, "1diot": 1, "idoits": 1, "scmu": 1, "sc*m": 1, "idea": None, "such": None}
