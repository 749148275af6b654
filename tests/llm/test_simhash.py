import hashlib
import random

import numpy as np

from pyspark.sql import functions as F

from quarry.llm import simhash, textops

ROWS = [(5, "a b c d e f g h i"), (4, None), (4, ""), (9, "one two three four five six seven eight nine ten é 漢字"), (1, "x"), (None, "tail text here"), (7, "a b c d e f g h i"), (3, " \n\t "), (2, "word " * 3000)]


def brute(rows):
    rows = sorted(((i, t or "", h) for i, t, h in rows), key=lambda r: (r[0] is None, -(r[0] or 0), r[2], r[1]))
    out = []
    for k, (i, t, _) in enumerate(rows):
        u, n = rows[(k + 1) % len(rows)][1], len(t) // 3
        e = t[: len(t) - n] + u[:n]
        a, b, c = (simhash.fingerprints([x])[0:1] for x in (t, e, u))
        out.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), a.tobytes().hex(), b.tobytes().hex(), round(float(simhash.likeness(a, b)[0]), 9), round(float(simhash.likeness(a, c)[0]), 9)))
    return sorted(out, key=str)


def hashed(df):
    return [(r.doc_id, r.text, r.h) for r in df.select("doc_id", "text", F.hash(F.coalesce("text", F.lit(""))).alias("h")).collect()]


def found(df):
    return sorted(((*r[:5], round(r[5], 9), round(r[6], 9)) for r in df.collect()), key=str)


def test_edited_matches_brute_force(spark):
    """Nulls, empty and long texts, ties, repeated rows, an empty table, columns of clashing names."""
    df = spark.createDataFrame(ROWS + ROWS[:2], "doc_id long, text string")
    for c in ("p", "mark", "h", "i", "own", "label", "fingerprint", "n_chars", "near_fingerprints"):
        df = df.withColumn(c, F.lit("clash"))
    for parts in (1, 3, 32):
        assert found(simhash.edited_fingerprints(df, parts=parts)) == brute(hashed(df))
    assert simhash.edited_fingerprints(df.limit(0)).collect() == [] == simhash.searched(simhash.edited_fingerprints(df.limit(0))).collect()


def test_an_id_with_most_rows_is_split(spark):
    rows = [(7 if i % 3 else i, f"text number {i} of {i % 11}") for i in range(400)] + [(None, f"null {i}") for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    runs = {r.p: r["count"] for r in simhash.in_runs(df, 16).where("mark = 0").groupBy("p").count().collect()}
    assert sum(runs.values()) == 600 and max(runs.values()) < 120
    huge = spark.createDataFrame([(2**62 + i // 2, f"t {i}") for i in range(300)], "doc_id long, text string")
    assert found(simhash.edited_fingerprints(huge, parts=50)) == brute(hashed(huge))
    assert found(simhash.edited_fingerprints(df, parts=16)) == brute(hashed(df))


def test_every_run_has_its_task(spark):
    x = simhash._spread(spark, 37)
    got = spark.createDataFrame(list(enumerate(x)), "p int, x int").select("p", F.pmod(F.hash("x"), F.lit(37)).alias("q")).collect()
    assert len(set(x)) == 37 and all(r.p == r.q for r in got)


def test_near_counts_equal_brute_force(spark):
    rnd = random.Random(11)
    base = [rnd.getrandbits(64) for _ in range(30)]
    all_ = list({b ^ sum(1 << i for i in rnd.sample(range(64), rnd.randint(0, 6))) for b in base for _ in range(9)})
    df = spark.createDataFrame([(f"{x:016x}",) for x in all_ + all_[:20]] + [(None,)], "fingerprint string")
    for radius, blocks, bucket in ((3, None, 1024), (3, 6, 1024), (3, None, 2), (0, None, 1024)):
        got = {r.fingerprint: r.n_near for r in simhash.near_counts(df, radius, 64, blocks, bucket).collect()}
        want = {f"{a:016x}": n for a in all_ if (n := sum(a != b and (a ^ b).bit_count() <= radius for b in all_))}
        assert got == want


def test_query_finds_near_copies_through_the_tables(spark, tmp_path):
    rnd = random.Random(2)
    long = [rnd.choice("abcdefghijklmnop") + str(rnd.randrange(5000)) for _ in range(4000)]
    other = [*long[:2000], "changed", *long[2001:]]
    rows = [(1, " ".join(long)), (2, " ".join(other)), (3, " ".join(long)), (4, "short"), (5, None), (6, " ".join(reversed(long)))]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.near_fingerprints for r in simhash.op10_document_fingerprints(spark, str(tmp_path)).collect()}
    prints = simhash.fingerprints([t or "" for _, t in rows])
    want = {i: len({b.tobytes() for b in prints if 0 < np.unpackbits(a ^ b).sum() <= simhash.RADIUS}) for (i, _), a in zip(rows, prints)}
    assert got == want and got[1] == got[2] == got[3] == 1


def slow_fingerprint(text, k=simhash.TERM_WORDS, bits=64):
    h, n = textops.words([text])
    terms, _ = textops.shingles(h, n, k)
    v = [sum(1 if (int(t) >> i) & 1 else -1 for t in terms) for i in range(64)]
    return [x > 0 for x in v]


def test_votes():
    rnd = random.Random(3)
    for n in (1, 2, 3, 50, 700):
        t = " ".join(rnd.choice("abcdefghij") for _ in range(n))
        got = np.unpackbits(simhash.fingerprints([t], 64)[0])
        h, m = textops.words([t])
        terms, _ = textops.shingles(h, m, 3)
        votes = np.zeros(64, int)
        for x in terms:
            by = np.array([x]).view(np.uint8)
            votes += np.concatenate([[(int(c) >> i) & 1 for i in range(8)] for c in by])
        assert (got == (2 * votes > len(terms))).all()


def test_words_are_alike_anywhere():
    a, n = textops.words(["the cat  sat", "", "sat the", "\x0bsat\x0c"])
    assert n.tolist() == [3, 0, 2, 1]
    assert a[2] == a[3] == a[5] and a[0] == a[4]


def test_near_finds_all_within_radius(spark):
    rnd = random.Random(7)
    base = [rnd.getrandbits(64) for _ in range(40)]
    all_ = list({b ^ sum(1 << i for i in rnd.sample(range(64), rnd.randint(0, 5))) for b in base for _ in range(6)})
    df = spark.createDataFrame([(i, f"{x:016x}") for i, x in enumerate(all_)] + [(-1, None)], "doc_id long, fingerprint string")
    for radius, blocks in ((3, None), (3, 6), (0, None)):
        got = {(r[0], r[1], r[2]) for r in simhash.near(df, df, radius=radius, bits=64, blocks=blocks).collect()}
        want = {(f"{a:016x}", f"{b:016x}", (a ^ b).bit_count()) for a in all_ for b in all_ if (a ^ b).bit_count() <= radius}
        assert got == want


def test_fingerprint_keeps_columns(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "a b", "y")], "doc_id long, text string, fingerprint string")
    r = simhash.fingerprint(df).orderBy("doc_id").collect()
    assert set(r[0].asDict()) == {"doc_id", "text", "fingerprint"} and r[0].fingerprint == "0" * 64 != r[1].fingerprint
