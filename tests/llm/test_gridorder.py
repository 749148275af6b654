import numpy as np
import pytest
from oracle import assert_same
from pyspark.sql import functions as F

from quarry.llm import gridorder


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_sql(spark, sf):
    assert assert_same(spark, gridorder.op1_embedding_neardup, gridorder.OP1_SQL, f"/root/testdata/{sf}") > 0


def brute(rows, cosine):
    n = len(rows)
    link = [set() for _ in range(n)]

    def ok(v):
        return v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)

    for i in range(n):
        for j in range(i):
            (_, a, x), (_, b, y) = rows[i], rows[j]
            if a is not None and a == b and ok(x) and ok(y) and len(x) == len(y):
                x, y = np.array(x), np.array(y)
                if x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= cosine:
                    link[i].add(j)
                    link[j].add(i)
    out = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            for j in link[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        out.append((rows[i][0], len(link[i]), min(rows[j][0] for j in seen)))
    return out


def test_brute_force_with_small_blocks(spark):
    rnd = np.random.default_rng(3)
    base = rnd.normal(size=(40, 6))
    rows = []
    for i in range(300):
        v = base[rnd.integers(40)] * rnd.uniform(0.1, 9) + rnd.normal(size=6) * rnd.choice([0, 0.05, 0.3])
        rows.append((i, int(rnd.integers(3)), v.tolist()))
    rows += [(1000, None, [1.0] * 6), (1001, 1, None), (1002, 1, [0.0] * 6), (1003, 1, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (1004, 1, [float("nan")] * 6), (1005, 1, []), (1006, 1, [1.0, 2.0]), (1007, 1, [1.0, 2.0]), (1008, 1, [float("inf")] * 6), (7, 0, rows[7][2])]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    for c in ("grp", "h", "sid", "fit", "copies", "kept", "n_links", "component_id"):
        df = df.withColumn(c, F.lit(1))
    for block in (4, 1024):
        got = gridorder.near_duplicates(df, block=block).collect()
        assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == sorted(brute(rows, 0.93))
        assert all(r.kept == (r.vec_id == r.component_id) for r in got)
    assert gridorder.near_duplicates(df.limit(0)).collect() == []


def boxes_of(spark, points, block):
    rows = [(0, i // block, *points[i : i + block].min(0).tolist(), *points[i : i + block].max(0).tolist()) for i in range(0, len(points), block)]
    return spark.createDataFrame([("g", *r[1:]) for r in rows], "grp string, blk long, lo0 double, lo1 double, hi0 double, hi1 double")


def test_recursion_opens_only_near_intervals(spark):
    """Seven levels of two: the pairs are those of a comparison of all boxes, far fewer than all."""
    t = np.linspace(0, 6.2, 400)
    points = np.stack([np.cos(t), np.sin(t)], 1)
    boxes = boxes_of(spark, points, 4)
    got = {(r.bi, r.bj) for r in gridorder._pairs(boxes, 0.1, 2, fan=2).collect()}
    b = [(points[i : i + 4].min(0), points[i : i + 4].max(0)) for i in range(0, 400, 4)]
    gap = lambda x, y: np.linalg.norm(np.maximum(0, np.maximum(x[0] - y[1], y[0] - x[1])))
    assert got == {(i, j) for i in range(100) for j in range(i, 100) if gap(b[i], b[j]) <= 0.1 + 1e-6} and len(got) < 1000 < 100 * 101 / 2
    assert {(r.bi, r.bj) for r in gridorder._pairs(boxes, 0.1, 2).collect()} == got
    assert gridorder._pairs(boxes.limit(0), 0.1, 2).collect() == []


def test_interval_join_misses_no_pair():
    rnd = np.random.default_rng(5)
    p = np.sort(rnd.normal(size=(500, 2)), axis=0)
    for a, b in (((0, 500), (0, 500)), ((0, 200), (200, 500))):
        seen, work = set(), 0
        for x, y in gridorder.interval_join(p, a, b, 0.2, 8):
            work += (x.stop - x.start) * (y.stop - y.start)
            pairs = {(min(i, j), max(i, j)) for i in range(x.start, x.stop) for j in range(y.start, y.stop) if i != j}
            assert not pairs & seen
            seen |= pairs
        d = np.linalg.norm(p[:, None] - p[None], axis=2) <= 0.2
        want = {(min(i, j), max(i, j)) for i in range(*a) for j in range(*b) if i != j and d[i, j]}
        assert want <= seen and work < 0.5 * (a[1] - a[0]) * (b[1] - b[0])


def test_blocks_of_a_wide_label_are_skipped(spark):
    """A label of two far apart clouds in 16 dimensions: half of the pairs of blocks of 16 are provably distant. (The
    vectors of the given tables spread alike in 64 directions: hardly any are, so there the exact comparison does the work.)"""
    rnd = np.random.default_rng(1)
    x = np.concatenate([rnd.normal(size=(150, 16)) * 0.03 + c * np.eye(16)[0] for c in (1, -1)])
    reps = spark.createDataFrame([(i, "g", 1, v.tolist(), i) for i, v in enumerate(x)], "sid long, grp string, copies long, embedding array<double>, h long")
    seq = gridorder._sequence(gridorder._placed(reps.drop("h"), gridorder._basis(reps, 2000, 8), (2 - 2 * 0.93) ** 0.5, 8), 16)
    boxes = seq.groupBy("grp", "blk").agg(*[f(F.get("proj", F.lit(k))).alias(f"{e}{k}") for e, f in (("lo", F.min), ("hi", F.max)) for k in range(8)])
    n = boxes.count()
    assert gridorder._pairs(boxes, (2 - 2 * 0.93) ** 0.5, 8).count() < 0.6 * n * (n + 1) / 2
