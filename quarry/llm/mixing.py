"""Mixing sources to target weights: a min-cost flow over membership patterns, then seeded documents."""

from __future__ import annotations

from collections import defaultdict
from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored, table

CYCLE = (5, 2, 1)
MOST_REPEATS = 3
WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: list[int], weights: list[int], repeats: int = MOST_REPEATS) -> list[Fraction]:
    """The sum of sizes shared by weight; none above repeats * size, what is over being shared again among the others.

    Sources are settled in the order of size / weight: the first ones reach their ceiling, the others split the rest."""
    rest, weight = Fraction(sum(sizes)), sum(weights)
    out = [Fraction(0)] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: Fraction(sizes[i], weights[i])):
        share = rest * weights[i] / weight if weight else Fraction(0)
        out[i] = min(share, Fraction(repeats * sizes[i]))
        rest -= out[i]
        weight -= weights[i]
    return out


class Network:
    """Largest flow from node 0 to node 1 by blocking flows over levels of the residual graph; edges may be widened and
    the flow carried on."""

    def __init__(self, nodes: int):
        self.out: list[list[int]] = [[] for _ in range(nodes)]
        self.to: list[int] = []
        self.room: list[int] = []  # edge e and its reverse e ^ 1

    def add(self, a: int, b: int, room: int) -> int:
        for x, y, r in ((a, b, room), (b, a, 0)):
            self.out[x].append(len(self.to))
            self.to.append(y)
            self.room.append(r)
        return len(self.to) - 2

    def fill(self) -> None:
        while True:
            level, edge = {0: 0}, [0]
            while edge and 1 not in level:
                new = {}
                for a in edge:
                    for e in self.out[a]:
                        if self.room[e] and self.to[e] not in level:
                            new[self.to[e]] = level[a] + 1
                level |= new
                edge = [*new]
            if 1 not in level:
                return
            at = [0] * len(self.out)  # of each node the next edge to try
            path: list[int] = []
            while True:
                a = self.to[path[-1]] if path else 0
                if a == 1:
                    most = min(self.room[e] for e in path)
                    for e in path:
                        self.room[e] -= most
                        self.room[e ^ 1] += most
                    path = path[: next(i for i, e in enumerate(path) if not self.room[e])]
                    continue
                while at[a] < len(self.out[a]):
                    e = self.out[a][at[a]]
                    if self.room[e] and level.get(self.to[e]) == level[a] + 1:
                        break
                    at[a] += 1
                if at[a] < len(self.out[a]):
                    path.append(self.out[a][at[a]])
                elif path:  # a dead end
                    at[self.to[path.pop() ^ 1]] += 1
                else:
                    break


def route(patterns: list[tuple[tuple, int]], quotas: dict, repeats: int = MOST_REPEATS) -> list[dict]:
    """Min-cost flow of words from each pattern (sources that hold its documents, words) to its sources' quotas.

    The r-th use of a pattern's words costs r, so the convex cost spreads repetition. All cost lies on the edges into the
    patterns and the cheapest augmenting paths come first, so the levels of repetition fill one after the other: the
    largest flow of one use, then, carried on, of two uses, and so on. The network's edges are the memberships."""
    names = sorted({s for p, _ in patterns for s in p}, key=lambda s: (s is None, s or ""))
    node = {s: 2 + len(patterns) + i for i, s in enumerate(names)}
    net = Network(2 + len(patterns) + len(names))
    into = [net.add(0, 2 + k, 0) for k in range(len(patterns))]
    across = [[(s, net.add(2 + k, node[s], repeats * n)) for s in p] for k, (p, n) in enumerate(patterns)]
    for s in names:
        net.add(node[s], 1, quotas[s])
    for _ in range(repeats):
        for e, (_, n) in zip(into, patterns):
            net.room[e] += n
        net.fill()
    return [{s: net.room[e ^ 1] for s, e in edges if net.room[e ^ 1]} for edges in across]


def mix(docs: DataFrame, members: str, size: str, order: str, cycle=CYCLE, repeats: int = MOST_REPEATS, max_patterns: int = 1_000_000) -> DataFrame:
    """(docs with a column copies, 0 to repeats, which replaces one of that name; a table of source, source_size, target).

    docs should be stored: they are read twice. members: array of the sources that hold a document; size: its words;
    order: its seeded place, a hex string. Documents are aggregated by pattern of membership; only these sums (one row
    a pattern, max_patterns at most, else an error) reach the driver. A pattern that is to give q words of its n uses
    every document q div n times, and once more those first in seeded order, up to the document whose middle passes
    q mod n. Places come from sums by leading hex digits and a window within each such bucket, so a source with most of
    the rows is spread over as many tasks as any other rows. Null and empty members make a pattern of their own, which
    takes nothing where no source holds it; null sizes count 0; equal places are settled by size, repeated rows are
    documents of their own; an empty table gives no rows."""
    spark = docs.sparkSession
    key = F.to_json(F.array_sort(F.array_distinct(F.col(members))))
    own = [c for c in docs.columns if c != "copies"]
    d = docs.select(*own).withColumn("__pattern", F.coalesce(key, F.lit("[]"))).withColumn(size, F.coalesce(F.col(size), F.lit(0)).cast("long"))
    sums = d.groupBy("__pattern").agg(F.first(F.array_sort(F.array_distinct(F.col(members)))).alias("p"), F.sum(size).alias("n"), F.count("*").alias("rows")).limit(max_patterns + 1).collect()
    sums.sort(key=lambda r: r["__pattern"])  # equal costs are settled alike in every run
    if len(sums) > max_patterns:
        raise ValueError(f"more than {max_patterns} patterns of membership")
    patterns = [(tuple(r.p or ()), int(r.n or 0)) for r in sums]
    sizes: dict = defaultdict(int)
    for p, n in patterns:
        for s in p:
            sizes[s] += n
    sources = sorted(sizes, key=lambda s: (s is None, s or ""))  # by code point, null last
    goal = dict(zip(sources, targets([sizes[s] for s in sources], [cycle[i % len(cycle)] for i in range(len(sources))], repeats)))
    flows = route(patterns, {s: round(goal[s]) for s in sources}, repeats)
    plan = [(r[0], sum(f.values()) // n if n else 0, sum(f.values()) % n if n else 0) for r, (_, n), f in zip(sums, patterns, flows)]
    # buckets of about a thousand rows of the largest pattern, or of a hundred thousand if there would be very many
    digits, most = 1, max((r.rows for r in sums), default=0)
    while digits < 4 and most > 1_000 * 16**digits or digits < 6 and most > 100_000 * 16**digits:
        digits += 1
    b = F.substring(order, 1, digits)
    by = Window.partitionBy("__pattern").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = d.groupBy("__pattern", b.alias("__bucket")).agg(F.sum(size).alias("n")).select("__pattern", "__bucket", F.coalesce(F.sum("n").over(by), F.lit(0)).alias("__before"))
    within = Window.partitionBy("__pattern", "__bucket").orderBy(order, size).rowsBetween(Window.unboundedPreceding, -1)
    rows = d.withColumn("__bucket", b).withColumn("__within", F.coalesce(F.sum(size).over(within), F.lit(0)))
    plan_df = spark.createDataFrame(plan or [("[]", 0, 0)], "__pattern string, __whole long, __part long")
    once_more = (2 * (F.col("__before") + F.col("__within")) + F.col(size) <= 2 * F.col("__part")) & (F.col("__part") > 0)
    out = rows.join(before, ["__pattern", "__bucket"]).join(plan_df, "__pattern").withColumn("copies", (F.col("__whole") + once_more.cast("long")))
    out = out.select(*own, "copies")
    facts = [(s, sizes[s], float(goal[s])) for s in sources] or [(None, 0, 0.0)]
    return out, spark.createDataFrame(facts, "source string, source_size long, target double")


def measured(docs: DataFrame, seed: str = "mix") -> DataFrame:
    """(doc_id, source, size, place): the words of each whole text (null: none) and its seeded place."""
    return docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256).alias("place"))


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken of every document; membership is the document's own source, so each
    pattern of the flow is one source.

    Null texts have no words; very long ones are counted whole; the null source is a source and comes last; repeated rows
    are documents of their own, ties in seeded order go by size; documents without words take 0; an empty table gives an
    empty result; other columns are ignored."""
    docs = stored(measured(table(spark, sf_dir, "documents", "doc_id", "text", "source")).withColumn("members", F.array("source")))
    out, facts = mix(docs, "members", "size", "place")
    facts = facts.withColumnRenamed("source", "s")
    return out.join(facts, F.col("source").eqNullSafe(F.col("s"))).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         sha256('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS place
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM s),
o AS (SELECT *, row_number() OVER (ORDER BY source_size / weight, source NULLS LAST) AS k FROM w),
c AS (
  SELECT *, (SELECT sum(source_size) FROM o) - 3 * (sum(source_size) OVER (ORDER BY k) - source_size) AS rest,
         sum(weight) OVER (ORDER BY k DESC) AS open_weight FROM o),
f AS (SELECT *, coalesce(min(CASE WHEN rest * weight <= 3 * source_size * open_weight THEN k END) OVER (), 1000000000) AS first_open FROM c),
t AS (
  SELECT source, source_size,
         CASE WHEN k < first_open THEN CAST(3 * source_size AS DOUBLE)
              ELSE CAST(max(CASE WHEN k = first_open THEN rest END) OVER () * weight AS DOUBLE) / CAST(max(CASE WHEN k = first_open THEN open_weight END) OVER () AS DOUBLE) END AS target
  FROM f),
q AS (SELECT *, CAST(round_even(target, 0) AS BIGINT) AS quota FROM t),
r AS (
  SELECT d.doc_id, d.size, q.source_size, q.target, q.quota,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.place, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source)
SELECT doc_id, size, source_size, target,
       CAST(size * (CASE WHEN source_size = 0 THEN 0 ELSE quota // source_size
         + CASE WHEN quota % source_size > 0 AND 2 * before + size <= 2 * (quota % source_size) THEN 1 ELSE 0 END END) AS BIGINT) AS taken
FROM r
"""
