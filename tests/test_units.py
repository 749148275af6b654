"""Hand-made cases and small models of the sequential operators."""

import random

import pandas as pd
from pyspark.sql import functions as F

from quarry.functions import text
from quarry.functions.scores import mean_pooled
from quarry.operators import bm25, cases, dense, evaluate, fusion, graph, parse, prompts, routing
from quarry.operators.dense import greedy_distinct, top_inner
from quarry.plans.hybrid import Config, HybridSearch
from quarry.sources.readers import append_new, chunks, first_by_id, prompt_registry, raw_texts, write_by_suffix
from quarry.sources.registry import Registry
from quarry.sources.shared import files_digest
from quarry.streaming.cache import ResultCache
from quarry.streaming.ingest import add_batch


def test_router_cases(spark):
    q = spark.createDataFrame([(1, "如何理解合同解除的条件？"), (2, "约定的违约金过高怎么处理"), (3, ""), (4, None)], "id int, text string")
    r = {x.id: x for x in routing.route(q).collect()}
    assert (r[1].task_type, r[1].issue_type, r[1].mode) == ("statute_exegesis", "contract_termination", "GRAPH_AUGMENTED")
    assert (r[2].issue_type, r[2].mode) == ("penalty_liquidated", "RAG")
    for i in (3, 4):
        assert (r[i].task_type, r[i].issue_type, r[i].mode, r[i].top_k_factor) == ("judge_style", "other", "RAG", 1.0)
    o = routing.overridden(routing.route(q).withColumn("a", F.lit('x {"task_type": "risk_alert", "issue_type": "tort_liability", "top_k_factor": 3} y')), "a").first()
    assert (o.task_type, o.issue_type, o.top_k_factor) == ("risk_alert", "tort_liability", 2.0)


def slow_walk(seeds, adj, nodes, depths, limit):
    seen, queue, out = set(seeds), [(s, 0, None) for s in seeds], []
    while queue and len(out) < limit:
        cur, dist, rel = queue.pop(0)
        if dist >= (depths.get(rel, depths["default"]) if rel else depths["default"]):
            continue
        for dst, r in adj.get(cur, []):
            if dst in seen:
                continue
            seen.add(dst)
            if dst not in nodes:
                continue
            out.append((dst, dist + 1, cur, r))
            if len(out) >= limit:
                break
            queue.append((dst, dist + 1, r))
    return out


def test_walk_equals_queue(spark):
    rnd = random.Random(1)
    edges, seeds, want = [], [], {}
    depths = {"default": 2, "a": 3, "b": 1}
    for q in range(25):
        n = rnd.randint(3, 12)
        base = q * 100
        adj = {}
        for s in range(n):
            for pos in range(rnd.randint(0, 4)):
                t, r = rnd.randrange(n + 2), rnd.choice("abc")
                adj.setdefault(base + s, []).append((base + t, r))
                edges.append((base + s, base + t, r, 1.0, pos))
        st = rnd.sample(range(n), 2)
        seeds += [(q, base + s, i) for i, s in enumerate(st)]
        want[q] = slow_walk([base + s for s in st], adj, {base + i for i in range(n)}, depths, 6)

    rnd = random.Random(1)
    sizes = []
    for q in range(25):
        n = rnd.randint(3, 12)
        sizes.append(n)
        for s in range(n):
            for _ in range(rnd.randint(0, 4)):
                rnd.randrange(n + 2), rnd.choice("abc")
        rnd.sample(range(n), 2)
    nodes = spark.createDataFrame([(q * 100 + i,) for q, n in enumerate(sizes) for i in range(n)], "node long")
    e = spark.createDataFrame(edges, "src long, dst long, relation string, conf double, pos int")
    got = graph.walk(spark.createDataFrame(seeds, "query_id int, node long, ord int"), e, nodes, depths, 6).orderBy("query_id", "ord").collect()
    assert {q: [(r.node, r.depth, r.parent, r.relation) for r in got if r.query_id == q] for q in want} == want


def slow_budget(cands, caps, total):
    out = {}
    for s, t, r, c, _ in sorted(cands, key=lambda x: x[4]):
        lst = out.setdefault(s, [])
        if len(lst) >= min(caps.get(r, total), total):
            continue
        for e in lst:
            if e[:2] == [t, r]:
                e[2] = max(e[2], c)
                break
        else:
            lst.append([t, r, c])
    return {s: [tuple(e) for e in v] for s, v in out.items() if v}


def test_budget_equals_loop(spark):
    rnd = random.Random(2)
    c = [(rnd.randrange(40), rnd.randrange(50, 56), rnd.choice(["cite", "next"]), rnd.choice([0.5, 0.9]), i) for i in range(900)]
    got = graph.budgeted(spark.createDataFrame(c, "src long, dst long, relation string, conf double, seq long"), {"cite": 3}, 5).orderBy("src", "pos").collect()
    have = {}
    for r in got:
        have.setdefault(r.src, []).append((r.dst, r.relation, r.conf))
    assert have == slow_budget(c, {"cite": 3}, 5)


def test_graph_import_and_resolution(spark):
    n = spark.createDataFrame([("a", None, '["b", {"article_id": "c", "relation": "cite", "conf": 0}]'), (None, "d", '[{"article_id": "a", "conf": 0.5}]'), ("", " ", '["x"]')], "article_id string, id string, neighbors string")
    assert sorted(tuple(r) for r in graph.imported(n).collect()) == [("a", "b", "neighbor", 1.0, 0), ("a", "c", "cite", 1.0, 1), ("d", "a", "neighbor", 0.5, 0)]
    refs = spark.createDataFrame([("x", "section:2.1", 0.85), ("x", "463", 0.9), ("x", "none", 0.9), ("y", "463", 0.9)], "src string, ref string, conf double")
    keys = spark.createDataFrame([("section:2", "s2"), ("463", "y")], "ref string, article_id string")
    assert sorted(tuple(r) for r in graph.resolved(refs, keys).collect()) == [("s2", "x", "cited", 0.85), ("x", "s2", "cite", 0.85), ("x", "y", "cite", 0.9), ("y", "x", "cited", 0.9)]
    defs = spark.createDataFrame([("a1", "t", 0.95), ("a2", "t", 0.95), ("a1", "w", 0.6)], "article_id string, term string, conf double")
    pos = spark.createDataFrame([("a1", 2), ("a2", 1)], "article_id string, pos int")
    assert [tuple(r) for r in graph.registered(defs, pos).collect()] == [("t", "a2")]


def test_fusion_by_hand(spark):
    runs = spark.createDataFrame([(1, 10, "bm25", 4.0), (1, 11, "bm25", 2.0), (1, 10, "dense", 0.9), (1, 12, "dense", 0.9), (2, 10, "bm25", 7.0)], "query_id int, doc_id int, channel string, score double")
    f = {(r.query_id, r.doc_id): r for r in fusion.fuse(runs, "blend").collect()}
    assert f[1, 10].rank == 1 and abs(f[1, 10].score - (0.5 * 1 + 0.5 * 0.4)) < 1e-12 and f[1, 10].channels == ["bm25", "dense"]
    assert f[2, 10].score == 0.0  # one hit: both norms are 0
    assert abs(sum(f[1, 10].contrib.values()) - f[1, 10].score) < 1e-12


def test_metrics_by_hand(spark):
    runs = spark.createDataFrame([("s", 1, 10, 1), ("s", 1, 11, 2), ("s", 1, 10, 3), ("s", 1, 12, 4)], "system string, query_id int, doc_id int, rank int")
    gold = spark.createDataFrame([(1, 11), (1, 99)], "query_id int, doc_id int")
    m = evaluate.metrics(runs, gold, spark.createDataFrame([(1,), (2,)], "query_id int"), (3,)).orderBy("query_id").collect()
    assert (m[0].hit_3, m[0].recall_3, m[0].mrr_3) == (1.0, 0.5, 0.5) and abs(m[0].ndcg_3 - 0.63093 / 1.63093) < 1e-4
    assert tuple(m[1][2:]) == (0.0, 0.0, 0.0, 0.0)


def test_greedy_distinct(spark):
    rnd = random.Random(5)
    pairs = {(a, b) for a, b in ((rnd.randrange(60), rnd.randrange(60)) for _ in range(90)) if a < b}
    kept = []
    for i in range(60):
        if not any((k, i) in pairs for k in kept):
            kept.append(i)
    nodes = spark.createDataFrame([(i,) for i in range(60)], "vec_id long")
    got = greedy_distinct(spark.createDataFrame(sorted(pairs), "a long, b long"), nodes).collect()
    assert sorted(r.vec_id for r in got) == kept


def test_top_inner_small(spark):
    c = spark.createDataFrame([(i, [float(i % 7), float(i % 3)]) for i in range(50)] + [(99, None)], "doc_id long, embedding array<double>")
    q = spark.createDataFrame([(1, [1.0, 0.5])], "query_id long, embedding array<double>")
    want = sorted(((-(i % 7 + 0.5 * (i % 3)), i) for i in range(50)))[:5]
    assert [r.doc_id for r in top_inner(q, c, 5).orderBy("rank").collect()] == [i for _, i in want]


def test_cases_filters(spark):
    c = spark.createDataFrame([("c1", "court of appeal", {"court": "High Court"}, ["x"]), ("c2", "court", {"court": "Low"}, ["x", "y"]), ("c3", "court", None, None)], "id string, text string, attrs map<string,string>, tags array<string>")
    q = spark.createDataFrame([(1, "court appeal")], "query_id int, text string")
    assert [r.id for r in cases.search(q, c.unionByName(spark.createDataFrame([("c4", "zz", None, None)], c.schema)), 5, keep=cases.matches({"court": "High"})).collect()] == ["c1"]
    assert [r.id for r in c.where(cases.matches({"tags": "y"}, lists={"tags": "tags"})).collect()] == ["c2"]
    t = spark.createDataFrame([("a", None, " ", "d")], "title string, facts string, issue string, holding string").select(cases.case_text().alias("t")).first().t
    assert t == "a\nd"


def test_running_heads(spark):
    lines = spark.createDataFrame([(1, p, 1, 5.0, 10.0, f"Page {p}") for p in (1, 2, 3)] + [(1, 1, 2, 50.0, 55.0, "body"), (1, 2, 2, 50.0, 55.0, "12")], "doc_id int, page int, line int, top double, bottom double, text string")
    heights = spark.createDataFrame([(1, p, 100.0) for p in (1, 2, 3)], "doc_id int, page int, height double")
    assert [r.text for r in parse.without_running_heads(lines, heights).collect()] == ["body"]


def test_choice_of_parse(spark):
    mk = lambda n, d: spark.createDataFrame([(d, i, "x", str(i), "t") for i in range(n)], "doc_id int, n long, article_no string, article_id string, text string")
    line, scan = mk(12, 1).unionByName(mk(3, 2)), mk(11, 1).unionByName(mk(2, 2))
    got = parse.chosen(line, scan).groupBy("doc_id").count().collect()
    assert {r.doc_id: r["count"] for r in got} == {1: 12, 2: 2}


def test_readers_and_registry(spark, tmp_path):
    (tmp_path / "raw/sub").mkdir(parents=True)
    (tmp_path / "raw/a.txt").write_bytes("第一条 甲".encode("gb18030"))
    (tmp_path / "raw/sub/b.txt").write_text("plain é")
    assert {r.source: r.text for r in raw_texts(spark, f"file://{tmp_path}/raw").collect()} == {"a.txt": "第一条 甲", "b.txt": "plain é"}
    (tmp_path / "c1.jsonl").write_text('{"id": "1", "text": "one", "part": "p"}\n{"id": "2", "text": "two", "lang": "en"}\n')
    (tmp_path / "c2.jsonl").write_text('{"id": "1", "text": "other"}\n')
    got = first_by_id(chunks(spark, f"file://{tmp_path}/c*.jsonl"), "id", ["file", "line"]).orderBy("id").collect()
    assert [(r.id, r.text, r.lang) for r in got] == [("1", "one", "zh"), ("2", "two", "en")]
    reg = Registry(spark, f"file://{tmp_path}/idx")
    assert reg.active() is None and reg.versions() == []
    d = spark.createDataFrame([(1, "en")], "id int, lang string")
    reg.write("v1", "t", d, ["lang"])
    reg.write("v2", "t", d.limit(0))
    reg.activate("v1")
    assert reg.active() == "v1" and reg.versions() == ["v1", "v2"] and reg.read("t").count() == 1 and reg.read("t", "v2").count() == 0
    (tmp_path / "p.json").write_text('{"registry": {"judge_style": {"system": "s", "user_prefix": "u"}}, "example_pool": [{"lang": "en", "tags": ["a"], "content": "c"}]}')
    t, ex = prompt_registry(spark, f"file://{tmp_path}/p.json")
    assert t.first().system == "s" and ex.first().tags == ["a"]


def test_incremental_and_batches(spark, tmp_path):
    root = f"file://{tmp_path}/ing"
    a = spark.createDataFrame([(1, "a b"), (2, "b c"), (2, "again")], "doc_id long, text string")
    add_batch(a, root, 0)
    add_batch(a.unionByName(spark.createDataFrame([(3, "c")], a.schema)), root, 1)
    assert spark.read.parquet(f"{root}/chunks").count() == 3 and spark.read.parquet(f"{root}/postings").select("doc_id").distinct().count() == 3
    s = {(r.batch, r.stage): (r.state, r.added) for r in spark.read.parquet(f"{root}/status").collect()}
    assert s == {(0, "chunks"): ("done", 2), (0, "postings"): ("done", 2), (1, "chunks"): ("done", 1), (1, "postings"): ("done", 1)}
    assert append_new(a, f"{root}/chunks", "doc_id") == 0
    assert bm25.extended(a.dropDuplicates(["doc_id"]), a).count() == 2


def test_prompts(spark):
    q = spark.createDataFrame([("q", "c", "e", None)], "q string, c string, e string, r string").select(prompts.messages(F.lit("sys"), F.col("q"), F.col("c"), F.col("e"), F.col("r")).alias("m"))
    assert q.select(prompts.flat(F.col("m"))).first()[0] == "system: sys\nuser: Context:\nc\n\nExample:\ne\n\nQuestion: q"
    a = prompts.answered(spark.createDataFrame([("p",)], "prompt string"), model=lambda p: F.concat(F.lit("Answer: "), p)).first()
    assert a.answer == "p"
    j = spark.createDataFrame([('{"score": 0.4}',), ("score 7",), ("none",), (None,)], "a string").select(fusion.parsed_judgement("a")).collect()
    assert [r[0] for r in j] == [0.4, 1.0, 0.0, 0.0]


def test_index_opens_in_another_place(spark, tmp_path):
    d = spark.createDataFrame([(1, "red cat"), (2, "blue cat sat"), (3, None), (4, "dog dog")], "doc_id long, text string")
    q = spark.createDataFrame([(1, "cat dog")], "query_id long, text string")
    reg = Registry(spark, f"file://{tmp_path}/ix")
    built = bm25.Index(d, registry=reg, version="a").search(q, 5).collect()
    assert reg.complete("a") and not reg.complete("b")
    reg.activate("a")
    d2 = d.unionByName(spark.createDataFrame([(5, "cat cat")], d.schema))
    bm25.Index(d2, registry=reg, version="b")
    again = bm25.Index.open(Registry(spark, f"file://{tmp_path}/ix")).search(q, 5).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, built)) == sorted(map(tuple, bm25.Index(d).search(q, 5).collect()))
    reg.activate("b")
    assert reg.active() == "b" and {r.doc_id for r in bm25.Index.open(reg).search(q, 5).collect()} == {1, 2, 4, 5}
    assert [f for f in (tmp_path / "ix").iterdir() if f.name.startswith("ACTIVE.")] == []
    assert bm25.Index(d.limit(0)).search(q, 5).collect() == []


def test_digest_follows_the_files(spark, tmp_path):
    d = spark.range(5)
    d.write.parquet(f"{tmp_path}/t")
    a = files_digest(spark, f"file://{tmp_path}/t")
    assert a == files_digest(spark, f"file://{tmp_path}/t")
    d.write.mode("append").parquet(f"{tmp_path}/t")
    assert a != files_digest(spark, f"file://{tmp_path}/t")


def test_search_by_language_and_padding(spark):
    d = spark.createDataFrame([(1, "en", "cat sat"), (2, "de", "cat"), (3, "zh", "合同解除"), (4, "zh", "合同成立")], "doc_id long, lang string, text string")
    q = spark.createDataFrame([(1, "en", "cat"), (2, "zh", "解除合同")], "query_id long, lang string, text string")
    got = bm25.search_by_lang(q, d, 2, {"zh": text.tokens_cjk}).collect()
    assert {(r.query_id, r.doc_id) for r in got} == {(1, 1), (2, 3), (2, 4)} and [r.doc_id for r in got if r.query_id == 2 and r.rank == 1] == [3]
    assert bm25.search_by_lang(q.limit(0), d, 2).collect() == []
    p = bm25.padded(spark.createDataFrame([(1, 2, 5.0, 1)], "query_id long, doc_id long, score double, rank int"), q, d, 3).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.doc_id, r.score) for r in p] == [(1, 2, 5.0), (1, 1, 0.0), (1, 3, 0.0), (2, 1, 0.0), (2, 2, 0.0), (2, 3, 0.0)]


def test_graph_search_equals_plain_model(spark):
    """A question that routes to graph mode gets hits that only the walk finds, scored by overlap, decay and weight."""
    d = spark.createDataFrame([(1, "lease of a house"), (2, "lease ends when notice"), (3, "meaning of notice in writing"), (4, " "), (5, "lease meaning far away")], "doc_id long, text string")
    q = spark.createDataFrame([(1, "what is the meaning of lease"), (2, "lease house")], "query_id long, text string")
    edges = spark.createDataFrame([(1, 3, "defined_by", 0.9, 0), (1, 4, "next", 1.0, 1), (3, 2, "cite", 1.0, 0)], "src long, dst long, relation string, conf double, pos int")
    c = Config(seeds=1, least_score=0.0, rerank_window=0)
    s = HybridSearch(d, edges=edges, config=c)
    first = {r.query_id: r.doc_id for r in s.index.search(q, 1).collect()}
    got = s.search(q, 10).collect()
    by = {(r.query_id, r.doc_id): r for r in got}
    assert not any("graph" in r.channels for r in got if r.query_id == 2)
    want = {}
    adj = {1: [(3, "defined_by", 0.9), (4, "next", 1.0)], 3: [(2, "cite", 1.0)]}
    words = {"what", "is", "the", "meaning", "of", "lease"}
    texts = {r.doc_id: set(r.text.split()) for r in d.collect()}
    weight = {"defined_by": 1.2, "cite": 1.15, "next": 0.95}
    todo, seen = [(first[1], 0)], {first[1]}
    while todo:
        n, depth = todo.pop(0)
        for t, rel, conf in adj.get(n, []):
            if t not in seen:
                seen.add(t)
                if t != 4:
                    want[t] = len(words & texts[t]) / len(words) * (2 + depth) ** -0.7 * weight[rel] * conf
                    todo.append((t, depth + 1))
    assert {k for k, r in by.items() if "graph" in r.channels} == {(1, t) for t in want}
    for t, x in want.items():
        assert by[1, t].score >= x - 1e-12 and (by[1, t].channels != ["graph"] or abs(by[1, t].score - x) < 1e-12)
    late = HybridSearch(d, config=c, late=True).search(q, 10).collect()
    assert all("colbert" in r.channels for r in late) and late


def test_graph_built_from_a_corpus(spark):
    rows = [("1", "law", 1, "“Goods” means all movable things."), ("2", "law", 2, "A seller of Goods follows Section 1."), ("3", "law", 3, "See Section 2 and Section 9."), ("4", "other", 1, "Nothing.")]
    e = graph.built(spark.createDataFrame(rows, "article_id string, source string, n int, text string"), ["source"], ["n"])
    got = {(r.src, r.dst, r.relation) for r in e.collect()}
    assert got == {("1", "2", "next"), ("2", "1", "prev"), ("2", "3", "next"), ("3", "2", "prev"), ("2", "1", "cite"), ("1", "2", "cited"), ("3", "2", "cite"), ("2", "3", "cited"), ("2", "1", "defined_by"), ("1", "2", "defines_term")}
    few = graph.built(spark.createDataFrame(rows, "article_id string, source string, n int, text string"), ["source"], ["n"], total=2)
    assert max(r["count"] for r in few.groupBy("src").count().collect()) == 2
    v = spark.createDataFrame([(1, "x", None), (2, " ", "zh"), (3, "y", "en"), (4, "z", "ZH")], "doc_id long, text string, lang string")
    assert [sorted(r.node for r in graph.searchable(v, x).collect()) for x in (None, "zh", "en")] == [[1, 3, 4], [1, 4], [3]]


def test_sequence_in_buckets_equals_one_window(spark):
    rnd = random.Random(6)
    rows = [(i, rnd.choice(["a", "b", None])) for i in rnd.sample(range(500), 200)]
    d = spark.createDataFrame(rows, "doc_id long, source string")
    plain, dealt = (sorted(map(tuple, graph.sequence_edges(d, ["source"], ["doc_id"], bucket=b).collect())) for b in (None, F.floor(F.col("doc_id") / 7)))
    assert plain == dealt and len(plain) == 2 * (200 - 3)


def test_scores_are_kept(spark):
    asked = spark.sparkContext.accumulator(0)

    @F.pandas_udf("double")
    def scorer(q: pd.Series, t: pd.Series) -> pd.Series:
        asked.add(len(q))
        return (q.str.len() + t.str.len()).astype(float)

    p = spark.createDataFrame([(1, "a", "bb"), (2, "a", "bb"), (3, "a", "c")], "i int, q string, t string")
    out, memo = fusion.scored_once(p, scorer)
    assert sorted((r.i, r.raw) for r in out.collect()) == [(1, 3.0), (2, 3.0), (3, 2.0)] and asked.value == 2
    out, memo = fusion.scored_once(p.unionByName(spark.createDataFrame([(4, "z", "z")], p.schema)), scorer, memo)
    assert sorted((r.i, r.raw) for r in out.collect())[-1] == (4, 2.0) and asked.value == 3 and memo.count() == 3
    assert fusion.chosen_scorer(30, "m", "c") == "m" and fusion.chosen_scorer(31, "m", "c") == "c" and fusion.chosen_scorer(5) is fusion.overlap_score


def test_vectors_and_cases_are_added_once(spark, tmp_path):
    d = spark.createDataFrame([(1, "red cat"), (2, "")], "doc_id long, text string")
    v = dense.embedded(d, dense.hashed_text(), most=1)
    q = dense.embedded(d, dense.hashed_text(), prefix="red ")
    by = {r.doc_id: r.embedding for r in v.collect()}
    assert abs(sum(x * x for x in by[1]) - 1) < 1e-9 and by[2] == [0.0] * 8 and {r.doc_id: r.embedding for r in q.collect()}[2] == by[1]
    assert dense.add_vectors(v, f"file://{tmp_path}/v") == 2 == spark.read.parquet(f"{tmp_path}/v").count() and dense.add_vectors(v, f"file://{tmp_path}/v") == 0
    c = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "z")], "id string, text string")
    assert cases.add_cases(c, f"file://{tmp_path}/c") == 2 and cases.add_cases(c, f"file://{tmp_path}/c") == 0
    assert spark.read.parquet(f"{tmp_path}/c").where("id = 'a'").first().text == "x"


def test_report_and_files(spark, tmp_path):
    m = spark.createDataFrame([("a", 1, 0.5), ("b", 1, 1.0), ("c", 1, 0.5)], "system string, query_id int, recall_10 double")
    assert [r.system for r in evaluate.report(m, ["recall_10"]).orderBy("place").collect()] == ["b", "a", "c"]
    assert [r.system for r in evaluate.report(m, ["recall_10"], order=["c", "a"]).orderBy("place").collect()] == ["c", "a", "b"]
    hits = spark.createDataFrame([(1, 10, 1)], "query_id int, doc_id int, rank int")
    assert sorted(r.system for r in evaluate.compared({x: hits for x in ("bm25", "dense", "colbert", "rrf", "hybrid", "graph")}).collect()) == ["bm25", "colbert", "dense", "graph", "hybrid", "rrf"]
    for name in ("m.csv", "m.jsonl"):
        write_by_suffix(m, f"{tmp_path}/{name}")
    assert spark.read.option("header", True).csv(f"{tmp_path}/m.csv").count() == 3 == spark.read.json(f"{tmp_path}/m.jsonl").count()
    (tmp_path / "c.json").write_text('{"top_k": 3, "unknown": 1, "gamma": 0.5}')
    c = Config.load(spark, f"file://{tmp_path}/c.json")
    assert (c.top_k, c.gamma, c.seeds) == (3, 0.5, 30)


def test_corpus_driver(spark):
    law = "\n".join(f"第{i}条 内容{i}。" for i in range(1, 31))
    raw = spark.createDataFrame([("law", law), ("note", "没有条文。只有句子。"), ("blank", None)], "source string, text string")
    got = parse.corpus(raw, target=5, overlap=0, gate={"count": 20, "coverage": 0.3, "gap_ratio": 0.5, "avg_len_ratio": 0.12}).collect()
    assert [r.article_id for r in sorted(got, key=lambda r: r.n) if r.source == "law"] == [str(i) for i in range(1, 31)]
    assert [r.text for r in sorted(got, key=lambda r: r.n) if r.source == "note"] == ["没有条文。", "只有句子。"] and not [r for r in got if r.source == "blank"]


def test_questions_are_synthesised(spark):
    d = spark.createDataFrame([(1, "good"), (2, "weak"), (3, "hopeless")], "doc_id long, text string")
    ask = lambda role, t: F.concat(F.lit("Can the contract be "), t, F.lit("?"))
    judge = lambda q, t: F.when(q.contains("good") | q.contains("again"), "score 8").otherwise("3")
    rewrite = lambda q, t: F.when(t == "weak", F.lit("Can the contract end again?")).otherwise(F.lit("no question"))
    got = prompts.synthesised(d, ["buyer", "judge"], ask, judge, rewrite).collect()
    assert {(r.doc_id, r.role, r.rewritten) for r in got} == {(1, "buyer", False), (1, "judge", False), (2, "buyer", True), (2, "judge", True)}


def test_result_cache(spark, tmp_path):
    c = ResultCache(spark, f"file://{tmp_path}/cache", ttl=900)
    at = lambda s: F.lit(s).cast("timestamp")
    r = spark.createDataFrame([("q1", 10), ("q1", 11), ("q2", 12)], "question string, doc_id int")
    c.put(r, now=at("2024-01-01 00:00:00"))
    c.put(r.where("doc_id = 11"), now=at("2024-01-01 00:10:00"))
    ask = lambda now: sorted((x.question, x.doc_id) for x in c.get(r.select("question"), now=at(now)).collect())
    assert ask("2024-01-01 00:11:00") == [("q1", 11), ("q2", 12)] and ask("2024-01-01 00:20:00") == [("q1", 11)] and ask("2024-01-01 01:00:00") == []


def test_text_helpers(spark):
    d = spark.createDataFrame([("12A(b)(1)", "ﬁ Ａ１", "[1.0]"), ("x", None, None)], "a string, b string, c string")
    r = d.select(text.section_key("a").alias("k"), text.nfkc("b").alias("n")).collect()
    assert [x.k for x in r] == ["12a:b:1", None] and [x.n for x in r] == ["fi A1", ""]
    v = spark.createDataFrame([([[1.0, 2.0], [3.0, 4.0], [9.0, 9.0]], [1, 1, 0])], "v array<array<double>>, m array<int>")
    assert v.select(mean_pooled(F.col("v"), F.col("m"))).first()[0] == [2.0, 3.0]
    assert spark.createDataFrame([("x" * 50 + "\n1 Intro ..... 3\n" + "body " * 60,)], "t string").select(parse.body_of_pages("t").alias("b")).first().b.startswith("body")
    assert spark.createDataFrame([("合同解除 ok",), ("plain words",)], "t string").select(text.tokens_by_lang("t").alias("t")).collect()[0].t[:1] == ["合同"]


def test_nothing_imports_the_extra_subpackage():
    import pathlib

    root = pathlib.Path(__file__).parent.parent / "quarry"
    for f in root.rglob("*.py"):
        if "llm" not in f.relative_to(root).parts:
            assert "llm" not in f.read_text().replace("llm_", ""), f


def test_containment_edges_equal_nested_loops(spark):
    docs = [(1, "the red cat sat"), (2, "a red catalog"), (3, "合同是协议"), (4, "redcat"), (5, None), (6, "The Red Cat sat on it"), (7, "--- x ---")]
    terms = [("red cat", 100, 0), ("the red cat sat", 1, 1), ("合同", 101, 2), ("cat", 102, 3), ("red", 103, 4), ("---", 104, 5), ("a", 105, 6), ("  ", 106, 7), ("at s", 107, 8), ("协议", 108, 9)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    t = spark.createDataFrame(terms, "term string, article long, term_pos int")
    got = {(r.src, r.dst) for r in graph.containment_edges(t, d).where("relation = 'defined_by'").collect()}
    assert got == {(i, a) for i, x in docs for w, a, _ in terms if x and w.strip() and w in x and i != a}


def test_holders_by_index_equal_nested_loops(spark):
    """Terms cut at either end, with apostrophes, in other cases and scripts: found in the postings or, without a whole word, in the texts."""
    docs = [(1, "the red cat sat, it's a dog's life"), (2, "a red catalog; rock'n'roll is old"), (3, "合同是协议 İstanbul is red"), (4, "redcat"), (5, None), (6, "The Red Cat sat on it"), (7, "--- x ---"), (7, "the x of x, the end"), (8, "ock 'n roll is old")]
    terms = ["red cat", "the red cat sat", "he red cat s", "合同", "red", "---", "  ", None, "ock'n'roll is o", "k'n'roll is old", "it's a dog's l", "s a dog's", "ed Cat sat o", "x of x", "stanbul is r", "no such words here", "'n roll is", "red cat sat"]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    t = spark.createDataFrame([(x, i) for i, x in enumerate(terms)], "term string, term_pos int")
    want = sorted({(i, k) for k, x in docs for i, w in enumerate(terms) if x and w and w.strip() and w in x})
    for index in (None, bm25.Index(d)):
        assert sorted((r.term_pos, r.doc_id) for r in graph.holders(t, d, index=index).collect()) == want


def test_graph_induced_makes_its_edges_once_and_from_the_index(spark, monkeypatch):
    from quarry.plans import queries_graph

    made, edges = [], queries_graph._edges
    monkeypatch.setattr(queries_graph, "_edges", lambda *a: made.append(edges(*a)) or made[-1])
    monkeypatch.setattr(graph, "_met_by_text", None, raising=False)  # no passage here lacks a whole word
    assert queries_graph.graph_induced(spark, "/root/testdata/sf0.001").count() > 0 and len(made) == 1


def test_walk_of_a_full_query_ends(spark):
    """Query 1 has its three nodes after a level, query 2 after two: deeper nodes are neither given nor looked for."""
    seeds = spark.createDataFrame([(1, 0, 1), (2, 10, 1)], "query_id int, node long, ord int")
    pairs = [(0, 1), (0, 2), (0, 3), (0, 4), (1, 5), (10, 11), (11, 12), (11, 13), (11, 14), (12, 15)]
    e = spark.createDataFrame([(a, b, "next", 1.0, i) for i, (a, b) in enumerate(pairs)], "src long, dst long, relation string, conf double, pos int")
    w = graph.walk(seeds, e, spark.range(20).withColumnRenamed("id", "node"), {"default": 3}, 3)
    assert sorted((r.query_id, r.ord, r.node, r.depth) for r in w.collect()) == [(1, 1, 1, 1), (1, 2, 2, 1), (1, 3, 3, 1), (2, 1, 11, 1), (2, 2, 12, 2), (2, 3, 13, 2)]


def test_search_is_dealt_by_tokens_too(spark, monkeypatch):
    """Few long chunks make as many deals as their tokens ask for; the hits are the same."""
    d = spark.createDataFrame([(i, " ".join(f"w{(i * k) % 37}" for k in range(200))) for i in range(40)], "doc_id long, text string")
    q = spark.createDataFrame([(1, "w1 w5 w9"), (2, "w0 w36")], "query_id int, text string")
    ix = bm25.Index(d)
    hits = lambda: sorted(map(tuple, ix.search(q, 7).collect()))
    whole, dealt, groups_ = hits(), [], F.lit
    monkeypatch.setattr(bm25, "DEAL_TOKENS", 500)
    monkeypatch.setattr(bm25.F, "lit", lambda x: dealt.append(x) or groups_(x))
    assert hits() == whole and 15 in dealt  # 40 chunks of 200 tokens, less 500 a deal: 16 deals, the last is 15
