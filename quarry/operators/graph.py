"""Citation graph: extraction, edges with budgets, walks, scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.scores import d, depth_decay, relation_weight
from ..functions.text import numeral, text_of
from ..sources.shared import stored

# Budgets of a node's edges, the widest range of a citation, characters of a number.
CAPS = {"cite": 20, "cited": 20, "defined_by": 10, "defines_term": 10}
TOTAL_CAP, WIDEST_RANGE = 60, 200
_NUM = "[0-9一二三四五六七八九十百千万两〇零]+"


def sequence_edges(chunks: DataFrame, group: list[str], order: list[str], key: str = "doc_id", bucket: Column | None = None) -> DataFrame:
    """(src, dst, relation, conf): prev and next in each group's order.

    One window for both; with `bucket`, a column that rises with the order, each window holds a bucket of a group, and the
    buckets' ends, a row each, are linked by a window of their own, so a group with most of the rows is spread."""
    o = F.struct(*order)
    c = chunks.select(key, *[x for x in dict.fromkeys([*group, *order]) if x != key], (bucket if bucket is not None else F.lit(0)).alias("__b"))
    w = Window.partitionBy(*group, "__b").orderBy(*order)
    n = c.select(key, *[x for x in group if x != key], "__b", F.lag(key).over(w).alias("p"), F.lead(key).over(w).alias("n"))
    if bucket is not None:
        ends = c.groupBy(*group, "__b").agg(F.min_by(key, o).alias("first"), F.max_by(key, o).alias("last"))
        by = Window.partitionBy(*group).orderBy("__b")
        ends = ends.select(*[F.col(g).alias(f"__{g}") for g in group], F.col("__b").alias("__c"), F.lag("last").over(by).alias("before"), F.lead("first").over(by).alias("after"))
        on = F.col("__b") == F.col("__c")
        for g in group:
            on = on & F.col(g).eqNullSafe(F.col(f"__{g}"))
        n = n.join(ends, on).select(key, F.coalesce("p", "before").alias("p"), F.coalesce("n", "after").alias("n"))
    return n.select(F.col(key).alias("src"), F.inline(F.array(F.struct(F.col("p").alias("dst"), F.lit("prev").alias("relation")), F.struct(F.col("n").alias("dst"), F.lit("next").alias("relation"))))).where("dst is not null").withColumn("conf", d(1))


def citations(chunks: DataFrame, key: str = "article_id", text: str = "text") -> DataFrame:
    """(src, ref, conf): references of each chunk. Ranges give each member (at most WIDEST_RANGE wide), then single ones.

    ref is a decimal article number for Chinese markers, and section:<id> or article:<n> for English ones. After a
    section sign a hyphen belongs to the id (§ 2-201), so only a dash or a word makes a range there."""
    t = text_of(text)
    zh_range = F.transform(F.regexp_extract_all(t, F.lit(f"第\\s*{_NUM}\\s*条\\s*(?:至|到)\\s*第\\s*{_NUM}\\s*条"), F.lit(0)), lambda m: F.struct(numeral(F.regexp_extract(m, f"第\\s*({_NUM})", 1)).alias("lo"), numeral(F.regexp_extract(m, f"(?:至|到)\\s*第\\s*({_NUM})", 1)).alias("hi"), F.lit("").alias("pre"), d(0.95).alias("conf")))
    en_range = F.transform(
        F.regexp_extract_all(t, F.lit("(?i)(?:(?:Section|Sec\\.?|Article|Art\\.?)\\s+\\d+\\s*(?:–|-|to|through)|§{1,2}\\s*\\d+\\s*(?:–|to|through))\\s*\\d+"), F.lit(0)),
        lambda m: F.struct(F.regexp_extract(m, "(\\d+)\\s*(?:–|-|to|through)", 1).cast("long").alias("lo"), F.regexp_extract(m, "(\\d+)$", 1).cast("long").alias("hi"), F.when(m.rlike("(?i)^art"), "article:").otherwise("section:").alias("pre"), d(0.85).alias("conf")),
    )
    wide = lambda r: (r["lo"] <= r["hi"]) & (r["hi"] - r["lo"] <= WIDEST_RANGE)
    members = F.flatten(F.transform(F.filter(F.concat(zh_range, en_range), wide), lambda r: F.transform(F.sequence(r["lo"], r["hi"]), lambda n: F.struct(F.concat(r["pre"], n.cast("string")).alias("ref"), r["conf"].alias("conf")))))
    one = lambda pattern, group, pre, conf, f=lambda x: x: F.transform(F.regexp_extract_all(t, F.lit(pattern), F.lit(group)), lambda m: F.struct(F.concat(F.lit(pre), f(m)).alias("ref"), d(conf).alias("conf")))
    singles = F.concat(
        one(f"第\\s*({_NUM})\\s*条", 1, "", 0.90, lambda m: numeral(m).cast("string")),
        one("(?i)(?:Section|Sec\\.?)\\s+(\\d+(?:\\.\\d+)*)", 1, "section:", 0.85),
        one("(?i)Article\\s+(\\d+)", 1, "article:", 0.85),
        one("§\\s*(\\d+(?:-\\d+)*)", 1, "section:", 0.85),
    )
    return chunks.select(F.col(key).alias("src"), F.inline(F.concat(members, singles))).where("ref is not null")


def resolved(refs: DataFrame, keys: DataFrame) -> DataFrame:
    """(src, dst, relation, conf) of refs(src, ref, conf) against keys(ref, article_id): exact, else the part before the
    first dot or dash of the id. Each citation also gives its reverse."""
    prefix = F.regexp_replace(F.col("ref"), "[.-].*$", "")
    k1, k2 = keys.select("ref", F.col("article_id").alias("a1")), keys.select(F.col("ref").alias("pre"), F.col("article_id").alias("a2"))
    r = refs.join(k1, "ref", "left").withColumn("pre", prefix).join(k2, "pre", "left").withColumn("dst", F.coalesce("a1", "a2")).where("dst is not null and dst <> src")
    both = F.array(F.struct(F.col("src").alias("s"), F.col("dst").alias("t"), F.lit("cite").alias("relation")), F.struct(F.col("dst").alias("s"), F.col("src").alias("t"), F.lit("cited").alias("relation")))
    return r.groupBy("src", "dst").agg(F.max("conf").alias("conf")).select(F.inline(both), "conf").select(F.col("s").alias("src"), F.col("t").alias("dst"), "relation", "conf")


def definitions(chunks: DataFrame, key: str = "article_id", text: str = "text") -> DataFrame:
    """(article, term, conf): terms a chunk defines, the greatest confidence of each."""
    t = text_of(text)
    many = lambda p, conf, low, high, stop: F.transform(F.filter(F.transform(F.regexp_extract_all(t, F.lit(p), F.lit(1)), lambda x: F.trim(x)), lambda x: (F.length(x) >= low) & (F.length(x) <= high) & ~x.isin(*stop)), lambda x: F.struct(x.alias("term"), d(conf).alias("conf")))
    zh, en = rules.TERM_STOPWORDS_ZH, rules.TERM_STOPWORDS_EN
    found = F.concat(
        many("(?:本法|本章|本节|本编|本条)?\\s*所称\\s*([^，。；:：\\n]{1,30}?)\\s*(?:[，,:：]\\s*)?是指", 0.95, 2, 20, zh),
        many("(?<!所称)(?<=^|[，。；:：\\n])([^，。；:：\\n]{2,30}?)\\s*是指", 0.60, 2, 12, zh),
        many("[“\"]([^”\"]{1,60})[”\"]\\s+(?i:means|shall mean)\\b", 0.95, 2, 50, en),
        many("\\b([A-Z][A-Za-z0-9\\-_ ]{1,40}?)\\s+(?:means|shall mean)\\b", 0.70, 2, 40, en),
    )
    return chunks.select(F.col(key).alias("article_id"), F.inline(found)).groupBy("article_id", "term").agg(F.max("conf").alias("conf"))


def registered(defs: DataFrame, position: DataFrame, least: float = 0.8, key: str = "article_id") -> DataFrame:
    """(term, article): the first article, by pos, that defines each term with enough confidence."""
    return defs.where(F.col("conf") >= least).join(position, key).groupBy("term").agg(F.min_by(key, F.struct("pos", key)).alias(key))


def _met_by_text(t: DataFrame, chunks: DataFrame, key: str, text: str) -> DataFrame:
    """(__tid, key): chunks that may hold a term of t(__tid, term), found through the words of all texts.

    A term meets, by an equi-join, only the chunks with the rarest of its inner words (neither first nor last), or with its
    first CJK character, or, if it has no word either, with its first other mark. A term without any of these meets the
    chunks with a word that contains its longest word, found among the distinct words by three characters of it."""
    word, cjk, other = F.lit("[a-z0-9]+"), F.lit("[\\u4e00-\\u9fff]"), F.lit("[^A-Za-z0-9\\s\\u4e00-\\u9fff]")
    words = lambda c: F.regexp_extract_all(F.lower(c), word, F.lit(0))
    chars = lambda c: F.regexp_extract_all(c, cjk, F.lit(0))
    marks = lambda c: F.regexp_extract_all(c, other, F.lit(0))
    body = text_of(text)
    cw = chunks.select(key, F.explode(F.array_distinct(F.concat(words(body), chars(body), marks(body)))).alias("g"))
    tw = words(F.col("term"))
    inner = F.slice(tw, 2, F.greatest(F.size(tw) - 2, F.lit(0)))
    first = lambda a: F.slice(a, 1, 1)
    term = F.col("term")
    keys = F.when(F.size(inner) > 0, F.array_distinct(inner)).when(F.size(chars(term)) > 0, first(chars(term))).when(F.size(tw) == 0, first(marks(term))).otherwise(F.array().cast("array<string>"))
    t = t.withColumn("keys", keys)
    often = cw.join(t.select(F.explode("keys").alias("g")).distinct(), "g", "left_semi").groupBy("g").agg(F.count("*").alias("df"))
    rare = t.where(F.size("keys") > 0).select("__tid", F.explode("keys").alias("g")).join(often, "g").groupBy("__tid").agg(F.min_by("g", F.struct("df", "g")).alias("g"))
    rest = t.where("size(keys) = 0").withColumn("w", F.get(F.array_sort(F.transform(tw, lambda x: F.struct((-F.length(x)).alias("n"), x.alias("w")))), F.lit(0))["w"])
    rest = rest.where("w is not null").withColumn("gram", F.substring("w", 1, 3))
    grams = lambda c: F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.array(F.substring(c, i, F.lit(1)), F.substring(c, i, F.lit(2)), F.substring(c, i, F.lit(3))))))
    if not rest.isEmpty():
        asked = F.broadcast(rest.select("gram").distinct())  # at most 36 ** 3 and fewer, as grams are letters and digits
        some = cw.select("g").distinct().where(F.col("g").rlike("^[a-z0-9]+$")).select("g", F.explode(grams(F.col("g"))).alias("gram")).join(asked, "gram", "left_semi")
        rare = rare.unionByName(rest.join(some, "gram").where(F.col("g").contains(F.col("w"))).select("__tid", "g"))
    return rare.join(cw, "g").select("__tid", key)


def holders(terms: DataFrame, chunks: DataFrame, key: str = "doc_id", text: str = "text", index=None) -> DataFrame:
    """terms(term, ...) with the key of every chunk whose text holds the term, each once. Blank terms are in no text.

    What lies inside a term lies whole in a text that holds it. With `index`, a bm25.Index of the chunks made with
    tokens(), a term that has a word between two marks that are no apostrophes, which is a token wherever the term is,
    meets the chunks in the postings of the rarest of these; the words of all texts are then gone through only if a
    term has none. So terms and texts are never all paired, and only texts that met a term are compared with it."""
    t = stored(terms.where(F.trim(text_of("term")) != "").distinct().withColumn("__tid", F.monotonically_increasing_id()))
    rest, met = t, None
    if index is not None:
        t = t.withColumn("__w", F.array_distinct(F.regexp_extract_all(F.lower("term"), F.lit("(?<=[^a-z0-9'])[a-z0-9]+(?=[^a-z0-9'])"), F.lit(0))))
        rest, w = t.where("size(__w) = 0").drop("__w"), stored(t.select("__tid", F.explode("__w").alias("g")))
        t = t.drop("__w")
        rare = stored(index.terms.select(F.col("term").alias("g"), "df").join(w, "g").groupBy("__tid").agg(F.min_by("g", F.struct("df", "g")).alias("g")))
        met = index.post.select(F.col("term").alias("g"), key).join(rare, "g").select("__tid", key)
    if met is None or not rest.isEmpty():
        others = _met_by_text(rest.select("__tid", "term"), chunks, key, text)
        met = others if met is None else met.unionByName(others)
    met = stored(met.distinct())
    some = chunks.select(key, F.col(text).alias("__t")).join(met.select(key).distinct(), key, "left_semi")
    return met.join(t, "__tid").join(some, key).where(F.col("__t").contains(F.col("term"))).select(*terms.columns, key).distinct()


def term_edges(held: DataFrame, cap: int = 10, key: str = "doc_id") -> DataFrame:
    """(src, dst, relation, conf) of held(term, article, term_pos, key): defined_by and its reverse; at most `cap` terms a
    chunk, the longest first."""
    w = Window.partitionBy(key).orderBy(F.length("term").desc(), "term_pos")
    top = held.where(F.col(key) != F.col("article")).withColumn("n", F.row_number().over(w)).where(F.col("n") <= cap).withColumn("conf", F.when(F.length("term") >= 4, d(0.90)).otherwise(d(0.85)))
    both = F.array(F.struct(F.col(key).alias("src"), F.col("article").alias("dst"), F.lit("defined_by").alias("relation")), F.struct(F.col("article").alias("src"), F.col(key).alias("dst"), F.lit("defines_term").alias("relation")))
    return top.select(F.inline(both), "conf").distinct()


def containment_edges(terms: DataFrame, chunks: DataFrame, cap: int = 10, key: str = "doc_id", text: str = "text", index=None) -> DataFrame:
    """term_edges() of all chunks whose text holds a term. terms(term, article, term_pos)."""
    return term_edges(holders(terms.select("term", "article", "term_pos"), chunks, key, text, index), cap, key)


def budgeted(candidates: DataFrame, caps: dict = CAPS, total: int = TOTAL_CAP) -> DataFrame:
    """candidates(src, dst, relation, conf, seq) -> edges(src, dst, relation, conf, pos) after the per-node budget.

    In the order of seq an edge is admitted while the node's list is shorter than its relation's cap (the total cap for
    others); a repeated edge raises the confidence, but only while the list is below the cap. As the list can only grow
    to `total`, a node's state is small: candidates are folded in order by one aggregate. What can't be admitted and exact
    repeats go beforehand, so the fold of a hub with any number of candidates sees at most its caps' number of neighbours
    a relation, each once a confidence."""
    cap = F.lit(total)
    for r, n in caps.items():
        cap = F.when(F.col("relation") == r, F.lit(min(n, total))).otherwise(cap)
    # a list at a relation's cap stays there, so of each relation only the first `cap` neighbours can ever be admitted
    w = Window.partitionBy("src", "relation").orderBy("first", "dst")
    can = candidates.groupBy("src", "relation", "dst").agg(F.min("seq").alias("first")).withColumn("n", F.row_number().over(w)).where(F.col("n") <= cap)
    c = candidates.join(can.select("src", "relation", "dst"), ["src", "relation", "dst"], "left_semi")
    c = c.groupBy("src", "dst", "relation", "conf").agg(F.min("seq").alias("seq")).withColumn("cap", cap)
    kind = "array<struct<dst:bigint,relation:string,conf:double>>"
    dst_type = candidates.schema["dst"].dataType.simpleString()
    kind = kind.replace("bigint", dst_type)
    g = c.withColumn("x", F.struct("seq", "dst", "relation", "conf", "cap")).groupBy("src").agg(F.sort_array(F.collect_list("x")).alias("xs"))

    def step(a, x):
        same = lambda e: (e["dst"] == x["dst"]) & (e["relation"] == x["relation"])
        raised = F.transform(a, lambda e: F.struct(e["dst"].alias("dst"), e["relation"].alias("relation"), F.when(same(e), F.greatest(e["conf"], x["conf"])).otherwise(e["conf"]).alias("conf")))
        return F.when(F.size(a) >= x["cap"], a).when(F.exists(a, same), raised).otherwise(F.concat(a, F.array(F.struct(x["dst"].alias("dst"), x["relation"].alias("relation"), x["conf"].alias("conf")))))

    g = g.withColumn("e", F.aggregate("xs", F.array().cast(kind), step))
    return g.select("src", F.posexplode("e").alias("pos", "e")).select("src", "e.dst", "e.relation", "e.conf", "pos").where("src <> dst")


def searchable(chunks: DataFrame, lang: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Vertices (node) a walk may emit: chunks with text, of the language asked for (a chunk without one counts as zh)."""
    ok = F.trim(text_of(text)) != ""
    if lang:
        ok = ok & (F.lower(F.trim(F.coalesce(F.nullif("lang", F.lit("")), F.lit("zh")))) == lang.lower())
    return chunks.where(ok).select(F.col(key).alias("node"))


def built(chunks: DataFrame, group: list[str], order: list[str], caps: dict = CAPS, total: int = TOTAL_CAP, key: str = "article_id", text: str = "text") -> DataFrame:
    """edges(src, dst, relation, conf, pos) of a corpus: neighbours in each group's order, citations resolved to the
    chunks they name (`ref` of a chunk is its key), terms defined and used, all within the nodes' budgets, in this order.

    chunks(key, text, ...); every source of edges is one join or window, the budget one fold a node."""
    seq = sequence_edges(chunks, group, order, key)
    refs = citations(chunks, key, text)
    keys = chunks.select(F.col(key).cast("string").alias("ref"), F.col(key).alias("article_id"))
    keys = keys.unionByName(keys.select(F.concat(F.lit("section:"), "ref").alias("ref"), "article_id"))
    cite = resolved(refs, keys)
    place = chunks.select(key, F.struct(*order).alias("pos"))
    terms = registered(definitions(chunks, key, text).withColumnRenamed("article_id", key), place, key=key)
    use = containment_edges(terms.select("term", F.col(key).alias("article"), F.xxhash64("term").alias("term_pos")), chunks, caps.get("defined_by", total), key, text)
    c = None
    for n, e in enumerate((seq, cite, use)):
        w = Window.partitionBy("src").orderBy("relation", "dst")
        e = e.select("src", "dst", "relation", "conf").withColumn("seq", F.row_number().over(w) + n * 10**9)
        c = e if c is None else c.unionByName(e)
    return budgeted(c.withColumn("seq", F.col("seq").cast("long")), caps, total)


def imported(nodes: DataFrame) -> DataFrame:
    """edges(src, dst, relation, conf, pos) from node rows (article_id, id, neighbors as a JSON array of strings or
    objects): the id may stand under either name; missing relations are `neighbor`, missing or zero confidences 1."""
    src = F.coalesce(F.nullif(F.trim("article_id"), F.lit("")), F.nullif(F.trim("id"), F.lit("")))
    n = nodes.withColumn("src", src).where("src is not null").select("src", F.posexplode(F.from_json("neighbors", "array<variant>")).alias("pos", "v"))
    get = lambda name, kind: F.try_variant_get("v", f"$.{name}", kind)
    conf = F.coalesce(F.nullif(get("conf", "double"), d(0)), d(1))
    dst = F.coalesce(get("article_id", "string"), F.when(F.schema_of_variant("v") == "STRING", F.try_variant_get("v", "$", "string")))
    return n.select("src", dst.alias("dst"), F.coalesce(get("relation", "string"), F.lit("neighbor")).alias("relation"), conf.alias("conf"), "pos").where("dst is not null and trim(dst) <> ''")


def walk(seeds: DataFrame, edges: DataFrame, vertices: DataFrame, depths: dict = rules.WALK_DEPTHS, limit: int = 800, relations: list[str] | None = None, least_conf: float = 0.0, qid: str = "query_id") -> DataFrame:
    """Breadth-first walks of all queries at once: (query, node, depth, parent, relation, conf, ord).

    seeds(query, node, ord); edges(src, dst, relation, conf, pos); vertices(node). A level joins the frontier with the
    edges, drops visited nodes and keeps each new one's first discoverer (frontier order, then edge order). Nodes beyond
    the vertices count as visited but are not emitted. How far a walk goes on depends on the relation that found a node.
    At most `limit` nodes a query, in order of discovery; a query that has them goes no further. The loop ends after the
    greatest depth; each level is written to the shared folder, so the plan of a level doesn't hold the levels before."""
    e = edges
    if least_conf > 0:
        e = e.where(F.col("conf") >= least_conf)
    if relations:
        e = e.where(F.col("relation").isin(*relations))
    default = depths.get("default", 2)

    def allowed(rel: Column) -> Column:
        out = F.lit(default)
        for r, n in depths.items():
            if r != "default":
                out = F.when(rel == r, n).otherwise(out)
        return F.when(rel.isNull(), default).otherwise(out)

    first = Window.partitionBy(qid, "node").orderBy("ord")
    frontier = seeds.withColumn("n", F.row_number().over(first)).where("n = 1").select(qid, "node", "ord", F.lit(None).cast("string").alias("relation"))
    visited = frontier.select(qid, "node")
    out = None
    for level in range(max(depths.values())):
        f = frontier.where(allowed(F.col("relation")) > level).select(qid, F.col("node").alias("src"), F.col("ord").alias("pord"))
        c = f.join(e, "src").select(qid, F.col("dst").alias("node"), F.col("src").alias("parent"), "relation", "conf", "pord", "pos").join(visited, [qid, "node"], "left_anti")
        w = Window.partitionBy(qid, "node").orderBy("pord", "pos")
        new = stored(c.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n"))
        if new.isEmpty():
            break
        real = new.join(vertices.select("node"), "node", "left_semi")
        order = Window.partitionBy(qid).orderBy("pord", "pos")
        level_rows = stored(real.withColumn("k", F.row_number().over(order)).select(qid, "node", F.lit(level + 1).alias("depth"), "parent", "relation", "conf", "k").where(F.col("k") <= limit))
        out = level_rows if out is None else out.unionByName(level_rows)
        visited = visited.unionByName(new.select(qid, "node"))
        full = out.groupBy(qid).agg(F.count("*").alias("n")).where(F.col("n") >= limit).select(qid)
        frontier = level_rows.join(full, qid, "left_anti").select(qid, "node", F.col("k").alias("ord"), "relation")
    if out is None:
        return seeds.limit(0).select(qid, "node", F.lit(1).alias("depth"), F.col("node").alias("parent"), F.lit("").alias("relation"), d(1).alias("conf"), F.lit(1).alias("ord"))
    w = Window.partitionBy(qid).orderBy("depth", "k")
    return out.withColumn("ord", F.row_number().over(w)).where(F.col("ord") <= limit).drop("k")


def neighbours(seeds: DataFrame, edges: DataFrame, vertices: DataFrame, depth: int, qid: str = "query_id") -> DataFrame:
    """All nodes within `depth` steps, whatever the relations."""
    return walk(seeds, edges, vertices, {"default": depth}, limit=2**31 - 1, qid=qid)


def scored(walked: DataFrame, semantic: Column, gamma: float = 0.7) -> DataFrame:
    """walked with score = semantic * (1 + depth)^-gamma * relation weight * confidence."""
    s = walked.withColumn("semantic", semantic).withColumn("decay", depth_decay(F.col("depth"), gamma)).withColumn("rel_weight", relation_weight(F.array("relation")))
    return s.withColumn("score", F.col("semantic") * F.col("decay") * F.col("rel_weight") * F.coalesce(F.nullif("conf", d(0)), d(1)))


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among nodes(node)."""
    return edges.join(nodes.select(F.col("node").alias("src")).distinct(), "src", "left_semi").join(nodes.select(F.col("node").alias("dst")).distinct(), "dst", "left_semi").select(edges.columns)
