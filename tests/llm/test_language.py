import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import language

SF = "/root/testdata/sf0.01"


def test_text_alone_finds_held_out_languages(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    model = language.fit(d.where("doc_id % 2 = 0"))
    got = language.identify(d.where("doc_id % 2 = 1").select("doc_id", "text", "lang"), model).collect()
    assert sum(r.lang == r.lang_id for r in got) >= 0.99 * len(got)
    assert all(r.keep for r in got)


def test_wrong_declaration_is_outvoted(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet").where("n_chars > 200")
    wrong = d.withColumn("lang2", F.when(F.col("lang") == "en", "fr").otherwise("en"))
    got = language.identify(wrong.select("doc_id", "text", "lang", "lang2", "source"), language.fit(d), declared="lang2", host="source").collect()
    assert sum(r.lang == r.lang_id for r in got) >= 0.99 * len(got)


def test_host_prior_by_hand(spark):
    rows = [(i, "the and of with that", "a.x.org", "x.org", "org") for i in range(30)] + [(99, "zz", "a.x.org", "x.org", "org"), (98, "zz", "b.y.org", "y.org", "org")]
    rows += [(200 + i, "der und ist nicht auch", "b.y.org", "y.org", "org") for i in range(30)]
    d = spark.createDataFrame(rows, "doc_id long, text string, host string, parent string, suffix string")
    train = spark.createDataFrame([(1, "the and of with that zz", "en"), (2, "der und ist nicht auch zz", "de")], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in language.identify(d, language.fit(train), host="host", parent="parent", suffix="suffix").collect()}
    assert got[99].lang_id == "en" and got[98].lang_id == "de"


def edge_rows(spark):
    rows = [(1, None, "en", "s"), (2, "", None, None), (3, "123 +++ 456", "en", "s"), (None, "the and of the", "xx", None), (5, "the and of the", "en", "s"), (5, "the and of the", "en", "s"), (6, "漢字テスト漢字漢字テスト漢字漢字テスト漢字" * 5, "en", "s"), (7, "und der die nicht auch " * 40_000, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")


def test_edges(spark):
    """Nulls in every column, empty and very long texts, repeated rows, an empty table, columns of clashing names."""
    d = edge_rows(spark)
    both = d.unionByName(spark.read.parquet(f"{SF}/documents.parquet").select(d.columns).where("doc_id > 9"))
    for c in ("keep", "lang_id", "confidence", "text_lang", "__n", "__h", "p2", "c", "hs", "bucket", "n", "fold"):
        both = both.withColumn(c, F.lit("clash"))
    got = language.documents_identified(both).where("doc_id < 9 or doc_id is null").collect()
    assert {(r.doc_id, r.keep) for r in got} == {(1, False), (2, False), (3, False), (None, True), (5, True), (6, False), (7, True)} and len(got) == 8
    assert all(r["__n"] == r.p2 == "clash" for r in got) and {r.lang_id for r in got if r.doc_id == 7} == {"de"}
    kept = language.kept(both).where("doc_id < 9 or doc_id is null").collect()
    assert sorted(map(str, (r.doc_id for r in kept))) == ["5", "5", "7", "None"] and kept[0].asDict().keys() == set(both.columns)
    assert language.documents_identified(d.limit(0)).collect() == [] == language.kept(d.limit(0)).collect()


def test_without_any_declaration_texts_with_letters_stay(spark):
    d = edge_rows(spark).withColumn("lang", F.lit(None).cast("string"))
    got = language.documents_identified(d).collect()
    assert {(r.doc_id, r.keep, r.lang_id) for r in got} == {(i, i in (None, 5, 6, 7), "und") for i in (1, 2, 3, None, 5, 6, 7)}
    assert language.kept(d).count() == 5


def plain(rows, langs, logp, folds):
    """(lang_id, confidence, text_lang) by the definition, a row at a time: rows of (text, declared, host, parent, suffix)."""
    k, text = len(langs), []
    for (t, *_), f in zip(rows, folds):
        low, ll, n = " " + (t or "").lower() + " ", np.zeros(k + 1), 0
        for i in range(1, len(low) - 1):
            if low[i].isalpha():
                n += 1
                ll += logp[f][language.grams([low[i - 1 : i + 2]])[0][0 if not low[i - 1].isalpha() else 1]].astype(float)
        ll *= min(n, language.EVIDENCE) / max(n, 1)
        text.append((n, ll, int(ll.argmax()) if n else k))
    tops = Counter(b for *_, b in text)
    total = [tops[i] for i in range(k)]
    level0 = [(x + 1) / (sum(total) + k) for x in total]
    by = {name: defaultdict(lambda: [0] * k) for name in "sph"}
    for (_, _, h, p, s), (_, _, b) in zip(rows, text):
        if b < k:
            by["s"][s][b] += 1
            by["p"][s, p][b] += 1
            by["h"][s, p, h][b] += 1
    smoothed = lambda c, q: [(x + language.SMOOTH * y) / (sum(c) + language.SMOOTH) for x, y in zip(c, q)]
    out = []
    for (_, d, h, p, s), (n, ll, b) in zip(rows, text):
        q = smoothed(by["s"][s], level0)
        q = q if p is None else smoothed(by["p"][s, p], q)
        own = [0] * k if h is None else [x - (i == b) for i, x in enumerate(by["h"][s, p, h])]
        q = smoothed(own, q)
        score = [ll[i] + math.log(q[i]) for i in range(k)] + [ll[k] + math.log(1e-3)]
        for said in (d and d.split("-")[0].lower(), language.SUFFIX_LANG.get((s or "").lower())):
            if said in langs:
                for i in range(k):
                    score[i] += math.log(language.TRUST if langs[i] == said else (1 - language.TRUST) / (k - 1))
        top = max(score)
        at = score.index(top) if n else k
        out.append(([*langs, "und"][at], 1 / sum(math.exp(x - top) for x in score) if n else 1.0, [*langs, "und"][b]))
    return out


def test_posterior_equals_the_plain_computation(spark):
    d = [r for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(60).collect()]
    hosts = [("a.x.de", "x.de", "de"), ("b.x.de", "x.de", "de"), ("www.y.fr", "y.fr", "fr"), ("z.example.com", "example.com", "com"), (None, None, None)]
    rows = []
    for i, r in enumerate(d):
        rows.append((r.text[: (30, 200, 5000)[i % 3]], (r.lang, "en-GB", None, "xx")[i % 4], *hosts[i * 7 % 5]))
    rows += [(None, "de", *hosts[0]), ("", None, *hosts[4]), ("12 34", "fr", *hosts[2]), ("ni ra to", None, *hosts[2]), ("ni ra to", None, *hosts[2])]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, text string, declared string, host string, parent string, suffix string")
    langs, logp = language.fit(spark.read.parquet(f"{SF}/documents.parquet"))
    folds = [r.f for r in df.select("doc_id", language.fold("text").alias("f")).orderBy("doc_id").collect()]
    want = plain(rows, langs, logp, folds)
    got = {r.doc_id: r for r in language.identify(df, (langs, logp), declared="declared", host="host", suffix="suffix", parent="parent").collect()}
    for i, (lang, confidence, text_lang) in enumerate(want):
        assert (got[i].lang_id, got[i].text_lang) == (lang, text_lang) and abs(got[i].confidence - confidence) < 1e-6, (i, rows[i])
        assert got[i].keep == (lang != "und")
    assert len({g.lang_id for g in got.values()}) >= 4


def test_suffix_and_domain_tell_where_the_text_does_not(spark):
    rows = [(i, "m", None, f"h{i}.{p}", p, p.split(".")[1]) for i, p in enumerate(["x.de", "x.fr", "x.es"])]
    rows += [(10 + i, "und der die nicht auch ist", None, f"g{i}.mixed.org", "mixed.org", "org") for i in range(50)] + [(99, "m", None, "new.mixed.org", "mixed.org", "org")]
    rows += [(200 + i, ("les des une qui dans est", "los una que las por para")[i % 2], None, None, None, None) for i in range(100)]
    d = spark.createDataFrame(rows, "doc_id long, text string, declared string, host string, parent string, suffix string")
    model = language.fit(spark.read.parquet(f"{SF}/documents.parquet"))
    got = {r.doc_id: r.lang_id for r in language.identify(d, model, declared="declared", host="host", suffix="suffix", parent="parent").collect()}
    assert [got[i] for i in (0, 1, 2, 99)] == ["de", "fr", "es", "de"]


def test_own_fold_is_unknown_to_the_model(spark):
    names = ["".join(chr(97 + (i * k) % 26) for k in (1, 3, 5, 7, 11)) for i in range(40)]
    rows = [(i, f"{x} and of", "en", "s") for i, x in enumerate(names)] + [(100, "und nicht", "de", "s")] * 9
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    langs, logp = language.fit(d)
    flat = logp[0][0, -1]
    for r in d.select("text", language.fold("text").alias("f")).distinct().collect():
        own, other = ({int(g) for g in language.grams([t])[0]} for t in (r.text, "and of"))
        if r.text == "und nicht":  # its only text: else the language would be lost
            assert all(logp[r.f][g, langs.index("de")] > flat + 1 for g in own)
        else:
            seen = {int(g) for x in d.where(language.fold("text") != r.f).select("text").collect() for g in language.grams([x.text])[0]}
            assert all((logp[r.f][g, langs.index("en")] > flat + 0.5) == (g in seen) for g in own) and other & own


def test_too_many_declarations_are_refused(spark):
    d = spark.createDataFrame([(i, "a b", f"l{i}", "s") for i in range(language.MOST_LANGUAGES + 1)], "doc_id long, text string, lang string, source string")
    with pytest.raises(ValueError):
        language.documents_identified(d)


def test_page_query(spark):
    got = language.page_language_id(spark, SF).collect()
    assert len(got) == 250 and sum(r.lang_id == r.declared for r in got) > 225
    rows = [(1, None, None), (2, "", ""), (3, "https://a.b.de/x", "<p>und der die nicht auch</p>"), (3, "https://a.b.de/x", "<p>und der die nicht auch</p>"), (None, "nonsense", "<html lang=DE-at><body>und der die</body>"), (5, "http://h.fr", "<html lang='fr'>" + "les des une " * 30_000)]
    p = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash")).withColumn("keep", F.lit("clash"))
    got = language.pages_identified(p.unionByName(spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url", "html", F.lit("").alias("text"), F.lit("").alias("keep")).where("page_id > 9"))).where("page_id < 9 or page_id is null").collect()
    assert {(r.page_id, r.lang_id) for r in got} >= {(1, "und"), (2, "und"), (3, "de"), (5, "fr")} and len(got) == 6
    assert language.pages_identified(p.limit(0)).collect() == []


def test_pages(spark):
    p = language.pages_evidence(spark.read.parquet(f"{SF}/pages.parquet"))
    model = language.fit(spark.read.parquet(f"{SF}/documents.parquet"))
    got = language.identify(p, model, declared="declared", host="host", suffix="suffix", parent="parent").collect()
    assert len(got) == 250 and sum(r.lang_id == r.declared for r in got) > 225


def test_rare_declared_languages_are_known(spark):
    rows = [(i, f"the and of with that {i}", "en", "s") for i in range(2000)] + [(5000 + i, "der und ist nicht auch", "de", "s") for i in range(3)] + [(None, "het een van dat niet", "nl", "s")] * 40
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    langs, picked = language.fitting_rows(d, 30)
    n = {r.lang: r["count"] for r in picked.groupBy("lang").count().collect()}
    assert langs == ["de", "en", "nl"] and n["de"] == 3 and 1 <= n["en"] <= 13 and n["nl"] == 1
    got = language.documents_identified(d, sample=30).collect()
    assert len(got) == len(rows) and all(r.keep and r.lang_id == r.lang for r in got)


def test_quota():
    assert language.quota({"a": 3, "b": 100, "c": 50}, 43) == 20 and language.quota({"a": 3, "b": 5}, 100) == 5
    assert language.quota({str(i): 9 for i in range(50)}, 10) == 1 and language.quota({}, 10) == 1
