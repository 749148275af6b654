import math
import random
from collections import Counter

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from quarry.llm import tokencount

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def pieces(spark):
    return tokencount.unigram(spark.read.parquet(f"{SF}/documents.parquet"))


def texts():
    return pq.read_table(f"{SF}/documents.parquet").column("text").to_pylist()


def plain(score, unknown, word):
    """Tokens of the best segmentation by the textbook DP over all pieces that end at each character."""
    s = tokencount.SPACE + word
    best = [(0, 0)]
    for e in range(1, len(s) + 1):
        of = [(best[e - 1][0] + unknown, best[e - 1][1] - len(s[e - 1].encode("utf-8", "surrogatepass")))]
        of += [(best[b][0] + score[s[b:e]], best[b][1] - 1) for b in range(max(0, e - 40), e) if s[b:e] in score]
        best.append(max(of))
    return -best[-1][1]


def test_trie_equals_plain_dp(pieces):
    c, score = tokencount.Counter(pieces), dict(pieces)
    rnd = random.Random(5)
    words = {w for x in texts() for w in x.split()}
    words |= {"".join(rnd.choice("abcé漢😀_\x00") for _ in range(rnd.randint(1, 60))) for _ in range(1500)}
    stem = "".join(rnd.choice("thean漢é") for _ in range(300))
    words |= {stem[: rnd.randint(1, 300)] + rnd.choice(["", "x", "the", "漢" * 50]) for _ in range(200)}
    words = sorted(words)
    c.learn(words)
    for w in rnd.sample(words, 3000) + [w for w in words if len(w) > 45]:
        assert c.known[w] == plain(score, c.unknown, w), w


def test_pretokens_are_those_of_split():
    texts = ["", " ", "a", " a  b\t", "x\x1cy\x85z", "é\u3000漢\u2028字 \u00a0", "\n\n", "end\n"] + ["x" + chr(i) + "y" for i in range(1, 0x3100)]
    for part in (pa.array(texts), pa.array(texts).slice(3, 5), pa.array([], pa.string())):
        ends, which, words = tokencount.pretokens(part)
        got = [[words[k] for k in which[s:e] if words[k]] for s, e in zip(ends, ends[1:])]
        assert got == [t.split() for t in part.to_pylist()]


def test_scores_are_shares_of_the_corpus(pieces):
    import public_tokenizers
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    n = Counter(p for t in texts() for w in t.split() for p in sp.encode(w, out_type=str))
    total = sum(n[p] + 1 for p, _ in pieces)
    assert len(pieces) > 30_000 and all(s == round(tokencount.SCALE * math.log((n[p] + 1) / total)) for p, s in pieces)


def test_scores_do_not_depend_on_how_rows_are_dealt(spark, pieces):
    assert tokencount.unigram(spark.read.parquet(f"{SF}/documents.parquet").repartition(7)) == pieces


def test_unigram_library_agrees(pieces):
    from tokenizers import Tokenizer, models

    c = tokencount.Counter(pieces)
    tk = Tokenizer(models.Unigram([("<unk>", 0.0)] + [(p, s / tokencount.SCALE) for p, s in pieces], unk_id=0))
    words = sorted({w for x in texts()[:40] for w in x.split() if w.isascii()})
    c.learn(words)
    same = sum(len(tk.encode(tokencount.SPACE + w).ids) == c.known[w] for w in words)
    assert same >= 0.99 * len(words)  # the library breaks ties of equal scores its own way


def test_shared_prefixes_are_scored_once(pieces):
    class Counting(dict):
        asked = 0

        def get(self, *a):
            Counting.asked += 1
            return super().get(*a)

    c = tokencount.Counter(pieces)
    c.score = Counting(c.score)
    stem = "abc" * 400
    c.learn([stem + x for x in "uvwxyz"])
    many, Counting.asked = Counting.asked, 0
    c.known.clear()
    c.learn([stem + "u"])
    assert many < 1.1 * Counting.asked


def test_small_cache_and_edges(spark, pieces):
    """Nulls, empty and very long texts, long pre-tokens, repeated rows, an empty table, columns of clashing names."""
    rows = [(1, "the cat  sat\n on"), (1, "the cat  sat\n on"), (2, None), (3, ""), (None, "x" * 5000 + " é"), (4, " \t"), (5, "a b " * 100_000), (6, "漢字" * 3000)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    for c in ("n_pretokens", "n_tokens", "piece", "n"):
        d = d.withColumn(c, F.lit("clash"))
    found = tokencount.token_counts(d, pieces=pieces).collect()
    assert len(found) == len(rows) and found[0].asDict().keys() == {"doc_id", "n_pretokens", "n_tokens"}
    got = {(r.doc_id, r.n_pretokens): r.n_tokens for r in found}
    c, score = tokencount.Counter(pieces, most=3), dict(pieces)
    for i, t in rows:
        n, total = c.texts([t or ""])
        words = Counter((t or "").split())
        assert got[i, n[0]] == total[0] == sum(k * plain(score, c.unknown, w) for w, k in words.items())
    assert tokencount.token_counts(d.limit(0)).collect() == []
    assert len({s for _, s in tokencount.unigram(d.limit(0))}) == 1
