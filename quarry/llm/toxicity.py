"""Toxicity: Levenshtein automata intersected with a lexicon trie, scored over context windows."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textops
from .common import in_arrow, slices, stored, table
from .labelled import held_out, scored, training_rows

SAMPLE = 20_000  # labelled rows the lexicon and weights are learned from, at most
HELD_OUT = (3, 1)
CUT = 0.7
WINDOW = 12  # words on either side of a hit
SHORTEST, LONGEST = 4, 12  # characters of a learned stem
EDGE = "".join(map(chr, range(33, 48))) + ":;<=>?[\\]^_`{|}~«»“”„‘’…–—¿¡"
QUOTES = '"“”„«»'
#: Words that report what others said, in the languages of the tables.
REPORTING = {"said", "says", "called", "calls", "wrote", "writes", "quoted", "quote", "word", "term", "insult", "slur", "dit", "appelle", "mot", "sagte", "nannte", "wort", "dijo", "llamó", "palabra"}


STRONG = 0.9  # share of toxic rows among a term's, from which one hit means much
LIFT = 5.0  # standard deviations by which a term's toxic rows exceed chance

#: A lexicon entry: spelling; whether longer words that begin with it count; whether it is strong.
Term = tuple[str, bool, bool]


def edits(term: Term) -> int:
    """Misspellings allowed: none under 4 characters, for stems and for terms that are not strong; one under 9; else two."""
    word, stem, strong = term
    return 0 if stem or not strong or len(word) < 4 else 1 if len(word) < 9 else 2


class Automaton:
    """The Levenshtein automata of all lexicon terms, run together over the terms' trie and determinised as needed.

    A state is a set of (trie node, edits so far, character owed by a swap); insertions, deletions, replacements and
    swaps of neighbours cost one edit. A stem accepts as soon as a prefix of the word is close enough to it, a word only
    at the word's end. Most words fall into the empty state after a few characters."""

    def __init__(self, terms: list[Term]):
        self.child: list[dict[str, int]] = [{}]
        self.room, self.ends = [0], [()]  # most edits of any term below; (term, is stem) of those that end here
        for k, (term, stem, _) in enumerate(terms):
            at, most = 0, edits(terms[k])
            self.room[0] = max(self.room[0], most)
            for c in term:
                if c not in self.child[at]:
                    self.child[at][c] = len(self.child)
                    self.child.append({})
                    self.room.append(0)
                    self.ends.append(())
                at = self.child[at][c]
                self.room[at] = max(self.room[at], most)
            self.ends[at] += ((k, stem),)
        self.terms = terms
        self.states: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.step: list[dict[str, int]] = []
        self.stem_hit: list = []
        self.word_hit: list = []
        self.alphabet = {c for t, *_ in terms for c in t}
        self.start = self._state({(0, 0, "")})

    def _state(self, items: set) -> int:
        todo, full = list(items), set(items)
        while todo:  # deletions: skip a character of the term
            node, e, owed = todo.pop()
            if owed:
                continue
            for x in self.child[node].values():
                if e + 1 <= self.room[x] and (x, e + 1, "") not in full:
                    full.add((x, e + 1, ""))
                    todo.append((x, e + 1, ""))
        least: dict = {}
        for node, e, owed in full:
            if e < least.get((node, owed), 9):
                least[node, owed] = e
        key = frozenset((n, e, o) for (n, o), e in least.items())
        if key not in self.states:
            self.states[key] = len(self.sets)
            self.sets.append(key)
            self.step.append({})
            ends = [(e, k, stem) for n, e, o in key if not o for k, stem in self.ends[n] if e <= edits(self.terms[k])]
            self.stem_hit.append(min(((e, k) for e, k, stem in ends if stem), default=None))
            self.word_hit.append(min(((e, k) for e, k, _ in ends), default=None))
        return self.states[key]

    def _next(self, state: int, c: str) -> int:
        new = set()
        for node, e, owed in self.sets[state]:
            if owed:
                if c == owed:
                    new.add((node, e, ""))
                continue
            if e + 1 <= self.room[node]:
                new.add((node, e + 1, ""))  # insertion
            for x, y in self.child[node].items():
                if x == c:
                    new.add((y, e, ""))
                elif e + 1 <= self.room[y]:
                    new.add((y, e + 1, ""))  # replacement
                    z = self.child[y].get(c)
                    if z is not None and e + 1 <= self.room[z]:
                        new.add((z, e + 1, x))  # swap: x must follow
        return self._state(new)

    def match(self, word: str) -> tuple[int, int] | None:
        """(edits, term) of the best term the word matches, or None."""
        state, best = self.start, None
        for c in word:
            c = c if c in self.alphabet else "\x00"
            step = self.step[state]
            nxt = step.get(c)
            if nxt is None:
                nxt = step[c] = self._next(state, c)
            state = nxt
            if not self.sets[state]:
                return best
            hit = self.stem_hit[state]
            if hit is not None and (best is None or hit < best):
                best = hit
        hit = self.word_hit[state]
        return hit if hit is not None and (best is None or hit < best) else best


def bare(word: str) -> str:
    return word.strip(EDGE).lower()


def _count_prefixes(batches):
    for b in slices(batches):
        pos: dict[str, int] = {}
        neg: dict[str, int] = {}
        for t, y in zip(b.column("text").to_pylist(), b.column("y").to_pylist()):
            seen = set()
            for w in {bare(x) for x in set(t.split())}:
                if len(w) >= SHORTEST:
                    seen.update(w[:k] for k in range(SHORTEST, min(len(w), LONGEST) + 1))
                if len(w) > 2:
                    seen.add(w + "$")
            into = pos if y else neg
            for p in seen:
                into[p] = into.get(p, 0) + 1
        both = [*pos, *(p for p in neg if p not in pos)]
        yield pa.RecordBatch.from_arrays([pa.array(both, pa.string()), pa.array([pos.get(p, 0) for p in both], pa.int64()), pa.array([neg.get(p, 0) for p in both], pa.int64())], names=["p", "pos", "neg"])


def telling(pos, neg, prior: float, lift: float = LIFT):
    """Whether a prefix's toxic rows are far more than chance gives, and a good share of its rows; columns or numbers."""
    total = pos + neg
    return (pos >= 0.3 * total) & ((pos - prior * total) * (pos - prior * total) >= lift * lift * prior * (1 - prior) * total) & (pos > prior * total)


def least_rows(positives: int) -> int:
    return max(4, math.ceil(0.004 * positives))


def choose(counts: dict[str, tuple[int, int]], positives: int, negatives: int, lift: float = LIFT) -> list[Term]:
    """The shortest telling prefixes, each grown while one longer prefix (or the whole word, spelled with $) still covers
    nearly all of its toxic rows; and, below a stem that is not strong, whatever is strong by itself. Below a strong stem, which takes
    no misspellings, the strong whole words stay as entries that do."""
    least, prior = least_rows(positives), positives / max(1, positives + negatives)
    good = {p for p, (a, b) in counts.items() if a >= least and telling(a, b, prior, lift)}
    longer: dict[str, list[str]] = {}
    for p in good:
        longer.setdefault(p[:-1], []).append(p)
    strong = lambda p: counts[p][0] >= STRONG * sum(counts[p])
    out, covered = set(), {}
    for p in sorted(good, key=lambda p: (len(p), p)):
        above = covered.get(p[:-1])
        if above is not None and (above or not strong(p)):
            covered[p] = above
            if p.endswith("$") and strong(p):
                out.add((p[:-1], False, True))
            continue
        q = p
        while not q.endswith("$"):
            grown = [r for r in longer.get(q, ()) if counts[r][0] >= 0.95 * counts[p][0]]
            if not grown:
                break
            q = max(grown, key=lambda r: (counts[r][0], r))
        covered[p] = strong(q)
        out.add((q.rstrip("$"), not q.endswith("$"), strong(q)))
    return sorted(out)


class Matcher:
    def __init__(self, terms: list[Term], innocent: frozenset, most: int = 300_000):
        self.auto, self.innocent, self.most = Automaton(terms), innocent, most
        self.seen: set[str] = set()
        self.hits: dict[str, tuple[int, int]] = {}  # raw word: (edits, term)

    def hit_words(self, words: set[str]) -> None:
        new = words - self.seen
        if len(self.seen) + len(new) > self.most:
            self.seen.clear()
            self.hits.clear()
            new = words
        self.seen |= new
        for raw in new:
            w = bare(raw)
            if len(w) > 2 and (m := self.auto.match(w)) is not None and (m[0] == 0 or w not in self.innocent):
                self.hits[raw] = m

    def features(self, texts: list[str]) -> np.ndarray:
        """Per text: strong exact and misspelled hits, plain and quoted, and weak hits (logs); distinct weak words,
        distinct terms, the most hits in one window (logs); hits a 100 words; whether there are two strong, two weak ones.
        A hit is quoted if it lies between quotation marks within its window or follows a reporting word closely."""
        out = np.zeros((len(texts), 11))
        for k, t in enumerate(texts):
            words = t.split()
            pool = set(words)
            self.hit_words(pool)
            if self.hits.keys().isdisjoint(pool):
                continue
            at = [(i, *self.hits[w]) for i, w in enumerate(words) if w in self.hits]
            n, weak = [0, 0, 0, 0], []
            for i, e, m in at:
                if not self.auto.terms[m][2]:
                    weak.append(words[i])
                    continue
                before, own = words[max(0, i - WINDOW) : i], words[i]
                open_ = sum(sum(map(w.count, QUOTES)) for w in before) % 2 == 1 or own[0] in QUOTES
                close = own.rstrip(".,;:!?")[-1:] in tuple(QUOTES) or any(any(q in w for q in QUOTES) for w in words[i + 1 : i + 1 + WINDOW])
                told = any(bare(w) in REPORTING for w in before[-3:])
                n[2 * ((open_ and close) or told) + (e > 0)] += 1
            place = np.array([i for i, *_ in at])
            most = int((np.searchsorted(place, place + WINDOW, "right") - np.arange(len(place))).max())
            logs = np.log1p([*n, len(weak), len(set(weak)), len({m for *_, m in at}), most])
            out[k] = [*logs, 100 * len(at) / len(words), n[0] + n[1] > 1, len(weak) > 1]
        return out


def _matcher(model) -> Matcher:
    key = (tuple(model["terms"]), model["innocent"])
    if _MADE.get("key") != key:
        _MADE.update(key=key, matcher=Matcher(model["terms"], model["innocent"]))
    return _MADE["matcher"]


_MADE: dict = {}


def _distinct(rows: DataFrame) -> DataFrame:
    """Rows whose least shingle hash no other row of the label has: of near copies few stay, so a document that was
    copied often doesn't make its rare words look like terms. Of rows that share it the text of the least SHA-256 stays,
    however the rows are dealt. Written to the shared folder; `sample` rows at most."""

    def run(batches):
        for b in slices(batches):
            t = b.column("text").to_pylist()
            h = [textops.shingles(*textops.words([x]), 5)[0] for x in t]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([int(x.min().view(np.int64)) if len(x) else 0 for x in h], pa.int64())], names=[*b.schema.names, "least"])

    return stored(rows.select("text", "y").transform(in_arrow, run, "text string, y double, least long").groupBy("least", "y").agg(F.min_by("text", F.sha2("text", 256)).alias("text")).select("text", "y"))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, lift: float = LIFT) -> dict:
    """Lexicon, innocent look-alikes and weights.

    Prefixes are counted by document on the executors and summed by key; those nearly all of whose documents are toxic
    come to the driver. Each of them needs at least 0.4 % of the toxic rows, so they are 250 times the words of a toxic
    row of the sample at most, ten prefixes a word. Misspelled matches that clean rows hold are look-alikes and never count.
    Weights: logistic regression on the hits' context features of the same rows."""
    rows = _distinct(training_rows(docs, labels, "toxic", *HELD_OUT, sample))
    total = rows.agg(F.count("*").alias("n"), F.sum("y").alias("p")).first()
    positives = int(total.p or 0)
    flat = {"terms": [], "innocent": frozenset(), "weights": np.zeros(12), "prior": (positives + 0.5) / (total.n + 1) if total.n else 0.5}
    if not positives or positives == total.n:
        return flat
    counts = rows.transform(in_arrow, _count_prefixes, "p string, pos long, neg long").groupBy("p").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    found = counts.where(F.col("pos") >= least_rows(positives)).where(telling(F.col("pos"), F.col("neg"), positives / total.n, lift)).collect()
    terms = choose({r.p: (r.pos, r.neg) for r in found}, positives, total.n - positives, lift)
    auto_terms = docs.sparkSession.sparkContext.broadcast(terms)

    def lookalikes(batches):
        auto, known = Automaton(auto_terms.value), set()
        for b in slices(batches):
            words = {bare(w) for t in b.column("text").to_pylist() for w in set(t.split())} - known
            known |= words
            got = [w for w in words if len(w) > 2 and (m := auto.match(w)) is not None and m[0] > 0]
            yield pa.RecordBatch.from_arrays([pa.array(got, pa.string())], names=["w"])

    # at most the distinct words of `sample` rows that lie near a term
    innocent = frozenset(r.w for r in rows.where("y = 0").select("text").transform(in_arrow, lookalikes, "w string").distinct().collect())
    part = {"terms": terms, "innocent": innocent}
    shipped = docs.sparkSession.sparkContext.broadcast(part)

    def describe(batches):
        m = Matcher(shipped.value["terms"], shipped.value["innocent"])
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([b.column("y"), pa.array(m.features(b.column("text").to_pylist()).tolist(), pa.list_(pa.float64()))], names=["y", "x"])

    got = sorted((tuple(r.x), r.y) for r in rows.transform(in_arrow, describe, "y double, x array<double>").collect())
    x, y = np.array([[*r, 1.0] for r, _ in got]), np.array([v for _, v in got])
    w = np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], 0.3)
    ridge[-1] = 1e-3
    for _ in range(40):  # Newton steps of ridge logistic regression
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge)
        step = np.linalg.solve(h, x.T @ (p - y) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return flat | part | {"weights": w}


def score(model: dict, texts: list[str]) -> np.ndarray:
    if not model["terms"]:
        return np.full(len(texts), model["prior"])
    x = _matcher(model).features(texts)
    return 1 / (1 + np.exp(-np.clip(x @ model["weights"][:-1] + model["weights"][-1], -30, 30)))


def cross_validated(docs: DataFrame, labels: DataFrame, lifts: list[float], folds: int = 3, sample: int = SAMPLE) -> dict[float, tuple[int, int, int, int]]:
    """For each lift: (toxic rows found, toxic rows, clean rows flagged, clean rows), each row judged by a model of the
    other folds. Only rows outside the held-out part take part, so lifts can be compared without a look at that part."""
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(*HELD_OUT))
    known = stored(known.select("doc_id", "toxic", F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(folds)).alias("fold")))
    out = {}
    for lift in lifts:
        sums = np.zeros(4, np.int64)
        for f in range(folds):
            rest, own = known.where(F.col("fold") != f), known.where(F.col("fold") == f).select("doc_id", "toxic")
            model = docs.sparkSession.sparkContext.broadcast(train(docs, rest, sample, lift))
            got = scored(docs.join(own.select("doc_id").distinct(), "doc_id", "left_semi"), score, model, *HELD_OUT, CUT).join(own, "doc_id")
            toxic, hit = F.col("toxic") == 1, F.col("predicted") == 1
            sums += np.array(got.agg(*[F.count(F.when(c, 1)) for c in (toxic & hit, toxic, ~toxic & hit, ~toxic)]).first())
        out[lift] = tuple(sums.tolist())
    return out


def classify(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of docs, from its whole text.

    Null and empty texts have no hits; very long texts and words are scanned whole; repeated rows score alike; reruns give
    the same scores however rows are dealt (samples and order are by hashes of content); without labelled rows of both
    kinds every score is the share of toxic ones (0.5 if there are none); null labels and ids teach nothing; an empty
    table gives no rows; columns beside doc_id and text are ignored."""
    return scored(docs, score, docs.sparkSession.sparkContext.broadcast(train(docs, labels, sample)), *HELD_OUT, CUT)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "labels", "doc_id", "toxic"))
