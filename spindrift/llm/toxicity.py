"""Toxicity by a learned lexicon, Levenshtein automata and context windows.

The lexicon (words, and stems that stand for every word they begin) is learned from labelled texts by a
likelihood-ratio test.  It is held as a trie; the trie is intersected with the Levenshtein automata of
its own terms, and the product is made deterministic state by state as words are read, so a word costs
one table look-up a character and most words leave after two or three.  A hit's evidence is its log
likelihood ratio among the labelled texts, learned apart for right and wrong spelling and weakened where
the words around it quote it; a logistic score weighs the sum, the strongest hit and the text's length.
"""

from __future__ import annotations

import math
import re
import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.llm import textkit as tk
from spindrift.llm.cluster import columns_only, cut
from spindrift.llm.labelled import held_out, training_texts

#: Labelled texts learned from, expected chance entries of the lexicon, lengths of stems.
SAMPLE, CHANCE, STEMS = 12_000, 0.05, range(4, 11)
#: Words of context on either side of a hit, and what a quotation leaves of its evidence.
WINDOW, QUOTED = 4, 0.25
_TOKEN = re.compile(r"\w+|[\"“”„«»‘’]")
_MARKS = frozenset("\"“”„«»‘’")
_REPORT = frozenset("said says wrote called quote quoted quotes word term dit écrit mot sagte schrieb wort dijo escribió palabra".split())


def edits(term: str) -> int:
    """Errors allowed in a term of the lexicon: none below 5 letters, one below 9, else two."""
    return 0 if len(term) < 5 else 1 if len(term) < 9 else 2


class Automaton:
    """Lazily determinised product of the lexicon trie and its Levenshtein automata.

    A state is the set of (trie node, errors so far); stems accept at their node whatever follows.
    """

    def __init__(self, words: list[str], stems: list[str]):
        self.next: list[dict[str, int]] = [{}]
        self.word: list[int] = [-1]
        self.stem: list[int] = [-1]
        self.budget: list[int] = [0]
        self.terms = [*words, *(s + "*" for s in stems)]
        for i, w in enumerate([*words, *stems]):
            fuzzy = edits(w) if i < len(words) else 0
            node = 0
            self.budget[0] = max(self.budget[0], fuzzy)
            for c in w:
                if c not in self.next[node]:
                    self.next[node][c] = len(self.next)
                    self.next.append({})
                    self.word.append(-1)
                    self.stem.append(-1)
                    self.budget.append(0)
                node = self.next[node][c]
                self.budget[node] = max(self.budget[node], fuzzy)
            if i < len(words):
                self.word[node] = i
            else:
                self.stem[node] = i
        self.allowed = [edits(w) for w in words]
        self.reset()

    def reset(self) -> None:
        self.ids: dict[frozenset, int] = {}
        self.states: list[frozenset] = []
        self.moves: list[dict[str, int]] = []
        self.accepts: list[tuple[int, int] | None] = []
        self.stems_at: list[int] = []
        self.start = self._state(self._close({(0, 0)}))

    def _close(self, nodes: set) -> frozenset:
        """Adds what deletions (letters of the term left out) reach."""
        todo, seen = list(nodes), set(nodes)
        while todo:
            node, e = todo.pop()
            for child in self.next[node].values():
                if e < self.budget[child] and (child, e + 1) not in seen:
                    seen.add((child, e + 1))
                    todo.append((child, e + 1))
        least: dict[int, int] = {}
        for node, e in seen:
            least[node] = min(e, least.get(node, e))
        return frozenset(least.items())

    def _state(self, nodes: frozenset) -> int:
        if nodes not in self.ids:
            self.ids[nodes] = len(self.states)
            self.states.append(nodes)
            self.moves.append({})
            hits = [(e, self.word[n]) for n, e in nodes if self.word[n] >= 0 and e <= self.allowed[self.word[n]]]
            self.accepts.append(min(hits) if hits else None)
            self.stems_at.append(max((self.stem[n] for n, e in nodes if e == 0), default=-1))
        return self.ids[nodes]

    def _move(self, state: int, c: str) -> int:
        out = set()
        for node, e in self.states[state]:
            child = self.next[node].get(c)
            if child is not None:
                out.add((child, e))
            if e < self.budget[node]:
                out.add((node, e + 1))
            for other, child in self.next[node].items():
                if other != c and e < self.budget[child]:
                    out.add((child, e + 1))
        to = self._state(self._close(out)) if out else -1
        self.moves[state][c] = to
        return to

    def match(self, word: str) -> tuple[int, int] | None:
        """(term, errors) of the nearest term, an exact stem before an inexact word; None if there is none."""
        state, stem = self.start, -1
        for c in word:
            to = self.moves[state].get(c)
            if to is None:
                to = self._move(state, c)
            if to < 0:
                return (stem, 0) if stem >= 0 else None
            state = to
            if self.stems_at[state] >= 0:
                stem = self.stems_at[state]
        hit = self.accepts[state]
        if hit is not None and (hit[0] == 0 or stem < 0):
            return hit[1], hit[0]
        return (stem, 0) if stem >= 0 else None


def learn(train: DataFrame) -> tuple[list[str], float]:
    """(terms, base rate); stems end in '*'.  Counts are made by the executors, once a document.  All terms that pass the test are kept: the sample bounds them."""

    def count(batches):
        for batch in tk.pieces(batches):
            pos: dict[str, int] = {}
            neg: dict[str, int] = {}
            for text, y in zip(batch.column("text").to_pylist(), batch.column("y").to_pylist(), strict=True):
                words = set(re.findall(r"\w+", (text or "").lower()))
                stems = {w[:n] + "*" for w in words for n in STEMS if len(w) >= n}
                to = pos if y else neg
                for t in (*words, *stems, ""):
                    to[t] = to.get(t, 0) + 1
            terms = list(pos.keys() | neg.keys())
            yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array([pos.get(t, 0) for t in terms], pa.int64()), pa.array([neg.get(t, 0) for t in terms], pa.int64())], ["term", "pos", "neg"])

    counts = train.select("text", "y").mapInArrow(count, "term string, pos long, neg long").groupBy("term").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    counts = cut(counts.where("pos >= 3 or term = ''"))
    whole = counts.where("term = ''").first()
    if whole is None or not whole.pos:
        return [], 0.0
    p, q = whole.pos, whole.neg
    base = p / (p + q)
    n = F.col("pos") + F.col("neg")
    gain = F.col("pos") * F.log(F.col("pos") / (n * base)) + F.when(F.col("neg") > 0, F.col("neg") * F.log(F.col("neg") / (n * (1 - base)))).otherwise(0.0)
    tried = max(1, counts.count()) * 20
    rows = counts.where(f"term <> '' and pos > {3 * base} * (pos + neg)").where(gain >= math.log(tried / CHANCE)).orderBy(gain.desc(), "term").collect() if q else []
    found = {r.term: (r.pos, r.neg) for r in rows}
    pure = {t: (a + base) / (a + b + 1) for t, (a, b) in found.items()}
    # of nested stems with nearly the same hits the longest term stands for all; a longer stem with fewer stays only if it is surely purer;
    # words stay beside their stems, which match exactly only, for their misspellings
    covered: set[str] = set()
    for t, (a, _) in found.items():
        body = t.rstrip("*")
        covered |= {s for s in [body + "*", *(body[:n] + "*" for n in STEMS if n < len(body))] if s != t and s in found and a >= 0.9 * found[s][0]}
    keep: list[str] = []
    for t in sorted(found.keys() - covered, key=lambda t: (len(t.rstrip("*")), not t.endswith("*"), t)):
        body, (a, b) = t.rstrip("*"), found[t]
        shorter = [pure[s] for s in keep if s.endswith("*") and s != t and body.startswith(s[:-1])]
        if t == body or not shorter or a * math.log(pure[t] / max(shorter)) + b * math.log((1 - pure[t]) / (1 - max(shorter))) >= math.log(tried / CHANCE) and pure[t] > max(shorter):
            keep.append(t)
    return sorted(keep), base


def find(text: str, auto: Automaton, memo: dict) -> tuple[int, dict[tuple[int, bool], float]]:
    """(words, {(term, misspelled): hits}) of a text; a quoted hit counts QUOTED, and each distinct word once."""
    low = text.lower()
    words = re.findall(r"\w+", low)
    hits: dict[str, tuple[int, int]] = {}
    for w in set(words):
        hit = memo.get(w, 0)
        if hit == 0:
            if len(memo) > 1 << 18:
                memo.clear()
            hit = memo[w] = auto.match(w)
        if hit is not None:
            hits[w] = hit
    out: dict[tuple[int, bool], float] = {}
    if hits:
        best: dict[str, float] = {}
        tokens = _TOKEN.findall(low)
        for i, w in enumerate(tokens):
            if w in hits and best.get(w, 0.0) < 1.0:
                before, after = tokens[max(0, i - WINDOW) : i], tokens[i + 1 : i + 1 + WINDOW]
                quoted = (not _MARKS.isdisjoint(before) and not _MARKS.isdisjoint(after)) or not _REPORT.isdisjoint(before)
                best[w] = max(best.get(w, 0.0), QUOTED if quoted else 1.0)
        for w, (term, errors) in hits.items():
            out[term, errors > 0] = out.get((term, errors > 0), 0.0) + best.get(w, 1.0)
    return len(words), out


def features(words: int, hits: dict[tuple[int, bool], float], weight: dict[tuple[int, bool], float]) -> list[float]:
    """Of one text: summed and strongest evidence, the sum for its length, the length."""
    each = [weight[k] * min(n, 5.0) for k, n in hits.items() if k in weight]
    total = sum(each)
    return [1.0, min(total, 12.0), 100.0 * total / (words + 40.0), max((weight[k] * min(n, 1.0) for k, n in hits.items() if k in weight), default=0.0), float(total > 0), math.log1p(words) * (total > 0)]


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.5, rounds: int = 40) -> np.ndarray:
    """Newton's method on the ridge-penalised logistic loss."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        w = w + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(train: DataFrame, terms: list[str], base: float) -> tuple[dict[tuple[int, bool], float], np.ndarray]:
    """Evidence of each term, spelled right and wrong apart, and the weights of ``features``; the driver sees counts, no texts."""
    words, stems = [t for t in terms if not t.endswith("*")], [t[:-1] for t in terms if t.endswith("*")]

    def scan(batches):
        auto, memo = Automaton(words, stems), {}
        for batch in tk.pieces(batches):
            rows = [find(t or "", auto, memo) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("y"), pa.array([n for n, _ in rows], pa.int64()), *[pa.array([[f(k, v) for k, v in h.items()] for _, h in rows], pa.list_(t)) for f, t in ((lambda k, _: k[0], pa.int32()), (lambda k, _: k[1], pa.bool_()), (lambda _, v: v, pa.float64()))]],
                ["doc_id", "y", "n", "term", "wrong", "hits"],
            )

    rows = train.select("doc_id", "y", "text").mapInArrow(scan, "doc_id long, y int, n long, term array<int>, wrong array<boolean>, hits array<double>").toArrow().sort_by("doc_id").to_pylist()
    hits = [dict(zip(zip(r["term"], r["wrong"], strict=True), r["hits"], strict=True)) for r in rows]
    y = np.array([float(r["y"] > 0) for r in rows])
    p, q = max(1.0, y.sum()), max(1.0, len(y) - y.sum())
    # a word of the lexicon is also a hit of the stem that would have matched it: the stem's evidence is that of all its forms
    bare, under = Automaton([], stems), {}
    for t, word in enumerate(words):
        hit = bare.match(word)
        if hit is not None:
            under[t, False] = (len(words) + hit[0], False)
    seen: dict[tuple[int, bool], list[int]] = {}
    for h, v in zip(hits, y, strict=True):
        for k in h.keys() | {under[k] for k in h if k in under}:
            seen.setdefault(k, [0, 0])[int(v)] += 1
    weight = {}
    for t in range(len(terms)):
        for wrong in (False, True):
            neg, pos = seen.get((t, wrong), (0, 0))
            if pos + neg:
                weight[t, wrong] = max(0.0, math.log((pos + base) / p) - math.log((neg + 1 - base) / q))
            else:
                weight[t, wrong] = 0.7 * weight.get((t, False), 0.0)
    x = np.array([features(r["n"], h, weight) for r, h in zip(rows, hits, strict=True)]).reshape(len(rows), 6)
    return weight, logistic(x, y) if terms and 0 < y.sum() < len(y) else np.array([-30.0, 0, 0, 0, 0, 0])


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, sample: int = SAMPLE, modulus: int = 4, rest: int = 2, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, held_out, score, predicted, n_hits, terms) and the columns named by ``carry`` for each row of ``docs``.

    Learned from at most ``sample`` labelled rows outside the held-out fold.  Null and empty texts and
    texts without hits have the low score of such texts; with no usable labels, or none that
    teach a term, every score is nearly 0.
    Repeated rows are scored each, a null doc_id is not held out, extra columns are ignored, an empty
    table gives an empty result.  Texts of any length are read whole.  Among equally near terms the first in order counts.
    """
    spark = docs.sparkSession
    train = cut(training_texts(docs, labels, "toxic", sample, modulus, rest))
    lexicon, base = learn(train)
    terms = [t for t in lexicon if not t.endswith("*")] + [t for t in lexicon if t.endswith("*")]
    weight, w = fit(train, terms, base)
    bc = spark.sparkContext.broadcast((terms, weight, w))

    def score(batches):
        terms, weight, w = bc.value
        auto, memo = Automaton([t for t in terms if not t.endswith("*")], [t[:-1] for t in terms if t.endswith("*")]), {}
        for batch in tk.pieces(batches):
            scores, hits, names = [], [], []
            for text in batch.column("text").to_pylist():
                if len(auto.states) > 1 << 16:
                    auto.reset()
                n, found = find(text or "", auto, memo)
                scores.append(1 / (1 + math.exp(-max(-30.0, min(30.0, float(np.dot(features(n, found, weight), w)))))))
                hits.append(len(found))
                names.append(",".join(sorted({terms[t] for t, _ in found})))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32()), pa.array(hits, pa.int32()), pa.array(names, pa.string()), *[batch.column(c) for c in carry]],
                ["doc_id", "held_out", "score", "predicted", "n_hits", "terms", *carry],
            )

    rows = columns_only(docs, "doc_id", "text", *[c for c in carry if c != "text"]).withColumn("held_out", held_out(modulus, rest))
    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in carry)
    return rows.mapInArrow(score, "doc_id long, held_out boolean, score double, predicted int, n_hits int, terms string" + (kinds and ", " + kinds))


cloudpickle.register_pickle_by_value(sys.modules[__name__])
