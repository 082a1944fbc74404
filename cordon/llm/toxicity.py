"""Toxicity: a lexicon trie met by Levenshtein automata, with context windows for quotation.

The lexicon is learned from labelled documents: word beginnings, and whole words that are
shorter or longer than these, that stand in toxic documents far more often than chance lets
them (a likelihood-ratio test against the number of candidates tried). All that pass are
kept. Terms lie in a trie. A word is read by walking the trie with the
word's Levenshtein automaton, a bit-parallel set of positions for no error and for one: a
term without error may begin a longer, inflected word (but for terms of fewer than SHORTEST
characters); with one edit it must be the whole, or if it is long all but ENDING characters. Around each find a window of words is scored: quotation marks
and words of reporting speak for quotation, second person for abuse. A logistic
regression over the sums gives the score.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cordon.llm.common import written
from cordon.llm.labelled import labelled_sample, remainder

#: Bound on the labelled documents of the fit.
MAX_LABELLED = 10_000
#: Lengths of word beginnings that are candidates; terms are met with an edit from the first length on, with an edit and an ending from the second.
SHORTEST, LONGEST, FUZZY_FROM, ENDED_FROM, ENDING = 4, 12, 5, 7, 2
WINDOW = 4
MAX_CACHE = 400_000

#: Marks of quotation, words of reporting, second-person words.
QUOTES = "\"'“”„«»‘’`"
REPORTING = "quote quoted quoting quotes says said wrote writes called word words term terms slur slurs meaning means cites cited".split()
SECOND_PERSON = "you your youre yourself u ur tu toi vous du dich dir ihr sie te ti usted vos".split()
STRIP = QUOTES + ".,;:!?()[]{}<>*#$%&|-_~…"


def signed_llr(dt: float, nt: float, dn: float, nn: float) -> float:
    """Likelihood ratio (G) of a term's rates in toxic and other documents; negative if it is no likelier in toxic ones."""
    def ll(k, n, p):
        return (k * math.log(p) if k else 0.0) + ((n - k) * math.log(1 - p) if n > k else 0.0)

    p = (dt + dn) / (nt + nn)
    if not 0 < p < 1:
        return 0.0
    g = 2 * (ll(dt, nt, dt / nt) + ll(dn, nn, dn / nn) - ll(dt, nt, p) - ll(dn, nn, p))
    return g if dt / nt > dn / nn else -g


@dataclass
class Lexicon:
    """Terms with weights, as a trie: child by (node, character), term number at its end node."""

    terms: list[str]
    weights: list[float]
    fuzzy: set[int] = field(default_factory=set)

    def __post_init__(self):
        self.child: list[dict[str, int]] = [{}]
        self.end: list[int] = [-1]
        for k, t in enumerate(self.terms):
            node = 0
            for c in t:
                if c not in self.child[node]:
                    self.child[node][c] = len(self.child)
                    self.child.append({})
                    self.end.append(-1)
                node = self.child[node][c]
            self.end[node] = k
        near = [self.terms[k] for k in self.fuzzy]
        self.heads, self.tails = tuple({t[: len(t) // 2] for t in near}), tuple({t[len(t) // 2 :] for t in near})
        self.begins, self.head2, self.tail3 = {t[:SHORTEST] for t in self.terms}, {h[:2] for h in self.heads}, {t[-3:] for t in self.tails}
        self.ending = [ENDING if len(t) >= ENDED_FROM else 0 for t in self.terms]
        self.found: dict[str, tuple[int, int]] = {}
        self.clean: set[str] = set()

    def exact(self, word: str) -> int:
        """The longest term that begins the word, or -1."""
        node, found = 0, -1
        for depth, c in enumerate(word, 1):
            node = self.child[node].get(c, -1)
            if node < 0:
                break
            if self.end[node] >= 0 and (depth >= SHORTEST or depth == len(word)):
                found = self.end[node]
        return found

    def near(self, word: str) -> int:
        """The weightiest term that one edit turns into the word, or if it is long into the word less an ending; or -1.

        Bit i of a state says that i characters of the word have been read. The trie is
        walked with two states, without and with an edit. One edit leaves the term's first
        half intact at the word's beginning or its second half at the end; other words aren't walked.
        """
        if not (word[:2] in self.head2 and word.startswith(self.heads) or any(w[-3:] in self.tail3 and w.endswith(self.tails) for w in (word, word[:-1], word[:-2]))):
            return -1
        masks: dict[str, int] = {}
        for i, c in enumerate(word):
            masks[c] = masks.get(c, 0) | 1 << i
        n, best = len(word), -1
        full = (1 << (n + 1)) - 1
        stack = [(0, 1, 0b10 & full)]
        while stack:
            node, none, one = stack.pop()
            for c, nxt in self.child[node].items():
                m = masks.get(c, 0)
                zero = (none & m) << 1
                # a match after an edit, an omitted character, one in place of another, one too many
                edit = ((one & m) << 1 | none | none << 1 | zero << 1) & full
                if not zero and not edit:
                    continue
                k = self.end[nxt]
                if k in self.fuzzy and (best < 0 or self.weights[k] > self.weights[best]) and edit >> max(1, n - self.ending[k]):
                    best = k
                stack.append((nxt, zero, edit))
        return best

    def look(self, tokens: set[str]) -> dict[str, tuple[int, int]]:
        """Those of the tokens (of lower-case text) that are finds, each with (term, 0 exact or 1 near)."""
        hits = {}
        for token in tokens.difference(self.clean):
            find = self.found.get(token)
            if find is None:
                word = token.strip(STRIP)
                k = self.exact(word) if word[:SHORTEST] in self.begins else -1
                find = (k, 0) if k >= 0 else (self.near(word), 1)
                if find[0] < 0:
                    if len(self.clean) >= MAX_CACHE:
                        self.clean.clear()
                    self.clean.add(token)
                    continue
                if len(self.found) >= MAX_CACHE:
                    self.found.clear()
                self.found[token] = find
            hits[token] = find
        return hits

    def __getstate__(self):
        return {"terms": self.terms, "weights": self.weights, "fuzzy": self.fuzzy}

    def __setstate__(self, state):
        self.__init__(**state)


def spans(text: str, lexicon: Lexicon) -> list[tuple[int, str, int, int, bool, bool]]:
    """Finds in a text: (word position, token, term, edits, quoted, second person near)."""
    tokens = text.lower().split()
    hit = lexicon.look(set(tokens))
    out = []
    if hit:
        for i, t in enumerate(tokens):
            if t in hit:
                term, edits = hit[t]
                before, after = tokens[max(0, i - WINDOW) : i], tokens[i + 1 : i + 1 + WINDOW]
                opened = t[0] in QUOTES or any(x[0] in QUOTES for x in before)
                closed = t.rstrip(".,;:!?)")[-1:] in QUOTES or any(x.rstrip(".,;:!?)")[-1:] in QUOTES for x in after)
                near = {x.strip(STRIP) for x in before + after}
                out.append((i, t, term, edits, opened and closed or bool(near & set(REPORTING)), bool(near & set(SECOND_PERSON))))
    return out


N_FEATURES = 7


def features(text: str, lexicon: Lexicon) -> list[float]:
    abuse = near = quoted = person = top = 0.0
    n = 0
    for _, _, term, edits, is_quoted, second in spans(text, lexicon):
        w = lexicon.weights[term]
        if is_quoted:
            quoted += w
            continue
        n += 1
        top = max(top, w)
        person += second
        if edits:
            near += w
        else:
            abuse += w
    words = text.count(" ") + 1
    return [math.log1p(abuse), math.log1p(near), math.log1p(quoted), top, math.log1p(person), math.log1p(100 * n / words), float(n > 0)]


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights (last: intercept) by Newton steps; the ridge leaves the intercept alone."""
    z = np.hstack([x, np.ones((len(x), 1))])
    w, penalty = np.zeros(z.shape[1]), np.diag([ridge] * x.shape[1] + [1e-6])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + penalty, z.T @ (y - p) - penalty @ w)
        w += step
        if abs(step).max() < 1e-8:
            break
    return w


@dataclass
class Model:
    lexicon: Lexicon
    weights: np.ndarray

    def score(self, texts: list[str]) -> np.ndarray:
        x = np.array([features(t, self.lexicon) for t in texts]).reshape(len(texts), N_FEATURES)
        return 1 / (1 + np.exp(-np.clip(x @ self.weights[:-1] + self.weights[-1], -30, 30)))


def candidates(word: str) -> list[str]:
    """Beginnings of SHORTEST to LONGEST characters, and the word itself where it is shorter or longer."""
    return [word[:k] for k in range(SHORTEST, min(LONGEST, len(word)) + 1)] + [word] * (0 < len(word) < SHORTEST or len(word) > LONGEST)


def counted(batches, among: set[str] | None = None):
    """Per batch, how many documents have a word with each candidate (of `among`)."""
    begins = {t[:SHORTEST] for t in among or ()}
    for batch in batches:
        count: Counter = Counter()
        for text in batch.column(0).to_pylist():
            words = {t.strip(STRIP) for t in set(text.lower().split())}
            if among is None:
                count.update({c for w in words for c in candidates(w)})
            else:
                count.update(among.intersection(c for w in words if w[:SHORTEST] in begins for c in candidates(w)))
        yield pa.RecordBatch.from_arrays([pa.array(list(count), pa.string()), pa.array(list(count.values()), pa.int64())], ["term", "n"])


def fit(sample: DataFrame) -> Model | None:
    sample = written(sample, "toxicity-sample")
    nt, nn = (sample.agg(F.sum("y").alias("t"), F.sum(1 - F.col("y")).alias("n")).first())
    if not nt or not nn:
        return None
    terms = "term string, n long"
    toxic = written(sample.where("y > 0").select("text").mapInArrow(counted, terms).groupBy("term").agg(F.sum("n").alias("n")).where(F.col("n") >= 2), "toxicity-terms")
    least = 2 * math.log(max(toxic.count(), 2)) + 4
    # what too few toxic documents have can't pass, even if no other has it
    enough = next((d for d in range(2, int(nt) + 1) if signed_llr(d, nt, 0, nn) >= least), int(nt) + 1)
    dt = {r["term"]: r["n"] for r in toxic.where(F.col("n") >= enough).collect()}  # from MAX_LABELLED documents
    among = set(dt)
    dn = {r["term"]: r["n"] for r in sample.where("y = 0").select("text").mapInArrow(lambda b: counted(b, among), terms).groupBy("term").agg(F.sum("n").alias("n")).collect()}
    passed = {t: (n, dn.get(t, 0)) for t, n in dt.items() if signed_llr(n, nt, dn.get(t, 0), nn) >= least and n / nt > 4 * dn.get(t, 0) / nn}
    # of a beginning and a longer one with nearly as many documents, the longer stays; longer ones with fewer fall under it
    chosen: list[str] = []
    begun: set[str] = set()
    after: dict[str, list[str]] = {}
    for u in passed:
        after.setdefault(u[:-1], []).append(u[-1])
    for t in sorted(passed, key=lambda t: (len(t), t)):
        if any(t[:k] in begun for k in range(SHORTEST, len(t) + 1)):
            continue
        while len(t) >= SHORTEST and (longer := sorted(t + c for c in after.get(t, ()) if passed[t + c][0] >= 0.95 * passed[t][0])):
            t = longer[0]
        chosen.append(t)
        begun.add(t)
    chosen = sorted(set(chosen), key=lambda t: (-passed[t][0], t))
    weights = [math.log((passed[t][0] + 0.5) / (nt + 1)) - math.log((passed[t][1] + 0.5) / (nn + 1)) for t in chosen]
    trial = Lexicon(chosen, weights, {k for k, t in enumerate(chosen) if len(t) >= FUZZY_FROM})

    def finds(batches):
        """Near finds of each term in toxic and other documents, per batch."""
        for batch in batches:
            seen: Counter = Counter()
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                seen.update({(term, int(y)) for _, _, term, edits, _, _ in spans(text, trial) if edits})
            keys = list(seen)
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in keys], pa.int32()), pa.array([y for _, y in keys], pa.int32()), pa.array([seen[k] for k in keys], pa.int64())], ["term", "y", "n"])

    near: Counter = Counter()
    for r in sample.select("text", "y").mapInArrow(finds, "term int, y int, n long").groupBy("term", "y").agg(F.sum("n").alias("n")).collect():  # two rows a term at most
        near[r["term"], r["y"]] = r["n"]
    # near forms of a term are believed unless other documents have them about as often
    lexicon = Lexicon(chosen, weights, {k for k in trial.fuzzy if near[k, 0] / nn <= max(1e-3, 0.2 * near[k, 1] / nt)})

    def measure(batches):
        for batch in batches:
            rows = [features(t, lexicon) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.float64())), batch.column(1)], ["x", "y"])

    table = sample.select("text", "y").mapInArrow(measure, "x array<double>, y double").toPandas()  # MAX_LABELLED rows at most
    return Model(lexicon, logistic(np.vstack(table["x"].to_numpy()), table["y"].to_numpy()))


def toxicity(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", folds: int = 3, held_out: int = 1, cut: float = 0.7, most: int = MAX_LABELLED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: id, held_out, score (0 to 1) and predicted (1 if score >= cut).

    Null texts are scored as empty ones, very long ones whole. Without labels of both kinds every score is 0.5.
    Repeated rows get equal rows; an empty table gives none; other columns have no influence.
    """
    model = fit(labelled_sample(docs, labels, label_col, folds, held_out, most, id_col, text_col))

    def run(batches):
        for batch in batches:
            texts = [t or "" for t in batch.column(0).to_pylist()]
            score = model.score(texts) if model else np.full(len(texts), 0.5)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(score, pa.float64())], [*batch.schema.names[1:], "score"])

    given = docs.select(F.col(text_col).alias("the_text"), F.col(id_col), F.coalesce(remainder(id_col, folds) == held_out, F.lit(False)).alias("held_out"))
    return given.mapInArrow(run, given.drop("the_text").schema.add("score", "double")).withColumn("predicted", (F.col("score") >= cut).cast("int"))
