"""Toxicity by a counterfactually regularised logistic classifier.

A text's features are the presence of words and of word beginnings, picked by
their association with the label on the training documents, and of swap terms.
These are identity terms of a fixed list, and such words of the training texts
as stand for each other there: met in documents of both labels, neither of which
they tell, and with the same neighbours. Each training sentence that holds a swap
term is paired with copies in which the term is swapped for others of its group;
the loss has the usual log-likelihood, a ridge, and the squared change of the
logit under each swap. The last makes a neutral mention of any group cost
nothing, whatever the label of the documents that happen to mention it.
``Model.swapped`` tells how many swapped copies the fit had; a model whose
sentences held no swap term at all says so when it is made.

At most ``SAMPLE`` documents that are not held out are learnt from; scoring
reads whole texts.

Defined results: null and empty texts have no features and score by the offset
alone; repeated rows get equal scores; null labels are not learnt from; without
labels of both kinds every document scores 0.5; an empty table gives no rows;
further columns are ignored.
"""

from __future__ import annotations

import re
import warnings
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, rows_of
from .labelled import held_out, training_sample

#: Labelled documents that are learnt from at most, and features that are kept.
SAMPLE, FEATURES = 12000, 600
LEAST_DOCUMENTS = 6
BEGINNINGS = (4, 5, 6, 7, 8)
#: Words of the texts that may become swap terms, neighbours that are counted for each side, members of a group at most,
#: documents of either label that such a word needs, and how far its share of toxic documents may be from that of all.
TERMS, NEIGHBOURS, GROUP, TERM_DOCUMENTS, TERM_LEAN = 200, 300, 4, 5, 3.0
#: Cosine of the neighbour counts from which two words stand for each other.
TERM_LIKENESS = 0.8
RIDGE, SWAP_PENALTY, STEPS = 2.0, 40.0, 40
#: A toxic document counts as this many: missing one is worse than doubting one.
TOXIC_WEIGHT = 2.0
THRESHOLD = 0.5
#: Words whose features a worker remembers at most.
MEMORY_WORDS = 500_000

# Identity terms, by groups whose members may stand for each other.
IDENTITY_GROUPS = (
    ("women", "men", "girls", "boys", "transgender", "nonbinary"),
    ("woman", "man", "girl", "boy"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("black", "white", "asian", "latino", "african", "european"),
    ("gay", "straight", "lesbian", "bisexual", "heterosexual", "queer"),
    ("immigrants", "refugees", "natives", "foreigners", "citizens"),
    ("disabled", "blind", "deaf", "autistic"),
    ("frauen", "männer"), ("muslime", "christen", "juden"), ("ausländer", "flüchtlinge", "einheimische"),
    ("femmes", "hommes"), ("musulmans", "chrétiens", "juifs"), ("étrangers", "réfugiés", "immigrés"),
    ("mujeres", "hombres"), ("musulmanes", "cristianos", "judíos"), ("extranjeros", "refugiados", "inmigrantes"),
)
IDENTITY = {w: g for g in IDENTITY_GROUPS for w in g}
_NOT_LETTERS = re.compile(r"[\W\d_]+")
_SENTENCES = re.compile(r"[.!?\n]+")


def bare(word: str) -> str:
    """A word without case, digits and signs."""
    return _NOT_LETTERS.sub("", word.lower())


def word_features(word: str, terms=IDENTITY) -> list[str]:
    """The word itself ("=...") and its beginnings ("^..."); of a swap term the word alone."""
    w = bare(word)
    if not w:
        return []
    return ["=" + w, *("^" + w[:n] for n in BEGINNINGS if len(w) >= n)] if w not in terms else ["=" + w]


@dataclass
class Model:
    names: list[str]
    weights: np.ndarray
    offset: float
    #: Swap terms and their groups; how many swapped copies of sentences the fit had.
    terms: dict[str, tuple[str, ...]] = field(default_factory=lambda: IDENTITY, repr=False)
    swapped: int = 0
    _memory: dict = field(default_factory=dict, repr=False)

    def __post_init__(self):
        self._at = {n: i for i, n in enumerate(self.names)}

    def __getstate__(self):
        return self.names, self.weights, self.offset, self.terms, self.swapped

    def __setstate__(self, state):
        self.names, self.weights, self.offset, self.terms, self.swapped = state
        self._memory = {}
        self.__post_init__()

    def features(self, text: str | None) -> set[int]:
        memory, out = self._memory, set()
        for w in set((text or "").split()):
            found = memory.get(w)
            if found is None:
                found = memory[w] = tuple(self._at[f] for f in word_features(w, self.terms) if f in self._at)
            if found:
                out.update(found)
        if len(memory) > MEMORY_WORDS:
            memory.clear()
        return out

    def score(self, text: str | None) -> float:
        x = self.offset + sum(self.weights[i] for i in self.features(text))
        return float(1 / (1 + np.exp(-min(max(x, -30.0), 30.0))))


def swaps(text: str | None, names: dict[str, int], terms=IDENTITY) -> Iterator[tuple[int, int]]:
    """(old, new) features of every swapped copy of every sentence with swap terms."""
    for sentence in _SENTENCES.split(text or ""):
        for w in {bare(x) for x in sentence.split()} & terms.keys():
            yield from ((names["=" + w], names["=" + other]) for other in terms[w] if other != w)


def fit(names: list[str], rows: list[tuple[int, list[int]]], moved: dict[tuple[int, int], int], ridge: float = RIDGE, penalty: float = SWAP_PENALTY, terms=IDENTITY) -> Model:
    """Newton's method; ``rows``: (label, features present), ``moved``: how often a swap changed one feature for another."""
    if {y for y, _ in rows} != {0, 1}:
        return Model(names, np.zeros(len(names)), 0.0, terms)
    n = len(names)
    x = np.zeros((len(rows), n + 1), np.float32)
    x[:, n] = 1
    for i, (_, at) in enumerate(rows):
        x[i, list(at)] = 1
    y = np.array([r[0] for r in rows], float)
    weight = np.where(y == 1, TOXIC_WEIGHT, 1.0)
    fixed = np.diag(np.append(np.full(n, ridge), 1e-3))
    swapped = sum(moved.values())
    for (old, new), times in moved.items():
        share = penalty * times / swapped * len(rows) / 100
        for a, b, sign in ((old, old, 1), (new, new, 1), (old, new, -1), (new, old, -1)):
            fixed[a, b] += sign * share
    w = np.zeros(n + 1)
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (weight * (y - p)) - fixed @ w
        h = (x * (weight * p * (1 - p))[:, None].astype(np.float32)).T @ x + fixed
        step = np.linalg.solve(h, g)
        size = np.abs(step).max()
        w += step / max(1.0, size / 2)
        if size < 1e-5:
            break
    return Model(names, w[:n], float(w[n]), terms, swapped)


def grouped(words: list[str], counts: np.ndarray) -> dict[str, tuple[str, ...]]:
    """Words to their groups, by the cosine of their rows of neighbour counts, the most alike first."""
    weight = np.sqrt(counts.astype(float))
    weight /= np.maximum(np.linalg.norm(weight, axis=1, keepdims=True), 1e-9)
    near = weight @ weight.T
    groups = {i: [i] for i in range(len(words))}
    of = list(range(len(words)))
    pairs = sorted(((-near[i, j], i, j) for i in range(len(words)) for j in range(i) if near[i, j] >= TERM_LIKENESS))
    for _, i, j in pairs:
        a, b = of[i], of[j]
        if a != b and len(groups[a]) + len(groups[b]) <= GROUP and all(near[p, q] >= TERM_LIKENESS for p in groups[a] for q in groups[b]):
            groups[a] += groups.pop(b)
            for k in groups[a]:
                of[k] = a
    return {words[i]: tuple(sorted(words[k] for k in g)) for g in groups.values() if len(g) > 1 for i in g}


def swap_terms(sample: DataFrame, clean: float, toxic: float) -> dict[str, tuple[str, ...]]:
    """The fixed identity terms, and groups of words that stand for each other in the training texts.

    What reaches the driver are TERMS words and their counts with NEIGHBOURS words on either side.
    """

    def counted(batches):
        seen: tuple[Counter, Counter] = (Counter(), Counter())
        for label, text in rows_of(batches, "label", "text"):
            seen[bool(label)].update({bare(w) for w in set((text or "").split())})
        for label, counts in enumerate(seen):
            for w, n in counts.items():
                if w and w not in IDENTITY:
                    yield w, n * (1 - label), n * label

    words = map_rows(sample, counted, "word string, clean long, toxic long", size=4096).groupBy("word").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    words = words.where((F.col("clean") >= TERM_DOCUMENTS) & (F.col("toxic") >= TERM_DOCUMENTS))
    top = words.orderBy(F.desc(F.col("clean") + F.col("toxic")), "word").limit(NEIGHBOURS + TERMS).collect()
    beside = {r["word"]: i for i, r in enumerate(top[:NEIGHBOURS])}
    lean = [(r["toxic"] / max(toxic, 1)) / (r["clean"] / max(clean, 1)) for r in top]
    places = {r["word"]: i for i, r in enumerate([r for r, x in zip(top, lean, strict=True) if 1 / TERM_LEAN <= x <= TERM_LEAN][:TERMS])}

    def met(batches):
        counts: Counter = Counter()
        for (text,) in rows_of(batches, "text"):
            for sentence in _SENTENCES.split(text or ""):
                row = [bare(x) for x in sentence.split()]
                for i, w in enumerate(row):
                    if w in places:
                        if i and row[i - 1] in beside:
                            counts[places[w], beside[row[i - 1]]] += 1
                        if i + 1 < len(row) and row[i + 1] in beside:
                            counts[places[w], NEIGHBOURS + beside[row[i + 1]]] += 1
        for (w, c), n in counts.items():
            yield w, c, n

    table = np.zeros((len(places), 2 * NEIGHBOURS))
    for r in map_rows(sample.select("text"), met, "word int, beside int, n long", size=4096).groupBy("word", "beside").agg(F.sum("n").alias("n")).collect():
        table[r["word"], r["beside"]] = r["n"]
    return IDENTITY | grouped(list(places), table)


def learn(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE, penalty: float = SWAP_PENALTY) -> Model:
    """Picks swap terms and features, and fits; counts and feature lists of the sample reach the driver."""
    sample = training_sample(docs, labels, "toxic", bound)
    kinds = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    clean, toxic = float(kinds.get(0, 0)), float(kinds.get(1, 0))
    terms = swap_terms(sample, clean, toxic)

    def counted(batches):
        seen: tuple[Counter, Counter] = (Counter(), Counter())
        for label, text in rows_of(batches, "label", "text"):
            seen[bool(label)].update({f for w in set((text or "").split()) for f in word_features(w, terms)})
        for label, counts in enumerate(seen):
            for f, n in counts.items():
                yield f, n * (1 - label), n * label

    counts = map_rows(sample, counted, "feature string, clean long, toxic long", size=4096).groupBy("feature").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    excess = (F.col("toxic") / max(toxic, 1) - F.col("clean") / max(clean, 1)) / F.sqrt((F.col("toxic") + F.col("clean") + 1) / max(toxic + clean, 1))
    picked = counts.where((F.col("toxic") >= LEAST_DOCUMENTS) & (excess > 0)).orderBy(excess.desc(), "feature").limit(FEATURES).select("feature").collect()
    names = sorted({r["feature"] for r in picked} | {"=" + w for w in terms})
    index = {f: i for i, f in enumerate(names)}
    finder = Model(names, np.zeros(len(names)), 0.0, terms)

    def reduced(batches):
        for doc, label, text in rows_of(batches, "doc_id", "label", "text"):
            yield doc, label, sorted(finder.features(text))

    def changed(batches):
        seen: Counter = Counter()
        for (text,) in rows_of(batches, "text"):
            seen.update(swaps(text, index, terms))
        for (old, new), n in seen.items():
            yield old, new, n

    rows = map_rows(sample, reduced, "doc_id long, label int, present array<int>").orderBy("doc_id").collect()
    moved = map_rows(sample.select("text"), changed, "old int, new int, n long", size=4096).groupBy("old", "new").agg(F.sum("n").alias("n")).collect()
    model = fit(names, [(r["label"], r["present"]) for r in rows], {(r["old"], r["new"]): r["n"] for r in moved}, penalty=penalty, terms=terms)
    if not model.swapped and toxic and clean:
        warnings.warn("no training sentence holds a swap term: the model is plain logistic regression", stacklevel=2)
    return model


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """op4: every document's toxicity."""
    model = learn(docs, labels)

    def scored(batches):
        for doc, text in rows_of(batches, "doc_id", "text"):
            yield doc, model.score(text)

    found = map_rows(docs.select("doc_id", "text"), scored, "doc_id long, score double", size=4096)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
