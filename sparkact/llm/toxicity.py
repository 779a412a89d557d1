"""Toxicity scores by a counterfactually regularised linear classifier.

A logistic model over the words of a text and the first letters of its words is fitted on a
bounded sample of labelled texts. Beside the labelled loss it pays for every difference of
score between a sentence of the sample that names a group and its counterfactual, in which identity
terms are swapped for others of their group; of a text that names none, one sentence gets a term
put before it and swapped likewise. A term's weight thus falls to what the sentence's other words
leave unexplained, so that a neutral mention of a group moves no score.

Of the features those are kept whose likelihood ratio says more about the labels than chance does
among so many features; what chance allows grows with their number, so that small samples keep few.

Scores depend on the text alone. Defined results: null and empty texts get the score of a text
without words, the model's base rate; repeated words count once, repeated rows get equal scores.
Of several labels of one doc_id the larger counts, of several texts the first in order. Without
labelled texts every score is a half. Extra columns stay as they are.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkact.llm.media import batched

# Terms for groups of people, by what they tell apart; a term is swapped inside its line.
IDENTITY = [
    "woman man girl boy", "women men girls boys", "she he", "female male", "mother father",
    "muslim christian jewish hindu buddhist catholic protestant atheist",
    "muslims christians jews hindus buddhists catholics protestants atheists",
    "black white asian african european latino arab indian", "gay straight lesbian bisexual transgender queer",
    "immigrant refugee foreigner citizen native", "immigrants refugees foreigners citizens natives",
    "old young elderly", "disabled blind deaf autistic",
    "frau mann mädchen junge", "muslime christen juden", "ausländer flüchtlinge einwanderer",
    "femme homme fille garçon", "musulmans chrétiens juifs", "immigrés réfugiés étrangers",
    "mujer hombre chica chico", "musulmanes cristianos judíos", "inmigrantes refugiados extranjeros",
]
SWAPS = {w: [x for x in line.split() if x != w] for line in IDENTITY for w in line.split()}
TERMS = sorted(SWAPS)
WORD = re.compile(r"[^\W\d_]+")
SENTENCE = re.compile(r"[.!?\n。！？]+")
STEM = 4  # letters


def features(words: set[str]) -> set[str]:
    return words | {w[:STEM] + "*" for w in words if len(w) > STEM}


def words_of(text: str | None) -> set[str]:
    return set(WORD.findall((text or "").lower()))


def swapped(words: set[str], number: int) -> tuple[set[str], set[str]]:
    """A text's words and those of its counterfactual; ``number`` varies the choice."""
    named = sorted(words & SWAPS.keys())
    if not named:
        term = TERMS[number % len(TERMS)]
        named, words = [term], words | {term}
    new = {SWAPS[w][(number + i) % len(SWAPS[w])] for i, w in enumerate(named)}
    return words, words - set(named) | new


class Model:
    """Weights by feature, and the score of a text's words."""

    def __init__(self, weights: dict[str, float], base: float):
        self.weights, self.base = weights, base

    def score(self, text: str | None) -> float:
        words = words_of(text)
        get, total = self.weights.get, self.base
        for w in words:
            total += get(w, 0.0)
        for s in {w[:STEM] for w in words if len(w) > STEM}:
            total += get(s + "*", 0.0)
        return float(1 / (1 + np.exp(-np.clip(total, -30, 30))))


class Features:
    """Numbers of feature names; a bag of words becomes an array of them."""

    def __init__(self):
        self.number: dict[str, int] = {}

    def of(self, words: set[str]) -> np.ndarray:
        number = self.number
        return np.array([number.setdefault(f, len(number)) for f in features(words)], np.int32)


def sentences(text: str | None) -> list[set[str]]:
    """The words of each sentence that has any."""
    return [w for w in map(words_of, SENTENCE.split(text or "")) if w]


def counterfactuals(text: str | None, number: int) -> list[tuple[set[str], set[str]]]:
    """(words, words with terms swapped) of the sentences that name a group; of one with a term before it, if none does."""
    parts = sentences(text)
    named = [w for w in parts if w & SWAPS.keys()] or [parts[number % len(parts)] if parts else set()]
    return [swapped(w, number + k) for k, w in enumerate(named)]


def likelihood_ratio(total: np.ndarray, toxic: np.ndarray, share: float) -> np.ndarray:
    """Twice the log likelihood that a feature's own share of toxic texts gains over ``share``."""
    part = lambda seen, p: np.where(seen > 0, seen * np.log(np.maximum(seen, 1) / np.maximum(total * p, 1e-300)), 0.0)
    return 2 * (part(toxic, share) + part(total - toxic, 1 - share))


def fit(texts: list[str | None], labels: list[int], **options: float) -> Model:
    """:func:`fitted` of lists."""
    return fitted(zip(texts, labels, strict=True), **options)


def fitted(rows: Iterable[tuple[str | None, int]], strictness: float = 0.75, swap_penalty: float = 4.0, ridge: float = 1e-4, rounds: int = 250, rate: float = 0.1) -> Model:
    """Full-batch Adam over (text, label) as they come, of which none is kept. A feature stays if its likelihood
    ratio is 2 * ``strictness`` * log(number of features) at least; identity terms always stay."""
    known, bags, sides, labels = Features(), [], ([], []), []
    known.of(set(TERMS))
    for i, (text, label) in enumerate(rows):
        labels.append(label)
        bags.append(known.of(words_of(text)))
        for pair in counterfactuals(text, i):
            for side, words in zip(sides, pair, strict=True):
                side.append(known.of(words))
    if not labels:
        return Model({}, 0.0)
    y = np.array(labels, float)
    share = (y.sum() + 1) / (len(y) + 2)
    every, size = np.concatenate(bags), len(known.number)
    total = np.bincount(every, minlength=size).astype(float)
    toxic = np.bincount(every, np.repeat(y, [len(b) for b in bags]), size)
    ratio = likelihood_ratio(total, toxic, share)
    least = 2 * strictness * np.log(max(2, np.count_nonzero(total)))
    chosen = dict.fromkeys([*sorted(f for f, n in known.number.items() if ratio[n] >= least), *TERMS])
    column = np.full(size, -1, np.int64)
    column[[known.number[f] for f in chosen]] = np.arange(len(chosen))
    texts, left, right = (csr(side, column) for side in (bags, *sides))
    w = np.zeros(len(chosen) + 1)
    w[-1] = np.log(share / (1 - share))
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, rounds + 1):
        loss, g = objective(w, texts, y, left, right, swap_penalty, ridge)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Model({f: float(w[i]) for i, f in enumerate(chosen) if abs(w[i]) > 1e-4}, float(w[-1]))


def objective(w: np.ndarray, texts, y: np.ndarray, left, right, swap_penalty: float, ridge: float) -> tuple[float, np.ndarray]:
    """(loss, gradient): the mean cross entropy of the labels, the mean squared difference of the scores of sentences and
    their counterfactuals, and the weights' squares."""
    g = np.zeros_like(w)
    p = sigmoid(times(texts, w))
    add(texts, g, (p - y) / len(y))
    a, b = sigmoid(times(left, w)), sigmoid(times(right, w))
    d = 2 * swap_penalty * (a - b) / len(a)
    add(left, g, d * a * (1 - a))
    add(right, g, -d * b * (1 - b))
    g[:-1] += ridge * w[:-1]
    entropy = -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))
    return float(entropy + swap_penalty * np.mean((a - b) ** 2) + ridge * (w[:-1] ** 2).sum() / 2), g


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def csr(bags: list[np.ndarray], column: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(row, column, rows) of the features that have a column."""
    cols = column[np.concatenate(bags)]
    row = np.repeat(np.arange(len(bags), dtype=np.int32), [len(b) for b in bags])
    return row[cols >= 0], cols[cols >= 0], len(bags)


def times(x, w: np.ndarray) -> np.ndarray:
    row, col, n = x
    return np.bincount(row, w[col], n) + w[-1]


def add(x, g: np.ndarray, d: np.ndarray) -> None:
    row, col, _ = x
    g[:-1] += np.bincount(col, d[row], len(g) - 1)
    g[-1] += d.sum()


def is_held_out(doc_id: Column) -> Column:
    """One document in four, by crc32 of the doc_id as text; no label of these is learnt from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def trained(docs: DataFrame, labels: DataFrame, sample: int = 8000) -> Model:
    """A model of at most ``sample`` labelled texts, those of the smallest hash of doc_id."""
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)").where(~is_held_out(F.col("doc_id")))
    chosen = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    return fitted((r["text"], r["toxic"]) for r in rows.orderBy("doc_id").toLocalIterator())


def scored(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    held = docs.sparkSession.sparkContext.broadcast((model.weights, model.base))  # weights of a bounded sample's features
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])

    def task(batches):
        own = Model(*held.value)

        def row(doc_id, held_out, text):
            s = own.score(text)
            return doc_id, held_out, s, int(s >= threshold)

        yield from batched(batches, row, schema)

    return docs.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(task, "doc_id long, held_out boolean, score double, predicted int")


def accepted(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """``docs`` without those whose score reaches the threshold; all columns as they are."""
    held = docs.sparkSession.sparkContext.broadcast((model.weights, model.base))

    @F.pandas_udf("double")
    def score(texts):
        return texts.map(Model(*held.value).score)

    return docs.where(score("text") < threshold)
