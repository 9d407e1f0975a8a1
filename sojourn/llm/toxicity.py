"""Toxicity scores by a linear model whose scores do not depend on which group a text mentions.

Features are the distinct words of a text and their beginnings. The model is fitted on a bounded sample of labelled texts by
logistic regression with two penalties: the squares of the weights, and, for every labelled sentence that names a group, the squares of
the score changes when the group's name is swapped for another. Names are given in four languages, or by the caller; the model
tells how many pairs there were, and without any it is plain logistic regression. A name that only happens to be frequent in toxic texts so
gets no weight of its own, and neutral mentions are not flagged.

Nulls and empty texts have no words and get the score of the intercept alone, very long texts are read whole, repeated rows get equal scores, an empty
table gives no rows, and one without usable labels a constant score. Columns other than ``doc_id`` and ``text``
are not read, and labels only of rows outside the held-out fold.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sojourn.llm.labelled import SAMPLE_ROWS, held_out, labelled_texts
from sojourn.llm.scratch import small_batches

# Names of groups in English, German, Spanish and French; those of one line are swapped for each other.
IDENTITY_TERMS = (
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "catholic"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists", "catholics"),
    ("black", "white", "asian", "latino", "african", "european"),
    ("gay", "lesbian", "straight", "transgender", "bisexual"),
    ("immigrants", "refugees", "foreigners", "natives"),
    ("blind", "deaf", "disabled"),
    ("old", "young", "elderly"),
    ("frauen", "männer", "mädchen", "jungen"),
    ("frau", "mann"),
    ("muslimisch", "christlich", "jüdisch", "hinduistisch", "buddhistisch", "katholisch"),
    ("muslime", "christen", "juden", "buddhisten", "atheisten", "katholiken"),
    ("schwarze", "weiße", "asiaten", "afrikaner", "europäer"),
    ("schwule", "lesben", "transsexuelle", "bisexuelle"),
    ("einwanderer", "flüchtlinge", "ausländer", "einheimische"),
    ("blinde", "gehörlose", "behinderte"),
    ("mujeres", "hombres", "niñas", "niños"),
    ("mujer", "hombre"),
    ("musulmanes", "cristianos", "judíos", "hindúes", "budistas", "ateos", "católicos"),
    ("negros", "blancos", "asiáticos", "latinos", "africanos", "europeos"),
    ("homosexuales", "lesbianas", "transexuales", "bisexuales"),
    ("inmigrantes", "refugiados", "extranjeros", "nativos"),
    ("ciegos", "sordos", "discapacitados"),
    ("femmes", "hommes", "filles", "garçons"),
    ("femme", "homme"),
    ("musulmans", "chrétiens", "juifs", "hindous", "bouddhistes", "athées", "catholiques"),
    ("noirs", "blancs", "asiatiques", "africains", "européens"),
    ("homosexuels", "lesbiennes", "transgenres", "bisexuels"),
    ("immigrés", "réfugiés", "étrangers", "autochtones"),
    ("aveugles", "sourds", "handicapés"),
)


def swaps_of(lines: Iterable[Iterable[str]]) -> dict[str, tuple[str, ...]]:
    """For each name the others of its lines."""
    out: dict[str, list[str]] = {}
    for line in map(list, lines):
        for term in line:
            out.setdefault(term, []).extend(x for x in line if x != term)
    return {term: tuple(dict.fromkeys(others)) for term, others in out.items() if others}


# Lengths of word beginnings that are features.
BEGINNINGS = (3, 4, 5, 6, 7)
# Features need so many labelled texts; the ones most unevenly spread over the labels are kept.
LEAST_TEXTS = 3
MOST_FEATURES = 4000
# What a toxic text counts for each other one, as there are fewer of them.
TOXIC_WEIGHT = 4.0
# Strength of the penalties on weights and on score changes, and rounds of descent.
RIDGE = 1e-4
SWAP_PENALTY = 1.0
ROUNDS = 600
# Words whose features a task remembers.
CACHE_WORDS = 300_000

WORD = re.compile(r"[^\W\d_]+")
SENTENCE = re.compile(r"[.!?\n]+")


def features_of(word: str) -> list[str]:
    return [word, *(f"{word[:n]}*" for n in BEGINNINGS if len(word) > n)]


def features(text: str) -> set[str]:
    return {f for w in set(WORD.findall(text.lower())) for f in features_of(w)}


def swapped_sentences(text: str, swaps: dict[str, tuple[str, ...]]) -> Iterator[tuple[set[str], set[str]]]:
    """Features of every sentence that names a group, and of the same with the next name of its line."""
    for sentence in SENTENCE.split(text.lower()):
        words = WORD.findall(sentence)
        if any(w in swaps for w in words):
            for turn in range(max(len(swaps[w]) for w in words if w in swaps)):
                other = [swaps[w][turn % len(swaps[w])] if w in swaps else w for w in words]
                yield {f for w in set(words) for f in features_of(w)}, {f for w in set(other) for f in features_of(w)}


@dataclass(frozen=True)
class Model:
    """``pairs``: sentences of the sample that a name was swapped in, whose score changes the fit penalised."""

    weights: dict[str, float]
    intercept: float
    pairs: int = 0

    def score(self, found: set[str]) -> float:
        z = self.intercept + math.fsum(self.weights.get(f, 0.0) for f in found)
        return 1 / (1 + math.exp(-max(-700.0, min(700.0, z))))


def feature_counts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """How many toxic and how many texts of each batch have a feature."""
    for frame in frames:
        toxic, every = Counter(), Counter()
        for label, text in zip(frame["label"], frame["text"], strict=True):
            found = features(text)
            every.update(found)
            if label:
                toxic.update(found)
        yield pd.DataFrame({"f": list(every), "a": [toxic[f] for f in every], "k": list(every.values())})


def chosen_rows(chosen: dict[str, int], swaps: dict[str, tuple[str, ...]]):
    """Numbers of the chosen features of every labelled text, and those that a swap adds or takes away."""

    def numbers(found: set[str]) -> list[int]:
        return sorted(chosen[f] for f in found if f in chosen)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for label, text in zip(frame["label"], frame["text"], strict=True):
                pairs = {(tuple(numbers(a - b)), tuple(numbers(b - a))) for a, b in swapped_sentences(text, swaps)}
                changed = [{"gone": list(a), "come": list(b)} for a, b in sorted(pairs) if a or b]
                out.append((label, numbers(features(text)), changed))
            yield pd.DataFrame(out, columns=["label", "found", "swaps"])

    return run


class Sparse:
    """Rows of feature numbers with values, for products with weights."""

    def __init__(self, rows: list[list[int]], values: list[list[float]] | None = None):
        lengths = np.array([len(r) for r in rows], np.int64)
        self.n = len(rows)
        self.row = np.repeat(np.arange(len(rows)), lengths)
        self.column = np.array([x for r in rows for x in r], np.int64)
        self.value = np.ones(len(self.column)) if values is None else np.array([x for r in values for x in r], float)

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.value * w[self.column], minlength=self.n)

    def back(self, r: np.ndarray, width: int) -> np.ndarray:
        return np.bincount(self.column, self.value * r[self.row], minlength=width)


def descend(x: Sparse, label: np.ndarray, swaps: Sparse, width: int, swap_penalty: float) -> tuple[np.ndarray, float]:
    """Weights and intercept by accelerated gradient steps."""
    w, b = np.zeros(width), 0.0
    if x.n == 0:
        return w, b
    at_w, at_b, momentum = w.copy(), b, 1.0
    # A bound of the curvature: a quarter of the largest row, and the swaps likewise.
    size = np.bincount(x.row, minlength=x.n).astype(float) + 1
    each = np.where(label > 0, TOXIC_WEIGHT, 1.0)
    steep = size.mean() + RIDGE
    if swaps.n:
        steep += 2 * swap_penalty * np.bincount(swaps.row, swaps.value**2, minlength=swaps.n).max()
    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(-np.clip(x.times(at_w) + at_b, -50, 50)))
        error = (p - label) * each / x.n
        g = x.back(error, width) + RIDGE * at_w
        if swaps.n:
            g += 2 * swap_penalty * swaps.back(swaps.times(at_w), width) / swaps.n
        new_w, new_b = at_w - g / steep, at_b - error.sum() / steep
        next_momentum = (1 + math.sqrt(1 + 4 * momentum**2)) / 2
        pull = (momentum - 1) / next_momentum
        # A step uphill starts the acceleration anew.
        if g @ (new_w - w) + error.sum() * (new_b - b) > 0:
            pull, next_momentum = 0.0, 1.0
        at_w, at_b = new_w + pull * (new_w - w), new_b + pull * (new_b - b)
        w, b, momentum = new_w, new_b, next_momentum
    return w, b


def fit(
    docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = SAMPLE_ROWS, swap_penalty: float = SWAP_PENALTY, terms: Iterable[Iterable[str]] = IDENTITY_TERMS
) -> Model:
    """The model of at most ``rows`` labelled texts. The features of the sample are counted by Spark, and the driver gets
    the numbers of at most ``MOST_FEATURES`` chosen ones for each of its texts."""
    small_batches(docs.sparkSession)
    some = labelled_texts(docs, labels, label, rows).persist()
    try:
        n, positive = some.agg(F.count("label"), F.sum("label")).first()
        if not n or not positive or positive == n:
            share = ((positive or 0) + 0.5) / (n + 1)
            return Model({}, math.log(share / (1 - share)))
        counts = some.mapInPandas(feature_counts, "f string, a long, k long").groupBy("f").agg(F.sum("a").alias("a"), F.sum("k").alias("k"))
        spread = F.abs(F.col("a") - F.col("k") * positive / n) / F.sqrt(F.col("k"))
        others = swaps_of(terms)
        names = list(others)
        kept = counts.filter((F.col("k") >= LEAST_TEXTS) | F.col("f").isin(names))
        top = kept.orderBy(F.col("f").isin(names).desc(), spread.desc(), "f").limit(MOST_FEATURES).select("f").collect()
        chosen = {r["f"]: i for i, r in enumerate(top)}
        data = some.mapInPandas(chosen_rows(chosen, others), "label int, found array<int>, swaps array<struct<gone:array<int>,come:array<int>>>").collect()
    finally:
        some.unpersist()
    changes = [x for r in data for x in r["swaps"]]
    swaps = Sparse([[*x["gone"], *x["come"]] for x in changes], [[1.0] * len(x["gone"]) + [-1.0] * len(x["come"]) for x in changes])
    w, b = descend(Sparse([r["found"] for r in data]), np.array([r["label"] for r in data], float), swaps, len(chosen), swap_penalty)
    return Model({f: float(w[i]) for f, i in chosen.items() if w[i]}, float(b), swaps.n)


def scorer(model: Model):
    @F.pandas_udf("double")
    def run(columns: Iterator[pd.Series]) -> Iterator[pd.Series]:
        # Most words have no feature with a weight; the others are remembered with theirs.
        known: dict[str, frozenset[str] | None] = {}
        for column in columns:
            out = []
            for text in column:
                found: set[str] = set()
                for word in set(WORD.findall(text.lower())) if isinstance(text, str) else ():
                    mine = known.get(word, False)
                    if mine is False:
                        if len(known) >= CACHE_WORDS:
                            known.clear()
                        mine = known[word] = frozenset(f for f in features_of(word) if f in model.weights) or None
                    if mine:
                        found |= mine
                out.append(model.score(found))
            yield pd.Series(out, dtype=float)

    return run


def score(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document, and ``swap_pairs``, the number of pairs the model was fitted with."""
    small_batches(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("held_out", held_out(F.col("doc_id")))
    found = texts.select("doc_id", "held_out", scorer(model)("text").alias("score"))
    return found.withColumn("predicted", (F.col("score") >= least).cast("int")).withColumn("swap_pairs", F.lit(model.pairs).cast("long"))


def accepted(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The documents that score below ``least``, with all their columns."""
    small_batches(docs.sparkSession)
    return docs.filter(scorer(model)("text") < least)
