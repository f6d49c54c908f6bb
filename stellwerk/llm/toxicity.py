"""Toxicity by a classifier that must not react to who is mentioned.

A logistic regression on the words of a text and the beginnings of its words is fitted to a bounded sample of labelled rows. In
each labelled sentence that mentions a group, the group's term is swapped for the next one
of its kind and for a neutral word; the fit penalises the change in score that this brings:

    loss = cross entropy + RIDGE |w|^2 / 2 + COUNTERFACTUAL mean (w.x(sentence) - w.x(swapped))^2 / 2

so that a group that is often insulted in the sample does not become an insult itself.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from hashlib import blake2b
from heapq import nsmallest

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled rows that the fit may see at most, and features that it may weigh.
SAMPLE, FEATURES, LEAST_DOCUMENTS = 8000, 500, 5
RIDGE, COUNTERFACTUAL, STEPS = 0.1, 50.0, 25
#: Sentences with a group kept of one text, for the penalty; a hash draws them from the whole text.
MENTIONS = 20
#: Kinds of group terms; the first of each is the neutral word.
GROUPS = (
    ("people", "women", "men", "girls", "boys", "transgender", "feminists"),
    ("person", "woman", "man", "girl", "boy"),
    ("people", "muslims", "christians", "jews", "hindus", "buddhists", "atheists", "catholics"),
    ("religious", "muslim", "christian", "jewish", "hindu", "buddhist", "catholic"),
    ("people", "blacks", "whites", "asians", "latinos", "immigrants", "refugees", "foreigners"),
    ("local", "black", "white", "asian", "latino", "african", "european", "arab", "mexican", "chinese", "indian"),
    ("partnered", "gay", "straight", "lesbian", "bisexual", "queer", "heterosexual"),
    ("aged", "old", "young", "elderly", "disabled", "blind", "deaf"),
)
#: Letters of the beginnings that stand for the forms of an inflected word.
STEM = 4
words_of = re.compile(r"\w+").findall
_NEXT = {t: g[1 + (i + 1) % (len(g) - 1)] for g in GROUPS for i, t in enumerate(g[1:])}
_NEUTRAL = {t: g[0] for g in GROUPS for t in g[1:]}


def features(words: Iterable[str]) -> set[str]:
    """The words, and the beginnings of longer ones (marked with a star)."""
    own = set(words)
    return own | {f"{w[:STEM]}*" for w in own if len(w) > STEM}


def line_of(words: Iterable[str]) -> str:
    """Features as one line; a sample is held in this form, which is far smaller than sets."""
    return " ".join(sorted(features(words)))


def swaps(text: str) -> list[tuple[str, str]]:
    """Features of the sentences that mention a group, each with those once the terms are swapped."""
    sentences = re.split(r"(?<=[.!?])\s+|\n", text.lower())
    mentions = (s for s in sentences if any(w in _NEXT for w in words_of(s)))
    out = []
    for sentence in nsmallest(MENTIONS, mentions, key=lambda s: (blake2b(s.encode("utf-8", "surrogatepass"), digest_size=8).digest(), s)):
        words = words_of(sentence)
        own = line_of(words)
        out += [(own, line_of(other.get(w, w) for w in words)) for other in (_NEUTRAL, _NEXT)]
    return out


@dataclass(frozen=True)
class Model:
    weights: dict[str, float]
    bias: float

    def score(self, text: str) -> float:
        """How likely label 1 is, from 0 to 1."""
        weights = self.weights
        z = self.bias + sum([weights[w] for w in weights.keys() & features(words_of(text.lower()))])
        return float(1 / (1 + np.exp(-np.clip(z, -500, 500))))


def fit(rows: Sequence[tuple[str, int]], pairs: Sequence[tuple[str, str]], counterfactual: float = COUNTERFACTUAL) -> Model:
    """Newton's method on the features that tell the labels apart best, and the group terms seen.

    ``rows`` are lines of features with labels 0 or 1, ``pairs`` those before and after a swap.
    With no row of one label, the score is the (smoothed) share of label 1; with none at all it is 0.
    """
    n, n1 = len(rows), sum(y for _, y in rows)
    prior = float(np.log((n1 + 0.5) / (n - n1 + 0.5)))
    if n1 in (0, n):
        return Model({}, prior if n else -500.0)
    toxic, other = Counter(), Counter()
    for line, y in rows:
        (toxic if y else other).update(line.split())

    def strength(w: str) -> float:
        """Information (in nats, times n) that the feature gives about the label."""
        a, b = toxic[w], other[w]
        cells = ((a, n1, a + b), (b, n - n1, a + b), (n1 - a, n1, n - a - b), (n - n1 - b, n - n1, n - a - b))
        return sum(x * math.log(x * n / (r * c)) for x, r, c in cells if x)

    seen = toxic.keys() | other.keys()
    often = [w for w in seen if toxic[w] + other[w] >= LEAST_DOCUMENTS and w not in _NEXT]
    chosen = sorted(often, key=lambda w: (-strength(w), w))[:FEATURES] + sorted(seen & _NEXT.keys())
    place = {w: i for i, w in enumerate(chosen)}

    def matrix(lines: Sequence[str]) -> np.ndarray:
        x = np.zeros((len(lines), len(chosen) + 1), np.float32)
        for i, line in enumerate(lines):
            x[i, [place[w] for w in line.split() if w in place]] = 1
        return x

    x, y = matrix([line for line, _ in rows]), np.array([y for _, y in rows], np.float64)
    x[:, -1] = 1
    ridge = np.full(x.shape[1], RIDGE)
    ridge[-1] = 1e-6
    penalty = np.diag(ridge)
    if pairs:
        change = matrix([a for a, _ in pairs]) - matrix([b for _, b in pairs])
        penalty += counterfactual * n / len(pairs) * (change.T @ change)
    w = np.zeros(x.shape[1])
    w[-1] = prior

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float((np.logaddexp(0, z) - y * z).sum() + w @ penalty @ w / 2)

    now = loss(w)
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
        gradient = x.T @ (p - y) + penalty @ w
        hessian = (x * (p * (1 - p))[:, None].astype(np.float32)).T @ x + penalty
        step, size = np.linalg.solve(hessian, gradient), 1.0
        while size > 1e-6 and loss(w - size * step) > now:
            size /= 2
        w = w - size * step
        before, now = now, loss(w)
        if before - now < 1e-6 * max(1.0, now):
            break
    return Model({t: float(w[i]) for t, i in place.items() if abs(w[i]) > 1e-9}, float(w[-1]))


def held_out(id_col: str) -> Column:
    """Whether a row is kept out of training: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Features of each sampled text, and those of its swapped sentences, as lines of text."""
    for batch in batches:
        texts = [t or "" for t in batch.column(1).to_pylist()]
        words = [line_of(words_of(t.lower())) for t in texts]
        pairs = ["\n".join(f"{a}\t{b}" for a, b in swaps(t)) for t in texts]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words), pa.array(pairs)], names=["toxic", "words", "pairs"])


def train(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic"
) -> Model:
    """Fits the model to at most SAMPLE labelled rows that are not held out, drawn by a hash of the id."""
    known = (
        labels.where(~held_out(id_col) & F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
        .groupBy(F.col(id_col).alias("id"))
        .agg(F.max((F.col(label_col) > 0).cast("int")).alias("toxic"))
    )
    total = known.count()
    if not total:
        return fit([], [])
    share = min(1.0, 1.2 * SAMPLE / total)
    order = F.pmod(F.xxhash64("id"), F.lit(1 << 30))
    drawn = known.where(order < F.lit(share * (1 << 30))).withColumn("order", order)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    # The sample is bounded by SAMPLE and drawn before the join, so it may be broadcast.
    # One text of each id, chosen in the map tasks: an id may hold any share of the rows.
    sets = texts.join(F.broadcast(drawn), "id").groupBy("order", "id", "toxic").agg(F.min("text").alias("text"))
    first = sets.orderBy("order", "id").limit(SAMPLE).select(F.struct("toxic", "order").alias("toxic"), "text")
    found = first.mapInArrow(_sets, "toxic struct<toxic:int,order:bigint>, words string, pairs string").collect()
    found.sort(key=lambda r: (r.toxic.order, r.words))
    pairs = [tuple(line.split("\t")) for r in found for line in r.pairs.split("\n") if line]
    return fit([(r.words, r.toxic.toxic) for r in found], pairs)


def score(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic"
) -> DataFrame:
    """``id_col``, held_out, score (0 to 1), predicted (1 from 0.5 on) for every row.

    A null or empty text gets the score of no word at all. Several labels of one id count as the largest;
    null labels and labels without a document are not used; without any label every score is 0. A
    row without an id is scored, not held out and not learned from. Other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, id_col, text_col, label_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            scores = [model.score(t.as_py() or "") for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["id", "score"])

    rows = docs.select(F.struct(F.col(id_col).alias("i"), held_out(id_col).alias("h")).alias("id"), F.col(text_col).alias("text"))
    scored = rows.mapInArrow(run, f"id struct<i:{docs.schema[id_col].dataType.simpleString()},h:boolean>, score double")
    return scored.select(
        F.col("id.i").alias(id_col), F.col("id.h").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
