"""Benchmark decontamination: every training passage is a query to an index of test items.

The index is an inverted one over the test items, with BM25 impacts. An impact is divided by what
its item scores against itself, so one threshold serves all items: a passage that holds a
whole item scores at least 1. Items lie in blocks, and each term keeps its largest impact per
block. Querying is block-max WAND: a passage is dropped if in no block the maxima of its terms
reach the threshold (tested for many passages at once), and otherwise its posting lists are
walked document by document, skipping blocks that cannot reach it. What is retrieved is
verified: the word triples of the item's question and of its answer (its last sentence) must
both be found in the text around the passage.

Items longer than a passage can hold are indexed in segments and verified as a whole. The
index is broadcast in parts of at most PART_ENTRIES segments, all weighted by the whole benchmark's counts; a larger one takes
several passes over the documents, never a larger broadcast.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stellwerk.session import materialise

#: Words in a passage and between the starts of two; a segment always lies within one passage.
PASSAGE, STRIDE, SEGMENT = 128, 64, 64
#: Share of an item's own score that retrieves it; shares of question and answer that verify it.
RETRIEVE, VERIFY, GRAM = 0.6, 0.7, 3
#: Items in a block, and segments in one part of the index.
BLOCK, PART_ENTRIES = 4, 1024
K1, B = 1.2, 0.75
words_of = re.compile(r"\w+").findall


def question_and_answer(text: str) -> tuple[list[str], list[str]]:
    """Words before the last sentence, and of it; a single sentence is cut after two thirds."""
    sentences = [w for s in re.split(r"(?<=[.!?])\s+|\n", text) if (w := words_of(s.lower()))]
    if len(sentences) > 1:
        return [w for s in sentences[:-1] for w in s], sentences[-1]
    words = sentences[0] if sentences else []
    cut = (2 * len(words) + 2) // 3
    return words[:cut], words[cut:]


def grams(words: Sequence[str]) -> set[tuple[str, ...]]:
    """Word triples; what is shorter is one gram, nothing has none."""
    return {tuple(words[i : i + GRAM]) for i in range(max(1, len(words) - GRAM + 1))} if words else set()


def covered(wanted: set[tuple[str, ...]], words: Sequence[str]) -> float:
    """Share of the grams that the words hold; 1 if none is wanted."""
    if not wanted:
        return 1.0
    there = {n: {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} for n in {len(g) for g in wanted}}
    return sum(g in there[len(g)] for g in wanted) / len(wanted)


@dataclass
class Posting:
    entries: list[int]
    impacts: list[float]
    largest: float
    blocks: dict[int, float]


@dataclass
class Statistics:
    """Segments, their words, and how many segments hold a term."""

    segments: int
    words: int
    holders: dict[str, int]


def segments_of(text: str) -> list[list[str]]:
    question, answer = question_and_answer(text)
    words = question + answer
    return [words[i : i + SEGMENT] for i in range(0, len(words), SEGMENT)]


def statistics_of(segments: Iterable[list[str]]) -> Statistics:
    out = Statistics(0, 0, Counter())
    for words in segments:
        out.segments += 1
        out.words += len(words)
        out.holders.update({*words})
    return out


class Index:
    """Inverted index of test items (id, text) with BM25 impacts and their maxima per block.

    ``statistics`` are those of the whole benchmark, and may be left out if the items are all of it.
    """

    def __init__(self, items: Sequence[tuple[int, str]], statistics: Statistics | None = None):
        self.items = items
        self.parts = [question_and_answer(text or "") for _, text in items]
        segments = [(k, words) for k, (_, text) in enumerate(items) for words in segments_of(text or "")]
        self.item_of = [k for k, _ in segments]
        counts = [Counter(w) for _, w in segments]
        whole = statistics or statistics_of(w for _, w in segments)
        n, mean, holders = whole.segments, whole.words / max(1, whole.segments), whole.holders
        self.term = {t: i for i, t in enumerate(dict.fromkeys(t for c in counts for t in c))}
        lists: dict[int, list[tuple[int, float]]] = defaultdict(list)
        for e, ((_, words), count) in enumerate(zip(segments, counts)):
            norm = K1 * (1 - B + B * len(words) / mean)
            impact = {
                t: math.log(1 + (n - holders[t] + 0.5) / (holders[t] + 0.5)) * f * (K1 + 1) / (f + norm) for t, f in count.items()
            }
            own = sum(impact.values())
            for t, x in impact.items():
                lists[self.term[t]].append((e, x / own))
        self.postings = [self._posting(lists[i]) for i in range(len(self.term))]
        self.bounds = np.zeros((len(self.term), -(-len(segments) // BLOCK)), np.float32)
        for i, p in enumerate(self.postings):
            for b, x in p.blocks.items():
                self.bounds[i, b] = x

    @staticmethod
    def _posting(pairs: list[tuple[int, float]]) -> Posting:
        blocks: dict[int, float] = {}
        for e, x in pairs:
            blocks[e // BLOCK] = max(x, blocks.get(e // BLOCK, 0.0))
        return Posting([e for e, _ in pairs], [x for _, x in pairs], max(blocks.values()), blocks)

    def search(self, terms: Sequence[int], threshold: float = RETRIEVE) -> list[tuple[int, float]]:
        """Entries whose score against the distinct terms reaches the threshold, by block-max WAND."""
        need = threshold - 1e-6
        cursors = [[self.postings[t].entries[0], 0, self.postings[t]] for t in terms]
        out = []
        while cursors:
            cursors.sort(key=lambda c: c[0])
            bound, pivot = 0.0, None
            for k, (_, _, p) in enumerate(cursors):
                bound += p.largest
                if bound >= need:
                    pivot = k
                    break
            if pivot is None:
                break
            target = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == target:
                pivot += 1
            block = target // BLOCK
            if sum(p.blocks.get(block, 0.0) for _, _, p in cursors[: pivot + 1]) < need:
                # No entry of this block can make it with these lists; the next list may join before its end.
                until = (block + 1) * BLOCK
                if pivot + 1 < len(cursors):
                    until = min(until, cursors[pivot + 1][0])
                self._advance(cursors, pivot + 1, max(until, target + 1))
            elif cursors[0][0] == target:
                score = sum(p.impacts[at] for _, at, p in cursors[: pivot + 1])
                if score >= need:
                    out.append((target, score))
                self._advance(cursors, pivot + 1, target + 1)
            else:
                self._advance(cursors, pivot, target)
        return out

    @staticmethod
    def _advance(cursors: list, n: int, until: int) -> None:
        """Moves the first ``n`` cursors to their first entry at or after ``until``; drops those at their end."""
        for c in cursors[:n]:
            c[1] = bisect_left(c[2].entries, until, c[1])
            c[0] = c[2].entries[c[1]] if c[1] < len(c[2].entries) else None
        cursors[:] = [c for c in cursors if c[0] is not None]

    def passages(self, texts: Sequence[list[str]]) -> Iterator[tuple[int, int, list[int]]]:
        """(text, first word, distinct terms) of the passages in which some block can reach the threshold."""
        get, n_terms = self.term.get, len(self.term)
        if not n_terms:
            return
        found = [np.array([get(w, -1) for w in words], np.int32) for words in texts]
        starts: list[tuple[int, int]] = []
        keys = []
        for k, ids in enumerate(found):
            at = np.flatnonzero(ids >= 0)
            if not len(at):
                continue
            last = max(0, -(-(len(ids) - PASSAGE) // STRIDE))  # passages 0 .. last cover all words
            cell = at // STRIDE
            base, terms = len(starts), ids[at].astype(np.int64)
            keys.append((base + np.minimum(cell, last)) * n_terms + terms)
            keys.append((base + np.maximum(np.minimum(cell - 1, last), 0)) * n_terms + terms)
            starts += [(k, STRIDE * p) for p in range(last + 1)]
        if not keys:
            return
        pairs = np.unique(np.concatenate(keys))
        passage, terms = pairs // n_terms, pairs % n_terms
        cuts = np.flatnonzero(np.concatenate(([True], passage[1:] != passage[:-1])))
        best = np.full(len(cuts), -1.0, np.float32)
        ends = np.append(cuts[1:], len(pairs))
        step = max(16, (1 << 16) // self.bounds.shape[1])
        for lo in range(0, len(cuts), step):
            hi = min(lo + step, len(cuts))
            rows = self.bounds[terms[cuts[lo] : ends[hi - 1]]]
            best[lo:hi] = np.add.reduceat(rows, cuts[lo:hi] - cuts[lo], axis=0).max(axis=1)
        for i in np.flatnonzero(best >= RETRIEVE - 1e-3):
            k, start = starts[passage[cuts[i]]]
            yield k, start, terms[cuts[i] : ends[i]].tolist()

    def leaks(self, texts: Sequence[str]) -> Iterator[tuple[int, int, float, float, float]]:
        """(text, item, score, question and answer overlap) of the verified items, once per text and item."""
        words = [words_of(t.lower()) for t in texts]
        best: dict[tuple[int, int], tuple[float, float, float]] = {}
        for k, start, terms in self.passages(words):
            for entry, score in self.search(terms):
                item = self.item_of[entry]
                question, answer = self.parts[item]
                margin = len(question) + len(answer)
                around = words[k][max(0, start - margin) : start + PASSAGE + margin]
                overlaps = covered(grams(question), around), covered(grams(answer), around)
                if min(overlaps) >= VERIFY:
                    best[k, item] = max(best.get((k, item), (0.0, 0.0, 0.0)), (score, *overlaps))
        for (k, item), (score, question_overlap, answer_overlap) in sorted(best.items()):
            yield k, item, score, question_overlap, answer_overlap


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments that hold a term, summed per batch; the row without a term has the number of segments and their words."""
    for batch in batches:
        own = statistics_of(words for text in batch.column(0).to_pylist() for words in segments_of(text or ""))
        terms, holders = [None, *own.holders], [own.segments, *own.holders.values()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(terms, pa.string()), pa.array(holders, pa.int64()), pa.array([own.words] + [0] * len(own.holders), pa.int64())],
            names=["term", "holders", "words"],
        )


def _statistics(counts: DataFrame, rows: Sequence[tuple[int, str]]) -> Statistics:
    """The benchmark's statistics, with the terms of these rows only."""
    own = {w for _, text in rows for words in segments_of(text) for w in words}
    wanted = counts.sparkSession.createDataFrame([(w,) for w in own], "term string")
    found = counts.join(F.broadcast(wanted), "term").collect()  # no more terms than the rows of one part have
    total = counts.where("term IS NULL").first()
    return Statistics(total.holders, total.words, {r.term: r.holders for r in found})


def _indexes(benchmark: DataFrame, item_col: str, text_col: str) -> Iterator[Index]:
    """The benchmark's index, part by part; only one part is held. The statistics are those of the whole benchmark."""
    counts: DataFrame | None = None
    rows: list[tuple[int, str]] = []
    size = 0
    for row in benchmark.select(item_col, text_col).toLocalIterator():
        entries = -(-len(words_of(row[1] or "")) // SEGMENT)
        if not entries:
            continue
        if rows and size + entries > PART_ENTRIES:
            if counts is None:
                counted = benchmark.select(text_col).mapInArrow(_counted, "term string, holders bigint, words bigint")
                counts = materialise(counted.groupBy("term").agg(F.sum("holders").alias("holders"), F.sum("words").alias("words")))
            yield Index(rows, _statistics(counts, rows))
            rows, size = [], 0
        rows.append((row[0], row[1]))
        size += entries
    if rows:
        yield Index(rows, None if counts is None else _statistics(counts, rows))


#: Characters of text handled at a time within a batch.
SLICE_CHARS = 4_000_000


def _slices(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    lo = size = 0
    for k, t in enumerate(texts):
        size += len(t)
        if size >= SLICE_CHARS:
            yield lo, texts[lo : k + 1]
            lo, size = k + 1, 0
    if lo < len(texts):
        yield lo, texts[lo:]


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id"
) -> DataFrame:
    """One row per document and benchmark item that it holds: ``id_col``, ``item_col``, score,
    question_overlap, answer_overlap.

    Words are runs of letters and digits in lower case. Null and empty texts and items hold nothing;
    repeated rows give repeated results; an empty benchmark gives no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    kind, item_kind = docs.schema[id_col].dataType, benchmark.schema[item_col].dataType
    schema = T.StructType(
        [T.StructField("id", kind), T.StructField("item", item_kind)]
        + [T.StructField(c, T.DoubleType()) for c in ("score", "question_overlap", "answer_overlap")]
    )
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    parts = []
    for index in _indexes(benchmark, item_col, text_col):
        shared = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in batches:
                out = []
                for lo, texts in _slices([t or "" for t in batch.column(1).to_pylist()]):
                    out += [(lo + k, index.items[i][0], *x) for k, i, *x in index.leaks(texts)]
                if out:
                    at, item, *scores = zip(*out)
                    columns = [batch.column(0).take(pa.array(at)), *map(pa.array, (item, *scores))]
                    yield pa.RecordBatch.from_arrays(columns, names=schema.names)

        parts.append(rows.mapInArrow(run, schema))
    found = parts[0] if parts else spark.createDataFrame([], schema)
    for more in parts[1:]:
        found = found.union(more)
    return found.withColumnsRenamed({"id": id_col, "item": item_col})


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, as they are; nothing is shuffled."""
    spark, place = docs.sparkSession, docs.columns.index(text_col)
    for index in _indexes(benchmark, item_col, "text"):
        shared = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                for lo, texts in _slices([t or "" for t in batch.column(place).to_pylist()]):
                    for k, *_ in shared.value.leaks(texts):
                        keep[lo + k] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
