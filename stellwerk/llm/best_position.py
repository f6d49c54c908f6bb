"""Ranked lexical search by the Best Position Algorithm.

Every document's words that some query asks for are written once with their counts. Documents are
then searched block by block: within a block each term has a list of its documents by falling impact.
A query reads its lists in parallel, looks each document it meets up in all of them by direct access, and marks every
position that was seen either way. The best position of a list is the end of the positions seen without a
gap; what no access has met lies behind all of them, so it scores at most the sum of the impacts next
to be seen. The search of a block ends when that sum is strictly below the k-th best score so
far, the blocks before it included, so that documents of equal score are never left out.

Blocks split the documents, not the terms: a word of every document is a list in every block, each of
bounded length, and only k documents of each query leave a task.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DataType, LongType, StructField, StructType

from stellwerk.session import materialise

#: Characters of query text searched for in one pass over the documents, postings of a block, and
#: positions read from each list in a query's first step; every further step reads twice as many.
PART_CHARS, BLOCK, FIRST_STEP = 8_000_000, 2_000_000, 16
#: Fixed values of the score.
WEIGHT_SCALE, TF_SCALE, LENGTH_SHARE = 1000, 1_000_000_000, 50
#: Every byte that is no part of a term to a blank, A-Z to lower case.
_TABLE = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)


def terms_of(text: bytes | None) -> list[bytes]:
    """Terms of a text in UTF-8: runs of letters and digits of ASCII and of all other characters."""
    return text.translate(_TABLE).split() if text else []


@dataclass(frozen=True)
class Corpus:
    """Documents with a term, all their terms, and documents for each term of the queries."""

    documents: int
    terms: int
    holders: dict[int, int]

    def weight(self, term: int) -> int:
        return math.floor(WEIGHT_SCALE * math.log((2 * self.documents + 2) / (2 * self.holders.get(term, 0) + 1)))


class Block:
    """Impact lists of some documents, which are numbered by rising id."""

    def __init__(self, lengths: np.ndarray, docs: np.ndarray, terms: np.ndarray, counts: np.ndarray, corpus: Corpus, weights: np.ndarray):
        """``lengths`` by document; ``docs``, ``terms`` and ``counts`` are parallel, one entry per posting."""
        share = 100 - LENGTH_SHARE + (LENGTH_SHARE * lengths * corpus.documents) // max(corpus.terms, 1)
        counts = counts.astype(np.int64)
        impact = weights[terms] * ((TF_SCALE * counts) // (1000 * counts + 20 * share[docs]))
        some = impact > 0
        docs, terms, impact = docs[some], terms[some], impact[some]
        self.size = len(lengths)
        by_doc = np.lexsort((docs, terms))
        docs, terms, impact = docs[by_doc], terms[by_doc], impact[by_doc]
        order = np.lexsort((docs, -impact, terms))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        #: In the order of terms, then documents: documents, impacts, places in the other order.
        self.docs, self.impacts, self.places = docs, impact, place
        #: In the order of terms, then falling impacts.
        self.ranked_docs, self.ranked_impacts = docs[order], impact[order]
        self.first = np.searchsorted(terms, np.arange(len(weights) + 1))

    def search(self, query: Sequence[int], k: int, floor: list[int], step: int = FIRST_STEP) -> tuple[np.ndarray, np.ndarray, int]:
        """Documents that can be among the k best, with their scores, and the accesses made.

        ``floor`` has the scores of the best documents of earlier blocks, at most k.
        """
        spans = [(int(self.first[t]), int(self.first[t + 1])) for t in query]
        spans = [(lo, hi) for lo, hi in spans if lo < hi]
        seen = [np.zeros(hi - lo, bool) for lo, hi in spans]
        best = [0] * len(spans)
        met = np.zeros(self.size, bool)
        docs, scores, accesses = [], [], 0
        kth = min(floor) if len(floor) >= k else -1
        while True:
            bound = sum(int(self.ranked_impacts[lo + b]) for (lo, hi), b in zip(spans, best) if lo + b < hi)
            if bound < kth or not any(lo + b < hi for (lo, hi), b in zip(spans, best)):
                break
            fresh = []
            for (lo, hi), b, marks in zip(spans, best, seen):
                stop = min(b + step, hi - lo)
                fresh.append(self.ranked_docs[lo + b : lo + stop][~marks[b:stop]])
                marks[b:stop] = True
            new = np.unique(np.concatenate(fresh))
            new = new[~met[new]]
            met[new] = True
            total = np.zeros(len(new), np.int64)
            for n, ((lo, hi), marks) in enumerate(zip(spans, seen)):
                at = np.minimum(np.searchsorted(self.docs[lo:hi], new), hi - lo - 1) + lo
                found = self.docs[at] == new
                at = at[found]
                total[found] += self.impacts[at]
                marks[self.places[at] - lo] = True
                behind = marks[best[n] :]
                best[n] += int(behind.argmin()) if len(behind) and not behind.all() else len(behind)
            accesses += len(new) * len(spans)
            docs.append(new)
            scores.append(total)
            known = np.concatenate([*scores, np.array(floor, np.int64)])
            if len(known) >= k:
                kth = int(np.partition(known, len(known) - k)[len(known) - k])
            step *= 2
        if not docs:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), accesses
        every, total = np.concatenate(docs), np.concatenate(scores)
        good = (total >= kth) & (total > 0)
        every, total = every[good], total[good]
        order = np.lexsort((every, -total))[:k]
        return every[order], total[order], accesses


def _key(entry: tuple[int, Any]) -> tuple:
    score, doc = entry
    return -score, doc is None, 0 if doc is None else doc


def _search_all(
    batches: Iterable[pa.RecordBatch], queries: Sequence[tuple[Any, Sequence[int]]], corpus: Corpus, weights: np.ndarray, k: int
) -> list[list[tuple[int, Any]]]:
    """The k best (score, id) of each query among the batches' documents (id, n, terms, counts)."""
    best: list[list[tuple[int, Any]]] = [[] for _ in queries]
    for block in _blocks(batches):
        ids, lengths, terms, counts, offsets = block
        docs = np.repeat(np.arange(len(ids)), np.diff(offsets))
        lists = Block(lengths, docs, terms, counts, corpus, weights)
        for q, (_, query) in enumerate(queries):
            found, scores, _ = lists.search(query, k, [s for s, _ in best[q]])
            if len(found):
                names = ids.take(pa.array(found)).to_pylist()
                best[q] = heapq.nsmallest(k, best[q] + list(zip(scores.tolist(), names)), key=_key)
    return best


def _blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Documents by rising id in blocks of about BLOCK postings: ids, lengths, terms, counts, and where each begins."""
    held: list[pa.RecordBatch] = []
    size = 0

    def block() -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        table = pa.Table.from_batches(held)
        table = table.sort_by([(table.column_names[0], "ascending")]).combine_chunks()
        ids, lengths, terms, counts = (c.combine_chunks() for c in table.columns)
        offsets = np.concatenate(([0], np.cumsum(terms.value_lengths().to_numpy(zero_copy_only=False)))).astype(np.int64)
        flat = (x.flatten().to_numpy(zero_copy_only=False) for x in (terms, counts))
        return ids, lengths.to_numpy(zero_copy_only=False), *flat, offsets

    for batch in batches:
        for lo in range(0, batch.num_rows, 2000):
            piece = batch.slice(lo, 2000)
            held.append(piece)
            size += len(piece.column(2).flatten())
            if size >= BLOCK:
                yield block()
                held, size = [], 0
    if held:
        yield block()


def _counted(docs: DataFrame, vocabulary: dict[bytes, int], id_col: str, text_col: str) -> DataFrame:
    """One row per document with a term: id, n, and the queries' terms in it with their counts."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = shared.value
        for batch in batches:
            lengths, terms, counts = [], [], []
            for text in batch.column(1).cast(pa.large_binary()):
                words = terms_of(text.as_py())
                tally: dict[int, int] = {}
                for t in map(number.get, words):
                    if t is not None:
                        tally[t] = tally.get(t, 0) + 1
                lengths.append(len(words))
                terms.append(list(tally))
                counts.append(list(tally.values()))
            columns = [pa.array(lengths, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int32()))]
            out = pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["id", "n", "terms", "counts"])
            yield out.filter(pa.array([n > 0 for n in lengths], pa.bool_()))

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, n bigint, terms array<int>, counts array<int>")


def _search_part(docs: DataFrame, items: Sequence[tuple[Any, str | None]], item_type: DataType, k: int, id_col: str, text_col: str) -> DataFrame:
    """item, doc, score: each task's k best of every item."""
    asked: dict[Any, set[bytes]] = {}
    for item, text in items:
        asked.setdefault(item, set()).update(terms_of((text or "").encode()))
    vocabulary = {t: n for n, t in enumerate(sorted(set().union(*asked.values())))}
    index = materialise(_counted(docs, vocabulary, id_col, text_col))
    whole = index.agg(F.count("*").alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    holders = index.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("n")).collect()
    corpus = Corpus(whole.documents, whole.terms, {r.term: r.n for r in holders})
    weights = np.array([corpus.weight(t) if t in corpus.holders else 0 for t in range(len(vocabulary))], np.int64)
    queries = [(item, sorted(vocabulary[t] for t in terms)) for item, terms in asked.items() if terms]
    shared = docs.sparkSession.sparkContext.broadcast((queries, corpus, weights))
    fields = StructType(
        [StructField("item", item_type), StructField("doc", docs.schema[id_col].dataType), StructField("score", LongType())]
    )
    schema = to_arrow_schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, corpus, weights = shared.value
        best = _search_all(batches, queries, corpus, weights, k)
        for lo in range(0, len(queries), 200):
            rows = [
                {"item": queries[q][0], "doc": doc, "score": score} for q in range(lo, min(lo + 200, len(queries))) for score, doc in best[q]
            ]
            yield from pa.Table.from_pylist(rows, schema).to_batches()

    return index.mapInArrow(run, fields)


def search(
    docs: DataFrame,
    items: DataFrame,
    k: int = 50,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """``item_col``, rank (from 1), ``id_col``, score of the k best documents of each item, scores above 0 only.

    Equal scores are ranked by rising id, a null id last. Items that share an id, or have none, are one
    item of all their terms; an item without a term, or whose terms no document holds, has no rows. Rows of
    ``docs`` are documents of their own, repeated ones too; a null or empty text has no term and does not count.
    Items beyond PART_CHARS are searched in several passes, with the same scores. Other columns are not read.
    """
    item_type = items.schema[item_col].dataType
    asked = items.select(F.col(item_col).alias("item"), F.col(item_text_col).alias("text"))
    size = asked.agg(F.coalesce(F.sum(F.length("text").cast("bigint")), F.lit(0))).first()[0]
    parts = max(1, math.ceil(size / PART_CHARS))
    number = F.pmod(F.xxhash64("item"), F.lit(parts))
    found = [
        _search_part(docs, [tuple(r) for r in asked.where(number == p).collect()], item_type, k, id_col, text_col) for p in range(parts)
    ]
    every = reduce(DataFrame.unionAll, found)
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc"))
    ranked = every.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select(F.col("item").alias(item_col), "rank", F.col("doc").alias(id_col), "score")
