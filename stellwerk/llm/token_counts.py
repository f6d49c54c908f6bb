"""Token counts by byte-pair merging on a heap and a linked list.

Only the number of tokens is wanted, so no identifier is looked up: a word of n symbols
that undergoes m merges has n - m tokens. A word's count is remembered by the task, since
a corpus repeats its words; that memory is bounded, whatever the data.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stellwerk.llm.presplit import Remembered, WordVocabulary

#: Words in each of the two generations that a worker process remembers.
REMEMBERED_WORDS = 300_000


class MergeCounter:
    """Counts the tokens of words and texts under a vocabulary's merges."""

    def __init__(self, vocabulary: WordVocabulary):
        self._vocabulary = vocabulary
        self._ranks = {pair: rank for rank, pair in enumerate(vocabulary.merges)}
        self._known = Remembered(self.word, REMEMBERED_WORDS)

    def word(self, word: str) -> int:
        """Tokens of one word: its symbols less the merges made, lowest rank and leftmost first."""
        symbols = self._vocabulary.symbols(word)
        ranks, n = self._ranks, len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i) for i in range(n - 1) if (r := ranks.get((symbols[i], symbols[i + 1]))) is not None]
        heapq.heapify(heap)
        merges = 0
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i]
            # An entry is stale when either side has been merged since it was pushed.
            if symbols[i] is None or j >= n or ranks.get((symbols[i], symbols[j])) != rank:
                continue
            symbols[i] += symbols[j]
            symbols[j] = None
            merges += 1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := ranks.get((symbols[i], symbols[k]))) is not None:
                    heapq.heappush(heap, (r, i))
            if (h := before[i]) >= 0 and (r := ranks.get((symbols[h], symbols[i]))) is not None:
                heapq.heappush(heap, (r, h))
        return n - merges

    def text(self, text: str) -> int:
        """Tokens of a whole text; an added token inside it counts as one."""
        total, known = 0, self._known
        for words, special in self._vocabulary.words(text):
            total += (special is not None) + sum(map(known.__getitem__, words))
        return total


@lru_cache(maxsize=2)
def _counter(path: str) -> MergeCounter:
    """One counter for each worker process and file."""
    return MergeCounter(WordVocabulary(path))


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, n_bytes, n_tokens, over_limit for every row.

    A null text counts as empty: 0 bytes, 0 tokens. Repeated rows are kept as they are; other
    columns are not read, so extra ones do not matter. ``tokenizer_path`` must exist on every
    executor.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(tokenizer_path)
        for batch in batches:
            counts = [counter.text(t.as_py() or "") for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64())], names=["id", "n_tokens"])

    rows = docs.select(F.struct(F.col(id_col).alias("i"), F.octet_length(text_col).cast("long").alias("b")).alias("id"), F.col(text_col).alias("t"))
    counted = rows.mapInArrow(run, f"id struct<i:{docs.schema[id_col].dataType.simpleString()},b:bigint>, n_tokens bigint")
    return counted.select(
        F.col("id.i").alias(id_col),
        F.coalesce("id.b", F.lit(0)).cast("long").alias("n_bytes"),
        "n_tokens",
        (F.col("n_tokens") > limit).alias("over_limit"),
    )
