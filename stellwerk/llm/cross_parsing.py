"""Language identification by cross-parsing entropy.

Each language has a suffix automaton of a reference: a sample of labelled text. A document is
parsed against it into the longest phrases that occur in the reference; a document in the
same language needs few of them. Phrases are normalised to bits per character,
``phrases * log2(reference length) / characters``, an estimate of the cross entropy, and the
language with the fewest wins. Its score is its weight against the others', and against parsing
into little more than single letters, which is what an unknown script comes to.

Texts of a batch are parsed side by side, one character of each at a time in each language, so
the work is array look-ups in the automata's transition tables.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bounds of the labelled sample: texts for each language, characters taken from one text (a stretch
#: at a place that follows from a hash), and characters of a reference.
SAMPLE_TEXTS, STRETCH, REFERENCE = 120, 400, 30_000
#: Letters with a column in the transition tables, the most frequent ones; arcs of all others are in a sorted list.
LETTERS = 62
#: Characters per phrase, on average, below which a text is not in a language.
LEAST_PHRASE = 4 / 3
#: Below this weight against single letters no language of the sample fits a text, however the languages compare.
MIN_FIT = 0.5
#: Below this score a text cannot be told from another language's; it is kept as long as one fits.
MIN_SCORE = 0.4
UNKNOWN = "und"
#: Stands for letters that are left out of a reference.
NO_LETTER = "\ue000"
#: Characters parsed side by side within a batch.
SLICE_CHARS = 2_000_000


def held_out(id_col: str) -> Column:
    """Whether a row is kept out of training: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def suffix_automaton(codes: Sequence[int]) -> list[dict[int, int]]:
    """Transitions of the suffix automaton: state 0 reads every substring of the codes."""
    step: list[dict[int, int]] = [{}]
    length, link = [0], [-1]
    last = 0
    for c in codes:
        new = len(step)
        step.append({})
        length.append(length[last] + 1)
        link.append(0)
        at = last
        while at >= 0 and c not in step[at]:
            step[at][c] = new
            at = link[at]
        if at >= 0:
            old = step[at][c]
            if length[old] == length[at] + 1:
                link[new] = old
            else:
                copy = len(step)
                step.append(dict(step[old]))
                length.append(length[at] + 1)
                link.append(link[old])
                while at >= 0 and step[at].get(c) == old:
                    step[at][c] = copy
                    at = link[at]
                link[old] = link[new] = copy
        last = new
    return step


class CrossParser:
    """Parses texts against the references of several languages."""

    def __init__(self, references: Sequence[tuple[str, str]]):
        self.languages = [lang for lang, _ in references]
        seen = Counter(c for _, text in references for c in text.lower() if c.isalpha())
        letters = [c for c, _ in sorted(seen.items(), key=lambda x: (-x[1], x[0]))]
        #: 0: anything that is no letter; 1, 2, ...: letters by falling frequency; the last code: letters of no reference.
        #: The last column of a table is for the codes without one of their own.
        self._other, self._width = len(letters) + 1, min(len(letters), LETTERS) + 2
        self._code = np.zeros(0x110000, np.int32)
        self._is_letter = np.zeros(0x110000, bool)
        known: list[int] = [c for c in range(0x110000) if chr(c).isalpha()]
        self._code[known], self._is_letter[known] = self._other, True
        for i, c in enumerate(letters, 1):
            self._code[ord(c)] = i
        tables, first = [np.full((1, self._width), -1, np.int32)], 1  # row 0: reads nothing
        self._root, self._bits = [], []
        #: Where a new phrase stands that starts with a code: at the empty row if no phrase does.
        self._start = np.zeros((len(references), self._other + 1), np.int32)
        rare: list[tuple[int, int]] = []
        for k, (_, text) in enumerate(references):
            codes, _, _ = self._encode([text])
            steps = suffix_automaton(codes.tolist())
            table = np.full((len(steps), self._width), -1, np.int32)
            for s, arcs in enumerate(steps):
                for c, to in arcs.items():
                    if c < self._width - 1:
                        table[s, c] = (first + to) * self._width
                    elif c != self._other:
                        rare.append(((first + s) * self._other + c, (first + to) * self._width))
            for c, to in steps[0].items():
                self._start[k, c] = (first + to) * self._width if c != self._other else 0
            tables.append(table)
            self._root.append(first)
            self._bits.append(math.log2(max(2, len(codes))))
            first += len(steps)
        self._next = np.concatenate(tables).ravel()
        rare.sort()
        self._rare_keys, self._rare_to = np.array([x for x, _ in rare], np.int64), np.array([x for _, x in rare], np.int32)

    def _read_rare(self, state: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Where the states (languages x texts) read codes without a column, -1 if nowhere."""
        keys = state // self._width * np.int64(self._other) + codes
        at = np.minimum(np.searchsorted(self._rare_keys, keys), len(self._rare_keys) - 1)
        return np.where(self._rare_keys[at] == keys, self._rare_to[at], -1)

    def _encode(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Codes of the texts end to end, with runs of what is no letter made one; codes and letters of each."""
        lowered = [t.lower() for t in texts]
        points = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
        owner = np.repeat(np.arange(len(texts)), [len(t) for t in lowered])
        codes = self._code[points]
        keep = np.ones(len(codes), bool)
        keep[1:] = (codes[1:] != 0) | (codes[:-1] != 0) | (owner[1:] != owner[:-1])
        letters = np.bincount(owner[self._is_letter[points]], minlength=len(texts))
        return codes[keep], np.bincount(owner[keep], minlength=len(texts)), letters

    def phrases(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Phrases of each text in each language (languages x texts), and characters and letters of each text."""
        codes, sizes, letters = self._encode(texts)
        starts = np.concatenate(([0], np.cumsum(sizes)[:-1])) if len(sizes) else sizes
        order = np.argsort(-sizes, kind="stable")
        at, n = starts[order], len(self.languages)
        # Texts by falling length: those longer than a position are the first ones.
        active = np.searchsorted(-sizes[order], -np.arange(1, int(sizes.max(initial=0)) + 1), side="right")
        count = np.zeros((n, len(texts)), np.int32)
        state = np.repeat(np.array(self._root, np.int32)[:, None] * self._width, len(texts), axis=1)
        columns = np.minimum(codes, self._width - 1)
        for position, k in enumerate(active.tolist()):
            places = at[:k] + position
            c = codes[places]
            to = self._next[state[:, :k] + columns[places]]
            if len(self._rare_keys) and len(rare := np.flatnonzero((c >= self._width - 1) & (c != self._other))):
                to[:, rare] = self._read_rare(state[:, rare], c[rare])
            ended = to < 0
            if position:  # at the start there is no phrase to end
                count[:, :k] += ended
            np.copyto(to, self._start[:, c], where=ended)
            state[:, :k] = to
        count[:, order] = count + (sizes[order] > 0)
        return count, sizes, letters

    def predict(self, texts: Sequence[str]) -> list[tuple[str, float]]:
        """Language and score of each text; ``und`` and 0 without a letter or a language to choose.

        Of equally good languages the first by name is given; the score says that there are others.
        """
        return [(lang, score) for lang, score, _ in self.judge(texts)]

    def judge(self, texts: Sequence[str]) -> list[tuple[str, float, float]]:
        """Language, score and fit of each text. The fit is the language's weight against single letters alone;
        a text that is one phrase as a whole fits."""
        if not self.languages:
            return [(UNKNOWN, 0.0, 0.0)] * len(texts)
        out: list[tuple[str, float, float]] = []
        for block in _slices(texts):
            count, sizes, letters = self.phrases(block)
            bits = count * np.array(self._bits)[:, None] / np.maximum(sizes, 1)
            best = bits.argmin(axis=0)
            # One more rival: a language that offers next to nothing but single letters.
            least = bits.min(axis=0)
            rivals = np.concatenate((bits, np.full((1, len(block)), min(self._bits) / LEAST_PHRASE)))
            score = 1 / np.exp2(np.minimum(-6 * (rivals - least), 500)).sum(axis=0)
            fit = 1 / (1 + np.exp2(np.clip(-6 * (rivals[-1] - least), -500, 500)))
            fit = np.where((count.min(axis=0) <= 1) & (sizes > 1), 1.0, fit)
            out += [
                (self.languages[b], float(s), float(f)) if some else (UNKNOWN, 0.0, 0.0)
                for b, s, f, some in zip(best, score, fit, letters > 0)
            ]
        return out


def _slices(texts: Sequence[str]) -> Iterator[Sequence[str]]:
    lo = size = 0
    for k, t in enumerate(texts):
        size += len(t)
        if size >= SLICE_CHARS:
            yield texts[lo : k + 1]
            lo, size = k + 1, 0
    if lo < len(texts):
        yield texts[lo:]


def references(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> list[tuple[str, str]]:
    """(language, reference text) by language, from a bounded sample of the rows that are not held out.

    Rows are drawn by a hash of their id at a rate that follows from the language's number of
    rows; SAMPLE_TEXTS different stretches of each language at most come to the driver, at any size.
    """
    rows = docs.where(~held_out(id_col) & F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")
    ).where(F.col("lang").isNotNull() & (F.length("text") > 0))
    counts = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return []
    rate = F.lit(0.0)
    for lang, n in sorted(counts.items()):
        rate = F.when(F.col("lang") == lang, min(1.0, 1.5 * SAMPLE_TEXTS / n)).otherwise(rate)
    hash_ = F.xxhash64("id")
    place = F.pmod(hash_, F.greatest(F.length("text") - STRETCH, F.lit(0)) + 1).cast("int") + 1
    drawn = rows.where(F.pmod(hash_, F.lit(1 << 20)) < rate * (1 << 20)).select(
        "lang", F.pmod(hash_, F.lit(1 << 20)).alias("order"), F.substring("text", place, F.lit(STRETCH)).alias("stretch")
    )
    # Copies, and rows that share an id, count once; what is beyond the sample is cut on the cluster.
    once = drawn.groupBy("lang", "stretch").agg(F.min("order").alias("order"))
    by = Window.partitionBy("lang").orderBy("order", "stretch")
    kept = once.withColumn("at", F.row_number().over(by)).where(F.col("at") <= SAMPLE_TEXTS)
    texts: dict[str, list[str]] = {}
    for r in kept.orderBy("lang", "at").collect():
        texts.setdefault(r.lang, []).append(r.stretch)
    return [(lang, reference(t)[:REFERENCE]) for lang, t in sorted(texts.items())]


def reference(texts: Sequence[str]) -> str:
    """One text of the sampled ones, in which letters that a single one of them has do not count as the language's.

    Otherwise a text of another script under a wrong label would be read as one phrase of its own.
    A language of a single text has its letters.
    """
    seen = Counter(c for t in texts for c in set(t.lower()) if c.isalpha())
    if len(texts) < 2:
        return " ".join(texts)
    return " ".join("".join(NO_LETTER if c.isalpha() and any(seen[x] < 2 for x in c.lower() if x.isalpha()) else c for c in t) for t in texts)


@lru_cache(maxsize=1)
def _parser(reference: tuple[tuple[str, str], ...]) -> CrossParser:
    """The automata of one worker process; they are built there from the references, which are small."""
    return CrossParser(reference)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``id_col``, held_out, lang_pred, score (0 to 1) for every row.

    Learns from text and non-null lang of the rows that are not held out. A null text, or one
    without a letter, is ``und`` with score 0, as is everything if no row can be learned from.
    A row without an id is not held out and not learned from. Repeated rows get equal results;
    other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(tuple(references(docs, id_col, text_col, lang_col)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = _parser(shared.value)
        for batch in batches:
            found = parser.predict([t or "" for t in batch.column(1).to_pylist()])
            columns = [pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["id", "lang_pred", "score"])

    rows = docs.select(F.struct(F.col(id_col).alias("i"), held_out(id_col).alias("h")).alias("id"), F.col(text_col).alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    found = rows.mapInArrow(run, f"id struct<i:{kind},h:boolean>, lang_pred string, score double")
    return found.select(F.col("id.i").alias(id_col), F.col("id.h").alias("held_out"), "lang_pred", "score")


def keep_identified(
    docs: DataFrame, min_fit: float = MIN_FIT, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang"
) -> DataFrame:
    """The rows of ``docs`` in a language of the sample, as they are: ``und`` and texts that no language fits go.

    A text that several languages fit alike, as short ones do, stays. The rows are not shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast(tuple(references(docs, id_col, text_col, lang_col)))
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = _parser(shared.value)
        for batch in batches:
            found = parser.judge([t or "" for t in batch.column(place).to_pylist()])
            yield batch.filter(pa.array([lang != UNKNOWN and fit >= min_fit for lang, _, fit in found], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
