"""BPE encoding and decoding by a tokenization automaton.

The automaton reads tokens and accepts exactly the token strings that the merges produce. It
starts as one state that loops on every base symbol. Merges are compiled in one after
another; the gadget of a merge ``u v -> uv``

* splits the state that ``u`` leads to: ``u`` now leads to a copy of it without the arc ``v``,
  so that ``u v`` can no longer be read as two tokens;
* adds an arc ``uv`` to every state that has an arc ``u``, leading where ``v`` leads (if ``u`` led to
  a state with an arc ``v``; otherwise nothing ever spells ``u v``).

All arcs of one token lead to one state (true at the start and kept by every gadget), so a
state is named by a token that leads to it. Written out, the table would have states x tokens
entries; it is kept as what the gadgets changed: the arc that each copy lost, and when. A
state is a copy of the one that the second part of its token led to, and an arc exists where
the arc of its first part did, which gives any entry by a few look-ups.

Encoding walks the arcs that spell the word, longest label first. Every beginning of a word has
one tokenization, so a position from which the walk cannot go on is never tried again, and
the walk is linear in the word. Decoding follows the arcs of the identifiers and emits their
labels.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stellwerk.llm.presplit import Remembered, WordVocabulary

#: Words in each of the two generations that a worker process remembers.
REMEMBERED_WORDS = 150_000


class TokenAutomaton:
    """Deterministic automaton over tokens, compiled from merges in order.

    A state is named by the token last read; None is the start.
    """

    def __init__(self, ids: dict[str, int], merges: Sequence[tuple[str, str]]):
        made = {a + b for a, b in merges}
        self.ids = ids
        self.longest = max(map(len, ids), default=0)
        #: Step that made a token, and its parts; base symbols were there at the start.
        self._step = {t: 0 for t in ids if t not in made}
        self._parts: dict[str, tuple[str, str]] = {}
        #: (token, arc) -> step at which the state of the token lost the arc.
        self._lost: dict[tuple[str, str], int] = {}
        #: Tokens that no state has an arc for.
        self._unread: set[str] = set()
        for step, (u, v) in enumerate(merges, 1):
            self._compile(step, u, v)

    def _compile(self, step: int, u: str, v: str) -> None:
        if u not in self._step or v not in self._step or u + v in self._step:
            raise ValueError(f"merge {step} ({u} {v}) needs tokens made before it and must make a new one")
        if u in self._unread or not self.has_arc(u, v):
            self._unread.add(u + v)  # an earlier merge always takes u or v away: no arc is added
        else:
            self._lost[u, v] = step
        self._step[u + v], self._parts[u + v] = step, (u, v)

    def has_arc(self, state: str | None, token: str) -> bool:
        """Whether the state has an arc for the token."""
        if state is None or token in self._unread:
            return token not in self._unread
        lost, step, parts = self._lost, self._step, self._parts
        arc, arc_until = token, len(step)
        while True:
            # The copies that the state came from: its own, then those of its second part, each up to
            # the step at which the one after it was made; the last gadget counted is the arc's own.
            at, at_until = state, len(step)
            while True:
                k = lost.get((at, arc))
                if k is not None and k < at_until and k <= arc_until:
                    return False
                if at not in parts:
                    break
                at, at_until = parts[at][1], step[at]
            if arc not in parts:
                return True
            arc, arc_until = parts[arc][0], step[arc]

    def encode(self, letters: str, mark: str = "") -> list[str]:
        """The accepted token string that spells the letters; the last letter carries the mark."""
        made, has_arc, longest, n = self._step, self.has_arc, self.longest, len(letters)
        spelt = letters + mark
        out: list[str] = []
        starts: list[int] = []
        dead: set[int] = set()
        last, at, end = None, 0, min(n, longest)
        while at < n:
            while end > at:
                token = spelt[at:] if end == n else spelt[at:end]
                if token in made and end not in dead and has_arc(last, token):
                    break
                end -= 1
            if end > at:
                out.append(token)
                starts.append(at)
                last, at, end = token, end, min(n, end + longest)
            elif not out:
                raise ValueError(f"no tokens spell {spelt[:40]!r}")
            else:
                dead.add(at)
                out.pop()
                at, end = starts.pop(), at - 1
                last = out[-1] if out else None
        return out

    def accepts(self, tokens: Sequence[str]) -> bool:
        """Whether the merges produce this token string."""
        return all(self.has_arc(a, b) for a, b in zip([None, *tokens], tokens))


class Codec:
    """Encodes whole texts to identifiers and decodes identifiers to labels."""

    def __init__(self, vocabulary: WordVocabulary):
        self._vocabulary = vocabulary
        self.automaton = TokenAutomaton(vocabulary.ids, vocabulary.merges)
        self._label = {i: t for t, i in [*vocabulary.ids.items(), *vocabulary.special.items()]}
        self._codes = Remembered(self._code_of, REMEMBERED_WORDS)
        self._labels = Remembered(self._labels_of, REMEMBERED_WORDS, longest=256)

    def _code_of(self, word: str) -> str:
        vocabulary = self._vocabulary
        tokens = self.automaton.encode(vocabulary.letters(word), vocabulary.suffix)
        return " ".join([str(vocabulary.ids[t]) for t in tokens])

    def _labels_of(self, code: str) -> str:
        return " ".join([self._label[int(i)] for i in code.split(" ")])

    def encode(self, text: str) -> list[str]:
        """Identifiers as text, one element (with spaces between identifiers) per word or added token."""
        out: list[str] = []
        for words, special in self._vocabulary.words(text):
            out += map(self._codes.__getitem__, words)
            if special is not None:
                out.append(str(self._vocabulary.special[special]))
        return out

    def decode(self, codes: Sequence[str]) -> str:
        """The labels of the arcs that the identifiers name, spaces between; ``codes`` as from encode."""
        return " ".join(map(self._labels.__getitem__, codes))


@lru_cache(maxsize=2)
def _codec(path: str) -> Codec:
    """One compiled automaton for each worker process and file."""
    return Codec(WordVocabulary(path))


def encode_decode(
    docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False
) -> DataFrame:
    """``id_col``, n_tokens, ids_sha256, decoded_sha256 for every row; ``with_ids`` adds ids.

    ids is the decimal identifiers joined by one space, decoded their labels joined likewise; both
    digests are lowercase hex. A null text is encoded as an empty one (0 tokens, digests of the
    empty string). Repeated rows are kept; other columns are not read. ``tokenizer_path`` must
    exist on every executor.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(tokenizer_path)
        for batch in batches:
            counts, digests, decoded, ids = [], [], [], []
            for text in batch.column(1):
                codes = codec.encode(text.as_py() or "")
                joined = " ".join(codes)
                counts.append(joined.count(" ") + 1 if joined else 0)
                digests.append(hashlib.sha256(joined.encode()).hexdigest())
                decoded.append(hashlib.sha256(codec.decode(codes).encode()).hexdigest())
                ids.append(joined if with_ids else None)
            columns = [pa.array(counts, pa.int64()), *(pa.array(x, pa.string()) for x in (digests, decoded, ids))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["id", "n_tokens", "a", "b", "c"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    coded = rows.mapInArrow(run, f"id {kind}, n_tokens bigint, a string, b string, c string")
    named = {"id": id_col, "a": "ids_sha256", "b": "decoded_sha256", "c": "ids"}
    return (coded if with_ids else coded.drop("c")).withColumnsRenamed(named)
