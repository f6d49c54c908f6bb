"""Cutting a text into the words that a word-end BPE vocabulary encodes on their own.

The rules are read from the tokenizer file: added tokens are found first, in the raw
text; what lies between them is composed (NFC), lower-cased and cut by the file's pattern.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

#: The white space that ``\s`` means in the tokenizer file's pattern dialect, as far as it is stable.
WHITE_SPACE = r"\t-\r \x85\xa0"

#: Code points below this one have the same classes in every Unicode version since 6; texts
#: with higher ones are cut by the library's own splitter, whose version may be newer or older.
STABLE_BELOW = 0x370


class Remembered(dict):
    """Results by word, computed when missing.

    Holds two generations of ``entries`` words: when the young one is full it becomes the old
    one, so frequent words stay and the size does not depend on the data. Words longer than
    ``longest`` are computed each time.
    """

    def __init__(self, compute: Callable[[str], object], entries: int, longest: int = 64):
        super().__init__()
        self._compute, self._entries, self._longest, self._old = compute, entries, longest, {}

    def __missing__(self, word: str):
        value = self._old.get(word)
        if value is None:
            value = self._compute(word)
        if len(word) <= self._longest:
            if len(self) >= self._entries:
                self._old = dict(self)
                self.clear()
            self[word] = value
        return value


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable Latin-1 for itself, others from U+0100 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


def _class_of(kind: str) -> str:
    """The stable characters of a general category (``L``, ``N``), for use inside brackets."""
    return "".join(re.escape(chr(c)) for c in range(STABLE_BELOW) if unicodedata.category(chr(c))[0] == kind)


@dataclass
class WordVocabulary:
    """A word-end BPE file: token ids, merge ranks, and the rules that cut a text."""

    path: str
    ids: dict[str, int] = field(init=False)
    merges: list[tuple[str, str]] = field(init=False)
    suffix: str = field(init=False)
    special: dict[str, int] = field(init=False)

    def __post_init__(self) -> None:
        with open(self.path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.ids = model["vocab"]
        self.merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.suffix = model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"].replace(r"\s", WHITE_SPACE)
        for kind in "LN":
            pattern = pattern.replace(f"[\\p{{{kind}}}]", f"[{_class_of(kind)}]").replace(f"\\p{{{kind}}}", _class_of(kind))
        self._find = re.compile(pattern).findall
        longest_first = sorted(self.special, key=len, reverse=True)
        self._cut = re.compile("(" + "|".join(map(re.escape, longest_first)) + ")").split if longest_first else None
        self._unstable = re.compile(f"[^\\x00-\\u{STABLE_BELOW - 1:04x}]").search
        self._letters = byte_letters()
        self._of_letter = {c: b for b, c in enumerate(self._letters)}
        self._library = None

    def letters(self, word: str) -> str:
        """The word's bytes, each as the letter that stands for it."""
        return word if word.isascii() and word.isprintable() else "".join([self._letters[b] for b in word.encode()])

    def symbols(self, word: str) -> list[str]:
        """The word's letters; the last one carries the end-of-word mark."""
        out = list(self.letters(word))
        out[-1] += self.suffix
        return out

    def words(self, text: str) -> Iterator[tuple[list[str], str | None]]:
        """Runs of words, each with the added token that follows it (None at the end)."""
        if self._cut is None or not any(s in text for s in self.special):
            yield self._split(text), None
            return
        parts = self._cut(text)
        for i in range(0, len(parts), 2):
            yield self._split(parts[i]), parts[i + 1] if i + 1 < len(parts) else None

    def _split(self, text: str) -> list[str]:
        if text.isascii():
            return self._find(text.lower())
        clean = unicodedata.normalize("NFC", text).lower()
        return self._split_by_library(text) if self._unstable(clean) or self._unstable(text) else self._find(clean)

    def _split_by_library(self, text: str) -> list[str]:
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self.path)
        clean = self._library.normalizer.normalize_str(text)
        of = self._of_letter
        return [
            bytes(of[c] for c in piece).decode() for piece, _ in self._library.pre_tokenizer.pre_tokenize_str(clean)
        ]
