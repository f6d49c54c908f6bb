"""Small text predicates shared by every stage."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce
from itertools import count

from pyspark.sql import Column, functions as F

# Word characters as Unicode letters, numbers and underscore; Java's own \w is ASCII.
WORD = r"[\p{L}\p{N}_]"
EDGE_SPACE = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"


def quote(value: str) -> str:
    """SQL text literal."""
    escaped = value.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n")
    return f"'{escaped}'"


_names = count()


def fresh_name() -> str:
    return f"v{next(_names)}"


def bind(value: str, use: Callable[[str], str]) -> str:
    """``use`` of a value that is evaluated once, however often ``use`` mentions it."""
    v = fresh_name()
    return f"element_at(transform(array({value}), {v} -> {use(v)}), 1)"


def text(col: Column | str) -> Column:
    """Column with NULL read as empty text."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def strip(col: Column) -> Column:
    """Trim every kind of white space, not just blanks."""
    return F.regexp_replace(col, EDGE_SPACE, "")


def contains_any(col: Column, words: Iterable[str]) -> Column:
    """True when any of the words is a substring."""
    tests = [F.contains(col, F.lit(w)) for w in words]
    return reduce(lambda a, b: a | b, tests) if tests else F.lit(False)


def contains_any_of(col: Column, words: Column) -> Column:
    """As :func:`contains_any` for a word list held in an array column."""
    return F.coalesce(F.exists(words, lambda w: F.contains(col, F.lower(w))), F.lit(False))


def scoring_text(title="title", company="company", description="description", location="location") -> Column:
    """Lower-cased text that skills, language and work type are read from."""
    return F.lower(F.concat_ws(" ", text(title), text(company), text(description), text(location)))


def count_words(lower_text: Column, words: Iterable[str]) -> Column:
    """Occurrences of whole words (Unicode word boundaries) in lower-cased text.

    The look-ahead on first letters spares most positions the boundary check.
    """
    alternatives = "|".join(words)
    initials = "".join(sorted({w[0] for w in words}))
    return F.regexp_count(lower_text, F.lit(f"(?=[{initials}])(?<!{WORD})(?:{alternatives})(?!{WORD})"))


def words(lower_text: Column) -> Column:
    """Words of two or more characters, in order."""
    return F.regexp_extract_all(lower_text, F.lit(f"({WORD}{{2,}})"), 1)
