"""Skill matching as row-wise expressions.

A candidate text matches between ASCII token boundaries. The text is split into
ASCII tokens once; one hash intersection with the lexicon's first tokens leaves
the few that can match, and only candidates with other characters in them still
need their pattern tried. No shuffle, no Python at run time.
"""

from __future__ import annotations

import re
import string

from pyspark.sql import Column, functions as F

from stellwerk import fixed
from stellwerk.functions.text import quote
from stellwerk.sources.config import Entry

_ALNUM = re.compile(r"[a-z0-9]+", re.ASCII)
# Spelled out, the class is a bit set to Java; as ranges it is several times slower.
ALNUM = string.digits + string.ascii_letters
BOUNDARY = f"[^{ALNUM}]"


def first_token(candidate: str) -> str | None:
    found = _ALNUM.search(candidate)
    return found.group(0) if found else None


def is_plain(candidate: str) -> bool:
    """ASCII letters and digits only: equality with a token decides."""
    return _ALNUM.fullmatch(candidate) is not None


def pattern(candidate: str) -> str:
    return f"(?:^|{BOUNDARY}){re.escape(candidate)}(?:$|{BOUNDARY})"


def marked(text: Column) -> Column:
    """The text with its token boundaries written out, so that a bounded match is a substring match.

    Runs of ASCII letters and digits stand between marks 1 and 2, and any other character that
    does not follow such a run has mark 3 before it; a text that ends with one has mark 3 after
    it. A candidate stands between boundaries exactly if its marked form is in the marked text.
    """
    clean = F.translate(text, "\x01\x02\x03", "   ")
    wrapped = F.regexp_replace(clean, f"([{ALNUM}]+)", "\x01$1\x02")
    spaced = F.regexp_replace(wrapped, f"(?<!\x02)([^{ALNUM}\x01\x02])", "\x03$1")
    return F.concat(spaced, F.when(clean.rlike(f"[^{ALNUM}]\\z"), F.lit("\x03")).otherwise(""))


def _array(values) -> str:
    return f"CAST(array({', '.join(quote(v) for v in values)}) AS ARRAY<STRING>)"


def _ordered_set(entries) -> list[str]:
    return list(dict.fromkeys(c for e in entries for c in e.candidates))


def tokens(lower_text: str) -> Column:
    """ASCII tokens of a text column; empty ones may be among them."""
    return F.split(F.col(lower_text), f"{BOUNDARY}+")


def token_hits(lower_text: str, entries: list[Entry]) -> Column:
    """Distinct tokens of the text column that begin some candidate."""
    wanted = dict.fromkeys(
        first_token(c) for c in _ordered_set(entries) if c not in fixed.SUBSTRING_CANDIDATES and first_token(c)
    )
    return F.array_intersect(tokens(lower_text), F.expr(_array(wanted)))


def matched_candidates(lower_text: str, hits: str, entries: list[Entry]) -> Column:
    """Candidate texts found in a text column, given its :func:`token_hits` column."""
    candidates = _ordered_set(entries)
    substrings = [c for c in candidates if c in fixed.SUBSTRING_CANDIDATES]
    plain = [c for c in candidates if is_plain(c)]
    rest = [c for c in candidates if c not in substrings and not is_plain(c)]
    checks = [f"CASE WHEN contains({lower_text}, {quote(c)}) THEN {quote(c)} END" for c in substrings]
    for c in rest:
        lead = first_token(c)
        tests = [f"array_contains({hits}, {quote(lead)})"] if lead else []
        tests += [f"contains({lower_text}, {quote(c)})", f"rlike({lower_text}, {quote(pattern(c))})"]
        checks.append(f"CASE WHEN {' AND '.join(tests)} THEN {quote(c)} END")
    found = f"array_intersect({hits}, {_array(plain)})"
    return F.expr(f"concat({found}, array_compact(array({', '.join(checks)})))" if checks else found)


def _values(matched: str, entries: list[Entry], value, element: str) -> str:
    """Distinct values of the entries that matched candidates stand for, by a literal map."""
    if not entries:
        return f"CAST(array() AS ARRAY<{element}>)"
    lookup: dict[str, list[str]] = {}
    for number, e in enumerate(entries):
        for c in e.candidates:
            lookup.setdefault(c, []).append(value(number, e))
    pairs = ", ".join(f"{quote(c)}, array({', '.join(v)})" for c, v in lookup.items())
    per_candidate = f"transform({matched}, c -> try_element_at(map({pairs}), c))"
    return f"array_distinct(flatten(filter({per_candidate}, v -> v IS NOT NULL)))"


def labels(matched: str, entries: list[Entry], titled: bool = True) -> Column:
    """Distinct labels of the entries with a candidate in the ``matched`` column."""
    return F.expr(_values(matched, entries, lambda _, e: quote(e.label.title() if titled else e.label), "STRING"))


def match_count(matched: str, entries: list[Entry]) -> Column:
    """Number of entries (not labels) with a matched candidate."""
    return F.expr(f"size({_values(matched, entries, lambda n, _: str(n), 'INT')})")


def mentioned(matched: str, entries: list[Entry]) -> Column:
    """True when any entry matches."""
    return F.expr(f"arrays_overlap({matched}, {_array(_ordered_set(entries))})") if entries else F.lit(False)


def joined(label_array: Column, limit: int | None = None) -> Column:
    """Sorted labels as one text, cut to ``limit`` labels."""
    ordered = F.array_sort(label_array)
    return F.array_join(F.slice(ordered, 1, limit) if limit else ordered, ", ")
