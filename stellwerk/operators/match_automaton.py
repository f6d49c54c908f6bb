"""Skill matching by a multi-pattern automaton, for lexicons too large for expressions.

The lexicon's forms (candidates with their token boundaries written out) are compiled into Aho-Corasick automata of a
bounded size, and each of these runs over every text in Arrow batches. Finding costs the length of the text plus the
matches, whatever the lexicon's size, and nothing is shuffled: neither the texts nor their tokens.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark import Broadcast, cloudpickle
from pyspark.sql import DataFrame, functions as F

from stellwerk import fixed
from stellwerk.functions import skills

# Workers get this module's code with the tasks, whether or not the package is installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Characters of forms, and rows of entries, that one automaton holds: about 100 bytes of a worker's memory for each. A
#: larger lexicon takes several automata and as many passes over the texts.
PART_CHARS = 1 << 20
#: Rows of a result batch.
BATCH_ROWS = 1 << 16
ENTRY = ("list_name", "category", "entry_no", "label")
MARKS = "\x01\x02\x03"


def forms(lexicon: DataFrame) -> DataFrame:
    """``form`` and the entry's columns: what stands in a marked text exactly if the candidate matches it.

    The marks between two characters follow from these two alone, so a candidate that matches anywhere is found by
    its marked form without the marks at both ends. Null and empty candidates match nothing.
    """
    candidate = F.col("candidate")
    bounded = skills.marked(candidate)
    loose = F.btrim(bounded, F.lit(MARKS))
    form = F.when(candidate.isin(*fixed.SUBSTRING_CANDIDATES), loose).otherwise(bounded)
    return lexicon.where(candidate != "").select(form.alias("form"), *ENTRY)


def parts(lexicon: DataFrame, part_chars: int = PART_CHARS) -> Iterator[tuple[dict[str, list[int]], list[tuple]]]:
    """The lexicon in pieces of a bounded size: entry numbers by form, and the entries. Only one piece is held at a time."""
    places: dict[str, list[int]] = {}
    entries: dict[tuple, int] = {}
    size = 0
    for form, *entry in forms(lexicon).toLocalIterator():
        if size and size + len(form) > part_chars:
            yield places, list(entries)
            places, entries, size = {}, {}, 0
        size += 1 if form in places else 1 + len(form)
        places.setdefault(form, []).append(entries.setdefault(tuple(entry), len(entries)))
    if places:
        yield places, list(entries)


def _finder(part: Broadcast, types: list[pa.DataType], names: list[str]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        places, entries = part.value
        automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for number, form in enumerate(places):
            automaton.add_word(form, number)
        automaton.make_automaton()
        entries_of = list(places.values())
        columns = [pa.array(values, kind) for values, kind in zip(zip(*entries), types)]

        def result(keys: pa.Array, rows: list[int], found: list[int]) -> pa.RecordBatch:
            taken = pa.array(found, pa.int32())
            return pa.RecordBatch.from_arrays([keys.take(pa.array(rows, pa.int32())), *[c.take(taken) for c in columns]], names)

        for batch in batches:
            rows, found = [], []
            for row, text in enumerate(batch.column(1)):
                hits = {number for _, number in automaton.iter(text.as_py())}
                seen = set().union(*[entries_of[h] for h in hits])
                rows += [row] * len(seen)
                found += seen
                if len(found) >= BATCH_ROWS:
                    yield result(batch.column(0), rows, found)
                    rows, found = [], []
            yield result(batch.column(0), rows, found)

    return run


def match_automaton(
    postings: DataFrame, lexicon: DataFrame, key: str = "seq", text: str = "_text", part_chars: int = PART_CHARS
) -> DataFrame:
    """``key, list_name, category, entry_no, label`` of matching entries: the rows of ``match_join``, without its joins.

    Each row of ``postings`` gives an entry once per automaton in which a candidate of it matches; count or collect
    distinctly. A null text matches nothing; texts and candidates are compared as given, so pass both lower-cased. The
    lexicon passes through the driver piece by piece and reaches the workers as one broadcast per piece.
    """
    spark = postings.sparkSession
    marked = postings.select(key, F.coalesce(skills.marked(F.col(text)), F.lit("")).alias("_marked"))
    kinds = [(n, lexicon.schema[n].dataType) for n in ENTRY]
    schema = f"`{key}` {postings.schema[key].dataType.simpleString()}, " + ", ".join(f"{n} {t.simpleString()}" for n, t in kinds)
    types = [{"string": pa.string(), "int": pa.int32(), "bigint": pa.int64()}[t.simpleString()] for _, t in kinds]
    found = [
        marked.mapInArrow(_finder(spark.sparkContext.broadcast(part), types, [key, *ENTRY]), schema)
        for part in parts(lexicon, part_chars)
    ]
    return reduce(DataFrame.union, found) if found else spark.createDataFrame([], schema)
