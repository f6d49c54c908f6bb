"""Phrase collocations by best-first branch-and-bound growth.

Phrases grow word by word from frequent ones. A phrase that occurs a times scores 2,000,000 a / (l + r)
at its lowest cut; a longer one that starts with it can neither occur more often than
it, nor have fewer occurrences of its first words. So 2,000,000 a / (l + a), with the counts of the prefix
at its lowest cut, bounds the score of everything that grows from it. The prefixes with the highest bounds are grown first,
down to a score that enough phrases of each language reach. What is dropped is known exactly above that score, since
the phrases that could cover one of these are grown as well; where too few remain, the score is lowered and
growth goes on. At the end no prefix that is not grown has a bound that reaches the last phrase reported, ties included.

Words are held as hashes of language and word. Counting is by pieces of text in numpy, sums are Spark's.
Sieves of a fixed size (bitmaps) tell which words, pairs and prefixes are worth counting; they may let others pass,
whose counts are then dropped, but never hold back one.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stellwerk.session import materialise

#: Occurrences of a candidate, its longest form in words, the share in percent of its occurrences
#: within a longer candidate that drops it, phrases reported for each language, and the scale of the score.
MIN_COUNT, LONGEST, COVERED, TOP, SCALE = 30, 4, 80, 2000, 2_000_000
#: Phrases of each language that the first score to grow down to is taken from, as a multiple of those reported.
FIRST_REACH = 2
#: Bits of a sieve, bytes of text counted at once, and values per bitmap bucket (given by Spark's bitmap functions).
BITS, SLICE, BUCKET = 1 << 25, 5_000_000, 32_768
UNKNOWN = "und"
_BREAK = 0xFF  # in no UTF-8 text
_TABLE = bytes(b + 32 if 65 <= b <= 90 else 32 if b == 9 else _BREAK if chr(b) in ".,;:!?\n\x0b\x0c\r" else b for b in range(256))


def words_of(texts: list[bytes]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words of the texts, and for each word in order its place among them and its piece."""
    data = np.frombuffer(bytes([_BREAK]).join(texts).translate(_TABLE), np.uint8)
    ends = data == _BREAK
    kept = ~(ends | (data == 32))
    starts = kept.copy()
    starts[1:] &= ~kept[:-1]
    starts = np.flatnonzero(starts)
    before = np.cumsum(kept, dtype=np.int32)
    offsets = np.append(before[starts] - 1, before[-1:] if len(before) else [0]).astype(np.int32)
    flat = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data[kept])])
    coded = flat.dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(), np.cumsum(ends, dtype=np.int32)[starts]


def word_hashes(lang: str, words: list[bytes]) -> np.ndarray:
    """Hashes of words of a language, as those of _word_hash."""
    own = xxhash.xxh64_intdigest(lang.encode(), seed=42)
    return np.array([xxhash.xxh64_intdigest(w, seed=own) for w in words], np.uint64).view(np.int64)


def _word_hash(lang: Column, word: Column) -> Column:
    return F.xxhash64(lang, word)  # the language's hash is the seed


def mixed(parts: list[np.ndarray]) -> np.ndarray:
    """Places in a sieve of phrases given by their words' hashes."""
    out = np.zeros(len(parts[0]), np.uint64)
    for k, part in enumerate(parts):
        h, turn = part.view(np.uint64), np.uint64(21 * k)
        out ^= (h << turn) | (h >> np.uint64(64 - 21 * k)) if k else h
    return (out & np.uint64(BITS - 1)).astype(np.int64)


def _mixed(g: Column, size: int) -> Column:
    out = F.get(g, F.lit(0))
    for k in range(1, size):
        h = F.get(g, F.lit(k))
        out = out.bitwiseXOR(F.shiftleft(h, 21 * k).bitwiseOR(F.shiftrightunsigned(h, 64 - 21 * k)))
    return out.bitwiseAND(F.lit(BITS - 1).cast("bigint"))


class Sieve:
    """A bitmap of BITS bits over all phrases of a table (column g); bounded whatever the table's size."""

    def __init__(self, phrases: DataFrame):
        place = F.when(F.size("g") == 1, _mixed(F.col("g"), 1))
        for size in range(2, LONGEST):
            place = place.when(F.size("g") == size, _mixed(F.col("g"), size))
        # Spark's buckets begin at 1.
        places = phrases.select((place + 1).alias("p"))
        filled = places.groupBy(F.bitmap_bucket_number("p").alias("bucket")).agg(
            F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits")
        )
        self._bits = np.zeros(BITS // 8, np.uint8)
        for r in filled.toLocalIterator():
            at = (r.bucket - 1) * (BUCKET // 8)
            self._bits[at : at + BUCKET // 8] = np.frombuffer(bytes(r.bits), np.uint8)

    def passes(self, parts: list[np.ndarray]) -> np.ndarray:
        places = mixed(parts)
        return (self._bits[places >> 3] >> (places & 7).astype(np.uint8)) & 1 == 1


def _by_language(batch: pa.RecordBatch) -> Iterator[tuple[str, list[bytes]]]:
    """Texts of a batch (lang, text), language by language, in slices."""
    langs = batch.column(0).dictionary_encode()
    texts = batch.column(1).cast(pa.large_binary())
    codes = langs.indices.to_numpy()
    for code, lang in enumerate(langs.dictionary.to_pylist()):
        held, size = [], 0
        for text in texts.take(pa.array(np.flatnonzero(codes == code))):
            held.append(text.as_py())
            size += len(held[-1])
            if size >= SLICE:
                yield lang, held
                held, size = [], 0
        if held:
            yield lang, held


def _rows(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    lang = F.coalesce(F.col(lang_col).cast("string"), F.lit(UNKNOWN))
    return docs.select(lang.alias("lang"), F.col(text_col).alias("text")).where(F.length("text") > 0)


def _words(rows: DataFrame, min_count: int) -> DataFrame:
    """lang, word, f of the frequent words, and one row with a null word per language for all its occurrences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, texts in _by_language(batch):
                words, codes, _ = words_of(texts)
                counts = np.append(np.bincount(codes, minlength=len(words)), len(codes))
                named = pa.concat_arrays([words.cast(pa.string()), pa.nulls(1, pa.string())])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(counts), pa.string()), named, pa.array(counts, pa.int64())], names=["lang", "word", "f"]
                )

    counted = rows.mapInArrow(run, "lang string, word string, f bigint").groupBy("lang", "word").agg(F.sum("f").alias("f"))
    return counted.where((F.col("f") >= min_count) | F.col("word").isNull())


def _distinct(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Where each distinct combination of the columns occurs first, and how often it occurs."""
    code = columns[0]
    for column in columns[1:]:
        _, low = np.unique(code, return_inverse=True)
        values, high = np.unique(column, return_inverse=True)
        code = low * np.int64(len(values)) + high
    _, first, counts = np.unique(code, return_index=True, return_counts=True)
    return first, counts


def _pairs(rows: DataFrame, words: Sieve, min_count: int) -> DataFrame:
    """g (two hashes), f of the frequent pairs of frequent words."""
    shared = rows.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, texts in _by_language(batch):
                known, codes, piece = words_of(texts)
                hashes = word_hashes(lang, known.to_pylist())
                if len(codes) < 2:
                    continue
                good = shared.value.passes([hashes])[codes]
                at = np.flatnonzero(good[:-1] & good[1:] & (piece[:-1] == piece[1:]))
                pair = codes[at].astype(np.int64) * len(known) + codes[at + 1]
                pair, counts = np.unique(pair, return_counts=True)
                a, b = hashes[pair // len(known)], hashes[pair % len(known)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (a, b, counts)], names=["a", "b", "f"])

    counted = rows.mapInArrow(run, "a bigint, b bigint, f bigint").groupBy("a", "b").agg(F.sum("f").alias("f"))
    return counted.where(F.col("f") >= min_count).select(F.array("a", "b").alias("g"), "f")


def _runs(rows: DataFrame, pairs: Sieve) -> DataFrame:
    """The stretches of three and more words in which every two neighbours are a frequent pair: what growth reads."""
    shared = rows.sparkSession.sparkContext.broadcast(pairs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, texts in _by_language(batch):
                known, codes, piece = words_of(texts)
                if len(codes) < 3:
                    continue
                h = word_hashes(lang, known.to_pylist())[codes]
                linked = shared.value.passes([h[:-1], h[1:]]) & (piece[:-1] == piece[1:])
                edge = np.diff(np.concatenate(([False], linked, [False])).astype(np.int8))
                first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) + 1  # last is exclusive, in words
                long = last - first >= 3
                first, last = first[long], last[long]
                sizes = last - first
                offsets = np.concatenate(([0], np.cumsum(sizes)))
                at = np.arange(offsets[-1]) + np.repeat(first - offsets[:-1], sizes)
                runs = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(h[at]))
                yield pa.RecordBatch.from_arrays([runs], names=["run"])

    return rows.mapInArrow(run, "run array<bigint>")


def _grow(runs: DataFrame, prefixes: DataFrame, min_count: int) -> DataFrame:
    """g, f of the frequent phrases that are a prefix (column g, of any lengths) and one word more."""
    shared = runs.sparkSession.sparkContext.broadcast(Sieve(prefixes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(0)
            h = lists.flatten().to_numpy()
            owner = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
            for size in range(3, LONGEST + 1):
                if len(h) < size:
                    break
                at = np.flatnonzero(owner[: len(h) - size + 1] == owner[size - 1 :])
                at = at[shared.value.passes([h[at + k] for k in range(size - 1)])]
                if len(at):
                    columns = [h[at + k] for k in range(size)]
                    first, counts = _distinct(columns)
                    flat = np.stack([c[first] for c in columns], axis=1).ravel()
                    offsets = pa.array(np.arange(len(first) + 1) * size, pa.int32())
                    phrases = pa.ListArray.from_arrays(offsets, pa.array(flat))
                    yield pa.RecordBatch.from_arrays([phrases, pa.array(counts, pa.int64())], names=["g", "f"])

    counted = runs.mapInArrow(run, "g array<bigint>, f bigint").groupBy("g").agg(F.sum("f").alias("f")).where(F.col("f") >= min_count)
    asked = prefixes.select(F.col("g").alias("p"))
    return counted.join(asked, F.slice("g", F.lit(1), F.size("g") - 1) == F.col("p"), "left_semi")


def _score(a: Column, l: Column, r: Column) -> Column:  # noqa: E741
    """SCALE a div (l + r), in decimals, since the product may pass 64 bits."""
    product = F.lit(SCALE).cast("decimal(10,0)") * a.cast("decimal(20,0)")
    return F.call_function("div", product, (l + r).cast("decimal(20,0)"))


def _lowest_cut(cuts: Column) -> Column:
    """The cut (score, k, l, r) of the lowest score, of equal ones the first; null if a count is unknown."""
    unknown = F.exists(cuts, lambda c: c["score"].isNull())
    return F.when(~unknown, F.array_min(cuts))


def _cut(k: int, a: Column, l: Column, r: Column) -> Column:  # noqa: E741
    return F.struct(_score(a, l, r).alias("score"), F.lit(k).alias("k"), l.alias("l"), r.alias("r"))


def _bound(a: Column, firsts: list[Column]) -> Column:
    """The highest score that anything can have that starts with a phrase: its first parts' counts at every cut."""
    return F.least(*[_score(a, f, a) for f in firsts]) if len(firsts) > 1 else _score(a, firsts[0], a)


def _counts(phrases: DataFrame, key: str, value: str) -> DataFrame:
    return phrases.select(F.col("g").alias(key), F.col("f").alias(value))


def _scored_pairs(pairs: DataFrame, words: DataFrame) -> DataFrame:
    """g, f, lang, first parts' counts (f1), cut, bound."""
    one = words.select(F.array("h").alias("g"), "f", "lang")
    left = one.select(F.col("g").alias("p"), F.col("f").alias("f1"), "lang")
    joined = pairs.join(left, F.slice("g", 1, 1) == F.col("p")).join(_counts(one, "q", "l1"), F.slice("g", 2, 1) == F.col("q"))
    a, f1 = F.col("f"), F.col("f1")
    return joined.select("g", "f", "lang", "f1", F.array_min(F.array(_cut(1, a, f1, F.col("l1")))).alias("cut"), _bound(a, [f1]).alias("bound"))


def _scored_triples(found: DataFrame, pairs: DataFrame, words: DataFrame) -> DataFrame:
    """g, f, lang, f1, f2, cut, bound."""
    left = pairs.select(F.col("g").alias("p"), F.col("f").alias("f2"), "f1", "lang")
    last = words.select(F.array("h").alias("w"), F.col("f").alias("l1"))
    joined = found.join(left, F.slice("g", 1, 2) == F.col("p")).join(_counts(pairs, "q", "l2"), F.slice("g", 2, 2) == F.col("q"))
    joined = joined.join(last, F.slice("g", 3, 1) == F.col("w"))
    a, f1, f2 = F.col("f"), F.col("f1"), F.col("f2")
    cuts = F.array(_cut(1, a, f1, F.col("l2")), _cut(2, a, f2, F.col("l1")))
    return joined.select("g", "f", "lang", "f1", "f2", _lowest_cut(cuts).alias("cut"), _bound(a, [f1, f2]).alias("bound"))


def _scored_fours(found: DataFrame, triples: DataFrame, pairs: DataFrame, words: DataFrame) -> DataFrame:
    """g, f, lang, cut; no cut if the last three words were not counted, which are in nothing of interest then."""
    left = triples.select(F.col("g").alias("p"), F.col("f").alias("f3"), "f2", "f1", "lang")
    last = words.select(F.array("h").alias("w"), F.col("f").alias("l1"))
    joined = found.join(left, F.slice("g", 1, 3) == F.col("p")).join(_counts(triples, "q", "l3"), F.slice("g", 2, 3) == F.col("q"), "left")
    joined = joined.join(_counts(pairs, "q2", "l2"), F.slice("g", 3, 2) == F.col("q2")).join(last, F.slice("g", 4, 1) == F.col("w"))
    a = F.col("f")
    cuts = [_cut(k, a, F.col(f"f{k}"), F.col(f"l{4 - k}")) for k in (1, 2, 3)]
    return joined.select("g", "f", "lang", _lowest_cut(F.array(*cuts)).alias("cut"))


def _reaching(phrases: DataFrame, floors: DataFrame, column: Column) -> DataFrame:
    """The phrases whose score or bound reaches their language's floor."""
    return phrases.join(floors, "lang").where(column >= F.col("floor")).drop("floor")


def _coverers(of: DataFrame, among: DataFrame, size: int) -> DataFrame:
    """g of the phrases of ``among`` that could grow into one that covers a phrase of ``of``, which begins
    with the last ``size`` words of theirs: those with enough occurrences."""
    needed = of.groupBy(F.slice("g", 1, size).alias("s")).agg(F.min("f").alias("least"))
    tail = F.slice("g", F.size("g") - size + 1, F.lit(size))
    return among.join(needed, tail == F.col("s")).where(100 * F.col("f") >= COVERED * F.col("least")).select("g")


def _survivors(candidates: DataFrame, longer: DataFrame) -> DataFrame:
    """Candidates that no phrase of one word more covers; a still longer one is covered by such a one as well."""
    n = F.size("g") - 1
    inside = longer.select("f", F.explode(F.array_distinct(F.array(F.slice("g", F.lit(1), n), F.slice("g", F.lit(2), n)))).alias("c"))
    most = inside.groupBy("c").agg(F.max("f").alias("most"))
    joined = candidates.join(most, F.col("g") == F.col("c"), "left")
    return joined.where(F.col("most").isNull() | (100 * F.col("most") < COVERED * F.col("f"))).drop("c", "most")


def _union(*tables: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)


def _floors(pairs: DataFrame, reach: int) -> DataFrame:
    """lang, floor: the score of the pair at rank ``reach``, or 0 where there are no more."""
    order = Window.partitionBy("lang").orderBy(F.desc("cut.score"))
    top = pairs.select("lang", "cut").withColumn("at", F.row_number().over(order)).where(F.col("at") <= reach)
    least = F.when(F.count("*") == reach, F.min("cut.score")).otherwise(0)
    return top.groupBy("lang").agg(least.alias("floor"))


def mine(
    docs: DataFrame, min_count: int = MIN_COUNT, top: int = TOP, text_col: str = "text", lang_col: str = "lang", first_reach: int = FIRST_REACH
) -> DataFrame:
    """``lang``, rank, phrase, a, l, r, n, score of each language's ``top`` best phrases of 2 to 4 words.

    A null language is ``und``; a null or empty text has no words. Ranked by score, then occurrences, both falling, then phrase;
    a phrase's words are joined by blanks. Rows count as documents of their own, repeated ones too. A language without a
    surviving phrase has no rows. Other columns are not read.
    """
    rows = _rows(docs, text_col, lang_col)
    counted = materialise(_words(rows, min_count))
    totals = counted.where("word IS NULL").select("lang", F.col("f").alias("n"))
    words = counted.where("word IS NOT NULL").withColumn("h", _word_hash(F.col("lang"), F.col("word")))
    frequent = materialise(_pairs(rows, Sieve(words.select(F.array("h").alias("g"))), min_count))
    pairs = materialise(_scored_pairs(frequent, words))
    runs = materialise(_runs(rows, Sieve(pairs.select("g"))))

    grown: list[DataFrame] = []  # prefixes already grown
    triples = fours = None
    reach = first_reach * top
    while True:
        floors = materialise(_floors(pairs, reach))
        good = _reaching(pairs, floors, F.col("cut.score"))
        wanted = _union(_reaching(pairs, floors, F.col("bound")).select("g"), _coverers(good, pairs, 1))
        triples = _more(runs, wanted, grown, triples, min_count, lambda found: _scored_triples(found, pairs, words))
        # The triples' own coverers and last parts need pairs that their bounds alone do not ask for.
        wanted = _union(
            _reaching(triples, floors, F.col("bound")).select(F.slice("g", 2, 2).alias("g")),
            _coverers(_reaching(triples, floors, F.col("cut.score")), pairs, 1),
        )
        triples = _more(runs, wanted, grown, triples, min_count, lambda found: _scored_triples(found, pairs, words))
        good = _reaching(triples, floors, F.col("cut.score"))
        wanted = _union(_reaching(triples, floors, F.col("bound")).select("g"), _coverers(good, triples, 2))
        fours = _more(runs, wanted, grown, fours, min_count, lambda found: found)
        scored = _scored_fours(fours, triples, pairs, words)
        every = _union(*(x.select("g", "f", "lang", "cut") for x in (pairs, triples, scored)))
        longer = _union(triples.select("g", "f"), fours.select("g", "f"))
        settled = materialise(_survivors(_reaching(every, floors, F.col("cut.score")), longer))
        kept = settled.groupBy("lang").agg(F.count("*").alias("kept"))
        open_ = floors.join(kept, "lang", "left").where((F.col("floor") > 0) & (F.coalesce("kept", F.lit(0)) < top))
        if open_.isEmpty():
            return _named(settled, words, totals, top)
        reach *= 4


def _more(runs, wanted, grown, known, min_count, scored):
    """The known phrases and those that grow from the wanted prefixes, of which those in ``grown`` are left out."""
    wanted = wanted.distinct()
    for before in grown:
        wanted = wanted.join(before, "g", "left_anti")
    wanted = materialise(wanted)
    grown.append(wanted)
    new = scored(_grow(runs, wanted, min_count))
    return materialise(new if known is None else _union(known, new))


def _named(settled: DataFrame, words: DataFrame, totals: DataFrame, top: int) -> DataFrame:
    """The best phrases of each language, with their words."""
    # Phrases tie-break by their words, so all with the score and count of the last rank are named.
    order = Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("f"))
    best = settled.withColumn("place", F.rank().over(order)).where(F.col("place") <= top).drop("place")
    spelled = best.select("g", F.posexplode("g").alias("at", "h")).join(words.select("h", "word"), "h")
    phrase = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ")
    named = best.join(spelled.groupBy("g").agg(phrase.alias("phrase")), "g").join(totals, "lang")
    order = Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("f"), F.asc("phrase"))
    ranked = named.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select(
        "lang", "rank", "phrase", F.col("f").alias("a"), F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n",
        F.col("cut.score").alias("score"),
    )
