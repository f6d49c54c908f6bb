"""Quality rules: lines that many documents of a host share do not count as a document's own.

Each line is normalised and hashed; the documents of a host that hold it are counted over the
whole corpus. Lines above the limit are removed, however large the host is, and a document of
which too little remains is rejected. Plain rules on the document alone (its length, its repeated windows of
words) reject documents before that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stellwerk.llm.common import let, sliding

#: White space between words, symbols, and the limits of the base rules.
SPACE, SYMBOLS = "[\\x20\\x09-\\x0D]", "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
MIN_WORDS, WINDOW, MAX_REPEATED_PERCENT = 20, 8, 30
#: A line is removed if more documents of its host hold it, however large the host is.
LINE_DOCUMENTS = 10
#: A document is depleted if less than this share of its words remains.
REMAINING = 0.3


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, f"{SPACE}+"), lambda w: w != "")


def repeated_words(words: Column) -> Column:
    """Words that lie in windows of WINDOW words found twice or more in the text.

    Windows are compared by a hash of their words' hashes. The starts of repeated windows
    come from neighbours in hash order; each covers WINDOW words, or as many as there are to the next start.
    """

    def covered(starts: Column) -> Column:
        gaps = F.transform(starts, lambda s, k: F.least(F.lit(WINDOW), F.coalesce(F.get(starts, k + 1) - s, F.lit(WINDOW))))
        return F.aggregate(gaps, F.lit(0), lambda total, x: total + x)

    def starts(by_hash: Column) -> Column:
        def repeated(x: Column, k: Column) -> Column:
            before, after = F.get(by_hash, k - 1)["h"], F.get(by_hash, k + 1)["h"]
            return F.coalesce(x["h"] == before, F.lit(False)) | F.coalesce(x["h"] == after, F.lit(False))

        return F.sort_array(F.transform(F.filter(by_hash, repeated), lambda x: x["k"]))

    def within(windows: Column) -> Column:
        pairs = F.transform(windows, lambda h, k: F.struct(h.alias("h"), k.alias("k")))
        found = let(F.sort_array(pairs), lambda by_hash: let(starts(by_hash), covered))
        return F.when(F.size(F.array_distinct(windows)) < F.size(windows), found).otherwise(0)

    def windows(hashes: Column) -> Column:
        return F.transform(
            sliding(F.size(hashes), WINDOW), lambda k: F.xxhash64(*[F.get(hashes, k + j) for j in range(WINDOW)])
        )

    return let(F.transform(words, lambda w: F.xxhash64(w)), lambda hashes: let(windows(hashes), within))


def measures(text: Column) -> dict[str, Column]:
    """Base measures of one text."""

    def lines(own: Column) -> Column:
        return F.size(own) - F.size(F.array_distinct(own))

    with_word = F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{SPACE[1:-1]}]"))
    return {
        "n_words": F.regexp_count(text, F.lit(f"[^{SPACE[1:-1]}]+")),
        "word_chars": F.length(F.translate(text, SPACES, "")),
        "n_symbols": F.length(text) - F.length(F.translate(text, SYMBOLS, "")),
        "n_dup_lines": let(with_word, lines),
        "n_repeat_words": repeated_words(words_of(text)),
    }


def _own_lines(text: Column) -> Column:
    """Normalised lines that hold a word: hash, words, and whether it is the first such line of the text."""

    def line(x: Column) -> Column:
        clean = F.regexp_replace(F.regexp_replace(F.lower(F.trim(x)), "[0-9]+", "0"), f"{SPACE}+", " ")
        return F.struct(F.xxhash64(clean).alias("hash"), F.regexp_count(x, F.lit(f"[^{SPACE[1:-1]}]+")).alias("words"))

    def marked(lines: Column) -> Column:
        def one(x: Column, k: Column) -> Column:
            before = F.get(lines, k - 1)["hash"]
            return F.struct(x["hash"].alias("hash"), x["words"].alias("words"), (before.isNull() | (before != x["hash"])).alias("first"))

        return F.transform(lines, one)

    return let(F.sort_array(F.filter(F.transform(F.split(text, "\n"), line), lambda x: x["words"] > 0)), marked)


def _removed_words(rows: DataFrame) -> DataFrame:
    """Words that the common lines of a host take from each document (id, mark, host)."""
    lines = rows.select("id", "mark", "host", F.inline(_own_lines(F.col("text"))))
    holders = lines.groupBy("host", "hash").agg(F.count_if("first").alias("holders"))
    common = holders.where(F.col("holders") > LINE_DOCUMENTS).select("host", "hash")
    hit = lines.join(common, ["host", "hash"]).repartition("id", "mark", "host")
    # Equal rows of the table meet here; each has one first line of a hash.
    once = hit.groupBy("id", "mark", "host", "hash").agg((F.sum("words") / F.count_if("first")).alias("words"))
    return once.groupBy("id", "mark", "host").agg(F.sum("words").cast("long").alias("removed"))


def rate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """For every row: ``id_col``, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, n_removed_words, kept.

    A null text counts as empty and fails the base rules; a null host counts as an empty name. A
    line counts once per document, however often it stands there; repeated rows count as
    documents and get equal results. Other columns are not read.
    """
    rows = docs.select(
        F.col(id_col).alias("id"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
        F.coalesce(F.col(host_col).cast("string"), F.lit("")).alias("host"),
    ).withColumn("mark", F.xxhash64("text"))
    base = rows.select("id", "mark", "host", *[c.cast("long").alias(n) for n, c in measures(F.col("text")).items()])
    removed = _removed_words(rows).withColumnsRenamed({"id": "i", "mark": "m", "host": "h"})
    joined = base.join(
        removed, F.col("id").eqNullSafe(F.col("i")) & (F.col("mark") == F.col("m")) & (F.col("host") == F.col("h")), "left"
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words"))
    own = F.col("n_words") - F.col("n_removed_words")
    return (
        joined.withColumn("n_removed_words", F.coalesce("removed", F.lit(0)).cast("long"))
        .withColumn("base_failed", failed)
        .select(
            F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
            "n_removed_words", (~F.col("base_failed") & (own >= REMAINING * F.col("n_words"))).alias("kept"),
        )
    )
