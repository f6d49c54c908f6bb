"""Skill matching as a join, for lexicons too large for expressions.

Postings explode to their distinct tokens and meet the lexicon on a candidate's first
token. Plain candidates match on equality alone; only the rest is checked against the
text. Its boundaries are marked once per posting, so no pattern depends on a candidate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from stellwerk import fixed
from stellwerk.functions import skills

#: Two tokens with a blank between them, from every token on.
PAIRS = f"(?<![{skills.ALNUM}])(?=([{skills.ALNUM}]+ [{skills.ALNUM}]+))"
MARK = rf"[^{skills.ALNUM} \t\n\x0b\f\r]"


def prepare_lexicon(lexicon: DataFrame) -> DataFrame:
    """Add ``lead``, ``how`` (plain, bounded or substring) and the ``form`` to look for to candidate rows.

    The lead is what a text must hold for the candidate to match at all: its first
    ASCII token or, for candidates without one and for substring candidates, its first
    other character. One token, or two with a blank between them, are a lead of their own.
    """
    candidate = F.col("candidate")
    token = F.nullif(F.regexp_extract(candidate, "([a-z0-9]+)", 1), F.lit(""))
    mark = F.regexp_extract(candidate, f"({MARK})", 1)
    loose = candidate.isin(*fixed.SUBSTRING_CANDIDATES)
    how = (
        F.when(loose, F.lit("substring"))
        .when(candidate.rlike("^[a-z0-9]+( [a-z0-9]+)?$"), F.lit("plain"))
        .otherwise(F.lit("bounded"))
    )
    pair = candidate.rlike("^[a-z0-9]+ [a-z0-9]+$")
    lead = F.when(pair, candidate).when(loose, mark).otherwise(F.coalesce(token, mark))
    return lexicon.withColumns({"lead": lead, "how": how, "form": F.when(loose, candidate).otherwise(skills.marked(candidate))})


def _holds(text: Column, marked: Column, form: Column, how: Column) -> Column:
    """The candidate stands in the text, between boundaries unless a substring will do."""
    return F.when(how == "substring", F.contains(text, form)).otherwise(F.contains(marked, form))


def _salted(df: DataFrame, salts: int) -> DataFrame:
    return df.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))


def match_candidates(
    postings: DataFrame, lexicon: DataFrame, key: str = "seq", text: str = "_text", salts: int = 16, marks: bool = True
) -> DataFrame:
    """``key, salt, candidate`` for every candidate text found, once each.

    Every posting holds common words, so lead keys are skewed: postings spread each lead
    over ``salts`` groups and the lexicon is repeated per salt. Spark decides by size
    whether the lexicon is broadcast instead. Plain candidates match on the lead alone; a
    posting's other possible ones (at most the lexicon's) are gathered and meet its text once.
    ``marks=False`` is for lexicons with an ASCII token in every candidate.
    """
    wanted = _salted(prepare_lexicon(lexicon.select("candidate").distinct()), salts)
    low = F.col(text)
    leads = skills.tokens(text)
    leads = F.concat(leads, F.regexp_extract_all(low, F.lit(PAIRS), F.lit(1)))
    if marks:
        leads = F.concat(leads, F.regexp_extract_all(low, F.lit(f"({MARK})"), 1))
    salt = F.pmod(F.xxhash64(key), F.lit(salts)).cast("int").alias("salt")
    found = postings.select(key, salt, F.explode(F.array_distinct(leads)).alias("lead")).where(F.col("lead") != "")
    # A plain candidate is its lead, so where that stands nothing is left to check and no text is needed.
    plain = F.col("how") == "plain"
    sure = found.join(wanted.where(plain).select("lead", "salt"), ["lead", "salt"]).select(key, "salt", F.col("lead").alias("candidate"))
    hits = found.join(wanted.where(~plain), ["lead", "salt"])
    possible = hits.groupBy(key, "salt").agg(F.collect_list(F.struct("candidate", "how", "form")).alias("_c"))
    held = F.filter("_c", lambda c: _holds(low, F.col("_marked"), c["form"], c["how"]))
    checked = (
        possible.join(postings.select(key, text, skills.marked(low).alias("_marked")), key)
        .select(key, "salt", F.explode(held).alias("_c"))
        .select(key, "salt", "_c.candidate")
    )
    return sure.unionByName(checked)


def match_join(
    postings: DataFrame, lexicon: DataFrame, key: str = "seq", text: str = "_text", salts: int = 16, marks: bool = True
) -> DataFrame:
    """``key, list_name, category, entry_no, label`` of matching entries.

    An entry appears once per matching candidate; count or collect it distinctly.
    """
    matched = match_candidates(postings, lexicon, key, text, salts, marks)
    return matched.join(_salted(lexicon, salts), ["candidate", "salt"]).select(
        key, "list_name", "category", "entry_no", "label"
    )


def entry_counts(matches: DataFrame, key: str = "seq") -> DataFrame:
    """Matching entries per posting and category."""
    return (
        matches.groupBy(key, "list_name", "category", "entry_no").agg(F.first("label").alias("label"))
        .groupBy(key, "list_name", "category").agg(F.count(F.lit(1)).alias("matches"))
    )


def label_lists(matches: DataFrame, key: str = "seq", limit: int | None = None) -> DataFrame:
    """Sorted distinct labels per posting, joined; never more than the lexicon has."""
    return matches.groupBy(key).agg(skills.joined(F.collect_set("label"), limit).alias("labels"))
