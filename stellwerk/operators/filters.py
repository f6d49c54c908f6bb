"""Row filters over postings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from stellwerk import fixed
from stellwerk.functions.pay import reaches
from stellwerk.functions.text import contains_any, contains_any_of, scoring_text, text


def min_score(threshold, score: str = "relevance_score") -> Column:
    return F.coalesce(F.col(score), F.lit(0)) >= (threshold if isinstance(threshold, Column) else F.lit(threshold))


def title_excludes(words) -> Column:
    """True when no word is a substring of the title ("intern" also drops "International")."""
    low = F.lower(text("title"))
    if isinstance(words, Column):
        return ~contains_any_of(low, words)
    return ~contains_any(low, [w.lower() for w in words])


def title_includes(words=tuple(fixed.TITLE_WORDS)) -> Column:
    return contains_any(F.lower(text("title")), [w.lower() for w in words])


def any_column_includes(columns: list[str], words=tuple(fixed.CITY_WORDS)) -> Column:
    """True when any word occurs in the row's values joined by blanks.

    A value that is absent reads as the word ``None``, as a row of a short file does.
    """
    values = [F.coalesce(F.col(c).cast("string"), F.lit("None")) for c in columns]
    return contains_any(F.lower(F.concat_ws(" ", *values)), [w.lower() for w in words])


def has_link(link: str = "link") -> Column:
    return text(link) != ""


def filter_ranked(df: DataFrame, min_relevance=0, exclude_keywords=(), manual: bool = False) -> DataFrame:
    """Score threshold (0 for injected links) and title exclusion."""
    return df.where(min_score(0 if manual else min_relevance) & title_excludes(exclude_keywords))


# Declared in search profiles; off unless called.


def requires_keywords(words) -> Column:
    """Every word occurs in the scoring text."""
    low = scoring_text()
    result = F.lit(True)
    for w in words:
        result = result & F.contains(low, F.lit(w.lower()))
    return result


def excludes_companies(companies) -> Column:
    return ~contains_any(F.lower(text("company")), [c.lower() for c in companies])


def work_preferences(work_location_types=None, employment_types=None, exclude_types=None) -> Column:
    result = F.lit(True)
    if work_location_types:
        result = result & F.col("work_location_type").isin(*work_location_types)
    if employment_types:
        result = result & F.col("employment_type").isin(*employment_types)
    if exclude_types:
        result = result & ~F.col("employment_type").isin(*exclude_types)
    return F.coalesce(result, F.lit(False))


def required_languages(languages) -> Column:
    return F.col("detected_languages").isin(*languages) if languages else F.lit(True)


def scraped_within(days: int, now: Column, scraped_at: Column) -> Column:
    """Scraped in the last ``days`` days; unreadable times do not pass."""
    return F.coalesce(scraped_at >= now - F.make_dt_interval(F.lit(days)), F.lit(False))


def least_pay(salary_min: float, unknown: bool = True) -> Column:
    """A year's pay can reach ``salary_min``; postings that name none pass unless told otherwise."""
    return reaches(F.col("salary_hint"), salary_min, unknown)
