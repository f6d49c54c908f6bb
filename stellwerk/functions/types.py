"""Work location, employment and salary, read from text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from stellwerk import fixed
from stellwerk.functions.text import contains_any, text


def work_type_override(lower_text: Column, current: Column) -> Column:
    """Remote words win over hybrid words; otherwise the current value stays."""
    return (
        F.when(contains_any(lower_text, fixed.ENRICH_REMOTE_WORDS), F.lit("Remote"))
        .when(contains_any(lower_text, fixed.ENRICH_HYBRID_WORDS), F.lit("Hybrid"))
        .otherwise(current)
    )


def work_type_from_text(value: Column) -> Column:
    low = F.lower(value)
    return (
        F.when(contains_any(low, fixed.TEXT_REMOTE_WORDS), F.lit("Remote"))
        .when(contains_any(low, fixed.TEXT_HYBRID_WORDS), F.lit("Hybrid"))
        .otherwise(F.lit("On-site"))
    )


def employment_type_from_text(value: Column) -> Column:
    low = F.lower(value)
    return (
        F.when(contains_any(low, fixed.TEXT_CONTRACT_WORDS), F.lit("Contract"))
        .when(contains_any(low, fixed.TEXT_INTERN_WORDS), F.lit("Internship"))
        .otherwise(F.lit("Full-time"))
    )


def employment_from_code(code: Column) -> Column:
    """Portal job type name to employment type; freelance is checked last and wins."""
    code = F.coalesce(code, F.lit("Full-time"))
    return (
        F.when(F.contains(code, F.lit("Freiberuflich")), F.lit("Freelance"))
        .when(contains_any(code, ["Vollzeit", "Full"]), F.lit("Full-time"))
        .otherwise(code)
    )


def work_type_from_code(code: Column) -> Column:
    code = F.coalesce(code, F.lit("Hybrid"))
    return F.when(contains_any(code, ["Remote", "Mobil"]), F.lit("Remote")).otherwise(code)


def remote_if(condition: Column) -> Column:
    return F.when(condition, F.lit("Remote")).otherwise(F.lit("On-site"))


def portal_work_type(provider: Column, title: Column, location: Column, remote_flag: Column) -> Column:
    """Work type as each portal's result list implies it."""
    title, location = text(title), text(location)
    flag = F.coalesce(remote_flag, F.lit(False))
    return (
        F.when(provider == "hays", remote_if(contains_any(F.lower(F.concat(title, location)), fixed.HAYS_REMOTE_WORDS)))
        .when(provider == "solcom", remote_if(F.contains(F.lower(title), F.lit("remote"))))
        .when(provider == "gulp", remote_if(flag | F.contains(location, F.lit("Remote"))))
        .when(provider == "freelance_de", remote_if(flag | F.contains(F.lower(location), F.lit("remote"))))
        .when(provider.isin("xing", "freelancermap"), F.lit("On-site"))
        .otherwise(remote_if(flag))
    )


def salary_hint(description: Column) -> Column:
    """First salary figure behind a salary word, or empty.

    Every figure has a currency sign or ``eur`` in it, so only texts that hold one are searched.
    """
    given = text(description)
    named = F.contains(given, F.lit("€")) | F.contains(given, F.lit("$")) | F.contains(F.lower(given), F.lit("eur"))
    return F.when(named, F.regexp_extract(given, fixed.SALARY_PATTERN, 1)).otherwise(F.lit(""))
