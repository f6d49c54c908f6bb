"""Clean-up of portal texts."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from stellwerk.fixed import CARD_DEFAULTS, POSTED_DEFAULT
from stellwerk.functions.text import strip

SOFT_HYPHEN = "\u00ad"


def _before(col: Column, mark: str) -> Column:
    return F.substring_index(col, mark, 1)


def _without(col: Column, mark: str) -> Column:
    return F.replace(col, F.lit(mark), F.lit(""))


def clean_offer_title(col: Column) -> Column:
    return strip(_without(F.coalesce(col, F.lit("")), SOFT_HYPHEN))


def clean_project_title(col: Column) -> Column:
    return strip(_before(col, "Firmenname"))


def clean_project_heading(col: Column) -> Column:
    return strip(_before(_without(col, " - freelance.de"), "Firmenname"))


def clean_premium_location(col: Column) -> Column:
    return strip(_before(col, "Premiumaccount"))


def clean_city(col: Column) -> Column:
    return strip(_without(col, ","))


def without_label(col: Column, label: str) -> Column:
    """Drop a label such as ``Location:`` wherever it stands, then trim."""
    return strip(_without(col, label))


def default_fill(provider: Column, field: str, value: Column) -> Column:
    """Portal constant where the page gave nothing; some fields are always constant."""
    filled = F.when(F.lit(False), F.lit(""))
    for key, defaults in CARD_DEFAULTS.items():
        if field in defaults:
            filled = filled.when(provider == key, F.lit(defaults[field]))
    if field == "posted_at_relative":
        filled = F.lit(POSTED_DEFAULT)
    return F.coalesce(value, filled, F.lit(""))
