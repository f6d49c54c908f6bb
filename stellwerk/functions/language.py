"""Language vote."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from stellwerk.fixed import ENGLISH_WORDS, GERMAN_WORDS
from stellwerk.functions.text import count_words


def german_votes(lower_text: Column) -> Column:
    return count_words(lower_text, GERMAN_WORDS)


def english_votes(lower_text: Column) -> Column:
    return count_words(lower_text, ENGLISH_WORDS)


def detected_language(lower_text: Column) -> Column:
    """German only with strictly more German than English function words."""
    return F.when(german_votes(lower_text) > english_votes(lower_text), F.lit("German")).otherwise(F.lit("English"))
