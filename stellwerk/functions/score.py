"""Relevance score, 0 to 100."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from stellwerk import fixed
from stellwerk.functions.text import contains_any, text


def weight(weights: dict | Column | None, key: str, missing: float) -> Column:
    """Weight of one key: engine defaults for an empty map, ``missing`` for one absent key."""
    default = F.lit(float(fixed.DEFAULT_WEIGHTS[key]))
    if weights is None or isinstance(weights, dict):
        return F.lit(float(weights.get(key, missing))) if weights else default
    empty = F.coalesce(F.size(weights), F.lit(0)) <= 0
    return F.when(empty, default).otherwise(F.coalesce(F.try_element_at(weights, F.lit(key)), F.lit(float(missing))))


def role_count(matched_roles: Column) -> Column:
    """Comma-separated items in the joined roles; 0 when empty."""
    roles = text(matched_roles)
    return F.when(roles == "", F.lit(0)).otherwise(F.size(F.split(roles, ",")))


def known_company(company: Column, known_companies) -> Column:
    return contains_any(F.lower(text(company)), [c.lower() for c in known_companies])


def score_parts(
    matches: dict[str, Column],
    is_mentioned: dict[str, Column],
    company: Column,
    matched_roles: Column,
    known_companies,
    weights: dict | Column | None = None,
) -> Column:
    """Struct of partial scores and the attainable maximum, all doubles."""
    fields, ceilings = [], []
    for key, category in fixed.SCORED_CATEGORIES:
        w = weight(weights, key, fixed.MISSING_CATEGORY_WEIGHT)
        points = (matches[category] * F.lit(fixed.POINTS_PER_SKILL)).cast("double")
        fields.append(F.when(is_mentioned[category], F.least(w, points)).otherwise(F.lit(0.0)).alias(category))
        ceilings.append(F.when(is_mentioned[category], w).otherwise(w * F.lit(fixed.UNMENTIONED_SHARE)))
    wc = weight(weights, "known_companies", fixed.MISSING_COMPANY_WEIGHT)
    ws = weight(weights, "seniority_level", fixed.MISSING_SENIORITY_WEIGHT)
    fields.append(F.when(known_company(company, known_companies), wc).otherwise(F.lit(0.0)).alias("company"))
    per_role = (role_count(matched_roles) * F.lit(fixed.POINTS_PER_ROLE)).cast("double")
    fields.append(F.least(ws, per_role).alias("seniority"))
    maximum = reduce(lambda a, b: a + b, ceilings) + (wc + ws)
    return F.struct(*fields, maximum.alias("maximum"))


def relevance_score(parts: Column) -> Column:
    """Score from :func:`score_parts`, truncated to an integer."""
    names = [c for _, c in fixed.SCORED_CATEGORIES] + ["company", "seniority"]
    total = reduce(lambda a, b: a + b, [parts[n] for n in names])
    ratio = (total / F.nullif(parts["maximum"], F.lit(0.0))) * F.lit(100.0)
    return F.when(parts["maximum"] > 0, ratio.cast("int")).otherwise(F.lit(0))
