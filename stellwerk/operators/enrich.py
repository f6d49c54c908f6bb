"""Enrichment of postings: skills, roles, gaps, language, salary, work type, score."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from stellwerk import fixed
from stellwerk.functions import score, skills, types
from stellwerk.functions.language import detected_language
from stellwerk.functions.text import scoring_text
from stellwerk.operators.merge import merge_details
from stellwerk.sources.config import Entry, Profile


@dataclass(frozen=True)
class Matching:
    """What postings are matched against.

    ``category_map`` says which lexicon categories count as a scored profile list
    being mentioned: ``"mapped"`` (the shipped lexicon's own names), ``"strict"``
    (categories named ``<list>_skills`` or ``<list>``), or an explicit mapping.
    """

    profile: Profile
    lexicon: tuple[Entry, ...]
    weights: dict | Column | None = None
    category_map: str | dict = "mapped"
    entries: tuple[Entry, ...] = field(init=False)

    def __post_init__(self):
        lists = fixed.MATCHING_LISTS + [fixed.ROLE_LIST]
        used = [e for e in self.profile.entries if e.category in lists]
        object.__setattr__(self, "entries", tuple(used) + tuple(self.lexicon))

    def lexicon_for(self, category: str) -> list[Entry]:
        if self.category_map == "strict":
            names = [f"{category}_skills", category]
        elif self.category_map == "mapped":
            names = fixed.MAPPED_CATEGORIES[category]
        else:
            names = self.category_map.get(category, [])
        return [e for e in self.lexicon if e.category in names]

    def mine(self) -> list[Entry]:
        return [e for name in fixed.MATCHING_LISTS for e in self.profile.of(name)]


def with_matches(df: DataFrame, m: Matching, text_col: str = "_text") -> DataFrame:
    """Add ``_matched``: candidate texts found in the scoring text.

    The array is exploded from a one-element array. A filter on anything derived from
    it (the score, above all) is then evaluated on the array. Through a plain
    projection Spark would push the filter below and repeat the whole matching in it.
    """
    hits = df.withColumn("_hits", skills.token_hits(text_col, list(m.entries)))
    matched = skills.matched_candidates(text_col, "_hits", list(m.entries))
    return hits.select(*df.columns, F.explode(F.array(matched)).alias("_matched"))


def skill_columns(matched: str, m: Matching) -> dict[str, Column]:
    """The three joined label columns."""
    mine = skills.labels(matched, m.mine())
    everything = skills.labels(matched, list(m.lexicon))
    return {
        "matching_skills": skills.joined(mine, fixed.MAX_MATCHING),
        "matched_roles": skills.joined(skills.labels(matched, m.profile.of(fixed.ROLE_LIST), titled=False)),
        "missing_skills": skills.joined(F.array_except(everything, mine), fixed.MAX_MISSING),
    }


def score_columns(matched: str, m: Matching) -> Column:
    names = [c for _, c in fixed.SCORED_CATEGORIES]
    return score.score_parts(
        {n: skills.match_count(matched, m.profile.of(n)) for n in names},
        {n: skills.mentioned(matched, m.lexicon_for(n)) for n in names},
        F.col("company"),
        F.col("matched_roles"),
        m.profile.known_companies,
        m.weights,
    )


def _optional(df: DataFrame, name: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast("string")


def enrich(df: DataFrame, m: Matching, breakdown: bool = False) -> DataFrame:
    """One enrichment pass. Adds or replaces the eight derived columns.

    A salary already present stays; the work type is only overridden by words in
    the text. ``breakdown`` keeps the partial scores as ``score_parts``.
    """
    salary_before = F.nullif(_optional(df, "salary_hint"), F.lit(""))
    out = df.withColumn("_text", scoring_text())
    out = out.withColumns(
        {
            "detected_languages": detected_language(F.col("_text")),
            "salary_hint": F.coalesce(salary_before, types.salary_hint(F.col("description"))),
            "work_location_type": types.work_type_override(F.col("_text"), _optional(df, "work_location_type")),
        }
    )
    out = with_matches(out, m)
    out = out.withColumns(skill_columns("_matched", m))
    out = out.withColumn("score_parts", score_columns("_matched", m))
    out = out.withColumn("relevance_score", score.relevance_score(F.col("score_parts")))
    return out.drop("_text", "_matched", *([] if breakdown else ["score_parts"]))


def enrich_two_pass(
    df: DataFrame, details: DataFrame, m: Matching, keep_nonempty: bool = False, order: str | None = None
) -> DataFrame:
    """List pass, detail merge, detail pass, as one plan.

    Only salary and work type survive from the list pass, so only those are
    computed there; everything else is derived once, from the merged posting. ``order``
    names the column of ``details`` that decides between several pages of one link.
    """
    list_text = scoring_text()
    first = df.withColumns(
        {
            "salary_hint": F.coalesce(
                F.nullif(_optional(df, "salary_hint"), F.lit("")), types.salary_hint(F.col("description"))
            ),
            "work_location_type": types.work_type_override(list_text, _optional(df, "work_location_type")),
        }
    )
    return enrich(merge_details(first, details, keep_nonempty, order), m)
