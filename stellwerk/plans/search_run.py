"""A search run, from captured pages or injected links to filtered results."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from stellwerk import fixed
from stellwerk.operators import filters
from stellwerk.operators.dedup import dedup_in_run
from stellwerk.operators.enrich import Matching, enrich, enrich_two_pass
from stellwerk.operators.filters import filter_ranked
from stellwerk.operators.rank import rank_by_score, top_rows
from stellwerk.session import materialise
from stellwerk.sources import sinks


@dataclass(frozen=True)
class RunSettings:
    """Search profile settings a run reads."""

    min_relevance_score: float = 0
    exclude_keywords: tuple[str, ...] = ()
    fetch_full_description: bool = False
    manual: bool = False
    formats: tuple[str, ...] = ("csv",)
    base_filename: str = "jobs"
    top_n: int = fixed.TOP_REPORT_ROWS
    keep_nonempty: bool = False
    #: Settings that profiles declare and a plain run leaves alone; see :func:`settings_of`.
    by_type: bool = False
    required_keywords: tuple[str, ...] = ()
    exclude_companies: tuple[str, ...] = ()
    work_location_types: tuple[str, ...] = ()
    employment_types: tuple[str, ...] = ()
    exclude_types: tuple[str, ...] = ()
    languages: tuple[str, ...] = ()
    notify_score: float | None = None
    salary_min: float | None = None


def settings_of(profile: dict, declared: bool = False) -> RunSettings:
    """Settings from a search profile document.

    ``declared`` also takes the ones that profiles declare but a plain run leaves alone: required
    keywords, excluded companies, least pay, work preferences, languages, size of the report, files by
    type, and the score from which to notify.
    """
    filtering, output = profile.get("filtering", {}), profile.get("output", {})
    more = {}
    if declared:
        wanted, notes = profile.get("work_preferences", {}), profile.get("notifications", {})
        scores = [n["min_score_notify"] for n in notes.values() if isinstance(n, dict) and n.get("min_score_notify") is not None]
        more = {
            "by_type": bool(output.get("separate_files_by_type", False)),
            "top_n": profile.get("report", {}).get("top_n_jobs") or fixed.TOP_REPORT_ROWS,
            "required_keywords": tuple(filtering.get("required_keywords") or ()),
            "exclude_companies": tuple(filtering.get("exclude_companies") or ()),
            **{k: tuple(wanted.get(k) or ()) for k in ("work_location_types", "employment_types", "exclude_types")},
            "languages": tuple(profile.get("language_requirements", {}).get("required") or ()),
            "notify_score": min(scores, default=None),
            "salary_min": filtering.get("salary_min"),
        }
    return RunSettings(
        min_relevance_score=filtering.get("min_relevance_score", 0) or 0,
        exclude_keywords=tuple(filtering.get("exclude_keywords", ())),
        fetch_full_description=profile.get("search_parameters", {}).get("fetch_full_description", False),
        formats=tuple(output.get("formats", ("csv",))),
        base_filename=output.get("base_filename", "jobs"),
        **more,
    )


def kept_postings(scored: DataFrame, settings: RunSettings) -> DataFrame:
    """Scored postings that pass every filter of the settings."""
    kept = filter_ranked(scored, settings.min_relevance_score, settings.exclude_keywords, settings.manual)
    if settings.required_keywords:
        kept = kept.where(filters.requires_keywords(settings.required_keywords))
    if settings.exclude_companies:
        kept = kept.where(filters.excludes_companies(settings.exclude_companies))
    if settings.work_location_types or settings.employment_types or settings.exclude_types:
        kept = kept.where(filters.work_preferences(settings.work_location_types, settings.employment_types, settings.exclude_types))
    if settings.salary_min is not None:
        kept = kept.where(filters.least_pay(settings.salary_min))
    return kept.where(filters.required_languages(settings.languages))


def worth_notifying(scored: DataFrame, settings: RunSettings) -> DataFrame:
    """Kept postings from the notification score on; none without such a score."""
    kept = kept_postings(scored, settings)
    return kept.where(filters.min_score(settings.notify_score)) if settings.notify_score is not None else kept.limit(0)


def scored_postings(
    postings: DataFrame, matching: Matching, details: DataFrame | None = None, settings: RunSettings = RunSettings()
) -> DataFrame:
    """Deduplicate, enrich, merge details when asked for, score. Unsorted and lazy.

    Deduplication comes first: nothing is matched or merged twice.
    """
    unique = dedup_in_run(postings)
    if details is not None and (settings.manual or settings.fetch_full_description):
        return enrich_two_pass(unique, details, matching, settings.keep_nonempty)
    return enrich(unique, matching)


def ranked_results(scored: DataFrame, settings: RunSettings = RunSettings()) -> DataFrame:
    """Filtered postings, best first.

    A global sort first samples its input. The shuffle in front of it keeps the scored
    rows, so that sampling reads them back instead of matching every posting twice.
    """
    kept = kept_postings(scored, settings)
    return rank_by_score(kept.repartition("seq"))


def run_search(
    postings: DataFrame,
    matching: Matching,
    out: str,
    details: DataFrame | None = None,
    settings: RunSettings = RunSettings(),
) -> DataFrame:
    """Write raw and filtered results to ``out`` and return the top rows.

    The scored postings are written once and read by every sink.
    """
    scored = materialise(scored_postings(postings, matching, details, settings))
    sinks.write_run(scored, out, settings.formats)
    kept = kept_postings(scored, settings)
    sinks.write_filtered(kept, out, settings.base_filename, settings.formats, by_type=settings.by_type)
    return top_rows(scored, settings.top_n)
