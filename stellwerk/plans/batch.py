"""Several search profiles in one plan."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, functions as F

from stellwerk.operators.dedup import first_by_key, run_key
from stellwerk.operators.enrich import Matching, enrich
from stellwerk.operators.filters import min_score, title_excludes
from stellwerk.operators.sync import batch_summary


def batch_run(postings: DataFrame, profiles: DataFrame, matching: Matching) -> DataFrame:
    """Kept postings of every profile, with their ``profile``.

    ``postings`` carry the ``profile`` whose search found them; ``profiles`` are rows of
    :func:`stellwerk.sources.config.load_search_profiles`, whose weights, score threshold and excluded title words
    apply to their own postings. A posting that two profiles found counts for both. Profiles
    without an entry for a setting take its default; postings of an unknown profile are left out.
    """
    # Profiles are a few documents that people write. Joined by a shuffle, all postings of a profile would meet in one task.
    wanted = postings.join(F.broadcast(profiles.select("profile")), "profile", "left_semi")
    unique = first_by_key(wanted, [F.col("profile"), run_key()], ["seq"])
    settings = profiles.select(
        "profile",
        F.coalesce("scoring_weights", F.create_map().cast("map<string,double>")).alias("_weights"),
        F.coalesce("filtering.min_relevance_score", F.lit(0.0)).alias("_least"),
        F.coalesce("filtering.exclude_keywords", F.array().cast("array<string>")).alias("_excluded"),
    )
    scored = enrich(unique.join(F.broadcast(settings), "profile"), replace(matching, weights=F.col("_weights")))
    kept = scored.where(min_score(F.col("_least")) & title_excludes(F.col("_excluded")))
    return kept.drop("_weights", "_least", "_excluded")


def batch_with_failures(postings: DataFrame, profiles: DataFrame, matching: Matching) -> tuple[DataFrame, DataFrame]:
    """Kept postings of the profiles that could be read, and the summary of all of them.

    ``profiles`` are rows of :func:`stellwerk.sources.config.checked_profiles`. One that has an ``error`` runs nothing and
    counts as one error; the others are not affected. A profile that keeps no posting is in the summary with 0.
    """
    good, said = profiles.where("error IS NULL").drop("error"), profiles.select("profile", "error")
    kept = batch_run(postings, good, matching)
    return kept, batch_summary(kept, said)
