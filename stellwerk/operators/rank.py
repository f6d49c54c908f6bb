"""Ranking and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from stellwerk import fixed
from stellwerk.functions.text import text


def score_or_zero() -> Column:
    return F.coalesce(F.col("relevance_score"), F.lit(0))


def rank_by_score(df: DataFrame, order: str = "seq") -> DataFrame:
    """Best first; equal scores in arrival order.

    The arrival number is part of the sort, so range partitioning also splits a
    score that many postings share.
    """
    return df.orderBy(score_or_zero().desc(), F.col(order))


def top_rows(df: DataFrame, n: int = fixed.TOP_REPORT_ROWS, order: str = "seq") -> DataFrame:
    """The first ``n`` postings of the ranking (a top-k, no full sort)."""
    return rank_by_score(df, order).limit(n)


def top_report(df: DataFrame, n: int = fixed.TOP_REPORT_ROWS, order: str = "seq") -> DataFrame:
    title = F.coalesce(F.col("title"), F.lit("Unknown"))
    top = top_rows(df, n, order)
    ranked = top.withColumn("rank", F.row_number().over(W.orderBy(score_or_zero().desc(), F.col(order))))
    line = F.format_string(
        "%d. %s (%d%%)\n   Posted: %s\n   %s\n",
        F.col("rank"),
        title,
        score_or_zero(),
        F.coalesce(F.col("posted_at_relative"), F.lit("None")),
        F.coalesce(F.col("link"), F.lit("N/A")),
    )
    return ranked.select("rank", title.alias("title"), score_or_zero().alias("relevance_score"), line.alias("line"))


def number_rows(df: DataFrame, order: str = "seq", block: int = 1_000_000, name: str = "rank") -> DataFrame:
    """1-based position in the score ranking, without a single-task window.

    Rows are grouped by score and block of arrival numbers. Counts per group, summed
    upwards, give each group's offset; positions inside a group are local. ``order``
    must be a unique integer, so no group exceeds ``block`` rows however many postings
    share a score; a row without one is an error.
    """
    number = F.coalesce(F.col(order).cast("long"), F.raise_error(F.lit(f"{order} is null: no place in the ranking")).cast("long"))
    keyed = df.withColumns(
        {"_score": score_or_zero(), "_block": F.floor(number / F.lit(float(block))).cast("long")}
    )
    sizes = keyed.groupBy("_score", "_block").agg(F.count(F.lit(1)).alias("_n"))
    per_score = sizes.groupBy("_score").agg(F.sum("_n").alias("_n"))
    # At most 101 scores: one small window is enough across scores.
    above = per_score.select(
        "_score",
        (F.sum("_n").over(W.orderBy(F.col("_score").desc()).rowsBetween(W.unboundedPreceding, 0)) - F.col("_n")).alias(
            "_above"
        ),
    )
    within = W.partitionBy("_score").orderBy("_block").rowsBetween(W.unboundedPreceding, 0)
    offsets = (
        sizes.withColumn("_before", F.sum("_n").over(within) - F.col("_n"))
        .join(above, "_score")
        .select("_score", "_block", (F.col("_above") + F.col("_before")).alias("_offset"))
    )
    local = F.row_number().over(W.partitionBy("_score", "_block").orderBy(order))
    numbered = keyed.withColumn("_local", local).join(offsets, ["_score", "_block"])
    return numbered.withColumn(name, (F.col("_offset") + F.col("_local")).cast("long")).drop(
        "_score", "_block", "_local", "_offset"
    )


def markdown_section(rank: Column) -> Column:
    """One posting's section of the markdown report."""
    return F.format_string(
        "### %d. %s (**%d%%**)\n"
        "- **Provider:** %s | **Location:** %s\n"
        "- **Matching Skills:** %s\n"
        "- **Link:** [View Posting](%s)\n\n---\n",
        rank,
        F.coalesce(F.col("title"), F.lit("Unknown")),
        score_or_zero(),
        F.coalesce(F.col("provider"), F.lit("None")),
        F.coalesce(F.col("location"), F.lit("None")),
        F.coalesce(F.col("matching_skills"), F.lit("None")),
        text("link"),
    )


def markdown_head(date: Column, total: Column) -> Column:
    """Title and total above the sections; ``date`` as yyyy-MM-dd text."""
    return F.format_string("# Job Search Results (%s)\n\nTotal processed: %d\n\n", date, total)


def markdown_report(df: DataFrame, order: str = "seq", date: Column | None = None) -> DataFrame:
    """Rank and section text of every posting, after the head at rank 0 (today's UTC date, if none is given)."""
    sections = number_rows(df, order).select("rank", markdown_section(F.col("rank")).alias("section"))
    today = F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd")
    head = df.agg(F.count(F.lit(1)).alias("_n")).select(
        F.lit(0).cast("long").alias("rank"), markdown_head(today if date is None else date, F.col("_n")).alias("section")
    )
    return head.union(sections)


def per_search_limit(df: DataFrame, limit: int | Column, most: int | None = None, pos: str = "pos") -> DataFrame:
    """First rows per (provider, query, location) in page order; a NULL limit keeps all.

    A constant lets Spark keep at most that many rows per search in each map task before
    the shuffle, so a search holding a large share of the rows never gathers in one task. For
    a limit per row, ``most`` gives the constant; a limit above it, or none, is then an error.
    """
    search = W.partitionBy("provider", "query", "location").orderBy(pos)
    most = limit if isinstance(limit, int) else most
    bounded = F.lit(limit) if isinstance(limit, int) else limit
    if most is not None:
        broken = F.raise_error(F.lit(f"a limit is missing or above {most}")).cast("int")
        df = df.withColumn("_limit", F.when(bounded <= most, bounded.cast("int")).otherwise(broken))
        ranked = df.withColumn("_rn", F.row_number().over(search)).where(F.col("_rn") <= F.lit(most))
        return ranked.where(F.col("_rn") <= F.col("_limit")).drop("_rn", "_limit")
    ranked = df.withColumn("_rn", F.row_number().over(search))
    return ranked.where(bounded.isNull() | (F.col("_rn") <= bounded)).drop("_rn")


def sheet_name(provider: Column) -> Column:
    return F.substring(F.upper(provider), 1, fixed.SHEET_NAME_LENGTH)


def dashboard(df: DataFrame) -> DataFrame:
    """Sheet per posting, ranged by (sheet, score, link) so one large portal spans tasks."""
    keyed = df.withColumn("sheet", sheet_name(F.coalesce(F.col("provider").cast("string"), F.lit("nan"))))
    order = [F.col("sheet"), F.col("relevance_score").desc_nulls_last(), F.col("link")]
    return keyed.repartitionByRange(*order).sortWithinPartitions(*order)


def canonical(df: DataFrame, headers: list[str] = fixed.HEADERS) -> DataFrame:
    """The fixed headers in order as text: absent or NULL becomes '', extra columns go."""
    return df.select(
        *[text(F.col(h).cast("string")).alias(h) if h in df.columns else F.lit("").alias(h) for h in headers]
    )
