"""Stand-alone filters over raw exports: by title words, or by city in any column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from stellwerk import fixed
from stellwerk.operators.dedup import dedup_by_link
from stellwerk.operators.filters import any_column_includes, title_includes
from stellwerk.sources.runs import scan_raw_csv
from stellwerk.sources.sinks import write_rows


def first_matching(rows: DataFrame, condition: Column, order: list[str]) -> DataFrame:
    """First row per link among those that match: the filter comes before deduplication."""
    return dedup_by_link(rows.where(condition), order)


def by_title(spark: SparkSession, folder: str, words=tuple(fixed.TITLE_WORDS)) -> DataFrame:
    return first_matching(scan_raw_csv(spark, folder), title_includes(words), ["path", "seq"])


def by_city(spark: SparkSession, folder: str, words=tuple(fixed.CITY_WORDS)) -> DataFrame:
    rows = scan_raw_csv(spark, folder)
    everywhere = any_column_includes([*fixed.HEADERS, "others"], words)
    return first_matching(rows.withColumn("others", F.concat_ws(" ", "others")), everywhere, ["path", "seq"])


def export_by_title(spark: SparkSession, folder: str, out: str, words=tuple(fixed.TITLE_WORDS)) -> None:
    write_rows(by_title(spark, folder, words), out)


def export_by_city(spark: SparkSession, folder: str, out: str, words=tuple(fixed.CITY_WORDS)) -> None:
    write_rows(by_city(spark, folder, words), out)
