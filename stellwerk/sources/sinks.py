"""Writers. Every path is given by the caller; nothing is deleted."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from stellwerk import fixed
from stellwerk.functions.extra import merged_line
from stellwerk.operators.rank import canonical, dashboard, markdown_report, number_rows, rank_by_score
from stellwerk.operators.sync import parse_utc, utc_format
from stellwerk.schema import RUN_FIELDS

CSV_OPTIONS = {
    "header": True,
    "quote": '"',
    "escape": '"',
    "emptyValue": "",
    "ignoreLeadingWhiteSpace": False,
    "ignoreTrailingWhiteSpace": False,
}

#: Runs that one task writes side by side; only the rows left when there are more are sorted by run.
OPEN_RUNS = 100


@contextmanager
def _runs_side_by_side(spark: SparkSession) -> Iterator[None]:
    """Tasks keep a file per run open. Else each sorts all its rows by run first, and holds what a row group or split holds.

    The session's own setting goes before. Only for text and JSON: an open Parquet file holds a whole row group.
    """
    name = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(name)
    if int(before) > 0:
        yield
        return
    spark.conf.set(name, str(OPEN_RUNS))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def write_run(df: DataFrame, path: str, formats=("csv",)) -> None:
    """Raw result: the fixed headers as CSV, all run fields as JSON lines, by run.

    :func:`stellwerk.sources.runs.scan_run_folders` reads both this layout and single run files. A column ``extra`` (a
    JSON object as text) adds its keys to the JSON of its posting; keys of run fields in it are left out.
    """
    if "csv" in formats:
        canonical(df).write.options(**CSV_OPTIONS).mode("errorifexists").csv(f"{path}/all_jobs_raw.csv")
    if "json" in formats:
        fields = [c for c in ["run_id", "seq", *RUN_FIELDS] if c in df.columns]
        by = [c for c in fields if c == "run_id"]
        rows = df.select(*fields)
        if "extra" in df.columns:
            whole = merged_line(F.struct(*[c for c in fields if c not in by]), F.col("extra"))
            rows = df.select(*by, whole.alias("value"))
        writer = rows.write.mode("errorifexists").partitionBy(*by)
        with _runs_side_by_side(df.sparkSession):
            (writer.text if "extra" in df.columns else writer.json)(f"{path}/all_jobs_raw.json")


def write_filtered(
    df: DataFrame, path: str, base: str = "jobs", formats=("csv",), order: str = "seq", by_type: bool = False
) -> None:
    """Filtered result, best first. Nothing is written when no posting passed.

    ``by_type`` writes one folder per employment type.
    """
    if df.isEmpty():
        return
    if "csv" in formats:
        columns = canonical(rank_by_score(df, order))
        writer = columns.withColumn("type", F.col("employment_type")) if by_type else columns
        writer = writer.write.options(**CSV_OPTIONS)
        (writer.partitionBy("type") if by_type else writer).csv(f"{path}/{base}.csv")
    if "json" in formats:
        rank_by_score(df, order).write.json(f"{path}/{base}.json")
    if "markdown" in formats:
        write_markdown(df, f"{path}/{base}.md", order)


def write_markdown(df: DataFrame, path: str, order: str = "seq", date: Column | None = None) -> None:
    """The report, head first and sections in rank order, as text parts that concatenate in order."""
    sections = markdown_report(df, order, date).repartitionByRange("rank").sortWithinPartitions("rank")
    # The writer ends each value with a line break of its own.
    sections.select(F.regexp_replace("section", r"\n\z", "").alias("value")).write.text(path)


def _master_type(header: str) -> str:
    return "int" if header == "relevance_score" else "string"


def append_master(new: DataFrame, path: str, headers: list[str] = fixed.HEADERS) -> None:
    """Append postings to the master table, by month of ``scraped_at``."""
    given = {h: F.col(h) if h in new.columns else F.lit(None) for h in headers}
    rows = new.select(*[given[h].cast(_master_type(h)).alias(h) for h in headers]).withColumn("month", F.coalesce(utc_format(parse_utc(F.col("scraped_at")), "yyyyMM"), F.lit("unknown")))
    # Together by month, so that an append leaves few files; a large month is split over tasks.
    rows.repartitionByRange("month", "link").write.mode("append").partitionBy("month").parquet(path)


def read_master(spark: SparkSession, path: str, headers: list[str] = fixed.HEADERS) -> DataFrame:
    """The master table; an empty frame where nothing has been written yet."""
    fields = ", ".join(f"{h} {_master_type(h)}" for h in headers)
    schema = f"{fields}, month string"
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def write_archive(archived: DataFrame, history: str, name: str) -> None:
    archived.write.mode("errorifexists").parquet(f"{history}/{name}")


def write_dashboard(df: DataFrame, path: str) -> None:
    """One set with every posting and one per portal, each best first."""
    order = [F.col("relevance_score").desc_nulls_last(), F.col("link")]
    df.repartitionByRange(*order).sortWithinPartitions(*order).write.parquet(f"{path}/ALL_JOBS")
    dashboard(df).write.partitionBy("sheet").parquet(f"{path}/sheets")


def write_rows(df: DataFrame, path: str) -> None:
    """Result of a stand-alone row filter: the fixed headers as CSV."""
    canonical(df).write.options(**CSV_OPTIONS).csv(path)


def write_numbered(df: DataFrame, path: str, order: str = "seq") -> None:
    number_rows(df, order).write.parquet(path)
