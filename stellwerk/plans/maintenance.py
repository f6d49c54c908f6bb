"""Upkeep of the master table: sync, rotate, refresh the dashboard, list old runs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from stellwerk import fixed
from stellwerk.operators import sync
from stellwerk.session import materialise
from stellwerk.sources import sinks


@dataclass(frozen=True)
class Maintained:
    """Counts of one maintenance run, and the runs that are due for removal."""

    new_rows: int
    archived: int
    expired: DataFrame
    archive_name: str | None


def sync_master(runs: DataFrame, master_path: str) -> int:
    """Append postings whose link the master does not hold; returns how many."""
    spark = runs.sparkSession
    new = materialise(sync.new_postings(runs, sinks.read_master(spark, master_path)))
    count = new.count()
    if count:
        sinks.append_master(new, master_path)
    return count


def rotate(
    spark: SparkSession,
    master_path: str,
    next_master_path: str,
    history: str,
    now: Column,
    retention_days: int = fixed.MASTER_RETENTION_DAYS,
) -> tuple[int, str | None]:
    """Move postings older than the retention to ``history``.

    Active postings go to ``next_master_path``, a new folder, so readers of the current
    master are undisturbed; without anything to archive nothing is written. Postings
    with unreadable times leave the master on a run that archives, to
    ``<history>/<name>_quarantine``.
    """
    master = sinks.read_master(spark, master_path).withColumn("_ts", sync.parse_utc(F.col("scraped_at")))
    part = sync.retention_class(F.col("_ts"), now, retention_days)
    month, unknown = F.col("month"), F.col("month") == "unknown"
    cut_month = sync.utc_format(sync.days_before(now, retention_days), "yyyyMM")
    # The month conditions follow from the class; they let each read skip the other months' files.
    archived = master.where((month <= cut_month) & ~unknown & (part == "archived"))
    active = master.where((month >= cut_month) & ~unknown & (part == "active"))
    period = sync.archive_period(archived, F.col("_ts")).first()
    if period is None:
        return 0, None
    keep, name = [*fixed.HEADERS, "month"], period["name"]
    sinks.write_archive(archived.select(*keep), history, name)
    sinks.write_archive(master.where(unknown).select(*keep), history, f"{name}_quarantine")
    active.select(*keep).write.partitionBy("month").parquet(next_master_path)
    return spark.read.parquet(f"{history}/{name}").count(), name


def maintain(
    spark: SparkSession,
    runs: DataFrame,
    master_path: str,
    next_master_path: str,
    history: str,
    dashboard_path: str,
    now: Column,
    retention_days: int = fixed.MASTER_RETENTION_DAYS,
    run_retention_days: int = fixed.RUN_RETENTION_DAYS,
) -> Maintained:
    """Sync, rotate, dashboard, expired runs, in that order. ``now`` is a UTC timestamp."""
    new_rows = sync_master(runs, master_path)
    archived, name = rotate(spark, master_path, next_master_path, history, now, retention_days)
    current = sinks.read_master(spark, next_master_path if name else master_path)
    sinks.write_dashboard(current.drop("month"), dashboard_path)
    now_utc = F.to_utc_timestamp(now, F.current_timezone()).cast("timestamp_ntz")
    expired = sync.expired_runs(runs.select("run_id").distinct(), now_utc, run_retention_days)
    return Maintained(new_rows, archived, expired, name)
