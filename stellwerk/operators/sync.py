"""Master table: what is new, what is old, what to report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from stellwerk import fixed
from stellwerk.operators.dedup import dedup_by_link


def parse_utc(value: Column) -> Column:
    """Timestamp of an ISO-8601 text; texts without a zone are UTC, others than dates NULL."""
    v = F.trim(value)
    zoned = (
        F.when(v.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.concat(v, F.lit("T00:00:00Z")))
        .when(v.rlike(r"([zZ]|[+-]\d{2}:?\d{2})$"), v)
        .otherwise(F.concat(v, F.lit("Z")))
    )
    return F.when(v.rlike(r"^\d{4}-"), F.try_to_timestamp(zoned))


def utc_format(ts: Column, pattern: str) -> Column:
    """Format in UTC whatever the session's time zone is."""
    return F.date_format(F.to_utc_timestamp(ts, F.current_timezone()), pattern)


def new_postings(batch: DataFrame, master: DataFrame, order: list[str] | None = None) -> DataFrame:
    """Postings of ``batch`` whose link is not in ``master``, first per link.

    The batch is reduced to one row per link first, so no link is hot afterwards. The
    master contributes only its link column, and only links that occur in the batch:
    with a small batch that test is a broadcast and the master is never shuffled.
    """
    unique = dedup_by_link(batch, order)
    known = master.select("link").join(batch.select("link").distinct(), "link", "left_semi")
    return unique.join(known, "link", "left_anti").select(*batch.columns)


def sync_summary(new: DataFrame) -> DataFrame:
    """New postings per run, and in total (``run_id`` NULL)."""
    return new.rollup("run_id").agg(F.count(F.lit(1)).alias("new_rows"))


def days_before(now: Column, days: int) -> Column:
    """Timestamp whole days of 24 hours earlier; interval arithmetic would follow the session zone's clock changes."""
    return F.timestamp_micros(F.unix_micros(now) - F.lit(days * 86_400_000_000))


def retention_class(scraped_at: Column, now: Column, retention_days: int = fixed.MASTER_RETENTION_DAYS) -> Column:
    """``active``, ``archived`` or, for unreadable times, ``quarantine``."""
    cutoff = days_before(now, retention_days)
    return (
        F.when(scraped_at < cutoff, F.lit("archived"))
        .when(scraped_at >= cutoff, F.lit("active"))
        .otherwise(F.lit("quarantine"))
    )


def archive_period(archived: DataFrame, scraped_at: Column) -> DataFrame:
    """First and last month of the archived postings and the archive's name."""
    months = archived.agg(F.min(scraped_at).alias("lo"), F.max(scraped_at).alias("hi")).where(F.col("lo").isNotNull())
    lo, hi = utc_format(F.col("lo"), "yyyyMM"), utc_format(F.col("hi"), "yyyyMM")
    return months.select(
        lo.alias("min_month"), hi.alias("max_month"), F.concat(lo, F.lit("_"), hi, F.lit("_archived_jobs")).alias("name")
    )


def run_date(run: Column) -> Column:
    """Date a run id starts with; NULL where it does not parse."""
    lead = F.substring_index(run, "_", 1)
    return F.when(lead.rlike(r"^\d{8}$"), F.to_date(F.try_to_timestamp(lead, F.lit("yyyyMMdd"))))


def expired_runs(runs: DataFrame, now: Column, retention_days: int = fixed.RUN_RETENTION_DAYS) -> DataFrame:
    """Runs dated before ``now`` minus the retention; undated runs stay. ``now`` has no zone."""
    started = run_date(F.col("run_id")).cast("timestamp_ntz")
    return runs.where(started < now - F.make_dt_interval(F.lit(retention_days)))


def provider_list(df: DataFrame) -> DataFrame:
    return df.select("provider").distinct()


def batch_summary(df: DataFrame, failed: DataFrame | None = None) -> DataFrame:
    """Postings per profile run and in total (``profile`` NULL).

    ``failed`` (profile, error) adds runs that ended in an error, with 0 postings, and, with a
    NULL error, runs that may have kept nothing.
    """
    counts = df.groupBy("profile").agg(F.count(F.lit(1)).alias("postings")).withColumn("error", F.lit(None).cast("string"))
    if failed is not None:
        counts = counts.unionByName(failed.select("profile", F.lit(0).cast("long").alias("postings"), "error"))
    return counts.rollup("profile").agg(
        F.sum("postings").alias("postings"), F.count("error").alias("errors")
    )
