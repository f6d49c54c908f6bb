"""Rotation of the master table in place: old postings are archived, and a record says so.

No file of the master is written again. The archive is written first, then one small record with the time of the cut;
readers leave out what lies before the last record's cut. A rotation that ends early has no record, so the master
is as before and the next rotation does the work anew, in a folder of its own.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from stellwerk import fixed
from stellwerk.operators import sync
from stellwerk.session import materialise
from stellwerk.sources import sinks

_RECORD = "name string, folder string, cut bigint, cut_month string, files array<string>, archived bigint"


def _records(spark: SparkSession, history: str) -> DataFrame:
    """Rotations that were carried through; none where nothing has been rotated."""
    try:
        return spark.read.schema(_RECORD).json(f"{history}/records/*")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], _RECORD)


def read_active(spark: SparkSession, master_path: str, history: str) -> DataFrame:
    """The master table without what rotations have archived or put in quarantine.

    Months before the last cut are not read. Of the postings with unreadable times those are left
    out whose files a rotation has dealt with; later ones are there.
    """
    master = sinks.read_master(spark, master_path)
    records = _records(spark, history)
    last = records.agg(F.max("cut").alias("cut"), F.max("cut_month").alias("month")).first()
    if last is None or last["cut"] is None:
        return master
    dealt = records.select(F.explode("files").alias("_file")).distinct()
    unknown = F.col("month") == "unknown"
    ts = sync.parse_utc(F.col("scraped_at"))
    dated = master.where(~unknown & (F.col("month") >= last["month"]) & (F.unix_micros(ts) >= last["cut"]))
    odd = master.where(unknown).withColumn("_file", F.col("_metadata.file_path"))
    return dated.unionByName(odd.join(dealt, "_file", "left_anti").select(*master.columns))


def rotate_in_place(
    spark: SparkSession, master_path: str, history: str, now: Column, retention_days: int = fixed.MASTER_RETENTION_DAYS
) -> tuple[int, str | None]:
    """Archive postings older than the retention; returns how many, and the archive's name.

    The months up to the cut are read, the later ones are not touched. Postings with unreadable times
    go to quarantine on a run that archives. Nothing is written if there is nothing to archive.
    """
    active = read_active(spark, master_path, history)
    cut = sync.days_before(now, retention_days)
    at = spark.range(1).select(F.unix_micros(cut).alias("cut"), sync.utc_format(cut, "yyyyMM").alias("month")).first()
    ts = sync.parse_utc(F.col("scraped_at"))
    unknown = F.col("month") == "unknown"
    keep = [*fixed.HEADERS, "month"]
    old = active.where(~unknown & (F.col("month") <= at["month"]) & (F.unix_micros(ts) < at["cut"]))
    period = sync.archive_period(old.withColumn("_ts", ts), F.col("_ts")).first()
    if period is None:
        return 0, None
    folder = f"{history}/archives/{period['name']}-{uuid.uuid4().hex[:12]}"
    sinks.write_archive(old.select(*keep), *folder.rsplit("/", 1))
    odd = materialise(_unknown_rows(spark, master_path, history))
    sinks.write_archive(odd.select(*keep), *f"{folder}-quarantine".rsplit("/", 1))
    archived = spark.read.parquet(folder).count()
    files = odd.agg(F.collect_set("_file").alias("files"))
    record = files.select(
        F.lit(period["name"]).alias("name"), F.lit(folder).alias("folder"), F.lit(at["cut"]).alias("cut"),
        F.lit(at["month"]).alias("cut_month"), "files", F.lit(archived).cast("bigint").alias("archived"),
    )
    record.coalesce(1).write.json(f"{history}/records/{uuid.uuid4().hex}")
    return archived, period["name"]


def _unknown_rows(spark: SparkSession, master_path: str, history: str) -> DataFrame:
    """Postings with unreadable times that no rotation has dealt with, and their files."""
    dealt = _records(spark, history).select(F.explode("files").alias("_file")).distinct()
    odd = sinks.read_master(spark, master_path).where("month = 'unknown'").withColumn("_file", F.col("_metadata.file_path"))
    return odd.join(dealt, "_file", "left_anti")


def archives(spark: SparkSession, history: str) -> list[str]:
    """Folders of the archives that rotations have recorded, oldest first."""
    return [r["folder"] for r in _records(spark, history).orderBy("cut").select("folder").collect()]


def stale_months(spark: SparkSession, master_path: str, history: str) -> list[str]:
    """Folders of the months that lie before the last cut as a whole: no reader needs them, they may be removed."""
    last = _records(spark, history).agg(F.max("cut_month").alias("month")).first()
    if last is None or last["month"] is None:
        return []
    months = sinks.read_master(spark, master_path).where((F.col("month") < last["month"]) & (F.col("month") != "unknown"))
    return [f"{master_path}/month={r['month']}" for r in months.select("month").distinct().orderBy("month").collect()]
