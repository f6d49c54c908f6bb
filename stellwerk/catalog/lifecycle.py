"""Master table upkeep over the events: users are links, days are runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from stellwerk.catalog import Catalog
from stellwerk.catalog.base import table
from stellwerk.operators import sync

CUT = "2024-01-16 00:00:00"
NOW = "2024-07-20 12:00:00"

AS_POSTINGS = """
SELECT event_id AS seq, concat(event_type, '/', cast(user_id AS STRING)) AS link, event_type AS provider,
       strftime(ts, '%Y%m%d_%H%M') AS run_id, value, ts FROM events
"""
NEW_SQL = f"""
SELECT seq, link, run_id FROM (
  SELECT *, row_number() OVER (PARTITION BY link ORDER BY run_id, seq) AS rn FROM ({AS_POSTINGS}) WHERE ts >= TIMESTAMP '{CUT}'
) WHERE rn = 1 AND link NOT IN (SELECT link FROM ({AS_POSTINGS}) WHERE ts < TIMESTAMP '{CUT}' AND value > 40)
"""


def as_postings(spark, sf):
    return table(spark, sf, "events").select(
        F.col("event_id").alias("seq"),
        F.concat("event_type", F.lit("/"), F.col("user_id").cast("string")).alias("link"),
        F.col("event_type").alias("provider"),
        F.date_format("ts", "yyyyMMdd_HHmm").alias("run_id"),
        "value",
        "ts",
    )


def new_rows(spark, sf):
    p = as_postings(spark, sf)
    cut = F.lit(CUT).cast("timestamp_ntz")
    batch = p.where(F.col("ts") >= cut).select("seq", "link", "run_id")
    return sync.new_postings(batch, p.where((F.col("ts") < cut) & (F.col("value") > 40)))


#: Times as the text a master table holds; some without a zone, some unreadable.
STAMPED = """
SELECT event_id, CASE event_id % 10 WHEN 0 THEN 'garbage' WHEN 1 THEN strftime(ts, '%Y-%m-%d %H:%M:%S')
                      WHEN 2 THEN strftime(ts, '%Y-%m-%d') WHEN 3 THEN ''
                      ELSE concat(strftime(ts, '%Y-%m-%dT%H:%M:%S.%f'), '+00:00') END AS scraped_at,
       CASE event_id % 10 WHEN 0 THEN NULL WHEN 1 THEN date_trunc('second', ts) WHEN 2 THEN date_trunc('day', ts) WHEN 3 THEN NULL
            ELSE ts END AS ts
FROM events
"""
CLASS_SQL = f"""
CASE WHEN ts < TIMESTAMP '{NOW}' - INTERVAL 180 DAY THEN 'archived'
     WHEN ts >= TIMESTAMP '{NOW}' - INTERVAL 180 DAY THEN 'active' ELSE 'quarantine' END
"""


def stamped(spark, sf):
    i = F.col("event_id") % 10
    text = (
        F.when(i == 0, "garbage")
        .when(i == 1, F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
        .when(i == 2, F.date_format("ts", "yyyy-MM-dd"))
        .when(i == 3, "")
        .otherwise(F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("+00:00")))
    )
    return table(spark, sf, "events").select("event_id", text.alias("scraped_at"))


def utc_now():
    return F.lit(NOW + "+00:00").cast("timestamp")


def register(c: Catalog) -> None:
    @c.add("incremental_sync", NEW_SQL)
    def incremental_sync(spark, sf):
        return new_rows(spark, sf)

    @c.add("sync_summary", f"SELECT run_id, count(*) AS new_rows FROM ({NEW_SQL}) GROUP BY ROLLUP (run_id)")
    def sync_summary(spark, sf):
        return sync.sync_summary(new_rows(spark, sf))

    @c.add("retention_split", f"SELECT event_id, scraped_at, {CLASS_SQL} AS part FROM ({STAMPED})")
    def retention_split(spark, sf):
        part = sync.retention_class(sync.parse_utc(F.col("scraped_at")), utc_now())
        return stamped(spark, sf).withColumn("part", part)

    @c.add("retention_counts", f"SELECT {CLASS_SQL} AS part, count(*) AS n FROM ({STAMPED}) GROUP BY 1")
    def retention_counts(spark, sf):
        part = sync.retention_class(sync.parse_utc(F.col("scraped_at")), utc_now())
        return stamped(spark, sf).groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))

    @c.add(
        "archive_period",
        f"""SELECT strftime(min(ts), '%Y%m') AS min_month, strftime(max(ts), '%Y%m') AS max_month,
                   concat(strftime(min(ts), '%Y%m'), '_', strftime(max(ts), '%Y%m'), '_archived_jobs') AS name
            FROM ({STAMPED}) WHERE {CLASS_SQL} = 'archived'""",
    )
    def archive_period(spark, sf):
        rows = stamped(spark, sf).withColumn("ts", sync.parse_utc(F.col("scraped_at")))
        archived = rows.where(sync.retention_class(F.col("ts"), utc_now()) == "archived")
        return sync.archive_period(archived, F.col("ts"))

    runs = """SELECT DISTINCT CASE WHEN event_type = 'error' THEN concat('misc_', user_id) WHEN event_type = 'view' THEN '20241399_0000_x'
        ELSE concat(strftime(ts, '%Y%m%d_%H%M'), '_', event_type) END AS run_id FROM events"""

    @c.add(
        "expired_runs",
        f"""SELECT run_id FROM ({runs})
            WHERE try_strptime(split_part(run_id, '_', 1), '%Y%m%d') < TIMESTAMP '2024-01-31 10:00:00' - INTERVAL 14 DAY""",
    )
    def expired_runs(spark, sf):
        e = F.col("event_type")
        run = (
            F.when(e == "error", F.concat(F.lit("misc_"), F.col("user_id").cast("string")))
            .when(e == "view", "20241399_0000_x")
            .otherwise(F.concat(F.date_format("ts", "yyyyMMdd_HHmm"), F.lit("_"), e))
        )
        names = table(spark, sf, "events").select(run.alias("run_id")).distinct()
        return sync.expired_runs(names, F.lit("2024-01-31 10:00:00").cast("timestamp_ntz"))

    @c.add(
        "master_months",
        f"SELECT coalesce(strftime(ts, '%Y%m'), 'unknown') AS month, count(*) AS n FROM ({STAMPED}) GROUP BY 1",
    )
    def master_months(spark, sf):
        month = F.coalesce(sync.utc_format(sync.parse_utc(F.col("scraped_at")), "yyyyMM"), F.lit("unknown"))
        return stamped(spark, sf).groupBy(month.alias("month")).agg(F.count(F.lit(1)).alias("n"))
