"""Writing and reading back: runs, exports, link lists, the master table, the stream."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from stellwerk import fixed
from stellwerk.catalog import Catalog
from stellwerk.catalog.base import POSTINGS, postings, quoted
from stellwerk.catalog.lifecycle import as_postings
from stellwerk.catalog.links import PORTAL_URLS, PROVIDER_SQL, portal_urls
from stellwerk.catalog.reports import REPORT_DATE, any_contains, markdown_sql
from stellwerk.functions.extra import extra_value
from stellwerk.operators.sync import days_before, new_postings
from stellwerk.plans.maintenance import maintain, sync_master
from stellwerk.plans.rotation import archives, read_active, rotate_in_place
from stellwerk.plans.row_filters import by_city, by_title, export_by_title
from stellwerk.schema import RUN_FIELDS
from stellwerk.session import shared_dir
from stellwerk.sources import runs, sinks
from stellwerk.streaming.keyed import start_keyed_sync
from stellwerk.streaming.sync import read_run_stream

#: Run rows: every header the postings view has, and the whole text in a header column.
GIVEN = ["search_criteria", "provider", "title", "company", "location", "work_location_type", "employment_type",
         "posted_at_relative", "link"]


def run_rows(spark, sf):
    return postings(spark, sf).withColumns(
        {"relevance_score": (F.length("description") % 60).cast("int"), "salary_hint": F.col("description")}
    )


def event_runs(spark, sf):
    """Events as postings of daily runs, with the time as text."""
    stamp = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00"))
    return as_postings(spark, sf).select(
        "seq", "link", "provider", F.substring("run_id", 1, 8).alias("run_id"), stamp.alias("scraped_at"),
        F.col("value").cast("int").alias("relevance_score"),
    )


#: Headers that runs made of events fill.
MASTER_GIVEN = ["link", "provider", "relevance_score", "scraped_at"]
EVENT_RUNS = """
SELECT event_id AS seq, cast(trunc(value) AS INTEGER) AS relevance_score, concat(event_type, '/', cast(user_id AS STRING)) AS link, event_type AS provider,
       strftime(ts, '%Y%m%d') AS run_id, date_trunc('second', ts) AS ts FROM events
"""
MASTER_SQL = f"""
SELECT link, provider, ts FROM (
  SELECT *, row_number() OVER (PARTITION BY link ORDER BY run_id, seq) AS rn FROM ({EVENT_RUNS})) WHERE rn = 1
"""
NOW = "2024-01-12 00:00:00"
FIRST_OF_LINKS = f"""
SELECT link, provider, relevance_score, scraped_at, month, {', '.join(f"'' AS {h}" for h in fixed.HEADERS if h not in MASTER_GIVEN)}
FROM (SELECT *, row_number() OVER (PARTITION BY link ORDER BY run_id, seq) AS rn,
             strftime(ts, '%Y-%m-%dT%H:%M:%S+00:00') AS scraped_at, strftime(ts, '%Y%m') AS month
      FROM ({EVENT_RUNS})) WHERE rn = 1
"""
#: Days from this one on arrive after the stream's restart.
STREAM_CUT = "20240104"


def whole_master(master: DataFrame) -> DataFrame:
    return master.select(*MASTER_GIVEN, "month", *[F.coalesce(h, F.lit("")).alias(h) for h in fixed.HEADERS if h not in MASTER_GIVEN])


def register(c: Catalog) -> None:
    @c.add(
        "run_table",
        f"""SELECT seq, run_id, job_id, description, cast(length(description) % 60 AS INTEGER) AS relevance_score,
                   {', '.join(GIVEN)} FROM ({POSTINGS})""",
    )
    def run_table(spark, sf):
        out = shared_dir(spark)
        sinks.write_run(run_rows(spark, sf), out, ("json",))
        rows = runs.scan_run_table(spark, f"{out}/all_jobs_raw.json")
        return rows.select("seq", "run_id", "job_id", "description", "relevance_score", *GIVEN)

    @c.add(
        "run_extra_keys",
        f"""SELECT run_id, seq, title, CASE WHEN more THEN chars END AS chars, CASE WHEN more THEN company END AS tag,
                   CASE WHEN more THEN link END AS deep, CASE WHEN more THEN 'chars,tags,deep' END AS keys
            FROM (SELECT *, seq % 4 <> 0 AS more, cast(length(description) AS INTEGER) AS chars FROM ({POSTINGS}))""",
    )
    def run_extra_keys(spark, sf):
        """Further keys are written beside the fields, scanned back and read by path; one named like a field does not count."""
        out = shared_dir(spark)
        parts = "'title', 'clash', 'chars', length(description), 'tags', array(provider, company), 'deep', named_struct('link', link)"
        extra = F.when(F.col("seq") % 4 != 0, F.expr(f"to_json(named_struct({parts}))")).otherwise(F.lit('{"seq":-1}'))
        sinks.write_run(run_rows(spark, sf).withColumn("extra", extra), f"{out}/runs/all", ("json",))
        found = runs.scan_run_folders(spark, f"{out}/runs", extra=True)
        read = [extra_value("chars", "int").alias("chars"), extra_value("tags[1]").alias("tag"), extra_value("deep.link").alias("deep")]
        return found.select("run_id", "seq", "title", *read, F.array_join(F.json_object_keys("extra"), ",").alias("keys"))

    @c.add("run_to_master", FIRST_OF_LINKS)
    def run_to_master(spark, sf):
        """Runs are written, scanned from their folders, synchronised; every master column is compared."""
        out = shared_dir(spark)
        sinks.write_run(event_runs(spark, sf), f"{out}/runs/all", ("json",))
        sync_master(runs.scan_run_folders(spark, f"{out}/runs"), f"{out}/master")
        return whole_master(sinks.read_master(spark, f"{out}/master"))

    @c.add(
        "raw_export_by_city",
        f"""SELECT DISTINCT link, 'note' AS via FROM ({POSTINGS}) WHERE {any_contains("lower(concat(title, ' ', description))", fixed.CITY_WORDS)}
              OR seq % 5 = 0""",
    )
    def raw_export_by_city(spark, sf):
        """Exports whose columns stand in another order, with one more that only the city filter searches."""
        out = shared_dir(spark)
        rows = run_rows(spark, sf)
        note = F.when(F.col("seq") % 5 == 0, F.lit(f"office in {fixed.CITY_WORDS[0].upper()}")).otherwise("")
        turned = [F.col(h) for h in ("salary_hint", "link", "title")]
        rows.select(note.alias("note"), *turned).write.options(**sinks.CSV_OPTIONS).csv(f"{out}/all_jobs_raw.csv")
        return by_city(spark, out).select("link", F.lit("note").alias("via"))

    values = {g: g for g in GIVEN} | {
        "relevance_score": "cast(length(description) % 60 AS STRING)", "salary_hint": "description"
    }

    @c.add(
        "raw_export",
        "SELECT " + ", ".join(f"{values.get(h, quoted(''))} AS {h}" for h in fixed.HEADERS) + f" FROM ({POSTINGS})",
    )
    def raw_export(spark, sf):
        out = shared_dir(spark)
        sinks.write_run(run_rows(spark, sf), out, ("csv",))
        return runs.scan_raw_csv(spark, out).select(*fixed.HEADERS)

    @c.add(
        "raw_export_by_title",
        f"SELECT DISTINCT link FROM ({POSTINGS}) WHERE {any_contains('lower(title)', fixed.TITLE_WORDS)}",
    )
    def raw_export_by_title(spark, sf):
        out = shared_dir(spark)
        sinks.write_run(run_rows(spark, sf), out, ("csv",))
        return by_title(spark, out).select("link")

    @c.add(
        "helper_export",
        f"SELECT DISTINCT link FROM ({POSTINGS}) WHERE {any_contains('lower(title)', fixed.TITLE_WORDS)}",
    )
    def helper_export(spark, sf):
        """The title filter's own file, read back; it has the fixed headers and no other column."""
        out = shared_dir(spark)
        sinks.write_run(run_rows(spark, sf), f"{out}/run", ("csv",))
        export_by_title(spark, f"{out}/run", f"{out}/found")
        found = spark.read.options(**sinks.CSV_OPTIONS).option("multiLine", True).csv(f"{out}/found")
        return found.select(*fixed.HEADERS).select("link")

    @c.add(
        "link_list",
        f"""SELECT url AS link, {PROVIDER_SQL} ELSE 'linkedin' END AS provider,
            {', '.join(f'{quoted(v)} AS {k}' for k, v in fixed.MANUAL_TEMPLATE.items())}
            FROM ({PORTAL_URLS}) WHERE NOT contains(url, '#top')""",
    )
    def link_list(spark, sf):
        out = shared_dir(spark)
        url = F.when(~F.contains("url", F.lit("#top")), F.col("url")).otherwise("")
        rows = portal_urls(spark, sf).select(F.col("page_id").cast("string").alias("note"), url.alias("link"))
        rows.write.options(**sinks.CSV_OPTIONS).csv(out)
        return runs.scan_link_list(spark, out).select("link", "provider", *fixed.MANUAL_TEMPLATE)

    @c.add(
        "captured_scan",
        f"SELECT page_id, {PROVIDER_SQL} END AS provider FROM pages",
    )
    def captured_scan(spark, sf):
        return runs.scan_pages(spark, f"{sf}/pages.parquet").select("page_id", "provider")

    @c.add("master_table", f"SELECT strftime(ts, '%Y%m') AS month, link, provider, strftime(ts, '%Y-%m-%dT%H:%M:%S+00:00') AS scraped_at FROM ({MASTER_SQL})")
    def master_table(spark, sf):
        out = shared_dir(spark)
        new = new_postings(event_runs(spark, sf), sinks.read_master(spark, out))
        sinks.append_master(new, out)
        return sinks.read_master(spark, out).select("month", "link", "provider", "scraped_at")

    @c.add(
        "dashboard_files",
        f"""SELECT sheet, link, title, provider, cast(length(description) % 60 AS INTEGER) AS relevance_score FROM (
              SELECT *, 'ALL_JOBS' AS sheet FROM ({POSTINGS}) UNION ALL SELECT *, substr(upper(provider), 1, 30) FROM ({POSTINGS}))""",
    )
    def dashboard_files(spark, sf):
        out = shared_dir(spark)
        sinks.write_dashboard(run_rows(spark, sf), out)
        shown = ["link", "title", "provider", "relevance_score"]
        everything = spark.read.parquet(f"{out}/ALL_JOBS").select(F.lit("ALL_JOBS").alias("sheet"), *shown)
        return everything.unionByName(spark.read.parquet(f"{out}/sheets").select("sheet", *shown))

    reported = f"SELECT *, length(description) % 60 AS relevance_score, title AS matching_skills FROM ({POSTINGS})"

    @c.add(
        "markdown_file",
        f"""SELECT unnest(string_split(substr(section, 1, length(section) - 1), chr(10))) AS line
            FROM ({markdown_sql(reported)})""",
    )
    def markdown_file(spark, sf):
        """Every line of the report."""
        out = shared_dir(spark)
        sinks.write_markdown(
            run_rows(spark, sf).withColumn("matching_skills", F.col("title")), out, date=F.lit(REPORT_DATE)
        )
        return spark.read.text(out).select(F.col("value").alias("line"))

    @c.add(
        "maintenance",
        f"""SELECT (SELECT count(*) FROM ({MASTER_SQL})) AS new_rows,
              (SELECT count(*) FROM ({MASTER_SQL}) WHERE ts < TIMESTAMP '{NOW}' - INTERVAL 7 DAY) AS archived,
              (SELECT concat(strftime(min(ts), '%Y%m'), '_', strftime(max(ts), '%Y%m'), '_archived_jobs') FROM ({MASTER_SQL})
               WHERE ts < TIMESTAMP '{NOW}' - INTERVAL 7 DAY) AS archive_name,
              (SELECT count(DISTINCT run_id) FROM ({EVENT_RUNS}) WHERE strptime(run_id, '%Y%m%d') < TIMESTAMP '{NOW}' - INTERVAL 3 DAY)
                AS expired_runs""",
    )
    def maintenance(spark, sf):
        out = shared_dir(spark)
        done = maintain(
            spark, event_runs(spark, sf), f"{out}/master", f"{out}/master_next", f"{out}/history", f"{out}/dashboard",
            F.lit(NOW + "+00:00").cast("timestamp"), retention_days=7, run_retention_days=3,
        )
        return done.expired.agg(F.count(F.lit(1)).alias("expired_runs")).select(
            F.lit(done.new_rows).cast("long").alias("new_rows"), F.lit(done.archived).cast("long").alias("archived"),
            F.lit(done.archive_name).alias("archive_name"), "expired_runs",
        )

    @c.add("maintained_tables", f"""
        SELECT CASE WHEN ts < TIMESTAMP '{NOW}' - INTERVAL 7 DAY THEN 'archive' ELSE 'active' END AS part, link, provider,
               strftime(ts, '%Y-%m-%dT%H:%M:%S+00:00') AS scraped_at FROM ({MASTER_SQL})""")
    def maintained_tables(spark, sf):
        """Where a rotation leaves every posting."""
        out = shared_dir(spark)
        done = maintain(
            spark, event_runs(spark, sf), f"{out}/master", f"{out}/master_next", f"{out}/history", f"{out}/dashboard",
            F.lit(NOW + "+00:00").cast("timestamp"), retention_days=7, run_retention_days=3,
        )
        active = sinks.read_master(spark, f"{out}/master_next" if done.archive_name else f"{out}/master")
        shown = active.select(F.lit("active").alias("part"), "link", "provider", "scraped_at")
        if done.archive_name:
            for part, name in (("archive", done.archive_name), ("quarantine", f"{done.archive_name}_quarantine")):
                moved = spark.read.parquet(f"{out}/history/{name}")
                shown = shown.union(moved.select(F.lit(part).alias("part"), "link", "provider", "scraped_at"))
        return shown

    @c.add("stream_sync", FIRST_OF_LINKS)
    def stream_sync(spark, sf):
        """Run files arrive as a stream, the later days after a restart; every master column is compared."""
        out = shared_dir(spark)
        rows = event_runs(spark, sf)
        for days in (F.col("run_id") < STREAM_CUT, F.col("run_id") >= STREAM_CUT):
            shown = [x for x in ["run_id", "seq", *RUN_FIELDS] if x in rows.columns]
            rows.where(days).select(*shown).write.mode("append").partitionBy("run_id").json(f"{out}/runs")
            stream = read_run_stream(spark, f"{out}/runs")
            start_keyed_sync(stream, f"{out}/master", f"{out}/checkpoint", available_now=True).awaitTermination()
        return whole_master(sinks.read_master(spark, f"{out}/master"))

    @c.add("rotation_months", f"""
        SELECT CASE WHEN ts < TIMESTAMP '{NOW}' - INTERVAL 7 DAY THEN 'archive' ELSE 'active' END AS part, link, provider,
               strftime(ts, '%Y-%m-%dT%H:%M:%S+00:00') AS scraped_at FROM ({MASTER_SQL})""")
    def rotation_months(spark, sf):
        """Two rotations in place, three days apart: what is archived, and what readers of the master still see."""
        out = shared_dir(spark)
        sinks.append_master(new_postings(event_runs(spark, sf), sinks.read_master(spark, f"{out}/master")), f"{out}/master")
        now = F.lit(NOW + "+00:00").cast("timestamp")
        for at in (days_before(now, 3), now):
            rotate_in_place(spark, f"{out}/master", f"{out}/history", at, retention_days=7)
        shown = ["link", "provider", "scraped_at"]
        parts = [read_active(spark, f"{out}/master", f"{out}/history").select(F.lit("active").alias("part"), *shown)]
        parts += [spark.read.parquet(f).select(F.lit("archive").alias("part"), *shown) for f in archives(spark, f"{out}/history")]
        return reduce(DataFrame.unionAll, parts)
