"""Deduplication, filters, ranking and reports over the documents."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from stellwerk import fixed
from stellwerk.catalog import Catalog
from stellwerk.catalog.base import DEDUP_SQL, POSTINGS, postings, quoted, table
from stellwerk.operators import dedup, filters, rank, sync
from stellwerk.plans.row_filters import first_matching

#: Postings with a score taken from the text length, so that reports have ties to break.
SCORED = f"SELECT *, cast(length(description) % 60 AS INTEGER) AS relevance_score, title AS matching_skills FROM ({POSTINGS})"


def scored(spark, sf):
    return postings(spark, sf).withColumns(
        {"relevance_score": (F.length("description") % 60).cast("int"), "matching_skills": F.col("title")}
    )


def any_contains(text: str, words) -> str:
    return "(" + " OR ".join(f"contains({text}, {quoted(w.lower())})" for w in words) + ")"


def first_sql(source: str, key: str, order: str, where: str = "TRUE") -> str:
    return f"""SELECT * EXCLUDE (rn) FROM (
        SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY {order}) AS rn FROM ({source}) WHERE {where}
    ) WHERE rn = 1"""


REPORT_DATE = "2025-01-31"


def markdown_sql(source: str) -> str:
    return f"""
    SELECT 0 AS rank, concat('# Job Search Results ({REPORT_DATE})', chr(10), chr(10), 'Total processed: ', count(*), chr(10), chr(10)) AS section
    FROM ({source})
    UNION ALL
    SELECT rank, concat('### ', rank, '. ', title, ' (**', relevance_score, '%**)', chr(10), '- **Provider:** ', provider,
           ' | **Location:** ', location, chr(10), '- **Matching Skills:** ', matching_skills, chr(10),
           '- **Link:** [View Posting](', link, ')', chr(10), chr(10), '---', chr(10)) AS section
    FROM (SELECT *, row_number() OVER (ORDER BY relevance_score DESC, seq) AS rank FROM ({source}))
    """


KEPT = "seq, job_id, provider, link, title, company"
KEPT_COLUMNS = KEPT.split(", ")
PART_ROWS = "SELECT p_partkey AS seq, p_brand AS link, p_name AS title, p_type AS company, cast(p_size AS STRING) AS location FROM part"


def parts(spark, sf):
    """Parts as short rows: many share a link."""
    return table(spark, sf, "part").select(
        F.col("p_partkey").alias("seq"),
        F.col("p_brand").alias("link"),
        F.col("p_name").alias("title"),
        F.col("p_type").alias("company"),
        F.col("p_size").cast("string").alias("location"),
    )


def register(c: Catalog) -> None:
    @c.add("dedup_in_run", f"SELECT {KEPT} FROM ({DEDUP_SQL})")
    def dedup_in_run(spark, sf):
        return dedup.dedup_in_run(postings(spark, sf).select(*KEPT_COLUMNS))

    @c.add(
        "dedup_per_provider",
        f"SELECT {KEPT} FROM ({first_sql(POSTINGS, 'provider, coalesce(nullif(job_id, {}), link)'.format(quoted('')), 'seq')})",
    )
    def dedup_per_provider(spark, sf):
        return dedup.dedup_in_run(postings(spark, sf).select(*KEPT_COLUMNS), per_provider=True)

    # Postings with neither id nor link are one posting; every ninth loses both here.
    @c.add(
        "dedup_count",
        f"""SELECT count(*) AS unique_postings FROM (
              SELECT DISTINCT CASE WHEN seq % 9 <> 0 THEN coalesce(nullif(job_id, ''), link) END AS k FROM ({POSTINGS}))""",
    )
    def dedup_count(spark, sf):
        keep = F.col("seq") % 9 != 0
        lost = {k: F.when(keep, F.col(k)) for k in ("job_id", "link")}
        return dedup.count_unique(postings(spark, sf).select(*KEPT_COLUMNS).withColumns(lost))

    @c.add("dedup_cross_run", f"SELECT run_id, {KEPT} FROM ({first_sql(POSTINGS, 'link', 'run_id, seq')})")
    def dedup_cross_run(spark, sf):
        return dedup.dedup_by_link(postings(spark, sf).select("run_id", *KEPT_COLUMNS))

    title_sql = any_contains("lower(title)", fixed.TITLE_WORDS)

    @c.add(
        "filter_then_dedup",
        f"SELECT run_id, {KEPT} FROM ({first_sql(POSTINGS, 'link', 'run_id, seq', title_sql)})",
    )
    def filter_then_dedup(spark, sf):
        rows = postings(spark, sf).select("run_id", *KEPT_COLUMNS)
        return first_matching(rows, filters.title_includes(), ["run_id", "seq"])

    @c.add("title_filter", f"SELECT seq, title FROM ({POSTINGS}) WHERE {title_sql}")
    def title_filter(spark, sf):
        return postings(spark, sf).where(filters.title_includes()).select("seq", "title")

    @c.add(
        "any_column_filter",
        f"""SELECT * FROM ({PART_ROWS})
            WHERE {any_contains("lower(concat_ws(' ', title, company, location, link))", ['red widget', 'economy 11', '7 brand'])}""",
    )
    def any_column_filter(spark, sf):
        words = ["red widget", "economy 11", "7 brand"]
        return parts(spark, sf).where(filters.any_column_includes(["title", "company", "location", "link"], words))

    @c.add(
        "city_rows",
        f"""SELECT * FROM ({first_sql(PART_ROWS, 'link', 'seq', any_contains("lower(concat_ws(' ', title, link))", ['ring', 'gear']))})""",
    )
    def city_rows(spark, sf):
        return first_matching(parts(spark, sf), filters.any_column_includes(["title", "link"], ["ring", "gear"]), ["seq"])

    @c.add(
        "title_exclude",
        f"SELECT seq, title FROM ({POSTINGS}) WHERE NOT {any_contains('lower(title)', ['junior', 'INTERN'])}",
    )
    def title_exclude(spark, sf):
        return postings(spark, sf).where(filters.title_excludes(["junior", "INTERN"])).select("seq", "title")

    @c.add("min_score", f"SELECT seq, relevance_score FROM ({SCORED}) WHERE relevance_score >= 25")
    def min_score(spark, sf):
        return scored(spark, sf).where(filters.min_score(25)).select("seq", "relevance_score")

    @c.add(
        "filter_ranked",
        f"""SELECT seq, title, relevance_score FROM ({SCORED})
            WHERE relevance_score >= 20 AND NOT {any_contains('lower(title)', ['senior'])} ORDER BY relevance_score DESC, seq""",
    )
    def filter_ranked(spark, sf):
        kept = filters.filter_ranked(scored(spark, sf), 20, ["Senior"])
        return rank.rank_by_score(kept.select("seq", "title", "relevance_score"))

    @c.add(
        "non_empty_link",
        f"SELECT seq, link FROM (SELECT seq, CASE WHEN location = 'en' THEN '' WHEN location = 'de' THEN NULL ELSE link END "
        f"AS link FROM ({POSTINGS})) WHERE coalesce(link, '') <> ''",
    )
    def non_empty_link(spark, sf):
        link = F.when(F.col("location") == "en", "").when(F.col("location") != "de", F.col("link"))
        return postings(spark, sf).select("seq", link.alias("link")).where(filters.has_link())

    @c.add(
        "declared_filters",
        f"""SELECT seq FROM ({POSTINGS})
            WHERE contains(lower(concat_ws(' ', title, company, description, location)), 'en')
              AND NOT contains(lower(company), 'src3') AND work_location_type IN ('On-site', 'Hybrid')
              AND employment_type IN ('Freelance', 'Contract', 'Internship') AND employment_type NOT IN ('Internship')""",
    )
    def declared_filters(spark, sf):
        keep = filters.requires_keywords(["EN"]) & filters.excludes_companies(["SRC3"])
        keep = keep & filters.work_preferences(["On-site", "Hybrid"], ["Freelance", "Contract", "Internship"], ["Internship"])
        return postings(spark, sf).where(keep).select("seq")

    @c.add(
        "scraped_within",
        "SELECT event_id, event_type FROM events WHERE ts >= TIMESTAMP '2024-01-30 00:00:00' - INTERVAL 7 DAY",
    )
    def scraped_within(spark, sf):
        now = F.lit("2024-01-30 00:00:00").cast("timestamp_ntz")
        events = table(spark, sf, "events")
        return events.where(filters.scraped_within(7, now, F.col("ts"))).select("event_id", "event_type")

    @c.add("rank_by_score", f"SELECT seq, relevance_score FROM ({SCORED}) ORDER BY relevance_score DESC, seq")
    def rank_by_score(spark, sf):
        return rank.rank_by_score(scored(spark, sf).select("seq", "relevance_score"))

    @c.add(
        "report_numbers",
        f"SELECT seq, row_number() OVER (ORDER BY relevance_score DESC, seq) AS rank FROM ({SCORED})",
    )
    def report_numbers(spark, sf):
        return rank.number_rows(scored(spark, sf).select("seq", "relevance_score"), block=100).select("seq", "rank")

    @c.add(
        "top_report",
        f"""SELECT cast(rank AS INTEGER) AS rank, title, relevance_score,
                   concat(rank, '. ', title, ' (', relevance_score, '%)', chr(10), '   Posted: Recent', chr(10), '   ', link, chr(10)) AS line
            FROM (SELECT *, row_number() OVER (ORDER BY relevance_score DESC, seq) AS rank FROM ({SCORED})) WHERE rank <= 5""",
    )
    def top_report(spark, sf):
        return rank.top_report(scored(spark, sf))

    @c.add(
        "top_rows",
        f"SELECT seq, title, relevance_score FROM ({SCORED}) ORDER BY relevance_score DESC, seq LIMIT 20",
    )
    def top_rows(spark, sf):
        return rank.top_rows(scored(spark, sf).select("seq", "title", "relevance_score"), 20)

    @c.add("markdown_lines", markdown_sql(SCORED))
    def markdown_lines(spark, sf):
        columns = ["seq", "title", "relevance_score", "provider", "location", "matching_skills", "link"]
        return rank.markdown_report(scored(spark, sf).select(*columns), date=F.lit(REPORT_DATE))

    @c.add(
        "per_search_limit",
        """SELECT event_id, provider, query, location FROM (
             SELECT event_id, event_type AS provider, props AS query, cast(user_id AS STRING) AS location,
                    row_number() OVER (PARTITION BY event_type, props, user_id ORDER BY event_id) AS rn,
                    CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 3 ELSE 2 END AS lim
             FROM events) WHERE rn <= lim""",
    )
    def per_search_limit(spark, sf):
        rows = table(spark, sf, "events").select(
            "event_id",
            F.col("event_type").alias("provider"),
            F.col("props").alias("query"),
            F.col("user_id").cast("string").alias("location"),
        )
        limit = F.when(F.col("provider") == "click", 1).when(F.col("provider") == "view", 3).otherwise(2)
        return rank.per_search_limit(rows, limit, most=3, pos="event_id")

    @c.add(
        "per_search_limit_open",
        """SELECT event_id, provider, query, location FROM (
             SELECT event_id, event_type AS provider, props AS query, cast(user_id AS STRING) AS location,
                    row_number() OVER (PARTITION BY event_type, props, user_id ORDER BY event_id) AS rn,
                    CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 300 END AS lim
             FROM events) WHERE lim IS NULL OR rn <= lim""",
    )
    def per_search_limit_open(spark, sf):
        """Limits per row that no constant bounds: missing for most portals, large for one."""
        rows = table(spark, sf, "events").select(
            "event_id",
            F.col("event_type").alias("provider"),
            F.col("props").alias("query"),
            F.col("user_id").cast("string").alias("location"),
        )
        limit = F.when(F.col("provider") == "click", 1).when(F.col("provider") == "view", 300)
        return rank.per_search_limit(rows, limit, pos="event_id")

    @c.add(
        "dashboard",
        f"""SELECT seq, provider, link, relevance_score, substr(upper(provider), 1, 30) AS sheet FROM ({SCORED})
            ORDER BY sheet, relevance_score DESC, link""",
    )
    def dashboard(spark, sf):
        return rank.dashboard(scored(spark, sf).select("seq", "provider", "link", "relevance_score"))

    @c.add("provider_list", "SELECT DISTINCT event_type AS provider FROM events")
    def provider_list(spark, sf):
        return sync.provider_list(table(spark, sf, "events").select(F.col("event_type").alias("provider")))

    headers = {
        "relevance_score": "cast(relevance_score AS STRING)", "search_criteria": "search_criteria", "provider": "provider",
        "title": "title", "company": "company", "location": "location", "work_location_type": "work_location_type",
        "employment_type": "employment_type", "matching_skills": "matching_skills", "posted_at_relative": "posted_at_relative",
        "link": "link",
    }

    @c.add(
        "canonical_projection",
        "SELECT " + ", ".join(f"{headers.get(h, quoted(''))} AS {h}" for h in fixed.HEADERS) + f" FROM ({SCORED})",
    )
    def canonical_projection(spark, sf):
        return rank.canonical(scored(spark, sf))

    union_sql = f"""
      SELECT seq, provider, title, description, NULL::STRING AS location FROM ({POSTINGS}) WHERE provider = 'hays'
      UNION ALL SELECT seq, provider, title, NULL, location FROM ({POSTINGS}) WHERE provider <> 'hays'"""

    @c.add("provider_union", union_sql)
    def provider_union(spark, sf):
        p = postings(spark, sf)
        parts_ = [
            p.where(F.col("provider") == "hays").select("seq", "provider", "title", "description"),
            p.where(F.col("provider") != "hays").select("seq", "provider", "title", "location"),
        ]
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts_)

    @c.add(
        "batch_summary",
        """SELECT profile, cast(sum(n) AS BIGINT) AS postings, cast(sum(e) AS BIGINT) AS errors FROM (
             SELECT event_type AS profile, count(*) AS n, 0 AS e FROM events WHERE event_type <> 'error' GROUP BY 1
             UNION ALL SELECT DISTINCT event_type, 0, 1 FROM events WHERE event_type = 'error'
           ) GROUP BY ROLLUP (profile)""",
    )
    def batch_summary(spark, sf):
        runs = table(spark, sf, "events").select(F.col("event_type").alias("profile"))
        failed = runs.where("profile = 'error'").distinct().withColumn("error", F.lit("run failed"))
        return sync.batch_summary(runs.where("profile <> 'error'"), failed)
