"""A whole search run over captured pages: cards, unique postings, details, two passes, filter, written results."""

from __future__ import annotations

from pyspark.sql import functions as F

from stellwerk import fixed
from stellwerk.catalog import Catalog
from stellwerk.catalog.base import REMOTE_SQL, SALARY_SQL, TEXT_SQL, enriched_sql, matching
from stellwerk.catalog.portals import CARDS, DETAILS, detail_pages, expected_cards, expected_details, render, source
from stellwerk.catalog.reports import first_sql
from stellwerk.operators.cards import extract_cards
from stellwerk.operators.details import extract_details
from stellwerk.plans.search_run import RunSettings, run_search
from stellwerk.schema import DETAIL_FIELDS
from stellwerk.session import shared_dir
from stellwerk.sources import runs, sinks

PORTAL = "hays"
SETTINGS = RunSettings(
    min_relevance_score=0, exclude_keywords=("src7 ",), fetch_full_description=True, formats=("csv", "json", "markdown")
)

CARDS_SQL = f"SELECT *, '{PORTAL}' AS provider FROM ({expected_cards(CARDS[PORTAL][1])})"
UNIQUE_SQL = first_sql(CARDS_SQL, "coalesce(nullif(job_id, ''), link)", "doc_id, pos")
FIRST_SQL = f"""
SELECT * EXCLUDE (txt, work_location_type), {SALARY_SQL} AS salary_hint,
       CASE WHEN {REMOTE_SQL} THEN 'Remote' WHEN contains(txt, 'hybrid') THEN 'Hybrid' ELSE work_location_type END AS work_location_type
FROM (SELECT *, {TEXT_SQL} AS txt FROM ({UNIQUE_SQL}))
"""
#: Every card's link leads to its document's detail page, captured twice.
MERGED_SQL = f"""
SELECT p.* EXCLUDE ({', '.join(DETAIL_FIELDS)}), {', '.join(f'coalesce(d.{f}, p.{f}) AS {f}' for f in DETAIL_FIELDS)}
FROM ({FIRST_SQL}) p LEFT JOIN (
  SELECT c.link, d.* EXCLUDE (doc_id) FROM ({CARDS_SQL}) c JOIN ({expected_details(DETAILS[PORTAL])}) d USING (doc_id)
  QUALIFY row_number() OVER (PARTITION BY c.link ORDER BY doc_id) = 1
) d ON p.link = d.link
"""
SHOWN = [h for h in fixed.HEADERS if h != "scraped_at"]


def collected(spark, sf):
    """Postings from rendered result pages, and rendered detail pages by link, each captured twice."""
    pages = source(spark, sf).withColumns({"html": render(CARDS[PORTAL][0]), "provider": F.lit(PORTAL)})
    cards = extract_cards(pages.select("doc_id", "provider", "query", "location", "result_limit", "html"))
    cards = runs.with_arrival_order(cards, "doc_id", "pos")
    links = cards.select("doc_id", F.col("link").alias("card_link")).distinct()
    details = detail_pages(spark, sf, PORTAL).join(links, "doc_id").withColumn("link", F.col("card_link"))
    captures = details.withColumn("capture", F.explode(F.array(F.lit(0), F.lit(1))))
    return cards, extract_details(captures)


def register(c: Catalog) -> None:
    @c.add(
        "search_run_pages",
        f"""SELECT {', '.join(f"coalesce(cast({h} AS STRING), '') AS {h}" for h in SHOWN)}
            FROM ({enriched_sql(MERGED_SQL)})
            WHERE relevance_score >= {SETTINGS.min_relevance_score} AND NOT contains(lower(title), 'src7 ')""",
    )
    def search_run_pages(spark, sf):
        """The filtered export as it is read back; the time of the run is left out."""
        out = shared_dir(spark)
        cards, details = collected(spark, sf)
        run_search(cards, matching(), out, details, SETTINGS)
        rows = spark.read.options(**sinks.CSV_OPTIONS).option("multiLine", True).csv(f"{out}/{SETTINGS.base_filename}.csv")
        return rows.select(*[F.coalesce(h, F.lit("")).alias(h) for h in SHOWN])
