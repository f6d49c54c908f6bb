"""Links and text rules over the captured pages, parts, customers and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from stellwerk import fixed
from stellwerk.catalog import Catalog
from stellwerk.catalog.base import quoted, table
from stellwerk.functions import cleanup, links, types
from stellwerk.operators.cards import is_blocked
from stellwerk.sources.runs import manual_postings

KEYS = [p[0] for p in fixed.PROVIDERS]
PATTERNS = [p[2] for p in fixed.PROVIDERS]
HOSTS = PATTERNS + ["example.net"]

#: Page URLs moved to the portals' domains, and the hrefs portals use in their cards.
PORTAL_URLS = f"""
SELECT page_id, replace(replace(url, 'example.com', host), 'example.org', upper(host)) AS url FROM (
  SELECT page_id, url, ([{', '.join(quoted(h) for h in HOSTS)}])[page_id % {len(HOSTS)} + 1] AS host FROM pages)
"""
PROVIDER_SQL = "CASE " + " ".join(
    f"WHEN contains(lower(url), {quoted(p)}) THEN {quoted(k)}" for k, p in zip(KEYS, PATTERNS)
)
HREFS = f"""
SELECT page_id, provider,
       CASE page_id % 5 WHEN 0 THEN url WHEN 1 THEN concat('/jobs/view/', slug, '?ref=', page_id)
            WHEN 2 THEN concat('/projekte/projekt-', page_id, '-', slug) WHEN 3 THEN concat('/job/', page_id, '/', slug, '/')
            ELSE concat('stelle-', slug, '-', page_id, '/') END AS href
FROM (SELECT page_id, url, split_part(url, '/', 3) AS slug,
             ([{', '.join(quoted(k) for k in KEYS)}])[page_id % 8 + 1] AS provider FROM pages)
"""
LINK_SQL = """
CASE WHEN provider = 'linkedin' THEN split_part(href, '?', 1)
     WHEN provider IN ('hays', 'xing', 'gulp', 'freelance_de') THEN CASE WHEN starts_with(href, 'http') THEN href ELSE concat(domain, href) END
     WHEN provider IN ('solcom', 'freelancermap') THEN CASE WHEN starts_with(href, '/') THEN concat(domain, href) ELSE href END
     ELSE concat(domain, href) END
"""
DOMAIN_SQL = "CASE provider " + " ".join(f"WHEN {quoted(k)} THEN {quoted(v)}" for k, v in fixed.DOMAINS.items()) + " ELSE '' END"
LINKED = f"SELECT *, {LINK_SQL} AS link FROM (SELECT *, {DOMAIN_SQL} AS domain FROM ({HREFS}))"
JOB_ID_SQL = """
CASE WHEN provider = 'linkedin' THEN CASE WHEN contains(href, 'jobs/view/') THEN split_part(split_part(href, '/', -1), '?', 1) ELSE href END
     WHEN provider = 'hays' THEN CASE WHEN contains(link, '/job/') THEN split_part(link, '/', -2)
                                      ELSE replace(split_part(link, '-', -1), '/', '') END
     WHEN provider = 'xing' THEN split_part(split_part(href, '/', -1), '?', 1)
     WHEN provider = 'freelance_de' THEN split_part(replace(split_part(href, '/', -1), 'projekt-', ''), '-', 1)
     ELSE split_part(href, '/', -1) END
"""


def portal_urls(spark, sf):
    host = F.element_at(F.lit(HOSTS), (F.col("page_id") % len(HOSTS) + 1).cast("int"))
    url = F.replace(F.replace("url", F.lit("example.com"), host), F.lit("example.org"), F.upper(host))
    return table(spark, sf, "pages").select("page_id", url.alias("url"))


def hrefs(spark, sf):
    i, slug = F.col("page_id"), F.split_part("url", F.lit("/"), F.lit(3))
    href = (
        F.when(i % 5 == 0, F.col("url"))
        .when(i % 5 == 1, F.concat(F.lit("/jobs/view/"), slug, F.lit("?ref="), i))
        .when(i % 5 == 2, F.concat(F.lit("/projekte/projekt-"), i, F.lit("-"), slug))
        .when(i % 5 == 3, F.concat(F.lit("/job/"), i, F.lit("/"), slug, F.lit("/")))
        .otherwise(F.concat(F.lit("stelle-"), slug, F.lit("-"), i, F.lit("/")))
    )
    provider = F.element_at(F.lit(KEYS), (i % 8 + 1).cast("int"))
    return table(spark, sf, "pages").select("page_id", provider.alias("provider"), href.alias("href"))


def words_sql(col: str, words) -> str:
    return "(" + " OR ".join(f"contains({col}, {quoted(w)})" for w in words) + ")"


PART_TEXT = """SELECT p_partkey, concat(p_name, CASE p_size % 9 WHEN 0 THEN ' Remote' WHEN 1 THEN ' Home-Office, befristet'
    WHEN 2 THEN ' hybrid Praktikant' WHEN 3 THEN ' flexibel, Freelance project' WHEN 4 THEN ' Automobil Werkstudent'
    WHEN 5 THEN ' international' ELSE '' END, ' ', p_type) AS text FROM part"""


def part_text(spark, sf):
    s = F.col("p_size") % 9
    tail = (
        F.when(s == 0, " Remote").when(s == 1, " Home-Office, befristet").when(s == 2, " hybrid Praktikant")
        .when(s == 3, " flexibel, Freelance project").when(s == 4, " Automobil Werkstudent")
        .when(s == 5, " international").otherwise("")
    )
    return table(spark, sf, "part").select("p_partkey", F.concat("p_name", tail, F.lit(" "), "p_type").alias("text"))


CODES = ["Vollzeit", "Full time", "Freiberuflich", "Teilzeit", "Freiberuflich / Vollzeit"]
PLACES = ["Remote", "Mobiles Arbeiten", "Vor Ort", "Hybrid"]
DIRTY = "concat(' ', p_name, ' Firmenname ', p_brand, ' - freelance.de', chr(173), ', Premiumaccount Location: Online seit: ', p_type, '  ')"


def register(c: Catalog) -> None:
    @c.add(
        "provider_from_url",
        f"SELECT page_id, url, {PROVIDER_SQL} END AS provider, {PROVIDER_SQL} ELSE 'linkedin' END AS manual_provider FROM ({PORTAL_URLS})",
    )
    def provider_from_url(spark, sf):
        url = F.col("url")
        return portal_urls(spark, sf).withColumns(
            {"provider": links.provider_from_url(url), "manual_provider": links.provider_from_url(url, "linkedin")}
        )

    @c.add("canonical_link", f"SELECT page_id, provider, href, link FROM ({LINKED})")
    def canonical_link(spark, sf):
        return hrefs(spark, sf).withColumn("link", links.canonical_link(F.col("provider"), F.col("href")))

    @c.add("job_id_from_href", f"SELECT page_id, provider, href, {JOB_ID_SQL} AS job_id FROM ({LINKED})")
    def job_id_from_href(spark, sf):
        return hrefs(spark, sf).withColumn("job_id", links.job_id_from_href(F.col("provider"), F.col("href")))

    @c.add("offer_id_from_url", f"SELECT page_id, nullif(regexp_extract(href, '/job/(\\d+)/', 1), '') AS offer_id FROM ({HREFS})")
    def offer_id_from_url(spark, sf):
        return hrefs(spark, sf).select("page_id", links.offer_id_from_url(F.col("href")).alias("offer_id"))

    @c.add(
        "manual_links",
        f"""SELECT page_id AS seq, cast(page_id AS STRING) AS job_id, {PROVIDER_SQL} ELSE 'linkedin' END AS provider, url AS link,
            {', '.join(f'{quoted(v)} AS {k}' for k, v in fixed.MANUAL_TEMPLATE.items())},
            'Manual | links.csv' AS search_criteria, 0 AS relevance_score, '2024-01-31T00:00:00+00:00' AS scraped_at
            FROM ({PORTAL_URLS}) WHERE NOT contains(url, '#top')""",
    )
    def manual_links(spark, sf):
        """Pages with an anchor stand for rows with a blank link."""
        url = F.when(~F.contains("url", F.lit("#top")), F.col("url")).otherwise("")
        rows = portal_urls(spark, sf).select(F.col("page_id").alias("seq"), url.alias("link"))
        return manual_postings(rows, F.lit("links.csv"), F.lit("2024-01-31T00:00:00+00:00"))

    @c.add(
        "job_types",
        f"""SELECT p_partkey,
            CASE WHEN {words_sql('lower(text)', fixed.TEXT_REMOTE_WORDS)} THEN 'Remote'
                 WHEN {words_sql('lower(text)', fixed.TEXT_HYBRID_WORDS)} THEN 'Hybrid' ELSE 'On-site' END AS work_location_type,
            CASE WHEN {words_sql('lower(text)', fixed.TEXT_CONTRACT_WORDS)} THEN 'Contract'
                 WHEN {words_sql('lower(text)', fixed.TEXT_INTERN_WORDS)} THEN 'Internship' ELSE 'Full-time' END AS employment_type
            FROM ({PART_TEXT})""",
    )
    def job_types(spark, sf):
        return part_text(spark, sf).select(
            "p_partkey",
            types.work_type_from_text(F.col("text")).alias("work_location_type"),
            types.employment_type_from_text(F.col("text")).alias("employment_type"),
        )

    provider_of = f"([{', '.join(quoted(k) for k in KEYS)}])[p_partkey % 8 + 1]"

    @c.add(
        "portal_work_type",
        f"""SELECT p_partkey, CASE
              WHEN provider = 'hays' AND {words_sql("lower(concat(text, p_brand))", fixed.HAYS_REMOTE_WORDS)} THEN 'Remote'
              WHEN provider = 'solcom' AND contains(lower(text), 'remote') THEN 'Remote'
              WHEN provider = 'gulp' AND (flag OR contains(place, 'Remote')) THEN 'Remote'
              WHEN provider = 'freelance_de' AND (flag OR contains(lower(place), 'remote')) THEN 'Remote'
              WHEN provider IN ('linkedin', 'ferchau') AND flag THEN 'Remote'
              ELSE 'On-site' END AS work_location_type
            FROM (SELECT t.p_partkey, t.text, p_brand, {provider_of.replace('p_partkey', 't.p_partkey')} AS provider, p_size > 40 AS flag, t.text AS place
                  FROM ({PART_TEXT}) t JOIN part ON part.p_partkey = t.p_partkey)""",
    )
    def portal_work_type(spark, sf):
        provider = F.element_at(F.lit(KEYS), (F.col("p_partkey") % 8 + 1).cast("int"))
        rows = part_text(spark, sf).join(table(spark, sf, "part").select("p_partkey", "p_size", "p_brand"), "p_partkey")
        title = F.col("text")
        location = F.when(provider == "hays", F.col("p_brand")).otherwise(F.col("text"))
        value = types.portal_work_type(provider, title, location, F.col("p_size") > 40)
        return rows.select("p_partkey", value.alias("work_location_type"))

    code_sql = f"([{', '.join(quoted(x) for x in CODES)}])[o_orderkey % {len(CODES) + 1} + 1]"
    place_sql = f"([{', '.join(quoted(x) for x in PLACES)}])[o_custkey % {len(PLACES) + 1} + 1]"

    @c.add(
        "employment_codes",
        f"""SELECT o_orderkey,
              CASE WHEN contains(code, 'Freiberuflich') THEN 'Freelance'
                   WHEN contains(code, 'Vollzeit') OR contains(code, 'Full') THEN 'Full-time' ELSE code END AS employment_type,
              CASE WHEN contains(place, 'Remote') OR contains(place, 'Mobil') THEN 'Remote' ELSE place END AS work_location_type
            FROM (SELECT o_orderkey, coalesce({code_sql}, 'Full-time') AS code, coalesce({place_sql}, 'Hybrid') AS place FROM orders)""",
    )
    def employment_codes(spark, sf):
        """One value of each list is missing, as a portal's field may be."""
        pick = lambda values, key: F.get(F.lit(values), (F.col(key) % (len(values) + 1)).cast("int"))
        return table(spark, sf, "orders").select(
            "o_orderkey",
            types.employment_from_code(pick(CODES, "o_orderkey")).alias("employment_type"),
            types.work_type_from_code(pick(PLACES, "o_custkey")).alias("work_location_type"),
        )

    @c.add(
        "text_cleanup",
        f"""SELECT p_partkey, trim(replace(v, chr(173), '')) AS offer_title, trim(split_part(v, 'Firmenname', 1)) AS project_title,
              trim(split_part(replace(v, ' - freelance.de', ''), 'Firmenname', 1)) AS heading,
              trim(split_part(v, 'Premiumaccount', 1)) AS premium_location, trim(replace(v, ',', '')) AS city,
              trim(replace(v, 'Location:', '')) AS label_free
            FROM (SELECT p_partkey, {DIRTY} AS v FROM part)""",
    )
    def text_cleanup(spark, sf):
        v = F.concat(
            F.lit(" "), "p_name", F.lit(" Firmenname "), "p_brand", F.lit(" - freelance.de\u00ad, Premiumaccount Location: Online seit: "),
            "p_type", F.lit("  "),
        )
        return table(spark, sf, "part").select(
            "p_partkey",
            cleanup.clean_offer_title(v).alias("offer_title"),
            cleanup.clean_project_title(v).alias("project_title"),
            cleanup.clean_project_heading(v).alias("heading"),
            cleanup.clean_premium_location(v).alias("premium_location"),
            cleanup.clean_city(v).alias("city"),
            cleanup.without_label(v, "Location:").alias("label_free"),
        )

    def fill_sql(field: str) -> str:
        cases = " ".join(f"WHEN {quoted(k)} THEN {quoted(d[field])}" for k, d in fixed.CARD_DEFAULTS.items() if field in d)
        return f"coalesce(v, CASE provider {cases} END, '')"

    @c.add(
        "default_fill",
        f"""SELECT p_partkey, {fill_sql('company')} AS company, {fill_sql('location')} AS location,
              coalesce(v, 'Recent') AS posted_at_relative
            FROM (SELECT p_partkey, {provider_of} AS provider, CASE WHEN p_size > 25 THEN p_name END AS v FROM part)""",
    )
    def default_fill(spark, sf):
        provider = F.element_at(F.lit(KEYS), (F.col("p_partkey") % 8 + 1).cast("int"))
        v = F.when(F.col("p_size") > 25, F.col("p_name"))
        fields = ("company", "location", "posted_at_relative")
        return table(spark, sf, "part").select(
            "p_partkey", *[cleanup.default_fill(provider, f, v).alias(f) for f in fields]
        )

    blocked = words_sql("html", fixed.BLOCK_PHRASES)
    page = "SELECT page_id, CASE page_id % 4 WHEN 1 THEN replace(html, '<footer>', '<footer>Kundeninformation ') WHEN 2 THEN replace(html, '<title>', '<title>Customer Information: ') ELSE html END AS html FROM pages"

    @c.add("blocked_pages", f"SELECT page_id FROM ({page}) WHERE {blocked}")
    def blocked_pages(spark, sf):
        i = F.col("page_id") % 4
        html = (
            F.when(i == 1, F.replace("html", F.lit("<footer>"), F.lit("<footer>Kundeninformation ")))
            .when(i == 2, F.replace("html", F.lit("<title>"), F.lit("<title>Customer Information: ")))
            .otherwise(F.col("html"))
        )
        return table(spark, sf, "pages").where(is_blocked(html)).select("page_id")
