"""Tables, the postings view both engines share, and a demonstration profile."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from stellwerk import fixed
from stellwerk.operators.enrich import Matching
from stellwerk.sources.config import Entry, flatten_entries, profile_from_dict


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


#: Documents as postings: ids by content, so exact copies share one; links by language and
#: length; titles and closing phrases set by rule, so that every enrichment has work.
POSTINGS = """
SELECT doc_id AS seq,
       md5(text) AS job_id,
       CASE doc_id % 8 WHEN 0 THEN 'linkedin' WHEN 1 THEN 'hays' WHEN 2 THEN 'solcom' WHEN 3 THEN 'freelancermap'
            WHEN 4 THEN 'xing' WHEN 5 THEN 'gulp' WHEN 6 THEN 'freelance_de' ELSE 'ferchau' END AS provider,
       concat('https://jobs.example.com/', lang, '/', cast(n_chars AS STRING)) AS link,
       CASE doc_id % 6 WHEN 0 THEN 'Winzer - Remote, Steillage' WHEN 1 THEN 'Intern: Beekeeping and Honey QA'
            WHEN 2 THEN concat('Gardener no. ', cast(n_chars % 10 AS STRING)) WHEN 3 THEN 'Soil Test Lab (C#), Vorarbeiter'
            WHEN 4 THEN 'International Seed Sales' ELSE concat('Junior ', upper(lang), ' Orchard Hand') END AS title,
       concat(source, CASE doc_id % 3 WHEN 0 THEN ' GmbH' ELSE ' Inc.' END) AS company,
       lang AS location,
       source AS run_id,
       concat('Engineer | ', lang) AS search_criteria,
       'On-site' AS work_location_type,
       CASE doc_id % 4 WHEN 0 THEN 'Freelance' WHEN 1 THEN 'Contract' WHEN 2 THEN 'Internship'
            ELSE 'Full-time' END AS employment_type,
       'Recent' AS posted_at_relative,
       concat(text, CASE doc_id % 10 WHEN 1 THEN ' 4-20 mA loops, hybrid. Hydroponik' WHEN 2 THEN ' Gehalt: 48.500 € plus Brix'
            WHEN 4 THEN ' Ladder Logic / .NET; NDVI' WHEN 5 THEN ' Stundensatz eur. pH, Bodenprobe'
            WHEN 7 THEN ' VERGÜTUNG $61K und Drip/Spray' WHEN 8 THEN ' Salary: €52k, crop forecast (C++)' ELSE '' END) AS description
FROM documents
"""

#: Detail pages for the labelled documents, one per link: pages may leave a field out (NULL)
#: or come back empty ('').
DETAILS = f"""
SELECT p.link,
       CASE WHEN l.quality = 1 THEN concat(p.title, ' (m/w/d)') END AS title,
       CASE WHEN l.toxic = 1 THEN 'Remote, Wien' END AS location,
       CASE WHEN l.quality = 1 THEN concat('Gehalt: 39.900 € Valve. ', p.description) ELSE '' END AS description,
       CASE WHEN l.quality = 1 AND l.toxic = 0 THEN 'Hybrid' END AS work_location_type
FROM ({POSTINGS}) p
JOIN (SELECT link, min(seq) AS seq FROM ({POSTINGS}) q JOIN labels ON labels.doc_id = q.seq GROUP BY link) w
  ON w.seq = p.seq
JOIN labels l ON l.doc_id = p.seq
"""


def postings(spark: SparkSession, sf: str) -> DataFrame:
    return spark.sql(POSTINGS.replace("FROM documents", "FROM {documents}"), documents=table(spark, sf, "documents"))


def details(spark: SparkSession, sf: str) -> DataFrame:
    """Detail rows through the library: first labelled posting per link."""
    from pyspark.sql import functions as F

    from stellwerk.operators.dedup import first_by_key

    labelled = postings(spark, sf).join(
        table(spark, sf, "labels").withColumnRenamed("doc_id", "seq"), "seq"
    )
    first = first_by_key(labelled.select("seq", "link", "title", "description", "quality", "toxic"), ["link"], ["seq"])
    good, toxic = F.col("quality") == 1, F.col("toxic") == 1
    return first.select(
        "link",
        F.when(good, F.concat(F.col("title"), F.lit(" (m/w/d)"))).alias("title"),
        F.when(toxic, F.lit("Remote, Wien")).alias("location"),
        F.when(good, F.concat(F.lit("Gehalt: 39.900 € Valve. "), F.col("description")))
        .otherwise(F.lit(""))
        .alias("description"),
        F.when(good & (F.col("toxic") == 0), F.lit("Hybrid")).alias("work_location_type"),
    )


#: A grower's lists, short: a plain token, two tokens, marks within, an umlaut, the texts that match anywhere, entries in
#: two languages with equal and with different forms, one in a list that does not score.
PROFILE = profile_from_dict(
    {
        "skills": {
            "ai_ml": ["NDVI", {"en": "Crop Forecast", "de": "Ernteprognose"}],
            "machines": ["Chainsaw"],
            "testing": ["pH", {"en": "Soil Test", "de": "Bodenprobe"}, "Drip/Spray"],
            "roles": [{"en": "Gardener", "de": "Gärtner"}, {"en": "Winegrower", "de": "Winzer"}, "Vorarbeiter"],
            "embedded": [{"en": "Hydroponics", "de": "Hydroponik"}, "4-20 mA"],
            "programming": ["C#", "Ladder Logic", "R"],
        },
        "known_companies": ["src2 gmbh", "SRC5 "],
    }
)

LEXICON = flatten_entries(
    {
        # Function words of the documents' own language stand in for frequent skills.
        "words": ["With", {"en": "For", "de": "Für"}, "Und", "Las", "Des", {"en": "Not", "de": "Nicht"}],
        "ai_ml_data": [{"en": "Crop Forecast", "de": "Ernteprognose"}, "NDVI", "Brix"],
        "embedded_hardware": ["LoRa", "4-20 mA", {"en": "Valve", "de": "Valve"}, {"en": "Hydroponics", "de": "Hydroponik"}],
        "testing_qa": ["Drip/Spray", {"en": "Soil Test", "de": "Bodenprobe"}, "pH", {"en": "Honey", "de": "Honig"}],
        "programming_languages": ["Ladder Logic", "C++", "R", ".NET", "C", "C#"],
        "roles_and_seniority": [{"en": "Winegrower", "de": "Winzer"}, "Orchard Hand", {"en": "Gardener", "de": "Gärtner"}],
    },
    "global",
)


def matching(category_map="mapped", weights=None) -> Matching:
    return Matching(PROFILE, LEXICON, weights, category_map)


# -- the same matching, said in SQL ------------------------------------------------------

_SUBSTRINGS = ("c++", "c#", ".net")


def quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def candidate_sql(text: str, candidate: str) -> str:
    if candidate in _SUBSTRINGS:
        return f"contains({text}, {quoted(candidate)})"
    escaped = re.sub(r"([^\w\s])", r"\\\1", candidate)
    return f"regexp_matches({text}, {quoted(f'(^|[^a-zA-Z0-9]){escaped}($|[^a-zA-Z0-9])')})"


def entry_sql(text: str, entry: Entry) -> str:
    return "(" + " OR ".join(candidate_sql(text, c) for c in entry.candidates) + ")"


def labels_sql(text: str, entries, titled: bool = True) -> str:
    """SQL list of distinct labels, sorted."""
    cases = ", ".join(
        f"CASE WHEN {entry_sql(text, e)} THEN {quoted(e.label.title() if titled else e.label)} END" for e in entries
    )
    return f"list_sort(list_distinct(list_filter([{cases}], lambda x: x IS NOT NULL)))"


def count_sql(text: str, entries) -> str:
    return " + ".join(f"(CASE WHEN {entry_sql(text, e)} THEN 1 ELSE 0 END)" for e in entries) or "0"


def any_sql(text: str, entries) -> str:
    return " OR ".join(entry_sql(text, e) for e in entries) or "FALSE"


TEXT_SQL = (
    "lower(concat_ws(' ', coalesce(title, ''), coalesce(company, ''), coalesce(description, ''), coalesce(location, '')))"
)

SALARY_SQL = (
    "regexp_extract(coalesce(description, ''), "
    r"'(?i)(?:Salary|Gehalt|Stundensatz|Vergütung):?[\s\x{00a0}]*([€$]\s?\d{2,3}[kK]|\d{2,3}[.,]\d{3}\s?[€$]|EUR)', 1)"
)

REMOTE_SQL = " OR ".join(f"contains(txt, {quoted(w)})" for w in fixed.ENRICH_REMOTE_WORDS)

GERMAN_SQL = f"({', '.join(map(quoted, fixed.GERMAN_WORDS))})"
ENGLISH_SQL = f"({', '.join(map(quoted, fixed.ENGLISH_WORDS))})"


def votes_sql(words: str) -> str:
    return (
        r"len(list_filter(regexp_extract_all(txt, '[\p{L}\p{N}_]{2,}'), "
        f"lambda w: w IN {words}))"
    )


def enriched_sql(source: str, category_map: str = "mapped", weights: dict | None = None) -> str:
    """SQL for one enrichment pass over ``source`` (must give salary_hint, or NULL)."""
    m = matching(category_map)
    missing = {"known_companies": fixed.MISSING_COMPANY_WEIGHT, "seniority_level": fixed.MISSING_SENIORITY_WEIGHT}
    w = dict(fixed.DEFAULT_WEIGHTS)
    if weights:
        w = {k: weights.get(k, missing.get(k, fixed.MISSING_CATEGORY_WEIGHT)) for k in w}
    cats = [
        ("programming_languages", "programming"),
        ("testing_skills", "testing"),
        ("embedded_firmware", "embedded"),
        ("ai_ml_skills", "ai_ml"),
    ]
    flags = ", ".join(
        f"({any_sql('txt', m.lexicon_for(c))}) AS {c}_seen, ({count_sql('txt', m.profile.of(c))}) AS {c}_hits"
        for _, c in cats
    )
    points = " + ".join(
        f"CASE WHEN {c}_seen THEN least({float(w[k])}::DOUBLE, {c}_hits * 4.0::DOUBLE) ELSE 0::DOUBLE END" for k, c in cats
    )
    ceiling = " + ".join(
        f"CASE WHEN {c}_seen THEN {float(w[k])}::DOUBLE ELSE {float(w[k])}::DOUBLE * 0.25::DOUBLE END" for k, c in cats
    )
    companies = " OR ".join(f"contains(lower(company), {quoted(c.lower())})" for c in m.profile.known_companies)
    roles = "CASE WHEN matched_roles = '' THEN 0 ELSE len(string_split(matched_roles, ',')) END"
    return f"""
    SELECT * EXCLUDE (score, ceiling), CAST(trunc((score / ceiling) * 100) AS INTEGER) AS relevance_score FROM (
      SELECT *, {points}
             + CASE WHEN {companies} THEN {float(w['known_companies'])}::DOUBLE ELSE 0::DOUBLE END
             + least({float(w['seniority_level'])}::DOUBLE, ({roles}) * 5.0::DOUBLE) AS score,
             {ceiling} + ({float(w['known_companies'])}::DOUBLE + {float(w['seniority_level'])}::DOUBLE) AS ceiling
      FROM (
        SELECT * EXCLUDE (mine, everything, given_salary, given_type),
               array_to_string(mine[1:15], ', ') AS matching_skills,
               array_to_string(list_sort(list_filter(everything, lambda x: NOT list_contains(mine, x)))[1:10], ', ')
                 AS missing_skills,
               CASE WHEN given_salary <> '' THEN given_salary ELSE {SALARY_SQL} END AS salary_hint,
               CASE WHEN {REMOTE_SQL} THEN 'Remote' WHEN contains(txt, 'hybrid') THEN 'Hybrid' ELSE given_type END
                 AS work_location_type,
               CASE WHEN {votes_sql(GERMAN_SQL)} > {votes_sql(ENGLISH_SQL)} THEN 'German' ELSE 'English' END
                 AS detected_languages
        FROM (
          SELECT * EXCLUDE (salary_hint, work_location_type), coalesce(salary_hint, '') AS given_salary,
                 work_location_type AS given_type,
                 {labels_sql('txt', m.mine())} AS mine,
                 {labels_sql('txt', m.lexicon)} AS everything,
                 array_to_string({labels_sql('txt', m.profile.of('roles'), titled=False)}, ', ') AS matched_roles,
                 {flags}
          FROM (SELECT *, {TEXT_SQL} AS txt FROM ({source}))
        )
      )
    )
    """


DEDUP_SQL = f"""
SELECT * EXCLUDE (rn) FROM (
  SELECT *, row_number() OVER (PARTITION BY coalesce(nullif(job_id, ''), link) ORDER BY seq) AS rn FROM ({POSTINGS})
) WHERE rn = 1
"""
