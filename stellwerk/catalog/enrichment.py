"""Matching, enrichment and scoring over the documents."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from stellwerk import fixed
from stellwerk.catalog import Catalog
from stellwerk.catalog.base import (
    DEDUP_SQL,
    DETAILS,
    ENGLISH_SQL,
    GERMAN_SQL,
    LEXICON,
    POSTINGS,
    PROFILE,
    REMOTE_SQL,
    SALARY_SQL,
    TEXT_SQL,
    any_sql,
    count_sql,
    details,
    enriched_sql,
    labels_sql,
    matching,
    postings,
    quoted,
    table,
    votes_sql,
)
from stellwerk.functions import language, score, skills, types
from stellwerk.functions.text import scoring_text, words
from stellwerk.operators import filters
from stellwerk.operators.dedup import dedup_in_run
from stellwerk.operators.enrich import enrich, enrich_two_pass, skill_columns, with_matches
from stellwerk.operators.match_automaton import match_automaton
from stellwerk.operators.match_join import entry_counts, label_lists, match_join
from stellwerk.operators.merge import merge_details
from stellwerk.plans.batch import batch_run, batch_with_failures
from stellwerk.plans.search_run import RunSettings, ranked_results, scored_postings
from stellwerk.sources.config import read_profiles

RESULT = [
    "seq", "title", "company", "relevance_score", "matching_skills", "missing_skills", "matched_roles",
    "detected_languages", "salary_hint", "work_location_type",
]
RESULT_SQL = ", ".join(RESULT)
TXT = f"(SELECT *, {TEXT_SQL} AS txt FROM ({POSTINGS}))"
NO_SALARY = "SELECT *, '' AS salary_hint FROM"
CATEGORIES = [c for _, c in fixed.SCORED_CATEGORIES]

RANK_SETTINGS = RunSettings(min_relevance_score=10, exclude_keywords=("junior", "intern"))

FIRST_PASS = f"""
SELECT * EXCLUDE (txt, work_location_type),
       {SALARY_SQL} AS salary_hint,
       CASE WHEN {REMOTE_SQL} THEN 'Remote' WHEN contains(txt, 'hybrid') THEN 'Hybrid' ELSE work_location_type END
         AS work_location_type
FROM (SELECT *, {TEXT_SQL} AS txt FROM ({DEDUP_SQL}))
"""

MERGED = f"""
SELECT p.* EXCLUDE (title, location, description, work_location_type),
       coalesce(d.title, p.title) AS title, coalesce(d.location, p.location) AS location,
       coalesce(d.description, p.description) AS description,
       coalesce(d.work_location_type, p.work_location_type) AS work_location_type
FROM ({FIRST_PASS}) p LEFT JOIN ({DETAILS}) d ON p.link = d.link
"""

_LEXICON_SQL = """
SELECT list_name, category, entry_no, label, unnest(candidates) AS candidate FROM (
  SELECT 'bench' AS list_name, 'words' AS category, cast(item_id AS INTEGER) AS entry_no,
         concat('item ', cast(item_id AS STRING)) AS label,
         list_distinct(list_concat(w, list_transform(range(1, len(w)), lambda i: concat(w[i], ' ', w[i + 1])))) AS candidates
  FROM (SELECT item_id, list_filter(string_split(regexp_replace(lower(text), '[^a-z ]', '', 'g'), ' '), lambda x: x <> '') AS w
        FROM benchmark)
)
"""

#: Words of a text, and two words with one blank between them: what the candidates above can equal.
_FOUND_SQL = f"""
SELECT DISTINCT seq, candidate FROM (
  SELECT seq, unnest(regexp_extract_all(txt, '[a-zA-Z0-9]+')) AS candidate FROM {TXT}
  UNION ALL
  SELECT seq, unnest(list_transform(list_filter(range(1, len(p)), lambda i: p[i] <> '' AND p[i + 1] <> ''),
                                    lambda i: concat(p[i], ' ', p[i + 1]))) AS candidate
  FROM (SELECT seq, string_split(unnest(string_split_regex(txt, '[^a-zA-Z0-9 ]')), ' ') AS p FROM {TXT})
)
"""


def passage_lexicon(spark, sf):
    """Lexicon derived from the benchmark passages: every word, and every two that stand together."""
    w = F.filter(F.split(F.regexp_replace(F.lower("text"), "[^a-z ]", ""), " "), lambda x: x != "")
    later = F.slice("w", F.lit(2), F.greatest(F.size("w") - 1, F.lit(0)))
    pairs = F.transform(later, lambda x, i: F.concat_ws(" ", F.get("w", i), x))
    passages = table(spark, sf, "benchmark").select("item_id", w.alias("w"))
    return passages.select(
        F.lit("bench").alias("list_name"),
        F.lit("words").alias("category"),
        F.col("item_id").cast("int").alias("entry_no"),
        F.concat(F.lit("item "), F.col("item_id").cast("string")).alias("label"),
        F.explode(F.array_distinct(F.concat("w", pairs))).alias("candidate"),
    )


def register(c: Catalog) -> None:
    @c.add(
        "postings_ranked",
        f"""SELECT {RESULT_SQL} FROM ({enriched_sql(f'{NO_SALARY} ({DEDUP_SQL})')})
            WHERE relevance_score >= 10 AND NOT contains(lower(title), 'junior') AND NOT contains(lower(title), 'intern')
            ORDER BY relevance_score DESC, seq""",
    )
    def postings_ranked(spark, sf):
        scored = scored_postings(postings(spark, sf), matching(), settings=RANK_SETTINGS)
        return ranked_results(scored, RANK_SETTINGS).select(*RESULT)

    @c.add("scoring_text", f"SELECT seq, txt FROM {TXT}")
    def scoring_text_(spark, sf):
        return postings(spark, sf).select("seq", scoring_text().alias("txt"))

    @c.add(
        "tokenise",
        r"SELECT seq, array_to_string(regexp_extract_all(txt, '[\p{L}\p{N}_]{2,}'), ' ') AS words, "
        rf"cast(len(regexp_extract_all(txt, '[\p{{L}}\p{{N}}_]{{2,}}')) AS INTEGER) AS n FROM {TXT}",
    )
    def tokenise(spark, sf):
        found = postings(spark, sf).select("seq", words(scoring_text()).alias("w"))
        return found.select("seq", F.array_join("w", " ").alias("words"), F.size("w").alias("n"))

    @c.add(
        "language_vote",
        f"""SELECT seq, cast({votes_sql(GERMAN_SQL)} AS INTEGER) AS german, cast({votes_sql(ENGLISH_SQL)} AS INTEGER) AS english,
            CASE WHEN {votes_sql(GERMAN_SQL)} > {votes_sql(ENGLISH_SQL)} THEN 'German' ELSE 'English' END
              AS detected_languages FROM {TXT}""",
    )
    def language_vote(spark, sf):
        txt = postings(spark, sf).select("seq", scoring_text().alias("txt"))
        low = F.col("txt")
        return txt.select(
            "seq",
            language.german_votes(low).alias("german"),
            language.english_votes(low).alias("english"),
            language.detected_language(low).alias("detected_languages"),
        )

    @c.add(
        "required_languages",
        f"SELECT seq FROM {TXT} WHERE {votes_sql(GERMAN_SQL)} > {votes_sql(ENGLISH_SQL)}",
    )
    def required_languages(spark, sf):
        spoken = postings(spark, sf).select("seq", language.detected_language(scoring_text()).alias("detected_languages"))
        return spoken.where(filters.required_languages(["German"])).select("seq")

    def skill_query(name: str, column: str, sql: str) -> None:
        @c.add(name, sql)
        def skill(spark, sf):
            m = matching()
            found = with_matches(postings(spark, sf).select("seq", scoring_text().alias("_text")), m)
            return found.select("seq", skill_columns("_matched", m)[column].alias(column))

    mine = labels_sql("txt", matching().mine())
    skill_query(
        "skill_match", "matching_skills", f"SELECT seq, array_to_string(({mine})[1:15], ', ') AS matching_skills FROM {TXT}"
    )
    skill_query(
        "matched_roles",
        "matched_roles",
        f"SELECT seq, array_to_string({labels_sql('txt', PROFILE.of('roles'), titled=False)}, ', ') AS matched_roles FROM {TXT}",
    )
    skill_query(
        "skill_gap",
        "missing_skills",
        f"""SELECT seq, array_to_string(list_sort(list_filter(everything, lambda x: NOT list_contains(mine, x)))[1:10], ', ')
              AS missing_skills
            FROM (SELECT seq, {mine} AS mine, {labels_sql('txt', LEXICON)} AS everything FROM {TXT})""",
    )

    @c.add(
        "token_boundaries",
        "SELECT seq, " + ", ".join(
            f"{any_sql('txt', [e])} AS m{i}" for i, e in enumerate(LEXICON)
        ) + f" FROM {TXT}",
    )
    def token_boundaries(spark, sf):
        m = matching()
        found = with_matches(postings(spark, sf).select("seq", scoring_text().alias("_text")), m)
        return found.select(
            "seq", *[skills.mentioned("_matched", [e]).alias(f"m{i}") for i, e in enumerate(LEXICON)]
        )

    @c.add(
        "category_counts",
        "SELECT seq, "
        + ", ".join(
            f"cast({count_sql('txt', PROFILE.of(n))} AS INTEGER) AS {n}_count, "
            f"({any_sql('txt', matching().lexicon_for(n))}) AS {n}_mentioned"
            for n in CATEGORIES
        )
        + f" FROM {TXT}",
    )
    def category_counts(spark, sf):
        m = matching()
        found = with_matches(postings(spark, sf).select("seq", scoring_text().alias("_text")), m)
        matched = "_matched"
        columns = []
        for n in CATEGORIES:
            columns.append(skills.match_count(matched, PROFILE.of(n)).alias(f"{n}_count"))
            columns.append(skills.mentioned(matched, m.lexicon_for(n)).alias(f"{n}_mentioned"))
        return found.select("seq", *columns)

    labels_of_passages = f"""SELECT seq, array_to_string(list_sort(list_distinct(list(label))), ', ') AS labels
            FROM ({_FOUND_SQL}) JOIN ({_LEXICON_SQL}) USING (candidate) GROUP BY seq"""

    @c.add("skill_match_join", labels_of_passages)
    def skill_match_join(spark, sf):
        txt = postings(spark, sf).select("seq", scoring_text().alias("_text"))
        return label_lists(match_join(txt, passage_lexicon(spark, sf), marks=False))

    @c.add("skill_match_automaton", labels_of_passages)
    def skill_match_automaton(spark, sf):
        txt = postings(spark, sf).select("seq", scoring_text().alias("_text"))
        return label_lists(match_automaton(txt, passage_lexicon(spark, sf)))

    @c.add(
        "entry_counts_join",
        f"""SELECT seq, list_name, category, count(DISTINCT entry_no) AS matches
            FROM ({_FOUND_SQL}) JOIN ({_LEXICON_SQL}) USING (candidate) GROUP BY ALL""",
    )
    def entry_counts_join(spark, sf):
        txt = postings(spark, sf).select("seq", scoring_text().alias("_text"))
        return entry_counts(match_join(txt, passage_lexicon(spark, sf), marks=False))

    def score_query(name: str, category_map: str, weights: dict | None) -> None:
        @c.add(name, f"SELECT seq, relevance_score FROM ({enriched_sql(f'{NO_SALARY} ({POSTINGS})', category_map, weights)})")
        def relevance(spark, sf):
            scored = enrich(postings(spark, sf), matching(category_map, weights))
            return scored.select("seq", "relevance_score")

    #: Profile, weights, threshold, excluded word; every document is found by two of the three.
    batch = [("wide", {}, 0, "junior"), ("firm", {"known_companies": 40.0}, 20, "rust"), ("skilled", {"programming_languages": 50.0}, 10, "intern")]

    def batch_part(k: int, name: str, weights: dict, least: int, word: str) -> str:
        found = f"SELECT * FROM ({DEDUP_SQL}) WHERE seq % 3 <> {k}"
        return f"""SELECT '{name}' AS profile, seq, relevance_score FROM ({enriched_sql(f"{NO_SALARY} ({found})", weights=weights)})
                   WHERE relevance_score >= {least} AND NOT contains(lower(title), '{word}')"""

    @c.add("batch_profiles", " UNION ALL ".join(batch_part(k, *b) for k, b in enumerate(batch)))
    def batch_profiles(spark, sf):
        rows = [(n, w, (float(least), [word])) for n, w, least, word in batch]
        profiles = spark.createDataFrame(
            rows, "profile string, scoring_weights map<string,double>, filtering struct<min_relevance_score:double,exclude_keywords:array<string>>"
        )
        names = F.array(*[F.when(F.col("seq") % 3 != k, F.lit(b[0])) for k, b in enumerate(batch)])
        found = dedup_in_run(postings(spark, sf)).withColumn("profile", F.explode(F.array_compact(names)))
        return batch_run(found, profiles, matching()).select("profile", "seq", "relevance_score")

    #: Documents of the same profiles, of one that keeps nothing, and of some that cannot be read; all have postings.
    documents = [
        *((n, json.dumps({"scoring_weights": w, "filtering": {"min_relevance_score": least, "exclude_keywords": [word]}})) for n, w, least, word in batch),
        ("picky", '{"filtering": {"min_relevance_score": 1000}, "unknown": 1}'),
        ("broken", '{"filtering": {'), ("listed", '[{"scoring_weights": {}}]'), ("mistyped", '{"search_queries": 5}'), ("empty", None),
    ]
    kept_by_profile = " UNION ALL ".join(batch_part(k, *b) for k, b in enumerate(batch))
    without = " UNION ALL ".join(f"SELECT '{n}', 0, {0 if n == 'picky' else 1}" for n, _ in documents[len(batch):])

    @c.add(
        "batch_with_failures",
        f"""SELECT profile, cast(sum(n) AS BIGINT) AS postings, cast(sum(e) AS BIGINT) AS errors FROM (
              SELECT profile, 1 AS n, 0 AS e FROM ({kept_by_profile}) UNION ALL {without}
            ) GROUP BY ROLLUP (profile)""",
    )
    def batch_failures(spark, sf):
        profiles = read_profiles(spark.createDataFrame(documents, "profile string, value string"))
        names = F.array(*[F.when(F.col("seq") % 3 != k, F.lit(n)) if k < len(batch) else F.lit(n) for k, (n, _) in enumerate(documents)])
        found = dedup_in_run(postings(spark, sf)).withColumn("profile", F.explode(F.array_compact(names)))
        return batch_with_failures(found, profiles, matching())[1]

    score_query("relevance_score", "mapped", None)
    score_query("relevance_score_strict", "strict", None)
    score_query("relevance_score_weights", "mapped", {"programming_languages": 40, "testing_skills": 5, "known_companies": 15})

    @c.add(
        "score_breakdown",
        f"""SELECT seq, relevance_score, {', '.join(
            f"CASE WHEN {n}_seen THEN least({float(fixed.DEFAULT_WEIGHTS[k])}::DOUBLE, {n}_hits * 4.0::DOUBLE) ELSE 0::DOUBLE END AS {n}"
            for k, n in fixed.SCORED_CATEGORIES)}
            FROM ({enriched_sql(f'{NO_SALARY} ({POSTINGS})')})""",
    )
    def score_breakdown(spark, sf):
        scored = enrich(postings(spark, sf), matching(), breakdown=True)
        return scored.select("seq", "relevance_score", *[F.col(f"score_parts.{n}").alias(n) for n in CATEGORIES])

    @c.add(
        "known_companies",
        "SELECT seq, "
        + " OR ".join(f"contains(lower(company), {quoted(k.lower())})" for k in PROFILE.known_companies)
        + f" AS known FROM ({POSTINGS})",
    )
    def known_companies(spark, sf):
        known = score.known_company(F.col("company"), PROFILE.known_companies)
        return postings(spark, sf).select("seq", known.alias("known"))

    @c.add(
        "role_count",
        f"""SELECT seq, cast(CASE WHEN r = '' THEN 0 ELSE len(string_split(r, ',')) END AS INTEGER) AS roles
            FROM (SELECT seq, CASE WHEN lang = 'en' THEN '' ELSE text END AS r FROM
                  (SELECT doc_id AS seq, lang, text FROM documents))""",
    )
    def role_count(spark, sf):
        r = F.when(F.col("lang") == "en", F.lit("")).otherwise(F.col("text"))
        return table(spark, sf, "documents").select(F.col("doc_id").alias("seq"), score.role_count(r).alias("roles"))

    @c.add("salary_hint", f"SELECT seq, {SALARY_SQL} AS salary_hint FROM ({POSTINGS})")
    def salary_hint(spark, sf):
        return postings(spark, sf).select("seq", types.salary_hint(F.col("description")).alias("salary_hint"))

    @c.add(
        "work_type_override",
        f"""SELECT seq, CASE WHEN {REMOTE_SQL} THEN 'Remote' WHEN contains(txt, 'hybrid') THEN 'Hybrid'
            ELSE work_location_type END AS work_location_type FROM {TXT}""",
    )
    def work_type_override(spark, sf):
        value = types.work_type_override(scoring_text(), F.col("work_location_type"))
        return postings(spark, sf).select("seq", value.alias("work_location_type"))

    @c.add(
        "detail_merge",
        f"""SELECT p.seq, p.link, coalesce(d.title, p.title) AS title, coalesce(d.location, p.location) AS location,
            coalesce(d.description, p.description) AS description,
            coalesce(d.work_location_type, p.work_location_type) AS work_location_type
            FROM ({POSTINGS}) p LEFT JOIN ({DETAILS}) d ON p.link = d.link""",
    )
    def detail_merge(spark, sf):
        merged = merge_details(postings(spark, sf), details(spark, sf))
        return merged.select("seq", "link", "title", "location", "description", "work_location_type")

    @c.add(
        "detail_merge_keep_text",
        f"""SELECT p.seq, coalesce(nullif(d.title, ''), p.title) AS title,
            coalesce(nullif(d.description, ''), p.description) AS description
            FROM ({POSTINGS}) p LEFT JOIN ({DETAILS}) d ON p.link = d.link""",
    )
    def detail_merge_keep_text(spark, sf):
        merged = merge_details(postings(spark, sf), details(spark, sf), keep_nonempty=True)
        return merged.select("seq", "title", "description")

    @c.add("two_pass_enrich", f"SELECT {RESULT_SQL} FROM ({enriched_sql(MERGED)})")
    def two_pass_enrich(spark, sf):
        unique = dedup_in_run(postings(spark, sf))
        return enrich_two_pass(unique, details(spark, sf), matching()).select(*RESULT)
