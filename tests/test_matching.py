"""Matching, score and scalar rules against hand-computed values and plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from stellwerk import fixed
from stellwerk.functions import cleanup, language, score, skills, types
from stellwerk.functions.text import scoring_text, strip, words
from stellwerk.operators.enrich import Matching, enrich, enrich_two_pass
from stellwerk.operators.match_automaton import PART_CHARS, match_automaton
from stellwerk.operators.match_join import label_lists, match_join
from stellwerk.sources.config import flatten_entries, lexicon_frame, profile_from_dict

PROFILE = profile_from_dict(
    {
        "known_companies": ["Rebland Kellerei"],
        "skills": {
            "embedded": ["LoRa", {"en": "Hydroponics", "de": "Hydroponik"}],
            "roles": [{"en": "Winegrower", "de": "Winzer"}, "Vorarbeiter", {"en": "Gardener", "de": "Gärtner"}],
            "programming": ["C#", "R"],
            "testing": [{"en": "Soil Test", "de": "Bodenprobe"}, "pH", "Drip/Spray"],
        },
    }
)
LEXICON = flatten_entries(
    {
        "testing_qa": ["pH", "Brix", {"en": "Soil Test", "de": "Bodenprobe"}],
        "roles_and_seniority": [{"en": "Gardener", "de": "Gärtner"}, {"en": "Winegrower", "de": "Winzer"}],
        "programming_languages": ["C", "R", "C#"],
        "embedded_hardware": [{"en": "Hydroponics", "de": "Hydroponik"}, "LoRa"],
    },
    "global",
)
CASES = [
    (0, "Winzer", "Hof und Garten", "Bodenprobe mit pH 7 (Brix), R", "Krems"),
    (1, "Head Gardener, Vorarbeiter", "Rebland Kellerei", "hydroponik", "remote"),
    (2, "Orchard Hand", "ACME", "", "Austria"),
]
COLUMNS = "seq long, title string, company string, description string, location string"


def scored(spark, category_map, weights=None):
    df = enrich(spark.createDataFrame(CASES, COLUMNS), Matching(PROFILE, LEXICON, weights, category_map))
    return {r["seq"]: r for r in df.collect()}


# Points: 4 for each skill of a category that was seen, up to its weight, 5 for each role, 10 for a known company. The most
# that can be had: weights of the categories seen, a quarter of the others', 25 for company and roles.
# Mapped, first case: R 4, pH and soil test 8, a role 5, of 20 + 20 + 15 / 4 + 20 / 4 + 25.
# Second: hydroponics 4, two roles 10, company 10, of 20 / 4 + 20 / 4 + 15 + 20 / 4 + 25. Strict: no category is seen.
@pytest.mark.parametrize(
    "category_map, expected",
    [("mapped", [int(17 / 73.75 * 100), int(24 / 55 * 100), 0]), ("strict", [int(5 / 43.75 * 100), int(20 / 43.75 * 100), 0])],
)
def test_scores_computed_by_hand(spark, category_map, expected):
    rows = scored(spark, category_map)
    assert [rows[i]["relevance_score"] for i in range(3)] == expected


def test_labels(spark):
    rows = scored(spark, "mapped")
    assert rows[0]["matching_skills"] == "Ph, R, Soil Test"
    assert rows[1]["matching_skills"] == "Hydroponics"
    # Role words of the lexicon are not among the matching lists, so they show as missing.
    assert [rows[i]["missing_skills"] for i in range(3)] == ["Brix, Winegrower", "Gardener", ""]
    assert [rows[i]["matched_roles"] for i in range(3)] == ["Winegrower", "Gardener, Vorarbeiter", ""]


def test_weights_from_a_column_and_missing_keys(spark):
    df = spark.createDataFrame(
        [(*CASES[0], {}), (*CASES[1], {"known_companies": 30.0})], COLUMNS + ", w map<string,double>"
    )
    out = enrich(df, Matching(PROFILE, LEXICON, F.col("w"), "strict")).collect()
    by = {r["seq"]: r["relevance_score"] for r in out}
    assert by[0] == int(5 / 43.75 * 100)
    # 30 + 10 of (4 * 20 * 0.25) + 30 + 15
    assert by[1] == int((40 / 65) * 100)
    assert scored(spark, "strict", {"known_companies": 30})[1]["relevance_score"] == by[1]


def test_score_is_truncated_not_rounded(spark):
    parts = F.struct(
        *[F.lit(0.0).alias(n) for n in ("programming", "testing", "embedded", "ai_ml", "company")],
        F.lit(29.0).alias("seniority"), F.lit(100.0).alias("maximum"),
    )
    zero = parts.withField("maximum", F.lit(0.0))
    row = spark.range(1).select(score.relevance_score(parts).alias("a"), score.relevance_score(zero).alias("b")).first()
    assert (row["a"], row["b"]) == (28, 0)


def stands_in(text: str, candidate: str) -> bool:
    """Character by character: the candidate is there, and no ASCII letter or digit touches it."""
    touches = set("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")
    at = text.find(candidate)
    while at >= 0:
        around = text[max(0, at - 1) : at] + text[at + len(candidate) : at + len(candidate) + 1]
        if candidate in fixed.SUBSTRING_CANDIDATES or not touches & set(around):
            return True
        at = text.find(candidate, at + 1)
    return False


def test_matching_equals_plain_python_on_random_texts(spark):
    rng = random.Random(7)
    names = ["ph", "c#", "für", "r", "soil test", "drip/spray", ".net", "日本", "c", "4-20 ma", "x2y", "c++", "wörd"]
    entries = flatten_entries({"x": names}, "global")
    glue = ["", " ", "/", "ü", "x", "1", "\n", "-", "_"]
    texts = [
        "".join(rng.choice(names + ["word", "soil", "phx", "xfür"]) + rng.choice(glue) for _ in range(rng.randint(0, 12)))
        for _ in range(400)
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "seq long, _text string")
    hits = df.withColumn("_hits", skills.token_hits("_text", list(entries)))
    got = {r["seq"]: set(r["m"]) for r in hits.select("seq", skills.matched_candidates("_text", "_hits", list(entries)).alias("m")).collect()}
    expected = {i: {c for c in names if stands_in(t, c)} for i, t in enumerate(texts)}
    assert got == expected

    joined = match_join(df, lexicon_frame(spark, entries))
    lists = {r["seq"]: r["labels"] for r in label_lists(joined).collect()}
    assert lists == {i: ", ".join(sorted(c)) for i, c in expected.items() if c}
    for part_chars in (1, 25, PART_CHARS):
        found = match_automaton(df, lexicon_frame(spark, entries), part_chars=part_chars)
        assert {r["seq"]: r["labels"] for r in label_lists(found).collect()} == lists


def test_automaton_takes_empty_inputs_and_moves_no_text(spark):
    words_frame = spark.createDataFrame(
        [("x", "y", 0, "A", "soil"), ("x", "y", 1, "B", ""), ("x", "y", 2, "C", None), ("x", "y", 3, "D", "soil"), ("x", "y", 4, "E", "-")],
        "list_name string, category string, entry_no int, label string, candidate string",
    )
    long = "soil " * 400_000 + "-"
    texts = spark.createDataFrame([(None, "soil"), (1, None), (2, ""), (3, long), (3, "soil")], "`a key` int, _text string")
    found = match_automaton(texts, words_frame, key="a key")
    assert sorted((str(r["a key"]), r["label"]) for r in found.collect()) == [
        ("3", "A"), ("3", "A"), ("3", "D"), ("3", "D"), ("3", "E"), ("None", "A"), ("None", "D")
    ]
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    assert match_automaton(texts, words_frame.limit(0), key="a key").collect() == []
    assert match_automaton(texts.limit(0), words_frame, key="a key").collect() == []


def one(spark, col, text):
    return spark.createDataFrame([(text,)], "t string").select(col).first()[0]


@pytest.mark.parametrize(
    "text, expected",
    [
        ("VERGÜTUNG: €80k", "€80k"),
        ("salary eur", "eur"),
        ("Stundensatz: 95 €", ""),
        ("Gehalt: €80k", "€80k"),
        ("Gehalt 95.000 €", "95.000 €"),
        (None, ""),
    ],
)
def test_salary(spark, text, expected):
    assert one(spark, types.salary_hint(F.col("t")), text) == expected


@pytest.mark.parametrize(
    "text, expected",
    [("automobilindustrie", "Remote"), ("hybrid", "Hybrid"), ("100%", "Remote"), ("office", "kept")],
)
def test_work_type_override(spark, text, expected):
    assert one(spark, types.work_type_override(F.col("t"), F.lit("kept")), text) == expected


def test_words_and_votes_are_unicode(spark):
    assert one(spark, words(F.col("t")), "für größe a _x des² und") == ["für", "größe", "_x", "des²", "und"]
    assert one(spark, language.german_votes(F.col("t")), "und undü und, und_ (der) die") == 4
    assert one(spark, language.detected_language(F.col("t")), "und the") == "English"


def test_title_case_of_labels():
    assert [s.title() for s in ("drip/spray", "x2y", "4-20 ma", "st. john's")] == ["Drip/Spray", "X2Y", "4-20 Ma", "St. John'S"]


def test_absent_text_is_empty(spark):
    df = spark.createDataFrame([("T", None, None, "L")], "title string, company string, description string, location string")
    assert df.select(scoring_text()).first()[0] == "t   l"
    assert one(spark, strip(F.col("t")), "\n a b\t") == "a b"
    assert one(spark, cleanup.clean_offer_title(F.col("t")), " In­genieur ") == "Ingenieur"


def test_two_passes_carry_salary_and_work_type(spark):
    rows = [
        (0, "a", "T", "c", "Gehalt: €80k hybrid", "l", "On-site"),
        (1, "b", "T", "c", "", "l", "On-site"),
        (2, "c", "T", "c", "remote", "l", "On-site"),
        (3, "d", "T", "c", "remote Gehalt: €70k", "l", "On-site"),
    ]
    df = spark.createDataFrame(
        rows, "seq long, link string, title string, company string, description string, location string, work_location_type string"
    )
    details = spark.createDataFrame(
        [
            ("a", "Salary: €90k plain", None),
            ("b", "Salary: €90k plain", "Hybrid"),
            ("c", "plain", "On-site"),
            ("d", "", None),
        ],
        "link string, description string, work_location_type string",
    )
    m = Matching(PROFILE, LEXICON)
    got = {r["seq"]: r for r in enrich_two_pass(df, details, m).collect()}
    # The list's salary stays; without one the page's counts.
    assert [got[i]["salary_hint"] for i in range(4)] == ["€80k", "€90k", "", "€70k"]
    # The list's text decides first, the page may overrule, its text may again.
    assert [got[i]["work_location_type"] for i in range(4)] == ["Hybrid", "Hybrid", "On-site", "Remote"]
    # A page that came back empty erases the list text, unless told not to.
    assert got[3]["description"] == ""
    kept = {r["seq"]: r for r in enrich_two_pass(df, details, m, keep_nonempty=True).collect()}
    assert kept[3]["description"] == "remote Gehalt: €70k"
