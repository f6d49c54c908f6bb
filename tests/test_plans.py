"""Physical plans: what must, and must not, be in them."""

import json
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from stellwerk import fixed
from stellwerk.catalog import build
from stellwerk.catalog.base import matching, postings
from stellwerk.functions import types
from stellwerk.functions.text import text
from stellwerk.operators import dedup, filters, rank, sync
from stellwerk.operators.enrich import enrich
from stellwerk.operators.match_join import match_candidates
from stellwerk.plans.batch import batch_run
from stellwerk.plans.maintenance import sync_master
from stellwerk.sources import runs, sinks

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").select(
        F.col("doc_id").alias("seq"), F.col("source").alias("title"), F.col("lang").alias("company"),
        F.col("text").alias("description"), F.col("lang").alias("location"),
    )


def test_matching_runs_once_and_without_python(spark):
    text = plan(enrich(documents(spark), matching()).where(filters.min_score(25)))
    assert "EvalPython" not in text
    # One intersection for the leads, one for the plain candidates.
    assert text.count("array_intersect(") == 2


def test_title_filter_reaches_the_scan(spark):
    text = plan(enrich(documents(spark), matching()).where(filters.title_excludes(["junior"])))
    assert any("junior" in line for line in text.splitlines() if "FileScan" in line)


def test_dedup_reduces_before_the_shuffle(spark):
    text = plan(dedup.dedup_in_run(postings(spark, SF).select("seq", "job_id", "link", "provider")))
    assert text.count("partial_min(") >= 1 and "Window" not in text


def test_search_limit_reduces_before_the_shuffle(spark):
    rows = spark.read.parquet(f"{SF}/events.parquet").selectExpr(
        "event_id AS pos", "event_type AS provider", "props AS query", "user_id AS location"
    )
    assert plan(rank.per_search_limit(rows, 3, most=5)).count("WindowGroupLimit") == 2


def test_top_rows_do_not_sort_everything(spark):
    assert "TakeOrderedAndProject" in plan(rank.top_rows(postings(spark, SF).withColumn("relevance_score", F.lit(1))))


def test_sync_reads_only_links_of_the_master(spark, tmp_path):
    path = str(tmp_path / "m")
    postings(spark, SF).select("link", "title", "description").write.parquet(path)
    new = sync.new_postings(postings(spark, SF).select("run_id", "seq", "link"), spark.read.parquet(path))
    assert "ReadSchema: struct<link:string>" in plan(new)


def test_no_query_forces_a_broadcast_or_a_cross_join(spark):
    catalog = build()
    for name in ("postings_ranked", "detail_merge", "skill_match_join", "search_plan", "incremental_sync"):
        df = catalog.queries[name](spark, SF)
        assert "Cartesian" not in plan(df), name
        assert "strategy=broadcast" not in df._jdf.queryExecution().logical().toString(), name


@pytest.fixture
def no_broadcast(spark):
    """Nothing is small enough to be broadcast by its size."""
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "-1")
    yield
    spark.conf.set(name, before)


def test_run_texts_are_not_shuffled_by_their_run(spark, tmp_path, no_broadcast):
    rows = postings(spark, SF).select("seq", "link", F.lit('{"chars":1}').alias("extra"))
    sinks.write_run(rows, str(tmp_path / "runs/all"), ("json",))
    assert "SortMergeJoin" not in plan(runs.scan_run_folders(spark, str(tmp_path / "runs"), extra=True))


def test_the_parts_of_one_run_stay_in_their_tasks(spark, tmp_path, no_broadcast):
    """A run that is synchronised whole is not brought together in one task first."""
    rows = postings(spark, SF).select("seq", "link", F.lit("one").alias("run_id")).repartition(6)
    sinks.write_run(rows, str(tmp_path / "runs/all"), ("json",))
    cost = "spark.sql.files.openCostInBytes"
    before = spark.conf.get(cost)
    spark.conf.set(cost, str(128 << 20))  # a task per file
    try:
        found = runs.scan_run_folders(spark, str(tmp_path / "runs"))
        assert found.groupBy(F.spark_partition_id()).count().count() == 6
    finally:
        spark.conf.set(cost, before)
    assert sync_master(found, str(tmp_path / "master")) == rows.select("link").distinct().count()


def test_a_profile_is_not_one_task_and_an_unread_one_shuffles_nothing(spark, no_broadcast):
    profiles = spark.createDataFrame(
        [("one", {}, (0.0, []))],
        "profile string, scoring_weights map<string,double>, filtering struct<min_relevance_score:double,exclude_keywords:array<string>>",
    )
    found = postings(spark, SF).withColumn("profile", F.explode(F.array(F.lit("one"), F.lit("unread"))))
    text = plan(batch_run(found, profiles, matching()))
    assert "SortMergeJoin" not in text
    # The one shuffle is deduplication's, and the unread profile's postings go before it.
    assert text.count("Exchange hashpartitioning") == 1 and text.index("LeftSemi") > text.index("Exchange hashpartitioning")


def test_plain_candidates_need_no_text(spark, no_broadcast):
    """They are a branch of their own, beside the candidates that are checked against texts."""
    texts = postings(spark, SF).select("seq", F.lower("description").alias("_text"))
    lexicon = spark.createDataFrame([("und",), ("mit der",), ("c#",)], "candidate string")
    text = plan(match_candidates(texts, lexicon))
    assert "Union" in text
    found = {r[0] for r in match_candidates(texts, lexicon).select("candidate").distinct().collect()}
    assert "und" in found


def test_salary_is_searched_only_where_a_currency_is_named(spark):
    """The guard lets through all that the pattern finds, whatever the letters' case."""
    texts = ["Gehalt: 48.500 €", "SALARY €80K", "\u017falary: eUr", "Verg\u00dctung:\u00a0$95k", "verg\u00fctung EUR", "Stundensatz 95", "Gehalt: 80k", "neuer", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    found = df.select(types.salary_hint(F.col("t")).alias("got"), F.regexp_extract(text("t"), fixed.SALARY_PATTERN, 1).alias("all"))
    assert [r["got"] for r in found.collect()] == [r["all"] for r in found.collect()]
    assert [r["got"] for r in found.collect()][:5] == ["48.500 €", "€80K", "eUr", "$95k", "EUR"]
    assert "CASE WHEN" in plan(df.select(types.salary_hint(F.col("t"))))


WRITE = """
import sys
from pyspark.sql import functions as F
from stellwerk.session import build_session
from stellwerk.sources import sinks

log, out = sys.argv[1:]
conf = {"spark__eventLog__" + k: v for k, v in {"enabled": "true", "dir": log, "rolling__enabled": "false", "compress": "false"}.items()}
spark = build_session("write", "local[2]", spark__ui__enabled="false", **conf)
rows = spark.range(20000).select(F.col("id").alias("seq"), (F.col("id") % 7).cast("string").alias("run_id"), F.lit("x").alias("link"))
sinks.write_run(rows, out + "/plain", ("json",))
sinks.write_run(rows.withColumn("extra", F.lit('{"chars":1}')), out + "/extra", ("json",))
spark.stop()
"""


def test_runs_are_written_without_holding_their_rows(tmp_path):
    """A task that writes several runs does not sort them first, so its memory does not follow what it reads."""
    log = tmp_path / "log"
    log.mkdir()
    subprocess.run([sys.executable, "-c", WRITE, f"file://{log}", str(tmp_path)], check=True, cwd=Path(__file__).parents[1], timeout=300)
    events = [json.loads(line) for f in log.iterdir() if not f.name.startswith(".") for line in f.read_text().splitlines()]
    tasks = [e["Task Metrics"] for e in events if e["Event"] == "SparkListenerTaskEnd"]
    assert sum(t["Output Metrics"]["Records Written"] for t in tasks) == 40000
    assert max(t["Peak Execution Memory"] for t in tasks) == 0


def test_more_runs_than_are_written_side_by_side(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sinks, "OPEN_RUNS", 3, raising=False)
    name = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(name)
    rows = spark.range(900).select(F.col("id").alias("seq"), (F.col("id") % 11).cast("string").alias("run_id"), F.col("id").cast("string").alias("link"))
    sinks.write_run(rows.coalesce(2), str(tmp_path / "runs/all"), ("json",))
    assert spark.conf.get(name) == before
    found = runs.scan_run_folders(spark, str(tmp_path / "runs")).select("seq", "run_id", "link")
    assert sorted(found.collect()) == sorted(rows.collect())
