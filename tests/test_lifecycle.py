"""Sources, sinks, deduplication, master table, streaming."""

import json

import pytest
from pyspark.sql import functions as F

from stellwerk.fixed import HEADERS
from stellwerk.functions.extra import extra_value, merged_line
from stellwerk.operators import dedup, rank, sync
from stellwerk.operators.dedup import first_by_key
from stellwerk.operators.enrich import Matching
from stellwerk.operators.merge import merge_details
from stellwerk.plans.maintenance import rotate, sync_master
from stellwerk.plans.row_filters import by_city, by_title
from stellwerk.plans.search_run import RunSettings, kept_postings, run_search, scored_postings, settings_of, worth_notifying
from stellwerk.sources import config, runs, sinks
from stellwerk.plans.rotation import read_active, rotate_in_place, stale_months
from stellwerk.streaming import keyed
from stellwerk.streaming.keyed import start_keyed_sync
from stellwerk.streaming.sync import first_within, read_run_stream, start_sync
from tests.test_matching import LEXICON, PROFILE


def write(path, value):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(value if isinstance(value, str) else json.dumps(value, indent=2), encoding="utf-8")


def test_run_folders(spark, tmp_path):
    write(tmp_path / "r1/jobs.json", [{"link": "a", "title": "x", "relevance_score": 3}, {"link": "b"}])
    write(tmp_path / "r1/all_jobs_raw.json", [{"link": "hidden"}])
    write(tmp_path / "r2/all_jobs_raw.json", [{"link": "c", "extra": 1}])
    write(tmp_path / "r3/jobs.json", "[{broken")  # hides the readable file beside it
    write(tmp_path / "r3/all_jobs_raw.json", [{"link": "hidden"}])
    write(tmp_path / "r4/jobs.json", {"link": "not a list"})
    write(tmp_path / "r5/other.json", [{"link": "ignored"}])
    write(tmp_path / "r6/jobs.json", '[{"link": "e"}] trailing')
    # Valid only once something is written around them.
    write(tmp_path / "r61/jobs.json", '[{"link": "inj"}],"w":[1]')
    write(tmp_path / "r62/jobs.json", '[{"link": "inj"}],[{"link": "inj"}]')
    write(tmp_path / "r63/jobs.json", '[{"link": "inj"}]],"w":[[1]')
    write(tmp_path / "r64/jobs.json", '[{"link": "inj"}]]},{"v":[[1]')
    write(tmp_path / "r7/jobs.json", [{"link": "f", "relevance_score": 33.0}, {"link": "g", "relevance_score": "high"}])
    rows = runs.scan_run_folders(spark, str(tmp_path)).orderBy("run_id", "seq").collect()
    assert [(r["run_id"], r["seq"], r["link"]) for r in rows] == [
        ("r1", 0, "a"), ("r1", 1, "b"), ("r2", 0, "c"), ("r7", 0, "f"), ("r7", 1, "g")
    ]
    assert rows[0]["relevance_score"] == 3 and rows[3]["relevance_score"] == 33 and rows[4]["relevance_score"] is None
    problems = {(r["run_id"], r["problem"], r["n"]) for r in runs.run_problems(spark, str(tmp_path)).collect()}
    assert problems == {
        *((f"r{k}", "not a JSON list", 1) for k in (3, 4, 6, 61, 62, 63, 64)), ("r7", "score is no whole number", 1)
    }


def test_bad_profiles_do_not_stop_the_others(spark, tmp_path):
    good = {"profile_name": "G", "search_queries": ["a"], "filtering": {"min_relevance_score": 5}}
    write(tmp_path / "good.json", good)
    write(tmp_path / "other.json", {"anything": {"else": 1}})
    write(tmp_path / "cut.json", '{"search_queries": ["a"')
    write(tmp_path / "after.json", '{"search_queries": ["a"]} x')
    write(tmp_path / "closes.json", '{"profile_name": "x"},"w":{"y":1}')
    write(tmp_path / "closes_list.json", '{"profile_name": "x"}]},{"v":[1')
    write(tmp_path / "list.json", [good])
    write(tmp_path / "text.json", '"a"')
    write(tmp_path / "kinds.json", {"search_queries": "a", "profile_name": "K"})
    write(tmp_path / "blank.json", "\n")
    write(tmp_path / "empty.json", "")  # no byte: as good as absent
    found = {r["profile"]: r for r in config.checked_profiles(spark, str(tmp_path)).collect()}
    assert {n: r["error"] for n, r in found.items()} == {
        "good": None, "other": None, "cut": "no valid JSON", "after": "no valid JSON", "closes": "no valid JSON",
        "closes_list": "no valid JSON", "list": "the root must be an object", "text": "the root must be an object",
        "kinds": "a setting is not of its kind", "blank": "no valid JSON",
    }
    assert found["good"]["search_queries"] == ["a"] and found["good"]["filtering"]["min_relevance_score"] == 5
    assert found["kinds"]["profile_name"] is None and found["closes"]["profile_name"] is None
    asked = config.checked_profiles(spark, str(tmp_path), ["good", "nobody", "cut", "good", "empty"]).select("profile", "error").collect()
    assert sorted(map(tuple, asked), key=str) == [
        ("cut", "no valid JSON"), ("empty", "no such profile"), ("good", None), ("nobody", "no such profile")
    ]


def test_keys_beyond_the_fields_come_and_go(spark, tmp_path):
    write(tmp_path / "r1/jobs.json", [{"link": "a", "budget": {"max": 9.5}, "tags": ["x", 2], "seq": 7, "none": None}, {"link": "b"}])
    write(tmp_path / "r2/jobs.json", '[{"budget": "9"}, {"link": "d", "a\\"b": "}\\n"}]')
    write(tmp_path / "r3/jobs.json", '[{"budget": 1}, 5]')
    first = runs.scan_run_folders(spark, str(tmp_path), extra=True)
    assert first.columns[-1] == "extra"
    sinks.write_run(first.drop("run_id"), str(tmp_path / "again/r9"), ("json",))
    sinks.write_run(first.limit(0), str(tmp_path / "empty/r9"), ("json",))
    for rows in (first, runs.scan_run_folders(spark, str(tmp_path / "again"), extra=True)):
        read = rows.select("link", extra_value("budget.max", "double"), extra_value("budget", "int"), extra_value("tags[1]", "int"), "extra")
        assert sorted(map(tuple, read.collect()), key=str) == [
            ("a", 9.5, None, 2, '{"budget":{"max":9.5},"none":null,"tags":["x",2]}'),
            ("b", None, None, None, None),
            ("d", None, None, None, '{"a\\"b":"}\\n"}'),
            (None, None, 9, None, '{"budget":"9"}'),
        ]
    assert runs.scan_run_folders(spark, str(tmp_path / "empty"), extra=True).collect() == []
    broken = spark.createDataFrame([(0, "a", "{no"), (1, "b", "5"), (2, None, None), (3, None, '{"link":"x"}')], "seq long, link string, extra string")
    assert [r[0] for r in broken.select(merged_line(F.struct("link"), F.col("extra"))).collect()] == ['{"link":"a"}', '{"link":"b"}', "{}", "{}"]


def test_a_written_run_is_found_again(spark, tmp_path):
    rows = spark.createDataFrame([(0, "a", "T", 5), (1, "b", None, 7)], "seq long, link string, title string, relevance_score int")
    sinks.write_run(rows, str(tmp_path / "runs/20250101_1000"), ("json", "csv"))
    sinks.write_run(rows.selectExpr("*", "'own' AS run_id"), str(tmp_path / "runs/20250102_1000"), ("json",))
    write(tmp_path / "runs/20250103_1000/jobs.json", [{"link": "c"}])
    got = {(r["run_id"], r["seq"], r["link"], r["relevance_score"]) for r in runs.scan_run_folders(spark, str(tmp_path / "runs")).collect()}
    assert got == {("20250101_1000", 0, "a", 5), ("20250101_1000", 1, "b", 7), ("own", 0, "a", 5), ("own", 1, "b", 7), ("20250103_1000", 0, "c", None)}


def test_exports_are_read_by_name(spark, tmp_path):
    write(tmp_path / "a/all_jobs_raw.csv", "note,link,title\nVienna office,1,Tester\nx,2,QA\n")
    write(tmp_path / "b/all_jobs_raw.csv", 'title,link,provider\n"Te,st",3,hays\n')
    rows = {r["link"]: r for r in runs.scan_raw_csv(spark, str(tmp_path)).collect()}
    assert [(rows[k]["title"], rows[k]["provider"], list(rows[k]["others"])) for k in "123"] == [
        ("Tester", "", ["Vienna office"]), ("QA", "", ["x"]), ("Te,st", "hays", [])
    ]
    assert {r["link"] for r in by_city(spark, str(tmp_path), ("vienna",)).collect()} == {"1"}


def test_details_count_once_per_link(spark):
    postings = spark.createDataFrame([(k, link) for k, link in enumerate(["a", "a", "b", "", None])], "seq long, link string")
    details = spark.createDataFrame(
        [("a", 2, "second"), ("a", 1, "first"), ("", 1, "none"), (None, 1, "none")], "link string, page long, title string"
    )
    got = merge_details(postings.withColumn("title", F.lit("old")), details, order="page").orderBy("seq").collect()
    assert [r["title"] for r in got] == ["first", "first", "old", "old", "old"]
    assert merge_details(postings, details).count() == 5


def test_limits_and_numbers_lose_no_row(spark):
    rows = spark.createDataFrame([(k, "p", "q", "l") for k in range(10)], "pos long, provider string, query string, location string")
    assert rank.per_search_limit(rows, 8).count() == 8
    assert rank.per_search_limit(rows, F.lit(None).cast("int")).count() == 10
    with pytest.raises(Exception, match="above 5"):
        rank.per_search_limit(rows, F.lit(8), most=5).collect()
    scored = spark.createDataFrame([(1, 5), (None, 7)], "seq long, relevance_score int")
    with pytest.raises(Exception, match="no place in the ranking"):
        rank.number_rows(scored).collect()


def test_a_map_inside_a_struct_can_be_deduplicated(spark):
    rows = spark.sql("SELECT 1 AS k, 2 AS seq, named_struct('m', map('a', 1)) AS s UNION ALL SELECT 1, 1, named_struct('m', map('b', 2))")
    assert [r["seq"] for r in first_by_key(rows, ["k"], ["seq"]).collect()] == [1]


def test_raw_exports_and_row_filters(spark, tmp_path):
    header = ",".join(HEADERS)
    line = lambda **v: ",".join('"' + v.get(h, "").replace('"', '""') + '"' for h in HEADERS)
    rows = [
        line(title='Tester "A"', link="1", company="two\nlines"),
        line(title="Cook", link="2", location="WIEN Vienna"),
        line(title="Test", link=""),
        line(title="Other", link="1", company="Graz"),
    ]
    write(tmp_path / "x/deep/all_jobs_raw.csv", "\n".join([header, *rows]) + "\n")
    write(tmp_path / "y/all_jobs_raw.csv", "\n".join([header, line(title="Quality", link="1"), line(title="QA", link="3")]) + "\n")
    write(tmp_path / "y/jobs.csv", "\n".join([header, line(title="Tester", link="9")]) + "\n")
    got = {(r["link"], r["title"], r["company"]) for r in by_title(spark, str(tmp_path)).collect()}
    assert got == {("1", 'Tester "A"', "two\nlines"), ("3", "QA", "")}
    # The filter comes before deduplication: the second row of link 1 is the first that matches.
    assert {(r["link"], r["title"]) for r in by_city(spark, str(tmp_path)).collect()} == {("2", "Cook"), ("1", "Other")}


def test_configuration_documents(spark, tmp_path):
    write(tmp_path / "p.json", {"skills": {"programming": ["Go", {"en": "A", "de": "B"}]}, "known_companies": ["X"]})
    profile = config.load_profile(spark, str(tmp_path / "p.json"))
    assert [(e.label, e.candidates) for e in profile.of("programming")] == [("Go", ("go",)), ("A", ("a", "b"))]
    write(tmp_path / "list.json", [1])
    with pytest.raises(config.ConfigError):
        config.load_lexicon(spark, str(tmp_path / "list.json"))
    doc = {
        "active_providers": {"hays": {"enabled": True}, "xing": {"enabled": False, "max_results": 3}},
        "search_queries": ["q"], "scoring_weights": {"programming_languages": 25},
        "filtering": {"min_relevance_score": 25, "exclude_keywords": ["x"]}, "output": {"formats": ["json"], "base_filename": "b"},
    }
    write(tmp_path / "profiles/fast.json", doc)
    row = config.load_search_profiles(spark, str(tmp_path / "profiles")).first()
    assert row["profile"] == "fast" and row["active_providers"]["hays"]["enabled"] and row["scoring_weights"] == {"programming_languages": 25.0}
    assert settings_of(doc) == RunSettings(25, ("x",), False, False, ("json",), "b")


def test_declared_settings_filter_and_split(spark, tmp_path):
    doc = {
        "filtering": {"required_keywords": ["Zinc"], "exclude_companies": ["Acme"]},
        "work_preferences": {"employment_types": ["Contract"], "exclude_types": ["Internship"]},
        "language_requirements": {"required": ["English"]},
        "output": {"separate_files_by_type": True, "formats": ["csv"]},
        "report": {"top_n_jobs": 2},
        "notifications": {"mail": {"min_score_notify": 0}, "on": True},
    }
    settings = settings_of(doc, declared=True)
    assert settings_of(doc).required_keywords == () and settings.top_n == 2 and settings.by_type and settings.notify_score == 0
    rows = [
        (0, "a", "T", "x", "work with zinc and the team", "Contract"), (1, "b", "T", "x", "work with tin", "Contract"),
        (2, "c", "T", "acme co", "zinc", "Contract"), (3, "d", "T", "x", "zinc", "Full-time"), (4, "e", "T", "x", "zinc und der die das", "Contract"),
    ]
    postings = spark.createDataFrame(rows, "seq long, link string, title string, company string, description string, employment_type string")
    postings = postings.withColumns({"location": F.lit(""), "job_id": F.col("link"), "work_location_type": F.lit("")})
    scored = scored_postings(postings, Matching(PROFILE, LEXICON), settings=settings)
    assert {r["link"] for r in kept_postings(scored, settings).collect()} == {"a"}
    assert {r["link"] for r in worth_notifying(scored, settings).collect()} == {"a"}
    assert worth_notifying(scored, settings_of(doc)).collect() == []
    assert run_search(postings, Matching(PROFILE, LEXICON), str(tmp_path / "run"), settings=settings).count() == 2
    assert spark.read.options(**sinks.CSV_OPTIONS).csv(str(tmp_path / "run/jobs.csv")).first()["type"] == "Contract"


def test_link_list(spark, tmp_path):
    write(tmp_path / "links.csv", "note,link\na,https://www.XING.com/jobs/1\nb,\nc,https://nowhere.example/2\n")
    rows = runs.scan_link_list(spark, str(tmp_path / "links.csv")).orderBy("seq").collect()
    assert [(r["provider"], r["job_id"] != rows[1 - i]["job_id"]) for i, r in enumerate(rows)] == [("xing", True), ("linkedin", True)]
    assert rows[0]["search_criteria"] == "Manual | links.csv" and rows[0]["title"] == "Pending Extraction..."


def test_first_wins_with_a_hot_key(spark):
    rows = spark.range(30000).select(
        F.col("id").alias("seq"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id"))).alias("link"),
        F.when(F.col("id") % 3 == 0, "").alias("job_id"),
        F.lit("x").alias("provider"),
    )
    shuffled = rows.repartition(16, (F.col("seq") * 7919) % 16)
    got = dedup.dedup_in_run(shuffled)
    assert got.count() == 20001
    assert got.where("link = 'hot'").first()["seq"] == 0


def test_ids_of_two_portals_collide_unless_kept_apart(spark):
    df = spark.createDataFrame([(0, "1", "a", "hays"), (1, "1", "b", "xing"), (2, None, "a", "xing")], "seq long, job_id string, link string, provider string")
    assert {r["seq"] for r in dedup.dedup_in_run(df).collect()} == {0, 2}
    assert {r["seq"] for r in dedup.dedup_in_run(df, per_provider=True).collect()} == {0, 1, 2}


def test_numbering_matches_a_global_window(spark):
    df = spark.range(5000).select((F.col("id") * 8_589_934_592 + 5).alias("seq"), (F.col("id") % 3).cast("int").alias("relevance_score"))
    got = [r["rank"] for r in rank.number_rows(df, block=1000).orderBy(F.col("relevance_score").desc(), "seq").collect()]
    assert got == list(range(1, 5001))


@pytest.mark.parametrize("zone", ["UTC", "Europe/Vienna", "America/Los_Angeles"])
def test_times_do_not_depend_on_the_session_zone(spark, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        values = ["2025-01-02T03:04:05.123456+00:00", "2025-01-31T23:30:00", "2025-02-01T00:30:00+01:00", "2025-01-31", "garbage", "", None]
        df = spark.createDataFrame([(v,) for v in values], "s string")
        ts = sync.parse_utc(F.col("s"))
        months = [r[0] for r in df.select(sync.utc_format(ts, "yyyyMM dd HH:mm")).collect()]
        assert months == ["202501 02 03:04", "202501 31 23:30", "202501 31 23:30", "202501 31 00:00", None, None, None]
        now = F.lit("2025-07-31T00:00:00+00:00").cast("timestamp")
        parts = [r[0] for r in df.select(sync.retention_class(ts, now)).collect()]
        assert parts == ["archived"] * 4 + ["quarantine"] * 3
        # The cut is midnight UTC, on either side of a clock change.
        near = spark.createDataFrame([("2025-01-31T23:59:59",), ("2025-02-01T00:00:00",), ("2025-02-01T00:30:00",)], "s string")
        parts = [r[0] for r in near.select(sync.retention_class(ts, now)).collect()]
        assert parts == ["archived", "active", "active"]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_expired_runs(spark):
    df = spark.createDataFrame([("20250101_1010_x_y",), ("misc",), ("20250110_0000_x",), ("20251399_x",)], "run_id string")
    now = F.lit("2025-01-20 00:00:00").cast("timestamp_ntz")
    assert [r[0] for r in sync.expired_runs(df, now).collect()] == ["20250101_1010_x_y"]


def batch(spark, *rows):
    return spark.createDataFrame(list(rows), "run_id string, seq long, link string, title string, scraped_at string")


def test_sync_and_rotation(spark, tmp_path):
    master = str(tmp_path / "master")
    first = batch(
        spark, ("r1", 0, "a", "1", "2024-01-01T00:00:00"), ("r1", 1, "a", "2", "2024-01-01T00:00:00"),
        ("r1", 2, "", "3", "2024-01-01T00:00:00"), ("r0", 9, "b", "4", "2024-12-30T00:00:00"), ("r2", 0, "q", "5", "garbage"),
    )
    assert sync_master(first, master) == 3
    assert sync_master(first, master) == 0
    assert sync_master(batch(spark, ("r3", 0, "b", "x", ""), ("r3", 1, "c", "6", "2025-01-02T00:00:00")), master) == 1
    assert {(r["link"], r["title"]) for r in sinks.read_master(spark, master).collect()} == {("a", "1"), ("b", "4"), ("q", "5"), ("c", "6")}
    later = F.lit("2024-03-01T00:00:00+00:00").cast("timestamp")
    assert rotate(spark, master, str(tmp_path / "none"), str(tmp_path / "h0"), later) == (0, None)
    now = F.lit("2025-01-10T00:00:00+00:00").cast("timestamp")
    count, name = rotate(spark, master, str(tmp_path / "next"), str(tmp_path / "history"), now)
    assert (count, name) == (1, "202401_202401_archived_jobs")
    assert {r["link"] for r in sinks.read_master(spark, str(tmp_path / "next")).collect()} == {"b", "c"}
    assert spark.read.parquet(str(tmp_path / f"history/{name}_quarantine")).first()["link"] == "q"


def test_stream_equals_batch_and_survives_a_restart(spark, tmp_path):
    def runs_of(*ids):
        rows = [(f"r{i}", n, f"l{(i * 7 + n) % 11}", f"t{i}", "2024-01-01T00:00:00") for i in ids for n in range(5)]
        return batch(spark, *rows)

    source, master, mark = (str(tmp_path / p) for p in ("runs", "master", "mark"))
    for ids in ((0, 1), (2, 3)):
        runs_of(*ids).write.mode("append").partitionBy("run_id").json(source)
        start_sync(read_run_stream(spark, source, 1), master, mark, available_now=True).awaitTermination()
    # The same files again, as after a lost checkpoint: nothing is added.
    start_sync(read_run_stream(spark, source), master, str(tmp_path / "mark2"), available_now=True).awaitTermination()
    got = sorted(r["link"] for r in sinks.read_master(spark, master).collect())
    expected = sorted(r["link"] for r in sync.new_postings(runs_of(0, 1, 2, 3), sinks.read_master(spark, str(tmp_path / "empty"))).collect())
    assert got == expected


def test_keyed_stream_starts_from_the_master_and_survives_a_restart(spark, tmp_path):
    """First by order within a batch, first to arrive across batches, none of the master's links; whole rows."""
    def runs_of(*ids):
        rows = [(f"r{i}", n, f"l{(i * 7 + n) % 11}" if n else "", f"t{i}.{n}", "2024-01-01T00:00:00") for i in ids for n in range(5)]
        return batch(spark, *rows)

    source, master, mark = (str(tmp_path / p) for p in ("runs", "master", "mark"))
    sync_master(batch(spark, ("r", 0, "l1", "old", "2023-12-01T00:00:00")), master)
    for ids in ((2, 1), (0, 3), (1, 2)):
        runs_of(*ids).write.mode("append").partitionBy("run_id").json(source)
        start_keyed_sync(read_run_stream(spark, source), master, mark, available_now=True).awaitTermination()
    got = {(r["link"], r["title"]) for r in sinks.read_master(spark, master).collect()}
    want, seen = {("l1", "old")}, {"l1", ""}
    for ids in ((1, 2), (0, 3)):
        for r in runs_of(*ids).orderBy("run_id", "seq").collect():
            if r["link"] not in seen:
                want.add((r["link"], r["title"]))
                seen.add(r["link"])
    assert got == want and sinks.read_master(spark, master).count() == len(want)


def test_keyed_stream_repeats_no_batch_that_was_written(spark, tmp_path):
    """The process dies after a batch's rows were written, before the batch was committed."""
    source, master, mark = (str(tmp_path / p) for p in ("runs", "master", "mark"))
    batch(spark, ("r1", 0, "a", "1", ""), ("r1", 1, "b", "2", "")).write.partitionBy("run_id").json(source)
    start_keyed_sync(read_run_stream(spark, source), master, mark, available_now=True).awaitTermination()
    for name in ("0", ".0.crc"):
        (tmp_path / "mark/commits" / name).unlink()
    start_keyed_sync(read_run_stream(spark, source), master, mark, available_now=True).awaitTermination()
    assert sorted(r["link"] for r in sinks.read_master(spark, master).collect()) == ["a", "b"]


def test_keyed_stream_asks_the_state_once_for_all_links_of_a_group(spark, tmp_path, monkeypatch):
    """A batch's rows pass the state once, however often the append reads them; here all links are one group."""
    source, master, mark, log = (str(tmp_path / p) for p in ("runs", "master", "mark", "log"))

    class Logged(keyed.FirstOfLink):
        def handleInputRows(self, key, rows, timerValues):
            rows = list(rows)
            with open(log, "a") as f:
                f.write("".join(f"{key[0]} {r['link']}\n" for r in rows))
            return super().handleInputRows(key, iter(rows), timerValues)

    monkeypatch.setattr(keyed, "GROUPS", 1)
    monkeypatch.setattr(keyed, "FirstOfLink", Logged)
    sync_master(batch(spark, ("r", 0, "c", "old", "")), master)
    batches = [[("r1", 2, "a", "a2", ""), ("r1", 1, "a", "a1", ""), ("r1", 0, "b", "b0", ""), ("r1", 3, "c", "c3", "")],
               [("r2", 0, "b", "b1", ""), ("r2", 1, "d", "d1", "")]]
    for rows in batches:
        batch(spark, *rows).write.mode("append").partitionBy("run_id").json(source)
        start_keyed_sync(read_run_stream(spark, source), master, mark, available_now=True).awaitTermination()
    got = sorted((r["link"], r["title"]) for r in sinks.read_master(spark, master).collect())
    assert got == [("a", "a1"), ("b", "b0"), ("c", "old"), ("d", "d1")]
    assert sorted(open(log).read().splitlines()) == sorted(f"0 {r[2]}" for rows in batches for r in rows)


def test_rotation_in_place(spark, tmp_path):
    master, history = str(tmp_path / "master"), str(tmp_path / "history")
    rows = [("r", k, f"l{k}", str(k), f"2024-0{1 + k // 4}-{1 + 7 * (k % 4):02d}T00:00:00") for k in range(16)]
    sync_master(batch(spark, *rows, ("r", 99, "odd", "odd", "garbage")), master)
    files = {p: p.stat().st_mtime_ns for p in (tmp_path / "master").rglob("*.parquet")}
    at = lambda day: F.lit(f"{day}T00:00:00+00:00").cast("timestamp")

    def links():
        return {r["link"] for r in read_active(spark, master, history).collect()}

    assert len(links()) == 17 and rotate_in_place(spark, master, history, at("2024-01-05"), 180) == (0, None)
    # A rotation that ended before its record was written changes nothing, and is done again.
    spark.range(3).write.parquet(f"{history}/archives/202401_202402_archived_jobs-half")
    assert len(links()) == 17
    count, name = rotate_in_place(spark, master, history, at("2024-08-11"), 180)
    assert (count, name) == (6, "202401_202402_archived_jobs") and links() == {f"l{k}" for k in range(6, 16)}
    assert [m.rsplit("/", 1)[1] for m in stale_months(spark, master, history)] == ["month=202401"]
    assert rotate_in_place(spark, master, history, at("2024-08-11"), 180) == (0, None)
    # A link that was archived may return, as may one without a readable time; nothing else is hidden.
    again = batch(spark, ("s", 0, "l0", "new", "2024-08-11T00:00:00"), ("s", 1, "odd", "new", "garbage"), ("s", 2, "l9", "x", ""))
    new = sync.new_postings(again, read_active(spark, master, history))
    sinks.append_master(new, master)
    assert links() == {f"l{k}" for k in [0, *range(6, 16)]} | {"odd"}
    assert rotate_in_place(spark, master, history, at("2024-09-01"), 180) == (3, "202402_202403_archived_jobs")
    assert all(p.stat().st_mtime_ns == t for p, t in files.items())
    archived = [r["link"] for p in (tmp_path / "history/records").glob("*/*.json") for r in spark.read.parquet(json.loads(p.read_text())["folder"]).collect()]
    assert sorted(archived) == sorted(f"l{k}" for k in range(9))


def test_arrival_order_makes_its_input_once(spark, tmp_path):
    """Range partitioning samples its input; what made the rows must not run again for that."""
    log = str(tmp_path / "log")

    @F.udf("long")
    def made(x):
        with open(log, "a") as f:
            f.write(f"{x}\n")
        return 99 - x

    rows = runs.with_arrival_order(spark.range(100, numPartitions=4).select(made("id").alias("at"), "id"), "at").collect()
    assert [r["at"] for r in sorted(rows, key=lambda r: r["seq"])] == list(range(100)) and len({r["seq"] for r in rows}) == 100
    assert sorted(map(int, open(log).read().split())) == list(range(100))


def test_bounded_state_stream(spark, tmp_path):
    batch(spark, *[(f"r{i}", i, f"l{i % 3}", "t", "2024-01-01T00:00:00") for i in range(9)]).write.json(str(tmp_path / "in"))
    stream = read_run_stream(spark, str(tmp_path / "in")).withColumn("ts", sync.parse_utc(F.col("scraped_at")))
    query = (
        first_within(stream, "ts", "1 day").writeStream.format("memory").queryName("bounded")
        .trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    )
    query.awaitTermination()
    assert sorted(r["link"] for r in spark.table("bounded").collect()) == ["l0", "l1", "l2"]


def test_search_run_writes_every_format(spark, tmp_path):
    rows = [(i, f"j{i % 8}", f"l{i}", "Winzer Test" if i % 2 else "Junior Winzer", "Rebland Kellerei", "R remote", "Wien", "hays") for i in range(20)]
    df = spark.createDataFrame(rows, "seq long, job_id string, link string, title string, company string, description string, location string, provider string")
    settings = RunSettings(min_relevance_score=20, exclude_keywords=("junior",), formats=("csv", "json", "markdown"), base_filename="best")
    top = run_search(df, Matching(PROFILE, LEXICON), str(tmp_path / "run"), settings=settings).collect()
    assert len(top) == 5 and top[0]["relevance_score"] >= top[-1]["relevance_score"]
    raw = spark.read.options(**sinks.CSV_OPTIONS).csv(str(tmp_path / "run/all_jobs_raw.csv"))
    assert raw.columns == HEADERS and raw.count() == 8
    best = spark.read.options(**sinks.CSV_OPTIONS).csv(str(tmp_path / "run/best.csv"))
    assert best.count() == 4 and {r["title"] for r in best.collect()} == {"Winzer Test"}
    assert spark.read.json(str(tmp_path / "run/best.json")).count() == 4
    assert sum(r[0].startswith("### ") for r in spark.read.text(str(tmp_path / "run/best.md")).collect()) == 4
