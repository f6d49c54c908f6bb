"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line."""

from __future__ import annotations

import json
import os
import tempfile
import time

from stellwerk.catalog import build
from stellwerk.session import build_session

HEADLINE = [
    "postings_ranked",
    "skill_match",
    "skill_match_join",
    "skill_match_automaton",
    "language_vote",
    "dedup_in_run",
    "dedup_cross_run",
    "detail_merge",
    "two_pass_enrich",
    "report_numbers",
    "search_plan",
    "incremental_sync",
    "retention_split",
    "page_text",
    "linkedin_cards",
    "freelancermap_details",
]


def spread(spark, sf: str, files: int) -> str:
    """A copy of the input in which the text tables lie in several files.

    The small text tables are single row groups, which one task would read; at cluster size
    files have row groups in plenty, so the engine itself does not deal rows anew.
    """
    out = tempfile.mkdtemp(prefix="bench-")
    for entry in os.listdir(sf):
        name = entry.removesuffix(".parquet")
        if name in ("documents", "pages"):
            spark.read.parquet(f"{sf}/{entry}").repartition(files).write.parquet(f"{out}/{entry}")
        elif entry.endswith(".parquet"):
            os.symlink(os.path.join(os.path.abspath(sf), entry), f"{out}/{entry}")
    return out


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
        spark__driver__memory="8g",
        spark__sql__shuffle__partitions=cpus,
    )
    spark.sparkContext.setLogLevel("ERROR")
    catalog, first, second = build(), {}, {}
    data = spread(spark, sf, int(cpus))
    # One query outside the timed set starts the executor threads and loads classes.
    catalog.queries["scoring_text"](spark, data).write.format("noop").mode("overwrite").save()
    for spent in (first, second):
        for name in HEADLINE:
            start = time.perf_counter()
            catalog.queries[name](spark, data).write.format("noop").mode("overwrite").save()
            spent[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(first.values()), 3),
                "unit": "sec",
                "queries": first,
                "second_run": second,
                "second_total": round(sum(second.values()), 3),
                "sf": os.path.basename(sf.rstrip("/")),
            }
        )
    )


if __name__ == "__main__":
    main()
