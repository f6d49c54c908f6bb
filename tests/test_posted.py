"""Publication dates by hand."""

import datetime

from pyspark.sql import functions as F

from stellwerk.functions.posted import posted_range

AT = "2024-03-01 05:30:00"
CASES = [
    ("vor 3 Tagen", "02-26", "02-27"), ("3 days ago", "02-26", "02-27"), ("vor einem Tag", "02-28", "02-29"), ("an hour ago", "03-01", "03-01"),
    ("vor 5 h", "02-29", "03-01"), ("vor 6 Stunden", "02-29", "02-29"), ("2 weeks ago", "02-09", "02-16"), ("vor 1 Monat", "01-01", "02-01"),
    ("30+ days ago", None, "01-31"), ("heute 12", "03-01", "03-01"), ("Gestern", "02-29", "02-29"), ("Online seit 29.02.", "02-29", "02-29"),
    ("12.02.24", "02-12", "02-12"), ("2024-02-10", "02-10", "02-10"), ("10. 2. 2024", "02-10", "02-10"), ("45 Minuten", "03-01", "03-01"),
]


def test_dates_relative_to_the_scrape(spark):
    odd = ["Recent", "", None, "31.02.2024", "vor Kurzem", "99", "v1.2.3"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate([c[0] for c in CASES] + odd + ["Seit 24.12."])], "i int, t string")
    rows = df.select("i", posted_range(F.col("t"), F.lit(AT).cast("timestamp")).alias("r")).collect()
    got = {r["i"]: r["r"] and tuple(r["r"]) for r in rows}
    day = lambda x: x and datetime.date.fromisoformat(f"2024-{x}")
    for i, (text, first, last) in enumerate(CASES):
        assert got[i] == (day(first), day(last)), text
    assert [got[len(CASES) + k] for k in range(len(odd))] == [None] * len(odd)
    assert got[len(CASES) + len(odd)] == (datetime.date(2023, 12, 24),) * 2
