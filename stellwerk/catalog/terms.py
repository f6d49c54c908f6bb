"""Pay and publication dates: texts made by rule from the tables' numbers, so that SQL knows what they say."""

from __future__ import annotations

from pyspark.sql import functions as F

from stellwerk.catalog import Catalog
from stellwerk.catalog.base import table
from stellwerk.functions.pay import reaches, yearly_pay
from stellwerk.functions.posted import posted_range, posted_since
from stellwerk.operators.filters import least_pay

FLOOR = 70_000
SINCE = "2024-01-10"

#: k is 30 to 119: text, low and high of a year.
PAY = (
    ("concat('€', k, 'k')", "k * 1000", "k * 1000"),
    ("concat(k, '.500 € pro Jahr')", "k * 1000 + 500", "k * 1000 + 500"),
    ("concat('Stundensatz ', k, ' €')", "k * 2080", "k * 2080"),
    ("concat(k, '-', k + 15, 'k EUR')", "k * 1000", "(k + 15) * 1000"),
    ("concat(k * 50, ',50 EUR/Monat')", "(k * 50 + 0.5) * 12", "(k * 50 + 0.5) * 12"),
    ("'VB'", "NULL", "NULL"),
    ("concat('Tagessatz: ', k * 10, ' €')", "k * 2600", "k * 2600"),
    ("concat('USD ', k + 20, ',000 to USD ', k, ',000 per year')", "k * 1000", "(k + 20) * 1000"),
    ("concat(k, ' bis ', k + 1, ' € pro Stunde')", "k * 2080", "(k + 1) * 2080"),
)
#: k is 1 to 20, at the time of the event: text, first and last day.
POSTED = (
    ("concat('vor ', k, ' Tagen')", "seen - INTERVAL 1 DAY * (k + 1)", "seen - INTERVAL 1 DAY * k"),
    ("concat(k, ' hours ago')", "seen - INTERVAL 1 HOUR * (k + 1)", "seen - INTERVAL 1 HOUR * k"),
    ("concat('Online seit ', strftime(seen - INTERVAL 1 DAY * k, '%d.%m.'))", "seen - INTERVAL 1 DAY * k", "seen - INTERVAL 1 DAY * k"),
    ("concat(k, ' Wochen')", "seen - INTERVAL 7 DAY * (k + 1)", "seen - INTERVAL 7 DAY * k"),
    ("'Recent'", "NULL", "NULL"),
    ("concat('vor ', k, ' Monaten')", "seen - INTERVAL 1 MONTH * (k + 1)", "seen - INTERVAL 1 MONTH * k"),
    ("'gestern'", "seen - INTERVAL 1 DAY", "seen - INTERVAL 1 DAY"),
    ("concat(k, '+ days ago')", "NULL", "seen - INTERVAL 1 DAY * k"),
    ("strftime(seen - INTERVAL 1 DAY * k, '%Y-%m-%d')", "seen - INTERVAL 1 DAY * k", "seen - INTERVAL 1 DAY * k"),
    ("'an hour ago'", "seen - INTERVAL 2 HOUR", "seen - INTERVAL 1 HOUR"),
    ("'Heute online'", "seen", "seen"),
)


def _choice(of: str, rows, place: int) -> str:
    cases = " ".join(f"WHEN {i} THEN {r[place]}" for i, r in enumerate(rows))
    return f"CASE {of} % {len(rows)} {cases} END"


PAY_SQL = f"""
SELECT doc_id, {_choice('doc_id', PAY, 0)} AS pay, cast({_choice('doc_id', PAY, 1)} AS DOUBLE) AS low,
       cast({_choice('doc_id', PAY, 2)} AS DOUBLE) AS high FROM (SELECT doc_id, n_chars % 90 + 30 AS k FROM documents)
"""
POSTED_SQL = f"""
SELECT event_id, seen, {_choice('event_id', POSTED, 0)} AS posted, cast({_choice('event_id', POSTED, 1)} AS DATE) AS first,
       cast({_choice('event_id', POSTED, 2)} AS DATE) AS last FROM (SELECT event_id, ts AS seen, user_id % 20 + 1 AS k FROM events)
"""


def pay_texts(spark, sf):
    rows = table(spark, sf, "documents").selectExpr("doc_id", "n_chars % 90 + 30 AS k")
    return rows.selectExpr("doc_id", f"{_choice('doc_id', PAY, 0)} AS salary_hint")


def posted_texts(spark, sf):
    """The same texts; the days are formatted by Spark."""
    rows = table(spark, sf, "events").selectExpr("event_id", "ts AS seen", "cast(user_id % 20 + 1 AS INT) AS k")
    day = F.date_sub(F.to_date("seen"), F.col("k"))
    rows = rows.withColumns({"dotted": F.date_format(day, "dd.MM."), "iso": F.date_format(day, "yyyy-MM-dd")})
    texts = _choice("event_id", POSTED, 0).replace("strftime(seen - INTERVAL 1 DAY * k, '%d.%m.')", "dotted")
    texts = texts.replace("strftime(seen - INTERVAL 1 DAY * k, '%Y-%m-%d')", "iso")
    return rows.select("event_id", F.col("seen").cast("timestamp").alias("seen"), F.expr(texts).alias("posted_at_relative"))


def register(c: Catalog) -> None:
    @c.add("yearly_pay", f"SELECT doc_id, pay AS salary_hint, low, high FROM ({PAY_SQL})")
    def yearly_pay_(spark, sf):
        pay = yearly_pay(F.col("salary_hint"))
        return pay_texts(spark, sf).withColumn("p", pay).select("doc_id", "salary_hint", "p.low", "p.high")

    @c.add("salary_floor", f"SELECT doc_id FROM ({PAY_SQL}) WHERE high >= {FLOOR} OR high IS NULL")
    def salary_floor(spark, sf):
        return pay_texts(spark, sf).where(least_pay(FLOOR)).select("doc_id")

    @c.add("salary_floor_known", f"SELECT doc_id FROM ({PAY_SQL}) WHERE high >= {FLOOR}")
    def salary_floor_known(spark, sf):
        return pay_texts(spark, sf).where(reaches(F.col("salary_hint"), FLOOR, unknown=False)).select("doc_id")

    @c.add("posted_range", f"SELECT event_id, posted, strftime(first, '%Y-%m-%d') AS first, strftime(last, '%Y-%m-%d') AS last FROM ({POSTED_SQL})")
    def posted_range_(spark, sf):
        read = posted_texts(spark, sf).withColumn("r", posted_range(F.col("posted_at_relative"), F.col("seen")))
        first, last = (F.date_format(F.col(f"r.{x}"), "yyyy-MM-dd").alias(x) for x in ("first", "last"))
        return read.select("event_id", F.col("posted_at_relative").alias("posted"), first, last)

    @c.add("posted_within", f"SELECT event_id FROM ({POSTED_SQL}) WHERE last >= DATE '{SINCE}'")
    def posted_within(spark, sf):
        day = F.lit(SINCE).cast("date")
        return posted_texts(spark, sf).where(posted_since(F.col("posted_at_relative"), F.col("seen"), day)).select("event_id")

    @c.add("posted_unreadable", f"SELECT posted AS posted_at_relative, count(*) AS n FROM ({POSTED_SQL}) WHERE last IS NULL GROUP BY posted")
    def posted_unreadable(spark, sf):
        read = posted_texts(spark, sf).where(posted_range(F.col("posted_at_relative"), F.col("seen")).isNull())
        return read.groupBy("posted_at_relative").agg(F.count(F.lit(1)).alias("n"))
