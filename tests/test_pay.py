"""Pay ranges by hand, and filters on them."""

import pytest
from pyspark.sql import functions as F

from stellwerk.functions.pay import reaches, yearly_pay

CASES = [
    ("€80k", (80000, 80000)), ("95.000 €", (95000, 95000)), ("$120K", (120000, 120000)), ("EUR", None), ("", None), (None, None),
    ("60.000 - 75.000 € pro Jahr", (60000, 75000)), ("€60-75k", (60000, 75000)), ("EUR 70,000 to EUR 85,500 per year", (70000, 85500)),
    ("4.500 € monatlich", (54000, 54000)), ("Stundensatz 95 €", (197600, 197600)), ("95 €/h", (197600, 197600)),
    ("22,50 € pro Stunde", (46800, 46800)), ("Tagessatz: 800 €", (208000, 208000)), ("1.200,50 EUR/Monat", (14406, 14406)),
    ("75 bis 60 k€", (60000, 75000)), ("CHF 110'000 p.a.", (110000, 110000)), ("50", (104000, 104000)), ("900", (234000, 234000)),
    ("5000", (60000, 60000)), ("48000", (48000, 48000)), ("100% remote", None), ("70 000 €", (70000, 70000)),
    ("75.000 bis 60.000 €", (60000, 75000)),
]


def test_yearly_pay(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CASES)], "i int, t string")
    got = {r["i"]: r["p"] for r in df.select("i", yearly_pay(F.col("t")).alias("p")).collect()}
    for i, (text, want) in enumerate(CASES):
        assert (got[i] and (round(got[i]["low"]), round(got[i]["high"]))) == want, text


@pytest.mark.parametrize("unknown, kept", [(True, ["€80k", "€60-75k", "EUR", None]), (False, ["€80k", "€60-75k"])])
def test_least_pay(spark, unknown, kept):
    df = spark.createDataFrame([(t,) for t in ("€80k", "€60-75k", "€60k", "EUR", None)], "t string")
    assert [r["t"] for r in df.where(reaches(F.col("t"), 70_000, unknown)).collect()] == kept
