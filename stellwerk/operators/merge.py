"""Detail-page data laid over list data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from stellwerk.operators.dedup import first_by_key
from stellwerk.schema import DETAIL_FIELDS


def overlay(new: Column, old: Column, keep_nonempty: bool = False) -> Column:
    """``new`` where the page gave the field, even as ''. NULL leaves ``old``."""
    present = new.isNotNull() & (new != "") if keep_nonempty else new.isNotNull()
    return F.when(present, new).otherwise(old)


def merge_details(
    df: DataFrame, details: DataFrame, keep_nonempty: bool = False, order: str | None = None
) -> DataFrame:
    """Left join on ``link``; detail fields that are present replace the posting's.

    Of several detail rows of a link the first counts: by ``order`` where given, else the
    smallest row; rows without a link are left out. The detail side is therefore unique on the
    key, so a link shared by many postings only widens the left side, which adaptive execution splits.
    ``keep_nonempty`` protects list text from pages that came back empty.
    """
    fields = [f for f in DETAIL_FIELDS if f in details.columns]
    linked = details.where(F.coalesce(F.col("link"), F.lit("")) != "")
    narrow = linked.select("link", *fields, *([order] if order and order not in fields else []))
    right = first_by_key(narrow, ["link"], [order or "link"]).select("link", F.struct(*fields).alias("_d"))
    joined = df.join(right, "link", "left")
    current = {f: F.col(f) if f in df.columns else F.lit(None).cast("string") for f in fields}
    merged = joined.withColumns({f: overlay(F.col("_d")[f], current[f], keep_nonempty) for f in fields})
    return merged.drop("_d")
