"""First-wins deduplication.

The winner of a key is the minimum of (order columns, row): an aggregate, so every
map task first reduces each key to one row. A key holding a large share of all rows
costs one row per map task in the shuffle, where a ranking window would send all of
its rows to one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType

RUN_KEY = ["job_id", "link"]


def run_key() -> Column:
    """In-run identity: the posting id, or the link where there is none."""
    return F.coalesce(F.nullif(F.col("job_id"), F.lit("")), F.col("link"))


def _holds_map(kind: DataType) -> bool:
    if isinstance(kind, StructType):
        return any(_holds_map(f.dataType) for f in kind.fields)
    return _holds_map(kind.elementType) if isinstance(kind, ArrayType) else isinstance(kind, MapType)


def first_by_key(df: DataFrame, key: list[str] | list[Column], order: list[str]) -> DataFrame:
    """Keep the first row per key in ``order``; columns keep their sequence."""
    keys = [F.col(k) if isinstance(k, str) else k for k in key]
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    if _holds_map(df.schema):  # maps have no order
        best = F.min_by(row, F.struct(*order))
    else:
        best = F.min(F.struct(*order, row.alias("_row")))["_row"]
    grouped = df.groupBy(*[k.alias(f"_k{i}") for i, k in enumerate(keys)]).agg(best.alias("_row"))
    return grouped.select("_row.*")


def dedup_in_run(df: DataFrame, order: list[str] | None = None, per_provider: bool = False) -> DataFrame:
    """First posting per in-run identity.

    By default the identity spans portals, so equal ids of two portals are one
    posting; ``per_provider`` keeps them apart.
    """
    key = ([F.col("provider")] if per_provider else []) + [run_key()]
    return first_by_key(df, key, order or ["seq"])


def count_unique(df: DataFrame) -> DataFrame:
    """One row, ``unique_postings``: what :func:`dedup_in_run` keeps, postings without id and link being one."""
    return df.groupBy(run_key().alias("_k")).agg(F.lit(1).alias("_one")).agg(F.count(F.lit(1)).alias("unique_postings"))


def dedup_by_link(df: DataFrame, order: list[str] | None = None) -> DataFrame:
    """First posting per non-empty link, over all runs."""
    linked = df.where(F.coalesce(F.col("link"), F.lit("")) != "")
    return first_by_key(linked, ["link"], order or ["run_id", "seq"])
