"""Search planning: which portal is asked for what, where.

One row per search profile goes in. Registry, queries and locations are exploded from
that row, so planning is a narrow transformation however many profiles there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from stellwerk import fixed
from stellwerk.schema import PROVIDER_CONF

CONF_TYPE = PROVIDER_CONF.simpleString()


def _registry(registry) -> Column:
    return F.array(
        *[
            F.struct(
                F.lit(i).alias("ord"),
                F.lit(key).alias("provider"),
                F.lit(display).alias("display_name"),
                F.lit(limit).alias("default_limit"),
            )
            for i, (key, display, _, limit) in enumerate(registry)
        ]
    )


def force_providers(profiles: DataFrame, names: list[str] | Column, column: str = "active_providers") -> DataFrame:
    """Disable every configured portal, enable the named ones; unlisted names get limit 20."""
    forced = F.transform(names if isinstance(names, Column) else F.lit(list(names)), F.lower)
    current = F.coalesce(F.col(column), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast(f"array<{CONF_TYPE}>")))
    switched = F.transform_values(
        current, lambda k, conf: conf.withField("enabled", F.array_contains(forced, k))
    )
    added = F.array_except(forced, F.map_keys(current))
    fresh = F.struct(
        F.lit(True).alias("enabled"),
        F.lit(fixed.FORCED_PROVIDER_LIMIT).alias("max_results"),
        F.lit(None).cast("int").alias("priority"),
        F.lit(None).cast("array<string>").alias("locations"),
    )
    return profiles.withColumn(
        column, F.map_concat(switched, F.map_from_arrays(added, F.transform(added, lambda _: fresh)))
    )


def resolve_providers(profiles: DataFrame, registry=tuple(fixed.PROVIDERS), by_priority: bool = False) -> DataFrame:
    """Enabled portals of each profile with their limit, numbered in registry order.

    ``by_priority`` orders by the configured priority first.
    """
    conf = F.try_element_at(F.col("active_providers"), F.col("_r.provider"))
    out = (
        profiles.withColumn("_r", F.explode(_registry(registry)))
        .withColumn("_conf", conf)
        .where(F.coalesce(F.col("_conf.enabled"), F.lit(False)))
    )
    rank = F.coalesce(F.col("_conf.priority"), F.lit(len(registry))) * F.lit(len(registry)) + F.col("_r.ord")
    return out.select(
        *profiles.columns,
        (rank if by_priority else F.col("_r.ord")).alias("ord"),
        F.col("_r.provider").alias("provider"),
        F.col("_r.display_name").alias("display_name"),
        F.coalesce(F.col("_conf.max_results"), F.col("_r.default_limit")).alias("result_limit"),
        F.col("_conf.locations").alias("provider_locations"),
    )


def localise(provider: Column, location: Column) -> Column:
    """Location as the portal spells it; portals without a table take it as given."""
    chain = F
    for key, names in fixed.LOCATION_NAMES.items():
        table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
        known = F.try_element_at(table, location)
        chain = chain.when(provider == key, F.coalesce(known, F.lit(fixed.LOCATION_DEFAULTS[key])))
    return chain.otherwise(location)


def is_remote_search(provider: Column, location: Column) -> Column:
    """LinkedIn takes "remote" as a flag on a Germany-wide search."""
    return (provider == "linkedin") & (F.lower(location) == "remote")


def target_location(provider: Column, location: Column) -> Column:
    return F.when(is_remote_search(provider, location), F.lit("Germany")).otherwise(localise(provider, location))


def search_plan(
    profiles: DataFrame, registry=tuple(fixed.PROVIDERS), without_location_filter: tuple[str, ...] = ()
) -> DataFrame:
    """One row per portal, query and location of each profile.

    A portal's own locations replace the profile's; portals named in
    ``without_location_filter`` are asked once per query.
    """
    resolved = resolve_providers(profiles, registry)
    queries = F.coalesce(F.col("search_queries"), F.lit(fixed.DEFAULT_QUERIES))
    general = F.coalesce(F.col("search_parameters.locations"), F.lit(fixed.DEFAULT_LOCATIONS))
    locations = F.coalesce(F.col("provider_locations"), general)
    if without_location_filter:
        whole = F.lit([fixed.NO_LOCATION_FILTER])
        locations = F.when(F.col("provider").isin(*without_location_filter), whole).otherwise(locations)
    return (
        resolved.withColumn("_locations", locations)
        .select("profile", "ord", "provider", "result_limit", "_locations", F.posexplode(queries).alias("query_no", "query"))
        .select(
            "profile", "ord", "provider", "result_limit", "query_no", "query",
            F.posexplode("_locations").alias("location_no", "location"),
        )
        .withColumns(
            {
                "target_location": target_location(F.col("provider"), F.col("location")),
                "remote_search": is_remote_search(F.col("provider"), F.col("location")),
            }
        )
    )


def run_id(started_at: Column, profile: Column, providers: Column) -> Column:
    """``yyyyMMdd_HHmm_<profile>_<portals>``, portals sorted; ``started_at`` without zone, in UTC."""
    base = F.replace(F.replace(profile, F.lit("user_"), F.lit("")), F.lit("_search"), F.lit(""))
    return F.concat_ws(
        "_", F.date_format(started_at, "yyyyMMdd_HHmm"), base, F.array_join(F.array_sort(providers), "_")
    )
