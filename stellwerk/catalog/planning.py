"""Search planning: every supplier is a search profile, its attributes the settings."""

from __future__ import annotations

from pyspark.sql import functions as F

from stellwerk import fixed
from stellwerk.catalog import Catalog
from stellwerk.catalog.base import quoted, table
from stellwerk.functions.links import provider_key, provider_or_fallback
from stellwerk.operators import search
from stellwerk.operators.cards import search_criteria

KEYS = [p[0] for p in fixed.PROVIDERS]
REGISTRY = ", ".join(
    f"({i}, {quoted(k)}, {quoted(d)}, {n})" for i, (k, d, _, n) in enumerate(fixed.PROVIDERS)
)


def profiles(spark, sf):
    """Portal i is configured when bit i of the nation's number is set, and enabled for
    suppliers in credit; every other portal limits or narrows its search."""
    n, s = table(spark, sf, "nation"), table(spark, sf, "supplier")
    rows = s.join(n, F.col("s_nationkey") == F.col("n_nationkey"))
    configured = F.filter(
        F.array(
            *[
                F.struct(
                    F.lit(k).alias("key"),
                    F.struct(
                        (F.col("s_acctbal") > (i - 3) * 1000).alias("enabled"),
                        (F.lit(10 + i) if i % 2 else F.lit(None).cast("int")).alias("max_results"),
                        F.lit(20 - i).alias("priority"),
                        (F.array(F.col("n_name"), F.lit("Remote")) if i % 3 == 1 else F.lit(None).cast("array<string>"))
                        .alias("locations"),
                    ).alias("value"),
                    F.lit(i).alias("bit"),
                )
                for i, k in enumerate(KEYS)
            ]
        ),
        lambda x: (F.col("s_nationkey") + F.lit(17)).bitwiseAND(F.pow(F.lit(2), x["bit"]).cast("int")) != 0,
    )
    return rows.select(
        F.col("s_name").alias("profile"),
        F.map_from_entries(F.transform(configured, lambda x: F.struct(x["key"], x["value"]))).alias("active_providers"),
        F.struct(F.array(F.lit("Germany"), F.lit("Slovakia"), F.lit("remote"), F.col("n_name")).alias("locations")).alias(
            "search_parameters"
        ),
        F.array(F.concat(F.lit("Engineer "), F.col("s_name")), F.lit("Tester")).alias("search_queries"),
    )


PROFILE_SQL = f"""
SELECT s.s_name AS profile, n.n_name, r.ord, r.provider, r.display_name, r.default_limit,
       s.s_acctbal > (r.ord - 3) * 1000 AS enabled,
       CASE WHEN r.ord % 2 = 1 THEN 10 + r.ord END AS max_results,
       20 - r.ord AS priority,
       CASE WHEN r.ord % 3 = 1 THEN [n.n_name, 'Remote'] ELSE ['Germany', 'Slovakia', 'remote', n.n_name] END AS locations,
       ((s.s_nationkey + 17) & (1 << r.ord)) <> 0 AS configured
FROM supplier s JOIN nation n ON s.s_nationkey = n.n_nationkey,
     (VALUES {REGISTRY}) r(ord, provider, display_name, default_limit)
"""
RESOLVED_SQL = f"SELECT *, coalesce(max_results, default_limit) AS result_limit FROM ({PROFILE_SQL}) WHERE configured AND enabled"
PLAN_SQL = f"""
SELECT profile, ord, provider, result_limit, query_no, query, location_no, locations[location_no + 1] AS location FROM (
  SELECT *, unnest(range(len(locations))) AS location_no FROM (
    SELECT *, unnest([0, 1]) AS query_no, unnest([concat('Engineer ', profile), 'Tester']) AS query FROM ({RESOLVED_SQL})))
"""


def localise_sql(provider: str, location: str) -> str:
    cases = []
    for key, names in fixed.LOCATION_NAMES.items():
        inner = " ".join(f"WHEN {quoted(a)} THEN {quoted(b)}" for a, b in names.items())
        cases.append(
            f"WHEN {quoted(key)} THEN CASE {location} {inner} ELSE {quoted(fixed.LOCATION_DEFAULTS[key])} END"
        )
    return f"CASE {provider} {' '.join(cases)} ELSE {location} END"


def register(c: Catalog) -> None:
    @c.add("provider_resolution", f"SELECT profile, ord, provider, display_name, cast(result_limit AS INTEGER) AS result_limit FROM ({RESOLVED_SQL})")
    def provider_resolution(spark, sf):
        resolved = search.resolve_providers(profiles(spark, sf))
        return resolved.select("profile", "ord", "provider", "display_name", "result_limit")

    @c.add(
        "provider_priority",
        f"SELECT profile, provider, cast(priority * 8 + ord AS INTEGER) AS ord FROM ({RESOLVED_SQL})",
    )
    def provider_priority(spark, sf):
        return search.resolve_providers(profiles(spark, sf), by_priority=True).select("profile", "provider", "ord")

    @c.add(
        "search_plan",
        f"""SELECT profile, cast(ord AS INTEGER) AS ord, provider, cast(result_limit AS INTEGER) AS result_limit,
                   cast(query_no AS INTEGER) AS query_no, query, cast(location_no AS INTEGER) AS location_no, location,
                   CASE WHEN provider = 'linkedin' AND lower(location) = 'remote' THEN 'Germany'
                        ELSE {localise_sql('provider', 'location')} END AS target_location,
                   provider = 'linkedin' AND lower(location) = 'remote' AS remote_search
            FROM ({PLAN_SQL})""",
    )
    def search_plan(spark, sf):
        return search.search_plan(profiles(spark, sf))

    @c.add(
        "search_plan_collapsed",
        f"""SELECT DISTINCT profile, provider, query, CASE WHEN provider IN ('hays', 'xing') THEN 'All Locations' ELSE location END AS location
            FROM ({PLAN_SQL})""",
    )
    def search_plan_collapsed(spark, sf):
        plan = search.search_plan(profiles(spark, sf), without_location_filter=("hays", "xing"))
        return plan.select("profile", "provider", "query", "location").distinct()

    @c.add(
        "search_criteria",
        f"SELECT profile, provider, concat(query, ' | ', location) AS search_criteria FROM ({PLAN_SQL})",
    )
    def search_criteria_(spark, sf):
        plan = search.search_plan(profiles(spark, sf))
        return plan.select("profile", "provider", search_criteria(F.col("query"), F.col("location")).alias("search_criteria"))

    @c.add(
        "forced_providers",
        f"""SELECT profile, provider, cast(result_limit AS INTEGER) AS result_limit FROM (
              SELECT profile, provider, configured,
                     CASE WHEN configured THEN coalesce(max_results, default_limit) ELSE 20 END AS result_limit
              FROM ({PROFILE_SQL})
            ) WHERE provider IN ('hays', 'gulp', 'xing')""",
    )
    def forced_providers(spark, sf):
        forced = search.force_providers(profiles(spark, sf), ["Hays", "gulp", "XING", "unknown"])
        return search.resolve_providers(forced).select("profile", "provider", "result_limit")

    locations = f"(SELECT c_custkey, c_nationkey % 8 AS p, CASE c_mktsegment WHEN 'BUILDING' THEN 'Germany' WHEN 'MACHINERY' THEN 'Poland' WHEN 'HOUSEHOLD' THEN 'remote' ELSE c_name END AS location FROM customer)"
    provider_case = "CASE p " + " ".join(f"WHEN {i} THEN {quoted(k)}" for i, k in enumerate(KEYS)) + " END"

    def customers(spark, sf):
        rows = table(spark, sf, "customer").withColumn("p", F.col("c_nationkey") % 8)
        provider = F.element_at(F.lit(KEYS), F.col("p") + 1)
        segment = F.col("c_mktsegment")
        location = (
            F.when(segment == "BUILDING", "Germany").when(segment == "MACHINERY", "Poland")
            .when(segment == "HOUSEHOLD", "remote").otherwise(F.col("c_name"))
        )
        return rows.select("c_custkey", provider.alias("provider"), location.alias("location"))

    @c.add(
        "localise",
        f"""SELECT c_custkey, provider, location, {localise_sql('provider', 'location')} AS localised
            FROM (SELECT c_custkey, {provider_case} AS provider, location FROM {locations})""",
    )
    def localise(spark, sf):
        value = search.localise(F.col("provider"), F.col("location"))
        return customers(spark, sf).withColumn("localised", value)

    @c.add(
        "remote_search",
        f"""SELECT c_custkey, provider = 'linkedin' AND lower(location) = 'remote' AS remote_search,
                   CASE WHEN provider = 'linkedin' AND lower(location) = 'remote' THEN 'Germany'
                        ELSE {localise_sql('provider', 'location')} END AS target_location
            FROM (SELECT c_custkey, {provider_case} AS provider, location FROM {locations})""",
    )
    def remote_search(spark, sf):
        p, l = F.col("provider"), F.col("location")
        return customers(spark, sf).select(
            "c_custkey",
            search.is_remote_search(p, l).alias("remote_search"),
            search.target_location(p, l).alias("target_location"),
        )

    names = [x for k, d, _, _ in fixed.PROVIDERS for x in (k.upper(), d)] + ["nobody"]
    by_key = " ".join(f"WHEN {quoted(k)} THEN {quoted(k)}" for k in KEYS)
    by_display = " ".join(f"WHEN {quoted(d.lower())} THEN {quoted(k)}" for k, d, _, _ in fixed.PROVIDERS)
    name_sql = f"([{', '.join(quoted(n) for n in names)}])[o_orderkey % {len(names)} + 1]"

    @c.add(
        "display_name_lookup",
        f"""SELECT o_orderkey, name, key, coalesce(key, 'linkedin') AS used FROM (
              SELECT o_orderkey, name, coalesce(CASE lower(name) {by_key} END, CASE lower(name) {by_display} END) AS key
              FROM (SELECT o_orderkey, {name_sql} AS name FROM orders))""",
    )
    def display_name_lookup(spark, sf):
        index = (F.col("o_orderkey") % len(names) + 1).cast("int")
        rows = table(spark, sf, "orders").select("o_orderkey", F.element_at(F.lit(names), index).alias("name"))
        return rows.withColumns({"key": provider_key(F.col("name")), "used": provider_or_fallback(F.col("name"))})

    @c.add(
        "run_ids",
        f"""SELECT profile, concat_ws('_', strftime(TIMESTAMP '2024-03-05 07:09:00', '%Y%m%d_%H%M'),
                   replace(replace(profile, 'user_', ''), '_search', ''), array_to_string(list_sort(list(provider)), '_')) AS run_id
            FROM (SELECT concat('user_', profile, '_search') AS profile, provider FROM ({RESOLVED_SQL})) GROUP BY profile""",
    )
    def run_ids(spark, sf):
        """At most one row per portal and profile meets in a group."""
        resolved = search.resolve_providers(profiles(spark, sf))
        named = resolved.select(F.concat(F.lit("user_"), "profile", F.lit("_search")).alias("profile"), "provider")
        started = F.lit("2024-03-05 07:09:00").cast("timestamp_ntz")
        return (
            named.groupBy("profile").agg(F.collect_list("provider").alias("providers"))
            .select("profile", search.run_id(started, F.col("profile"), F.col("providers")).alias("run_id"))
        )
