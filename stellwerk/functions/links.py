"""Links: portal recognition, canonical form, ids."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from stellwerk.fixed import DOMAINS, FALLBACK_PROVIDER, PROVIDERS
from stellwerk.functions.text import text


def _last_segment(href: Column) -> Column:
    return F.substring_index(href, "/", -1)


def provider_from_url(url: Column, default: str | None = None, registry=PROVIDERS) -> Column:
    """First portal, in registry order, whose domain occurs in the lower-cased URL."""
    low = F.lower(url)
    chain = F
    for key, _, pattern, _ in registry:
        chain = chain.when(F.contains(low, F.lit(pattern)), F.lit(key))
    return chain.otherwise(F.lit(default))


def provider_key(name: Column, registry=PROVIDERS) -> Column:
    """Portal key for a key or display name in any case; NULL when unknown."""
    low = F.lower(name)
    by_key = reduce(lambda c, p: c.when(low == p[0], F.lit(p[0])), registry, F)
    by_display = reduce(lambda c, p: c.when(low == p[1].lower(), F.lit(p[0])), registry, F)
    return F.coalesce(by_key, by_display)


def provider_or_fallback(name: Column) -> Column:
    """Portal used for detail pages: unknown names fall back to the first portal."""
    return F.coalesce(provider_key(name), F.lit(FALLBACK_PROVIDER))


def canonical_link(provider: Column, href: Column) -> Column:
    """Absolute posting URL as each portal's parser stores it."""
    domain = reduce(lambda c, kv: c.when(provider == kv[0], F.lit(kv[1])), DOMAINS.items(), F).otherwise(F.lit(""))
    absolute = F.concat(domain, href)
    return (
        F.when(provider == "linkedin", F.substring_index(href, "?", 1))
        .when(
            provider.isin("hays", "xing", "gulp", "freelance_de"),
            F.when(href.startswith("http"), href).otherwise(absolute),
        )
        .when(provider.isin("solcom", "freelancermap"), F.when(href.startswith("/"), absolute).otherwise(href))
        .when(provider == "ferchau", absolute)
        .otherwise(href)
    )


def job_id_from_href(provider: Column, href: Column) -> Column:
    """Posting id as each portal's parser derives it from the card link."""
    last = _last_segment(href)
    before_last = F.substring_index(F.substring_index(canonical_link(provider, href), "/", -2), "/", 1)
    return (
        F.when(
            provider == "linkedin",
            F.when(F.contains(href, F.lit("jobs/view/")), F.substring_index(last, "?", 1)).otherwise(href),
        )
        .when(
            provider == "hays",
            F.when(F.contains(canonical_link(provider, href), F.lit("/job/")), before_last).otherwise(
                F.replace(F.substring_index(canonical_link(provider, href), "-", -1), F.lit("/"), F.lit(""))
            ),
        )
        .when(provider == "xing", F.substring_index(last, "?", 1))
        .when(
            provider == "freelance_de",
            F.substring_index(F.replace(last, F.lit("projekt-"), F.lit("")), "-", 1),
        )
        .otherwise(last)
    )


def offer_id_from_url(url: Column) -> Column:
    """Digits of a ``/job/<digits>/`` path part; NULL when absent."""
    return F.nullif(F.regexp_extract(text(url), r"/job/(\d+)/", 1), F.lit(""))
