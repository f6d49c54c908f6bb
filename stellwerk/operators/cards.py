"""Postings from captured result pages.

One plan for all portals: parse a page into nodes, pick the portal's card nodes, cut
to the search limit, explode, read the raw fields with the portal's rules, and bring
them to posting columns. A portal is a :class:`CardRules` registered by key;
:func:`register_cards` adds further ones.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from stellwerk import fixed
from stellwerk.functions import cleanup, types
from stellwerk.functions.html import (
    NODES_TYPE,
    Dom,
    Test,
    attr,
    attr_is,
    attr_like,
    both,
    class_like,
    has_attr,
    has_class,
    html_nodes,
    tag,
)
from stellwerk.functions.links import canonical_link, job_id_from_href
from stellwerk.functions.text import bind, contains_any, quote
from stellwerk.schema import CARD_FIELDS

OFFER_TYPE = (
    "struct<id:string,title:string,intro:string,tasks:string,requirements:string,benefits:string,"
    "jobTypeName:string,workplaceTypeName:string,locationCity:string,locationCountry:string,slug:string>"
)
OFFERS_TYPE = f"struct<ControllerResponse:struct<Data:struct<Offers:array<{OFFER_TYPE}>>>>"

#: Raw fields a portal's rules may give, with the value of one left out.
RAW_FIELDS = {
    "title": "CAST(NULL AS STRING)",
    "href": "CAST(NULL AS STRING)",
    "company": "CAST(NULL AS STRING)",
    "location": "CAST(NULL AS STRING)",
    "posted": "CAST(NULL AS STRING)",
    "description": "CAST(NULL AS STRING)",
    "type_text": "CAST(NULL AS STRING)",
    "remote": "false",
}


@dataclass(frozen=True)
class CardRules:
    """Card selectors in order of preference, and the raw fields of one card.

    ``fields`` maps a card to SQL for any of :data:`RAW_FIELDS`. A NULL ``title`` or
    ``href`` drops the card. ``type_text`` is text that work and employment type are
    read from; without it ``employment`` and the portal's work type rule apply.
    ``shared`` is SQL that several fields need: evaluated once, passed to ``fields``.
    """

    selectors: tuple[Test, ...]
    fields: Callable[[Dom, str], dict[str, str]]
    employment: str = ""
    shared: Callable[[Dom], str] = lambda card: "0"


def _linkedin(card: Dom, _: str) -> dict[str, str]:
    title = card.first_text(both(tag("h3"), has_class("base-search-card__title")))
    company = card.first_text(both(tag("h4"), has_class("base-search-card__subtitle")))
    location = card.first_text(both(tag("span"), has_class("job-search-card__location")))
    badges = card.each(both(tag("span"), class_like("badge|metadata")), lambda d: d.text())
    return {
        "title": bind(title, lambda t: f"CASE WHEN {company} IS NOT NULL AND {location} IS NOT NULL THEN {t} END"),
        "company": company,
        "location": location,
        "href": card.first_attr(both(tag("a"), has_class("base-card__full-link")), "href"),
        "type_text": f"concat_ws(' ', {title}, array_join({badges}, ' '), {card.raw_text()})",
    }


def _hays(card: Dom, _: str) -> dict[str, str]:
    info = both(tag("div"), has_class("info-text"))
    rows = card.each(both(tag("div"), has_class("row")), lambda d: d.raw_text())
    return {
        "title": card.first_text(both(tag("h4"), has_class("search__result__header__title"))),
        "location": card.first(
            both(tag("div"), has_class("search__result__job__attribute__location")), lambda d: d.first_text(info)
        ),
        "href": card.first_attr(both(tag("a"), has_class("search__result__link")), "href"),
        "posted": f"try_element_at(filter({rows}, r -> contains(r, 'Online seit')), 1)",
        "description": card.first_text(both(tag("div"), has_class("search__result__teaser")), " "),
    }


def _solcom(card: Dom, _: str) -> dict[str, str]:
    header = both(tag("div"), has_class("project-header"))
    pin = both(tag("li"), has_class("pin-icon"))

    def of_link(take: Callable[[Dom], str]) -> str:
        return card.first(header, lambda d: d.first(tag("a"), take))

    return {
        "title": of_link(lambda a: f"coalesce({a.first_text(tag('h2'))}, 'Unknown')"),
        "location": card.first(both(tag("div"), has_class("project-infos")), lambda d: d.first_text(pin)),
        "href": of_link(lambda a: f"coalesce({attr(a.node, 'href')}, '')"),
    }


def _freelancermap(card: Dom, _: str) -> dict[str, str]:
    link = both(tag("a"), attr_is("data-testid", "title"))
    return {
        "title": card.first_text(link),
        "location": card.first_text(both(tag("div"), attr_is("data-testid", "city")), " "),
        "href": card.first(link, lambda d: f"coalesce({attr(d.node, 'href')}, '')"),
        "posted": card.first_text(both(tag("span"), attr_is("data-testid", "created"))),
    }


def _xing(card: Dom, _: str) -> dict[str, str]:
    link = both(tag("a"), attr_like("href", "/jobs/"))
    return {
        "title": f"coalesce({card.first_text(tag('h2', 'h3'))}, {card.first_text(link)})",
        "href": card.first_attr(link, "href"),
    }


def _facts(card: Dom, lists: list[Test], kinds: Callable[[Dom, str], dict[str, str]]) -> str:
    """Kind and text of each item of the first list found; an item has one kind at most."""

    def fact(item: Dom) -> str:
        def named(text: str) -> str:
            cases = " ".join(f"WHEN {test} THEN {quote(kind)}" for kind, test in kinds(item, text).items())
            return f"named_struct('text', {text}, 'kind', CASE {cases} END)"

        return bind(item.text(), named)

    return bind(card.first_of(lists, lambda d: d.nodes), lambda items: Dom(items).each(tag("li"), fact))


def _last_fact(facts: str, kind: str) -> str:
    return f"try_element_at(filter({facts}, f -> f.kind = {quote(kind)}), -1).text"


def _gulp_facts(card: Dom) -> str:
    return _facts(
        card,
        [both(tag("ul"), has_class("small")), both(tag("ul"), has_class("fa-ul"))],
        lambda item, text: {
            "place": item.mentions("map-marker"),
            "posted": item.mentions("history"),
            "remote": f"{item.mentions('laptop-house')} OR contains({text}, 'Remote')",
        },
    )


def _gulp(card: Dom, facts: str) -> dict[str, str]:
    link = both(tag("a"), has_attr("href"))
    badges = card.each(both(tag("a"), has_class("badge")), lambda d: d.text())
    return {
        "title": f"coalesce({card.first_text(tag('h3'))}, {card.first_text(link)})",
        "location": _last_fact(facts, "place"),
        "href": card.first_attr(link, "href"),
        "posted": _last_fact(facts, "posted"),
        "description": f"array_join({badges}, ' | ')",
        "remote": f"{_last_fact(facts, 'remote')} IS NOT NULL",
    }


def _freelance_de_facts(card: Dom) -> str:
    return _facts(
        card,
        [both(tag("ul"), class_like("fa-ul|icon-list"))],
        lambda item, text: {
            "place": item.mentions("fa-map-marker", "fa-location"),
            "start": item.mentions("fa-calendar"),
            "remote": f"rlike(lower({text}), 'remote|home office')",
            "company": f"contains({text}, 'Project Provider:')",
        },
    )


def _freelance_de(card: Dom, facts: str) -> dict[str, str]:
    link = both(tag("a"), attr_like("href", r"project\.php|projekte/"))
    return {
        "title": card.first_text(link),
        "company": _last_fact(facts, "company"),
        "location": _last_fact(facts, "place"),
        "href": card.first_attr(link, "href"),
        "posted": card.first_text(both(tag("small"), has_class("time-ago"))),
        "description": card.text(" | "),
        "remote": f"{_last_fact(facts, 'remote')} IS NOT NULL",
    }


CARD_RULES: dict[str, CardRules] = {
    "linkedin": CardRules((tag("li"),), _linkedin),
    "hays": CardRules((both(tag("div"), has_class("search__result")),), _hays, "Contract"),
    "solcom": CardRules(
        (both(tag("div"), has_class("contenance-solcom-portal-project-item")),), _solcom, "Freelance"
    ),
    "freelancermap": CardRules((both(tag("div"), has_class("project-card")),), _freelancermap, "Freelance"),
    "xing": CardRules((tag("article"),), _xing, "Full-time"),
    "gulp": CardRules(
        (tag("search-project-card"), both(tag("div"), has_class("list-result-item"))), _gulp, "Freelance", _gulp_facts
    ),
    "freelance_de": CardRules(
        (tag("search-project-card"), both(tag("div"), has_class("project-item"))),
        _freelance_de,
        "Freelance",
        _freelance_de_facts,
    ),
}


def register_cards(provider: str, rules: CardRules) -> None:
    """Make a further portal known to :func:`extract_cards`."""
    CARD_RULES[provider] = rules


def by_provider(sql: dict[str, str]) -> Column:
    """Each portal's SQL for its own rows, NULL for rows of other portals."""
    return F.expr("CASE provider " + " ".join(f"WHEN {quote(k)} THEN {v}" for k, v in sql.items()) + " END")


def _cards_of(nodes: str, rules: CardRules) -> str:
    """Subtrees of the first selector that matches anything."""
    found = [Dom(nodes).each(s, lambda d: d.nodes) for s in rules.selectors]
    chosen = found[-1]
    for better in reversed(found[:-1]):
        fallback = chosen
        chosen = bind(better, lambda b, f=fallback: f"CASE WHEN size({b}) > 0 THEN {b} ELSE {f} END")
    return chosen


def offers_json(html: Column) -> Column:
    """The offer list embedded in a page as application data; NULL when absent or invalid.

    The object ends at the first ``};``, so an offer text holding that sequence makes
    the page unreadable; :func:`offers_unreadable` reports such pages.
    """
    data = F.regexp_extract(html, r"(?s)App\.Data\s*=\s*(\{.*?\});", 1)
    return F.from_json(F.nullif(data, F.lit("")), OFFERS_TYPE, {"allowSingleQuotes": "false"})[
        "ControllerResponse"
    ]["Data"]["Offers"]


def offers_unreadable(html: Column) -> Column:
    return html.rlike(r"(?s)App\.Data\s*=\s*\{.*?\};") & offers_json(html).isNull()


def offer_markup(offer: Column) -> Column:
    parts = [F.coalesce(offer[p], F.lit("")) for p in ("intro", "tasks", "requirements", "benefits")]
    return F.concat_ws(" ", *parts)


def offer_fields(offer: Column, description: Column) -> dict[str, Column]:
    city, country = F.coalesce(offer["locationCity"], F.lit("")), F.coalesce(offer["locationCountry"], F.lit(""))
    return {
        "title": cleanup.clean_offer_title(offer["title"]),
        "company": F.lit("FERCHAU"),
        "location": cleanup.strip(F.concat_ws(" ", city, country)),
        "link": F.concat(F.lit(fixed.DOMAINS["ferchau"]), F.coalesce(offer["slug"], F.lit(""))),
        "job_id": F.coalesce(offer["id"], F.lit("None")),
        "posted_at_relative": F.lit(fixed.POSTED_DEFAULT),
        "description": F.coalesce(description, F.lit("")),
        "work_location_type": types.work_type_from_code(offer["workplaceTypeName"]),
        "employment_type": types.employment_from_code(offer["jobTypeName"]),
    }


def _raw_struct(card: Dom, rules: CardRules) -> str:
    def struct(shared: str) -> str:
        given = RAW_FIELDS | rules.fields(card, shared)
        return "named_struct(" + ", ".join(f"{quote(k)}, {v}" for k, v in given.items()) + ")"

    return bind(rules.shared(card), struct)


def card_fields(provider: Column, raw: Column, remote_search: Column) -> dict[str, Column]:
    """Posting columns from a card's raw fields."""
    title = F.when(provider == "freelance_de", cleanup.clean_project_title(raw["title"])).otherwise(raw["title"])
    place = (
        F.when(provider == "freelancermap", cleanup.clean_city(raw["location"]))
        .when(provider == "freelance_de", cleanup.clean_premium_location(raw["location"]))
        .otherwise(raw["location"])
    )
    company = F.when(
        provider == "freelance_de", cleanup.without_label(raw["company"], "Project Provider:")
    ).otherwise(raw["company"])
    posted = F.when(provider == "hays", cleanup.without_label(raw["posted"], "Online seit:")).otherwise(raw["posted"])
    location = cleanup.default_fill(provider, "location", place)
    employment = F.create_map(*[F.lit(x) for k, r in CARD_RULES.items() for x in (k, r.employment)])
    portal_type = types.portal_work_type(provider, title, location, raw["remote"])
    from_text = raw["type_text"].isNotNull()
    work_type = F.when(from_text, types.work_type_from_text(raw["type_text"])).otherwise(portal_type)
    return {
        "title": title,
        "company": cleanup.default_fill(provider, "company", company),
        "location": location,
        "link": canonical_link(provider, raw["href"]),
        "job_id": job_id_from_href(provider, raw["href"]),
        "posted_at_relative": cleanup.default_fill(provider, "posted_at_relative", posted),
        "description": F.coalesce(raw["description"], F.lit("")),
        "work_location_type": F.when((provider == "linkedin") & remote_search, F.lit("Remote")).otherwise(work_type),
        "employment_type": F.when(from_text, types.employment_type_from_text(raw["type_text"])).otherwise(
            F.try_element_at(employment, provider)
        ),
    }


def is_blocked(html: Column) -> Column:
    """True when the page, title included, holds a block phrase."""
    return contains_any(html, fixed.BLOCK_PHRASES)


def not_blocked(df: DataFrame) -> DataFrame:
    """Leave out pages of the portal that answers with a country notice."""
    return df.where(~((F.col("provider") == "solcom") & is_blocked(F.col("html"))))


def _first(items: Column, limit: Column) -> Column:
    """The first ``limit`` items; all of them where there is no limit."""
    return F.when(limit.isNull(), items).otherwise(F.slice(items, F.lit(1), F.greatest(limit, F.lit(0))))


def extract_cards(pages: DataFrame) -> DataFrame:
    """One row per posting on each captured result page.

    ``pages`` needs ``provider, query, location, result_limit, html``; other columns
    pass through. The limit cuts cards before unreadable ones are dropped; NULL is no limit.
    ``scraped_at``, where the page has it, is when the page was captured; else it is the time
    of the run, as UTC text.
    """
    keep = [c for c in pages.columns if c not in ("html", "location", "result_limit")]
    is_offers = F.col("provider") == "ferchau"
    cards = by_provider({k: _cards_of("_nodes", r) for k, r in CARD_RULES.items()})
    items = F.when(
        is_offers, F.expr(f"transform(_offers, o -> named_struct('card', CAST(NULL AS {NODES_TYPE}), 'offer', o))")
    ).otherwise(F.expr(f"transform(_cards, c -> named_struct('card', c, 'offer', CAST(NULL AS {OFFER_TYPE})))"))
    exploded = (
        not_blocked(pages)
        .withColumnRenamed("location", "req_location")
        .withColumn("_offers", F.when(is_offers, offers_json(F.col("html"))))
        .withColumn("_nodes", html_nodes(F.when(~is_offers, F.col("html"))))
        .withColumn("_cards", cards)
        .select(*keep, "req_location", F.posexplode(_first(items, F.col("result_limit"))).alias("pos", "_item"))
        .select(*keep, "req_location", "pos", "_item.card", "_item.offer")
    )
    # Exploding the one-element list drops unreadable cards without a filter that Spark
    # would push below, evaluating every rule a second time.
    rules = by_provider({k: _raw_struct(Dom("card"), r) for k, r in CARD_RULES.items()})
    readable = F.filter(F.array(rules), lambda r: F.col("offer").isNotNull() | (r["title"].isNotNull() & r["href"].isNotNull()))
    raw = exploded.withColumn(
        "_offer_nodes", html_nodes(F.when(is_offers, offer_markup(F.col("offer"))))
    ).select(*keep, "req_location", "pos", "offer", "_offer_nodes", F.explode(readable).alias("_raw"))
    from_offer = offer_fields(F.col("offer"), F.expr(Dom("_offer_nodes").text("\n")))
    from_card = card_fields(F.col("provider"), F.col("_raw"), F.lower(F.col("req_location")) == "remote")
    others = [c for c in keep if c not in ("provider", "query")]
    return raw.select(
        *others,
        "provider",
        "pos",
        search_criteria(F.col("query"), F.col("req_location")).alias("search_criteria"),
        *([] if "scraped_at" in others else [scraped_now().alias("scraped_at")]),
        *[F.when(is_offers, from_offer[f]).otherwise(from_card[f]).alias(f) for f in CARD_FIELDS],
    )


def scraped_now() -> Column:
    """The run's time as the master table reads it, in UTC."""
    return F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")


def search_criteria(query: Column, location: Column) -> Column:
    """How a search is named on its postings."""
    return F.concat(F.coalesce(query, F.lit("")), F.lit(" | "), F.coalesce(location, F.lit("")))
