"""Detail-page data: one struct of overriding fields per captured page.

Each portal first tries data embedded in the page (JSON-LD, application state), then
containers in order of preference. NULL in a field means the page does not give it;
'' is a value and overwrites.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from stellwerk.functions import cleanup, types
from stellwerk.functions.html import (
    Dom,
    Test,
    attr_is,
    attr_like,
    both,
    class_like,
    has_class,
    html_nodes,
    strip_sql,
    tag,
)
from stellwerk.functions.links import offer_id_from_url
from stellwerk.functions.text import bind, quote
from stellwerk.operators.cards import by_provider, offer_fields, offer_markup, offers_json
from stellwerk.schema import DETAIL_FIELDS

LINE = "\n"
JSON_OPTIONS = "map('allowSingleQuotes', 'false')"
#: Fields that come as text, object or list are read as JSON text and looked into later.
LD_TYPE = "array<struct<`@type`:string,title:string,description:string,hiringOrganization:string,jobLocation:string>>"
STATE_TYPE = (
    "struct<project:struct<title:string,company:string,city:string,country:string,"
    "description:string,skills:struct<enabled:array<struct<localizedName:string>>>>>"
)

LD_SCRIPT = both(tag("script"), attr_is("type", "application/ld+json"))
STATE_SCRIPT = both(
    tag("script"), has_class("js-react-on-rails-component"), attr_is("data-component-name", "ProjectShow")
)


# -- JSON-LD ---------------------------------------------------------------------------


def ld_items(script: str) -> str:
    """Items of one JSON-LD text; a single object counts as a list of one. NULL if invalid."""
    return f"from_json(nullif({script}, ''), {quote(LD_TYPE)}, {JSON_OPTIONS})"


def first_ld(dom: Dom) -> str:
    """Items of the page's first JSON-LD script."""
    return ld_items(dom.first(LD_SCRIPT, lambda d: d.script_text()))


def all_ld(dom: Dom) -> str:
    """Items of all JSON-LD scripts up to the first invalid one."""
    scripts = f"filter({dom.each(LD_SCRIPT, lambda d: d.script_text())}, s -> s <> '')"
    parsed = f"transform({scripts}, s -> {ld_items('s')})"

    def valid(p: str) -> str:
        bad = f"array_position(transform({p}, x -> x IS NULL), true)"
        return f"flatten(slice({p}, 1, CAST(CASE WHEN {bad} > 0 THEN {bad} - 1 ELSE size({p}) END AS INT)))"

    return bind(parsed, valid)


def object_text(json_text: str, path: str) -> str:
    """Text at ``path`` when the JSON text is an object."""
    return f"CASE WHEN startswith(ltrim({json_text}), '{{') THEN get_json_object({json_text}, '$.{path}') END"


def organisation(item: str) -> str:
    return object_text(f"{item}.hiringOrganization", "name")


def locality(item: str, lists: bool = True) -> str:
    """Town of an item whose location is an object or, with ``lists``, a list of them."""
    place = f"{item}.jobLocation"
    single = object_text(place, "address.addressLocality")
    if not lists:
        return single
    listed = f"get_json_object({place}, '$[0].address.addressLocality')"
    return f"CASE WHEN startswith(ltrim({place}), '[') THEN {listed} ELSE {single} END"


def _first_nonempty(values: str) -> str:
    return f"try_element_at(filter({values}, v -> v IS NOT NULL AND v <> ''), 1)"


def _nonempty(sql: str) -> str:
    return f"nullif({sql}, '')"


def _given(sql: str) -> str:
    return f"coalesce({sql}, '')"


def _when(condition: str, sql: str) -> str:
    return f"CASE WHEN {condition} THEN {sql} END"


# -- portals ---------------------------------------------------------------------------


@dataclass(frozen=True)
class DetailRules:
    """How one portal's detail page is read.

    ``fields`` gives SQL for any detail field, from the page and from the portal's
    embedded markup (``markup``), which is parsed alongside. Fields other than the
    description count only where a description was found, unless they ``always`` do.
    ``shared`` is SQL that several fields need: evaluated once, passed to ``fields``.
    """

    fields: Callable[[Dom, Dom, str], dict[str, str]]
    markup: Callable[[Dom], str] | None = None
    always: bool = False
    shared: Callable[[Dom], str] = lambda dom: "0"


def _linkedin_markup(dom: Dom) -> str:
    return _first_nonempty(f"transform({first_ld(dom)}, i -> i.description)")


def _linkedin(dom: Dom, embedded: Dom, _: str) -> dict[str, str]:
    containers = [
        both(tag("div"), has_class("show-more-less-html__markup")),
        both(tag("section"), has_class("description")),
        both(tag("article"), has_class("jobs-description")),
    ]
    return {"description": f"coalesce({_nonempty(embedded.text(LINE))}, {dom.first_of(containers, lambda d: d.text(LINE))})"}


def _hays(dom: Dom, embedded: Dom, _: str) -> dict[str, str]:
    containers = [
        both(tag("div"), has_class("job-description__content")),
        both(tag("div"), has_class("h-text")),
        both(tag("section"), has_class("job-description")),
        both(tag("div"), has_class("job-details-content")),
        tag("article"),
    ]
    cut = ("script", "style", "iframe", "noscript")
    header = dom.first_text(both(tag("div"), has_class("job-details__header-location")))
    # The label's parent holds the place.
    spans = dom.each(
        tag("span"),
        lambda d: f"CASE WHEN contains({d.raw_text()}, 'Einsatzort') THEN {d.parent_text(dom)} END",
    )
    labelled = f"try_element_at(filter({spans}, t -> t IS NOT NULL), 1)"
    return {
        "description": dom.first_of(containers, lambda d: d.text(LINE, without=cut)),
        "title": dom.first_text(tag("h1")),
        "company": "'Hays Client'",
        "location": f"coalesce({header}, {strip_sql(f"replace({labelled}, 'Einsatzort', '')")})",
    }


def _solcom(dom: Dom, embedded: Dom, _: str) -> dict[str, str]:
    def described(d: Dom) -> str:
        items = d.each(tag("li"), lambda li: li.text())
        return f"concat({d.text(LINE)}, {quote(LINE * 2 + 'SKILLS EXTRACT:' + LINE)}, array_join({items}, {quote(LINE)}))"

    def around(heading: str) -> Test:
        inside = lambda n: f"{n}.no < {heading}.no AND {n}.last >= {heading}.last"
        return both(tag("div"), class_like("content|main|project"), inside)

    containers = [both(tag("div"), has_class("project-details")), both(tag("div"), has_class("description-content"))]
    found = bind(
        f"try_element_at({dom.matching(tag('h1'))}, 1)",
        lambda h: _when(
            f"{h} IS NOT NULL", f"coalesce({dom.last(around(h), described)}, {dom.first_of(containers, described)})"
        ),
    )
    return {"description": found, "company": "'SOLCOM Client'", "title": dom.first_text(tag("h1"))}


def _state(dom: Dom) -> str:
    script = _nonempty(dom.first(STATE_SCRIPT, lambda d: d.script_text()))
    return f"from_json({script}, {quote(STATE_TYPE)}, {JSON_OPTIONS}).project"


def _freelancermap_markup(dom: Dom) -> str:
    return _nonempty(f"{_state(dom)}.description")


def _freelancermap(dom: Dom, embedded: Dom, p: str) -> dict[str, str]:
    own = f"{p}.company"
    company = f"CASE WHEN startswith({own}, '{{') THEN get_json_object({own}, '$.name') ELSE {own} END"
    country = _given(object_text(f"{p}.country", "localizedName"))
    place = strip_sql(f"concat_ws(' ', {_given(f'{p}.city')}, {country})")
    names = f"transform({p}.skills.enabled, s -> s.localizedName)"
    skills = bind(
        names,
        lambda n: f"CASE WHEN size({n}) > 0 THEN concat({quote(LINE * 2 + 'Skills: ')}, array_join({n}, ', ')) ELSE '' END",
    )
    postings = f"filter({all_ld(dom)}, i -> i.`@type` = 'JobPosting')"
    ld_company = _first_nonempty(f"transform({postings}, i -> {strip_sql(organisation('i'))})")
    ld_place = _first_nonempty(f"transform({postings}, i -> {strip_sql(locality('i', lists=False))})")
    containers = [
        both(tag("div"), has_class("ql-editor")),
        both(tag("div"), has_class("project-body-description")),
        both(tag("div"), attr_is("id", "project-description")),
    ]
    firm = [both(tag("div"), has_class("company-name")), both(tag("a"), attr_like("href", "/profil/firma/"))]
    own_text = _nonempty(f"concat({_given(embedded.text(LINE))}, {skills})")
    return {
        "description": f"coalesce({own_text}, {dom.first_of(containers, lambda d: d.text(LINE))})",
        "company": f"coalesce({_nonempty(strip_sql(company))}, {ld_company}, {dom.first_of(firm, lambda d: d.text())}, '')",
        "title": _given(f"{p}.title"),
        "location": f"coalesce({_nonempty(place)}, {ld_place}, '')",
    }


def _xing_found(dom: Dom) -> str:
    """Title, description and JSON-LD fields; NULL on a page without title and description."""

    def fields(item: str) -> str:
        return (
            f"named_struct('title', {item}.title, 'company', {organisation(item)}, 'location', {_nonempty(locality(item))})"
        )

    posting = bind(f"try_element_at({first_ld(dom)}, 1)", fields)
    name = dom.first_text(tag("title"))
    from_name = f"CASE WHEN NOT contains({name}, 'XING') THEN {strip_sql(f"substring_index({name}, '|', 1)")} END"
    containers = [
        both(tag("div"), attr_is("data-testid", "html-renderer")),
        both(tag("section"), attr_is("data-testid", "job-details-content")),
        both(tag("div"), attr_is("id", "job-description")),
        tag("main"),
    ]
    cut = ("script", "style", "nav", "header", "footer")
    title = f"coalesce({_nonempty(f'{posting}.title')}, {_nonempty(dom.first_text(tag('h1')))}, {from_name}, '')"
    found = _given(dom.first_of(containers, lambda d: d.text(LINE, without=cut)))
    return bind(
        f"named_struct('title', {title}, 'description', {found}, 'p', {posting})",
        lambda f: f"CASE WHEN {f}.title <> '' OR {f}.description <> '' THEN {f} END",
    )


def _xing(dom: Dom, embedded: Dom, found: str) -> dict[str, str]:
    return {
        "description": f"{found}.description",
        "title": f"{found}.title",
        "company": _when(f"{found} IS NOT NULL", f"coalesce({found}.p.company, 'XING Employer')"),
        "location": _when(f"{found} IS NOT NULL", f"coalesce({found}.p.location, 'Germany')"),
    }


def _gulp(dom: Dom, embedded: Dom, _: str) -> dict[str, str]:
    tags = dom.first(
        attr_is("data-testid", "readonlyTagsContainer"), lambda d: d.each(has_class("tag"), lambda t: t.text())
    )
    skills = bind(
        tags,
        lambda t: f"CASE WHEN size({t}) > 0 THEN concat({quote(LINE * 2 + 'Skills: ')}, array_join({t}, ', ')) ELSE '' END",
    )
    main = f"concat({_given(dom.first_text(attr_is('data-testid', 'readonlyValue'), LINE))}, {skills})"
    containers = [both(tag("div"), has_class("project-details")), both(tag("div"), has_class("description-content"))]
    places = dom.each(both(tag("i"), class_like("map-marker")), lambda d: d.parent_text(dom))
    labelled = f"try_element_at(filter({places}, t -> contains(t, 'Location:')), 1)"
    heading = f"{dom.first_text(attr_is('data-testid', 'projectTitle'))}, {dom.first_text(tag('h1'))}"
    return {
        "description": f"coalesce({_nonempty(main)}, {dom.first_of(containers, lambda d: d.text(LINE))})",
        "title": f"coalesce({heading}, '')",
        "company": "'GULP Client'",
        "location": f"coalesce({strip_sql(f"replace({labelled}, 'Location:', '')")}, 'Germany')",
    }


def _freelance_de_facts(dom: Dom) -> str:
    def fact(item: Dom) -> str:
        place, firm = item.mentions("fa-map-marker", "fa-location"), item.mentions("fa-building")
        kind = f"CASE WHEN {place} THEN 'place' WHEN {firm} THEN 'company' END"
        return f"named_struct('text', {item.text()}, 'kind', {kind})"

    return bind(
        dom.first(both(tag("ul"), class_like("fa-ul|icon-list|overview")), lambda d: d.nodes),
        lambda items: Dom(items).each(tag("li"), fact),
    )


def _freelance_de(dom: Dom, embedded: Dom, facts: str) -> dict[str, str]:
    containers = [
        both(tag("div"), attr_is("id", "project-description")),
        both(tag("div"), has_class("panel-body")),
        both(tag("div"), has_class("project-detail-content")),
    ]
    badges = bind(
        dom.each(class_like("badge|tag|skill"), lambda d: d.text()),
        lambda b: f"CASE WHEN size({b}) > 0 THEN concat({quote(LINE * 2 + 'Skills & Keywords: ')}, array_join({b}, ', ')) ELSE '' END",
    )
    last = lambda kind: f"try_element_at(filter({facts}, f -> f.kind = '{kind}'), -1).text"
    return {
        "description": f"concat({_given(dom.first_of(containers, lambda d: d.text(LINE)))}, {badges})",
        "title": _given(dom.first_text(tag("h1"))),
        "company": f"coalesce({last('company')}, 'Freelance.de Client')",
        "location": f"coalesce({last('place')}, 'Germany/Remote')",
    }


DETAIL_RULES: dict[str, DetailRules] = {
    "linkedin": DetailRules(_linkedin, _linkedin_markup),
    "hays": DetailRules(_hays),
    "solcom": DetailRules(_solcom),
    "freelancermap": DetailRules(_freelancermap, _freelancermap_markup, always=True, shared=_state),
    "xing": DetailRules(_xing, always=True, shared=_xing_found),
    "gulp": DetailRules(_gulp),
    "freelance_de": DetailRules(_freelance_de, always=True, shared=_freelance_de_facts),
}


def register_details(provider: str, rules: DetailRules) -> None:
    """Make a further portal's detail pages known to :func:`extract_details`."""
    DETAIL_RULES[provider] = rules


def target_offer(offers: Column, target: Column, strict: bool = False) -> Column:
    """The offer whose id is the link's; without one the page's first offer stands in.

    ``strict`` gives NULL instead of another offer.
    """
    own = F.try_element_at(F.filter(offers, lambda o: o["id"] == target), F.lit(1))
    return own if strict else F.coalesce(own, F.try_element_at(offers, F.lit(1)))


def _raw_struct(rules: DetailRules) -> str:
    """The portal's fields as a struct, the description never NULL.

    Unless the portal's fields always count, a page without a description gives nothing
    else either.
    """
    dom, embedded, null = Dom("_nodes"), Dom("_embedded"), "CAST(NULL AS STRING)"

    def struct(shared: str) -> str:
        given = rules.fields(dom, embedded, shared)

        def with_description(d: str) -> str:
            parts = [f"'description', {d}"]
            for f in DETAIL_FIELDS:
                if f != "description":
                    value = given.get(f, null)
                    parts.append(f"'{f}', " + (value if rules.always else _when(f"{d} <> ''", value)))
            return f"named_struct({', '.join(parts)})"

        return bind(_given(given["description"]), with_description)

    return bind(rules.shared(dom), struct)


def detail_fields(provider: Column, raw: Column) -> dict[str, Column]:
    """Detail columns from a page's raw fields."""
    described = (provider == "linkedin") & (raw["description"] != "")
    title = (
        F.when(provider == "freelance_de", cleanup.clean_project_heading(raw["title"]))
        .when(provider == "freelancermap", cleanup.strip(raw["title"]))
        .otherwise(raw["title"])
    )
    return {
        "title": title,
        "company": raw["company"],
        "location": raw["location"],
        "description": raw["description"],
        "work_location_type": F.when(described, types.work_type_from_text(raw["description"])).otherwise(
            raw["work_location_type"]
        ),
        "employment_type": F.when(described, types.employment_type_from_text(raw["description"])).otherwise(
            raw["employment_type"]
        ),
    }


def extract_details(pages: DataFrame, strict_target: bool = False) -> DataFrame:
    """``link`` and the overriding detail fields, one row per captured detail page.

    ``pages`` needs ``link, provider, html``. A page that yields nothing gives an empty
    description and NULL elsewhere, as a failed page visit does.
    """
    page, provider = F.col("html"), F.col("provider")
    is_offers = provider == "ferchau"
    markup = by_provider({k: r.markup(Dom("_nodes")) for k, r in DETAIL_RULES.items() if r.markup})
    others = [c for c in pages.columns if c not in ("html", *DETAIL_FIELDS)]
    own_offer = target_offer(offers_json(page), offer_id_from_url(F.col("link")), strict_target)
    parsed = (
        pages.withColumns({"_offer": F.when(is_offers, own_offer), "_nodes": html_nodes(F.when(~is_offers, page))})
        .withColumn("_embedded", html_nodes(F.when(is_offers, offer_markup(F.col("_offer"))).otherwise(markup)))
        .withColumn("_raw", by_provider({k: _raw_struct(r) for k, r in DETAIL_RULES.items()}))
    )
    offer = offer_fields(F.col("_offer"), F.expr(Dom("_embedded").text(LINE)))
    detail = detail_fields(provider, F.col("_raw"))
    found = F.col("_offer").isNotNull()
    columns = []
    for f in DETAIL_FIELDS:
        value = F.when(found, offer[f]).otherwise(detail[f])
        columns.append((F.coalesce(value, F.lit("")) if f == "description" else value).alias(f))
    return parsed.select(*others, *columns)


def unreadable(pages: DataFrame) -> DataFrame:
    """Pages whose markup could not be parsed at all."""
    parsed = pages.withColumn("_nodes", html_nodes("html"))
    return parsed.where(F.col("_nodes").isNull() & F.col("html").isNotNull()).drop("_nodes")
