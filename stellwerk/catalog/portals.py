"""Portal pages built from the documents, and read back.

Every document becomes one result page and one detail page per portal. The SQL states
what must come out of them, straight from the documents, so building and reading a
page has to cancel out.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

from stellwerk.catalog import Catalog
from stellwerk.catalog.base import quoted, table
from stellwerk.operators.cards import extract_cards
from stellwerk.operators.details import extract_details
from stellwerk.schema import CARD_FIELDS, DETAIL_FIELDS

#: What pages are made of. ``t`` is a title with markup characters, ``d`` the text as shown.
SOURCE = r"""
SELECT doc_id, lang, source, cast(doc_id AS STRING) AS id, concat(source, ' Engineer & Tester <', lang, '>') AS t,
       regexp_replace(text, '^\s+|\s+$', '', 'g') AS d, concat('q ', source) AS query,
       CASE lang WHEN 'fr' THEN 'remote' ELSE lang END AS location,
       CASE lang WHEN 'en' THEN 3 WHEN 'de' THEN 2 ELSE 1 END AS result_limit
FROM documents
"""


def source(spark, sf):
    lang, src = F.col("lang"), F.col("source")
    return table(spark, sf, "documents").select(
        "doc_id", "lang", "source", F.col("doc_id").cast("string").alias("id"),
        F.concat(src, F.lit(" Engineer & Tester <"), lang, F.lit(">")).alias("title"), "text",
        F.concat(F.lit("q "), src).alias("query"),
        F.when(lang == "fr", "remote").otherwise(lang).alias("location"),
        F.when(lang == "en", 3).when(lang == "de", 2).otherwise(1).alias("result_limit"),
    )


def escaped(col: Column) -> Column:
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        col = F.replace(col, F.lit(char), F.lit(entity))
    return col


def render(template: str) -> Column:
    """Template with ``{column}`` marks, filled with escaped text; ``{!column}`` is not escaped."""
    parts = []
    for piece in re.split(r"(\{!?\w+\})", template):
        name = re.fullmatch(r"\{(!?)(\w+)\}", piece)
        if name:
            parts.append(F.col(name[2]) if name[1] else escaped(F.col(name[2])))
        elif piece:
            parts.append(F.lit(piece))
    return F.concat(*parts)


def json_text(*fields: Column) -> Column:
    """JSON text safe inside a script element."""
    return F.to_json(F.struct(*fields))


SEARCH = "concat(query, ' | ', location) AS search_criteria"

# Per portal: page template, and per kept card its position and the fields expected of it.
CARDS: dict[str, tuple[str, list[tuple[int, dict[str, str]]]]] = {
    "linkedin": (
        '<ul><li><div><h3 class="base-search-card__title"> {title} </h3><h4 class="base-search-card__subtitle"><a>{source} AG</a></h4>'
        '<span class="job-search-card__location">{lang}-Stadt</span>'
        '<a class="base-card__full-link big" href="https://de.linkedin.com/jobs/view/dev-{id}?pos=1&amp;x=2">go</a>'
        '<span class="x-badge">Hybrid</span></div></li>'
        '<li><h3 class="base-search-card__title">No link</h3></li>'
        '<li><h3 class="base-search-card__title">Praktikant {id}</h3><h4 class="base-search-card__subtitle">X</h4>'
        '<span class="job-search-card__location">Y</span><a class="base-card__full-link" href="/other/{id}?a">go</a></li></ul>',
        [
            (0, {
                "title": "t", "company": "concat(source, ' AG')", "location": "concat(lang, '-Stadt')",
                "link": "concat('https://de.linkedin.com/jobs/view/dev-', id)", "job_id": "concat('dev-', id)",
                "work_location_type": "CASE location WHEN 'remote' THEN 'Remote' ELSE 'Hybrid' END",
                "employment_type": "'Full-time'",
            }),
            (2, {
                "title": "concat('Praktikant ', id)", "company": "'X'", "location": "'Y'", "link": "concat('/other/', id)",
                "job_id": "concat('/other/', id, '?a')",
                "work_location_type": "CASE location WHEN 'remote' THEN 'Remote' ELSE 'On-site' END",
                "employment_type": "'Internship'",
            }),
        ],
    ),
    "hays": (
        '<div class="a search__result"><h4 class="search__result__header__title">{title}</h4>'
        '<a class="search__result__link" href="/jobsuche/{id}/job/{id}9/1">d</a>'
        '<div class="search__result__job__attribute__location"><div class="info-text"> {lang} Home Office</div></div>'
        '<div class="row"><span>Ref</span></div><div class="row"><span>Online seit:</span> 3 Tage {id}</div>'
        '<div class="search__result__teaser"><p>{text}</p><script>var x = "</p>";</script><b>Ende</b></div></div>'
        '<div class="search__result"><h4>none</h4></div>'
        '<div class="search__result"><h4 class="search__result__header__title">B {id}</h4>'
        '<a class="search__result__link" href="https://www.hays.de/stelle-b-{id}/">d</a></div>',
        [
            (0, {
                "title": "t", "company": "'Hays Client'", "location": "concat(lang, ' Home Office')",
                "link": "concat('https://www.hays.de/jobsuche/', id, '/job/', id, '9/1')", "job_id": "concat(id, '9')",
                "posted_at_relative": "concat('3 Tage ', id)", "description": "concat(d, ' Ende')",
                "work_location_type": "'Remote'", "employment_type": "'Contract'",
            }),
            (2, {
                "title": "concat('B ', id)", "company": "'Hays Client'", "location": "'Germany'",
                "link": "concat('https://www.hays.de/stelle-b-', id, '/')", "job_id": "id",
                "work_location_type": "'On-site'", "employment_type": "'Contract'",
            }),
        ],
    ),
    "solcom": (
        '<div class="contenance-solcom-portal-project-item"><div class="project-header"><a href="/de/p/{id}"><h2>{title}<br>Remote</h2></a></div>'
        '<div class="project-infos"><ul><li class="x">a</li><li class="pin-icon"> {lang} </li></ul></div></div>'
        '<div class="contenance-solcom-portal-project-item"><div class="project-header"><span>no link</span></div><a href="/x">y</a></div>'
        '<div class="contenance-solcom-portal-project-item"><div class="project-header"><a href="p/{id}x">no title</a></div></div>',
        [
            (0, {
                "title": "concat(t, 'Remote')", "company": "'SOLCOM Client'", "location": "lang",
                "link": "concat('https://www.solcom.de/de/p/', id)", "job_id": "id", "work_location_type": "'Remote'",
                "employment_type": "'Freelance'",
            }),
            (2, {
                "title": "'Unknown'", "company": "'SOLCOM Client'", "location": "'Germany'", "link": "concat('p/', id, 'x')",
                "job_id": "concat(id, 'x')", "work_location_type": "'On-site'", "employment_type": "'Freelance'",
            }),
        ],
    ),
    "freelancermap": (
        '<div class="project-card x"><a data-testid="title" href="/projekt/{id}">{title}</a>'
        '<div data-testid="city"><span>{lang}</span>, <b>Wien</b></div><span data-testid="created"> vor {id} Tagen</span></div>'
        '<div class="project-card"><a href="/projekt/none">none</a></div>'
        '<div class="project-card"><a data-testid="title" href="https://f.example/{id}">C &amp; {id}</a></div>',
        [
            (0, {
                "title": "t", "company": "'Freelancermap Client'", "location": "concat(lang, '  Wien')",
                "link": "concat('https://www.freelancermap.de/projekt/', id)", "job_id": "id",
                "posted_at_relative": "concat('vor ', id, ' Tagen')", "work_location_type": "'On-site'",
                "employment_type": "'Freelance'",
            }),
            (2, {
                "title": "concat('C & ', id)", "company": "'Freelancermap Client'", "location": "'Germany'",
                "link": "concat('https://f.example/', id)", "job_id": "id", "work_location_type": "'On-site'",
                "employment_type": "'Freelance'",
            }),
        ],
    ),
    "xing": (
        '<article><h3>{title}</h3><h2>second</h2><a href="/jobs/wien-{id}?ijt=1">open</a></article>'
        '<article><a href="/other/{id}">open</a><h2>no job link</h2></article>'
        '<article><p>unclosed <a href="https://www.xing.com/jobs/b-{id}"> B <i>{id}</i></a></article>',
        [
            (0, {
                "title": "t", "company": "'XING Employer'", "location": "'Germany/Remote'",
                "link": "concat('https://www.xing.com/jobs/wien-', id, '?ijt=1')", "job_id": "concat('wien-', id)",
                "work_location_type": "'On-site'", "employment_type": "'Full-time'",
            }),
            (2, {
                "title": "concat('B', id)", "company": "'XING Employer'", "location": "'Germany/Remote'",
                "link": "concat('https://www.xing.com/jobs/b-', id)", "job_id": "concat('b-', id)",
                "work_location_type": "'On-site'", "employment_type": "'Full-time'",
            }),
        ],
    ),
    "gulp": (
        '<search-project-card><h3><a href="/gulp2/g/projekte/{id}">{title}</a></h3><ul class="small">'
        '<li><i class="fa fa-map-marker"></i> {lang}</li><li><i class="fa fa-history"></i>vor {id} h</li>'
        '<li><i class="fa-laptop-house"></i>ja</li></ul><a class="badge">{source}</a><a class="badge x">{title}</a></search-project-card>'
        '<search-project-card><h3>no link</h3></search-project-card>'
        '<search-project-card><a href="https://www.gulp.de/p/{id}c">C {id}</a><ul class="fa-ul"><li><i class="map-marker"></i>Remote {id}</li></ul>'
        '</search-project-card><div class="list-result-item"><a href="/old">old</a></div>',
        [
            (0, {
                "title": "t", "company": "'GULP Client'", "location": "lang",
                "link": "concat('https://www.gulp.de/gulp2/g/projekte/', id)", "job_id": "id",
                "posted_at_relative": "concat('vor ', id, ' h')", "description": "concat(source, ' | ', t)",
                "work_location_type": "'Remote'", "employment_type": "'Freelance'",
            }),
            (2, {
                "title": "concat('C ', id)", "company": "'GULP Client'", "location": "concat('Remote ', id)",
                "link": "concat('https://www.gulp.de/p/', id, 'c')", "job_id": "concat(id, 'c')",
                "work_location_type": "'Remote'", "employment_type": "'Freelance'",
            }),
        ],
    ),
    "freelance_de": (
        '<div class="list"><div class="project-item"><a href="/projekte/projekt-{id}-{source}">{title} Firmenname sichtbar</a>'
        '<ul class="icon-list"><li><i class="fa-map-marker-alt"></i>{lang} Premiumaccount noetig</li><li>Project Provider: {source} AG</li>'
        '<li><i class="fa-calendar"></i>sofort</li><li>Remote moeglich</li></ul><small class="time-ago">heute {id}</small><p>{text}</p></div>'
        '<div class="project-item"><a href="/firma/{id}">none</a></div>'
        '<div class="project-item"><a href="https://www.freelance.de/search/project.php?id={id}">Z {id}</a></div></div>',
        [
            (0, {
                "title": "t", "company": "concat(source, ' AG')", "location": "lang",
                "link": "concat('https://www.freelance.de/projekte/projekt-', id, '-', source)", "job_id": "id",
                "posted_at_relative": "concat('heute ', id)",
                "description": "concat(t, ' Firmenname sichtbar | ', lang, ' Premiumaccount noetig | Project Provider: ', source, "
                "' AG | sofort | Remote moeglich | heute ', id, ' | ', d)",
                "work_location_type": "'Remote'", "employment_type": "'Freelance'",
            }),
            (2, {
                "title": "concat('Z ', id)", "company": "'Freelance.de Client'", "location": "'Germany/Remote'",
                "link": "concat('https://www.freelance.de/search/project.php?id=', id)",
                "job_id": "concat('project.php?id=', id)", "description": "concat('Z ', id)",
                "work_location_type": "'Remote'", "employment_type": "'Freelance'",
            }),
        ],
    ),
}


def expected_cards(cards) -> str:
    selects = []
    for pos, fields in cards:
        values = {f: "''" for f in CARD_FIELDS} | {"posted_at_relative": "'Recent'"} | fields
        columns = ", ".join(f"{values[f]} AS {f}" for f in CARD_FIELDS)
        selects.append(
            f"SELECT doc_id, {pos} AS pos, {SEARCH}, {columns} FROM ({SOURCE}) WHERE result_limit > {pos}"
        )
    return " UNION ALL ".join(selects)


def offers(spark, sf):
    """Application data with two offers; every third page carries a text that ends it early."""
    s = source(spark, sf)
    first = F.struct(
        F.col("doc_id").alias("id"), F.concat(F.lit(" Ent\u00adwickler "), F.col("id")).alias("title"),
        F.concat(F.lit("<p>"), escaped(F.col("text")), F.lit("</p>")).alias("intro"), F.lit("<ul><li>a<li>b</ul>").alias("tasks"),
        F.when(F.col("doc_id") % 3 == 0, "x};").otherwise("").alias("requirements"), F.lit("").alias("benefits"),
        F.when(F.col("lang") == "de", "Vollzeit").when(F.col("lang") == "fr", "Freiberuflich").otherwise("Teilzeit").alias("jobTypeName"),
        F.when(F.col("lang") == "de", "Mobiles Arbeiten").otherwise("Vor Ort").alias("workplaceTypeName"),
        F.col("lang").alias("locationCity"), F.lit("DE").alias("locationCountry"),
        F.concat(F.lit("/de/job/"), F.col("id"), F.lit("/x")).alias("slug"),
    )
    second = F.struct(
        (F.col("doc_id") + 1).alias("id"), F.lit("Zweite").alias("title"), F.lit("").alias("intro"), F.lit("t").alias("tasks"),
        F.lit("r").alias("requirements"), F.lit("").alias("benefits"), F.lit("Vollzeit").alias("jobTypeName"),
        F.lit("Remote").alias("workplaceTypeName"), F.lit("").alias("locationCity"), F.lit("AT").alias("locationCountry"),
        F.lit("/de/job/2").alias("slug"),
    )
    data = F.to_json(
        F.struct(F.struct(F.struct(F.array(second, first).alias("Offers")).alias("Data")).alias("ControllerResponse"))
    )
    html = F.concat(F.lit("<html><script>var a = 1; App.Data = "), data, F.lit(";</script><p>x</p></html>"))
    return s.withColumn("html", html).withColumn("provider", F.lit("ferchau"))


OFFER_TYPES = {
    "employment_type": "CASE lang WHEN 'de' THEN 'Full-time' WHEN 'fr' THEN 'Freelance' ELSE 'Teilzeit' END",
    "work_location_type": "CASE lang WHEN 'de' THEN 'Remote' ELSE 'Vor Ort' END",
}
OFFER_SECOND = {
    "title": "'Zweite'", "company": "'FERCHAU'", "location": "'AT'", "link": "'https://touch.ferchau.com/de/job/2'",
    "job_id": "cast(doc_id + 1 AS STRING)", "description": "'t r'", "work_location_type": "'Remote'", "employment_type": "'Full-time'",
}
OFFER_FIRST = {
    "title": "concat('Entwickler ', id)", "company": "'FERCHAU'", "location": "concat(lang, ' DE')",
    "link": "concat('https://touch.ferchau.com/de/job/', id, '/x')", "job_id": "id",
    "description": "concat(d, chr(10), 'a', chr(10), 'b')", **OFFER_TYPES,
}

def detail_pages(spark, sf, provider: str):
    """Three kinds of detail page per portal, by document number."""
    s = source(spark, sf)
    markup = F.concat(F.lit("<p>"), escaped(F.col("text")), F.lit("</p><ul><li>eins</li></ul>"))
    ld_object = json_text(
        F.lit("JobPosting").alias("@type"), F.col("title").alias("title"), markup.alias("description"),
        F.struct(F.col("source").alias("name")).alias("hiringOrganization"),
        F.struct(F.struct(F.col("lang").alias("addressLocality")).alias("address")).alias("jobLocation"),
    )
    ld_list = F.concat(
        F.lit('[{"@type": "WebPage", "hiringOrganization": "plain"}, '), ld_object, F.lit("]")
    )
    script = lambda body: F.concat(F.lit('<script type="application/ld+json">'), body, F.lit("</script>"))
    if provider == "linkedin":
        kinds = [
            script(ld_object),
            script(ld_list),
            render('<script type="application/ld+json">not json</script><div class="show-more-less-html__markup">{text}<br>Freelance</div>'),
        ]
    elif provider == "hays":
        kinds = [
            render('<h1>{title}</h1><div class="job-description__content"><p>{text}<style>p { margin: 0 }</style><iframe>no</iframe><p>b</div>'
                   '<div class="job-details__header-location">{lang}</div>'),
            render('<h1>{title}</h1><section class="job-description">{text}</section><p><span>Einsatzort</span> {lang} </p>'),
            render("<h1>{title}</h1><p>{text}</p>"),
        ]
    elif provider == "solcom":
        kinds = [
            render('<div class="main"><div class="project-x"><div class="row"><h1>{title}</h1></div><ul><li>{text}</li><li>b</li></ul></div><p>no</p></div>'),
            render('<div><h1>{title}</h1></div><div class="project-details">{text}</div>'),
            render('<div class="main"><p>{text}</p></div>'),
        ]
    elif provider == "freelancermap":
        state = json_text(
            F.struct(
                F.concat(F.col("title"), F.lit(" ")).alias("title"), F.struct(F.col("source").alias("name")).alias("company"),
                F.col("lang").alias("city"), F.struct(F.lit("Land").alias("localizedName")).alias("country"),
                markup.alias("description"),
                F.struct(F.array(F.struct(F.lit("Java").alias("localizedName")), F.struct(F.col("lang").alias("localizedName"))).alias("enabled")).alias("skills"),
            ).alias("project")
        )
        tag_open = '<script type="application/json" class="js-react-on-rails-component" data-component-name="ProjectShow">'
        kinds = [
            F.concat(F.lit(tag_open), state, F.lit("</script>")),
            F.concat(script(ld_list), render('<div class="ql-editor">{text}</div>')),
            render('<a href="/profil/firma/9">{source} KG</a><div id="project-description">{text}</div>'),
        ]
    elif provider == "xing":
        kinds = [
            F.concat(script(ld_object), render("<main><nav>n</nav><p>{text}</p><footer>f</footer></main>")),
            render('<title>{id} | Jobs</title><div data-testid="html-renderer"><header>h</header>{text}</div>'),
            render("<title>Sign in | XING</title><p>{text}</p>"),
        ]
    elif provider == "gulp":
        kinds = [
            render('<h2 data-testid="projectTitle">{title}</h2><div data-testid="readonlyValue"><p>{text}</p><p>b</p></div>'
                   '<div data-testid="readonlyTagsContainer"><span class="tag">A</span><span class="tag">{lang}</span></div>'
                   '<p><i class="fa map-marker-alt"></i><b>Location:</b> {lang}</p>'),
            render('<h1>{title}</h1><div class="description-content">{text}</div>'),
            render("<h1>{title}</h1><p>{text}</p>"),
        ]
    else:
        kinds = [
            render('<h1>{title} - freelance.de</h1><div class="panel-body">{text}</div><span class="badge">A</span><b class="my-skill">{lang}</b>'
                   '<ul class="overview"><li><i class="fa-map-marker"></i>Ort A</li><li><i class="fa-building"></i>{source} SE</li>'
                   '<li><i class="fa-location"></i>{lang}</li></ul>'),
            render('<h1>{title} Firmenname x</h1><div id="project-description">{text}</div>'),
            render("<p>{text}</p>"),
        ]
    i = F.col("doc_id") % 3
    html = F.when(i == 0, kinds[0]).when(i == 1, kinds[1]).otherwise(kinds[2])
    return s.select("doc_id", F.col("id").alias("link"), F.lit(provider).alias("provider"), html.alias("html"))


WITH_ITEM = "concat(d, chr(10), 'eins')"


def _types(value: str) -> dict[str, str]:
    low = f"lower({value})"
    remote = " OR ".join(f"contains({low}, {quoted(w)})" for w in ("remote", "home office", "home-office", "wfh", "telecommute", "mobil", "ortsunabhängig"))
    hybrid = " OR ".join(f"contains({low}, {quoted(w)})" for w in ("hybrid", "mischform", "flexibel"))
    contract = " OR ".join(f"contains({low}, {quoted(w)})" for w in ("contract", "freelance", "freiberuflich", "project", "befristet", "projektbasiert"))
    intern = " OR ".join(f"contains({low}, {quoted(w)})" for w in ("intern", "praktikant", "student", "thesis", "werkstudent"))
    return {
        "description": value,
        "work_location_type": f"CASE WHEN {remote} THEN 'Remote' WHEN {hybrid} THEN 'Hybrid' ELSE 'On-site' END",
        "employment_type": f"CASE WHEN {contract} THEN 'Contract' WHEN {intern} THEN 'Internship' ELSE 'Full-time' END",
    }


EMPTY = {"description": "''"}
# Per portal: the fields expected of the three kinds of detail page.
DETAILS: dict[str, list[dict[str, str]]] = {
    "linkedin": [_types(WITH_ITEM), _types(WITH_ITEM), _types("concat(d, chr(10), 'Freelance')")],
    "hays": [
        {"description": "concat(d, chr(10), 'b')", "title": "t", "company": "'Hays Client'", "location": "lang"},
        {"description": "d", "title": "t", "company": "'Hays Client'", "location": "lang"},
        EMPTY,
    ],
    "solcom": [
        {"description": "concat(t, chr(10), d, chr(10), 'b', chr(10), chr(10), 'SKILLS EXTRACT:', chr(10), d, chr(10), 'b')",
         "title": "t", "company": "'SOLCOM Client'"},
        {"description": "concat(d, chr(10), chr(10), 'SKILLS EXTRACT:', chr(10))", "title": "t", "company": "'SOLCOM Client'"},
        EMPTY,
    ],
    "freelancermap": [
        {"description": f"concat({WITH_ITEM}, chr(10), chr(10), 'Skills: Java, ', lang)", "title": "t", "company": "source",
         "location": "concat(lang, ' Land')"},
        {"description": "d", "title": "''", "company": "source", "location": "lang"},
        {"description": "d", "title": "''", "company": "concat(source, ' KG')", "location": "''"},
    ],
    "xing": [
        {"description": "d", "title": "t", "company": "source", "location": "lang"},
        {"description": "d", "title": "id", "company": "'XING Employer'", "location": "'Germany'"},
        EMPTY,
    ],
    "gulp": [
        {"description": "concat(d, chr(10), 'b', chr(10), chr(10), 'Skills: A, ', lang)", "title": "t", "company": "'GULP Client'",
         "location": "lang"},
        {"description": "d", "title": "t", "company": "'GULP Client'", "location": "'Germany'"},
        EMPTY,
    ],
    "freelance_de": [
        {"description": "concat(d, chr(10), chr(10), 'Skills & Keywords: A, ', lang)", "title": "t", "company": "concat(source, ' SE')",
         "location": "lang"},
        {"description": "d", "title": "t", "company": "'Freelance.de Client'", "location": "'Germany/Remote'"},
        {"description": "''", "title": "''", "company": "'Freelance.de Client'", "location": "'Germany/Remote'"},
    ],
}


def expected_details(kinds: list[dict[str, str]]) -> str:
    selects = []
    for i, fields in enumerate(kinds):
        columns = ", ".join(f"{fields.get(f, 'NULL::STRING')} AS {f}" for f in DETAIL_FIELDS)
        selects.append(f"SELECT doc_id, {columns} FROM ({SOURCE}) WHERE doc_id % 3 = {i}")
    return " UNION ALL ".join(selects)


def register(c: Catalog) -> None:
    def cards_query(provider: str, template: str, cards) -> None:
        @c.add(f"{provider}_cards", expected_cards(cards))
        def cards_of(spark, sf):
            pages = source(spark, sf).withColumns({"html": render(template), "provider": F.lit(provider)})
            wanted = pages.select("doc_id", "provider", "query", "location", "result_limit", "html")
            return extract_cards(wanted).select("doc_id", "pos", "search_criteria", *CARD_FIELDS)

    for provider, (template, cards) in CARDS.items():
        cards_query(provider, template, cards)

    first = expected_cards([(0, OFFER_SECOND | {"description": "concat('t', ' ', 'r')"}), (1, OFFER_FIRST)])

    @c.add("ferchau_cards", f"SELECT * FROM ({first}) WHERE doc_id % 3 <> 0")
    def ferchau_cards(spark, sf):
        pages = offers(spark, sf).select("doc_id", "provider", "query", "location", "result_limit", "html")
        return extract_cards(pages).select("doc_id", "pos", "search_criteria", *CARD_FIELDS)

    def details_query(provider: str, kinds) -> None:
        @c.add(f"{provider}_details", expected_details(kinds))
        def details_of(spark, sf):
            return extract_details(detail_pages(spark, sf, provider)).select("doc_id", *DETAIL_FIELDS)

    for provider, kinds in DETAILS.items():
        details_query(provider, kinds)

    def offer_columns(fields) -> str:
        return ", ".join(f"{fields[f]} AS {f}" for f in DETAIL_FIELDS)

    nothing = ", ".join(f"{EMPTY.get(f, 'NULL::STRING')} AS {f}" for f in DETAIL_FIELDS)

    @c.add(
        "ferchau_details",
        f"""SELECT doc_id, {offer_columns(OFFER_FIRST)} FROM ({SOURCE}) WHERE doc_id % 3 <> 0 AND lang <> 'es'
            UNION ALL SELECT doc_id, {offer_columns(OFFER_SECOND)} FROM ({SOURCE}) WHERE doc_id % 3 <> 0 AND lang = 'es'
            UNION ALL SELECT doc_id, {nothing} FROM ({SOURCE}) WHERE doc_id % 3 = 0""",
    )
    def ferchau_details(spark, sf):
        """The link's own offer comes second on the page; one language links to an offer not on it."""
        number = F.when(F.col("lang") == "es", F.lit("x")).otherwise(F.col("id"))
        link = F.concat(F.lit("https://touch.ferchau.com/de/job/"), number, F.lit("/x"))
        pages = offers(spark, sf).select("doc_id", link.alias("link"), "provider", "html")
        return extract_details(pages).select("doc_id", *DETAIL_FIELDS)
