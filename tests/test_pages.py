"""Pages: node arrays, embedded data in all its shapes, fallbacks."""

import json
import time

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stellwerk.functions import html
from stellwerk.catalog import build
from stellwerk.functions.html import HIDDEN_TEXT, PIECE_CHARS, Dom, html_nodes, parse_nodes, tag, whole_references
from stellwerk.operators.cards import CardRules, extract_cards, offers_unreadable, register_cards
from stellwerk.operators.details import extract_details
from tests.compare import compare


def texts(spark, html, sql):
    return spark.createDataFrame([(html,)], "h string").select(html_nodes("h").alias("n")).select(F.expr(sql)).first()[0]


@pytest.mark.parametrize(
    "html, expected",
    [
        ("<p>a<p>b<br>c</div>d", "a|b|c|d"),
        ("x<!-- no -->y", "x|y"),
        ("<script>var t='</p>';</script><style>p{}</style>a", "a"),
        ("a &amp; b &lt;c&gt; &euro;5", "a & b <c> €5"),
        ("<template><b>no</b></template><b> yes </b>", "yes"),
        ("<div/>a<b/>c", "a|c"),
        ("", ""),
        ("no markup", "no markup"),
        ("<ul><li>a<li>b</ul>c", "a|b|c"),
    ],
)
def test_visible_text(spark, html, expected):
    assert texts(spark, html, Dom("n").text("|")) == expected


def test_end_tag_closes_what_was_opened_since():
    rows = parse_nodes("<ul><li>a<li>b</ul><p>c")
    spans = [(r[3], r[0], r[1]) for r in rows if r[3]]
    assert spans == [("ul", 1, 5), ("li", 2, 5), ("li", 4, 5), ("p", 6, 7)]


def test_removed_subtrees_and_order(spark):
    html = "<main>a<nav>n<b>m</b></nav>b<footer>f</footer></main>"
    assert texts(spark, html, Dom("n").first(tag("main"), lambda d: d.text("|", without=("nav", "footer")))) == "a|b"
    assert texts(spark, html, Dom("n").first_text(tag("h1"))) is None
    assert texts(spark, "<b>1</b><b>2</b>", Dom("n").last(tag("b"), lambda d: d.text())) == "2"
    assert texts(spark, "<b>it's \\ \"</b>", Dom("n").first_text(tag("b"))) == "it's \\ \""


def details(spark, provider, *pages, link="l"):
    df = spark.createDataFrame([(str(i), provider, h) for i, h in enumerate(pages)], "link string, provider string, html string")
    if link != "l":
        df = df.withColumn("n", F.col("link")).withColumn("link", F.lit(link))
    return [r.asDict() for r in extract_details(df).orderBy("n" if link != "l" else "link").collect()]


def ld(value):
    body = value if isinstance(value, str) else json.dumps(value)
    return f'<script type="application/ld+json">{body}</script>'


def test_json_ld_shapes_for_linkedin(spark):
    box = '<div class="x show-more-less-html__markup">box</div>'
    got = details(
        spark,
        "linkedin",
        ld({"description": "<p>obj</p> Remote"}) + box,
        ld([{"x": 1}, {"description": "second"}, {"description": "third"}]) + box,
        ld("{broken") + box,
        ld({"description": ""}) + '<section class="description">Werkstudent hybrid</section>',
        "<p>nothing</p>",
    )
    assert [g["description"] for g in got] == ["obj\nRemote", "second", "box", "Werkstudent hybrid", ""]
    assert [g["work_location_type"] for g in got] == ["Remote", "On-site", "On-site", "Hybrid", None]
    assert [g["employment_type"] for g in got] == ["Full-time", "Full-time", "Full-time", "Internship", None]


def test_json_ld_shapes_for_xing(spark):
    place = {"address": {"addressLocality": "Wien"}}
    got = details(
        spark,
        "xing",
        ld({"title": "T", "hiringOrganization": {"name": "O"}, "jobLocation": place}),
        ld({"title": "T", "hiringOrganization": "plain", "jobLocation": [place, {}]}),
        ld([{"title": "L"}]),
        "<title>Job | Portal</title>",
        "<title>Sign in | XING</title>",
        "<h1>H</h1><main><script>x</script>d</main>",
    )
    assert [g["title"] for g in got] == ["T", "T", "L", "Job", None, "H"]
    assert [g["company"] for g in got] == ["O", "XING Employer", "XING Employer", "XING Employer", None, "XING Employer"]
    assert [g["location"] for g in got] == ["Wien", "Wien", "Germany", "Germany", None, "Germany"]
    assert [g["description"] for g in got] == ["", "", "", "", "", "d"]


def test_embedded_state_for_freelancermap(spark):
    def state(**project):
        return (
            '<script class="js-react-on-rails-component" data-component-name="ProjectShow">'
            + json.dumps({"project": project})
            + "</script>"
        )

    posting = {"@type": "JobPosting", "hiringOrganization": {"name": " LD "}, "jobLocation": {"address": {"addressLocality": "Graz"}}}
    got = details(
        spark,
        "freelancermap",
        state(title=" T ", company="Plain", city="Ulm", country={"localizedName": "DE"}, description="<b>x</b>y"),
        state(title="T", company={"name": "N"}, skills={"enabled": [{"localizedName": "A"}, {"localizedName": "B"}]}) + ld(posting),
        ld({"@type": "Other"}) + ld([posting]),
        ld("broken") + ld(posting) + '<div class="company-name">C</div>',
    )
    assert [(g["title"], g["company"], g["location"]) for g in got] == [
        ("T", "Plain", "Ulm DE"), ("T", "N", "Graz"), ("", "LD", "Graz"), ("", "C", ""),
    ]
    assert [g["description"] for g in got] == ["x\ny", "\n\nSkills: A, B", "", ""]


def test_label_and_parent_lookup(spark):
    got = details(
        spark,
        "hays",
        '<div class="h-text">d</div><p><span>Einsatzort</span>Ulm</p>',
        '<article>d</article>',
        '<div class="job-details-content"></div>',
    )
    assert [(g["description"], g["location"]) for g in got] == [("d", "Ulm"), ("d", None), ("", None)]
    got = details(spark, "gulp", '<div class="project-details">d</div><i class="fa-map-marker"></i>Location: Bonn')
    assert got[0]["location"] == "d Bonn".replace(" ", "") or got[0]["location"].endswith("Bonn")


def offers(*items):
    return "<script>App.Data = " + json.dumps({"ControllerResponse": {"Data": {"Offers": list(items)}}}) + ";</script>"


def test_offer_of_the_link_comes_first(spark):
    page = offers({"id": 1, "title": "one"}, {"id": 2, "title": "two", "workplaceTypeName": "Mobil"})
    url = "https://touch.ferchau.com/de/job/{}/x"
    for number, title in ((2, "two"), (3, "one")):
        assert details(spark, "ferchau", page, link=url.format(number))[0]["title"] == title
    df = spark.createDataFrame([(url.format(3), "ferchau", page)], "link string, provider string, html string")
    assert extract_details(df, strict_target=True).first()["title"] is None


def test_offer_text_with_end_mark_makes_the_page_unreadable(spark):
    bad, good = offers({"id": 1, "title": "a};b"}), offers({"id": 1, "title": "ab"})
    df = spark.createDataFrame([(bad,), (good,), ("<p>",)], "html string")
    assert [r[0] for r in df.select(offers_unreadable(F.col("html"))).collect()] == [True, False, False]
    assert details(spark, "ferchau", bad)[0]["description"] == ""


def cards(spark, provider, html, limit=10):
    df = spark.createDataFrame(
        [(provider, "q", "l", limit, html)], "provider string, query string, location string, result_limit int, html string"
    )
    return extract_cards(df).orderBy("pos").collect()


def test_limit_cuts_before_unreadable_cards_go(spark):
    card = '<article><a href="/jobs/{0}">{0}</a></article>'
    html = card.format("a") + "<article>none</article>" + card.format("b")
    assert [r["title"] for r in cards(spark, "xing", html)] == ["a", "b"]
    assert [r["title"] for r in cards(spark, "xing", html, 2)] == ["a"]


def test_blocked_page_yields_nothing(spark):
    html = (
        '<div class="contenance-solcom-portal-project-item"><div class="project-header"><a href="/x"><h2>T</h2></a></div></div>'
    )
    assert len(cards(spark, "solcom", html)) == 1
    assert cards(spark, "solcom", html + "Kundeninformation") == []


def test_further_portal_by_rules(spark):
    rules = CardRules((tag("section"),), lambda c, _: {"title": c.first_text(tag("h5")), "href": c.first_attr(tag("a"), "href")}, "Full-time")
    register_cards("other", rules)
    got = cards(spark, "other", '<section><h5>T</h5><a href="http://o/9">x</a></section><section>none</section>')
    assert [(r["title"], r["link"], r["job_id"], r["employment_type"]) for r in got] == [("T", "http://o/9", "9", "Full-time")]


def test_unclosed_tags_are_read_in_linear_time():
    def spent(n):
        start = time.process_time()
        assert len(parse_nodes("<p>x" * n)) == 2 * n
        return time.process_time() - start

    spent(1000)
    assert spent(16_000) < 12 * max(spent(4000), 0.005)
    rows = parse_nodes("<div><style>a</style>b<b>c</div>d</b>")
    assert [(r[3], r[5]) for r in rows if r[5]] == [(HIDDEN_TEXT, "a"), ("", "b"), ("", "c"), ("", "d")]


@pytest.mark.parametrize("name", ["page_nodes", "page_text"])
def test_pages_cut_off_within_a_reference_are_read_as_their_sql_says(spark, tmp_path, name):
    pages = [
        (0, "<h1>a &amp; b&amp</h1><li>x &copy</li><p>&quot;c&quot; &middot d&quo</p>"), (1, "<h1>&copy; e</h1><p>a && b &amp;amp</p>"),
        (2, '<a href="/x?a=1&copy=2&b">t</a><li>&amp;copy</li>'), (3, None),
    ]
    spark.createDataFrame(pages, "page_id long, html string").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    catalog = build()
    assert compare(catalog.queries[name](spark, str(tmp_path)).toPandas(), con.execute(catalog.sql[name]).df()) is None


def test_only_references_with_their_semicolon(spark):
    html = "&amp; &amp &#38; &#38 &#x26; &euro;5 &copy=1 &"
    assert spark.createDataFrame([(html,)], "h string").select(whole_references(F.col("h"))).first()[0] == (
        "&amp; &amp;amp &#38; &amp;#38 &#x26; &euro;5 &amp;copy=1 &amp;"
    )


def test_a_batch_of_pages_goes_back_in_pieces():
    """What a worker holds as nodes follows the page, not the batch."""
    page = "<p>a</p>" * (PIECE_CHARS // 20)
    batch = pa.array([page, None, page, page, "", page, "<b>x"])
    pieces = list(html_nodes.func(iter([batch, pa.array([None], pa.string())])))
    assert [len(x) for x in pieces] == [4, 3, 1]
    assert [None if x is None else len(x) for piece in pieces for x in piece.to_pylist()] == [
        None if h is None else len(parse_nodes(h)) for h in [*batch.to_pylist(), None]
    ]


def test_a_page_that_follows_itself_is_parsed_once(monkeypatch):
    """Several captures of one page; unreadable and missing pages stay NULL, equal pages further apart are their own."""
    a, b = "<p class='x'>a &amp; b</p>", "<div>c<br>d</div>"
    pages = [None, None, a, a, a, b, a, "", "", "<![if", "<![if", None]
    expected = [nodes for page in pages for nodes in html._node_array([page]).to_pylist()]
    parsed = []
    read = html.parse_nodes
    monkeypatch.setattr(html, "parse_nodes", lambda page: parsed.append(page) or read(page))
    assert html._node_array(pages).to_pylist() == expected
    assert parsed == [a, b, a, "", "<![if"]
