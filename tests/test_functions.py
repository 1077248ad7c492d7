"""Hand-worked rows for the column expressions."""

import math
import random
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewire.functions import dates, html, numeric, text, themes, urls
from tidewire.plans import news_panel


def column(spark, values, expression, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}").coalesce(1)
    return [r[0] for r in rows.orderBy("i").select(expression(F.col("v"))).collect()]


def test_urls(spark):
    given_urls = [
        "HTTP://www.Ex.com:80/A/b//?q=1#f",
        "https://m.x.org",
        "no-scheme/path/",
        "   ",
        None,
        "http://[bad/Path",
        " https://a.b/c\n",
        "https://user@WWW.Ex.com/p",
    ]
    assert column(spark, given_urls, urls.normalize_url) == [
        "http://ex.com:80/A/b",
        "https://m.x.org",
        "no-scheme/path",
        None,
        None,
        "http://[bad/path",
        "https://a.b/c",
        "https://user@www.ex.com/p",
    ]
    assert column(spark, given_urls, urls.domain_of)[:4] == ["www.ex.com:80", "m.x.org", "", ""]


def test_navigation_urls(spark):
    values = ["/tag/x", "/Authors/", "/category/", "/story/", None]
    assert column(spark, values, urls.is_navigation) == [True, True, True, False, False]


def test_whitespace(spark):
    values = [" a  b\x1c\n", "　", "", None]
    assert column(spark, values, text.collapse_whitespace) == ["a b", "", "", None]
    assert column(spark, values, text.clean_extracted) == ["a b", None, None, None]
    assert column(spark, values, text.strip) == ["a  b", "", "", None]
    assert column(spark, values, text.has_visible) == [True, False, False, None]
    assert column(spark, ["﻿a ï»¿b"], text.clean_article) == ["a b"]


def test_long_whitespace_run_is_linear(spark):
    value = "a" + " " * 200_000 + "b"
    assert column(spark, [value], lambda c: F.length(text.strip(c))) == [200_002]


def test_encoding_repair(spark):
    values = ["itâ€™s", "aâ€¦", "Â5", "aâ€”b", "aâ€“b", "â€œxâ€", None]
    assert column(spark, values, text.fix_encoding) == ["it's", "a...", "5", "a-b", "a-b", '"x"', None]


@pytest.mark.parametrize(
    "value, alpha, latin, noise, flag",
    [
        ("abc 123", 3 / 7, 1.0, 0.0, "low_alpha"),
        ("¿Qué?", 3 / 5, 1.0, 1 / 5, "encoding_noise"),
        ("Жa", 1.0, 0.5, 0.0, "ok"),
        ("¿1", 0.0, 0.0, 1 / 2, "encoding_noise"),
        ("", 0.0, 0.0, 0.0, "low_alpha"),
        ("a×÷", 1 / 3, 1.0, 0.0, "low_alpha"),
    ],
)
def test_quality(spark, value, alpha, latin, noise, flag):
    row = column(
        spark,
        [value],
        lambda c: F.struct(
            text.alpha_ratio(c), text.latin_ratio(c), text.noise_ratio(c),
            text.quality_flag(text.alpha_ratio(c), text.noise_ratio(c)),
        ),
    )[0]
    assert row[:3] == pytest.approx((alpha, latin, noise))
    assert row[3] == flag


def test_word_and_junk_rules(spark):
    assert column(spark, ["More, moreover more éMore"], lambda c: text.count_word(c, "more")) == [2]
    assert column(spark, ["a - - b - c"], lambda c: text.count_substring(c, " - ")) == [2]
    values = ["more " * 8, "more " * 9, "Video " * 9, "x #name? y", " - " * 41, "moreover " * 20]
    assert column(spark, values, text.has_junk) == [False, True, True, True, True, False]


def test_english_rule(spark):
    rows = spark.createDataFrame(
        [("en", 0.85, "ok"), ("en", 0.84, "ok"), ("fr", 1.0, "ok"), ("en", 1.0, "low_alpha"), (None, 1.0, "ok")],
        "lang string, latin double, flag string",
    )
    found = rows.select(text.is_english(F.col("lang"), F.col("latin"), F.col("flag")).alias("e")).collect()
    assert [r.e for r in found] == [True, False, False, False, False]


THEMES = [
    ("ENV_CLIMATECHANGE;WB_WIND", (1, 0, 1, 0, 0, 1, 0)),
    ("TAX_CARBON_TAX;ENERGY", (1, 1, 0, 1, 1, 1, 1)),
    ("SOIL_EMISSIONS", (1, 1, 0, 1, 0, 1, 1)),
    ("ECON_OILPRICE", (0, 0, 0, 1, 0, 0, 0)),
    (None, (0, 0, 0, 0, 0, 0, 0)),
]


def articles(spark):
    tones = ["1.5,2,3", "-2,0", "0,1", "", "abc"]
    rows = [(20240105101500, f"u{i}", "s", t, tones[i], "2024-01-05") for i, (t, _) in enumerate(THEMES)]
    rows.append((20240105101500, "x", "s", "BUSINESS_CLIMATE;CARBON", "9", "2024-01-05"))
    rows.append((20240201000000, "late", "s", "CARBON", "9", "2024-02-01"))
    schema = "DATE bigint, DocumentIdentifier string, SourceCommonName string, V2Themes string, V2Tone string, d string"
    return spark.createDataFrame(rows, schema).withColumn("ingest_date", F.col("d").cast("date")).drop("d")


def test_theme_flags(spark):
    tagged = news_panel.tag_articles(news_panel.scan_articles(articles(spark), "2024-01-01", "2024-01-31"))
    names = ["is_climate", "is_carbon", "is_cleantech", "is_energy", "is_policy", "is_relevant", "is_transition"]
    rows = {r["url"]: r for r in tagged.collect()}
    assert sorted(rows) == [f"u{i}" for i in range(5)]
    for i, (_, flags) in enumerate(THEMES):
        assert tuple(rows[f"u{i}"][n] for n in names) == flags
    assert [rows[f"u{i}"]["tone_score"] for i in range(5)] == [1.5, -2.0, 0.0, None, None]
    assert rows["u2"]["positive_tone_component"] is None and rows["u2"]["negative_tone_component"] is None
    assert all(r["is_climate"] >= r["is_carbon"] for r in rows.values())


def test_daily_tone_over_all_rows(spark):
    tagged = news_panel.tag_articles(news_panel.scan_articles(articles(spark), "2024-01-01", "2024-01-31"))
    row = news_panel.daily_aggregate(tagged).first()
    assert row["avg_tone"] == pytest.approx(-0.5 / 3)
    assert (row["avg_positivity"], row["avg_negativity"]) == (1.5, 2.0)


def test_panel_invariants(spark):
    row = news_panel.daily_news_panel(articles(spark), "2024-01-01", "2024-01-31").first()
    assert row["n_climate"] == row["n_articles"] and row["share_climate"] == 1.0
    assert row["share_transition"] == row["share_energy"]


def test_theme_patterns_with_special_characters(spark):
    match = lambda c: themes.matches_any(c, ["a.c", "plain"])
    assert column(spark, ["abc", "xplainx", "ac"], match) == [True, True, False]


def test_numbers(spark):
    assert column(spark, ["1.5", "x", "NaN", "", None], numeric.number) == [1.5, None, None, None, None]
    assert column(spark, [2.0, 0.0, -1.0], numeric.safe_ln, "double") == [math.log(2.0), None, None]
    assert column(spark, [0.9, 0.5, 0.1, 0.3], numeric.is_sure, "double") == [True, False, True, False]
    assert column(spark, [0.5, 0.49], numeric.binary_label, "double") == [1, 0]
    assert column(spark, [1, 0, None], numeric.label_name, "int") == ["climate_yes", "climate_no", None]


def test_scores(spark):
    pairs = [[0.0, 0.0], [1000.0, 0.0]]
    assert column(spark, pairs, numeric.softmax, "array<double>") == [[0.5, 0.5], [1.0, 0.0]]
    assert column(spark, pairs, numeric.argmax, "array<double>") == [0, 0]
    assert column(spark, [0.0], numeric.sigmoid, "double") == [0.5]


def entropy(spark, buckets):
    rows = spark.createDataFrame([tuple(buckets)], ", ".join(f"b{i} bigint" for i in range(6)))
    return rows.select(numeric.entropy([F.col(f"b{i}") for i in range(6)])).first()[0]


def test_entropy(spark):
    assert entropy(spark, (1, 1, 0, 0, 0, 0)) == pytest.approx(0.693147, abs=1e-6)
    assert entropy(spark, (0,) * 6) == 0
    assert entropy(spark, (3, 0, 0, 0, 0, 0)) == pytest.approx(0, abs=1e-9)
    assert entropy(spark, (None, 2, 0, 0, 0, 0)) == pytest.approx(0, abs=1e-9)


def test_dates(spark):
    found = column(spark, [20240229235959, 20241301000000, None], dates.compact_timestamp, "bigint")
    assert [str(v) if v else None for v in found] == ["2024-02-29 23:59:59", None, None]
    found = column(spark, ["31/12/2021", "2021-12-31", None], dates.day_first_date)
    assert [str(v) if v else None for v in found] == ["2021-12-31", None, None]


def test_html_entities(spark):
    values = ["a &amp;lt; b", "&#8217;&#x1F600;&eacute;&nope &", "x&nbsp;y", "&#55296;&#0;", "plain"]
    assert column(spark, values, html.decode_entities) == [
        "a &lt; b", "’😀é&nope &", "x\u00a0y", "&#55296;&#0;", "plain"
    ]


def test_html_readings(spark):
    page = """<html><body><nav>menu</nav><script>if (a > b) "</p>";</script><!-- <p>no</p> -->
      <p>One <b>bo</b>ld &amp; more</p><p>a < b</p><footer>foot</footer></body></html>"""
    assert column(spark, [page], html.primary_text) == ["One bold & more a < b"]
    assert column(spark, ["<article>x<br>y</article><p>z</p>", "no tags"], html.primary_text) == ["x y", None]
    pages = [
        "<article>one</article><div>between</div><article>two</article>",
        "<p>first<p>second <b>x</b><div>no</div><p>last",
        "<p>seen</p><script>var code = 1; <p>hidden</p>",
        "<p>caf&eacute; &uuml;ber &nbsp;&CounterClockwiseContourIntegral;</p>",
    ]
    assert column(spark, pages, html.primary_text) == ["one two", "first second x last", "seen", "café über ∳"]
    page = """<head>title</head><body><header><a href=x>home</a></header><div>long line</div><div>short</div>
      <ul><li><a href=y>menu item</a></li><li>real item with <a href=z>link</a></li></ul><select><option>1</option></select></body>"""
    assert column(spark, [page, "<body><a>only</a></body>"], html.fallback_text) == ["long line short real item with link", None]


@settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))
@given(values=st.lists(st.text(max_size=40).filter(lambda v: "\x00" not in v and v.isprintable()), min_size=1, max_size=20))
def test_properties(spark, values):
    once = column(spark, values, urls.normalize_url)
    plain = [v for v in once if v and "[" not in v and "]" not in v]
    if plain:
        assert column(spark, plain, lambda c: F.lower(urls.normalize_url(c))) == [v.lower() for v in plain]
    for ratio in (text.alpha_ratio, text.latin_ratio, text.noise_ratio):
        assert all(0 <= r <= 1 for r in column(spark, values, ratio))
    alpha = [sum(c.isalpha() for c in v) / len(v) if v else 0.0 for v in values]
    assert column(spark, values, text.alpha_ratio) == pytest.approx(alpha)
    collapsed = column(spark, values, text.collapse_whitespace)
    assert collapsed == [" ".join(v.split()) for v in values]


@settings(max_examples=10, deadline=None, suppress_health_check=list(HealthCheck))
@given(buckets=st.tuples(*[st.integers(0, 1000)] * 6))
def test_entropy_range(spark, buckets):
    assert -1e-8 <= entropy(spark, buckets) <= math.log(6) + 1e-9


def plain_parts(page, furniture):
    """Page and article by a stack over tags, character by character marked hidden or inside."""
    tag = re.compile(rf"</?({'|'.join((*furniture, 'article'))})(?:[\s/][^>]*)?>", re.I)
    hidden, inside, stack = [False] * len(page), [False] * len(page), []
    for m in tag.finditer(page):
        name, closing = m[1].lower(), m[0].startswith("</")
        if not closing:
            stack.append((name, m.end()))
        elif name in [n for n, _ in stack]:
            while True:
                top, start = stack.pop()
                for i in range(start, m.start()):
                    hidden[i] |= top != "article"
                    inside[i] |= top == "article"
                if top == name:
                    break
    for name, start in stack:
        for i in range(start, len(page)):
            inside[i] |= name == "article"
    bare = [False] * len(page)
    for m in tag.finditer(page):
        bare[m.start() : m.end()] = [True] * (m.end() - m.start())
    words = [[c if not h and not b else " " for c, h, b in zip(page, hidden, bare)], [c if not h and not b and a else " " for c, h, b, a in zip(page, hidden, bare, inside)]]
    return tuple("".join(w).split() for w in words)


def test_nested_elements_against_a_stack(spark):
    draw = random.Random(3)
    names = ("nav", "aside", "form", "footer", "article", "NAV", "Article")
    pages = [
        "<article>A<article>c</article>B</article>",
        "<nav>a<nav>b</nav>tail</nav>text",
        "<aside>x<form>y</aside>z</form> w",
        "<article>a<nav>m</article>b</nav>c",
        "<nav>never closed <article>kept",
        "<navigation>no tag</navigation><aside/>open",
        "</nav></article>stray",
        "",
    ]
    for _ in range(300):
        parts = []
        for k in range(draw.randrange(14)):
            name = draw.choice(names)
            parts += [draw.choice(("<%s>", "<%s class='x'>", "</%s>", "</%s >")) % name, f" w{k} "]
        pages.append("".join(parts))
    rows = spark.createDataFrame(list(enumerate([*pages, None])), "id int, html string")
    found = {r["id"]: r["p"] for r in rows.select("id", html.visible_parts(F.col("html"), html.FURNITURE).alias("p")).collect()}
    assert found[len(pages)] is None
    for i, page in enumerate(pages):
        wanted = plain_parts(page, html.FURNITURE)
        assert (found[i]["page"].split(), found[i]["article"].split()) == wanted, page


def test_main_text_of_nested_pages(spark):
    cases = {
        "<article>A<article>c</article>B</article>": "A c B",
        "<article><p>one</p><aside>x<aside>y</aside>leak</aside><p>two</p></article>": "one two",
        "<nav><article>teaser</article></nav><p>prose</p>": "prose",
        "<form>f<nav>n</form></nav><p>after</p>": "after",
        "<article>open <b>end</b>": "open end",
    }
    rows = spark.createDataFrame([(k,) for k in cases], "html string")
    found = {r["html"]: r["t"] for r in rows.select("html", html.primary_text(F.col("html")).alias("t")).collect()}
    assert found == cases
