import hashlib
import html

import pytest
from pyspark.sql import functions as F

from setledger.functions import markers, numbers, text, times, urls, vectors


def values(df, column):
    return [r[0] for r in df.select(column).collect()]


SPACES = "".join(chr(i) for i in range(0x110000) if chr(i).isspace())


def test_words_split_like_unicode_white_space(rows):
    cases = ["", "  ", "a b", "\xa0a\x85b c\x1cd\n", *[f"x{s}y" for s in SPACES], "zero​width"]
    df = rows("i int, s string", *enumerate(cases)).orderBy("i")
    assert values(df, text.words(F.col("s"))) == [c.split() for c in cases]
    assert values(df, text.strip(F.col("s"))) == [c.strip() for c in cases]
    assert values(df, text.excerpt(F.col("s"), 3)) == [" ".join(c.split())[:3] for c in cases]


def test_normalize_and_tokens(rows):
    df = rows("s string", ("  Leg press (hinge ) 45! ",))
    assert values(df, text.normalize_text(F.col("s"))) == ["leg press hinge 45"]
    assert values(df, text.token_set(F.concat("s", "s"))) == [["leg", "press", "hinge", "45"]]


def test_bad_bytes_are_dropped(spark):
    df = spark.sql("SELECT decode(X'61FF62', 'ISO-8859-1') AS s, CAST(X'61FF62' AS STRING) AS raw")
    assert values(df, text.drop_bad_bytes(F.col("raw"))) == ["ab"]


@pytest.mark.parametrize("given, expected", [
    ("5", 5.0), (" 2.5 ", 2.5), ("-1e2", -100.0), (".5", 0.5), ("5d", None), ("5f", None), ("nan", None),
    ("1_000", None), ("", None), (None, None), ("abc", None)])
def test_parse_number(rows, given, expected):
    df = rows("s string", (given,))
    assert values(df, numbers.parse_number(F.col("s"))) == [expected]
    assert values(df, numbers.coerce_number(F.col("s"))) == [0.0 if expected is None else expected]


def test_format_number(rows):
    df = rows("i int, x double", (0, 5.0), (1, 2.25), (2, 2.5), (3, None), (4, float("nan")), (5, 0.04)).orderBy("i")
    assert values(df, numbers.format_number(F.col("x"))) == ["5", "2.2", "2.5", "unknown", "unknown", "0"]


def test_dates(spark):
    df = spark.sql("SELECT TIMESTAMP_NTZ '2024-01-01 10:20:30.75' AS t UNION ALL SELECT TIMESTAMP_NTZ '2023-11-12 00:00:00'"
                   " UNION ALL SELECT TIMESTAMP_NTZ '2022-12-22 23:59:59' UNION ALL SELECT NULL").orderBy(F.desc("t"))
    t = F.col("t")
    assert values(df, times.pretty_date(t)) == ["January 1st, 2024", "November 12th, 2023", "December 22nd, 2022", None]
    assert values(df, times.iso_seconds(times.truncate_seconds(t)))[0] == "2024-01-01T10:20:30"
    assert values(df, times.epoch_seconds(t)) == [1704104430, 1699747200, 1671753599, 0]
    assert values(df, times.format_date(t)) == ["2024-01-01", "2023-11-12", "2022-12-22", "unknown date"]
    assert values(df, times.iso_seconds(times.start_of_week(t)))[1] == "2023-11-06T00:00:00"
    assert values(df, times.iso_seconds(times.next_midnight(t)))[2] == "2022-12-23T00:00:00"


def test_unreadable_date_is_shown_as_it_came(rows):
    df = rows("s string", ("soon",))
    parsed = times.parse_timestamp(F.col("s"))
    assert values(df, times.format_date(parsed, F.col("s"))) == ["soon"]


@pytest.mark.parametrize("url, stem, site, video", [
    ("https://journal.iusca.org/index.php/Journal/article/view/361", "361", "journal.iusca.org", None),
    ("https://www.Site.com:8080/a b|c/", "a-b-c", "site.com:8080", None),
    ("https://www.site.com:8080/a/b;c=1?x=2", "b", "site.com:8080", None),
    ("https://site.com", "article", "site.com", None),
    ("https://site.com/%%%/#x/y", "article", "site.com", None),
    ("https://www.youtube.com/watch?t=3&v=&v=a%2Bb&v=c", "watch", "youtube.com", "a+b"),
    (" https://m.youtube.com/watch?v=100%", None, None, "100%"),
    ("https://www.youtube.com/watch?xv=1", "watch", "youtube.com", None),
    ("https://youtu.be/xyz?si=1", "xyz", "youtu.be", "xyz"),
    ("not a url", "not-a-url", None, None),
])
def test_urls(rows, url, stem, site, video):
    got = rows("u string", (url,)).select(urls.file_stem(F.col("u")), urls.site_name(F.col("u")),
                                          urls.video_id(F.col("u"))).first()
    if stem is not None:
        assert got[0] == f"{stem}_{hashlib.sha1(url.encode()).hexdigest()[:8]}"
        assert got[1] == site
    assert got[2] == video


def test_entities_like_the_standard_library(rows):
    cases = ["a &amp; b", "&amp;lt;", "&#38;lt;", "&#8217;&#x2019;&rsquo;", "&eacute;t&eacute;", "&unknown; &", "R&D; &lt", "&#0;&#1114112;&#xD800;",
             "&NotEqualTilde;x", "&nbsp;&amp;&amp;amp;", "plain", "&#150;&#x92;&#128;&#129;", "x &amp y", "&copy 2020",
             "&notit;", "&#1;&#65534;&#127;|&#11;", "&#99999999999999999999;&#xFFFFFFFFFFFFFFFFFF;", "&#x41&#66 &#;&#x;&#0065;", "&", "&;&&lt&gt",
             "&frac12x&frac1;&\u00e9;", "&#13;\n", ""]
    want = [html.unescape(c) for c in cases]
    df = rows("i int, s string", *enumerate(cases)).orderBy("i")
    assert values(df, urls.unescape_html(F.col("s"))) == want


def test_page_fields(rows):
    page = '<TITLE>\n A &amp; B\n - YouTube </TITLE><title>x</title>{"ownerChannelName":"C &quot;D&quot;"}'
    got = rows("h string", (page,)).select(urls.html_title(F.col("h")), urls.owner_name(F.col("h"))).first()
    assert tuple(got) == ("A & B", 'C "D"')
    got = rows("j string", ('{"title":" T ","author_name":" "}',)).select(
        urls.oembed_title(F.col("j")), urls.oembed_author(F.col("j"))).first()
    assert tuple(got) == ("T", None)


def test_classes_differ_in_precedence(rows):
    df = rows("i int, e string", (0, "Chin Up"), (1, "Leg press (hinge )"), (2, "Weighted dips"), (3, " Face pull"),
              (4, "Lateral Raise")).orderBy("i")
    assert values(df, markers.exercise_class(F.col("e"))) == ["upper_compound", "lower_compound", "bodyweight", "other", "isolation"]
    assert values(df, markers.model_group(F.col("e"))) == ["bodyweight", "lower_compound", "bodyweight", "global", "isolation"]


def test_low_value_marker_beyond_the_window(rows):
    df = rows("t string", ("x" * 300 + " shutterstock",))
    assert values(df, markers.has_low_value_text(F.col("t"), 300)) == [False]
    assert values(df, markers.has_low_value_text(F.col("t"))) == [True]


def test_block_errors_are_per_source(rows):
    df = rows("i int, m string", (0, "403 Client Error"), (1, "IP has been blocked"), (2, "timed out"), (3, None)).orderBy("i")
    assert values(df, markers.is_block_error(F.col("m"))) == [True, True, False, False]
    assert values(df, markers.is_transcript_block(F.col("m"))) == [False, True, False, False]


def test_unit_length(rows):
    df = rows("v array<double>", ([3.0, 4.0],), ([0.0, 0.0],))
    assert values(df, vectors.l2_normalize(F.col("v"))) == [[0.6, 0.8], [0.0, 0.0]]
    assert values(df, vectors.dot(F.col("v"), F.col("v"))) == [25.0, 0.0]


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_local_clock_changes_do_not_move_times(spark, rows, zone):
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        df = rows("s string", ("2024-03-10 02:30:00",), ("2024-13-01 00:00:00",), ("2024-03-10",))
        t = times.parse_timestamp(F.col("s"))
        assert values(df, times.iso_seconds(t)) == ["2024-03-10T02:30:00", None, None]
        assert values(df, times.epoch_seconds(t)) == [1710037800, 0, 0]
        assert values(df, times.iso_seconds(times.truncate_seconds(t)))[0] == "2024-03-10T02:30:00"
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
