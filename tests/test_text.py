import html
import math
from urllib.parse import parse_qsl, urlencode, urlparse

import pytest
from pyspark.sql import functions as F

from newsloom.functions import pages, scores, text, urls


def column(spark, values, expression, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(expression(F.col("x"))).collect()]


def test_clean_text(spark):
    raw = ["<div>Giá <i>xăng</i> giảm</div><script>if (a < b) { c() }</script>", "<style>.x > p {top: 0}</style>Bản tin sáng", "một \t hai\n\n \nba", "Cầu thủ ghi bàn", "mưa ☔ lớn", None, "", "x\x01y\x1fz\u00a0 ", "1 &lt; 2 &amp; 3"]
    got = column(spark, raw, text.clean_text)
    assert got == ["Giá xăng giảm", "Bản tin sáng", "một hai ba", raw[3], raw[4], "", "", "xyz", "1 < 2 & 3"]


def test_clean_text_of_pages(spark, small):
    """Whole pages against a plain version with patterns."""
    import re
    import unicodedata

    def plain(page):
        t = re.sub(r"(?is)<!--.*?-->|<!doctype[^>]*>|<(script|style)\b.*?</\1\s*>", " ", unicodedata.normalize("NFC", page))
        t = re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "", html.unescape(re.sub(r"<[^>]*>", " ", t)))
        return " ".join(t.split())

    pages_ = spark.read.parquet(f"{small}/pages.parquet").select("html", text.clean_text(F.col("html")).alias("clean")).collect()
    assert all(r.clean == plain(r.html) for r in pages_) and len(pages_) == 50


def test_tokens_and_predicates(spark):
    assert column(spark, ["Tin_tức 5.000 AT&T, iPhone-18. Ab"], text.tokens) == [["Tin", "tức", "5.000", "AT&T", "iPhone-18", "Ab"]]
    words = ["1.000", "a", "A1", "Ab", "ab", "12,5"]
    assert column(spark, words, text.is_numeric) == [True, False, False, False, False, True]
    assert column(spark, words, text.looks_like_entity) == [False, False, True, True, False, False]
    assert column(spark, ["Straße  Ａ", None], text.normalize_keyword) == ["strasse a", None]


def test_valid_keyword(spark):
    rows = [("tin tức", 2, True), ("tin tức", 3, False), ("845.100 tệ 3 3", 4, False), ("3 5", 2, False), ("90 ngày", 2, True), ("", 0, False)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, p string, n int, want boolean")
    assert all(r.got == r.want for r in df.select("want", text.is_valid_keyword(F.col("p"), F.col("n")).alias("got")).collect())


def brute_url(url):
    url = url.strip()
    if not url:
        return ""
    p = urlparse(url)
    kept = [(k, v) for k, v in parse_qsl(p.query, keep_blank_values=True) if not k.lower().startswith("utm_") and k.lower() not in text_tracking()]
    out = p._replace(fragment="", query=urlencode(kept, doseq=True)).geturl()
    return out.rstrip("/") if out.endswith("/") and len(out) > len(f"{p.scheme}://{p.netloc}/") else out


def text_tracking():
    return urls.TRACKING


def test_normalize_url(spark):
    got = ["HTTP://a.b/c/?utm_source=x&A=1#f", "http://a.b/", "http://a.b/c//", " http://a.b/c?REF=1&q=x y+z&e ", "", "http://a.b?x=%C3%A9*~", "http://a.b/c/?fbclid=1", "https://a.b/?a=1/"]
    assert column(spark, got, urls.normalize_url) == [brute_url(u) for u in got]
    once = column(spark, got, urls.normalize_url)
    assert column(spark, once, urls.normalize_url) == once


def test_scores(spark):
    df = spark.createDataFrame([(3, 1, 0, 10.0, 20.0), (0, 2, 9, 0.0, 20.0), (1, 0, 3, 5.0, 0.0)], "r int, p int, age int, v double, m double")
    rows = df.select(scores.momentum_score(F.col("r"), F.col("p")), scores.recency_score(F.col("age")), scores.strength_score(F.col("v"), F.col("m")), scores.growth_label(F.col("r"), F.col("p"))).collect()
    assert rows[0][0] == pytest.approx(1 - math.exp(-(math.log(4) - math.log(2)))) and rows[1][0] == 0
    assert rows[0][1] == 1 and rows[2][1] == pytest.approx(math.exp(-1))
    assert rows[0][2] == pytest.approx(math.log1p(10) / math.log1p(20)) and rows[1][2] == rows[2][2] == 0
    assert [r[3] for r in rows] == ["+200.0%", "-100.0%", "NEW"]


def test_feeds():
    rss = "<rss><channel><item><title>A &amp;lt;b&amp;gt;x</title><link> http://a </link><description>d &lt;p&gt;e</description><pubDate>Mon, 14 Sep 2026 08:00:00 +0700</pubDate></item><item><title>no link</title></item></channel></rss>"
    (one,) = pages.parse_feed(rss)
    assert (one["url"], one["content"], one["published_at"].isoformat()) == ("http://a", "d e", "2026-09-14T08:00:00+07:00")
    atom = '<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>T</title><link href="http://b"/><summary>s</summary><updated>2026-09-14T10:00:00Z</updated></entry></feed>'
    (two,) = pages.parse_feed(atom)
    assert two["url"] == "http://b" and two["content"] == "s" and two["published_at"].year == 2026
    assert pages.parse_feed("<bad") == [] == pages.parse_feed(None)
    assert pages.decode_bytes("<?xml version='1.0' encoding='latin-1'?>é".encode("latin-1")).endswith("é")


def test_article():
    p = "x" * 300
    page = f"<html><title>Nghe podcasts | T - Báo VnExpress</title><article class='fck_detail'><p>{p}</p><p>{p}</p><div class='author'><p>me</p></div><h2>b &amp; c</h2><blockquote>{'y' * 200}</blockquote></article></html>"
    got = pages.parse_article(page)
    assert got == {"title": "T", "content": f"{p}\nb & c\n{'y' * 200}", "error": None}
    ld = "<script type='application/ld+json'>" + '{"@graph":[{"headline":"H","articleBody":"' + "z" * 600 + '"}]}' + "</script>"
    assert pages.parse_article(ld) == {"title": "H", "content": "z" * 600, "error": None}
    two = "<script type='application/ld+json'>[{\"articleBody\":\"short\"},{\"@graph\":[{\"headline\":\" A  B \",\"articleBody\":\"<p>" + "u" * 300 + "</p><p>" + "v" * 300 + "</p>\"}]}]</script><h1> </h1><title>T</title>"
    assert pages.parse_article(two) == {"title": "T", "content": f"{'u' * 300}\n{'v' * 300}", "error": None}
    nested = f"<div class='section-detail-podcast'><i><div class='scrolling-ctn'>{'w ' * 300}<form>no</form></div></i></div><meta property='og:title' content=' O '>"
    assert pages.parse_article(nested) == {"title": "O", "content": ("w " * 300).strip(), "error": None}
    assert pages.parse_article("<p>short</p>")["error"] == "no article text"
    assert pages.parse_article(None)["error"] == "empty page"
    assert html.unescape("&amp;") == "&"
