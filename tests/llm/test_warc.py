"""WARC derivatives against html.parser, broken pages, charsets, ties and files."""

import time
from html.parser import HTMLParser
from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

from rankscope.llm import warc

from ..conftest import SF_MID

BLOCKS = set("""address article aside blockquote dd div dl dt fieldset figure footer form h1 h2 h3 h4 h5 h6 head header li
main nav ol p pre section table title tr ul br hr""".split())


class Page(HTMLParser):
    """Text and links as the standard library sees them."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.text, self.links, self.hidden = [], [], 0

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style", "noscript", "template"):
            self.hidden += 1
        if not self.hidden:
            self.text.append("\n" if tag in BLOCKS else " " if tag in ("td", "th") else "")
            if tag == "a" and dict(attrs).get("href"):
                self.links.append(dict(attrs)["href"].strip())

    def handle_endtag(self, tag):
        if tag in ("script", "style", "noscript", "template"):
            self.hidden = max(0, self.hidden - 1)
            self.text.append(" ")
        elif not self.hidden:
            self.text.append("\n" if tag in BLOCKS else " " if tag in ("td", "th") else "")

    def handle_data(self, data):
        if not self.hidden:
            self.text.append(data)

    def handle_comment(self, data):
        self.text.append(" ")


def test_pages_against_the_standard_parser(spark):
    pages = spark.read.parquet(f"{SF_MID}/pages.parquet")
    made = warc.build_derivatives(warc.responses(pages), "id")
    texts = {r.id: r.block for r in made.where("record_type = 'conversion'").collect()}
    metas = {r.id: r.block for r in made.where("record_type = 'metadata'").collect()}
    seen = 0
    for row in pages.collect():
        p = Page()
        p.feed(row.html or "")
        p.close()
        lines = (" ".join(x.split()) for x in "".join(p.text).split("\n"))
        assert texts[row.page_id] == "\n".join(x for x in lines if x)
        want = list(dict.fromkeys(urljoin(row.url, x) for x in p.links))
        got = [x.split(": ", 1)[1] for x in metas[row.page_id].split("\r\n") if x.startswith("outlink: ")]
        assert got == want
        seen += bool(want)
    assert seen > 10


@pytest.mark.parametrize("part", ["<a ", "<title>", "<p ", "<title ", "<a href", "<a href=\"", "<a href='", "<!--", "<script ",
                                  "<script></script ", "<", "&#9", "<td ", "</title ", "<a href=x ", "href=", "<a\n     "])
def test_long_broken_pages_take_no_longer_than_sound_ones(part):
    page = part * (1_000_000 // len(part))
    start = time.process_time()
    warc.plain_text(page), warc.outlinks(page, "http://a.example/"), warc.page_title(page)
    assert time.process_time() - start < 4


def test_numbers_beyond_any_character():
    assert warc.plain_text("&#" + "9" * 5000 + "; &#" + "0" * 5000 + "65; &#65; &#x41;") == "� A A A"


def test_charsets_ties_and_clashing_columns(spark):
    page = "<a href='/x'>é</a><a href=\"/x\">ü</a><a href=/y>ß</a><a href='/x'></a>"
    rows = [(1, "http://a.example/", "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=ISO-8859-1", page.encode("latin-1")),
            (2, "http://a.example/", "HTTP/1.1 200 OK", b"<meta charset='iso-8859-1'>" + page.encode("latin-1")),
            (3, "http://a.example/", "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=no-such", page.encode()),
            (4, None, None, None)]
    df = spark.createDataFrame(rows, "id long, target_uri string, http string, payload binary").selectExpr(
        "*", "'r' || id AS record_id", "'d' AS warc_date", "'clash' AS block", "'clash' AS refers_to", "'clash' AS content_type")
    made = warc.build_derivatives(df, "id").toPandas()
    text = made[made.record_type == "conversion"].set_index("id")
    assert text.block[[1, 2, 3]].tolist() == ["éüß"] * 3 and text.block[4] == "" and text.refers_to[1] == "r1"
    for meta in made[(made.record_type == "metadata") & (made.id < 4)].block:
        assert [x for x in meta.split("\r\n") if x.startswith("outlink")] == ["outlink: http://a.example/x",
                                                                              "outlink: http://a.example/y"]
    assert len(made) == 8 and warc.build_derivatives(df.limit(0), "id").count() == 0


def test_files_are_read_back(spark, tmp_path):
    pages = spark.read.parquet(f"{SF_MID}/pages.parquet")
    made = warc.build_derivatives(warc.responses(pages), "id")
    warc.write_records(made.repartition(3), str(tmp_path / "w"))
    back = warc.read_records(spark, str(tmp_path / "w"))
    got = back.select(F.col("headers")["WARC-Record-ID"].alias("record_id"), F.col("block").cast("string").alias("block"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, made.select("record_id", "block").collect()))
    assert back.select("file").distinct().count() == 3
