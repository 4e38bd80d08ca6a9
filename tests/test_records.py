"""Record shaping, display, spans and titles on hand-written rows."""

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import display as d
from corpusloom.operators import records as rec
from corpusloom.operators import titles as tit

PAGE = (
    '<!DOCTYPE html><html lang="fr"><head><meta charset="utf-8"><title>A &amp; B</title>'
    '<meta name="Author" content="Zoé"><meta name="empty"><meta name="author" content="second">'
    "<style>p{}</style><script>var t=\"</p>\";</script></head>"
    '<body><!-- x --><h1>Big   title</h1><p>Some <b>bold</b> text</p><a href="/u">here</a>'
    "<article>1</article><article>2</article></body></html>"
)


@pytest.fixture(scope="module")
def records(spark):
    rows = [(1, "http://h/x/y.html", PAGE), (2, "C:\\d\\z.html", "<html><body>cut"), (3, "/n", None)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    return {r.page_id: r for r in rec.page_records(pages, "url", "html", "page_id").collect()}


def test_page_record(records):
    r = records[1]
    assert (r.file, r.title, r.lang, r.pages) == ("y.html", "A & B", "fr", 2)
    assert r.content_type == "text/html; charset=utf-8" and r.error is None
    assert r.body == "Big title Some bold text here 1 2"
    assert r.metadata == {"charset": "utf-8", "author": "Zoé"}
    assert [(x.url, x.text) for x in r.link] == [("/u", "here")]


def test_errors_keep_the_record(records):
    assert records[2].error == "unterminated document" and records[2].body == "cut"
    assert records[2].file == "z.html"
    assert records[3].error == "missing content" and records[3].path == "/n"


def test_metrics(spark):
    frame = spark.createDataFrame([(None,), ("bad",), (None,)], "error string")
    assert tuple(rec.run_metrics(frame).first()) == (3, 1)
    watched, seen = rec.observe_metrics(frame)
    watched.count()
    assert seen.get == {"processed": 3, "errors": 1}


def test_user_parser_errors_do_not_stop_the_task(spark):
    def parse(path, content):
        if content == b"":
            raise ValueError("empty file")
        return {"body": content.decode(), "pages": 3, "titles": ["a", "b"], "metadata": {"k": "v"}}

    files = spark.createDataFrame(
        [("/a/b.pdf", bytearray(b"text")), ("c.pdf", bytearray(b""))], "path string, content binary"
    )
    rows = {r.file: r for r in rec.extract_files(files, parse).collect()}
    assert rows["b.pdf"].body == "text" and rows["b.pdf"].pages == 3
    assert rows["b.pdf"].metadata == {"k": "v"} and rows["b.pdf"].error is None
    assert rows["c.pdf"].error == "ValueError: empty file" and rows["c.pdf"].body is None


def test_suffix_and_numbered_titles(spark):
    frame = spark.createDataFrame([("p", {"a": "1"}, ["t0", "t1"])], "path string, m map<string,string>, titles array<string>")
    row = rec.suffix_fields(frame).first()
    assert row.path_fr == "p" and row.m_fr == {"a_fr": "1"} and row.id == "p"
    titled = rec.numbered_titles(frame).first()
    assert (titled.parsed_title_0, titled.parsed_title_1, titled.parsed_title_2) == ("t0", "t1", None)


NESTED = (
    "id bigint, `a.b` string, a struct<b:string,c:array<struct<n:string>>>, "
    "tags array<string>, m map<string,string>"
)


def test_dotted_path(spark):
    frame = spark.createDataFrame([(1, "flat", ("deep", [("x",), ("y",)]), ["t"], {"k": "v"})], NESTED)
    get = lambda path: frame.select(d.get_path(frame, path).alias("v")).first()["v"]
    assert get("a.c.n") == ["x", "y"]
    assert get("a.b") == "deep"  # the shortest name that exists is walked into
    assert get("m.k") == "v" and get("tags") == ["t"]
    assert get("nothing.here") is None


def test_display(spark):
    frame = spark.createDataFrame(
        [(1, "p", ["x", "y"], 0), (2, None, [], 5), (3, "", None, 0)], "id bigint, path string, tags array<string>, n int"
    )
    template = [
        [{"pre": "<", "field": "path", "post": ">"}, {"field": "tags"}],
        [{"pre": "n: ", "field": "n", "post": ","}],
    ]
    shown = [r[0] for r in frame.orderBy("id").select(d.display_lines(frame, template)).collect()]
    assert shown[0] == "<p>x, y<br />"
    assert shown[1] == "n: 5<br />"
    assert shown[2].startswith("{")


def test_image_and_url(spark):
    frame = spark.createDataFrame([("see http://a/b.png and http://a/c.jpg", "C:\\a\\b"), ("none", "/x")], "t string, p string")
    rows = frame.select(d.first_image("t").alias("i"), d.file_url(F.col("p")).alias("u")).collect()
    assert rows[0].i == "http://a/b.png" and rows[1].i is None
    assert rows[0].u == "file://C:/a/b"


SPAN = (
    "doc_id bigint, page int, paragraph int, pos int, text string, font_name string, "
    "font_size double, y double, page_height double"
)


def spans(spark, rows):
    return spark.createDataFrame(rows, SPAN)


def test_titles(spark):
    table = spans(spark, [
        (1, 1, 0, 0, "Header one", "ABC+Times-Bold", 20.0, 10.0, 800.0),
        (1, 1, 1, 0, "In the ", "Times", 12.0, 390.0, 800.0),
        (1, 1, 1, 1, "middle", "X+Times-BOLD", 30.0, 390.0, 800.0),
        (1, 1, 2, 0, "short", "Times", 90.0, 400.0, 800.0),
        (1, 1, 3, 0, "longer", "Times", 20.0, 700.0, 800.0),
        (1, 1, 4, 0, "same size later", "Times", 20.0, 405.0, 800.0),
        (1, 2, 5, 0, "second page", "Times", 99.0, 400.0, 800.0),
        (2, 1, 0, 0, "tiny", "Times", 9.0, 1.0, 800.0),
    ])
    got = {r.doc_id: r.titles for r in tit.title_candidates(table).collect()}
    # five characters are too short; of equal sizes the earlier paragraphs win
    assert got == {1: ["In the middle", "longer", "Header one"]}
    stats = {(r.doc_id, r.paragraph): r for r in tit.paragraph_stats(table).collect()}
    assert stats[(1, 0)].bold and stats[(1, 1)].bold and not stats[(1, 2)].bold
    assert stats[(1, 1)].max_size == 30.0 and stats[(1, 1)].length == 13


def test_median_font(spark):
    table = spans(spark, [
        (1, 1, 0, 0, "aa", "T", 10.0, 0.0, 1.0), (1, 1, 0, 1, "bb", "T", 20.0, 0.0, 1.0),
        (1, 1, 0, 2, "   ", "T", 99.0, 0.0, 1.0),
        (2, 1, 0, 0, "title", "T", 40.0, 0.0, 1.0), (2, 2, 1, 0, "bbb", "T", 11.0, 0.0, 1.0),
        (2, 2, 1, 1, "c", "T", 12.0, 0.0, 1.0), (2, 11, 2, 0, "x" * 50, "T", 50.0, 0.0, 1.0),
    ])
    got = {r.doc_id: (r.pages, r.median_font) for r in tit.median_font(table).collect()}
    assert got == {1: (1, 15.0), 2: (11, 11.0)}
