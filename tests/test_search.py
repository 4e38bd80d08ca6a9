"""Predicates, requests, facets, highlighting and suggestions on small tables."""

import math

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import geo
from corpusloom.functions import highlight as hl
from corpusloom.functions import match as m
from corpusloom.functions import text as tx
from corpusloom.operators import places as pl
from corpusloom.operators import relevance as rel
from corpusloom.operators import search as sr
from corpusloom.operators import words as ops
from corpusloom.operators.facets import Facet, facet_date, facet_field, facet_range, facet_terms
from corpusloom.operators.search import Choice, SearchRequest, page, search

DOCS = [
    (1, "The quick brown fox", "news", 10, ["a", "b"]),
    (2, "quick brownies", "news", 20, ["b"]),
    (3, "A lazy dog; quick!", "blog", 30, []),
    (4, "fax machine", None, 40, None),
    (5, "brown quick", "blog", 50, ["a"]),
]


@pytest.fixture(scope="module")
def docs(spark):
    frame = spark.createDataFrame(DOCS, "doc_id bigint, text string, source string, n int, tags array<string>")
    return frame.withColumn("tokens", tx.tokenise(F.col("text")))


def ids(df):
    return sorted(r.doc_id for r in df.collect())



def test_free_text(docs):
    t = [F.col("tokens")]
    assert ids(docs.where(m.free_text(t, "quick BROWN", "AND"))) == [1, 5]
    assert ids(docs.where(m.free_text(t, "lazy fax"))) == [3, 4]
    assert ids(docs.where(m.free_text(t, "brown", "AND", "*"))) == [1, 2, 5]
    assert ids(docs.where(m.free_text(t, "fex", "AND", "~"))) == [1, 4]
    assert ids(docs.where(m.free_text(t, "qu*k la?y", "AND", "*"))) == [3]
    assert ids(docs.where(m.phrase(F.col("tokens"), "quick brown"))) == [1]
    both = [F.col("tokens"), tx.tokenise(F.coalesce("source", F.lit("")))]
    assert ids(docs.where(m.free_text(both, "blog quick", "AND"))) == [3, 5]


def test_fuzzify():
    assert m.fuzzify("a  bc", "*") == ["*a*", "*bc*"]
    assert m.fuzzify("a b~", "*") == ["a", "b~"]
    assert m.fuzzify("a f:b", "~") == ["a", "f:b"]
    assert m.fuzzify("a", None) == ["a"]
    assert [m.allowed_edits(w) for w in ("ab", "abc", "abcdef")] == [0, 1, 2]


def test_two_fields(docs):
    source = tx.tokenise(F.coalesce("source", F.lit("")))
    assert ids(docs.where(m.two_fields(F.col("tokens"), source, "lazy news"))) == [1, 2, 3]
    assert ids(docs.where(m.two_fields(F.col("tokens"), source, '"brown fox"'))) == [1]


def test_field_predicates(docs):
    assert ids(docs.where(m.in_range(F.col("n"), 20, 40))) == [2, 3, 4]
    assert ids(docs.where(m.in_range(F.col("n"), None, 10))) == [1]
    assert ids(docs.where(m.exclude(F.col("source") == "news"))) == [3, 4, 5]
    assert ids(docs.where(m.has_value(F.col("tags"), "a"))) == [1, 5]
    assert ids(docs.where(m.any_of(F.col("source"), ["news"], "match_all"))) == [1, 2, 3, 4, 5]
    assert ids(docs.where(m.any_of(F.col("source"), ["news", "none"], "match_all"))) == [1, 2]
    assert ids(docs.where(m.any_of(F.col("source"), ["news"]))) == [1, 2]


def test_nested_same_object(spark):
    frame = spark.createDataFrame(
        [(1, [("x", 1), ("y", 2)]), (2, [("x", 2)]), (3, None)], "doc_id bigint, o array<struct<k:string,v:int>>"
    )
    assert ids(frame.where(m.nested_any(F.col("o"), lambda e: (e["k"] == "x") & (e["v"] == 2)))) == [2]


def test_may_contain_is_necessary(docs):
    kept = set(ids(docs.where(m.may_contain(F.col("text"), ["quick", "brown"]))))
    assert set(ids(docs.where(m.free_text([F.col("tokens")], "quick brown", "AND")))) <= kept


def test_request_editing_and_pages(docs):
    news = Choice("source", m.term(F.col("source"), "news"))
    blog = Choice("source", m.term(F.col("source"), "blog"))
    request = SearchRequest(start=30).add(news)
    assert request.start == 0
    assert request.set(blog).choices == (blog,)
    assert request.add(blog).remove(news).choices == (blog,)
    assert request.add(blog).clear("source").choices == ()
    assert SearchRequest(start=5).previous_page().start == 0
    assert SearchRequest().next_page().start == 10
    whole = ids(docs)
    parts = [r.doc_id for s in (0, 2, 4) for r in page(docs, [("n", "asc")], "doc_id", s, 2).collect()]
    assert parts == whole
    assert search(docs, SearchRequest(start=4, size=3)).total.first()[0] == 5


def test_or_group_and_lone_or(docs):
    one = Choice("source", m.term(F.col("source"), "news"), any_of=True)
    two = Choice("source", m.term(F.col("source"), "blog"), any_of=True)
    assert ids(search(docs, SearchRequest(choices=(one, two))).hits) == [1, 2, 3, 5]
    assert ids(search(docs, SearchRequest(choices=(one,))).hits) == [1, 2]
    assert len(ids(search(docs, SearchRequest(choices=(one,), lone_or="match_all")).hits)) == 5


def test_filter_scopes(docs):
    facets = (Facet("source", where=F.col("n") >= 20), Facet("tags", kind="array"))
    chosen = Choice("source", m.term(F.col("source"), "news"))
    result = search(docs, SearchRequest(choices=(chosen,), facets=facets))
    assert ids(result.hits) == [2]
    counts = {(r.facet, r.value): r.n for r in result.facets.collect()}
    assert counts == {("source", "news"): 1, ("tags", "b"): 1}
    # a page filter replaces it on the hits and leaves the facets alone
    result = search(docs, SearchRequest(choices=(chosen,), facets=facets, post=F.col("n") == 10))
    assert ids(result.hits) == [1]
    assert {(r.facet, r.value): r.n for r in result.facets.collect()} == counts
    free = search(docs, SearchRequest(facets=facets, post=F.col("n") == 10))
    assert {(r.facet, r.value): r.n for r in free.facets.collect()} == {
        ("source", "news"): 1, ("source", "blog"): 2, ("tags", "a"): 2, ("tags", "b"): 2,
    }


def test_facet_orders_and_text(docs):
    def values(order, size=10):
        rows = facet_terms(docs, [Facet("source", size=size, order=order)]).orderBy("rank").collect()
        return [r.value for r in rows]

    assert values("count") == ["blog", "news"] and values("reverse_term") == ["news", "blog"]
    assert values("term", 1) == ["blog"]
    words = facet_terms(docs, [Facet("text", kind="text", size=2)]).orderBy("rank").collect()
    assert [(r.value, r.n) for r in words] == [("quick", 4), ("brown", 2)]
    with pytest.raises(ValueError):
        Facet("source", order="random")


def test_facet_field_options(docs):
    rows = lambda **k: [(r.value, r.n) for r in facet_field(docs, "source", **k).collect()]
    assert rows() == [("blog", 2), ("news", 2)]
    assert rows(query=F.col("n") < 25) == [("news", 2), ("blog", 0)]
    assert rows(query=F.col("n") < 25, mincount=1) == [("news", 2)]
    assert rows(offset=1, limit=1) == [("news", 2)]
    assert rows(prefix="bl", missing=True) == [("blog", 2), (None, 1)]


def test_facet_field_in_one_pass(spark, docs, tmp_path):
    rows = lambda **k: [tuple(r) for r in facet_field(docs, "source", **k).collect()]
    assert rows(ranked=True, missing=True) == [("blog", 2, 1), ("news", 2, 2), (None, 1, None)]
    assert rows(ranked=True, limit=1, offset=1, query=F.col("n") < 35, mincount=1, missing=True) == [("blog", 1, 2), (None, 0, None)]
    assert rows(limit=0, missing=True) == [(None, 1)] and rows(limit=None, missing=True)[-1] == (None, 1)
    assert rows(limit=None, offset=1) == [("news", 2)] and rows(query=F.col("n") > 99, mincount=1) == []
    with pytest.raises(ValueError):
        facet_field(docs, "source", limit=None, ranked=True)
    docs.write.parquet(str(tmp_path / "docs"))
    stored = spark.read.parquet(str(tmp_path / "docs"))
    text = facet_field(stored, "source", F.col("n") > 15, mincount=1, missing=True)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(n,15)" in text and text.count("FileScan") == 1
    assert "GreaterThan(n,15)" not in facet_field(stored, "source", F.col("n") > 15)._jdf.queryExecution().executedPlan().toString()


def test_search_once_matches_once(docs):
    request = SearchRequest(
        text=m.text_query(F.col("text"), F.lit("en"), "quick"), sort=(("n", "desc"),), start=1, size=2,
        facets=(Facet("source"), Facet("tags", kind="array")), post=F.col("n") < 50,
    )
    plain, (once, kept) = search(docs, request), sr.search_once(docs, request)
    assert [r.doc_id for r in once.hits.collect()] == [r.doc_id for r in plain.hits.collect()] == [2, 1]
    assert once.total.first().total == plain.total.first().total == 3
    assert sorted(map(tuple, once.facets.collect())) == sorted(map(tuple, plain.facets.collect()))
    assert ids(kept) == [1, 2, 3, 5]
    for part in (once.hits, once.total, once.facets):
        assert "quick" not in part._jdf.queryExecution().optimizedPlan().toString()
    none, _ = sr.search_once(docs.limit(0), request)
    assert none.total.first().total == 0 and not none.hits.collect() and not none.facets.collect()


def test_facet_range_counts_by_brute_force(spark):
    values = [0.0, 5.0, 10.0, 15.0, 20.0, 24.0, 25.0, 30.0, 31.0, -1.0]
    frame = spark.createDataFrame([(v,) for v in values] + [(None,)], "x double")
    for hardend, include in ((False, ("lower",)), (True, ("upper",)), (True, ("all",)), (False, ("edge",))):
        got = {
            (r.kind, r.low, r.high): r.n
            for r in facet_range(frame, "x", 0.0, 25.0, 10.0, hardend, ("all",), include).collect()
        }
        stop = 25.0 if hardend else 30.0
        edges = [(0.0, 10.0), (10.0, 20.0), (20.0, stop)]
        inc = {"lower", "upper", "edge", "outer"} if include == ("all",) else set(include)
        for i, (a, b) in enumerate(edges):
            low = "lower" in inc or ("edge" in inc and i == 0)
            high = "upper" in inc or ("edge" in inc and i == 2)
            want = sum((v > a or (low and v == a)) and (v < b or (high and v == b)) for v in values)
            assert got[("range", a, b)] == want, (hardend, include, a)
        first, last = bool({"lower", "edge"} & inc), bool({"upper", "edge"} & inc)
        outer = "outer" in inc
        assert got[("before", None, None)] == sum(v < 0 or (v == 0 and (outer or not first)) for v in values)
        assert got[("after", None, None)] == sum(v > stop or (v == stop and (outer or not last)) for v in values)
        between = sum((0 < v < stop) or (v == 0 and first) or (v == stop and last) for v in values)
        assert got[("between", None, None)] == between


def test_facet_date_months(spark):
    frame = spark.sql("select timestamp(d) ts from values ('2024-01-31'),('2024-02-01'),('2024-02-29'),('2024-04-01') t(d)")
    rows = facet_date(frame, "ts", "2024-01-01", "2024-03-15", 1, "month", other=("after",)).collect()
    got = {(r.kind, str(r.low)[:10], str(r.high)[:10]): r.n for r in rows}
    assert got == {
        ("range", "2024-01-01", "2024-02-01"): 1, ("range", "2024-02-01", "2024-03-01"): 2,
        ("range", "2024-03-01", "2024-04-01"): 0, ("after", "None", "None"): 1,
    }


def test_highlight(spark):
    long = "x " * 300 + "Cat’s concat CAT end " + "y " * 300
    frame = spark.createDataFrame([("a cat sat", ), (long,), ("nothing",), ("",)], "t string")
    got = [r[0] for r in frame.select(hl.fragment(F.col("t"), ["cat"], pre="<", post=">")).collect()]
    assert got[0] == "...a <cat> sat..."
    assert "concat <CAT> end" in got[1] and len(got[1]) <= 500 + 8
    assert got[2] is None and got[3] is None


def test_highlight_marks_whole_words_only(spark):
    frame = spark.createDataFrame([("l’été et cafés",)], "t string")
    assert frame.select(hl.mark(F.col("t"), ["caf", "et"], "<", ">")).first()[0] == "l’été <et> cafés"


def test_geo(spark):
    frame = spark.createDataFrame([(48.8566, 2.3522), (51.5074, -0.1278), (40.71, -74.0)], "lat double, lng double")
    km = [r[0] for r in frame.select(geo.arc_distance(F.col("lat"), F.col("lng"), 48.8566, 2.3522)).collect()]
    assert km[0] == pytest.approx(0.0) and km[1] == pytest.approx(343.5, abs=1.0)
    inside = geo.within(F.col("lat"), F.col("lng"), 48.8566, 2.3522, 350.0)
    assert frame.where(inside).count() == 2
    miles = geo.within(F.col("lat"), F.col("lng"), 48.8566, 2.3522, 217.0, "miles", "plane")
    assert frame.where(miles).count() == 2


def test_relevance(spark):
    frame = spark.createDataFrame([(1, "cat cat dog"), (2, "dog bird"), (3, "fish")], "doc_id bigint, text string")
    terms = ops.doc_terms(frame, None, lang=None)
    rows = rel.relevance(terms, ["cat", "dog", "unknown"]).collect()
    assert [r.doc_id for r in rows] == [1, 2]
    assert rows[0].score == pytest.approx(2 / 2 * math.log10(3) + 1 / 2 * math.log10(3 / 2))


def test_suggestions(spark):
    stats = spark.createDataFrame(
        [("house", 5, 9), ("horse", 9, 9), ("mouse", 50, 50), ("hose", 1, 1)], "term string, documents bigint, count bigint"
    )
    found = rel.suggest(stats, ["houze", "horse", "hoes", "zzz"])
    assert {r.word: r.suggestion for r in found.collect()} == {"houze": "house", "hoes": "horse"}
    assert rel.suggested_query(found, "Houze zzz horse").first()[0] == "house zzz horse"


@pytest.mark.parametrize("sort", [(), (("a", "asc"),), (("a", "desc"),), (("a", "desc"), ("b", "asc")), (("b", "asc"), ("a", "desc"))])
def test_pages_by_cursor_equal_pages_by_offset(spark, sort):
    values = [None, 1.0, float("nan"), 2.0, 1.0]
    rows = [(i, values[i % 5], [None, "x", "y"][i % 3]) for i in range(23)]
    df = spark.createDataFrame(rows, "k int, a double, b string").repartition(3)
    pages = list(sr.deep_pages(df, sort, "k", 4))
    assert [len(p) for p in pages] == [4, 4, 4, 4, 4, 3]
    assert [[r.k for r in p] for p in pages] == [[r.k for r in sr.page(df, sort, "k", 4 * n, 4).collect()] for n in range(6)]


def test_cursor_reaches_the_scan_and_a_new_choice_starts_over(spark, tmp_path):
    spark.range(1000).select(F.col("id").alias("doc_id"), (F.col("id") % 7).alias("n")).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    request = sr.SearchRequest(size=5, sort=(("n", "desc"),))
    second = request.page_after(sr.search(df, request).hits.collect()[-1])
    hits = sr.search(df, second).hits
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "LessThan(n,6)" in plan.split("PushedFilters")[1] and "GreaterThan(doc_id,34)" in plan.split("PushedFilters")[1]
    assert [r.doc_id for r in hits.collect()] == [41, 48, 55, 62, 69]
    assert [r.doc_id for r in sr.search(df, second.next_page()).hits.collect()] == [76, 83, 90, 97, 104]
    assert sr.search(df, second).total.first().total == 1000
    assert second.sorted_by("n", "asc").after is None
    empty = df.where("doc_id < 0")
    assert list(sr.deep_pages(empty, (), "doc_id")) == []


@pytest.mark.parametrize("radius", [0.0, 0.5, 60.0, 900.0, 7000.0, 30000.0])
def test_places_around_many_centres(spark, radius):
    spots = [(i, (i * 37.3) % 180 - 90, (i * 91.7) % 360 - 180) for i in range(300)]
    spots += [(400 + i, lat, lng) for i, (lat, lng) in enumerate(
        [(90.0, 0.0), (-90.0, 7.0), (89.9, 170.0), (0.0, 180.0), (0.0, -180.0), (0.001, 179.999), (45.0, 10.0), (45.0, 370.0), (45.004, 10.0)])]
    odd = [(900, None, 1.0), (901, 1.0, None), (902, float("nan"), 1.0), (903, 1.0, float("nan"))]
    left = spark.createDataFrame(spots + odd, "p int, lat double, lng double")
    right = spark.createDataFrame([(k, a, b, "x") for k, a, b in spots[:300:7] + spots[300:] + odd], "c int, lat double, lng double, distance string")

    def far(a, b, c, d):
        a, b, c, d = map(math.radians, (a, b, c, d))
        h = math.sin((a - c) / 2) ** 2 + math.cos(a) * math.cos(c) * math.sin((b - d) / 2) ** 2
        return 2 * 6371.0 * math.asin(math.sqrt(min(1.0, h)))

    want = {(k, j) for k, a, b in spots[:300:7] + spots[300:] for j, c, d in spots if far(c, d, a, b) <= radius + 1e-6}
    rows = pl.within_radius(left, right, "p", "c", radius + 1e-6).collect()
    assert len(rows) == len(want) and {(r.c, r.p) for r in rows} == want


def test_centres_of_one_file_are_dealt_out(spark):
    ids = spark.range(0, 200, 1, 1)
    spots = ids.select("id", F.lit(10.0).alias("lat"), F.lit(20.0).alias("lng"))
    found = pl.within_radius(spots.limit(5).toDF("p", "lat", "lng"), spots.toDF("c", "lat", "lng"), "p", "c", 1.0)
    parts = found.groupBy(F.spark_partition_id().alias("part")).count().collect()
    assert sum(r["count"] for r in parts) == 1000
    assert len(parts) > 1 and max(r["count"] for r in parts) < 500
