"""Facet queries: values, texts, ranges, dates and filter scopes."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from corpusloom.catalogue import common as c
from corpusloom.catalogue.pages import LINK, decode_sql
from corpusloom.functions import html as h
from corpusloom.functions import match as m
from corpusloom.operators import facets as fc
from corpusloom.operators.facets import Facet, facet_field, facet_terms
from corpusloom.operators.search import Choice, SearchRequest, search, search_once


def _long(df):
    return df.withColumn("rank", F.col("rank").cast("bigint"))


def facets_multi(spark, sf_dir):
    labels = c.table(spark, sf_dir, "labels")
    docs = c.table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    docs = docs.join(labels, "doc_id", "left").withColumn("long", F.col("n_chars") > 2000)
    facets = [
        Facet("lang"),
        Facet("source", size=5),
        Facet("source", size=5, order="reverse_term", name="source_z"),
        Facet("quality", order="term"),
        Facet("long", order="reverse_count"),
    ]
    return _long(facet_terms(docs, facets))


def facet_text(spark, sf_dir):
    docs = c.table(spark, sf_dir, "documents", "doc_id", ["doc_id", "text"])
    return _long(facet_terms(docs, [Facet("text", size=10, kind="text")]))


def facet_orders(spark, sf_dir):
    orders = ("count", "reverse_count", "term", "reverse_term")
    facets = [Facet("p_name", size=7, order=o, name=o) for o in orders]
    return _long(facet_terms(c.table(spark, sf_dir, "part"), facets))


def facet_nested(spark, sf_dir):
    pages = c.table(spark, sf_dir, "pages", "page_id").select(
        "page_id", F.transform(h.links(F.col("html")), lambda e: e["text"]).alias("link_text")
    )
    return _long(facet_terms(pages, [Facet("link_text", size=15, kind="array")]))


def facet_options(spark, sf_dir):
    parts = c.table(spark, sf_dir, "part")
    found = facet_field(
        parts, "p_brand", F.col("p_size") > 25, prefix="Brand#1", sort="index", limit=6, offset=2, mincount=1
    )
    labels = c.table(spark, sf_dir, "labels")
    docs = c.table(spark, sf_dir, "documents").select("doc_id").join(labels, "doc_id", "left")
    with_missing = facet_field(docs, "quality", missing=True)
    return found.withColumn("facet", F.lit("brand")).unionByName(
        with_missing.withColumn("facet", F.lit("quality"))
    )


def facet_ranked(spark, sf_dir):
    """One pass over ``orders``: values with their place, and the null row of those without a label."""
    orders = c.table(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") != "P", F.col("o_orderpriority")).alias("status")
    dear = F.col("o_totalprice") > 150000
    rows = orders.select(status, "o_totalprice")
    return facet_field(rows, "status", dear, limit=3, offset=1, mincount=1, missing=True, ranked=True)


def facet_zero_counts(spark, sf_dir):
    parts = c.table(spark, sf_dir, "part")
    return facet_field(parts, "p_brand", F.col("p_name") == "red widget", mincount=0, limit=None)


def facet_range(spark, sf_dir):
    orders = c.table(spark, sf_dir, "orders")
    return fc.facet_range(orders, "o_totalprice", 50000.0, 400000.0, 60000.0, other=("all",))


def facet_range_hardend(spark, sf_dir):
    items = c.table(spark, sf_dir, "lineitem")
    return fc.facet_range(
        items, "l_quantity", 5.0, 47.0, 10.0, hardend=True, other=("before", "after", "between"),
        include=("lower", "upper"),
    )


def facet_range_edge(spark, sf_dir):
    items = c.table(spark, sf_dir, "lineitem")
    return fc.facet_range(
        items, "l_quantity", 10.0, 40.0, 10.0, other=("all",), include=("upper", "edge", "outer")
    )


def facet_date(spark, sf_dir):
    return fc.facet_date(
        c.table(spark, sf_dir, "orders"), "o_orderdate", "1996-01-01", "1998-01-01", 1, "month",
        other=("all",),
    )


def facet_date_years(spark, sf_dir):
    items = c.table(spark, sf_dir, "lineitem")
    return fc.facet_date(items, "l_shipdate", "1995-01-01", "1999-07-01", 2, "year")


def facet_date_hours(spark, sf_dir):
    return fc.facet_date(
        c.table(spark, sf_dir, "events"), "ts", "2024-01-02", "2024-01-04 10:00:00", 6, "hour",
        hardend=True, other=("before", "after"),
    )


def _scoped(spark, sf_dir):
    items = c.table(spark, sf_dir, "orders")
    cheap = F.col("o_totalprice") < 200000
    request = SearchRequest(
        choices=(Choice("o_orderstatus", m.term(F.col("o_orderstatus"), "F")),),
        facets=(
            Facet("o_orderstatus", where=F.col("o_totalprice") > 50000),
            Facet("o_orderpriority"),
            Facet("o_orderpriority", where=cheap, name="cheap_priority"),
        ),
    )
    return items, request, cheap


def facet_scopes(spark, sf_dir):
    items, request, _ = _scoped(spark, sf_dir)
    return _long(search(items, request, "o_orderkey").facets)


def facet_post_filter(spark, sf_dir):
    items, request, cheap = _scoped(spark, sf_dir)
    with_post = replace(request, post=cheap)
    totals = [
        search(items, r, "o_orderkey").total.select(F.lit(name).alias("scope"), "total")
        for name, r in (("chosen", request), ("post", with_post))
    ]
    return totals[0].unionByName(totals[1])


def search_answer(spark, sf_dir):
    """Hits, total and facets of one request, from one pass over the texts."""
    docs = c.table(spark, sf_dir, "documents", "doc_id", ["doc_id", "text", "lang", "source", "n_chars"])
    request = SearchRequest(
        text=m.text_query(F.col("text"), F.col("lang"), "that"), sort=(("n_chars", "desc"),), start=5, size=20,
        facets=(Facet("lang"), Facet("source", size=4)), fields=("doc_id", "n_chars"),
    )
    found, _ = search_once(docs, request)
    hits = found.hits.select(F.lit("hit").alias("part"), F.col("doc_id").cast("string").alias("value"), F.col("n_chars").alias("n"))
    total = found.total.select(F.lit("total").alias("part"), F.lit("all").alias("value"), F.col("total").alias("n"))
    return hits.unionAll(total).unionAll(found.facets.select("facet", "value", "n"))


def total_hits(spark, sf_dir):
    docs = c.table(spark, sf_dir, "documents", "doc_id", ["doc_id", "text", "lang"])
    request = SearchRequest(text=m.text_query(F.col("text"), F.col("lang"), "that"), start=30)
    return search(docs, request).total


QUERIES = {
    f.__name__: f
    for f in (
        facets_multi, facet_text, facet_orders, facet_nested, facet_options, facet_zero_counts,
        facet_range, facet_range_hardend, facet_range_edge, facet_date, facet_date_years, facet_date_hours,
        facet_scopes, facet_post_filter, facet_ranked, search_answer, total_hits,
    )
}


def _facet_sql(facet: str, value: str, source: str, order: str, size: int, where: str = "TRUE") -> str:
    return f"""SELECT * FROM (
  SELECT '{facet}' AS facet, ({value})::VARCHAR AS value, count(*) AS n,
    row_number() OVER (ORDER BY {order}) AS rank
  FROM {source} WHERE ({value}) IS NOT NULL AND ({where}) GROUP BY 2) WHERE rank <= {size}"""


_BY_COUNT = "count(*) DESC, value"
_PART_ORDERS = {
    "count": _BY_COUNT,
    "reverse_count": "count(*), value",
    "term": "value",
    "reverse_term": "value DESC",
}
_CHOSEN = "o_orderstatus = 'F' AND o_totalprice > 50000"


def _buckets_sql(ranges: str, source: str, rows: list[str]) -> str:
    return f"""WITH r AS ({ranges})
SELECT 'range' AS kind, r.low, r.high, (SELECT count(*) FROM {source} WHERE {rows[0]}) AS n FROM r
""" + "".join(
        f"UNION ALL SELECT '{kind}', NULL, NULL, count(*) FROM {source} WHERE {test}\n"
        for kind, test in rows[1:]
    )


ORACLES = {
    "facets_multi": """WITH d AS (SELECT *, n_chars > 2000 AS long FROM documents LEFT JOIN labels USING (doc_id))
"""
    + " UNION ALL ".join(
        [
            _facet_sql("lang", "lang", "d", _BY_COUNT, 10),
            _facet_sql("source", "source", "d", _BY_COUNT, 5),
            _facet_sql("source_z", "source", "d", "value DESC", 5),
            _facet_sql("quality", "quality", "d", "value", 10),
            _facet_sql("long", "long", "d", "count(*), value", 10),
        ]
    ),
    "facet_text": f"""WITH t AS (SELECT DISTINCT doc_id, unnest({c.words_sql('text')}) AS token FROM documents)
{_facet_sql('text', 'token', 't', _BY_COUNT, 10)}""",
    "facet_orders": " UNION ALL ".join(_facet_sql(o, "p_name", "part", k, 7) for o, k in _PART_ORDERS.items()),
    "facet_nested": f"""WITH t AS (
  SELECT DISTINCT page_id, unnest([{decode_sql('t')} FOR t IN regexp_extract_all(html, {LINK}, 2)]) AS v FROM pages)
{_facet_sql('link_text', 'v', 't', _BY_COUNT, 15)}""",
    "facet_options": """SELECT 'brand' AS facet, * FROM (
  SELECT p_brand AS value, count(*) FILTER (WHERE p_size > 25) AS n FROM part
  WHERE starts_with(p_brand, 'Brand#1') GROUP BY p_brand HAVING count(*) FILTER (WHERE p_size > 25) >= 1
  ORDER BY p_brand LIMIT 6 OFFSET 2)
UNION ALL
SELECT 'quality', quality::VARCHAR, count(*) FROM documents LEFT JOIN labels USING (doc_id) GROUP BY quality""",
    "facet_ranked": """WITH o AS (
  SELECT CASE WHEN o_orderstatus <> 'P' THEN o_orderpriority END AS value FROM orders WHERE o_totalprice > 150000),
r AS (
  SELECT value, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, value) AS rank
  FROM o WHERE value IS NOT NULL GROUP BY value)
SELECT value, n, rank FROM r WHERE rank BETWEEN 2 AND 4
UNION ALL SELECT NULL, count(*), NULL FROM o WHERE value IS NULL""",
    "facet_zero_counts": """SELECT p_brand AS value, count(*) FILTER (WHERE p_name = 'red widget') AS n
FROM part GROUP BY p_brand""",
    "facet_range": _buckets_sql(
        "SELECT 50000.0::DOUBLE + i * 60000 AS low, 50000.0::DOUBLE + (i + 1) * 60000 AS high FROM range(6) t(i)",
        "orders",
        [
            "o_totalprice >= r.low AND o_totalprice < r.high",
            ("before", "o_totalprice < 50000"),
            ("after", "o_totalprice >= 410000"),
            ("between", "o_totalprice >= 50000 AND o_totalprice < 410000"),
        ],
    ),
    "facet_range_hardend": _buckets_sql(
        "SELECT 5.0::DOUBLE + i * 10 AS low, least(5.0::DOUBLE + (i + 1) * 10, 47.0) AS high FROM range(5) t(i)",
        "lineitem",
        [
            "l_quantity >= r.low AND l_quantity <= r.high",
            ("before", "l_quantity < 5"),
            ("after", "l_quantity > 47"),
            ("between", "l_quantity >= 5 AND l_quantity <= 47"),
        ],
    ),
    "facet_range_edge": _buckets_sql(
        "SELECT 10.0::DOUBLE + i * 10 AS low, 10.0::DOUBLE + (i + 1) * 10 AS high FROM range(3) t(i)",
        "lineitem",
        [
            "(l_quantity > r.low OR (r.low = 10 AND l_quantity = 10)) AND l_quantity <= r.high",
            ("before", "l_quantity <= 10"),
            ("after", "l_quantity >= 40"),
            ("between", "l_quantity >= 10 AND l_quantity <= 40"),
        ],
    ),
    "facet_date": _buckets_sql(
        """SELECT TIMESTAMP '1996-01-01' + to_months(i::INTEGER) AS low,
  TIMESTAMP '1996-01-01' + to_months((i + 1)::INTEGER) AS high FROM range(24) t(i)""",
        "orders",
        [
            "o_orderdate >= r.low AND o_orderdate < r.high",
            ("before", "o_orderdate < TIMESTAMP '1996-01-01'"),
            ("after", "o_orderdate >= TIMESTAMP '1998-01-01'"),
            ("between", "o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1998-01-01'"),
        ],
    ),
    "facet_date_years": _buckets_sql(
        """SELECT TIMESTAMP '1995-01-01' + to_years(2 * i::INTEGER) AS low,
  TIMESTAMP '1995-01-01' + to_years(2 * (i + 1)::INTEGER) AS high FROM range(3) t(i)""",
        "lineitem",
        ["l_shipdate >= r.low AND l_shipdate < r.high"],
    ),
    "facet_date_hours": _buckets_sql(
        """SELECT TIMESTAMP '2024-01-02' + to_hours(6 * i::INTEGER) AS low,
  least(TIMESTAMP '2024-01-02' + to_hours(6 * (i + 1)::INTEGER), TIMESTAMP '2024-01-04 10:00:00') AS high
  FROM range(10) t(i)""",
        "events",
        [
            "ts >= r.low AND ts < r.high",
            ("before", "ts < TIMESTAMP '2024-01-02'"),
            ("after", "ts >= TIMESTAMP '2024-01-04 10:00:00'"),
        ],
    ),
    "facet_scopes": " UNION ALL ".join(
        [
            _facet_sql("o_orderstatus", "o_orderstatus", "orders", _BY_COUNT, 10, _CHOSEN),
            _facet_sql("o_orderpriority", "o_orderpriority", "orders", _BY_COUNT, 10, _CHOSEN),
            _facet_sql(
                "cheap_priority", "o_orderpriority", "orders", _BY_COUNT, 10, f"{_CHOSEN} AND o_totalprice < 200000"
            ),
        ]
    ),
    "facet_post_filter": f"""SELECT 'chosen' AS scope, count(*) AS total FROM orders WHERE {_CHOSEN}
UNION ALL SELECT 'post', count(*) FROM orders WHERE o_orderstatus = 'F' AND o_totalprice < 200000""",
    "search_answer": f"""WITH {c.TOKENS},
d AS (SELECT * FROM documents WHERE doc_id IN (SELECT doc_id FROM tokens WHERE token = 'that'))
SELECT * FROM (SELECT 'hit' AS part, doc_id::VARCHAR AS value, n_chars AS n FROM d ORDER BY n_chars DESC, doc_id LIMIT 20 OFFSET 5)
UNION ALL SELECT 'total', 'all', count(*) FROM d
UNION ALL SELECT facet, value, n FROM ({_facet_sql("lang", "lang", "d", _BY_COUNT, 10)})
UNION ALL SELECT facet, value, n FROM ({_facet_sql("source", "source", "d", _BY_COUNT, 4)})""",
    "total_hits": f"""WITH {c.TOKENS} SELECT count(DISTINCT doc_id) AS total FROM tokens WHERE token = 'that'""",
}
