"""Search queries: predicates, paging, highlighting, distance, spelling, ranking."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.catalogue import common as c
from corpusloom.catalogue.pages import BODY, LINK, decode_sql
from corpusloom.functions import display as d
from corpusloom.functions import geo
from corpusloom.functions import highlight as hl
from corpusloom.functions import html as h
from corpusloom.functions import match as m
from corpusloom.functions import text as tx
from corpusloom.functions.rows import keep, once
from corpusloom.operators import fuzzy as fz
from corpusloom.operators import places
from corpusloom.operators import relevance as rel
from corpusloom.operators import words as ops
from corpusloom.operators.records import drop_null_content, normalise_content
from corpusloom.operators.search import Choice, SearchRequest, partial_fields, search
from corpusloom.sources.tables import scan


def _texts(spark, sf_dir):
    docs = c.table(spark, sf_dir, "documents", "doc_id", ["doc_id", "text", "lang", "source", "n_chars"])
    return docs


def _with_tokens(spark, sf_dir):
    return _texts(spark, sf_dir).withColumn("tokens", tx.tokenise(F.col("text"), F.col("lang")))


def _ids(df):
    return df.select("doc_id", "lang", "source")


def scan_filtered(spark, sf_dir):
    path = f"{sf_dir}/documents.parquet"
    return scan(spark, path, ["doc_id", "text"], F.col("lang") == "fr", descending="doc_id")


def null_text_dropped(spark, sf_dir):
    labels = c.table(spark, sf_dir, "labels")
    docs = c.table(spark, sf_dir, "documents").join(labels, "doc_id", "left")
    # only judged-good documents keep a text, the others carry a null
    shown = docs.select("doc_id", F.when(F.col("quality") == 1, F.col("text")).alias("text"))
    return normalise_content(drop_null_content(shown))


def match_all(spark, sf_dir):
    rows = c.table(spark, sf_dir, "part").where(m.match_all())
    return rows.select("p_partkey", "p_name")


def term_and(spark, sf_dir):
    choice = [m.term(F.col("c_mktsegment"), "BUILDING"), m.term(F.col("c_nationkey"), 7)]
    return c.table(spark, sf_dir, "customer").where(m.combine(choice)).select("c_custkey", "c_name")


def range_filter(spark, sf_dir):
    first, last = (F.lit(d).cast("timestamp_ntz") for d in ("1996-01-01", "1996-12-31 23:59:59.999999"))
    inside = m.in_range(F.col("o_totalprice"), 100000.0, 150000.0) & m.in_range(
        F.col("o_orderdate"), first, last
    )
    return c.table(spark, sf_dir, "orders").where(inside).select("o_orderkey", "o_totalprice")


def free_text_and(spark, sf_dir):
    found = m.text_query(F.col("text"), F.col("lang"), "With FROM", "AND")
    return _ids(keep(_texts(spark, sf_dir), found))


def free_text_or(spark, sf_dir):
    return _ids(keep(_texts(spark, sf_dir), m.text_query(F.col("text"), F.col("lang"), "por nicht")))


def free_text_fields(spark, sf_dir):
    fields = [F.col("tokens"), tx.tokenise(F.col("source"))]
    return _ids(keep(_with_tokens(spark, sf_dir), m.free_text(fields, "src3 that", "AND")))


def wildcard(spark, sf_dir):
    tokens = tx.tokenise(F.col("p_name"))
    rows = c.table(spark, sf_dir, "part").where(m.free_text([tokens], "ed idg", "AND", "*"))
    return rows.select("p_partkey", "p_name")


def fuzzy(spark, sf_dir):
    tokens = tx.tokenise(F.col("p_name"))
    rows = c.table(spark, sf_dir, "part").where(m.free_text([tokens], "smll widgte", "OR", "~"))
    return rows.select("p_partkey", "p_name")


def fuzzy_documents(spark, sf_dir):
    return _near_documents(spark, sf_dir, ["there"], 1)


FAR_WORDS = ["there", "nihct", "dansk"]


def fuzzy_documents_all(spark, sf_dir):
    """Documents with a word near each of two."""
    return _near_documents(spark, sf_dir, ["thare", "hass"], 2)


def _postings(spark, sf_dir):
    """Every document's distinct words with their counts, written once."""
    counts = tx.term_counts(F.col("text"), F.col("lang"))
    return ops.shared(_texts(spark, sf_dir).where(F.col("text").isNotNull()).select(
        "doc_id", "lang", "source", counts.alias("terms")
    ))


def _near_documents(spark, sf_dir, words, n_words):
    postings = _postings(spark, sf_dir)
    vocabulary = ops.word_count_by_doc(postings).select("term").distinct()
    most = max(m.allowed_edits(w) for w in words)
    near = fz.similar_terms(fz.variant_index(vocabulary, most, words), words)
    return _ids(fz.with_similar_words(postings, near, n_words))


def fuzzy_terms(spark, sf_dir):
    """The vocabulary's words near misspelt ones, through its index of deletion variants."""
    stats = ops.corpus_word_stats(ops.word_count_by_doc(_postings(spark, sf_dir)))
    near = fz.similar_terms(fz.variant_index(stats), FAR_WORDS, 2)
    return near.join(stats, "term").select("word", "term", F.col("distance").cast("bigint").alias("distance"), "documents")


def phrase(spark, sf_dir):
    return _ids(keep(_texts(spark, sf_dir), m.text_phrase(F.col("text"), F.col("lang"), "in the")))


def _joined(spark, sf_dir):
    """Documents whose words have an article or a possessive joined to them."""
    docs = c.documents(spark, sf_dir)
    joined = F.when(F.col("lang") == "fr", F.replace("text", F.lit(" que"), F.lit(" l'que"))).otherwise(
        F.replace("text", F.lit(" that "), F.lit(" that's "))
    )
    return docs.where(F.col("lang").isin("fr", "en")).withColumn("text", joined)


def _found_by(docs, query, operator, side):
    found = m.text_query(F.col("text"), F.col("lang"), query, operator).alias("found")
    beside = m.text_phrase(F.col("text"), F.col("lang"), side).alias("side")
    hits = once(docs, F.struct(found, beside), "hit", "doc_id")
    return hits.select("doc_id", "hit.found", "hit.side")


def query_elision(spark, sf_dir):
    """A query word with a French article meets words with and without it."""
    return _found_by(_joined(spark, sf_dir), "l'que l’quepa", "OR", "de l'que")


def query_possessive(spark, sf_dir):
    return _found_by(_joined(spark, sf_dir), "that's of’s", "AND", "that's the")


def two_field_or(spark, sf_dir):
    pages = c.table(spark, sf_dir, "pages", "page_id").select(
        "page_id", tx.tokenise(h.body_text(F.col("html"))).alias("body"), tx.tokenise(F.col("url")).alias("path")
    )
    words = m.two_fields(F.col("body"), F.col("path"), "blog nicht")
    quoted = m.two_fields(F.col("body"), F.col("path"), '"example com"')
    return pages.select("page_id", words.alias("any_word"), quoted.alias("as_phrase"))


def or_group(spark, sf_dir):
    rows = c.table(spark, sf_dir, "lineitem").where(m.any_of(F.col("l_returnflag"), ["A", "R"]))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity")
    )


def or_group_table(spark, sf_dir):
    wanted = c.table(spark, sf_dir, "nation").where(F.col("n_regionkey") == 2)
    wanted = wanted.select(F.col("n_nationkey").alias("c_nationkey"))
    rows = m.keep_matching(c.table(spark, sf_dir, "customer"), "c_nationkey", wanted)
    return rows.select("c_custkey", "c_nationkey")


def nested_any(spark, sf_dir):
    pages = c.table(spark, sf_dir, "pages", "page_id")
    same = m.nested_any(h.links(F.col("html")), lambda e: (e["text"] == "de") & (e["url"] == "/de"))
    return pages.where(same).select("page_id", "url")


def nested_any_rows(spark, sf_dir):
    turns = c.table(spark, sf_dir, "conversations")
    met = m.term(F.col("role"), "assistant") & m.has_value(tx.tokenise(F.col("text")), "the")
    return turns.groupBy("conv_id").agg(F.bool_or(met).alias("met")).where("met").select("conv_id")


def exclude(spark, sf_dir):
    labels = c.table(spark, sf_dir, "labels")
    docs = c.table(spark, sf_dir, "documents").select("doc_id", "source").join(labels, "doc_id", "left")
    return docs.where(m.exclude(F.col("toxic") == 1) & m.exclude(F.col("source") == "src1"))


def multivalue(spark, sf_dir):
    pages = c.table(spark, sf_dir, "pages", "page_id")
    urls = F.transform(h.links(F.col("html")), lambda e: e["url"])
    return pages.where(m.has_value(urls, "/the")).select("page_id")


def predefined_filters(spark, sf_dir):
    request = SearchRequest(
        predefined=(F.col("p_size") <= 10,),
        choices=(
            Choice("p_brand", m.term(F.col("p_brand"), "Brand#2"), any_of=True),
            Choice("p_brand", m.term(F.col("p_brand"), "Brand#17"), any_of=True),
            Choice("p_type", m.term(F.col("p_type"), "ECONOMY")),
        ),
        sort=(("p_retailprice", "desc"),),
        size=50,
        fields=("p_partkey", "p_brand", "p_size"),
    )
    return search(c.table(spark, sf_dir, "part"), request, "p_partkey").hits


def lone_or_compat(spark, sf_dir):
    alone = (Choice("c_mktsegment", m.term(F.col("c_mktsegment"), "BUILDING"), any_of=True),)
    customers = c.table(spark, sf_dir, "customer")
    totals = [
        search(customers, SearchRequest(choices=alone, lone_or=mode), "c_custkey").total.select(
            F.lit(mode).alias("mode"), "total"
        )
        for mode in ("term", "match_all")
    ]
    return totals[0].unionByName(totals[1])


def page_two(spark, sf_dir):
    request = SearchRequest(size=25, sort=(("o_totalprice", "desc"),)).next_page()
    hits = search(c.table(spark, sf_dir, "orders"), request, "o_orderkey").hits
    return hits.select("o_orderkey", "o_totalprice")


def page_deep(spark, sf_dir):
    """The eleventh page of 100, each page found from the last row of the one before."""
    orders = c.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_totalprice")
    request = SearchRequest(size=100, sort=(("o_orderdate", "desc"), ("o_totalprice", "asc")))
    for _ in range(10):
        rows = search(orders, request, "o_orderkey").hits.collect()
        if not rows:
            break
        request = request.page_after(rows[-1], "o_orderkey")
    return search(orders, request, "o_orderkey").hits


def sort_field(spark, sf_dir):
    request = SearchRequest(text=F.col("lang") == "es", size=20).sorted_by("n_chars", "asc")
    return search(c.table(spark, sf_dir, "documents"), request).hits.select("doc_id", "n_chars")


def fields_returned(spark, sf_dir):
    docs = c.table(spark, sf_dir, "documents")
    named = partial_fields(docs, {"core": ("doc_id", "lang"), "origin": ("source",)})
    return named.select("core.doc_id", "core.lang", "origin.source")


def highlight(spark, sf_dir):
    words = ["that", "nicht", "por", "dans"]
    docs = _texts(spark, sf_dir)
    marked = once(docs, hl.fragment(F.col("text"), words), "fragment", "doc_id", "source")
    return marked.where(F.col("fragment").isNotNull()).select(
        "doc_id", "fragment", hl.mark(F.col("source"), ["src3"], "<b>", "</b>").alias("path")
    )


def _places(spark, sf_dir, table, key):
    at = F.col(key)
    return c.table(spark, sf_dir, table).select(
        at, ((at * 37) % 180 - 90).cast("double").alias("lat"), ((at * 91) % 360 - 180).cast("double").alias("lng")
    )


def geo_radius(spark, sf_dir):
    homes = _places(spark, sf_dir, "customer", "c_custkey")
    near = geo.within(F.col("lat"), F.col("lng"), 48.85, 2.35, 1500.0)
    km = geo.arc_distance(F.col("lat"), F.col("lng"), 48.85, 2.35)
    return homes.where(near).select("c_custkey", F.round(km, 4).alias("km"))


def geo_plane(spark, sf_dir):
    homes = _places(spark, sf_dir, "supplier", "s_suppkey")
    near = geo.within(F.col("lat"), F.col("lng"), 10.0, 20.0, 2500.0, "miles", "plane")
    miles = geo.plane_distance(F.col("lat"), F.col("lng"), 10.0, 20.0, "miles")
    return homes.where(near).select("s_suppkey", F.round(miles, 4).alias("miles"))


def geo_pairs(spark, sf_dir):
    """Suppliers around every customer."""
    customers, suppliers = _places(spark, sf_dir, "customer", "c_custkey"), _places(spark, sf_dir, "supplier", "s_suppkey")
    found = places.within_radius(suppliers, customers, "s_suppkey", "c_custkey", 800.0)
    return found.withColumn("distance", F.round("distance", 4))


MISSPELT = "smal rign blu widgett gren"


def _part_stats(spark, sf_dir):
    parts = c.table(spark, sf_dir, "part").select("p_partkey", "p_name")
    terms = ops.doc_terms(parts, None, "p_partkey", "p_name", None)
    return ops.corpus_word_stats(ops.word_count_by_doc(terms))


def spell_suggest(spark, sf_dir):
    found = rel.suggest(_part_stats(spark, sf_dir), MISSPELT.split())
    return found.withColumn("distance", F.col("distance").cast("bigint"))


MISTYPED = "thare wich plaec bettwen zzyyxx"


def spell_indexed(spark, sf_dir):
    """Suggestions from all documents, through the vocabulary's index."""
    stats = ops.shared(ops.corpus_word_stats(ops.word_count_by_doc(_postings(spark, sf_dir))))
    found = rel.suggest(stats, MISTYPED.split(), per_word=3, index=fz.variant_index(stats))
    return found.withColumn("distance", F.col("distance").cast("bigint"))


def spell_query(spark, sf_dir):
    found = rel.suggest(_part_stats(spark, sf_dir), MISSPELT.split())
    return rel.suggested_query(found, MISSPELT)


def relevance_topk(spark, sf_dir):
    terms = ops.doc_terms(c.documents(spark, sf_dir), None)
    ranked = rel.relevance(terms, ["that", "nicht", "thin", "por"], 20)
    return ranked.withColumn("score", F.round("score", 6))


def search_hits_shown(spark, sf_dir):
    docs = _with_tokens(spark, sf_dir)
    request = SearchRequest(
        choices=(Choice("lang", m.term(F.col("lang"), "en")),),
        text=m.free_text([F.col("tokens")], "that thin", "AND"),
        sort=(("n_chars", "desc"),),
        size=15,
    )
    hits = search(docs, request).hits
    template = [[{"pre": "<i>", "field": "source", "post": "</i>"}, {"pre": "chars: ", "field": "n_chars"}]]
    return hits.select("doc_id", d.display_lines(hits, template).alias("shown"))


QUERIES = {
    f.__name__: f
    for f in (
        scan_filtered, null_text_dropped, match_all, term_and, range_filter, free_text_and,
        free_text_or, free_text_fields, wildcard, fuzzy, fuzzy_documents, fuzzy_documents_all, fuzzy_terms, phrase, two_field_or,
        query_elision, query_possessive,
        or_group, or_group_table, nested_any, nested_any_rows, exclude, multivalue,
        predefined_filters, lone_or_compat, page_two, page_deep, sort_field, fields_returned, highlight,
        geo_radius, geo_plane, geo_pairs, spell_suggest, spell_indexed, spell_query, relevance_topk, search_hits_shown,
    )
}


_TOK = f"""[CASE WHEN lang = 'fr' THEN regexp_replace(w, {c.quoted(tx.ELISION)}, '')
  WHEN lang = 'en' THEN regexp_replace(w, {c.quoted(tx.POSSESSIVE)}, '') ELSE w END FOR w IN {c.words_sql('text')}]"""
_DOCS = f"d AS (SELECT *, {_TOK} AS tokens FROM documents)"
_PARTS = f"p AS (SELECT *, {c.words_sql('p_name')} AS tokens FROM part)"


def _any(tokens: str, test: str) -> str:
    return f"len([t FOR t IN {tokens} IF {test}]) > 0"


_PART_STATS = f"""words AS (SELECT p_partkey, unnest({c.words_sql('p_name')}) AS term FROM part),
stats AS (SELECT term, count(DISTINCT p_partkey) AS documents FROM words GROUP BY term),
asked AS (SELECT unnest({MISSPELT.split()}) AS word),
ranked AS (
  SELECT word, term AS suggestion, levenshtein(term, word)::BIGINT AS distance, documents,
    row_number() OVER (PARTITION BY word ORDER BY levenshtein(term, word), documents DESC, term) AS r
  FROM stats JOIN asked ON abs(length(term) - length(word)) <= 2 AND levenshtein(term, word) <= 2
  WHERE word NOT IN (SELECT term FROM stats)),
found AS (SELECT word, suggestion, distance, documents FROM ranked WHERE r = 1)"""

# one ASCII sign for every other character, as distances count bytes on this side
_ASCII = "regexp_replace(t, '[^\\x00-\\x7F]', '#', 'g')"
_DOC_STATS = f"""{_DOCS},
stats AS (SELECT t, count(*) AS documents FROM (
  SELECT doc_id, unnest(list_distinct(tokens)) AS t FROM d) GROUP BY t)"""

_PIECE = r"[\p{L}\p{N}]+(?:[''’][\p{L}\p{N}]+)*|[^\p{L}\p{N}]+"
_ARC = """2 * 6371.0 * asin(sqrt(least(1.0, pow(sin(radians(lat - 48.85) / 2), 2)
  + cos(radians(lat)) * cos(radians(48.85)) * pow(sin(radians(lng - 2.35) / 2), 2))))"""
_PLANE = """3958.8 * sqrt(pow(radians(least(abs(lng - 20.0), 360 - abs(lng - 20.0))) * cos(radians(10.0)), 2)
  + pow(radians(lat - 10.0), 2))"""

# words of the same derived texts, articles and possessives taken off by plain replacement
_JOINED = """d AS (
  SELECT doc_id, lang, CASE WHEN lang = 'fr' THEN replace(text, ' que', ' l' || chr(39) || 'que')
    ELSE replace(text, ' that ', ' that' || chr(39) || 's ') END AS text FROM documents WHERE lang IN ('fr', 'en')),
t AS (
  SELECT doc_id, lang, ' ' || array_to_string(regexp_extract_all(
    CASE WHEN lang = 'fr' THEN replace(lower(text), 'l' || chr(39), '') ELSE replace(lower(text), chr(39) || 's', '') END,
    '[\\p{L}\\p{N}]+(?:' || chr(39) || '[\\p{L}\\p{N}]+)*'), ' ') || ' ' AS line FROM d)"""

ORACLES = {
    "query_elision": f"""WITH {_JOINED} SELECT doc_id,
  lang = 'fr' AND (contains(line, ' que ') OR contains(line, ' quepa ')) AS found,
  lang = 'fr' AND contains(line, ' de que ') AS side FROM t""",
    "query_possessive": f"""WITH {_JOINED} SELECT doc_id,
  lang = 'en' AND contains(line, ' that ') AND contains(line, ' of ') AS found,
  lang = 'en' AND contains(line, ' that the ') AS side FROM t""",
    "scan_filtered": "SELECT doc_id, text FROM documents WHERE lang = 'fr' ORDER BY doc_id DESC",
    "null_text_dropped": """SELECT d.doc_id, replace(replace(d.text, '_', ' '), '.pdf', '') AS text
FROM documents d JOIN labels l USING (doc_id) WHERE l.quality = 1 AND d.text IS NOT NULL""",
    "match_all": "SELECT p_partkey, p_name FROM part",
    "term_and": "SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey = 7",
    "range_filter": """SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice BETWEEN 100000 AND 150000
AND o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1997-01-01'""",
    "free_text_and": f"""WITH {_DOCS} SELECT doc_id, lang, source FROM d
WHERE list_contains(tokens, 'with') AND list_contains(tokens, 'from')""",
    "free_text_or": f"""WITH {_DOCS} SELECT doc_id, lang, source FROM d
WHERE list_contains(tokens, 'por') OR list_contains(tokens, 'nicht')""",
    "free_text_fields": f"""WITH {_DOCS} SELECT doc_id, lang, source FROM d
WHERE (list_contains(tokens, 'src3') OR source = 'src3') AND list_contains(tokens, 'that')""",
    "wildcard": f"""WITH {_PARTS} SELECT p_partkey, p_name FROM p
WHERE {_any('tokens', "t LIKE '%ed%'")} AND {_any('tokens', "t LIKE '%idg%'")}""",
    "fuzzy": f"""WITH {_PARTS} SELECT p_partkey, p_name FROM p
WHERE {_any('tokens', "levenshtein(t, 'smll') <= 1")} OR {_any('tokens', "levenshtein(t, 'widgte') <= 2")}""",
    "fuzzy_documents": f"""WITH {_DOCS} SELECT doc_id, lang, source FROM d
-- one ASCII sign for every other character, as this side counts bytes
WHERE {_any('tokens', "levenshtein(regexp_replace(t, '[^\\x00-\\x7F]', '#', 'g'), 'there') <= 1")}""",
    "fuzzy_documents_all": f"""WITH {_DOCS} SELECT doc_id, lang, source FROM d
WHERE {_any('tokens', f"levenshtein({_ASCII}, 'thare') <= 1")} AND {_any('tokens', f"levenshtein({_ASCII}, 'hass') <= 1")}""",
    "fuzzy_terms": f"""WITH {_DOC_STATS}
SELECT word, t AS term, levenshtein({_ASCII}, word)::BIGINT AS distance, documents
FROM stats, (SELECT unnest({FAR_WORDS}) AS word) WHERE levenshtein({_ASCII}, word) <= 2""",
    "phrase": f"""WITH {_DOCS} SELECT doc_id, lang, source FROM d
WHERE contains(' ' || array_to_string(tokens, ' ') || ' ', ' in the ')""",
    "two_field_or": f"""WITH p AS (
  SELECT page_id, ' ' || array_to_string({c.words_sql(BODY)}, ' ') || ' ' AS body,
    ' ' || array_to_string({c.words_sql('url')}, ' ') || ' ' AS path FROM pages)
SELECT page_id, contains(body, ' blog ') OR contains(path, ' blog ')
    OR contains(body, ' nicht ') OR contains(path, ' nicht ') AS any_word,
  contains(body, ' example com ') OR contains(path, ' example com ') AS as_phrase FROM p""",
    "or_group": """SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity
FROM lineitem WHERE l_returnflag IN ('A', 'R') GROUP BY ALL""",
    "or_group_table": """SELECT c_custkey, c_nationkey FROM customer
WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2)""",
    "nested_any": f"""WITH l AS (
  SELECT page_id, url, regexp_extract_all(html, {LINK}, 1) AS urls,
    [{decode_sql('t')} FOR t IN regexp_extract_all(html, {LINK}, 2)] AS texts FROM pages)
SELECT page_id, url FROM l
WHERE len([1 FOR z IN list_zip(urls, texts) IF z[1] = '/de' AND z[2] = 'de']) > 0""",
    "nested_any_rows": f"""SELECT DISTINCT conv_id FROM conversations
WHERE role = 'assistant' AND list_contains({c.words_sql('text')}, 'the')""",
    "exclude": """SELECT doc_id, source, quality, toxic FROM documents LEFT JOIN labels USING (doc_id)
WHERE coalesce(toxic, 0) <> 1 AND source <> 'src1'""",
    "multivalue": f"""SELECT page_id FROM pages WHERE list_contains(regexp_extract_all(html, {LINK}, 1), '/the')""",
    "predefined_filters": """SELECT p_partkey, p_brand, p_size FROM part
WHERE p_size <= 10 AND p_brand IN ('Brand#2', 'Brand#17') AND p_type = 'ECONOMY'
ORDER BY p_retailprice DESC, p_partkey LIMIT 50""",
    "lone_or_compat": """SELECT 'term' AS mode, count(*) AS total FROM customer WHERE c_mktsegment = 'BUILDING'
UNION ALL SELECT 'match_all', count(*) FROM customer""",
    "page_two": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 25",
    "page_deep": """SELECT o_orderkey, o_orderdate, o_totalprice FROM orders
ORDER BY o_orderdate DESC, o_totalprice, o_orderkey LIMIT 100 OFFSET 1000""",
    "sort_field": "SELECT doc_id, n_chars FROM documents WHERE lang = 'es' ORDER BY n_chars, doc_id LIMIT 20",
    "fields_returned": "SELECT doc_id, lang, source FROM documents",
    "highlight": f"""WITH cut AS (
  SELECT doc_id, text, source, regexp_extract_all(text, '{_PIECE}') AS parts FROM documents),
hit AS (
  SELECT *, [i FOR i IN range(1, len(parts) + 1) IF lower(parts[i]) IN ('that', 'nicht', 'por', 'dans')] AS hits FROM cut),
pos AS (
  SELECT *, greatest(length(array_to_string(parts[1:hits[1] - 1], '')) - 250, 0) AS start FROM hit WHERE len(hits) > 0),
win AS (SELECT *, substring(text, (start + 1)::BIGINT, 500) AS w0 FROM pos),
lft AS (
  SELECT *, CASE WHEN start > 0 AND regexp_matches(substring(text, start::BIGINT, 1), '[\\p{{L}}\\p{{N}}''’]')
    THEN regexp_replace(w0, '^[\\p{{L}}\\p{{N}}''’]+', '') ELSE w0 END AS w1 FROM win),
rgt AS (
  SELECT *, CASE WHEN regexp_matches(substring(text, (start + 501)::BIGINT, 1), '[\\p{{L}}\\p{{N}}''’]')
    THEN regexp_replace(w1, '[\\p{{L}}\\p{{N}}''’]+\\z', '') ELSE w1 END AS w2 FROM lft)
SELECT doc_id, '...' || array_to_string([CASE WHEN lower(x) IN ('that', 'nicht', 'por', 'dans')
    THEN '<mark>' || x || '</mark>' ELSE x END
    FOR x IN regexp_extract_all(w2, '{_PIECE}')], '') || '...' AS fragment,
  CASE WHEN source = 'src3' THEN '<b>src3</b>' ELSE source END AS path
FROM rgt""",
    "geo_radius": f"""WITH g AS (SELECT c_custkey, ((c_custkey * 37) % 180 - 90)::DOUBLE AS lat,
  ((c_custkey * 91) % 360 - 180)::DOUBLE AS lng FROM customer)
SELECT c_custkey, round({_ARC}, 4) AS km FROM g WHERE {_ARC} <= 1500""",
    "geo_plane": f"""WITH g AS (SELECT s_suppkey, ((s_suppkey * 37) % 180 - 90)::DOUBLE AS lat,
  ((s_suppkey * 91) % 360 - 180)::DOUBLE AS lng FROM supplier)
SELECT s_suppkey, round({_PLANE}, 4) AS miles FROM g WHERE {_PLANE} <= 2500""",
    "geo_pairs": """WITH a AS (SELECT c_custkey, ((c_custkey * 37) % 180 - 90)::DOUBLE AS lat0,
  ((c_custkey * 91) % 360 - 180)::DOUBLE AS lng0 FROM customer),
b AS (SELECT s_suppkey, ((s_suppkey * 37) % 180 - 90)::DOUBLE AS lat, ((s_suppkey * 91) % 360 - 180)::DOUBLE AS lng FROM supplier),
pairs AS (SELECT c_custkey, s_suppkey, 2 * 6371.0 * asin(sqrt(least(1.0, pow(sin(radians(lat - lat0) / 2), 2)
  + cos(radians(lat)) * cos(radians(lat0)) * pow(sin(radians(lng - lng0) / 2), 2)))) AS distance FROM a, b)
SELECT c_custkey, s_suppkey, round(distance, 4) AS distance FROM pairs WHERE distance <= 800""",
    "spell_suggest": f"WITH {_PART_STATS} SELECT word, suggestion, distance, documents FROM found",
    "spell_indexed": f"""WITH {_DOC_STATS},
near AS (
  SELECT word, t AS suggestion, levenshtein({_ASCII}, word)::BIGINT AS distance, documents
  FROM stats, (SELECT unnest({MISTYPED.split()}) AS word)
  WHERE levenshtein({_ASCII}, word) <= 2 AND word NOT IN (SELECT t FROM stats)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY distance, documents DESC, suggestion) AS r FROM near)
SELECT word, suggestion, distance, documents FROM ranked WHERE r <= 3""",
    "spell_query": f"""WITH {_PART_STATS},
parts AS (SELECT unnest({MISSPELT.split()}) AS w, generate_subscripts({MISSPELT.split()}, 1) AS i)
SELECT string_agg(coalesce(f.suggestion, p.w), ' ' ORDER BY p.i) AS suggested
FROM parts p LEFT JOIN found f ON f.word = p.w""",
    "relevance_topk": f"""WITH {c.TOKENS},
counts AS (SELECT doc_id, token, count(*) AS n FROM tokens GROUP BY ALL),
sizes AS (SELECT doc_id, count(*) AS distinct_terms FROM counts GROUP BY doc_id),
total AS (SELECT count(*) AS total FROM sizes),
hits AS (SELECT * FROM counts WHERE token IN ('that', 'nicht', 'thin', 'por')),
freq AS (SELECT token, count(*) AS df FROM hits GROUP BY token)
SELECT doc_id, round(sum(h.n::DOUBLE / s.distinct_terms * log10(t.total::DOUBLE / f.df)), 6) AS score
FROM hits h JOIN sizes s USING (doc_id) JOIN freq f USING (token) CROSS JOIN total t
GROUP BY doc_id
ORDER BY sum(h.n::DOUBLE / s.distinct_terms * log10(t.total::DOUBLE / f.df)) DESC, doc_id LIMIT 20""",
    "search_hits_shown": f"""WITH {_DOCS} SELECT doc_id,
  '<i>' || source || '</i>' || 'chars: ' || n_chars || '<br />' AS shown FROM d
WHERE lang = 'en' AND list_contains(tokens, 'that') AND list_contains(tokens, 'thin')
ORDER BY n_chars DESC, doc_id LIMIT 15""",
}
