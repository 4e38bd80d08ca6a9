"""Queries over ``pages``: records, metadata, spans and titles."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.catalogue import common as c
from corpusloom.functions import display as d
from corpusloom.functions import html as h
from corpusloom.operators import records as rec
from corpusloom.operators import titles as tit
from corpusloom.functions.rows import expand


def _pages(spark, sf_dir):
    return c.table(spark, sf_dir, "pages", "page_id")


def _records(spark, sf_dir):
    return rec.page_records(_pages(spark, sf_dir), "url", "html", "page_id")


def _spans(spark, sf_dir):
    return tit.spans_from_html(_pages(spark, sf_dir))


def page_records(spark, sf_dir):
    return _records(spark, sf_dir).select(
        "page_id", "path", "file", "title", "body", "content_type", "lang",
        F.col("pages").cast("bigint").alias("pages"), "error",
    )


def page_metadata(spark, sf_dir):
    pairs = _records(spark, sf_dir).select("page_id", F.explode_outer("metadata").alias("name", "value"))
    return pairs.where(F.col("name").isNotNull())


def page_links(spark, sf_dir):
    links = _pages(spark, sf_dir).select("page_id", h.links(F.col("html")).alias("link"))
    return (
        expand(links, "link", "page_id")
        .groupBy("url", "text")
        .agg(F.count(F.lit(1)).alias("n"), F.min("page_id").alias("first_page"))
    )


def page_links_variants(spark, sf_dir):
    """The same links with other attributes, quotes, markup and entities."""
    html = F.regexp_replace("html", r'<a href="([^"]*)">', r"<a class='k' href='$1' id=x><b>")
    html = F.replace(html, F.lit("</a>"), F.lit("</b>&eacute;&#233;&#xE9;&unknown;</a>"))
    pages = _pages(spark, sf_dir).select("page_id", h.links(html).alias("link"))
    return expand(pages, "link", "page_id").groupBy("url", "text").agg(F.count(F.lit(1)).alias("n"))


def page_titles(spark, sf_dir):
    return rec.numbered_titles(tit.title_candidates(_spans(spark, sf_dir)))


def page_sections(spark, sf_dir):
    spans = tit.page_count(_spans(spark, sf_dir))
    sections = _pages(spark, sf_dir).select(
        F.col("page_id").alias("doc_id"), h.section_count(F.col("html")).cast("bigint").alias("sections")
    )
    return sections.join(spans, "doc_id", "left").select(
        "doc_id", "sections", F.col("pages").cast("bigint").alias("pages")
    )


def page_first_image(spark, sf_dir):
    # link targets of the test pages are words; as .png names they stand for images
    shown = _pages(spark, sf_dir).select(
        "page_id", "url", F.regexp_replace("html", r'href="/([^"]*)"', r'src="http://img.example.com/$1.png"').alias("html")
    )
    return shown.select("page_id", d.first_image("url", "html").alias("image"))


def file_urls(spark, sf_dir):
    paths = _pages(spark, sf_dir).select(
        "page_id", F.concat(F.lit("C:\\docs\\"), F.translate("url", "/", "\\")).alias("path")
    )
    return paths.select("page_id", d.file_url(F.col("path")).alias("url"))


def keep_going_errors(spark, sf_dir):
    broken = _records(spark, sf_dir).where(F.col("error").isNotNull())
    return broken.select("page_id", "file", "title", F.length("body").cast("bigint").alias("n_chars"), "error")


def extract_metrics(spark, sf_dir):
    return rec.run_metrics(_records(spark, sf_dir))


def span_stats(spark, sf_dir):
    return tit.paragraph_stats(_spans(spark, sf_dir)).select(
        "doc_id",
        F.col("page").cast("bigint").alias("page"),
        F.col("paragraph").cast("bigint").alias("paragraph"),
        "max_size", "bold", "y", "length",
    )


def title_candidates(spark, sf_dir):
    found = tit.title_candidates(_spans(spark, sf_dir))
    return found.select("doc_id", F.posexplode("titles").alias("rank", "title")).select(
        "doc_id", F.col("rank").cast("bigint").alias("rank"), "title"
    )


def median_font(spark, sf_dir):
    return tit.median_font(_spans(spark, sf_dir)).select(
        "doc_id", F.col("pages").cast("bigint").alias("pages"), "median_font"
    )


def suffix_fields(spark, sf_dir):
    records = _records(spark, sf_dir).select("path", "file", "title", "lang", "metadata")
    return rec.suffix_fields(records).withColumn(
        "metadata_fr", F.array_join(F.sort_array(F.map_keys("metadata_fr")), ",")
    )


def dotted_get(spark, sf_dir):
    records = _records(spark, sf_dir).select("page_id", "link", F.struct(F.struct("path", "lang").alias("meta")).alias("doc"))
    return records.select(
        "page_id",
        F.array_join(d.get_path(records, "link.url"), " ").alias("urls"),
        d.get_path(records, "doc.meta.lang").alias("lang"),
    )


TEMPLATE = [
    [{"pre": "<code>", "field": "path", "post": "</code>"}, {"pre": ": ", "field": "file"}],
    [{"pre": "<strong>", "field": "title", "post": "</strong>"}],
    [{"pre": "to ", "field": "link.text"}, {"pre": "in parts: ", "field": "pages", "post": ","}],
    [{"pre": "problem: ", "field": "error"}, {"field": "missing"}],
]


def display_lines(spark, sf_dir):
    records = _records(spark, sf_dir)
    return records.select("page_id", d.display_lines(records, TEMPLATE).alias("shown"))


QUERIES = {
    f.__name__: f
    for f in (
        page_records, page_metadata, page_links, page_links_variants, page_titles, page_sections, page_first_image,
        file_urls, keep_going_errors, extract_metrics, span_stats, title_candidates,
        median_font, suffix_fields, dotted_get, display_lines,
    )
}


def decode_sql(text: str) -> str:
    for entity, char in h.ENTITIES.items():
        text = f"replace({text}, {c.quoted(entity)}, {c.quoted(char)})"
    return text


_TITLE = decode_sql("trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1))")
_BARE = f"""regexp_replace(regexp_replace(regexp_replace(html, '(?is)^.*?</head>', ''),
  '(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->', ' ', 'g'), '(?s)<[^>]+>', ' ', 'g')"""
BODY = f"trim(regexp_replace({decode_sql(_BARE)}, '[ \\t\\r\\n]+', ' ', 'g'))"
_CHARSET = """nullif(regexp_extract(html, '(?i)<meta[^>]* charset="([^"]*)"', 1), '')"""
_LANG = """nullif(regexp_extract(html, '(?i)<html[^>]* lang="([^"]*)"', 1), '')"""
LINK = """'(?is)<a href="([^"]*)"[^>]*>([^<]*)</a>'"""

RECORDS = f"""records AS (
  SELECT page_id, url AS path, split_part(url, '/', -1) AS file, nullif({_TITLE}, '') AS title,
    {BODY} AS body, 'text/html' || coalesce('; charset=' || {_CHARSET}, '') AS content_type,
    {_LANG} AS lang, len(regexp_extract_all(html, '(?i)<article'))::BIGINT AS pages,
    {_CHARSET} AS charset,
    regexp_extract_all(html, {LINK}, 1) AS link_urls,
    [{decode_sql('t')} FOR t IN regexp_extract_all(html, {LINK}, 2)] AS link_texts,
    CASE WHEN html IS NULL THEN 'missing content'
         WHEN NOT contains(lower(html), '</html>') THEN 'unterminated document' END AS error
  FROM pages)"""

_SIZES = " ".join(f"WHEN element = '{e}' THEN {s}" for e, s in tit.FONT_SIZES.items())
SPANS = f"""marked AS (
  SELECT page_id AS doc_id, string_split(regexp_replace(
    regexp_replace(html, '(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->', ' ', 'g'),
    '(?i)<(h[1-6]|p|li|div|footer)(?: [^>]*)?>', chr(1) || '\\1' || chr(2), 'g'), chr(1)) AS blocks
  FROM pages),
blocks AS (
  SELECT doc_id, unnest(blocks) AS block, generate_subscripts(blocks, 1) - 2 AS paragraph FROM marked),
runs AS (
  SELECT doc_id, paragraph, lower(split_part(block, chr(2), 1)) AS element,
    regexp_extract_all(block, '(?s)(?:\\x02|<(/?[A-Za-z0-9]+)[^>]*>)([^<]*)', 1) AS tags,
    regexp_extract_all(block, '(?s)(?:\\x02|<(/?[A-Za-z0-9]+)[^>]*>)([^<]*)', 2) AS texts
  FROM blocks WHERE paragraph >= 0),
pieces AS (
  SELECT doc_id, paragraph, element, unnest(tags) AS tag, unnest(texts) AS raw,
    generate_subscripts(texts, 1) - 1 AS pos FROM runs),
spans AS (
  SELECT doc_id, (paragraph // {tit.PARAGRAPHS_PER_PAGE}) + 1 AS page, paragraph, pos, {decode_sql('raw')} AS text,
    (coalesce(lower(tag), '') = 'b' OR element IN ('h1', 'h2', 'h3')) AS is_bold,
    (CASE {_SIZES} ELSE {tit.OTHER_SIZE} END
      + CASE WHEN coalesce(lower(tag), '') = 'b' THEN {tit.BOLD_STEP} ELSE 0 END)::DOUBLE AS font_size,
    ((paragraph % {tit.PARAGRAPHS_PER_PAGE}) * {tit.PAGE_HEIGHT / tit.PARAGRAPHS_PER_PAGE})::DOUBLE AS y
  FROM pieces WHERE raw <> ''),
sized AS (SELECT *, length(regexp_replace(text, '\\s', '', 'g')) AS glyphs FROM spans)"""

TITLES = f"""{SPANS},
paragraphs AS (
  SELECT doc_id, page, paragraph, max(font_size) FILTER (WHERE glyphs > 0) AS max_size,
    arg_min(y, pos) AS y, sum(length(text)) AS length, string_agg(text, '' ORDER BY pos) AS text
  FROM sized WHERE page = 1 GROUP BY ALL),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY max_size DESC NULLS LAST, paragraph) AS r
  FROM paragraphs WHERE length > 5),
placed AS (
  SELECT doc_id, text, row_number() OVER (
    PARTITION BY doc_id ORDER BY abs({tit.PAGE_HEIGHT / 2} - y), r) - 1 AS rank
  FROM ranked WHERE r <= 3)"""

ORACLES = {
    "page_records": f"""WITH {RECORDS}
SELECT page_id, path, file, title, body, content_type, lang, pages, error FROM records""",
    "page_metadata": f"""WITH {RECORDS}
SELECT page_id, 'charset' AS name, charset AS value FROM records WHERE charset IS NOT NULL""",
    "page_links": f"""WITH {RECORDS},
l AS (SELECT page_id, unnest(link_urls) AS url, unnest(link_texts) AS text FROM records)
SELECT url, text, count(*) AS n, min(page_id) AS first_page FROM l GROUP BY url, text""",
    "page_links_variants": f"""WITH {RECORDS},
l AS (SELECT page_id, unnest(link_urls) AS url, unnest(link_texts) AS text FROM records)
SELECT url, text || 'ééé&unknown;' AS text, count(*) AS n FROM l GROUP BY ALL""",
    "page_titles": f"""WITH {TITLES}
SELECT doc_id, max(text) FILTER (WHERE rank = 0) AS parsed_title_0,
  max(text) FILTER (WHERE rank = 1) AS parsed_title_1, max(text) FILTER (WHERE rank = 2) AS parsed_title_2
FROM placed GROUP BY doc_id""",
    "page_sections": f"""WITH {SPANS},
n AS (SELECT doc_id, max(page)::BIGINT AS pages FROM spans GROUP BY doc_id)
SELECT p.page_id AS doc_id, len(regexp_extract_all(p.html, '(?i)<article'))::BIGINT AS sections, n.pages
FROM pages p LEFT JOIN n ON n.doc_id = p.page_id""",
    "page_first_image": """WITH shown AS (
  SELECT page_id, url, regexp_replace(html, 'href="/([^"]*)"', 'src="http://img.example.com/\\1.png"', 'g') AS html FROM pages)
SELECT page_id, nullif(regexp_extract(to_json({'url': url, 'html': html})::VARCHAR,
  '(http://\\S+?\\.(jpg|png|gif|jpeg))', 1), '') AS image FROM shown""",
    "file_urls": """SELECT page_id, 'file://' || replace('C:\\docs\\' || replace(url, '/', '\\'), '\\', '/') AS url FROM pages""",
    "keep_going_errors": f"""WITH {RECORDS}
SELECT page_id, file, title, length(body)::BIGINT AS n_chars, error FROM records WHERE error IS NOT NULL""",
    "extract_metrics": f"""WITH {RECORDS}
SELECT count(*) AS processed, count(error) AS errors FROM records""",
    "span_stats": f"""WITH {SPANS}
SELECT doc_id, page::BIGINT AS page, paragraph::BIGINT AS paragraph,
  max(font_size) FILTER (WHERE glyphs > 0) AS max_size,
  coalesce(sum(CASE WHEN is_bold THEN glyphs ELSE 0 END) / nullif(sum(glyphs), 0) >= 0.5, false) AS bold,
  arg_min(y, pos) AS y, sum(length(text))::BIGINT AS length
FROM sized GROUP BY ALL""",
    "title_candidates": f"""WITH {TITLES} SELECT doc_id, rank, text AS title FROM placed""",
    "median_font": f"""WITH {SPANS},
n AS (SELECT doc_id, max(page) AS pages FROM spans GROUP BY doc_id),
used AS (
  SELECT s.doc_id, s.font_size, unnest(range(s.glyphs)) AS glyph
  FROM sized s JOIN n USING (doc_id)
  WHERE CASE WHEN n.pages = 1 THEN s.page = 1 ELSE s.page BETWEEN 2 AND 10 END),
m AS (SELECT doc_id, quantile_cont(font_size, 0.5) AS median_font FROM used GROUP BY doc_id)
SELECT n.doc_id, n.pages::BIGINT AS pages, m.median_font FROM n LEFT JOIN m USING (doc_id)""",
    "suffix_fields": f"""WITH {RECORDS}
SELECT path AS path_fr, file AS file_fr, title AS title_fr, lang AS lang_fr,
  CASE WHEN charset IS NULL THEN '' ELSE 'charset_fr' END AS metadata_fr, path AS id FROM records""",
    "dotted_get": f"""WITH {RECORDS}
SELECT page_id, array_to_string(link_urls, ' ') AS urls, lang FROM records""",
    "display_lines": f"""WITH {RECORDS}
SELECT page_id,
  '<code>' || path || '</code>' || CASE WHEN file <> '' THEN ': ' || file ELSE '' END || '<br />'
  || CASE WHEN title IS NOT NULL THEN '<strong>' || title || '</strong><br />' ELSE '' END
  || CASE WHEN len(link_texts) > 0 OR pages > 0 THEN
       regexp_replace(regexp_replace(
         CASE WHEN len(link_texts) > 0 THEN 'to ' || array_to_string(link_texts, ', ') || ' ' ELSE '' END
         || CASE WHEN pages > 0 THEN 'in parts: ' || pages || ',' ELSE '' END, '\\s\\z', ''), ',\\z', '') || '<br />'
     ELSE '' END
  || CASE WHEN error IS NOT NULL THEN 'problem: ' || error || '<br />' ELSE '' END AS shown
FROM records""",
}
