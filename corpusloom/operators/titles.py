"""Text spans with fonts and positions, their statistics and title candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.functions import html as h

# How an HTML page is laid out as spans: size in points by element, and the
# number of paragraphs on one printed page.
FONT_SIZES = {"h1": 24.0, "h2": 18.0, "h3": 14.0, "p": 10.0, "li": 9.0}
OTHER_SIZE = 8.0
BOLD_STEP = 2.0
PARAGRAPHS_PER_PAGE = 20
PAGE_HEIGHT = 800.0

START, INSIDE = "\u0001", "\u0002"


def spans_from_html(pages: DataFrame, doc_id: str = "page_id", html: str = "html") -> DataFrame:
    """Spans of HTML pages: ``doc_id, page, paragraph, pos, text, font_name,
    font_size, y, page_height``.

    Block elements are paragraphs, and so is text before the first of them; the text
    runs between inline tags are spans.
    """
    inside = F.regexp_replace(F.col(html), r"(?is)^.*?</head>", "")
    visible = F.regexp_replace(inside, h.INVISIBLE, " ")
    marked = F.regexp_replace(visible, h.BLOCK, f"{START}$1{INSIDE}")
    lead = F.regexp_replace(F.substring_index(marked, START, 1), h.TAG, " ")
    # text before the first element becomes an element of its own
    marked = F.when(lead.rlike(r"\S"), F.concat(F.lit(f"{START}lead{INSIDE}"), marked)).otherwise(marked)
    blocks = pages.select(
        F.col(doc_id).alias("doc_id"), F.posexplode_outer(F.split(marked, START)).alias("paragraph", "block")
    ).where(F.col("paragraph") > 0)
    run = rf"(?s)(?:{INSIDE}|<(/?[A-Za-z0-9]+)[^>]*>)([^<]*)"
    blocks = blocks.select(
        "doc_id",
        (F.col("paragraph") - 1).alias("paragraph"),
        F.lower(F.substring_index("block", INSIDE, 1)).alias("element"),
        F.regexp_extract_all("block", F.lit(run), F.lit(1)).alias("tags"),
        F.regexp_extract_all("block", F.lit(run), F.lit(2)).alias("texts"),
    )
    size = F.when(F.lit(False), F.lit(0.0))
    for element, points in FONT_SIZES.items():
        size = size.when(F.col("element") == element, F.lit(points))
    size = size.otherwise(F.lit(OTHER_SIZE))
    bold = F.lower(F.col("tag")) == "b"
    return (
        blocks.select(
            "doc_id", "paragraph", "element", F.posexplode_outer(F.arrays_zip("tags", "texts")).alias("pos", "run")
        )
        .select("doc_id", "paragraph", "element", "pos", F.col("run.tags").alias("tag"), F.col("run.texts").alias("text"))
        .where(F.col("text") != "")
        .select(
            "doc_id",
            (F.floor(F.col("paragraph") / PARAGRAPHS_PER_PAGE) + 1).cast("int").alias("page"),
            "paragraph",
            "pos",
            h.decode(F.col("text")).alias("text"),
            F.when(bold | F.col("element").isin("h1", "h2", "h3"), F.lit("ABCDEF+Serif-Bold"))
            .otherwise(F.lit("Serif"))
            .alias("font_name"),
            (size + F.when(bold, F.lit(BOLD_STEP)).otherwise(F.lit(0.0))).alias("font_size"),
            ((F.col("paragraph") % PARAGRAPHS_PER_PAGE) * (PAGE_HEIGHT / PARAGRAPHS_PER_PAGE)).alias("y"),
            F.lit(PAGE_HEIGHT).alias("page_height"),
        )
    )


def is_bold(font_name: Column) -> Column:
    """Embedded fonts carry a prefix up to ``+``, which does not count."""
    return F.contains(F.lower(F.regexp_replace(font_name, r"^[^+]*\+", "")), F.lit("bold"))


def glyphs(text: Column) -> Column:
    """Characters that are not blank."""
    return F.length(F.regexp_replace(text, r"\s", ""))


def page_count(spans: DataFrame) -> DataFrame:
    return spans.groupBy("doc_id").agg(F.max("page").alias("pages"))


def median_font(spans: DataFrame) -> DataFrame:
    """``(doc_id, pages, median_font)`` over all non-blank characters.

    One-page documents use page 1, longer ones pages 2 to 10. The two middle
    values of an even count are averaged. Sizes are weighted by their number of
    characters, and the two cases are one aggregation, so a long document is
    folded to its few distinct sizes before anything is shuffled.
    """
    weight = glyphs(F.col("text"))
    usable = weight > 0

    def median(condition: Column) -> Column:
        size = F.when(usable & condition, F.col("font_size"))
        return F.percentile(size, 0.5, F.when(usable, weight).otherwise(F.lit(1)))

    found = spans.groupBy("doc_id").agg(
        F.max("page").alias("pages"),
        median(F.col("page") == 1).alias("first"),
        median(F.col("page").between(2, 10)).alias("later"),
    )
    return found.select(
        "doc_id", "pages", F.when(F.col("pages") == 1, F.col("first")).otherwise(F.col("later")).alias("median_font")
    )


def paragraph_stats(spans: DataFrame, *more: Column) -> DataFrame:
    """Per paragraph: largest font, whether half of it is bold, position of its
    first span and length of its text, and ``more`` aggregates."""
    weight = glyphs(F.col("text"))
    bold = F.sum(F.when(is_bold(F.col("font_name")), weight).otherwise(0))
    return spans.groupBy("doc_id", "page", "paragraph").agg(
        F.max(F.when(weight > 0, F.col("font_size"))).alias("max_size"),
        F.coalesce(F.try_divide(bold, F.sum(weight)) >= 0.5, F.lit(False)).alias("bold"),
        F.min_by("y", "pos").alias("y"),
        F.max("page_height").alias("page_height"),
        F.sum(F.length("text")).alias("length"),
        *more,
    )


def title_candidates(spans: DataFrame, n: int = 3, min_length: int = 5) -> DataFrame:
    """``(doc_id, titles)``: of the first page's paragraphs longer than
    ``min_length`` the ``n`` with the largest font, nearest to the middle first.

    A page's paragraphs are put together where they are measured, so the spans are cut
    once, and what is ranked is one page of each document. Rows without doc_id are left out.
    """
    first = spans.where((F.col("page") == 1) & F.col("doc_id").isNotNull())
    by_size = Window.partitionBy("doc_id").orderBy(F.desc("max_size"), F.asc("paragraph"))
    pieces = F.sort_array(F.collect_list(F.struct("pos", "text")))
    whole = F.array_join(F.transform(pieces, lambda p: p["text"]), "").alias("text")
    largest = (
        paragraph_stats(first, whole)
        .where(F.col("length") > min_length)
        .withColumn("rank", F.row_number().over(by_size))
        .where(F.col("rank") <= n)
        .select("doc_id", F.abs(F.col("page_height") / 2 - F.col("y")).alias("distance"), "rank", "text")
    )
    ordered = F.sort_array(F.collect_list(F.struct("distance", "rank", "text")))
    return largest.groupBy("doc_id").agg(F.transform(ordered, lambda t: t["text"]).alias("titles"))
