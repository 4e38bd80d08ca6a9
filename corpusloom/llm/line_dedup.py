"""Boilerplate lines: lines that many distinct sites have.

Each task folds the sites of a line into a HyperLogLog sketch and sketches merge in the
aggregation, so a line on every page costs one small row per task. Lines whose estimate
is clearly above or below the threshold are decided by it; the few in between get an
exact distinct count. All work is built-in column functions and joins; texts are never
shuffled while the table of hits is small enough to send to them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.staging import Staging, unused
from corpusloom.session import small_side

MIN_SITES = 10
LOG_BUCKETS = 10
#: the estimate decides outside this band; it is over seven standard errors wide
BAND = 0.25
BLANKS = " \t\r"


def _lines(text: str = "text") -> Column:
    return F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)


def _key(line: Column) -> Column:
    """A line without its margin, as a 64-bit hash; null for a blank line."""
    bare = F.btrim(line, F.lit(BLANKS))
    return F.when(bare != "", F.xxhash64(bare))


def occurrences(docs: DataFrame, site: str) -> DataFrame:
    """``doc_id, site, h`` for every line that is not blank."""
    rows = docs.select("doc_id", F.col(site).alias("site"), F.explode(_lines()).alias("line"))
    return rows.select("doc_id", "site", _key(F.col("line")).alias("h")).where("h is not null")


def boilerplate(docs: DataFrame, staging: Staging, site: str = "source", min_sites: int = MIN_SITES) -> DataFrame:
    """``h, first_doc`` of the lines on at least ``min_sites`` distinct sites."""
    seen = occurrences(docs, site)
    spread = seen.groupBy("h").agg(
        F.hll_sketch_estimate(F.hll_sketch_agg("site", LOG_BUCKETS)).alias("sites"),
        F.min("doc_id").alias("first_doc"),
    )
    spread = staging.keep(spread.where(F.col("sites") >= min_sites * (1 - BAND)), "spread")
    near = spread.where(F.col("sites") <= min_sites * (1 + BAND)).select("h")
    exact = seen.join(small_side(near), "h", "left_semi").select("h", "site").where("site is not null")
    enough = exact.distinct().groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") >= min_sites)
    far = spread.where(F.col("sites") > min_sites * (1 + BAND)).select("h")
    found = spread.join(far.union(enough.select("h")), "h").select("h", "first_doc")
    return staging.swap(spread, found, "boilerplate")


def remove_boilerplate(
    docs: DataFrame, site: str = "source", min_sites: int = MIN_SITES, count: str | None = None
) -> DataFrame:
    """``docs(doc_id, text, <site>, ...)`` with boilerplate lines taken out of ``text``.

    A line is known by its content without blanks, tabs and returns at its ends. If it
    stands on ``min_sites`` distinct sites or more, it stays in the document of the
    smallest doc_id that has it and goes from all others; remaining lines are unchanged
    and in order. ``count`` names an added column with the number of lines removed.

    Blank lines stay. A null text stays null, a null site counts for no site, and a row
    without doc_id is never the one that keeps a line. Repeated rows are treated alike.
    Other columns, whatever their names, pass through; an empty table gives no rows.
    """
    staging = Staging(docs.sparkSession)
    narrow = docs.select(F.col("doc_id").alias("doc_id"), F.col(site).alias("site"), "text")
    lines = boilerplate(narrow, staging, "site", min_sites)
    found = occurrences(narrow, "site").join(small_side(lines), "h")
    hits = found.where("not (doc_id <=> first_doc)").groupBy(F.col("doc_id").alias("_hit_doc")).agg(
        F.collect_set("h").alias("_hits")
    )
    hits = small_side(staging.swap(lines, hits, "hits"))
    marked = docs.join(hits, docs["doc_id"].eqNullSafe(hits["_hit_doc"]), "left")
    found = hits["_hits"]
    kept = F.filter(_lines(), lambda x: ~F.coalesce(F.array_contains(found, _key(x)), F.lit(False)))
    text = F.when(found.isNull(), docs["text"]).otherwise(F.array_join(kept, "\n"))
    if count is None:
        return marked.select(*[text.alias("text") if c == "text" else docs[c] for c in docs.columns])
    gone = F.when(found.isNull(), F.lit(0)).otherwise(F.size(_lines()) - F.size(kept))
    rest = [docs[c] for c in docs.columns if c not in ("text", count)]
    return marked.select(*rest, text.alias("text"), gone.cast("long").alias(count))


def drop_boilerplate(docs: DataFrame, site: str = "source", min_sites: int = MIN_SITES) -> DataFrame:
    """:func:`remove_boilerplate` for a pipeline: ``n_chars`` follows the text, and a
    document all of whose lines were removed goes (each line stays in its first one)."""
    gone = unused(docs, "_removed")
    clean = remove_boilerplate(docs, site, min_sites, gone)
    blank = F.btrim(F.coalesce("text", F.lit("")), F.lit(BLANKS + "\n")) == ""
    clean = clean.where(~((F.col(gone) > 0) & blank))
    length = F.when(F.col(gone) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return clean.withColumn("n_chars", length).select(docs.columns)
