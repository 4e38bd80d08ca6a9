"""Benchmark passages in documents, by SimHash fingerprints of item-sized windows.

1. Every item gives a few anchor words, as rare in the corpus as possible, that no
   passage of the wanted similarity can miss all at once, in whatever order its words
   stand. Where a document has an anchor, every window of the item's length that holds it
   is laid, unless too many kinds of the item's shingles are missing there to reach the
   similarity at all.
2. Windows and items get 64-bit SimHash fingerprints; a word weighs as many votes as
   there are shingles that hold it.
3. Fingerprints are cut into ``RADIUS + 1`` blocks. Two that differ in at most ``RADIUS``
   bits agree in a block, so an equality join on blocks finds them all.
4. Pairs within the radius are decided by the weighted Jaccard similarity of their
   shingles, a shingle weighing as often as it occurs.

Everything is built-in column functions and joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.staging import Staging, few
from corpusloom.session import small_side

SIMILARITY = 0.8
SHINGLE = 5
RADIUS = 15
BLOCKS = RADIUS + 1
BLOCK_BITS = 64 // BLOCKS


def _words(text: str = "text") -> Column:
    """Lower-case words between blanks, tabs and line ends."""
    return F.array_remove(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), "[\\x20\\x09-\\x0D]+", -1), "")


def _shingles(words: str) -> Column:
    """The runs of five words, in order; all words as one when there are fewer."""
    last = F.greatest(F.size(words) - SHINGLE + 1, F.lit(1))
    runs = F.transform(
        F.sequence(F.lit(1), last), lambda i: F.array_join(F.slice(words, i, SHINGLE), " ")
    )
    return F.when(F.size(words) > 0, runs).otherwise(F.array().cast("array<string>"))


def _over(at: Column, size: Column) -> Column:
    """How many shingles of ``size`` words hold the word at place ``at``."""
    shingles = F.greatest(size - SHINGLE + 1, F.lit(1))
    return F.least(at, shingles - 1) - F.greatest(at - (SHINGLE - 1), F.lit(0)) + 1


def _fingerprint(words: str) -> Column:
    """64 majority votes of the words' hashes, weighted by the shingles over each word."""
    hashed = F.transform(
        words, lambda w, i: F.struct(F.xxhash64(w).alias("h"), _over(i, F.size(words)).alias("n"))
    )
    votes = F.transform(
        F.sequence(F.lit(0), F.lit(63)),
        lambda b: F.aggregate(
            hashed, F.lit(0), lambda s, x: s + x["n"] * (F.getbit(x["h"], b) * 2 - 1).cast("int")
        ),
    )
    return F.aggregate(
        F.zip_with(votes, F.sequence(F.lit(0), F.lit(63)), lambda v, b: F.struct(v.alias("v"), b.alias("b"))),
        F.lit(0).cast("long"),
        lambda s, x: F.when(x["v"] > 0, s.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), x["b"]))).otherwise(s),
    )


def _blocks(fingerprint: str) -> Column:
    """The number and bits of each block."""
    mask = (1 << BLOCK_BITS) - 1
    return F.transform(
        F.sequence(F.lit(0), F.lit(BLOCKS - 1)),
        lambda i: i * (mask + 1)
        + F.call_function("shiftrightunsigned", F.col(fingerprint), i * BLOCK_BITS).bitwiseAND(F.lit(mask).cast("long")).cast("int"),
    )


def _hashed(words: str | Column, size: Column) -> Column:
    """Hashes of the shingles that an item of ``size`` words would share with ``words``."""
    words, run = F.col(words) if isinstance(words, str) else words, F.least(size, F.lit(SHINGLE))
    places = F.sequence(F.lit(1), F.size(words) - run + 1)
    return F.when(F.size(words) >= run, F.transform(places, lambda i: F.xxhash64(F.slice(words, i, run)))).otherwise(
        F.array().cast("array<bigint>")
    )


def _may_reach(words: Column, similarity: float) -> Column:
    """False where ``words`` lack so many of the item's shingles ``held`` that no window of
    them is similar enough: each kind that is missing is one occurrence at least, and at
    most ``1 - similarity`` of the item's occurrences may be missing."""
    size = F.col("size")
    missing = F.size("held") - F.size(F.array_intersect(_hashed(words, size), F.col("held")))
    return missing <= F.greatest(size - SHINGLE + 1, F.lit(1)) * (1 - similarity) + 1e-6


def anchors(items: DataFrame, docs: DataFrame, staging: Staging) -> DataFrame:
    """``word, size, item_id, print``: the anchors of each item.

    A passage reaches the similarity only if at most a fifth of the item's shingles is
    missing. Words at least five apart share no shingle, so a passage without any of them
    misses all shingles over them; the rarest words of the corpus are taken, in turn, until
    that is more than a fifth.
    """
    places = items.select("item_id", "print", "size", F.posexplode("words").alias("at", "word"))
    places = staging.keep(places, "places")
    vocabulary = few(staging.keep(places.select("word").distinct(), "vocabulary"))
    seen = docs.select(F.explode(_words()).alias("word")).join(vocabulary, "word")
    counts = seen.groupBy("word").agg(F.count("*").alias("n"))
    rated = places.join(counts, "word", "left").select(
        "item_id", "print", "size",
        F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word", "at", _over(F.col("at"), F.col("size")).alias("over")).alias("x"),
    )
    rated = rated.groupBy("item_id", "print", "size").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    need = F.floor(F.greatest(F.col("size") - SHINGLE + 1, F.lit(1)) / 5) + 1
    nothing = F.struct(F.lit(0).alias("sum"), F.slice("xs", 1, 0).alias("taken"))

    def take(acc: Column, x: Column) -> Column:
        near = F.exists(acc["taken"], lambda y: F.abs(y["at"] - x["at"]) < SHINGLE)
        more = F.struct((acc["sum"] + x["over"]).alias("sum"), F.concat(acc["taken"], F.array(x)).alias("taken"))
        return F.when((acc["sum"] >= need) | near, acc).otherwise(more)

    chosen = rated.withColumn("chosen", F.aggregate("xs", nothing, take))
    chosen = chosen.withColumn("x", F.explode(F.when(F.col("chosen.sum") >= need, F.col("chosen.taken")).otherwise(F.col("xs"))))
    return staging.keep(chosen.select("x.word", "size", "item_id", "print").distinct(), "anchors")


def contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``doc_id, item_id, similarity`` for each document with a window of an item's
    length whose weighted shingles are at least ``similarity`` (0.8 or more) like the
    item's; the highest similarity of all windows.

    Near the end of a document windows are shorter. Null and blank texts and items match
    nothing. Rows that repeat a doc_id or an item_id count as one, rows without doc_id as
    one document without id. Other columns are ignored; empty tables give no rows.
    """
    if similarity < SIMILARITY:
        raise ValueError("anchors are chosen for a similarity of 0.8 or more")
    staging = Staging(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    items = benchmark.select("item_id", _words().alias("words")).withColumn("size", F.size("words"))
    items = staging.keep(items.where("size > 0").distinct().withColumn("print", _fingerprint("words")), "items")

    # windows that hold an anchor at any place
    told = docs.select("doc_id", _words().alias("words"))
    told = told.select("doc_id", "words", F.posexplode("words").alias("here", "word"))
    met = told.join(few(anchors(items, docs, staging)), "word")
    first = F.greatest(F.col("here") - F.col("size") + 1, F.lit(0))
    met = met.select(
        "doc_id", "item_id", "print", "size", first.alias("first"), F.col("here").alias("last"),
        F.slice("words", first + 1, F.col("here") + F.col("size") - first).alias("around"),
    )
    held = F.array_distinct(_hashed("words", F.col("size"))).alias("held")
    met = met.join(small_side(items.select("item_id", "print", held)), ["item_id", "print"])
    met = met.where(_may_reach(F.col("around"), similarity))
    start = F.explode(F.sequence(F.lit(0), F.col("last") - F.col("first"))).alias("start")
    windows = met.select("doc_id", "size", "held", "around", start)
    windows = windows.select("doc_id", "size", "held", F.slice("around", F.col("start") + 1, F.col("size")).alias("words"))
    windows = windows.where(_may_reach(F.col("words"), similarity)).select("doc_id", "size", "words")
    windows = windows.where("size(words) > 0").distinct().withColumn("print", _fingerprint("words"))
    windows = staging.keep(windows.withColumn("window", F.expr("uuid()")), "windows")

    # all fingerprints within the radius share a block
    left = windows.select("doc_id", "window", "size", "print", F.explode(_blocks("print")).alias("block"))
    right = items.select("item_id", "size", F.col("print").alias("item_print"), F.explode(_blocks("print")).alias("block"))
    near = left.join(small_side(right), ["size", "block"]).where(
        F.bit_count(F.col("print").bitwiseXOR(F.col("item_print"))) <= RADIUS
    )
    near = staging.keep(near.select("doc_id", "window", "item_id", "item_print").distinct(), "near")

    # exact similarity
    def counted(table: DataFrame, key: list[str], name: str) -> DataFrame:
        rows = table.select(*key, F.explode(_shingles("words")).alias("shingle"))
        return rows.groupBy(*key, "shingle").agg(F.count("*").alias(name))

    def weight(table: DataFrame, key: list[str], name: str) -> DataFrame:
        return table.select(*key, F.greatest(F.size("words") - SHINGLE + 1, F.lit(1)).alias(name))

    texts = windows.select("window", "words").join(near.select("window").distinct(), "window", "left_semi")
    item = ["item_id", "item_print"]
    named = items.withColumnRenamed("print", "item_print")
    shared = (
        near.join(counted(texts, ["window"], "n"), "window")
        .join(small_side(counted(named, item, "m")), [*item, "shingle"])
        .groupBy("doc_id", "window", *item).agg(F.sum(F.least("n", "m")).alias("shared"))
        .join(weight(texts, ["window"], "all_n"), "window").join(small_side(weight(named, item, "all_m")), item)
    )
    found = shared.withColumn("similarity", F.col("shared") / (F.col("all_n") + F.col("all_m") - F.col("shared")))
    found = found.where(F.col("similarity") >= similarity)
    best = found.groupBy("doc_id", "item_id").agg(F.max("similarity").alias("similarity"))
    best = staging.keep(best, "contaminated")
    staging.only(best)
    return best


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` without documents that hold a benchmark passage, all columns
    unchanged; rows without doc_id stay."""
    found = contaminated(docs, benchmark, similarity).select("doc_id").where("doc_id is not null").distinct()
    gone = few(Staging(docs.sparkSession).keep(found, "contaminated"))
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)
