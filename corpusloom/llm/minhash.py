"""Near-duplicate documents by bottom-k sketches.

One hash function orders the shingles of a document; its ``k`` smallest hashes are its
sketch, a uniform sample of the set. Inverted lists of the retained values propose
pairs, the bottom-k of the united sketches estimates their similarity, and the full
sets decide.

Two sets whose similarity reaches the threshold share far more than half of their
sketches (for k = 64 and 0.8 the chance of sharing fewer is 2e-8), so a value
only has to be listed while it is among the rarest ``m - m/2 + 1`` of its sketch. Lists
are not expanded into all pairs:

1. documents with equal sets are one node;
2. every list compares its members with one hub, the member whose values are the
   commonest, which takes one pair per entry;
3. members of short lists that no common hub links yet are compared with each other;
4. members of long lists are sketched again without a size limit. Their lists hold the
   rarest values only, and there two members meet only if no hub links them and their
   sizes and the places of the shared value still allow the threshold.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import flat
from corpusloom.llm.components import components
from corpusloom.llm.staging import Staging, few, ship

K = 64
LONG_LIST = 48
SLACK = 5.0


def _sets(texts: list[str], words: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    for hashes in flat.words(texts):
        yield np.unique(flat.shingles(hashes, words).view(np.int64))


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.zeros(len(arrays) + 1, np.int32)
    np.cumsum([len(a) for a in arrays], out=offsets[1:])
    flat_values = np.concatenate(arrays) if arrays else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat_values, pa.int64()))


def _digest(values: np.ndarray, salt: int) -> int:
    mixed = flat.mix(values.view(np.uint64) ^ np.uint64(salt * 0x5851F42D4C957F2D))
    return int(mixed.sum(dtype=np.uint64).view(np.int64))


def sketch(docs: DataFrame, words: int = 5, k: int = K) -> DataFrame:
    """``doc_id``, the set's size ``n``, two digests ``d1 d2`` of the whole set, and the
    ``k`` smallest shingle hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for low, high, texts in flat.slices(batch.column(1)):
                sets = list(_sets(texts, words))
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(low, high - low),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([_digest(s, 1) for s in sets], pa.int64()),
                        pa.array([_digest(s, 2) for s in sets], pa.int64()),
                        _lists([s[:k] for s in sets]),
                    ],
                    ["doc_id", "n", "d1", "d2", "sketch"],
                )

    schema = "doc_id long, n long, d1 long, d2 long, sketch array<long>"
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def full_sets(docs: DataFrame, words: int = 5) -> DataFrame:
    """``rid`` and the whole set ``shingles`` of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for low, high, texts in flat.slices(batch.column(1)):
                sets = list(_sets(texts, words))
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(low, high - low), _lists(sets)], ["rid", "shingles"]
                )

    schema = "rid long, shingles array<long>"
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def _sizes_allow(percent: int, a: Column, b: Column) -> Column:
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def _estimate_allows(percent: int, k: int) -> Column:
    """The united sketch's estimate, with ``SLACK`` standard deviations of room."""
    union = F.array_sort(F.array_union("sketch_a", "sketch_b"))
    p = percent / 100
    shared = F.size(F.array_intersect(F.slice(union, 1, k), F.array_intersect("sketch_a", "sketch_b")))
    size = F.least(F.size(union), F.lit(k)).cast("double")
    return shared >= size * p - SLACK * F.sqrt(size * p * (1 - p))


def _with_both(pairs: DataFrame, table: DataFrame, value: str) -> DataFrame:
    """``pairs(a, b)`` with ``value`` of both ends."""
    for end in ("a", "b"):
        side = table.select(F.col("rid").alias(end), F.col(value).alias(f"{value}_{end}"))
        pairs = pairs.join(side, end)
    return pairs


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets reach the threshold."""
    both = _with_both(pairs, sets, "shingles")
    shared = F.size(F.array_intersect("shingles_a", "shingles_b"))
    union = F.size("shingles_a") + F.size("shingles_b") - shared
    return both.where(shared * 100 >= union * percent).select("a", "b")


def _of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    return docs.join(few(ids.withColumnRenamed("rid", "doc_id")), "doc_id", "left_semi")


def _pair_ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("rid")).distinct()


def _in_long_lists(
    docs: DataFrame, entries: DataFrame, percent: int, words: int, staging: Staging
) -> DataFrame:
    """Pairs ``(a, b)`` within long lists that no common hub links.

    The members' whole sets are listed by their rarest values, as many of them as a pair
    at the threshold cannot all miss. Values of a hub count as the commonest; only what a
    member has beside its hub's values is counted. A shared value at place i of one set
    and j of the other leaves an overlap of ``min(n_a - i, n_b - j)``; values that only
    one member has take the first places.
    """
    known = staging.keep(
        entries.groupBy("rid").agg(F.min("hint").alias("hint"), F.max_by("hub", F.struct("length", "hub")).alias("hub")),
        "long",
    )
    sets = staging.keep(full_sets(_of(docs, known.select("rid")), words), "long-sets")
    hubs = known.select(F.col("hub").alias("rid")).distinct()
    hub_sets = sets.join(hubs, "rid").groupBy("rid").agg(F.first("shingles").alias("hub_shingles"))
    hub_sets = staging.keep(hub_sets.withColumnRenamed("rid", "hub"), "hub-sets")
    common = staging.keep(hub_sets.select(F.explode("hub_shingles").alias("v")).distinct(), "hub-values")
    # what no hub has
    beside = sets.join(known, "rid").join(hub_sets, "hub")
    beside = staging.keep(
        beside.select("rid", "hint", "shingles", F.array_except("shingles", "hub_shingles").alias("own")), "beside"
    )
    rows = staging.keep(beside.select("rid", F.explode("own").alias("v")).join(common, "v", "left_anti"), "own")
    counts = staging.keep(rows.groupBy("v").agg(F.count("*").alias("df")), "long-counts")
    own = rows.join(counts, "v").groupBy("rid").agg(
        F.count_if(F.col("df") == 1).cast("int").alias("alone"),
        F.array_sort(F.collect_list(F.when(F.col("df") > 1, F.struct("df", "v")))).alias("shared"),
        F.collect_list("v").alias("all_own"),
    )
    none = F.array().cast("array<long>")
    ranked = beside.join(own, "rid", "left").select(
        "rid", "hint", F.size("shingles").alias("n"), F.coalesce("alone", F.lit(0)).alias("alone"),
        F.concat(
            F.coalesce(F.transform("shared", lambda x: x["v"]), none),
            F.array_sort(F.array_except("shingles", F.coalesce("all_own", none))),
        ).alias("values"),
    )
    room = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1 - F.col("alone")
    listed = (
        ranked.withColumn("room", room.cast("int")).where("room > 0")
        .select("rid", "hint", "n", "alone", F.posexplode(F.expr("slice(values, 1, room)")).alias("i", "v"))
        .select("rid", "hint", "n", (F.col("n") - F.col("alone") - F.col("i")).alias("left"), "v")
    )
    listed = staging.keep(listed, "long-lists")
    x, y = listed.alias("x"), listed.alias("y")
    sizes = F.col("x.n") + F.col("y.n")
    return x.join(
        y,
        (F.col("x.v") == F.col("y.v")) & (F.col("x.rid") < F.col("y.rid"))
        & (F.col("x.hint") != F.col("y.hint")) & _sizes_allow(percent, F.col("x.n"), F.col("y.n"))
        & (F.least("x.left", "y.left") * (100 + percent) >= sizes * percent),
    ).select(F.col("x.rid").alias("a"), F.col("y.rid").alias("b")).distinct()


def near_duplicates(
    docs: DataFrame, percent: int = 80, words: int = 5, k: int = K, long_list: int = LONG_LIST
) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs(doc_id, text)``.

    Documents are linked when ``100 * |A & B| >= percent * |A | B|`` on their sets of
    distinct shingles of ``words`` words; ``component_id`` is the smallest reachable
    doc_id and ``kept`` marks the document that bears it.

    Null and blank texts have an empty set and no links. A text is known by the smallest
    doc_id that has it, so texts for which that is the same document share a component.
    Rows without doc_id take the component of their text's other copies, else null, and
    are not kept. Other columns are ignored; an empty table gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ship(docs.sparkSession)
    staging = Staging(docs.sparkSession)
    sketches = staging.keep(sketch(docs, words, k), "sketches")
    key = ["n", "d1", "d2"]
    # aggregates are written before they are joined, so that both sides of the join are
    # plain shuffles, of which a hot key's part can be split
    named = staging.keep(sketches.where("n > 0").groupBy(key).agg(F.min("doc_id").alias("rid")), "named")
    members = staging.keep(
        sketches.select("doc_id", *key).join(named, key, "left"), "members"
    )
    reps = staging.keep(
        sketches.join(named.withColumnRenamed("rid", "doc_id"), [*key, "doc_id"], "left_semi")
        .withColumnRenamed("doc_id", "rid").select("rid", "n", "d1", "sketch"),
        "reps",
    )

    # inverted lists of the rarest shared values of each sketch
    entries = reps.select("rid", "n", "d1", F.size("sketch").alias("m"), F.explode("sketch").alias("v"))
    counts = staging.keep(entries.groupBy("v").agg(F.count("*").alias("df")).where("df > 1"), "counts")
    shared = entries.join(counts, "v").groupBy("rid", "n", "d1", "m").agg(
        F.array_sort(F.collect_list(F.struct("df", "v"))).alias("values")
    )
    room = F.size("values") - F.ceil(F.col("m") / 2) + 1
    weight = F.aggregate("values", F.lit(0).cast("long"), lambda s, x: s + x["df"]) / F.col("m")
    lists = staging.keep(
        shared.select("rid", "n", weight.alias("weight"), room.cast("int").alias("room"), "values")
        .where("room > 0")
        .select("rid", "n", "weight", F.explode(F.expr("slice(values, 1, room)")).alias("e"))
        .select("rid", "n", "weight", F.col("e.v").alias("v")),
        "lists",
    )

    # one hub for every list
    hubs = lists.groupBy("v").agg(
        F.max(F.struct("weight", (-F.col("rid")).alias("rid"), "n")).alias("hub"),
        F.count("*").alias("length"),
    ).where("length > 1")
    hubs = staging.keep(
        hubs.select("v", "length", (-F.col("hub.rid")).alias("hub"), F.col("hub.n").alias("hub_n")), "hubs"
    )
    by_hub = (
        lists.join(hubs, "v").where("rid <> hub").where(_sizes_allow(percent, F.col("n"), F.col("hub_n")))
        .select(F.col("hub").alias("a"), F.col("rid").alias("b")).distinct()
    )
    likely = staging.keep(
        _with_both(by_hub, reps, "sketch").where(_estimate_allows(percent, k)).select("a", "b"), "likely"
    )
    sets = staging.keep(full_sets(_of(docs, _pair_ends(likely)), words), "sets")
    linked = staging.keep(_confirm(likely, sets, percent), "linked")
    staging.drop(sets)

    # what the hubs leave open
    near = linked.union(linked.select("a", F.col("a").alias("b")))
    hint = staging.keep(near.groupBy(F.col("b").alias("rid")).agg(F.min("a").alias("hint")), "hints")
    open_lists = lists.join(hubs.select("v", "length", "hub"), "v").join(hint, "rid", "left")
    open_lists = staging.keep(
        open_lists.select("v", "rid", "n", "length", "hub", F.coalesce("hint", "rid").alias("hint")), "open"
    )
    short = open_lists.where(F.col("length") <= long_list)
    x, y = short.alias("x"), short.alias("y")
    pairs = x.join(
        y,
        (F.col("x.v") == F.col("y.v")) & (F.col("x.rid") < F.col("y.rid"))
        & (F.col("x.hint") != F.col("y.hint")) & _sizes_allow(percent, F.col("x.n"), F.col("y.n")),
    ).select(F.col("x.rid").alias("a"), F.col("y.rid").alias("b")).distinct()
    more = _with_both(pairs, reps, "sketch").where(_estimate_allows(percent, k)).select("a", "b")
    hot = open_lists.where(F.col("length") > long_list)
    more = staging.keep(
        more.union(_in_long_lists(docs, hot, percent, words, staging)).distinct(), "more"
    )
    sets = staging.keep(full_sets(_of(docs, _pair_ends(more)), words), "sets")
    links = linked.union(_confirm(more, sets, percent))

    found = components(links, staging)
    staging.only(members, found)
    component = F.when(F.col("n") > 0, F.coalesce("component", "rid")).otherwise(F.col("doc_id"))
    return members.join(found.withColumnRenamed("node", "rid"), "rid", "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"),
    )


def drop_near_duplicates(docs: DataFrame, percent: int = 80, words: int = 5) -> DataFrame:
    """The rows of ``docs`` without near copies: of each group of linked documents the
    one with the smallest doc_id stays, all columns unchanged.

    Rows that repeat a kept document (same doc_id) stay with it, and so do rows without
    doc_id unless a text of theirs belongs to another document.
    """
    found = near_duplicates(docs, percent, words)
    gone = Staging(docs.sparkSession).keep(
        found.where("doc_id is not null and not kept").select("doc_id").distinct(), "gone"
    )
    return docs.join(few(gone), "doc_id", "left_anti").select(docs.columns)
