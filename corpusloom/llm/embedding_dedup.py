"""Near duplicates among embeddings by cross-polytope hashing.

A pseudo-random rotation (three rounds of random signs and a fast Hadamard transform) turns
a vector, and the nearest of the 2d vertices of the cross polytope, its largest coordinate
with its sign, is one hash. Two such hashes from two rotations make a bucket of one table.
Besides its own bucket a vector also enters the next best ones of the table (multiprobe),
where a second or third largest coordinate takes the place of the largest. Vectors that
share a bucket of any table are compared by their exact cosine.

Equal vectors are folded first. A bucket is worked on by tasks that hold at most two blocks
of it, so a crowded one becomes many tasks; only links per vector and the edges of a
spanning forest leave a task, never pairs. A pair that meets in several buckets counts in
the first of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.components import components
from corpusloom.llm.staging import Staging, few, ship

COSINE = 0.9
#: with these a pair at a cosine of 0.9 meets in no bucket with 2e-5 (64 dimensions)
TABLES = 8
PROBES = 4
POLYTOPES = 2
ROUNDS = 3
#: the largest coordinates that probes look at
REACH = 3
#: vectors of a crowded bucket's block
BLOCK = 1024
CODES = (1 << 31) - 1
#: numbers gathered at a time when small buckets are compared
GATHERED = 1 << 22


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Walsh-Hadamard transform of every row (a power of two long), length kept."""
    n, h = x.shape[1], 1
    while h < n:
        halves = x.reshape(len(x), n // (2 * h), 2, h)
        a, b = halves[:, :, 0], halves[:, :, 1]
        x = np.stack([a + b, a - b], axis=2).reshape(len(x), n)
        h *= 2
    return x / np.sqrt(n)


def signs(size: int, table: int, polytope: int) -> np.ndarray:
    """The random signs of one rotation, the same on every machine."""
    seed = np.random.SeedSequence([size, table, polytope])
    return np.random.Generator(np.random.Philox(seed)).integers(0, 2, (ROUNDS, size)) * 2.0 - 1


def buckets(units: np.ndarray, tables: int, probes: int) -> np.ndarray:
    """For every row its ``probes`` buckets in each table, the nearest one first."""
    rows, dim = units.shape
    size = 1 << max(1, int(np.ceil(np.log2(max(dim, 2)))))
    padded = np.zeros((rows, size))
    padded[:, :dim] = units
    reach = min(REACH, size)
    found = np.empty((rows, tables, probes), np.int32)
    for table in range(tables):
        code, cost = np.zeros((rows, 1), np.int64), np.zeros((rows, 1))
        for polytope in range(POLYTOPES):
            x = padded
            for flips in signs(size, table, polytope):
                x = hadamard(x * flips)
            large = np.abs(x)
            top = np.argsort(-large, axis=1, kind="stable")[:, :reach]
            height = np.take_along_axis(large, top, axis=1)
            vertex = 2 * top + (np.take_along_axis(x, top, axis=1) < 0)
            gap = (height[:, :1] - height) ** 2
            code = ((code * (2 * size))[:, :, None] + vertex[:, None, :]).reshape(rows, -1) % CODES
            cost = (cost[:, :, None] + gap[:, None, :]).reshape(rows, -1)
        best = np.argsort(cost, axis=1, kind="stable")[:, :probes]
        mine = np.take_along_axis(code, best, axis=1)
        # a space too small for so many different vertices repeats the nearest one
        found[:, table, : mine.shape[1]] = mine
        found[:, table, mine.shape[1] :] = mine[:, :1]
    return found


def unit_rows(column: pa.Array, dim: int) -> np.ndarray:
    """The rows of a list column as vectors of length 1, in double precision."""
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _hash(tables: int, probes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column(1).value_lengths().to_numpy(zero_copy_only=False)
            for dim in np.unique(sizes).tolist():
                place = np.flatnonzero(sizes == dim)
                for low in range(0, len(place), BLOCK):
                    part = batch.take(pa.array(place[low : low + BLOCK]))
                    codes = buckets(unit_rows(part.column(1), dim), tables, probes)
                    data = pa.array([c.astype("<i4").tobytes() for c in codes], pa.binary())
                    keyed = codes.astype(np.int64) + np.arange(tables)[None, :, None] * (1 << 32)
                    keys = pa.ListArray.from_arrays(
                        pa.array(np.arange(len(codes) + 1, dtype=np.int32) * tables * probes), pa.array(keyed.ravel())
                    )
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0), pa.array(np.full(len(codes), dim, np.int32)), data, keys],
                        ["cid", "dim", "codes", "keys"],
                    )

    return run


def _first_met(a: np.ndarray, b: np.ndarray, table: np.ndarray, code: np.ndarray) -> np.ndarray:
    """Whether each pair of code tables (pairs, tables, probes) has its first common bucket
    at ``code`` of ``table``."""
    left = np.arange(len(a))
    for earlier in range(int(table.max(initial=0))):
        asked = left[table[left] > earlier]
        met = (a[asked, earlier][:, :, None] == b[asked, earlier][:, None, :]).any(axis=(1, 2))
        left = np.setdiff1d(left, asked[met], assume_unique=True)
    mine, other = a[left, table[left]], b[left, table[left]]
    common = (mine[:, :, None] == other[:, None, :]).any(axis=2)
    smaller = (common & (mine < code[left][:, None])).any(axis=1)
    first = np.zeros(len(a), bool)
    first[left[~smaller]] = True
    return first


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of ``n`` nodes the smallest node it is linked with over any path."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        following = root.copy()
        np.minimum.at(following, root[a], low)
        np.minimum.at(following, root[b], low)
        np.minimum.at(following, a, low)
        np.minimum.at(following, b, low)
        following = following[following]
        if (following == root).all():
            return root
        root = following


class Group:
    """Rows of whole buckets (or pairs of blocks of one), sorted by bucket."""

    def __init__(self, batch: pa.RecordBatch, tables: int, probes: int):
        self.batch = batch
        number = {name: batch.column(name).to_numpy(zero_copy_only=False) for name in ("dim", "key", "i", "j", "mine")}
        self.cid, self.size = batch.column("cid").to_numpy(), batch.column("size").to_numpy()
        self.mine, self.i, self.j = number["mine"], number["i"], number["j"]
        self.table, self.code, self.dim = number["key"] >> 32, number["key"] & ((1 << 32) - 1), number["dim"]
        change = np.zeros(len(self.cid), bool)
        if len(change):
            change[0] = True
            for name in ("dim", "key", "i", "j"):
                change[1:] |= number[name][1:] != number[name][:-1]
        self.starts = np.flatnonzero(change)
        self.codes = np.frombuffer(b"".join(batch.column("codes").to_pylist()), "<i4").reshape(-1, tables, probes)

    def pairs(self, dim: int, units: np.ndarray, rows: np.ndarray, cosine: float):
        """Linked pairs of the rows of one dimension (places in this group, in order)."""
        ends = np.append(self.starts[1:], len(self.cid))
        group = np.searchsorted(self.starts, rows, side="right") - 1
        # a bucket in one block: every row meets all after it
        alone = self.i[rows] == self.j[rows]
        small = alone & ((ends - self.starts)[group] <= 64)
        asked = np.flatnonzero(small)
        count = ends[group[asked]] - rows[asked] - 1
        at = 0
        while at < len(asked):
            upto = at + max(1, int(np.searchsorted(np.cumsum(count[at:]), GATHERED // dim, side="right")))
            many = count[at:upto]
            a = np.repeat(asked[at:upto], many)
            b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(many) - many, many)
            hit = np.einsum("ij,ij->i", units[a], units[b]) >= cosine
            yield a[hit], b[hit]
            at = upto
        for g in np.unique(group[~small]).tolist():
            mine = np.flatnonzero(group == g)
            if alone[mine[0]]:
                left = right = mine
            else:
                place = self.mine[rows[mine]]
                left, right = mine[place == self.i[rows[mine[0]]]], mine[place == self.j[rows[mine[0]]]]
            for low in range(0, len(left), 256):
                part = left[low : low + 256]
                x, y = np.nonzero(units[part] @ units[right].T >= cosine)
                a, b = part[x], right[y]
                keep = a < b if alone[mine[0]] else np.ones(len(a), bool)
                yield a[keep], b[keep]

    def linked(self, cosine: float) -> pa.RecordBatch:
        """Links per row, ``(a, a, n)``, and the edges ``(a, b, 0)`` of a spanning forest."""
        links, edges = np.zeros(len(self.cid), np.int64), []
        for dim in np.unique(self.dim).tolist():
            rows = np.flatnonzero(self.dim == dim)
            units = unit_rows(self.batch.column("v").take(pa.array(rows)), dim)
            for a, b in self.pairs(dim, units, rows, cosine):
                for low in range(0, len(a), 1 << 16):
                    x, y = rows[a[low : low + (1 << 16)]], rows[b[low : low + (1 << 16)]]
                    first = _first_met(self.codes[x], self.codes[y], self.table[x], self.code[x])
                    x, y = x[first], y[first]
                    np.add.at(links, x, self.size[y])
                    np.add.at(links, y, self.size[x])
                    near = np.unique(np.concatenate([x, y]))
                    if len(near):
                        root = _forest(len(near), np.searchsorted(near, x), np.searchsorted(near, y))
                        other = np.flatnonzero(root != np.arange(len(near)))
                        edges.append(np.column_stack([near[other], near[root[other]]]))
        told = np.flatnonzero(links)
        ends = np.concatenate([*edges, np.zeros((0, 2), np.int64)]).astype(np.int64)
        if len(ends):
            root = _forest(len(self.cid), ends[:, 0], ends[:, 1])
            other = np.flatnonzero(root != np.arange(len(root)))
            ends = np.column_stack([other, root[other]])
        a, b = np.concatenate([told, ends[:, 0]]), np.concatenate([told, ends[:, 1]])
        n = np.concatenate([links[told], np.zeros(len(ends), np.int64)])
        return pa.RecordBatch.from_arrays([pa.array(self.cid[a]), pa.array(self.cid[b]), pa.array(n)], ["a", "b", "n"])


def _compare(tables: int, probes: int, cosine: float):
    """Walks a partition sorted by bucket, whole buckets at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        for batch in batches:
            starts = Group(batch, tables, probes).starts
            first = [batch.column(name)[0].as_py() for name in ("dim", "key", "i", "j")] if batch.num_rows else None
            if first is None:
                continue
            if waiting and [waiting[-1].column(name)[0].as_py() for name in ("dim", "key", "i", "j")] != first:
                yield Group(_joined(waiting), tables, probes).linked(cosine)
                waiting = []
            last = int(starts[-1])
            if last:
                yield Group(_joined([*waiting, batch.slice(0, last)]), tables, probes).linked(cosine)
                waiting = []
            waiting.append(batch.slice(last))
        if waiting:
            yield Group(_joined(waiting), tables, probes).linked(cosine)

    return run


def _joined(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return pa.Table.from_batches(batches).combine_chunks().to_batches()[0] if len(batches) > 1 else batches[0]


def near_duplicates(
    vectors: DataFrame, cosine: float = COSINE, tables: int = TABLES, probes: int = PROBES
) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row of ``vectors(vec_id, embedding)``.

    ``n_links`` counts the other rows found with a cosine of at least ``cosine`` (above 0),
    ``component_id`` is the smallest vec_id reachable by links, the row's own included, and
    ``kept`` marks rows with that id. No pair below ``cosine`` is linked; equal vectors
    always are, others when they share a bucket of one of the ``tables``.

    Vectors that are null, empty, all zero, or hold a null or non-finite component are
    linked with nothing, and so are vectors of different length. Rows that repeat a vec_id
    are vectors of their own, counted one by one. Rows without vec_id are linked and counted
    like others, never kept, and have no component when no row of theirs has an id. Other
    columns are ignored; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    ship(spark)
    staging = Staging(spark)
    kind = dict(vectors.dtypes)["embedding"]
    v = F.col("embedding") if kind == "array<float>" else F.col("embedding").cast("array<double>")
    good = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists(
        "v", lambda c: c != 0
    )
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
    valid = F.coalesce(good, F.lit(False))
    classes = rows.where(valid).groupBy("v").agg(F.min("vec_id").alias("rid"), F.count("*").alias("size"))
    classes = staging.keep(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")
    hashed = classes.select("cid", "v").mapInArrow(
        _hash(tables, probes), "cid long, dim int, codes binary, keys array<long>"
    )
    hashed = staging.keep(hashed, "hashed")
    keyed = hashed.select("cid", "dim", F.explode(F.array_distinct("keys")).alias("key"))
    crowded = keyed.groupBy("dim", "key").agg(F.count("*").alias("n")).where("n > 1")
    crowded = staging.keep(crowded.select("dim", "key", F.ceil(F.col("n") / BLOCK).cast("int").alias("n")), "crowded")
    met = keyed.join(few(crowded), ["dim", "key"]).withColumn("mine", F.pmod(F.xxhash64("cid"), "n").cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    met = met.select(
        "cid", "key", "mine", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j")
    )
    full = hashed.select("cid", "dim", "codes").join(classes.select("cid", "size", "v"), "cid")
    blocks = met.join(full, "cid").repartition("dim", "key", "i", "j").sortWithinPartitions("dim", "key", "i", "j")
    found = staging.keep(blocks.mapInArrow(_compare(tables, probes, cosine), "a long, b long, n long"), "found")
    counts = staging.keep(found.where("n > 0").groupBy("a").agg(F.sum("n").alias("n")), "counts")
    nodes = components(found.where("n = 0").select("a", "b"), staging)
    named = classes.join(nodes, classes["cid"] == nodes["node"]).select("cid", "rid", "component")
    least = staging.keep(named.groupBy("component").agg(F.min("rid").alias("least")), "least")
    named = named.join(least, "component").select("cid", "least")
    told = classes.join(counts, classes["cid"] == counts["a"], "left").join(named, "cid", "left")
    told = staging.keep(
        told.select(
            F.col("v").alias("of"),
            (F.coalesce("n", F.lit(0)) + F.col("size") - 1).cast("long").alias("links"),
            F.coalesce("least", "rid").alias("least"),
        ),
        "told",
    )
    joined = rows.where(valid).join(told, F.col("v") == F.col("of")).select("vec_id", "links", "least")
    lone = rows.where(~valid).select("vec_id", F.lit(0).cast("long").alias("links"), F.col("vec_id").alias("least"))
    every = joined.union(lone)
    result = every.select(
        "vec_id", F.col("links").alias("n_links"), F.col("least").alias("component_id"),
        F.coalesce(F.col("vec_id") == F.col("least"), F.lit(False)).alias("kept"),
    )
    result = staging.keep(result, "linked")
    staging.only(result)
    return result
