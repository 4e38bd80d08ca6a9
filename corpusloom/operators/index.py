"""Keyed document tables: full and partial updates, joins by position."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable
from dataclasses import dataclass
from datetime import datetime

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.session import work_path


def stamp(df: DataFrame, batch_time: datetime | str, column: str = "indexed_at") -> DataFrame:
    """One write time on every row of a batch; a parameter, so that a repeated
    run gives the same table."""
    return df.withColumn(column, F.lit(batch_time).cast("timestamp"))


def latest(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """One row per key: the one that is last by ``order``, one column after another.

    Rows that are equal in it are told apart by their content, so the choice does not
    depend on how they are read. The rank limit is applied in every task before the
    shuffle, so a key with very many versions arrives as one row per task.
    """
    content = F.xxhash64(*rows.columns)
    newest = Window.partitionBy(key).orderBy(*[F.col(c).desc() for c in order], content)
    return rows.withColumn("_rank", F.row_number().over(newest)).where(F.col("_rank") == 1).drop("_rank")


def upsert(index: DataFrame, rows: DataFrame, key: str, version: str | None = None) -> DataFrame:
    """The index after a full-document write: rows replace those of equal key.

    ``version`` orders several rows of one key within the batch; one row per key is
    written in any case. Columns missing on either side become null.
    """
    fresh = latest(rows, key, version) if version else latest(rows, key)
    untouched = index.join(fresh.select(key), key, "left_anti")
    return untouched.unionByName(fresh, allowMissingColumns=True)


def set_field(
    index: DataFrame, updates: DataFrame, key: str, field: str, insert: bool = True
) -> DataFrame:
    """Set one field on existing documents.

    With ``insert`` an update without a document becomes a document that holds
    only key and field. Keys are unique on both sides.
    """
    new = updates.select(key, F.col(field).alias("_new"))
    joined = index.join(new, key, "full_outer" if insert else "left")
    if field in index.columns:
        value = F.coalesce("_new", field)
    else:
        value = F.col("_new")
    return joined.withColumn(field, value).drop("_new")


def join_by_position(left: DataFrame, right: DataFrame, position: str = "position") -> DataFrame:
    """Rows of two tables that carry the same position number.

    Files have no inherent line order in Spark, so both sides bring the number.
    """
    return left.join(right, position, "inner")


BUCKET, GENERATION = "_bucket", "_gen"
OWN = {BUCKET, GENERATION, "_commit", "_row", "_field", "_value"}


@dataclass(frozen=True)
class Snapshot:
    """What a table's log says at one version: the base folder of each bucket, the
    commits not folded into it yet, and the batches each writer has committed."""

    version: int
    buckets: int
    base: dict[int, str]
    open: list[dict]
    seen: dict[str, list[list[int]]]

    def touched(self) -> list[int]:
        return sorted({b for commit in self.open for b in commit["buckets"]})


def _with_number(ranges: list[list[int]], number: int) -> list[list[int]]:
    """Closed ranges of whole numbers with one more; rising numbers stay one range."""
    merged: list[list[int]] = []
    for low, high in sorted([*ranges, [number, number]]):
        if merged and low <= merged[-1][1] + 1:
            merged[-1][1] = max(merged[-1][1], high)
        else:
            merged.append([low, high])
    return merged


class IndexTable:
    """A keyed parquet table: base files by hash of the key, and commits of changed rows.

    A write costs its own rows only. Its files become part of the table by one entry in
    the log, a numbered small file that is renamed into place, which fails where another
    writer took the number; it then takes the next one. Entries are in the order in which
    writes ended, and of a key the newest full row counts, then the fields set after it.
    A batch number that a writer has committed is not written again, so a repeated batch
    changes nothing, and writers never touch each other's rows.

    Reading merges only the buckets that open commits touch; all others are scanned
    as they are, without an exchange. After ``fold_after`` open commits, a write folds them
    into new base files of just these buckets. A null key is a key like any other. Choose
    ``buckets`` so that one bucket's rows suit one task; it is fixed when the table is
    made. The folder's file system has to refuse a rename onto an existing file, as HDFS does;
    a local disk looks first and then renames, which suits one machine's tests.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, schema: str, buckets: int = 16, fold_after: int = 8):
        self.spark, self.path, self.key, self.schema, self.fold_after = spark, path, key, schema, fold_after
        empty = spark.createDataFrame([], schema)
        self.columns, self.types = empty.columns, dict(empty.dtypes)
        if OWN & set(self.columns):
            raise ValueError(f"the table keeps these names for itself: {sorted(OWN)}")
        self.others = [c for c in self.columns if c != key]
        if not self._exists(0):
            self._claim(0, {"kind": "base", "buckets": buckets, "base": {}, "open": [], "seen": {}})

    # --- the log ---------------------------------------------------------------

    def _hadoop(self, path: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where, where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _log(self, version: int) -> str:
        return f"{self.path}/log/{version:012d}.json"

    def _exists(self, version: int) -> bool:
        where, files = self._hadoop(self._log(version))
        return files.exists(where)

    def _claim(self, version: int, entry: dict) -> bool:
        """Make ``entry`` the log's number ``version``; false if that number is taken."""
        jvm = self.spark._jvm
        target, _ = self._hadoop(self._log(version))
        draft, files = self._hadoop(f"{self.path}/drafts/{uuid.uuid4().hex}")
        out = files.create(draft, False)
        out.write(bytearray(json.dumps(entry).encode()))
        out.close()
        files.mkdirs(target.getParent())
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(
            files.makeQualified(draft).toUri(), self.spark.sparkContext._jsc.hadoopConfiguration()
        )
        options = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            context.rename(files.makeQualified(draft), files.makeQualified(target), options)
        except Py4JJavaError:
            files.delete(draft, False)
            if not self._exists(version):
                raise
            return False
        return True

    def _entry(self, version: int) -> dict:
        where, files = self._hadoop(self._log(version))
        stream = files.open(where)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def snapshot(self) -> Snapshot:
        """The table's newest version: the last base entry and what came after it."""
        where, files = self._hadoop(f"{self.path}/log/*.json")
        version = max(int(s.getPath().getName().split(".")[0]) for s in files.globStatus(where))
        later, number = [], version
        while (entry := self._entry(number))["kind"] != "base":
            later.append({**entry, "commit": number})
            number -= 1
        seen = entry["seen"]
        for commit in later:
            seen = self._also_seen(seen, commit)
        base = {int(b): generation for b, generation in entry["base"].items()}
        return Snapshot(version, entry["buckets"], base, entry["open"] + later[::-1], seen)

    @staticmethod
    def _name(kind: str, writer: str) -> str:
        return f"{kind}/{writer}"

    def _also_seen(self, seen: dict, commit: dict) -> dict:
        name = self._name(commit["kind"], commit["writer"])
        return {**seen, name: _with_number(seen.get(name, []), commit["batch"])}

    # --- writing ---------------------------------------------------------------

    def _write_buckets(self, kind: str, rows: DataFrame) -> tuple[str, list[int]]:
        """Rows with their bucket as files of a new generation, and the buckets they have."""
        generation = f"g{uuid.uuid4().hex}"
        folder = f"{self.path}/{kind}/{GENERATION}={generation}"
        rows.write.partitionBy(BUCKET).parquet(folder)
        where, files = self._hadoop(folder)
        names = [status.getPath().getName() for status in files.listStatus(where)]
        return generation, sorted(int(n.split("=")[1]) for n in names if n.startswith(f"{BUCKET}="))

    def _commit(self, kind: str, rows: DataFrame, batch: int, writer: str) -> None:
        def known(at: Snapshot) -> bool:
            return any(low <= batch <= high for low, high in at.seen.get(self._name(kind, writer), []))

        at = self.snapshot()
        if known(at):
            # computed all the same: a stream keeps its state up by running its batches
            rows.write.format("noop").mode("overwrite").save()
            return
        bucket = F.pmod(F.xxhash64(self.key), F.lit(at.buckets)).cast("int")
        generation, buckets = self._write_buckets(kind, rows.withColumn(BUCKET, bucket).repartition(BUCKET))
        entry = {"kind": kind, "writer": writer, "batch": batch, "generation": generation, "buckets": buckets}
        at = self.snapshot()
        while not known(at) and not self._claim(at.version + 1, entry):
            at = self.snapshot()
        if len(at.open) + 1 >= self.fold_after:
            self.fold()

    def write(self, rows: DataFrame, batch: int, order: str | None = None, writer: str = "main") -> None:
        """Full-document write of one batch; ``order`` ranks equal keys in it."""
        fresh = latest(rows, self.key, order) if order else latest(rows, self.key)
        self._commit("rows", fresh.select(*self.columns), batch, writer)

    def write_field(self, updates: DataFrame, field: str, batch: int, writer: str = "main") -> None:
        """Set one field of documents; only keys and values are written. An update
        without a document becomes a document of key and field."""
        value = F.to_json(F.struct(F.col(field).cast(self.types[field]).alias("v"))).alias("_value")
        delta = latest(updates.select(self.key, field), self.key)
        self._commit("fields", delta.select(self.key, F.lit(field).alias("_field"), value), batch, writer)

    # --- reading ---------------------------------------------------------------

    def _scan(self, kind: str, schema: str, folders: list[tuple[str, int]]) -> DataFrame:
        schema = f"{schema}, {GENERATION} string, {BUCKET} int"
        if not folders:
            return self.spark.createDataFrame([], schema)
        root = f"{self.path}/{kind}"
        paths = [f"{root}/{GENERATION}={generation}/{BUCKET}={bucket}" for generation, bucket in folders]
        return self.spark.read.schema(schema).option("basePath", root).parquet(*paths)

    def _base(self, at: Snapshot, buckets: Iterable[int]) -> DataFrame:
        return self._scan("base", self.schema, [(at.base[b], b) for b in buckets if b in at.base])

    def _changes(self, at: Snapshot, kind: str, schema: str) -> DataFrame:
        commits = [c for c in at.open if c["kind"] == kind]
        found = self._scan(kind, schema, [(c["generation"], b) for c in commits for b in c["buckets"]])
        pairs = [F.lit(v) for c in commits for v in (c["generation"], c["commit"])]
        numbers = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,int>")
        return found.withColumn("_commit", numbers[F.col(GENERATION)].cast("bigint"))

    def _merged(self, at: Snapshot, by_bucket: bool = False) -> DataFrame:
        """Current rows of the touched buckets, with the bucket: all versions of a key meet
        once. With ``by_bucket`` a bucket's rows stay together, ready to be written."""
        row = F.struct("_commit", *self.others).alias("_row")
        none = [F.lit(None).cast("string").alias(c) for c in ("_field", "_value")]
        base = self._base(at, at.touched()).withColumn("_commit", F.lit(-1).cast("bigint"))
        rows = base.unionByName(self._changes(at, "rows", self.schema)).select(self.key, BUCKET, "_commit", row, *none)
        fields = self._changes(at, "fields", f"`{self.key}` {self.types[self.key]}, _field string, _value string")
        blank = F.lit(None).cast(rows.schema["_row"].dataType).alias("_row")
        every = rows.unionByName(fields.select(self.key, BUCKET, "_commit", blank, "_field", "_value"))
        if by_bucket:
            every = every.repartition(BUCKET)
        setters = [
            F.max_by(F.struct("_commit", "_value"), F.when(F.col("_field") == c, F.col("_commit"))).alias(f"_set_{c}")
            for c in self.others
        ]
        newest = F.max_by("_row", F.when(F.col("_row").isNotNull(), F.col("_commit"))).alias("_row")
        found = every.groupBy(BUCKET, self.key).agg(newest, *setters)

        def value(name: str):
            if name == self.key:
                return F.col(name)
            held, whole = F.col(f"_set_{name}"), F.col("_row")
            later = held.isNotNull() & F.coalesce(held["_commit"] > whole["_commit"], F.lit(True))
            told = F.from_json(held["_value"], f"v {self.types[name]}")["v"]
            return F.when(later, told).otherwise(whole[name]).alias(name)

        return found.select(*[value(c) for c in self.columns], BUCKET)

    def read(self) -> DataFrame:
        """One row per key, whatever the writers and batches: the table as it is now."""
        at = self.snapshot()
        touched = set(at.touched())
        settled = self._base(at, [b for b in at.base if b not in touched]).select(*self.columns)
        if not touched:
            return settled
        merged = self._merged(at).select(*self.columns)
        return settled.unionByName(merged) if set(at.base) - touched else merged

    # --- folding ---------------------------------------------------------------

    def fold(self) -> bool:
        """Fold the open commits into new base files of the buckets they touch.

        Commits that end meanwhile stay open. False if there was nothing to fold, or if
        another fold was faster: the files of this one are then never referred to.
        """
        at = self.snapshot()
        if not at.touched():
            return False
        generation, buckets = self._write_buckets("base", self._merged(at, by_bucket=True))
        while (now := self.snapshot()).base == at.base:
            entry = {
                "kind": "base",
                "buckets": at.buckets,
                "base": {**at.base, **dict.fromkeys(buckets, generation)},
                "open": [c for c in now.open if c["commit"] > at.version],
                "seen": now.seen,
            }
            if self._claim(now.version + 1, entry):
                return True
        return False

    def compact(self, path: str | None = None) -> IndexTable:
        """Fold all open commits, here or as the base of a new table at ``path``."""
        table = self
        if path:
            table = IndexTable(self.spark, path, self.key, self.schema, self.snapshot().buckets, self.fold_after)
            table.write(self.read(), 0)
        table.fold()
        return table

    def clean(self) -> int:
        """Delete files of commits and bases that the newest version no longer needs; how many
        folders went. Only folders named in the log are looked at, so files of a writer
        that is still at work stay. Call it when no reader uses an older version."""
        at = self.snapshot()
        used = {*at.base.values(), *(c["generation"] for c in at.open)}
        gone = 0
        for version in range(at.version + 1):
            entry = self._entry(version)
            named = entry["base"].values() if entry["kind"] == "base" else [entry["generation"]]
            kind = entry["kind"]
            for generation in set(named) - used:
                where, files = self._hadoop(f"{self.path}/{kind}/{GENERATION}={generation}")
                gone += bool(files.delete(where, True))
        return gone


def new_index(spark: SparkSession, key: str, schema: str, label: str = "index") -> IndexTable:
    return IndexTable(spark, work_path(spark, label), key, schema)
