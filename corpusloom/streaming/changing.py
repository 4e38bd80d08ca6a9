"""Running corpus statistics over documents that change.

A document's counts are remembered under its id, so a newer version takes the old
counts back before it adds its own.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from corpusloom.functions import text as tx
from corpusloom.operators.index import IndexTable
from corpusloom.streaming.flows import ROCKSDB, STATE_PROVIDER, each_batch, writer_of

HELD = "version bigint, terms array<string>, numbers array<bigint>"
CHANGES = "term string, documents bigint, count bigint"
OLDEST = -(2**63)


class RememberCounts(StatefulProcessor):
    """State per document: its version and counts. Output: what a newer version changes.

    Of one version seen with different counts the greater list of words stays, whichever
    came first, so the result does not depend on the order of arrival. Only the newest row
    of a micro-batch is held, however many an id has.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("held", HELD)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        version, terms, numbers = max((r.version, list(r.terms), list(r.numbers)) for r in rows)
        before: dict[str, int] = {}
        if self.held.exists():
            held = self.held.get()
            if (held[0], list(held[1]), list(held[2])) >= (version, terms, numbers):
                return
            before = dict(zip(held[1], held[2]))
        after = dict(zip(terms, numbers))
        self.held.update((version, terms, numbers))
        for term in before.keys() | after.keys():
            documents = (term in after) - (term in before)
            count = after.get(term, 0) - before.get(term, 0)
            if documents or count:
                yield Row(term=term, documents=documents, count=count)

    def close(self) -> None:
        pass


def count_changes(docs: DataFrame, version: str, doc_id: str = "doc_id", text: str = "text", lang: str | None = "lang") -> DataFrame:
    """``(term, documents, count)`` differences of a document stream, by ``version``.

    A null or empty text is a version without words: it takes back what was there. A null
    version is older than any other; a null id is an id like any other; a repeated or
    older version changes nothing.
    """
    language: Column | None = F.col(lang) if lang else None
    rule = tx.index_rule(language if language is not None else F.lit(None).cast("string"))
    entries = tx.term_counts(F.coalesce(F.col(text), F.lit("")), language, rule)
    counted = docs.select(
        F.col(doc_id).alias("doc_id"), F.coalesce(F.col(version).cast("bigint"), F.lit(OLDEST)).alias("version"), entries.alias("entries")
    )
    rows = counted.select(
        "doc_id",
        "version",
        F.col("entries.term").alias("terms"),
        F.transform("entries.n", lambda n: n.cast("bigint")).alias("numbers"),
    )
    return rows.groupBy("doc_id").transformWithState(RememberCounts(), CHANGES, "Append", "None")


def changing_stats(
    docs: DataFrame, version: str, table: IndexTable, checkpoint: str, timeout: int | None = None, **columns: str
) -> StreamingQuery:
    """Keep ``table`` (``term, documents, count``) at the statistics of every document's
    newest version.

    A micro-batch's differences are added up by term, met with the totals the table
    holds, and written as one commit. A repeated batch finds its number committed and
    adds nothing. Read the result with :func:`current_stats`.
    """
    docs.sparkSession.conf.set(STATE_PROVIDER, ROCKSDB)
    writer = writer_of(checkpoint)

    def add(batch: DataFrame, number: int) -> None:
        changes = batch.groupBy("term").agg(F.sum("documents").alias("_documents"), F.sum("count").alias("_count"))
        totals = changes.join(table.read(), "term", "left").select(
            "term",
            (F.coalesce("documents", F.lit(0)) + F.col("_documents")).alias("documents"),
            (F.coalesce("count", F.lit(0)) + F.col("_count")).alias("count"),
        )
        table.write(totals, number, writer=writer)

    return each_batch(count_changes(docs, version, **columns), add, checkpoint, "append", timeout)


def current_stats(table: IndexTable) -> DataFrame:
    """The words that some document still holds."""
    return table.read().where(F.col("documents") > 0)
