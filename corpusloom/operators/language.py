"""Language detection from character trigrams, learned from labelled rows."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType
from pyspark.sql.window import Window

from corpusloom.functions import text as tx
from corpusloom.functions.rows import expand
from corpusloom.session import small_side, stage


def trigrams(text: Column) -> Column:
    """All trigrams of the whole text: lower-case letters, other runs one blank.

    Each match takes one character and looks ahead over three, so one linear pass
    yields every overlapping trigram; ``substring`` would scan from the start of
    the text for each of them.
    """
    return F.regexp_extract_all(_padded(text), F.lit("(?s)(?=(...))."), F.lit(1))


def _padded(text: Column) -> Column:
    letters = F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}]+", " "))
    return F.concat(F.lit(" "), letters, F.lit(" "))


#: bits of a character in a trigram's number, and trigrams that a task holds before it counts them
BITS = 21
HELD = 1 << 20


def _numbers(padded: str) -> np.ndarray:
    """The trigrams of one padded text, each as one number."""
    codes = np.frombuffer(padded.encode("utf-32-le"), np.uint32).astype(np.int64)
    return (codes[:-2] << 2 * BITS) | (codes[1:-1] << BITS) | codes[2:]


def _grams(numbers: np.ndarray) -> list[str]:
    mask = (1 << BITS) - 1
    codes = np.stack([numbers >> 2 * BITS, numbers >> BITS & mask, numbers & mask], axis=1)
    joined = codes.astype("<u4").tobytes().decode("utf-32-le")
    return [joined[i : i + 3] for i in range(0, len(joined), 3)]


def _number_of(gram: Column) -> Column:
    """The number of a trigram that is a string; null for other lengths."""
    first, second, third = (F.ascii(gram.substr(i, 1)).cast("bigint") for i in (1, 2, 3))
    number = F.shiftleft(first, 2 * BITS).bitwiseOR(F.shiftleft(second, BITS)).bitwiseOR(third)
    return F.when(F.length(gram) == 3, number)


def language_profiles(
    docs: DataFrame, text: str = "text", lang: str = "lang", size: int | None = None
) -> DataFrame:
    """``(lang, gram, n, total)``: the trigrams of each language, all of them or the
    ``size`` commonest; ``total`` is the sum of the kept counts.

    The trigrams of a batch of texts are counted as numbers, so a language gives a row per
    distinct one and about ``HELD`` of them.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[np.ndarray]] = {}

        def told(code: str) -> pa.RecordBatch:
            numbers, n = np.unique(np.concatenate(held.pop(code)), return_counts=True)
            columns = [pa.array([code] * len(n), pa.string()), pa.array(_grams(numbers), pa.string()), pa.array(n, pa.int64())]
            return pa.RecordBatch.from_arrays(columns, names=["lang", "gram", "n"])

        sizes: dict[str, int] = {}
        for batch in batches:
            for code, padded in zip(batch["lang"].to_pylist(), batch["padded"].to_pylist()):
                numbers = _numbers(padded)
                held.setdefault(code, []).append(numbers)
                sizes[code] = sizes.get(code, 0) + len(numbers)
                if sizes[code] >= HELD:
                    sizes[code] = 0
                    yield told(code)
        for code in list(held):
            yield told(code)

    labelled = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    rows = labelled.select(F.col(lang).alias("lang"), _padded(F.col(text)).alias("padded"))
    counted = rows.mapInArrow(count, "lang string, gram string, n bigint")
    summed = counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    if size is not None:
        best = Window.partitionBy("lang").orderBy(F.desc("n"), F.asc("gram"))
        summed = summed.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= size)
    # distinct trigrams only, of which an alphabet allows so many
    return summed.select("lang", "gram", "n", F.sum("n").over(Window.partitionBy("lang")).alias("total"))


def _counted(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``(doc_id, number, n)``: the distinct trigrams of each text; a text without any has
    one row of nulls."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows, numbers, counts, held = batch.column(0), [], [], [], 0

            def told() -> pa.RecordBatch:
                found, n = np.concatenate(numbers), np.concatenate(counts)
                none = n == 0
                columns = [ids.take(pa.array(np.concatenate(rows))), pa.array(found, pa.int64(), mask=none), pa.array(n, pa.int64(), mask=none)]
                return pa.RecordBatch.from_arrays(columns, names=["doc_id", "number", "n"])

            for row, padded in enumerate(batch.column(1).to_pylist()):
                found, n = np.unique(_numbers(padded), return_counts=True)
                if not len(found):
                    found, n = np.zeros(1, np.int64), np.zeros(1, np.int64)
                rows.append(np.full(len(found), row))
                numbers.append(found)
                counts.append(n)
                held += len(found)
                if held >= HELD // 8:
                    yield told()
                    rows, numbers, counts, held = [], [], [], 0
            if held:
                yield told()

    rows = docs.where(F.col(text).isNotNull()).select(F.col(doc_id).alias("doc_id"), _padded(F.col(text)).alias("padded"))
    kind = StructType([rows.schema["doc_id"], StructField("number", LongType()), StructField("n", LongType())])
    return rows.mapInArrow(count, kind)


def detect_language(
    docs: DataFrame,
    profiles: DataFrame,
    languages: Sequence[str],
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """``(doc_id, detected, score)``; score is the mean log weight per trigram.

    A trigram of language L weighs ``ln((n + 1) / (total + 1))``, an unlisted one
    ``ln(1 / (total + 1))``. The common part is a factor of the document's trigram
    count, so only listed trigrams have to be joined. A text's trigrams are counted as
    numbers first; the profiles are written when this is called and broadcast where their
    size allows. Equal scores go
    to the first language code; documents without letters get null.
    """
    codes = sorted(languages)
    # written once: learning is not done again for the floors, and its true size decides the join
    profiles = stage(profiles, "profiles")
    wide = profiles.groupBy("gram").agg(
        *[
            F.max(F.when(F.col("lang") == code, F.log(F.col("n") + 1))).alias(f"w_{i}")
            for i, code in enumerate(codes)
        ]
    )
    floors = profiles.groupBy().agg(
        F.struct(
            *[
                F.max(F.when(F.col("lang") == code, -F.log(F.col("total") + 1))).alias(f"f_{i}")
                for i, code in enumerate(codes)
            ]
        )
    ).scalar()
    wide = wide.select(_number_of(F.col("gram")).alias("number"), *[c for c in wide.columns if c != "gram"])
    sums = (
        _counted(docs, doc_id, text).join(small_side(wide), "number", "left")
        .groupBy("doc_id")
        .agg(
            F.sum("n").alias("grams"),
            *[F.sum(F.col("n") * F.col(f"w_{i}")).alias(f"s_{i}") for i in range(len(codes))],
        )
        .withColumn("floors", floors)
    )
    choices = F.array(
        *[
            F.struct(
                (
                    -(
                        F.try_divide(F.coalesce(F.col(f"s_{i}"), F.lit(0.0)), F.col("grams"))
                        + F.col(f"floors.f_{i}")
                    )
                ).alias("loss"),
                F.lit(code).alias("lang"),
            )
            for i, code in enumerate(codes)
        ]
    )
    best = F.array_min(F.filter(choices, lambda ch: ch["loss"].isNotNull()))
    return sums.select("doc_id", best.alias("best")).select(
        "doc_id", F.col("best.lang").alias("detected"), (-F.col("best.loss")).alias("score")
    )


BUCKETS = 1 << 16
# multipliers of a trigram's first two characters; with them two-character suffixes below U+0100 stay apart
FIRST, SECOND = 40503, 257


def _buckets(padded: str) -> np.ndarray:
    """The trigrams of one padded text as numbers below ``BUCKETS``."""
    codes = np.frombuffer(padded.encode("utf-32-le"), np.uint32).astype(np.int64)
    return (codes[:-2] * FIRST + codes[1:-1] * SECOND + codes[2:]) % BUCKETS


def hashed_profiles(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """``(lang, bucket, n, total)`` of labelled documents; at most ``BUCKETS`` rows a language.

    A batch of texts is counted in one array per language before anything is shuffled.
    Rows without a text or a label are left out, texts without letters add nothing.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: dict[str, np.ndarray] = {}
            for code, padded in zip(batch["lang"].to_pylist(), batch["padded"].to_pylist()):
                found = counts.setdefault(code, np.zeros(BUCKETS, np.int64))
                found += np.bincount(_buckets(padded), minlength=BUCKETS)
            for code, found in counts.items():
                places = np.flatnonzero(found)
                columns = [pa.array([code] * len(places), pa.string()), pa.array(places.astype(np.int32)), pa.array(found[places])]
                yield pa.RecordBatch.from_arrays(columns, names=["lang", "bucket", "n"])

    labelled = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    rows = labelled.select(F.col(lang).alias("lang"), _padded(F.col(text)).alias("padded"))
    summed = rows.mapInArrow(count, "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    # one row a bucket, so a language's window holds BUCKETS rows at most
    return summed.withColumn("total", F.sum("n").over(Window.partitionBy("lang")))


def detect_in_row(
    docs: DataFrame,
    profiles: DataFrame,
    languages: Sequence[str],
    doc_id: str = "doc_id",
    text: str = "text",
    keep: Sequence[str] = (),
) -> DataFrame:
    """``(doc_id, detected, score)`` and ``keep`` by a linear model: hashed trigrams times a weight per language.

    ``profiles`` come from :func:`hashed_profiles` and are read when this is called. The weights are
    those of :func:`detect_language`, with trigrams told apart by their bucket only, and the score is
    their mean. They are ``BUCKETS`` numbers for each asked language, whatever the corpus, so a
    document is neither exploded nor joined nor shuffled. Equal scores go to the first language code;
    null texts are left out, and documents without letters and languages without a profile get null.
    """
    asked = profiles.where(F.col("lang").isin(list(languages))).select("lang", "bucket", "n", "total").toPandas()
    codes = sorted(asked["lang"].unique())
    weights = np.zeros((len(codes), BUCKETS))
    for row, code in zip(weights, codes):
        known = asked[asked["lang"] == code]
        row[known["bucket"]] = known["n"]
        row[:] = np.log((row + 1) / (known["total"].iloc[0] + 1))

    def means(padded: str) -> np.ndarray | None:
        buckets = _buckets(padded)
        return weights[:, buckets].mean(axis=1) if len(buckets) else None

    @F.pandas_udf("array<double>")
    def scores(padded: pd.Series) -> pd.Series:
        return padded.map(means)

    rows = docs.where(F.col(text).isNotNull()).select(
        F.col(doc_id).alias("doc_id"), *keep, scores(_padded(F.col(text))).alias("_scores")
    )
    choices = [F.struct((-F.get("_scores", F.lit(i))).alias("loss"), F.lit(code).alias("lang")) for i, code in enumerate(codes)]
    none = F.lit(None).cast("struct<loss: double, lang: string>")
    best = F.array_min(F.filter(F.array(*choices, none), lambda choice: choice["loss"].isNotNull()))
    return rows.withColumn("_best", best).select(
        "doc_id", F.col("_best.lang").alias("detected"), (-F.col("_best.loss")).alias("score"), *keep
    )
