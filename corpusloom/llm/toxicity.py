"""Toxicity by two Kneser-Ney language models, one per class.

Each class has discounted counts of word pairs, words and word beginnings (of the latter
two, how many different pairs they end); a level that
has not seen an expression hands its discounted mass to the next one, and the last level
is one distribution for both classes: how many different neighbours a word beginning
follows anywhere in the corpus. An expression that is rare in both classes therefore
costs them nearly the same.

A text's score compares the two log-likelihoods per word, over the whole text and over
its most suspicious words (single ones and neighbours), and maps them to a probability by a
logistic function. That function is fitted on training texts of one half, read by models
of the other half, so that no text is judged by its own counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import flat
from corpusloom.llm.staging import Staging, few, lowest, ship, unused

DISCOUNT = 2.5
WINDOWS = (1, 4)
THRESHOLD = 0.7
STEM_CHARS = 4
STEMS = 1 << 16
#: labelled rows the class models are fitted on at most; all other counts cover all rows
MOST_LABELLED = 20_000
#: words after a context that its pairs must outweigh; pairs are too rare in the smaller
#: class to speak before they are many
PAIR_PRIOR = 50_000.0


def expressions(texts: list[str], whole: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The words of texts as three flat arrays, and the number of words of each text:
    hashes of the word with its predecessor, of the word, and the number of its stem (with
    ``whole`` the stem's full hash).
    Words are runs of letters and digits, lower-cased; the first one follows a mark."""
    cp = flat.points(" ".join(texts) + " ")
    folded = flat.folded()[cp]
    inside = folded > 0
    before = np.empty_like(inside)
    before[0], before[1:] = False, inside[:-1]
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(before & ~inside)
    values = flat.codes()[folded]
    word = flat.span_hashes(values, starts, ends)
    stem = flat.span_hashes(values, starts, np.minimum(ends, starts + STEM_CHARS))
    stops = np.searchsorted(starts, np.cumsum([len(t) + 1 for t in texts]))
    previous = np.empty_like(word)
    previous[1:] = word[:-1]
    counts = np.diff(stops, prepend=0)
    previous[(stops - counts)[counts > 0]] = 0
    pair = flat.mix(previous * flat.MULTIPLIER + word)
    return pair, word, stem if whole else _numbers(stem), counts


def _numbers(stem: np.ndarray) -> np.ndarray:
    return (stem % np.uint64(STEMS)).astype(np.int64)


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The different pairs of a stem and the stem before it, of a few texts each."""
    import pandas as pd

    for batch in batches:
        for _, _, texts in flat.slices(batch.column(0)):
            _, _, stem, counts = expressions(texts, whole=True)
            before = np.roll(stem, 1)
            stops = np.cumsum(counts)
            before[(stops - counts)[counts > 0]] = 0
            both = pd.DataFrame({"stem": _numbers(stem), "before": before.view(np.int64)}).drop_duplicates()
            yield pa.RecordBatch.from_pandas(both, preserve_index=False)


def neighbour_counts(docs: DataFrame) -> DataFrame:
    """``(stem, sides)``: how many different stems each stem follows in all of ``docs``."""
    pairs = docs.select("text").mapInArrow(_neighbours, "stem long, before long").distinct()
    return pairs.groupBy("stem").agg(F.count("*").alias("sides"))


def _class_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct pairs of each text with their words, stem, half and class."""
    import pandas as pd

    names = ["pair", "word", "previous", "stem", "half", "toxic", "n"]
    for batch in batches:
        half, toxic = (np.array(batch.column(i).to_pylist(), np.int32) for i in (1, 2))
        for low, high, texts in flat.slices(batch.column(0)):
            pair, word, stem, counts = expressions(texts)
            previous = np.roll(word, 1)
            stops = np.cumsum(counts)
            previous[(stops - counts)[counts > 0]] = 0
            text = np.repeat(np.arange(low, high), counts)
            table = pd.DataFrame(
                {"pair": pair.view(np.int64), "word": word.view(np.int64), "previous": previous.view(np.int64),
                 "stem": stem, "text": text}
            ).drop_duplicates(["pair", "text"])
            table["half"], table["toxic"] = half[table["text"]], toxic[table["text"]]
            table = table.groupby(["pair", "half", "toxic"], sort=False).agg(
                word=("word", "first"), previous=("previous", "first"), stem=("stem", "first"), n=("text", "size")
            ).reset_index()
            yield pa.RecordBatch.from_pandas(table[names], preserve_index=False)


CELLS = ("n00", "n01", "n10", "n11")


def class_counts(labelled: DataFrame, staging: Staging) -> DataFrame:
    """Counts of expressions in ``labelled(text, half, toxic)``, a column for each half
    (0, 1) and class (0, 1). A pair counts the texts that have it; a word and a stem count
    the different pairs they end, so that copied passages do not add up."""
    schema = "pair long, word long, previous long, stem long, half int, toxic int, n long"
    rows = labelled.select("text", "half", "toxic").mapInArrow(_class_pairs, schema)
    cells = [
        F.sum(F.when((F.col("half") == int(c[1])) & (F.col("toxic") == int(c[2])), F.col("n")).otherwise(0)).alias(c)
        for c in CELLS
    ]
    pairs = staging.keep(
        rows.groupBy("pair").agg(
            F.min("word").alias("word"), F.min("previous").alias("previous"), F.min("stem").alias("stem"), *cells
        ),
        "pairs",
    )
    kinds = [F.sum((F.col(c) > 0).cast("long")).alias(c) for c in CELLS]
    levels = [
        pairs.select(F.lit(0).alias("level"), F.col("pair").alias("key"), F.col("previous").alias("context"), *CELLS),
        pairs.groupBy("word").agg(F.min("stem").alias("stem"), *kinds)
        .select(F.lit(1).alias("level"), F.col("word").alias("key"), F.col("stem").alias("context"), *CELLS),
        pairs.groupBy("stem").agg(*kinds)
        .select(F.lit(2).alias("level"), F.col("stem").alias("key"), F.lit(0).cast("long").alias("context"), *CELLS),
    ]
    # the discount leaves nothing of a smaller count
    told = "level = 2 or n00 + n10 > {d} or n01 + n11 > {d}".format(d=DISCOUNT)
    small = [F.col(c).cast("int").alias(c) for c in CELLS]
    return levels[0].union(levels[1]).union(levels[2]).where(told).select("level", "key", "context", *small)


class Level:
    """Sorted keys with the discounted counts of one level for one or two halves."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        order = np.argsort(keys, kind="stable")
        self.keys, self.counts = keys[order], counts[order].astype(np.float64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The row of each key, -1 where it is unknown."""
        if not len(self.keys):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, at, -1)


class Models:
    """The two class models over the counts of the chosen halves."""

    def __init__(self, counts: dict[str, np.ndarray], sides: dict[str, np.ndarray], halves: tuple[int, ...]):
        by_class = np.stack(
            [sum(counts[f"n{h}{c}"].astype(np.float64) for h in halves) for c in (0, 1)], axis=1
        )
        level, keys, context = counts["level"], counts["key"], counts["context"]
        shared = np.ones(STEMS)
        shared[sides["stem"]] += sides["sides"]
        shared /= shared.sum()
        # word beginnings
        at = level == 2
        total = max(1.0, by_class[at].sum())
        share, handed = self._discounted(by_class[at], total)
        stem = handed * np.repeat(shared[:, None], 2, axis=1)
        stem[keys[at]] += share
        # words: what is discounted, or left out as single, goes to the beginnings
        at = level == 1
        self.word = Level(keys[at], by_class[at])
        of = context[at][np.argsort(keys[at], kind="stable")]
        kinds = np.bincount(of, minlength=STEMS) + 1.0
        self.word_p, handed = self._discounted(self.word.counts, total)
        self.below_word = handed * stem / kinds[:, None]
        # pairs: given the word before
        at = level == 0
        self.pair = Level(keys[at], by_class[at])
        before = self.word.find(context[at][np.argsort(keys[at], kind="stable")])
        kept = self.pair.counts - np.minimum(self.pair.counts, DISCOUNT)
        sums = np.zeros((len(self.word.keys) + 1, 2))
        np.add.at(sums, before, kept)
        sums[-1] = 0
        follow = np.zeros(len(sums))
        follow[:-1] = self.word.counts.sum(axis=1)
        trust = np.clip(sums.sum(axis=1) / np.maximum(follow, 1), 0, 0.98)
        trust[-1] = 0
        weight = trust[:, None] / (sums + PAIR_PRIOR)
        self.pair_p = kept * weight[before]
        self.below_pair = weight * PAIR_PRIOR + 1 - trust[:, None]

    @staticmethod
    def _discounted(counts: np.ndarray, total: float) -> tuple[np.ndarray, float]:
        """Per class the share of each expression after the discount, and the mass handed
        to the level below, which is the same for both classes: their sizes differ, and
        an expression new to both must not speak for the smaller one."""
        kept = counts - np.minimum(counts, DISCOUNT)
        handed = max(0.02, 1 - kept.sum() / total)
        sums = np.maximum(kept.sum(axis=0), 1e-9)
        return (1 - handed) * kept / sums, handed

    def log_ratio(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Toxic against ordinary log-probability of every word, and words per text."""
        pair, word, stem, counts = expressions(texts)
        at = self.word.find(word.view(np.int64))
        p = self.below_word[stem]
        seen = at >= 0
        p[seen] += self.word_p[at[seen]]
        before = np.roll(at, 1)
        stops = np.cumsum(counts)
        before[(stops - counts)[counts > 0]] = -1
        p *= self.below_pair[before]
        at = self.pair.find(pair.view(np.int64))
        seen = at >= 0
        p[seen] += self.pair_p[at[seen]]
        ratio = np.log(p[:, 1]) - np.log(p[:, 0])
        return ratio, counts

    def features(self, column: pa.Array) -> np.ndarray:
        """Per text the mean ratio of its words and, for each of ``WINDOWS``, the highest
        mean over that many neighbours (a shorter text counts as filled up with zeros);
        zeros without words."""
        found = []
        for _, _, texts in flat.slices(column):
            ratio, counts = self.log_ratio(texts)
            sums = np.concatenate([[0.0], np.cumsum(ratio)])
            stop = 0
            for n in counts.tolist():
                start, stop = stop, stop + n
                row = [(sums[stop] - sums[start]) / max(n, 1)]
                for size in WINDOWS:
                    if n > size:
                        best = (sums[start + size : stop + 1] - sums[start : stop + 1 - size]).max()
                    else:
                        best = sums[stop] - sums[start]
                    row.append(best / size)
                found.append(row)
        return np.array(found).reshape(-1, 1 + len(WINDOWS))


def fit_logistic(x: np.ndarray, y: np.ndarray, rounds: int = 30) -> np.ndarray:
    """Weights and bias of a lightly regularised logistic regression (Newton steps)."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (p - y) + 1e-2 * w
        bend = (x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(x.shape[1])
        step = np.linalg.solve(bend, slope)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def training_rows(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> DataFrame:
    """``doc_id, text, toxic, half`` of labelled documents outside the held-out third, at
    most ``most`` documents (those with the lowest hash of the id)."""
    marked = labels.select(F.col("doc_id").cast("long"), F.col("toxic").cast("int")).where(
        "doc_id is not null and toxic in (0, 1) and crc32(cast(cast(doc_id as string) as binary)) % 3 <> 1"
    )
    marked = marked.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = lowest(marked, most, "doc_id")
    half = (F.xxhash64(F.lit("half"), "doc_id") % 2 != 0).cast("int").alias("half")
    return docs.select("doc_id", "text").join(few(chosen), "doc_id").select("doc_id", "text", "toxic", half)


def _arrays(df: DataFrame) -> dict[str, np.ndarray]:
    """The columns of a bounded table."""
    return {name: column.to_numpy() for name, column in zip(df.columns, df.toArrow().columns)}


def fit(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> dict:
    """The counts, neighbour counts and logistic weights of a classifier."""
    ship(docs.sparkSession)
    staging = Staging(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    labelled = staging.keep(training_rows(docs, labels, most), "labelled")
    counts = _arrays(class_counts(labelled, staging))
    sides = _arrays(neighbour_counts(docs))
    send = docs.sparkSession.sparkContext.broadcast((counts, sides))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        others = [Models(*send.value, (1,)), Models(*send.value, (0,))]
        for batch in batches:
            both = [m.features(batch.column(0)) for m in others]
            half = np.array(batch.column(1).to_pylist(), bool)
            x = np.where(half[:, None], both[1], both[0])
            yield pa.RecordBatch.from_arrays([*(pa.array(c) for c in x.T), batch.column(2)], [*parts, "toxic"])

    parts = [f"x{i}" for i in range(1 + len(WINDOWS))]
    schema = ", ".join(f"{p} double" for p in parts) + ", toxic int"
    seen = _arrays(labelled.select("text", "half", "toxic").mapInArrow(judge, schema))
    send.unpersist()
    staging.only()
    weights = fit_logistic(np.column_stack([seen[p] for p in parts]), seen["toxic"].astype(np.float64))
    return {"counts": counts, "sides": sides, "weights": weights}


def score(docs: DataFrame, model: dict, name: str = "toxicity") -> DataFrame:
    """``docs`` with a column ``name`` from 0 to 1; a column of that name is replaced.

    Null, empty and wordless texts get the score of a text that says nothing either way.
    Repeated rows and rows without doc_id are scored like all others; an empty table gives
    no rows.
    """
    spark = docs.sparkSession
    ship(spark)
    send = spark.sparkContext.broadcast(model)

    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        held = Models(send.value["counts"], send.value["sides"], (0, 1))
        weights = send.value["weights"]
        for column in texts:
            x = held.features(column)
            z = np.column_stack([x, np.ones(len(x))]) @ weights
            yield pa.array(1 / (1 + np.exp(-np.clip(z, -700, 700))), pa.float64())

    judge = F.arrow_udf(run, "double")
    return docs.withColumn(name, judge("text"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, all columns unchanged."""
    name = unused(docs, "_toxicity")
    scored = score(docs, fit(docs, labels), name)
    return scored.where(F.col(name) < threshold).select(docs.columns)
