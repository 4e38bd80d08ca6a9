"""Encoding and decoding with a sentencepiece BPE model, by vectorised merge rounds.

The symbols of all distinct words of a block lie in one flat array. Every round finds the
pair of lowest rank in each word, merges its leftmost place in all words at once, closes
the gaps and looks up only the pairs next to a merge; words without a pair leave. Words
of more than ``LONG`` symbols take the same merges from a heap, so their cost stays near
linear.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import flat
from corpusloom.llm.piece_model import NONE, PieceModel, Words, gather, model_of, read_vocabulary
from corpusloom.llm.staging import ship

LONG = 96
BLOCK_CHARS = 1 << 20


def _pairs(model: PieceModel, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The piece that each pair makes and its rank, ``NONE`` where there is none."""
    made = model.pair_table.find(left.astype(np.int64) * model.size + right)
    return made, np.where(made == NONE, NONE, model.rank[np.where(made == NONE, 0, made)])


def merge_sequence(model: PieceModel, symbols: list[int]) -> list[int]:
    """The merges of one word in order of rank and place, from a heap of pairs."""
    n = len(symbols)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    pairs, rank, size = model.pairs, model.rank, model.size
    heap = []

    def offer(i: int) -> None:
        j = after[i]
        if j < n and (made := pairs.get(symbols[i] * size + symbols[j])) is not None:
            heapq.heappush(heap, (int(rank[made]), i, symbols[i], j, symbols[j], made))

    for i in range(n - 1):
        offer(i)
    while heap:
        _, i, left, j, right, made = heapq.heappop(heap)
        if symbols[i] != left or after[i] != j or symbols[j] != right:
            continue
        symbols[i], symbols[j], after[i] = made, -1, after[j]
        if after[j] < n:
            before[after[j]] = i
        after[j] = -1
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    return [s for s in symbols if s >= 0]


def merge_words(model: PieceModel, words: Words) -> tuple[np.ndarray, np.ndarray]:
    """The pieces of the distinct words, one word after another, and how many each has."""
    sizes = words.lengths.astype(np.int64)
    base = np.cumsum(sizes) - sizes
    out, out_size = words.symbols.copy(), sizes.copy()
    for w in np.flatnonzero(sizes > LONG):
        done = merge_sequence(model, out[base[w] : base[w] + sizes[w]].tolist())
        out[base[w] : base[w] + len(done)], out_size[w] = done, len(done)
    active = np.flatnonzero((sizes > 1) & (sizes <= LONG))
    length = sizes[active]
    symbols = out[gather(base[active], length)]
    made = rank = None
    while len(active):
        starts = np.cumsum(length) - length
        if rank is None:
            made, rank = np.full((2, len(symbols)), NONE, np.int32)
            inner = np.ones(len(symbols), bool)
            inner[starts + length - 1] = False
            at = np.flatnonzero(inner)
            made[at], rank[at] = _pairs(model, symbols[at], symbols[at + 1])
        least = np.minimum.reduceat(rank, starts)
        done = least == NONE
        if done.any():
            where = gather(starts[done], length[done])
            out[gather(base[active[done]], length[done])] = symbols[where]
            out_size[active[done]] = length[done]
            stay = np.repeat(~done, length)
            symbols, made, rank = symbols[stay], made[stay], rank[stay]
            active, length, least = active[~done], length[~done], least[~done]
            if not len(active):
                break
            starts = np.cumsum(length) - length
        owner = np.repeat(np.arange(len(active)), length)
        lowest = np.flatnonzero(rank == least[owner])
        first = np.ones(len(lowest), bool)
        first[1:] = owner[lowest[1:]] != owner[lowest[:-1]]
        at = lowest[first]
        symbols[at] = made[at]
        stay = np.ones(len(symbols), bool)
        stay[at + 1] = False
        symbols, made, rank = symbols[stay], made[stay], rank[stay]
        at -= np.arange(len(at))
        length = length - 1
        starts = np.cumsum(length) - length
        has_left, has_right = at > starts, at + 1 < starts + length
        made[at], rank[at] = NONE, NONE
        for place in (at[has_left] - 1, at[has_right]):
            made[place], rank[place] = _pairs(model, symbols[place], symbols[place + 1])
    pieces = out[gather(base, out_size)]
    return pieces, out_size


def _with_bytes(model: PieceModel, words: Words, pieces, sizes) -> tuple[np.ndarray, np.ndarray]:
    """Characters outside the vocabulary, which are words of their own, become bytes."""
    start = np.cumsum(sizes) - sizes
    odd = np.flatnonzero(pieces[start] < 0) if len(pieces) else np.empty(0, np.int64)
    if not len(odd):
        return pieces, sizes
    extra = [model.byte_pieces(int(words.points[w])) for w in odd]
    all_pieces = np.concatenate([pieces, *extra])
    sizes, start = sizes.copy(), start.copy()
    sizes[odd] = [len(e) for e in extra]
    start[odd] = len(pieces) + np.cumsum(sizes[odd]) - sizes[odd]
    return all_pieces[gather(start, sizes)], sizes


def encode_texts(model: PieceModel, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The ids of a block of texts, one text after another, and how many each has."""
    words = Words(texts, model)
    pieces, sizes = _with_bytes(model, words, *merge_words(model, words))
    starts = np.cumsum(sizes) - sizes
    each = sizes[words.occurs]
    total = np.concatenate([[0], np.cumsum(each)])[words.stops]
    return pieces[gather(starts[words.occurs], each)], np.diff(total, prepend=0)


def _pack(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A column of strings or binaries from one buffer; ``offsets`` in bytes."""
    buffers = [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(values)]
    return pa.Array.from_buffers(kind, len(offsets) - 1, buffers)


def decode_ids(model: PieceModel, ids: np.ndarray) -> bytes:
    """The text of a sequence of ids, without the blank that encoding puts before it."""
    size = model.surface_size[ids]
    text = model.surface[gather(model.surface_start[ids], size)].tobytes()
    shown = np.flatnonzero((ids != model.begin) & (ids != model.end))
    if len(shown) and text[:1] == b" " and model.pieces[ids[shown[0]]][:1] == "▁":
        text = text[1:]
    return text


def _decoded(model: PieceModel, ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """The texts of sequences of ids that lie in one array."""
    texts = [
        decode_ids(model, ids[a:b].astype(np.int64)).decode("utf-8", "replace")
        for a, b in zip(offsets[:-1], offsets[1:])
    ]
    return pa.array(texts, pa.string())


def encode(
    docs: DataFrame, model_path: str, begin: bool = True, end: bool = True, decoded: bool = False
) -> DataFrame:
    """``doc_id`` and ``ids``, the pieces of each whole text as little-endian unsigned
    32-bit integers, with the begin and end ids; with ``decoded`` also the text that
    :func:`decode` makes of these ids, in the same pass.

    Null texts are empty: only begin and end. Every row gives a row, also repeated ones
    and such without doc_id. Other columns are ignored; an empty table gives no rows.
    """
    ship(docs.sparkSession)
    vocabulary = docs.sparkSession.sparkContext.broadcast(read_vocabulary(model_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of(vocabulary.value)
        for batch in batches:
            for low, high, texts in flat.slices(batch.column(1), BLOCK_CHARS):
                ids, counts = encode_texts(model, texts)
                offsets = np.concatenate([[0], np.cumsum(counts + begin + end)])
                framed = np.empty(offsets[-1], "<u4")
                framed[gather(offsets[:-1] + begin, counts)] = ids
                if begin:
                    framed[offsets[:-1]] = model.begin
                if end:
                    framed[offsets[1:] - 1] = model.end
                columns = [batch.column(0).slice(low, high - low), _pack(framed, offsets * 4, pa.binary())]
                if decoded:
                    columns.append(_decoded(model, framed, offsets))
                yield pa.RecordBatch.from_arrays(columns, names)

    names = ["doc_id", "ids", "decoded"][: 2 + decoded]
    schema = "doc_id long, ids binary" + ", decoded string" * decoded
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def decode(encoded: DataFrame, model_path: str) -> DataFrame:
    """``doc_id``, ``ids`` and ``decoded``, the text that the ids stand for.

    Bytes that are no UTF-8 become U+FFFD; null or empty ids give an empty text.
    """
    ship(encoded.sparkSession)
    vocabulary = encoded.sparkSession.sparkContext.broadcast(read_vocabulary(model_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of(vocabulary.value)
        for batch in batches:
            step = max(1, int(len(batch) * (4 << 20) / max(1, batch.nbytes)))
            for low in range(0, len(batch), step):
                part = batch.slice(low, step)
                held = [np.frombuffer(i or b"", "<u4") for i in part.column(1).to_pylist()]
                offsets = np.concatenate([[0], np.cumsum([len(h) for h in held])])
                texts = _decoded(model, np.concatenate(held), offsets)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), texts], names)

    names = ["doc_id", "ids", "decoded"]
    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids binary, decoded string")
