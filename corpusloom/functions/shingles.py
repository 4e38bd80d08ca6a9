"""Shingles of whole Arrow batches, counted as numbers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: tokens of a block; a longer document is a block of its own
BLOCK_TOKENS = 1 << 19


def shingle_counter(
    low: int, high: int, limit: int = BLOCK_TOKENS
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For ``mapInArrow`` over one column of token lists: ``term, documents, n`` of each block
    of lists, where ``documents`` is the number of lists with the shingle.

    The functions are nested so that workers need not import this package.
    """

    def blocks(lists: pa.ListArray) -> Iterator[pa.ListArray]:
        ends = np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < len(lists):
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield lists.slice(start, stop - start)
            start = stop

    def counted(lists: pa.ListArray) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
        sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        owner = np.repeat(np.arange(len(lists), dtype=np.int64), sizes)
        words = lists.flatten()
        encoded = words.dictionary_encode()
        token = encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        place, number = np.arange(len(token)), token
        for k in range(1, high + 1):
            if k > 1:  # the places whose shingle of k - 1 tokens goes on in the same list
                last = place + k - 1
                inside = last < len(token)
                place, number, last = place[inside], number[inside], last[inside]
                inside = owner[last] == owner[place]
                # the number of the head and that of the last token, both below the number of tokens
                place, number = place[inside], number[inside] * len(encoded.dictionary) + token[last[inside]]
            if not len(place):
                return
            order = np.argsort(number, kind="stable")  # equal shingles side by side, in the order of their lists
            held, of = number[order], owner[place[order]]
            new = np.ones(len(order), bool)
            new[1:] = held[1:] != held[:-1]
            start = np.flatnonzero(new)
            number = np.empty(len(order), np.int64)
            number[order] = np.cumsum(new) - 1
            if k < low:
                continue
            new[1:] |= of[1:] != of[:-1]
            parts = [words.take(pa.array(place[order[start]] + j)) for j in range(k)]
            yield (
                pc.binary_join_element_wise(*parts, " ") if k > 1 else parts[0],
                np.add.reduceat(new, start, dtype=np.int64),
                np.diff(np.append(start, len(order))),
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lists in blocks(batch.column(0)):
                for term, documents, n in counted(lists):
                    yield pa.RecordBatch.from_arrays([term, pa.array(documents), pa.array(n)], ["term", "documents", "n"])

    return run
