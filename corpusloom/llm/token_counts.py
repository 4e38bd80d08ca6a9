"""Token counts of a sentencepiece BPE model from a finite-state transducer.

Reading a word from left to right, the encoding of each prefix ends in one piece, and it
follows from the encodings of shorter prefixes: the piece that ends here and is stable
behind the last piece of the prefix it extends. A state therefore holds, for every place
from which a piece may still grow, the node of the vocabulary's trie, the last piece of
the encoding before that place and the number of tokens since. Reading a character leads
to one next state and emits the change of the count. States are compiled when they are
first reached.

A word starts in the start state, so the map of a chunk that begins with a word is a
constant: its count. Words of more than ``CHUNK`` characters are cut into chunks, whose
maps from entry state to exit state and count are tabulated for the states they are reached
in and composed through a parallel prefix scan. The counts of texts come from another
prefix sum over words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import flat
from corpusloom.llm.piece_model import PieceModel, Words, model_of, read_vocabulary, word_blocks
from corpusloom.llm.sentencepiece_codec import merge_sequence
from corpusloom.llm.staging import ship

CHUNK = 48
BLOCK_CHARS = 2 << 20
MOST_STEPS = 400_000
#: rounds in which entry states of chunks are looked for; more only make maps larger
ROUNDS = 3
START = ((0, -1, 0),)


class Transducer:
    """The compiled part of the automaton; it is dropped when it exceeds ``MOST_STEPS``
    transitions and grows again from what is read next."""

    def __init__(self, model: PieceModel):
        self.model = model
        # the trie: children by (node, character piece), the piece that ends at a node
        self.child: dict[int, int] = {}
        self.piece, self.inner = [-1], [True]
        for text, i in model.ids.items():
            node = 0
            for char in text:
                key = node * model.size + int(model.char_ids[32 if char == "▁" else ord(char)])
                if key not in self.child:
                    self.child[key] = len(self.piece)
                    self.piece.append(-1)
                    self.inner.append(False)
                self.inner[node] = True
                node = self.child[key]
            self.piece[node] = i
        self.symbols = {
            i: [int(model.char_ids[32 if c == "▁" else ord(c)]) for c in text]
            for text, i in model.ids.items()
        }
        self.stable: dict[int, bool] = {}
        self._clear()

    def _clear(self) -> None:
        self.states = [START]
        self.numbers = {START: 0}
        self.steps: dict[int, int] = {}  # (state, symbol) to next state * 64 + change + 32

    def _is_stable(self, left: int, right: int) -> bool:
        """Whether two pieces side by side are the encoding of their text; ``left`` is
        -1 at the start of a word."""
        key = left * self.model.size + right
        known = self.stable.get(key)
        if known is None:
            if len(self.stable) > MOST_STEPS:
                self.stable.clear()
            if left < 0:
                known = merge_sequence(self.model, list(self.symbols[right])) == [right]
            else:
                both = self.symbols[left] + self.symbols[right]
                known = merge_sequence(self.model, both) == [left, right]
            self.stable[key] = known
        return known

    def _compile(self, state: int, symbol: int) -> int:
        grown = []
        for node, last, since in self.states[state]:
            after = self.child.get(node * self.model.size + symbol)
            if after is not None:
                grown.append((after, last, since))
        for node, last, since in grown:  # the longest piece comes first
            piece = self.piece[node]
            if piece >= 0 and self._is_stable(last, piece):
                change = since + 1
                break
        else:
            raise RuntimeError("the vocabulary has no stable piece here")
        places = [(n, p, s - change) for n, p, s in grown if self.inner[n]]
        target = (*places, (0, piece, 0))
        number = self.numbers.get(target)
        if number is None:
            number = self.numbers[target] = len(self.states)
            self.states.append(target)
        step = self.steps[state * self.model.size + symbol] = number * 64 + change + 32
        return step

    def _step(self, key: int) -> int:
        found = self.steps.get(key)
        if found is None:
            found = self._compile(key // self.model.size, key % self.model.size)
        return found

    def _read(
        self, symbols: np.ndarray, starts: np.ndarray, sizes: np.ndarray, entries: np.ndarray
    ) -> tuple[np.ndarray, np.ndarray]:
        """The state behind each span and the change of the count in it, from the state it is
        entered in; all spans read their n-th character at once."""
        state, change = entries.copy(), np.zeros(len(starts), np.int64)
        active = np.argsort(-sizes, kind="stable")
        left = sizes[active]
        place = 0
        while going := int(np.searchsorted(-left, -place, side="left")):
            active, left = active[:going], left[:going]
            keys, back = np.unique(
                state[active] * self.model.size + symbols[starts[active] + place], return_inverse=True
            )
            moves = np.array([self._step(k) for k in keys.tolist()], np.int64)[back]
            state[active] = moves >> 6
            change[active] += (moves & 63) - 32
            place += 1
        return state, change

    def _long(self, symbols: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Tokens of long words: maps of all chunks at once, composed by a prefix scan.

        A chunk's map has a row for the start state and for each state in which it is entered
        behind such a row, found in ``ROUNDS`` rounds: automata like this one forget where
        they began, so these nearly always hold the state that the word brings. The scan
        links a row with the one it leads to in the next chunk and doubles the links, so that
        each row knows the last one it leads to and the sum on the way. A state that no row
        has is carried chunk by chunk up to one that has.
        """
        pieces = -(-sizes // CHUNK)
        behind = np.cumsum(pieces)
        word = np.repeat(np.arange(len(sizes)), pieces)
        chunk = np.arange(len(word))
        low = starts[word] + (chunk - (behind - pieces)[word]) * CHUNK
        length = np.minimum(CHUNK, (starts + sizes)[word] - low)
        final = np.zeros(len(chunk), bool)
        final[behind - 1] = True
        # rows of the maps, each by chunk and entry state
        rows = exits = changes = np.empty(0, np.int64)
        fresh = chunk << 32
        for _ in range(ROUNDS):
            state, change = self._read(symbols, low[fresh >> 32], length[fresh >> 32], fresh & 0xFFFFFFFF)
            rows, exits, changes = (np.concatenate(x) for x in ((rows, fresh), (exits, state), (changes, change)))
            on = ~final[fresh >> 32]
            fresh = np.setdiff1d(((fresh >> 32) + 1 << 32 | state)[on], rows)
        order = np.argsort(rows)
        rows, exits, changes = rows[order], exits[order], changes[order]

        def find(asked: np.ndarray) -> np.ndarray:
            at = np.minimum(np.searchsorted(rows, asked), len(rows) - 1)
            return np.where(rows[at] == asked, at, -1)

        follow = np.where(final[rows >> 32], -1, find((rows >> 32) + 1 << 32 | exits))
        to = np.where(follow < 0, np.arange(len(rows)), follow)
        total = np.where(follow < 0, 0, changes)
        while not np.array_equal(to, far := to[to]):
            total, to = total + total[to], far
        start = find(behind - pieces << 32)
        count = total[start] + changes[to[start]]
        for w in np.flatnonzero(~final[rows[to[start]] >> 32]).tolist():
            row = int(to[start[w]])
            while row >= 0:
                at, state = int(rows[row]) >> 32, exits[row : row + 1]
                row = -1
                while row < 0 and not final[at]:
                    at += 1
                    row = int(find((at << 32) + state)[0])
                    if row < 0:
                        state, change = self._read(symbols, low[at : at + 1], length[at : at + 1], state)
                        count[w] += change[0]
                if row >= 0:
                    count[w] += total[row] + changes[to[row]]
                    row = int(to[row])
        return count

    def counts(self, words: Words) -> np.ndarray:
        """Tokens of each distinct word."""
        if len(self.steps) > MOST_STEPS:
            self._clear()
        sizes = words.lengths.astype(np.int64)
        base = np.cumsum(sizes) - sizes
        total = np.zeros(len(sizes), np.int64)
        odd = words.symbols[base] < 0 if len(sizes) else np.zeros(0, bool)
        for w in np.flatnonzero(odd):
            total[w] = len(self.model.byte_pieces(int(words.points[w])))
        long = np.flatnonzero(sizes > CHUNK)
        if len(long):
            total[long] = self._long(words.symbols, base[long], sizes[long])
        short = np.flatnonzero((sizes <= CHUNK) & ~odd)
        total[short] = self._read(words.symbols, base[short], sizes[short], np.zeros(len(short), np.int64))[1]
        return total


_compiled: dict[str, Transducer] = {}


def transducer_of(vocabulary: dict) -> Transducer:
    """The transducer of a vocabulary; a Python worker keeps it for all its tasks."""
    if vocabulary["key"] not in _compiled:
        _compiled[vocabulary["key"]] = Transducer(model_of(vocabulary))
    return _compiled[vocabulary["key"]]


def count_texts(machine: Transducer, texts: list[str]) -> np.ndarray:
    found = []
    for _, _, words in word_blocks(texts, machine.model, BLOCK_CHARS):
        scan = np.concatenate([[0], np.cumsum(machine.counts(words)[words.occurs])])
        found.append(np.diff(scan[words.stops], prepend=0))
    return np.concatenate(found) if found else np.empty(0, np.int64)


def count_tokens(docs: DataFrame, model_path: str) -> DataFrame:
    """``doc_id``, ``n_bytes`` (UTF-8) and ``n_tokens`` of each whole text, as the
    library of the model counts them without begin and end ids.

    Null and empty texts have neither bytes nor tokens. Every row gives a row, also
    repeated ones and such without doc_id. Other columns are ignored.
    """
    ship(docs.sparkSession)
    vocabulary = docs.sparkSession.sparkContext.broadcast(read_vocabulary(model_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer_of(vocabulary.value)
        for batch in batches:
            counts = [count_texts(machine, texts) for _, _, texts in flat.slices(batch.column(2), BLOCK_CHARS)]
            counts = np.concatenate(counts) if counts else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(counts, pa.int64())],
                ["doc_id", "n_bytes", "n_tokens"],
            )

    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes")
    rows = docs.select(F.col("doc_id").cast("long"), size, "text")
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
