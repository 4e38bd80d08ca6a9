"""Periodic runs of words, found in a grammar that compresses the text.

Re-Pair replaces the most frequent pair of neighbouring symbols by a new symbol until no pair
of a document repeats; here all pairs that are more frequent than their overlapping
neighbours are replaced in one round, for many documents at once. What is left of each
document becomes the leaves of a balanced tree, so every document is one binary grammar.

Every run lies inside some symbol and crosses the boundary of its two parts. So each
symbol is looked at once, at its first place: a run of at least four periods across the
boundary has two whole periods on one side of it, and those start or end at the boundary.
What is found there holds at all places the symbol was derived at; overlapping intervals of
equal period are merged, and the shortest period of an interval is the run's.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm import flat
from corpusloom.llm.staging import ship, unused

WORD = re.compile("[^\x20\x09-\x0d]+")
PERIODS = 4
SHORTEST = 6
#: numbers laid out at a time when boundaries are looked at
SPREAD = 1 << 20


def word_codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The 64-bit hash of every word of ``texts``, in order, and where each text's words end."""
    cp = flat.points(" ".join(texts) + " ")
    space = (cp == 32) | ((cp >= 9) & (cp <= 13))
    before = np.empty_like(space)
    before[0], before[1:] = True, space[:-1]
    starts, ends = np.flatnonzero(before & ~space), np.flatnonzero(space & ~before)
    stops = np.cumsum([len(t) + 1 for t in texts])
    return flat.span_hashes(flat.codes()[cp], starts, ends), np.searchsorted(starts, stops)


class Spans:
    """Equality of stretches of symbols by prefix sums of their codes."""

    def __init__(self, symbols: np.ndarray):
        n = len(symbols)
        self.up, down = flat._power_tables(n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        codes = flat.mix((symbols.astype(np.uint64) + np.uint64(1)) * flat.MULTIPLIER)
        np.cumsum(codes * down[:n], out=self.sums[1:])

    def equal(self, i: np.ndarray, j: np.ndarray, size: np.ndarray) -> np.ndarray:
        left = (self.sums[i + size] - self.sums[i]) * self.up[i]
        return left == (self.sums[j + size] - self.sums[j]) * self.up[j]

    def forward(self, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
        """How far the stretches from ``i`` and ``j`` agree, at most ``most``."""
        low, high = np.zeros_like(most), most.copy()
        while (low < high).any():
            middle = (low + high + 1) // 2
            same = self.equal(i, j, middle)
            low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
        return low

    def backward(self, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
        """How far the stretches before ``i`` and ``j`` agree, at most ``most``."""
        low, high = np.zeros_like(most), most.copy()
        while (low < high).any():
            middle = (low + high + 1) // 2
            same = self.equal(i - middle, j - middle, middle)
            low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
        return low


class Grammar:
    """The symbols of a binary grammar over the words of some documents: where each one first
    stands (start, boundary, end in words), and all its places."""

    def __init__(self, symbols: np.ndarray, document: np.ndarray):
        self.first: list[np.ndarray] = []
        self.places: list[np.ndarray] = []  # columns: symbol, start
        self.count = 0
        at, stop, document = self._pair(symbols, document)
        self._tree(at, stop, document)
        self.nodes = np.concatenate([*self.first, np.zeros((0, 3), np.int64)])
        self.at = np.concatenate([*self.places, np.zeros((0, 2), np.int64)])

    def _named(self, start: np.ndarray, boundary: np.ndarray, end: np.ndarray) -> None:
        self.first.append(np.column_stack([start, boundary, end]))
        self.count += len(start)

    def _pair(self, symbols: np.ndarray, document: np.ndarray):
        """Re-Pair: rounds of replacements until no pair repeats within its document."""
        n = len(symbols)
        base = int(symbols.max(initial=-1)) + 1
        symbols = symbols.astype(np.int64)
        at, stop = np.arange(n), np.arange(1, n + 1)
        alive = np.ones(n, bool)
        rules, names = np.zeros(0, np.int64), np.zeros(0, np.int64)
        while True:
            open_ = np.flatnonzero(alive[:-1] & (document[:-1] == document[1:]))
            keys = (symbols[open_] << 32) | symbols[open_ + 1]
            pairs, which, counts = np.unique(keys, return_inverse=True, return_counts=True)
            place = np.searchsorted(rules, pairs)
            known = np.zeros(len(pairs), bool)
            known[place < len(rules)] = rules[place[place < len(rules)]] == pairs[place < len(rules)]
            again = ((counts >= 2) | known)[which]
            alive[:] = False
            open_, which = open_[again], which[again]
            if not len(open_):
                return at, stop, document
            alive[open_] = True
            rank = np.full(len(symbols) + 1, -1, np.int64)
            rank[open_] = (counts[which] << 32) + (1 << 31) - which
            # streaks of one pair (a word many times over), and whether their neighbours rank lower
            value = rank[open_]
            head = np.ones(len(open_), bool)
            head[1:] = (open_[1:] != open_[:-1] + 1) | (value[1:] != value[:-1])
            streak = np.cumsum(head) - 1
            heads = np.flatnonzero(head)
            tails = np.append(heads[1:], len(open_)) - 1
            wins = (rank[open_[heads] - 1] < value[heads]) & (rank[open_[tails] + 1] < value[heads])
            wins |= (open_[heads] == 0) & (rank[open_[tails] + 1] < value[heads])
            even = (open_ - open_[heads][streak]) % 2 == 0
            chosen = wins[streak] & even
            spot, pair = open_[chosen], which[chosen]
            used, where, inverse = np.unique(pair, return_index=True, return_inverse=True)
            new = ~known[used]
            name = np.empty(len(used), np.int64)
            name[~new] = names[place[used[~new]]]
            name[new] = self.count + np.arange(int(new.sum()))
            lead = spot[where[new]]
            self._named(at[lead], at[lead + 1], stop[lead + 1])
            rules = np.insert(rules, place[used[new]], pairs[used[new]])
            names = np.insert(names, place[used[new]], name[new])
            large = stop[spot + 1] - at[spot] >= SHORTEST
            self.places.append(np.column_stack([name[inverse][large], at[spot[large]]]))
            symbols[spot] = base + name[inverse]
            stop[spot] = stop[spot + 1]
            alive[spot] = True
            alive[np.maximum(spot - 1, 0)] = True
            kept = np.ones(len(symbols), bool)
            kept[spot + 1] = False
            symbols, at, stop, document, alive = (x[kept] for x in (symbols, at, stop, document, alive))

    def _tree(self, at: np.ndarray, stop: np.ndarray, document: np.ndarray) -> None:
        """Neighbours joined two by two, level by level, up to one symbol per document."""
        while len(at):
            first = np.searchsorted(document, document)
            left = np.flatnonzero((np.arange(len(at)) - first)[:-1] % 2 == 0) if len(at) > 1 else np.zeros(0, int)
            left = left[document[left] == document[left + 1]]
            if not len(left):
                return
            self.places.append(np.column_stack([self.count + np.arange(len(left)), at[left]]))
            self._named(at[left], at[left + 1], stop[left + 1])
            stop = stop.copy()
            stop[left] = stop[left + 1]
            kept = np.ones(len(at), bool)
            kept[left + 1] = False
            at, stop, document = at[kept], stop[kept], document[kept]


def _squares(nodes: np.ndarray, symbols: np.ndarray, spans: Spans) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two equal neighbouring stretches that start or end at a node's boundary: the node, the
    first place and the period, where the node is long enough for a run of that period."""
    start, boundary, end = nodes.T
    room = (end - start) // PERIODS
    found = []
    for side, most in ((0, np.minimum((end - boundary) // 2, room)), (1, np.minimum((boundary - start) // 2, room))):
        most = np.where(end - start >= SHORTEST, most, 0)
        asked = np.flatnonzero(most > 0)
        upto = np.cumsum(most[asked])
        low = 0
        while low < len(asked):
            high = max(low + 1, int(np.searchsorted(upto, (upto[low - 1] if low else 0) + SPREAD, side="right")))
            part = asked[low:high]
            node = np.repeat(part, most[part])
            period = np.arange(1, len(node) + 1) - np.repeat(np.cumsum(most[part]) - most[part], most[part])
            place = boundary[node] - 2 * period * side
            near = (symbols[place] == symbols[place + period]) & (
                symbols[place + period - 1] == symbols[place + 2 * period - 1]
            )
            node, period, place = node[near], period[near], place[near]
            same = spans.equal(place, place + period, period)
            found.append((node[same], place[same], period[same]))
            low = high
    return tuple(np.concatenate(x) for x in zip(*found))


def _checked(low, high, place, period, start, end, symbols):
    """The intervals compared word by word; one that rests on equal hashes of different
    words is found anew."""
    size = high - low - period
    step = 0
    while step < len(low):
        upto = step + max(1, int(np.searchsorted(np.cumsum(size[step:]), SPREAD, side="right")))
        many = size[step:upto]
        which = np.repeat(np.arange(step, upto), many)
        i = low[which] + np.arange(len(which)) - np.repeat(np.cumsum(many) - many, many)
        for k in np.unique(which[symbols[i] != symbols[i + period[which]]]).tolist():
            q, a, b = period[k], place[k], place[k]
            while b + q < end[k] and symbols[b] == symbols[b + q]:
                b += 1
            while a > start[k] and symbols[a - 1] == symbols[a - 1 + q]:
                a -= 1
            low[k], high[k] = a, b + q
        step = upto
    return low, high


def find_runs(symbols: np.ndarray, document: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All runs (start, end, period) of a sequence of symbols, by start and period.
    ``document`` tells the document of each place; documents share no symbols."""
    nothing = np.zeros(0, np.int64)
    if len(symbols) < SHORTEST:
        return nothing, nothing, nothing
    spans, grammar = Spans(symbols), Grammar(symbols, document)
    node, place, period = _squares(grammar.nodes, symbols, spans)
    start, end = grammar.nodes[node, 0], grammar.nodes[node, 2]
    high = place + period + spans.forward(place, place + period, end - place - period)
    low = place - spans.backward(place, place + period, place - start)

    def long_enough(low, high, period):
        return high - low >= np.maximum(SHORTEST, PERIODS * period)

    def first_of(order, *same):
        keep = np.ones(len(order), bool)
        keep[1:] = False
        for x in same:
            keep[1:] |= x[order][1:] != x[order][:-1]
        return order[keep]

    kept = np.flatnonzero(long_enough(low, high, period))
    # the same interval has its shortest period first
    order = kept[np.lexsort((period[kept], high[kept], low[kept], node[kept]))]
    kept = first_of(order, node, low, high)
    node, place, period, low, high = (x[kept] for x in (node, place, period, low, high))
    low, high = _checked(low, high, place, period, start[kept], end[kept], symbols)
    kept = np.flatnonzero(long_enough(low, high, period))
    node, period, low, high = (x[kept] for x in (node, period, low, high))
    # to all places each symbol was derived at; ``node`` is in order
    left = np.searchsorted(node, grammar.at[:, 0], side="left")
    many = np.searchsorted(node, grammar.at[:, 0], side="right") - left
    run = np.repeat(left - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
    move = np.repeat(grammar.at[:, 1], many) - grammar.nodes[node[run], 0]
    low, high, period = low[run] + move, high[run] + move, period[run]
    if not len(low):
        return nothing, nothing, nothing
    order = np.lexsort((-high, low, period))
    low, high, period = low[order], high[order], period[order]
    # one period after the other, so that ends of a smaller period never reach into the next
    shift = period * (len(symbols) + 1)
    reach = np.maximum.accumulate(high + shift)
    new = np.ones(len(low), bool)
    new[1:] = low[1:] + period[1:] + shift[1:] > reach[:-1]
    first = np.flatnonzero(new)
    high = np.maximum.reduceat(high, first)
    low, period = low[first], period[first]
    kept = first_of(np.lexsort((period, high, low)), low, high)
    kept = kept[np.lexsort((period[kept], low[kept]))]
    return low[kept], high[kept], period[kept]


def _covered(n: int, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, low, 1)
    np.add.at(change, high, -1)
    return np.cumsum(change[:-1]) > 0


RUN = T.StructType([T.StructField(name, T.LongType(), False) for name in ("start", "length", "period")])


def _text_runs(texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Collapsed texts; runs per text; start in its text, length and period of every run."""
    codes, stops = word_codes(texts)
    counts = np.diff(stops, prepend=0)
    document = np.repeat(np.arange(len(texts)), counts)
    own = flat.mix(codes ^ flat.mix((document.astype(np.uint64) + np.uint64(1)) * flat.MULTIPLIER))
    symbols = np.unique(own, return_inverse=True)[1].astype(np.int64)
    low, high, period = find_runs(symbols, document)
    gone = _covered(len(symbols), low + period, high)
    offset = stops - counts
    collapsed = []
    for text, start, stop in zip(texts, offset.tolist(), stops.tolist()):
        words = WORD.findall(text)
        if gone[start:stop].any():
            words = [words[i] for i in np.flatnonzero(~gone[start:stop]).tolist()]
        collapsed.append(" ".join(words))
    of = document[low]
    return collapsed, np.bincount(of, minlength=len(texts)), low - offset[of], high - low, period


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low, high, texts in flat.slices(batch.column(batch.num_columns - 1)):
            collapsed, counts, *numbers = _text_runs(texts)
            ends = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
            runs = pa.StructArray.from_arrays([pa.array(x.astype(np.int64)) for x in numbers], ["start", "length", "period"])
            rest = batch.slice(low, high - low)
            yield pa.RecordBatch.from_arrays(
                [*rest.columns[:-1], pa.ListArray.from_arrays(ends, runs), pa.array(collapsed, pa.string())],
                [*rest.schema.names[:-1], "runs", "collapsed"],
            )


def periodic_runs(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``runs`` and ``collapsed`` in place of the column ``text``.

    ``runs`` are the periodic runs among the words (``[^\\x20\\x09-\\x0D]+``, as written) of
    the whole text, by start and period: a stretch whose words ``period`` apart are equal, with
    no smaller period, of at least four periods and six words, that cannot be extended.
    ``collapsed`` joins by single spaces the words outside runs and in the first period of
    each.

    Null and wordless texts have no runs and collapse to an empty text. Rows are worked on
    one by one, so repeated rows and rows without doc_id repeat in the result; an empty
    table gives no rows. Other columns stay, but any of the names ``runs`` and
    ``collapsed`` are replaced.
    """
    ship(docs.sparkSession)
    rest = [name for name in docs.columns if name not in (text, "runs", "collapsed")]
    last = unused(docs, "_text")
    rows = docs.select(*rest, F.col(text).cast("string").alias(last))
    kinds = [field for field in rows.schema.fields if field.name != last]
    schema = T.StructType([*kinds, T.StructField("runs", T.ArrayType(RUN, False)), T.StructField("collapsed", T.StringType())])
    return rows.mapInArrow(_run, schema)
