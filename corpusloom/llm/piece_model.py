"""The vocabulary of a sentencepiece BPE model as tables, and the words of a text.

No piece has a blank behind another character, so merges never cross the start of a run
of blanks, nor a character that no piece has. Between those cuts lie the words, which can
be worked on one by one, each distinct word of a block once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from corpusloom.llm import flat

BLANK = "▁"
NONE = np.int32(2**31 - 1)


class Table:
    """A fixed map from int64 keys to int32 values, looked up for whole arrays."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, int(len(keys) * 4).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, -1, np.int64)
        self.values = np.full(1 << bits, NONE, np.int32)
        slots = self._slots(keys)
        left = np.arange(len(keys))
        while len(left):
            at, first = np.unique(slots[left], return_index=True)
            free = self.keys[at] == -1
            self.keys[at[free]] = keys[left[first[free]]]
            self.values[at[free]] = values[left[first[free]]]
            left = left[self.keys[slots[left]] != keys[left]]
            slots[left] = (slots[left] + 1) & self.mask

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * flat.MULTIPLIER) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The value of each key, ``NONE`` where there is none."""
        slots = self._slots(keys)
        held = self.keys[slots]
        found = np.where(held == keys, self.values[slots], NONE)
        left = np.flatnonzero((held != keys) & (held != -1))
        while len(left):
            slots[left] = (slots[left] + 1) & self.mask
            held = self.keys[slots[left]]
            hit = held == keys[left]
            found[left[hit]] = self.values[slots[left[hit]]]
            left = left[~hit & (held != -1)]
        return found


def read_vocabulary(path: str) -> dict:
    """What the tables need from a model file: pieces, scores and kinds."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())
    kinds = [
        "c" if model.is_control(i) else "u" if model.is_unknown(i) else "b" if model.is_byte(i) else "n"
        for i in ids
    ]
    return {
        "key": path,
        "pieces": [model.id_to_piece(i) for i in ids],
        "scores": [model.get_score(i) for i in ids],
        "kinds": "".join(kinds),
        "begin": model.bos_id(),
        "end": model.eos_id(),
    }


class PieceModel:
    def __init__(self, vocabulary: dict):
        self.pieces, kinds = vocabulary["pieces"], vocabulary["kinds"]
        self.begin, self.end = vocabulary["begin"], vocabulary["end"]
        self.size = len(self.pieces)
        self.ids = {p: i for i, p in enumerate(self.pieces) if kinds[i] == "n"}
        self.byte_ids = np.array([i for i, k in enumerate(kinds) if k == "b"], np.int32)
        # pieces of equal score have equal rank; the place decides between them
        scores = np.array(vocabulary["scores"])
        self.rank = np.unique(-scores, return_inverse=True)[1].astype(np.int32)
        self.char_ids = np.full(0x110000, -1, np.int32)
        for piece, i in self.ids.items():
            if len(piece) == 1:
                self.char_ids[ord(piece)] = i
        self.blank = self.ids[BLANK]
        self.char_ids[32] = self.blank
        pairs = {}
        for piece, i in self.ids.items():
            for cut in range(1, len(piece)):
                left, right = self.ids.get(piece[:cut]), self.ids.get(piece[cut:])
                if left is not None and right is not None:
                    pairs[left * self.size + right] = i
        self.pairs = pairs
        self.pair_table = Table(
            np.fromiter(pairs, np.int64, len(pairs)), np.fromiter(pairs.values(), np.int32, len(pairs))
        )
        # what each piece stands for in a decoded text
        surface = [
            b"" if kinds[i] in "cu"
            else bytes([int(p[3:5], 16)]) if kinds[i] == "b"
            else p.replace(BLANK, " ").encode()
            for i, p in enumerate(self.pieces)
        ]
        self.surface_size = np.array([len(s) for s in surface], np.int64)
        self.surface_start = np.cumsum(self.surface_size) - self.surface_size
        self.surface = np.frombuffer(b"".join(surface), np.uint8)

    def byte_pieces(self, point: int) -> np.ndarray:
        """The pieces for a character that no piece has: one per byte."""
        return self.byte_ids[np.frombuffer(chr(point).encode("utf-8", "surrogatepass"), np.uint8)]


_models: dict[str, PieceModel] = {}


def model_of(vocabulary: dict) -> PieceModel:
    """The tables of a vocabulary, built once per process."""
    if vocabulary["key"] not in _models:
        _models[vocabulary["key"]] = PieceModel(vocabulary)
    return _models[vocabulary["key"]]


def gather(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The indices of the ranges ``[start, start + size)``, one range after another."""
    ends = np.cumsum(sizes)
    if not len(sizes) or not ends[-1]:
        return np.empty(0, np.int64)
    steps = np.repeat(starts - (ends - sizes), sizes)
    return steps + np.arange(ends[-1])


class Words:
    """The distinct words of a block of texts and where they occur."""

    def __init__(self, texts: list[str], model: PieceModel):
        cp = flat.points("".join(" " + t for t in texts if t))
        ids = model.char_ids[cp]
        blank, odd = ids == model.blank, ids < 0
        sizes = np.array([len(t) + 1 if t else 0 for t in texts], np.int64)
        stops = np.cumsum(sizes)
        cut = np.zeros(len(cp) + 1, bool)
        cut[:-1] = odd | blank
        cut[1:-1] &= ~(blank[1:] & blank[:-1])
        cut[1:-1] |= odd[:-1] | odd[1:]
        cut[(stops - sizes)[sizes > 0]] = True
        starts = np.flatnonzero(cut[:-1])
        ends = np.append(starts[1:], len(cp)) if len(starts) else starts
        plain = np.where(blank, 32, cp)
        hashes = flat.span_hashes(flat.codes()[plain], starts, ends)
        _, first, self.occurs = np.unique(hashes, return_index=True, return_inverse=True)
        self.lengths = (ends - starts)[first]
        self.symbols = ids[gather(starts[first], self.lengths)]
        self.points = cp[starts[first]]
        #: words before the end of each text
        self.stops = np.searchsorted(starts, stops)


def word_blocks(texts: list[str], model: PieceModel, limit: int) -> Iterator[tuple[int, int, Words]]:
    for low, high in flat.blocks(texts, limit):
        yield low, high, Words(texts[low:high], model)
