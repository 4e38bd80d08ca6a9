"""Token counts of long words: chunk maps composed by a scan, against the library."""

import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from corpusloom.llm import token_counts
from corpusloom.llm.piece_model import read_vocabulary

PATH = public_tokenizers.path("piece_bpe_32k.model")


def long_words():
    draw = random.Random(1)
    size = token_counts.CHUNK
    texts = ["a" * n for n in (size - 2, size - 1, size, size + 1, 2 * size - 1, 2 * size, 1000)]
    for letters in ("ab", "abcdeinrst", "日本語漢字"):
        texts += ["".join(draw.choices(letters, k=n)) for n in (size + 5, 4 * size, 3000)]
    texts += ["".join(draw.choices(["la", "ment", "tion", "s", "un", "qu"], k=300)) for _ in range(10)]
    texts += ["=" * 777, "x" + "-_" * 400, "é" * 333, "word " * 50 + "schifffahrt" * 30 + " and " + "ab" * 500, ""]
    return texts


@pytest.mark.parametrize("rounds", [1, 2, 3])
def test_long_words(monkeypatch, rounds):
    """With fewer rounds more states are missing from the maps and carried chunk by chunk."""
    monkeypatch.setattr(token_counts, "ROUNDS", rounds)
    machine = token_counts.Transducer(token_counts.model_of(read_vocabulary(PATH)))
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    texts = long_words()
    assert token_counts.count_texts(machine, texts).tolist() == [len(library.encode(t)) for t in texts]


def test_states_that_no_map_holds():
    """An automaton that never forgets where it began: the state counts all characters read."""

    class Counter(token_counts.Transducer):
        def __init__(self):
            self.model = type("Model", (), {"size": 1})

        def _step(self, key):
            return (key + 1) * 64 + 32 + key % 3

    machine = Counter()
    sizes = [49, 48 * 7, 48 * 7 + 1, 1000]
    starts = [sum(sizes[:i]) for i in range(len(sizes))]
    got = machine._long(np.zeros(sum(sizes), np.int64), np.array(starts), np.array(sizes))
    assert got.tolist() == [sum(i % 3 for i in range(n)) for n in sizes]
