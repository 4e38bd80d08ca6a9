"""The two class models, their features and the scores against plain Python over dictionaries."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import toxicity

D, PRIOR = toxicity.DISCOUNT, toxicity.PAIR_PRIOR
MARK = ""


def pairs_of(text):
    words = re.findall("[a-z0-9]+", (text or "").lower())
    return list(zip([MARK, *words], words))


def kept(n):
    return max(0.0, n - D)


class Plain:
    """Probabilities of one word at a time, from counts of texts."""

    def __init__(self, labelled, every, halves):
        texts, ends_word, ends_stem = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter)
        for text, half, toxic in labelled:
            for pair in set(pairs_of(text)):
                texts[pair][half, toxic] += 1
        for pair, cells in texts.items():
            for cell in cells:
                ends_word[pair[1]][cell] += 1
                ends_stem[pair[1][:4]][cell] += 1

        def told(cells):
            return any(sum(n for (_, c), n in cells.items() if c == k) > D for k in (0, 1))

        def both(table, some=told):
            return {
                key: [sum(n for (h, c), n in cells.items() if h in halves and c == k) for k in (0, 1)]
                for key, cells in table.items() if some(cells)
            }

        self.pairs, self.words, self.stems = both(texts), both(ends_word), both(ends_stem, lambda cells: True)
        befores = {(pair[0][:4], pair[1][:4]) for text in every for pair in pairs_of(text)}
        self.sides = Counter(stem for _, stem in befores)
        self.total = max(1.0, sum(map(sum, self.stems.values())))
        self.stem_share, self.stem_handed = self.share(self.stems)
        self.word_share, self.word_handed = self.share(self.words)
        self.kinds = Counter(word[:4] for word in self.words)
        self.after = defaultdict(lambda: [0.0, 0.0])
        for (before, _), counts in self.pairs.items():
            if before in self.words:
                for c in (0, 1):
                    self.after[before][c] += kept(counts[c])

    def share(self, table):
        sums = [max(1e-9, sum(kept(n[c]) for n in table.values())) for c in (0, 1)]
        handed = max(0.02, 1 - sum(kept(n) for both in table.values() for n in both) / self.total)
        return {k: [(1 - handed) * kept(n[c]) / sums[c] for c in (0, 1)] for k, n in table.items()}, handed

    def probability(self, before, word, c):
        stem = word[:4]
        lowest = (1 + self.sides[stem]) / (toxicity.STEMS + sum(self.sides.values()))
        p = self.stem_handed * lowest + self.stem_share.get(stem, (0, 0))[c]
        p = self.word_handed * p / (1 + self.kinds[stem]) + self.word_share.get(word, (0, 0))[c]
        if before not in self.words:
            return p
        sums = self.after[before]
        trust = min(0.98, sum(sums) / max(1, sum(self.words[before])))
        weight = trust / (sums[c] + PRIOR)
        return p * (weight * PRIOR + 1 - trust) + kept(self.pairs.get((before, word), (0, 0))[c]) * weight

    def features(self, text):
        ratio = [math.log(self.probability(*pair, 1) / self.probability(*pair, 0)) for pair in pairs_of(text)]
        found = [sum(ratio) / max(1, len(ratio))]
        for size in toxicity.WINDOWS:
            found.append(max(sum(ratio[i : i + size]) for i in range(max(1, len(ratio) - size + 1))) / size)
        return found


@pytest.fixture(scope="module")
def corpus():
    draw = random.Random(4)
    plain = [f"{a}{b}" for a in ("gard", "hous", "rive", "tabl", "wint") for b in ("", "e", "en", "s")]
    rude = ["zork", "zorkish", "blarg", "blargen"]
    texts, labels = {}, {}
    for i in range(120):
        toxic = i % 3 == 0
        words = draw.choices(plain, k=draw.randrange(1, 30))
        for _ in range(draw.randrange(1, 5) if toxic else 0):
            words.insert(draw.randrange(len(words)), draw.choice(rude))
        if draw.random() < 0.1:
            words.append(draw.choice(rude))
        texts[i] = draw.choice([" ", ", ", "\n"]).join(words).title()
        if i < 100:
            labels[i] = int(toxic)
    texts |= {200: "", 201: None, 202: "...", 203: "unseen words only", 204: "zork " * 50}
    labels |= {200: 0, 201: 1}
    return texts, labels


def test_scores_by_brute_force(spark, corpus):
    texts, labels = corpus
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    marked = spark.createDataFrame([(i, 1, t) for i, t in labels.items()], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, marked)
    half = {r.doc_id: r.half for r in docs.select("doc_id", (F.xxhash64(F.lit("half"), "doc_id") % 2 != 0).cast("int").alias("half")).collect()}
    used = {i: t for i, t in labels.items() if zlib.crc32(str(i).encode()) % 3 != 1}
    assert 0 < len(used) < len(labels) and {half[i] for i in used} == {0, 1}
    labelled = [(texts[i], half[i], t) for i, t in used.items()]

    # the logistic function is at its optimum for texts that the other half's model read
    others = {h: Plain(labelled, texts.values(), (1 - h,)) for h in (0, 1)}
    x = np.array([[*others[half[i]].features(texts[i]), 1.0] for i in used])
    w = model["weights"]
    slope = x.T @ (1 / (1 + np.exp(-x @ w)) - np.array(list(used.values()))) + 1e-2 * w
    assert np.abs(slope).max() < 1e-5

    whole = Plain(labelled, texts.values(), (0, 1))
    got = {r.doc_id: r.toxicity for r in toxicity.score(docs, model).collect()}
    assert set(got) == set(texts)
    for i, text in texts.items():
        want = 1 / (1 + math.exp(-(np.dot(whole.features(text), w[:-1]) + w[-1])))
        assert got[i] == pytest.approx(want, abs=1e-9), (i, text)
    held = [i for i in labels if i not in used and i < 100]
    assert sum((got[i] >= 0.5) == labels[i] for i in held) / len(held) > 0.8


def test_probabilities_of_a_context_do_not_exceed_one(spark, corpus):
    """Over all words seen, with the mass that the levels hand down left over."""
    texts, labels = corpus
    model = Plain([(texts[i], 0, t) for i, t in labels.items()], texts.values(), (0,))
    words = {word for text in texts.values() for _, word in pairs_of(text)}
    for before in [MARK, "nowhere", *sorted(words)[:10]]:
        for c in (0, 1):
            assert 0 < sum(model.probability(before, word, c) for word in words) <= 1 + 1e-9
