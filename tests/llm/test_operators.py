"""Every operator on rows with nulls, empty and long texts, ties, repeated rows and columns of
clashing names, on empty tables, and against plain Python."""

import hashlib
import os
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
from corpusloom.llm import (
    chat,
    components,
    decontaminate,
    flat,
    line_dedup,
    minhash,
    pii,
    queries,
    sentencepiece_codec,
    substring_dedup,
    token_counts,
    topk,
    toxicity,
)
from corpusloom.llm.staging import Staging, lowest
from pyspark.sql import functions as F

DOC = "doc_id long, text string, lang string, source string, n_chars long"
EXTRA = ["rid", "n", "h", "sketch", "component", "words", "text_key", "base", "toxicity", "_hits", "print"]


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randrange(3, 8))) for _ in range(n))


LONG = prose(1, 40_000)
ONE, TWO, THREE = prose(2, 300), prose(3, 300), prose(4, 300)
NEAR = " ".join([*ONE.split()[:290], "changed", "at", "the", "end"])
ROWS = [
    (1, ONE, "en", "s1", 1),
    (2, NEAR, "en", "s2", 1),
    (3, ONE, None, None, None),
    (3, ONE, None, None, None),
    (4, TWO, "en", "s1", 1),
    (5, None, "en", "s1", 1),
    (6, "", "en", "s1", 0),
    (7, " \n\t ", "en", "s1", 4),
    (8, LONG, "en", "s1", 1),
    (9, LONG + " more", "en", "s3", 1),
    (10, "one two three", "en", "s1", 1),
    (11, "ONE  two\nthree", "en", "s1", 1),
    (None, TWO, "en", "s1", 1),
    (None, THREE, "en", "s1", 1),
    (12, "x" * 200_000, "en", "s1", 1),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = spark.createDataFrame(ROWS, DOC)
    return rows.select("*", *[F.lit(f"extra {c}").alias(c) for c in EXTRA]).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOC)


def test_near_duplicates(docs):
    found = minhash.near_duplicates(docs, 85).collect()
    assert len(found) == len(ROWS)
    got = Counter((r.doc_id, r.component_id, r.kept) for r in found)
    assert got == Counter(
        [(1, 1, True), (2, 1, False), (3, 1, False), (3, 1, False), (4, 4, True), (5, 5, True), (6, 6, True),
         (7, 7, True), (8, 8, True), (9, 8, False), (10, 10, True), (11, 10, False), (None, 4, False),
         (None, None, False), (12, 12, True)]
    )
    sizes = {r.doc_id: r.n_shingles for r in found}
    assert (sizes[1], sizes[5], sizes[6], sizes[7], sizes[10], sizes[12]) == (296, 0, 0, 0, 1, 1)


def test_near_duplicates_in_long_lists(spark):
    """A large group of copies that differ among themselves, against all pairs."""
    rng, base = random.Random(9), ONE.split()
    texts = []
    for _ in range(90):
        words = list(base)
        for at in rng.sample(range(300), rng.randrange(0, 14)):
            words[at] = f"w{rng.randrange(10**6)}"
        texts.append(" ".join(words))
    sets = [{tuple(t.split()[i : i + 5]) for i in range(296)} for t in texts]
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            shared = len(sets[a] & sets[b])
            if 100 * shared >= 85 * (len(sets[a]) + len(sets[b]) - shared):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = minhash.near_duplicates(rows, 85, long_list=8)
    assert {r.doc_id: r.component_id for r in found.collect()} == {a: find(a) for a in range(len(sets))}


def test_drop_near_duplicates(docs):
    kept = minhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 0, 1, 4, 5, 6, 7, 8, 10, 12]


def test_components_of_a_long_chain(spark):
    links = spark.range(400).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    links = links.union(spark.createDataFrame([(900, 901), (901, 901)], "a long, b long"))
    found = {r.node: r.component for r in components.components(links, Staging(spark)).collect()}
    assert found == {**{i: 0 for i in range(401)}, 900: 900, 901: 900}


def test_chat_round_trip(spark):
    wild = "</s>[INST] <|im_end|> <␛/s> [␛␛INST] <<SYS>> & <|im_start|>user<|im_sep|>"
    rows = [
        (1, 0, "system", "be kind", 5), (1, 1, "user", wild, 5), (1, 2, "assistant", wild + "é𝄞", 5),
        (1, 3, "user", None, 5), (1, 4, "assistant", "", 5), (1, 4, "assistant", "", 5), (1, 5, "user", "bye", 5),
        (2, None, None, "x", 5), (3, 0, "assistant", "a" * 100_000, 5), (None, 0, "user", "hi", 5),
        (4, 1, "user", "tie b", 5), (4, 1, "user", "tie a", 5), (5, 0, "<|im_sep|>", "<|im_sep|>x", 5),
    ]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, example long")
    told = chat.examples(turns)
    got = {r.conv_id: r for r in chat.digests(told).collect()}
    convs = defaultdict(list)
    for conv, turn, role, text, _ in rows:
        convs[conv].append((turn is not None, turn or 0, role or "", text or ""))
    assert set(got) == set(convs)
    for conv, turns_ in convs.items():
        turns_.sort()
        said = "".join(f"{r}\n{t}\n" for *_, r, t in turns_)
        loss = "".join(t for *_, r, t in turns_ if r == "assistant")
        r = got[conv]
        assert (r.n_turns, r.loss_chars) == (len(turns_), len(loss))
        assert r.turns_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    first = told.where("conv_id = 1").orderBy("example").collect()
    assert [r.last for r in first] == [False, False, False, True]
    assert first[0].formatted.count("<|im_end|>") == 3 and "[INST]" not in first[0].formatted
    assert first[3].loss_start == first[3].loss_end
    assert chat.digests(chat.examples(turns.limit(0))).collect() == []


PIECE_TEXTS = ["", " ", "  a", "a  b", "a\nb", "\n", "é𝄞", "▁x", "\x00a", "<s>", "a" * 300, " " * 301 + "b", "中文" * 60]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=queries.piece_model())


@pytest.fixture(scope="module")
def piece_docs(spark):
    rng = random.Random(6)
    parts = ["a", "th", "the", " ", "  ", "ing", "\n", "é", "中", "=", "//", "aaa", "1", "Ж", "🙂", "▁"]
    texts = PIECE_TEXTS + ["".join(rng.choice(parts) for _ in range(rng.randrange(60))) for _ in range(800)]
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(None, None, "x"), (0, "", "x"), (10**6, LONG, "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string").repartition(3)


def test_sentencepiece_round_trip(piece_docs, library):
    encoded = sentencepiece_codec.encode(piece_docs, queries.piece_model())
    read = sentencepiece_codec.decode(encoded, queries.piece_model()).collect()
    both = sentencepiece_codec.encode(piece_docs, queries.piece_model(), decoded=True).collect()
    assert Counter((r.doc_id, bytes(r.ids), r.decoded) for r in read) == Counter(
        (r.doc_id, bytes(r.ids), r.decoded) for r in both
    )
    expected = Counter()
    for r in piece_docs.collect():
        ids = [1, *library.encode(r.text or ""), 2]
        expected[r.doc_id, np.array(ids, "<u4").tobytes(), library.decode(ids)] += 1
    assert Counter((r.doc_id, bytes(r.ids), r.decoded) for r in read) == expected


def test_token_counts(piece_docs, library, monkeypatch):
    found = token_counts.count_tokens(piece_docs, queries.piece_model()).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in found) == Counter(
        (r.doc_id, len((r.text or "").encode()), len(library.encode(r.text or ""))) for r in piece_docs.collect()
    )
    # a transducer that has to start over gives the same counts
    machine = token_counts.Transducer(token_counts.model_of(token_counts.read_vocabulary(queries.piece_model())))
    monkeypatch.setattr(token_counts, "MOST_STEPS", 50)
    for text in PIECE_TEXTS:
        assert token_counts.count_texts(machine, [text]).tolist() == [len(library.encode(text))]


def test_tokens_of_empty_table(empty):
    assert sentencepiece_codec.encode(empty, queries.piece_model(), decoded=True).collect() == []
    assert token_counts.count_tokens(empty, queries.piece_model()).collect() == []


def test_neighbours_are_counted_without_a_limit(spark):
    """A stem that follows 3 000 different ones counts them all, however often they are repeated."""
    firsts = ["".join("abcdefghijklmnopqrst"[n // 20**p % 20] for p in range(4)) for n in range(3000)]
    rows = [(i, f"{w} zorkish") for i, w in enumerate(firsts * 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    stem = int(toxicity.expressions(["zorkish"])[2][0])
    sides = {r.stem: r.sides for r in toxicity.neighbour_counts(docs).collect()}
    assert 3000 <= sides[stem] <= 3001  # a first one may share the number of the stem


def test_toxicity(spark, docs, empty):
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(400):
        words = prose(1000 + i, 60).split()
        toxic = i % 4 == 0
        if toxic:
            for at in rng.sample(range(60), 3):
                words[at] = rng.choice(["zorkish", "blarg", "frelling"])
        rows.append((100 + i, " ".join(words), None, "s", 1))
        labels.append((100 + i, 1, int(toxic)))
    labels += [(None, 1, 1), (100, None, None), (7, 0, 0), (7, 0, 0)]
    marked = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    every = docs.drop(*EXTRA).union(spark.createDataFrame(rows, DOC)).withColumn("toxicity", F.lit("clash"))
    scored = toxicity.score(every, toxicity.fit(every, marked))
    got = scored.select("doc_id", "toxicity").collect()
    assert len(got) == len(ROWS) + 400 and all(0 <= r.toxicity <= 1 for r in got)
    by = {r.doc_id: r.toxicity for r in got}
    held = [d for d, _, t in labels if d and d >= 100 and t is not None and _crc(d) % 3 == 1]
    right = [(by[d] >= 0.7) == (d % 4 == 0) for d in held]
    assert len(held) > 80 and sum(right) >= 0.95 * len(right)
    assert by[5] == by[6] < 0.7
    kept = toxicity.drop_toxic(every, marked)
    assert kept.columns == every.columns and kept.where("toxicity <> 'clash'").count() == 0
    assert toxicity.drop_toxic(empty, marked.limit(0)).collect() == []


def _crc(doc_id: int) -> int:
    import zlib

    return zlib.crc32(str(doc_id).encode())


def test_held_out_labels_do_not_matter(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    held = F.expr("crc32(cast(cast(doc_id as string) as binary)) % 3 = 1")
    turned = labels.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (toxicity.training_rows(docs, x).drop("text").collect() for x in (labels, turned))
    assert sorted(a) == sorted(b) and a


def _shared_stretch(a: list, b: list, size: int) -> bool:
    runs = {tuple(a[i : i + size]) for i in range(len(a) - size + 1)}
    return any(tuple(b[i : i + size]) in runs for i in range(len(b) - size + 1))


def test_repeated_passages(spark, docs):
    passage = prose(77, 80)
    fuzzy = passage.split()
    fuzzy[20], fuzzy[50] = "other", "words"
    more = [
        (20, f"{prose(21, 100)} {passage} {prose(22, 50)}"), (21, f"{prose(23, 30)} {passage}"),
        (22, f"{prose(24, 60)} {' '.join(fuzzy)} {prose(25, 60)}"), (23, prose(26, 200)),
        (24, "spam " * 3000), (25, "spam " * 2500 + prose(27, 30)), (26, passage.split()[0]),
    ]
    rows = docs.select("doc_id", "text", "rid").union(
        spark.createDataFrame([(i, t, "x") for i, t in more], "doc_id long, text string, rid string")
    )
    got = {r.doc_id: r for r in substring_dedup.repeated(rows).collect()}
    assert set(got) == {r[0] for r in ROWS if r[0]} | {i for i, _ in more}
    assert got[20].passages == "100:180" and got[21].passages == "30:110" and got[22].passages == "60:140"
    assert got[20].class_id == got[21].class_id == got[22].class_id == 20
    assert got[23].n_links == 0 and got[23].passages == "" and got[26].n_links == 0
    assert got[24].partners == [25] and got[25].partners == [24]
    assert (got[3].rid, got[2].class_id, got[9].class_id) == (1, 1, 8)
    assert got[5].n_links == got[6].n_links == got[7].n_links == 0
    assert substring_dedup.repeated(rows.limit(0)).collect() == []


def test_fuzzy_passages_are_found(spark):
    """Pairs of documents with a passage in which words are substituted at random, its ends
    excepted: at least 0.9 of them link, at every length and similarity."""
    rng, rows, cases = random.Random(12), [], []
    for size in (50, 80, 120):
        for equal in (0.8, 0.85, 0.9):
            for _ in range(40):
                words = prose(rng.randrange(10**9), size).split()
                other = list(words)
                for i in rng.sample(range(1, size - 1), round(size * (1 - equal))):
                    other[i] += "x"
                for text in (words, other):
                    around = prose(rng.randrange(10**9), 90).split()
                    rows.append((len(rows), " ".join(around[:40] + text + around[40:])))
                cases.append((size, equal, len(rows) - 2))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    linked = {r.doc_id: r.n_links for r in substring_dedup.repeated(docs).collect()}
    found = defaultdict(list)
    for size, equal, d in cases:
        found[size, equal].append(linked[d] > 0 and linked[d + 1] > 0)
    assert {c: sum(f) / len(f) for c, f in found.items() if sum(f) < 0.9 * len(f)} == {}


def test_no_pair_of_passages_is_left_out(spark):
    """Every fifth word replaced, and documents that share their passages with others than the
    first document of a seed."""
    rng, rows = random.Random(23), []
    fresh = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    passage = fresh(50)
    edited = [w if i % 5 != 2 else "x" + w for i, w in enumerate(passage)]
    rows += [(1, fresh(40) + passage + fresh(40)), (2, fresh(30) + edited + fresh(60))]
    # document 10 has short pieces of both passages, 11 and 12 as well as 13 and 14 have them whole
    left, right = fresh(60), fresh(60)
    pieces = [x for k in range(0, 60, 12) for p in (left, right) for x in p[k : k + 11] + fresh(30)]
    rows.append((10, pieces))
    rows += [(i, fresh(20) + (left if i < 13 else right) + fresh(20)) for i in (11, 12, 13, 14)]
    # members of a group that have more and more of their words replaced
    long = fresh(80)
    for i in range(12):
        rows.append((20 + i, [f"y{i}" if j % 6 == i % 6 and j < 12 * i else w for j, w in enumerate(long)]))
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string").repartition(3)
    got = {r.doc_id: set(r.partners) for r in substring_dedup.repeated(docs).collect()}
    hashed = {i: next(flat.words([" ".join(w)])) for i, w in rows}
    words = {i: (h >> np.uint64(32)).astype(np.uint32).view(np.int32) for i, h in hashed.items()}
    expected = {i: {j for j in words if i != j and substring_dedup.passages(words[min(i, j)], words[max(i, j)], 50, 0.8)} for i in words}
    assert expected[1] == {2} and expected[11] == {12} and expected[13] == {14} and len(expected[20]) > 6
    assert got == expected


def test_passages_of_words_that_come_again(spark, monkeypatch):
    """All copies of a passage, one amid pieces of itself, and all words of a repeated one."""
    rng = random.Random(24)
    fresh = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    copied, whole = fresh(60), fresh(60)
    pieces = lambda: [x for k in range(52, -1, -4) for x in whole[k : k + 8] + fresh(20)]
    edited = [w if i % 9 != 4 else "x" + w for i, w in enumerate(copied[:30] + copied[33:])]
    before = pieces()
    rows = [
        (1, fresh(40) + copied + fresh(40)),
        (2, fresh(20) + copied + fresh(30) + edited + fresh(33) + copied + fresh(5)),
        (3, fresh(15) + whole + fresh(15)),
        (4, before + whole + fresh(3) + pieces()),
        (5, fresh(30) + ["spam"] * 60 + fresh(30)),
        (6, fresh(10) + ["spam"] * 200 + fresh(10)),
    ]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.partners, r.passages) for r in substring_dedup.repeated(docs).collect()}
    n = len(before)
    assert got == {
        1: ([2], "40:100"), 2: ([1], "20:80,110:167,200:260"), 3: ([4], "15:75"), 4: ([3], f"{n}:{n + 60}"),
        5: ([6], "30:90"), 6: ([5], "10:210"),
    }
    hashed = [(h >> np.uint64(32)).astype(np.uint32).view(np.int32) for h in flat.words([" ".join(w) for _, w in rows])]
    found = [sorted(substring_dedup.passages(hashed[k], hashed[k + 1], 50, 0.8)) for k in (0, 2, 4)]
    monkeypatch.setattr(substring_dedup, "MATCHES", 500)
    assert found == [sorted(substring_dedup.passages(hashed[k], hashed[k + 1], 50, 0.8)) for k in (0, 2, 4)]


def test_passages_write_little(spark, monkeypatch):
    """Words that come once are not written, and a text is sent once for all its pairs."""
    written, keep = {}, Staging.keep

    def counted(self, df, label):
        table = keep(self, df, label)
        sizes = [os.path.getsize(f.removeprefix("file://")) for f in table.inputFiles()]
        written.setdefault(label, (sum(sizes), table.count()))
        return table

    monkeypatch.setattr(Staging, "keep", counted)
    rng = random.Random(41)
    fresh = lambda n: " ".join(f"w{rng.randrange(10**9)}" for _ in range(n))
    shared = fresh(60)
    rows = [(i, f"{fresh(500)} {shared} {fresh(500)}" if i < 40 else fresh(1000)) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    got = {r.doc_id: r.n_links for r in substring_dedup.repeated(docs).collect()}
    assert got == {i: 39 * (i < 40) for i in range(400)}
    assert sum(size for size, _ in written.values()) < sum(len(t) for _, t in rows) / 4
    assert written["pairs"][1] == 40 * 39 // 2 and written["sent"][1] == 40


def test_passages_of_many_rounds(spark, monkeypatch):
    """Texts that go to their tiles in rounds meet the same partners."""
    rng = random.Random(42)
    fresh = lambda n: " ".join(f"w{rng.randrange(10**9)}" for _ in range(n))
    shared = [fresh(60) for _ in range(6)]
    rows = [(i, f"{fresh(20)} {shared[i % 6]} {fresh(20)} {shared[i // 5 % 6]}") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    monkeypatch.setattr(substring_dedup, "GROUP_WORDS", 1000)
    monkeypatch.setattr(substring_dedup, "ROUND", 1)
    got = {r.doc_id: set(r.partners) for r in substring_dedup.repeated(docs).collect()}
    has = {i: {i % 6, i // 5 % 6} for i, _ in rows}
    assert got == {i: {j for j in has if j != i and has[i] & has[j]} for i in has}


def test_passages_are_as_similar_as_they_say():
    """Insertions, deletions and substitutions, and stretches just below the similarity."""
    rng = random.Random(3)
    for case in range(60):
        vocabulary = np.arange(1, 4000)
        core = [rng.choice(vocabulary) for _ in range(rng.choice([60, 90, 150]))]
        other = []
        for i, w in enumerate(core):
            kind = rng.random() if 0 < i < len(core) - 1 else 1
            other += [] if kind < 0.02 else [w, 5000 + i] if kind < 0.04 else [6000 + i] if kind < case % 4 * 0.1 else [w]
        a = np.array([rng.choice(vocabulary) for _ in range(70)] + core + [rng.choice(vocabulary) for _ in range(70)], np.int32)
        b = np.array([7000 + i for i in range(30)] + other + [8000 + i for i in range(80)], np.int32)
        for a0, a1, b0, b1, equal in substring_dedup.passages(a, b, 50, 0.8):
            assert min(a1 - a0, b1 - b0) >= 50 and equal >= 0.8 * max(a1 - a0, b1 - b0)
            x, y = a[a0:a1].tolist(), b[b0:b1].tolist()
            row = [0] * (len(y) + 1)
            for u in x:
                last = 0
                for t, v in enumerate(y, 1):
                    last, row[t] = row[t], last + 1 if u == v else max(row[t], row[t - 1])
            assert equal <= row[-1] and x[0] == y[0] and x[-1] == y[-1]
        if case % 4 == 0:
            assert substring_dedup.passages(a, b, 50, 0.8)


def test_exact_runs_are_all_found(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    words = {r.doc_id: re.findall(r"[^\x20\x09-\x0D]+", r.text.lower()) for r in rows}
    by = defaultdict(set)
    for w in words.values():
        for i in range(len(w) - 49):
            by[tuple(w[i : i + 50])].add(tuple(w))
    hot = {run for run, seen in by.items() if len(seen) > 1}
    expected = {d for d, w in words.items() if any(tuple(w[i : i + 50]) in hot for i in range(len(w) - 49))}
    found = queries.op5_substring_dedup(spark, sf_dir).where("n_links > 0").collect()
    assert expected and expected <= {r.doc_id for r in found}


def test_top_k(spark):
    rng = random.Random(4)
    rows = [(i, [float(rng.gauss(0, 1) * (1 + i % 7)) for _ in range(8)], "x") for i in range(300)]
    rows += [(400 + i, rows[50][1], "x") for i in range(6)] + [rows[50]]
    rows += [(500, None, "x"), (550, [1.0, None], "x"), (600, [float("nan")] * 8, "x"), (650, [float("inf")] * 8, "x"),
             (700, [], "x"), (750, [1.0, 2.0], "x"), (751, [2.0, 2.0], "x"), (None, [1.0] * 8, "x"), (800, [0.0] * 8, "x")]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>, v string").repartition(3)
    found = topk.top_k(topk.quantised(vectors), F.col("vec_id") % 50 == 0, 5).collect()
    whole = {
        i: np.floor(np.array(v) * 256).astype(int)
        for i, v, _ in rows if i is not None and v and None not in v and np.isfinite(v).all()
    }
    expected = set()
    for q in [i for i in whole if i % 50 == 0]:
        scored = sorted((-int(whole[q] @ p), i) for i, p in whole.items() if i != q and len(p) == len(whole[q]))
        expected |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:5])}
    assert {(r.query_id, r["rank"], r.vec_id, r.score) for r in found} == expected and len(found) == len(expected)
    assert topk.top_k(topk.quantised(vectors.limit(0)), F.col("vec_id") % 50 == 0).collect() == []


def test_top_k_pruning_is_exact():
    rng = np.random.default_rng(2)
    for _ in range(40):
        p = rng.integers(-300, 300, (200, 6))
        p = p[np.argsort(-np.sqrt((p**2).sum(axis=1)), kind="stable")]
        lengths = np.sqrt((p.astype(float) ** 2).sum(axis=1))
        q = p[rng.integers(200)] + rng.integers(-5, 5, 6)
        scores = p @ q
        least = float(np.sort(scores)[-5])
        kept = topk._candidates(q, float(np.sqrt((q**2).sum())), p, lengths, least)
        assert set(np.flatnonzero(scores >= least)) <= set(kept.tolist()) and len(kept) < 200


def test_top_k_meets_only_buckets_that_can_win(spark, monkeypatch):
    """Short vectors are far too short for any query: their buckets are in no pair, so never copied."""
    monkeypatch.setattr(topk, "BUCKET", 32)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 4)
    rng = np.random.default_rng(11)
    rows = [(i, (rng.normal(size=6) * (100 if i < 40 else 0.5)).tolist()) for i in range(400)]
    vectors = topk.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    pairs = []
    real = topk.reachable

    def watched(blocks, longest):
        found = real(blocks, longest)
        pairs.append((found.count(), blocks.count() * longest.count()))
        return found

    monkeypatch.setattr(topk, "reachable", watched)
    found = topk.top_k(vectors, F.col("vec_id") % 10 == 0, 5).collect()
    whole = {i: np.floor(np.array(v) * 256).astype(int) for i, v in rows}
    expected = set()
    for q in range(0, 400, 10):
        scored = sorted((-int(whole[q] @ p), i) for i, p in whole.items() if i != q)
        expected |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:5])}
    assert {(r.query_id, r["rank"], r.vec_id, r.score) for r in found} == expected
    met, possible = pairs[0]
    assert possible > 50 and met < possible / 4


BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def _base_spans(text: str) -> str:
    def luhn(digits):
        each = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
        return sum(x - 9 if x > 9 else x for x in each) % 10 == 0

    found = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if {
                "email": True,
                "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else True,
                "card": 13 <= len(digits) <= 19 and luhn(digits),
                "phone": 9 <= len(digits) <= 15,
            }[kind]:
                found.append(f"{kind}:{m.start()}:{m.end()}")
    return ",".join(found)


def test_personal_data(spark, docs, empty):
    rng = random.Random(11)
    parts = ["a.b@c.d", "x@y", "@", "1.2.3.4", "300.1.1.1", "001.2.3.004.5", "4111 1111 1111 1111", "4111111111111112",
             "+1 (137) 555-7713", "+12", " ", "\n", "é", "𝄞", "_", "-", ".", "7", 'token = "24be64439e3e49cf46b2d7c90f3"',
             "a@b@c.d-e.f", "+1((((", "mail"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(12))) for _ in range(400)]
    texts += ["a.b@c.d " * 2000, "9" * 60_000, "1 " * 20_000, "a" * 50_000 + "@b.c", "._" * 20_000]
    rows = docs.select("doc_id", "text", "base").union(
        spark.createDataFrame([(1000 + i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, base string")
    )
    found = pii.find(rows).select("doc_id", pii.told("base").alias("base"), pii.told("spans").alias("spans")).collect()
    expected = Counter((r.doc_id, _base_spans(r.text or "")) for r in rows.collect())
    assert Counter((r.doc_id, r.base) for r in found) == expected
    order = {k: i for i, k in enumerate(pii.KINDS)}
    for r in found:
        spans = [(order[k], int(a), int(b)) for k, a, b in (s.split(":") for s in r.spans.split(",") if s)]
        assert spans == sorted(spans) and set(filter(None, r.base.split(","))) <= set(r.spans.split(","))
    assert pii.find(empty).collect() == []


def test_disguised_personal_data(spark):
    """Contacts and numbers that no base pattern finds are added, ordinary ones are not."""
    rng, rows, planted = random.Random(21), [], {}

    def number(*sizes):
        return ["".join(str(rng.randrange(10)) for _ in range(n)) for n in sizes]

    for i in range(600):
        name, host = prose(9000 + i, 2).split()
        a, b, c = number(3, 3, 4)
        kind, span, right = [
            ("email", f"{name}@{host}.org", False), ("contact", f"{name} (at) {host} (dot) org", True),
            ("contact", f"{name}[at]{host}.com", True), ("number", f"{a}-{b}-{c}", True),
            ("phone", f"+1 ({a}) {b}-{c}", False), ("card", "4111.1111.1111.1111", True),
            ("contact", f"{name} @ {host}", False), ("number", "7" + "".join(number(9)), False),
        ][i % 8]
        before = prose(9700 + i, 6) + " "
        rows.append((i, f"{before}{span} {prose(9900 + i, 6)}"))
        planted[i] = (f"{'number' if kind == 'card' else kind}:{len(before)}:{len(before) + len(span)}", right)
    found = pii.find(spark.createDataFrame(rows, "doc_id long, text string"))
    added = {r.doc_id: r.spans for r in found.select("doc_id", pii.told("spans").alias("spans")).collect()}
    hits = [planted[i][0] in added[i].split(",") for i in planted if planted[i][1]]
    wrong = [added[i] for i in planted if i % 8 >= 6]
    assert sum(hits) >= 0.9 * len(hits) and sum(map(bool, wrong)) <= 0.1 * len(wrong)


def test_rare_generators_beside_many_numbers(spark, monkeypatch):
    """Few secrets beside many numbers reach their threshold, with a sample that is small."""
    monkeypatch.setattr(pii, "MOST_PROPOSALS", 300)
    rng = random.Random(31)
    rows = [(i, " ".join(str(rng.randrange(10**8, 10**9)) + " x" for _ in range(40))) for i in range(600)]
    key = "".join(rng.choice("0123456789abcdef") for _ in range(28))
    rows += [(1000 + i, f"{prose(5000 + i, 4)} token = {key[:-3]}{i + 100}") for i in range(20)]
    found = pii.find(spark.createDataFrame(rows, "doc_id long, text string"))
    spans = {r.doc_id: r.spans for r in found.select("doc_id", pii.told("spans").alias("spans")).collect()}
    assert sum("secret" in spans[1000 + i] for i in range(20)) >= 18


def test_line_dedup(spark, docs, empty):
    rows = [(100 + i, f"own {i}\n  Menu \nbody {i}\n\nMenu\t", None, f"s{i % 6}", 1) for i in range(12)]
    rows += [(200 + i, f"Rare\nown {i}", None, f"s{i % 3}", 1) for i in range(9)]
    rows += [(None, "Menu\nlast", None, None, 1), (300, "Menu", None, None, 1), (300, "Menu", None, None, 1)]
    every = docs.union(spark.createDataFrame(rows, DOC).select("*", *[F.lit("x").alias(c) for c in EXTRA]))
    clean = line_dedup.remove_boilerplate(every, min_sites=6, count="gone")
    got = defaultdict(list)
    for r in clean.collect():
        got[r.doc_id].append((r.text, r.gone))
    assert got[100] == [("own 0\n  Menu \nbody 0\n\nMenu\t", 0)]
    assert got[105] == [("own 5\nbody 5\n", 2)]
    assert got[200] == [("Rare\nown 0", 0)] and got[300] == [("", 1), ("", 1)]
    assert ("last", 1) in got[None] and got[5] == [(None, 0)] and got[8] == [(LONG, 0)]
    assert sum(map(len, got.values())) == len(ROWS) + len(rows)
    assert line_dedup.remove_boilerplate(every, min_sites=6).columns == every.columns
    kept = line_dedup.drop_boilerplate(every, min_sites=6)
    assert kept.columns == every.columns and kept.where("doc_id = 300").count() == 0
    assert kept.where("doc_id = 105").first().n_chars == len("own 5\nbody 5\n")
    assert kept.count() == len(ROWS) + len(rows) - 2
    assert line_dedup.remove_boilerplate(empty).collect() == []


@pytest.mark.parametrize("sites", range(20, 41, 4))
def test_spread_near_the_threshold_is_exact(spark, sites):
    rows = spark.range(sites * 3).select(
        F.col("id").alias("doc_id"), (F.col("id") % sites).cast("string").alias("source"), F.lit("line").alias("text")
    )
    assert line_dedup.boilerplate(rows, Staging(spark), min_sites=30).count() == (sites >= 30)


def test_decontamination(spark, docs, empty):
    item = prose(50, 40)
    edited = " ".join(["other", *item.split()[1:]])
    far = item.split()
    far[10], far[20], far[30] = "x1", "x2", "x3"
    rows = [
        (100, f"{prose(51, 30)} {item} {prose(52, 30)}"), (101, item.upper()), (102, f"{prose(53, 5)} {edited}"),
        (103, f"{prose(54, 9)} {' '.join(far)}"), (104, "short item here now"), (105, item + " " + item),
        (None, item), (106, item), (106, item), (107, f"{prose(55, 50)} {prose(56, 18)} {prose(57, 50)}"),
    ]
    every = docs.select("doc_id", "text", "words", "print").union(
        spark.createDataFrame([(i, t, "x", "x") for i, t in rows], "doc_id long, text string, words string, print string")
    )
    items = spark.createDataFrame(
        [(1, item, "x"), (1, item, "x"), (2, "Short item here now", "x"), (3, None, "x"), (4, " ", "x"), (None, prose(58, 30), "x"),
         (5, prose(56, 18), "x")],
        "item_id long, text string, size string",
    )
    got = {(r.doc_id, r.item_id): r.similarity for r in decontaminate.contaminated(every, items).collect()}
    assert set(got) == {(d, 1) for d in (100, 101, 102, 105, 106, None)} | {(104, 2), (107, 5)}
    assert got[100, 1] == got[101, 1] == got[106, 1] == 1.0

    def grams(w):
        return Counter(tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1)))

    def best(text, other):
        """The highest weighted Jaccard similarity of any window, cut at the text's end or not."""
        w, t, found = text.lower().split(), grams(other.lower().split()), 0.0
        size = len(other.split())
        for i in range(len(w)):
            own = grams(w[i : i + size])
            common = sum((own & t).values())
            found = max(found, common / (sum(own.values()) + sum(t.values()) - common))
        return found

    for d, text in rows:
        if (d, 1) in got:
            assert got[d, 1] == best(text, item), d
    kept = decontaminate.drop_contaminated(every, items)
    assert kept.columns == every.columns and kept.count() == every.count() - 8 + 0
    assert decontaminate.contaminated(empty, items).collect() == []
    assert decontaminate.contaminated(every, items.limit(0)).collect() == []
    with pytest.raises(ValueError):
        decontaminate.contaminated(every, items, 0.5)


def test_decontamination_of_reordered_passages(spark):
    """Swapped halves and moved sentences, against all windows in plain Python."""
    def grams(w):
        return Counter(" ".join(w[i : i + 5]) for i in range(max(len(w) - 4, 1)))

    items, rows = [], []
    for k in range(24):
        size = 44 + k
        w = prose(7000 + k, size).split()
        items.append((k, w))
        cut = (size // 2, 12)[k % 2]
        moved = (w[cut:] + w[:cut], w[:9] + w[9 + cut :] + w[9 : 9 + cut])[k // 2 % 2]
        rows.append((k, prose(7100 + k, 20).split() + moved + prose(7200 + k, (30, 0)[k // 4 % 2]).split()))
    expected = {}
    for (k, item), (_, doc) in zip(items, rows):
        m, best = grams(item), 0
        for s in range(len(doc)):
            n = grams(doc[s : s + len(item)])
            common = (m & n).total()
            best = max(best, common / (m.total() + n.total() - common))
        if best >= 0.8:
            expected[k] = best
    docs = spark.createDataFrame([(d, " ".join(w)) for d, w in rows], "doc_id long, text string")
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in items], "item_id long, text string")
    got = {r.doc_id: r.similarity for r in decontaminate.contaminated(docs, bench).collect()}
    assert len(expected) >= 12 and got == expected


def test_fingerprints_of_passages_at_the_threshold(spark):
    """Windows that just reach the similarity lie within the radius."""
    rng, rows = random.Random(13), []
    for size in (15, 25, 35, 45, 55):
        for _ in range(120):
            words = prose(rng.randrange(10**9), size).split()
            lost = (size - 4) // 9  # shingles that may go on either side
            at_end = rng.random() < 0.5
            other = prose(rng.randrange(10**9), lost).split() if lost else []
            window = words[: size - lost] + other if at_end else other + words[lost:]
            rows.append((size, words, window))
    frame = spark.createDataFrame(rows, "size int, words array<string>, other array<string>")
    frame = frame.withColumn("a", decontaminate._fingerprint("words")).withColumn("b", decontaminate._fingerprint("other"))
    bits = frame.select("size", F.bit_count(F.col("a").bitwiseXOR(F.col("b"))).alias("n")).collect()
    assert sum(r.n > decontaminate.RADIUS for r in bits) <= 0.005 * len(bits)
    # and blocks lose none of them
    shared = F.size(F.array_intersect(decontaminate._blocks("a"), decontaminate._blocks("b")))
    near = frame.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= decontaminate.RADIUS)
    assert near.where(shared == 0).count() == 0


def test_bounded_sample(spark):
    rows = spark.range(5000).select(F.col("id").alias("doc_id"))
    a, b = (sorted(r.doc_id for r in lowest(rows.repartition(n), 100, "doc_id").collect()) for n in (2, 7))
    assert a == b and len(a) == 100 and len(lowest(rows.limit(5), 100, "doc_id").collect()) == 5
