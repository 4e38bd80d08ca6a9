"""Periodic runs, embedding near-dedup and whitening against plain Python and numpy, and on
rows with nulls, empty and long values, ties, repeated rows, empty tables and clashing names."""

import random

import numpy as np
import pytest
from corpusloom.llm import embedding_dedup, queries, runs, whitening
from pyspark.sql import functions as F


def plain_runs(words):
    found = {}
    for period in range(1, len(words) // 4 + 1):
        i = 0
        while i + period < len(words):
            j = i
            while j + period < len(words) and words[j] == words[j + period]:
                j += 1
            if j + period - i >= max(6, 4 * period):
                found.setdefault((i, j + period - i), period)
            i = max(j, i + 1)
    listed = sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))
    gone = {i for s, n, q in listed for i in range(s + q, s + n)}
    return listed, " ".join(w for i, w in enumerate(words) if i not in gone)


def periodic_text(rng):
    words = [rng.choice("abcdefgh"[: rng.choice([1, 2, 3, 8])]) for _ in range(rng.randrange(60))]
    for _ in range(rng.randrange(4)):
        part = [rng.choice("abcd") for _ in range(rng.randrange(1, 7))] * rng.randrange(2, 9)
        place = rng.randrange(len(words) + 1)
        words[place:place] = part[: rng.randrange(len(part)) + 1]
    return words * rng.choice([1, 1, 1, 3, 5])


def test_runs_equal_plain_python():
    rng = random.Random(5)
    for _ in range(300):
        texts = [periodic_text(rng) for _ in range(rng.randrange(1, 6))]
        collapsed, counts, *numbers = runs._text_runs([" \n".join(t) for t in texts])
        listed = list(zip(*(x.tolist() for x in numbers)))
        for text, words, n in zip(collapsed, texts, counts.tolist()):
            assert (listed[:n], text) == plain_runs(words)
            listed = listed[n:]


@pytest.mark.parametrize("words", [
    ["a"] * 5000, ["a", "b"] * 3000 + ["c"], "abaababaabaab" * 200, ["x"] + ["a", "a", "b"] * 700 + ["a", "a"] * 9,
], ids=["one word", "two words", "nested", "mixed"])
def test_long_runs(words):
    collapsed, _, *numbers = runs._text_runs([" ".join(words)])
    assert (list(zip(*(x.tolist() for x in numbers))), collapsed[0]) == plain_runs(list(words))


def test_symbols_of_the_grammar_are_few_in_repeated_text():
    symbols = np.tile(np.arange(8), 4096)
    grammar = runs.Grammar(symbols, np.zeros(len(symbols), np.int64))
    assert len(grammar.nodes) < 64
    assert (grammar.nodes[:, 2] > grammar.nodes[:, 1]).all() and (grammar.nodes[:, 1] > grammar.nodes[:, 0]).all()


def test_runs_of_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(300_000)) + " end" * 7
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "a a a a a a"), (4, "a a a a a a"), (None, "A a A a A a A a"),
            (5, "a a a a a"), (6, "  " * 6), (7, long)]
    docs = spark.createDataFrame([(i, t, t, 1) for i, t in rows], "doc_id long, text string, collapsed string, _text int")
    found = runs.periodic_runs(docs)
    assert found.columns == ["doc_id", "_text", "runs", "collapsed"]
    told = sorted((r["doc_id"] or 0, [tuple(x) for x in r["runs"]], r["collapsed"]) for r in found.where("doc_id is null or doc_id < 7").collect())
    assert told == [
        (0, [(0, 8, 2)], "A a"), (1, [], ""), (2, [], ""), (3, [], ""), (4, [(0, 6, 1)], "a"), (4, [(0, 6, 1)], "a"),
        (5, [], "a a a a a"), (6, [(0, 6, 1)], " "),
    ]
    last = found.where("doc_id = 7").first()
    assert [tuple(x) for x in last["runs"]] == [(300_000, 7, 1)]
    assert last["collapsed"] == long[: -len(" end" * 6)]
    assert runs.periodic_runs(docs.limit(0)).count() == 0


def test_runs_query_of_planted_periods(spark, sf_dir):
    planted = queries.with_periods(spark.read.parquet(f"{sf_dir}/documents.parquet")).collect()
    told = {r["doc_id"]: r for r in queries.op11_periodic_runs(spark, sf_dir).collect()}
    assert len(told) == len(planted)
    some = 0
    for doc_id, text in planted:
        words = runs.WORD.findall(text or "")
        if len(words) < 1500:
            listed, _ = plain_runs(words)
            assert told[doc_id]["n_runs"] == len(listed)
            if listed:
                some += 1
                best = max(listed, key=lambda r: (r[1] / r[2], -r[0], -r[2]))
                assert (told[doc_id]["start"], told[doc_id]["length"], told[doc_id]["period"]) == best
                assert told[doc_id]["exponent_milli"] == 1000 * best[1] // best[2]
            else:
                assert told[doc_id]["start"] is None and told[doc_id]["exponent_milli"] is None
    assert some


def plain_links(rows, cosine=0.9):
    """Links and components of valid rows ``(vec_id, vector)`` by all pairs."""
    x = np.array([v for _, v in rows], float)
    u = x / np.linalg.norm(x, axis=1)[:, None]
    near = u @ u.T >= cosine
    np.fill_diagonal(near, False)
    root = [i for i, _ in rows]
    for _ in rows:
        root = [min([root[i], *(root[j] for j in np.flatnonzero(near[i]))]) for i in range(len(rows))]
    return [(i, int(near[k].sum()), root[k]) for k, (i, _) in enumerate(rows)]


def around(rng, centre, cosine):
    other = rng.standard_normal(len(centre))
    other -= other @ centre * centre
    return cosine * centre + np.sqrt(1 - cosine**2) * other / np.linalg.norm(other)


def unit(rng, dim):
    v = rng.standard_normal(dim)
    return v / np.linalg.norm(v)


VECTORS = "vec_id long, embedding array<double>, n long, key long, size int, cid string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], 1, 2, 3, "x") for i, v in rows], VECTORS)


@pytest.mark.parametrize("block", [8, 1024])
def test_links_equal_all_pairs(spark, block, monkeypatch):
    rng = np.random.default_rng(11)
    rows = [(1000 + i, unit(rng, 24)) for i in range(150)]
    hub = unit(rng, 24)
    rows += [(i, around(rng, hub, rng.uniform(0.93, 0.999))) for i in range(100)]  # one crowded bucket
    rows += [(500 + i, 3.0 * hub) for i in range(30)] + [(700 + i, around(rng, rows[i][1], 0.93)) for i in range(60)]
    monkeypatch.setattr(embedding_dedup, "BLOCK", block)
    found = embedding_dedup.near_duplicates(vectors(spark, rows)).collect()
    assert sorted((r[0], r[1], r[2]) for r in found) == sorted(plain_links(rows))
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in found)


def test_recall_at_the_threshold(spark):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(500):
        v = unit(rng, 64)
        rows += [(2 * i, v), (2 * i + 1, around(rng, v, 0.9005)), (10_000 + i, around(rng, v, 0.8995))]
    links = {r["vec_id"]: r["n_links"] for r in embedding_dedup.near_duplicates(vectors(spark, rows)).collect()}
    wanted = dict((i, n) for i, n, _ in plain_links(rows))
    assert sum(links.values()) >= 0.99 * sum(wanted.values())
    assert all(links[i] <= wanted[i] for i in wanted)


def test_links_of_odd_vectors(spark):
    rows = [(1, [1, 0, 0]), (2, [2, 0, 0]), (2, [0, 1, 0]), (3, [0, 0, 0]), (4, None), (5, []), (6, [1, None, 0]),
            (7, [float("nan"), 1, 0]), (8, [float("inf"), 1, 0]), (9, [1, 0]), (10, [1e300, 1e300, 0]), (11, [1e-300, 1e-300, 0]),
            (None, [1, 0, 0]), (12, [0, 5]), (12, [0, 5]), (13, [-1, 0, 0]), (None, [0, 0, 7])]
    found = embedding_dedup.near_duplicates(vectors(spark, rows)).collect()
    assert sorted(found, key=lambda r: (r[0] is None, r[0] or 0, r[2] or 0)) == [
        (1, 2, 1, True), (2, 2, 1, False), (2, 0, 2, True), (3, 0, 3, True), (4, 0, 4, True), (5, 0, 5, True), (6, 0, 6, True),
        (7, 0, 7, True), (8, 0, 8, True), (9, 0, 9, True), (10, 1, 10, True), (11, 1, 10, False), (12, 1, 12, True),
        (12, 1, 12, True), (13, 0, 13, True), (None, 0, None, False), (None, 2, 1, False),
    ]
    assert embedding_dedup.near_duplicates(vectors(spark, rows).limit(0)).count() == 0


def test_hadamard_keeps_lengths_and_inverts():
    x = np.random.default_rng(0).standard_normal((5, 64))
    assert np.allclose(embedding_dedup.hadamard(embedding_dedup.hadamard(x)), x)
    assert np.allclose(np.linalg.norm(embedding_dedup.hadamard(x), axis=1), np.linalg.norm(x, axis=1))


@pytest.mark.parametrize("dim, k", [(1, 3), (9, 4), (64, 16), (300, 16)])
def test_eigenpairs(dim, k):
    x = np.random.default_rng(dim).standard_normal((2000, dim)) * np.linspace(1, 1.4, dim)
    v = np.cov(x.T, bias=True).reshape(dim, dim)
    values, found = whitening.jacobi_davidson(lambda block: v @ block, dim, k)
    expected, other = (y[..., ::-1][..., :k] for y in np.linalg.eigh(v))
    assert np.abs(values - expected).max() <= 1e-13 * expected[0]
    assert np.abs(np.abs((found * other).sum(axis=0)) - 1).max() < 1e-12


def test_equal_eigenvalues():
    q = np.linalg.qr(np.random.default_rng(1).standard_normal((40, 40)))[0]
    e = np.repeat([5.0, 3.0, 1.0, 0.0], 10)
    values, found = whitening.jacobi_davidson(lambda block: q @ (e[:, None] * (q.T @ block)), 40, 15)
    assert np.allclose(values, e[:15], atol=1e-12)
    assert np.allclose(found.T @ found, np.eye(15), atol=1e-12)


def plain_whitening(x, k):
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    d = (n * fit - sums) / n
    v = d.T @ d / n
    e, u = (y[..., ::-1][..., :k] for y in np.linalg.eigh(v))
    far = n * x - sums
    return n, (far * far).sum(axis=1), far / n @ u / np.sqrt(e), e / np.trace(v)


def test_whitening_equals_numpy(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(whitening, "BLOCK", 100)
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    table = table.union(table.limit(20))  # repeated rows are projected, and fitted once
    rows = sorted(table.select("vec_id", "embedding").distinct().collect())
    n, deviation, whitened, explained = plain_whitening(np.floor(64 * np.array([r[1] for r in rows], float)).astype(np.int64) + 1_000_000, 16)
    found = sorted(whitening.whiten(whitening.whole_entries(table)).collect(), key=lambda r: (r["vec_id"], r["component"]))
    assert {r["n"] for r in found} == {n} and len(found) == 16 * (len(rows) + 20)
    found = sorted({(r["vec_id"], r["component"]): r for r in found}.values(), key=lambda r: (r["vec_id"], r["component"]))
    assert [r["deviation"] for r in found[::16]] == deviation.tolist()
    got = np.array([r["whitened"] for r in found]).reshape(-1, 16)
    assert np.abs(got * np.sign((got * whitened).sum(axis=0)) - whitened).max() < 1e-9
    assert np.allclose([r["explained"] for r in found[:16]], explained, rtol=1e-12)
    assert {r["component"] for r in found} == set(range(1, 17)) and found[0]["identity_error"] < 1e-12


def test_whitening_of_odd_rows(spark):
    good = [(i, [float(i % 5), float(i * i % 7), 2.0]) for i in range(40)]
    odd = [(100, None), (101, [1.0, None, 2.0]), (102, [float("nan"), 0.0, 0.0]), (103, [float("-inf"), 0.0, 0.0]), (104, []),
           (None, [1.0, 1.0, 2.0]), (105, [4.0]), (106, [1e300, 0.0]), (107, [-1e300, 0.0])]
    found = whitening.whiten(whitening.whole_entries(vectors(spark, good + odd))).collect()
    by_id = {}
    for r in found:
        by_id.setdefault(r["vec_id"], []).append(r)
    assert set(by_id) == {*range(40), None, 106, 107}  # nothing varies along a single vector
    assert all(len(by_id[i]) == 2 for i in (*range(40), None))  # the third dimension is constant
    assert all(r["identity_error"] < 1e-12 for r in found)
    assert [(r["component"], r["deviation"]) for r in by_id[106]] == [(1, (1 << 63) - 1)]
    assert sorted(round(by_id[i][0]["whitened"], 12) for i in (106, 107)) == [-1, 1]
    assert whitening.whiten(whitening.whole_entries(vectors(spark, good).limit(0))).count() == 0
    x = whitening.whole_entries(vectors(spark, [(1, [-0.001, 0.5])])).first()["x"]
    assert x == [999_999, 1_000_032]


def test_new_query_columns(spark, sf_dir):
    assert queries.op11_periodic_runs(spark, sf_dir).dtypes == [
        ("doc_id", "bigint"), ("n_runs", "bigint"), ("start", "bigint"), ("length", "bigint"), ("period", "bigint"),
        ("exponent_milli", "bigint"), ("runs_sha256", "string"), ("collapsed_sha256", "string"),
    ]
    found = queries.op12_embedding_dedup(spark, sf_dir)
    assert found.dtypes == [("vec_id", "bigint"), ("n_links", "bigint"), ("component_id", "bigint"), ("kept", "boolean")]
    white = queries.op13_whitening(spark, sf_dir)
    assert [f"{n} {t}".replace("bigint", "long") for n, t in white.dtypes] == whitening.WHITENED.split(", ")
    assert white.where(F.col("whitened").isNull()).count() == 0
