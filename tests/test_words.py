"""Counts, vocabulary and TF-IDF on a five-document corpus."""

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import text as tx
from corpusloom.functions.shingles import shingle_counter
from corpusloom.operators import language as lg
from corpusloom.operators import words as ops

DOCS = [
    (1, "cat cat dog common", "en"),
    (2, "dog bird common", "en"),
    (3, "common common common", "en"),
    (4, "the of 42 x", "en"),
    (5, None, "en"),
]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def terms(spark):
    return ops.doc_terms(spark.createDataFrame(DOCS, "doc_id bigint, text string, lang string"))


@pytest.fixture(scope="module")
def stats(terms):
    return ops.corpus_word_stats(ops.word_count_by_doc(terms))


def test_word_count(terms):
    rows = {(r.doc_id, r.term): r.n for r in ops.word_count_by_doc(terms).collect()}
    assert rows[(1, "cat")] == 2 and rows[(3, "common")] == 3
    assert {d for d, _ in rows} == {1, 2, 3}  # no empty term, no empty document


def test_stats_and_totals(terms, stats):
    rows = {r.term: (r.documents, r["count"]) for r in stats.collect()}
    assert rows == {"cat": (1, 2), "dog": (2, 2), "bird": (1, 1), "common": (3, 5)}
    assert ops.total_docs(terms).first()[0] == 3
    assert ops.total_docs(terms, "2n_plus_1").first()[0] == 7
    with pytest.raises(ValueError):
        ops.total_docs(terms, "other")
    counted = ops.word_count_by_doc(terms).agg(F.sum("n")).first()[0]
    assert counted == sum(c for _, c in rows.values())


def test_vocabulary_cuts_by_size_before_min_count(stats):
    words = lambda **k: [r.term for r in ops.vocabulary(stats, **k).orderBy(F.desc("count"), "term").collect()]
    assert words(min_count=2) == ["common", "cat", "dog"]
    assert words(size=2, min_count=1) == ["common", "cat"]
    assert words(size=1, min_count=6) == []


def test_vocabulary_with_total_is_the_same_vocabulary(terms, stats):
    for size, least in ((6000, 1), (2, 1), (6000, 2), (3, 5)):
        plain = {r.term for r in ops.vocabulary(stats, size, least).collect()}
        rows = ops.vocabulary_with_total(terms, size, least).collect()
        assert {r.term for r in rows} == plain
        assert {r.total_docs for r in rows} <= {3}


def test_tfidf(terms):
    vocab = ops.vocabulary_with_total(terms, min_count=1)
    rows = {(r.doc_id, r.term): r for r in ops.tfidf(terms, vocab).collect()}
    cat = rows[(1, "cat")]
    assert cat.tf == pytest.approx(2 / 3) and cat.idf == pytest.approx(math.log10(3))
    assert rows[(3, "common")].tfidf == 0.0  # a term of every document
    compat = {(r.doc_id, r.term): r for r in ops.tfidf(terms, vocab, True, "2n_plus_1").collect()}
    assert compat[(1, "cat")].idf == pytest.approx(math.log10(7), abs=1e-6)


def test_tf_divides_by_terms_outside_the_vocabulary_too(terms):
    rows = ops.tfidf(terms, ops.vocabulary_with_total(terms, size=1, min_count=1)).collect()
    assert {(r.doc_id, round(r.tf, 6)) for r in rows} == {(1, 0.333333), (2, 0.333333), (3, 3.0)}


def test_top_terms(terms):
    scores = ops.tfidf(terms, ops.vocabulary_with_total(terms, min_count=1))
    top = {(r.doc_id, r.rank): r.term for r in ops.top_terms(scores, 2).collect()}
    assert top[(1, 1)] == "cat" and top[(2, 1)] == "bird" and top[(3, 1)] == "common"
    assert (1, 3) not in top


def test_dense_lines(terms):
    vocab = ops.vocabulary_with_total(terms, min_count=2)
    assert ops.header_line(vocab).first()[0] == "path\tcommon\tcat\tdog"
    lines = {r.doc_id: r.line.split("\t") for r in ops.dense_lines(terms, vocab).collect()}
    assert lines[3] == ["3", "0.0", "0.0", "0.0"]
    assert float(lines[1][2]) == pytest.approx(2 / 3 * math.log10(3), abs=1e-15) and len(lines[2]) == 4


def test_idf_natural(terms, stats):
    rows = ops.idf_natural(ops.word_count_by_doc(terms), ops.total_docs(terms)).collect()
    found = {r.term: r.idf for r in rows}
    assert found["common"] == pytest.approx(0.0) and found["cat"] == pytest.approx(math.log(2))


def test_stem_table_overrides_rule(spark):
    counts = spark.createDataFrame([("en", "mice", 1, 2), ("en", "cats", 1, 1)], "lang string, term string, documents bigint, count bigint")
    stems = spark.createDataFrame([("en", "mice", "mouse")], "lang string, term string, stem string")
    assert {r.term: r.stem for r in ops.stem_counts(counts, stems).collect()} == {"mice": "mouse", "cats": "cats"}
    assert {r.term: r.stem for r in ops.stem_counts(counts).collect()} == {"mice": "mice", "cats": "cat"}


def test_language_on_held_out_rows(spark):
    train = [
        (1, "the house and the garden with the other thing", "en"),
        (2, "la maison et le jardin avec les autres choses", "fr"),
        (3, "das haus und der garten mit den anderen sachen", "de"),
    ]
    docs = spark.createDataFrame(train, "doc_id bigint, text string, lang string")
    profiles = lg.language_profiles(docs)
    asked = spark.createDataFrame(
        [(1, "the weather and the other house"), (2, "le temps et les maisons"), (3, "der andere garten"), (4, "12 34")],
        "doc_id bigint, text string",
    )
    got = {r.doc_id: r.detected for r in lg.detect_language(asked, profiles, ["de", "en", "fr"]).collect()}
    assert got == {1: "en", 2: "fr", 3: "de", 4: None}


def test_trigrams_are_counted_as_numbers(spark):
    texts = [
        (1, "The house, the garden", "en"), (2, "la maison", "fr"), (2, "la maison", "fr"), (3, "\u4e2d\U0001f600\U00020000\u4e2d", "zh"),
        (4, "12 34", "en"), (5, "", "fr"), (6, None, "fr"), (7, "no label", None), (None, "the garden " * 30_000, "en"),
    ]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string, lang string")
    profiles = lg.language_profiles(docs)
    # sorted in batches before they leave a task, not as strings in each row
    assert "MapInArrow" in plan(profiles) and "sort_array" not in plan(profiles)
    grams = lambda padded: Counter(padded[i : i + 3] for i in range(len(padded) - 2))
    letters = lambda text: "".join(ch if ch.isalpha() else " " for ch in text.lower()).split()
    counted = [(i, lang, grams(f" {' '.join(letters(text))} ")) for i, text, lang in texts if text is not None]
    want, totals = Counter(), Counter()
    for _, lang, held in counted:
        if lang is not None:
            want.update({(lang, gram): n for gram, n in held.items()})
            totals[lang] += held.total()
    assert {(r.lang, r.gram): r.n for r in profiles.collect()} == dict(want)

    def best(held):
        weights = {code: [n * math.log((want[code, gram] + 1) / (totals[code] + 1)) for gram, n in held.items()] for code in totals}
        return min((-math.fsum(w) / held.total(), code) for code, w in weights.items())

    found = lg.detect_language(docs, profiles, ["en", "fr", "zh"])
    assert "sort_array" not in plan(found) and "BroadcastHashJoin" in plan(found)
    got = {r.doc_id: (r.detected, r.score) for r in found.collect()}
    # an empty text has no letters, nor has one of digits; a null text is left out
    for i, _, held in counted:
        assert got[i] == ((None, None) if not held else (best(held)[1], pytest.approx(-best(held)[0])))
    assert got.keys() == {i for i, *_ in counted}


def test_language_in_the_row(spark):
    train = [
        (1, "the house and the garden with the other thing", "en"),
        (2, "la maison et le jardin avec les autres choses", "fr"),
        (3, "das haus und der garten mit den anderen sachen", "de"),
        (4, "nobody told", None), (5, None, "en"), (6, "", "fr"),
    ]
    docs = spark.createDataFrame(train, "doc_id bigint, text string, lang string")
    profiles = lg.hashed_profiles(docs)
    totals = {r.lang: (r.total, r.n) for r in profiles.groupBy("lang", "total").agg({"n": "sum"}).toDF("lang", "total", "n").collect()}
    # a padded text has as many trigrams as letters and inner blanks
    assert totals == {code: (len(text), len(text)) for _, text, code in train[:3]}
    asked = spark.createDataFrame(
        [(1, "the weather and the other house"), (1, "the weather and the other house"), (2, "le temps et les maisons"),
         (3, "der andere garten"), (4, "12 34"), (5, None), (6, ""), (7, "the house " * 20_000), (8, "\u4e2d\U0001f600\U00020000")],
        "doc_id bigint, text string",
    ).withColumn("scores", F.lit("kept out"))
    found = lg.detect_in_row(asked, profiles, ["fr", "de", "en", "xx"])
    got = sorted((r.doc_id, r.detected) for r in found.collect())
    assert [g for g in got if g[0] != 8] == [(1, "en"), (1, "en"), (2, "fr"), (3, "de"), (4, None), (6, None), (7, "en")]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan and "Generate" not in plan
    none = lg.detect_in_row(asked, lg.hashed_profiles(docs.limit(0)), ["en"]).collect()
    assert len(none) == 8 and not any(r.detected for r in none)


def test_language_buckets_and_weights(spark):
    """Against counts made with plain Python."""
    text = "abc abcd"
    grams = [f" {text} "[i : i + 3] for i in range(len(text))]
    places = [(ord(g[0]) * lg.FIRST + ord(g[1]) * lg.SECOND + ord(g[2])) % lg.BUCKETS for g in grams]
    docs = spark.createDataFrame([(1, text, "en"), (2, "abx", "en")], "doc_id bigint, text string, lang string")
    profiles = lg.hashed_profiles(docs.where("doc_id = 1"))
    counts = {r.bucket: r.n for r in profiles.collect()}
    assert counts == {p: places.count(p) for p in places}
    [row] = lg.detect_in_row(docs.where("doc_id = 1"), profiles, ["en"]).collect()
    assert row.score == pytest.approx(sum(math.log((counts[p] + 1) / (len(text) + 1)) for p in places) / len(places))


def test_one_document_with_most_tokens(spark):
    rows = [(i, "tiny word", "en") for i in range(50)] + [(99, "huge " * 50_000 + "word", "en")]
    terms = ops.doc_terms(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))
    stats = {r.term: (r.documents, r["count"]) for r in ops.corpus_word_stats(ops.word_count_by_doc(terms)).collect()}
    assert stats == {"tiny": (50, 50), "word": (51, 51), "huge": (1, 50_000)}


def test_shingles_are_counted_once_a_block(spark):
    """The same as shingles and counts of each row, without a row for each document and shingle."""
    texts = ["a b a b a b c", "a b", "b", "", "c a b a", None, "é ü é ü", "a b a b a b c", "a b c d e f g h i j"]
    df = spark.createDataFrame([(t.split() if t is not None else None,) for t in texts], "tokens array<string>").coalesce(1)
    by_row = df.select(F.explode(tx.count_terms(tx.shingles(F.col("tokens")))).alias("e")).select("e.*")
    expected = {tuple(r) for r in ops.corpus_word_stats(by_row).collect()}
    found = ops.shingle_counts(df)
    rows = found.collect()
    assert {tuple(r) for r in ops.corpus_word_stats(found, "documents").collect()} == expected
    assert len(rows) == len({r.term for r in rows}) == len(expected)
    assert ops.shingle_counts(df.limit(0)).collect() == []
    # lists cut into blocks, and only the lengths asked for
    run = shingle_counter(2, 2, 5)
    cut = df.mapInArrow(run, "term string, documents long, n long").groupBy("term").agg(F.sum("documents"), F.sum("n"))
    assert {tuple(r) for r in cut.collect()} == {e for e in expected if e[0].count(" ") == 1}


def test_shingle_stats_makes_shingles_in_batches(spark, sf_dir):
    from corpusloom.catalogue import all_queries

    told = plan(all_queries()["shingle_stats"](spark, sf_dir))
    assert "MapInArrow" in told and "sort_array" not in told
    # rows are dealt by term as the batches give them, and folded only then
    assert told.count("Exchange") == 1 and told.index("partial_sum") < told.index("Exchange")
