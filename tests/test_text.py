"""Token rules on hand-written texts."""

import pytest
from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import functions as F

from corpusloom.functions import stopwords
from corpusloom.functions import text as tx
from corpusloom.functions.rows import expand, once


def tokens_of(spark, text, lang, keep=None):
    df = spark.createDataFrame([(text, lang)], "text string, lang string")
    tokens = tx.tokenise(F.col("text"), F.col("lang"))
    if keep is not None:
        tokens = F.filter(tokens, keep)
    return df.select(tokens.alias("t")).first()["t"]


@pytest.mark.parametrize(
    "text,lang,expected",
    [
        ("plan_qualite.pdf", "fr", ["plan", "qualite"]),
        ("L'été, l’eau", "fr", ["été", "eau"]),
        ("The cat's 42 hats", "en", ["the", "cat", "42", "hats"]),
        ("x 7b", "en", ["x", "7b"]),
        ("Straße", "de", ["straße"]),
        ("aujourd'hui jusqu'ici", "fr", ["aujourd'hui", "ici"]),
        ("foo.pdfbar", "en", ["foobar"]),
        ("", "en", []),
        ("  \n ", "en", []),
    ],
)
def test_tokens(spark, text, lang, expected):
    assert tokens_of(spark, text, lang) == expected


def test_filters(spark):
    assert tokens_of(spark, "The cat's 42 hats", "en", tx.not_a_number) == ["the", "cat", "hats"]
    both = tx.every(tx.length_between(), tx.has_ascii_letter)
    assert tokens_of(spark, "x 7b 42 éé", "en", both) == ["7b"]
    assert tokens_of(spark, "éé", "fr", tx.not_a_number) == ["éé"]
    assert tokens_of(spark, "abc ab1", "en", tx.whole_match("[a-z]+")) == ["abc"]


def test_stopwords_by_language(spark):
    rule = tx.not_stopword(F.col("lang"))
    assert tokens_of(spark, "the cat les chats", "en", rule) == ["cat", "les", "chats"]
    assert tokens_of(spark, "the cat les chats", "fr", rule) == ["the", "cat", "chats"]
    assert tokens_of(spark, "the cat und les", "de", rule) == ["cat", "und", "les"]


def test_lists_are_the_public_ones(spark):
    assert stopwords.ENGLISH == StopWordsRemover.loadDefaultStopWords("english")
    assert stopwords.FRENCH == StopWordsRemover.loadDefaultStopWords("french")
    assert len(stopwords.STANDARD) == 33


def test_stopword_file(spark, tmp_path):
    path = tmp_path / "stop.txt"
    path.write_text(" | a comment\n\nle  la | articles\nDu\n | only this\n", encoding="utf-8")
    rows = stopwords.read_stopword_file(spark, str(path), "fr").collect()
    assert sorted((r.lang, r.word) for r in rows) == [("fr", "du"), ("fr", "la"), ("fr", "le")]


def test_counts_are_complete_and_ordered(spark):
    df = spark.createDataFrame([("b a b c a b",), ("",), ("z",)], "text string")
    got = [r[0] for r in df.select(tx.term_counts(F.col("text"))).collect()]
    assert [(e.term, e.n) for e in got[0]] == [("a", 2), ("b", 3), ("c", 1)]
    assert got[1] == []
    assert [(e.term, e.n) for e in got[2]] == [("z", 1)]


def test_long_apostrophe_chain_does_not_recurse(spark):
    df = spark.createDataFrame([("a" + "'a" * 100_000,)], "text string")
    assert df.select(F.size(tx.tokenise(F.col("text"))).alias("n")).first()["n"] == 1


def test_whole_text_is_read(spark):
    df = spark.createDataFrame([("w " * 200_000 + "last",)], "text string")
    counts = df.select(tx.term_counts(F.col("text")).alias("c")).first()["c"]
    assert {e.term: e.n for e in counts} == {"w": 200_000, "last": 1}


def test_shingles(spark):
    df = spark.createDataFrame([(["a", "b", "c"],), ([],), (["x"],)], "t array<string>")
    got = [r[0] for r in df.select(tx.shingles(F.col("t"))).collect()]
    assert got[0] == ["a", "b", "c", "a b", "b c", "a b c"]
    assert got[1] == [] and got[2] == ["x"]


@pytest.mark.parametrize(
    "term,lang,stem",
    [
        ("queries", "en", "query"), ("horses", "en", "horse"), ("cats", "en", "cat"),
        ("glass", "en", "glass"), ("corpus", "en", "corpus"), ("gateaux", "fr", "gateau"),
        ("chats", "fr", "chat"), ("autos", "de", "autos"),
    ],
)
def test_stems(spark, term, lang, stem):
    df = spark.createDataFrame([(term, lang)], "term string, lang string")
    assert df.select(tx.light_stem(F.col("term"), F.col("lang"))).first()[0] == stem


def test_user_filter_hook(spark):
    df = spark.createDataFrame([("one three five",)], "text string")
    longer = lambda t: F.length(t) > 3
    got = df.select(tx.term_counts(F.col("text"), keep=longer).alias("c")).first()["c"]
    assert [e.term for e in got] == ["five", "three"]


def test_once_keeps_nulls_and_expand_drops_empty(spark):
    df = spark.createDataFrame([(1, "a b"), (2, ""), (3, None)], "id int, text string")
    counted = df.select("id", tx.term_counts(F.col("text")).alias("terms"))
    assert {r.id for r in expand(counted, "terms", "id").collect()} == {1}
    assert once(df, F.upper("text"), "u", "id").count() == 3
