"""Fuzzy words through deletion variants, against all pairs of words."""

import random
import re

import pytest
from corpusloom.catalogue.search import fuzzy_documents
from corpusloom.functions.match import allowed_edits
from corpusloom.operators import fuzzy
from corpusloom.operators import relevance as rel
from pyspark.sql import functions as F


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def edited(rng, word, times):
    for _ in range(times):
        i = rng.randrange(len(word) + 1)
        kind = rng.randrange(3)
        word = word[:i] + (rng.choice("abcé") if kind else "") + word[i + (kind != 1) :]
    return word


@pytest.fixture(scope="module")
def words():
    rng = random.Random(3)
    base = ["".join(rng.choice("abcdé") for _ in range(rng.randrange(1, 16))) for _ in range(150)]
    return sorted({w for b in base for w in (b, edited(rng, b, 1), edited(rng, b, 2), edited(rng, b, 3)) if w})


@pytest.mark.parametrize("edits", [0, 1, 2, None])
def test_similar_terms_are_all_pairs(spark, words, edits):
    asked = words[::17] + ["zzzzzz", "", words[0].upper()]
    vocabulary = spark.createDataFrame([(w,) for w in words] + [(None,)], "term string")
    index = fuzzy.variant_index(vocabulary)
    found = {(r.word, r.term): r.distance for r in fuzzy.similar_terms(index, asked, edits).collect()}
    wanted = {}
    for a in {w.lower() for w in asked}:
        most = allowed_edits(a) if edits is None else edits
        wanted.update({(a, b): distance(a, b) for b in words if distance(a, b) <= most})
    assert found == wanted
    own = fuzzy.variant_index(vocabulary, 2, asked)
    assert {(r.word, r.term) for r in fuzzy.similar_terms(own, asked, edits).collect()} == set(wanted)


def test_variants_are_bounded(spark):
    df = spark.createDataFrame([("abcdefghijklmnop",), ("a",), ("",), (None,), ("aaaa",)], "w string")
    got = [r[0] for r in df.select(fuzzy.variants(F.col("w"))).collect()]
    assert len(got[0]) == 1 + 8 + 28 and max(map(len, got[0])) == fuzzy.PREFIX
    assert sorted(got[1]) == ["", "a"] and got[2] == [""] and got[3] is None
    assert sorted(got[4]) == ["aa", "aaa", "aaaa"]
    with pytest.raises(ValueError):
        fuzzy.variants(F.col("w"), 3)


def test_documents_by_similar_words(spark):
    rows = [(1, [("house", 1), ("mouse", 2)]), (2, [("horse", 1)]), (3, []), (4, None), (5, [("hose", 1), ("cat", 1)]), (None, [("house", 1)])]
    postings = spark.createDataFrame(rows, "doc_id long, terms array<struct<term:string,n:long>>")
    vocabulary = spark.createDataFrame([(w,) for w in ("house", "mouse", "horse", "hose", "cat")], "term string")
    index = fuzzy.variant_index(vocabulary)
    near = fuzzy.similar_terms(index, ["hause", "cut"])
    assert {(r.word, r.term) for r in near.collect()} == {("hause", "house"), ("cut", "cat")}

    def ids(n):
        return sorted(str(r.doc_id) for r in fuzzy.with_similar_words(postings, near, n).collect())

    assert ids(1) == ["1", "5"] and ids(2) == []


def test_no_distance_is_asked_of_document_tokens(spark, sf_dir):
    plan = fuzzy_documents(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    asked = re.findall(r"levenshtein\(([^)]*)\)", plan)
    assert asked and all(re.fullmatch(r"term#\d+, word#\d+(, None)?", a) for a in asked), asked
    assert not re.search(r"lambda[^\n]*levenshtein", plan)


def test_suggestions_through_the_index(spark):
    rows = [("horse", 5), ("house", 9), ("hours", 2), ("mouse", 9), ("hoe", 1)]
    stats = spark.createDataFrame(rows, "term string, documents long")
    asked = ["houze", "horse", "hoes", "zzz"]
    plain = rel.suggest(stats, asked, per_word=2).collect()
    assert sorted(rel.suggest(stats, asked, per_word=2, index=fuzzy.variant_index(stats)).collect()) == sorted(plain)


def test_words_and_not_the_vocabulary_are_broadcast(spark, tmp_path):
    named = F.concat(F.lit("w"), "id")
    spark.range(1000).select(named.alias("term"), F.lit(1).alias("documents")).write.parquet(f"{tmp_path}/stats")
    stats = spark.read.parquet(f"{tmp_path}/stats")
    near = rel.suggest(stats, ["w1x"], index=fuzzy.variant_index(stats))
    assert [r.suggestion for r in near.collect()] == ["w1"]
    plan = near._jdf.queryExecution().optimizedPlan().toString()
    held = [re.search(r"(left|right)Hint=\(strategy=broadcast\)|(\w+)Hint", x) for x in plan.splitlines() if "Join" in x]
    assert len(held) == 2 and all(h and h.group(1) == "right" for h in held)
