"""Shapes of physical plans that matter at scale."""

import re
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from corpusloom import catalogue
from corpusloom.operators import words as ops
from corpusloom.session import SCAN_PARTITIONS, planned_bytes, shared_folder, small_side, spread, stage, work_path

QUERIES = catalogue.all_queries()
PYTHON = {"train_assign", "wssse", "user_parser", "batched_writer", "lang_detect_row"}
EAGER = {
    "train_assign", "wssse", "model_roundtrip", "train_predict_tf", "index_table_twice",
    "json_roundtrip", "binary_scan", "tsv_roundtrip", "cluster_column", "assign_tf", "train_apply_jobs",
}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def final_plan(df):
    df.collect()
    return plan(df).split("Initial Plan")[0]


@pytest.mark.parametrize(
    "name", sorted(n for n in QUERIES if n not in EAGER | PYTHON and not n.startswith("stream_"))
)
def test_no_python_and_no_cross_join(spark, sf_dir, name):
    text = plan(QUERIES[name](spark, sf_dir))
    assert not re.search(r"ArrowEval|BatchEvalPython|MapInPandas|FlatMapGroups", text)
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_counts_per_document_need_no_shuffle(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert "Exchange" not in plan(ops.word_count_by_doc(ops.doc_terms(docs)))


@pytest.mark.parametrize("name", ["word_count_by_doc", "corpus_stats", "tfidf_top", "highlight"])
def test_texts_are_cut_once_per_branch(spark, sf_dir, name):
    lines = plan(QUERIES[name](spark, sf_dir)).split("\n")
    filters = [x for x in lines if re.match(r"[\s:+*()0-9-]*Filter", x) and "regexp_extract_all" in x]
    assert not filters


def test_both_branches_of_tfidf_read_what_was_counted_once(spark, sf_dir):
    text = final_plan(QUERIES["tfidf_top"](spark, sf_dir))
    assert "regexp" not in text and "BroadcastHashJoin" in text
    assert "WindowGroupLimit" in text and "TakeOrderedAndProject" in text


def test_scan_pushes_filter_and_prunes_columns(spark, sf_dir):
    text = plan(QUERIES["term_and"](spark, sf_dir))
    assert re.search(r"PushedFilters: \[[^\]]*EqualTo\(c_mktsegment,BUILDING\)", text)
    assert "ReadSchema: struct<c_custkey:bigint,c_name:string,c_nationkey:int,c_mktsegment:string>" in text
    text = plan(QUERIES["corpus_stats"](spark, sf_dir))
    assert "ReadSchema: struct<text:string,lang:string>" in text


def test_ranges_reach_the_scan(spark, sf_dir):
    text = plan(QUERIES["facet_date_years"](spark, sf_dir))
    assert re.search(r"PushedFilters: \[[^\]]*GreaterThanOrEqual\(l_shipdate", text)
    assert "ReadSchema: struct<l_shipdate:timestamp_ntz>" in text
    text = plan(QUERIES["range_filter"](spark, sf_dir))
    assert re.search(r"PushedFilters: \[[^\]]*GreaterThanOrEqual\(o_totalprice", text)


def test_all_facets_take_one_scan(spark, sf_dir):
    assert plan(QUERIES["facet_orders"](spark, sf_dir)).count("FileScan") == 1
    assert "WindowGroupLimit" in plan(QUERIES["facet_orders"](spark, sf_dir))


def test_pages_are_top_k(spark, sf_dir):
    assert "TakeOrderedAndProject" in plan(QUERIES["page_two"](spark, sf_dir))


def test_ranks_are_cut_before_the_shuffle(spark, sf_dir):
    for name in ("top_words", "title_candidates", "index_upsert"):
        text = plan(QUERIES[name](spark, sf_dir))
        assert "WindowGroupLimit" in text and "Partial" in text, name


def test_scans_are_spread_only_on_request(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert planned_bytes(docs) > 0
    assert "Exchange" not in plan(spread(docs, "doc_id"))
    spark.conf.set(SCAN_PARTITIONS, "3")
    try:
        assert spread(docs, "doc_id").rdd.getNumPartitions() == 3
    finally:
        spark.conf.unset(SCAN_PARTITIONS)


def test_stage_and_shared_folder(spark):
    folder = spark.conf.get("spark.checkpoint.dir")
    assert shared_folder(spark) == folder and work_path(spark, "a") != work_path(spark, "a")
    staged = stage(spark.range(10), "ten")
    assert staged.count() == 10 and folder in staged.inputFiles()[0]


def _on_cluster(spark, settings, chosen=None):
    """The session as a cluster's: other settings, same JVM."""
    conf = SimpleNamespace(get=settings.get, set=settings.__setitem__)
    context = SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: chosen, _jsc=spark.sparkContext._jsc)
    return SimpleNamespace(conf=conf, sparkContext=context, _jvm=spark._jvm)


def test_shared_folder_on_a_cluster(spark, tmp_path):
    plain = f"file:{tmp_path}/kept"
    for told in (f"{tmp_path}/kept", f"file://{tmp_path}/kept/"):
        found = shared_folder(_on_cluster(spark, {"spark.checkpoint.dir": told}))
        assert found.replace("file://", "file:") == plain
        assert shared_folder(_on_cluster(spark, {}, told)).replace("file://", "file:") == plain
    assert shared_folder(_on_cluster(spark, {"spark.sql.warehouse.dir": f"{tmp_path}/kept"})) == plain
    default = f"file:{spark._jvm.java.lang.System.getProperty('user.dir')}/spark-warehouse"
    with pytest.raises(ValueError):
        shared_folder(_on_cluster(spark, {"spark.sql.warehouse.dir": default}))


def test_only_small_sides_are_broadcast(spark):
    small, big = spark.range(10), spark.range(10**12)
    join = lambda side: plan(spark.range(10**9).join(small_side(side), "id"))
    assert "BroadcastHashJoin" in join(small) and "BroadcastHashJoin" not in join(big)
