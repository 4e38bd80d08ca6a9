"""Keyed tables, clusters, files, jobs and streams."""

import glob
import json
import os

import pytest
from pyspark.sql import functions as F

from corpusloom.catalogue import files
from corpusloom.operators import clusters as cl
from corpusloom.operators import index as ix
from corpusloom.operators import words as ops
from corpusloom.plans import apply as apply_job
from corpusloom.plans import clustering as km
from corpusloom.plans import corpus as corpus_job
from corpusloom.plans import train as train_job
from corpusloom.sources import files as io
from corpusloom.sources.tables import scan
from corpusloom.streaming import changing, flows

INDEX = "doc_id bigint, a string, v int"


def rows_of(df, key="doc_id"):
    return {r[key]: tuple(r) for r in df.collect()}


def test_upsert(spark):
    index = spark.createDataFrame([(1, "x", 1), (2, "y", 1)], INDEX)
    batch = spark.createDataFrame([(2, "old", 2), (2, "new", 3), (3, "z", 2)], INDEX)
    once = ix.upsert(index, batch, "doc_id", "v")
    assert rows_of(once) == {1: (1, "x", 1), 2: (2, "new", 3), 3: (3, "z", 2)}
    assert rows_of(ix.upsert(once, batch, "doc_id", "v")) == rows_of(once)


def test_hot_key_upsert(spark):
    batch = spark.range(20_000).select(
        F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("doc_id"), F.lit("b").alias("a"), F.col("id").cast("int").alias("v")
    )
    got = ix.upsert(spark.createDataFrame([], INDEX), batch, "doc_id", "v")
    assert got.count() == batch.select("doc_id").distinct().count()
    assert got.where("doc_id = 7").first().v == 19_998


def test_set_field(spark):
    index = spark.createDataFrame([(1, "x", 1), (2, "y", None)], INDEX)
    updates = spark.createDataFrame([(2, 9), (5, 8)], "doc_id bigint, v int")
    assert rows_of(ix.set_field(index, updates, "doc_id", "v")) == {1: (1, "x", 1), 2: (2, "y", 9), 5: (5, None, 8)}
    assert rows_of(ix.set_field(index, updates, "doc_id", "v", insert=False)) == {1: (1, "x", 1), 2: (2, "y", 9)}


def test_index_table(spark):
    table = ix.new_index(spark, "doc_id", INDEX)
    assert table.read().count() == 0
    table.write(spark.createDataFrame([(1, "x", 1), (2, "y", 1)], INDEX), 0)
    change = spark.createDataFrame([(2, "z", 1), (2, "w", 2)], INDEX)
    for _ in range(2):
        table.write(change, 1, "v")
    want = {1: (1, "x", 1), 2: (2, "w", 2)}
    assert rows_of(table.read()) == want
    assert rows_of(table.compact(table.path + "-compact").read()) == want


def small_index(spark, path, **options):
    return ix.IndexTable(spark, str(path), "doc_id", INDEX, **options)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_index_table_folds_touched_buckets_and_reads_without_exchange(spark, tmp_path):
    table = small_index(spark, tmp_path / "t", buckets=8, fold_after=100)
    rows = spark.range(200).select(F.col("id").alias("doc_id"), F.lit("x").alias("a"), F.lit(0).alias("v"))
    table.write(rows, 0)
    assert table.fold() and not table.fold()
    first = table.snapshot()
    assert "Exchange" not in plan_of(table.read()) and table.read().count() == 200
    table.write_field(spark.createDataFrame([(7, 70), (900, 9)], "doc_id bigint, v int"), "v", 0)
    touched = table.snapshot().touched()
    assert 1 <= len(touched) <= 2
    assert "Exchange" in plan_of(table.read())
    want = {i: (i, "x", 0) for i in range(200)} | {7: (7, "x", 70), 900: (900, None, 9)}
    assert rows_of(table.read()) == want
    assert table.fold() and rows_of(table.read()) == want and "Exchange" not in plan_of(table.read())
    after = table.snapshot()
    assert {b for b in after.base if after.base[b] != first.base.get(b)} == set(touched)
    assert table.clean() >= 2 and rows_of(table.read()) == want


def test_index_table_folds_by_itself_and_keeps_the_order_of_commits(spark, tmp_path):
    table = small_index(spark, tmp_path / "t", buckets=3, fold_after=2)
    want = {}
    for batch in range(5):
        table.write(spark.createDataFrame([(1, f"w{batch}", batch), (10 + batch, "n", None)], INDEX), batch)
        table.write_field(spark.createDataFrame([(1, None), (2, batch)], "doc_id bigint, v int"), "v", batch)
        want |= {1: (1, f"w{batch}", None), 10 + batch: (10 + batch, "n", None), 2: (2, None, batch)}
        assert rows_of(table.read()) == want and len(table.snapshot().open) < 2
    assert table.snapshot().seen == {"rows/main": [[0, 4]], "fields/main": [[0, 4]]}
    # opened again, with other options: the number of buckets stays
    again = small_index(spark, tmp_path / "t", buckets=99)
    assert again.snapshot().buckets == 3 and rows_of(again.read()) == want
    # a repeated batch of before the fold changes nothing, a gap in the numbers is filled
    again.write(spark.createDataFrame([(1, "repeated", 0)], INDEX), 2)
    assert rows_of(again.read()) == want
    again.write(spark.createDataFrame([(3, "late", 0)], INDEX), 9)
    again.write(spark.createDataFrame([(4, "gap", 0)], INDEX), 7)
    assert rows_of(again.read()) == want | {3: (3, "late", 0), 4: (4, "gap", 0)}


def test_index_table_with_null_keys_hot_keys_and_empty_batches(spark, tmp_path):
    table = small_index(spark, tmp_path / "t", buckets=2, fold_after=100)
    table.write(spark.createDataFrame([], INDEX), 0)
    assert not table.fold() and table.read().count() == 0
    rows = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, None).otherwise(F.col("id") % 5).alias("doc_id"), F.lit("h").alias("a"), F.col("id").cast("int").alias("v")
    )
    table.write(rows, 1, "v")
    table.write_field(spark.createDataFrame([(None, 5)], "doc_id bigint, v int"), "v", 1)
    for _ in range(2):
        got = rows_of(table.read())
        assert set(got) == {None, 0, 1, 2, 3, 4} and got[None] == (None, "h", 5)
        table.fold()
    with pytest.raises(ValueError):
        ix.IndexTable(spark, str(tmp_path / "u"), "doc_id", "doc_id bigint, _bucket int")


def test_two_writers_and_two_folds_at_once(spark, tmp_path, monkeypatch):
    table = small_index(spark, tmp_path / "t", fold_after=100)
    other = small_index(spark, tmp_path / "t", fold_after=100)
    table.write(spark.createDataFrame([(1, "x", 0), (2, "x", 0)], INDEX), 0)
    claim, meanwhile = ix.IndexTable._claim, []

    def delayed(self, version, entry):
        # another writer takes the number between this one's reading the log and its claim
        if self is table and meanwhile:
            meanwhile.pop()()
        return claim(self, version, entry)

    monkeypatch.setattr(ix.IndexTable, "_claim", delayed)
    meanwhile.append(lambda: other.write(spark.createDataFrame([(2, "other", 5), (3, "other", 5)], INDEX), 0, writer="other"))
    table.write(spark.createDataFrame([(2, "later", 6)], INDEX), 1)
    want = {1: (1, "x", 0), 2: (2, "later", 6), 3: (3, "other", 5)}
    assert not meanwhile and rows_of(table.read()) == want
    # a commit that ends during a fold stays open and keeps its rank
    meanwhile.append(lambda: other.write(spark.createDataFrame([(1, "during", 7)], INDEX), 1, writer="other"))
    assert table.fold() and len(table.snapshot().open) == 1
    want[1] = (1, "during", 7)
    assert rows_of(table.read()) == rows_of(other.read()) == want
    # of two folds one is given up, without loss
    meanwhile.append(lambda: other.fold())
    table.write(spark.createDataFrame([(4, "x", 0)], INDEX), 2)
    meanwhile.append(lambda: other.fold())
    other.write(spark.createDataFrame([(5, "x", 0)], INDEX), 2, writer="other")
    assert not table.fold()
    assert rows_of(table.read()) == want | {4: (4, "x", 0), 5: (5, "x", 0)}


def test_positional_join_drops_the_longer_rest(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b")], "position bigint, path string")
    right = spark.createDataFrame([(1, "7")], "position bigint, cluster string")
    assert [tuple(r) for r in ix.join_by_position(left, right).collect()] == [(1, "a", "7")]


def test_top_words(spark):
    docs = spark.createDataFrame(
        [(1, "cat cat dog", "en"), (2, "dog", "en"), (3, "fish", "en"), (4, "of the", "en")], "doc_id bigint, text string, lang string"
    )
    assignment = spark.createDataFrame([(1, 0), (2, 0), (3, 1), (4, 1)], "doc_id bigint, cluster int")
    counts = cl.words_per_cluster(docs, assignment)
    lines = sorted(r.line for r in cl.top_words_lines(cl.top_words(counts, 1)).collect())
    assert lines == ["0\tcat:2", "1\tfish:1"]
    lines = sorted(r.line for r in cl.assignment_lines(assignment).collect())
    assert lines[0] == "0\t1"


def test_nearest_centre_takes_the_lowest_of_equals(spark):
    vectors = spark.createDataFrame([(1, [0.0])], "id bigint, v array<double>")
    centres = spark.createDataFrame([(i, [float(i)]) for i in range(3)], "g bigint, centre array<double>")
    assert cl.nearest_centre(vectors, centres, "id", "v", "g").first().g == 0
    twice = centres.union(spark.createDataFrame([(-1, [0.0])], centres.schema))
    assert cl.nearest_centre(vectors, twice, "id", "v", "g").first().g == -1


def test_nearest_centre_in_parts(spark):
    """Dealt vectors find the same centres, and no part holds all vectors of the one dimension."""
    vectors = spark.range(200).select("id", F.array(F.cos("id"), F.sin(F.col("id") * 3)).alias("v"))
    odd = spark.createDataFrame([(900, None), (901, [1.0]), (902, [0.0, None])], "id bigint, v array<double>")
    centres = spark.range(9).select(F.col("id").alias("g"), F.array(F.sin("id"), F.cos("id")).alias("centre"))
    rows = vectors.union(odd)
    whole, dealt = (cl.nearest_centre(rows, centres, "id", "v", "g", parts) for parts in (None, 7))
    assert sorted(map(tuple, dealt.collect()), key=str) == sorted(map(tuple, whole.collect()), key=str)
    plan = dealt._jdf.queryExecution().optimizedPlan().toString()
    assert "_part" in plan and "_part" not in whole._jdf.queryExecution().optimizedPlan().toString()


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("corpus") / "docs")
    words = [("cat dog", "en"), ("tree leaf root", "en"), ("star moon", "en")]
    rows = [(i, (words[i % 3][0] + " ") * 5, "en") for i in range(30)] + [(99, "the of", "en"), (100, None, "en")]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string").write.parquet(path)
    return path


def test_train_and_apply_jobs(spark, corpus, tmp_path):
    model, out1, out2 = (str(tmp_path / n) for n in ("model", "out1", "out2"))
    cost = train_job.main(["--documents", corpus, "-o", model, "-n", "3"])
    assert cost == pytest.approx(0.0, abs=1e-6)
    apply_job.main(["--documents", corpus, "-i", model, "--output1", out1, "--output2", out2, "--one-file"])
    assigned = dict(reversed(r.value.split("\t")) for r in spark.read.text(out1).collect())
    assert len(assigned) == 30 and len({assigned[str(i)] for i in range(0, 30, 3)}) == 1
    assert len(set(assigned.values())) == 3
    top = sorted(r.value.split("\t", 1)[1] for r in spark.read.text(out2).collect())
    assert top == ["cat:50\tdog:50", "leaf:50\troot:50\ttree:50", "moon:50\tstar:50"]
    assert len(glob.glob(f"{out1}/part-*")) == 1


def test_job_detects_language(spark, corpus, tmp_path):
    from corpusloom.operators.language import hashed_profiles, language_profiles

    rows = [(1, "the house and the garden", "en"), (2, "la maison et le jardin", "fr")]
    train = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    profiles = str(tmp_path / "profiles")
    language_profiles(train).write.parquet(profiles)
    docs = train_job.read_corpus(spark, corpus, "doc_id < 5", profiles)
    assert docs.count() == 5 and {r.lang for r in docs.collect()} <= {"en", "fr"}
    hashed = str(tmp_path / "hashed")
    hashed_profiles(train).write.parquet(hashed)
    again = train_job.read_corpus(spark, corpus, "doc_id < 5", hashed)
    assert again.columns == ["doc_id", "text", "lang"] and sorted(again.collect()) == sorted(docs.collect())
    assert "Join" not in again._jdf.queryExecution().executedPlan().toString()


def test_corpus_job(spark, corpus, tmp_path):
    out = str(tmp_path / "tables")
    corpus_job.main(["--documents", corpus, "--output", out, "--min", "1"])
    stats = {r.term: (r.documents, r["count"]) for r in spark.read.parquet(f"{out}/stats").collect()}
    assert stats["cat"] == (10, 50) and len(stats) == 7
    assert spark.read.parquet(f"{out}/tfidf").where("term = 'cat'").count() == 10


def test_assignment_is_the_nearest_centre(spark, corpus):
    tokens = km.document_tokens(scan(spark, corpus, ["doc_id", "text", "lang"]))
    model = km.train(tokens, 2)
    found = km.distances(model, tokens).collect()
    assert all(r.own == pytest.approx(r.nearest) for r in found) and len(found) == 30
    training = model.stages[-1].summary.trainingCost  # equal, as this run converges
    assert km.cost(model, tokens).first()[0] == pytest.approx(training, rel=1e-6)
    with pytest.raises(ValueError):
        km.assign(model, tokens, "other")


def test_scan_files_and_json(spark, tmp_path):
    deep = tmp_path / "a" / "b"
    deep.mkdir(parents=True)
    for name in ("x.pdf", "y.PDF", "z.html", "none"):
        (deep / name).write_bytes(b"12")
    (tmp_path / "empty.pdf").write_bytes(b"")
    found = io.scan_files(spark, str(tmp_path), ["pdf", "html"]).collect()
    assert sorted((os.path.basename(r.path), r.length) for r in found) == [("x.pdf", 2), ("z.html", 2)]
    lines = tmp_path / "lines"
    lines.mkdir()
    (lines / "ok.json").write_text('{"path":"p","body":"flush"}\n\n{"path":"q"}\n', encoding="utf-8")
    (lines / "BAD.JSON").write_text('{"path":\n', encoding="utf-8")
    (lines / "skip.txt").write_text('{"path":"no"}\n', encoding="utf-8")
    rows = io.scan_json_lines(spark, str(lines), "path string, body string").collect()
    assert sorted((r.path or "", r.body or "", r[io.CORRUPT] is not None) for r in rows) == [
        ("", "", True), ("p", "flush", False), ("q", "", False),
    ]


def test_json_files_roll(spark, tmp_path):
    frame = spark.range(2000).select("id", F.repeat(F.lit("x"), 100).alias("t")).coalesce(1)
    io.write_json_lines(frame, str(tmp_path / "out"), roll_bytes=60_000)
    files = glob.glob(str(tmp_path / "out" / "*.json"))
    assert len(files) == 4 and max(map(os.path.getsize, files)) < 70_000
    assert io.scan_json_lines(spark, str(tmp_path / "out"), "id bigint, t string").count() == 2000


def test_batches_go_on_after_a_failure(spark, tmp_path):
    folder = str(tmp_path)

    def send(batch):
        if any(r["id"] == 7 for r in batch):
            raise OSError("refused")
        with open(f"{folder}/{batch[0]['id']}.json", "w", encoding="utf-8") as out:
            json.dump([int(r["id"]) for r in batch], out)

    got = io.send_batches(spark.range(0, 120, 1, 1), send).collect()
    assert [(r.batches, r.rows, r.failed) for r in got] == [(3, 70, 50)]
    assert got[0].error
    sent = [i for f in glob.glob(f"{folder}/*.json") for i in json.load(open(f, encoding="utf-8"))]
    assert sorted(sent) == list(range(50, 120))


def test_cluster_column_and_matrix(spark, tmp_path):
    (tmp_path / "c.csv").write_text('position,cluster\n1,"4"\n2,"5"\n', encoding="utf-8")
    assert [tuple(r) for r in io.scan_cluster_column(spark, str(tmp_path / "c.csv")).collect()] == [(1, "4"), (2, "5")]
    (tmp_path / "m.tsv").write_text("path\ta\tb\nd1\t0.0\t1.0\n", encoding="utf-8")
    assert [tuple(r) for r in io.scan_tsv(spark, str(tmp_path / "m.tsv")).collect()] == [("d1", "0.0\t1.0")]


def test_matrix_takes_little_disk(spark, tmp_path, monkeypatch):
    """The matrix that is read back is whole, and its many equal cells are not written out."""
    rows = [(i, " ".join(f"word{'abcdefghij'[j // 10]}{'abcdefghij'[j % 10]}" for j in range(i % 90, i % 90 + 10)), "en") for i in range(200)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    matrix, kept = str(tmp_path / "matrix"), []
    monkeypatch.setattr(files, "work_path", lambda session, label: matrix)
    monkeypatch.setattr(files.ops, "shared", lambda terms, shared=ops.shared: kept.append(shared(terms)) or kept[0])
    got = files.tsv_roundtrip(spark, str(tmp_path)).collect()
    lines = [r.value for r in spark.read.text(matrix).collect()]
    assert len(got) == 200 and len(lines) == 201
    assert {r.cells for r in got} == {len(line.split("\t")) for line in lines} and got[0].cells > 50
    assert sum(os.path.getsize(f) for f in glob.glob(f"{matrix}/part-*")) < sum(map(len, lines)) / 5
    assert not any(os.path.exists(f.removeprefix("file://")) for f in kept[0].inputFiles())


def test_stream_restart_neither_loses_nor_doubles(spark, tmp_path):
    source, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    schema = "doc_id bigint, text string, lang string"

    def drop(first):
        rows = [(first + i, "cat dog cat", "en") for i in range(3)]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(source)

    table = ix.new_index(spark, "term", "term string, documents bigint, count bigint")
    for first in (0, 10):
        drop(first)
        flows.append_to(flows.word_counts(flows.json_stream(spark, source, schema, 1)), out, mark)
        flows.running_stats(flows.json_stream(spark, source, schema), table, mark + "-stats")
    flows.append_to(flows.word_counts(flows.json_stream(spark, source, schema, 1)), out, mark)
    counts = spark.read.parquet(out)
    assert counts.count() == 12
    batch = ops.corpus_word_stats(counts)
    assert rows_of(table.read(), "term") == rows_of(batch, "term")


def test_changed_documents_take_their_counts_back(spark, tmp_path):
    source, mark = str(tmp_path / "in"), str(tmp_path / "mark")
    schema = "doc_id bigint, text string, lang string, version bigint, terms string"
    table = ix.new_index(spark, "term", "term string, documents bigint, count bigint")
    drops = [
        [(1, "cat dog cat", "en", 1, "x"), (2, "dog", "en", 1, "x"), (3, "fish bird", "en", None, "x"), (None, "owl", "en", 1, "x")],
        # a change with a repeat of the old version, a text taken away, a late older version, ties
        [(1, "cat mouse", "en", 2, "x"), (1, "cat dog cat", "en", 1, "x"), (2, None, "en", 5, "x"), (3, "fish", "en", 0, "x"), (4, "ant", "en", 1, "x")],
        [(2, "dog dog", "en", 4, "x"), (1, "cat mouse", "en", 2, "x"), (4, "bee", "en", 1, "x"), (4, "ant", "en", 1, "x"), (None, "owl owl", "en", 2, "x")],
        [(5, "", "en", 1, "x"), (3, "fish tree tree", "en", 1, "x")],
    ]
    stats = []
    for rows in drops:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(source)
        changing.changing_stats(flows.json_stream(spark, source, schema), "version", table, mark)
        stats.append({r.term: (r.documents, r["count"]) for r in changing.current_stats(table).collect()})
    assert stats[0] == {"cat": (1, 2), "dog": (2, 2), "fish": (1, 1), "bird": (1, 1), "owl": (1, 1)}
    assert stats[1] == {"cat": (1, 1), "mouse": (1, 1), "fish": (1, 1), "ant": (1, 1), "owl": (1, 1)}
    assert stats[2] == {"cat": (1, 1), "mouse": (1, 1), "fish": (1, 1), "bee": (1, 1), "owl": (1, 2)}
    assert stats[3] == {"cat": (1, 1), "mouse": (1, 1), "fish": (1, 1), "tree": (1, 2), "bee": (1, 1), "owl": (1, 2)}
    # a batch that is run again after its commit adds nothing
    again = spark.createDataFrame([("cat", 9, 9)], "term string, documents bigint, count bigint")
    table.write(again, 0, writer=flows.writer_of(mark))
    assert {r.term: (r.documents, r["count"]) for r in changing.current_stats(table).collect()} == stats[3]


def test_limits_of_a_stream(spark, tmp_path):
    source = str(tmp_path / "in")
    for i in range(4):
        spark.createDataFrame([(i, "x")], "doc_id bigint, text string").coalesce(1).write.mode("append").json(source)
    sizes = []
    stream = flows.json_stream(spark, source, "doc_id bigint, text string", 1)
    flows.each_batch(stream, lambda df, n: sizes.append(df.count()), str(tmp_path / "mark"), timeout=120)
    assert sizes == [1, 1, 1, 1]


def test_lines_are_numbered_across_splits_and_files(spark, tmp_path):
    want = {"b.txt": [f"line {i} " + "x" * (i % 50) for i in range(700)], "a.txt": ["", "alone", ""], "c.txt": ["end"]}
    folder = tmp_path / "texts"
    folder.mkdir()
    for name, lines in want.items():
        (folder / name).write_text("\n".join(lines) + "\n")
    whole = [line for name in sorted(want) for line in want[name]]
    size, cost = "spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"
    old = {key: spark.conf.get(key) for key in (size, cost)}
    try:
        spark.conf.set(size, "1000")
        spark.conf.set(cost, "1")
        numbered = io.numbered_lines(spark, str(folder))
        assert spark.read.text(str(folder)).rdd.getNumPartitions() > 10
        got = {r.position: r.line for r in numbered.collect()}
    finally:
        for key, value in old.items():
            spark.conf.set(key, value)
    assert got == dict(enumerate(whole, 1))
    other = tmp_path / "other.txt"
    other.write_text("one\ntwo")
    pairs = sorted(tuple(r) for r in io.paired_lines(spark, str(folder), str(other)).collect())
    assert pairs == [(1, "", "one"), (2, "alone", "two")]
    (tmp_path / "none").mkdir()
    assert io.numbered_lines(spark, str(tmp_path / "none")).count() == 0
