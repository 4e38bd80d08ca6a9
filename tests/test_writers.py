"""Files within a byte limit under one commit, and metrics of micro-batches."""

import os

import pytest
from pyspark.sql import functions as F

from corpusloom.sources import rolling
from corpusloom.streaming import flows, metrics


def _data_files(path):
    return sorted(n for n in os.listdir(path) if n.startswith("part-"))


def _read(path):
    return [line for n in _data_files(path) for line in open(os.path.join(path, n), encoding="utf-8").read().split("\n")[:-1]]


@pytest.fixture
def lines(spark):
    return spark.range(400).repartition(3).select(
        F.concat(F.lit("né "), F.repeat(F.lit("x"), (F.col("id") % 50).cast("int")), F.col("id").cast("string")).alias("line")
    )


def test_files_keep_the_byte_limit(spark, lines, tmp_path):
    path, limit = str(tmp_path / "out"), 1000
    rows = lines.union(spark.createDataFrame([("y" * 5000,), (None,), ("",)], "line string"))
    rolling.write_lines_rolled(rows, path, limit)
    sizes = {n: os.path.getsize(os.path.join(path, n)) for n in _data_files(path)}
    large = [n for n, size in sizes.items() if size > limit]
    assert len(large) == 1 and sizes[large[0]] == 5001
    # a file ends only where the next line would not fit: at 60 bytes a line most are nearly full
    assert len(sizes) <= sum(sizes.values()) / limit * 1.4 + 4
    expected = sorted(r.line or "" for r in rows.collect())
    assert sorted(_read(path)) == expected
    assert not os.path.exists(os.path.join(path, rolling.PENDING))
    assert sorted(r.value for r in spark.read.text(path).collect()) == expected


def test_failed_job_leaves_nothing(spark, lines, tmp_path):
    path = str(tmp_path / "out")
    rolling.write_lines_rolled(lines.limit(5), path, 1000)
    before = _read(path)
    bad = F.when(F.col("line").endswith("x399"), F.raise_error(F.lit("broken row")).cast("string")).otherwise(F.col("line"))
    with pytest.raises(Exception, match="broken row"):
        rolling.write_lines_rolled(lines.select(bad.alias("line")), path, 100)
    with pytest.raises(Exception, match="broken row"):
        rolling.write_lines_rolled(lines.select(bad.alias("line")), path, 100, mode="overwrite")
    assert _read(path) == before and not os.path.exists(os.path.join(path, rolling.PENDING))


def test_append_and_overwrite(spark, lines, tmp_path):
    path = str(tmp_path / "out")
    one, other = lines.limit(7), spark.createDataFrame([("z",)], "line string")
    rolling.write_lines_rolled(one, path)
    rolling.write_lines_rolled(other, path)
    assert len(_read(path)) == 8
    rolling.write_lines_rolled(other, path, mode="overwrite")
    assert _read(path) == ["z"]
    rolling.write_lines_rolled(other.limit(0), str(tmp_path / "none"))
    assert _data_files(str(tmp_path / "none")) == []
    with pytest.raises(Exception, match="one string column"):
        spark.range(3).write.format(rolling.FORMAT).mode("append").save(str(tmp_path / "number"))
    with pytest.raises(Exception, match="positive"):
        rolling.write_lines_rolled(other, str(tmp_path / "zero"), 0)


def test_json_rolled_keeps_nulls(spark, tmp_path):
    rows = spark.createDataFrame([(1, None, "a\nb "), (None, "x", None)], "id long, line string, text string")
    rolling.write_json_rolled(rows, str(tmp_path / "json"), 10)
    assert len(_data_files(tmp_path / "json")) == 2
    assert all('"line":' in line for line in _read(tmp_path / "json"))
    back = spark.read.schema(rows.schema).json(str(tmp_path / "json"))
    assert sorted(back.collect(), key=str) == sorted(rows.collect(), key=str)


def test_metrics_while_a_stream_runs(spark, tmp_path):
    for part in range(4):
        values = [(i, None if i % 3 else "bad") for i in range(part * 10, part * 10 + 5 + part)]
        spark.createDataFrame(values, "id long, error string").coalesce(1).write.json(str(tmp_path / f"in/{part}"))
    stream = flows.json_stream(spark, str(tmp_path / "in"), "id long, error string", 1)
    rows = metrics.watched(stream, "parts", processed=F.count(F.lit(1)), errors=F.count("error"))
    folder, out = str(tmp_path / "metrics"), str(tmp_path / "out")
    with metrics.recorded(spark, "parts", folder) as listener:
        query = flows.append_to(rows, out, str(tmp_path / "progress"))
        listener.wait(query.runId)
        with pytest.raises(TimeoutError):
            listener.wait("another", 0.01)
    found = metrics.table(spark, folder)
    assert found.where("metric = 'processed' and value > 0").count() == 4
    got = {r.metric: r.total for r in metrics.totals(found).collect()}
    back = spark.read.schema("id long, error string").parquet(out)
    assert got == {"processed": back.count(), "errors": back.where("error is not null").count()} and got["processed"] == 26
