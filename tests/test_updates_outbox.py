"""The stream of updates and delivery in two steps, across restarts and failures."""

import datetime as dt
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from tidewire.sources import outbox, updates
from tidewire.streaming import streams

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _updates(spark, ids):
    return spark.createDataFrame([(i, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=i), f"u{i % 3}", "up", '{"ü": 1}') for i in ids], updates.UPDATE)


def _take(spark, path, tmp, n):
    stream = updates.read_updates(spark, path, block=10)
    return streams.run_once(stream, f"take{n}", "append", f"{tmp}/cp")


def test_updates_go_on_after_a_restart(spark, tmp_path):
    path = str(tmp_path / "in")
    assert updates.UpdateFolder(path).next_offset() == 0
    seen = []
    for n, ids in enumerate(([0, 3, 4, 25], [26, 27, 90, 91, 95], [], [96])):
        if ids:
            updates.write_updates(_updates(spark, ids), path, block=10)
        assert updates.UpdateFolder(path, 10).next_offset() == max([*ids, *seen]) + 1
        got = _take(spark, path, tmp_path, n).collect()
        assert sorted(r["update_id"] for r in got) == sorted(ids)  # none lost, none again
        assert all(r["at"] == dt.datetime(2024, 1, 1) + dt.timedelta(seconds=r["update_id"]) and r["data"] == '{"ü": 1}' for r in got)
        seen += ids


def test_updates_start_where_asked(spark, tmp_path):
    path = str(tmp_path / "in")
    updates.write_updates(_updates(spark, range(40)), path, block=10)
    got = streams.run_once(updates.read_updates(spark, path, block=10, startingOffset=33), "late", "append", str(tmp_path / "cp"))
    assert sorted(r["update_id"] for r in got.collect()) == list(range(33, 40))
    reader = updates.UpdateStream(updates.UpdateFolder(path, 10), 0)
    assert [p.value for p in reader.partitions({"next": 5}, {"next": 27})] == [(5, 15), (15, 25), (25, 27)]
    assert reader.partitions({"next": 5}, {"next": 5}) == []


def _messages(spark, path, fail=None):
    stream = spark.readStream.schema(outbox.MESSAGE).option("maxFilesPerTrigger", 1).parquet(path)
    if fail is None:
        return stream

    @F.udf("string")
    def broken(body):
        if body == fail:
            raise RuntimeError("midway")
        return body

    return stream.withColumn("body", broken("body"))


def test_nothing_is_published_until_all_tasks_are_done(spark, tmp_path):
    source, box, checkpoint = (str(tmp_path / x) for x in ("in", "box", "cp"))
    first = [("a", 1, k, f"a{k}") for k in range(5)] + [("b", 1, k, f"b{k}") for k in range(3)]
    spark.createDataFrame(first, outbox.MESSAGE).repartition(4).coalesce(1).write.mode("append").parquet(source)
    assert outbox.published(spark, box).count() == 0
    with pytest.raises(Exception, match="midway"):
        streams.finish(outbox.deliver(_messages(spark, source, "b2").repartition(4), box, checkpoint))
    assert outbox.published(spark, box).count() == 0
    streams.finish(outbox.deliver(_messages(spark, source).repartition(4), box, checkpoint))
    spark.createDataFrame([("a", 2, 0, "later")], outbox.MESSAGE).coalesce(1).write.mode("append").parquet(source)
    for _ in range(2):  # the second run finds nothing new
        streams.finish(outbox.deliver(_messages(spark, source).repartition(4), box, checkpoint))
    got = outbox.published(spark, box).orderBy("chat", "issue", "part").collect()
    assert [tuple(r)[:4] for r in got] == sorted([*first, ("a", 2, 0, "later")]) and {r["batch"] for r in got} == {0, 1}


def test_a_batch_is_published_once(spark, tmp_path):
    """The query stopped between publishing and its checkpoint: the batch comes again and is thrown away."""
    writer, row = outbox.OutboxWriter(str(tmp_path / "box")), spark.createDataFrame([("a", 1, 0, "x")], outbox.MESSAGE).first()
    for _ in range(2):
        writer.commit([writer.write(iter([row])), writer.write(iter([])), None], 7)
    assert outbox.published(spark, str(tmp_path / "box")).count() == 1
    assert len(list((tmp_path / "box" / "staged").iterdir())) == 1
    writer.abort([writer.write(iter([row])), None], 8)
    assert len(list((tmp_path / "box" / "staged").iterdir())) == 1
    writer.commit([], 9)
    assert outbox.published(spark, str(tmp_path / "box")).count() == 1
