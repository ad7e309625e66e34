"""Streams give what the batch operators give, once the watermark has passed."""

import random
from datetime import datetime, timedelta

import pytest

from klaxon.operators import analysis, knowledge, prepare
from klaxon.sources.base import Historian
from klaxon.sources.store import ParquetStore
from klaxon.streaming import accuracy
from klaxon.streaming import alarms as streaming

T0 = datetime(2024, 1, 1)
ROWS = "ts timestamp, seq long, tag string, level string, priority string, state string, transition string, site string, zone string, description string"


def drain(spark, tmp_path, name, rows, make, batches=1):
    path = str(tmp_path / name)
    size = -(-len(rows) // batches)
    for k in range(0, len(rows), size):
        spark.createDataFrame(rows[k : k + size], ROWS).coalesce(1).write.mode("append").parquet(path)
    last = [(T0 + timedelta(days=2), 10_000, "END", "HI", "LOW", "ACTIVE", "N2A", "end", "Z", "")]
    spark.createDataFrame(last, ROWS).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(ROWS).option("maxFilesPerTrigger", 1).parquet(path)
    q = make(stream).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / f"{name}-state")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def row(minute, k, tag, transition="N2A", priority="HIGH"):
    return (T0 + timedelta(minutes=minute), k, tag, "HI", priority, "ACTIVE", transition, "s", "Z", "")


def test_floods_and_sessions(spark, tmp_path):
    rows = [row(k * 0.5, k, f"T{k % 3}") for k in range(15)] + [row(40, 99, "T0")]
    batch = analysis.alarm_floods(spark.createDataFrame(rows, ROWS).selectExpr("cast(ts AS timestamp_ntz) AS ts", "seq", "tag", "level", "priority", "state"))
    got = drain(spark, tmp_path, "floods", rows, streaming.flood_windows).collect()
    assert [(r["window_start"], r["alarm_count"]) for r in got] == [(r["window_start"], r["alarm_count"]) for r in batch.collect()] == [(T0, 15)]
    found = drain(spark, tmp_path, "sessions", rows, streaming.incident_sessions).collect()
    assert [(r["site"], r["alarm_count"], r["tags"]) for r in found] == [("s", 15, 3)]


def test_sessions_of_one_tag_do_not_qualify(spark, tmp_path):
    rows = [row(k, k, "T") for k in range(5)] + [row(60 + k, 10 + k, f"T{k % 2}") for k in range(5)]
    for exact in (False, True):
        found = drain(spark, tmp_path, f"tags_{exact}", rows, lambda s: streaming.incident_sessions(s, exact=exact)).collect()  # noqa: B023
        assert [(r["start_ts"], r["tags"]) for r in found] == [(T0 + timedelta(minutes=60), 2)]
    plan = streaming.incident_sessions(spark.createDataFrame(rows, ROWS))._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_set" not in plan


def closed(spark, tmp_path, name, rows, batches):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    got = drain(spark, tmp_path, name, rows, streaming.closed_episodes, batches).where("tag <> 'END'").collect()
    return sorted((r["tag"], r["start_ts"], r["end_ts"], r["implicit"]) for r in got)


def wanted(spark, rows):
    tx = spark.createDataFrame(rows, ROWS).selectExpr("cast(ts AS timestamp_ntz) AS ts", "seq", "tag", "level", "priority", "zone", "description", "transition")
    return sorted((r["tag"], r["start_ts"], r["end_ts"], r["implicit"]) for r in prepare.episodes(tx).where("NOT standing").collect())


def test_closed_episodes_in_any_order_of_arrival(spark, tmp_path):
    """Rows that come up to 8 minutes after later ones, over several batches, ties by seq: as the batch operator has them."""
    r = random.Random(3)
    rows = [row(k // 3, k, f"T{r.randrange(2)}", r.choice(["N2A", "A2A", "A2N"])) for k in range(60)]
    late = sorted(rows, key=lambda x: x[0] + timedelta(minutes=r.random() * 8))
    assert late != rows
    assert closed(spark, tmp_path, "any_order", late, 4) == wanted(spark, rows)


def test_rows_behind_the_watermark_are_dropped(spark, tmp_path):
    rows = [row(0, 0, "T", "N2A"), row(30, 1, "T", "A2N"), row(60, 2, "T", "N2A"), row(10, 3, "T", "A2N"), row(61, 4, "T", "A2N")]
    assert closed(spark, tmp_path, "dropped", rows, 5) == wanted(spark, [x for x in rows if x[1] != 3])


def test_accuracy_folded_batch_by_batch(spark, tmp_path):
    """After each batch, and after one that runs twice, as the query over all confirmations."""
    store, source = ParquetStore(spark, str(tmp_path / "s")), str(tmp_path / "in")
    store.append(spark.sql("SELECT concat('I', id) AS incident_id, 'T' AS tag, 'm' AS method, 1 AS rank FROM range(40)"), "candidates")
    candidates = store.read("candidates")
    for k in range(3):
        rows = spark.sql(f"SELECT concat('I', id % 40) AS incident_id, id % 3 = 0 AS engine_top_pick_correct, timestampadd(HOUR, cast(id * 7 AS int), timestamp_ntz'2024-01-01 00:00:00') AS confirmed_at FROM range({k * 20}, {k * 20 + 20})")
        store.shaped(rows, "kb_confirmations").write.mode("append").parquet(source)
        stream = spark.readStream.schema(store.read("kb_confirmations").schema).parquet(source)
        accuracy.fold_accuracy(stream, store, str(tmp_path / "c")).awaitTermination(120)
        with store.batch("accuracy-0") as again:
            again.append(store.read("accuracy_parts"), "accuracy_parts")
        want = knowledge.accuracy_by_day(spark.read.parquet(source), candidates).collect()
        assert {tuple(r) for r in accuracy.accuracy(store).collect()} == {tuple(r) for r in want} and len(want) > 4
    assert accuracy.confirmed_so_far(store).first() == (60, 20)


def test_exported_folders_in_batch_and_as_a_stream(spark, tmp_path):
    folder = tmp_path / "export"
    export = lambda k, sql: spark.sql(sql).coalesce(1).write.parquet(str(folder / f"day={k}"))
    source = Historian(spark, samples=f"file://{folder}", alarms=str(folder))
    assert source.process_samples().collect() == []
    export(1, "SELECT timestamp_ntz'2024-01-01 00:00:00' AS ts, 'A' AS tag, 1.5D AS value, 'x' AS other")
    export(2, "SELECT timestamp_ntz'2024-01-02 00:00:00' AS ts, 'B' AS tag")
    assert sorted(map(tuple, source.process_samples().select("tag", "value").collect()), key=str) == [("A", 1.5), ("B", None)] and source.process_samples().rdd.getNumPartitions() == 2
    assert source.alarm_events().count() == 2 and source.alarm_events().columns[:3] == ["ts", "seq", "tag"]

    def run():
        q = source.sample_stream().writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).start()
        q.processAllAvailable()
        q.stop()
        return sorted(r["tag"] for r in spark.read.parquet(str(tmp_path / "out")).collect())

    assert run() == ["A", "B"]
    export(3, "SELECT timestamp_ntz'2024-01-03 00:00:00' AS ts, 'C' AS tag, 2.5D AS value")
    assert run() == ["A", "B", "C"]  # what the checkpoint has is not taken again
