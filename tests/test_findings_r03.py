"""What the findings of round 3 were about."""

import os
import random
import statistics

import pyarrow as pa

from pyspark.sql import functions as F

from klaxon.operators import knowledge, prepare, rootcause, sessions


def test_medians_do_not_depend_on_arrival(spark):
    """Rows that come in another order each time that they are worked out, as blocks do that several executors send."""
    given = spark.range(0, 300_000, 1, 2).selectExpr("'a' AS k", "xxhash64(id) / 1e18D AS v")

    def mixed(batches):
        table = pa.Table.from_batches(batches)
        order = list(range(table.num_rows))
        random.Random(os.urandom(8)).shuffle(order)
        yield from table.take(pa.array(order)).combine_chunks().to_batches()

    rows = given.mapInArrow(mixed, "k string, v double")
    spark.conf.set("spark.sql.exchange.reuse", "false")
    try:
        found = [prepare.medians(rows, "k", "v").first()["median"] for _ in range(2)]
    finally:
        spark.conf.unset("spark.sql.exchange.reuse")
    assert found == [statistics.median(r["v"] for r in given.select("v").collect())] * 2


def test_one_long_incident_is_the_work_of_many_tasks(spark):
    """An incident that holds nearly all alarms, over two days; without adaptive execution, which would hide where rows go."""
    minute = "TIMESTAMP_NTZ'2024-01-01 00:00:00' + make_dt_interval(0, 0, id div 4)"
    rows = spark.range(12_000).selectExpr(
        f"{minute} AS ts", "id AS seq", "concat('T-', id % 5) AS tag", "'HI' AS level", "'HIGH' AS priority", "'ACTIVE' AS state", "'Z' AS zone", "'d' AS description"
    )
    later = rows.where("seq < 40").selectExpr("ts + INTERVAL 9 DAY AS ts", "seq + 20000 AS seq", "tag", "level", "priority", "state", "zone", "description")
    rows = rows.unionByName(later)
    most = lambda df: df.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "8"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        found = rootcause.segment_incidents(rows, 15)
        assert most(found) < 4_000
        assert {tuple(r) for r in found.groupBy("incident_id").count().collect()} == {("INC-00000", 12_000), ("INC-00001", 40)}
        stable = rootcause.stable_ids(found)
        assert most(stable) < 9_000 and {tuple(r) for r in stable.groupBy("incident_id").count().collect()} == {("INC-20240101T000000000000", 12_000), ("INC-20240110T000000000000", 40)}
        kept = knowledge.incident_tables(found, rootcause.rank_candidates(found), rootcause.incidents(found))["incident_alarms"]
        assert most(kept) < 4_000
        first = kept.where("incident_id = 'INC-00000'").orderBy("sequence_rank").collect()
        assert [r["sequence_rank"] for r in first] == list(range(1, 12_001)) and [r["tag"] for r in first] == [f"T-{k % 5}" for k in range(12_000)]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_detail_of_a_long_incident_is_sorted_in_pieces(spark, monkeypatch):
    """No one aggregate takes all alarms of an incident as they are; an hour with many of them is cut as well, also where all are of one minute."""
    monkeypatch.setattr(sessions, "SMALL", 0)
    monkeypatch.setattr(sessions, "SPLIT", 1_000)
    minute = "TIMESTAMP_NTZ'2024-01-01 00:00:00' + make_dt_interval(0, 0, if(id < 3000, 0, id div 10))"
    rows = spark.range(6_000).selectExpr("if(id % 100 = 99, 'B', 'A') AS incident_id", f"{minute} AS ts", "id AS seq", "concat('T-', id % 5) AS tag", "'HI' AS level", "'HIGH' AS priority").repartition(7)
    found = rows.select("incident_id").distinct()
    ranked = found.selectExpr("incident_id", "1 AS rank", "'T-0' AS tag", "0.5D AS confidence")
    history = found.where("incident_id = 'A'").selectExpr("incident_id", "TIMESTAMP_NTZ'2024-02-01 00:00:00' AS confirmed_at", "'x' AS id", "'c' AS confirmed_cause")
    whole = knowledge.incident_detail(found, rows, ranked, history)
    expected = {k: sorted(tuple(r)[1:] for r in rows.collect() if r["incident_id"] == k) for k in ("A", "B")}
    made = {r["incident_id"]: r for r in whole.collect()}
    assert {k: [tuple(x) for x in r["alarms"]] for k, r in made.items()} == expected
    assert [len(made[k]["confirmations"] or []) for k in ("A", "B")] == [1, 0]
    assert "collect_list(struct(ts" in (plan := whole._jdf.queryExecution().optimizedPlan().toString())
    assert all("_bucket" in line.split("[", 2)[1] for line in plan.splitlines() if "collect_list(struct(ts" in line)
    listed = knowledge.incident_detail(found, rows, ranked, history, alarm=F.col("seq"))
    assert {r["incident_id"]: r["alarms"] for r in listed.collect()} == {k: [x[1] for x in v] for k, v in expected.items()}
