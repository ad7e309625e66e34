"""The CSV log, the store, the service over them, and the synthetic plant."""

import csv
import io
import json
import os
import random
import threading
from urllib.parse import urlparse

import pytest

from klaxon import schema
from klaxon.operators import rootcause
from klaxon.plans import report
from klaxon.plans.service import Service
from klaxon.sources import alarm_log, base, csv_scan
from klaxon.sources.base import Historian
from klaxon.sources.store import Batch, ParquetStore
from klaxon.sources.synthetic import SyntheticPlant

LINES = [
    '01-02-2024 10:00,1,1-AB-C-02-X,1 - High,N2A,msg,,LifeSafety,,,,,,,Gas leak caf\xe9',
    '01-02-2024 10:05,1,1-AB-C-02-X,1 - High,a2n ,msg,,LifeSafety,,,,,,,Gas leak caf\xe9',
    '01-02-2024 10:06,1,,x,A2A,fallback,,,,,,,,,',
    'nonsense,1,P,x,A2A,m,,,,,,,,,m',
    '01-02-2024 10:07,1,P,x,XXX,m,,,,,,,,,m',
]


@pytest.mark.parametrize("encoding", ["utf-8", "latin-1"])
def test_log(spark, tmp_path, encoding):
    path = tmp_path / "log.csv"
    path.write_bytes("\n".join([",".join(alarm_log.COLUMNS), *LINES]).encode(encoding))
    log = alarm_log.AlarmLog.read(spark, str(path))
    rows = log.transitions.orderBy("seq").collect()
    assert [(r["tag"], r["transition"], r["level"], r["priority"], r["zone"]) for r in rows] == [
        ("1-AB-C-02-X", "N2A", "GAS", "CRITICAL", "AB-02"),
        ("1-AB-C-02-X", "A2N", "GAS", "CRITICAL", "AB-02"),
        ("UNKNOWN-ASSET", "A2A", "GENERAL", "LOW", "UNKNOWN"),
    ]
    assert rows[0]["message"] == "Gas leak café" and log.rejected().first()["rejected"] == 2
    assert alarm_log.AlarmLog.read(spark, str(path), start="2024-02-01 10:05:00", end="2024-02-01 10:05:00").transitions.count() == 1
    assert log.process_samples().collect() == [] and log.alarm_events().count() == 3
    store = ParquetStore(spark, str(tmp_path / "store"))
    assert report.ingest_log(spark, store, str(path)) == 2
    assert store.read("episodes").count() == 2 and store.meta()["kind"] == "real"


def test_log_quotes_line_ends_and_white_space(spark, tmp_path):
    path = tmp_path / "log.csv"
    lines = ['01-02-2024 10:00,1,"\t A-B ",3 - Low,N2A,m,,,,,,,,,"He said ""fan, on"" now"', '01-02-2024 10:01,1,C,3 - Low,\tA2A,m,,,,,,,,,"two\nlines"', "01-02-2024 10:02,1,C,3 - Low,?,m,,,,,,,,,x", "01-02-2024 11:00,1,C,3 - Low,?,m,,,,,,,,,x", "bad,1,C,3 - Low,A2N,m,,,,,,,,,x"]
    path.write_text("\n".join([",".join(alarm_log.COLUMNS), *lines]))
    log = alarm_log.AlarmLog.read(spark, str(path))
    assert [(r["tag"], r["zone"], r["transition"], r["message"]) for r in log.transitions.orderBy("seq").collect()] == [("A-B", "A", "N2A", 'He said "fan, on" now'), ("C", "C", "A2A", "two\nlines")]
    assert log.rejected().first()["rejected"] == 3
    # Unknown transitions count inside the window only, bad times everywhere.
    assert alarm_log.AlarmLog.read(spark, str(path), end="2024-02-01 10:30:00").rejected().first()["rejected"] == 2


@pytest.fixture
def small_blocks(spark):
    for k, v in (("maxPartitionBytes", "64"), ("openCostInBytes", "64")):
        spark.conf.set(f"spark.sql.files.{k}", v)
    yield
    for k in ("maxPartitionBytes", "openCostInBytes"):
        spark.conf.unset(f"spark.sql.files.{k}")


FIELDS = ["", "x", 'say ""hi""', "two\nlines", "a,b", "\n\n", "a\r\nb", 'five "" inch', "long " * 60, "long\nlines\n" * 30, '""', "caf\xe9"]


def csv_rows(n, seed=4):
    r = random.Random(seed)
    rows = [[r.choice(FIELDS).replace('""', '"') if r.random() < 0.5 else r.choice(["1", 'mid"quote', "plain"]) for _ in range(3)] for _ in range(n)]
    return [row for row in rows if "".join(row).strip()]


def as_csv(rows, end="\n"):
    quoted = lambda f: '"' + f.replace('"', '""') + '"' if any(c in f for c in ',\r\n') or f.startswith('"') or "hi" in f else f
    return "".join(",".join(map(quoted, row)) + end for row in [["a", "b", "c"], *rows])


@pytest.mark.parametrize("end", ["\n", "\r\n"])
@pytest.mark.parametrize("small", [True, False])
def test_csv_scan_against_the_csv_module(spark, tmp_path, request, small, end):
    """Files of uneven sizes, cut into blocks of 64 bytes: every record, in the order of the files' names."""
    if small:
        request.getfixturevalue("small_blocks")
    want = []
    for k, n in enumerate([3, 30, 1, 0, 12]):
        rows = csv_rows(n, k)
        (tmp_path / f"part{k}.csv").write_bytes(as_csv(rows, end).encode())
        want += rows
        assert rows == [x for x in csv.reader(io.StringIO(as_csv(rows, end), newline=""))][1:]
    raw = csv_scan.read_records(spark, str(tmp_path), ["a", "b", "c"])
    got = raw.orderBy("seq").collect()
    assert [[x or "" for x in r[1:]] for r in got] == want and len({r["seq"] for r in got}) == len(want)
    if small:
        assert raw.rdd.getNumPartitions() > 20


def test_csv_scan_of_odd_files(spark, tmp_path, small_blocks):
    path = tmp_path / "f.csv"
    path.write_bytes(b"\xef\xbb\xbfA,b,c\r\n1,2\r\n\r\n  \n" + b'3,"open\n' + b"x" * 200 + b"\nmore")
    got = csv_scan.read_records(spark, str(path), ["a", "b", "c"]).orderBy("seq").collect()
    assert [tuple(r)[1:3] for r in got] == [("1", "2"), ("3", "open\n" + "x" * 200 + "\nmore")]
    path.write_bytes(b"a,b,c\n" + "caf\xe9,1,2\n".encode("latin-1") * 50)
    assert {r["a"] for r in csv_scan.read_records(spark, str(path), ["a", "b", "c"]).collect()} == {"caf\xe9"}
    path.write_bytes(b"a,c,b\n1,2,3\n")
    with pytest.raises(Exception, match="begins with"):
        csv_scan.read_records(spark, str(path), ["a", "b", "c"]).collect()


def test_csv_states_against_every_prefix():
    r = random.Random(2)
    for _ in range(500):
        lines = "".join(r.choice('ab,"\n') for _ in range(30)).split("\n")
        inside = False
        for k, line in enumerate(lines):
            inside = csv_scan.ends_inside(line.encode(), inside)
            state = [False, True]
            for x in lines[: k + 1]:
                state = [csv_scan.ends_inside(x.encode(), s) for s in state]
            assert state[0] == inside


def test_a_clear_in_a_later_file_ends_the_episode(spark, tmp_path):
    """Same minute; the file of the clear is the larger one, which Spark reads first."""
    head, line = ",".join(alarm_log.COLUMNS), "01-02-2024 10:00,1,T,x,{},m,,,,,,,,,fan"
    (tmp_path / "a.csv").write_text("\n".join([head, line.format("N2A")]))
    (tmp_path / "b.csv").write_text("\n".join([head, line.format("A2N"), *["bad,1,T,x,N2A,m,,,,,,,,,x"] * 500]))
    found = alarm_log.AlarmLog.read(spark, str(tmp_path)).episodes.collect()
    assert [(r["implicit"], r["standing"], r["duration_min"]) for r in found] == [(False, False, 0.0)]


def test_commands(spark, tmp_path):
    from klaxon.__main__ import main

    path, store = tmp_path / "log.csv", str(tmp_path / "store")
    path.write_text("\n".join([",".join(alarm_log.COLUMNS), *LINES]))
    assert main(["ingest", store, str(path)], spark) == "2 rows rejected"
    assert "== Bad actors\ntag" in main(["report", store], spark)
    assert "summary" in json.loads(open(main(["dump", store, str(tmp_path / "p.json")], spark)).read())


def test_store(spark, tmp_path):
    store = ParquetStore(spark, str(tmp_path / "s"))
    assert store.meta() == {} and store.read("alarms").collect() == []
    store.append_rows([], "process_samples")
    store.append(spark.sql("SELECT timestamp_ntz'2024-01-01 00:00:00' AS ts, 'T' AS tag, 'extra' AS other"), "alarms")
    store.append(spark.sql("SELECT timestamp_ntz'2024-01-02 00:00:00' AS ts, 'U' AS tag, 'HI' AS level"), "alarms")
    assert store.sql("SELECT tag, level FROM alarms ORDER BY tag").collect() == [("T", None), ("U", "HI")]
    store.set_meta(a="1", b="2")
    store.set_meta(a="3")
    assert store.meta() == {"a": "3", "b": "2"}
    assert report.truth_of(store) is None
    store.reset()
    assert store.meta() == {} and store.read("alarms").collect() == []


def test_a_failed_batch_is_never_seen(spark, tmp_path):
    store, row = ParquetStore(spark, str(tmp_path / "s")), spark.sql("SELECT timestamp_ntz'2024-01-01 00:00:00' AS ts, 'T' AS tag, 'I' AS incident_id")
    store.append(row, "alarms")
    for replaces in (False, True):
        with pytest.raises(KeyError), store.batch("b", replaces) as batch:
            batch.append(row, "incident_alarms")
            batch.append(row, "incidents")
            raise KeyError
        assert store.read("incidents").count() == store.read("incident_alarms").count() == 0 and store.read("alarms").count() == 1
    for _ in range(2):  # the retry, and one more that finds it done
        with store.batch("b") as batch:
            batch.append(row, "incident_alarms")
            batch.append(row, "incidents")
    assert store.read("incidents").count() == store.read("incident_alarms").count() == 1
    store.set_meta(a="1")
    store.set_meta(a="2", b="3")
    store.compact()
    assert len(store.visible()) == 1 and store.meta() == {"a": "2", "b": "3"} and store.read("incidents").count() == store.read("alarms").count() == 1
    store.reset()
    assert store.meta() == {} and store.read("incidents").count() == 0
    with pytest.raises(ValueError, match="already"), store.batch() as batch:
        batch.append(row, "alarms")
        batch.append(row, "alarms")


def test_time_range_reads_only_its_days(spark, tmp_path):
    store = ParquetStore(spark, str(tmp_path / "s"))
    rows = spark.sql("SELECT timestampadd(HOUR, cast(id AS int), timestamp_ntz'2024-01-01 00:00:00') AS ts, 'T' AS tag FROM range(24 * 20) UNION ALL SELECT null, 'N'")
    store.append(rows, "alarms")
    some = store.read("alarms", "2024-01-05 00:00:00", "2024-01-07 00:00:00")
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan and "day#" in plan.split("PartitionFilters: [")[1]
    assert some.count() == 49
    assert store.read("alarms", start="2024-01-20 23:00:00").count() == 1 and store.read("alarms", end="2024-01-01 00:00:00").count() == 1 and store.read("alarms").count() == 481
    assert store.sql("SELECT * FROM alarms", "2024-01-02 00:00:00", "2024-01-02 23:59:59").count() == 24


def test_incidents_keep_their_ids(spark, tmp_path):
    """Earlier days, late alarms that widen an incident, and a crash between the tables."""
    store = ParquetStore(spark, str(tmp_path / "s"))
    event = "timestamp_ntz '{}' AS ts, {}L AS seq, '{}' AS tag, 'HI' AS level, 'HIGH' AS priority, 'ACTIVE' AS state"
    one = lambda at, k: spark.sql(" UNION ALL ".join("SELECT " + event.format(f"{at}:0{j}:00", k + j, "AB"[j % 2]) for j in range(3)))
    store.append(one("2024-01-05 10", 0), "alarms")
    assert Service(store).record_incidents() == 1
    first = store.read("incidents").first()
    assert first["incident_id"] == "INC-20240105T100000000000"
    store.append(one("2024-01-02 08", 10), "alarms")
    store.append(one("2024-01-05 10", 20).selectExpr("ts - INTERVAL 5 MINUTES AS ts", "seq", "tag", "level", "priority", "state"), "alarms")
    append, service = Batch.append, Service(store)

    def dies(self, df, table):
        if table == "candidates":
            raise InterruptedError
        append(self, df, table)

    with pytest.MonkeyPatch.context() as m, pytest.raises(InterruptedError):
        m.setattr(Batch, "append", dies)
        service.record_incidents()
    assert store.read("incidents").count() == 1 and store.read("incident_alarms").count() == 3
    assert service.record_incidents() == 1 and service.record_incidents() == 0
    assert {r["incident_id"] for r in store.read("incidents").collect()} == {first["incident_id"], "INC-20240102T080000000000"}
    assert store.read("incident_alarms").count() == 6 and {r["incident_id"] for r in store.read("candidates").collect()} == {r["incident_id"] for r in store.read("incidents").collect()}


def test_payload_has_whole_lists(spark, tmp_path):
    """More floods and cause hints than any limit that the lists once had."""
    store, n = ParquetStore(spark, str(tmp_path / "s")), 5_100
    store.append(spark.sql(f"SELECT timestampadd(MINUTE, cast(id div 11 * 30 AS int), timestamp_ntz'2024-01-01 00:00:00') AS ts, id AS seq, concat('T', id div 11, '-', id % 2) AS tag, 'HI' AS level, 'HIGH' AS priority, 'ACTIVE' AS state FROM range({11 * n})"), "alarms")
    payload = Service(store).payload()
    assert len(payload["floods"]) == n and len(payload["cause_hints"]) > 5_000
    assert payload["floods"][0]["window_start"] > payload["floods"][-1]["window_start"]


def test_historian(spark):
    with pytest.raises(NotImplementedError):
        Historian(spark).process_samples()


def test_plant_and_service(spark, tmp_path):
    store = ParquetStore(spark, str(tmp_path / "p"))
    plant = report.ingest_synthetic(spark, store, days=3, sample_seconds=3600, incidents_per_day=1.4)
    assert plant.n == 4 and store.read("process_samples").count() == 72 * len(schema.PLANT_TAGS)
    assert plant.alarm_events().collect() == SyntheticPlant(spark, days=3, sample_seconds=3600).alarm_events().collect()
    service = Service(store)
    assert rootcause.validate(service.ranked, plant.ground_truth()).first()["accuracy"] == 1.0
    first = service.incident_list(1).first()["incident_id"]
    done = service.confirm(first, action_taken="Reset the valve")
    assert done["prior_matches"] == 0 and service.confirm(first)["prior_matches"] == 1
    assert service.confirm("none") == {"error": "unknown incident"}
    assert service.kb_stats()["total"] == 2 and service.kb_stats()["engine_accuracy"]["confirmations"] == 2
    assert service.recommendations(first).where("source = 'knowledge base'").count() == 1
    answer = service.recommendation_answers(first).first()
    assert answer["known_case"] and answer["signature"]["root_tag"] and 1 <= len(answer["recommendations"]) <= 5
    assert not service.recommendation_answers().where(f"incident_id <> '{first}' AND NOT known_case").isEmpty()
    assert service.record_incidents("unit 1") == 4 and service.record_incidents() == 0
    assert store.read("incidents").where("status = 'open' AND unit = 'unit 1'").count() == 4 and store.read("incident_alarms").count() == service.labelled.count() and store.read("candidates").count() == service.ranked.count()
    payload = service.payload()
    assert payload["summary"]["incidents"] == 4 and json.dumps(payload)
    assert "== Root cause" in report.report(service, plant.ground_truth(), 3)
    assert "accuracy" in report.report(service, report.truth_of(store), 3) and "1.0" in report.report(service, report.truth_of(store), 3).split("== Validation")[1]


def test_scratch_goes_with_its_block(spark, tmp_path, monkeypatch):
    made, own = [], base.scratch_folder
    monkeypatch.setattr(base, "scratch_folder", lambda s: made.append(own(s)) or made[-1])
    kept = lambda: [os.path.exists(urlparse(p).path) for p in made]
    with base.scratch():
        outer, elsewhere = base.written(spark.range(5)), []
        other = threading.Thread(target=lambda: elsewhere.append(base.written(spark.range(7))))
        other.start()
        other.join()
        with pytest.raises(ZeroDivisionError), base.scratch():
            base.written(spark.range(3))
            base.scratch_folder(spark)  # nothing is written there
            assert kept() == [True, True, True, False]
            1 / 0  # noqa: B018
        assert kept() == [True, True, False, False] and outer.count() == 5
    assert kept() == [False, True, False, False] and elsewhere[0].count() == 7
    store = ParquetStore(spark, str(tmp_path / "store"))
    store.append(spark.sql("SELECT timestamp_ntz'2024-01-01 00:00:00' AS ts, 0L AS seq, 'T' AS tag, 'HI' AS level, 'HIGH' AS priority, 'ACTIVE' AS state"), "alarms")
    service = Service(store)
    assert service.kpis() and service.summary()["total_alarms"] == 1
    assert len(made) > 4 and not any(kept()[4:])
