"""Hand-made cases: edges, ties, nulls, empty input; and brute force on random alarms."""

import random
import statistics
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from klaxon import schema
from klaxon.functions import alarms as fn
from klaxon.operators import analysis, knowledge, kpis, prepare, rootcause, sessions
from klaxon.operators.sessions import gap_sessions, neighbours, numbered, positions

T0 = datetime(2024, 1, 1)
COLUMNS = "ts timestamp_ntz, seq long, tag string, level string, priority string, state string, value double, zone string, description string"


def at(minutes):
    return T0 + timedelta(minutes=minutes)


def alarms(spark, rows):
    """rows: (minute, tag, level, priority)"""
    return spark.createDataFrame([(at(m), k, t, level, p, "ACTIVE", 1.0, "Z", None) for k, (m, t, level, p) in enumerate(rows)], COLUMNS)


def transitions(spark, *moves):
    """moves: (minute, transition)"""
    rows = [(at(m), k, "T", "HI", "LOW", "Z", "d", x) for k, (m, x) in enumerate(moves)]
    return spark.createDataFrame(rows, "ts timestamp_ntz, seq long, tag string, level string, priority string, zone string, description string, transition string")


@pytest.mark.parametrize(
    ("moves", "states", "ends"),
    [
        ([(0, "A2N")], ["ACTIVE", "CLEARED"], [(0, 0, None, True, False)]),
        ([(0, "N2A"), (2, "A2A"), (5, "A2N")], ["ACTIVE", "ACTIVE", "CLEARED"], [(0, 2, 2.0, False, False), (2, 5, 3.0, False, False)]),
        ([(0, "N2A"), (2, "N2A"), (5, "A2N")], ["ACTIVE", "ACTIVE", "CLEARED"], [(2, 5, 3.0, False, False)]),
        ([(0, "N2A")], ["ACTIVE"], [(0, None, None, False, True)]),
        ([(0, "A2N"), (0, "N2A")], ["ACTIVE", "ACTIVE", "CLEARED"], [(0, 0, None, True, False), (0, None, None, False, True)]),
        ([(0, "N2A"), (100_000, "A2N")], ["ACTIVE", "CLEARED"], [(0, 100_000, 100_000.0, False, False)]),
    ],
)
def test_episodes(spark, moves, states, ends):
    tx = transitions(spark, *moves)
    assert sorted(r["state"] for r in prepare.alarm_events(tx).collect()) == states
    got = [(r["start_ts"], r["end_ts"], r["duration_min"], r["implicit"], r["standing"]) for r in prepare.episodes(tx).orderBy("start_ts", F.desc("implicit")).collect()]
    assert got == [(at(a), None if b is None else at(b), d, i, s) for a, b, d, i, s in ends]


def test_chattering_ties_and_edge(spark):
    tied = alarms(spark, [(0, "A", "HI", "LOW")] * 3)
    assert analysis.chattering(tied).collect()[0]["chattering_events"] == 1
    edge = alarms(spark, [(0, "A", "HI", "LOW"), (0.5, "A", "HI", "LOW"), (1, "A", "HI", "LOW")])
    assert analysis.chattering(edge).collect()[0]["chattering_events"] == 1
    assert analysis.chattering(alarms(spark, [(0, "A", "HI", "LOW"), (0.5, "A", "HI", "LOW"), (1.02, "A", "HI", "LOW")])).collect() == []
    # The bucket that a run of events is cut at makes no difference.
    rows = alarms(spark, [(k / 10, "A", "HI", "LOW") for k in range(50)])
    assert analysis.chattering(rows).collect() == analysis.chattering(rows, bucket_s=60).collect()


def test_session_edge(spark):
    rows = alarms(spark, [(0, "A", "HI", "HIGH"), (15, "B", "HI", "LOW"), (30.02, "A", "HI", "LOW")])
    assert [r["session"] for r in gap_sessions(rows, 15).orderBy("seq").collect()] == [0, 0, 1]
    found = rootcause.segment_incidents(rows, 15, min_alarms=2)
    assert [r["incident_id"] for r in found.orderBy("seq").collect()] == ["INC-00000", "INC-00000", None]


def brute_pairs(rows, reach, window):
    out = {}
    for i, x in enumerate(rows):
        for y in rows[i + 1 : i + 1 + reach]:
            if y[0] - x[0] <= window and x[1] != y[1]:
                key = tuple(sorted((x[1], y[1])))
                out[key] = out.get(key, 0) + 1
    return out


@pytest.mark.parametrize("seed", range(3))
def test_random_alarms(spark, seed):
    r = random.Random(seed)
    rows = sorted((r.choice([r.randint(0, 3000), r.randint(0, 100), 50]), f"T{r.randint(0, 5)}", r.choice(["HI", "LO"]), r.choice(list(schema.PRIORITY_RANK))) for _ in range(400))
    df = alarms(spark, rows).repartition(5)
    pairs = {(x["tag_a"], x["tag_b"]): x["co_occurrences"] for x in analysis.co_occurrence(df, top=None, max_neighbours=7).collect()}
    assert pairs == {k: n for k, n in brute_pairs(rows, 7, 15).items() if n >= 3}
    assert [x["pos"] for x in positions(df).orderBy("seq").collect()] == list(range(400))
    session, want = 0, []
    for k, x in enumerate(rows):
        session += k > 0 and x[0] - rows[k - 1][0] > 5
        want.append(session)
    assert [x["session"] for x in gap_sessions(df, 5).orderBy("seq").collect()] == want
    met = neighbours(df, ["tag", "level"], {"seq": F.col("seq")}, width=60 * 60_000_000).orderBy("seq").collect()
    for k, x in enumerate(met):
        same = [j for j, y in enumerate(rows) if y[1:3] == rows[k][1:3]]
        p = same.index(k)
        assert (x["prev"] and x["prev"]["seq"]) == (same[p - 1] if p else None)
        assert (x["next"] and x["next"]["seq"]) == (same[p + 1] if p + 1 < len(same) else None)


def test_sequences(spark):
    rows = alarms(spark, [(0, "A", "HI", "LOW"), (1, "A", "HI", "LOW"), (2, "B", "LO", "CRITICAL"), (3, "C", "HI", "LOW"), (100, "D", "HI", "CRITICAL")])
    assert [tuple(r) for r in analysis.pre_incident_sequences(rows).collect()] == [("A:HI -> B:LO", 1)]


@pytest.mark.parametrize("stays", [0, 0.5, 0.97])
def test_sequences_of_an_endless_session(spark, stays):
    """A session over many days, cut at every day, against plain Python."""
    r = random.Random(4)
    tags = ["T0"]
    for _ in range(399):
        tags.append(tags[-1] if r.random() < stays else f"T{r.randint(0, 2)}")
    rows = alarms(spark, [(k * 20, t, "HI", "CRITICAL" if r.random() < 0.02 else "LOW") for k, t in enumerate(tags)])
    kept = [(x["tag"], x["priority"]) for x in rows.orderBy("seq").collect()]
    last = max(k for k, x in enumerate(kept) if x[1] == "CRITICAL")
    steps = [f"{t}:HI" for k, (t, _) in enumerate(kept[: last + 1]) if not k or kept[k - 1][0] != t]
    assert [tuple(x) for x in analysis.pre_incident_sequences(rows).collect()] == [(" -> ".join(steps[-5:]), 1)]


@pytest.mark.parametrize("block", [1, 7, 10_000])
def test_numbers_in_blocks(spark, block):
    keys = random.Random(2).sample(range(500), 60)
    got = {x["k"]: x["number"] for x in numbered(spark.createDataFrame([(k,) for k in keys], "k long"), "k", block).collect()}
    assert got == {k: n for n, k in enumerate(sorted(keys))}


def test_match_against_brute_force(spark):
    r = random.Random(7)
    kinds = lambda: sorted(r.sample("ABCD", r.randint(1, 3)))
    sig = [(f"I{k}", r.choice("XY"), kinds(), r.choice(["Z", None]), "s") for k in range(40)]
    past = [(f"c{k:02}", f"s{k % 5}", "I", r.choice("XY"), kinds(), r.choice(["Z", "W", None]), f"cause{k}", "", "op", True, at(r.randint(0, 6))) for k in range(60)]
    want = {}
    for i, tag, types, zone, _ in sig:
        best = None
        for c in past:
            j = len(set(types) & set(c[4])) / len(set(types) | set(c[4]))
            if c[3] == tag and j >= 0.5:
                best = max(filter(None, [best, (j + 0.15 * (c[5] == zone), c[10], c[0], c[6])]))
        if best:
            want[i] = best[3]
    frames = spark.createDataFrame(sig, "incident_id string, root_tag string, alarm_types array<string>, zone string, signature string"), spark.createDataFrame(past, schema.CONFIRMATIONS)
    assert {x["incident_id"]: x["confirmed_cause"] for x in knowledge.match(*frames).collect()} == want
    assert knowledge.with_json_types(frames[1]).where("id = 'c00'").first()["alarm_types"] == "[" + ",".join(f'"{t}"' for t in past[0][4]) + "]"


def test_root_cause_ties_and_zero_span(spark):
    rows = alarms(spark, [(0, "B", "HI", "HIGH"), (0, "A", "HI", "HIGH"), (0, "B", "HI", "LOW")])
    lab = rootcause.labelled(rows)
    assert {r["tag"]: r["initiations"] for r in rootcause.initiation_rates(lab).collect()} == {"A": 1, "B": 1}
    top = rootcause.rank_candidates(lab).orderBy("rank").collect()
    assert [r["tag"] for r in top] == ["A", "B"] and top[0]["confidence"] == 1.0 and "fired first" in top[0]["explanation"]


@pytest.mark.parametrize(("types", "matches"), [(["B", "C"], 0), (["A", "B"], 1), (["A"], 1)])
def test_match_needs_half_of_the_types(spark, types, matches):
    sig = spark.createDataFrame([("I1", "T", ["A", "B"], None, "s")], "incident_id string, root_tag string, alarm_types array<string>, zone string, signature string")
    history = spark.createDataFrame([("c", "s", "I0", "T", types, None, "cause", "", "op", True, T0)], schema.CONFIRMATIONS)
    assert knowledge.match(sig, history).count() == matches


def test_interpolation(spark):
    values = {1: 1.0, 6: 6.0, 0: None, 10: None}
    s = spark.createDataFrame([(at(k), "x", v) for k, v in values.items()], "ts timestamp_ntz, tag string, value double")
    got = [r["value"] for r in prepare.align_tags(s).orderBy("ts").collect()]
    assert got == [None, 1, 2, 3, 4, None, 6, 6, 6, 6, None]
    assert prepare.pivot_tags(prepare.align_tags(s), ["x"]).columns == ["ts", "x"]


@pytest.mark.parametrize("pieces", [2, 200])
def test_medians_are_exact(spark, pieces):
    r = random.Random(13)
    values = {"hot": [r.gauss(0, 9) for _ in range(1201)], "even": [r.gauss(5, 1) for _ in range(300)], "ties": [float(r.randint(0, 3)) for _ in range(400)], "two": [1.0, 4.0], "one": [7.0], "none": [None]}
    df = spark.createDataFrame([(k, v) for k, vs in values.items() for v in vs], "tag string, value double").repartition(4)
    got = {x["tag"]: x["median"] for x in prepare.medians(df, "tag", "value", pieces).collect()}
    assert got == {k: pytest.approx(statistics.median(vs)) for k, vs in values.items() if vs != [None]}


def test_outliers(spark):
    s = spark.createDataFrame([(at(k), "flat", 5.0) for k in range(9)] + [(at(k), "t", float(k % 3)) for k in range(9)] + [(at(9), "t", 1000.0), (at(10), "n", None)], "ts timestamp_ntz, tag string, value double")
    assert [r["value"] for r in prepare.flag_outliers(s).where("outlier").collect()] == [1000.0]


def test_scalars(spark):
    df = spark.createDataFrame([("1-JK-J-00-D",), ("A-B",), ("X",), ("",), (None,)], "a string")
    assert [r[0] for r in df.select(fn.zone_of(F.col("a"))).collect()] == ["JK-00", "A", "X", "UNASSIGNED", "UNASSIGNED"]
    p = spark.createDataFrame([("1 - High", "LifeSafety", "GENERAL"), ("2 - medium ", "", "GENERAL"), (None, "HVAC-High", "GENERAL"), (None, None, None), ("x", "x", "GAS")], "s string, c string, t string")
    assert [r[0] for r in p.select(fn.map_priority(F.col("s"), F.col("c"), F.col("t"))).collect()] == ["CRITICAL", "MEDIUM", "HIGH", "LOW", "CRITICAL"]


def test_empty_input(spark):
    none = alarms(spark, [(0, "A", "HI", "LOW")]).where("false")
    tx = transitions(spark, (0, "N2A")).where("false")
    for df in (analysis.bad_actors(none), analysis.chattering(none), analysis.alarm_floods(none), analysis.co_occurrence(none), analysis.pre_incident_sequences(none), kpis.alarm_rate(none), kpis.zone_load(none), prepare.episodes(tx), prepare.alarm_events(tx), rootcause.segment_incidents(none)):
        assert df.collect() == []
    assert kpis.priority_distribution(none).count() == 4
    assert kpis.time_to_clear(prepare.episodes(tx)).first()["timed_episodes"] == 0
    assert rootcause.validate(rootcause.rank_candidates(rootcause.labelled(none)), none.select(F.lit("i").alias("incident_id"), F.col("tag").alias("root_tag"))).first()["accuracy"] == 0.0


def test_quantiles_are_exact(spark):
    """Against numpy: ties, one number, no number, pieces that hold several places; no aggregate that holds the numbers."""
    r = np.random.default_rng(4)
    for values in (r.integers(0, 40, 999).astype(float), r.normal(size=2000), np.array([7.0]), np.array([1.0, 2.0]), np.repeat([3.0, 9.0], [500, 501])):
        rows = spark.createDataFrame([(float(v),) for v in values], "v double").groupBy("v").agg(F.count("*").alias("n"))
        got = kpis.quantiles(rows, {"a": 0.5, "b": 0.9, "c": 0.0, "d": 1.0}, pieces=20)
        assert got.first().asDict() == pytest.approx(dict(zip("abcd", np.quantile(values, [0.5, 0.9, 0, 1]), strict=True)))
    assert "percentile(" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert kpis.quantiles(rows.limit(0), {"a": 0.5}).first()["a"] is None


def test_key_figures_read_alarms_and_episodes_once(spark, tmp_path):
    """The last plan reads the two tables of counts alone."""
    a = spark.sql("SELECT timestampadd(MINUTE, cast(id AS int), timestamp_ntz'2024-01-01 00:00:00') AS ts, id AS seq, concat('T', id % 9) AS tag, 'HI' AS level, if(id % 4 = 0, null, 'HIGH') AS priority, if(id % 3 = 0, 'CLEARED', 'ACTIVE') AS state, 'Z' AS zone, 'N2A' AS transition, 'd' AS description FROM range(400)")
    a.write.parquet(str(tmp_path / "source"))
    a = spark.read.parquet(str(tmp_path / "source"))
    out = kpis.summary_kpis(a, prepare.episodes(a))
    assert "source" not in out._jdf.queryExecution().executedPlan().toString() and "klaxon-core" in str(out.inputFiles())
    one, e = out.first(), prepare.episodes(a)
    assert one["rate"] == kpis.alarm_rate(a).first() and one["time_to_clear"] == kpis.time_to_clear(e).first()
    assert sorted(one["priority_mix"], key=lambda x: x["priority"]) and {tuple(sorted(x.asDict().items(), key=str)) for x in one["priority_mix"]} == {tuple(sorted(x.asDict().items(), key=str)) for x in kpis.priority_distribution(a).collect()}
    assert one["standing_alarm_count"] == e.where("standing").count() and one["high_priority_share_pct"] == 100.0


def test_shares_are_added_up_in_small_windows(spark):
    """Many tags without a share of their own: their cumulative share is that of all others."""
    rows = [("A", 4000), ("B", 2500), ("C", 2500), *((f"T{k:04}", 1) for k in range(1000))]
    a = spark.createDataFrame(rows, "tag string, n int").selectExpr("explode(sequence(1, n)) AS seq", "tag").selectExpr("timestamp_ntz'2024-01-01 00:00:00' AS ts", "cast(seq AS long) AS seq", "tag", "'HI' AS level", "'LOW' AS priority", "'ACTIVE' AS state")
    got = analysis.bad_actors(a, None).orderBy(F.desc("alarm_count"), "tag").collect()
    assert [r["cum_pct"] for r in got] == [40.0, 65.0, 90.0, *[90.0] * 1000] and [r["tag"] for r in got[:3]] == ["A", "B", "C"]


def test_hot_buckets_are_cut(spark, monkeypatch):
    """Half of all rows in one hour, most of them in one minute: many buckets, the same numbers."""
    r = random.Random(8)
    rows = [(r.choice([0, 3000, 3000]) + r.randrange(900), f"T{r.randrange(4)}") for _ in range(400)] + [(1200 + r.choice([7, 7, 7, r.randrange(60)]), "HOT") for _ in range(500)] + [(None, "T0")]
    df = spark.createDataFrame([(None if m is None else at(m), k, t) for k, (m, t) in enumerate(rows)], "ts timestamp_ntz, seq long, tag string").repartition(3)
    made = lambda: [{tuple(x) for x in out.select("seq", *c).collect()} for out, c in ((gap_sessions(df.where("ts IS NOT NULL"), 5), ["session"]), (positions(df.where("ts IS NOT NULL")), ["pos"]), (neighbours(df, ["tag"], {"s": F.col("seq")}), ["prev.s", "next.s"]))]
    plain = made()
    for name, value in (("SPLIT", 40), ("SMALL", 0)):
        monkeypatch.setattr(sessions, name, value)
    assert made() == plain
    sizes = sessions._bucketed(df.where("tag = 'HOT'"), sessions.HOUR).groupBy("_bucket").agg(F.count("*").alias("n")).collect()
    assert len(sizes) > 100 and max(x["n"] for x in sizes) <= 10
