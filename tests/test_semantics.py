"""Edge cases of the model, one test for each decision."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tickstrata.functions import columns as C
from tickstrata.model import SHARD_NS, SOURCE_MESSAGE
from tickstrata.operators import compaction, dedup, ordered, registry, scan, summary
from tickstrata.session import shared_dir
from tickstrata.sources.messages import ingest

TEL = "did long, timestamp long, created_at long, value array<long>"


def tel(spark, rows):
    df = spark.createDataFrame([(d, t, c, [c]) for d, t, c in rows], TEL)
    return df.withColumn("shard_id", C.shard_id("timestamp"))


def pairs(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


def test_shards_truncate_toward_zero(spark):
    rows = tel(spark, [(1, SHARD_NS - 1, 0), (1, SHARD_NS, 0), (1, -1, 0), (1, -SHARD_NS, 0)])
    assert pairs(rows, "timestamp", "shard_id") == [(-SHARD_NS, -1), (-1, 0), (SHARD_NS - 1, 0), (SHARD_NS, 1)]
    assert [scan.shard_of(t) for t in (SHARD_NS - 1, SHARD_NS, -1, -SHARD_NS)] == [0, 1, 0, -1]


def test_scan_granularity(spark):
    rows = tel(spark, [(1, 10, 0), (1, 20, 1), (1, 30, 2), (2, 20, 3), (1, SHARD_NS, 4)])
    assert pairs(scan.device_scan(rows, 1, 15, 25), "timestamp") == [(20,)]
    assert pairs(scan.device_scan(rows, 1, 15, 25, "shard"), "timestamp") == [(10,), (20,), (30,)]
    assert pairs(scan.device_scan(rows, 1, 25, 15), "timestamp") == []
    assert len(pairs(scan.device_scan(rows, 1, 25, 15, "shard"), "timestamp")) == 3
    assert pairs(scan.device_scan(rows, 1, SHARD_NS, 15, "shard"), "timestamp") == []
    assert pairs(scan.device_scan(rows, 99, 0, SHARD_NS), "timestamp") == []
    with pytest.raises(ValueError, match="granularity"):
        scan.device_scan(rows, 1, 0, 1, "day")


def test_sweeps_are_scans(spark):
    rows = tel(spark, [(1, 10, 0), (1, 20, 1), (1, 30, 2), (2, 20, 3), (1, SHARD_NS, 4)])
    windows = spark.createDataFrame([(0, 1, 15, 25), (1, 1, 25, 15), (2, 1, SHARD_NS, 15), (3, 1, 0, SHARD_NS)], "window_id long, did long, start long, end long")
    for mode in ("exact", "shard"):
        got = pairs(scan.sweep(rows, windows, mode), "window_id", "timestamp")
        assert got == sorted((w.window_id, t) for w in windows.collect() for (t,) in pairs(scan.device_scan(rows, w.did, w.start, w.end, mode), "timestamp"))


def test_first_write_wins_and_merge_prefers_the_older_run(spark):
    rows = spark.createDataFrame([(1, 10, 5, 5), (1, 10, 1, 7), (0, 0, 1, 5), (1, 11, 2, 7)], "did long, timestamp long, created_at long, run_created_at long")
    assert pairs(compaction.merge(rows), "did", "timestamp", "run_created_at") == [(0, 0, 5), (1, 10, 5), (1, 11, 7)]
    assert pairs(dedup.changes(rows, ["did", "timestamp"], ["run_created_at"]), "did", "timestamp", "run_created_at") == [(0, 0, 5), (1, 10, 5), (1, 11, 7)]


def test_registry_never_changes(spark):
    rows = spark.createDataFrame([(1, [1, 2], 0, [7, 8]), (1, [2, 1], 1, [9, 6]), (2, [], 2, [])], "did long, key array<int>, at long, value array<long>")
    found = registry.first_fields(rows, ["at"])
    assert sorted((r.did, r.key) for r in found.collect()) == [(1, [1, 2]), (2, [])]
    assert sorted((r.did, r.key) for r in registry.extend(found, rows, ["at"]).collect()) == [(1, [1, 2]), (2, [])]
    assert [r["at"] for r in registry.conflicts(rows, found).collect()] == [1]
    named = registry.explode(rows.select("did", "value").selectExpr("did", "0L AS timestamp", "value"), found)
    assert pairs(named, "did", "register", "reading") == [(1, 1, 7), (1, 1, 9), (1, 2, 6), (1, 2, 8)]


def test_map_ranges(spark):
    rows = tel(spark, [(d, t, 0) for d in (9, 10, 11, 12) for t in (1, 2, 3)])
    assert len(pairs(ordered.between(rows, (10, 2), (12, 1)), "did", "timestamp")) == 6
    assert len(pairs(ordered.starting_at(rows, 11, 3), "did", "timestamp")) == 4
    keys = lambda df: [(r.did, r.timestamp) for r in df.collect()]
    for found in (ordered.ordered_scan(rows.repartition(5)), ordered.starting_at(rows.repartition(5), 10, 2), ordered.between(rows.repartition(5), (9, 2), (12, 1))):
        assert keys(found) == sorted(keys(found)) and len(keys(found)) > 5
    with pytest.raises(ValueError, match="empty"):
        ordered.between(rows, (12, 1), (10, 2))


NOW = 1_700_000_000_000


def messages(spark, bodies):
    return spark.createDataFrame([(i, NOW - 1, did, body, 0) for i, (did, body) in enumerate(bodies)], SOURCE_MESSAGE)


def test_ingest_edges(spark):
    def body(top, regs="[[1,2]]", kind=80, own=5):
        return f'{{"msg_type":{kind},"timestamp":{top},"data":{{"timestamp":{own},"regs":{regs}}}}}'

    cases = {
        "kept: an hour ahead": (1, body(NOW + 3_600_000)),
        "dropped: more than an hour": (2, body(NOW + 3_600_001)),
        "kept: ten years old": (3, body(NOW - 315_360_000_000)),
        "kept: the payload's time": (4, body(0)),
        "kept: no registers": (5, body(7, "[]")),
        "quarantine: short pair": (6, body(7, "[[1]]")),
        "quarantine: fraction": (7, body(7, "[[1,1.5]]")),
        "kept: beyond 2**53": (8, body(7, "[[1,9007199254740993]]")),
        "quarantine: did too large": (1 << 32, body(7)),
        "quarantine: negative did": (-1, body(7)),
        "quarantine: negative time": (9, body(-1)),
        "dropped: other type": (10, body(7, kind=79)),
        "dropped: no payload": (11, '{"msg_type":80,"timestamp":7,"data":null}'),
        "quarantine: broken": (12, '{"msg_type":80,'),
        "quarantine: time overflows": (13, body(-(1 << 62))),
        "kept: payload without a time": (14, '{"msg_type":80,"timestamp":0,"data":{"regs":[[1,2]]}}'),
    }
    found = ingest(messages(spark, cases.values()), NOW)
    kept = {r.did: r for r in found.rows.collect()}
    assert sorted(kept) == sorted(d for k, (d, _) in cases.items() if k.startswith("kept"))
    assert sorted(r.did for r in found.quarantine.collect()) == sorted(d for k, (d, _) in cases.items() if k.startswith("quarantine"))
    assert kept[4].timestamp == 5_000_000 and kept[5].key == [] and kept[8].value == [9007199254740993] and kept[14].timestamp == 0


def test_times_that_overflow_go_to_quarantine(spark):
    body = lambda top: f'{{"msg_type":80,"timestamp":{top},"data":{{"timestamp":5,"regs":[]}}}}'
    rows = [(0, 5, 1, body(-(1 << 63)), 0), (1, 1 << 60, 2, body(7), 0), (2, 5, 3, body(7), 0), (3, None, 4, body(7), 0), (4, 5, 5, body((1 << 63) - 1), 0)]
    found = ingest(spark.createDataFrame(rows, SOURCE_MESSAGE), NOW)
    assert [r.did for r in found.rows.collect()] == [3]
    assert sorted(r.did for r in found.quarantine.collect()) == [1, 2, 4]  # the last one is dropped as from the future


def test_running_offset_over_cells(spark):
    rows = spark.createDataFrame([(r, d, t, d + t) for r in (1, None) for d in range(4) for t in range(6)], "run int, did long, timestamp long, n long")
    got = summary.running_offset(rows.repartition(3), "n", ["run"], ["did", "timestamp"], [C.F.col("did"), C.F.floor(C.F.col("timestamp") / 2)]).collect()
    for run in (1, None):
        at = 0
        for r in sorted((r for r in got if r.run == run), key=lambda r: (r.did, r.timestamp)):
            assert r.offset == at
            at += r.n
    assert len(got) == len(rows.collect())


def test_of_repeated_registers_the_last_value_counts(spark):
    df = spark.createDataFrame([(1, 1, [5, 6, 5], [1, 300, -1]), (2, 1, [], [])], "did long, timestamp long, key array<int>, value array<long>")
    got = {r.did: tuple(r)[2:] for r in summary.payload_sizes(df).collect()}
    assert got == {1: (len('{"6":300,"5":-1}'), 20, 16), 2: (2, 0, 0)}


def test_a_cluster_needs_a_shared_folder(monkeypatch):
    class Context:
        master = "spark://host:7077"

        def getConf(self):  # noqa: N802
            return {}

    class Session:
        sparkContext, conf = Context(), type("Conf", (), {"get": staticmethod(lambda k, d: d)})  # noqa: N815

    with pytest.raises(ValueError, match="checkpoint"):
        shared_dir(Session())


def test_names_and_flags(spark):
    row = spark.sql(f"SELECT '{SHARD_NS}_2759_1682228682901132262_index' AS name, 3 AS flag, 7L AS small, 35008L AS large")
    got = row.select(C.run_part("name", 1), C.run_part("name", 2), C.is_zip("flag"), C.is_compact("flag"), C.field_folder("small"), C.field_folder("large")).first()
    assert tuple(got) == ("2759", "1682228682901132262", True, True, "07", "35")


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 5), st.integers(0, 4), st.integers(0, 1000)), max_size=40, unique=True))
def test_merge_matches_a_plain_model(spark, rows):
    want = {}
    for did, t, run, created in sorted(rows, key=lambda r: (r[2], r[3])):
        want.setdefault((did, t), (run, created))
    df = spark.createDataFrame(rows, "did long, timestamp long, run_created_at long, created_at long")
    got = {(r.did, r.timestamp): (r.run_created_at, r.created_at) for r in compaction.merge(df).collect()}
    assert got == want
