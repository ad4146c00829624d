import json

import pytest

from tickstrata.__main__ import main
from tickstrata.model import SHARD_NS
from tickstrata.sources.legacy import encode_index, read_index, tails
from tickstrata.sources.store import Conflict, Store
from tickstrata.streaming import ingest

TEL = "did long, timestamp long, created_at long, value array<long>"


def rows(spark, *items):
    return spark.createDataFrame([(d, t, c, [v]) for d, t, c, v in items], TEL)


def values(df):
    return sorted((r.did, r.timestamp, r.value[0]) for r in df.collect())


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, f"file://{tmp_path}/store")


def test_runs_repeat_until_compaction(spark, store):
    assert values(store.rows()) == []
    store.append(rows(spark, (1, 10, 0, 1), (1, 10, 1, 2), (1, SHARD_NS, 0, 3)), created_at=5)
    store.append(rows(spark, (1, 10, 0, 9)), created_at=7)
    assert values(store.scan(1, 0, 20)) == [(1, 10, 1), (1, 10, 9)]
    assert values(store.scan(1, 0, 20, dedup=True)) == [(1, 10, 1)]
    assert store.compact() == []  # two files are too few
    assert store.compact(least=1) == [0]
    assert values(store.scan(1, 0, 2 * SHARD_NS)) == [(1, 10, 1), (1, SHARD_NS, 3)]
    store.append(rows(spark, (1, 10, 0, 8)), created_at=6)
    store.compact(least=1)
    assert values(store.scan(1, 0, 20)) == [(1, 10, 1)]  # the row of run 5 still counts as older than that of run 6


def test_compaction_needs_more_than_ten_small_files(spark, store):
    for k in range(10):
        store.append(rows(spark, (1, k, 0, k)), created_at=k)
    assert store.compact() == []
    store.append(rows(spark, (1, 10, 0, 10)), created_at=10)
    assert store.compact(small=1) == []
    assert store.compact() == [0] and len(store.files()) <= 4 and len(values(store.rows())) == 11


def test_a_version_is_published_once(spark, store):
    store.append(rows(spark, (1, 1, 0, 1)), created_at=1)
    assert not store._publish(0, [])
    assert store.version() == 1 and len(store.files()) == 1


def test_writers_that_lose_a_race_try_again(spark, store, monkeypatch):
    store.append(rows(spark, (1, 1, 0, 1)), created_at=1)
    publish, other = Store._publish, rows(spark, (2, 2, 0, 2))

    def late(self, base, actions):
        if base == 1:  # another writer comes first
            monkeypatch.setattr(Store, "_publish", publish)
            store.append(other, created_at=2)
        return publish(self, base, actions)

    monkeypatch.setattr(Store, "_publish", late)
    assert store.append(rows(spark, (3, 3, 0, 3)), created_at=3) == 3
    assert [v[0] for v in values(store.rows())] == [1, 2, 3]
    gone = store.files()
    store.compact(least=1)
    with pytest.raises(Conflict):
        store._commit([], gone)  # what was compacted can't be replaced again


def test_batches_are_idempotent_for_each_source(spark, store):
    for _ in range(2):
        store.append(rows(spark, (1, 1, 0, 1)), batch_id=3, source="a")
    assert len(values(store.rows())) == 1
    store.append(rows(spark, (2, 1, 0, 1)), batch_id=0, source="b")
    store.append(rows(spark, (3, 1, 0, 1)), batch_id=4, source="a")
    assert [v[0] for v in values(store.rows())] == [1, 2, 3]
    store.compact(least=1)
    store.remove(spark.createDataFrame([(d, 0, 20, 5) for d in (1, 2, 3)], "did long, start long, end long, created long"))
    assert values(store.rows()) == []
    store.append(rows(spark, (3, 1, 0, 1)), batch_id=4, source="a")  # a store that has been emptied still knows
    assert values(store.rows()) == []


def test_of_equal_times_the_smaller_offset_comes_first(spark, store):
    df = spark.createDataFrame([(1, 5, 0, [k], k) for k in (7, 3, 9)], TEL + ", offset int").repartition(3)
    store.append(df, created_at=1)
    assert values(store.rows()) == [(1, 5, 3)]


def test_vacuum_and_remove(spark, store, tmp_path):
    for k in range(3):
        store.append(rows(spark, (k, 10, 0, k)), created_at=k)
    before = {f.path for f in store.files()}
    store.remove(spark.createDataFrame([(1, 0, 20, 5)], "did long, start long, end long, created long"))
    assert [v[0] for v in values(store.rows())] == [0, 2]
    assert {f.path for f in store.files()} == {p for p in before if "run=1-" not in p}  # files without such rows stay as they are
    assert store.vacuum(keep=1) == 1
    store._write(store.rows().drop("run"), 99)  # a write that was never published
    assert store.vacuum(keep=1) == 0 and store.vacuum(keep=1, grace_ms=-1000) == 2
    assert [v[0] for v in values(store.rows())] == [0, 2]
    store.append(rows(spark, (9, 10, 0, 9)), created_at=9)
    assert [v[0] for v in values(store.rows())] == [0, 2, 9]


def test_versions_go_on_from_checkpoints(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store", checkpoint=3, compression="lz4_raw")
    for k in range(8):
        store.append(rows(spark, (k, 10, 0, k)), created_at=k, batch_id=k, source="s")
    assert store._log()[1] == [3, 6]
    assert [v[0] for v in values(store.rows())] == list(range(8)) and len(store.files(4)) == 4
    assert store.vacuum(keep=1) == 0 and store._log()[0] == [8]
    again = Store(spark, store.root)
    again.append(rows(spark, (7, 10, 0, 7)), batch_id=7, source="s")
    assert [v[0] for v in values(again.rows())] == list(range(8))


def test_scan_opens_only_files_whose_bounds_meet_it(spark, store):
    for d in range(4):
        store.append(rows(spark, (d, 10, 0, d), (d, 500, 0, d)), created_at=d)
    opened = lambda *a, **k: {p.split("run=")[1].split("-")[0] for p in store.scan(*a, **k).inputFiles()}
    assert opened(2, 0, 20) == {"2"} and opened(9, 0, 20) == set()
    assert opened(2, 600, 700) == set() and opened(2, 600, 700, "shard") == {"2"}


def test_register_lists_are_stored_with_the_rows(spark, store):
    schema = "did long, timestamp long, created_at long, key array<int>, value array<long>, offset int"
    store.append(spark.createDataFrame([(1, 5, 0, [7, 8], [1, 2], 1), (1, 6, 0, [8, 7], [3, 4], 0)], schema), created_at=1)
    store.append(spark.createDataFrame([(1, 7, 0, [9], [5], 0), (2, 7, 0, [4], [6], 0)], schema), created_at=2)
    assert sorted((r.did, r.key) for r in store.registry().collect()) == [(1, [8, 7]), (2, [4])]
    named = store.scan(1, 0, 6, named=True).collect()
    assert sorted(tuple(r) for r in named) == [(1, 5, 7, 2), (1, 5, 8, 1), (1, 6, 7, 4), (1, 6, 8, 3)]
    wide = store.reshard(store.root + "-wide", 2 * SHARD_NS)
    assert values(wide.rows()) == values(store.rows()) and wide.registry().count() == 2


def test_commands(spark, store, capsys):
    store.append(rows(spark, (1, 10, 0, 1), (2, 20, 0, 2)), created_at=1)
    for arguments, text in ((["scan", store.root, "1", "0", "15"], "[1]"), (["files", store.root], "run=1-"), (["sweep", store.root, "2", "--now", "30"], "\t1\t"), (["compact", store.root], "[]")):
        main(arguments, spark)
        assert text in capsys.readouterr().out
    main(["size", store.root], spark)
    assert int(capsys.readouterr().out) > 0


def test_scan_prunes_and_pushes_down(spark, store):
    store.append(rows(spark, *((d, s * SHARD_NS + d, 0, d) for d in range(20) for s in range(4))), created_at=1)
    plan = store.scan(3, SHARD_NS, SHARD_NS + 10)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(shard_id" in plan
    assert "EqualTo(did,3)" in plan and "GreaterThanOrEqual(timestamp," in plan
    assert "Exchange" not in plan


def test_streaming_ingest_restarts(spark, store, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()

    def put(name, dids):
        body = lambda d: json.dumps({"msg_type": 80, "timestamp": 1000 + d, "data": {"timestamp": 1, "regs": [[1, d]]}})
        lines = [json.dumps({"offset": d, "created_at_ms": 5, "did": d, "body": body(d), "length": 1}) for d in dids]
        (folder / name).write_text("\n".join([*lines, json.dumps({"offset": 9, "created_at_ms": 5, "did": 1, "body": "{", "length": 1})]))

    def run():
        q = ingest.start(ingest.read_messages(spark, str(folder)), store, str(tmp_path / "cp"), str(tmp_path / "bad"), now_ms=10_000)
        q.awaitTermination(60)

    put("a.json", [1, 2])
    run()
    assert values(store.rows()) == [(1, 1001 * 10**6, 1), (2, 1002 * 10**6, 2)]
    run()
    put("b.json", [3])
    run()
    assert [v[0] for v in values(store.rows())] == [1, 2, 3]
    assert spark.read.parquet(str(tmp_path / "bad")).count() == 2
    put("c.json", [4])
    q = ingest.start(ingest.read_messages(spark, str(folder), bytes_per_batch=1 << 20), store, str(tmp_path / "other"), now_ms=10_000)
    q.awaitTermination(60)  # another query's batches start at 0 again, and are its own
    assert [v[0] for v in values(store.rows())] == [1, 1, 2, 2, 3, 3, 4]
    assert sorted((r.did, r.key) for r in store.registry().collect()) == [(d, [1]) for d in (1, 2, 3, 4)]
    q = ingest.start(ingest.read_messages(spark, str(folder)), store, str(tmp_path / "other"), now_ms=10_000, every="1 second")
    put("d.json", [5])
    q.processAllAvailable()
    assert q.isActive
    q.stop()
    assert values(store.rows())[-1][0] == 5


def test_legacy_index_round_trip(spark, tmp_path):
    items = [(26754, 0, 40, 0, 1682228682901132262), (4294967295, 1 << 40, 7, 3, 1)]
    df = spark.createDataFrame(items, "did long, offset long, length long, flag long, timestamp long")
    data = b"".join(bytes(r.record) for r in encode_index(df).orderBy("did").collect())
    assert len(data) == 50
    (tmp_path / "x_index").write_bytes(data)
    (tmp_path / "y_index").write_bytes(b"")
    got = read_index(spark, str(tmp_path)).drop("path").collect()
    assert sorted(tuple(r) for r in got) == sorted(items)
    (tmp_path / "z_index").write_bytes(data[:25] + b"cut")
    assert [r["bytes"] for r in tails(spark, str(tmp_path)).collect()] == [3]
    (tmp_path / "big_index").write_bytes(b"\0" * 17 + b"\xff" * 8)
    assert [r.timestamp for r in read_index(spark, str(tmp_path / "big_index")).collect()] == [None]
