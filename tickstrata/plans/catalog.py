"""Registered queries over the test tables, and the same in SQL for DuckDB.

`events` stands for telemetry: user_id is the device, event_id the order of arrival. `lineitem` by
supplier and ship date gives repeats to remove.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickstrata.functions import columns as C
from tickstrata.model import SHARD_NS
from tickstrata.operators import compaction, dedup, ordered, registry, scan, summary
from tickstrata.session import shared_dir
from tickstrata.sources import messages
from tickstrata.sources.store import Store

DID, START, END = 7, 1_704_888_000_000_000_000, 1_705_492_800_000_000_000  # 2024-01-10T12:00 and seven days on
NOW_MS = 1_706_745_600_000  # 2024-02-01

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

TEL = f"""tel AS (SELECT user_id AS did, epoch_us(ts) * 1000 AS timestamp, event_id AS created_at,
    epoch_us(ts) * 1000 // {SHARD_NS} AS shard_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, event_type, value AS reading FROM events)"""


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql if sql.lstrip().upper().startswith("WITH") else f"WITH {TEL} {sql}"
        return f

    return register


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """did, timestamp, created_at, shard_id, key, value from `events`."""
    k = F.get_json_object("props", "$.k").cast("long")
    rows = _table(spark, sf_dir, "events").select(
        F.col("user_id").alias("did"), C.nanos("ts").alias("timestamp"), F.col("event_id").alias("created_at"),
        F.array(F.lit(1), F.lit(2)).alias("key"), F.array(k, F.col("event_id")).alias("value"),
    )
    return rows.withColumn("shard_id", C.shard_id("timestamp"))


def _flat(rows: DataFrame) -> DataFrame:
    return rows.select("did", "timestamp", "created_at", F.concat_ws(",", F.col("value").cast("array<string>")).alias("value"))


FLAT = "did, timestamp, created_at, k || ',' || created_at AS value"


# scans


@query(f"SELECT {FLAT} FROM tel WHERE did = {DID} AND timestamp BETWEEN {START} AND {END}")
def device_scan_range(spark, sf_dir):
    return _flat(scan.device_scan(telemetry(spark, sf_dir), DID, START, END))


@query(f"SELECT {FLAT} FROM tel WHERE did = {DID} AND shard_id BETWEEN {START // SHARD_NS} AND {END // SHARD_NS}")
def device_scan_shard(spark, sf_dir):
    return _flat(scan.device_scan(telemetry(spark, sf_dir), DID, START, END, "shard"))


@query(f"SELECT {DID} AS did, count(*) AS n FROM tel WHERE did = {DID} AND timestamp BETWEEN {START} AND {END}")
def device_count(spark, sf_dir):
    rows = scan.device_scan(telemetry(spark, sf_dir), DID, START, END)
    return rows.agg(F.lit(DID).alias("did"), F.count("*").alias("n"))


@query(
    f"""SELECT string_agg(CAST(timestamp AS VARCHAR), ';' ORDER BY timestamp, created_at) AS timestamp,
    string_agg(k || ',' || created_at, ';' ORDER BY timestamp, created_at) AS data FROM tel WHERE did = {DID} AND timestamp BETWEEN {START} AND {END}"""
)
def read_response(spark, sf_dir):
    answer = scan.read_response(scan.device_scan(telemetry(spark, sf_dir), DID, START, END))
    return answer.select(F.array_join(F.col("timestamp").cast("array<string>"), ";").alias("timestamp"), F.array_join("data", ";").alias("data"))


WINDOWS = 53  # of seven days, back from NOW_MS


@query(
    f"""SELECT w AS window_id, did, count(*) AS n, min(timestamp) AS first, max(timestamp) AS last FROM tel, range({WINDOWS}) r(w)
    WHERE timestamp BETWEEN {NOW_MS}000000 - (w + 1) * {SHARD_NS} AND {NOW_MS}000000 - w * {SHARD_NS} GROUP BY w, did"""
)
def weekly_sweep(spark, sf_dir):
    rows = telemetry(spark, sf_dir)
    windows = rows.select("did").distinct().withColumn("window_id", F.explode(F.sequence(F.lit(0), F.lit(WINDOWS - 1)).cast("array<bigint>")))
    end = F.lit(NOW_MS * 1_000_000) - F.col("window_id") * SHARD_NS
    windows = windows.select("window_id", "did", (end - SHARD_NS).alias("start"), end.alias("end"))
    return scan.sweep(rows, windows).groupBy("window_id", "did").agg(F.count("*").alias("n"), F.min("timestamp").alias("first"), F.max("timestamp").alias("last"))


# the store


def _store(spark: SparkSession, sf_dir: str, runs: int = 3) -> Store:
    """A store of `runs` runs of telemetry, in the shared folder."""
    store = Store(spark, f"{shared_dir(spark)}/store-{uuid.uuid4().hex}")
    rows = telemetry(spark, sf_dir).drop("key", "shard_id")
    for k in range(runs):
        store.append(rows.where(F.col("created_at") % runs == k), created_at=k)
    return store


@query(f"SELECT {FLAT}, created_at % 3 AS run_created_at, shard_id FROM tel WHERE did = {DID} AND timestamp BETWEEN {START} AND {END}")
def store_scan(spark, sf_dir):
    rows = _store(spark, sf_dir).scan(DID, START, END)
    return rows.withColumn("value", F.concat_ws(",", F.col("value").cast("array<string>")))


@query("SELECT created_at % 3 AS run_created_at, shard_id, count(*) AS n FROM tel GROUP BY ALL")
def run_scan(spark, sf_dir):
    return _store(spark, sf_dir).rows().groupBy("run_created_at", "shard_id").agg(F.count("*").alias("n"))


@query("SELECT created_at % 3 AS run_created_at, shard_id, min(timestamp) AS min_time, max(timestamp) AS max_time, count(*) AS rows FROM tel GROUP BY ALL")
def run_bounds(spark, sf_dir):
    return summary.bounds(_store(spark, sf_dir).rows(), ["run_created_at", "shard_id"])


@query("SELECT created_at % 3 AS run_created_at, count(*) AS rows, count(DISTINCT shard_id) AS shards, true AS sized FROM tel GROUP BY ALL")
def store_size(spark, sf_dir):
    """Rows and shards of each run by the log; its bytes are the codec's business, so only that they are there."""
    store = _store(spark, sf_dir)
    found = store.catalog().groupBy("run_created_at")
    sized = (F.min("size") > 0) & (F.sum("size") < store.size())
    return found.agg(F.sum("rows").alias("rows"), F.countDistinct("shard_id").alias("shards"), sized.alias("sized"))


@query(
    """SELECT created_at % 3 AS run_created_at, shard_id, min(did) AS min_did, max(did) AS max_did, min(timestamp) AS min_time, max(timestamp) AS max_time FROM tel GROUP BY ALL"""
)
def store_catalog(spark, sf_dir):
    bounds = [f(c).alias(c) for f, c in ((F.min, "min_did"), (F.max, "max_did"), (F.min, "min_time"), (F.max, "max_time"))]
    return _store(spark, sf_dir).catalog().groupBy("run_created_at", "shard_id").agg(*bounds)


@query("SELECT shard_id, count(*) AS n, count(DISTINCT did) AS devices, max(timestamp) AS last FROM tel WHERE timestamp >= 1704888000000000000 GROUP BY shard_id")
def store_sql(spark, sf_dir):
    name = f"telemetry_{uuid.uuid4().hex}"
    _store(spark, sf_dir).view(name)
    return spark.sql(f"SELECT shard_id, count(*) AS n, count(DISTINCT did) AS devices, max(timestamp) AS last FROM {name} WHERE timestamp >= {START} GROUP BY shard_id")


OVERLAP = "o AS (SELECT did, timestamp, shard_id, min(created_at % 3) AS run FROM (SELECT * FROM tel UNION ALL SELECT * REPLACE (created_at + 1 AS created_at) FROM tel WHERE created_at % 2 = 0) GROUP BY ALL)"


@query(f"WITH {TEL}, {OVERLAP} SELECT did, timestamp, run AS run_created_at, shard_id FROM o")
def store_compact(spark, sf_dir):
    """Runs that overlap, compacted: of each (did, timestamp) the row of the oldest run is left."""
    store = Store(spark, f"{shared_dir(spark)}/store-{uuid.uuid4().hex}")
    rows = telemetry(spark, sf_dir).drop("key", "shard_id")
    rows = rows.unionByName(rows.where("created_at % 2 = 0").withColumn("created_at", F.col("created_at") + 1))
    for k in range(3):
        store.append(rows.where(F.col("created_at") % 3 == k), created_at=k)
    store.compact(least=1)
    return store.rows().select("did", "timestamp", "run_created_at", "shard_id")


STONES = f"did % 5 = 0 AND timestamp BETWEEN {START} AND {END} AND created_at <= 8000"


@query(f"SELECT did, timestamp, created_at FROM tel WHERE NOT ({STONES})")
def store_remove(spark, sf_dir):
    store = _store(spark, sf_dir)
    devices = telemetry(spark, sf_dir).where("did % 5 = 0").select("did").distinct()
    store.remove(devices.select("did", F.lit(START).alias("start"), F.lit(END).alias("end"), F.lit(8000).alias("created")))
    return store.rows().select("did", "timestamp", "created_at")


@query(f"SELECT timestamp // (4 * {SHARD_NS}) AS shard_id, count(*) AS n, min(timestamp) AS first, max(timestamp) AS last FROM tel GROUP BY ALL")
def store_reshard(spark, sf_dir):
    wide = _store(spark, sf_dir).reshard(f"{shared_dir(spark)}/store-{uuid.uuid4().hex}", 4 * SHARD_NS)
    return wide.rows().groupBy("shard_id").agg(F.count("*").alias("n"), F.min("timestamp").alias("first"), F.max("timestamp").alias("last"))


# Of a device, the run with the smaller stamp registers first, and in a run the row that came first.
KNOWN = """known AS (SELECT did, CASE WHEN arg_min(created_at, (created_at % 3) * 1000000000 + created_at) % 2 = 0 THEN '1,2' ELSE '2,1' END AS key FROM tel GROUP BY did)"""


def _named_store(spark: SparkSession, sf_dir: str) -> Store:
    """A store that was given the register lists of its devices, too."""
    store, rows = Store(spark, f"{shared_dir(spark)}/store-{uuid.uuid4().hex}"), _full(spark, sf_dir).drop("shard_id")
    for k in range(3):
        store.append(rows.where(F.col("created_at") % 3 == k), created_at=k)
    return store


@query(f"WITH {TEL}, {KNOWN} SELECT did, key FROM known")
def store_registry(spark, sf_dir):
    return _named_store(spark, sf_dir).registry().withColumn("key", F.concat_ws(",", F.col("key").cast("array<string>")))


@query(
    f"""WITH {TEL}, {KNOWN} SELECT did, timestamp, CASE WHEN key = '1,2' THEN p ELSE 3 - p END AS register, CASE WHEN p = 1 THEN k ELSE created_at END AS reading
    FROM tel JOIN known USING (did), (VALUES (1), (2)) t(p) WHERE did = {DID} AND timestamp BETWEEN {START} AND {END}"""
)
def store_decode(spark, sf_dir):
    return _named_store(spark, sf_dir).scan(DID, START, END, named=True)


NAMES = f"""names AS (SELECT {SHARD_NS} || '_' || shard_id || '_' || created_at || '_' || kind AS name
    FROM (SELECT DISTINCT shard_id, created_at % 5 AS created_at FROM tel), (VALUES ('index'), ('data')) t(kind))"""


@query(
    f"""WITH {TEL}, {NAMES} SELECT name, CAST(split_part(name, '_', 2) AS BIGINT) AS shard_id, CAST(split_part(name, '_', 3) AS BIGINT) AS created_at,
    regexp_replace(name, 'index$', 'data') AS data_name, CAST(split_part(name, '_', 1) AS VARCHAR) || '/' || split_part(name, '_', 2) AS folder FROM names WHERE name LIKE '%index'"""
)
def catalog_files(spark, sf_dir):
    runs = telemetry(spark, sf_dir).select("shard_id", (F.col("created_at") % 5).alias("created_at")).distinct()
    runs = runs.withColumn("kind", F.explode(F.array(F.lit("index"), F.lit("data"))))
    names = runs.select(F.format_string(f"{SHARD_NS}_%d_%d_%s", "shard_id", "created_at", "kind").alias("name")).where(F.col("name").endswith("index"))
    return names.select(
        "name", C.run_part("name", 1).cast("long").alias("shard_id"), C.run_part("name", 2).cast("long").alias("created_at"),
        F.regexp_replace("name", "index$", "data").alias("data_name"), F.concat_ws("/", C.run_part("name", 0), C.run_part("name", 1)).alias("folder"),
    )


@query("SELECT shard_id, count(*) AS n, min(timestamp) AS first, max(timestamp) AS last FROM tel GROUP BY shard_id")
def shard_assign(spark, sf_dir):
    return telemetry(spark, sf_dir).groupBy("shard_id").agg(F.count("*").alias("n"), F.min("timestamp").alias("first"), F.max("timestamp").alias("last"))


# dedup and merge

LINES = ["l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice"]


@query(
    """SELECT l_suppkey, l_shipdate, l_orderkey, l_linenumber, l_partkey FROM lineitem
    QUALIFY row_number() OVER (PARTITION BY l_suppkey, l_shipdate ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice) = 1"""
)
def dedup_first_wins(spark, sf_dir):
    rows = _table(spark, sf_dir, "lineitem").select("l_suppkey", "l_shipdate", *LINES)
    return dedup.first_wins(rows, ["l_suppkey", "l_shipdate"], LINES).select("l_suppkey", "l_shipdate", "l_orderkey", "l_linenumber", "l_partkey")


@query(
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem
    QUALIFY lag(1) OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) IS NULL"""
)
def dedup_lag(spark, sf_dir):
    order = ["l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate"]
    rows = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *order)
    return dedup.changes(rows, ["l_orderkey", "l_linenumber"], order).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


RUNS = """r AS (SELECT did, timestamp, created_at, 5 AS run_created_at FROM tel WHERE created_at % 2 = 0
    UNION ALL SELECT did, timestamp, created_at + 1000000, 7 FROM tel WHERE created_at % 3 = 0
    UNION ALL SELECT did, timestamp, created_at + 2000000, 9 FROM tel)"""


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three runs that overlap."""
    rows = telemetry(spark, sf_dir).select("did", "timestamp", "created_at")
    run = lambda df, add, stamp: df.select("did", "timestamp", (F.col("created_at") + add).alias("created_at"), F.lit(stamp).alias("run_created_at"))
    return run(rows.where("created_at % 2 = 0"), 0, 5).unionByName(run(rows.where("created_at % 3 = 0"), 1_000_000, 7)).unionByName(run(rows, 2_000_000, 9))


@query(f"WITH {TEL}, {RUNS} SELECT * FROM r")
def union_runs(spark, sf_dir):
    return _runs(spark, sf_dir)


@query(f"WITH {TEL}, {RUNS} SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY did, timestamp ORDER BY run_created_at, created_at) = 1")
def compact_merge(spark, sf_dir):
    return compaction.merge(_runs(spark, sf_dir))


FILES = "files AS (SELECT shard_id, created_at % 23 AS run, count(*) * 300000 AS size FROM tel GROUP BY ALL)"


@query(
    f"""WITH {TEL}, {FILES} SELECT shard_id, count(*) AS files, string_agg('run' || lpad(CAST(run AS VARCHAR), 2, '0'), ',' ORDER BY size, lpad(CAST(run AS VARCHAR), 2, '0')) AS names
    FROM files WHERE size < 100000000 GROUP BY shard_id HAVING count(*) > 10"""
)
def compact_plan(spark, sf_dir):
    files = telemetry(spark, sf_dir).groupBy("shard_id", (F.col("created_at") % 23).alias("run")).agg((F.count("*") * 300_000).alias("size"))
    files = files.withColumn("name", F.concat(F.lit("run"), F.lpad(F.col("run").cast("string"), 2, "0")))
    return compaction.plan(files).withColumn("names", F.array_join("names", ","))


# the ordered map

KEYED = "keyed AS (SELECT did, timestamp, created_at FROM tel WHERE created_at % 7 = 0)"


def _map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry(spark, sf_dir).select("did", "timestamp", "created_at")


@query("SELECT did, timestamp, created_at FROM tel ORDER BY did, timestamp")
def ordered_scan(spark, sf_dir):
    return ordered.ordered_scan(_map(spark, sf_dir))


@query("SELECT did, timestamp, created_at FROM tel WHERE (did, timestamp) IN (SELECT (did, timestamp) FROM tel WHERE created_at = 100)")
def map_get(spark, sf_dir):
    rows = _map(spark, sf_dir)
    return ordered.contains(rows, rows.where("created_at = 100")).select("did", "timestamp", "created_at")


@query(f"WITH {TEL}, {KEYED} SELECT did, timestamp FROM keyed")
def map_contains(spark, sf_dir):
    rows = _map(spark, sf_dir)
    there = rows.where("created_at % 7 = 0").select("did", "timestamp")
    return ordered.contains(rows, there.unionByName(there.select("did", (-F.col("timestamp")).alias("timestamp"))))


@query(f"WITH {TEL}, {KEYED} SELECT did, timestamp, created_at FROM tel ANTI JOIN keyed USING (did, timestamp)")
def map_delete(spark, sf_dir):
    rows = _map(spark, sf_dir)
    return ordered.delete(rows, rows.where("created_at % 7 = 0"))


@query(f"SELECT did, timestamp, created_at FROM tel WHERE did > {DID} OR did = {DID} AND timestamp >= {START}")
def map_from(spark, sf_dir):
    return ordered.starting_at(_map(spark, sf_dir), DID, START)


@query(f"SELECT did, timestamp, created_at FROM tel WHERE (did > {DID} OR did = {DID} AND timestamp >= {START}) AND (did < {DID + 3} OR did = {DID + 3} AND timestamp <= {END})")
def map_range(spark, sf_dir):
    return ordered.between(_map(spark, sf_dir), (DID, START), (DID + 3, END))


# ingest

BODY = f"""src AS (SELECT *, CASE WHEN created_at % 10 = 5 THEN {NOW_MS} + 7200000 ELSE timestamp // 1000000 END AS ms, created_at % 10 AS c FROM tel),
    src2 AS (SELECT *, CASE WHEN c IN (3, 4) THEN 0 ELSE ms END AS top, CASE WHEN c IN (0, 4) THEN 79 ELSE 80 END AS msg_type, {NOW_MS} - 5000 AS created_ms FROM src),
    ev AS (SELECT *, CASE WHEN top <> 0 THEN top WHEN msg_type = 80 THEN ms + 1 ELSE created_ms END AS event_ms FROM src2)"""


def source_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages made from telemetry, one in ten of each of these kinds: other type, no payload, broken body, payload's time, source's time, future, short pair."""
    rows = telemetry(spark, sf_dir)
    c = F.col("created_at") % 10
    ms = F.when(c == 5, F.lit(NOW_MS + 7_200_000)).otherwise(F.call_function("div", "timestamp", F.lit(1_000_000)))
    pair = lambda k, v: F.array(F.lit(k).cast("long"), v)
    regs = F.when(c == 6, F.array(F.array(F.lit(1).cast("long")))).otherwise(F.array(pair(1, F.get("value", F.lit(0))), pair(2, F.get("value", F.lit(1)))))
    data = F.when(c != 1, F.struct((ms + 1).alias("timestamp"), regs.alias("regs")))
    kind = F.when(c.isin(0, 4), 79).otherwise(80)
    top = F.when(c.isin(3, 4), F.lit(0).cast("long")).otherwise(ms)
    body = F.to_json(F.struct(kind.alias("msg_type"), F.lit(0).alias("status"), F.col("created_at").cast("int").alias("msg_id"), top.alias("timestamp"), data.alias("data")))
    body = F.when(c == 2, F.left(body, F.lit(20))).otherwise(body)
    return rows.select(F.col("created_at").cast("int").alias("offset"), F.lit(NOW_MS - 5000).alias("created_at_ms"), "did", body.alias("body"), F.length(body).alias("length"))


@query(f"WITH {TEL}, {BODY} SELECT did, event_ms * 1000000 AS timestamp, k || ',' || created_at AS value, '1,2' AS key FROM ev WHERE c NOT IN (0, 1, 2, 4, 5, 6)")
def ingest_json(spark, sf_dir):
    rows = messages.ingest(source_messages(spark, sf_dir), NOW_MS).rows
    text = lambda c: F.concat_ws(",", F.col(c).cast("array<string>")).alias(c)
    return rows.select("did", "timestamp", text("value"), text("key"))


@query(f"WITH {TEL}, {BODY} SELECT did, CASE WHEN c = 2 THEN 'body' ELSE 'register pair' END AS reason, count(*) AS n FROM ev WHERE c IN (2, 6) GROUP BY ALL")
def ingest_quarantine(spark, sf_dir):
    return messages.ingest(source_messages(spark, sf_dir), NOW_MS).quarantine.groupBy("did", "reason").agg(F.count("*").alias("n"))


@query(f"WITH {TEL}, {BODY} SELECT created_at AS offset, did FROM ev WHERE c NOT IN (0, 1, 2, 4, 5)")
def ingest_filter(spark, sf_dir):
    return messages.data_messages(messages.parse(source_messages(spark, sf_dir)), NOW_MS).select(F.col("offset").cast("long").alias("offset"), "did")


@query(f"WITH {TEL}, {BODY} SELECT created_at AS offset, event_ms FROM ev WHERE c <> 2")
def event_time(spark, sf_dir):
    return messages.valid_json(messages.parse(source_messages(spark, sf_dir))).select(F.col("offset").cast("long").alias("offset"), "event_ms")


@query(f"WITH {TEL}, {BODY} SELECT created_at AS offset, event_ms FROM ev WHERE c <> 2 AND event_ms - {NOW_MS} <= 3600000")
def future_skew(spark, sf_dir):
    parsed = messages.valid_json(messages.parse(source_messages(spark, sf_dir)))
    return parsed.where(C.in_time(F.col("event_ms"), NOW_MS, 3_600_000)).select(F.col("offset").cast("long").alias("offset"), "event_ms")


@query(f"WITH {TEL}, {BODY} SELECT created_at AS offset, register, CASE WHEN register = 1 THEN k ELSE created_at END AS reading FROM ev, (VALUES (1), (2)) t(register) WHERE c NOT IN (1, 2, 6)")
def regs_pivot(spark, sf_dir):
    rows = messages.pivot(messages.valid_json(messages.parse(source_messages(spark, sf_dir))).where("m.data IS NOT NULL AND offset % 10 <> 6"), "m.data.regs")
    rows = rows.select(F.col("offset").cast("long").alias("offset"), F.explode(F.arrays_zip("key", "value")).alias("r"))
    return rows.select("offset", F.col("r.key").alias("register"), F.col("r.value").alias("reading"))


@query("SELECT shard_id, count(*) AS rows, CAST(count(*) * 20 AS BIGINT) AS bytes FROM tel GROUP BY shard_id")
def ingest_size(spark, sf_dir):
    return summary.ingest_size(telemetry(spark, sf_dir), ["shard_id"])


VARINT = lambda x: f"CAST(greatest(1, ceil(length(bin({x})) / 7.0)) AS INT)"


@query(f"SELECT did, timestamp, length('{{\"1\":' || k || ',\"2\":' || created_at || '}}') AS json_bytes, 20 AS fixed_bytes, 4 + {VARINT('k')} + {VARINT('created_at')} AS packed_bytes FROM tel")
def payload_size(spark, sf_dir):
    return summary.payload_sizes(telemetry(spark, sf_dir))


@query("SELECT created_at, created_at % 4 AS flag, created_at % 2 = 1 AS zip, created_at % 4 >= 2 AS compact FROM tel")
def flag_bits(spark, sf_dir):
    rows = telemetry(spark, sf_dir).select("created_at", (F.col("created_at") % 4).alias("flag"))
    return rows.select("created_at", "flag", C.is_zip("flag").alias("zip"), C.is_compact("flag").alias("compact"))


# the registry

FIELDS = "SELECT did, CASE WHEN min(created_at) % 2 = 0 THEN '1,2' ELSE '2,1' END AS key FROM tel GROUP BY did"


def _full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Telemetry whose devices change the order of their registers."""
    key = F.when(F.col("created_at") % 2 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(2), F.lit(1)))
    return telemetry(spark, sf_dir).withColumn("key", key)


@query(FIELDS)
def field_registry(spark, sf_dir):
    found = registry.first_fields(_full(spark, sf_dir), ["created_at"])
    return found.withColumn("key", F.concat_ws(",", F.col("key").cast("array<string>")))


@query("SELECT did, count(*) AS n FROM tel WHERE did % 3 <> 0 GROUP BY did")
def registry_new_devices(spark, sf_dir):
    rows = _full(spark, sf_dir)
    known = registry.first_fields(rows.where("did % 3 = 0"), ["created_at"])
    return registry.new_devices(rows, known).groupBy("did").agg(F.count("*").alias("n"))


@query(f"WITH {TEL}, f AS ({FIELDS}) SELECT did, count(*) AS n FROM tel JOIN f USING (did) WHERE f.key <> CASE WHEN created_at % 2 = 0 THEN '1,2' ELSE '2,1' END GROUP BY did")
def registry_conflicts(spark, sf_dir):
    rows = _full(spark, sf_dir)
    return registry.conflicts(rows, registry.first_fields(rows, ["created_at"])).groupBy("did").agg(F.count("*").alias("n"))


@query(
    f"""WITH {TEL}, f AS ({FIELDS}) SELECT did, timestamp, CASE WHEN f.key = '1,2' THEN p ELSE 3 - p END AS register, CASE WHEN p = 1 THEN k ELSE created_at END AS reading
    FROM tel JOIN f USING (did), (VALUES (1), (2)) t(p)"""
)
def register_explode(spark, sf_dir):
    rows = _full(spark, sf_dir)
    return registry.explode(rows.drop("key"), registry.first_fields(rows, ["created_at"]))


@query("SELECT did, min(timestamp) AS min_time, max(timestamp) AS max_time, count(*) AS rows FROM tel GROUP BY did")
def device_summary(spark, sf_dir):
    return summary.bounds(telemetry(spark, sf_dir), ["did"])


@query(
    """SELECT did, min(timestamp) AS start, max(timestamp) AS "end", CAST(sum(k) AS BIGINT) AS size, count(*) * 25 AS first_index_size,
    CAST(coalesce(sum(sum(k)) OVER (ORDER BY did ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset", 0 AS flag FROM tel GROUP BY did"""
)
def device_index(spark, sf_dir):
    return summary.device_index(telemetry(spark, sf_dir), F.get("value", F.lit(0)))


@query("SELECT shard_id, did, timestamp, k, CAST(coalesce(sum(k) OVER (PARTITION BY shard_id ORDER BY did, timestamp ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"offset\" FROM tel")
def running_offset(spark, sf_dir):
    rows = telemetry(spark, sf_dir).select("shard_id", "did", "timestamp", F.get("value", F.lit(0)).alias("k"))
    return summary.running_offset(rows, "k", ["shard_id"], ["did", "timestamp"], [F.col("did"), F.call_function("div", "timestamp", F.lit(3_600_000_000_000))])


# extensions


@query(f"SELECT did, timestamp, created_at FROM tel WHERE NOT (did % 5 = 0 AND timestamp BETWEEN {START} AND {END} AND created_at <= 8000)")
def range_delete(spark, sf_dir):
    rows = _map(spark, sf_dir)
    stones = rows.where("did % 5 = 0").select("did").distinct().select("did", F.lit(START).alias("start"), F.lit(END).alias("end"), F.lit(8000).alias("created"))
    return compaction.remove_ranges(rows, stones)


@query(f"SELECT timestamp // (4 * {SHARD_NS}) AS shard_id, count(*) AS n FROM tel GROUP BY ALL")
def reshard_tier(spark, sf_dir):
    return compaction.reshard(telemetry(spark, sf_dir), 4 * SHARD_NS).groupBy("shard_id").agg(F.count("*").alias("n"))
