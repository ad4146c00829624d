"""The store: immutable Parquet runs behind a log of versions.

    <root>/data/run=<id>/shard_id=<n>/part-*.parquet   rows sorted by (did, timestamp)
    <root>/fields/run=<id>/part-*.parquet              the register lists of devices that were new in a run
    <root>/_log/<version>.json                         what a version adds and removes, one action a line
    <root>/_log/checkpoint=<version>/part-*.parquet    all actions that still hold at a version

A version is published by giving a complete file the next version's name, in one step that fails if that
name is taken; the writer then looks at the newer version and tries again. A reader takes the newest version
once and keeps to it. So a run is visible as a whole or not at all, and compaction swaps its files in one
step. Actions hold each file's bounds of device and time, so a scan opens only files that can have its rows;
they are filtered as a DataFrame, and only the paths that a scan reads reach the driver. All files go through
Hadoop's file system. Its rename has to be atomic and must not replace a file, as on HDFS; on a
local disk a hard link serves.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterable
from dataclasses import asdict, dataclass
from urllib.parse import unquote

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickstrata.functions.columns import shard_id
from tickstrata.model import MIN_RUNS, SHARD_NS, SMALL_RUN, STORED
from tickstrata.operators import compaction, registry, scan

ROWS_PER_FILE = 20_000_000
ACTION = (
    "action STRING, path STRING, shard_id BIGINT, size BIGINT, run_created_at BIGINT, rows BIGINT, min_did BIGINT, max_did BIGINT, "
    "min_time BIGINT, max_time BIGINT, source STRING, batch_id BIGINT"
)
FIELDS = "did BIGINT, key ARRAY<INT>, run_created_at BIGINT"
ATTEMPTS = 20


class Conflict(RuntimeError):
    """Another writer has changed the same files, or published first too often."""


@dataclass(frozen=True)
class File:
    path: str  # below the root
    shard_id: int
    size: int
    run_created_at: int
    rows: int
    min_did: int
    max_did: int
    min_time: int
    max_time: int


class Store:
    """compression: any codec that Parquet knows, such as zstd, snappy or lz4_raw; checkpoint: versions between two of them."""

    def __init__(self, spark: SparkSession, root: str, width: int = SHARD_NS, compression: str = "zstd", checkpoint: int = 10) -> None:
        self.spark, self.root, self.width = spark, root.rstrip("/"), width
        self.compression, self.checkpoint = compression, checkpoint
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    # the log

    def _log(self) -> tuple[list[int], list[int]]:
        """The versions and the checkpoints that are there."""
        folder = self._path(f"{self.root}/_log")
        if not self._fs.exists(folder):
            return [], []
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        versions = sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith("."))
        return versions, sorted(int(n.partition("=")[2]) for n in names if n.startswith("checkpoint="))

    def version(self) -> int:
        return (self._log()[0] or [0])[-1]

    def actions(self, version: int | None = None) -> DataFrame:
        """The actions that hold at a version (by default the newest): live files, files of register lists, last batches of sources."""
        versions, checkpoints = self._log()
        version = (versions or [0])[-1] if version is None else version
        base = max((c for c in checkpoints if c <= version), default=0)
        found = self.spark.createDataFrame([], ACTION)
        if base:
            found = self.spark.read.schema(ACTION).parquet(f"{self.root}/_log/checkpoint={base}")
        since = [f"{self.root}/_log/{v:020d}.json" for v in versions if base < v <= version]
        if since:
            found = found.unionByName(self.spark.read.schema(ACTION).json(since))
        gone = found.where("action = 'remove'").select("path").distinct()
        batches = found.where("action = 'batch'").groupBy("action", "source").agg(F.max("batch_id").alias("batch_id"))
        live = found.where("action IN ('add', 'fields')").join(gone, "path", "left_anti")
        return live.unionByName(batches, allowMissingColumns=True)

    def live(self, version: int | None = None) -> DataFrame:
        """The live data files of a version, one row each."""
        return self.actions(version).where("action = 'add'").select(*File.__dataclass_fields__)

    def files(self, version: int | None = None, where: Column | None = None) -> list[File]:
        """The live data files, or those of them that `where` takes."""
        found = self.live(version)
        return [File(**r.asDict()) for r in (found if where is None else found.where(where)).collect()]

    def _write_new(self, path: str, content: bytes) -> bool:
        """Put a complete file at `path` if there is none; False if there is."""
        own = self._path(f"{self.root}/_log/.{uuid.uuid4().hex}")
        stream = self._fs.create(own, True)
        stream.write(bytearray(content))
        stream.close()
        jvm, target = self.spark._jvm, self._path(path)
        try:
            if self._fs.getScheme() == "file":
                files, at = jvm.java.nio.file.Files, lambda p: jvm.java.nio.file.Paths.get(self._fs.makeQualified(p).toUri().getPath(), self.spark.sparkContext._gateway.new_array(jvm.java.lang.String, 0))
                files.createLink(at(target), at(own))
            else:
                options = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
                jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), self.spark._jsc.hadoopConfiguration()).rename(own, target, options)
        except Py4JJavaError as e:
            if "AlreadyExists" not in e.java_exception.getClass().getName():
                raise
            return False
        finally:
            self._fs.delete(own, False)
        return True

    def _publish(self, base: int, actions: Iterable[dict]) -> bool:
        """Publish version base + 1; False if it is there already."""
        lines = "\n".join(json.dumps(a) for a in actions)
        if not self._write_new(f"{self.root}/_log/{base + 1:020d}.json", lines.encode()):
            return False
        if (base + 1) % self.checkpoint == 0:
            self._save_checkpoint(base + 1)
        return True

    def _save_checkpoint(self, version: int) -> None:
        target = self._path(f"{self.root}/_log/checkpoint={version}")
        if self._fs.exists(target):
            return
        own = f"{self.root}/_log/.{uuid.uuid4().hex}"
        self.actions(version).coalesce(8).write.parquet(own)
        if not self._fs.rename(self._path(own), target):
            self._fs.delete(self._path(own), True)

    def _commit(self, adds: list[File], removes: list[File] = (), fields: list[str] = (), source: str | None = None, batch_id: int | None = None) -> int:
        """Publish against the newest version. Raises Conflict if one of `removes` isn't live any more; gives 0 if the batch is there already."""
        told = [{"action": "add", **asdict(f)} for f in adds] + [{"action": "remove", "path": f.path} for f in removes]
        told += [{"action": "fields", "path": p} for p in fields]
        if batch_id is not None:
            told.append({"action": "batch", "source": source, "batch_id": batch_id})
        for _ in range(ATTEMPTS):
            base = self.version()
            if batch_id is not None and self._has_batch(source, batch_id, base):
                return 0
            if removes:
                wanted = self.spark.createDataFrame([(f.path,) for f in removes], "path string")
                if self.live(base).join(wanted, "path", "left_semi").count() < len(removes):
                    raise Conflict(f"files of {self.root} that were to be replaced are gone")
            if self._publish(base, told):
                return base + 1
        raise Conflict(f"{ATTEMPTS} other versions of {self.root} came first")

    def _has_batch(self, source: str | None, batch_id: int, version: int) -> bool:
        """Batches of a source come in order, so the last one says which are there."""
        found = self.actions(version).where("action = 'batch'").where(F.col("source").eqNullSafe(F.lit(source)))
        return not found.where(F.col("batch_id") >= batch_id).isEmpty()

    # writing

    def _write(self, rows: DataFrame, stamp: int) -> list[File]:
        """Write a run: one shuffle by shard, split within a shard by device, each file sorted."""
        run = f"{self.root}/data/run={stamp}-{uuid.uuid4().hex[:12]}"
        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        laid = rows.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in STORED))
        laid = laid.repartitionByRange(n, "shard_id", "did", "timestamp").sortWithinPartitions("shard_id", "did", "timestamp")
        laid.write.option("maxRecordsPerFile", ROWS_PER_FILE).option("compression", self.compression).partitionBy("shard_id").parquet(run)
        read = self.spark.read.schema(STORED).parquet(run)
        bounds = [f(c).alias(f"{n}_{k}") for c, k in (("did", "did"), ("timestamp", "time")) for f, n in ((F.min, "min"), (F.max, "max"))]
        found = read.groupBy("shard_id", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size"))
        found = found.agg(F.count("*").alias("rows"), *bounds).withColumn("run_created_at", F.lit(stamp)).collect()  # one row a file
        below = lambda p: unquote(p)[unquote(p).rindex("/data/run=") + 1 :]
        return [File(**(r.asDict() | {"path": below(r["path"])})) for r in found]

    def _write_fields(self, rows: DataFrame, arrival: list[str], stamp: int) -> list[str]:
        """Write the register lists of the devices that the store doesn't know yet."""
        new = registry.first_fields(registry.new_devices(rows, self.registry()), arrival)
        if new.isEmpty():
            return []
        path = f"fields/run={stamp}-{uuid.uuid4().hex[:12]}"
        new.select("did", F.col("key").cast("array<int>").alias("key"), F.lit(stamp).cast("long").alias("run_created_at")).write.parquet(f"{self.root}/{path}")
        return [path]

    def append(self, rows: DataFrame, created_at: int | None = None, batch_id: int | None = None, source: str | None = None) -> int:
        """Add a run of `rows` (did, timestamp, created_at, value, and offset and key if there are any); gives the newest version.

        Of repeats of (did, timestamp) within a run the first to arrive stays, by created_at and then offset. With `key`, the
        lists of devices that are new are registered by the same version. A batch that this source has stored already is
        not stored again.
        """
        if batch_id is not None and self._has_batch(source, batch_id, base := self.version()):
            return base
        stamp = created_at if created_at is not None else time.time_ns()
        arrival = ["created_at", *(c for c in ("offset",) if c in rows.columns)]
        fields = self._write_fields(rows, arrival, stamp) if "key" in rows.columns else []
        rows = rows.withColumn("run_created_at", F.lit(stamp)).withColumn("shard_id", shard_id("timestamp", self.width))
        return self._commit(self._write(compaction.merge(rows, arrival), stamp), fields=fields, source=source, batch_id=batch_id) or self.version()

    # reading

    def rows(self, files: list[File] | None = None) -> DataFrame:
        """All rows of the files; repeats across runs show until compaction."""
        files = self.files() if files is None else files
        if not files:
            return self.spark.createDataFrame([], STORED)
        schema = T.StructType([*STORED, T.StructField("run", T.StringType())])  # run and shard_id come from the folders' names
        read = self.spark.read.schema(schema).option("basePath", f"{self.root}/data")
        return read.parquet(*(f"{self.root}/{f.path}" for f in files)).drop("run")

    def registry(self) -> DataFrame:
        """did, key: the register list that a device was first stored with."""
        paths = [r.path for r in self.actions().where("action = 'fields'").select("path").collect()]
        if not paths:
            return self.spark.createDataFrame([], FIELDS).drop("run_created_at")
        found = self.spark.read.schema(FIELDS).parquet(*(f"{self.root}/{p}" for p in paths))
        return registry.first_fields(found, ["run_created_at", "key"])

    def scan(self, did: int, start: int, end: int, granularity: str = "exact", dedup: bool = False, named: bool = False) -> DataFrame:
        """One device's rows; named: did, timestamp, register, reading by the stored register list.

        Only files whose bounds meet the device and the time are opened; did and time are pushed down to those.
        """
        low, high = scan.shard_of(start, self.width), scan.shard_of(end, self.width)
        meets = F.col("shard_id").between(low, high) & F.lit(did).between(F.col("min_did"), F.col("max_did"))
        if granularity == "exact":
            meets = meets & (F.col("min_time") <= end) & (F.col("max_time") >= start)
        found = scan.device_scan(self.rows(self.files(where=meets)), did, start, end, granularity, self.width)
        found = compaction.merge(found) if dedup else found
        return registry.explode(found, self.registry().where(F.col("did") == did)) if named else found

    def view(self, name: str = "telemetry") -> None:
        """Make the rows of the newest version a view for SQL."""
        self.rows().createOrReplaceTempView(name)

    def catalog(self) -> DataFrame:
        """shard_id, size, name, run_created_at, rows and bounds of the live files."""
        return self.live().withColumnRenamed("path", "name")

    def size(self) -> int:
        """Bytes of everything below the root, what no version names included."""
        return self._fs.getContentSummary(self._path(self.root)).getLength()

    # maintenance

    def compact(self, small: int = SMALL_RUN, least: int = MIN_RUNS) -> list[int]:
        """Merge the small files of each shard that has more than `least`; returns the shards that were.

        Rows keep the stamp of the run that they first came in, so a later merge still knows which is older. Each shard
        is published by itself: one whose files another writer has replaced meanwhile is left as it is.
        """
        some = self.live().where(F.col("size") < small)
        shards = some.groupBy("shard_id").agg(F.count("*").alias("n")).where(F.col("n") > least).select("shard_id")
        gone = [File(**r.asDict()) for r in some.join(shards, "shard_id", "left_semi").select(*File.__dataclass_fields__).collect()]
        if not gone:
            return []
        written, done = self._write(compaction.merge(self.rows(gone)), time.time_ns()), []
        for shard in sorted({f.shard_id for f in gone}):
            own = lambda files: [f for f in files if f.shard_id == shard]  # noqa: B023, E731
            try:
                self._commit(own(written), own(gone))
                done.append(shard)
            except Conflict:
                continue
        return done

    def remove(self, tombstones: DataFrame) -> int:
        """Rewrite the files that `tombstones` (did, start, end, created) can meet, without the rows that they cover; gives the newest version."""
        for _ in range(ATTEMPTS):
            base = self.version()
            spread = tombstones.where("start <= end").withColumn("shard_id", F.explode(F.sequence(shard_id("start", self.width), shard_id("end", self.width))))
            meets = F.col("did").between(F.col("min_did"), F.col("max_did")) & (F.col("min_time") <= F.col("end")) & (F.col("max_time") >= F.col("start"))
            met = self.live(base).alias("f").join(spread.select("did", "start", "end", "shard_id"), "shard_id").where(meets)
            files = [File(**r.asDict()) for r in met.select(*File.__dataclass_fields__).distinct().collect()]
            if not files:
                return base
            written = self._write(compaction.remove_ranges(self.rows(files), tombstones), time.time_ns())
            try:
                return self._commit(written, files)
            except Conflict:
                continue
        raise Conflict(f"files of {self.root} changed too often")

    def reshard(self, root: str, width: int) -> Store:
        """A store at `root` with shards of another width that has the rows and register lists of this one."""
        out = Store(self.spark, root, width, self.compression, self.checkpoint)
        rows = compaction.reshard(self.rows(), width)
        fields = out._write_fields(self.registry().withColumn("created_at", F.lit(0)), ["created_at"], 0)
        out._commit(out._write(rows, time.time_ns()), fields=fields)
        return out

    def vacuum(self, keep: int = 2, grace_ms: int = 3_600_000) -> int:
        """Delete what none of the newest `keep` versions names, those of failed writes included; returns how many data files.

        Files younger than `grace_ms` may belong to a write that isn't published yet, and stay unless an older version names them.
        """
        versions, checkpoints = self._log()
        if not versions:
            return 0
        first = versions[-keep:][0]
        named = {f.path for v in versions[-keep:] for f in self.files(v)}
        known = {r.path for r in self.spark.read.schema(ACTION).json([f"{self.root}/_log/{v:020d}.json" for v in versions]).where("action = 'remove'").select("path").collect()}
        limit, gone = time.time() * 1000 - grace_ms, 0
        folder = self._path(f"{self.root}/data")
        listed = self._fs.listFiles(folder, True) if self._fs.exists(folder) else None
        while listed is not None and listed.hasNext():
            s = listed.next()
            full = s.getPath().toString()
            path = full[full.rindex("/data/run=") + 1 :]
            if path.endswith(".parquet") and path not in named and (path in known or s.getModificationTime() <= limit):
                self._fs.delete(s.getPath(), False)
                gone += 1
        self._save_checkpoint(first)
        for v in (v for v in versions if v < first):
            self._fs.delete(self._path(f"{self.root}/_log/{v:020d}.json"), False)
        for c in (c for c in checkpoints if c < first):
            self._fs.delete(self._path(f"{self.root}/_log/checkpoint={c}"), True)
        return gone
