"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

The ring has 2**14 ticks. A row's key (doc_id) hashes to a tick; each shard stands on the ring as
many virtual nodes. A row goes to the first virtual node clockwise whose shard has room; the rows
that overflow a full shard continue clockwise. All rows of a tick meet the same nodes in the same
order, so it is enough to know how many rows a tick sends to each shard: the counts of the ticks
(at most 2**14 numbers, however many rows there are) go to the driver, which walks the ring with
them. A row then finds its place by its rank within its tick: the rank within a cell of the tick, by hash of
the whole row, plus the count of the cells before it. Rows that are the same are counted and dealt out again. So
no task sorts a whole tick, even if one key holds a third of all rows. Texts are never shuffled.

With slack None, the shards' bounds add up to the number of rows exactly, so counts are at most
one apart; with a slack e, a shard takes up to (1 + e) times its even share, and a change of
the shard count moves fewer rows.

Defined cases: a null text has size 16 and the checksum of the empty text; a null doc_id hashes by
its text's checksum; repeated rows get places of their own; further columns are ignored; no rows
give no rows.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickstrata.llm.repeats import counted, dealt
from tickstrata.session import durable

TICK_BITS = 14
TICKS = 1 << TICK_BITS
CELLS = 1024  # of a tick


def ring(shards: int, vnodes: int) -> list[tuple[int, int]]:
    """The virtual nodes as (tick, shard), clockwise."""
    points = []
    for shard in range(shards):
        for k in range(vnodes):
            h = int.from_bytes(hashlib.blake2b(f"{shard}/{k}".encode(), digest_size=8).digest(), "big")
            points.append((h, shard))
    return [(h >> (64 - TICK_BITS), shard) for h, shard in sorted(points)]


def bounds(rows: int, shards: int, slack: float | None) -> list[int]:
    if slack is None:
        return [rows // shards + (k < rows % shards) for k in range(shards)]
    return [-int(-(1 + slack) * rows // shards)] * shards


def walk(counts: dict[int, int], shards: int, vnodes: int, slack: float | None) -> list[tuple[int, int, int, int, int]]:
    """(tick, first rank, last rank, shard, slot of the first): which ranks of a tick go to which shard.

    In each round every tick that has rows left asks its next virtual node, in ring order, so a
    shard's own rows come before those that overflow from others.
    """
    nodes = ring(shards, vnodes)
    free = bounds(sum(counts.values()), shards, slack)
    taken = [0] * shards
    first, at = [0] * TICKS, 0
    for tick in range(TICKS):
        while at < len(nodes) and nodes[at][0] < tick:
            at += 1
        first[tick] = at % len(nodes)
    left = {t: [n, 0, first[t]] for t, n in sorted(counts.items())}  # rows, next rank, next node
    out = []
    while left:
        for tick in list(left):
            state = left[tick]
            while not free[shard := nodes[state[2]][1]]:
                state[2] = (state[2] + 1) % len(nodes)
            n = min(state[0], free[shard])
            out.append((tick, state[1] + 1, state[1] + n, shard, taken[shard]))
            free[shard] -= n
            taken[shard] += n
            state[0] -= n
            state[1] += n
            if not state[0]:
                del left[tick]
    return out


def assign(docs: DataFrame, shards: int = 40, vnodes: int = 64, slack: float | None = None) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot for each row of `docs` (doc_id, text, ...)."""
    crc = F.crc32(F.coalesce("text", F.lit("")).cast("binary"))
    size = (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long")
    rows = counted(docs.select("doc_id", size.alias("size"), crc.alias("text_crc32")), "shard-rows")
    key = F.xxhash64("doc_id", F.when(F.col("doc_id").isNull(), F.col("text_crc32")))
    rows = rows.select("*", F.shiftrightunsigned(key, 64 - TICK_BITS).cast("int").alias("tick"), F.pmod(F.xxhash64("doc_id", "text_crc32", "size"), F.lit(CELLS)).alias("cell"))
    counts = {r["tick"]: r["rows"] for r in rows.groupBy("tick").agg(F.sum("n").alias("rows")).collect()}
    plan = json.dumps([list(x) for x in walk(counts, shards, vnodes, slack)])
    segments = docs.sparkSession.range(1).select(F.explode(F.from_json(F.lit(plan), "array<array<long>>")).alias("s"))
    segments = segments.select(F.col("s")[0].cast("int").alias("tick"), F.struct(*(F.col("s")[k].alias(n) for k, n in ((1, "low"), (2, "high"), (3, "shard"), (4, "slot")))).alias("s"))
    segments = segments.groupBy("tick").agg(F.collect_list("s").alias("segments"))  # at most TICKS rows
    running = Window.rowsBetween(Window.unboundedPreceding, -1)
    ahead = lambda of, by, order: F.coalesce(F.sum(of).over(running.partitionBy(*by).orderBy(*order)), F.lit(0))
    cells = rows.groupBy("tick", "cell").agg(F.sum("n").alias("rows")).select("tick", "cell", ahead("rows", ["tick"], ["cell"]).alias("before"))
    within = rows.select("*", ahead("n", ["tick", "cell"], ["doc_id", "text_crc32", "size"]).alias("within"))
    within = within.join(cells, ["tick", "cell"]).select("doc_id", "size", "text_crc32", "tick", (F.col("before") + F.col("within")).alias("before"), "n")
    rows = dealt(durable(within, "shard-ranks")).withColumn("rank", F.col("before") + F.col("k") + 1)
    placed = rows.join(F.broadcast(segments), "tick")
    segment = F.filter("segments", lambda s: (s["low"] <= F.col("rank")) & (F.col("rank") <= s["high"]))[0]
    placed = placed.withColumn("s", segment)
    return placed.select(
        "doc_id", "size", "text_crc32", F.col("s.shard").cast("int").alias("shard"), (F.col("s.slot") + F.col("rank") - F.col("s.low")).alias("slot")
    )
