"""Exact deduplication by Grace hashing.

Records go to hash buckets; a bucket that outgrows its memory is partitioned to spill files by the
next bits of the hash, again and again, until each one fits an open-addressing table. The table
compares complete contents, so two texts count as equal only if every byte is. Each input partition
is combined in this way before the shuffle, so a text that a third of all rows share reaches the
shuffle once for each input partition, not once for each row.

Spill files belong to one task, stand in its own temporary folder and go when the task ends, as
Spark's spill files do; no other task reads them.

Defined cases: a null text counts as empty; texts are equal when identical after lower-casing A-Z
only; the row with the largest doc_id stays (null is the smallest); of rows that repeat both
doc_id and text, one stays; further columns are ignored; no rows give no rows.
"""

from __future__ import annotations

import hashlib
import os
import pickle
import string
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickstrata.llm.repeats import counted, dealt

FAN = 16  # spill files of one partitioning step: four bits of the hash each
BITS = 60


class OpenTable:
    """Open addressing with linear probing; equal means equal content, never just equal hashes."""

    def __init__(self) -> None:
        self.slots: list[int] = [-1] * 64
        self.rows: list[list] = []  # hash, content, largest doc_id, rows
        self.bytes = 0

    def add(self, h: int, content: bytes, doc_id: int | None, n: int) -> None:
        slots, rows = self.slots, self.rows
        mask = len(slots) - 1
        at = h & mask
        while (k := slots[at]) >= 0:
            row = rows[k]
            if row[0] == h and row[1] == content:
                if doc_id is not None and (row[2] is None or doc_id > row[2]):
                    row[2] = doc_id
                row[3] += n
                return
            at = (at + 1) & mask
        slots[at] = len(rows)
        rows.append([h, content, doc_id, n])
        self.bytes += len(content) + 200
        if 2 * len(rows) > len(slots):
            self._grow()

    def _grow(self) -> None:
        mask = 4 * len(self.slots) - 1
        self.slots = [-1] * (mask + 1)
        for k, row in enumerate(self.rows):
            at = row[0] & mask
            while self.slots[at] >= 0:
                at = (at + 1) & mask
            self.slots[at] = k


def grace(records: Iterator[tuple[int, bytes, int | None, int]], budget: int, depth: int = 0) -> Iterator[list]:
    """Combine records of equal content within `budget` bytes of memory; yields [hash, content, largest doc_id, rows]."""
    table = OpenTable()
    for record in records:
        table.add(*record)
        if table.bytes > budget and 4 * depth < BITS and len(table.rows) > 1:
            break
    else:
        yield from table.rows
        return
    with tempfile.TemporaryDirectory(prefix="grace-") as folder:
        paths = [os.path.join(folder, str(i)) for i in range(FAN)]
        files = [open(p, "wb") for p in paths]  # noqa: SIM115
        try:
            shift = BITS - 4 * depth
            put = [pickle.Pickler(f, protocol=5) for f in files]
            for part in (table.rows, records):
                for h, content, doc_id, n in part:
                    p = put[(h >> shift) % FAN]
                    p.dump((h, content, doc_id, n))
                    p.clear_memo()
            table = None
        finally:
            for f in files:
                f.close()
        for p in paths:
            yield from grace(_spilled(p), budget, depth + 1)
            os.remove(p)


def _spilled(path: str) -> Iterator[tuple]:
    with open(path, "rb") as f:
        load = pickle.Unpickler(f).load
        while True:
            try:
                yield load()
            except EOFError:
                return


def _batches(rows: Iterator[list], make, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[1]) + 32
        if size > most:
            yield make(held)
            held, size = [], 0
    if held:
        yield make(held)


def _normal(text) -> bytes:
    return (text or "").encode().lower()  # bytes.lower() knows A-Z only


def _hash(content: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(content, digest_size=8).digest(), "big")


def _combine_local(budget: int):
    def make(rows):
        return pa.RecordBatch.from_arrays(
            [
                pa.array([r[0] - (1 << 63) for r in rows], pa.int64()),
                pa.array([r[1] for r in rows], pa.binary()),
                pa.array([r[2] for r in rows], pa.int64()),
                pa.array([r[3] for r in rows], pa.int64()),
            ],
            names=["h", "content", "keep_id", "n"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def records():
            for b in batches:
                for doc_id, text in zip(b.column(0).to_pylist(), b.column(1)):
                    content = _normal(text.as_py())
                    yield _hash(content), content, doc_id, 1

        yield from _batches(grace(records(), budget), make)

    return run


def _combine_bucket(budget: int):
    def make(rows):
        return pa.RecordBatch.from_arrays(
            [
                pa.array([hashlib.sha256(r[1]).hexdigest() for r in rows], pa.string()),
                pa.array([r[2] for r in rows], pa.int64()),
                pa.array([r[3] for r in rows], pa.int64()),
            ],
            names=["text_sha256", "keep_id", "group_size"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def records():
            for b in batches:
                for h, content, keep, n in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), b.column(3).to_pylist()):
                    yield h + (1 << 63), content.as_py(), keep, n

        yield from _batches(grace(records(), budget), make)

    return run


def normal_digest(text: Column) -> Column:
    """The digest of the normalised text."""
    return F.sha2(F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase), 256)


def groups(docs: DataFrame, budget: int = 64 << 20) -> DataFrame:
    """One row for each distinct normalised text: text_sha256, keep_id, group_size."""
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    local = rows.mapInArrow(_combine_local(budget), "h long, content binary, keep_id long, n long")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return local.repartition(n, "h").mapInArrow(_combine_bucket(budget), "text_sha256 string, keep_id long, group_size long")


def mark(docs: DataFrame, budget: int = 64 << 20) -> DataFrame:
    """For each row of `docs` (doc_id, text, ...): doc_id, keep_id, group_size, kept, text_sha256."""
    # rows that repeat both are counted, so that no window has to gather them; dealt out before the join, which can split a very large group
    rows = dealt(counted(docs.select(F.col("doc_id").cast("long"), normal_digest(F.col("text")).alias("text_sha256")), "exact-rows"))
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("k") == 0)
    return rows.join(groups(docs, budget), "text_sha256").select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256")
