"""Best-fit packing of documents into sequences by a grouping genetic algorithm.

Pieces are dealt to blocks by hash, a few thousand each, so that sizes are mixed alike. Several
islands evolve packings of each block, each island a task of its own. A packing starts from best-fit
on a perturbed descending order. Crossover injects whole well-filled bins of one parent into the
other, drops the bins that hold a piece twice by now and some of the emptiest ones, lets bins exchange pieces for
displaced ones that fill them better, and best-fits those that stay displaced. A block whose packing has as few
bins as its tokens need is done. Between rounds each island's elite migrates to the next island; in the end the best
packing of a block is used. Every random choice is seeded by block, island and round, so a lost task
gives the same packing again.

Token ids are those of the tokenizers library. Where a text has plain Latin characters only, no special
string and no very long run without a break, tiktoken gives the same ids from the same vocabulary
several times faster and is used instead; the tests compare the two.

Defined cases: a null text counts as empty and is one piece that holds the closing id; a document
longer than a sequence is cut so that only its first piece is shorter; repeated rows are packed
each; further columns are ignored; no rows give no rows.
"""

from __future__ import annotations

import base64
import os
import random
import re
import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickstrata.llm.batches import slices
from tickstrata.llm.repeats import counted, dealt
from tickstrata.session import durable

SIZE = 2048
PASSES = 3  # over the bins, to exchange displaced pieces
ORDERS = 6  # for the best fit of what stays displaced
STALE = 6  # generations without a better packing, after which an island waits for the next round
PAIRED = 60  # displaced pieces, the shortest ones, that are also tried two at a time
END = 0
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"
FINAL = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])
_PLAIN = re.compile(r"[\t\n\r\x20-\x7e\xa1-ɏ]*")
_RUN = 300  # characters of a run of one kind, beyond which merging by tiktoken takes too long
_loaded: dict = {}


def _encoder(path: str):
    """Function from a list of texts to arrays of ids."""
    if path in _loaded:
        return _loaded[path]
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(path)
    own.no_truncation()
    own.no_padding()

    def plain(text: str) -> np.ndarray:
        return np.asarray(own.encode(text, add_special_tokens=False).ids, np.uint32)

    ranks, one = path.removesuffix(".json") + ".tiktoken", plain
    if os.path.exists(ranks):
        import public_tokenizers
        import tiktoken

        with open(ranks, "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        fast = tiktoken.Encoding("pieces", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})

        def one(text: str) -> np.ndarray:
            words = text.split()
            blank = len(text) - sum(map(len, words)) - len(words)  # beyond one for each word
            if blank > _RUN or len(max(words, key=len, default="")) > _RUN or "<|" in text or not _PLAIN.fullmatch(text):
                return plain(text)
            return np.frombuffer(array("I", fast.encode_ordinary(text)), np.uint32)

    _loaded[path] = one
    return one


def _cut(path: str, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(path)
        for b in slices(batches):
            rows = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids = np.append(encode(text or ""), np.uint32(END)).astype("<u4")
                ends = range(len(ids) % size or min(size, len(ids)), len(ids) + 1, size)
                start = 0
                for k, end in enumerate(ends):
                    rows.append((doc_id, k, start, end - start, zlib.crc32(ids[start:end].tobytes())))
                    start = end
            cols = list(zip(*rows)) or [[]] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def pieces(docs: DataFrame, tokenizer: str, size: int = SIZE) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece of `docs` (doc_id, text, ...)."""
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_cut(tokenizer, size), PIECE)


class Packing:
    """Bins of piece numbers."""

    def __init__(self, bins: list[list[int]], sizes: list[int], size: int) -> None:
        self.bins = bins
        self.fill = [sum(map(sizes.__getitem__, b)) for b in bins]
        # mean square of the bins' fill: rewards full bins beside nearly empty ones
        self.fitness = sum(f * f for f in self.fill) / (size * size * max(len(bins), 1))

    @property
    def score(self) -> tuple[int, float]:
        return -len(self.bins), self.fitness


def best_fit(bins: list[list[int]], fill: list[int], items: list[int], sizes: list[int], size: int) -> None:
    """Put each item, in order, into the bin that it leaves fullest."""
    room = sorted((size - f, k) for k, f in enumerate(fill) if f < size)
    for item in items:
        n = sizes[item]
        at = bisect_left(room, (n, -1))
        if at < len(room):
            left, k = room.pop(at)
            bins[k].append(item)
            left -= n
        else:
            k, left = len(bins), size - n
            bins.append([item])
        if left:
            insort(room, (left, k))


def start(sizes: list[int], size: int, rng: random.Random, noise: float) -> Packing:
    order = sorted(range(len(sizes)), key=lambda k: (-sizes[k] * (1 + noise * rng.random()), k))
    bins: list[list[int]] = []
    best_fit(bins, [], order, sizes, size)
    return Packing(bins, sizes, size)


def exchange(bins: list[list[int]], fill: list[int], free: list[int], sizes: list[int], size: int, order: list[int]) -> list[int]:
    """Give bins, in `order`, one displaced piece for up to two of theirs, or two for up to one, where that fills them better.

    Returns what is displaced then: its total falls with each exchange.
    """
    free = sorted(free, key=lambda k: (sizes[k], k))
    lengths = np.array([sizes[k] for k in free], np.int64)

    def paired():
        i, j = np.triu_indices(min(len(lengths), PAIRED), 1)
        sums = lengths[i] + lengths[j]
        at = np.argsort(sums, kind="stable")
        return sums[at], i[at], j[at]

    pairs = paired()
    for k in order:
        if not len(free):
            break
        room = size - fill[k]
        if not room:
            continue
        # at equal gain many pieces come out for one: short pieces among the displaced make those easier to place
        outs = [*combinations(bins[k][:PAIRED], 2), *((x,) for x in bins[k]), ()]
        less = np.array([sum(sizes[x] for x in o) for o in outs], np.int64)
        one = np.searchsorted(lengths, less + room, "right") - 1
        gains = np.where(one >= 0, lengths[one] - less, 0)
        best = int(gains.argmax())
        out, come, gain = outs[best], [int(one[best])], int(gains[best])
        if gain < room and len(pairs[0]):
            less = less[-len(bins[k]) - 1 :]
            two = np.searchsorted(pairs[0], less + room, "right") - 1
            gains = np.where(two >= 0, pairs[0][two] - less, 0)
            best = int(gains.argmax())
            if gains[best] > gain:
                at = two[best]
                out, come, gain = outs[len(outs) - len(less) + best], sorted((int(pairs[1][at]), int(pairs[2][at]))), int(gains[best])
        if gain <= 0:
            continue
        bins[k] = [x for x in bins[k] if x not in out] + [free[x] for x in come]
        fill[k] = sum(map(sizes.__getitem__, bins[k]))
        for x in reversed(come):
            del free[x]
        for x in out:
            insort(free, x, key=lambda x: (sizes[x], x))
        lengths = np.array([sizes[x] for x in free], np.int64)
        pairs = paired()
    return free


def cross(a: Packing, b: Packing, sizes: list[int], size: int, rng: random.Random) -> Packing:
    """`a` with some whole well-filled bins of `b`; the displaced pieces are exchanged for others, then best-fitted."""
    ranked = sorted(range(len(b.bins)), key=lambda k: -b.fill[k])
    good = ranked[: max(1, len(ranked) // 2)]
    chosen = [b.bins[k] for k in rng.sample(good, max(1, len(good) // rng.choice((5, 20, 80, 320))))]
    injected = {item for items in chosen for item in items}
    kept, free = [], []
    for items in a.bins:
        if injected.isdisjoint(items):
            kept.append(list(items))
        else:
            free += [k for k in items if k not in injected]
    # some of the emptiest bins, and some others, are dissolved, too, so that a bin can be saved
    kept.sort(key=lambda items: -sum(map(sizes.__getitem__, items)))
    least = max(1, len(kept) - rng.choice((1, 2, 4, 8, 16)))
    gone = {*range(least, len(kept)), *rng.sample(range(least), min(least - 1, rng.choice((0, 4, 16, 64))))}
    free += [item for k in gone for item in kept[k]]
    kept = [items for k, items in enumerate(kept) if k not in gone] + [list(items) for items in chosen]
    fill = [sum(map(sizes.__getitem__, items)) for items in kept]
    for _ in range(PASSES):
        order = [k for k in range(len(kept)) if fill[k] < size]
        rng.shuffle(order)
        before = sum(fill)
        free = exchange(kept, fill, free, sizes, size, order)
        if not free or sum(fill) == before:
            break
    # what is displaced still goes to bins in the best of some orders
    found = []
    for k in range(ORDERS):
        order = sorted(free, key=lambda x: (-sizes[x] * (1 + 0.15 * k * rng.random()), x))
        room = [k for k in range(len(kept)) if fill[k] < size]
        bins, held = [list(kept[k]) for k in room], [fill[k] for k in room]
        best_fit(bins, held, order, sizes, size)
        found.append((len(bins), -sum(sum(map(sizes.__getitem__, x)) ** 2 for x in bins), k, room, bins))
    _, _, _, room, bins = min(found, key=lambda x: x[:3])
    for k, items in zip(room, bins):
        kept[k] = items
    return Packing(kept + bins[len(room) :], sizes, size)


def evolve(sizes: list[int], size: int, seed: str, elites: list[Packing], population: int = 4, generations: int = 12) -> Packing:
    """The best packing after some generations; `elites` come from earlier rounds."""
    rng = random.Random(seed)
    pool = list(elites) + [start(sizes, size, rng, 0.0 if not k else 0.1 * k) for k in range(max(population - len(elites), 1))]
    stale = 0
    for _ in range(generations if len(sizes) > 1 else 0):
        pool.sort(key=lambda p: p.score, reverse=True)
        if stale == STALE or not pool[0].bins or len(pool[0].bins) == -(-sum(sizes) // size):
            break  # no packing has fewer bins
        a = pool[0] if rng.random() < 0.5 else rng.choice(pool[: max(2, population // 2)])
        child = cross(a, rng.choice(pool), sizes, size, rng)
        stale = 0 if child.score > pool[0].score else stale + 1
        if child.score > pool[-1].score:
            pool[-1] = child
    return max(pool, key=lambda p: p.score)


def _ordered(table: pa.Table) -> pa.Table:
    """Every island sees the pieces of a block in this order."""
    return table.sort_by([(c, "ascending") for c in ("doc_id", "piece", "start", "length", "ids_crc32")])


def _island(size: int, turn: int):
    def run(key: tuple, own: pa.Table, elites: pa.Table) -> pa.Table:
        block, island = key[0].as_py(), key[1].as_py()
        sizes = _ordered(own).column("length").to_pylist()
        found = []
        for data in elites.sort_by([("fitness", "descending"), ("genome", "ascending")]).column("genome").to_pylist() if elites.num_rows else []:
            bins: dict[int, list[int]] = {}
            for item, k in enumerate(np.frombuffer(data, np.int32).tolist()):
                bins.setdefault(k, []).append(item)
            found.append(Packing(list(bins.values()), sizes, size))
        best = evolve(sizes, size, f"{block}/{island}/{turn}", found)
        genome = np.zeros(len(sizes), np.int32)
        for k, items in enumerate(best.bins):
            genome[items] = k
        fitness = best.fitness - len(best.bins)
        return pa.table({"block": pa.array([block], pa.int64()), "island": pa.array([island], pa.int32()), "fitness": pa.array([fitness], pa.float64()), "genome": pa.array([genome.tobytes()], pa.binary())})

    return run


def _place(key: tuple, own: pa.Table, best: pa.Table) -> pa.Table:
    own = _ordered(own)
    genome = np.frombuffer(best.column("genome")[0].as_py(), np.int32)
    used: dict[int, int] = {}
    offsets = []
    for k, n in zip(genome.tolist(), own.column("length").to_pylist()):
        offsets.append(used.get(k, 0))
        used[k] = offsets[-1] + n
    block = key[0].as_py()
    table = own.select(["doc_id", "piece", "start", "length", "ids_crc32"])
    table = table.append_column("sequence_id", pa.array(genome.astype(np.int64) + (block << 31)))
    return table.append_column("offset", pa.array(offsets, pa.int64())).cast(FINAL)


def pack(cut: DataFrame, size: int = SIZE, per_block: int = 4096, islands: int = 2, rounds: int = 2) -> DataFrame:
    """`cut` (the columns of pieces()) with sequence_id and offset."""
    cut = durable(cut, "pieces")
    blocks = -(-cut.count() // per_block) or 1
    # repeated rows are counted and numbered, so that they go to different blocks
    block = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", "k"), F.lit(blocks))
    cut = durable(dealt(counted(cut, "piece-counts")).withColumn("block", block).drop("k"), "piece-blocks")
    each = cut.select("*", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"))
    genomes = cut.sparkSession.createDataFrame([], "block long, island int, fitness double, genome binary")
    for turn in range(rounds):
        come = genomes.select("block", F.pmod(F.col("island") + 1, F.lit(islands)).cast("int").alias("island"), "fitness", "genome")
        elites = genomes.unionByName(come).distinct()
        genomes = each.groupBy("block", "island").cogroup(elites.groupBy("block", "island")).applyInArrow(_island(size, turn), genomes.schema)
        genomes = durable(genomes, "genomes")
    best = genomes.groupBy("block").agg(F.max_by("genome", F.struct("fitness", "island")).alias("genome"))
    return cut.groupBy("block").cogroup(best.groupBy("block")).applyInArrow(_place, f"{PIECE}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str, size: int = SIZE) -> DataFrame:
    return pack(pieces(docs, tokenizer, size), size)
