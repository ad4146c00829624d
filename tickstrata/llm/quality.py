"""Quality classifier: ordinal cumulative-link regression on graded ratings.

The grade of a labelled document is quality plus not-toxic: 0, 1 or 2. One weight vector over hashed
text features is shared by all grades; ordered thresholds cut its score into grades:
P(grade >= g) = sigmoid(score - threshold_g). Expected grade and tail probability follow.

Features of a text: the presence of each word (lower-case, without edge punctuation) and of the first
3 to 6 characters of a word, as languages that inflect and compound vary its end; and how large
its shares of capitals, digits, symbols, bars, doubled marks, repeated words and repeated lines are. They
are present or not, so a single telling word weighs the same in a long text. Buckets met in fewer
than `least` labelled documents keep weight 0.

The fit reads a sample of at most `most` labelled rows (those of the smallest hashes of doc_id) on the driver; every
document is scored. Defined cases: a null text counts as empty, and an empty one is scored by the
thresholds alone; repeated rows get a row each; a doc_id with several labels uses its lowest grade;
without labels every document gets probability 1 and the highest grade; further columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickstrata.llm.batches import slices

BITS = 18
GRADES = 3
EDGE = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~¿¡«»"
PREFIXES = (3, 4, 5, 6)
STEPS = (0.002, 0.005, 0.01, 0.02, 0.05, 0.1, 0.2, 0.4)  # thresholds of the shares' features
_MARKS = re.compile(r"[^\w\s]{2,}")
_UPPER = re.compile(r"\b[^\W\d_a-z]*[A-Z][^\W\d_a-z]*\b")
SHARES = ("capitals", "digits", "symbols", "bars", "doubled marks", "repeated words", "repeated lines")


def features(text: str) -> np.ndarray:
    """The distinct hashed features of a text, ascending."""
    words = text.split()
    bare = {w.strip(EDGE) for w in set(text.lower().split())}
    found = {zlib.crc32(w.encode()) >> (32 - BITS) for w in bare}
    for k in PREFIXES:
        found.update(zlib.crc32(b"%d^" % k + w.encode()) >> (32 - BITS) for w in {w[:k] for w in bare if len(w) > k})
    n, chars, lines = max(len(words), 1), max(len(text), 1), text.split("\n")
    shares = (
        sum(map(str.isupper, words)) / n,
        sum(map(text.count, "0123456789")) / chars,
        sum(map(text.count, EDGE)) / chars,
        text.count("|") / n,
        len(_MARKS.findall(text)) / n,
        (1 - len(set(words)) / n) / 4,
        1 - len(set(lines)) / len(lines),
    )
    for name, share in zip(SHARES, shares):
        found.update(zlib.crc32(f"\0{name}>{s}".encode()) >> (32 - BITS) for s in STEPS if share > s)
    return np.fromiter(sorted(found), np.int64, len(found))


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    thresholds: np.ndarray  # of grades 1 and 2, ascending

    def score(self, texts: list[str]) -> np.ndarray:
        return np.array([self.weights[features(t)].sum() for t in texts], float)

    def tails(self, texts: list[str]) -> np.ndarray:
        """P(grade >= g) of each text, for g = 1 and 2."""
        return _sigmoid(self.score(texts)[:, None] - self.thresholds[None, :])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit(rows: list[np.ndarray], grades: np.ndarray, least: int = 5, lasso: float = 1e-3, turns: int = 150) -> Model:
    """Maximum penalised likelihood by gradient steps with momentum; thresholds stay in order by their gap's logarithm."""
    weights = np.zeros(1 << BITS)
    if not len(rows):
        return Model(weights, np.full(GRADES - 1, -40.0))
    met = np.zeros(1 << BITS, np.int32)
    for r in rows:
        met[r] += 1
    used = np.flatnonzero(met >= least)
    number = np.full(1 << BITS, -1, np.int32)
    number[used] = np.arange(len(used), dtype=np.int32)
    rows = [(k := number[r])[k >= 0] for r in rows]
    flat, doc = np.concatenate(rows), np.repeat(np.arange(len(rows), dtype=np.int32), [len(r) for r in rows])
    share = met[used] / len(rows)
    first = [np.clip((grades >= g).mean(), 1e-3, 1 - 1e-3) for g in range(1, GRADES)]
    low = -np.log(first[0] / (1 - first[0]))
    gap = np.log(max(-np.log(first[1] / (1 - first[1])) - low, 1e-2))
    w, state = np.zeros(len(used)), np.array([low, gap])
    m, v = np.zeros(len(used) + 2), np.zeros(len(used) + 2)
    for turn in range(1, turns + 1):
        cuts = np.array([state[0], state[0] + np.exp(state[1])])
        score = np.bincount(doc, w[flat], len(rows)) - share @ w
        a = _sigmoid(score - cuts[0])  # P(grade >= 1)
        b = _sigmoid(score - cuts[1])
        p = np.clip(np.choose(grades, [1 - a, a - b, b]), 1e-9, 1)
        da, db = a * (1 - a), b * (1 - b)
        by_score = np.choose(grades, [-da, da - db, db]) / p
        by_low = np.choose(grades, [da, -da, np.zeros_like(a)]) / p
        by_high = np.choose(grades, [np.zeros_like(a), db, -db]) / p
        g = np.concatenate([np.bincount(flat, by_score[doc], len(used)) - share * by_score.sum(), [by_low.sum() + by_high.sum(), by_high.sum() * np.exp(state[1])]])
        g /= len(rows)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        step = 0.1 * (m / (1 - 0.9**turn)) / (np.sqrt(v / (1 - 0.99**turn)) + 1e-6)
        rate = 0.1 / (1 - 0.9**turn) / (np.sqrt(v[: len(used)] / (1 - 0.99**turn)) + 1e-6)
        w += step[: len(used)]
        w = np.sign(w) * np.maximum(np.abs(w) - rate * lasso, 0)  # the proximal step: weights without a clear use become 0
        state = state + step[len(used) :]
    weights[used] = w
    shift = share @ w
    return Model(weights, np.array([state[0], state[0] + np.exp(state[1])]) + shift)


def _features_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        rows = [features(t or "").astype(np.int32) for t in b.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.int32())), b.column(1)], names=["features", "grade"])


def train(docs: DataFrame, labels: DataFrame, most: int = 5000) -> Model:
    """Fit on at most `most` rows of `docs` (doc_id, text, ...) that `labels` (doc_id, quality, toxic) grades."""
    grade = (F.col("quality") + 1 - F.col("toxic")).cast("int")
    graded = labels.where("quality IN (0, 1) AND toxic IN (0, 1)").groupBy("doc_id").agg(F.min(grade).alias("grade"))
    chosen = graded.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "grade")  # at most `most` rows of 12 bytes
    table = rows.mapInArrow(_features_of, "features array<int>, grade int").orderBy("grade").toArrow()
    column = table.column("features").combine_chunks()
    return fit([np.asarray(x.values) for x in column], np.asarray(table.column("grade").to_numpy(), np.int64))


def _scorer(model: Model, inside: bool):
    """Puts the expected grade and the top grade's probability beside the first column; the text is the second one, or a field of the first."""
    # only the weights in use go to the executors
    used = np.flatnonzero(model.weights)
    values, thresholds = model.weights[used], model.thresholds

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = np.zeros(1 << BITS)
        weights[used] = values
        own = Model(weights, thresholds)
        for b in slices(batches):
            texts = pc.struct_field(b.column(0), "text") if inside else b.column(1)
            tails = own.tails([t or "" for t in texts.to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(tails.sum(1)), pa.array(tails[:, 1])], names=[b.schema.names[0], "expected_grade", "p_top"])

    return run


def score(docs: DataFrame, model: Model, keep: float = 0.5) -> DataFrame:
    """doc_id, expected_grade, p_top (probability of the highest grade), kept for each row of `docs`."""
    rows = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_scorer(model, False), "doc_id long, expected_grade double, p_top double")
    return rows.withColumn("kept", F.col("p_top") >= keep)


def select(docs: DataFrame, model: Model, keep: float = 0.5) -> DataFrame:
    """The rows of `docs` that the classifier keeps."""
    rows = docs.select(F.struct("*").alias("row"))
    schema = f"row {rows.schema['row'].dataType.simpleString()}, expected_grade double, p_top double"
    return rows.mapInArrow(_scorer(model, True), schema).where(F.col("p_top") >= keep).select("row.*")
