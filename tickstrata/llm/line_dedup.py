"""Line deduplication by content-defined chunks of lines.

A rolling hash over the hashes of two neighbouring lines decides after which lines a chunk ends, so
chunks depend on the lines alone and stay the same when text is put in before them. A chunk of several
lines that stands earlier anywhere in the corpus goes. A passage that is repeated begins and ends
inside chunks, so matches are extended over the edges: at every line begins, and at every line ends, an
overlapping chunk whose boundary is the first one that gives it LONG words. Those that stand earlier go, too,
which together takes every run of equal lines of LONG words or more, one long line included. The
first occurrence (by doc_id, then place) stays, and so does a repeat that overlaps it.

Digests only find the candidates: their complete texts are grouped and joined byte by byte before
anything goes. A chunk that very many documents share is pre-aggregated before the shuffle and never
gathered in one place.

Defined cases: a null text stays null; a text whose lines all go becomes empty, and its row stays;
rows that repeat doc_id and text are one document and get the same text; chunks without a word stay,
and so do single lines under LONG words, however often they occur; a line counts as a word at least; very
long texts are cut in time linear in their lines; a null doc_id comes first; no rows give no rows;
further columns stay as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickstrata.session import discard, durable

LONG = 50  # words of a run of lines that goes wherever its edges are
WORD = r"[^\x20\x09-\x0D]+"
SHIFT = 32  # a chunk is start << SHIFT | lines


def _held(name: str) -> Column:
    """The column, named twice: the optimizer inlines what is named once, and would make it anew for each element."""
    return F.when(F.size(name) >= 0, F.col(name))


def _start(at: Column) -> Column:
    return F.shiftright(at, SHIFT).cast("int")


def _lines_of(at: Column) -> Column:
    return at.bitwiseAND((1 << SHIFT) - 1).cast("int")


def _at(start: Column, lines: Column) -> Column:
    return F.shiftleft(start.cast("long"), SHIFT).bitwiseOR(lines.cast("long"))


def _ended(size: Column) -> Column:
    """The lines (from 0) after which a chunk ends."""

    def ends(i: Column) -> Column:
        return (i == size - 1) | ((F.coalesce(F.get("_roll", i - 1), F.lit(0)) * 31 + F.get("_roll", i)) % 101 % 2 == 0)

    return F.filter(F.sequence(F.lit(0), size - 1), ends)


def _needed(words: Column) -> Column:
    """How many of the words' lines reach LONG words; null if all of them are too few."""
    add = lambda a, x: F.when(a["words"] >= LONG, a).otherwise(F.struct((a["words"] + F.greatest(x, F.lit(1))).alias("words"), (a["n"] + 1).alias("n")))
    return F.aggregate(words, F.struct(F.lit(0).alias("words"), F.lit(0).alias("n")), add, lambda a: F.when(a["words"] >= LONG, a["n"]))


def _cut(texts: DataFrame) -> DataFrame:
    """`texts` with `_lines`, `_hash` (of each line) and `_ats`: the chunks that may go."""
    df = texts.select("*", F.split("text", "\n").alias("_lines"))
    rolled = lambda x: F.conv(F.substring(F.md5(x), 1, 4), 16, 10).cast("int")
    df = df.select(
        "*", F.transform("_lines", rolled).alias("_roll"), F.transform("_lines", lambda x: F.xxhash64(x)).alias("_hash"),
        F.transform("_lines", lambda x: F.regexp_count(x, F.lit(WORD))).alias("_words"),
    )
    df = df.select("*", _ended(F.size("_lines")).alias("_ends"))
    chunk = lambda end, k: F.struct((F.coalesce(F.get("_ends", k - 1), F.lit(-1)) + 1).alias("first"), end.alias("end"))
    several = F.filter(F.transform("_ends", chunk), lambda c: c["end"] > c["first"])
    several = F.transform(several, lambda c: _at(c["first"], c["end"] - c["first"] + 1))
    # a line counts as a word at least, so LONG lines are enough
    ahead = F.transform("_words", lambda _, i: _at(i, _needed(F.slice(_held("_words"), i + 1, F.lit(LONG)))))
    low = lambda i: F.greatest(i - LONG + 1, F.lit(0))
    back = F.transform("_words", lambda _, i: _needed(F.reverse(F.slice(_held("_words"), low(i) + 1, i - low(i) + 1))))
    back = F.transform(back, lambda n, i: _at(i - n + 1, n))
    worded = lambda at: F.exists(F.slice(_held("_words"), _start(at) + 1, _lines_of(at)), lambda w: w > 0)
    ats = F.filter(F.array_distinct(F.array_compact(F.concat(several, ahead, back))), worded)
    return df.select("*", ats.alias("_ats")).drop("_roll", "_ends")


def _same(a: str, b: str) -> list[Column]:
    return [F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.doc_id")), F.col(f"{a}.text_hash") == F.col(f"{b}.text_hash")]


def removals(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, gone: the chunks (start << SHIFT | lines) of a document that stand earlier, without overlap."""
    texts = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    digest = lambda at: F.aggregate(F.slice(_held("_hash"), _start(at) + 1, _lines_of(at)), F.lit(7).cast("long"), lambda a, x: F.xxhash64(a, x))
    narrow = _cut(texts).select("doc_id", "text_hash", F.transform("_ats", lambda at: F.struct(at.alias("at"), digest(at).alias("digest"))).alias("_ats"))
    # explode_outer, as the filter that Spark infers below a plain one would make the chunks anew, inlined
    narrow = narrow.select("doc_id", "text_hash", F.explode_outer("_ats").alias("c")).where("c IS NOT NULL").select("doc_id", "text_hash", "c.*")
    narrow = durable(narrow, "line-chunks")
    # grouped by more than the key: the joins then deal both sides themselves, and can split what many documents share
    again = narrow.groupBy("digest", F.xxhash64("digest").alias("h")).agg(F.count("*").alias("n")).where("n > 1").select("digest")
    held = narrow.join(again, "digest").groupBy("doc_id", "text_hash").agg(F.collect_set("at").alias("ats"))
    own = texts.alias("t").join(held.alias("h"), _same("t", "h"))
    own = own.select("t.doc_id", "t.text_hash", "ats", F.split("t.text", "\n").alias("_lines"))
    chunk = lambda at: F.struct(at.alias("at"), F.array_join(F.slice(_held("_lines"), _start(at) + 1, _lines_of(at)), "\n").alias("chunk"))
    own = own.select("doc_id", "text_hash", F.explode_outer(F.transform("ats", chunk)).alias("c")).where("c IS NOT NULL")
    own = durable(own.select(F.struct("doc_id", "text_hash", "c.at").alias("place"), "c.chunk"), "line-candidates")
    discard(narrow)
    firsts = own.groupBy("chunk", F.xxhash64("chunk").alias("hash")).agg(F.min("place").alias("first")).drop("hash")
    both = own.join(firsts, "chunk")
    one = F.col("place.doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("place.text_hash") == F.col("first.text_hash"))
    gone = both.where(~one | (_start(F.col("place.at")) >= _start(F.col("first.at")) + _lines_of(F.col("first.at")))).select("place.*")
    gone = durable(gone.groupBy("doc_id", "text_hash").agg(F.collect_set("at").alias("gone")), "line-gone")
    discard(own)
    return gone


def clean(docs: DataFrame, whole: float | None = None) -> DataFrame:
    """`docs` with the cleaned text in `text`, and n_lines, n_removed (lines) beside its columns.

    whole: documents that would lose this share of their characters or more are copies as a whole, and stay as they are.
    """
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("doc_id"), F.xxhash64("text").alias("text_hash"))
    # what goes grows with the documents, so it is never broadcast, however small a table is
    df = rows.alias("r").join(removals(docs).hint("merge").alias("g"), _same("r", "g"), "left").select("row", "gone", F.split("row.text", "\n").alias("_lines"))
    out = F.array_distinct(F.flatten(F.transform("gone", lambda at: F.sequence(_start(at), _start(at) + _lines_of(at) - 1))))
    df = df.select("row", "_lines", out.alias("out"))
    stays = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("out"))
    kept = F.array_join(F.transform(stays, lambda i: F.get(_held("_lines"), i)), "\n")
    df = df.select("row", F.size("_lines").alias("lines"), "out", F.when(F.col("out").isNotNull(), kept).alias("kept"))
    if whole is not None:
        left = F.length("kept") > (1 - whole) * F.length("row.text")
        df = df.select("row", "lines", F.when(left, F.col("out")).alias("out"), F.when(left, F.col("kept")).alias("kept"))
    text = F.when(F.col("out").isNull(), F.col("row.text")).otherwise(F.col("kept"))
    columns = [(text if c == "text" else F.col("row").getField(c)).alias(c) for c in docs.columns]
    n_lines = F.when(F.col("row.text").isNull(), 0).otherwise(F.col("lines"))
    return df.select(*columns, n_lines.cast("long").alias("n_lines"), F.when(F.col("out").isNull(), 0).otherwise(F.size("out")).cast("long").alias("n_removed"))
