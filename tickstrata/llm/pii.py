"""Personal data: fixed patterns, and bootstrapped contextual extraction on top of them.

Seeds are the spans that the fixed patterns find: email, ip, card and phone. The words beside the
seeds become lexical patterns (last word before, last two before, first word after). Patterns and the
instances in their slots form a graph, scored in turns: a pattern's confidence is the mean score of
its distinct instances, without those of the kind's shape that have no score yet; an instance's score
is one minus the chance that all of its accepted patterns are wrong; seeds keep score 1. An instance that no fixed pattern caught is added if it has the rough
shape of the kind and its score after the last turn reaches the threshold. Seeds always stay. An
instance is a token, a run of tokens of digits (phone and card) or an email spelled out in words.

One pass over the texts writes, for each document, its seeds and the tokens that could be
identifiers, with their neighbours; the turns and the result read that narrow table. The patterns'
regular expressions differ from the plain ones only where that cannot change a match: possessive
loops and starts at the edge of a run keep them linear, and free of recursion, on very long runs.

Defined cases: a null text counts as empty; no spans give an empty string and its digest; repeated
rows each get their row; identical instances count once for a pattern; further columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickstrata.session import durable

KINDS = ("email", "ip", "card", "phone")
LOCAL = "[A-Za-z0-9._%+-]"
BASE = {
    "email": rf"(?:(?<!{LOCAL})|\G){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}+",
    # a whole run of 12 to 19 digits with single separators; longer and shorter runs would fail
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
NEEDS = {"email": "@", "ip": ".", "card": "", "phone": "+"}  # without this the pattern cannot match
# a token of 4 characters or more with a digit or an at sign
TOKEN = r"(?<!\S)(?=[^\s0-9@]*+[0-9@])\S{4,}+"
# a token of digits, brackets, dots and dashes; those with only spaces between them form runs
PIECE = r"""(?<![^\s"'<\[{])\(?[0-9][0-9().-]*+(?![^\s"',;:!?>\]}])"""
PIECES = 19  # a run has a digit a piece at least, and no kind more than 19 digits
# an email in words
_AT, _DOT = (rf"(?:\x20++{w}\x20++|\x20*+[(\[{{]\x20*+{w}\x20*+[)\]}}]\x20*+{or_})" for w, or_ in (("at", ""), ("dot", r"|\.")))
SPELLED = rf"(?i)(?<!{LOCAL}){LOCAL}++{_AT}[a-z0-9-]++(?:{_DOT}[a-z0-9-]++)++"
# the rough shape of each kind that an added instance must have
SHAPES = {
    "email": rf"^[^@\s]+@[^@\s]+$|^{SPELLED}$",
    "ip": r"^[0-9]{1,3}([.:][0-9]{1,3}){3}(:[0-9]+)?$|^([0-9A-Fa-f]{1,4}:){3,7}[0-9A-Fa-f]{1,4}$",
    "card": r"^[0-9]([\x20-]?[0-9]){11,18}$",
    "phone": r"^\(?[0-9][0-9().-]{7,17}[0-9]$|^\(?[0-9]([().-]{0,3}(\x20+[().-]{0,3})?[0-9]){8,14}$",
}
HIT = "array<struct<start:int,end:int,value:string,before:string,after:string>>"
BLOCK = 64
SIDE = 48  # characters beside a hit that are searched for its neighbouring words


def _zipped(gaps: Column, found: Column) -> Column:
    """Matches with the texts before and after them: split() gives those in the same order."""
    return F.zip_with(
        F.arrays_zip(F.slice(gaps, 1, F.size(found)).alias("gap"), F.slice(gaps, 2, F.size(found)).alias("next")),
        found,
        lambda g, h: F.struct(g["gap"].alias("gap"), g["next"].alias("next"), h.alias("hit")),
    )


def _hits(zipped: Column) -> Column:
    """Positions of the matches."""

    def step(acc, x):
        start = acc["at"] + F.length(x["gap"])
        end = start + F.length(x["hit"])
        hit = F.struct(
            start.alias("start"), end.alias("end"), x["hit"].alias("value"), F.right(x["gap"], F.lit(SIDE)).alias("before"), F.left(x["next"], F.lit(SIDE)).alias("after")
        )
        return F.struct(end.alias("at"), F.array_append(acc["out"], hit).alias("out"))

    def width(acc, x):
        return acc + F.length(x["gap"]) + F.length(x["hit"])

    # appending copies the array, so a long list is summed up in blocks, each from its own start
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(zipped) - 1) / BLOCK).cast("int")), lambda k: F.slice(zipped, k * BLOCK + 1, F.lit(BLOCK)))
    blocks = F.transform(blocks, lambda b: F.struct(b.alias("hits"), F.aggregate(b, F.lit(0), width).alias("width")))
    none = F.array().cast("array<int>")
    begins = F.aggregate(
        blocks,
        F.struct(F.lit(0).alias("at"), none.alias("out")),
        lambda acc, b: F.struct((acc["at"] + b["width"]).alias("at"), F.array_append(acc["out"], acc["at"]).alias("out")),
    )["out"]
    placed = F.zip_with(
        blocks, begins, lambda b, at: F.aggregate(b["hits"], F.struct(at.alias("at"), F.array().cast(HIT).alias("out")), step)["out"]
    )
    return F.when(F.size(zipped) == 0, F.array().cast(HIT)).otherwise(F.flatten(placed))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        part = lambda p: F.length(F.ltrim(p, F.lit("0"))) <= 3
        number = lambda p: F.coalesce(F.right(p, F.lit(3)).try_cast("int"), F.lit(0)) <= 255
        return F.forall(F.split(value, r"\."), lambda p: part(p) & number(p))
    if kind == "card":
        back = F.reverse(_digits(value))
        doubled = lambda i: F.substring(back, i, F.lit(1)).cast("int") * (F.lit(2) - i % 2)
        luhn = F.aggregate(
            F.sequence(F.lit(1), F.length(back)), F.lit(0), lambda acc, i: acc + doubled(i) - F.when(doubled(i) > 9, 9).otherwise(0)
        )
        return F.length(back).between(12, 19) & (luhn % 10 == 0)
    if kind == "phone":
        return F.length(_digits(value)).between(9, 15)
    return F.lit(True)


def _checker(kind: str):
    return lambda h: _valid(kind, h["value"])


def _namer(kind: int):
    return lambda h: F.struct(
        h["start"].alias("start"), F.lit(kind).alias("kind"), h["end"].alias("end"), *(h[c].alias(c) for c in ("value", "before", "after"))
    )


def _of_kind(kind: int):
    return lambda h: h["kind"] == kind


def _shaped(kind: str, value: Column) -> Column:
    return value.rlike(SHAPES[kind])


def _with_runs(df: DataFrame) -> DataFrame:
    """`df` with `runs` for `piece`: hits of several pieces with only spaces between them that have the shape of a kind.

    They go from the start of such a run or to its end; what does neither has no words beside it. A piece that has a shape by
    itself is in no run.
    """
    whole = lambda x: _shaped("card", x["value"]) | _shaped("phone", x["value"])
    before = lambda i: F.coalesce(whole(F.get("piece", i - 1)), F.lit(True))
    linked = F.transform("piece", lambda x, i: (i > 0) & x["before"].rlike(r"^\x20+$") & ~whole(x) & ~before(i))
    next_is = lambda i: F.coalesce(F.get("_linked", i + 1), F.lit(False))
    begins, ends = (lambda x, i: ~x & next_is(i)), (lambda x, i: x & ~next_is(i))
    df = df.select("*", linked.alias("_linked"))
    numbers = lambda test: F.filter(F.transform("_linked", lambda x, i: F.when(test(x, i), i)), lambda i: i.isNotNull())
    tied = lambda first, n: F.forall(F.slice(_held("_linked"), first + 2, n - 1), lambda x: x)
    counts = F.array(*map(F.lit, range(2, PIECES + 1)))
    ahead = F.transform(numbers(begins), lambda i: F.transform(counts, lambda n: F.struct(i.alias("first"), n.alias("n"))))
    back = F.transform(numbers(ends), lambda i: F.transform(counts, lambda n: F.struct((i - n + 1).alias("first"), n.alias("n"))))
    places = F.array_distinct(F.concat(F.flatten(ahead), F.flatten(back)))
    df = df.select("*", F.filter(places, lambda p: (p["first"] >= 0) & (p["first"] + p["n"] <= F.size("_linked")) & tied(p["first"], p["n"])).alias("_places"))

    def hit(p):
        parts = F.slice(_held("piece"), p["first"] + 1, p["n"])
        head = F.element_at(parts, 1)
        value = F.aggregate(F.slice(parts, 2, p["n"] - 1), head["value"], lambda a, x: F.concat(a, x["before"], x["value"]))
        value = F.regexp_replace(value, "[().-]+$", "")
        lone = value.startswith("(") & ~value.contains(")")
        start = head["start"] + lone.cast("int")
        value = F.when(lone, F.substr(value, F.lit(2))).otherwise(value)
        return F.struct(start.alias("start"), (start + F.length(value)).alias("end"), value.alias("value"), head["before"].alias("before"), F.element_at(parts, -1)["after"].alias("after"))

    df = df.select("*", F.transform("_places", hit).alias("runs"))
    return df.withColumn("runs", F.filter("runs", lambda h: _shaped("card", h["value"]) | _shaped("phone", h["value"]))).drop("_linked", "_places", "piece")


def _held(name: str) -> Column:
    """The column, named twice: the optimizer inlines what is named once, and would make it anew for each element."""
    return F.when(F.size(name) >= 0, F.col(name))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, row, base, tokens, runs: a row for each document, with its seeds by kind, the tokens beside them and what takes several tokens."""
    text = F.coalesce("text", F.lit(""))
    df = docs.select("doc_id", text.alias("text"), F.monotonically_increasing_id().alias("row"))
    for kind, pattern in {**BASE, "token": TOKEN, "piece": PIECE, "spelled": SPELLED}.items():
        there = F.instr("text", NEEDS[kind]) > 0 if NEEDS.get(kind) else F.lit(True)
        df = df.select(
            "*",
            F.when(there, F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>")).alias(f"{kind}_found"),
        )
        gaps = F.when(F.size(f"{kind}_found") > 0, F.split("text", pattern, -1)).otherwise(F.array().cast("array<string>"))
        df = df.select("*", gaps.alias(f"{kind}_gaps"))
        df = df.select("*", _zipped(F.col(f"{kind}_gaps"), F.col(f"{kind}_found")).alias(f"{kind}_all")).drop(f"{kind}_gaps", f"{kind}_found")
    hits = {k: _hits(F.col(f"{k}_all")) for k in (*KINDS, "token", "piece", "spelled")}
    kept = {k: F.filter(hits[k], _checker(k)) for k in KINDS}
    df = df.select("doc_id", "row", *(hits[k].alias(k) for k in ("token", "piece", "spelled")), *(kept[k].alias(k) for k in KINDS))
    named = [F.transform(F.col(k), _namer(i)) for i, k in enumerate(KINDS)]
    df = _with_runs(df.select("doc_id", "row", "token", "piece", "spelled", F.array_sort(F.concat(*named)).alias("base")))
    beside = lambda hits, taken: F.filter(hits, lambda t: ~F.exists(taken, lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"])))
    df = df.select("doc_id", "row", "base", "token", beside(F.concat("runs", "spelled"), "base").alias("runs"))
    # the tokens in a run are no values of their own
    return df.select("doc_id", "row", "base", beside(beside("token", "base"), "runs").alias("tokens"), "runs")


def _slots(h: Column) -> list[Column]:
    """The lexical patterns around a hit; null where there is no such word."""
    before, after = F.lower(h["before"]), F.lower(h["after"])
    last = F.regexp_extract(before, r"(\S{1,32})\s*$", 1)
    two = F.regexp_extract(before, r"(?:^|\s)(\S{1,32}\s+\S{1,32})\s*$", 1)
    first = F.regexp_extract(after, r"^\s*(\S{1,32})", 1)
    named = (("before", last), ("two before", two), ("after", first))
    return [F.when(F.length(w) > 0, F.concat(F.lit(f"{n}: "), F.regexp_replace(w, r"\s+", " "))) for n, w in named]


def _edges(scanned: DataFrame) -> DataFrame:
    """The graph: instance (row, start, end, value), its seed kind or null, and one pattern."""
    seeds = scanned.select("row", F.explode("base").alias("h")).select("row", F.col("h.kind").alias("seed"), "h")
    several = scanned.select("row", F.lit(None).cast("int").alias("seed"), F.explode("runs").alias("h"))
    tokens = scanned.select("row", F.explode("tokens").alias("h")).select("row", F.lit(None).cast("int").alias("seed"), "h")
    core = F.regexp_extract("h.value", r"""^["'(<\[{]*+(.*?)["',;:.!?)>\]}]*$""", 1)
    lead = F.instr(F.col("h.value"), core) - 1
    cols = ["row", "seed", (F.col("h.start") + lead).alias("start"), (F.col("h.start") + lead + F.length(core)).alias("end"), core.alias("value"), "slots"]
    seeds, several = (x.select("row", "seed", F.col("h.start").alias("start"), F.col("h.end").alias("end"), F.col("h.value").alias("value"), F.array_compact(F.array(*_slots(F.col("h")))).alias("slots")) for x in (seeds, several))
    tokens = tokens.withColumn("slots", F.array_compact(F.array(*_slots(F.col("h"))))).select(*cols)
    return seeds.unionByName(several).unionByName(tokens).select("row", "seed", "start", "end", "value", F.explode("slots").alias("pattern"))


def discover(scanned: DataFrame, turns: int = 3, support: int = 5, confidence: float = 0.9) -> DataFrame:
    """row, start, end, kind, score of the instances that the patterns add.

    support: distinct seeds or instances found before that a pattern needs; confidence: what patterns and added instances need.
    """
    graph = durable(_edges(scanned).groupBy("pattern", "value").agg(F.max("seed").alias("seed")), "pii-graph")
    shaped = reduce(lambda a, b: a.when(b[0], b[1]), [(F.col("value").rlike(SHAPES[k]), F.lit(i)) for i, k in enumerate(KINDS)][1:], F.when(F.col("value").rlike(SHAPES["email"]), F.lit(0)))
    graph = graph.withColumn("shape", F.coalesce("seed", shaped))
    scores = None
    for _ in range(turns):
        slots = graph.where("seed IS NOT NULL OR shape IS NOT NULL")
        if scores is not None:
            slots = slots.join(scores, ["value"], "left")
            known = F.when(F.col("seed").isNotNull(), 1.0).when(F.col("shape") == F.col("score_kind"), F.col("score"))
        else:
            known = F.when(F.col("seed").isNotNull(), 1.0)
        # a value of the shape that nothing is known of yet says neither yes nor no
        count = lambda test: F.sum(test.cast("long"))
        by = slots.groupBy("pattern", F.col("shape").alias("kind")).agg(F.sum(known).alias("good"), count(known.isNull()).alias("unknown"), count(F.coalesce(known, F.lit(0)) >= confidence).alias("held"))
        filled = graph.groupBy("pattern").agg(F.count("*").alias("instances"))
        accepted = by.where(F.col("held") >= support).join(filled, "pattern")
        accepted = accepted.select("pattern", "kind", (F.col("good") / (F.col("instances") - F.col("unknown"))).alias("confidence"))
        accepted = accepted.where(F.col("confidence") >= confidence)
        found = graph.where("seed IS NULL").join(accepted, "pattern").where("shape = kind")
        wrong = F.exp(F.sum(F.log(F.greatest(F.lit(1e-9), 1 - F.col("confidence")))))
        scores = durable(found.groupBy("value", F.col("kind").alias("score_kind")).agg((1 - wrong).alias("score")), "pii-scores")
    added = scores.where(F.col("score") >= confidence).select("value", F.col("score_kind").alias("kind"), "score")
    instances = _edges(scanned).where("seed IS NULL").select("row", "start", "end", "value").distinct()
    return instances.join(added, "value").select("row", "start", "end", "kind", "score")


def _apart(found: Column) -> Column:
    """Of instances (score, length, start, kind, end) that overlap, the one of the higher score, then the longer one."""
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")

    def step(acc, x):
        taken = F.exists(acc, lambda a: (a["start"] < x["end"]) & (x["start"] < a["end"]))
        return F.when(taken, acc).otherwise(F.array_append(acc, F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"))))

    return F.aggregate(F.reverse(F.array_sort(found)), none, step)


def _joined(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def find(docs: DataFrame, turns: int = 3, support: int = 5, confidence: float = 0.9) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added for each row of `docs` (doc_id, text, ...).

    The counts and the digest are of the seeds; spans and n_added cover what the patterns add, too.
    """
    scanned = durable(scan(docs), "pii-scan")
    span = F.struct("score", (F.col("end") - F.col("start")).alias("length"), "start", "kind", "end")
    added = discover(scanned, turns, support, confidence).groupBy("row").agg(F.collect_list(span).alias("added")).select("row", _apart(F.col("added")).alias("added"))
    df = scanned.select("doc_id", "row", F.transform("base", lambda h: F.struct(h["start"].alias("start"), h["kind"].alias("kind"), h["end"].alias("end"))).alias("base"))
    df = df.join(added, "row", "left").withColumn("added", F.coalesce("added", F.array().cast("array<struct<start:int,kind:int,end:int>>")))
    counts = [F.size(F.filter("base", _of_kind(i))).cast("long").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return df.select(
        "doc_id", *counts, F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
        _joined(F.array_sort(F.concat("base", "added"))).alias("spans"), F.size("added").cast("long").alias("n_added"),
    )
