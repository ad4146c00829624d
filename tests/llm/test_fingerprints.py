import hashlib
import random
import re
import struct

import xxhash

from tickstrata.llm import fingerprints as P
from tickstrata.llm import queries


def edited(rows):
    """doc_id to the edited text; rows are (doc_id, text) with distinct ids."""
    order = sorted(rows, key=lambda r: -r[0])
    out = {}
    for k, (d, t) in enumerate(order):
        t, after = t or "", order[(k + 1) % len(order)][1] or ""
        half = len(t) // 2
        out[d] = t[: len(t) - half] + after[:half]
    return out


def hashed(*values):
    """Spark's xxhash64 of words and longs; a null leaves the hash as it is."""
    h = 42
    for v in values:
        if v is not None:
            h = xxhash.xxh64_intdigest(v.encode() if isinstance(v, str) else struct.pack("<q", v), seed=h % (1 << 64))
            h -= (h >> 63) << 64
    return h


def plain(text):
    """{hash of 32 bits: place} of the distinct anchors."""
    units = re.findall(r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D]{1,48}(?![^\x20\x09-\x0D])|[^\x20\x09-\x0D]", text or "")
    h = [hashed(u) for u in units]
    s = [hashed(*h[i : i + 2]) for i in range(len(h))]
    found = {}
    for i in range(len(h) - P.K + 1):
        inner = s[i : i + 4]
        if min(inner[0], inner[3]) <= min(inner[1:3]):
            found.setdefault(hashed(inner[0], inner[2], h[i + 4]) >> 32 & 0xFFFFFFFF, i)
    if not found and h:
        all_of = 7
        for x in h:
            all_of = xxhash.xxh64_intdigest(struct.pack("<q", x), seed=hashed(all_of) % (1 << 64))
            all_of -= (all_of >> 63) << 64
        found = {all_of >> 32 & 0xFFFFFFFF: 0}
    return found


def likeness(a, b):
    if a == b:
        return 1.0
    met = sorted((a[h], b[h]) for h in a.keys() & b.keys())
    apart = [None, *(x - y for x, y in met), None]
    held = sum(apart[i] in (apart[i - 1], apart[i + 1]) for i in range(1, len(apart) - 1))
    return held / (len(a) + len(b) - held)


def shown(anchors):
    return " ".join(f"{h:x}.{place}" for place, h in sorted((p, h) for h, p in anchors.items()))


def check(got, rows):
    """Each column against a plain version."""
    want, order = edited(rows), sorted(rows, key=lambda r: -r[0])
    after = {d: order[(k + 1) % len(order)][1] for k, (d, _) in enumerate(order)}
    assert sorted(r.doc_id for r in got) == sorted(want)
    text = dict(rows)
    for r in got:
        own, other = plain(text[r.doc_id]), plain(want[r.doc_id])
        assert r.n_chars == len(text[r.doc_id] or "")
        assert r.edited_sha256 == hashlib.sha256(want[r.doc_id].encode()).hexdigest()
        assert (r.fingerprint, r.edited_fingerprint) == (shown(own), shown(other))
        assert abs(r.near_edited - likeness(own, other)) < 1e-12 and abs(r.near_next - likeness(own, plain(after[r.doc_id]))) < 1e-12


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefgé😀") for _ in range(rng.randint(1, 7))) for _ in range(n))


def test_edits_and_likeness(spark):
    rng = random.Random(8)
    rows = [(i * 7 - 300, words(rng, rng.choice([0, 1, 3, 5, 6, 40, 300, 900]))) for i in range(150)]
    rows += [(5000, None), (5001, "x" * 5_000), (5002, "a " * 20_000), (5003, rows[7][1]), (5004, rows[7][1]), (5005, "é" * 49 + " " + "a" * 48)]
    df = spark.createDataFrame([(d, t, 1, 2) for d, t in rows], "doc_id long, text string, own int, bucket int").repartition(5)
    got = P.compare(df).collect()
    check(got, rows)
    by = {r.doc_id: r for r in got}
    assert by[5004].near_next == 1.0  # the next one has the same text
    long = [r for r in got if r.n_chars > 1000 and r.doc_id < 5000]
    assert sum(0.15 < r.near_edited < 0.6 for r in long) > 0.9 * len(long)  # half of the anchors of either are shared: a third of all
    assert all(r.near_next < 0.1 for r in long)


def likenesses(spark, pairs):
    made = spark.createDataFrame(pairs, "k int, a string, b string")
    for x in ("a", "b"):
        made = P.fingerprint(made, x, f"{x}_print")
    return [r.s for r in P.with_likeness(made, "a_print", "b_print", "s").orderBy("k").select("s").collect()]


def test_anchors_do_not_depend_on_what_stands_around(spark):
    rng = random.Random(9)
    middle, before, after = words(rng, 200), words(rng, 37), words(rng, 50)
    own, moved = plain(middle), plain(f"{before} {middle} {after}")
    assert own and all(moved[h] == p + 37 for h, p in own.items())
    assert 0.35 < len(own) / 200 < 0.65  # two of the four inner pairs are at an edge
    run = "".join(rng.choice("的一是在不了有和人这") for _ in range(400))  # without white space
    # a passage counts at whatever place it stands; anchors that agree on no place don't
    lone = " ".join(f"{' '.join(middle.split()[k : k + 5])} {words(rng, 5)}" for k in range(0, 195, 11))
    got = likenesses(spark, [(0, middle, f"{before} {middle}"), (1, run, "大" + run), (2, middle, lone)])
    assert got[0] > 0.75 and got[1] > 0.95 and got[2] < 0.05


def test_likeness_is_near_the_jaccard_index_of_shingles(spark):
    rng = random.Random(10)
    base = words(rng, 2000).split(" ")
    pairs, want = [], []
    for k, share in enumerate((0.0, 0.02, 0.05, 0.1, 0.3)):
        other = [words(rng, 1) if rng.random() < share else w for w in base]
        a, b = ({tuple(x[i : i + 5]) for i in range(len(x) - 4)} for x in (base, other))
        pairs.append((k, " ".join(base), " ".join(other)))
        want.append(len(a & b) / len(a | b))
    assert all(abs(x - y) < 0.05 for x, y in zip(likenesses(spark, pairs), want))


def test_repeated_ids_and_small_tables(spark):
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    assert P.compare(frame([])).count() == 0
    one = P.compare(frame([(4, "one single document")])).collect()
    check(one, [(4, "one single document")])
    assert one[0].near_next == 1.0
    many = P.compare(frame([(1, "a b"), (1, "a b"), (1, "c d"), (None, "e"), (None, None), (2, "f g h")]))
    assert many.count() == 6


def test_query(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    check(queries.op5_fingerprints(spark, sf_dir).collect(), rows)
