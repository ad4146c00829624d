import hashlib
import random
import re
from collections import Counter

import regex

from tickstrata.llm import pii, queries

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def brute(text):
    out, n = [], []
    for order, (kind, pattern) in enumerate(PLAIN.items()):
        k = 0
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else 0, "card": 12 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if good:
                out.append((m.start(), order, f"{kind}:{m.start()}:{m.end()}"))
                k += 1
        n.append(k)
    return n, ",".join(x[2] for x in sorted(out))


def check(spark, texts, **kw):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, row string")
    rows = {r["doc_id"]: r for r in pii.find(docs, **kw).collect()}
    assert len(rows) == len(texts)
    for i, t in enumerate(texts):
        n, spans = brute(t)
        r = rows[i]
        assert [r[f"n_{k}"] for k in pii.KINDS] == n, (t, r)
        assert r["base_sha256"] == hashlib.sha256(spans.encode()).hexdigest(), (t, r, spans)
        assert set(filter(None, spans.split(","))) <= set(r["spans"].split(","))
    return rows


def test_seeds_match_the_plain_patterns(spark):
    rng = random.Random(3)
    parts = ["a@b.c", "x_y", "@", ".", "+", "1", "22", " ", "-", "4111 1111 1111 1111", "4111111111111111", "10.0.0.1", "300.1.1.1", "+1 (668) 555-1911", "é", "😀", "\n", "a", "%", "(", ")", "0000255.1.2.3", "_", "  "]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(600)]
    check(spark, [*texts, None, "", "a@b.c_x@d.e", "a@b.c.@d.e", "aaa@bbb@ccc.dd", "1.2.3.4.5.6.7.8", "1.2.3.45.6.7.8"])


def test_very_long_runs_are_linear_and_do_not_overflow(spark):
    n = 20_000
    check(spark, ["1" * n, "1 " * n, "1." * n, "a" * n, "a." * n + "@", "x@" + "a." * n + "b", "+" + "1(" * n, "a@b.c " * 2000, "@" * n])


def test_patterns_add_what_the_fixed_ones_miss(spark):
    texts = [f"some word reach me at +1 (555) 555-{1000 + i} today" for i in range(40)]
    texts += ["other text reach me at 555-123-4567 today", "no context 555-123-4567x here", "a clean document with 12 words"]
    rows = check(spark, texts)
    start = texts[40].index("555-")
    assert rows[40]["spans"] == f"phone:{start}:{start + 12}" and rows[40]["n_added"] == 1
    assert rows[42]["spans"] == "" and all(rows[i]["n_added"] == 0 for i in range(40))


def test_null_ids_repeated_rows_and_no_rows(spark):
    schema = "doc_id long, text string, base array<int>, email string"
    rows = [(None, "x@y.z", [1], "e"), (None, "x@y.z", None, None), (None, None, [], ""), (1, "10.0.0.1", None, "e"), (1, "10.0.0.1", None, "e")]
    got = sorted((repr(r.doc_id), r.spans) for r in pii.find(spark.createDataFrame(rows, schema)).collect())
    assert got == [("1", "ip:0:8")] * 2 + [("None", "")] + [("None", "email:0:5")] * 2
    assert pii.find(spark.createDataFrame([], schema)).count() == 0


def test_query(spark, sf_dir):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = queries.op1_pii(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        n, spans = brute(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(spans.encode()).hexdigest()
        assert [r[f"n_{k}"] for k in pii.KINDS] == n


def test_patterns_add_what_takes_several_tokens(spark):
    texts = [f"some word reach me at +1 (555) 555-{1000 + i} today" for i in range(80)]
    texts += [f"or you could write to user{i}@example.com please" for i in range(80)]
    new = ["(843) 555-7672", "843 555 7673", "843 555-7674", "1 843.555 7675"]
    texts += [f"other text reach me at {x} today, 3 times" for x in new] + [f'all can reach me at "{new[1]}".', f"they reach me at ({new[1]}), 12 of 20"]
    mails = ["jane at host dot org", "jane [at] mail.host (dot) org", "jane@" + "h" * 90 + "o5"]
    texts += [f"or you could write to {x} please" for x in mails]
    rows = check(spark, texts)
    for i, x in enumerate([*new, new[1], new[1], *mails], 160):
        start = texts[i].index(x)
        assert rows[i]["spans"] == f"{'email' if x in mails else 'phone'}:{start}:{start + len(x)}", (texts[i], rows[i])
    assert all(rows[i]["n_added"] == 0 for i in range(160))


def test_many_unseen_values_and_patterns_of_found_ones(spark):
    texts = [f"some word reach me at +1 (555) 555-{1000 + i} today" for i in range(40)]
    texts += [f"other text reach me at 555-123-{4000 + i} today" for i in range(60)]
    texts += [f"the sales desk: 555-123-{4000 + i} for orders" for i in range(8)] + ["the sales desk: 555-999-4567 for orders"]
    # words of other shapes beside seeds still count against a pattern
    texts += [f"item costs +1 (777) 555-{1000 + i} now" for i in range(6)] + [f"item costs eur{i}00 now" for i in range(6)] + ["item costs 555-777-4567 now"]
    rows = check(spark, texts)
    assert all(rows[i]["n_added"] == 1 for i in range(40, 109))
    assert all(rows[i]["n_added"] == 0 for i in (*range(40), *range(109, len(texts))))


def scored(edges, turns, support, confidence):
    """{(row, start, end, kind): score} of what discover() adds, by walking the graph's edges one by one."""
    pairs = {}
    for e in edges:
        known = pairs.setdefault((e.pattern, e.value), e.seed)
        pairs[e.pattern, e.value] = e.seed if known is None else known if e.seed is None else max(known, e.seed)
    kind_of = lambda v: next((k for k, name in enumerate(pii.KINDS) if regex.search(pii.SHAPES[name], v)), None)
    filled, scores = Counter(p for p, _ in pairs), {}
    for _ in range(turns):
        good, unknown, held = Counter(), Counter(), Counter()
        for (p, v), seed in pairs.items():
            kind = kind_of(v) if seed is None else seed
            if kind is None:
                continue
            score = 1.0 if seed is not None else scores[v][1] if v in scores and scores[v][0] == kind else None
            unknown[p, kind] += score is None
            good[p, kind] += score or 0.0
            held[p, kind] += score is not None and score >= confidence
        sure = {pk: good[pk] / (filled[pk[0]] - unknown[pk]) for pk in held if held[pk] >= support}
        sure = {pk: c for pk, c in sure.items() if c >= confidence}
        wrong = {}
        for (p, v), seed in pairs.items():
            if seed is None and (p, kind_of(v)) in sure:
                wrong[v] = wrong.get(v, 1.0) * max(1e-9, 1 - sure[p, kind_of(v)])
        scores = {v: (kind_of(v), 1 - w) for v, w in wrong.items()}
    return {(e.row, e.start, e.end, scores[e.value][0]): scores[e.value][1] for e in edges if e.seed is None and e.value in scores and scores[e.value][1] >= confidence}


def test_scores_match_a_walk_of_the_graph(spark):
    rng = random.Random(12)
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    forms = [lambda: f"+1 ({digits(3)}) 555-{digits(4)}", lambda: f"555-{digits(3)}-{digits(4)}", lambda: f"({digits(3)}) 555-{digits(4)}", lambda: f"u{digits(3)}@mail.example", lambda: f"jo{digits(2)} at host dot org", lambda: f"10.0.{rng.randint(0, 255)}.{rng.randint(0, 255)}", lambda: f"10.0.{rng.randint(256, 999)}.7", lambda: f"eur{digits(2)}", lambda: "4111 1111 1111 1111"]
    pure = [[k in group for k in range(len(forms))] for group in ((0, 1), (0, 2), (1, 2), (3, 4))]
    mixes = pure + [[rng.random() ** 4 for _ in forms] for _ in range(8)]
    contexts = [("call", "now"), ("reach me at", "today"), ("write to", "please"), ("host", "down"), ("costs", "now"), ("sales desk:", "for orders"), ("card", "valid"), ("", "here"), ("ring", ""), ("mail", "or"), ("node", "up"), ("fax", "then")]
    texts = []
    for _ in range(900):
        k = rng.randrange(len(contexts))
        parts = [f"{contexts[k][0]} {f()} {contexts[k][1]}" for f in rng.choices(forms, mixes[k], k=rng.choice([1, 1, 2]))]
        texts.append(" and so ".join(parts))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    scanned = pii.durable(pii.scan(docs), "test-scan")
    edges = pii._edges(scanned).collect()
    sizes = []
    for turns, support, confidence in ((1, 5, 0.9), (3, 5, 0.9), (3, 2, 0.6), (4, 1, 0.3)):
        want = scored(edges, turns, support, confidence)
        got = {(r.row, r.start, r.end, r.kind): r.score for r in pii.discover(scanned, turns, support, confidence).collect()}
        assert got.keys() == want.keys()
        assert all(abs(got[k] - want[k]) < 1e-6 for k in got)
        sizes.append(len(got))
    assert 0 < sizes[1] < sizes[2] <= sizes[3] and sizes[0] <= sizes[1], sizes
