import hashlib
import random
import re

from pyspark.sql import functions as F

from lodestone.llm.spotsigs import ANCHORS, CHAIN, edited_likeness, likeness, near_duplicates, signatures

SCHEMA = "doc_id long, text string, s string, copy string"


def brute_set(text):
    common = set(ANCHORS.split())
    words = [w for w in re.split(r"[^\w]+|_", text.lower()) if w]
    out = set()
    for i, w in enumerate(words):
        if w in common:
            rest = [x for x in words[i + 1 :] if x not in common][:CHAIN]
            if len(rest) == CHAIN:
                out.add((w, *rest))
    return out or set(words) or {text}


def jaccard(a, b):
    return len(a & b) / len(a | b)


def texts(n, seed=1):
    r = random.Random(seed)
    words = [*ANCHORS.split()[:20], *(f"wört{i}" for i in range(40))]
    return [" ".join(r.choice(words) for _ in range(r.randrange(0, 60))) for _ in range(n)]


def test_edited_likeness(spark):
    body = [*texts(60), None, "", "!!!", "the", "word", "é😀" * 9, "the cat. " * 2000]
    ids = [i * 7 % 1009 for i in range(len(body))]
    rows = [(i, t, "x", "y") for i, t in zip(ids, body, strict=True)]
    docs = spark.createDataFrame(rows, SCHEMA)
    text = {i: t or "" for i, t, *_ in rows}
    order = sorted(text, reverse=True)
    got = {r.doc_id: r for r in edited_likeness(docs).collect()}
    assert len(got) == len(rows)
    prints = {}
    for k, i in enumerate(order):
        t, nxt = text[i], text[order[(k + 1) % len(order)]]
        half = len(t) // 2
        edited = t[: len(t) - half] + nxt[:half]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert abs(r.near_edited - jaccard(brute_set(t), brute_set(edited))) < 1e-12
        assert abs(r.near_next - jaccard(brute_set(t), brute_set(nxt))) < 1e-12
        prints.setdefault(t, set()).add(r.fingerprint)
        prints.setdefault(edited, set()).add(r.edited_fingerprint)
    assert all(len(p) == 1 for p in prints.values())


def test_ranges_agree(spark):
    from lodestone.llm.spotsigs import with_next

    rows = [(i, str(i)) for i in random.Random(2).sample(range(10_000), 500)]
    docs = spark.createDataFrame(rows, "k long, t string")
    order = sorted((k for k, _ in rows), reverse=True)
    want = {k: str(order[(n + 1) % len(order)]) for n, k in enumerate(order)}
    for size in (7, 100, 1000):
        assert {r.k: r.next_t for r in with_next(docs, "k", ["t"], size).collect()} == want


def test_ties_nulls_empty(spark):
    assert edited_likeness(spark.createDataFrame([], SCHEMA)).count() == 0
    one = edited_likeness(spark.createDataFrame([(4, "the a b c d", "", "")], SCHEMA)).collect()
    assert one[0].near_next == 1.0
    rows = [(1, "a b", "", "")] * 3 + [(None, "x", "", ""), (None, None, "", "")]
    assert edited_likeness(spark.createDataFrame(rows, SCHEMA)).count() == 5
    assert edited_likeness(spark.createDataFrame(rows[3:], SCHEMA)).count() == 2


def test_near_duplicates_equal_brute_force(spark):
    r = random.Random(9)
    base = texts(25, 4)
    body = []
    for t in base:
        body += [t, t]
        w = t.split()
        for n in (1, 2, 4):
            x = list(w)
            for _ in range(n):
                if x:
                    x[r.randrange(len(x))] = f"neu{r.randrange(99)}"
            body.append(" ".join(x))
    rows = [(i, t, "", "") for i, t in enumerate(body)]
    members, links = near_duplicates(spark.createDataFrame(rows, SCHEMA), 0.6)
    sets = [brute_set(t) for t in body]
    first = {i: min(j for j, s in enumerate(sets) if s == sets[i]) for i in range(len(body))}
    assert {m.doc_id: m.class_id for m in members.collect()} == first
    heads = sorted(set(first.values()))
    want = {(a, b) for a in heads for b in heads if a < b and jaccard(sets[a], sets[b]) >= 0.6}
    got = [(x.a, x.b) for x in links.collect()]
    assert len(got) == len(set(got)) and set(got) == want and want


def test_likeness(spark):
    row = spark.range(1).select(likeness(F.expr("array(1L, 2L)"), F.expr("array(2L, 3L)")).alias("x"), signatures(F.lit("")).alias("s")).first()
    assert abs(row.x - 1 / 3) < 1e-12 and len(row.s) == 1
