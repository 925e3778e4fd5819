import hashlib
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

import lodestone.llm.suffix as m

SCHEMA = "doc_id long, text string, doc string, spans string, kept string"


def brute(rows, width=100):
    """rows: (id, text); a set of windows seen, in order."""
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, hashlib.md5((rows[i][1] or "").encode()).hexdigest()))
    seen, out = set(), []
    for i in order:
        raw = (rows[i][1] or "").encode()
        gone = bytearray(len(raw))
        for s in range(len(raw) - width + 1):
            w = raw[s : s + width]
            if w in seen:
                gone[s : s + width] = b"\1" * width
            seen.add(w)
        spans = sum(gone[k] and not (k and gone[k - 1]) for k in range(len(raw)))
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        out.append((rows[i][0], len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab", min_size=8, max_size=40), min_size=1, max_size=9))
def test_repeated_windows(texts):
    pieces = [t.encode() for t in texts]
    place = np.cumsum([0] + [len(p) + 5 for p in pieces[:-1]])
    got = {(p, i) for p, a, b in m.repeated(pieces, place, 8) for i in range(a, b + 1)}
    seen, want = set(), set()
    for p, t in enumerate(pieces):
        for i in range(len(t) - 7):
            (want.add((p, i)) if t[i : i + 8] in seen else seen.add(t[i : i + 8]))
    assert got == want


def corpus(seed=1):
    r = random.Random(seed)
    say = lambda n: " ".join(r.choice(["alpha", "béta", "gamma", "delta", "x", "日本"]) + str(r.randrange(300)) for _ in range(n))
    shared = [say(n) for n in (15, 30, 80)]
    line = say(10)
    texts = []
    for _ in range(60):
        parts = [say(r.randrange(30))]
        for _ in range(r.randrange(3)):
            parts += [r.choice([*shared, line]), say(r.randrange(20))]
        texts.append(" ".join(parts))
    texts += texts[:5]
    texts += [None, "", "x" * 99, "x" * 100, "x" * 101, "ab" * 3000, "ab" * 200 + "c", say(3), (say(12) + " ") * 6, texts[3][1:]]
    return texts


def test_equals_brute_force(spark):
    rows = list(enumerate(corpus()))
    docs = spark.createDataFrame([(i * 2, t, "", "", "") for i, t in rows], SCHEMA).repartition(5)
    want = brute([(i * 2, t) for i, t in rows])
    assert sum(w[2] for w in want) > 5000
    assert sorted(map(tuple, m.digests(docs).collect()), key=str) == want


def test_hot_keys_and_joined_anchors(spark, monkeypatch):
    monkeypatch.setattr(m, "HOT", 700)
    monkeypatch.setattr(m, "BUCKET", 3000)
    monkeypatch.setattr(m, "LISTED", 0)
    monkeypatch.setattr(m, "LONGEST", 300)
    rows = list(enumerate(corpus(7)))
    r = random.Random(2)
    hot = "the same words in all of them, " * 2
    rows += [(1000 + i, f"{r.random()}{r.random()}{hot}{r.randrange(4)}{r.random()} tail {r.randrange(3)} and so on and on and on") for i in range(60)]
    docs = spark.createDataFrame([(i, t, "", "", "") for i, t in rows], SCHEMA)
    assert sorted(map(tuple, m.digests(docs).collect()), key=str) == brute(rows)


def test_ties_nulls_empty(spark):
    assert m.digests(spark.createDataFrame([], SCHEMA)).count() == 0
    long = "".join(chr(97 + i * i % 23) for i in range(300))
    rows = [(1, long), (1, long), (1, long + "!"), (None, long), (None, None), (0, "a"), (2, long[:150])]
    docs = spark.createDataFrame([(i, t, "", "", "") for i, t in rows], SCHEMA)
    assert sorted(map(tuple, m.digests(docs).collect()), key=str) == brute(rows)


def test_repeats_within_one_piece(spark):
    """A text that repeats itself, and nothing else, has no second piece under its anchors."""
    r = random.Random(3)
    line = "".join(r.choice("abcdefgh ") for _ in range(45))
    texts = [line * 4, "q" * 250, ("xy" * 7 + "z") * 20, "".join(r.choice("klmn") for _ in range(400))]
    docs = spark.createDataFrame([(i, t, "", "", "") for i, t in enumerate(texts)], SCHEMA)
    want = brute(list(enumerate(texts)))
    assert [w[2] > 0 for w in want] == [True, True, True, False]
    assert sorted(map(tuple, m.digests(docs).collect()), key=str) == want


def test_more_anchors_than_a_list_holds(spark, monkeypatch):
    """Beyond four million repeated anchors workers still look them up in a table, and no document is joined to its anchors."""
    assert m.LISTED >= 100 << 20  # 6 GB of documents have about 25 million, 30 GB 125 million
    plans, candidates = [], m.candidate_pieces

    def seen(docs, width):
        out = candidates(docs, width)
        plans.append(out._jdf.queryExecution().toString())
        return out

    monkeypatch.setattr(m, "candidate_pieces", seen)
    rows = list(enumerate(corpus(5)))
    docs = spark.createDataFrame([(i, t, "", "", "") for i, t in rows], SCHEMA)
    # A table in several parts; one so full that almost every anchor passes.
    for marks, part in ((1 << 30, 1 << 10), (1 << 10, 1 << 10)):
        monkeypatch.setattr(m, "MARKS", marks)
        monkeypatch.setattr(m, "PART", part)
        assert sorted(map(tuple, m.digests(docs).collect()), key=str) == brute(rows)
    assert len(plans) == 2 and not any("Join" in p for p in plans)


def test_marked_keys_are_found(spark, monkeypatch):
    monkeypatch.setattr(m, "PART", 1 << 14)
    keys = np.random.default_rng(1).integers(-(1 << 63), 1 << 63, 30_000)
    places = spark.createDataFrame([(int(k),) for k in keys[:10_000]], "key long").repartition(3)
    folder, bits, size = m._mark(places, 10_000)
    found = m._probably(keys, folder, bits, size)
    assert (bits, size) == (1 << 18, 1 << 14) and found[:10_000].all() and found[10_000:].mean() < 0.02
