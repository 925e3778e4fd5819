import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.llm.near_dups import FINER, Text, banded, classes, distance, drop_copies, near, occurrences, sketches

SCHEMA = "doc_id long, text string, class_id string, node string, key string"


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1]


@settings(max_examples=400, deadline=None)
@given(st.text("abc", max_size=14), st.text("abc", max_size=14), st.integers(0, 14))
def test_distance(a, b, most):
    d = levenshtein(a, b)
    assert distance(a, b, most) == (d if d <= most else None)
    if a and b and most:
        assert banded(a, b, most) == (d if d <= most else None)


def test_occurrences():
    assert occurrences(np.array([5, 3, 5, 5, 3], np.uint64)).tolist() == [0, 0, 1, 2, 1]


def words(r, n):
    return [f"w{r.randrange(4000)}" for _ in range(n)]


def edit(r, w, n):
    w = list(w)
    for _ in range(n):
        i = r.randrange(len(w))
        kind = r.randrange(3)
        if kind == 0:
            w[i] = f"x{r.randrange(999)}"
        elif kind == 1:
            del w[i]
        else:
            w.insert(i, f"y{r.randrange(999)}")
    return w


def corpus(seed=2):
    r = random.Random(seed)
    texts = []
    for n in [*[6, 9, 12, 20, 40] * 4, *[80, 150, 300] * 8, 4000]:
        base = words(r, n)
        texts.append(" ".join(base))
        for k in range(r.randrange(4)):
            texts.append(" ".join(edit(r, base, max(1, n // 60 * (k + 1)))))
        texts.append(" ".join([*base, *words(r, n // 6)]))
    shared = words(r, 60)
    texts += [" ".join([*words(r, 60), *shared]) for _ in range(30)]
    texts += [None, "", "!!!", "One two.", "one, TWO", "one two three", "the " * 40, "the " * 60]
    texts += texts[:20]
    return texts


def brute(texts):
    t = [Text(x or "") for x in texts]
    label = list(range(len(t)))
    for i in range(len(t)):
        for j in range(i):
            if label[i] != label[j] and ((texts[i] or "") == (texts[j] or "") or near(t[i], t[j])):
                lo, hi = sorted((label[i], label[j]))
                label = [lo if x == hi else x for x in label]
    return label


def test_equals_brute_force(spark):
    texts = corpus()
    docs = spark.createDataFrame([(i, t, "a", "b", "c") for i, t in enumerate(texts)], SCHEMA)
    want = brute(texts)
    got = {r.doc_id: r.class_id for r in classes(docs.repartition(6)).collect()}
    assert len(set(want)) < len(want) - 40
    assert [got[i] for i in range(len(texts))] == want
    kept = drop_copies(docs).collect()
    assert sorted(r.doc_id for r in kept) == sorted(set(want))


def test_shuffles_instead_of_broadcasts_agree(spark, monkeypatch):
    from lodestone.llm import near_dups

    monkeypatch.setattr(near_dups, "BROADCAST_ROWS", 0)
    texts = corpus(5)[:90]
    rows = [(i, t, "a", "b", "c") for i, t in enumerate(texts)]
    got = {r.doc_id: r.class_id for r in classes(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts)


def test_large_group_needs_no_pairs_within(spark):
    r = random.Random(4)
    base = words(r, 120)
    docs = spark.createDataFrame([(i, " ".join(edit(r, base, 1)), "", "", "") for i in range(300)], SCHEMA)
    assert {x.class_id for x in classes(docs).collect()} == {0}


def test_chain_is_one_class(spark):
    r = random.Random(8)
    w = words(r, 200)
    texts = []
    for _ in range(12):
        texts.append(" ".join(w))
        w = edit(r, w, 3)
    docs = spark.createDataFrame([(i, t, "", "", "") for i, t in enumerate(texts)], SCHEMA)
    assert [x.class_id for x in sorted(classes(docs).collect())] == brute(texts)


def test_nulls_ties_empty(spark):
    assert classes(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(1, "a b", "", "", "")] * 2 + [(None, "a b", "", "", ""), (None, "c d", "", "", ""), (None, None, "", "", ""), (4, "a b", "", "", "")]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = sorted(map(tuple, classes(docs).collect()), key=str)
    assert got == sorted([(1, 1), (1, 1), (None, 1), (None, None), (None, None), (4, 1)], key=str)
    kept = [(r.doc_id, r.text) for r in drop_copies(docs).collect()]
    assert sorted(kept, key=str) == sorted([(1, "a b"), (None, "c d"), (None, None)], key=str)


def test_one_row_of_each_class(spark):
    """Repeated rows, an id of two texts, null ids: one row of each class stays, whatever the partitions."""
    r = random.Random(3)
    base, other = words(r, 100), words(r, 100)
    near_, far = " ".join(edit(r, base, 2)), " ".join(other)
    rows = [(7, " ".join(base), "x", "", ""), (7, " ".join(base), "w", "", ""), (7, far, "x", "", ""), (9, near_, "x", "", ""), (None, near_, "x", "", ""), (None, " ".join(other[:60]), "x", "", ""), (None, " ".join(other[:60]), "x", "", "")]
    docs = spark.createDataFrame(rows, SCHEMA)
    first = [tuple(x) for x in drop_copies(docs).collect()]
    assert len(first) == 2 and {x[0] for x in first} == {7, None}
    assert sorted(first, key=str) == sorted([tuple(x) for x in drop_copies(docs.repartition(5)).collect()], key=str)


def test_near_copies_of_many_edits(spark):
    """Copies with 1 to 10 % of their words changed are found, nine of ten at least at each rate; other texts stay alone."""
    r = random.Random(21)
    texts, rates = [], []
    for n in (300, 1000):
        for rate in (1, 2, 3, 5, 7, 10):
            for _ in range(12):
                base = words(r, n)
                copy = list(base)
                for i in r.sample(range(n), n * rate // 100):
                    copy[i] = f"x{r.randrange(99_999)}"
                texts += [" ".join(base), " ".join(copy)]
                rates.append((n, rate))
    docs = spark.createDataFrame([(i, t, "", "", "") for i, t in enumerate(texts)], SCHEMA)
    got = {x.doc_id: x.class_id for x in classes(docs).collect()}
    caught = {}
    for k, key in enumerate(rates):
        assert got[2 * k] == 2 * k and got[2 * k + 1] in (2 * k, 2 * k + 1)
        caught.setdefault(key, []).append(got[2 * k + 1] == 2 * k)
    for key, hits in caught.items():
        assert sum(hits) >= (10 if key[1] == 10 else 11), (key, hits)


def test_a_bucket_is_compared_in_blocks(spark, monkeypatch):
    """Pairs across the blocks of a bucket are those of the whole bucket, each once."""
    from lodestone.llm import near_dups

    g = np.random.default_rng(5)
    rows = [(1, i, i % 40) for i in range(120)] + [(2, i, i % 3) for i in range(6)]
    grams = {i: sorted({int(x) for x in g.integers(0, 40, 30)} | set(range(100, 110))) for i in range(120)}
    texts = spark.createDataFrame(list(grams.items()), "node long, grams array<int>")
    open_ = spark.createDataFrame(rows, "key long, node long, label long")
    alike = lambda p, q: len(set(grams[p]) & set(grams[q])) >= 1 / 3 * (len(grams[p]) + len(grams[q])) - 1
    want = {(a, b) for k in (1, 2) for _, a, x in [r for r in rows if r[0] == k] for _, b, y in [r for r in rows if r[0] == k] if a < b and x != y and alike(a, b)}
    for block in (512, 16):
        monkeypatch.setattr(near_dups, "BLOCK", block)
        got = [tuple(x) for x in near_dups._across(open_, texts).collect()]
        assert len(got) == len(set(got)) and set(got) == want and want


@pytest.mark.parametrize("n", [5, 8, 30, 60, 400])
def test_sketches_meet_at_the_least_likeness(n):
    r = random.Random(n)
    met = tried = 0
    for _ in range(60):
        w = words(r, n + 4)
        a, b = " ".join(w), " ".join(edit(r, w, max(1, n // 50)))
        if near(Text(a), Text(b)):
            tried += 1
            met += bool(set(sketches(a)) & set(sketches(b)))
    assert met == tried


def test_dense_group(spark):
    """Copies of one original with few to many edits: most pairs are just not alike enough."""
    r = random.Random(14)
    base = words(r, 150)
    texts = [" ".join(edit(r, base, r.randrange(1, 12))) for _ in range(150)]
    docs = spark.createDataFrame([(i, t, "", "", "") for i, t in enumerate(texts)], SCHEMA)
    assert [x.class_id for x in sorted(classes(docs).collect())] == brute(texts)


@pytest.mark.parametrize(("long", "short"), [(65, 52), (80, 64)])
def test_finer_sketches_meet_at_the_least_likeness(long, short):
    r = random.Random(long)
    missed = 0
    for _ in range(600):
        w = words(r, long + 4)
        missed += not set(sketches(" ".join(w), FINER)) & set(sketches(" ".join(w[: short + 4]), FINER))
    assert missed == 0


def test_no_pair_that_shares_a_sketch_is_left_out(spark):
    """Pairs that meet in the buckets of a common passage only, whose central text is like neither, are decided too."""
    r = random.Random(6)
    passage, texts = words(r, 80), []
    for _ in range(60):
        texts.append(" ".join([*passage, *words(r, 120)]))
    for _ in range(40):
        own = words(r, 120)
        other = [f"x{r.randrange(99_999)}" if i % 6 == 3 else w for i, w in enumerate(own)]
        texts += [" ".join([*passage, *own]), " ".join([*passage, *other])]
    docs = spark.createDataFrame([(i, t, "", "", "") for i, t in enumerate(texts)], SCHEMA)
    got = {x.doc_id: x.class_id for x in classes(docs.repartition(3)).collect()}
    keys, t = [set(sketches(x)) for x in texts], [Text(x) for x in texts]
    want = [(i, j) for j in range(len(texts)) for i in range(j) if keys[i] & keys[j] and near(t[i], t[j])]
    assert len(want) > 15
    assert [p for p in want if got[p[0]] != got[p[1]]] == []
    assert len(set(got.values())) >= 100


def test_counts_in_common(monkeypatch):
    from lodestone.llm import near_dups

    monkeypatch.setattr(near_dups, "COLUMNS", 7)
    g = np.random.default_rng(3)
    sets = [np.unique(g.integers(0, 60, n)) for n in (1, 30, 40, 8, 25)]
    got = near_dups._in_common(sets)
    assert all(got[i, j] == len(set(sets[i]) & set(sets[j])) for i in range(5) for j in range(5) if i != j)
