import random

import numpy as np

from lodestone.llm.quality import FEATURES, classify, features, fit, train

DOCS, LABELS = "doc_id long, text string, score string, y string", "doc_id long, quality int, toxic int, text string"


def corpus(n, seed=1):
    r = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        good = r.random() < 0.7
        words = ["".join(r.choice("abcdefghi") for _ in range(r.randrange(2, 9))) for _ in range(r.randrange(10, 80))]
        text = " ".join(words) + "." if good else r.choice([" ".join(w.upper() + "!!" for w in words), " ".join([words[0]] * 40), "\n".join(f"{w}*** |" for w in words)])
        docs.append((i, text, "x", "y"))
        labels.append((i, int(good), 0, "z"))
    return docs, labels


def test_held_out_accuracy(spark):
    import zlib

    docs, labels = corpus(800)
    rows = [*docs, (None, "a b", "", ""), (5000, None, "", ""), (5001, "", "", ""), (3, docs[3][1], "", "")]
    got = classify(spark.createDataFrame(rows, DOCS), spark.createDataFrame([*labels, (None, 1, 0, ""), (9999, None, 0, "")], LABELS)).collect()
    assert len(got) == len(rows)
    want = dict((i, q) for i, q, *_ in labels)
    held = [r for r in got if r.held_out and r.doc_id in want]
    assert held and all((zlib.crc32(str(r.doc_id).encode()) % 5 == 0) == r.held_out for r in got if r.doc_id is not None)
    assert sum(r.predicted == want[r.doc_id] for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert len({r.score for r in got if r.doc_id in (5000, 5001)}) == 1


def test_labels_of_held_out_rows_teach_nothing(spark):
    import zlib

    docs, labels = corpus(300)
    turned = [(i, 1 - q if zlib.crc32(str(i).encode()) % 5 == 0 else q, t, x) for i, q, t, x in labels]
    d = spark.createDataFrame(docs, DOCS)
    a, b = (train(d, spark.createDataFrame(x, LABELS)) for x in (labels, turned))
    assert a.intercept == b.intercept and all((p == q).all() for p, q in zip(a.mains, b.mains, strict=True))


def test_interaction():
    r = np.random.default_rng(0)
    x = r.random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    m = fit(x, y, bins=16, pairs=1)
    assert m.pairs[0][:2] == (0, 1)
    assert ((m.score(x) > 0.5) == y).mean() > 0.95


def test_no_labels_and_empty(spark):
    d = spark.createDataFrame([(1, "a", "", "")], DOCS)
    none = spark.createDataFrame([], LABELS)
    assert classify(d, none).first().score == 0.5
    assert classify(d.where("false"), none).count() == 0
    one = classify(d, spark.createDataFrame([(1, 1, 0, "")], LABELS)).first()
    assert one.score >= 0.5
    assert features(None) == features("") == [0.0] * len(FEATURES)


def plain_score(m, x):
    """The model's tables, entry by entry."""
    import math

    place = lambda cuts, v: sum(c <= v for c in cuts)
    bins = [place(c, v) for c, v in zip(m.cuts, x, strict=True)]
    total = m.intercept + sum(t[b] for t, b in zip(m.mains, bins, strict=True)) + sum(t[bins[f], bins[g]] for f, g, t in m.pairs)
    return 1 / (1 + math.exp(-total))


def test_score_is_a_sum_of_table_entries(spark):
    docs, labels = corpus(300, seed=4)
    d = spark.createDataFrame(docs, DOCS)
    m = train(d, spark.createDataFrame(labels, LABELS))
    assert len(m.pairs) == 5 and any(t.any() for _, _, t in m.pairs)
    text = {i: t for i, t, *_ in docs}
    for r in classify(d, spark.createDataFrame(labels, LABELS)).collect():
        assert abs(r.score - plain_score(m, features(text[r.doc_id]))) < 1e-12


def test_trees_are_the_best_of_all():
    """Against a search of every cut."""
    from lodestone.llm.quality import _pair_tree, _tree

    gain = lambda g, h: g * g / (h + 1)
    r = np.random.default_rng(7)

    def cut(g, h):
        """(gain over no cut, first bin of the right side) of the best cut."""
        whole = gain(g.sum(), h.sum())
        return max(((gain(g[:k].sum(), h[:k].sum()) + gain(g[k:].sum(), h[k:].sum()) - whole, k) for k in range(1, len(g))), default=(0, 0))

    for _ in range(200):
        n = int(r.integers(1, 9))
        g, h = r.normal(size=n), r.random(n) + 0.1
        want, (more, k) = np.zeros(n), cut(g, h)
        for part in ((slice(0, k), slice(k, n)) if more > 1e-9 else (slice(0, n),)):
            more, j = cut(g[part], h[part])
            j = part.start + j if more > 1e-9 else part.stop
            for s in (slice(part.start, j), slice(j, part.stop)):
                want[s] = g[s].sum() / (h[s].sum() + 1)
        assert np.allclose(_tree(g, h), want)
        g, h = r.normal(size=(n + 1, 4)), r.random((n + 1, 4)) + 0.1
        best = 0.0
        for a, b in ((g, h), (g.T, h.T)):
            total, k = cut(a.sum(1), b.sum(1))
            best = max(best, total + sum(cut(a[s].sum(0), b[s].sum(0))[0] for s in (slice(0, k), slice(k, len(a)))))
        assert abs(_pair_tree(g, h)[1] - best) < 1e-9


def test_long_texts_and_repeated_ids(spark):
    """Texts are taken whole, and the rows that learning takes are bounded whatever ids repeat."""
    long = "word and more. " * 200_000
    assert features(long + "!!!! #### $$$$") != features(long) and all(np.isfinite(features(long)))
    docs = [(1, f"some text {i}", "", "") for i in range(400)] + [(2, long, "", "")]
    d, labels = spark.createDataFrame(docs, DOCS), spark.createDataFrame([(1, 1, 0, ""), (2, 0, 0, ""), (1, 0, 0, "")], LABELS)
    got = classify(d, labels, most=50).collect()
    assert len(got) == 401 and all(0 <= r.score <= 1 for r in got)
