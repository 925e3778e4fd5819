import math
import random

from lodestone.llm.topk import search

SCHEMA = "vec_id long, embedding array<float>, score string"


def f32(x):
    import numpy as np

    return float(np.float32(x))


LONG = (1 << 63) - 1


def brute(rows, queries, k=10, f32=f32):
    ok = lambda v: v is not None and all(x is not None and math.isfinite(x) for x in v)
    ints = lambda v: [math.floor(1024 * f32(x)) for x in v]
    rows = [(i, ints(v)) for i, v, _ in rows if i is not None and ok(v)]
    out = []
    for i, q in [(i, ints(v)) for i, v, _ in queries if i is not None and ok(v)]:
        scores = sorted((-sum(a * b for a, b in zip(q, v, strict=False)), j) for j, v in rows if j != i)[:k]
        out += [(i, r, j, max(-LONG - 1, min(LONG, -s))) for r, (s, j) in enumerate(scores, 1)]
    return sorted(out)


def test_search(spark):
    r = random.Random(5)
    rows = [(i, [r.gauss(0, 1 / (1 + d)) for d in range(40)], "x") for i in range(600)]
    rows += [(600 + i, rows[i][1], "x") for i in range(100)]  # ties
    rows += [(900, None, ""), (901, [1.0, None], ""), (902, [math.nan] * 40, ""), (903, [math.inf] * 40, ""), (None, [1.0] * 40, ""), (904, [], ""), (905, [0.0] * 40, ""), (906, [3.0], "")]
    df = spark.createDataFrame(rows, SCHEMA)
    q = df.where("vec_id % 50 = 0")
    got = sorted(tuple(x) for x in search(df.repartition(5), q, query_rows=4).collect())
    assert got == brute(rows, [x for x in rows if x[0] is not None and x[0] % 50 == 0])


def test_few_and_empty(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0], ""), (100, [1.0, 2.0], ""), (3, [-0.5, 0.1], "")], SCHEMA)
    got = sorted(tuple(x) for x in search(df, df.where("vec_id % 100 = 0")).collect())
    assert got == brute(df.collect(), df.where("vec_id % 100 = 0").collect())
    assert search(df.where("false"), df).count() == 0
    assert search(df, df.where("false")).count() == 0


def test_large_components(spark):
    """Scores beyond 2^53, and beyond longs, are ranked as whole numbers."""
    r = random.Random(6)
    for size, kind in ((1e6, "float"), (1e3, "float"), (1e30, "double"), (1e200, "double")):
        rows = [(i, [r.gauss(0, size) for _ in range(20)], "x") for i in range(300)]
        rows += [(300 + i, rows[i][1], "x") for i in range(50)] + [(400 + i, [size + i, *[size] * 19], "x") for i in range(60)]
        df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, score string")
        got = sorted(tuple(x) for x in search(df.repartition(3), df.where("vec_id % 20 = 0"), query_rows=7).collect())
        assert got == brute(rows, [x for x in rows if x[0] % 20 == 0], f32=f32 if kind == "float" else float)


def test_seeded_bound_drops_nothing():
    import numpy as np

    from lodestone.llm.topk import Blocks, best

    g = np.random.default_rng(3)
    x = np.floor(1024 * g.normal(size=(24, 9000)))
    q = x[:, :40]
    at, found, score = best(Blocks(np.arange(9000), x), np.arange(40), q, 10)
    for i in range(40):
        s = q[:, i] @ x
        want = [j for j in np.lexsort((np.arange(9000), -s)) if j != i][:10]
        assert found[at == i].tolist() == want and [s[j] for j in want] == [v for a, v in zip(at, score, strict=True) if a == i]
