import random
from collections import Counter

from pyspark.sql import functions as F

from lodestone.llm.lines import drop_boilerplate, host_of

SCHEMA = "doc_id long, text string, source string, lines string, h string"


def brute(rows, ratio, least):
    pages, on = Counter(r[2] for r in rows), Counter()
    for _, t, s, *_ in rows:
        on.update({(s, x) for x in (t or "").split("\n") if x.strip(" ")})
    out = []
    for i, t, s, *_ in rows:
        lines = [] if t is None else t.split("\n")
        kept = [x for x in lines if not x.strip(" ") or on[s, x] < least or on[s, x] <= ratio * pages[s]]
        out.append((i, None if t is None else "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=str)


def test_equals_brute_force(spark):
    r = random.Random(3)
    rows = []
    for i in range(400):
        lines = [f"line {r.randrange(60)}" for _ in range(r.randrange(5))] + ["nav"] * (r.random() < 0.4) + ["", "  "] * (r.random() < 0.2) + [f"own {i}"]
        r.shuffle(lines)
        rows.append((i, "\n".join(lines), r.choice(["a", "b", "c", None, "tiny" if i < 9 else "a"]), "x", "y"))
    rows += [(900, None, "a", "", ""), (901, "", "a", "", ""), (7, rows[7][1], rows[7][2], "", ""), (None, "nav", "a", "", ""), (902, "x\n" * 30_000 + "nav", "a", "", "")]
    df = spark.createDataFrame(rows, SCHEMA)
    for ratio, least in ((0.1, 5), (0.05, 2), (0.3, 1)):
        got = drop_boilerplate(df, ratio, least).select("doc_id", "text", "n_lines", "n_dropped").collect()
        assert sorted(map(tuple, got), key=str) == brute(rows, ratio, least)


def test_shuffled_join_and_empty(spark, monkeypatch):
    import lodestone.llm.lines as m

    rows = [(i, f"nav\nown {i}", "ab"[i % 2], "", "") for i in range(40)]
    df = spark.createDataFrame(rows, SCHEMA)
    monkeypatch.setattr(m, "BROADCAST_LINES", -1)
    assert {r.text for r in drop_boilerplate(df).collect()} == {f"own {i}" for i in range(40)}
    assert drop_boilerplate(df.where("false")).count() == 0


def test_host(spark):
    urls = [("http://User@A.example.com:80/x?y", "a.example.com"), ("https://b.net", "b.net"), ("/local", None), (None, None)]
    got = spark.createDataFrame(urls, "u string, h string").select(host_of(F.col("u")).alias("g"), "h").collect()
    assert all(r.g == r.h for r in got)
