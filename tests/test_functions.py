import random

import pytest
from pyspark.sql import functions as F

from lodestone import config as C
from lodestone.functions import text as T
from lodestone.functions.globs import glob_regex
from lodestone.functions.stem import porter
from lodestone.operators import fulltext, fusion, graph, stats
from lodestone.operators.chunking import chunks, fixed_chunks
from lodestone.operators.fulltext import normalized
from lodestone.operators.symbols import definitions, references


def one(spark, column, **values):
    kind = {str: "string", int: "int", float: "double", list: "array<double>"}
    schema = ", ".join(f"{k} {kind[type(v)]}" for k, v in values.items()) or "x int"
    return spark.createDataFrame([tuple(values.values()) or (1,)], schema).select(column).first()[0]


@pytest.mark.parametrize("text, parts", [
    ("function signInWithGoogle() {}", ["signInWithGoogle", "sign", "In", "With", "Google"]),
    ("const user_auth_token = 123", ["user_auth_token", "user", "auth", "token"]),
    ("the quick brown fox", []),
])
def test_identifiers(spark, text, parts):
    assert one(spark, T.identifiers(F.col("t")), t=text).split() == parts


@pytest.mark.parametrize("query, all_of, some", [
    ("how does the authentication flow work", ["authentication", "flow", "work"], "flow"),
    ("how does the it is", None, None), ("", None, None), ("auth login", None, "authentication"),
])
def test_query_phrases(spark, query, all_of, some):
    assert one(spark, T.query_all(F.col("q")), q=query) == all_of
    found = one(spark, T.query_any(F.col("q")), q=query)
    assert found is None if some is None else some in found


@pytest.mark.parametrize("scores, want", [([-20.0, -10.0, -1.0], [1, 10 / 19 - 1 / 19, 0]), ([-5.0], [1]), ([-5.0, -5.0, -5.0], [1, 1, 1])])
def test_normalized(spark, scores, want):
    rows = spark.createDataFrame([(0, i, s) for i, s in enumerate(scores)], "query_id int, i int, bm25 double")
    got = [r.bm25_norm for r in normalized(rows).orderBy("i").collect()]
    assert got == pytest.approx(want)


@pytest.mark.parametrize("v, f, want", [(1, 1, 2 / 61), (None, 1, 1 / 61), (1, None, 1 / 61), (None, None, 0)])
def test_rrf(spark, v, f, want):
    assert one(spark, T.rrf(F.lit(v).cast("int"), F.lit(f).cast("int"))) == pytest.approx(want)


@pytest.mark.parametrize("path, want", [("README.md", 0.5), ("docs/guide.md", 0.7), ("src/auth.test.ts", 0.85), ("package.json", 0.8), ("src/auth.ts", 1.0), ("a/.env", 0.8), ("x/test/y.ts", 0.85)])
def test_multiplier(spark, path, want):
    assert one(spark, T.file_multiplier(F.col("p")), p=path) == want


@pytest.mark.parametrize("query, text, want", [("signIn here", "call signIn()", 1.5), ("user_id", "user_id", 1.5), ("aB1 cD2 eF3 gH4", "aB1 cD2 eF3 gH4", 2.5), ("plain words", "plain words", 1.0)])
def test_boost(spark, query, text, want):
    assert one(spark, T.identifier_boost(F.col("q"), F.col("t")), q=query, t=text) == want


@pytest.mark.parametrize("word, stem", [("caresses", "caress"), ("ponies", "poni"), ("agreed", "agre"), ("plastered", "plaster"), ("motoring", "motor"), ("hopping", "hop"), ("relational", "relat"), ("hopefulness", "hope"), ("adjustment", "adjust"), ("controll", "control"), ("happy", "happi"), ("sky", "sky"), ("filing", "file"), ("été", "été"), ("as", "as")])
def test_porter(word, stem):
    assert porter(word) == stem


@pytest.mark.parametrize("glob, yes, no", [
    ("**/*.ts", ["a.ts", "a/b/c.ts"], [".x/a.ts", "a.tsx", ".ts"]), ("node_modules/**", ["node_modules/a", "node_modules/a/b"], ["a/node_modules/b"]),
    ("*.lock", ["yarn.lock"], ["a/yarn.lock"]), ("src/{a,b}/?.js", ["src/a/x.js"], ["src/c/x.js", "src/a/xy.js"]), ("[!a]*.py", ["b.py"], ["a.py"]),
])
def test_globs(glob, yes, no):
    import re

    assert all(re.search(glob_regex(glob), p) for p in yes) and not any(re.search(glob_regex(glob), p) for p in no)


def brute_fixed(text, most, overlap):
    """Chunks line by line: emit when full, begin the next with the lines that reach the overlap."""
    out, first, now = [], 1, []
    lines = text.split("\n")
    size = lambda ls: sum(len(x) + 1 for x in ls)
    for i, line in enumerate(lines, 1):
        now.append(line)
        if size(now) >= most:
            out.append((first, i, "\n".join(now)))
            k = next((k for k in range(1, len(now) + 1) if size(now[-k:]) >= overlap), len(now)) if overlap > 0 else 0
            now = now[len(now) - k :]
            first = max(1, i - k + 1)
    return [*out, (first, len(lines), "\n".join(now))] if now else out


def test_fixed_chunks(spark):
    r = random.Random(6)
    texts = ["", "x", "y" * 500, "\n" * 50] + ["\n".join("w" * r.randrange(40) for _ in range(r.randrange(1, 40))) for _ in range(40)]
    for most, overlap in ((20, 5), (8, 0), (10, 10)):
        files = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "file_path string, content string")
        got = {}
        for x in fixed_chunks(files, most, overlap).orderBy("file_path", "chunk_index").collect():
            got.setdefault(int(x.file_path), []).append((x.start_line, x.end_line, x.chunk_text))
        assert [got.get(i, []) for i in range(len(texts))] == [brute_fixed(t, most * 4, overlap * 4) for t in texts]


def test_syntax_chunks_claim_comments(spark):
    text = "import x\n\n// about f\nfunction f() {\n}\n\n/** g */\n\nclass G {\n}\nconst y = 1\n"
    files = spark.createDataFrame([("a.js", text), ("b.js", "const z = 1\n"), ("c.txt", "function f()\nclass G")], "file_path string, content string")
    rows = chunks(files, "syntax").orderBy("file_path", "chunk_index").collect()
    assert [(x.file_path, x.start_line, x.end_line) for x in rows] == [("a.js", 1, 2), ("a.js", 3, 6), ("a.js", 7, 12), ("b.js", 1, 2), ("c.txt", 1, 2)]


def test_symbols(spark):
    src = [
        ("a.ts", "export function start(x) {\n  // not(this)\n  return helper(x) + lib.other(x);\n}\nimport { one as uno, two } from './m';\nnew Widget();\n"),
        ("b.py", "class Ab:\n    def run(self):\n        pass\n"), ("c.md", "function no() {}"),
    ]
    files = spark.createDataFrame(src, "file_path string, content string")
    defs = definitions(files)
    assert sorted((d.file_path, d.name, d.kind, d.line) for d in defs.collect()) == [("a.ts", "start", "function", 1), ("b.py", "Ab", "class", 1), ("b.py", "run", "function", 2)]
    refs = {(x.file_path, x.name) for x in references(files, defs).collect()}
    assert {n for f, n in refs if f == "a.ts"} == {"helper", "other", "one", "two", "Widget"}


def test_graph_weights(spark):
    refs = spark.createDataFrame([("a", "f"), ("a", "g"), ("a", "h"), ("b", "f"), ("a", "own"), ("a", "nowhere")], "file_path string, name string")
    defs = spark.createDataFrame([("f", "b"), ("g", "b"), ("h", "b"), ("h", "c"), ("own", "a")], "name string, file_path string")
    edges = lambda *a: {(e.src, e.dst): e.weight for e in graph.file_graph(refs, defs, *a).collect()}
    assert edges() == {("a", "b"): 2.5, ("a", "c"): 0.5}
    assert edges("binary") == {("a", "b"): 1.0, ("a", "c"): 1.0}
    assert edges("sqrt")[("a", "c")] == pytest.approx(0.5**0.5)
    assert edges("raw", 1) == {("a", "b"): 2.0}


def linked_files(n, seed):
    """Rows (file, name) of references and definitions of n files: names of all files, of some, of one."""
    r = random.Random(seed)
    names = ["all", *(f"some{i}" for i in range(6)), *(f"one{i}" for i in range(n))]
    refs = [(f"f{i}", x) for i in range(n) for x in {"all", r.choice(names), r.choice(names), f"one{i}"}]
    return refs, [(x, f"f{i}") for i in range(n) for x in {r.choice(names[:7]), f"one{i}", "all"} if i % 3 or x != "all"]


def brute_graph(refs, defs):
    edges = {}
    for name in {x for x, _ in defs}:
        of = {f for x, f in defs if x == name}
        for a in {f for f, x in refs if x == name}:
            for b in of - {a}:
                edges[a, b] = edges.get((a, b), 0) + 1 / len(of)
    return edges


def graph_tables(spark, refs, defs):
    return spark.createDataFrame(refs, "file_path string, name string"), spark.createDataFrame(defs, "name string, file_path string")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("block", [1 << 18, 4])
def test_edges_are_not_shuffled(spark, monkeypatch, block):
    monkeypatch.setattr(graph, "BLOCK", block, raising=False)
    refs, defs = linked_files(30, 5)
    edges = graph.file_graph(*graph_tables(spark, refs + [(None, "all")], defs + [("none", None)]))
    assert "Exchange" not in plan(edges)
    rows = [((e.src, e.dst), e.weight) for e in edges.collect()]
    assert dict(rows) == pytest.approx(brute_graph(refs, defs)) and len(rows) == len(dict(rows)) > 300


def brute_ppr(edges, seeds, steps=20):
    nodes = {x for a, b, _ in edges for x in (a, b)} | set(seeds)
    total = sum(seeds.values())
    restart = {n: seeds.get(n, 0) / total for n in nodes}
    rank = dict(restart)
    for _ in range(steps):
        out = {n: sum(w for a, _, w in edges if a == n) for n in nodes}
        lost = sum(r for n, r in rank.items() if out[n] == 0)
        rank = {n: (0.15 + 0.85 * lost) * restart[n] + sum(0.85 * rank[a] * w / out[a] for a, b, w in edges if b == n) for n in nodes}
    return {n: r / max(rank.values()) for n, r in rank.items() if r > 0}


def test_pagerank(spark):
    edges = [("a", "b", 1.0), ("b", "c", 2.0), ("c", "a", 1.0), ("b", "d", 1.0), ("x", "y", 1.0)]
    seeds = {"a": 1.0, "z": 3.0}
    got = graph.pagerank(spark.createDataFrame(edges, "src string, dst string, weight double"), spark.createDataFrame([(7, n, s) for n, s in seeds.items()], "query_id int, node string, score double"))
    assert {r.node: r.ppr for r in got.collect()} == pytest.approx(brute_ppr(edges, seeds))
    none = spark.createDataFrame([], "query_id int, node string, score double")
    assert graph.pagerank(spark.createDataFrame(edges, "src string, dst string, weight double"), none).count() == 0


@pytest.mark.parametrize("queries", [3, graph.BESIDE + 4])
def test_walk_joins_ranks_to_files(spark, queries):
    """A step has a row a file, not a reference, and few queries side by side; ranks are those of the edges."""
    refs, defs = linked_files(25, 6)
    edges = [(a, b, w) for (a, b), w in brute_graph(refs, defs).items()]
    seeds = {q: {f"f{q}": 1.0, "elsewhere": 0.5, f"f{q % 3 + 7}": 2.0} for q in range(queries)}
    walk = graph.NameGraph(*graph_tables(spark, refs, defs))
    assert walk.files.count() == walk.files.select("node").distinct().count() == len({a for a, _, _ in edges}) and "ids" in walk.files.columns
    got = graph.pagerank(walk, spark.createDataFrame([(q, n, s) for q, of in seeds.items() for n, s in of.items()], "query_id int, node string, score double")).collect()
    walk.release()
    assert {(r.query_id, r.node): r.ppr for r in got} == pytest.approx({(q, n): p for q, of in seeds.items() for n, p in brute_ppr(edges, of).items()}, abs=1e-5)


@pytest.mark.parametrize("stem", [False, True])
def test_postings_need_no_shuffle(spark, stem):
    """The places of a chunk's terms are gathered where the chunk is."""
    texts = {1: "Thing things a thing", 2: "", 3: None, 4: "x été thing " * 3}
    rows = [(i, f"p/{i}.md", t, "") for i, t in texts.items()]
    made = fulltext.postings(spark.createDataFrame(rows, "chunk_id long, file_path string, chunk_text string, identifiers string").coalesce(1), stem=stem)
    assert "Exchange" not in plan(made)
    want = {}
    for i, path, t, _ in rows:
        fields = ["p", str(i), "md"], (t or "").lower().replace("é", "e").split()
        for f, words in enumerate(fields):
            for at, w in enumerate(words):
                want.setdefault((porter(w) if stem else w, f, i, path, sum(map(len, fields))), []).append(at)
    got = [((r.term, r.field, r.chunk_id, r.file_path, r.n_terms), r.positions) for r in made.collect()]
    assert dict(got) == want and len(got) == len(want)


def test_merge_adjacent(spark):
    rows = [(0, "a", 1, 10, 0.5, 0.2, "p"), (0, "a", 15, 20, 0.1, 0.9, "q"), (0, "a", 26, 30, 0.3, 0.1, "r"), (0, "b", 1, 2, 0.2, 0.3, "s"), (0, "a", 2, 3, 0.6, 0.9, "t")]
    hits = spark.createDataFrame(rows, "query_id int, file_path string, start_line int, end_line int, similarity double, score double, preview string")
    got = sorted((r.file_path, r.start_line, r.end_line, r.similarity, r.score, r.preview) for r in fusion.merge_adjacent(hits).collect())
    assert got == [("a", 1, 20, 0.6, 0.9, "t"), ("a", 26, 30, 0.3, 0.1, "r"), ("b", 1, 2, 0.2, 0.3, "s")]


def test_config(tmp_path):
    c = C.load({"search": {"top_k": 3}, "indexing": {"include": ["**/*.ts", "**/*.vue"]}})
    assert c["search"]["top_k"] == 3 and c["indexing"]["include"].count("**/*.ts") == 1 and c["indexing"]["include"][-1] == "**/*.vue"
    assert C.detect_provider(c) == "ollama"
    with pytest.raises(ValueError):
        C.load({"embedding": {"dimensions": 0}})
    f = C.ConfigFile(str(tmp_path / "c.json"))
    assert f.set("embedding.dimensions", "64") == {"key": "embedding.dimensions", "value": 64, "dimensions_changed": True}
    assert f.use_provider("openai")["dimensions_changed"] and f.show()["provider"] == "openai"
    with pytest.raises(KeyError):
        f.set("embedding.nothing", "1")
    with pytest.raises(ValueError):
        f.set("intercept.enabled", "maybe")
    assert f.set("indexing.exclude", "a/**, b/**")["value"] == ["a/**", "b/**"]
    f.reset()
    assert f.effective() == C.load()
    acl = C.AccessList(str(tmp_path / "acl.json"))
    assert acl.add("deny", str(tmp_path)) and not acl.add("deny", str(tmp_path)) and acl.discard("deny", str(tmp_path)) and acl.entries("deny") == []


def test_sizes(spark):
    assert [one(spark, stats.size_text(F.lit(n))) for n in (10, 2048, 3 << 20)] == ["10 bytes", "2.0 KB", "3.0 MB"]
