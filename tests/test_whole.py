"""Queries over every row of their tables."""

import pytest

from lodestone.plans import queries as Q

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def write(spark, path, texts, vectors=()):
    rows = [(i, t, "en", "web", len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(list(vectors), "vec_id long, embedding array<float>, label int").write.parquet(f"{path}/embeddings.parquet")
    return str(path)


@pytest.fixture(scope="module")
def partly(spark, tmp_path_factory):
    """Ten documents, the first six with a vector; the rare words stand in the others only."""
    texts = [f"plain words number{i}" for i in range(6)] + ["thing edble here", "other words", "edble", "nothing more"]
    return write(spark, tmp_path_factory.mktemp("whole") / "partly", texts, [(i, [float(i), 1.0], 0) for i in range(6)])


def test_full_text_sees_documents_without_a_vector(spark, partly):
    fused = [r for r in Q.rrf_fusion(spark, partly).collect() if r.fts_rank]
    ranks = {(r.query_id, r.chunk_id): r.fts_rank for r in Q.bm25_tiered(spark, partly).collect()}
    assert {(r.query_id, r.chunk_id): r.fts_rank for r in fused} == ranks and {c for q, c in ranks if q == 1} == {6, 8}
    assert all(r.vec_rank is None for r in fused if r.chunk_id >= 6)
    for query in (Q.hybrid_search, Q.hybrid_debug):
        assert {6, 8} <= {r.chunk_id for r in query(spark, partly).collect() if r.query_id == 1}


LINES = ["alpha gamma\nbravo alpha été", "bravo élève\nalpha hotel bravo", "gamma alpha\nabcd bravo", "abcd gamma\nabcd hotel", "lonely"]


def brute_edges(texts):
    """(src, dst) -> weight of files by words of five letters or more, each shared by the files with a line that starts with it."""
    import re
    from collections import defaultdict

    path = lambda i: f"web/en/{i}.{('ts', 'md', 'test.ts', 'json', 'py')[i % 5]}"
    definers, edges = defaultdict(set), defaultdict(float)
    for i, t in enumerate(texts):
        for line in t.lower().split("\n"):
            if m := re.match("[a-z]+", line):
                definers[m[0]].add(i)
    for i, t in enumerate(texts):
        for w in {w for w in re.findall(r"[^\W\d_]+", t.lower()) if len(w) >= 5}:
            for j in definers[w] - {i}:
                edges[path(i), path(j)] += 1 / len(definers[w])
    return dict(edges)


@pytest.fixture(scope="module")
def linked(spark, tmp_path_factory):
    return write(spark, tmp_path_factory.mktemp("whole") / "linked", LINES)


def test_references_have_five_letters(spark, linked):
    assert {r.name for r in Q.doc_refs(spark, linked).collect()} == {"alpha", "gamma", "bravo", "hotel", "élève", "lonely"}
    want = brute_edges(LINES)
    got = {(r.src, r.dst): r.weight for r in Q.file_graph_raw(spark, linked).collect()}
    assert got == pytest.approx(want, abs=1e-6) and len(want) > 4
    assert {(r.src, r.dst) for r in Q.file_graph_binary(spark, linked).collect()} == set(want)


RANKED = ["alpha gamma thing\nbravo alpha", "bravo edble\nalpha hotel thing", "gamma alpha\nthing bravo", "hotel gamma\nabcd hotel thing", "lonely", "edble alpha\nlonely gamma"]


def brute_ranks(edges, seeds):
    out, rank = {}, dict(seeds)
    for (src, _), w in edges.items():
        out[src] = out.get(src, 0) + w
    for _ in range(20):
        lost = sum(r for n, r in rank.items() if n not in out)
        after = {n: p * (0.15 + 0.85 * lost) for n, p in seeds.items()}
        for (src, dst), w in edges.items():
            if src in rank:
                after[dst] = after.get(dst, 0) + 0.85 * rank[src] * w / out[src]
        rank = after
    return {n: r / max(rank.values()) for n, r in rank.items() if r > 0}


def test_ranks_are_of_the_file_graph(spark, tmp_path):
    sf = write(spark, tmp_path / "ranked", RANKED)
    edges, seeds = brute_edges(RANKED), {}
    for r in Q._seeds(spark, sf).collect():
        seeds.setdefault(r.query_id, {})[r.node] = r.score
    want, more = {}, set()
    for q, of in seeds.items():
        ranks = brute_ranks(edges, {n: s / sum(of.values()) for n, s in of.items()})
        want |= {(q, n): p for n, p in ranks.items()}
        more |= {(q, n) for n, _ in sorted(((n, p) for n, p in ranks.items() if n not in of and p >= 0.05), key=lambda x: (-round(x[1], 9), x[0]))[:3]}
    got = {(r.query_id, r.node): r.ppr for r in Q.ppr(spark, sf).collect()}
    assert got == pytest.approx(want, abs=1e-4) and len(want) > 6
    assert {(r.query_id, r.node) for r in Q.graph_expand(spark, sf).collect()} == more and more


def test_hybrid_graph_has_names_of_many_files(spark, tmp_path):
    texts = [f"alpha words\nthing {'edble ' * (i % 4)}and number{i}" for i in range(25)]
    sf = write(spark, tmp_path / "many", texts, [(i, [float(i % 7), 1.0], 0) for i in range(25)])
    edges = spark.createDataFrame([(*k, w) for k, w in brute_edges(texts).items()], "src string, dst string, weight double")
    pick = lambda rows: sorted((r.query_id, r.rank, r.chunk_id, round(r.score, 6)) for r in rows.collect())
    assert pick(Q.hybrid_graph(spark, sf)) == pick(Q._hybrid(spark, sf, edges)) != pick(Q.hybrid_search(spark, sf))
