import datetime as dt
import json

import pytest

from lodestone.plans.engine import Engine
from lodestone.sources.embedding import HashEmbedder, HttpEmbedder
from lodestone.streaming.sync import file_stream, upsert_stream

CONFIG = {"embedding": {"dimensions": 16, "query_prefix": ""}, "search": {"similarity_threshold": -1.0}}


def source(name, extra=""):
    return f"export function process_{name}(input) {{\n  return validate_{name}(input);\n}}\n\nexport function validate_{name}(x) {{\n  return Boolean(x);\n}}\n{extra}\n"


def embedder(dimensions=16, up=True):
    e = HashEmbedder(dimensions)
    e.ping = lambda: up
    return e


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "repo"
    (root / "src").mkdir(parents=True)
    (root / "node_modules").mkdir()
    (root / "node_modules/x.js").write_text("function no() {}")
    for n in ("alpha", "beta"):
        (root / f"src/{n}.js").write_text(source(n))
    (root / "src/gamma.js").write_text(source("gamma", "process_alpha(1);"))
    (root / "README.md").write_text("# process_alpha\nAbout process_alpha and more.\n")
    return root


def engine(spark, tmp_path, tree, **kw):
    return Engine(spark, f"file://{tmp_path}/index", f"file://{tree}", CONFIG, kw.get("embedder") or embedder())


def test_index_search_and_maintain(spark, tmp_path, tree):
    e = engine(spark, tmp_path, tree)
    assert e.sync() == {"added": 4}
    status = e.index_status()
    assert status["ok"] and status["files"] == 4 and status["symbol_graph"]
    assert e.sync() == {"unchanged": 4}

    hits = e.search_code("process_alpha", mode="lexical")
    assert hits[0]["file"] == "src/alpha.js" and hits[0]["similarity"] == 0
    assert {h["file"] for h in hits} >= {"src/alpha.js", "src/gamma.js", "README.md"}
    assert e.search_code("nothing_like_it", mode="lexical") == []
    hybrid = e.search_code("process_alpha in code", top_k=3)
    assert len(hybrid) == 3 and {h["file"] for h in hybrid} == {"src/alpha.js", "src/gamma.js", "README.md"}
    assert all(h["score"] is None for h in e.search_code("anything", mode="semantic"))
    assert {h["file"] for h in e.search_code("process_alpha", path="src/g", mode="lexical")} == {"src/gamma.js"}
    assert [x["query"] for x in json.loads(e.search_json(["process_alpha", "validate_beta"]))] == ["process_alpha", "validate_beta"]
    with pytest.raises(ValueError):
        e.search(["x"], mode="other")

    assert e.find_symbol("process_beta") == {"found": True, "definitions": [{"file": "src/beta.js", "kind": "function", "line": 1}]}
    assert not e.find_symbol("missing")["found"]
    assert e.find_references("process_alpha") == {"defined_in": ["src/alpha.js"], "referenced_by": ["src/gamma.js"], "count": 1}
    assert [s["name"] for s in e.outline("beta")["symbols"]] == ["process_beta", "validate_beta"]
    assert len(e.outline("src/")["candidates"]) == 3

    (tree / "src/alpha.js").write_text(source("alpha2"))
    e.update_file("src/alpha.js")
    assert not e.find_symbol("process_alpha")["found"] and e.find_symbol("process_alpha2")["found"]
    (tree / "src/beta.js").unlink()
    assert e.gc() == 1 and e.gc() == 0
    assert not e.find_symbol("process_beta")["found"]
    (tree / "src/delta.js").write_text(source("delta"))
    (tree / "src/gamma.js").write_text(source("gamma"))
    assert e.sync() == {"added": 1, "changed": 1, "unchanged": 2}
    e.store.prune()
    report = e.report()
    assert report["coverage"]["percent"] == 100 and report["recent_files"] and report["mean_chunks"] >= 1
    assert e.allowed([], [], "/home/x") and not e.allowed([], [f"file://{tree}"], "/home/x")


def test_failures_keep_the_index(spark, tmp_path, tree):
    engine(spark, tmp_path, tree).sync()
    down = engine(spark, tmp_path, tree, embedder=embedder(up=False))
    assert "error" in down.sync() and down.index_status()["files"] == 4
    other = engine(spark, tmp_path, tree, embedder=embedder(dimensions=8))
    assert "error" in other.sync() and not other.index_status()["ok"]
    with pytest.raises(ValueError):
        other.search(["x"])
    assert other.reindex() == {"added": 4}
    e = engine(spark, tmp_path, tree)
    e.store.set_state(sync_status="in_progress", sync_started_at=(dt.datetime.now(dt.UTC) - dt.timedelta(minutes=6)).isoformat())
    e.recover()
    assert e.store.state()["sync_status"] == "idle"


def test_lexical_when_the_embedder_is_down(spark, tmp_path, tree):
    engine(spark, tmp_path, tree).sync()

    down = embedder()

    def fail(_):
        raise OSError("down")

    down.embed = fail
    hits = engine(spark, tmp_path, tree, embedder=down).search_code("process_alpha")
    assert hits and all(h["similarity"] == 0 for h in hits)


def test_stream(spark, tmp_path, tree):
    e = engine(spark, tmp_path, tree)
    q = upsert_stream(file_stream(spark, f"file://{tree}", e.config), e.store, e.config, e.embedder, f"{tmp_path}/state")
    q.awaitTermination()
    assert e.index_status()["files"] == 4
    (tree / "src/new.py").write_text("def fresh():\n    pass\n")
    q = upsert_stream(file_stream(spark, f"file://{tree}", e.config), e.store, e.config, e.embedder, f"{tmp_path}/state")
    q.awaitTermination()
    assert e.index_status()["files"] == 5 and e.find_symbol("fresh")["found"]


def test_http_retries(monkeypatch):
    import io
    import urllib.error

    calls = []

    def post(codes):
        def one(self, texts):
            calls.append(len(texts))
            if codes:
                raise urllib.error.HTTPError("u", codes.pop(0), "", None, io.BytesIO())
            return [[0.0]] * len(texts)

        return one

    h = HttpEmbedder({"dimensions": 1, "batch_size": 2}, wait=0)
    monkeypatch.setattr(HttpEmbedder, "_post", post([503, 429]))
    assert len(h.embed(["a", "b", "c"])) == 3 and calls == [2, 2, 2, 1]
    monkeypatch.setattr(HttpEmbedder, "_post", post([400]))
    with pytest.raises(urllib.error.HTTPError):
        h.embed(["a"])
    monkeypatch.setattr(HttpEmbedder, "_post", post([500] * 9))
    assert not h.ping()


def test_tool_server(spark, tmp_path, tree):
    from lodestone.plans.tools import ToolServer, status_line

    e = engine(spark, tmp_path, tree)
    assert status_line(e.index_status()) == "no index"
    e.sync()
    server = ToolServer(e)
    ask = lambda method, **params: server.handle(json.dumps({"jsonrpc": "2.0", "id": 1, "method": method, "params": params}))
    assert ask("initialize")["result"]["capabilities"] == {"tools": {}} and ask("ping")["result"] == {}
    assert [t["name"] for t in ask("tools/list")["result"]["tools"]] == ["search_code", "find_symbol", "find_references", "outline", "index_status"]
    found = ask("tools/call", name="find_symbol", arguments={"name": "process_beta"})["result"]["content"][0]["text"]
    assert json.loads(found)["found"]
    assert ask("tools/call", name="nothing")["error"]["code"] == -32602 and ask("tools/call", name="outline")["error"]["code"] == -32602
    assert ask("other")["error"]["code"] == -32601 and server.handle("{")["error"]["code"] == -32700
    assert server.handle('{"method": "notifications/initialized"}') is None
    assert ask("tools/call", name="search_code", arguments={"query": "x", "mode": "bad"})["result"]["isError"]
    assert status_line(e.report()).startswith("4 files")


def test_older_versions_are_read(spark, tmp_path, tree):
    new = engine(spark, tmp_path, tree)
    new.sync()
    folder = f"file://{tmp_path}/older"
    new.store.table("chunks").drop("identifiers", "n_terms").write.parquet(f"{folder}/old/chunks")
    e = Engine(spark, folder, f"file://{tree}", CONFIG, embedder())
    e.store.set_state(snapshot="old", schema_version=1, embedding_dimensions=16)
    assert "process_alpha" in " ".join(r.identifiers for r in e.store.table("chunks").collect())
    assert e.store.table("symbols").count() == 0
    assert e.search_code("process_alpha", mode="lexical")[0]["file"] == "src/alpha.js"
    assert e.sync(force=True) == {"unchanged": 4} and e.store.state()["schema_version"] == 4
    assert e.find_symbol("process_alpha")["found"] and e.index_status()["files"] == 4


def stops(folder, word):
    """An embedder that fails on texts that hold a word, and writes each text it embeds to a file of a folder."""

    class Stops(HashEmbedder):
        def embed(self, texts):
            import uuid

            if any(word and word in t for t in texts):
                raise OSError("refused")
            for t in texts:
                with open(f"{folder}/{uuid.uuid4().hex}", "w") as f:
                    f.write(t)
            return HashEmbedder.embed(self, texts)

    return Stops(16)


def test_failed_files_are_left_for_the_next_run(spark, tmp_path, tree):
    (tmp_path / "seen").mkdir()
    e = engine(spark, tmp_path, tree, embedder=stops(tmp_path / "seen", "process_beta"))
    assert e.sync() == {"added": 3, "failed": 1}
    state = e.store.state()
    assert state["sync_failed_files"] == 1 and not state.get("initial_index_complete") and state["sync_status"] == "idle"
    assert not e.find_symbol("process_beta")["found"] and e.find_symbol("process_alpha")["found"]
    before = sorted(f.read_text() for f in (tmp_path / "seen").iterdir())
    again = engine(spark, tmp_path, tree, embedder=stops(tmp_path / "seen", ""))
    assert again.sync() == {"added": 1, "unchanged": 3} and again.store.state()["initial_index_complete"]
    after = sorted(f.read_text() for f in (tmp_path / "seen").iterdir())
    others = [t for t in after if "beta" not in t]
    assert others == [t for t in before if "beta" not in t] and len(set(others)) == len(others) and any("process_beta" in t for t in after)


def test_an_interrupted_run_goes_on(spark, tmp_path, tree, monkeypatch):
    """Windows of one file: what is committed before a crash is not embedded again."""
    from lodestone.sources.snapshot import Snapshots

    (tmp_path / "seen").mkdir()
    config = {**CONFIG, "indexing": {"window": 1}}
    make = lambda: Engine(spark, f"file://{tmp_path}/index", f"file://{tree}", config, stops(tmp_path / "seen", ""))
    real, calls = Snapshots.append, []

    def breaks(self, *a, **kw):
        calls.append(1)
        if len(calls) == 2:
            raise OSError("killed")
        real(self, *a, **kw)

    monkeypatch.setattr(Snapshots, "append", breaks)
    with pytest.raises(OSError, match="killed"):
        make().sync()
    done = {r.file_path for r in make().store.table("files").collect()}
    assert 1 <= len(done) <= 3 and make().store.state()["sync_status"] == "error"
    monkeypatch.setattr(Snapshots, "append", real)
    first = [f.name for f in (tmp_path / "seen").iterdir()]
    got = make().sync()
    assert got["unchanged"] == len(done) and got["added"] == 4 - len(done)
    texts = [f.read_text() for f in (tmp_path / "seen").iterdir() if f.name not in first]
    assert all(f"process_{n}(" not in t.split("return")[0] for t in texts for n in ("alpha", "beta", "gamma") if f"src/{n}.js" in done)
    assert make().store.state()["initial_index_complete"]


def test_a_torn_state_leaves_the_one_before(spark, tmp_path, tree):
    from lodestone.sources.snapshot import Damaged

    e = engine(spark, tmp_path, tree)
    e.sync()
    newest = sorted((tmp_path / "index").glob("state-*.json"))[-1]
    newest.with_name(f"state-{int(newest.name[6:-5]) + 1:012d}.json").write_text('{"segments": [')
    assert e.index_status()["files"] == 4 and e.store.readable()
    e.store.set_state(note="after")
    assert e.store.state()["note"] == "after" and e.index_status()["files"] == 4
    for f in (tmp_path / "index").glob("state-*.json"):
        f.write_text("{")
        (f.parent / f".{f.name}.crc").unlink(missing_ok=True)
    with pytest.raises(Damaged):
        e.store.state()
    assert e.index_status()["status"] == "damaged" and not e.store.readable()
    assert e.sync() == {"added": 4} and e.index_status()["ok"]
    part = next(p for p in (tmp_path / "index").glob("*/chunks/part-*.parquet") if p.stat().st_size > 100)
    part.write_bytes(part.read_bytes()[:40])
    (part.parent / f".{part.name}.crc").unlink(missing_ok=True)
    assert not e.store.readable() and e.sync() == {"added": 4}


def test_one_file_touches_one_segment(spark, tmp_path, tree, monkeypatch):
    from lodestone.plans import engine as module

    e = engine(spark, tmp_path, tree)
    e.sync()
    segments = e.store.state()["segments"]
    read = []
    real = module.read_paths
    monkeypatch.setattr(module, "read_paths", lambda spark, root, names, kb: read.append(names) or real(spark, root, names, kb))
    (tree / "src/alpha.js").write_text(source("alpha3"))
    e.update_file("src/alpha.js")
    assert read == [["src/alpha.js"]] and e.store.state()["segments"][:-1] == segments
    terms = {r.term for r in e.store.table("postings").collect()}
    assert "process" in terms and "alpha3" in terms
    index = e.store.text_index()
    chunks = e.store.table("chunks").collect()
    assert (index.chunks, index.terms) == (len(chunks), sum(c.n_terms for c in chunks))
    hits = {r.chunk_id for r in index.postings.collect()}
    assert hits <= {c.chunk_id for c in chunks}
    (tree / "src/alpha.js").unlink()
    e.update_file("src/alpha.js")
    assert e.index_status()["files"] == 3
    before = {k: sorted(map(str, e.store.table(k).collect())) for k in ("chunks", "symbols", "refs", "files", "postings")}
    e.store.compact()
    e.store.prune()
    assert len(e.store.state()["segments"]) == 1
    assert before == {k: sorted(map(str, e.store.table(k).collect())) for k in before}


def test_text_search_reads_its_terms_only(spark, tmp_path, tree):
    from lodestone.operators import fulltext

    e = engine(spark, tmp_path, tree)
    e.sync()
    queries = spark.createDataFrame([(0, "validate_alpha")], "query_id int, query_text string")
    plan = fulltext.bm25(e.store.text_index(), queries)._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "EqualTo(term,valid)" in plan or "term,valid" in plan.split("PushedFilters")[1]
    assert "regexp_extract_all(translate" not in plan.split("PushedFilters")[1].split("\n")[0] and "chunk_text" not in plan


def test_cancel(spark, tmp_path, tree):
    from lodestone.plans.tools import session_text

    e = engine(spark, tmp_path, tree)
    assert e.cancel() == {"status": "no_process"} and session_text(e.index_status()) == ""
    real = e._files
    e._files = lambda: [real(), e.store.set_state(sync_cancel="9999")][0]
    assert e.sync() == {"stopped": 1} and e.store.state()["sync_status"] == "idle" and not e.store.state().get("initial_index_complete")
    e._files = real
    assert e.sync() == {"added": 4}
    assert "find_symbol(name)" in session_text(e.index_status())


def test_git_decides_what_is_listed(spark, tmp_path, tree):
    import os
    import subprocess

    from lodestone.sources.files import git_changed, list_files, walk

    run = lambda *a: subprocess.run(["git", "-C", str(tree), "-c", "user.name=a", "-c", "user.email=a@b", *a], check=True, capture_output=True)
    os.symlink(tree / "README.md", tree / "src/link.md")
    os.symlink(tree / "src", tree / "also")
    assert walk(str(tree), None) == ["README.md", "src/alpha.js", "src/beta.js", "src/gamma.js"] and len(walk(str(tree), 2)) == 2
    run("init", "-q")
    (tree / ".gitignore").write_text("src/gamma.js\nnode_modules\n")
    run("add", "README.md", "src/alpha.js")
    run("commit", "-q", "-m", "first", "--date", "2001-01-01T00:00:00Z")
    names = lambda: {r.file_path for r in list_files(spark, f"file://{tree}").collect()}
    assert names() == {"README.md", "src/alpha.js", "src/beta.js", ".gitignore"}
    assert set(git_changed(str(tree), "2099-01-01")) == {"src/beta.js", ".gitignore", "src/link.md", "also"}
    (tree / "src/alpha.js").write_text("function changed() {}")
    e = engine(spark, tmp_path, tree)
    assert "src/alpha.js" in e.changed_since("2099-01-01") and git_changed(str(tmp_path), "2001-01-01") is None
    assert e.sync() == {"added": 3} and not e.find_symbol("process_gamma")["found"]


def test_command_line(tmp_path, capsys):
    from lodestone.__main__ import main

    files = ["--config", f"{tmp_path}/c.json", "--lists", f"{tmp_path}/l.json"]
    assert main([*files, "config", "set", "search.top_k", "7"]) == 0
    assert main([*files, "deny", "add", str(tmp_path)]) == 0
    assert main([*files, "deny", "list"]) == 0
    assert str(tmp_path) in capsys.readouterr().out
