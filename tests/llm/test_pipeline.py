import hashlib
import os

import pytest

pytest.importorskip("public_tokenizers")
corpus_pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="test data")
def test_stages_equal_brute_force(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    from lodestone.llm.near_dups import Text, near
    from lodestone.plans.storage import materialize

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept, before = {}, docs
    for name, stage in corpus_pipeline.STAGES:
        after = materialize(stage(spark, before, SF), "test")
        if name != "tokens":
            assert after.columns == corpus_pipeline.COLUMNS
        kept[name], before = after.collect(), after
    all_ = {r.doc_id: r for r in docs.collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    good = {r.doc_id for r in kept["quality"]}
    known = [i for i in labels if i in all_]
    assert sum((i in good) == bool(labels[i]) for i in known) >= 0.97 * len(known)

    # Site lines: text of kept lines only, a subsequence of the lines before.
    for r in kept["site_lines"]:
        rest = iter(all_[r.doc_id].text.split("\n"))
        assert all(x in rest for x in r.text.split("\n")) and r.n_chars == len(r.text)
    assert {r.doc_id for r in kept["site_lines"]} == good

    # Near copies: one of each component of the links of all pairs.
    rows = sorted(kept["site_lines"])
    texts = [Text(r.text) for r in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if label[i] != label[j] and (rows[i].text == rows[j].text or near(texts[i], texts[j])):
                lo, hi = sorted((label[i], label[j]))
                label = [lo if x == hi else x for x in label]
    assert sorted(r.doc_id for r in kept["near_copies"]) == [rows[i].doc_id for i in sorted(set(label))]

    # Mix: rows of the stage before, twice at most.
    from collections import Counter

    times = Counter(r.doc_id for r in kept["mix"])
    assert set(times) <= {r.doc_id for r in kept["near_copies"]} and max(times.values()) <= 2
    words = lambda rs: sum(len(r.text.split()) for r in rs)
    assert abs(words(kept["mix"]) / words(kept["near_copies"]) - 1.5) < 0.15

    t = Tokenizer.from_file(public_tokenizers.path(corpus_pipeline.TOKENIZER))
    text = {r.doc_id: r.text for r in kept["mix"]}
    assert Counter(r.doc_id for r in kept["tokens"]) == times
    for r in kept["tokens"]:
        ids = t.encode(text[r.doc_id], add_special_tokens=False).ids
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
    assert corpus_pipeline.run(spark, SF).count() == len(kept["tokens"])


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages_on_odd_tables(spark, tmp_path):
    """Null, empty, long and repeated rows, null ids and sources, further columns and empty tables, stage by stage."""
    from lodestone.plans.storage import materialize

    long = "lorem ipsum dolor " * 60_000
    rows = [(i, f"the words of text {i} are its own number {i * 7} and no other has {i * i}.", "en", "ab"[i % 2], 1) for i in range(60)]
    rows += [rows[3], rows[3], (None, rows[4][1], "en", "a", 1), (None, "no id here but these words are not in another text at all.", None, None, None)]
    rows += [(100, None, "en", "a", None), (101, "", "en", "a", 0), (102, long, "en", None, len(long)), (102, "another text of the same id as the long one before it.", "en", "b", 5)]
    docs = spark.createDataFrame(rows, DOCS)
    labels = "doc_id long, quality int, toxic int"
    for name, ids in (("some", [(i, 1, 0) for i in range(40)] + [(None, 0, 0), (41, None, None)]), ("none", [])):
        sf = str(tmp_path / name)
        spark.createDataFrame(ids, labels).write.parquet(f"{sf}/labels.parquet")
        for table in (docs, docs.where("false")):
            before = table.selectExpr("*", "1 as score", "2 as node", "3 as slots", "4 as __id")
            for stage, function in corpus_pipeline.STAGES if ids else corpus_pipeline.STAGES[:1]:
                after = materialize(function(spark, before, sf), "test-odd")
                if stage == "near_copies" and table is docs:
                    kept = [tuple(r) for r in after.collect()]
                    again = [tuple(r) for r in function(spark, before.repartition(7), sf).collect()]
                    assert sorted(map(str, kept)) == sorted(map(str, again)) and len(kept) == len({str(r[:2]) for r in kept})
                    assert {r[0] for r in kept} >= {*range(60), 100, 102, None} - {101}
                before = after
            assert (before.count() > 0) == (table is docs)
