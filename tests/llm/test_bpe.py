import hashlib
import random

import pytest

pytest.importorskip("public_tokenizers")
import public_tokenizers as P
from hypothesis import given, settings
from hypothesis import strategies as st
from test_token_store import HARD, random_texts

from lodestone.llm.bpe import Bpe, MergeTree, NONE, digests, encode, merge

PATH = P.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def bpe():
    return Bpe(PATH)


TEXTS = [*HARD, "ΑΣ ΣΑΣ ὈΔΥΣΣΕΎΣ", "İstanbul ẞ ǅ", "é é ﬃ", "<|startoftext|>A<|endoftext|> <|ENDOFTEXT|>", "antidisestablishmentarianism" * 40]


def test_equals_library(library, bpe):
    for t in TEXTS + random_texts(400):
        ids = library.encode(t, add_special_tokens=False).ids
        assert bpe.encode(t) == ids, t
        assert bpe.decode(ids) == library.decode(ids, skip_special_tokens=False)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=24), st.integers(0, 10**6))
def test_merge_equals_scan(symbols, seed):
    r = random.Random(seed)
    pairs = {(r.randrange(8), r.randrange(8)): None for _ in range(12)}
    pairs = {p: (i, r.randrange(8)) for i, p in enumerate(pairs)}
    want = list(symbols)
    while True:
        found = [(pairs[a, b][0], i) for i, (a, b) in enumerate(zip(want, want[1:], strict=False)) if (a, b) in pairs]
        if not found or len(want) > 50:
            break
        i = min(found)[1]
        want[i : i + 2] = [pairs[want[i], want[i + 1]][1]]
    assert merge(symbols, pairs) == want


def test_tree():
    t = MergeTree([5, 2, 2, NONE])
    assert t.root() == 1
    t.set(1, NONE)
    assert t.root() == 2
    t.set(2, NONE), t.set(0, NONE)
    assert t.root() == -1


def test_query(spark, library):
    rows = [(i, t, "x") for i, t in enumerate([None, *TEXTS])] + [(0, None, "x"), (None, "a", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for i, t, _ in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    assert sorted(map(tuple, digests(docs, PATH).collect()), key=str) == sorted(want, key=str)
    got = encode(docs.where("doc_id > 0"), PATH).collect()
    assert all(r.ids == library.encode(rows[r.doc_id][1], add_special_tokens=False).ids for r in got)
    assert digests(docs.where("false"), PATH).count() == 0


def test_text_of_more_words_than_are_kept(library, monkeypatch):
    from lodestone.llm import bpe as module

    monkeypatch.setattr(module, "KEPT_WORDS", 50)
    b = Bpe(PATH)
    many = " ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300))
    for t in (many, f"{many}<|endoftext|>{many[:400]}", "some few words", many):
        assert b.encode(t) == library.encode(t, add_special_tokens=False).ids
        assert len(b.known) <= 50
