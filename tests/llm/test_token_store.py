import random
import zlib

import pytest

pytest.importorskip("public_tokenizers")
import public_tokenizers as P

from lodestone.llm.token_store import Encoder, store

PATH = P.path("byte_bpe_50k.json")
HARD = ["", " ", "a", "  a\n\n b \t\t", "don't we'll I'M it''s", "x<|endoftext|>y", "é　ü\x85\xa0z \x1c\x1d a", "1234 56,7.8", "日本語 テスト 👍🏽 𝒳", "a  b ", "ﬁ ½ Ⅷ ²", "\x00\x01 \x0b\x0c", "'s's 't", "word " * 3000]


def library(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    return [t.encode(x, add_special_tokens=False).ids for x in texts]


def random_texts(n, seed=3):
    r = random.Random(seed)
    letters = "ab zé'\n\t 12.,! \x85語stmd’"
    return ["".join(r.choice(letters) for _ in range(r.randrange(60))) for _ in range(n)]


def test_encoder_equals_library():
    import struct

    e = Encoder(PATH)
    texts = HARD + random_texts(500)
    for t, ids in zip(texts, library(texts)):
        assert e.encode(t) == struct.pack(f"<{len(ids)}I", *ids), t


def test_store_round_trip(spark):
    import struct

    texts = [None, *HARD, *random_texts(40)]
    rows = [(i * 3, t, "x") for i, t in enumerate(texts)]
    random.Random(1).shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string, start string")
    got = {r.doc_id: r for r in store(docs, PATH).collect()}
    at = 0
    for i, ids in enumerate(library([t or "" for t in texts])):
        raw = struct.pack(f"<{len(ids) + 1}I", *ids, 0)
        assert tuple(got[i * 3]) == (i * 3, at, len(ids) + 1, zlib.crc32(raw))
        at += len(ids) + 1


def test_store_ties_nulls_empty(spark):
    schema = "doc_id long, text string"
    assert store(spark.createDataFrame([], schema), PATH).count() == 0
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c"), (None, None), (2, "")], schema)
    got = sorted(((r.doc_id is not None, r.doc_id, r.start, r.n_tokens) for r in store(docs, PATH).collect()), key=str)
    assert len(got) == 5
    assert sorted(x[2] for x in got) == [0, 1, 3, 6, 9]


def test_another_process_reads_the_folder(spark, tmp_path):
    """The folder alone holds the dictionary, the manifest and the files."""
    import os
    import struct
    import subprocess
    import sys

    from lodestone.llm.token_store import fetch, get_dictionary, open_store, write_store

    r = random.Random(5)
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randrange(2, 8))) for _ in range(300)]
    texts = [" ".join(r.choice(words) for _ in range(40)) for _ in range(700)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    folder = f"file://{tmp_path}/store"
    files = write_store(docs, PATH, folder, file_docs=200).collect()
    assert len(files) >= 3 and len({f.dictionary for f in files}) == 1
    assert len(get_dictionary(folder, files[0].dictionary)) > 1000 and (tmp_path / f"store/{files[0].dictionary}.zdict").stat().st_size > 1000
    ids = [*library([texts[123]])[0], 0]
    assert fetch(spark, folder, 123) == [struct.pack(f"<{len(ids)}I", *ids)] and fetch(spark, folder, 700) == []
    assert open_store(spark, folder).count() == len(files)

    code = f"""
from pyspark.sql import SparkSession
from lodestone.llm.token_store import open_store, read_store
spark = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').getOrCreate()
for r in read_store(open_store(spark, {folder!r}), {folder!r}).collect():
    print('row', *r)
"""
    out = subprocess.run([sys.executable, "-c", code], env={**os.environ, "PYTHONPATH": os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))}, capture_output=True, text=True, check=True).stdout
    got = {int(x.split()[1]): tuple(map(int, x.split()[2:])) for x in out.splitlines() if x.startswith("row")}
    at = 0
    for i, ids in enumerate(library(texts)):
        assert got[i] == (at, len(ids) + 1, zlib.crc32(struct.pack(f"<{len(ids) + 1}I", *ids, 0)))
        at += len(ids) + 1


def test_wrong_dictionary_is_refused(spark, tmp_path):
    from lodestone.llm.token_store import open_store, read_store, write_store

    docs = spark.createDataFrame([(i, f"some words {i} and more of them") for i in range(600)], "doc_id long, text string")
    folder = f"file://{tmp_path}/store"
    sha = write_store(docs, PATH, folder).first().dictionary
    (tmp_path / f"store/{sha}.zdict").write_bytes(b"other")
    (tmp_path / f"store/.{sha}.zdict.crc").unlink(missing_ok=True)
    with pytest.raises(Exception, match="not the dictionary"):
        read_store(open_store(spark.newSession(), folder), folder).collect()


def test_cuts_of_two_levels(spark):
    from pyspark.sql import functions as F

    from lodestone.llm.common import key_cuts, range_of

    df = spark.range(30_000).select((F.col("id") * 7 % 30_011).alias("k")).union(spark.range(900).select(F.lit(77).cast("long"))).union(spark.range(3).select(F.lit(None).cast("long")))
    cuts = key_cuts(df, "k", 20, level=32)
    rows = df.select("k", range_of(F.col("k"), cuts).alias("r")).groupBy("r").agg(F.count("*").alias("n"), F.min("k").alias("lo"), F.max("k").alias("hi")).orderBy("r").collect()
    assert len(cuts) > 1200 and [r.r for r in rows] == list(range(len(cuts) + 1))
    assert all(a.hi < b.lo for a, b in zip(rows, rows[1:], strict=False)) and max(r.n for r in rows if not r.lo <= 77 <= r.hi) < 100
