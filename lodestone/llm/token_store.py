"""Token-id files: documents compressed one by one with a shared dictionary.

File: MAGIC, u32 header length, header (JSON: dictionary SHA-256, documents, ids, index
length), the index (zstandard: deltas of doc ids, id counts and frame lengths), then a
zstandard frame a document of its ids as little-endian u32. A reader fetches one short
document by the index and one ranged read.

Folder: the token files, ``<SHA-256>.zdict`` (the dictionary that files name by that
hash; none is written for an empty one) and ``manifest``, a Parquet table of the files
that count, written last. The folder alone is enough to read every document.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
import struct
import unicodedata
import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import arrow_rows, filesystem, key_cuts, range_of, small_batches
from lodestone.plans.storage import fresh_dir

MAGIC = b"LDTK0001"
#: White space of the vocabulary's pattern, for engines whose own class differs.
SPACE = r"\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: The vocabulary's pattern for texts without ODD code points, where Python's classes agree with it.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+"
#: Words kept by a worker.
KEPT_WORDS = 1 << 20


def odd_points() -> str:
    """A class of code points that engines class differently.

    Control codes that only Python calls white space, numbers that are no decimal digits,
    blocks to which Unicode still adds letters, and all beyond the first plane.
    """
    other = [i for i in range(0x10000) if unicodedata.category(chr(i)) in ("Nl", "No", "Cn")]
    runs: list[list[int]] = []
    for i in other:
        if runs and runs[-1][1] == i - 1:
            runs[-1][1] = i
        else:
            runs.append([i, i])
    return r"[\x1c-\x1f\u1c80-\u1c8f\ua7c0-\ua7ff\U00010000-\U0010ffff" + "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in runs) + "]"


ODD = odd_points()
#: Those of ODD that are ASCII.
CONTROLS = "\x1c\x1d\x1e\x1f"


def byte_letters() -> list[str]:
    """The letter of each byte: printable Latin-1 stands for itself, the rest from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class _Known(dict):
    """Word -> ids, made when first asked for."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, word: str) -> bytes:
        if len(self) >= KEPT_WORDS:
            self.clear()
        self[word] = ids = self.make(word)
        return ids


class Encoder:
    """Ids of texts as little-endian u32 bytes, as the tokenizers library gives them.

    Words of the vocabulary's own pattern never share a token, so that the library
    encodes each distinct word once a worker; whole texts go to it where a special
    token's string or an ODD code point occurs.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.words = re.compile(PATTERN).findall
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.odd = re.compile("|".join([*map(re.escape, special), ODD])).search
        self.special, self.model, self.letters = special, self.tokenizer.model, dict(enumerate(byte_letters()))
        self.word = _Known(self.split).__getitem__

    def split(self, word: str) -> bytes:
        """Ids of one word of the pattern: the library's merges of its byte letters."""
        ids = [t.id for t in self.model.tokenize(word.encode().decode("latin-1").translate(self.letters))]
        return struct.pack(f"<{len(ids)}I", *ids)

    def whole(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str) -> bytes:
        if text.isascii():
            odd = any([x in text for x in self.special]) or any([x in text for x in CONTROLS])
        else:
            odd = self.odd(text)
        if odd:
            return self.whole(text)
        return b"".join(map(self.word, self.words(text)))


@functools.lru_cache(2)
def encoder_of(path: str) -> Encoder:
    """The worker's encoder: its words stay known from task to task."""
    return Encoder(path)


def train_dictionary(docs: DataFrame, path: str, samples: int = 500, longest: int = 50_000, size: int = 64 << 10, end: int = 0) -> bytes:
    """A zstandard dictionary of the ids of ``samples`` documents of ``longest`` characters at most (least hash of the id).

    The bound is on what it is fitted to; every document is then compressed with it.
    Too few or too short documents give an empty dictionary.
    """
    import zstandard

    order = F.xxhash64("doc_id")
    fits = docs.where(F.col("doc_id").isNotNull() & (F.length("text") <= longest))
    picked = [r[0] for r in fits.select("doc_id").orderBy(order, "doc_id").limit(samples).collect()]
    texts = fits.where(F.col("doc_id").isin(picked)).select("doc_id", "text").orderBy("doc_id", F.xxhash64("text")).limit(2 * samples).collect() if picked else []
    encoder = encoder_of(path)
    ids = [encoder.encode(r.text) + struct.pack("<I", end) for r in texts]
    try:
        return zstandard.train_dictionary(size, ids).as_bytes()
    except zstandard.ZstdError:
        return b""


def compressor(dictionary: bytes, level: int = 3):
    import zstandard

    words = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    if words:
        words.precompute_compress(level=level)
    return zstandard.ZstdCompressor(level=level, dict_data=words, write_checksum=False)


def decompressor(dictionary: bytes):
    import zstandard

    return zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)


def pack_file(rows: list[tuple[int | None, int, bytes]], dictionary: bytes) -> bytes:
    """rows: (doc_id, ids, frame) in file order."""
    import numpy as np
    import zstandard

    ids = np.array([-(1 << 63) if i is None else i for i, _, _ in rows], "<i8")
    index = ids.tobytes() + np.array([n for _, n, _ in rows], "<u8").tobytes() + np.array([len(b) for _, _, b in rows], "<u8").tobytes()
    index = zstandard.ZstdCompressor(level=3).compress(index)
    head = json.dumps({"dictionary_sha256": hashlib.sha256(dictionary).hexdigest(), "documents": len(rows), "ids": sum(n for _, n, _ in rows), "index_bytes": len(index)}).encode()
    return b"".join([MAGIC, struct.pack("<I", len(head)), head, index, *(b for _, _, b in rows)])


class Reader:
    """Documents of one file of the store, by place, each by one ranged read."""

    def __init__(self, stream, dictionary: bytes):
        import numpy as np
        import zstandard

        self.stream, self.codec = stream, decompressor(dictionary)
        if stream.read(8) != MAGIC:
            raise ValueError("not a token file")
        (n,) = struct.unpack("<I", stream.read(4))
        self.head = json.loads(stream.read(n))
        if self.head["dictionary_sha256"] != hashlib.sha256(dictionary).hexdigest():
            raise ValueError("the file was written with another dictionary")
        d = self.head["documents"]
        index = zstandard.ZstdDecompressor().decompress(stream.read(self.head["index_bytes"]))
        self.doc_ids, self.counts = np.frombuffer(index, "<i8", d), np.frombuffer(index, "<u8", d, 8 * d)
        sizes = np.frombuffer(index, "<u8", d, 16 * d)
        self.offsets = 12 + n + self.head["index_bytes"] + np.concatenate([[0], np.cumsum(sizes, dtype="i8")])

    def doc_id(self, k: int) -> int | None:
        return None if self.doc_ids[k] == -(1 << 63) else int(self.doc_ids[k])

    def ids(self, k: int) -> bytes:
        self.stream.seek(int(self.offsets[k]))
        return self.codec.decompress(self.stream.read(int(self.offsets[k + 1] - self.offsets[k])), max_output_size=int(self.counts[k]) * 4)


def encode_frames(docs: DataFrame, path: str, dictionary: bytes, end: int = 0) -> DataFrame:
    """(doc_id, n, frame): each whole text's ids with ``end`` appended, compressed where the text was read."""

    def task(batches):
        import pyarrow as pa

        encoder, codec, tail = encoder_of(path), compressor(dictionary), struct.pack("<I", end)
        for batch in batches:
            raw = [encoder.encode(t or "") + tail for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(b) // 4 for b in raw], pa.int64()), pa.array([codec.compress(b) for b in raw], pa.binary())], ["doc_id", "n", "frame"])

    small_batches(docs.sparkSession, 500)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(task, "doc_id long, n long, frame binary")


def dictionary_path(folder: str, sha: str) -> str:
    return f"{folder}/{sha}.zdict"


def put_dictionary(folder: str, dictionary: bytes) -> str:
    """Write the dictionary below its hash, which is returned; an empty one needs no file."""
    sha = hashlib.sha256(dictionary).hexdigest()
    if dictionary:
        fs, to = filesystem(dictionary_path(folder, sha))
        fs.create_dir(to.rpartition("/")[0], recursive=True)
        with fs.open_output_stream(to, compression=None) as out:
            out.write(dictionary)
    return sha


@functools.lru_cache(4)
def get_dictionary(folder: str, sha: str) -> bytes:
    """The dictionary of that hash, as the store's folder has it."""
    if sha == hashlib.sha256(b"").hexdigest():
        return b""
    fs, path = filesystem(dictionary_path(folder, sha))
    with fs.open_input_stream(path, compression=None) as stream:
        dictionary = stream.read()
    if hashlib.sha256(dictionary).hexdigest() != sha:
        raise ValueError(f"{path} is not the dictionary of its name")
    return dictionary


FILES = "part long, nth long, file string, documents long, ids long, least_id long, most_id long, dictionary string"


def write_store(docs: DataFrame, path: str, folder: str, end: int = 0, file_docs: int = 8192) -> DataFrame:
    """Write ``docs`` (doc_id, text) in ascending doc_id order; returns the manifest, FILES.

    A row a file, ``part`` and ``nth`` being its place in the order. Null texts are empty
    documents; null ids come first, equal ids in the order of their ids' bytes. Ids are
    range-cut by quantiles of doc_id, so that the texts are encoded once and only frames
    are shuffled, a range to a task. An empty table gives no file; other columns are
    ignored. Each attempt writes files of its own; only those that the manifest names count.
    """
    import uuid

    dictionary = train_dictionary(docs, path, end=end)
    sha = put_dictionary(folder, dictionary)
    cuts = key_cuts(docs, "doc_id", file_docs)
    rows = encode_frames(docs, path, dictionary, end).withColumn("part", range_of(F.col("doc_id"), cuts).cast("long"))
    rows = rows.repartitionById(len(cuts) + 1, F.col("part").cast("int")).sortWithinPartitions("part", F.col("doc_id").asc_nulls_first(), "n", "frame")

    def task(batches):
        import pyarrow as pa

        fs, to = filesystem(folder)
        fs.create_dir(to, recursive=True)

        def put(part, rows):
            name = f"{uuid.uuid4().hex}.ldtk"
            with fs.open_output_stream(f"{to}/{name}", compression=None) as out:
                out.write(pack_file(rows, dictionary))
            known = [i for i, _, _ in rows if i is not None] or [None]
            row = (part, nth, name, len(rows), sum(n for _, n, _ in rows), known[0], known[-1], sha)
            return pa.RecordBatch.from_arrays([pa.array([x], pa.string() if isinstance(x, str) else pa.int64()) for x in row], [x.split()[0] for x in FILES.split(", ")])

        now, held, size, nth = None, [], 0, 0
        for part, doc_id, n, frame in arrow_rows(batches, "part", "doc_id", "n", "frame"):
            if held and (part != now or size > 64 << 20):
                yield put(now, held)
                held, size, nth = [], 0, nth + 1 if part == now else 0
            now = part
            held.append((doc_id, n, frame))
            size += len(frame)
        if held:
            yield put(now, held)

    rows.select("part", "doc_id", "n", "frame").mapInArrow(task, FILES).write.mode("overwrite").parquet(f"{folder}/manifest")
    return open_store(docs.sparkSession, folder)


def open_store(spark, folder: str) -> DataFrame:
    """The manifest of a store in a folder, by this or any other session."""
    return spark.read.schema(FILES).parquet(f"{folder}/manifest")


def starts(files: DataFrame) -> DataFrame:
    """files with ``first``: the ids in all files before. One row a file: its window is the list of files."""
    from pyspark.sql.window import Window as W

    before = W.orderBy("part", "nth").rowsBetween(W.unboundedPreceding, -1)
    return files.withColumn("first", F.coalesce(F.sum("ids").over(before), F.lit(0)))


def read_store(files: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document of a manifest's files, read back from them."""

    def task(batches):
        import numpy as np
        import pyarrow as pa

        fs, path = filesystem(folder)
        for name, first, sha in arrow_rows(batches, "file", "first", "dictionary"):
            with fs.open_input_file(f"{path}/{name}") as stream:
                reader = Reader(stream, get_dictionary(folder, sha))
                n = reader.head["documents"]
                at = first + np.concatenate([[0], np.cumsum(reader.counts[:-1], dtype="i8")])
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array([reader.doc_id(k) for k in range(n)], pa.int64()), "start": pa.array(at.astype("i8")),
                    "n_tokens": pa.array(reader.counts.astype("i8")), "ids_crc32": pa.array([zlib.crc32(reader.ids(k)) for k in range(n)], pa.int64()),
                })

    n = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return starts(files).repartition(n, "file").mapInArrow(task, "doc_id long, start long, n_tokens long, ids_crc32 long")


def fetch(spark, folder: str, doc_id: int) -> list[bytes]:
    """The ids of each document of that id: files whose range has it, then their index and a ranged read."""
    import numpy as np

    found = open_store(spark, folder).where((F.col("least_id") <= doc_id) & (F.col("most_id") >= doc_id)).orderBy("part", "nth")
    fs, path = filesystem(folder)
    out = []
    for r in found.select("file", "dictionary").toLocalIterator():
        with fs.open_input_file(f"{path}/{r.file}") as stream:
            reader = Reader(stream, get_dictionary(folder, r.dictionary))
            out += [reader.ids(int(k)) for k in np.flatnonzero(reader.doc_ids == doc_id)]
    return out


def store(docs: DataFrame, path: str, folder: str | None = None, end: int = 0) -> DataFrame:
    """Write the store of ``docs`` (doc_id, text) and read it back: (doc_id, start, n_tokens, ids_crc32) a row.

    Nulls, equal ids, repeated rows, empty tables and other columns as in write_store();
    a text of any length is one frame.
    """
    folder = folder or fresh_dir(docs.sparkSession, "tokens")
    return read_store(write_store(docs, path, folder, end), folder)
