"""Removal of repeated passages: shard Burrows-Wheeler transforms merged by interleave refinement."""

from __future__ import annotations

import functools

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lodestone.llm.common import filesystem, key_cuts, range_of, small_batches
from lodestone.plans.storage import Workspace, fresh_dir, materialize

#: Bytes of an anchor. A window of the given width has the anchor with the least hash within it.
GRAM = 32
#: Bytes that a symbol of the transforms spans.
SYMBOL = 4
#: Bytes of pieces merged in one task; of pieces of one key from which they are dealt by more of their bytes.
BUCKET, HOT = 1 << 19, 1 << 20
SHARDS = 4
#: Windows of a piece at most.
LONGEST = 4096
#: Repeated anchors are marked in a table of bits, which each worker holds, up to so many; joined by document beyond.
LISTED = 128 << 20
#: Bits for each of them, two of which are set; bits of the table at most (128 MB), and of the parts it is made in.
SPARSE, MARKS, PART = 16, 1 << 30, 1 << 23

_M1, _M2, _GOLD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


# Transforms -----------------------------------------------------------------


def symbols(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbol, piece number, offset) of each place of the pieces, which are rings: a symbol runs on at the start."""
    sizes = np.array([len(p) for p in pieces], np.int64)
    text = np.frombuffer(b"".join(pieces), np.uint8).astype(np.uint32)
    piece = np.repeat(np.arange(len(pieces)), sizes)
    offset = np.arange(len(text)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    base, size = np.arange(len(text)) - offset, sizes[piece]
    symbol = np.zeros(len(text), np.uint32)
    for i in range(SYMBOL):
        symbol = symbol << np.uint32(8) | text[base + (offset + i) % size]
    return symbol, piece, offset


def _ranks(high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Dense ranks of the pairs, and the places in their order."""
    n = len(high)
    bits = max(1, int(max(n, high.max(initial=0) + 1, low.max(initial=0) + 1) - 1).bit_length())
    if 3 * bits <= 64:
        key = np.sort(high.astype(np.uint64) << np.uint64(2 * bits) | low.astype(np.uint64) << np.uint64(bits) | np.arange(n, dtype=np.uint64))
        order = (key & np.uint64((1 << bits) - 1)).astype(np.int64)
        pair = key >> np.uint64(bits)
    else:
        order = np.lexsort((low, high))
        pair = high[order].astype(np.uint64) << np.uint64(32) | low[order].astype(np.uint64)
    rank = np.empty(n, np.int64)
    rank[order] = np.cumsum(np.concatenate([[False], pair[1:] != pair[:-1]])) if n else 0
    return rank, order


class Shard:
    """The sorted suffixes of some pieces, to ``width`` bytes, and their transform."""

    def __init__(self, pieces: list[bytes], width: int):
        symbol, self.piece, self.offset = symbols(pieces)
        base = np.arange(len(symbol)) - self.offset
        size = np.array([len(p) for p in pieces], np.int64)[self.piece]
        ahead = lambda k: base + (self.offset + k) % size
        rank, order = _ranks(symbol >> np.uint32(16), symbol & np.uint32(65535))
        known = SYMBOL
        while known < width:
            step = min(known, width - known)
            rank, order = _ranks(rank, rank[ahead(step)])
            known += step
        #: Places in suffix order, and before each the symbol that ends where it begins.
        self.order = order
        self.transform = symbol[ahead(-SYMBOL)][order]


def merge(shards: list[Shard], width: int) -> tuple[np.ndarray, np.ndarray]:
    """(interleave, separate): the shard of each suffix in the order of all, by ``width`` bytes, and
    whether a suffix differs in them from the one before.

    The interleave begins as the shards one after the other. A round deals the suffixes,
    as they stand, by the symbol before them: what was in order by k symbols is then in
    order by k + 1. Blocks of equal prefixes keep their place from round to round, so a
    new border's round is its common prefix. The shards' suffixes are never compared.
    """
    interleave = np.repeat(np.arange(len(shards), dtype=np.uint8), [len(s.order) for s in shards])
    n = len(interleave)
    transform = np.concatenate([s.transform for s in shards]).astype(np.uint64) << np.uint64(32)
    separate = np.zeros(n, bool)
    separate[:1] = True
    number = np.arange(n, dtype=np.uint64)
    for _ in range(width // SYMBOL):
        at = np.argsort(interleave, kind="stable")  # suffix k of the shards, one after the other, stands at at[k]
        before = np.empty(n, np.uint64)
        before[at] = transform
        key = np.sort(before | number)
        came = (key & np.uint64(0xFFFFFFFF)).astype(np.int64)
        block = np.cumsum(separate)[came]
        key >>= np.uint64(32)
        separate[1:] |= (key[1:] != key[:-1]) | (block[1:] != block[:-1])
        interleave = interleave[came]
    return interleave, separate


def repeated(pieces: list[bytes], place: np.ndarray, width: int) -> list[tuple[int, int, int]]:
    """(piece, first, last): runs of windows of the pieces of which another piece or place has an earlier copy.

    place: for each piece, where its first byte stands in the order of all text. Pieces
    are at least ``width`` bytes, which a multiple of SYMBOL is.
    """
    cut = np.linspace(0, len(pieces), min(SHARDS, len(pieces)) + 1).astype(int)
    shards = [Shard(pieces[a:b], width) for a, b in zip(cut, cut[1:], strict=False)]
    interleave, separate = merge(shards, width)
    at = np.argsort(interleave, kind="stable")
    piece, offset = np.empty(len(at), np.int64), np.empty(len(at), np.int64)
    piece[at] = np.concatenate([s.piece[s.order] + a for s, a in zip(shards, cut, strict=False)])
    offset[at] = np.concatenate([s.offset[s.order] for s in shards])
    size = np.array([len(p) for p in pieces], np.int64)
    # Suffixes that run over a piece's end are no windows.
    stands = np.where(offset + width <= size[piece], place[piece] + offset, np.int64((1 << 63) - 1))
    starts = np.flatnonzero(separate)
    first = np.repeat(np.minimum.reduceat(stands, starts), np.diff(np.append(starts, len(stands))))
    later = (stands != first) & (stands < (1 << 63) - 1)
    piece, offset = piece[later], offset[later]
    order = np.lexsort((offset, piece))
    piece, offset = piece[order], offset[order]
    if not len(piece):
        return []
    new = np.flatnonzero(np.concatenate([[True], (piece[1:] != piece[:-1]) | (offset[1:] != offset[:-1] + 1)]))
    last = np.append(new[1:], len(piece)) - 1
    return list(zip(piece[new].tolist(), offset[new].tolist(), offset[last].tolist(), strict=True))


# Pieces ---------------------------------------------------------------------


def grams(text: bytes) -> np.ndarray:
    """Hashes of the text's runs of GRAM bytes."""
    h, power, size = np.frombuffer(text, np.uint8).astype(np.uint64) + np.uint64(1), int(_GOLD), 1
    while size < GRAM:
        h = h[:-size] * np.uint64(power) + h[size:]
        power, size = power * power % (1 << 64), 2 * size
    h = (h ^ (h >> np.uint64(30))) * _M1
    h = (h ^ (h >> np.uint64(27))) * _M2
    return h ^ (h >> np.uint64(31))


def _over(x: np.ndarray, n: int, pick) -> np.ndarray:
    """pick (minimum or maximum) of each n neighbours."""
    size = 1
    while 2 * size <= n:
        x, size = pick(x[:-size], x[size:]), 2 * size
    return pick(x[: len(x) - (n - size)], x[n - size :]) if size < n else x


def anchors(text: bytes, width: int) -> np.ndarray:
    """Hashes of the anchors of the text's windows, each place of an anchor once."""
    if len(text) < width:
        return np.zeros(0, np.uint64)
    h, n = grams(text), width - GRAM + 1
    rim = np.zeros(n - 1, np.uint64)
    # A place is an anchor's if the greatest of the least hashes of the windows over it is its own.
    return h[_over(np.concatenate([rim, _over(h, n, np.minimum), rim]), n, np.maximum) == h]


def runs(text: bytes, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first window, windows) of the runs of windows whose least gram hash is the same.

    Equal windows have equal anchors wherever they stand.
    """
    if len(text) < width:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    least = _over(grams(text), width - GRAM + 1, np.minimum)
    start = np.concatenate([[0], np.flatnonzero(least[1:] != least[:-1]) + 1])
    length = np.diff(np.append(start, len(least)))
    if length.max() > LONGEST:
        cuts = [np.arange(a, a + k, LONGEST) for a, k in zip(start, length, strict=True)]
        start = np.concatenate(cuts)
        length = np.diff(np.append(start, len(least)))
    return least[start], start, length


PIECES = "doc long, start long, size int, key long, d1 long, d2 long, piece binary, core int, core_end int, spots int"


class _Pieces:
    """Rows of PIECES; bytes only where this task has not had them yet."""

    def __init__(self):
        self.had: set[bytes] = set()
        self.rows: list[list] = [[] for _ in range(9)]

    def add(self, doc, start, piece: bytes, key: int, core: int, core_end: int) -> None:
        import xxhash

        d = xxhash.xxh128_digest(piece, seed=core_end - core + 1)
        new = d not in self.had
        self.had.add(d)
        for column, x in zip(self.rows, (doc, start, len(piece), key, int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True), piece if new else None, core, core_end), strict=True):
            column.append(x)

    def spots(self) -> list[int | None]:
        """How often its anchor stands in each new piece; 2 for pieces of other keys."""
        keys, pieces, cores = self.rows[3], self.rows[6], self.rows[7]
        new = [i for i, p in enumerate(pieces) if p is not None]
        out: list[int | None] = [None] * len(pieces)
        if new:
            size = np.array([len(pieces[i]) for i in new])
            h = grams(b"".join([pieces[i] for i in new])).view(np.int64)
            own = np.repeat(np.array([keys[i] for i in new], np.int64), size)[: len(h)] == h
            ends = np.cumsum(size)
            for k in range(1, GRAM):  # runs over a piece's end
                own[(ends - k)[ends - k < len(own)]] = False
            count = np.add.reduceat(np.append(own, False).astype(np.int64), ends - size)
            for i, n in zip(new, count.tolist(), strict=True):
                out[i] = n if cores[i] < 0 else 2
        return out

    def batch(self):
        import pyarrow as pa

        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.int32()]
        out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip([*self.rows, self.spots()], kinds, strict=True)], [x.split()[0] for x in PIECES.split(", ")])
        self.rows = [[] for _ in range(9)]
        return out


def _marks(keys: np.ndarray, bits: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(part, first, second): the two bits of each key in a table of ``bits``, in parts of ``size``, both powers of two; they are in one part."""
    x = keys.view(np.uint64) * _GOLD
    x = (x ^ (x >> np.uint64(29))) * _M1
    x ^= x >> np.uint64(32)
    low, wide = np.uint64(size - 1), np.uint64(size.bit_length() - 1)
    y = (x * _M2) >> np.uint64(64 - int(wide))
    return ((x >> wide) & np.uint64(bits // size - 1)).astype(np.int64), (x & low).astype(np.int64), y.astype(np.int64)


def _mark(places: DataFrame, total: int) -> tuple[str, int, int]:
    """(folder, bits, size): the written table of bits of the ``total`` anchors of places (key), a row for each part of ``size``."""
    spark = places.sparkSession
    bits = min(MARKS, 1 << max(10, (SPARSE * total - 1).bit_length()))
    size = min(bits, PART)

    def deal(batches):
        import pyarrow as pa

        for batch in batches:
            part, first, second = _marks(batch.column("key").to_numpy(), bits, size)
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(first.astype(np.int32)), pa.array(second.astype(np.int32))], ["part", "first", "second"])

    def fill(table):
        import pyarrow as pa

        own = np.zeros(size, bool)
        own[table.column("first").to_numpy()] = own[table.column("second").to_numpy()] = True
        return pa.table({"part": table.column("part").slice(0, 1), "bits": pa.array([np.packbits(own, bitorder="little").tobytes()], pa.binary())})

    folder = fresh_dir(spark, "suffix-marks")
    rows = places.mapInArrow(deal, "part long, first int, second int")
    rows.groupBy("part").applyInArrow(fill, "part long, bits binary").write.parquet(folder)
    return folder, bits, size


@functools.lru_cache(1)
def _marked(folder: str, bits: int, size: int) -> np.ndarray:
    import pyarrow.parquet as pq
    from pyarrow import fs as pafs

    fs, path = filesystem(folder)
    out = np.zeros(bits // 8, np.uint8)
    for f in fs.get_file_info(pafs.FileSelector(path)):
        if f.path.endswith(".parquet"):
            with fs.open_input_file(f.path) as stream:
                for batch in pq.ParquetFile(stream).iter_batches(8):
                    for part, own in zip(batch.column("part").to_pylist(), batch.column("bits").to_pylist(), strict=True):
                        out[part * size // 8 : (part + 1) * size // 8] = np.frombuffer(own, np.uint8)
    return out


def _probably(x: np.ndarray, folder: str, bits: int, size: int) -> np.ndarray:
    """Whether both bits of each key are set: of all keys that were marked, and of few others."""
    known = _marked(folder, bits, size)
    part, first, second = _marks(x, bits, size)
    first, second = part * size + first, part * size + second
    return (known[first >> 3] >> (first & 7) & known[second >> 3] >> (second & 7) & 1).astype(bool)


def _among(x: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(x), bool)
    return known[np.minimum(np.searchsorted(known, x), len(known) - 1)] == x


def candidate_pieces(docs: DataFrame, width: int) -> DataFrame:
    """PIECES of (doc, text): the runs of windows whose anchor stands in another place too.

    A window whose anchor stands nowhere else is no copy of anything, so nothing else is
    left out. Anchors are counted in each batch before they are shuffled. The bits that
    mark the repeated ones let a few of the others pass, whose pieces are found alone.
    """
    spark = docs.sparkSession
    small_batches(spark, 2000)

    def count(batches):
        import pyarrow as pa

        for batch in batches:
            found = [anchors((t or "").encode(), width) for t in batch.column("text").to_pylist()]
            key, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *found]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n.astype(np.int64))], ["key", "n"])

    places = docs.select("text").mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where("n > 1")
    folder = fresh_dir(spark, "suffix-anchors")
    places.select("key").write.parquet(folder)
    places = spark.read.schema("key long").parquet(folder)

    def cut(batches, is_known):
        for batch in batches:
            out = _Pieces()
            texts = batch.column("text").to_pylist()
            for i, (doc, text) in enumerate(zip(batch.column("doc").to_pylist(), texts, strict=True)):
                raw = (text or "").encode()
                key, start, n = runs(raw, width)
                key = key.view(np.int64)
                for j in np.flatnonzero(is_known(key, batch, i)).tolist():
                    a = int(start[j])
                    out.add(doc, a, raw[a : a + int(n[j]) + width - 1], int(key[j]), -1, -1)
            yield out.batch()

    total = places.count()
    if total <= LISTED:
        marks = _mark(places, total)
        task = lambda batches: cut(batches, lambda key, batch, i: _probably(key, *marks))
        return docs.select("doc", "text").mapInArrow(task, PIECES)

    def pairs(batches):
        import pyarrow as pa

        for batch in batches:
            keys = [np.unique(runs((t or "").encode(), width)[0]).view(np.int64) for t in batch.column("text").to_pylist()]
            doc = np.repeat(batch.column("doc").to_numpy(), [len(k) for k in keys])
            yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array(np.concatenate([np.zeros(0, np.int64), *keys]))], ["doc", "key"])

    small_batches(spark, 500)
    own = docs.select("doc", "text").mapInArrow(pairs, "doc long, key long").join(places, "key", "left_semi")
    own = own.groupBy("doc").agg(F.array_sort(F.collect_list("key")).alias("keys"))
    task = lambda batches: cut(batches, lambda key, batch, i: _among(key, np.array(batch.column("keys")[i].as_py(), np.int64)))
    return docs.select("doc", "text").join(own, "doc").mapInArrow(task, PIECES)


def divide(pieces: DataFrame, width: int) -> DataFrame:
    """PIECES of pieces of hot keys, dealt by more of their bytes.

    The windows of a piece share a core: the anchor at first. A window reaches beyond it
    by half of what it lacks on one side at least, which side first being a matter of its
    content; the core and those bytes are the new key.
    """

    def task(batches):
        import xxhash

        for batch in batches:
            out = _Pieces()
            for doc, start, piece, key, core, core_end in zip(*(batch.column(c).to_pylist() for c in ("doc", "start", "piece", "key", "core", "core_end")), strict=True):
                last = len(piece) - width
                if core < 0:  # windows by the leftmost anchor in them
                    spots = np.flatnonzero(grams(piece).view(np.int64) == key)
                    lows = [0, *(int(a) + 1 for a in spots[:-1])]
                    parts = [(lo, min(int(a), last), int(a), int(a) + GRAM) for lo, a in zip(lows, spots, strict=True)]
                else:
                    parts = [(0, last, core, core_end)]
                for lo, hi, c, e in parts:
                    lack = width - (e - c)
                    right = (lack + 1) // 2
                    left = lack - right + 1
                    turn = e + right - width  # windows from here on reach right beyond the core
                    for a, b, c2, e2 in ((lo, min(hi, turn - 1), c - left, e), (max(lo, turn), hi, c, e + right)):
                        if a <= b:
                            deep = xxhash.xxh64_intdigest(piece[c2:e2], seed=e2 - c2)
                            out.add(doc, start + a, piece[a : b + width], deep - (1 << 64) if deep >> 63 else deep, c2 - a, e2 - a)
            yield out.batch()

    return pieces.mapInArrow(task, PIECES)


def repeats(docs: DataFrame, width: int = 100) -> DataFrame:
    """(doc, spans): ranges (a, b) of bytes of (doc, text) that windows with an earlier copy cover.

    Equal pieces come together first, the earliest standing for all: the others are
    copies whole. The different pieces of a key go to one task, which merges the
    transforms of their shards. Keys with more bytes than a task should hold are divided
    by more of their content, again and again if need be; a key is a whole window in the
    end, of which there is one piece.
    """
    if width % SYMBOL or width < 2 * GRAM:
        raise ValueError(f"width must be a multiple of {SYMBOL}, {2 * GRAM} at least")
    work = Workspace(docs.sparkSession)
    try:
        return materialize(_repeats(docs, width, work), "suffix-spans")
    finally:
        work.close()


def _repeats(docs: DataFrame, width: int, work: Workspace) -> DataFrame:
    small_batches(docs.sparkSession, 500)
    pieces = work.keep(candidate_pieces(docs, width), "suffix-pieces")
    found = []
    while True:
        unique = pieces.groupBy("d1", "d2").agg(
            F.min(F.struct("doc", "start")).alias("first"), F.count("*").alias("n"), F.max("piece").alias("piece"), F.min("key").alias("key"), F.min("core").alias("core"), F.min("core_end").alias("core_end"), F.max("spots").alias("spots"),
            F.max("size").cast("long").alias("bytes"),
        )
        unique = work.keep(unique.select("d1", "d2", "first.*", "n", "piece", "key", "core", "core_end", "spots", "bytes"), "suffix-unique")
        firsts = unique.where("n > 1").select("d1", "d2", F.col("doc").alias("d"), F.col("start").alias("s"))
        later = pieces.join(firsts, ["d1", "d2"]).where("doc <> d or start <> s")
        found.append(later.select("doc", F.col("start").alias("a"), (F.col("start") + F.col("size")).alias("b")))
        # A piece alone under its key, with one anchor in it, has no window twice.
        weights = unique.groupBy("key").agg(F.sum("bytes").alias("bytes"), F.count("*").alias("n"), F.max("spots").alias("most"))
        weights = work.keep(weights.where("n > 1 or most > 1").select("key", (F.col("bytes") > HOT).alias("hot"), "n", "bytes"), "suffix-keys")
        hot = weights.where("hot and n > 1").select("key")
        columns = ["doc", "start", "piece", "key", "core", "core_end"]
        cold = weights.where("not hot or n = 1")
        total = cold.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
        found.append(_merged(unique.select(*columns).join(cold.select("key"), "key", "left_semi"), total, width))
        if hot.isEmpty():
            break
        pieces = work.keep(divide(unique.select(*columns).join(hot, "key", "left_semi").select(*columns), width), "suffix-pieces")
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("a", "b"))).alias("spans"))


def _merged(pieces: DataFrame, total: int, width: int) -> DataFrame:
    """(doc, a, b) of the windows of the pieces, ``total`` bytes, that the merged transforms show to have an earlier copy."""
    buckets = max(1, -(-total // BUCKET))
    rows = pieces.select("doc", "start", "piece", F.pmod(F.xxhash64("key"), F.lit(buckets)).alias("bucket"))

    def task(table):
        import pyarrow as pa

        doc, start = table.column("doc").to_numpy(), table.column("start").to_numpy()
        order = np.lexsort((start, doc))
        doc, start = doc[order], start[order]
        texts = table.column("piece").to_pylist()
        texts = [texts[i] for i in order]
        rank = np.cumsum(np.concatenate([[0], doc[1:] != doc[:-1]])) if len(doc) else doc
        got = repeated(texts, (rank << 40) + start, width)
        return pa.Table.from_pydict({
            "doc": pa.array([doc[p] for p, _, _ in got], pa.int64()), "a": pa.array([int(start[p]) + i for p, i, _ in got], pa.int64()),
            "b": pa.array([int(start[p]) + j + width for p, _, j in got], pa.int64()),
        })

    return rows.groupBy("bucket").applyInArrow(task, "doc long, a long, b long")


def _numbered(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(docs with ``doc``, copies): a number a row in the order of all text.

    It is the id where ids are there and no two rows share one. Else it is the place in
    the order of id (null last) and text's digest; rows equal in both are numbered once,
    the others, copies whole, come back apart.
    """
    odd = docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 or doc_id is null")
    if odd.isEmpty():
        return docs.withColumn("doc", F.col("doc_id")), docs.where("false")
    docs = docs.withColumn("digest", F.md5("text"))
    rows = docs.groupBy("doc_id", "digest").agg(F.count("*").alias("n"))
    rows = materialize(rows.withColumn("range", F.when(F.col("doc_id").isNull(), F.lit(1 << 40)).otherwise(range_of(F.col("doc_id"), key_cuts(docs, "doc_id", 50_000)))), "suffix-rows")
    base = rows.groupBy("range").agg(F.count("*").alias("k"))
    base = base.select("range", F.coalesce(F.sum("k").over(W.orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    place = F.row_number().over(W.partitionBy("range").orderBy("doc_id", "digest")) - 1
    numbers = rows.withColumn("place", place).join(base, "range").select("doc_id", "digest", "n", (F.col("place") + F.col("base")).alias("doc"))
    joined = docs.dropDuplicates(["doc_id", "digest"]).alias("x").join(numbers.alias("y"), F.col("x.doc_id").eqNullSafe(F.col("y.doc_id")) & (F.col("x.digest") == F.col("y.digest")))
    joined = materialize(joined.select("x.doc_id", "x.text", "y.doc", "y.n"), "suffix-docs")
    copies = joined.where("n > 1").select("doc_id", "text", F.explode(F.sequence(F.lit(2), F.col("n"))).alias("copy")).drop("copy")
    return joined.drop("n"), copies


def dedup(docs: DataFrame, width: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept): each whole text without the bytes of its repeated windows.

    A byte goes if some ``width`` bytes over it also start earlier: in a document of
    smaller id, or in the same one. Null texts are empty; texts below the width lose
    nothing. Rows without id come last, rows of one id by their text's digest; of equal
    rows one is the earliest. Empty tables give no rows; other columns are ignored.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    docs, copies = _numbered(docs)
    rows = docs.join(repeats(docs, width), "doc", "left").select("doc_id", "text", "spans")
    whole = F.array(F.struct(F.lit(0).cast("long").alias("a"), F.octet_length("text").cast("long").alias("b")))
    rows = rows.unionByName(copies.select("doc_id", "text", F.when(F.octet_length("text") >= width, whole).alias("spans")))

    def task(batches):
        import pyarrow as pa

        for batch in batches:
            out = [[], [], [], []]
            for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                raw = text.encode()
                joined: list[list[int]] = []
                for a, b in sorted((s["a"], s["b"]) for s in spans or ()):
                    if joined and a <= joined[-1][1]:
                        joined[-1][1] = max(b, joined[-1][1])
                    else:
                        joined.append([a, b])
                ends = [0, *(x for ab in joined for x in ab), len(raw)]
                kept = b"".join([raw[ends[i] : ends[i + 1]] for i in range(0, len(ends), 2)])
                for column, x in zip(out, (len(raw), len(raw) - len(kept), len(joined), kept), strict=True):
                    column.append(x)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    small_batches(docs.sparkSession, 500)
    return rows.mapInArrow(task, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def digests(docs: DataFrame, width: int = 100) -> DataFrame:
    """dedup() with the SHA-256 of the remaining bytes in their place."""
    return dedup(docs, width).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


