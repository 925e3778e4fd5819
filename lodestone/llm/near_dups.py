"""Near-duplicate documents by Order MinHash, verified by banded alignment."""

from __future__ import annotations

import functools
import re
from collections import Counter

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lodestone.llm.common import small_batches
from lodestone.plans.storage import materialize

#: Words of a shingle, and the likeness of two documents that are near copies: one less edits by words of the longer.
SHINGLE, LIKENESS = 5, 0.8
#: Shingle likeness below which two texts are not aligned: that of texts with a tenth of their words changed is 0.4.
LOOSE = 0.3
#: What _across() asks for unless it is told; classes() has it ask for LOOSE.
ACROSS = 0.5
#: Sketches (number, k-mers of each, fewest and most shingles of the texts that get them). Texts with a
#: tenth of their words changed share one with chance 0.95, with a twentieth, or a fifth in one place, 0.999 and more.
FAMILIES = ((40, 3, 50, 1 << 62), (16, 2, 16, 64), (16, 1, 0, 24))
#: Longer ones for texts left in buckets of several classes, which less alike texts rarely share: texts with a
#: shingle likeness of 0.8 miss each other with a chance below 1 in 10 million, with 0.63 in a tenth of the cases.
FINER = ((96, 8, 50, 1 << 62), (32, 4, 16, 64), (20, 3, 0, 20))
#: Hash table cells of one step of sketching, which bounds its memory for long texts.
CELLS = 1 << 19
#: Members of a bucket that are compared in one task.
BLOCK = 512
#: Rows of small buckets that are compared in one task; columns of a step of counting what sets share.
BUNDLE, COLUMNS = 2000, 4096
#: Tables of a few numbers a row are joined by broadcast up to so many rows (64 bytes each at most), by a shuffle beyond.
BROADCAST_ROWS = 250_000

WORD = re.compile(r"\w+").findall
_M1, _M2, _GOLD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), 0x9E3779B97F4A7C15


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _odd(n: int, salt: int) -> np.ndarray:
    return _mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(_GOLD) + np.uint64(salt)) | np.uint64(1)


@functools.lru_cache(1)
def _words():
    import xxhash

    class Known(dict):
        def __missing__(self, w):
            if len(self) > 1 << 18:
                self.clear()
            self[w] = h = xxhash.xxh64_intdigest(w)
            return h

    return Known().__getitem__


def shingles(text: str) -> np.ndarray:
    """Hashes of the text's runs of SHINGLE words in order; a shorter text is one shingle, one without words is itself."""
    words = WORD(text.lower())
    w = np.fromiter(map(_words(), words or [text]), np.uint64, max(1, len(words)))
    if len(w) < SHINGLE:
        w = np.concatenate([w, np.zeros(SHINGLE - len(w), np.uint64)])
    n = len(w) - SHINGLE + 1
    return _mix(sum(w[i : i + n] * m for i, m in enumerate(_odd(SHINGLE, 7))))


def occurrences(s: np.ndarray) -> np.ndarray:
    """How many equal shingles come before each."""
    order = np.argsort(s, kind="stable")
    t = s[order]
    first = np.concatenate([[True], t[1:] != t[:-1]]) if len(t) else np.zeros(0, bool)
    at = np.arange(len(t))
    out = np.empty(len(t), np.int64)
    out[order] = at - np.maximum.accumulate(np.where(first, at, 0))
    return out


def sketches(text: str, families=FAMILIES) -> list[int]:
    """Order MinHash keys: for each order, the least occurrence-labelled shingles, in text order, as one hash."""
    s = shingles(text)
    labelled = _mix(s + occurrences(s).astype(np.uint64) * np.uint64(_GOLD))
    keys = []
    for family, (number, take, fewest, most) in enumerate(families):
        if not fewest <= len(s) <= most:
            continue
        take = min(take, len(s))
        weights, spread = _odd(take, 99), _odd(number, 1000 + family)
        step = max(1, CELLS // len(s))
        for a in range(0, number, step):
            v = labelled * spread[a : a + step, None]
            row, least = np.arange(len(v)), np.empty((len(v), take), np.int64)
            for k in range(take):
                least[:, k] = at = v.argmin(1)
                v[row, at] = np.uint64((1 << 64) - 1)
            least.sort(1)
            own = (s[least] * weights).sum(1) + (row + family * 128 + a).astype(np.uint64)
            keys += _mix(own).view(np.int64).tolist()
    return keys


def _common(a: str, i: int, b: str, j: int) -> int:
    """Length of the longest common run from a[i] and b[j] on."""
    step, n = 8, 0
    most = min(len(a) - i, len(b) - j)
    while n < most:
        if a[i + n : i + n + step] == b[j + n : j + n + step] and n + step <= most:
            n += step
            step *= 2
        elif step > 1:
            step //= 2
        elif a[i + n] != b[j + n]:
            break
        else:
            n += 1
    return n


def diagonals(a: str, b: str, most: int) -> int | None:
    """Edit distance by the furthest reach of each diagonal, in a band that widens with the edits: for few of them."""
    n, m = len(a), len(b)
    reach = {0: _common(a, 0, b, 0)}  # diagonal (j - i) -> furthest i
    if reach[0] == n == m:
        return 0
    for d in range(1, most + 1):
        after = {}
        for k in range(max(-d, -n), min(d, m) + 1):
            i = max(reach.get(k - 1, -1), reach.get(k, -2) + 1, reach.get(k + 1, -2) + 1)
            if i < 0 or i > n or i + k > m or i + k < 0:
                i = min(i, n, m - k)
                if i < max(0, -k):
                    continue
            i += _common(a, i, b, i + k)
            if i == n and i + k == m:
                return d
            after[k] = i
        reach = after
    return None


def banded(a: str, b: str, most: int) -> int | None:
    """Edit distance within a band of ``most`` on either side of the diagonal, None above it.

    Column by column, the band's vertical differences are two bit vectors (plus and
    minus one), which move down a row with the diagonal. Cells outside the band count
    as one more than their neighbours, which no path of ``most`` edits needs.
    """
    if len(a) > len(b):
        a, b = b, a
    n, m = len(a), len(b)
    if m - n > most:
        return None
    places: dict[str, int] = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    full = (1 << (2 * most + 1)) - 1
    plus, minus, found = full ^ ((1 << most) - 1), 0, 0
    for j in range(1, m + 1):
        up = j - most - 1
        same = places.get(b[j - 1], 0)
        same = (same >> up if up >= 0 else same << -up) & full
        level = ((((same & plus) + plus) ^ plus) | same | minus) & full  # as the cell before on the diagonal
        right = minus | (full ^ (level | plus))
        left = level & plus
        if j <= n:
            found += not level >> most & 1
            if found > most + m - n:
                return None
        else:
            at = n - j + most
            found += (right >> at & 1) - (left >> at & 1)
        plus = left | (full ^ (level >> 1 | right))
        minus = level >> 1 & right
    return found if found <= most else None


def distance(a: str, b: str, most: int) -> int | None:
    """Edit distance by alignment in a band about the diagonal that widens with the edits, None above ``most``."""
    k = _common(a, 0, b, 0)
    a, b = a[k:], b[k:]
    k = _common(a[::-1], 0, b[::-1], 0)
    a, b = a[: len(a) - k], b[: len(b) - k]
    if not a or not b:
        d = max(len(a), len(b))
        return d if d <= most else None
    if abs(len(a) - len(b)) > most:
        return None
    d, width = diagonals(a, b, min(most, 8)), 8
    while d is None and width < most:
        width = min(most, width * 6)
        d = banded(a, b, width)
    return d


class Text:
    """A text's words as letters of one alphabet, and its shingles."""

    def __init__(self, text: str):
        self.words = WORD(text.lower()) or [text]

    def letters(self, alphabet: dict[str, str]) -> str:
        return "".join([alphabet.setdefault(w, chr(32 + len(alphabet) if len(alphabet) < 0xD000 else 0x800 + 32 + len(alphabet))) for w in self.words])


def near(a: Text, b: Text) -> bool:
    """Whether the texts are alike in order: by alignment, edits of a fifth of the longer's words at most.

    Equal words are; texts below SHINGLE words need them. Texts with too few words in
    common for that, or with a shingle likeness below LOOSE, are not aligned.
    """
    alphabet: dict[str, str] = {}
    x, y = a.letters(alphabet), b.letters(alphabet)
    if x == y:
        return True
    longer = max(len(x), len(y))
    if min(len(x), len(y)) < max(SHINGLE, LIKENESS * longer):
        return False
    p, q = ({t[i : i + SHINGLE] for i in range(len(t) - SHINGLE + 1)} for t in (x, y))
    both = len(p & q)
    if both < LOOSE * (len(p) + len(q) - both):
        return False
    if sum((Counter(x) & Counter(y)).values()) < LIKENESS * longer - 1e-9:
        return False
    return distance(x, y, int((1 - LIKENESS) * longer + 1e-9)) is not None


def _node(id_col: Column, text: Column) -> Column:
    """A row's id; without one, a negative number from its text."""
    return F.coalesce(id_col.cast("long"), -F.abs(F.xxhash64(text).bitwiseAND(F.lit((1 << 62) - 1))) - 1)


def bag(text: str) -> np.ndarray:
    """Hashes of the text's words, each with how many equal ones come before it, in 32 bits."""
    words = WORD(text.lower()) or [text]
    w = np.fromiter(map(_words(), words), np.uint64, len(words))
    return np.unique(_mix(w + occurrences(w).astype(np.uint64) * np.uint64(_GOLD)).astype(np.uint32)).view(np.int32)


def sketch(docs: DataFrame, families=FAMILIES, with_grams: bool = False) -> DataFrame:
    """(node, print, keys, grams, bag) of each row of (doc_id, text); grams: the distinct shingles, in 32 bits, and the bag if asked for."""

    def task(batches):
        import pyarrow as pa

        for batch in batches:
            texts = batch.column("text").to_pylist()
            keys = [sketches(t, families) for t in texts]
            grams = [np.unique(shingles(t).astype(np.uint32)).view(np.int32) for t in texts] if with_grams else [None] * len(texts)
            bags = [bag(t) for t in texts] if with_grams else grams
            yield pa.RecordBatch.from_arrays(
                [batch.column("node"), batch.column("print"), pa.array(keys, pa.list_(pa.int64())), *(pa.array(x, pa.list_(pa.int32())) for x in (grams, bags))], ["node", "print", "keys", "grams", "bag"]
            )

    small_batches(docs.sparkSession, 500)
    rows = docs.select(_node(F.col("doc_id"), F.col("text")).alias("node"), F.md5("text").alias("print"), "text")
    return rows.mapInArrow(task, "node long, print string, keys array<long>, grams array<int>, bag array<int>")


def _small(df: DataFrame) -> DataFrame:
    """A written table, to be broadcast if it is small."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _texts(nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """(node, doc_id, text) of the rows of the nodes."""
    nodes = _small(materialize(nodes.distinct(), "near-nodes"))
    return docs.select(_node(F.col("doc_id"), F.col("text")).alias("node"), "doc_id", "text").join(nodes, "node", "left_semi")


def verify(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes whose texts are near copies; of repeated rows of docs, repeatedly.

    ``pairs`` is a written table. Only its texts move: with a small one, a's once a pair
    and b's once; else once for a, and once with a's for b.
    """
    if pairs.isEmpty():
        return pairs.select("a", "b")
    texts, known = docs.select(_node(F.col("doc_id"), F.col("text")).alias("node"), "text"), pairs
    if pairs.count() <= BROADCAST_ROWS:
        known = F.broadcast(pairs)
        ends = texts.join(F.broadcast(pairs.select(F.col("b").alias("node"))), "node", "left_semi")
    else:
        texts = ends = _texts(pairs.select(F.explode(F.array("a", "b")).alias("node")), docs).select("node", "text")

    def task(batches):
        import pyarrow as pa

        kept = functools.lru_cache(64)(Text)
        for batch in batches:
            x, y = batch.column("x").to_pylist(), batch.column("y").to_pylist()
            ok = [near(Text(p), kept(q)) for p, q in zip(x, y, strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    small_batches(docs.sparkSession, 100)
    rows = texts.withColumnsRenamed({"node": "a", "text": "x"}).join(known, "a").join(ends.withColumnsRenamed({"node": "b", "text": "y"}), "b")
    return materialize(rows.select("a", "b", "x", "y").mapInArrow(task, "a long, b long"), "near-links")


def met(rows: DataFrame, other: DataFrame, key: str, spread: str, tasks: int = 8) -> DataFrame:
    """rows joined to ``other``, which has one row a key: the rows of a key are dealt over ``tasks`` parts by ``spread``."""
    part = F.pmod(F.xxhash64(spread), F.lit(tasks))
    copies = other.withColumn("__part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(tasks - 1).cast("long"))))
    return rows.withColumn("__part", part).join(copies, [key, "__part"]).drop("__part")


def components(links: DataFrame) -> DataFrame:
    """(node, label) of the nodes of links (a, b), a written table: label is the least node that links lead to.

    Each round takes the least label of the neighbours and then that label's own; the
    labels are written to the shared folder between rounds. Links may be repeated.
    """
    both = links.select("a", "b").union(links.select("b", "a")).where("a <> b")
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).select("node", F.least("node", "b").alias("label")), "near-labels")
    while True:
        known = _small(labels)
        near_ = both.join(known.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        step = near_.join(known, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = step.alias("s").join(known.alias("l"), F.col("s.label") == F.col("l.node"), "left")
        after = materialize(jump.select("s.node", "s.old", F.least("s.label", F.coalesce("l.label", "s.label")).alias("label")), "near-labels")
        changed = not after.where("old <> label").isEmpty()
        labels = after.select("node", "label")
        if not changed:
            return labels


def joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """components() of the links behind ``labels`` and of further ones: the classes that these join are linked, not their nodes."""
    between = materialize(_labelled_pairs(links, labels).select(F.col("a_label").alias("a"), F.col("b_label").alias("b")), "near-between")
    if between.isEmpty():
        return labels
    after = _small(components(between))
    moved = labels.alias("l").join(after.alias("n"), F.col("l.label") == F.col("n.node"), "left")
    new = after.join(_small(labels).select("node"), "node", "left_anti").select("node", "label")
    return materialize(moved.select("l.node", F.coalesce("n.label", "l.label").alias("label")).union(new), "near-labels")


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, class_id): class_id is the least id of the row's group of near copies, itself if it has none.

    Equal texts (null counts as empty) are one class before any are compared, and so are
    rows of equal id. Of different texts those that share a sketch are candidates, which
    near() decides:

    1. each against the most central of its bucket (the text whose buckets hold most,
       which an original is to its copies), the best of them first and the others if that
       leaves the two apart, so that a group costs about a pair a member, whatever its size;
    2. texts of buckets that still hold several classes get longer sketches, by which
       they are compared in the same way;
    3. all pairs of different classes that still share a sketch, of these or the longer
       ones, but those whose words or shingles in common are too few for near().

    No bucket is capped; a bucket beyond BLOCK members is compared in blocks. Texts of
    fewer than five words are near copies if their words are equal; texts without words
    if they are equal. Texts of any length are taken whole. Rows without id get the class
    of their text, null if no row of it has an id. Empty tables give no rows; other
    columns are ignored.
    """
    found = _labelled(docs, id_col, text_col)
    doc_id = F.when(F.col("node") >= 0, F.col("node")).alias("doc_id")
    # The label is the class's least id, but where a row without id, whose node is negative, is of the class.
    bare = found.where("label < 0")
    out = found.where("label >= 0").select(doc_id, F.col("label").alias("class_id"))
    if bare.isEmpty():
        return out
    heads = bare.groupBy("label").agg(F.min(F.when(F.col("node") >= 0, F.col("node"))).alias("class_id"))
    return out.union(met(bare, heads, "label", "node").select(doc_id, "class_id"))


def _labelled(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(node, print, label), one row a row of docs: print is the text's digest, label its class's."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = materialize(sketch(docs), "near-sketches")
    least = F.coalesce(F.min(F.when(F.col("node") >= 0, F.col("node"))), F.min("node"))
    firsts = materialize(rows.groupBy("print").agg(least.alias("first"), F.first("keys").alias("keys")), "near-firsts")
    again = rows.groupBy("node").agg(F.count("*").alias("n"), F.min("print").alias("lo"), F.max("print").alias("hi")).where("n > 1")
    again = materialize(again.select("node", (F.col("lo") < F.col("hi")).alias("several")), "near-again")
    once = again.isEmpty()
    shared = _shared(_keyed(firsts.select(F.col("first").alias("node"), "keys"), once))

    links, tried = _linked_to_heads(_to_heads(shared), docs)
    if not once:
        # Rows of one id and several texts are one document: their texts' nodes are linked.
        same = rows.select("node", "print").join(_small(again).where("several"), "node").join(firsts.select("print", "first"), "print")
        links = materialize(links.union(same.select(F.col("first").alias("a"), F.col("node").alias("b"))), "near-all-links")
    labels = components(links)
    open_ = _open(shared, labels)
    if not open_.isEmpty():
        texts = materialize(sketch(_texts(open_.select("node"), docs).select("doc_id", "text"), FINER, with_grams=True), "near-finer")
        finer = _shared(_keyed(texts, once))
        steps = ((finer, lambda x: _to_heads(x).select("a", "b")), (shared.union(finer), lambda x: _across(_unlike(x), texts, LOOSE)))
        for buckets, pairs_of in steps:
            open_ = _open(buckets, labels)
            if open_.isEmpty():
                continue
            pairs = pairs_of(open_).join(_small(tried), ["a", "b"], "left_anti")
            pairs = materialize(_labelled_pairs(pairs, labels).select("a", "b"), "near-pairs")
            more = verify(pairs, docs)
            tried = tried.union(pairs)
            labels = joined(labels, more)

    kinds = firsts.select("print", F.col("first").alias("node")).join(_small(labels), "node", "left").select("print", F.coalesce("label", "node").alias("label"))
    return materialize(rows.select("node", "print").join(kinds, "print").select("node", "print", "label"), "near-classes")


def _keyed(rows: DataFrame, once: bool) -> DataFrame:
    """(node, key) of rows (node, keys), each once; ``once``: no node has several rows."""
    rows = rows.select("node", F.explode(F.array_distinct("keys")).alias("key"))
    return rows if once else rows.distinct()


def _labelled_pairs(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """(a, b, a_label, b_label) of the pairs whose nodes have different labels (node, label); a node without one is its own."""
    known = _small(labels)
    for side in "ab":
        found = known.select(F.col("node").alias(side), F.col("label").alias("__label"))
        pairs = pairs.join(found, side, "left").withColumn(f"{side}_label", F.coalesce("__label", side)).drop("__label")
    return pairs.where("a_label <> b_label").select("a", "b", "a_label", "b_label")


def _linked_to_heads(pairs: DataFrame, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(links, tried) of pairs (a, b, best, node), written: each node's best pair first, then the others unless that linked both to one head."""
    best = pairs.where("best")
    links = verify(best.select("a", "b"), docs)
    heads = best.join(_small(links), ["a", "b"], "left_semi").select("node", F.when(F.col("node") == F.col("a"), F.col("b")).otherwise(F.col("a")).alias("label"))
    rest = materialize(_labelled_pairs(pairs.where("not best").select("a", "b"), materialize(heads, "near-heads")).select("a", "b"), "near-pairs")
    return materialize(links.union(verify(rest, docs)), "near-all-links"), materialize(best.select("a", "b").union(rest), "near-tried")


def _shared(keyed: DataFrame) -> DataFrame:
    """(key, node, n) of the keys that several nodes have, n being how many."""
    buckets = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    return materialize(met(keyed, buckets, "key", "node").select("key", "node", "n"), "near-shared")


def _to_heads(shared: DataFrame) -> DataFrame:
    """Pairs (a, b, best, node) of each node and the most central one of each of its buckets; the best of a node is that with the most central of them.

    No pair comes twice: of two nodes only the less central has the other as its head.
    """
    # A node is in as many buckets, and has as many heads, as sketches at most.
    weighed = materialize(shared.select("key", "node", F.sum("n").over(W.partitionBy("node")).alias("w")), "near-weights")
    heads = weighed.groupBy("key").agg(F.max(F.struct("w", (-F.col("node")).alias("head"))).alias("h"))
    pairs = met(weighed, heads, "key", "node").where("node <> -h.head").groupBy("node").agg(F.collect_set("h").alias("hs"))
    pairs = pairs.select("node", F.array_max("hs").alias("top"), F.explode("hs").alias("h"))
    head = -F.col("h.head")
    return materialize(pairs.select(F.least("node", head).alias("a"), F.greatest("node", head).alias("b"), (F.col("h") == F.col("top")).alias("best"), "node"), "near-pairs")


def _open(shared: DataFrame, labels: DataFrame) -> DataFrame:
    """(key, node, n, label) of the buckets that hold several classes."""
    rows = shared.join(_small(labels), "node", "left").select("key", "node", "n", F.coalesce("label", "node").alias("label"))
    several = rows.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("key")
    return materialize(met(rows, several, "key", "node"), "near-open")


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).distinct()


def _unlike(rows: DataFrame) -> DataFrame:
    """The rows (key, node, n, label) of one of the buckets that have the same members."""
    own = rows.groupBy("key").agg(F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y"), F.count("*").alias("k"))
    return met(rows, own.groupBy("x", "y", "k").agg(F.min("key").alias("key")).select("key"), "key", "node")


def _in_common(sets: list[np.ndarray]) -> np.ndarray:
    """How many elements each two of the sets have in common (not of a set with itself)."""
    row = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    _, column, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = n > 1
    kept = shared[column]
    row, column = row[kept], (np.cumsum(shared) - 1)[column[kept]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.zeros((len(sets), len(sets)), np.float32)
    for a in range(0, int(shared.sum()), COLUMNS):
        lo, hi = np.searchsorted(column, (a, a + COLUMNS))
        has = np.zeros((len(sets), min(COLUMNS, int(column[hi - 1]) + 1 - a)), np.float32)
        has[row[lo:hi], column[lo:hi] - a] = 1
        out += has @ has.T
    return out


def _alike(node, label, block, two: bool, grams, bags, likeness: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of nodes of different labels, across the blocks if they are two, whose bags and shingle sets near() may accept."""
    ok = (label[:, None] != label) & ((block[:, None] < block) if two else (node[:, None] < node))
    if ok.any() and bags[0] is not None:
        size = np.array([len(x) for x in bags])
        least = LIKENESS * np.maximum(size[:, None], size) - 2  # hashes of two words may agree
        ok &= np.minimum(size[:, None], size) >= least
        if ok.any():
            ok &= _in_common(bags) >= least
    at = np.flatnonzero(ok.any(0) | ok.any(1))
    if not len(at):
        return node[:0], node[:0]
    ok, node, grams = ok[np.ix_(at, at)], node[at], [grams[i] for i in at]
    size = np.array([len(x) for x in grams])
    ok &= _in_common(grams) >= likeness / (1 + likeness) * (size[:, None] + size) - 1
    i, j = np.nonzero(ok)
    return node[i], node[j]


def _across(rows: DataFrame, texts: DataFrame, likeness: float = ACROSS) -> DataFrame:
    """Pairs of different classes that share a bucket and whose bags and shingle sets are alike; others are not made.

    ``rows`` are (key, node, n, label), n the members of the bucket, which it may leave out.

    The members of a large bucket are dealt into blocks, and the blocks meet in pairs,
    so that no task compares a whole bucket. Small buckets are compared many to a task.
    """
    if "n" not in rows.columns:
        rows = met(rows, rows.groupBy("key").agg(F.count("*").alias("n")), "key", "node")
    if "bag" not in texts.columns:
        texts = texts.withColumn("bag", F.lit(None).cast("array<int>"))
    blocks = F.ceil(F.col("n") / BLOCK)
    rows = rows.select("key", "node", "label", F.pmod(F.xxhash64("node"), blocks).alias("block"), F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("other"))
    rows = materialize(rows.select("key", "node", "label", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")), "near-blocks")
    bundles = max(1, rows.count() // BUNDLE)
    rows = rows.withColumn("bundle", F.pmod(F.xxhash64("key", "i", "j"), F.lit(bundles))).join(texts.select("node", "grams", "bag"), "node")

    def task(table):
        import pyarrow as pa

        key, i, j, node, label, block = (table.column(c).to_numpy() for c in ("key", "i", "j", "node", "label", "block"))
        grams, bags = (table.column(c).to_pandas().to_numpy() for c in ("grams", "bag"))
        order = np.lexsort((j, i, key))
        moved = (np.diff(key[order]) != 0) | (np.diff(i[order]) != 0) | (np.diff(j[order]) != 0)
        found = [np.zeros((2, 0), np.int64)]
        for at in np.split(order, np.flatnonzero(moved) + 1):
            if len(at) > 1:
                found.append(np.stack(_alike(node[at], label[at], block[at], i[at[0]] < j[at[0]], grams[at], bags[at], likeness)))
        p, q = np.concatenate(found, 1)
        return pa.table({"p": pa.array(p, pa.int64()), "q": pa.array(q, pa.int64())})

    rows = rows.select("bundle", "key", "i", "j", "node", "label", "block", "grams", "bag")
    return _ordered(rows.groupBy("bundle").applyInArrow(task, "p long, q long"))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each class of near copies: that of the least id (null last), then of the least digest of its text.

    Of rows equal in both the one with the least digest of all its columns stays, so that
    reruns agree. A null text is an empty one; rows without id stay if no row with an id is
    a copy, one of each text. Empty tables give no rows; all columns stay as they are.
    """
    found = _labelled(docs, id_col, text_col)
    kept = found.groupBy("label").agg(F.min(F.struct((F.col("node") < 0).alias("bare"), "node", "print")).alias("k")).select("k.node", "k.print")
    rows = found.groupBy("node", "print").agg(F.count("*").alias("n")).join(kept, ["node", "print"], "left_semi")
    rows = materialize(rows.select(F.col("node").alias("__node"), F.col("print").alias("__print"), (F.col("n") > 1).alias("__again")), "near-kept")
    text = F.coalesce(F.col(text_col), F.lit(""))
    several = not rows.where("__again").isEmpty()
    out = docs.join(_small(rows), (_node(F.col(id_col), text) == F.col("__node")) & (F.md5(text) == F.col("__print")))
    if several:
        again = out.where("__again").withColumn("__nth", F.row_number().over(W.partitionBy("__node", "__print").orderBy(F.md5(F.to_json(F.struct(*docs.columns))))))
        out = out.where("not __again").unionByName(again.where("__nth = 1").drop("__nth"))
    return out.select(*docs.columns)
