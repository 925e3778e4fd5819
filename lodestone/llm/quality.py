"""Quality classifier: a generalised additive model with pairwise interactions.

Shallow trees are boosted in turn, one feature (then one pair) at a time, on binned
values; summed, a feature's trees are a table of its bins, a pair's a table of two.
A score is a sum of table entries.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import small_batches

FEATURES = (
    "words", "word_length", "distinct_words", "repeated_word", "capitals", "digits", "symbols", "marks", "other_letters",
    "words_with_symbols", "lines", "distinct_lines", "line_ends", "longest_word", "spaces",
)
UPPER, DIGIT = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789"
LOWER, SPACES = b"abcdefghijklmnopqrstuvwxyz", b" \t\r\n\x0b\x0c"
MARKS = b".,;:?'\"-()"
SYMBOLS = bytes(b for b in range(33, 127) if b not in UPPER + LOWER + DIGIT + MARKS)
ENDS = (".", "!", "?", ":", '"')
_SYMBOL = re.compile("[" + re.escape(SYMBOLS.decode()) + "]")


def features(text: str | None) -> list[float]:
    """The FEATURES of a whole text; of a null or empty one all are 0."""
    if not text:
        return [0.0] * len(FEATURES)
    raw, words, lines = text.encode("utf-8", "replace"), text.split(), text.split("\n")
    n, w, k = len(raw), max(1, len(words)), len(lines)
    count = lambda kinds: n - len(raw.translate(None, kinds))
    upper, lower, digits, symbols = count(UPPER), count(LOWER), count(DIGIT), count(SYMBOLS)
    lengths = list(map(len, words)) or [0]
    again = sum([a == b for a, b in zip(words, words[1:], strict=False)])
    marked = len([x for x in words if _SYMBOL.search(x)]) if symbols else 0
    ended = sum([x.endswith(ENDS) for x in lines])
    return [
        math.log1p(len(words)), sum(lengths) / w, len(set(words)) / w**0.8, again / w, upper / max(1, upper + lower), digits / n, symbols / n,
        count(MARKS) / n, (n - len(text)) / n, marked / w, k / w, len(set(lines)) / k, ended / k,
        math.log1p(max(lengths)), count(SPACES) / n,
    ]


@dataclass
class Model:
    """Cuts of each feature, a table of its bins, and tables of pairs."""

    intercept: float = 0.0
    cuts: list[np.ndarray] = field(default_factory=list)
    mains: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, f], side="right") for f, c in enumerate(self.cuts)]) if self.cuts else np.zeros((0, len(x)), int)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row of features."""
        total, bins = np.full(len(x), self.intercept), self.bins(x)
        for f, table in enumerate(self.mains):
            total += table[bins[f]]
        for f, g, table in self.pairs:
            total += table[bins[f], bins[g]]
        return 1 / (1 + np.exp(-total))


def _leaf(g, h):
    return g / (h + 1.0)


def _gain(g, h):
    return g * g / (h + 1.0)


def _split(g: np.ndarray, h: np.ndarray) -> tuple[int, float]:
    """Best cut of a histogram: (first bin of the right side, gain)."""
    left, all_ = np.cumsum(g)[:-1], g.sum()
    hl, ha = np.cumsum(h)[:-1], h.sum()
    if not len(left):
        return 0, 0.0
    gain = _gain(left, hl) + _gain(all_ - left, ha - hl) - _gain(all_, ha)
    k = int(np.argmax(gain))
    return k + 1, float(gain[k])


def _tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Leaf values, by bin, of a tree of two levels on one feature's histogram."""
    out = np.zeros(len(g))
    k, gain = _split(g, h)
    for part in (slice(0, k), slice(k, len(g))) if gain > 1e-9 else (slice(0, len(g)),):
        j, gain = _split(g[part], h[part])
        a = part.start + j if gain > 1e-9 else part.stop
        for s in (slice(part.start, a), slice(a, part.stop)):
            out[s] = _leaf(g[s].sum(), h[s].sum())
    return out


def _pair_tree(g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, float]:
    """Leaf values, by pair of bins, of a tree that cuts one feature and then, either side, the other."""
    best = (np.zeros(g.shape), 0.0)
    for turn in (False, True):
        a, b = (g.T, h.T) if turn else (g, h)
        k, gain = _split(a.sum(1), b.sum(1))
        out, total = np.zeros(a.shape), gain
        for s in (slice(0, k), slice(k, len(a))):
            ga, hb = a[s].sum(0), b[s].sum(0)
            j, more = _split(ga, hb)
            total += more
            out[s, :j], out[s, j:] = _leaf(ga[:j].sum(), hb[:j].sum()), _leaf(ga[j:].sum(), hb[j:].sum())
        if total > best[1]:
            best = (out.T if turn else out, total)
    return best


def fit(x: np.ndarray, y: np.ndarray, bins: int = 32, rounds: int = 60, pair_rounds: int = 20, pairs: int = 5, rate: float = 0.2) -> Model:
    """Boost the tables in cycles over the features, then over the pairs that help the residual most.

    Without rows the score is 0.5; with one label only it is near that label.
    """
    if not len(y):
        return Model()
    p = (y.sum() + 0.5) / (len(y) + 1)
    m = Model(math.log(p / (1 - p)))
    m.cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    m.mains = [np.zeros(len(c) + 1) for c in m.cuts]
    b, total = m.bins(x), np.full(len(y), m.intercept)

    def slopes():
        q = 1 / (1 + np.exp(-total))
        return y - q, q * (1 - q)

    for _ in range(rounds):
        for f, table in enumerate(m.mains):
            g, h = slopes()
            step = rate * _tree(np.bincount(b[f], g, len(table)), np.bincount(b[f], h, len(table)))
            table += step
            total += step[b[f]]

    def grid(f, k, v):
        n, w = len(m.mains[f]), len(m.mains[k])
        return np.bincount(b[f] * w + b[k], v, n * w).reshape(n, w)

    g, h = slopes()
    every = [(f, k) for f in range(len(m.cuts)) for k in range(f + 1, len(m.cuts))]
    chosen = sorted(every, key=lambda fk: -_pair_tree(grid(*fk, g), grid(*fk, h))[1])[:pairs]
    m.pairs = [(f, k, np.zeros((len(m.mains[f]), len(m.mains[k])))) for f, k in chosen]
    for _ in range(pair_rounds):
        for f, k, table in m.pairs:
            g, h = slopes()
            step = rate * _pair_tree(grid(f, k, g), grid(f, k, h))[0]
            table += step
            total += step[b[f], b[k]]
    return m


def held_out(doc_id: Column) -> Column:
    """Whether a row is kept from learning: crc32 of its id as text, modulo 5, is 0; so is a row without id."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = 20_000, **options) -> Model:
    """Fit on ``most`` labelled rows that are not held out (least hash of the id; the bound of the sample).

    Only the sample's ids, at most ``most``, are broadcast, and only its features, 15
    numbers a row of ``most`` rows at most, come to the driver. Rows with null id or label
    teach nothing; of repeated ids each row counts until the bound. Null and empty texts
    have the features of an empty text, long ones are taken whole. Without labelled rows,
    or with empty tables, the model scores 0.5. Other columns are ignored.
    """
    small_batches(docs.sparkSession, 500)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("double").alias("y"))
    known = known.where(F.col("doc_id").isNotNull() & F.col("y").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(most)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(known), "doc_id")

    def task(batches):
        import pyarrow as pa

        for batch in batches:
            x = [features(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(x, pa.list_(pa.float64())), batch.column("y")], ["doc_id", "x", "y"])

    got = rows.select("doc_id", "text", "y").mapInArrow(task, "doc_id long, x array<double>, y double")
    got = got.orderBy(F.xxhash64("doc_id"), "doc_id", "y", "x").limit(most).toArrow()
    if not got.num_rows:
        return Model()
    x = np.array(got.column("x").to_pylist())
    return fit(x, np.array(got.column("y").to_pylist()), **options)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs with ``score``: the probability of label 1, of empty and null texts too.

    Rows map to rows, repeated ones too, with all their columns (one called ``score``
    would clash and must be renamed first); a text of any length is taken whole; an
    empty table gives no rows.
    """
    small_batches(docs.sparkSession, 500)

    def task(batches):
        import pyarrow as pa

        for batch in batches:
            x = np.array([features(t) for t in batch.column("text").to_pylist()]).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(model.score(x))], [*batch.schema.names, "score"])

    kinds = ", ".join(f"`{c}` {t}" for c, t in docs.dtypes)
    return docs.mapInArrow(task, f"{kinds}, score double")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **options) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row of docs, whatever its id, repeated or null, and its text; other columns are ignored."""
    model = train(docs, labels, **options)
    rows = score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model)
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
