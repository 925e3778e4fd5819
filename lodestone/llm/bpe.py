"""Byte-pair encoding by a segment tree over adjacent pair ranks, and decoding."""

from __future__ import annotations

import functools
import hashlib
import json
import re
import unicodedata

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import small_batches
from lodestone.llm.token_store import ODD, SPACE, byte_letters

#: The vocabulary's words, white space spelled out.
WORDS = rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{SPACE}\p{{L}}\p{{N}}]+"
NONE = 1 << 62
#: Words kept by a worker; the longest that are.
KEPT_WORDS, KEPT_LENGTH = 3 << 17, 64


class MergeTree:
    """Ranks of adjacent pairs at the leaves, the least (leftmost of equals) at the root."""

    def __init__(self, ranks: list[int]):
        # A leaf is rank * n + place, so that the plain minimum is the leftmost of equals.
        self.n = n = len(ranks)
        self.tree = [NONE] * n + [r if r == NONE else r * n + i for i, r in enumerate(ranks)]
        for k in range(n - 1, 0, -1):
            self.tree[k] = min(self.tree[2 * k], self.tree[2 * k + 1])

    def root(self) -> int:
        """Place of the least rank, -1 if no pair merges."""
        least = self.tree[1] if self.n > 1 else self.tree[self.n] if self.n else NONE
        return -1 if least == NONE else least % self.n

    def set(self, place: int, rank: int) -> None:
        tree, k = self.tree, place + self.n
        tree[k] = NONE if rank == NONE else rank * self.n + place
        k >>= 1
        while k:
            tree[k] = min(tree[2 * k], tree[2 * k + 1])
            k >>= 1


def merge(symbols: list[int], pairs: dict[tuple[int, int], tuple[int, int]]) -> list[int]:
    """Ids after all merges; pairs: (left, right) -> (rank, merged id)."""
    n = len(symbols)
    if n < 2:
        return symbols
    symbols = list(symbols)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    rank = lambda a, b: pairs.get((symbols[a], symbols[b]), (NONE,))[0]
    tree = MergeTree([rank(i, i + 1) for i in range(n - 1)])
    while (i := tree.root()) >= 0:
        j = after[i]
        symbols[i] = pairs[symbols[i], symbols[j]][1]
        after[i] = k = after[j]
        symbols[j] = -1
        if j < n - 1:
            tree.set(j, NONE)
        if k < n:
            before[k] = i
            tree.set(i, rank(i, k))
        else:
            tree.set(i, NONE)
        if (h := before[i]) >= 0:
            tree.set(h, rank(h, i))
    return [s for s in symbols if s >= 0]


class Bpe:
    """Encoder and decoder of a vocabulary file with word ends, lower case and no white space."""

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        model = data["model"]
        self.vocab, self.end = model["vocab"], model["end_of_word_suffix"]
        self.pairs = {}
        for rank, (a, b) in enumerate(model["merges"]):
            self.pairs[self.vocab[a], self.vocab[b]] = rank, self.vocab[a + b]
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.tokens = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        self.at_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")").split
        self.odd = re.compile(ODD).search
        self.words, self.letters = regex.compile(WORDS).findall, byte_letters()
        library = Tokenizer.from_file(path)
        self.normalizer, self.splitter = library.normalizer, library.pre_tokenizer
        self.known: dict[str, tuple[int, str, str]] = {}

    def word_ids(self, letters: str) -> list[int]:
        """Ids of a word of byte letters; letters that the vocabulary lacks are left out."""
        first = [self.vocab.get(c) for c in letters[:-1]] + [self.vocab.get(letters[-1] + self.end)]
        return merge([i for i in first if i is not None], self.pairs)

    def pieces(self, text: str) -> list[tuple[int, str, str]]:
        """(ids, ids as text, tokens as text) of each word and special token."""
        found = []
        for part in self.at_special(text):
            if part in self.special:
                found.append((1, str(self.special[part]), part))
            elif self.odd(part):  # letters on which Unicode versions differ: the library's tables
                found += map(self.piece, (w for w, _ in self.splitter.pre_tokenize_str(self.normalizer.normalize_str(part))))
            else:
                part = part if part.isascii() else unicodedata.normalize("NFC", part).replace("Σ", "σ")
                known, words = self.known, self.words(part.lower())
                own = {w: self.piece("".join([self.letters[b] for b in w.encode()])) for w in set(words).difference(known)}
                found += [own[w] if w in own else known[w] for w in words] if own else [known[w] for w in words]
                kept = {w: p for w, p in own.items() if len(w) <= KEPT_LENGTH}
                if len(known) + len(kept) > KEPT_WORDS:
                    known.clear()
                if len(kept) <= KEPT_WORDS:
                    known.update(kept)
        return [x for x in found if x[0]]

    def piece(self, letters: str) -> tuple[int, str, str]:
        ids = self.word_ids(letters)
        return len(ids), " ".join(map(str, ids)), " ".join([self.tokens[i] for i in ids])

    def encode(self, text: str) -> list[int]:
        return [int(i) for _, ids, _ in self.pieces(text) for i in ids.split()]

    def decode(self, ids: list[int]) -> str:
        """Tokens joined by spaces: the vocabulary names no decoder."""
        return " ".join([self.tokens[i] for i in ids if i in self.tokens])


@functools.lru_cache(2)
def bpe_of(path: str) -> Bpe:
    """The worker's coder: its words stay known from task to task."""
    return Bpe(path)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids, decoded) of every whole text.

    Null texts are empty; an empty text has no ids and decodes to itself. Rows map to
    rows, repeated ones and those without id too; a text of any length is coded whole;
    an empty table gives no rows; other columns are ignored.
    """

    def task(batches):
        import pyarrow as pa

        bpe = bpe_of(path)
        for batch in batches:
            ids = [bpe.encode(t or "") for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32())), pa.array([bpe.decode(x) for x in ids], pa.string())], ["doc_id", "ids", "decoded"])

    small_batches(docs.sparkSession, 200)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return docs.mapInArrow(task, "doc_id long, ids array<int>, decoded string")


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encode() and decode() of every whole text, digested.

    Null texts are empty; an empty text has no ids. Rows map to rows, repeated ones too;
    other columns are ignored.
    """

    def task(batches):
        import pyarrow as pa

        bpe = bpe_of(path)
        sha = lambda parts: hashlib.sha256(" ".join(parts).encode()).hexdigest()
        for batch in batches:
            n, ids, decoded = [], [], []
            for text in batch.column("text").to_pylist():
                found = bpe.pieces(text or "")
                n.append(sum([x[0] for x in found]))
                ids.append(sha([x[1] for x in found]))
                decoded.append(sha([x[2] for x in found]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids), pa.array(decoded)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    small_batches(docs.sparkSession, 500)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return docs.mapInArrow(task, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
