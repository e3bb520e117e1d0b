"""Byte-level BPE by a segment tree over adjacent pair ranks, and its inverse.

The leaves of a tree hold the merge rank of each pair of neighbours; the root is the lowest
rank, and descending to the left child wherever it is not larger finds the leftmost pair of that
rank. A merge changes three leaves and their ancestors. The short pieces of many words are
merged side by side, one tree to a row of an array; a long piece has a tree of its own and costs
n log n.

A text is cut where white space begins; such chunks are independent of each other under the
vocabulary's splitting pattern, so their ids are remembered by chunk, in a table of at most
MEMO entries that only saves time.

Cases: a null text counts as empty and gives no ids. The strings of special tokens in a text
give their ids, as in the tokenizers library. Other columns are carried along by neither
function. Ids are bytes, four to an id, little-endian.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import id_field, map_arrow, portions

#: The splitting pattern of byte-level vocabularies, and Unicode's white space.
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
BLANK = "\t\n\x0b\x0c\r \x85\xa0  -     　"
CHUNKS = re.compile(f"[{BLANK}]*[^{BLANK}]+|[{BLANK}]+")

NONE = 1 << 30
MEMO = 1 << 19
LONG_CHUNK = 64
LONG_PIECE = 64
#: Characters of text worked on at once, and so what a Python worker holds.
BATCH_CHARS = 1 << 20


def byte_alphabet() -> dict[str, int]:
    """The characters that stand for bytes: printable ones for themselves, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteBpe:
    """One vocabulary file, ready to encode and decode."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = byte_alphabet()
        raw = lambda token: bytes(alphabet[c] for c in token)
        vocab = {raw(t): i for t, i in spec["model"]["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_pattern = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.bytes_of = [b""] * (1 + max([*vocab.values(), *self.special.values()]))
        for token, i in vocab.items():
            self.bytes_of[i] = token
        for token, i in self.special.items():
            self.bytes_of[i] = token.encode()
        self.byte_ids = np.array([vocab[bytes([b])] for b in range(256)], np.int64)
        self.width = len(self.bytes_of)
        ranks = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = map(raw, pair.split(" ") if isinstance(pair, str) else pair)
            ranks.setdefault(vocab[left] * self.width + vocab[right], (rank, vocab[left + right]))
        self.ranks = ranks
        self.keys = np.array(sorted(ranks), np.int64)
        self.rank_of = np.array([ranks[k][0] for k in self.keys.tolist()] + [NONE], np.int64)
        self.merged = np.zeros(len(ranks) + 1, np.int64)
        for rank, merged in ranks.values():
            self.merged[rank] = merged
        self.memo: dict[str, bytes] = {}

    # -- merging ---------------------------------------------------------------------------

    def merge_one(self, piece: bytes) -> list[int]:
        """Ids of one piece, by one segment tree."""
        ids = self.byte_ids[np.frombuffer(piece, np.uint8)].tolist()
        n, width, find = len(ids), self.width, self.ranks.get
        size = 1 << max(0, n - 1).bit_length()
        tree = [NONE] * (2 * size)
        rank = lambda i, j: (find(ids[i] * width + ids[j]) or (NONE,))[0] if 0 <= i and j < n else NONE
        after, before = [*range(1, n + 1)], [*range(-1, n - 1)]
        tree[size : size + n] = [rank(i, i + 1) for i in range(n)]
        for i in range(size - 1, 0, -1):
            tree[i] = min(tree[2 * i], tree[2 * i + 1])

        def put(i: int, value: int) -> None:
            i += size
            tree[i] = value
            while i := i >> 1:
                tree[i] = min(tree[2 * i], tree[2 * i + 1])

        while tree[1] < NONE:
            lowest, i = tree[1], 1
            while i < size:
                i = 2 * i + (tree[2 * i] > lowest)
            i -= size
            gone = after[i]
            ids[i], ids[gone], after[i] = int(self.merged[lowest]), -1, after[gone]
            if after[i] < n:
                before[after[i]] = i
            put(gone, NONE)
            put(i, rank(i, after[i]))
            if before[i] >= 0:
                put(before[i], rank(before[i], i))
        return [i for i in ids if i >= 0]

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs; a side below 0 stands for none."""
        key = left * self.width + right
        at = np.searchsorted(self.keys, key)
        found = (at < len(self.keys)) & (left >= 0) & (right >= 0)
        found[found] = self.keys[at[found]] == key[found]
        return np.where(found, self.rank_of[np.where(found, at, -1)], NONE)

    def merge_many(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of short pieces as bytes: a tree in each row, all merging at once."""
        out: list[bytes] = [b""] * len(pieces)
        lengths = np.array([len(p) for p in pieces])
        size, low = 2, 0
        while low < LONG_PIECE:
            rows = np.flatnonzero((lengths > low) & (lengths <= size))
            if len(rows):
                self._merge_rows(pieces, rows, lengths[rows], size, out)
            low, size = size, 2 * size
        return out

    def _merge_rows(self, pieces: list[bytes], rows: np.ndarray, lengths: np.ndarray, size: int, out: list[bytes]) -> None:
        m = len(rows)
        joined = np.frombuffer(b"".join([pieces[r].ljust(size, b"\0") for r in rows]), np.uint8).reshape(m, size)
        ids = np.full((m, size + 2), -1, np.int64)  # a column of none on either side
        inside = np.arange(size) < lengths[:, None]
        ids[:, 1:-1] = np.where(inside, self.byte_ids[joined], -1)
        after = np.tile(np.arange(1, size + 3), (m, 1))
        before = np.tile(np.arange(-1, size + 1), (m, 1))
        tree = np.full((m, 2 * size), NONE, np.int64)
        tree[:, size:] = self._rank(ids[:, 1:-1].ravel(), ids[:, 2:].ravel()).reshape(m, size)
        for i in range(size - 1, 0, -1):
            np.minimum(tree[:, 2 * i], tree[:, 2 * i + 1], out=tree[:, i])
        live = np.flatnonzero(tree[:, 1] < NONE)
        while len(live):
            lowest = tree[live, 1]
            node = np.ones(len(live), np.int64)
            for _ in range(size.bit_length() - 1):
                node = 2 * node + (tree[live, 2 * node] > lowest)
            at = node - size + 1
            gone = after[live, at]
            ids[live, at] = self.merged[lowest]
            ids[live, gone] = -1
            beyond = after[live, gone]
            after[live, at] = beyond
            before[live, beyond] = at
            prior = before[live, at]
            own, left, right = ids[live, at], ids[live, prior], ids[live, beyond]
            leaves = ((gone, np.full(len(live), NONE)), (at, self._rank(own, right)), (prior, self._rank(left, own)))
            for leaf, value in leaves:
                real = leaf > 0
                row, node = live[real], leaf[real] - 1 + size
                tree[row, node] = value[real]
                for _ in range(size.bit_length() - 1):
                    node = node >> 1
                    tree[row, node] = np.minimum(tree[row, 2 * node], tree[row, 2 * node + 1])
            live = live[tree[live, 1] < NONE]
        for r, row in zip(rows.tolist(), ids.astype("<i4")):
            out[r] = row[row >= 0].tobytes()

    # -- texts -----------------------------------------------------------------------------

    def _learn(self, chunks: Iterable[str]) -> None:
        """Puts the ids of chunks into the memo."""
        parts = {c: [p.encode() for p in PIECES.findall(c)] for c in chunks}
        short = list({p for ps in parts.values() for p in ps if len(p) <= LONG_PIECE})
        ids = dict(zip(short, self.merge_many(short)))
        for chunk, pieces in parts.items():
            self.memo[chunk] = b"".join([ids[p] if p in ids else self._long(p) for p in pieces])

    def _long(self, piece: bytes) -> bytes:
        return np.array(self.merge_one(piece), "<u4").tobytes()

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, as little-endian unsigned 32-bit integers."""
        if len(self.memo) > MEMO:
            self.memo.clear()
        memo = self.memo
        split = [self._segments(t) for t in texts]
        chunked = [[CHUNKS.findall(s) if not i % 2 else s for i, s in enumerate(parts)] for parts in split]
        new = {c for parts in chunked for s in parts[::2] for c in s if c not in memo}
        self._learn(new)
        out = []
        for parts in chunked:
            out.append(b"".join([b"".join([memo[c] for c in s]) if not i % 2 else self.special[s].to_bytes(4, "little") for i, s in enumerate(parts)]))
        for c in new:
            if len(c) > LONG_CHUNK:
                del memo[c]
        return out

    def _segments(self, text: str) -> list[str]:
        """Plain text and special tokens in turn."""
        return self.special_pattern.split(text) if self.special_pattern else [text]

    def decode(self, ids: bytes) -> str:
        of = self.bytes_of
        return b"".join([of[i] for i in np.frombuffer(ids, "<u4").tolist()]).decode("utf-8", "replace")


_LOADED: dict[str, ByteBpe] = {}


def loaded(path: str) -> ByteBpe:
    """The vocabulary of a path, read once for each Python worker."""
    if path not in _LOADED:
        _LOADED[path] = ByteBpe(path)
    return _LOADED[path]


def encode(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids) of each row's text."""
    kind = id_field(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for part in portions(list(map(len, texts)), BATCH_CHARS):
                ids = bpe.encode_many(texts[part])
                counts = pa.array([len(i) // 4 for i in ids], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0)[part], counts, pa.array(ids, pa.binary())], names=["doc_id", "n_tokens", "ids"])

    return map_arrow(docs.select("doc_id", "text"), run, f"{kind}, n_tokens long, ids binary")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids, text): encoded rows with their text restored."""
    kind = id_field(encoded)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [bpe.decode(i or b"") for i in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=["doc_id", "n_tokens", "ids", "text"])

    return map_arrow(encoded.select("doc_id", "n_tokens", "ids"), run, f"{kind}, n_tokens long, ids binary, text string")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """decode(encode(docs)), in one pass of one Python worker a task."""
    kind = id_field(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for part in portions(list(map(len, texts)), BATCH_CHARS):
                ids = bpe.encode_many(texts[part])
                columns = [batch.column(0)[part], pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array(map(bpe.decode, ids), pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids", "text"])

    return map_arrow(docs.select("doc_id", "text"), run, f"{kind}, n_tokens long, ids binary, text string")
