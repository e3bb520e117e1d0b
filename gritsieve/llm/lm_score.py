"""Scores of texts under an n-gram model, by a weighted backoff automaton.

Model: Dirichlet-smoothed n-grams of order ORDER,
    p(w | h) = (c(hw) + m * p(w | h')) / (c(h) + m),
where h' is h without its first word and m the order's entry of MASSES; at the bottom p(w) = (c(w) + 0.5) / (N + 0.5 (V + 1)). The
probabilities after any history sum to one over the known tokens and one unknown. Seen
histories are states; a seen n-gram is an arc, and where there is none the failure arc leads to
the state of h' at weight m / (c(h) + m). A document is read once from left to right,
carrying the state and adding up log-probabilities.

The whole model is as large as the corpus's set of n-grams, so it is never in one place. Documents
are gathered in nodes of NODE_BYTES. A node asks for the corpus counts of its distinct n-grams, and
builds, block by block, the part of the automaton that its documents can reach. Bigrams come
first, with the words; of a longer order only n-grams whose history several nodes have are asked
for, since of the rest a node has all occurrences itself.

The exchange sends each node's key hashes, sorted, in one frame for each of FAN parts of the
hash space. If the parts would hold over PART_KEYS keys, they are merged in groups of FAN nodes
and dealt once more, in FAN parts of each part, and so on: frames, memory and rows are in
proportion to the input at any size, by the logarithm of the input to the base FAN. The hottest word costs a
key a node, and nothing is broadcast.

Learning takes rows outside fold HELD_OUT. N-grams are named by 62-bit hashes, words too: at 10^10
distinct n-grams some ten pairs are expected to share a name (n(n-1)/2^63), and counts with it.

Cases: a null text counts as empty and is its end token alone. A null id belongs to fold 0.
Repeated rows count as often as they come. Without training rows all counts are 0. An empty table
gives an empty result.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_finished, fold_remainder, hand_back, map_arrow, materialize, portions

FOLDS = 5
HELD_OUT = 1
ORDER = 3
#: For orders 2, 3 and so on (the last entry for any beyond).
MASSES = (300.0, 20.0)
#: Text that one automaton is built for, and text that one node asks for.
BLOCK_BYTES = 3_000_000
NODE_BYTES = 12_000_000
#: Frames that a node sends in one step of the exchange, and keys that meet in one part at most.
FAN = 2048
PART_KEYS = 4_000_000

#: Bytes of a word that are hashed side by side with those of others; a longer word is hashed alone.
SHORT_BYTES = 32

#: Names of what is no word.
_END = xxhash.xxh64_intdigest(b"\n end")
_BEGIN = xxhash.xxh64_intdigest(b"\n begin")


class Block:
    """Token sequences of some documents, and their distinct n-grams of each order."""

    def __init__(self, texts: pa.Array, learning: np.ndarray, order: int):
        split = pc.ascii_split_whitespace(pc.ascii_lower(texts.fill_null("")))
        flat = split.flatten()
        coded = flat.dictionary_encode()
        real = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
        bounds = split.offsets.to_numpy()
        inside = np.concatenate([[0], np.cumsum(real)])[bounds - bounds[0]]
        words = coded.indices.to_numpy()[real].astype(np.int64)
        hashes = _word_hashes(coded.dictionary)
        self.end, self.begin = len(hashes), len(hashes) + 1
        self.width = len(hashes) + 2
        self.hashes = np.concatenate([hashes, np.array([_END, _BEGIN], np.uint64)])
        self.lengths = np.diff(inside) + 1
        ends = np.cumsum(self.lengths)
        self.tokens = np.full(int(ends[-1]) if len(ends) else 0, self.end, np.int64)
        at_end = np.zeros(len(self.tokens), bool)
        at_end[ends - 1] = True
        self.tokens[~at_end] = words
        self.starts = ends - self.lengths
        learned = np.repeat(learning, self.lengths)
        place = np.arange(len(self.tokens)) - np.repeat(self.starts, self.lengths)

        self.grams: list[np.ndarray] = []  # for each order, the place of each token's n-gram among the distinct, or -1
        self.contexts: list[np.ndarray] = []  # of each distinct n-gram, the n-gram before its last token
        self.lasts: list[np.ndarray] = []
        self.keys: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self._add(np.zeros(len(self.tokens), np.int64), np.ones(len(self.tokens), bool), np.zeros(1, np.uint64), learned, 1)
        # The history that each token follows: a distinct n-gram of the order before, or the beginning.
        for n in range(2, order + 1):
            known = self.grams[-1]
            history = np.full(len(self.tokens), -1, np.int64)
            history[1:] = known[:-1]
            if n == 2:
                history[place == 0] = len(self.keys[0])  # the beginning stands behind all words
                names = np.append(self.keys[0], np.uint64(_BEGIN))
            else:
                history[place < n - 2] = -1
                names = self.keys[-1]
            self._add(history, (place >= n - 2) & (history >= 0), names, learned, n)

    def _add(self, history: np.ndarray, there: np.ndarray, names: np.ndarray, learned: np.ndarray, n: int) -> None:
        if n == 1:  # all have the same history, and words have numbers already
            present = np.bincount(self.tokens, minlength=self.width) > 0
            last = np.flatnonzero(present)
            context, distinct = np.zeros(len(last), np.int64), last
            at = (np.cumsum(present) - 1)[self.tokens]
        else:
            distinct, _, at = _distinct(history[there] * self.width + self.tokens[there])
            context, last = np.divmod(distinct, self.width)
        key = self.hashes[last] if n == 1 else _mixed(names[context], self.hashes[last])
        found = np.full(len(self.tokens), -1, np.int64)
        found[there] = at
        self.grams.append(found)
        self.contexts.append(context)
        self.lasts.append(last)
        self.keys.append((key & ~np.uint64(3)) | np.uint64(min(n, 3)))
        self.counts.append(np.bincount(at, weights=learned[there], minlength=len(distinct)).astype(np.int64))


def _word_hashes(words: pa.Array) -> np.ndarray:
    """A 64-bit name of each word, from its length and its bytes, eight at a time."""
    if not len(words):
        return np.zeros(0, np.uint64)
    ends = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    lengths = np.diff(ends)
    raw = words.buffers()[2]
    data = np.concatenate([np.frombuffer(raw, np.uint8)[: ends[-1]] if raw else np.zeros(0, np.uint8), np.zeros(8, np.uint8)])
    eight = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))
    out = lengths.astype(np.uint64)
    for k in range(0, SHORT_BYTES, 8):
        some = np.flatnonzero((lengths > k) & (lengths <= SHORT_BYTES))
        beyond = np.maximum(0, 8 - (lengths[some] - k)).astype(np.uint64) * np.uint64(8)  # bits of the words that follow
        out[some] = _mixed(out[some], eight[ends[some] + k] << beyond)
    for i in np.flatnonzero(lengths > SHORT_BYTES).tolist():
        out[i] = xxhash.xxh64_intdigest(data[ends[i] : ends[i + 1]])
    return out


def _mixed(history: np.ndarray, word: np.ndarray) -> np.ndarray:
    x = history * np.uint64(0x9E3779B97F4A7C15) + (word ^ (word >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


class Automaton:
    """The states and arcs of the model that a block's documents can reach.

    A state is a seen history: the root, the beginning, or a distinct n-gram of the block below the
    highest order. The arc of a state and a token is the n-gram that they make, whose place the
    block has for every token; it is there if training has the n-gram. arcs: for each order the
    log-probabilities of its n-grams, ABSENT where there is no arc; every token has one from the
    root. fails: for each order the weights of its states' failure arcs, which lead to the state one word shorter.
    """

    ABSENT = 1.0

    def __init__(self, block: Block, totals: list[np.ndarray], n_tokens: int, n_types: int, masses: tuple[float, ...]):
        self.block, self.order = block, len(totals)
        mass_of = lambda n: masses[min(n - 2, len(masses) - 1)]
        self.known = totals[0] > 0
        p = (totals[0] + 0.5) / (n_tokens + 0.5 * (n_types + 1))
        self.base = np.log(p)
        self.arcs, self.fails = [self.base], []
        ends = totals[0][block.lasts[0] == block.end]
        seen = np.append(totals[0], ends.sum())  # a document begins as often as one ends
        for n in range(2, self.order + 1):
            context, count, mass = block.contexts[n - 1], totals[n - 1], mass_of(n)
            self.fails.append(np.log(mass / (seen + mass)))
            p = (count + mass * p[_suffix_places(block, n)]) / (seen[context] + mass)
            self.arcs.append(np.where(count > 0, np.log(p), self.ABSENT))
            seen = count

    def traverse(self) -> np.ndarray:
        """Log-probabilities of the block's documents: one pass over the tokens, left to right, that carries the state."""
        block, top = self.block, self.order - 1
        if not len(block.tokens):
            return np.zeros(0)
        # From a state of each length on each token: the weight of the failure arcs and the arc that it takes, and the length of the state that it comes to.
        weight = self.arcs[0][block.grams[0]]
        to = np.minimum(top, self.known[block.grams[0]]).astype(np.uint8)
        weights, tos = [weight], [to]
        for length, fails in enumerate(self.fails, 1):
            before = np.append(-1, block.grams[length - 1][:-1])
            if length == 1:
                before[block.starts] = len(fails) - 1
            arc = np.append(self.arcs[length], self.ABSENT)[block.grams[length]]
            there = arc <= 0
            weight = np.where(there, arc, np.append(fails, 0.0)[before] + weight)
            to = np.where(there, min(length + 1, top), to).astype(np.uint8)
            weights.append(weight)
            tos.append(to)
        first = min(1, top)
        for to in tos:  # a document ends in the state that the next one begins in
            to[block.starts[1:] - 1] = first
        lengths = bytearray(len(block.tokens))
        length = first
        for k, by_length in enumerate(zip(*(to.tobytes() for to in tos))):
            lengths[k] = length
            length = by_length[length]
        taken = np.choose(np.frombuffer(lengths, np.uint8), weights)
        return np.add.reduceat(taken, block.starts)


def _suffix_places(block: Block, n: int) -> np.ndarray:
    """For each distinct n-gram, the place of the one of order n - 1 that it ends with."""
    out = np.full(len(block.keys[n - 1]), -1, np.int64)
    there = block.grams[n - 1] >= 0
    out[block.grams[n - 1][there]] = block.grams[n - 2][there]
    return out


# -- what a node knows ------------------------------------------------------------------------


def _rounds(order: int) -> list[range]:
    """Which orders are asked for together."""
    return [range(1, min(order, 2) + 1), *(range(n, n + 1) for n in range(3, order + 1))]


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, ascending, a place of each, and the place of every key among the distinct."""
    order = np.argsort(keys)
    ordered = keys[order]
    new = np.append(True, ordered[1:] != ordered[:-1]) if len(keys) else np.zeros(0, bool)
    at = np.empty(len(keys), np.int64)
    at[order] = np.cumsum(new) - 1
    return ordered[new], order[new], at


def known_and_asked(blocks: list[Block], order: int, replies: list[np.ndarray]) -> tuple[list[list[np.ndarray]], tuple[np.ndarray, np.ndarray]]:
    """For each block the corpus counts by order, as far as replies came, and what the next round asks: keys ascending, and training counts here.

    An n-gram whose history no other node has is in no other node either.
    """
    known: list[list[np.ndarray]] = [[] for _ in blocks]
    others: list[np.ndarray] = []  # of each block, whether other nodes have its n-grams of the order before
    for r, orders in enumerate(_rounds(order)):
        keys, first, at = _distinct(np.concatenate([b.keys[n - 1] for n in orders for b in blocks]))
        counts = np.bincount(at, weights=np.concatenate([b.counts[n - 1] for n in orders for b in blocks]), minlength=len(keys)).astype(np.int64)
        ask = np.ones(len(keys), bool)
        if r:
            ask = np.concatenate([o[b.contexts[orders[0] - 1]] for o, b in zip(others, blocks)])[first]
        if r == len(replies):
            return known, (keys[ask], counts[ask])
        shared = np.zeros(len(keys), bool)
        counts[ask], shared[ask] = replies[r] >> 1, (replies[r] & 1).astype(bool)
        cuts = np.cumsum([len(b.keys[n - 1]) for n in orders for b in blocks])[:-1]
        for i, part in enumerate(np.split(at, cuts)):
            known[i % len(blocks)].append(counts[part])
        others = [shared[part] for part in np.split(at, cuts)[-len(blocks) :]]
    return known, (np.zeros(0, np.uint64), np.zeros(0, np.int64))


# -- distribution --------------------------------------------------------------------------


@functools.cache
def _zstandard() -> tuple[zstandard.ZstdCompressor, zstandard.ZstdDecompressor]:
    """One of each for the many frames of a process."""
    return zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def _packed(values: np.ndarray) -> bytes:
    """Integers as byte planes, compressed."""
    width = values.dtype.itemsize
    return _zstandard()[0].compress(values.view(np.uint8).reshape(-1, width).T.tobytes())


def _unpacked(blob: bytes, kind: str) -> np.ndarray:
    width = np.dtype(kind).itemsize
    raw = np.frombuffer(_zstandard()[1].decompress(blob), np.uint8)
    return np.ascontiguousarray(raw.reshape(width, -1).T).reshape(-1).view(kind)


def _smallest(counts: np.ndarray) -> bytes:
    """Counts in as few bytes each as the largest needs; the first byte tells how many."""
    width = next(w for w in (1, 2, 4, 8) if not len(counts) or int(counts.max()) < 1 << 8 * w)
    return bytes([width]) + _packed(counts.astype(f"<u{width}"))


def _counts(blob: bytes) -> np.ndarray:
    return _unpacked(blob[1:], f"<u{blob[0]}").astype(np.int64)


def _keys(blob: bytes) -> np.ndarray:
    return np.cumsum(_unpacked(blob, "<u8"), dtype=np.uint64)


_ASKED = "node long, part int, keys binary, counts binary"


def _frames(node: int, keys: np.ndarray, counts: np.ndarray, parts: int) -> pa.RecordBatch:
    """Ascending keys cut at the ends of as many equal parts of the hash space; no row for an empty one."""
    part = ((keys >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
    cuts = np.flatnonzero(np.diff(part, prepend=np.uint64(1 << 63))).tolist()
    spans = list(zip(cuts, [*cuts[1:], len(keys)]))
    rows = [(int(part[a]), _packed(np.diff(keys[a:z], prepend=np.uint64(0))), _smallest(counts[a:z])) for a, z in spans]
    columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.binary(), pa.binary()))]
    return pa.RecordBatch.from_arrays([pa.array([node] * len(rows), pa.int64()), *columns], names=["node", "part", "keys", "counts"])


def _nodes(docs: DataFrame) -> DataFrame:
    """node, and its documents: ids, whether they are held out, sizes in bytes, and texts, compressed."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        held: list[pa.RecordBatch] = []
        size = 0

        def gathered() -> pa.RecordBatch:
            ids, out, texts = (pa.concat_arrays([b.column(i) for b in held]) for i in range(3))
            listed = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in (ids, out, pc.binary_length(texts).cast(pa.int32()))]
            blob = zstandard.ZstdCompressor(level=3).compress(b"".join(texts.cast(pa.binary()).to_pylist()))
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), *listed, pa.array([blob], pa.binary())], names=["node", "ids", "held", "sizes", "texts"])

        for batch in batches:
            batch = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2).fill_null("")], names=["doc_id", "held", "text"])
            for part in portions(pc.binary_length(batch.column(2)).to_pylist(), BLOCK_BYTES):
                some = batch.slice(part.start, part.stop - part.start)
                own = pc.sum(pc.binary_length(some.column(2))).as_py()
                if held and size + own > NODE_BYTES:
                    yield gathered()
                    held, size, number = [], 0, number + 1
                held.append(some)
                size += own
        if held:
            yield gathered()

    held_out = (fold_remainder("doc_id", FOLDS) == HELD_OUT).alias("held")
    return map_arrow(docs.select("doc_id", held_out, "text"), run, f"node long, ids array<{kind}>, held array<boolean>, sizes array<int>, texts binary")


def _opened(sizes: pa.ListScalar, held: pa.ListScalar, texts: bytes, order: int) -> list[Block]:
    lengths = sizes.values.to_numpy()
    ends = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    raw = zstandard.ZstdDecompressor().decompress(texts, max_output_size=max(1, int(ends[-1])))
    array = pa.StringArray.from_buffers(len(lengths), pa.py_buffer(ends.tobytes()), pa.py_buffer(raw))
    learning = ~held.values.to_numpy(zero_copy_only=False)
    return [Block(array[part], learning[part], order) for part in portions(lengths.tolist(), BLOCK_BYTES)]


def _merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, their sums, and the place of each key among them; a node has no key twice."""
    distinct, _, at = _distinct(np.concatenate(keys))
    return distinct, np.bincount(at, weights=np.concatenate(counts)).astype(np.int64), at


def _answered(nodes: list[int], parts: list[int], keys: list[np.ndarray], sums: np.ndarray, shared: np.ndarray, at: np.ndarray) -> dict[str, pa.Array]:
    """Rows of node, part, totals for all frames, whose keys' places are at: twice the sum, and one more if several nodes have the key."""
    totals = (2 * sums + (shared | (np.bincount(at, minlength=len(sums)) > 1)))[at]
    ends = np.cumsum([len(k) for k in keys]).tolist()
    answers = [_smallest(totals[a:z]) for a, z in zip([0, *ends], ends)]
    return {"node": pa.array(nodes, pa.int64()), "part": pa.array(parts, pa.int32()), "totals": pa.array(answers, pa.binary())}


def exchange(asked: DataFrame, n_nodes: int, n_keys: int, parts: int = 0) -> DataFrame:
    """asked: node, part, keys, counts, with parts (FAN at first) parts. Rows of node, part, totals; and tokens and types, the sums over distinct keys of words.

    A part that would hold too many keys is first merged from groups of nodes and cut further.
    """
    parts = parts or FAN

    def add_up(batches: pa.Table) -> pa.Table:
        keys = [_keys(k) for k in batches["keys"].to_pylist()]
        distinct, sums, at = _merged(keys, [_counts(c) for c in batches["counts"].to_pylist()])
        words = sums[(distinct & np.uint64(3)) == 1]
        rest = [0] * (len(keys) - 1)
        answers = _answered(batches["node"].to_pylist(), batches["part"].to_pylist(), keys, sums, np.zeros(len(sums), bool), at)
        return pa.table(answers | {"tokens": pa.array([int(words.sum()), *rest], pa.int64()), "types": pa.array([int((words > 0).sum()), *rest], pa.int64())})

    schema = "node long, part int, totals binary, tokens long, types long"
    if n_keys <= parts * PART_KEYS or parts * FAN >= 1 << 31:
        return asked.groupBy("part").applyInArrow(add_up, schema)

    groups = -(-n_nodes // FAN)
    asked = materialize(asked.withColumn("mid", F.col("part").cast("long") * groups + F.pmod(F.xxhash64("node"), F.lit(groups))))

    def merge(batches: pa.Table) -> pa.Table:
        distinct, sums, _ = _merged([_keys(k) for k in batches["keys"].to_pylist()], [_counts(c) for c in batches["counts"].to_pylist()])
        return pa.Table.from_batches([_frames(batches["mid"][0].as_py(), distinct, sums, parts * FAN)])

    def back(own: pa.Table, replies: pa.Table) -> pa.Table:
        keys = [_keys(k) for k in own["keys"].to_pylist()]
        distinct, _, at = _distinct(np.concatenate(keys))
        replies = replies.sort_by("part")
        totals = np.concatenate([_counts(c) for c in replies["totals"].to_pylist()])
        rest = [0] * (own.num_rows - 1)
        sums = {c: pa.array([pc.sum(replies[c]).as_py(), *rest], pa.int64()) for c in ("tokens", "types")}
        return pa.table(_answered(own["node"].to_pylist(), own["part"].to_pylist(), keys, totals >> 1, (totals & 1).astype(bool), at) | sums)

    finer = exchange(asked.groupBy("mid").applyInArrow(merge, _ASKED), parts * groups, n_keys, parts * FAN)
    return asked.groupBy("mid").cogroup(finer.withColumnRenamed("node", "mid").groupBy("mid")).applyInArrow(back, schema)


def score(docs: DataFrame, order: int = ORDER, masses: tuple[float, ...] = MASSES) -> DataFrame:
    """One row per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    nodes = materialize(_nodes(docs))
    n_nodes, n_docs, n_bytes = nodes.select(F.count("*"), F.sum(F.size("sizes")), F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, n: a + n))).first()
    most = (n_bytes or 0) + 2 * (n_docs or 0)  # a word takes two bytes with its space, and gives two keys at most in a round; a document has an end
    own = nodes.select("node", "held", "sizes", "texts")
    answers = None

    def replies_of(replies: pa.Table, rounds: int) -> list[np.ndarray]:
        """The answers of each round that came before, in the order of its keys."""
        replies = replies.sort_by([("round", "ascending"), ("part", "ascending")])
        of, blobs = replies["round"].to_pylist(), replies["totals"].to_pylist()
        return [np.concatenate([np.zeros(0, np.int64), *(_counts(b) for b, r in zip(blobs, of) if r == k)]) for k in range(rounds)]

    def asker(r: int):
        upto = [*_rounds(order)[r]][-1]

        def ask(own: pa.Table, replies: pa.Table) -> pa.Table:
            blocks = _opened(own["sizes"][0], own["held"][0], own["texts"][0].as_py(), upto)
            _, (keys, counts) = known_and_asked(blocks, upto, replies_of(replies, r))
            hand_back()
            return pa.Table.from_batches([_frames(own["node"][0].as_py(), keys, counts, FAN)])

        def ask_first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            nothing = pa.table({"round": pa.array([], pa.int32()), "part": pa.array([], pa.int32()), "totals": pa.array([], pa.binary())})
            for batch in batches:
                for i in range(batch.num_rows):
                    yield from ask(pa.Table.from_batches([batch.slice(i, 1)]), nothing).to_batches()

        return ask if r else ask_first

    n_tokens = n_types = 0
    for r in range(len(_rounds(order))):
        asked = own.groupBy("node").cogroup(answers.select("node", "part", "totals", "round").groupBy("node")).applyInArrow(asker(r), _ASKED) if r else map_arrow(own, asker(r), _ASKED)
        found = materialize(exchange(asked, n_nodes, most).withColumn("round", F.lit(r)))
        if not r:
            n_tokens, n_types = (v or 0 for v in found.agg(F.sum("tokens"), F.sum("types")).first())
        answers = answers.unionByName(found) if r else found
        del asked, found
        drop_finished(docs.sparkSession)

    def read(own: pa.Table, replies: pa.Table) -> pa.Table:
        out = []
        blocks = _opened(own["sizes"][0], own["held"][0], own["texts"][0].as_py(), order)
        known, _ = known_and_asked(blocks, order, replies_of(replies, len(_rounds(order))))
        for block, totals in zip(blocks, known):
            automaton = Automaton(block, totals, n_tokens, n_types, masses)
            tokens = block.grams[0]
            base = np.add.reduceat(automaton.base[tokens], block.starts) / math.log(10)
            found = np.add.reduceat(automaton.known[tokens].astype(np.int64), block.starts)
            scores = automaton.traverse() / math.log(10)
            out.append(pa.table({"n_tokens": pa.array(block.lengths, pa.int64()), "n_known": pa.array(found, pa.int64()), "train_tokens": pa.array([n_tokens] * len(scores), pa.int64()), "base_score": pa.array(base, pa.float64()), "score": pa.array(scores, pa.float64())}))
        del blocks, known, automaton, block
        hand_back()
        own = own.combine_chunks()
        return pa.concat_tables(out).add_column(0, "held_out", pa.array(own["held"][0].values)).add_column(0, "doc_id", pa.array(own["ids"][0].values))

    grouped = nodes.groupBy("node").cogroup(answers.select("node", "part", "totals", "round").groupBy("node"))
    return grouped.applyInArrow(read, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
