"""Toxicity of texts, after noisy-channel deobfuscation.

Tokens are what ASCII or Unicode blanks part. A token that may be disguised becomes a lattice:
each character stands for itself or for the letters it is written for, a run of one character
for one or two of it, a separator between single letters for nothing. Runs of single letters
with spaces between are one lattice, which may part into words. The Viterbi path under a
character trigram model is the restored text. Lattices of any length are decoded, in
overlapping parts of PART characters; any PART // 2 of them lie in one part.

A text's words are the runs of letters and digits in its tokens, and in restored ones. They are
scored by logistic regression on whether the text has certain words and word beginnings; in a
word of over LONGEST_WORD letters words may be hidden, so that it has beginnings at each letter. Trigrams
are counted over all documents of the training folds, of letters mapped to an alphabet of some
130 symbols, which bounds them. Weights are learnt from at most TRAIN_DOCS labelled documents of the
training folds (the lowest hashes of their ids); the features of most weight, MAX_FEATURES at
most, go to the driver. A text's score depends on its words alone.

Cases: a null or empty text is scored like a text with none of the features. Without labels of
both kinds every score is the share of label 1, or 0. Repeated rows are scored alike. An empty
table gives an empty result. A null id belongs to fold 0.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold_remainder, hand_back, id_field, map_arrow, materialize, portions

FOLDS = 3
HELD_OUT = 1
TRAIN_DOCS = 8000
MAX_FEATURES = 800
LEAST_DOCS = 4
PREFIXES = (3, 4, 5, 6)
LONGEST_WORD = 24
THRESHOLD = 0.7
RIDGE = 0.002
BATCH_BYTES = 1 << 23
MEMO = 1 << 19

#: Letters that a character is written for.
LEET = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "(": "c"}
SEPARATORS = ".-_*~ "
#: Costs of the channel, in natural logarithms.
LEET_COST, RUN_COST, DOUBLE_COST, SEPARATOR_COST, BREAK_COST = 1.0, 0.5, 1.5, 0.3, 0.7

#: Characters of a lattice that are decoded together, and of a token that a worker remembers.
PART = 96
REMEMBERED = 64

_EDGE = re.compile(r"^[^\w@$!|+€(]+|[^\w@$]+$")
_TAIL = re.compile(r"[^\w]+$")
_DISGUISED = re.compile(r"(?=.*[^\W\d_])(?:.*[013457@$!|+€(89]|.*(.)\1\1|(?:\w[.\-_*~]){2,}\w$)")
_BLANKS = r"[\x{85}\p{Z}]"
_PIECE = re.compile(r"[^\W_]+")
_LONG_RUN = re.compile(r"(.)\1{3,}")

#: The alphabet of the character model: ASCII letters and digits, Latin-1's small letters, and for all others one of 58 symbols.
BEGIN, END = "^", "$"
_OWN = "abcdefghijklmnopqrstuvwxyz0123456789" + "".join(map(chr, range(0xDF, 0x100)))
_SHARED = [chr(0xE000 + k) for k in range(58)]
ALPHABET = BEGIN + END + _OWN + "".join(_SHARED)


class _Symbols(dict):
    """Symbols of characters, as they come."""

    def __missing__(self, c: str) -> str:
        self[c] = c if c in _OWN else _SHARED[ord(c) % len(_SHARED)]
        return self[c]


symbol = _Symbols()
_CODES: list[np.ndarray] = []


def _codes() -> np.ndarray:
    """For each code point the place of its symbol in ALPHABET, 0 if it is no letter; made once for each worker."""
    if not _CODES:
        letters = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
        codes = 2 + len(_OWN) + np.arange(0x110000) % len(_SHARED)
        codes[list(map(ord, _OWN))] = 2 + np.arange(len(_OWN))
        _CODES.append(np.where(letters, codes, 0).astype(np.int64))
    return _CODES[0]


class CharModel:
    """P(c | two symbols before), each order interpolated with the one below; BEGIN and END stand around a word."""

    def __init__(self, trigrams: dict[str, int]):
        self.three, self.two, self.one = Counter(trigrams), Counter(), Counter()
        self.after_two, self.after_one, self.total = Counter(), Counter(), 0
        for g, n in trigrams.items():
            self.two[g[1:]] += n
            self.one[g[2]] += n
            self.after_two[g[:2]] += n
            self.after_one[g[1]] += n
            self.total += n
        self.size = len(self.one) + 1000
        self.memo: dict[tuple[str, str], float] = {}

    def log(self, before: str, c: str) -> float:
        key = (before, c)
        if key not in self.memo:
            p = (self.one[c] + 0.1) / (self.total + 0.1 * self.size)
            p = (self.two[before[1] + c] + 4 * p) / (self.after_one[before[1]] + 4)
            self.memo[key] = math.log((self.three[before + c] + 4 * p) / (self.after_two[before] + 4))
        return self.memo[key]


def _arcs(text: str, i: int) -> Iterator[tuple[int, str, float]]:
    """(end, letters, cost) of the ways on from a place; a space among the letters parts words."""
    c = text[i]
    if c in SEPARATORS:
        yield i + 1, "", SEPARATOR_COST
        if c == " ":
            yield i + 1, " ", BREAK_COST
            return
    run = i + 1
    while run < len(text) and text[run] == c:
        run += 1
    for letter, cost in ((c, 0.0), *((x, LEET_COST) for x in LEET.get(c, ""))):
        yield i + 1, letter, cost
        if run - i >= 2:
            yield run, letter, cost + (RUN_COST if run - i > 2 else DOUBLE_COST)
        if run - i >= 3:
            yield run, letter * 2, cost + RUN_COST


def decode(text: str, model: CharModel) -> str:
    """The likeliest source of a disguised text; exact Viterbi over (place, last two characters)."""
    best: list[dict[str, tuple[float, str]]] = [{} for _ in range(len(text) + 1)]
    best[0][BEGIN * 2] = (0.0, "")
    for i in range(len(text)):
        if not best[i]:
            continue
        arcs = list(_arcs(text, i))
        for before, (score, out) in best[i].items():
            for end, letters, cost in arcs:
                s, h = score - cost, before
                for letter in letters:
                    if letter == " ":
                        s, h = s + model.log(h, END), BEGIN * 2
                    else:
                        letter = symbol[letter]
                        s, h = s + model.log(h, letter), h[1] + letter
                at = best[end]
                if h not in at or s > at[h][0]:
                    at[h] = (s, out + letters)
    ends = [(s + model.log(h, END), out) for h, (s, out) in best[-1].items()]
    return max(ends)[1] if ends else text


def plain(token: str) -> str:
    """A token in lower case without marks around it."""
    return _TAIL.sub("", _EDGE.sub("", token.lower()))


def _parts(n: int) -> Iterator[slice]:
    """Overlapping parts of something n long."""
    yield from (slice(at, at + PART) for at in range(0, max(1, n - PART // 2), PART // 2))


def restored(token: str, model: CharModel) -> str:
    """A token without marks around it, and without disguise; of a long lattice its parts, which overlap, with spaces between."""
    word = _LONG_RUN.sub(r"\1\1\1", plain(token))
    return " ".join(decode(word[p], model) for p in _parts(len(word))) if _DISGUISED.match(word) else word


_DOUBLED, _TRIPLED = re.compile(r"(.)\1+"), re.compile(r"(.)\1\1")


def features_of(word: str) -> list[str]:
    """A word, doubled letters written once, and its beginnings (a long one's at each letter); marked so that they can't be taken for each other."""
    word = _DOUBLED.sub(r"\1", word)
    if len(word) < 3:
        return []
    starts = range(len(word) - 2 if len(word) > LONGEST_WORD else 1)
    return [*{"^" + word[i : i + n] for i in starts for n in PREFIXES if len(word) - i > n or i and len(word) - i == n}, "=" + word]


def token_features(token: str, model: CharModel) -> set[str]:
    """Features of a token's words, as written and restored."""
    bare = token.rstrip(".,;:!?")
    if bare.isalpha() and not _TRIPLED.search(word := bare.lower()):
        return set(features_of(word))  # one word without disguise: what follows would give the same
    words = {*_PIECE.findall(token.lower()), *_PIECE.findall(restored(token, model))}
    return {f for w in words for f in features_of(w)}


@dataclass
class Scorer:
    """Everything learnt: the channel's trigrams, and a weight for each feature."""

    trigrams: dict[str, int]
    weights: dict[str, float]
    bias: float
    _model: CharModel | None = field(default=None, repr=False)

    def __getstate__(self):
        return self.__dict__ | {"_model": None}

    @property
    def model(self) -> CharModel:
        if self._model is None:
            self._model = CharModel(self.trigrams)
        return self._model

    def score(self, found: set[str]) -> float:
        z = self.bias + sum(self.weights[f] for f in sorted(found))
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, z))))


def hits(texts: pa.Array, model: CharModel, wanted: dict[str, float] | None, memo: dict[str, tuple[str, ...]]) -> Iterator[set[str]]:
    """For each text, the wanted features (all, if None) of its restored words."""
    texts = texts.fill_null("")
    for part in portions(pc.binary_length(texts).to_pylist(), BATCH_BYTES):
        split = pc.ascii_split_whitespace(pc.replace_substring_regex(texts[part], _BLANKS, " "))
        coded = split.flatten().dictionary_encode()
        tokens = coded.dictionary.to_pylist()
        if len(memo) > MEMO:
            memo.clear()
        own = []
        for t in tokens:
            if (f := memo.get(t)) is None:
                f = tuple(x for x in token_features(t, model) if wanted is None or x in wanted)
                if len(t) <= REMEMBERED:
                    memo[t] = f
            own.append(f)
        order = coded.indices.to_numpy()
        has = np.array([bool(f) for f in own], bool)[order] if len(own) else np.zeros(0, bool)
        single = np.array([len(t) == 1 for t in tokens], bool)[order] if len(own) else np.zeros(0, bool)
        bounds = (split.offsets.to_numpy() - split.offsets[0].as_py()).tolist()
        for a, b in zip(bounds, bounds[1:]):
            found: set[str] = set()
            for k in np.unique(order[a:b][has[a:b]]).tolist():
                found.update(own[k])
            alone = single[a:b]
            if len(alone) > 3 and (alone[:-3] & alone[1:-2] & alone[2:-1] & alone[3:]).any():
                for run in _spelled([tokens[k] for k in order[a:b].tolist()]):
                    for word in _PIECE.findall(decode(run, model)):
                        found.update(x for x in features_of(word) if wanted is None or x in wanted)
            yield found


def _spelled(tokens: list[str]) -> Iterator[str]:
    """Runs of four or more single characters, with spaces between, in lower case; long ones in overlapping parts."""
    run: list[str] = []
    for t in [*tokens, ""]:
        if len(t) == 1 and (t.isalnum() or t in LEET):
            run.append(t.lower())
            continue
        for p in _parts(len(run)):
            if len(run[p]) >= 4:
                yield " ".join(run[p])
        run = []


# -- training ------------------------------------------------------------------------------


def _sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    chosen = labels.where("toxic is not null").where(fold_remainder("doc_id", FOLDS) != HELD_OUT).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "toxic").limit(TRAIN_DOCS)
    joined = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # TRAIN_DOCS rows
    return joined.orderBy(F.xxhash64("doc_id"), F.xxhash64("text"), "toxic").limit(TRAIN_DOCS).select("text", "toxic")


#: What no word has that is written as it is spoken.
_NOT_PLAIN = r"[0-9@$|+€(]|!."


def trigram_counts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct trigrams of the runs of letters in texts, as three places in ALPHABET of 8 bits each, and how often they come."""
    counted = pc.ascii_split_whitespace(pc.replace_substring_regex(pc.utf8_lower(texts.fill_null("")), _BLANKS, " ")).flatten().value_counts()
    counted = counted.filter(pc.invert(pc.match_substring_regex(counted.field(0), _NOT_PLAIN)))
    points = np.frombuffer(("\n".join(counted.field(0).to_pylist()) + "\n").encode("utf-32-le"), np.uint32)
    times = np.append(counted.field(1).to_numpy(), 0)[np.cumsum(points == 10) - (points == 10)]
    one = _codes()[points]
    begin, end = ALPHABET.index(BEGIN), ALPHABET.index(END)
    two, three = np.append(0, one[:-1]), np.append([0, 0], one[:-2])[: len(one)]
    three = np.where((two > 0) & (three > 0), three, begin)
    real, last = one > 0, (one == 0) & (two > 0)
    codes = np.concatenate([((three << 16) + (np.where(two > 0, two, begin) << 8) + one)[real], ((three << 16) + (two << 8) + end)[last]])
    distinct, at = np.unique(codes, return_inverse=True)
    return distinct, np.bincount(at, weights=np.concatenate([times[real], np.append(0, times[:-1])[last]])).astype(np.int64)


def _count_trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """At most a row for each trigram of the alphabet from a task."""
    codes, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for batch in batches:
        more, times = trigram_counts(batch.column(0))
        codes, at = np.unique(np.concatenate([codes, more]), return_inverse=True)
        counts = np.bincount(at, weights=np.concatenate([counts, times]), minlength=len(codes)).astype(np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(codes, pa.int64()), pa.array(counts, pa.int64())], names=["code", "n"])


def train(docs: DataFrame, labels: DataFrame) -> Scorer:
    learnt = docs.where(fold_remainder("doc_id", FOLDS) != HELD_OUT).select("text")
    grams = map_arrow(learnt, _count_trigrams, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).collect()  # len(ALPHABET) ** 3 rows at most
    trigrams = {"".join(ALPHABET[r.code >> k & 255] for k in (16, 8, 0)): r.n for r in grams}
    sample = materialize(_sample(docs, labels).repartition(max(4, docs.sparkSession.sparkContext.defaultParallelism)))
    totals = {r.toxic: r["count"] for r in sample.groupBy("toxic").count().collect()}
    if len(totals) < 2:
        share = totals.get(1, 0) / max(1, sum(totals.values()))
        return Scorer(trigrams, {}, math.log(max(share, 1e-12) / max(1 - share, 1e-12)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, counts = CharModel(trigrams), (Counter(), Counter())
        memo: dict[str, tuple[str, ...]] = {}
        for batch in batches:
            for found, toxic in zip(hits(batch.column(0), model, None, memo), batch.column(1).to_pylist()):
                counts[toxic].update(found)
        names = list(counts[1])
        yield pa.RecordBatch.from_pydict({"f": names, "pos": [counts[1][f] for f in names], "neg": [counts[0][f] for f in names]}, schema=pa.schema([("f", pa.string()), ("pos", pa.int64()), ("neg", pa.int64())]))
        rest = [f for f in counts[0] if f not in counts[1]]
        yield pa.RecordBatch.from_pydict({"f": rest, "pos": [0] * len(rest), "neg": [counts[0][f] for f in rest]}, schema=pa.schema([("f", pa.string()), ("pos", pa.int64()), ("neg", pa.int64())]))

    ratio = F.log((F.col("pos") + 0.5) / totals[1] / ((F.col("neg") + 0.5) / totals[0]))
    counted = map_arrow(sample, count, "f string, pos long, neg long").groupBy("f").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    chosen = counted.where(F.col("pos") >= LEAST_DOCS).where(ratio > 1).orderBy((F.col("pos") * ratio).desc(), "f").limit(MAX_FEATURES).collect()
    names = sorted(r.f for r in chosen)
    place = {f: i for i, f in enumerate(names)}

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, memo = CharModel(trigrams), {}
        for batch in batches:
            rows = [np.array(sorted(place[f] for f in found), "<u2").tobytes() for found in hits(batch.column(0), model, place, memo)]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary()), batch.column(1)], names=["x", "toxic"])

    rows = map_arrow(sample, find, "x binary, toxic int").groupBy("x", "toxic").count().collect()  # at most TRAIN_DOCS
    weights, bias = _logistic(sorted((bytes(r.x), r.toxic, r["count"]) for r in rows), len(names))
    del rows, grams, chosen
    hand_back()
    return Scorer(trigrams, dict(zip(names, weights)), bias)


def _logistic(rows: list[tuple[bytes, int, int]], width: int) -> tuple[list[float], float]:
    """Ridge logistic regression with classes of equal weight at most, by accelerated gradient steps."""
    x = np.zeros((len(rows), width + 1), np.float32)
    x[:, -1] = 1
    for i, (bits, _, _) in enumerate(rows):
        x[i, np.frombuffer(bits, "<u2")] = 1
    y = np.array([r[1] for r in rows], float)
    n = np.array([r[2] for r in rows], float)
    n[y == 1] *= min(10.0, max(1.0, n[y == 0].sum() / max(1.0, n[y == 1].sum())))
    n /= n.sum()
    ridge = np.full(width + 1, RIDGE / 100)
    ridge[-1] = 0
    step = 1 / (0.25 * float((n[:, None] * x).sum(axis=0) @ np.ones(width + 1)) + ridge.max())
    step = max(step, 1 / (0.25 * np.linalg.norm(np.sqrt(n)[:, None] * x, 2) ** 2 + ridge.max()))
    w = ahead = np.zeros(width + 1)
    t = 1.0
    for _ in range(1500):
        gradient = x.T @ (n * (1 / (1 + np.exp(-np.clip(x @ ahead, -40, 40))) - y)) + ridge * ahead
        following = ahead - step * gradient
        t, before = (1 + math.sqrt(1 + 4 * t * t)) / 2, t
        ahead = following + (before - 1) / t * (following - w)
        w = following
    return [float(v) for v in w[:-1]], float(w[-1])


# -- scoring -------------------------------------------------------------------------------


def score(docs: DataFrame, scorer: Scorer) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted."""
    kind = id_field(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, tuple[str, ...]] = {}
        for batch in batches:
            scores = [scorer.score(found) for found in hits(batch.column(2), scorer.model, scorer.weights, memo)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores, pa.float64()), pa.array([int(s >= THRESHOLD) for s in scores], pa.int32())], names=["doc_id", "held_out", "score", "predicted"])

    held_out = (fold_remainder("doc_id", FOLDS) == HELD_OUT).alias("held_out")
    return map_arrow(docs.select("doc_id", held_out, "text"), run, f"{kind}, held_out boolean, score double, predicted int")
