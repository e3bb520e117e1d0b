"""Quality rules: base statistics, and a linear-chain conditional random field over lines.

Every line with a word has a feature vector; Viterbi decoding labels the lines content or
boilerplate, and a document is kept if content lines hold KEEP_SHARE of its words. Documents of
fewer than LEAST_WORDS words, or with over half of their words in repeated windows of three,
fail beforehand.

Training: at most TRAIN_DOCS labelled documents (the lowest hashes of their ids), as long as
fewer than TRAIN_LINES lines came before; their texts are whole, long ones in sequences of
SEQUENCE lines. Labels are of documents, lines get theirs in steps. In good documents only a
line's repeats are boilerplate. In bad ones all lines are at first; a field without transitions
then gives back those that look like lines of good documents, though never a document's least
content-like line, and a field with transitions is fitted to that and decodes them once more.
The log-likelihood is climbed with Adam on the driver, which sees feature vectors only. Without
labels of both kinds there is no field, and what passes the base rules is kept.

Cases: a null text has no words and fails. Lines without a word are not labelled. Repeated rows
are judged alike. An empty table gives an empty result. A null id is carried along.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import hand_back, id_field, map_arrow, portions

LEAST_WORDS = 50
KEEP_SHARE = 0.5
TRAIN_DOCS = 3000
TRAIN_LINES = 200_000
SEQUENCE = 32
ROUNDS = 60
RIDGE = 1e-3
BATCH_BYTES = 1 << 22

#: The characters that count as symbols.
SYMBOLS = b"#*$%&|<>"
_LOWER, _UPPER, _DIGIT, _SPACE, _SYMBOL, _STOP, _OTHER, _LEAD, _REST, _BREAK = range(10)


def _byte_classes() -> np.ndarray:
    out = np.full(256, _OTHER, np.int64)
    out[ord("a") : ord("z") + 1] = _LOWER
    out[ord("A") : ord("Z") + 1] = _UPPER
    out[ord("0") : ord("9") + 1] = _DIGIT
    out[list(b" \t\x0b\x0c\r")] = _SPACE
    out[ord("\n")] = _BREAK
    out[list(SYMBOLS)] = _SYMBOL
    out[list(b".,;:!?")] = _STOP
    out[0x80:0xC0] = _REST
    out[0xC0:] = _LEAD
    return out


_CLASSES = _byte_classes()
FEATURES = 11
#: Which feature tells that an earlier line is equal.
REPEATS = 9


@dataclass(frozen=True)
class Field:
    """emission[f, y] and transition[y before, y]; label 1 is content."""

    emission: np.ndarray
    transition: np.ndarray


@dataclass
class Page:
    """One document's statistics, and its lines that have words."""

    n_words: int
    word_chars: int
    n_symbols: int
    n_dup_lines: int
    n_repeat_words: int
    features: np.ndarray
    line_words: np.ndarray

    @property
    def base_failed(self) -> bool:
        return self.n_words < LEAST_WORDS or 100 * self.n_repeat_words > 50 * self.n_words


def _repeated(ids: np.ndarray) -> int:
    """Words in windows of three that occur twice or more; ids are below 2**21."""
    if len(ids) < 4:
        return 0
    keys = (ids[:-2] << 42) | (ids[1:-1] << 21) | ids[2:]
    _, at, counts = np.unique(keys, return_inverse=True, return_counts=True)
    twice = counts[at] > 1
    if not twice.any():
        return 0
    marked = np.zeros(len(ids), bool)
    marked[:-2] |= twice
    marked[1:-1] |= twice
    marked[2:] |= twice
    return int(marked.sum())


def read_page(text: bytes, word_ids: np.ndarray) -> Page:
    raw = np.frombuffer(text, np.uint8)
    kinds = _CLASSES[raw]
    lines = text.split(b"\n")
    line_of = np.cumsum(kinds == _BREAK)
    counts = np.bincount(line_of * 10 + kinds, minlength=10 * len(lines)).reshape(-1, 10)
    words = np.array([len(s.split()) for s in lines])
    seen: set[bytes] = set()
    repeats = np.zeros(len(lines), bool)
    stops = np.zeros(len(lines), bool)
    for i, s in enumerate(lines):
        if words[i]:
            repeats[i] = s in seen
            seen.add(s)
            stops[i] = s.rstrip()[-1:] in b".!?"
    total = counts.sum(axis=0)
    live = words > 0
    c, w = counts[live].astype(float), words[live]
    chars = c.sum(axis=1) - c[:, _REST] - c[:, _BREAK]
    inked = chars - c[:, _SPACE]
    letters = c[:, _LOWER] + c[:, _UPPER] + c[:, _LEAD]
    features = np.stack(
        [
            np.ones(len(w)),
            c[:, _SYMBOL] / inked,
            c[:, _SYMBOL] > 0,
            c[:, _UPPER] / np.maximum(letters, 1),
            c[:, _DIGIT] / inked,
            c[:, _STOP] / inked,
            c[:, _OTHER] / inked,
            np.minimum(np.log1p(w) / 6, 2),
            np.minimum(inked / w / 20, 2),
            repeats[live],
            stops[live],
        ],
        axis=1,
    )
    in_words = int(total.sum() - total[_REST] - total[_SPACE] - total[_BREAK])
    return Page(len(word_ids), in_words, int(total[_SYMBOL]), int(repeats.sum()), _repeated(word_ids), features, w)


def pages_of(texts: pa.Array) -> Iterator[Page]:
    texts = texts.fill_null("")
    for part in portions(pc.binary_length(texts).to_pylist(), BATCH_BYTES):
        some = texts[part]
        split = pc.ascii_split_whitespace(some)
        flat = split.flatten()
        coded = flat.dictionary_encode()
        ids = coded.indices.to_numpy().astype(np.int64)
        real = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
        bounds = (split.offsets.to_numpy() - split.offsets[0].as_py()).tolist()
        small = len(coded.dictionary) < 1 << 21
        for text, a, b in zip(some.cast(pa.binary()).to_pylist(), bounds, bounds[1:]):
            own = ids[a:b][real[a:b]]
            yield read_page(text, own if small else np.unique(own, return_inverse=True)[1].astype(np.int64))


# -- the field -----------------------------------------------------------------------------


def viterbi(emitted: np.ndarray, transition: np.ndarray) -> list[int]:
    """The likeliest labels of a line sequence; ties go to content."""
    (t00, t01), (t10, t11) = transition.tolist()
    back = []
    a, b = emitted[0].tolist()
    for e, f in emitted[1:].tolist():
        a0, a1, b0, b1 = a + t00, b + t10, a + t01, b + t11
        back.append((a1 >= a0, b1 >= b0))
        a, b = max(a0, a1) + e, max(b0, b1) + f
    label = int(b >= a)
    out = [label]
    for step in reversed(back):
        label = int(step[label])
        out.append(label)
    return out[::-1]


def content_share(page: Page, field: Field) -> float:
    if not len(page.line_words):
        return 0.0
    labels = np.array(viterbi(page.features @ field.emission, field.transition))
    return float((page.line_words * labels).sum() / page.line_words.sum())


def likelihood_gradient(x: np.ndarray, y: np.ndarray, real: np.ndarray, emission: np.ndarray, transition: np.ndarray):
    """Of sequences side by side: x (docs, lines, features), y (docs, lines), real (docs, lines)."""
    n, t, _ = x.shape
    e = x @ emission
    forward, backward = np.zeros((n, t, 2)), np.zeros((n, t, 2))
    forward[:, 0] = e[:, 0]
    for i in range(1, t):
        step = np.logaddexp(forward[:, i - 1, :1] + transition[0], forward[:, i - 1, 1:] + transition[1]) + e[:, i]
        forward[:, i] = np.where(real[:, i, None], step, forward[:, i - 1])
    for i in range(t - 2, -1, -1):
        ahead = e[:, i + 1] + backward[:, i + 1]
        step = np.logaddexp(ahead[:, :1] + transition[:, 0], ahead[:, 1:] + transition[:, 1])
        backward[:, i] = np.where(real[:, i + 1, None], step, 0.0)
    norm = np.logaddexp(forward[:, -1, 0], forward[:, -1, 1])
    ones = np.eye(2)[y]
    single = np.exp(forward + backward - norm[:, None, None]) * real[:, :, None]
    d_emission = np.einsum("ntf,nty->fy", x, (ones * real[:, :, None]) - single)
    pair = forward[:, :-1, :, None] + transition + (e + backward)[:, 1:, None, :] - norm[:, None, None, None]
    both = real[:, 1:, None, None]
    d_transition = ((ones[:, :-1, :, None] * ones[:, 1:, None, :] - np.exp(pair)) * both).sum(axis=(0, 1))
    score = (e * ones * real[:, :, None]).sum(axis=(1, 2)) + (transition[y[:, :-1], y[:, 1:]] * real[:, 1:]).sum(axis=1)
    return float((score - norm).sum()), d_emission, d_transition


def fit(sequences: list[np.ndarray], labels: list[np.ndarray], start: Field | None = None, chained: bool = True) -> Field:
    """Climbs the log-likelihood of labelled sequences; the same result for the same rows in the same order.

    Not chained: transitions stay zero, so that each line is judged by itself.
    """
    longest = max(len(s) for s in sequences)
    x = np.zeros((len(sequences), longest, FEATURES))
    real = np.zeros((len(sequences), longest), bool)
    y = np.zeros((len(sequences), longest), int)
    for row, i in enumerate(sorted(range(len(sequences)), key=lambda i: len(sequences[i]))):
        x[row, : len(sequences[i])] = sequences[i]
        real[row, : len(sequences[i])] = True
        y[row, : len(sequences[i])] = labels[i]
    if not chained:  # every line a sequence
        x, y, real = x[real][:, None], y[real][:, None], np.ones((int(real.sum()), 1), bool)
    groups = [g for g in np.array_split(np.arange(len(x)), 4) if len(g)]
    parts = [(x[g][:, : int(real[g].sum(axis=1).max())], y[g][:, : int(real[g].sum(axis=1).max())], real[g][:, : int(real[g].sum(axis=1).max())]) for g in groups]
    lines = real.sum()
    theta = np.zeros(FEATURES * 2 + 4) if start is None else np.concatenate([start.emission.ravel(), start.transition.ravel()])
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    for k in range(1, ROUNDS + 1):
        emission, transition = theta[:-4].reshape(FEATURES, 2), theta[-4:].reshape(2, 2)
        gradient = np.zeros_like(theta)
        for part in parts:
            _, de, dt = likelihood_gradient(*part, emission, transition)
            gradient += np.concatenate([de.ravel(), dt.ravel()]) / lines
        gradient -= RIDGE * theta
        first, second = 0.9 * first + 0.1 * gradient, 0.99 * second + 0.01 * gradient**2
        theta = theta + 0.15 * (first / (1 - 0.9**k)) / (np.sqrt(second / (1 - 0.99**k)) + 1e-9)
    return Field(theta[:-4].reshape(FEATURES, 2), theta[-4:].reshape(2, 2))


def first_labels(features: np.ndarray, quality: int) -> np.ndarray:
    """Labels of a document's lines before any field: bad documents have no content, good ones no boilerplate but repeats."""
    return np.where(features[:, REPEATS] > 0, 0, 1) if quality else np.zeros(len(features), int)


def relabelled(features: np.ndarray, field: Field) -> np.ndarray:
    """Decoded labels of a bad document's lines, of which the least content-like stays boilerplate."""
    emitted = features @ field.emission
    labels = np.array(viterbi(emitted, field.transition))
    labels[np.argmin(emitted[:, 1] - emitted[:, 0])] = 0
    return labels


def learn(pages: list[tuple[np.ndarray, int]]) -> Field | None:
    """A field from documents' features and their quality, 0 or 1."""
    if len({quality for _, quality in pages}) < 2:
        return None
    pages = sorted(pages, key=lambda p: (len(p[0]), p[1], p[0].tobytes()))
    cuts = [range(SEQUENCE, len(f), SEQUENCE) for f, _ in pages]
    pieces = lambda arrays: [part for a, c in zip(arrays, cuts) for part in np.split(a, c)]
    sequences, labels, field = pieces([f for f, _ in pages]), [first_labels(f, q) for f, q in pages], None
    for chained in (False, True, True):
        field = fit(sequences, pieces(labels), field, chained)
        labels = [own if q else relabelled(f, field) for (f, q), own in zip(pages, labels)]
    return field


def train(docs: DataFrame, labels: DataFrame) -> Field | None:
    """A field from labels (doc_id, quality 0 or 1) of documents."""
    chosen = labels.where("quality is not null").select("doc_id", F.col("quality").cast("int").alias("quality")).orderBy(F.xxhash64("doc_id"), "quality").limit(TRAIN_DOCS)
    order = [F.xxhash64("doc_id"), F.xxhash64("text"), F.col("quality")]
    some = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").orderBy(*order).limit(TRAIN_DOCS)  # TRAIN_DOCS rows, as chosen
    lines = F.size(F.split("text", "\n"))
    before = F.sum(lines).over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))  # over TRAIN_DOCS rows
    some = some.withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < TRAIN_LINES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = [p.features.astype(np.float32).tobytes() for p in pages_of(batch.column(0))]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(vectors, pa.binary())], names=["quality", "features"])

    rows = map_arrow(some.select("text", "quality"), run, "quality int, features binary").where("length(features) > 0").collect()
    field = learn([(np.frombuffer(r.features, np.float32).reshape(-1, FEATURES).astype(float), r.quality) for r in rows])
    del rows
    hand_back()
    return field


def judge(page: Page, field: Field | None) -> tuple[bool, float]:
    """Whether a document is kept, and its content share (1 without a field)."""
    share = 1.0 if field is None else content_share(page, field)
    return not page.base_failed and share >= KEEP_SHARE, share


def assess(docs: DataFrame, field: Field | None) -> DataFrame:
    """One row per row of docs: doc_id, the base statistics, base_failed, kept, content_share."""
    kind = id_field(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(p.n_words, p.word_chars, p.n_symbols, p.n_dup_lines, p.n_repeat_words, p.base_failed, *judge(p, field)) for p in pages_of(batch.column(1))]
            columns = list(zip(*rows)) or [()] * 8
            types = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types))], names=["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "content_share"])

    longs = ", ".join(f"{c} long" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))
    return map_arrow(docs.select("doc_id", "text"), run, f"{kind}, {longs}, base_failed boolean, kept boolean, content_share double")


def keep_good(docs: DataFrame, field: Field | None) -> DataFrame:
    """The rows of docs that are kept, whole; nothing is shuffled."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([judge(p, field)[0] for p in pages_of(batch.column(at))], pa.bool_()))

    return map_arrow(docs, run, docs.schema)
