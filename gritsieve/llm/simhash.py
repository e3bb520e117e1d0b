"""Near-duplicates by SimHash fingerprints and meet-in-the-middle ball hashing.

Two 64-bit fingerprints within 2 bits of each other have a common neighbour within 1 bit of
both. Every distinct fingerprint therefore emits its 65 variants within half the radius, and the
shuffle on variants brings every linked pair together. Fingerprints that meet under one variant
are within 2 bits of each other, so there are at most 65 of them, and linking each to the next
gives the same components as all pairs would. Colliding pairs are verified all the same.

Texts with one fingerprint form one class before anything is emitted, so that copies cost
nothing. Components come from distributed star contraction.

Cases: a null or empty text has fingerprint zero and is linked like any other. A row with a null
id takes part; component_id is the smallest id that is not null, or null if there is none.
Repeated rows appear as often as they came. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import drop_finished, id_field, join_by_key, map_arrow, map_groups, materialize, portions, text_or_empty, words_of
from .components import connected_components

SHINGLE = 3
SEED = 42
RADIUS = 2
_CHUNK = 1 << 14


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The unsigned 64-bit fingerprint: a bit is set if it is in over half of the shingles' hashes."""
    words = words_of(text)
    if not words:
        return 0
    pieces = [b" ".join(words)] if len(words) < shingle else map(b" ".join, zip(*(words[i:] for i in range(shingle))))
    digest = xxhash.xxh64_digest
    hashes = b"".join([digest(p, seed) for p in pieces])
    total = len(hashes) // 8
    votes = np.zeros(64, np.int64)
    raw = np.frombuffer(hashes, np.uint8).reshape(total, 8)
    for at in range(0, total, _CHUNK):
        votes += np.unpackbits(raw[at : at + _CHUNK], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(votes * 2 > total).tobytes(), "big")


def row_key(docs: DataFrame) -> Column:
    """16 bytes that tell rows of different id or text apart."""
    whole = F.concat(F.coalesce(F.concat(F.lit("="), F.col("doc_id").cast("string")), F.lit("")), F.lit("\0"), text_or_empty())
    return F.unhex(F.md5(whole.cast("binary")))


def with_fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, row_key): the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([fingerprint(t) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64)), batch.column(2)], names=["doc_id", "fp", "row_key"])

    return map_arrow(docs.select("doc_id", "text", row_key(docs).alias("row_key")), run, f"{id_field(docs)}, fp long, row_key binary")


def _bit(i: int) -> Column:
    value = 1 << i
    return F.lit(value - (1 << 64) if i == 63 else value).cast("long")


def links_within_radius(prints: DataFrame) -> DataFrame:
    """prints: distinct fp. Links (u, v) between fingerprints at 1 or 2 differing bits; enough of them to connect all that are."""
    variants = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(_bit(i)) for i in range(64)])
    emitted = prints.select("fp", F.explode(variants).alias("variant"))
    before = F.lag("fp").over(Window.partitionBy("variant").orderBy("fp"))
    met = emitted.select(F.col("fp").alias("u"), before.alias("v")).where("v is not null")
    return met.where(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= RADIUS).distinct()


def _with_component(rooted: DataFrame) -> DataFrame:
    """Adds component_id, the least first_id of a root's rows; a large component's rows don't meet in one task."""
    least = materialize(rooted.groupBy("root").agg(F.min("first_id").alias("component_id"), F.count("*").alias("members")))
    return join_by_key(rooted, least, "root", "members", rooted.count())


def near_duplicate_components(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, fp, component_id, root (which tells components apart that have no id), row_key."""
    printed = materialize(with_fingerprints(docs))
    classes = materialize(printed.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")))
    found = connected_components(links_within_radius(classes.select("fp")))
    rooted = materialize(classes.join(found, classes.fp == found.node, "left").select("fp", "first_id", "n", F.coalesce("root", "fp").alias("root")))
    named = materialize(_with_component(rooted).select("fp", "component_id", "root", "n"))
    return join_by_key(printed, named, "fp", "n", printed.count()).select("doc_id", "fp", "component_id", "root", "row_key")


# -- similar texts ---------------------------------------------------------------------------
#
# Texts that share 80 % of their five-word shingles have fingerprints some ten bits apart; ball
# hashing at radius 2 sees few of them. It finds candidates all the same, and bands of least
# hashes find the rest: BANDS keys of ROWS least hashes each, of which two texts of similarity s
# have one in common with probability 1 - (1 - s^ROWS)^BANDS, 0.99993 at 0.8. Texts that meet are
# compared by their least hashes, and those that may be similar enough form clusters. In a cluster
# links are verified on whole sets of shingles, exactly. Neither step sends pairs: texts of
# one key, or of one cluster, meet in lots of bounded size, each two lots in a group of their
# own, and a group gives a spanning forest.

WORDS, SIMILARITY = 5, 0.8
BANDS, ROWS = 24, 5
#: Pairs whose estimate is lower than the similarity by more than this aren't verified: four and a half standard errors at 0.8.
MARGIN = 0.165
#: Texts in a lot on average, and shingles in a lot of a cluster.
LOT, LOT_SHINGLES = 1024, 1 << 20
#: Keys of 16 bytes that are broadcast at most.
BROADCAST_KEYS = 1 << 20
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0x9E3779B97F4A7C15 * 3 % (1 << 64)))


def _scrambled(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    return x ^ (x >> np.uint64(29))


#: An odd factor for each least hash.
_FACTORS = _scrambled(_scrambled(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64))) | np.uint64(1)


def shingle_set(text: str | None, words: int = WORDS) -> np.ndarray:
    """The 64-bit hashes of a text's word shingles, ascending, each once; a text of fewer words is one shingle."""
    tokens = words_of(text)
    if not tokens:
        return np.zeros(0, np.uint64)
    names = {t: i for i, t in enumerate(dict.fromkeys(tokens))}
    hashes = np.frombuffer(b"".join([xxhash.xxh64_digest(t, SEED) for t in names]), ">u8").astype(np.uint64)
    row = hashes[np.fromiter(map(names.__getitem__, tokens), np.int64, len(tokens))]
    span = min(words, len(tokens))
    rolled = np.zeros(len(tokens) - span + 1, np.uint64)
    for k in range(span):
        rolled = rolled * _MIX[1] + row[k : len(tokens) - span + 1 + k]
    return np.unique(_scrambled(rolled))


def set_fingerprint(shingles: np.ndarray) -> int:
    """The fingerprint of a set of shingle hashes, as a signed long."""
    votes = np.zeros(64, np.int64)
    for at in range(0, len(shingles), _CHUNK):
        votes += np.unpackbits(shingles[at : at + _CHUNK].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(votes * 2 > len(shingles)).tobytes(), "big", signed=True)


def least_hashes(shingles: np.ndarray) -> np.ndarray:
    """BANDS * ROWS least hashes of a set that isn't empty, each under a permutation of its own."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 1 << 10):
        np.minimum(least, (shingles[at : at + (1 << 10), None] * _FACTORS).min(axis=0), out=least)
    return least


def band_keys(least: np.ndarray) -> np.ndarray:
    keys = np.arange(BANDS, dtype=np.uint64)
    for column in _scrambled(least).reshape(BANDS, ROWS).T:
        keys = _scrambled(keys * _MIX[1] + column)
    return keys.view(np.int64)


def _sketched(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, row_key, class, n_shingles, fp, bands, sketch): texts with the same set of shingles are one class; a sketch has a byte of each least hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                shingles = shingle_set(text, words)
                least = least_hashes(shingles) if len(shingles) else None
                rows.append((xxhash.xxh64_intdigest(shingles.tobytes()), len(shingles), set_fingerprint(shingles), [] if least is None else band_keys(least), b"" if least is None else (least & np.uint64(255)).astype(np.uint8).tobytes()))
            column = lambda i, kind: pa.array([r[i] for r in rows], kind)  # noqa: B023, E731
            classes = pa.array(np.array([r[0] for r in rows], np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), classes, column(1, pa.int32()), column(2, pa.int64()), column(3, pa.list_(pa.int64())), column(4, pa.binary())], names=["doc_id", "row_key", "class", "n_shingles", "fp", "bands", "sketch"])

    return map_arrow(docs.select("doc_id", "text", row_key(docs).alias("row_key")), run, f"{id_field(docs)}, row_key binary, class long, n_shingles int, fp long, bands array<long>, sketch binary")


def _in_lots(members: DataFrame, key: str, lots: Column) -> DataFrame:
    """Adds lot, low and high: rows of a key are dealt in lots, and each two lots of it have one group (key, low, high)."""
    dealt = members.withColumn("lots", lots.cast("int")).withColumn("lot", F.pmod(F.xxhash64("id"), F.col("lots")).cast("int"))
    met = dealt.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("lots") - 1)))
    return met.withColumn("low", F.least("lot", "with")).withColumn("high", F.greatest("lot", "with")).drop("with", "lots")


def estimates(sketches: np.ndarray, i: int, j: int) -> np.ndarray:
    """Similarity of rows i to j with all rows, from the share of equal bytes; unequal least hashes give equal bytes once in 256 times."""
    same = np.zeros((j - i, len(sketches)), np.uint8)
    for column in np.ascontiguousarray(sketches.T):
        same += column[i:j, None] == column
    return (same / sketches.shape[1] - 1 / 256) / (1 - 1 / 256)


def likely_pairs(sketches: np.ndarray, sizes: np.ndarray, lots: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places a < b and estimates of pairs that may have the similarity; with two lots, of pairs between them."""
    found = []
    both = lots.min() != lots.max()
    step = max(1, (1 << 22) // len(sketches))
    for i in range(0, len(sketches), step):
        j = min(i + step, len(sketches))
        alike = estimates(sketches, i, j)
        may = (alike >= similarity - MARGIN) & (np.arange(len(sketches)) > np.arange(i, j)[:, None])
        may &= np.minimum(sizes[i:j, None], sizes) >= np.maximum(sizes[i:j, None], sizes) * similarity - 1e-6
        if both:
            may &= lots[i:j, None] != lots
        a, b = np.nonzero(may)
        found.append((a + i, b, alike[a, b]))
    return tuple(map(np.concatenate, zip(*found)))


def spanning_links(pairs: tuple[np.ndarray, np.ndarray, np.ndarray], n: int, verify: Callable[[int, int], bool] | None = None) -> list[tuple[int, int]]:
    """Of the pairs that hold, likeliest first, those that connect what wasn't connected."""
    root = list(range(n))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    out = []
    order = np.argsort(-pairs[2], kind="stable")
    for a, b in zip(pairs[0][order].tolist(), pairs[1][order].tolist()):
        x, y = find(a), find(b)
        if x != y and (verify is None or verify(a, b)):
            root[x] = y
            out.append((a, b))
    return out


def exact_jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Similarity of two whole sets of shingle hashes."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 1.0


def _linked_in_groups(groups: DataFrame, keys: list[str], similarity: float, exact: bool) -> DataFrame:
    """groups: keys, id, lot, n_shingles, sketch and, if exact, shingles. Links (u, v): a spanning forest of each group."""

    def links(group: pa.Table) -> pa.Table:
        group = group.sort_by("id")
        ids, sizes, lots = (group[c].to_numpy() for c in ("id", "n_shingles", "lot"))
        sketches = np.frombuffer(b"".join(group["sketch"].to_pylist()), np.uint8).reshape(len(ids), -1)
        sets = [np.frombuffer(s, np.uint64) for s in group["shingles"].to_pylist()] if exact else []
        verify = (lambda a, b: exact_jaccard(sets[a], sets[b]) >= similarity) if exact else None
        found = np.array(spanning_links(likely_pairs(sketches, sizes, lots, similarity), len(ids), verify), np.int64).reshape(-1, 2)
        return pa.table({"u": ids[found[:, 0]], "v": ids[found[:, 1]]})

    return map_groups(groups, keys, links, "u long, v long").distinct()


def _ball_candidates(classes: DataFrame) -> DataFrame:
    """Links (u, v) between classes whose fingerprints are equal or within the radius, by ball hashing; enough to connect all that are."""
    first = classes.groupBy("fp").agg(F.min("class").alias("first"), F.count("*").alias("n"))
    same = classes.join(first.where("n > 1"), "fp").where("class <> first").select(F.col("class").alias("u"), F.col("first").alias("v"))
    near = links_within_radius(classes.select("fp").distinct())
    name = lambda c: first.select(F.col("fp").alias(c), F.col("first").alias("class_" + c))
    return same.unionByName(near.join(name("u"), "u").join(name("v"), "v").select(F.col("class_u").alias("u"), F.col("class_v").alias("v")))


def _band_candidates(classes: DataFrame, similarity: float) -> DataFrame:
    """Links (u, v) between classes that have a band in common and may be similar enough."""
    emitted = classes.select(F.col("class").alias("id"), F.explode("bands").alias("key"))
    counted = materialize(emitted.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))
    met = join_by_key(emitted, counted, "key", "n", classes.count() * BANDS)
    met = met.join(classes.select(F.col("class").alias("id"), "n_shingles", "sketch"), "id")
    return _linked_in_groups(_in_lots(met, "key", F.ceil(F.col("n") / LOT)).drop("n"), ["key", "low", "high"], similarity, False)


def _with_sets(docs: DataFrame, members: DataFrame, words: int) -> DataFrame:
    """members (with row_key) with shingles, read from their texts again; the texts of others aren't shuffled while members are few."""
    few = members.count() <= BROADCAST_KEYS
    keys = members.select("row_key", "id")
    chosen = docs.select("text", row_key(docs).alias("row_key")).join(F.broadcast(keys) if few else keys, "row_key").select("id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in portions(pc.binary_length(batch.column(1).fill_null("")).to_pylist(), 1 << 20):
                sets = [shingle_set(t, words).tobytes() for t in batch.column(1)[part].to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0)[part], pa.array(sets, pa.binary())], names=["id", "shingles"])

    sets = map_arrow(chosen, run, "id long, shingles binary").dropDuplicates(["id"])  # rows alike in id and text
    return members.drop("row_key").join(sets, "id")


def _linked(docs: DataFrame, classes: DataFrame, words: int, similarity: float) -> DataFrame:
    """(node, root): components of all classes of that similarity."""
    some = classes.where("n_shingles > 0")
    candidates = _ball_candidates(some).unionByName(_band_candidates(some, similarity))
    clusters = connected_components(candidates)
    sizes = materialize(clusters.join(some, F.col("node") == F.col("class")).groupBy(F.col("root").alias("cluster")).agg(F.count("*").alias("members"), F.sum("n_shingles").alias("total")))
    named = join_by_key(clusters.select(F.col("root").alias("cluster"), F.col("node").alias("id")), sizes, "cluster", "members", classes.count())
    members = materialize(named.join(some.select(F.col("class").alias("id"), "row_key", "n_shingles", "sketch"), "id"))
    drop_finished(docs.sparkSession)
    lots = F.greatest(F.ceil(F.col("members") / LOT), F.ceil(F.col("total") / LOT_SHINGLES))
    groups = _in_lots(_with_sets(docs, members, words), "cluster", lots).drop("members", "total")
    return connected_components(_linked_in_groups(groups, ["cluster", "low", "high"], similarity, True))


def similar_components(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, component_id, root, row_key) for each row of docs: components of texts linked by the Jaccard similarity of their word shingles."""
    rows = materialize(_sketched(docs, words))
    classes = materialize(rows.groupBy("class").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n"), F.min("row_key").alias("row_key"), *(F.first(c).alias(c) for c in ("n_shingles", "fp", "bands", "sketch"))))
    found = _linked(docs, classes, words, similarity)
    rooted = materialize(classes.join(found, F.col("class") == F.col("node"), "left").select("class", "first_id", "n", F.coalesce("root", "class").alias("root")))
    named = materialize(_with_component(rooted).select("class", "component_id", "root", "n"))
    return join_by_key(rows.select("doc_id", "row_key", "class"), named, "class", "n", rows.count()).select("doc_id", "component_id", "root", "row_key")


def keep_one_of_each_component(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of docs that stay, whole: one of each component (doc_id, root, row_key), that of the smallest id.

    Rows without an id come after those that have one; rows of one id are told apart by their texts.
    """
    tag = "__row"
    while tag in docs.columns:
        tag += "_"
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row_key")).alias("first")
    kept = materialize(found.groupBy("root").agg(first).select(F.col("first.row_key").alias(tag)))
    stays = docs.withColumn(tag, row_key(docs)).join(kept, tag, "left_semi")
    once = F.row_number().over(Window.partitionBy(tag).orderBy("doc_id"))  # rows alike in id and text
    return stays.withColumn(tag, once).where(F.col(tag) == 1).select(docs.columns)
