"""Exact and near dedup against brute force."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from gritsieve.llm import components, exact_dedup, simhash
from gritsieve.llm.queries import op3_simhash_near_dedup, op10_exact_dedup

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, kept boolean, group_size string"


def frame(spark, rows):
    """Rows with extra columns whose names clash with the operators' own."""
    return spark.createDataFrame([(*r, None, "x") for r in rows], SCHEMA).repartition(3)


ROWS = [(5, "a  b"), (3, "a b"), (4, "a\t\nb"), (9, " a b"), (7, None), (8, ""), (1, "x " * 5000), (2, "x " * 5000), (2, "x " * 5000), (6, "alone"), (None, "alone"), (None, "none"), (None, "none")]


def brute_exact(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", text or "")].append(doc_id)
    out = []
    for text, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        first = True
        for i in ids:
            out.append((i, keep, len(ids), i == keep and first, hashlib.sha256(text.encode()).hexdigest()))
            first = first and i != keep
    return out


@pytest.mark.parametrize("max_bits", [1 << 30, 1 << 10])
def test_exact_report(spark, max_bits):
    got = exact_dedup.dedup_report(frame(spark, ROWS), max_bits)
    assert sorted(map(str, (tuple(r) for r in got.withColumn("digest", F.lower(F.hex("digest"))).collect()))) == sorted(map(str, brute_exact(ROWS)))


def test_exact_rows(spark):
    docs = frame(spark, ROWS)
    kept = exact_dedup.dedup(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r[0]) for r in brute_exact(ROWS) if r[3])


def test_exact_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert exact_dedup.dedup_report(empty).count() == exact_dedup.dedup(empty).count() == 0


def test_hot_group(spark, monkeypatch):
    monkeypatch.setattr("gritsieve.llm.common.HOT_ROWS", 20)
    rows = [(i, "hot" if i % 3 else f"text {i}") for i in range(600)]
    got = sorted(tuple(r)[:4] for r in exact_dedup.dedup_report(frame(spark, rows)).collect())
    assert got == sorted(r[:4] for r in brute_exact(rows))


def test_op10_equals_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert sorted(map(tuple, op10_exact_dedup(spark, SF).collect())) == sorted(brute_exact(rows))


def test_filter_misses_no_repeat(spark):
    rng = np.random.default_rng(4)
    hashes = rng.integers(-(1 << 63), 1 << 63, 3000)
    rows = spark.createDataFrame(pa.table({"h": np.concatenate([hashes, hashes[:500]])}).to_pandas()).repartition(7)
    geometry = exact_dedup.Geometry(3500)
    maybe = exact_dedup.may_repeat(rows, F.col("h"), exact_dedup.build_repeat_filter(rows, geometry), geometry)
    flagged = {r.h for r in rows.where(maybe).collect()}
    assert flagged >= set(hashes[:500].tolist()) and len(flagged) < 800


def test_one_set_of_bits_for_each_task(spark, monkeypatch):
    rows = spark.range(5000).selectExpr("xxhash64(id) AS h").union(spark.range(50).selectExpr("xxhash64(id) AS h")).repartition(3)
    monkeypatch.setattr(exact_dedup, "SHARD_BITS", 1 << 16)
    geometry = exact_dedup.Geometry(1 << 15)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        sets = exact_dedup.task_sets(rows, geometry)
        assert geometry.shards > 1 and sets.count() == 3 * geometry.shards
        monkeypatch.setattr(exact_dedup, "SET_ROWS", 500)
        assert exact_dedup.task_sets(rows, geometry).count() > 3 * geometry.shards
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_equal_ids_and_texts_of_different_rows(spark):
    rows = [(1, "same", k % 2 == 0, str(k)) for k in range(40)]
    kept = {tuple(exact_dedup.dedup(spark.createDataFrame(rows, SCHEMA).repartition(n)).first()) for n in (1, 3, 7)}
    assert len(kept) == 1


def brute_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    ids = list(prints)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for x in ids:
        for y in ids:
            if (prints[x] ^ prints[y]).bit_count() <= 2:
                a, b = find(x), find(y)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_op3_equals_brute_force(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    prints = {i: brute_print(t) for i, t in texts.items()}
    wanted = brute_components(prints)
    assert sorted(map(tuple, op3_simhash_near_dedup(spark, SF).collect())) == sorted((i, f"{p:016x}", wanted[i]) for i, p in prints.items())


def test_fingerprints_of_odd_texts():
    for text in (None, "", " \n", "One", "one TWO", "É é x", "w " * 40000, "a b c a b c a b c"):
        assert simhash.fingerprint(text) == brute_print(text)


def test_links_find_every_pair(spark):
    rng = random.Random(6)
    prints = {}
    for i in range(60):
        base = rng.getrandbits(64)
        for k in range(rng.randint(1, 6)):
            prints[len(prints)] = base
            for _ in range(rng.randint(0, 2)):
                base ^= 1 << rng.randrange(64)
    signed = [(p - (1 << 64) if p >> 63 else p,) for p in set(prints.values())]
    links = simhash.links_within_radius(spark.createDataFrame(signed, "fp long"))
    found = components.connected_components(links)
    root = {r.node: r.root for r in found.collect()}
    key = lambda p: root.get(p - (1 << 64) if p >> 63 else p, p)
    wanted = brute_components(prints)
    groups = defaultdict(set)
    for i, p in prints.items():
        groups[wanted[i]].add(key(p))
    assert all(len(g) == 1 for g in groups.values()) and len(set.union(*groups.values())) == len(groups)


def test_near_rows(spark):
    rows = [(3, "same words in here"), (2, "SAME words  in here"), (2, "same words in here"), (4, None), (5, ""), (None, "other"), (6, "another text of words")]
    docs = frame(spark, rows)
    kept = simhash.keep_one_of_each_component(docs, simhash.near_duplicate_components(docs))
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["2", "4", "6", "None"]
    empty = spark.createDataFrame([], "doc_id long, text string")
    for components_of in (simhash.near_duplicate_components, simhash.similar_components):
        assert components_of(empty).count() == simhash.keep_one_of_each_component(empty, components_of(empty)).count() == 0


def five_word_shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_similar_texts_are_found(spark):
    rng = random.Random(9)
    vocabulary = [f"w{int(3000 ** rng.random())}" for _ in range(5000)]  # as frequent as their rank is low
    rows, group = [], {}
    for g in range(60):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(80, 400))]
        for _ in range(rng.randint(1, 4)):
            words = list(base)
            for _ in range(len(words) // 90):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            group[len(rows)] = g
            rows.append((len(rows), " ".join(words)))
    rows += [(1000, None), (1001, ""), (1002, "one two"), (1003, "One  two"), (1003, "one two"), (None, "no id here"), (1004, "w " * 20000)]
    found = {r.doc_id: r.component_id for r in simhash.similar_components(frame(spark, rows)).collect()}
    sets = {i: five_word_shingles(t) for i, t in rows[: len(group)]}
    close = [(a, b) for a in group for b in group if a < b and group[a] == group[b] and jaccard(sets[a], sets[b]) >= 0.8]
    assert len(close) > 80 and np.mean([found[a] == found[b] for a, b in close]) > 0.95
    assert all(group[i] == group[found[i]] for i in group)
    assert found[1000] == found[1001] == 1000 and found[1002] == found[1003] == 1002 and found[None] is None and found[1004] == 1004


def test_similarity_of_sketches():
    rng = np.random.default_rng(1)
    for n, shared in ((40, 30), (200, 170), (5000, 4500)):
        a = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        b = np.concatenate([a[:shared], rng.integers(0, 1 << 63, n - shared, dtype=np.uint64)])
        sketches = np.stack([(simhash.least_hashes(x) & np.uint64(255)).astype(np.uint8) for x in (a, b)])
        assert abs(simhash.estimates(sketches, 0, 1)[0, 1] - len(np.intersect1d(a, b)) / len(np.union1d(a, b))) < 0.13
        assert simhash.exact_jaccard(np.unique(a), np.unique(b)) == shared / (2 * n - shared)


def test_sketch_does_not_depend_on_its_parts(monkeypatch):
    shingles = simhash.shingle_set(" ".join(f"w{i % 1700}" for i in range(5000)))
    whole = simhash.set_fingerprint(shingles)
    assert (simhash.least_hashes(shingles) == (shingles[:, None] * simhash._FACTORS).min(axis=0)).all()
    monkeypatch.setattr(simhash, "_CHUNK", 64)
    assert simhash.set_fingerprint(shingles) == whole


def test_components_of_a_hub(spark, monkeypatch):
    monkeypatch.setattr("gritsieve.llm.common.HOT_ROWS", 20)
    edges = spark.createDataFrame([(i, 500) for i in range(300)] + [(i, 1000) for i in range(600, 900)] + [(500, 501)], "u long, v long")
    assert {(r.node, r.root) for r in components.connected_components(edges).collect()} == {(i, 0) for i in [*range(300), 500, 501]} | {(i, 600) for i in [*range(600, 900), 1000]}


def test_no_folder_of_its_own_on_a_cluster(spark, monkeypatch):
    from gritsieve.llm import common

    class Context:
        master = "spark://host:7077"
        _jsc = type("C", (), {"sc": lambda self: type("S", (), {"getCheckpointDir": lambda self: type("O", (), {"isEmpty": lambda self: True})()})()})()

    session = type("Session", (), {"sparkContext": Context, "conf": type("Conf", (), {"get": lambda self, *a: None})()})()
    with pytest.raises(ValueError, match="checkpoint"):
        common.shared_folder(session)


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501)], "u long, v long")
    assert {(r.node, r.root) for r in components.connected_components(edges).collect()} == {(i, 0) for i in range(201)} | {(500, 500), (501, 500)}


def block_edits(rng, words, similarity):
    """A text and a copy of it cut at the end, so that they have about that similarity."""
    return words, words[: int((len(words) - 4) * similarity) + 5]


def test_cut_copies_of_flat_texts_are_found(spark):
    rng = random.Random(31)
    rows, pairs = [], []
    for n in (30, 100, 300, 1000, 3000):
        for _ in range(8):
            for words in block_edits(rng, [f"w{rng.randrange(10**6)}" for _ in range(n)], rng.uniform(0.81, 0.88)):
                rows.append((len(rows), " ".join(words)))
            pairs.append((len(rows) - 2, len(rows) - 1))
    assert all(jaccard(five_word_shingles(rows[a][1]), five_word_shingles(rows[b][1])) >= 0.8 for a, b in pairs)
    found = {r.doc_id: r.component_id for r in simhash.similar_components(frame(spark, rows)).collect()}
    recall = sum(found[a] == found[b] for a, b in pairs)
    print("cut copies found:", recall, "of", len(pairs))
    assert recall == len(pairs) and len(set(found.values())) == len(pairs)


def test_long_texts_are_verified_exactly(spark):
    rng = random.Random(32)
    rows = []
    for k in range(30):
        words = [f"v{rng.randrange(10**6)}" for _ in range(1004)]
        n = 800 if k % 2 else 798
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(words[: n + 4]))]
    found = {r.doc_id: r.component_id for r in simhash.similar_components(frame(spark, rows)).collect()}
    assert [found[2 * k + 1] == 2 * k for k in range(30)] == [k % 2 == 1 for k in range(30)]


def brute_similar(texts):
    """The component of each text under exact similarity of all pairs."""
    sets = [five_word_shingles(t) for t in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            small, large = sorted((len(sets[i]), len(sets[j])))
            if root[i] != root[j] and small >= 0.8 * large and jaccard(sets[i], sets[j]) >= 0.8:
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    return root


@pytest.mark.parametrize("lot", [None, 20])
def test_spokes_of_a_hub_and_pairs_among_strangers(spark, monkeypatch, lot):
    """Whole groups, and groups in many lots with the keys shuffled."""
    if lot:
        monkeypatch.setattr(simhash, "LOT", lot)
        monkeypatch.setattr(simhash, "LOT_SHINGLES", 2000)
        monkeypatch.setattr(simhash, "BROADCAST_KEYS", 0)
    rng = random.Random(33)
    new = lambda n: [f"u{rng.randrange(10**9)}" for _ in range(n)]
    hub = new(44)
    texts = [" ".join(hub)] + [" ".join(hub + new(6)) for _ in range(300)]  # 0.87 to the hub, 0.77 to each other
    plate = new(40)
    own = new(12)
    for k in range(120):  # the same boilerplate; every tenth is like the one before
        own = new(12) if k % 10 else own[:-1] + new(1)
        texts.append(" ".join(plate + own))
    rng.shuffle(texts)
    wanted = brute_similar(texts)
    found = {r.doc_id: r.component_id for r in simhash.similar_components(frame(spark, list(enumerate(texts)))).collect()}
    assert [found[i] for i in range(len(texts))] == wanted


def test_unrelated_rows_without_own_ids_stay(spark):
    texts = [" ".join(f"{c}{i}" for i in range(30)) for c in "abcdefg"]
    rows = [(None, texts[0]), (None, texts[1]), (None, texts[1]), (1, texts[2]), (1, texts[3]), (1, texts[3]), (None, texts[2]), (2, texts[4] + " x"), (None, texts[4]), (None, None), (3, texts[5]), (3, texts[6])]
    docs = frame(spark, rows)
    for components_of in (simhash.similar_components, simhash.near_duplicate_components):
        kept = simhash.keep_one_of_each_component(docs, components_of(docs))
        assert kept.columns == docs.columns
        wanted = [(None, texts[0]), (None, texts[1]), (1, texts[2]), (1, texts[3]), (None, None), (3, texts[5]), (3, texts[6]), (2, texts[4] + " x")]
        if components_of is simhash.near_duplicate_components:
            wanted += [(None, texts[4])] if (simhash.fingerprint(texts[4]) ^ simhash.fingerprint(texts[4] + " x")).bit_count() > 2 else []
        assert sorted(map(str, ((r.doc_id, r.text) for r in kept.collect()))) == sorted(map(str, wanted))


def test_stage_equals_brute_force_on_documents(spark):
    """Near duplicates of documents as they are, and cut and edited copies of them, against all pairs."""
    rng = random.Random(34)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").limit(400).collect()]
    for i, text in rows[:200:2]:
        words = text.split()
        if len(words) > 20:
            cut = words[: int(len(words) * rng.uniform(0.75, 0.99))]
            for _ in range(rng.randint(0, len(words) // 60)):
                cut[rng.randrange(len(cut))] = "edited"
            rows.append((100_000 + i, " ".join(cut)))
    rows += [(None, rows[3][1]), (200_000, None), (200_001, "")]
    wanted = brute_similar([t for _, t in rows])
    got = simhash.similar_components(frame(spark, rows)).collect()
    place = {}
    for k, (i, t) in enumerate(rows):
        place.setdefault((i, t), k)
    texts = {(i, simhash_key(i, t)): wanted[k] for k, (i, t) in enumerate(rows)}
    root = {}
    for r in got:
        root.setdefault(texts[(r.doc_id, bytes(r.row_key))], set()).add(r.root)
    assert len(got) == len(rows)
    assert all(len(x) == 1 for x in root.values()) and len(set.union(*root.values())) == len(root) == len(set(wanted)) < len(rows) - 30


def simhash_key(doc_id, text):
    return hashlib.md5((("" if doc_id is None else f"={doc_id}") + "\0" + (text or "")).encode()).digest()


def test_recall_of_bands():
    """Of pairs at 0.8, the share that has a band in common and an estimate above the margin."""
    rng = np.random.default_rng(6)
    missed = 0
    for _ in range(3000):
        shared = rng.integers(0, 1 << 63, 160, dtype=np.uint64)
        pair = [simhash.least_hashes(np.concatenate([shared, rng.integers(0, 1 << 63, 20, dtype=np.uint64)])) for _ in range(2)]
        a, b = (simhash.band_keys(x) for x in pair)
        sketches = np.stack([(x & np.uint64(255)).astype(np.uint8) for x in pair])
        missed += not (a == b).any() or simhash.estimates(sketches, 0, 1)[0, 1] < simhash.SIMILARITY - simhash.MARGIN
    print("missed:", missed, "of 3000")
    assert missed <= 3
