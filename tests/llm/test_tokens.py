"""BPE and token store against the tokenizers library."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from tokenizers import Tokenizer

from gritsieve.llm import bpe, token_store
from gritsieve.llm.queries import op4_bpe_round_trip, op5_token_store

SF = "/root/testdata/sf0.001"
BYTES = public_tokenizers.path("byte_bpe_50k.json")
WORDS = public_tokenizers.path("word_bpe_49k.json")


def odd_texts():
    rng = random.Random(5)
    made = ["".join(rng.choice("ab  \n\t'stre!1é日 　\x1c") for _ in range(rng.randint(0, 90))) for _ in range(400)]
    return [*made, "", " ", "a" * 3000, "ab" * 900 + "\n", "<|endoftext|>", "x<|endoftext|> <|endoftext|>y", "it's we'll 'S", "é é Å"]


def test_encoding_equals_the_library():
    library, own = Tokenizer.from_file(BYTES), bpe.ByteBpe(BYTES)
    texts = odd_texts()
    for text, ids, want in zip(texts, own.encode_many(texts), library.encode_batch(texts, add_special_tokens=False)):
        assert np.frombuffer(ids, "<u4").tolist() == want.ids, text
        assert own.decode(ids) == library.decode(want.ids, skip_special_tokens=False) == text


def test_single_tree_equals_many():
    own = bpe.ByteBpe(BYTES)
    rng = random.Random(1)
    pieces = [bytes(rng.choice(b" aehlnorst") for _ in range(rng.randint(1, 64))) for _ in range(500)]
    for piece, ids in zip(pieces, own.merge_many(pieces)):
        assert np.frombuffer(ids, "<u4").tolist() == own.merge_one(piece)


def test_full_memo_changes_nothing(monkeypatch):
    monkeypatch.setattr(bpe, "MEMO", 10)
    own, fresh = bpe.ByteBpe(BYTES), bpe.ByteBpe(BYTES)
    texts = odd_texts()
    assert own.encode_many(texts) == own.encode_many(texts) == [fresh.encode_many([t])[0] for t in texts]


def test_op4_equals_the_library(spark):
    library = Tokenizer.from_file(BYTES)
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = op4_bpe_round_trip(spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_round_trip_of_odd_rows(spark):
    library = Tokenizer.from_file(BYTES)
    rows = [(1, None), (2, ""), (None, "no id"), (3, "é b" * 30_000), (4, "again"), (4, "again"), (5, "<|endoftext|> x")]
    docs = spark.createDataFrame([(*r, 7, "y") for r in rows], "doc_id long, text string, n_tokens int, ids string").repartition(3)
    wanted = [(i, np.array(library.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes(), t or "") for i, t in rows]
    got = bpe.round_trip(docs, BYTES).collect()
    assert sorted(map(str, ((r.doc_id, bytes(r.ids), r.text) for r in got))) == sorted(map(str, wanted))
    assert all(r.n_tokens == len(r.ids) // 4 for r in got) and bpe.round_trip(docs.limit(0), BYTES).count() == 0


def expected_store(rows):
    library, out, start = Tokenizer.from_file(WORDS), [], 0
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        ids = library.encode(text or "", add_special_tokens=False).ids + [1]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_op5_equals_the_library(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = sorted(tuple(r) for r in op5_token_store(spark, SF).collect())
    assert got == sorted(expected_store(rows))


def test_store_of_odd_rows(spark, tmp_path):
    texts = [*odd_texts(), None, "word " * 30000, "word " * 30000]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "no id"), (3, texts[3])]
    random.Random(2).shuffle(rows)
    docs = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id long, text string, digest int").repartition(5)
    token_store.write_store(docs, str(tmp_path / "s"), WORDS, 1)
    want = expected_store(rows)
    assert sorted(map(str, (tuple(r) for r in token_store.read_checksums(spark, str(tmp_path / "s")).collect()))) == sorted(map(str, want))
    whole = {r.start: bytes(r.ids) for r in token_store.read_ids(spark, str(tmp_path / "s")).collect()}
    assert {s: zlib.crc32(ids) for s, ids in whole.items()} == {w[1]: w[3] for w in want}
    chunks = token_store.read_chunks(spark, str(tmp_path / "s"))
    assert chunks.count() == chunks.select("digest").distinct().count()


def test_groups_of_batches(monkeypatch):
    own, library = token_store.Encoder(WORDS), Tokenizer.from_file(WORDS)
    for most in (token_store.MEMO, 3):
        monkeypatch.setattr(token_store, "MEMO", most)
        batches = [["a b c", None], [], ["", " "], [None], odd_texts(), ["c a", "b" * 5000]]
        for texts, (ids, ends) in zip(batches, own.encode_many([pa.array(t, pa.string()) for t in batches], 1), strict=True):
            want = [library.encode(t or "", add_special_tokens=False).ids + [1] for t in texts]
            assert [p.tolist() for p in np.split(ids, ends)[:-1]] == want


def test_store_of_no_rows(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string")
    token_store.write_store(docs, str(tmp_path / "s"), WORDS, 1)
    assert token_store.read_recipes(spark, str(tmp_path / "s")).count() == 0


def test_equal_passages_share_chunks():
    rng = np.random.default_rng(3)
    passage = rng.integers(0, 49000, 6000).astype(np.uint16)
    first, second = (np.concatenate([rng.integers(0, 49000, n).astype(np.uint16), passage]) for n in (500, 777))
    names = [{token_store.digest(ids[a:b].tobytes()) for a, b in zip([0, *token_store.cut(ids)], token_store.cut(ids))} for ids in (first, second)]
    assert len(names[0] & names[1]) > 15
    assert token_store.cut(np.array([], np.uint16)) == []
    ends = np.cumsum([len(first), len(second)])
    both = token_store.cut_all(np.concatenate([first, second]), ends)
    assert both == [token_store.cut(first), [len(first) + c for c in token_store.cut(second)]]


def test_corrupt_chunk_is_found(spark):
    bad = spark.createDataFrame([(b"0" * 16, 1, b"\x01\x00")], "digest binary, n int, ids binary")
    with pytest.raises(Exception, match="does not match its digest"):
        token_store.checked_chunks(bad).collect()


def test_wrong_count_in_a_recipe_is_found(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b c"), (2, "word " * 3000)], "doc_id long, text string")
    token_store.write_store(docs, str(tmp_path / "s"), WORDS, 1)
    recipes = token_store.read_recipes(spark, str(tmp_path / "s"))
    assert token_store._entries(recipes).count() > 1
    with pytest.raises(Exception, match="its recipe tells"):
        token_store._entries(recipes.withColumn("n_tokens", recipes.n_tokens + 1)).collect()
