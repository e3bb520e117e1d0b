"""The whole pipeline against plain loops, stage by stage."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

from tokenizers import Tokenizer

import corpus_pipeline
from gritsieve.llm import quality

from test_dedup import brute_similar
from test_models import brute_page, brute_share
from test_native import brute_mix

SF = "/root/testdata/sf0.001"


def test_pipeline_equals_brute_force(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    field = quality.train(docs, labels)  # held against other rows in a test of its own
    at, columns = docs.columns.index("text"), docs.columns

    def good(text):
        return not brute_page(text)[-1] and (field is None or brute_share(text, field) >= quality.KEEP_SHARE)

    rows = sorted((tuple(r) for r in docs.collect() if good(r.text)), key=lambda r: r[columns.index("doc_id")])
    first = {}
    for r in rows:
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r[at] or ""), r)
    rows = list(first.values())
    root = brute_similar([r[at] for r in rows])
    rows = [r for k, r in enumerate(rows) if k == root.index(root[k])]
    assert 0 < len(rows) < len(first)

    frame = spark.createDataFrame(rows, docs.schema)
    size = lambda text: len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    keyed = [(r.doc_id, r.source, size(r.text), r.u) for r in frame.select("doc_id", "source", "text", F.xxhash64(*columns).alias("u")).collect()]
    text = {r.doc_id: r.text for r in frame.collect()}
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    wanted = []
    for doc_id, z, _, _, taken in brute_mix(keyed):
        ids = np.array(library.encode(text[doc_id], add_special_tokens=False).ids, "<u4").tobytes()
        wanted += [(doc_id, ids, text[doc_id])] * (taken // z if z else 0)
    assert sorted((r.doc_id, bytes(r.ids), r.text) for r in corpus_pipeline.run(spark, SF).collect()) == sorted(wanted)
