"""Licence scan, mixing and the fixity audit against brute force; the pipeline."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gritsieve.llm import license_scan, mixing, quality, simhash, warc_audit
from gritsieve.llm.queries import op2_warc_fixity, op6_license_scan, op7_mix_sources

SF = "/root/testdata/sf0.001"


def documents(spark, sf=SF):
    return spark.read.parquet(f"{sf}/documents.parquet")


def brute_license(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    found = [(i, label) for label, phrase in license_scan.BASE.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    places = [i for i, _ in found]
    labels = {label for _, label in found}
    for label, passage, keys in license_scan.TEMPLATES:
        for key in keys:
            n = len(key.split())
            if any(words[i : i + n] == key.split() for i in range(len(words))):
                labels.add(label)
    return len(words), len(found), min(places, default=None), max(places, default=None), ",".join(sorted({b for _, b in found})), ",".join(sorted(labels))


def test_licences_equal_brute_force(spark):
    texts = ["The MIT License mit license MIT-License", "license", "", None, "under CC BY-NC 4.0", "permission is HEREBY granted, free of charge", "apache license apache license version 2.0", "gnu general public license\0version 3 or mit", "gnu K İmit license KLICENSE", "Apache Lİcense É mit É license", "word " * 30000 + "MIT license", "mit license " * 5000, "SPDX-License-Identifier: GPL-3.0-or-later", license_scan._GNU.format("", "3"), license_scan._GNU.format("Affero ", "3"), "License); YOU may not use this file except in compliance with the License.", "the MPL was not distributed with this file, if a copy of the mpl was not distributed with this file", "license mit spdx identifier", "x " * 70 + "used to endorse or promote products derived from this software without specific prior written permission"]
    rows = [(r.doc_id, r.text) for r in documents(spark).collect()] + [(10_000 + i, t) for i, t in enumerate(texts)] + [(10_000, texts[0]), (None, texts[0])]
    docs = spark.createDataFrame([(*r, "w") for r in rows], "doc_id long, text string, words string").repartition(3)
    got = license_scan.scan(docs).collect()
    key = lambda r: (str(r[0]), r[1:3])
    assert sorted((tuple(r)[:7] for r in got), key=key) == sorted(((i, *brute_license(t)) for i, t in rows), key=key)
    assert all(0 <= r.score <= 1 and (r.score > 0) == bool(r.labels) for r in got)
    assert license_scan.scan(docs.limit(0)).count() == 0


def test_op6_is_native(spark):
    for query in (op6_license_scan, op7_mix_sources):
        plan = query(spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow", plan)


def brute_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        left = total - sum(3 * sizes[s] for s in capped)
        share = sum(weight[s] for s in names if s not in capped)
        target = {s: 3 * sizes[s] if s in capped else (left * weight[s] / share if share else 0) for s in names}
        more = {s for s in names if s not in capped and target[s] > 3 * sizes[s]}
        if not more:
            return target
        capped |= more


def brute_mix(rows):
    """(doc_id, size, source_size, target, taken) of rows doc_id, source, size, hash; the dual solved by bisection."""
    sizes = Counter()
    for _, s, z, _ in rows:
        sizes[s] += z
    targets, out = brute_targets(sizes), []
    for s in sizes:
        own = [r for r in rows if r[1] == s]
        n = Counter(z for _, _, z, _ in own if z)
        k, scale = {}, sizes[s] / len(own)
        if targets[s] and sizes[s]:
            full = targets[s] >= 3 * sizes[s] * (1 - 1e-12)
            rate = lambda z, x: 3.0 if full else min(3.0, math.exp(min(2.0, x * z / scale)))  # noqa: B023, E731
            low, high = -1e6, 1e6
            for _ in range(300):
                middle = (low + high) / 2
                low, high = (middle, high) if sum(c * z * rate(z, middle) for z, c in n.items()) < targets[s] else (low, middle)
            run = total = 0
            for z in sorted(n, reverse=True):
                total += n[z] * rate(z, high)
                k[z] = max(0, min(n[z] * 3, math.floor(total + 1e-9 + 0.5) - run))
                run = math.floor(total + 1e-9 + 0.5)
            left = targets[s] - sum(z * c for z, c in k.items())
            picks = {}
            for z in n:
                power = math.floor(math.log2(z))
                picks[power] = max(picks.get(power, (False, 0, 0, 0)), (0 < k[z] < 3 * n[z], n[z], z, k[z]))
            for _, c, z, had in sorted(picks.values(), key=lambda p: -p[2]):
                quotient = left / z
                move = max(-had, min(3 * c - had, math.copysign(math.floor(abs(quotient) + 0.5), quotient)))
                k[z] += int(move)
                left -= z * move
        for z in {r[2] for r in own}:
            some = sorted((r for r in own if r[2] == z), key=lambda r: r[3])
            each, more = divmod(k.get(z, 0), len(some))
            out += [(i, z, sizes[s], targets[s], z * (each + (at < more))) for at, (i, _, _, _) in enumerate(some)]
    return out


def check_mix(spark, docs):
    rows = [(r.doc_id, r.source, len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")), r.u) for r in docs.select("doc_id", "text", "source", F.xxhash64("doc_id", "text", "source").alias("u")).collect()]
    key = lambda r: tuple(map(str, r[:3])) + (r[4],)
    got, wanted = (sorted(map(tuple, x), key=key) for x in (mixing.mix_report(docs).collect(), brute_mix(rows)))
    assert [(*r[:3], r[4]) for r in got] == [(*r[:3], r[4]) for r in wanted]
    assert [r[3] for r in got] == pytest.approx([r[3] for r in wanted])
    return got


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_mix_equals_brute_force(spark, sf):
    docs = documents(spark, sf)
    source = {r.doc_id: r.source for r in docs.collect()}
    rows = check_mix(spark, docs)
    assert sorted(rows) == sorted(map(tuple, op7_mix_sources(spark, sf).collect()))
    taken, least, target = Counter(), defaultdict(lambda: math.inf), {}
    for doc_id, size, _, want, took in rows:
        s = source[doc_id]
        taken[s] += took
        target[s] = want
        least[s] = min(least[s], size or math.inf)
        assert 0 <= took <= 3 * size and (not size or took % size == 0)
    off = {s: (abs(taken[s] - target[s]), least[s], target[s]) for s in target}
    assert all(x <= max(smallest, 0.01 * want) for x, smallest, want in off.values())


@pytest.mark.parametrize("classes, lot", [(100_000, 4096), (0, 3)])
def test_mix_of_hot_classes(spark, monkeypatch, classes, lot):
    """A source and size that hold most rows, many of them equal or without an id; also by shuffle, in many lots."""
    monkeypatch.setattr(mixing, "BROADCAST_CLASSES", classes)
    monkeypatch.setattr(mixing, "LOT", lot)
    monkeypatch.setattr("gritsieve.llm.common.HOT_ROWS", 20)
    rows = [(None, f"w{i % 7} x", "a") for i in range(300)] + [(5, "same text", "a")] * 200 + [(i, "y " * (i % 5), "b") for i in range(60)] + [(i, "q " * 40, None) for i in range(10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(6)
    report = check_mix(spark, docs)
    assert len(report) == len(rows)
    mixed = mixing.mix(docs)
    assert sum(len(r.text.split()) for r in mixed.collect()) == sum(r[4] for r in report)


def test_no_solution_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(mixing, "MAX_ROUNDS", 0)
    classes = spark.createDataFrame([("0a", 3, 10)], "s string, z long, n long")
    with pytest.raises(ArithmeticError):
        mixing.solve(classes, mixing.source_targets(classes))


def test_dual_is_solved(spark):
    classes = spark.createDataFrame([("0a", z, 1 + z % 3) for z in range(1, 400)] + [("0b", 7, 1000)], "s string, z long, n long")
    solved = mixing.solve(classes, mixing.source_targets(classes))
    for r in solved.collect():
        rate = lambda z: min(3.0, math.exp(min(2.0, r.multiplier * z / r.scale))) if not r.full else 3.0  # noqa: B023, E731
        reached = sum(c.n * c.z * rate(c.z) for c in classes.where(F.col("s") == r.s).collect())
        assert reached == pytest.approx(r.target, rel=1e-5)


def test_mix_of_odd_rows(spark):
    rows = [(1, None, "a"), (2, "", None), (3, "x y z", None), (3, "x y z", None), (None, "p q", "b"), (4, "w " * 20000, "c")] + [(10 + i, "one two", "a") for i in range(50)]
    docs = spark.createDataFrame([(*r, 0, 0) for r in rows], "doc_id long, text string, source string, size int, s int")
    report = mixing.mix_report(docs).collect()
    assert len(report) == len(rows) and all(r.taken == 0 for r in report if r.doc_id in (1, 2))
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    assert mixed.select(F.sum(F.size(F.split(F.trim("text"), " ")))).first()[0] == sum(r.taken for r in report)
    empty = docs.limit(0)
    assert mixing.mix_report(empty).count() == mixing.mix(empty).count() == 0
    nothing = spark.createDataFrame([(1, "", "a")], "doc_id long, text string, source string")
    assert mixing.mix_report(nothing).first().target == 0


def index(spark, rows):
    return spark.createDataFrame(rows, "archive long, offset long, length long, digest string")


def test_audit_finds_what_differs(spark):
    rows = [(a, 700 * i, 700, f"{a}-{i}") for a in range(3) for i in range(3000)]
    copy = [r for r in rows if r[:2] != (0, 0) and r[0] != 2]
    copy[1500] = (*copy[1500][:3], "changed")
    copy.append((1, 700 * 3000, 10, "more"))
    found = {(r.archive, r.offset): r.finding for r in warc_audit.audit(index(spark, rows), index(spark, copy)).collect()}
    assert found == {(0, 0): "missing", copy[1500][:2]: "damaged", (1, 2100000): "extra"} | {(2, 700 * i): "missing" for i in range(3000)}
    assert warc_audit.audit(index(spark, rows), index(spark, rows)).count() == 0
    assert warc_audit.audit(index(spark, []), index(spark, [])).count() == 0


def test_only_differing_branches_are_opened(spark):
    rows = [(0, 40000 * i, 40000, str(i)) for i in range(2000)]
    other = [(*r[:3], "x") if r[1] == 40000 * 777 else r for r in rows]
    height = warc_audit.tree_height(index(spark, rows))
    ours, theirs = warc_audit.tree(index(spark, rows), height), warc_audit.tree(index(spark, other), height)
    assert height == 3 and ours[-1].count() == 1
    assert [warc_audit._differing(a, b).count() for a, b in zip(ours, theirs)] == [1] * 4


def test_op2_equals_its_damage(spark):
    rows = op2_warc_fixity(spark, SF).collect()
    assert sorted(r.page_id for r in rows) == sorted(r.page_id for r in spark.read.parquet(f"{SF}/pages.parquet").collect())
    for r in rows:
        assert r.finding == ("missing" if r.page_id % 89 == 7 else "damaged" if r.page_id % 97 == 5 else "sound")


def test_op2_of_odd_pages(spark, tmp_path):
    """Null html and url, no id, repeated rows, long pages, extra columns of clashing names; and no rows."""
    rows = [(5, None, None), (7, "u", "x"), (7, "u", "x"), (None, "u", "y"), (102, "u", ""), (8, "ü", "z" * 200_000), (8, "ü", "z" * 200_000), (194, None, "é")]
    spark.createDataFrame([(*r, "o", "s", 1) for r in rows], "page_id long, url string, html string, copy string, digest string, length int").write.parquet(str(tmp_path / "a/pages.parquet"))

    def record(page_id, url, html):
        body = (html or "").encode()
        return (f"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>\r\nWARC-Target-URI: {url or ''}\r\nContent-Type: text/html\r\nContent-Length: {len(body)}\r\n\r\n").encode() + body + b"\r\n\r\n"

    found = op2_warc_fixity(spark, str(tmp_path / "a")).collect()
    wanted = Counter((r[0], hashlib.sha256(record(*r)).hexdigest(), len(record(*r)), "missing" if r[0] == 7 else "damaged" if r[0] in (5, 102) else "sound") for r in rows)
    assert Counter((r.page_id, r.record_sha256, r.length, r.finding) for r in found) == wanted
    spans = sorted((r.offset, r.length) for r in found)
    assert spans[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:]))
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(str(tmp_path / "b/pages.parquet"))
    assert op2_warc_fixity(spark, str(tmp_path / "b")).count() == 0


def test_layout(spark):
    rows = spark.createDataFrame([(None, 40_000_000, "a"), (1, 40_000_000, "b"), (1, 40_000_000, "b"), (0, 10, "c")], "page_id long, length long, digest string")
    placed = warc_audit.laid_out(rows, [F.col("page_id").asc_nulls_last(), F.col("digest")]).collect()
    assert sorted((r.archive, r.offset) for r in placed) == [(0, 0), (0, 10), (0, 40_000_010), (1, 0)]
    assert warc_audit.laid_out(rows.limit(0), [F.col("page_id")]).count() == 0


def test_pipeline_stages(spark, tmp_path):
    docs = documents(spark, "/root/testdata/sf0.01")
    columns, counts = docs.columns, [docs.count()]
    at = docs
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, at, "/root/testdata/sf0.01").write.parquet(str(tmp_path / str(i)))
        before, at = at, spark.read.parquet(str(tmp_path / str(i)))
        counts.append(at.count())
        if i < len(corpus_pipeline.STAGES) - 1:
            assert at.columns == columns
            texts = {(r.doc_id, r.text) for r in before.select("doc_id", "text").collect()}
            assert {(r.doc_id, r.text) for r in at.select("doc_id", "text").collect()} <= texts
    assert counts[0] > counts[1] > counts[2] >= counts[3] and counts[4] == counts[5]
    mixed = {r.doc_id: r.text for r in spark.read.parquet(str(tmp_path / "3")).collect()}
    assert all(mixed[r.doc_id] == r.text for r in at.collect())


def test_pipeline_equals_its_stages(spark):
    rows = corpus_pipeline.run(spark, SF).select("doc_id", "n_tokens").collect()
    docs, labels = documents(spark), spark.read.parquet(f"{SF}/labels.parquet")
    good = quality.keep_good(docs, quality.train(docs, labels))
    components = {r.doc_id: r.component_id for r in simhash.similar_components(good).collect()}
    assert rows and all(components[r.doc_id] == r.doc_id for r in rows)
