"""Fixity audit of WARC archives with Merkle trees over offset ranges.

A record's digest is the SHA-256 of its bytes. A leaf of an archive's tree covers RANGE_BYTES of
offsets and hashes, in order, the offsets, lengths and digests of the records that begin there; a
node above covers FANOUT neighbours. Replicas are compared root by root, and only the children
of nodes that differ are looked at, down to the leaves and then to the records in them.

All of it is DataFrame operations. A leaf holds as many records as fit in its range, a node
FANOUT children: no group grows with the archive, and a tree is built with one small aggregation
a level.

Cases: a null url or html counts as empty. A page without an id stands last. Repeated rows are
records of their own. An archive that one replica lacks is missing record by record. Empty
tables give an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, running_sum

RANGE_BYTES = 1 << 16
FANOUT = 16
ARCHIVE_BYTES = 1 << 26


def record_bytes(page_id: Column, url: Column, html: Column) -> Column:
    """A WARC/1.0 resource record, as text in UTF-8."""
    body = F.coalesce(html, F.lit(""))
    head = F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"),
        F.coalesce(page_id.cast("string"), F.lit("")),
        F.lit(">\r\nWARC-Target-URI: "),
        F.coalesce(url, F.lit("")),
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "),
        F.octet_length(body).cast("string"),
        F.lit("\r\n\r\n"),
    )
    return F.concat(head, body, F.lit("\r\n\r\n"))


def digest(record: Column) -> Column:
    return F.sha2(record, 256)


def laid_out(records: DataFrame, order: list[Column]) -> DataFrame:
    """Adds archive and offset to rows with length: records stand one after another in the given order, and an archive ends where ARCHIVE_BYTES are reached."""
    placed = running_sum(records, order, "length", "position")
    archive = F.floor(F.col("position") / ARCHIVE_BYTES).cast("long")
    # Where an archive's first record begins; one row an archive.
    firsts = placed.groupBy(archive.alias("archive")).agg(F.min("position").alias("first"))
    return placed.withColumn("archive", archive).join(firsts, "archive").withColumn("offset", F.col("position") - F.col("first")).drop("first", "position")


def _hash_of(children: Column) -> Column:
    return F.sha2(F.array_join(F.sort_array(F.collect_list(children)).getField("text"), "\n"), 256)


def leaves(index: DataFrame) -> DataFrame:
    """index: archive, offset, length, digest. (archive, level 0, node, hash)."""
    line = F.concat_ws(" ", F.col("offset").cast("string"), F.col("length").cast("string"), F.col("digest"))
    child = F.struct(F.col("offset").alias("at"), line.alias("text"))
    return index.groupBy("archive", F.floor(F.col("offset") / RANGE_BYTES).cast("long").alias("node")).agg(_hash_of(child).alias("hash"))


def parents(nodes: DataFrame) -> DataFrame:
    child = F.struct(F.col("node").alias("at"), F.concat_ws(" ", F.col("node").cast("string"), F.col("hash")).alias("text"))
    return nodes.groupBy("archive", F.floor(F.col("node") / FANOUT).cast("long").alias("node")).agg(_hash_of(child).alias("hash"))


def tree(index: DataFrame, height: int) -> list[DataFrame]:
    """Levels from the leaves to the roots (node 0 of each archive)."""
    levels = [materialize(leaves(index))]
    for _ in range(height):
        levels.append(materialize(parents(levels[-1])))
    return levels


def tree_height(*indexes: DataFrame) -> int:
    """Levels above the leaves until every archive of either replica has one node."""
    last = max((i.agg(F.max("offset")).first()[0] or 0) // RANGE_BYTES for i in indexes)
    height = 0
    while last:
        last //= FANOUT
        height += 1
    return height


def _differing(a: DataFrame, b: DataFrame) -> DataFrame:
    """(archive, node) where the hashes differ or one is missing."""
    joined = a.select("archive", "node", F.col("hash").alias("ours")).join(b.select("archive", "node", F.col("hash").alias("theirs")), ["archive", "node"], "full_outer")
    return joined.where(~F.col("ours").eqNullSafe(F.col("theirs"))).select("archive", "node")


def audit(a: DataFrame, b: DataFrame) -> DataFrame:
    """Records in which replica b differs from a: archive, offset, digest, copy_digest and finding (damaged, missing or extra).

    a and b: archive, offset, length, digest, each record once.
    """
    height = tree_height(a, b)
    ours, theirs = tree(a, height), tree(b, height)
    suspects = materialize(_differing(ours[-1], theirs[-1]))
    for level in range(height - 1, -1, -1):
        above = [F.col("archive"), F.floor(F.col("node") / FANOUT).cast("long").alias("up"), F.col("node"), F.col("hash")]
        up = suspects.select("archive", F.col("node").alias("up"))
        below = [nodes[level].select(above).join(up, ["archive", "up"], "left_semi") for nodes in (ours, theirs)]
        suspects = materialize(_differing(*below))
    node = F.floor(F.col("offset") / RANGE_BYTES).cast("long").alias("node")
    inside = [i.select("archive", node, "offset", "length", "digest").join(suspects, ["archive", "node"], "left_semi") for i in (a, b)]
    joined = inside[0].select("archive", "offset", F.col("length").alias("n"), "digest").join(inside[1].select("archive", "offset", F.col("length").alias("m"), F.col("digest").alias("copy_digest")), ["archive", "offset"], "full_outer")
    finding = F.when(F.col("copy_digest").isNull(), "missing").when(F.col("digest").isNull(), "extra").when((F.col("digest") != F.col("copy_digest")) | (F.col("n") != F.col("m")), "damaged")
    return joined.select("archive", "offset", "digest", "copy_digest", finding.alias("finding")).where("finding is not null")
