"""Mixing sources to target weights by entropy balancing.

Each source gets a share of all words by weight, at most MOST times its own. Of all document
rates that reach the shares, those nearest to one copy each in relative entropy are exponentially
tilted: rate = exp(lambda * size / scale), at most MOST, with one multiplier a source. The
convex dual is solved by Newton steps over a table of (source, size, documents), kept in
brackets; each step is one aggregation, and multipliers stay in a table with the sources.

Rates become whole copies: along the sizes of a source, descending, the running sum of copies is
rounded, which leaves an error of at most half the largest document; then one class of sizes in
each power of two takes up what is left. A class is the documents of one source and size. Its
copies are dealt evenly, and what is over goes to the lowest hashes of the rows: the class has a
threshold, found among lots of hashes whose number follows its size, and a row needs no more than its class's
entry. Equal rows have one hash; where a threshold falls among them they are counted through.

Everything is DataFrame operations. Sums that decide anything are exact decimals, so reruns agree.
Windows run over aggregates only: a source's sizes (at most the words of its longest document), a
class's lots (a LOT-th of its rows), and one lot. A source or class of any share of the rows is
pre-aggregated. Classes are broadcast while there are at most BROADCAST_CLASSES, else joined by shuffle, large ones apart.

Cases: a null text has size 0 and takes nothing. A null source is a source, last in order.
Rows of equal id are dealt copies one by one, by their hashes, and so are rows without an id. If there are no words, all
targets are 0. An empty table gives an empty result. A dual that isn't solved after MAX_ROUNDS rounds is an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, join_by_key, materialize, running_sum, text_or_empty

WEIGHTS = (5, 2, 1)
MOST = 3
LOT = 4096
BROADCAST_CLASSES = 100_000
TOLERANCE = 1e-7
MAX_ROUNDS = 20
_STEPS = 3


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def _keyed(docs: DataFrame) -> DataFrame:
    """Adds s (the source, never null, in its order), z (size) and u, a hash of the row. Names are ours alone: the caller's columns are behind a struct."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    key = F.when(F.col("source").isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col("source").cast("string")))
    hashed = [F.col(f"`{c}`") for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]
    return docs.select(row, key.alias("s"), word_count(text_or_empty()).alias("z"), F.xxhash64(*hashed).alias("u"))


def _exact(value: Column) -> Column:
    return F.sum(value.cast("decimal(34,6)")).cast("double")


def source_targets(classes: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """classes: s, z, n. One row a source: s, n_docs, source_size, least (smallest size above 0), target."""
    sources = classes.groupBy("s").agg(F.sum(F.col("z") * F.col("n")).alias("source_size"), F.sum("n").alias("n_docs"), F.min(F.when(F.col("z") > 0, F.col("z"))).alias("least"))
    placed = running_sum(sources.withColumn("one", F.lit(1).cast("long")), [F.col("s")], "one", "place")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod("place", F.lit(len(weights))) + 1).cast("int"))
    sources = materialize(placed.withColumn("weight", weight).drop("one", "place"))
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    level, full = 0.0, -1
    cap = F.col("source_size") * MOST
    while total:  # each round stops more sources, or ends
        at = F.col("weight") * F.lit(level)
        spent, left, stopped = sources.agg(F.sum(F.when(at >= cap, cap)), F.sum(F.when(at < cap, F.col("weight"))), F.count_if(at >= cap)).first()
        if stopped == full or not left:
            break
        level, full = (total - (spent or 0)) / left, stopped
    return sources.withColumn("target", F.least(cap.cast("double"), F.col("weight") * F.lit(level))).drop("weight")


def _rate(size: Column, scale: Column, multiplier: Column, full: Column) -> Column:
    tilt = F.least(multiplier * size / scale, F.lit(2.0))
    return F.when(full, F.lit(float(MOST))).otherwise(F.least(F.lit(float(MOST)), F.exp(tilt)))


def solve(classes: DataFrame, sources: DataFrame) -> DataFrame:
    """Newton steps on the dual: adds scale, full (rate MOST throughout) and multiplier to sources."""
    some = sources.where("source_size > 0 and target > 0")
    ratio = F.col("target") / F.col("source_size")
    low = F.col("least") / (F.col("source_size") / F.col("n_docs"))
    state = some.withColumn("scale", F.col("source_size") / F.col("n_docs")).withColumn("full", ratio >= MOST * (1 - 1e-12))
    bound = F.log(ratio) / low  # with this multiplier even the smallest document's rate is past the ratio
    state = state.select(
        "*",
        F.least(bound, F.lit(0.0)).alias("lo"),
        F.when(ratio > 1, F.log(F.lit(float(MOST))) / low).otherwise(F.lit(0.0)).alias("hi"),
        F.log(ratio).alias("multiplier"),
        F.lit(None).cast("double").alias("error"),
    )
    state = materialize(state)
    for _ in range(MAX_ROUNDS):
        for _ in range(_STEPS):
            state = _newton(classes, state)
        state = materialize(state)
        if (state.agg(F.max(F.when(~F.col("full"), F.abs("error") / F.col("target")))).first()[0] or 0) < TOLERANCE:
            return state
    raise ArithmeticError(f"no multipliers within {TOLERANCE} of the targets after {MAX_ROUNDS * _STEPS} steps")


def _newton(classes: DataFrame, state: DataFrame) -> DataFrame:
    size = F.col("z").cast("double")
    rate = _rate(size, F.col("scale"), F.col("multiplier"), F.col("full"))
    slope = F.when(rate < MOST, F.col("n") * size * size / F.col("scale") * rate).otherwise(F.lit(0.0))
    sums = classes.join(state.select("s", "scale", "multiplier", "full"), "s").groupBy("s").agg(_exact(F.col("n") * size * rate).alias("reached"), _exact(slope).alias("slope"))
    joined = state.drop("error").join(sums, "s")
    error = F.col("reached") - F.col("target")
    lo = F.when(error < 0, F.greatest("lo", "multiplier")).otherwise(F.col("lo"))
    hi = F.when(error > 0, F.least("hi", "multiplier")).otherwise(F.col("hi"))
    step = F.col("multiplier") - error / F.col("slope")
    joined = joined.select("s", "n_docs", "source_size", "least", "target", "scale", "full", lo.alias("lo"), hi.alias("hi"), "multiplier", error.alias("error"), F.when(F.col("slope") > 0, step).alias("step"))
    settled = F.col("full") | (F.abs("error") <= TOLERANCE / 10 * F.col("target"))
    inside = (F.col("step") > F.col("lo")) & (F.col("step") < F.col("hi"))
    following = F.when(settled, F.col("multiplier")).when(inside, F.col("step")).otherwise((F.col("lo") + F.col("hi")) / 2)
    return joined.withColumn("multiplier", following).drop("step")


def whole_copies(classes: DataFrame, solved: DataFrame) -> DataFrame:
    """Adds k, the copies that all documents of a class get together, to classes of solved sources."""
    size = F.col("z").cast("double")
    rated = classes.where("z > 0").join(solved, "s").select("s", "z", "n", "target", (F.col("n") * _rate(size, F.col("scale"), F.col("multiplier"), F.col("full"))).alias("share"))
    down = Window.partitionBy("s").orderBy(F.col("z").desc())
    running = F.round(F.sum("share").over(down.rowsBetween(Window.unboundedPreceding, 0)) + F.lit(1e-9))
    rounded = rated.withColumn("run", running.cast("long"))
    k = F.col("run") - F.coalesce(F.lag("run").over(down), F.lit(0).cast("long"))
    rounded = materialize(rounded.withColumn("k", F.greatest(F.lit(0).cast("long"), F.least(k, F.col("n") * MOST))).select("s", "z", "n", "target", "k"))
    # What is left, and one class in each power of two to take it up.
    left = rounded.groupBy("s").agg((F.first("target") - F.sum(F.col("k") * F.col("z")).cast("double")).alias("left"))
    free = F.struct(((F.col("k") > 0) & (F.col("k") < F.col("n") * MOST)).alias("free"), "n", "z", "k")
    picks = rounded.groupBy("s", F.floor(F.log2("z")).alias("power")).agg(F.max(free).alias("pick")).groupBy("s").agg(F.sort_array(F.collect_list(F.struct(F.col("pick.z").alias("z"), F.col("pick.n").alias("n"), F.col("pick.k").alias("k"))), asc=False).alias("picks"))
    moved = left.join(picks, "s").select(
        "s",
        F.explode(
            F.expr(
                f"""aggregate(picks, named_struct('left', left, 'moves', cast(array() as array<struct<z:bigint,move:bigint>>)),
                (a, p) -> named_struct(
                  'left', a.left - p.z * greatest(-p.k, least(p.n * {MOST} - p.k, cast(round(a.left / p.z) as bigint))),
                  'moves', concat(a.moves, array(named_struct('z', p.z, 'move', greatest(-p.k, least(p.n * {MOST} - p.k, cast(round(a.left / p.z) as bigint))))))),
                a -> a.moves)"""
            )
        ).alias("m"),
    )
    moved = moved.select("s", F.col("m.z").alias("z"), F.col("m.move").alias("move"))
    return rounded.join(moved, ["s", "z"], "left").select("s", "z", (F.col("k") + F.coalesce("move", F.lit(0).cast("long"))).alias("k"))


def _thresholds(counted: DataFrame, classes: DataFrame) -> DataFrame:
    """(s, z, threshold, tie) for classes with more copies than even shares take: rows of lower hashes get one more, and tie of those at it.

    counted: s, z, u, m. classes: s, z, n, more.
    """
    some = classes.where("more > 0").select(F.struct("s", "z").alias("class"), "n", "more", F.ceil(F.col("n") / LOT).alias("lots"))
    keyed = counted.select(F.struct("s", "z").alias("class"), "u", "m")
    # The upper half of the hash, from 0, cut into as many equal parts.
    lot = F.shiftright((F.shiftright("u", 32) + F.lit(1 << 31)) * F.col("lots"), 32)
    dealt = materialize(join_by_key(keyed, some, "class", "n", counted.count()).withColumn("lot", lot).drop("lots"))
    earlier = lambda *by: Window.partitionBy("class", *by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)
    before = lambda value, *by: F.coalesce(F.sum(value).over(earlier(*by)), F.lit(0).cast("long"))
    lots = dealt.groupBy("class", "lot").agg(F.sum("m").alias("size"), F.first("more").alias("more"))
    cut = lots.withColumn("skipped", before("size", "lot")).where("skipped <= more and more < skipped + size").select("class", "lot", "skipped")
    inside = dealt.join(cut, ["class", "lot"]).withColumn("at", F.col("skipped") + before("m", "lot", "u"))
    return inside.where("at <= more and more < at + m").select("class.s", "class.z", F.col("u").alias("threshold"), (F.col("more") - F.col("at")).alias("tie"))


def _deal(keyed: DataFrame, weights: tuple[int, ...]) -> DataFrame:
    """One row for each class: s, z, n, what each of its rows gets (each, threshold, tie), and its source's source_size and target. keyed: s, z, u."""
    counted = materialize(keyed.groupBy("s", "z", "u").agg(F.count("*").alias("m")))
    classes = materialize(counted.groupBy("s", "z").agg(F.sum("m").alias("n")))
    sources = materialize(source_targets(classes, weights))
    copies = whole_copies(classes, solve(classes, sources))
    k = F.coalesce("k", F.lit(0).cast("long"))
    shared = materialize(classes.join(copies, ["s", "z"], "left").select("s", "z", "n", F.expr("coalesce(k, 0) div n").alias("each"), F.pmod(k, F.col("n")).alias("more")))
    cut = _thresholds(counted, shared)
    return materialize(shared.join(cut, ["s", "z"], "left").join(sources.select("s", "source_size", "target"), "s").drop("more"))


def _dealt(rows: DataFrame, deal: DataFrame) -> DataFrame:
    """rows (s, z, u and more) with source_size, target and copies instead of s and u."""
    entries = deal.select(F.struct("s", "z").alias("class"), "n", "each", "threshold", "tie", "source_size", "target")
    keyed = rows.withColumn("class", F.struct("s", "z"))
    if entries.count() <= BROADCAST_CLASSES:
        joined = keyed.join(F.broadcast(entries), "class")
    else:
        joined = join_by_key(keyed, entries, "class", "n", deal.agg(F.sum("n")).first()[0])
    tied = F.coalesce(F.col("tie") > 0, F.lit(False)) & (F.col("u") == F.col("threshold"))
    out = [*(c for c in rows.columns if c not in ("s", "u")), "source_size", "target"]
    more = F.coalesce((F.col("u") < F.col("threshold")).cast("long"), F.lit(0).cast("long"))
    plain = joined.where(~tied).select(*out, (F.col("each") + more).alias("copies"))
    if deal.where("tie > 0").isEmpty():
        return plain
    # Equal rows, of which some get one more: numbered within their partitions, whose counts are added up.
    equal = materialize(joined.where(tied).withColumn("part", F.spark_partition_id()))
    parts = equal.groupBy("class", "part").agg(F.count("*").alias("rows"))
    counts = parts.withColumn("before", F.coalesce(F.sum("rows").over(Window.partitionBy("class").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))).drop("rows")
    number = F.col("before") + F.row_number().over(Window.partitionBy("class", "part").orderBy("u")) - 1
    numbered = equal.join(counts, ["class", "part"]).withColumn("number", number)
    return plain.unionByName(numbered.select(*out, (F.col("each") + (F.col("number") < F.col("tie")).cast("long")).alias("copies")))


def with_copies(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """row (the columns of docs), size, source_size, target, copies. Rows stay where they are while their classes can be broadcast."""
    keyed = _keyed(docs)
    return _dealt(keyed, _deal(keyed.select("s", "z", "u"), weights)).withColumnRenamed("z", "size")


def mix_report(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """One row per row of docs: doc_id, size, source_size, target, taken."""
    keyed = materialize(_keyed(docs.select("doc_id", "text", "source")).select(F.col("row.doc_id").alias("doc_id"), "s", "z", "u"))
    dealt = _dealt(keyed, _deal(keyed.select("s", "z", "u"), weights))
    return dealt.select("doc_id", F.col("z").alias("size"), "source_size", "target", (F.col("z") * F.col("copies")).alias("taken"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """The rows of docs, each as often as the mix takes it."""
    copied = with_copies(docs, weights).where("copies > 0")
    return copied.select(F.explode(F.array_repeat("row", F.col("copies").cast("int"))).alias("row")).select("row.*")
