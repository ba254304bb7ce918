"""Mixing sources to target weights by hash-threshold histograms.

Every row has a 60-bit hash. Sums of sizes by source and the hash's leading 12 bits give, for each
source, the bucket in which its budget ends; only rows of that bucket are summed again by the next
12 bits, and so on, until the threshold stands between two hash values. Rows are then filtered by
comparing hashes: nothing is sorted. Thresholds of the first, second, ... copy are nested: a row
that gets a further copy has all earlier ones.

Null text has size 0; null sources are one source, last in order. Rows with the same id and text
hash alike and are taken or left together. An empty table gives an empty mix.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stage, staging, whole_text

LEVEL_BITS = 12
LEVELS = 5
# Fixed values of the contract.
WEIGHTS = (5, 2, 1)
SHARE = Fraction(3, 2)
MOST = 2


def word_count(text: Column) -> Column:
    """Runs of characters other than ASCII white space: those that begin a run are counted."""
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]++")).cast("long")


def targets(sizes: list[tuple[str | None, int]], weights=WEIGHTS, share=SHARE, most=MOST) -> dict:
    """Exact targets by source: shares by weight, capped, the excess reshared by weight until none is above its cap."""
    order = sorted((s for s, _ in sizes if s is not None)) + [None for s, _ in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    size = dict(sizes)
    left, open_, out = share * sum(size.values()), set(order), {}
    while open_:
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / total > most * size[s]]
        if not over:
            out |= {s: left * weight[s] / total for s in open_}
            break
        for s in over:
            out[s] = Fraction(most * size[s])
            open_.discard(s)
        left -= sum(out[s] for s in over)
    return out


def spot(text: Column) -> Column:
    """A row's place among 2 ** (LEVEL_BITS * LEVELS) hash values."""
    digest = F.md5(F.concat_ws(":", F.col("doc_id").cast("long").cast("string"), F.md5(text)))
    return F.conv(F.substring(digest, 1, LEVEL_BITS * LEVELS // 4), 16, 10).cast("long")


def _sizes(docs: DataFrame) -> DataFrame:
    text = whole_text()
    return stage(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            "source",
            word_count(text).alias("size"),
            spot(text).alias("spot"),
            F.xxhash64(text).alias("text_hash"),
        ),
        "sizes",
    )


def thresholds(rows: DataFrame, weights=WEIGHTS, share=SHARE, most=MOST) -> DataFrame:
    with staging(rows.sparkSession):
        return _thresholds(rows, weights, share, most)


def _thresholds(rows: DataFrame, weights, share, most) -> DataFrame:
    """rows (source, size, spot) -> per source: _source, threshold, copies, source_size, target. A
    row is taken `copies` times and once more if its spot is below the threshold. Of each level but
    the first only the boundary buckets' rows are read: they are written once and refined from there.
    """
    spark = rows.sparkSession
    # one row a source comes to the driver
    sizes = [(r[0], r[1]) for r in rows.groupBy("source").agg(F.sum("size")).collect()]
    goal = targets(sizes, weights, share, most)
    plan = {s: divmod(goal[s], n) if n else (0, Fraction(0)) for s, n in sizes}
    # Budget of the copy that not all rows get; below: what lies under the boundary bucket so far.
    state = {s: {"prefix": 0, "below": 0, "budget": float(plan[s][1])} for s, _ in sizes}
    shape = T.StructType(
        [T.StructField("_source", T.StringType())]
        + [T.StructField(n, T.LongType()) for n in ("prefix", "below", "threshold", "copies", "source_size")]
        + [T.StructField(n, T.DoubleType()) for n in ("target", "budget")]
    )

    def frame():
        return spark.createDataFrame(
            [
                (s, x["prefix"], x["below"], x.get("threshold", 0), int(plan[s][0]), n, float(goal[s]), x["budget"])
                for s, n in sizes
                for x in [state[s]]
            ],
            shape,
        )

    total, inside = LEVEL_BITS * LEVELS, rows
    for level in range(LEVELS):
        shift = total - LEVEL_BITS * (level + 1)
        if level:
            at_boundary = F.shiftright("spot", shift + LEVEL_BITS) == F.col("prefix")
            inside = with_source(inside.select("source", "size", "spot"), frame()).filter(at_boundary).select("source", "size", "spot")
            if level == 1:
                inside = stage(inside, "boundary")
        bucket = F.shiftright("spot", shift)
        sums = inside.groupBy("source", bucket.alias("bucket")).agg(F.sum("size").alias("n"))
        # per source: at most 2 ** LEVEL_BITS buckets, summed from the left up to the budget
        buckets = sums.groupBy("source").agg(F.array_sort(F.collect_list(F.struct("bucket", "n"))).alias("buckets"))
        found = {r["source"]: r["end"] for r in with_source(buckets, frame()).select("source", _boundary().alias("end")).collect()}
        for s, x in state.items():
            if s in found:
                x |= {"prefix": found[s]["bucket"], "below": found[s]["below"], "last": found[s]["n"]}
            else:
                x["prefix"] <<= LEVEL_BITS
    for x in state.values():
        # the row (or rows of one hash) at the boundary goes in if the sum comes nearer by it
        over = x.get("last", 0) and x["below"] + x["last"] - x["budget"] < x["budget"] - x["below"]
        x["threshold"] = x["prefix"] + bool(over)
    return frame().drop("prefix", "below", "budget")


def _boundary() -> Column:
    """The first bucket that passes the budget, with what lies below it and what it holds; where none does, the
    place behind the last."""
    start = F.struct(
        F.col("below").alias("below"), F.lit(0).cast("long").alias("bucket"), F.lit(0).cast("long").alias("n"), F.lit(False).alias("over")
    )

    def step(acc, x):
        over = acc["below"] + x["n"] > F.col("budget")
        keep = lambda name, at, behind: F.when(acc["over"], acc[name]).when(over, at).otherwise(behind).alias(name)
        return F.struct(
            keep("below", acc["below"], acc["below"] + x["n"]), keep("bucket", x["bucket"], x["bucket"] + 1),
            keep("n", x["n"], F.lit(0).cast("long")), (acc["over"] | over).alias("over"),
        )

    return F.aggregate("buckets", start, step)


def with_source(rows: DataFrame, known: DataFrame) -> DataFrame:
    """known has one row a source and comes from the driver, so its size is proven."""
    return rows.join(F.broadcast(known), F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source")


def _copies(spots: Column, most: int = MOST) -> Column:
    return F.least(F.col("copies") + (spots < F.col("threshold")).cast("long"), F.lit(most))


def mix_documents(docs: DataFrame, weights=WEIGHTS, share=SHARE, most=MOST) -> DataFrame:
    """docs (doc_id, text, source) -> per row: doc_id, text_hash, size, source_size, target, copies, taken."""
    rows = _sizes(docs)
    copies = _copies(F.col("spot"), most)
    return with_source(rows, thresholds(rows, weights, share, most)).select(
        "doc_id", "text_hash", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken")
    )


def apply_mix(docs: DataFrame) -> DataFrame:
    """docs as the mix takes them: rows it leaves out go, rows it repeats come twice. Each row's hash
    is compared with its source's thresholds where the row stands: no row moves.
    """
    names = docs.columns
    marked = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), F.col("source").alias("source"), spot(whole_text()).alias("spot")
    )
    with staging(docs.sparkSession):
        known = thresholds(_sizes(docs))
    again = with_source(marked, known).select(
        "_row", F.explode(F.array_repeat(F.lit(1), _copies(F.col("spot")).cast("int")))
    )
    return again.select(*[F.col("_row").getField(c).alias(c) for c in names])
