"""What the operators of this folder share: staged tables, size-checked joins, text positions."""

from __future__ import annotations

import ctypes
import ctypes.util
import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only when its measured size is at most this.
BROADCAST_BYTES = 32 << 20


def scratch_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; one of our own only on a local master where it is unset."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not sc.master.startswith("local[") and sc.master != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="turnstone-"))
    return sc.getCheckpointDir().rstrip("/")


def run_folder(spark: SparkSession) -> str:
    """The folder of all that this application stages; its owner may drop it when the results are written."""
    return f"{scratch_dir(spark)}/turnstone-{spark.sparkContext.applicationId}"


def fresh_path(spark: SparkSession, tag: str) -> str:
    return f"{run_folder(spark)}/{tag}-{uuid.uuid4().hex}"


#: Rows of whole texts that are sent to a Python worker at once.
TEXT_BATCH = 500
BATCH_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"


def stage(df: DataFrame, tag: str, batch: int | None = None) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends, and ids given at random stay as written. batch
    bounds the rows that a Python worker is sent at once while df is written; the session's setting holds again after.
    """
    spark = df.sparkSession
    path = fresh_path(spark, tag)
    if (scope := _scope.get()) is not None:
        scope.paths.append(path)
    before = spark.conf.get(BATCH_SETTING)
    if batch is not None:
        spark.conf.set(BATCH_SETTING, batch)
    try:
        df.write.mode("overwrite").parquet(path)
    finally:
        spark.conf.set(BATCH_SETTING, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged = path
    return out


def drop_folder(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def unstage(df: DataFrame) -> None:
    """Delete a staged table that no live plan reads any more."""
    drop_folder(df.sparkSession, df._staged)


class Scope:
    """Tables staged within `staging`; those kept belong to the scope around it."""

    def __init__(self, outer: Scope | None):
        self.paths: list[str] = []
        self.outer = outer

    def keep(self, df: DataFrame) -> DataFrame:
        self.paths.remove(df._staged)
        if self.outer is not None:
            self.outer.paths.append(df._staged)
        return df


_scope: ContextVar[Scope | None] = ContextVar("scope", default=None)


@contextmanager
def staging(spark: SparkSession):
    """Tables that are staged inside and not kept are deleted at the end: what is returned must not read them."""
    scope = Scope(_scope.get())
    before = _scope.set(scope)
    try:
        yield scope
    finally:
        _scope.reset(before)
        for path in scope.paths:
            drop_folder(spark, path)


def drop_run(spark: SparkSession) -> None:
    """Delete all that this application has staged, when its results are written."""
    drop_folder(spark, run_folder(spark))


def checked_broadcast(staged: DataFrame, row_bytes: int) -> DataFrame:
    """Hint a broadcast if rows * row_bytes is at most BROADCAST_BYTES; beyond it Spark shuffles both sides."""
    return F.broadcast(staged) if staged.count() * row_bytes <= BROADCAST_BYTES else staged


def whole_text(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def let(value: Column, body) -> Column:
    """Evaluate value once and hand it to body."""
    return F.element_at(F.transform(F.array(value), body), 1)


@cache
def _libc():
    name = ctypes.util.find_library("c")
    return ctypes.CDLL(name) if name else None


def give_back() -> None:
    """Return what this Python worker has freed to the system, so that the idle workers of one stage do
    not hold memory that the next one needs."""
    pa.default_memory_pool().release_unused()
    if hasattr(_libc(), "malloc_trim"):
        _libc().malloc_trim(0)


def mix64(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


SPANS = "array<struct<start:int,end:int,hit:string>>"


#: Elements that a fold appends one by one before it puts a block of them away.
BLOCK = 128


def fold(items: Column, start: Column, step, shape: str) -> Column:
    """Run step(state, item) -> (state, emitted) over an array from `start` on and collect what is
    emitted, of type `shape`. An array grows by copying, so items are folded in blocks of BLOCK and
    the blocks joined at the end: the cost stays in proportion to the array.
    """
    none = F.array().cast(f"array<{shape}>")

    def one(acc, x):
        return let(step(acc["state"], x), lambda r: F.struct(r["state"].alias("state"), F.concat(acc["out"], F.array(r["emit"])).alias("out")))

    def block(acc, part):
        inner = F.aggregate(part, F.struct(acc["state"].alias("state"), none.alias("out")), one)
        return let(inner, lambda r: F.struct(r["state"].alias("state"), F.concat(acc["out"], F.array(r["out"])).alias("out")))

    def blocked(whole):
        count = F.ceil(F.size(whole) / BLOCK).cast("int")
        parts = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.slice(whole, i * BLOCK + 1, F.lit(BLOCK)))
        first = F.struct(start.alias("state"), F.array().cast(f"array<array<{shape}>>").alias("out"))
        return F.when(count > 0, F.flatten(F.aggregate(parts, first, block, lambda acc: acc["out"]))).otherwise(none)

    return let(items, blocked)


def located(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches of a pattern that never matches the empty string: an
    array of (start, end, hit) in code points. What lies between matches (split) gives the places.
    """
    between = F.split(text, pattern, -1)
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.zip_with(between, hits, lambda b, h: F.struct(F.length(b).alias("skip"), h.alias("hit")))

    def step(at, x):
        begin = at + x["skip"]
        end = begin + F.length(x["hit"])
        span = F.struct(begin.alias("start"), end.alias("end"), x["hit"].alias("hit"))
        return F.struct(end.alias("state"), span.alias("emit"))

    walked = fold(F.filter(pairs, lambda x: x["hit"].isNotNull()), F.lit(0), step, "struct<start:int,end:int,hit:string>")
    return F.when(text.rlike(pattern), walked).otherwise(F.array().cast(SPANS))


def text_hash() -> Column:
    return F.xxhash64(whole_text())


def one_of_each(rows: DataFrame, group: str, order: Column) -> DataFrame:
    """rows (group, doc_id, digest, n: rows with that id and digest) -> marks for `keep_rows`, so that of each group
    only the first by order stays. Groups of one row need none."""
    tops = rows.groupBy(group).agg(F.min(F.struct(order.alias("o"), "doc_id", "digest")).alias("top"), F.sum("n").alias("_rows"))
    some = stage(tops.filter("_rows > 1").select(F.col(group).alias("_group"), "top"), "tops")
    near = rows.join(checked_broadcast(some, 120), F.col(group).eqNullSafe(F.col("_group")))
    first = F.col("doc_id").eqNullSafe(F.col("top.doc_id")) & (F.col("digest") == F.col("top.digest"))
    return near.withColumn("_first", first).filter("not _first or n > 1").select(
        F.col("doc_id").alias("_id"), F.col("digest").alias("_digest"), F.col("_first").alias("_one")
    )


def keep_rows(docs: DataFrame, marks: DataFrame, digest: Column) -> DataFrame:
    """docs without the rows whose (doc_id, digest of the text) stands in marks (staged; columns _id, _digest, _one), but
    for one row of each key that is marked _one. Only marked rows are looked for and only repeated ones grouped; the
    others pass where they stand. Columns of docs pass through unchanged, whatever their names.
    """
    names = docs.columns
    marked = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), F.col("doc_id").alias("_did"), digest.alias("_dig"))
    same = F.col("_did").eqNullSafe(F.col("_id")) & (F.col("_dig") == F.col("_digest"))
    stays = marked.join(checked_broadcast(marks.select("_id", "_digest"), 160), same, "left_anti").select("_row")
    if marks.filter("_one").limit(1).count():
        one = marked.join(checked_broadcast(marks.filter("_one").select("_id", "_digest"), 160), same, "left_semi")
        stays = stays.unionByName(one.groupBy("_did", "_dig").agg(F.first("_row").alias("_row")).select("_row"))
    return stays.select(*[F.col("_row").getField(c).alias(c) for c in names])
