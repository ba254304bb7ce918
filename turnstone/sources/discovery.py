"""Which transcripts there are: files below configured roots, each owned by one root, newest first."""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.relational import among

#: Names of transcripts and their compressed form.
PATTERN = "*.{jsonl,jsonl.zst}"


def _plain(path: Column) -> Column:
    """A path without its scheme's authority and doubled slashes."""
    return F.regexp_replace(F.regexp_replace(path, "^file:/+", "/"), "(?<!:)//+", "/")


def discover(spark: SparkSession, roots: list[tuple[str, str]], pattern: str = PATTERN) -> DataFrame:
    """roots (source, folder) -> source, root, path, mtime, size of every file below. Only file listings are read, not
    contents. A file below several roots of a source belongs to the innermost; a transcript that stands there plain and
    compressed is the plain one. Links are followed as the file system lists them."""
    found = None
    for source, root in roots:
        listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
        rows = listed.select(
            F.lit(source).alias("source"), F.lit(unquote(root).rstrip("/")).alias("root"), _plain(F.col("path")).alias("path"),
            F.col("modificationTime").alias("mtime"), F.col("length").alias("size"),
        )
        found = rows if found is None else found.unionByName(rows)
    identity = F.regexp_replace("path", r"\.zst$", "")
    by = Window.partitionBy("source", identity).orderBy(F.col("path").endswith(".zst"), F.desc(F.length("root")))
    return found.withColumn("at", F.row_number().over(by)).filter("at = 1").drop("at")


def newest_first(files: DataFrame) -> DataFrame:
    return files.orderBy(F.desc("mtime"), "path")


def in_scope(files: DataFrame, since=None, project: str | None = None, sessions: DataFrame | None = None) -> DataFrame:
    """Files written since a time (the file's, so one that was never read counts as well), and those whose session
    (source, path, git_repo) lies in a project, by a part of the repository's name."""
    rows = files if since is None else files.filter(F.col("mtime") >= F.lit(since))
    if project:
        if sessions is None:
            raise ValueError("a project's scope needs the sessions")
        rows = among(rows, sessions.filter(F.col("git_repo").ilike(f"%{project}%")), "source", "path")
    return rows
