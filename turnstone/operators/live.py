"""Liveness, freshness and turn state of sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .relational import last_per_session


def liveness(rows: DataFrame, now, window: int = 300) -> DataFrame:
    """pid_alive, watched, ended, last_activity -> liveness; the first rule that holds decides."""
    age = F.lit(now).cast("timestamp_ntz").cast("timestamp").cast("long") - F.col("last_activity").cast("timestamp").cast("long")
    rule = (
        F.when(~F.col("pid_alive"), "ended")
        .when(F.col("watched"), "active")
        .when(F.col("ended"), "ended")
        .when(F.col("last_activity").isNull(), "unknown")
        .when(age <= window, "idle")
        .otherwise("unknown")
    )
    return rows.withColumn("liveness", rule)


def freshness(rows: DataFrame) -> DataFrame:
    limits = F.array_compact(
        F.array(
            F.when(F.col("offset") < F.col("size"), "behind"),
            F.when(F.col("missing"), "missing"),
            F.when(F.col("generation") < F.col("wanted"), "generation"),
        )
    )
    return rows.withColumn("lag_bytes", F.greatest(F.col("size") - F.col("offset"), F.lit(0))).withColumn(
        "limitations", F.array_join(limits, ",")
    ).withColumn("current", F.col("limitations") == "")


def turn_state(messages: DataFrame, calls: DataFrame, markers: DataFrame, tail: int = 8, open_most: int = 32) -> DataFrame:
    """messages (session_id, idx, role, agent_id), open calls (session_id, message_idx, idx, agent_id),
    last markers (session_id, message_idx, ends_turn) -> session_id, turn. The tail is taken over all rows and
    subagents' rows are left out afterwards, so a busy subagent can hide the main thread.
    """
    last = (
        last_per_session(messages, tail, "idx")
        .filter("agent_id is null")
        .groupBy("session_id")
        .agg(F.max_by("role", "idx").alias("last_role"))
    )
    open_ = (
        last_per_session(calls, open_most, "message_idx", "idx")
        .groupBy("session_id")
        .agg(F.max(F.col("agent_id").isNotNull()).alias("sub_open"), F.count("*").alias("open_calls"))
    )
    ends = markers.groupBy("session_id").agg(F.max_by("ends_turn", "message_idx").alias("ends_turn"))
    base = messages.select("session_id").distinct()
    joined = base.join(last, "session_id", "left").join(open_, "session_id", "left").join(ends, "session_id", "left")
    user_last = F.coalesce(F.col("last_role") == "user", F.lit(False))
    turn = (
        F.when(F.col("sub_open"), "subagents_running")
        .when(F.col("open_calls") > 0, "working")
        .when(F.col("ends_turn") & ~user_last, "awaiting_input")
        .when(~F.col("ends_turn") & ~user_last, "working")
        .otherwise("unknown")
    )
    return joined.select("session_id", turn.alias("turn"))


def three_valued(rows: DataFrame, condition) -> DataFrame:
    """matches: known to hold; possible_match: unknown."""
    return rows.withColumn("matches", F.coalesce(condition, F.lit(False))).withColumn(
        "possible_match", condition.isNull()
    )


def fleet_live(parts: DataFrame, limit: int) -> DataFrame:
    rank = F.when(F.col("liveness") == "active", 0).when(F.col("liveness") == "idle", 1).when(F.col("liveness") == "unknown", 2).otherwise(3)
    return parts.orderBy(rank, F.desc_nulls_last("last_activity"), "id").limit(limit)


def roster(sessions: DataFrame, files: DataFrame, watched: DataFrame, active_since) -> DataFrame:
    """Indexed sessions, catalogued files no session stands for, and watched paths nobody knows: path, id, arm,
    observed_write. sessions (id, path), files (path, present, mtime), watched (path)."""
    seen = watched.select("path").distinct().withColumn("w", F.lit(True))
    known = sessions.select("path", "id").join(files, "path", "left").withColumn("arm", F.lit("indexed"))
    bare = files.join(sessions.select("path"), "path", "left_anti").withColumns({"id": F.lit(None), "arm": F.lit("catalogued")})
    strange = seen.select("path").join(sessions.select("path"), "path", "left_anti").join(files.select("path"), "path", "left_anti")
    strange = strange.withColumns({"id": F.lit(None), "present": F.lit(None), "mtime": F.lit(None), "arm": F.lit("watched")})
    rows = known.unionByName(bare).unionByName(strange).join(seen, "path", "left")
    wrote = F.coalesce("w", F.lit(False)) | F.coalesce(F.col("present") & (F.col("mtime") >= active_since), F.lit(False))
    return rows.select("path", "id", "arm", wrote.alias("observed_write"))


def members(rows: DataFrame, include_idle: bool, idle_since) -> DataFrame:
    idle = F.coalesce(F.col("last_activity") >= idle_since, F.lit(False)) & F.lit(include_idle)
    return rows.filter(F.col("observed_write") | idle)


def watched_sessions(paths: list[str], sessions: DataFrame) -> DataFrame:
    """The watch list in its order, each path with every session that stands for it, or with none."""
    spark = sessions.sparkSession
    listed = spark.createDataFrame(list(enumerate(paths)), "place long, path string")
    return listed.join(sessions.select("path", "id"), "path", "left").orderBy("place", "id")


def live_coverage(rows: DataFrame, samples: int = 16) -> tuple[DataFrame, DataFrame]:
    """rows (path, id, matches, possible_match, last_activity) -> one row of counts, and the first paths of which nobody
    knows whether they match."""
    unknown = F.col("possible_match") & ~F.col("matches")
    counts = rows.agg(
        F.count("*").alias("observed_paths"), F.count("id").alias("indexed_paths"),
        F.count_if(F.col("id").isNull()).alias("unindexed_paths"), F.count_if(unknown).alias("unknown_count"),
    )
    return counts, rows.filter(unknown).orderBy(F.desc_nulls_last("last_activity"), "path").select("path").limit(samples)


def catch_up(rows: DataFrame) -> DataFrame:
    """Rows that a fresh read may bring up to date: indexed before, behind, and readable. rows (source, current, generation,
    size, limitations: comma-joined)."""
    barred = F.array_contains(F.split("limitations", ","), F.lit("catalog_source_missing")) | F.array_contains(
        F.split("limitations", ","), F.lit("not_yet_indexed")
    )
    return rows.filter(
        F.col("source").isNotNull() & ~F.col("current") & F.coalesce(F.col("generation") > 0, F.lit(False)) & F.col("size").isNotNull() & ~barred
    )


def marked_roster(rows: DataFrame, marks: DataFrame) -> DataFrame:
    """The roster with the live marks (path, pid_alive, marked_at) of its paths, the latest of each."""
    last = marks.groupBy("path").agg(F.max_by("pid_alive", "marked_at").alias("pid_alive"), F.max("marked_at").alias("marked_at"))
    return rows.join(last, "path", "left")


def merge_lists(parts: DataFrame, order: str, limit: int) -> DataFrame:
    """Lists of several endpoints (endpoint, host, id, order) as one: a host that is not named is its endpoint; a row that
    two endpoints tell, by host and id, is the one with the later order."""
    host = F.coalesce(F.nullif(F.trim("host"), F.lit("")), F.col("endpoint"))
    rest = [c for c in parts.columns if c not in ("host", "id", order)]
    best = parts.withColumn("host", host).groupBy("host", "id").agg(F.max(F.struct(order, *rest)).alias("r"))
    return best.select("host", "id", "r.*").orderBy(F.desc_nulls_last(order), "host", "id").limit(limit)


def full_freshness(rows: DataFrame) -> DataFrame:
    """As freshness, told with what the catalogue knows besides: rows (offset, size, missing, generation, wanted, signature,
    signature_now, boundary_ok, readable)."""
    limits = F.array_compact(
        F.array(
            F.when(F.col("missing"), "catalog_source_missing"),
            F.when(F.coalesce("generation", F.lit(0)) == 0, "not_yet_indexed"),
            F.when(F.col("offset") < F.col("size"), "behind"),
            F.when(F.col("generation") < F.col("wanted"), "generation"),
            F.when(~F.col("signature").eqNullSafe(F.col("signature_now")), "signature"),
            F.when(~F.coalesce("boundary_ok", F.lit(True)), "boundary"),
            F.when(~F.coalesce("readable", F.lit(True)), "unreadable"),
        )
    )
    lag = F.greatest(F.col("size") - F.col("offset"), F.lit(0))
    return rows.withColumn("lag_bytes", lag).withColumn("limitations", F.array_join(limits, ",")).withColumn("current", F.col("limitations") == "")
