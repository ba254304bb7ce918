"""Usage statistics over sessions, messages and tool calls."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import DESTRUCTIVE, permission_pattern


def overview(sessions: DataFrame, messages: DataFrame, calls: DataFrame) -> DataFrame:
    """One row of four counts; each side is reduced to a row before the three meet."""
    s = sessions.agg(F.count("*").alias("sessions"))
    m = messages.agg(F.count("*").alias("messages"))
    c = calls.agg(F.count("*").alias("tool_calls"), F.count("bash_command").alias("bash_calls"))
    one = F.lit(1).alias("one")
    return s.select("*", one).join(m.select("*", one), "one").join(c.select("*", one), "one").drop("one")


def tool_usage(calls: DataFrame, limit: int = 50) -> DataFrame:
    """Ties are ordered by name."""
    return calls.groupBy("tool_name").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "tool_name").limit(limit)


def bash_breakdown(calls: DataFrame, limit: int = 100) -> DataFrame:
    return (
        calls.filter("bash_base is not null")
        .groupBy("bash_base", "bash_sub")
        .agg(F.count("*").alias("n"), F.max("is_compound").alias("is_compound"))
        .orderBy(F.desc("n"), "bash_base", F.asc_nulls_first("bash_sub"))
        .limit(limit)
    )


def bash_suggestions(calls: DataFrame, high: int = 50, medium: int = 10, top: int = 500) -> DataFrame:
    """Rungs in order: destructive, compound, then by count."""
    base = F.col("bash_base")
    rung = (
        F.when(base.isin(*DESTRUCTIVE), "skipped")
        .when(F.col("is_compound"), "review")
        .when(F.col("n") >= high, "high")
        .when(F.col("n") >= medium, "medium")
        .otherwise("review")
    )
    why = (
        F.when(base.isin(*DESTRUCTIVE), "destructive command")
        .when(F.col("is_compound"), "compound command")
        .when(F.col("n") >= medium, "frequent command")
        .otherwise("rare command")
    )
    rows = bash_breakdown(calls, top).filter(F.trim(base) != "")
    return rows.select(permission_pattern(base, F.col("bash_sub")).alias("pattern"), "n", rung.alias("confidence"), why.alias("reason"))


def token_usage(sessions: DataFrame, limit: int = 50) -> DataFrame:
    sums = sessions.groupBy("git_repo").agg(
        F.sum(F.coalesce("input_tokens", F.lit(0))).alias("input_tokens"),
        F.sum(F.coalesce("output_tokens", F.lit(0))).alias("output_tokens"),
    )
    total = F.col("input_tokens") + F.col("output_tokens")
    return sums.orderBy(total.desc(), "git_repo").limit(limit)


def usage_by_source(sessions: DataFrame, since=None, limit: int = 200) -> DataFrame:
    """An unknown cached sum is shown as 0 and leaves fresh unknown, as does one above the input."""
    rows = sessions.filter("input_tokens is not null or output_tokens is not null")
    if since is not None:
        rows = rows.filter(F.coalesce("ended_at", "started_at") >= F.lit(since))
    sums = rows.groupBy("source", "model", "host").agg(
        F.coalesce(F.sum("input_tokens"), F.lit(0)).alias("input_tokens"),
        F.coalesce(F.sum("output_tokens"), F.lit(0)).alias("output_tokens"),
        F.sum("cached_tokens").alias("cached"),
        F.count("*").alias("session_count"),
    )
    fresh = F.when(F.col("cached") <= F.col("input_tokens"), F.col("input_tokens") - F.col("cached"))
    shown = sums.select(
        "source", "model", "host", "input_tokens", F.coalesce("cached", F.lit(0)).alias("cached_tokens"),
        "output_tokens", fresh.alias("fresh_tokens"), "session_count",
    )
    total = F.col("input_tokens") + F.col("output_tokens")
    return shown.orderBy(total.desc(), "source", "model", "host").limit(limit)


def fleet_usage(parts: DataFrame, sentinel: str = "local") -> DataFrame:
    """Per-host usage rows merged; a sentinel host takes the endpoint's name."""
    host = F.when(F.col("host") == sentinel, F.col("endpoint")).otherwise(F.col("host"))
    return parts.groupBy("source", "model", host.alias("host")).agg(
        *[F.sum(c).alias(c) for c in ("input_tokens", "cached_tokens", "output_tokens", "fresh_tokens", "session_count")]
    )


def newest_transcripts(sessions: DataFrame) -> DataFrame:
    """Of copies of a transcript (source, host, key): file present first, then most recent, then by id."""
    copies = Window.partitionBy("source", F.coalesce("host", F.lit("")), "transcript").orderBy(
        F.desc("present"), F.desc_nulls_last("recency"), "id"
    )
    return sessions.withColumn("at", F.row_number().over(copies)).filter("at = 1").drop("at")


def skill_usage(uses: DataFrame, sessions: DataFrame) -> DataFrame:
    """uses (session_id, skill_name), sessions as newest_transcripts gives them."""
    return (
        uses.join(sessions.select(F.col("id").alias("session_id"), "source", "host"), "session_id")
        .groupBy("skill_name", "source", "host")
        .agg(F.count("*").alias("invocations"), F.countDistinct("session_id").alias("sessions"))
    )


def fleet_skills(parts: DataFrame) -> DataFrame:
    """Skill rows (endpoint, skill_name, source, host, invocations, sessions) of several hosts as one table; an endpoint's
    name stands for its host."""
    host = F.coalesce("endpoint", F.trim("host"))
    return parts.groupBy(F.trim("skill_name").alias("skill_name"), "source", host.alias("host")).agg(
        F.sum("invocations").alias("invocations"), F.sum("sessions").alias("sessions")
    )


def skill_violations(parts: DataFrame, coverage: DataFrame) -> DataFrame:
    """What makes an endpoint's answer unfit to merge: (endpoint, rule, n), no rows where all is well. coverage
    (endpoint, bounded, sources, attributed_invocations, considered_sessions, unattributed_candidates, and each as control_)."""
    names = ("attributed_invocations", "considered_sessions", "unattributed_candidates")
    known = coverage.withColumnRenamed("sources", "_sources").select("endpoint", "_sources")
    rows = parts.join(known, "endpoint", "left")
    blank = (F.trim("skill_name") == "") | (F.trim("host") == "")
    rules = [
        (blank, "blank name"),
        (F.col("sessions") > F.col("invocations"), "more sessions than invocations"),
        (~(F.col("invocations") > 0) | ~(F.col("sessions") > 0), "count not positive"),
        (~F.array_contains("_sources", F.col("source")), "source not asked for"),
    ]
    found = [rows.filter(test).groupBy("endpoint").agg(F.count("*").alias("n")).select("endpoint", F.lit(rule).alias("rule"), "n") for test, rule in rules]
    keys = ["endpoint", "skill_name", "source", "host"]
    twice = parts.groupBy(*keys).count().filter("count > 1").groupBy("endpoint").agg(F.count("*").alias("n"))
    found.append(twice.select("endpoint", F.lit("row given twice").alias("rule"), "n"))
    sums = parts.groupBy("endpoint").agg(F.sum("invocations").alias("_sum"))
    both = coverage.join(sums, "endpoint", "left")
    off = F.coalesce("_sum", F.lit(0)) != F.col("attributed_invocations")
    found.append(both.filter(off).select("endpoint", F.lit("rows do not add up").alias("rule"), F.lit(1).cast("long").alias("n")))
    for name in names:
        control, own = F.col(f"control_{name}"), F.col(name)
        bad = F.when(F.col("bounded"), control < own).otherwise(control != own)
        found.append(both.filter(bad).select("endpoint", F.lit(f"control of {name}").alias("rule"), F.lit(1).cast("long").alias("n")))
    return reduce(DataFrame.unionByName, found)


def usage_rollup(events: DataFrame, sessions: DataFrame) -> DataFrame:
    """Sums by source session; the smallest session id owns them, its siblings get NULL. Where sessions tell what they
    hold (known_prompt_tokens, known_completion_tokens), only rows that differ are returned."""
    names = ("prompt_tokens", "completion_tokens")
    sums = events.groupBy("source_session_id").agg(*[F.sum(n).alias(n) for n in names])
    owner = sessions.groupBy("source_session_id").agg(F.min("id").alias("owner"))
    now = (
        sessions.join(owner.join(sums, "source_session_id"), "source_session_id")
        .select("id", "source_session_id", *[F.when(F.col("id") == F.col("owner"), F.col(n)).alias(n) for n in names],
                *[F.col(f"known_{n}") for n in names if f"known_{n}" in sessions.columns])
    )
    if all(f"known_{n}" in sessions.columns for n in names):
        same = [F.col(n).eqNullSafe(F.col(f"known_{n}")) for n in names]
        now = now.filter(~reduce(lambda a, b: a & b, same)).drop(*[f"known_{n}" for n in names])
    return now


def coverage(files: DataFrame) -> DataFrame:
    """files (source, root, size, offset, missing, mtime) by source and root."""
    behind = F.col("offset") < F.col("size")
    return files.groupBy("source", "root").agg(
        F.count("*").alias("files"),
        F.count_if("missing").alias("missing"),
        F.count_if(~F.col("missing") & behind).alias("pending"),
        F.count_if(~F.col("missing") & ~behind).alias("current"),
        F.min(F.when(~F.col("missing") & behind, F.col("mtime"))).alias("oldest_pending"),
    )


def pending_split(rows: DataFrame, cutoff) -> DataFrame:
    early = F.col("mtime") < F.lit(cutoff)
    return rows.agg(
        F.sum(F.when(early, 1).otherwise(0)).alias("eligible"), F.sum(F.when(early, 0).otherwise(1)).alias("held")
    )


def selectivity(rows: DataFrame, wanted, share: float = 0.1) -> DataFrame:
    """Whether the rows wanted hold at most a share of the weight."""
    kept = F.coalesce(F.sum(F.when(wanted, F.col("weight"))), F.lit(0))
    return rows.agg(kept.alias("kept"), F.sum("weight").alias("total")).withColumn(
        "selective", F.col("kept") <= share * F.col("total")
    )


def high_water(messages: DataFrame) -> DataFrame:
    return messages.groupBy("session_id").agg(F.max("idx").alias("high_water"))


def high_water_of_path(sessions: DataFrame, messages: DataFrame) -> DataFrame:
    """By transcript path; one that several sessions stand for has no answer."""
    one = sessions.groupBy("path").agg(F.count("*").alias("n"), F.first("id").alias("session_id"))
    found = one.join(high_water(messages), "session_id", "left")
    return found.select("path", F.when(F.col("n") == 1, F.col("high_water")).alias("high_water"))


def move_classes(moves: DataFrame) -> DataFrame:
    """moves (before, after, proved): pairs by class: proved and alone, proved with several partners, unproved."""
    alone = lambda c: F.count("*").over(Window.partitionBy(c, "proved")) == 1
    kind = F.when(~F.col("proved"), "unproved").when(alone("before") & alone("after"), "moved").otherwise("ambiguous")
    return moves.select(kind.alias("class")).groupBy("class").agg(F.count("*").alias("n"))


def duplicate_census(rows: DataFrame, *keys: str) -> DataFrame:
    groups = rows.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")
    return groups.agg(F.count("*").alias("groups"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("excess"))


def recent_keys(rows: DataFrame, key: str, order: str, limit: int) -> DataFrame:
    return rows.groupBy(key).agg(F.max(order).alias("newest")).orderBy(F.desc("newest"), key).limit(limit)


def sample_paths(rows: DataFrame, paths: int = 3, top: int = 8) -> DataFrame:
    """rows (source, detail, path): files by (source, detail), with their first paths. Only as many
    paths as are shown are collected, so no group is gathered whole."""
    distinct = rows.select("source", "detail", "path").distinct()
    place = Window.partitionBy("source", "detail").orderBy("path")
    first = distinct.withColumn("at", F.row_number().over(place)).filter(F.col("at") <= paths)
    shown = first.groupBy("source", "detail").agg(F.array_join(F.array_sort(F.collect_list("path")), ",").alias("paths"))
    counts = distinct.groupBy("source", "detail").agg(F.count("*").alias("files"))
    best = counts.orderBy(F.desc("files"), "source", "detail").limit(top)
    return best.join(shown, ["source", "detail"])
