"""Reading sessions: lists, whole sessions and their ends, cursors, and facts derived from messages."""

from __future__ import annotations

import base64
import binascii
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import last_activity, recency
from .relational import among

TAIL = 100
LIVE_PAGE = 256


def activity(name: str = "indexed_at") -> Column:
    return recency(F.col("ended_at"), F.col("started_at"), F.col(name))


def list_sessions(
    sessions: DataFrame,
    limit: int | None = 50,
    source: str | None = None,
    since=None,
    project: str | None = None,
    host: str | None = None,
    session: str | None = None,
) -> DataFrame:
    """Sessions (id, source, host, git_repo, started_at, ended_at, indexed_at) by their last activity, newest first. Filters
    are exact but for project, a part of the repository's name in either case."""
    rows = sessions
    for name, value in (("source", source), ("host", host), ("id", session)):
        if value is not None:
            rows = rows.filter(F.col(name) == value)
    if project is not None:
        rows = rows.filter(F.col("git_repo").ilike(f"%{project}%"))
    if since is not None:
        rows = rows.filter(activity() >= F.lit(since))
    if limit is None:
        return rows
    return rows.orderBy(F.desc_nulls_last(activity()), "id").limit(limit)


def with_calls(messages: DataFrame, calls: DataFrame) -> DataFrame:
    """Messages with their tool calls in order, as an array."""
    rest = [c for c in calls.columns if c not in ("session_id", "message_id")]
    own = calls.filter("message_id is not null").groupBy(F.col("message_id").alias("id")).agg(
        F.array_sort(F.collect_list(F.struct("idx", *[c for c in rest if c != "idx"]))).alias("tool_calls")
    )
    return messages.join(own, "id", "left")


def load_sessions(
    messages: DataFrame, calls: DataFrame, ids: DataFrame, tools: bool = True, message_limit: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """(messages, orphan calls) of the sessions in ids (id): messages from the head on, in order; calls of no message apart."""
    wanted = ids.select(F.col("id").alias("session_id"))
    rows = among(messages, wanted, "session_id")
    if message_limit is not None:
        rows = rows.orderBy("idx", "id").limit(message_limit)
    mine = among(calls, wanted, "session_id")
    orphans = mine.filter("message_id is null").orderBy("idx")
    return (with_calls(rows, mine) if tools else rows), orphans


def load_tail(
    messages: DataFrame, calls: DataFrame, session_id, tail: int | None = None, after_idx: int | None = None, tools: bool = False
) -> DataFrame:
    """The last messages of a session, or those behind a cursor, or the last of these, in order. Calls are those of the
    messages returned: what lies outside the window, or belongs to no message, is not there."""
    if tail is not None and tail <= 0:
        raise ValueError("tail must be positive")
    rows = messages.filter(F.col("session_id") == session_id)
    if after_idx is not None:
        rows = rows.filter(F.col("idx") > after_idx)
    if tail is not None:
        rows = rows.orderBy(F.desc("idx"), F.desc("id")).limit(tail)
    if tools:
        mine = calls.filter(F.col("session_id") == session_id)
        rows = with_calls(rows, among(mine, rows.select(F.col("id").alias("message_id")), "message_id"))
    return rows.orderBy("idx", "id")


class Cursor(NamedTuple):
    session_id: str
    last_idx: int
    epoch: int | None


# The forms of cursors.
CURSOR, OLD_CURSOR, PAGE_CURSOR = "v2", "v1", "live-v1"


def _packed(*parts) -> str:
    return base64.urlsafe_b64encode(":".join(map(str, parts)).encode()).decode().rstrip("=")


def _unpacked(text: str) -> str:
    try:
        return base64.urlsafe_b64decode(text + "=" * (-len(text) % 4)).decode()
    except (binascii.Error, UnicodeDecodeError, ValueError) as error:
        raise ValueError(f"malformed cursor: {text}") from error


def _count(text: str, cursor: str) -> int:
    if not text.isdecimal():
        raise ValueError(f"malformed cursor: {cursor}")
    return int(text)


def encode_cursor(session_id: str, last_idx: int, epoch: int = 0) -> str:
    if epoch < 0:
        raise ValueError("an epoch cannot be negative")
    return _packed(CURSOR, epoch, session_id, last_idx)


def decode_cursor(cursor: str) -> Cursor:
    """Of the present form, or the one before it, which knew no epoch. A place before the first message is -1."""
    form, _, rest = _unpacked(cursor).partition(":")
    epoch = None
    if form == CURSOR:
        first, _, rest = rest.partition(":")
        epoch = _count(first, cursor)
    elif form != OLD_CURSOR:
        raise ValueError(f"malformed cursor: {cursor}")
    session, _, at = rest.rpartition(":")
    if not session:
        raise ValueError(f"malformed cursor: {cursor}")
    return Cursor(session, -_count(at[1:], cursor) if at.startswith("-") else _count(at, cursor), epoch)


def encode_page(offset: int) -> str:
    if offset < 0:
        raise ValueError("an offset cannot be negative")
    return _packed(PAGE_CURSOR, offset)


def decode_page(cursor: str | None) -> int:
    if cursor is None:
        return 0
    form, _, at = _unpacked(cursor).partition(":")
    if form != PAGE_CURSOR:
        raise ValueError(f"malformed cursor: {cursor}")
    return _count(at, cursor)


def check_read(session_id: str, message_limit: int | None = None, tail: int | None = None, after: str | None = None) -> Cursor | None:
    """What may be asked of one read: a limit reads from the head, tail and after from the end; a cursor names its session."""
    if message_limit is not None and (tail is not None or after is not None):
        raise ValueError("message_limit reads from the start of a session; tail and after read from its end")
    if tail is not None and tail <= 0:
        raise ValueError("tail must be positive")
    cursor = decode_cursor(after) if after is not None else None
    if cursor is not None and cursor.session_id != session_id:
        raise ValueError(f"cursor belongs to another session: {cursor.session_id}")
    return cursor


def read_behind(
    messages: DataFrame, calls: DataFrame, session_id: str, after: str, epoch: int, tail: int | None = None, tools: bool = False
) -> tuple[DataFrame, bool]:
    """(messages, whether the cursor was reset): where the session's content was replaced since the cursor was given, its
    place says nothing any more, and the last TAIL messages are read."""
    cursor = check_read(session_id, tail=tail, after=after)
    reset = (cursor.epoch or 0) != epoch
    after_idx = None if reset else cursor.last_idx
    return load_tail(messages, calls, session_id, (tail or TAIL) if reset else tail, after_idx, tools), reset


def live_page(rows: DataFrame, limit: int, cursor: str | None = None, keep: Column | None = None) -> DataFrame:
    """A page of the live roster: newest activity first. keep is tested on the page, so a page may hold fewer rows."""
    if not 1 <= limit <= LIVE_PAGE:
        raise ValueError(f"limit must lie within 1..{LIVE_PAGE}")
    page = rows.orderBy(F.desc_nulls_last("last_activity"), "id").offset(decode_page(cursor)).limit(limit)
    return page if keep is None else page.filter(keep)


def with_activity(sessions: DataFrame) -> DataFrame:
    """sessions (ended_at, file_mtime) with last_activity."""
    return sessions.withColumn("last_activity", last_activity(F.col("ended_at"), F.col("file_mtime")))


def derive_sessions(messages: DataFrame, calls: DataFrame, usage: DataFrame) -> DataFrame:
    """Per session, from what was parsed: messages (session_id, at), calls (session_id), usage (session_id, input_tokens,
    output_tokens) -> times, whole seconds between them, counts and token sums; a sum of unknowns is unknown."""
    said = messages.groupBy("session_id").agg(F.min("at").alias("started_at"), F.max("at").alias("ended_at"), F.count("*").alias("message_count"))
    made = calls.groupBy("session_id").agg(F.count("*").alias("tool_count"))
    spent = usage.groupBy("session_id").agg(F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"))
    whole = lambda c: F.col(c).cast("timestamp").cast("double")
    return (
        said.join(made, "session_id", "left")
        .join(spent, "session_id", "left")
        .withColumn("tool_count", F.coalesce("tool_count", F.lit(0)))
        .withColumn("duration_seconds", F.floor(whole("ended_at") - whole("started_at")).cast("long"))
    )


def with_state(messages: DataFrame, state: DataFrame, sessions: DataFrame) -> DataFrame:
    """Messages with their state (message_id, ...) and their session's source, path and host."""
    about = sessions.select(F.col("id").alias("session_id"), "source", "host")
    return messages.join(state.withColumnRenamed("message_id", "id"), "id").join(about, "session_id")


def recompute_groups(sessions: DataFrame, messages: DataFrame, since=None, only_mode: str | None = None) -> DataFrame:
    """All messages of the sessions that hold a message whose context is to be made anew, each with is_target. Targets
    have content or thinking and, where asked, were given their context by one mode; no mode is `off`."""
    rows = sessions if since is None else sessions.filter(activity() >= F.lit(since))
    target = F.col("content").isNotNull() | F.col("thinking").isNotNull()
    if only_mode is not None:
        target = target & (F.coalesce("context_mode", F.lit("off")) == only_mode)
    marked = messages.withColumn("is_target", target)
    held = marked.filter("is_target").select("session_id").distinct()
    inside = among(held, rows.select(F.col("id").alias("session_id")), "session_id")
    return among(marked, inside, "session_id")


def census(groups: DataFrame, rows: DataFrame, key: str, name: str) -> DataFrame:
    """Rows by group, groups without any included: (key, name)."""
    counts = rows.groupBy(key).agg(F.count("*").alias(name))
    return groups.select(key).distinct().join(counts, key, "left").select(key, F.coalesce(name, F.lit(0)).alias(name))


def call_counts(sessions: DataFrame, calls: DataFrame) -> DataFrame:
    """Sessions (id, host) that made calls, with their number; calls are counted before they meet their session."""
    counts = calls.groupBy(F.col("session_id").alias("id")).agg(F.count("*").alias("calls"))
    return sessions.select("id", "host").join(counts, "id")


def with_presence(rows: DataFrame, there: DataFrame, key: str) -> DataFrame:
    """rows with `present`: whether their key stands in there."""
    mark = there.select(key).distinct().withColumn("present", F.lit(True))
    return rows.join(mark, key, "left").withColumn("present", F.coalesce("present", F.lit(False)))


def roster_union(**arms: DataFrame) -> DataFrame:
    """name=frame with id: one list of (kind, id)."""
    out = None
    for name, rows in arms.items():
        one = rows.select(F.lit(name).alias("kind"), "id")
        out = one if out is None else out.unionByName(one)
    return out


def relabel_host(sessions: DataFrame, before: str, after: str) -> DataFrame:
    return sessions.withColumn("host", F.when(F.col("host") == before, after).otherwise(F.col("host")))
