"""Schemas and deterministic identity of the session-history model."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SESSIONS = (
    "id string, source string, source_path string, source_session_id string, started_at timestamp_ntz, "
    "ended_at timestamp_ntz, model string, cwd string, git_repo string, git_branch string, host string, "
    "input_tokens bigint, output_tokens bigint, cached_tokens bigint, file_mtime double, indexed_at timestamp_ntz"
)
MESSAGES = (
    "id string, session_id string, idx int, agent_id string, role string, content string, thinking string, "
    "timestamp timestamp_ntz"
)
TOOL_CALLS = (
    "id string, session_id string, message_id string, idx int, tool_name string, tool_input string, "
    "bash_command string, bash_base string, bash_sub string, is_compound boolean, tool_use_id string, agent_id string"
)
TOOL_RESULTS = "session_id string, tool_use_id string, result_summary string, is_error boolean, completed_at timestamp_ntz"
STOP_MARKERS = "session_id string, message_idx int, reason string, ends_turn boolean"


def short_hash(*parts) -> Column:
    """First 32 hex digits of the SHA-256 of the parts joined by colons."""
    return F.substring(F.sha2(F.concat_ws(":", *parts), 256), 1, 32)


def session_id(source, path) -> Column:
    return short_hash(source, path)


def message_id(session, idx) -> Column:
    return short_hash(session, F.col(idx).cast("string") if isinstance(idx, str) else idx.cast("string"))


def tool_call_id(message, idx) -> Column:
    return message_id(message, idx)


def orphan_call_id(session, idx) -> Column:
    return short_hash(session, F.lit("orphan"), F.col(idx).cast("string") if isinstance(idx, str) else idx.cast("string"))
