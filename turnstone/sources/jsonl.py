"""JSONL transcripts: capture of complete lines, and the usage log."""

from __future__ import annotations

import hashlib
import io
import json

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import first_int, first_of, lenient_int, shell_command, usage_event_id

LINE_LIMIT, INFLATED_LIMIT = 64 << 20, 96 << 20
PATTERN = "*.{jsonl,jsonl.zst}"
CAPTURED = "path string, line int, offset long, record string, committed long, digest string"
USAGE_MESSAGE = "shell.turn.inference_done"


def captured_lines(content: bytes, limit: int = LINE_LIMIT):
    """(line, offset, record) of complete lines, up to the first that is malformed, no object, or too long;
    then the committed offset and the SHA-256 of what was taken."""
    at, n, taken, rolling = 0, 0, [], hashlib.sha256()
    while (end := content.find(b"\n", at)) >= 0:
        raw = content[at : end + 1]
        try:
            whole = len(raw) <= limit and (not raw.strip() or isinstance(json.loads(raw), dict))
        except ValueError:
            whole = False
        if not whole:
            break
        if raw.strip():
            taken.append((n, at, raw.decode("utf-8", "replace").strip()))
        rolling.update(raw)
        at, n = end + 1, n + 1
    return taken, at, rolling.hexdigest()


def inflated(content: bytes, limit: int = INFLATED_LIMIT) -> bytes | None:
    """A .zst file's content; None where it is no such file or exceeds the limit."""
    import zstandard

    try:
        with zstandard.ZstdDecompressor().stream_reader(io.BytesIO(content), read_across_frames=True) as reader:
            out = reader.read(limit + 1)
    except zstandard.ZstdError:
        return None
    return out if len(out) <= limit else None


def opened(spark: SparkSession, path: str, glob: str = PATTERN) -> DataFrame:
    """path, content of every file; a file is read whole by one task."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    return files.select("path", "content")


def taken_from(name: str, content: bytes):
    """captured_lines of a file; a compressed one that cannot be read gives nothing."""
    raw = inflated(content) if name.endswith(".zst") else content
    return captured_lines(bytes(raw)) if raw is not None else ([], None, None)


def capture(spark: SparkSession, path: str, glob: str = PATTERN) -> DataFrame:
    """Complete records of every file, and one row a file, of line -1 and without a record, that tells how far it was
    read and the digest of that. An unterminated tail is left for later. `.zst` files are inflated first; a file that
    cannot be inflated has no digest."""

    def read(frames):
        for frame in frames:
            for name, content in zip(frame["path"], frame["content"], strict=True):
                taken, committed, digest = taken_from(name, bytes(content))
                rows = [(name, -1, None, None, committed, digest), *((name, *x, None, None) for x in taken)]
                out = pd.DataFrame(rows, columns=[c.split()[0] for c in CAPTURED.split(", ")])
                yield out.astype({"offset": "Int64", "committed": "Int64"})

    return opened(spark, path, glob).mapInPandas(read, CAPTURED)


def captured_files(captured: DataFrame) -> DataFrame:
    """path, committed, digest of every file, those without a complete record as well."""
    return captured.filter("line = -1").select("path", "committed", "digest")


def usage_events(lines: DataFrame, source: str = "grok") -> DataFrame:
    """lines (value) of the usage log -> events; other messages and lines without a session id are passed over."""
    v = F.col("value")
    at = lambda p: F.get_json_object(v, p)
    number = lambda p: lenient_int(at(p))
    rows = lines.filter((at("$.msg") == USAGE_MESSAGE) & F.coalesce(at("$.sid") != "", F.lit(False)) & at("$.ctx").startswith("{"))
    out = rows.select(
        F.lit(source).alias("source"),
        at("$.sid").alias("source_session_id"),
        F.try_to_timestamp(at("$.ts")).alias("ts"),
        number("$.ctx.prompt_tokens").alias("prompt_tokens"),
        number("$.ctx.cached_prompt_tokens").alias("cached_tokens"),
        number("$.ctx.completion_tokens").alias("completion_tokens"),
        number("$.ctx.reasoning_tokens").alias("reasoning_tokens"),
        usage_event_id(
            F.lit(source), at("$.sid"), at("$.ts"), at("$.ctx.loop_index"), at("$.ctx.prompt_tokens"), at("$.ctx.completion_tokens")
        ).alias("id"),
    )
    return out


def claude_messages(records: DataFrame) -> DataFrame:
    """Captured records -> messages by position: path, idx, role, content, thinking, timestamp, model, tokens, stop reason.
    Only user and assistant records (and the older `message` records) are messages."""
    from pyspark.sql import Window

    r = F.col("record")
    kind, role = F.get_json_object(r, "$.type"), first_of(r, "$.message.role", "$.role", "$.type")
    raw = F.get_json_object(r, "$.message.content")
    blocks = F.from_json(raw, "array<struct<type:string,text:string,thinking:string,id:string,name:string,input:string>>")
    text = lambda types, field: F.array_join(
        F.transform(F.filter(blocks, lambda b: b["type"].isin(*types)), lambda b: b[field]), "\n"
    )
    rows = records.filter(kind.isin("user", "assistant", "message")).select(
        "path", "line", role.alias("role"),
        F.when(raw.startswith("["), text(("text", "input_text", "output_text"), "text")).otherwise(raw).alias("content"),
        F.nullif(F.when(raw.startswith("["), text(("thinking",), "thinking")), F.lit("")).alias("thinking"),
        F.when(raw.startswith("["), F.filter(blocks, lambda b: b["type"] == "tool_use")).alias("tools"),
        F.try_to_timestamp(F.get_json_object(r, "$.timestamp")).alias("timestamp"),
        first_of(r, "$.message.model", "$.model").alias("model"),
        first_int(r, "$.message.usage.input_tokens", "$.inputTokens").alias("fresh"),
        first_int(r, "$.message.usage.cache_creation_input_tokens").alias("made"),
        first_int(r, "$.message.usage.cache_read_input_tokens").alias("cached_tokens"),
        first_int(r, "$.message.usage.output_tokens", "$.outputTokens").alias("output_tokens"),
        first_of(r, "$.message.stop_reason").alias("stop_reason"),
    )
    known = F.coalesce("fresh", "made", "cached_tokens").isNotNull()
    total = F.when(known, sum((F.coalesce(c, F.lit(0)) for c in ("fresh", "made", "cached_tokens")), F.lit(0)))
    place = Window.partitionBy("path").orderBy("line")
    return (
        rows.withColumn("input_tokens", total)
        .withColumn("idx", F.row_number().over(place) - 1)
        .withColumn("ends_turn", F.col("stop_reason").isin("end_turn", "stop_sequence"))
        .drop("fresh", "made", "line")
    )


def claude_calls(messages: DataFrame) -> DataFrame:
    """Tool calls of messages, in order."""
    rows = messages.select("path", F.col("idx").alias("message_idx"), F.posexplode("tools").alias("idx", "t"))
    command = shell_command(F.col("t.name"), F.col("t.input"))
    return rows.select(
        "path", "message_idx", "idx", F.col("t.id").alias("tool_use_id"), F.col("t.name").alias("tool_name"),
        F.col("t.input").alias("tool_input"), command.alias("bash_command"),
    )
