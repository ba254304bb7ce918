"""Results as records: JSON, projections, search guidance, and a stream of what comes in."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

ISO = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "ignoreNullFields": "false"}


def records(rows: DataFrame) -> DataFrame:
    """One JSON text a row, times as ISO; nulls are written."""
    return rows.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in rows.columns]), ISO).alias("record"))


def write_records(rows: DataFrame, path: str, form: str = "jsonl") -> None:
    """JSON Lines files, or rows of tab-separated text with a head; both are written by the executors."""
    if form == "jsonl":
        rows.write.options(**ISO).mode("overwrite").json(path)
    elif form == "text":
        shown = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in rows.columns]
        plain = [F.regexp_replace(c, r"[\t\n\r]", " ") for c in shown]
        rows.select(*[c.alias(n) for c, n in zip(plain, rows.columns, strict=True)]).write.mode("overwrite").csv(path, sep="\t", header=True)
    else:
        raise ValueError(f"unsupported output: {form}")


def lines(rows: DataFrame, form: str = "jsonl") -> Iterator[str]:
    """A bounded result's lines for a terminal, partition by partition: `jsonl`, `json` (one array) or `text`."""
    if form not in ("jsonl", "json", "text"):
        raise ValueError(f"unsupported output: {form}")
    found = (r[0] for r in records(rows).toLocalIterator())
    if form == "jsonl":
        yield from found
    elif form == "json":
        yield "[" + ",".join(found) + "]"
    else:
        yield "\t".join(rows.columns)
        for record in found:
            yield "\t".join("" if v is None else str(v) for v in json.loads(record).values())


def project(rows: DataFrame, fields: list[str]) -> DataFrame:
    """The fields asked for; `parent.key` keeps one key of a struct. A field nobody knows is refused, by name."""
    shape: dict[str, list[str] | None] = {}
    unknown = []
    for field in fields:
        name, dot, key = field.partition(".")
        kind = next((f.dataType for f in rows.schema if f.name == name), None)
        if kind is None or dot and not (isinstance(kind, T.StructType) and key in kind.names):
            unknown.append(field)
        elif not dot:
            shape[name] = None
        elif shape.setdefault(name, []) is not None:
            shape[name].append(key)
    if unknown:
        raise ValueError(f"unknown output fields: {', '.join(sorted(unknown))}")
    part = lambda name, keys: F.when(F.col(name).isNotNull(), F.struct(*[F.col(f"{name}.{k}").alias(k) for k in dict.fromkeys(keys)]))
    return rows.select(*[F.col(n) if keys is None else part(n, keys).alias(n) for n, keys in shape.items()])


def guidance(results: DataFrame, tool: str | None, again: Callable[[], DataFrame], index_ready: bool = True) -> str | None:
    """A note beside a search's result (with lexical_match), or None. Only where a tool filter left nothing is the search
    run again without it."""
    if not index_ready:
        return "the keyword index is not ready; keyword results may be incomplete"
    total, lexical = results.agg(F.count("*"), F.count_if("lexical_match")).first()
    if total:
        return None if lexical else "no result holds the words of the query; all were found by meaning"
    if not tool:
        return "no result"
    total, lexical = again().agg(F.count("*"), F.count_if("lexical_match")).first()
    if not total:
        return f"no result with the tool {tool} and none without it"
    return f"no result with the tool {tool}, which leaves out message text; {total} without it, {lexical} of them by keyword"


def follow(messages: DataFrame, session_id: str, emit: Callable[[str], None], checkpoint: str, after_idx: int = -1) -> StreamingQuery:
    """A stream of messages (session_id, idx, ...): each batch's new messages of a session go to emit as JSON in order. A
    batch is one session's news since the last, so it is small; a place that was shown is not shown again."""
    shown = [after_idx]

    def batch(rows: DataFrame, _: int) -> None:
        fresh = rows.filter(F.col("idx") > shown[0]).dropDuplicates(["idx"]).orderBy("idx")
        for (record,) in records(fresh).toLocalIterator():
            shown[0] = max(shown[0], json.loads(record)["idx"])
            emit(json.dumps({"type": "delta", "message": json.loads(record)}))

    mine = messages.filter(F.col("session_id") == session_id)
    return mine.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).start()


def follow_until(query: StreamingQuery, emit: Callable[[str], None], timeout: float = 60, quiet: float | None = None) -> None:
    """Let a follow run for its time, or until nothing came for `quiet` seconds; then `closed` is the last line."""
    began = last = time.monotonic()
    seen = -1
    reason = "timeout"
    while time.monotonic() - began < timeout and query.isActive:
        query.processAllAvailable()
        batch = (query.lastProgress or {}).get("batchId", -1)
        rows = (query.lastProgress or {}).get("numInputRows", 0)
        if batch != seen and rows:
            seen, last = batch, time.monotonic()
        elif quiet is not None and time.monotonic() - last >= quiet:
            reason = "quiet"
            break
        time.sleep(0.1)
    query.stop()
    emit(json.dumps({"type": "closed", "reason": reason}))
