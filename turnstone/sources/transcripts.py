"""Transcripts whose records only make sense in order: one fold a file, over captured records.

A file is the unit of capture and of retry, so a task holds one file's records at a time. Every product's
reader feeds the same Thread, which numbers messages and keeps what belongs to no message apart.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Callable, Iterable
from datetime import UTC, datetime
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import agent_fields, shell_command, stored_input
from ..model import message_id, orphan_call_id, session_id, tool_call_id
from .jsonl import PATTERN, opened, taken_from
from .programs import wrapper_calls

SUMMARY = 1024
CALLS = "array<struct<id:string,name:string,input:string>>"
RESULTS = "array<struct<id:string,summary:string,is_error:boolean>>"
THREAD = (
    f"path string, kind string, idx int, role string, content string, thinking string, at timestamp, calls {CALLS}, "
    f"results {RESULTS}, ends_turn boolean, native_id string, model string, cwd string, git_branch string, "
    "input_tokens long, cached_tokens long, output_tokens long, agent_id string, git_repo string"
)
NAMES = [c.split()[0] for c in THREAD.split(", ")]


def when(value) -> datetime | None:
    """ISO text or epoch milliseconds; None where neither reads."""
    try:
        if isinstance(value, (int, float)) and not isinstance(value, bool):
            return datetime.fromtimestamp(value / 1000, UTC).replace(tzinfo=None)
        read = datetime.fromisoformat(value)
        return read.astimezone(UTC).replace(tzinfo=None) if read.tzinfo else read
    except (TypeError, ValueError, OverflowError, OSError):
        return None


def whole(value) -> int | None:
    return value if isinstance(value, int) and not isinstance(value, bool) else None


def as_dict(value) -> dict:
    return value if isinstance(value, dict) else {}


def summary(content) -> str:
    """A result's text, cut to SUMMARY characters."""
    if isinstance(content, list):
        content = "\n".join(str(as_dict(b).get("text") or "") for b in content if as_dict(b).get("type") == "text")
    return ("" if content is None else content if isinstance(content, str) else json.dumps(content))[:SUMMARY]


def call(id_, name, given) -> dict:
    text = given if isinstance(given, str) else None if given is None else json.dumps(given)
    return {"id": str(id_) if id_ else None, "name": str(name or ""), "input": text}


def answer(id_, content, failed=False) -> dict:
    return {"id": str(id_), "summary": summary(content), "is_error": bool(failed)}


def blocks(content) -> dict:
    """Text, thinking, calls and results of a message's content: a string, a block, or a list of either."""
    out = {"text": [], "thinking": [], "calls": [], "results": []}
    for b in content if isinstance(content, list) else [content]:
        if isinstance(b, str):
            out["text"].append(b)
            continue
        b = as_dict(b)
        kind = b.get("type")
        if kind in ("text", "input_text", "output_text") and isinstance(b.get("text"), str):
            out["text"].append(b["text"])
        elif kind == "thinking":
            out["thinking"].append(str(b.get("thinking") or b.get("text") or ""))
        elif kind in ("tool_use", "toolCall"):
            out["calls"].append(call(b.get("id") or b.get("toolCallId"), b.get("name"), b.get("input", b.get("arguments"))))
        elif kind in ("tool_result", "toolResult"):
            out["results"].append(answer(b.get("tool_use_id") or b.get("toolCallId"), b.get("content"), b.get("is_error")))
    return out


class Thread:
    """What one file has told so far."""

    def __init__(self, path: str):
        self.path, self.said, self.loose = path, [], []
        self.about: dict = {}
        self.used: dict[str, int | None] = {"input_tokens": None, "cached_tokens": None, "output_tokens": None}

    def say(self, role, text, thinking=(), at=None, calls=(), results=(), ends=None, agent=None) -> dict:
        join = lambda parts: ("\n".join(parts) if isinstance(parts, (list, tuple)) else parts) or None
        row = {"kind": "message", "role": role, "content": join(text), "thinking": join(thinking), "at": at}
        self.said.append(row | {"calls": list(calls), "results": list(results), "ends_turn": ends, "agent_id": agent})
        return self.said[-1]

    def stray(self, at=None, calls=(), results=(), ends=None) -> None:
        """Calls, results or a turn's end outside any message; idx is then the last message's."""
        self.loose.append(
            {"kind": "stray", "idx": len(self.said) - 1, "at": at, "calls": list(calls), "results": list(results), "ends_turn": ends}
        )

    def know(self, **facts) -> None:
        self.about.update({k: v for k, v in facts.items() if v})

    def learn(self, **facts) -> None:
        """As know, but the first that is told counts."""
        self.about.update({k: v for k, v in facts.items() if v and k not in self.about})

    def spend(self, merge: Callable[[int, int], int], **tokens) -> None:
        """An unknown count stays unknown; it is no zero."""
        for k, n in tokens.items():
            if n is not None:
                self.used[k] = n if self.used[k] is None else merge(self.used[k], n)

    def rows(self) -> Iterable[dict]:
        yield {"path": self.path, "kind": "session"} | self.about | self.used
        for i, row in enumerate(self.said):
            yield {"path": self.path} | row | {"idx": i}
        for row in self.loose:
            yield {"path": self.path} | row


class Mirror:
    """Two streams tell the same messages: each copy meets one of the other stream, and only the first to come counts."""

    def __init__(self, one: str, other: str, always: bool = True):
        self.facing = {one: other, other: one}
        self.open, self.always, self.waiting = always, always, Counter()

    def first(self, stream: str, identity) -> bool:
        if not self.open:
            return True
        if self.waiting[self.facing[stream], identity]:
            self.waiting[self.facing[stream], identity] -= 1
            return False
        self.waiting[stream, identity] += 1
        return True

    def close(self) -> None:
        self.open = self.always
        self.waiting.clear()


# How a turn ends, and who may speak.
CLAUDE_ENDS = ("end_turn", "stop_sequence")
ROLES = ("user", "assistant", "system")


def _paid(thread: Thread, use: dict, old: dict) -> None:
    """Cached input is counted beside fresh input: together they are what was billed."""
    for key in ("input_tokens", "cache_creation_input_tokens", "cache_read_input_tokens"):
        n = whole(use.get(key))
        thread.spend(int.__add__, input_tokens=whole(old.get("inputTokens")) if n is None and key == "input_tokens" else n)
    n = whole(use.get("output_tokens"))
    thread.spend(int.__add__, output_tokens=whole(old.get("outputTokens")) if n is None else n, cached_tokens=whole(use.get("cache_read_input_tokens")))


def read_claude(thread: Thread, records: Iterable[dict]) -> None:
    """Messages of the main thread, and those of subagents, which progress records carry. A progress record's own message
    is none; its tokens are billed besides."""
    for r in records:
        m, at = as_dict(r.get("message")), when(r.get("timestamp") or r.get("created_at"))
        thread.learn(
            model=m.get("model") or r.get("model") or r.get("model_name"), cwd=r.get("cwd") or r.get("working_directory"),
            git_repo=r.get("git_root") or r.get("repo"), native_id=r.get("sessionId"),
            git_branch=r.get("gitBranch") or as_dict(r.get("git")).get("branch") or r.get("git_branch"),
        )
        data = as_dict(r.get("data"))
        agent = None
        if r.get("type") == "progress":
            m = as_dict(as_dict(data.get("message")).get("message")) if data.get("type") == "agent_progress" else {}
            agent = data.get("agentId")
            _paid(thread, as_dict(m.get("usage")), {})
        else:
            _paid(thread, as_dict(m.get("usage")), r)
            m = m or (r if "role" in r else {})
        role = m.get("role", m.get("sender", "user"))
        if not m or role not in ROLES:
            continue
        b, reason = blocks(m.get("content")), m.get("stop_reason")
        thread.say(role, b["text"], b["thinking"], at, b["calls"], b["results"], reason in CLAUDE_ENDS if reason else None, agent)
    # no record names the repository any more; the folder is the best guess
    thread.learn(git_repo=thread.about.get("cwd"))


def compaction(payload: dict) -> str | None:
    """A readable summary of what was left out, where there is one."""
    for key in ("summary", "content", "message"):
        if text := "\n".join(blocks(payload.get(key))["text"]):
            return text
    return None


def read_codex(thread: Thread, records: Iterable[dict]) -> None:
    """Events and response items mirror each other; calls stand outside messages; token totals are running ones."""
    mirror = Mirror("event", "item")
    for r in records:
        p, at = as_dict(r.get("payload")), when(r.get("timestamp"))
        kind, sub = r.get("type"), as_dict(r.get("payload")).get("type")
        if kind == "session_meta":
            if p.get("id") in (None, thread.about.get("native_id", p.get("id"))):  # a fork embeds its parent's
                thread.know(native_id=p.get("id"), cwd=p.get("cwd"), git_branch=as_dict(p.get("git")).get("branch"))
        elif kind == "turn_context":
            thread.know(model=p.get("model"), cwd=p.get("cwd"))
        elif kind == "token_usage_record" or sub == "token_count":
            total = as_dict(p.get("thread_token_usage") or as_dict(p.get("info")).get("total_token_usage"))
            thread.spend(
                max,
                input_tokens=whole(total.get("input_tokens")),
                cached_tokens=whole(total.get("cached_input_tokens")),
                output_tokens=whole(total.get("output_tokens")),
            )
        elif kind == "event_msg" and sub in ("user_message", "agent_message"):
            role, text = "user" if sub == "user_message" else "assistant", str(p.get("message") or "")
            if mirror.first("event", (role, text)):
                thread.say(role, text, at=at)
        elif kind == "event_msg" and sub in ("task_started", "task_complete", "turn_aborted"):
            thread.stray(at, ends=sub != "task_started")
        elif kind == "message" or kind == "response_item" and sub == "message":
            b = blocks(p.get("content"))
            role, text = p.get("role") or "system", "\n".join(b["text"])
            if kind == "message" or mirror.first("item", (role, text)):
                thread.say(role, text, b["thinking"], at, b["calls"], b["results"])
        elif sub in ("compaction", "compaction_summary"):
            if text := compaction(p):
                thread.say("system", text, at=at)
        elif kind == "compacted":
            # a snapshot of the history that stays: only what was not told yet is new
            told = Counter((x["role"], x["content"]) for x in thread.said)
            if text := compaction(p):
                thread.say("system", text, at=at)
            for item in p.get("replacement_history") or []:
                b, role = blocks(as_dict(item).get("content")), as_dict(item).get("role")
                text = "\n".join(b["text"])
                if as_dict(item).get("type") == "message" and role in ROLES and text:
                    if told[role, text]:
                        told[role, text] -= 1
                    else:
                        thread.say(role, text, b["thinking"], at, b["calls"], b["results"])
        elif sub == "custom_tool_call" and p.get("name") == "exec" and isinstance(p.get("input"), str):
            # one program stands for many calls, so none of them owns its id
            thread.stray(at, [call(None, name, given) for name, given in wrapper_calls(p["input"])])
        elif sub == "tool_search_call":
            thread.stray(at, [call(p.get("call_id"), "tool_search", p.get("arguments"))])
        elif sub == "tool_search_output" and p.get("call_id"):
            thread.stray(at, results=[answer(p["call_id"], json.dumps({"tools": p.get("tools", [])}))])
        elif sub in ("function_call", "custom_tool_call"):
            thread.stray(at, [call(p.get("call_id"), p.get("name"), p.get("parameters", p.get("arguments", p.get("input"))))])
        elif sub == "web_search_call":
            thread.stray(at, [call(p.get("call_id") or p.get("id"), "web_search", p.get("action"))])
        elif isinstance(sub, str) and sub.endswith("_output") and p.get("call_id"):
            out = as_dict(p.get("output"))
            text = out["content"] if isinstance(out.get("content"), str) else p.get("output")
            thread.stray(at, results=[answer(p["call_id"], text, out.get("success") is False)])


# How a turn ends.
PI_ENDS = ("stop", "aborted", "error")


def read_pi(thread: Thread, records: Iterable[dict]) -> None:
    """Billable input is fresh, read and written cache; a shell run is a message with its own call and result."""
    for r in records:
        kind, at, m = r.get("type"), when(r.get("timestamp")), as_dict(r.get("message"))
        if kind == "session":
            thread.know(native_id=r.get("id"), cwd=r.get("cwd"))
        elif kind == "model_change":
            thread.know(model=r.get("modelId"))
        elif kind in ("custom_message", "compaction"):
            text = r.get("summary") if kind == "compaction" else blocks(r.get("content"))["text"]
            if text:
                thread.say("system", text, at=at)
        elif kind == "message" and m.get("role") == "bashExecution":
            bad = bool(m.get("cancelled")) or m.get("exitCode") not in (None, 0)
            thread.say(
                "system", str(m.get("output") or ""), at=at, calls=[call(r.get("id"), "bash", {"command": m.get("command")})],
                results=[answer(r.get("id"), m.get("output"), bad)] if r.get("id") else [],
            )
        elif kind == "message":
            b, role = blocks(m.get("content")), m.get("role")
            if m.get("toolCallId"):
                b["results"].append(answer(m["toolCallId"], m.get("content"), m.get("isError")))
            ends = m.get("stopReason") in PI_ENDS if role == "assistant" and m.get("stopReason") else None
            role = role if role in ("user", "assistant") else "system"
            thread.say(role, b["text"], b["thinking"], at, b["calls"], b["results"], ends)
            use = as_dict(m.get("usage"))
            paid = [n for n in (whole(use.get(k)) for k in ("input", "cacheRead", "cacheWrite")) if n is not None]
            thread.spend(
                int.__add__, input_tokens=sum(paid) if paid else None, cached_tokens=whole(use.get("cacheRead")),
                output_tokens=whole(use.get("output")),
            )


def read_grok(thread: Thread, records: Iterable[dict]) -> None:
    """Reasoning waits for the next assistant message; backend calls join the last message if it is the assistant's,
    else the next. What still waits at another speaker or at the end becomes a message of its own."""
    parts = thread.path.rstrip("/").split("/")
    if len(parts) > 2:
        thread.know(native_id=parts[-2], cwd=unquote(parts[-3]))
    thoughts, calls = [], []

    def flush() -> None:
        if thoughts or calls:
            thread.say("assistant", None, list(thoughts), calls=list(calls))
            thoughts.clear(), calls.clear()

    for r in records:
        kind = r.get("type")
        if kind in ("system", "user"):
            flush()
            if text := blocks(r.get("content"))["text"]:
                thread.say(kind, text)
        elif kind == "assistant":
            own = as_dict(r.get("reasoning")).get("text")
            thoughts.extend([own] if own else [])
            made = [call(as_dict(c).get("id"), as_dict(c).get("name"), as_dict(c).get("arguments")) for c in r.get("tool_calls") or []]
            if "model" not in thread.about:
                thread.know(model=r.get("model_id"))
            thread.say("assistant", blocks(r.get("content"))["text"], list(thoughts), calls=calls + made)
            thoughts.clear()
            calls = []
        elif kind == "tool_result":
            flush()
            text, id_ = str(r.get("content") or ""), r.get("tool_call_id")
            if text or id_:
                label = [f"[tool_call_id: {id_}]"] if id_ else []
                thread.say("system", label + ([text] if text else []), results=[answer(id_, text, r.get("is_error"))] if id_ else [])
        elif kind == "reasoning":
            thoughts.extend(blocks(r.get("summary"))["text"] or [str(as_dict(s).get("text")) for s in r.get("summary") or [] if as_dict(s).get("text")])
        elif kind == "backend_tool_call":
            made = call(r.get("id") or r.get("tool_call_id"), r.get("name"), r.get("arguments", r.get("input")))
            (thread.said[-1]["calls"] if thread.said and thread.said[-1]["role"] == "assistant" else calls).append(made)
    flush()
    for row in thread.said:
        if row["role"] == "assistant" and (row["calls"] or row["content"]):
            row["ends_turn"] = not row["calls"]


def read_kimi(thread: Thread, records: Iterable[dict]) -> None:
    """A step's parts gather until the step ends; within an open turn the agent's stream mirrors the wire's."""
    mirror, step = Mirror("wire", "agent", always=False), None

    def end_step(at, reason) -> None:
        if step and any(step.values()):
            if mirror.first("wire", ("assistant", "\n".join(step["text"]))):
                ends = None if reason is None else reason != "tool_use"
                thread.say("assistant", step["text"], step["thinking"], at, step["calls"], step["results"], ends)

    for r in records:
        kind, at, e = r.get("type"), when(r.get("time")), as_dict(r.get("event"))
        if kind == "metadata":
            thread.know(native_id=r.get("session_id"))
        elif kind in ("profile.bind", "llm.request"):
            thread.know(model=r.get("modelAlias"))
        elif kind == "agent.turn.started":
            mirror.open = True
        elif kind == "agent.turn.ended":
            mirror.close()
        elif kind in ("context.append_message", "agent.message.appended"):
            m, agent = as_dict(r.get("message")), kind == "agent.message.appended"
            m = as_dict(m.get("message")) if agent else m
            mirror.open = mirror.open or agent
            b, role = blocks(m.get("content")), m.get("role")
            role = role if role in ("user", "assistant") else "system"
            if mirror.first("agent" if agent else "wire", (role, "\n".join(b["text"]))):
                thread.say(role, b["text"], b["thinking"], at, b["calls"], b["results"])
        elif kind == "usage.record":
            use = as_dict(r.get("usage"))
            paid = [n for n in (whole(use.get(k)) for k in ("inputOther", "inputCacheRead", "inputCacheCreation")) if n is not None]
            thread.spend(
                int.__add__, input_tokens=sum(paid) if paid else None, cached_tokens=whole(use.get("inputCacheRead")),
                output_tokens=whole(use.get("output")),
            )
        elif kind == "context.append_loop_event":
            what, part = e.get("type"), as_dict(e.get("part"))
            if what == "step.begin":
                end_step(at, None)
                step = {"text": [], "thinking": [], "calls": [], "results": []}
            elif what == "step.end":
                end_step(at, e.get("finishReason"))
                step = None
            elif what == "tool.result" and step is None:
                thread.stray(at, results=[answer(e.get("toolCallId"), as_dict(e.get("result")).get("output"))])
            elif step is not None:
                if what == "content.part" and part.get("type") in ("text", "think"):
                    step["text" if part["type"] == "text" else "thinking"].append(str(part.get(part["type"]) or ""))
                elif what == "tool.call":
                    step["calls"].append(call(e.get("toolCallId"), e.get("name"), e.get("args")))
                elif what == "tool.result":
                    result = as_dict(e.get("result"))
                    step["results"].append(answer(e.get("toolCallId"), result.get("output"), result.get("isError")))
    end_step(None, None)


READERS = {"claude": read_claude, "codex": read_codex, "pi": read_pi, "grok": read_grok, "kimi": read_kimi}


def _folded(path: str, product: str, records: Iterable[dict]) -> pd.DataFrame:
    thread = Thread(path)
    READERS[product](thread, records)
    out = pd.DataFrame([{n: row.get(n) for n in NAMES} for row in thread.rows()], columns=NAMES)
    numbers = {c: "Int64" for c in ("input_tokens", "cached_tokens", "output_tokens")} | {"idx": "Int32"}
    return out.astype(numbers | {"at": "datetime64[us]", "ends_turn": "boolean"})


def read_files(spark: SparkSession, path: str, product: str, glob: str = PATTERN) -> DataFrame:
    """Transcripts of a folder -> THREAD rows: a session row a file, its messages, and strays. A file's records are
    folded by the task that reads it, so nothing is shuffled."""

    def read(frames):
        for frame in frames:
            for name, content in zip(frame["path"], frame["content"], strict=True):
                taken, _, _ = taken_from(name, bytes(content))
                yield _folded(name, product, (json.loads(x[2]) for x in taken))

    return opened(spark, path, glob).mapInPandas(read, THREAD)


def read_threads(records: DataFrame, product: str) -> DataFrame:
    """As read_files, from a stored table of captured records (path, line, record), which is grouped by file."""

    def fold(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        return _folded(key[0], product, (json.loads(x) for x in frame.sort_values("line")["record"] if x is not None))

    return records.select("path", "line", "record").groupBy("path").applyInPandas(fold, THREAD)


def thread_sessions(threads: DataFrame, source: str) -> DataFrame:
    """Session rows of THREAD with what their messages tell: times, whole seconds, counts."""
    said = threads.filter("kind <> 'session'")
    counts = said.groupBy("path").agg(
        F.min("at").alias("started_at"), F.max("at").alias("ended_at"), F.count_if(F.col("kind") == "message").alias("message_count"),
        F.sum(F.size("calls")).alias("tool_count"),
    )
    facts = ["native_id", "model", "cwd", "git_repo", "git_branch", "input_tokens", "cached_tokens", "output_tokens"]
    rows = threads.filter("kind = 'session'").select("path", *facts).join(counts, "path", "left")
    span = F.col("ended_at").cast("double") - F.col("started_at").cast("double")
    return rows.select(
        session_id(F.lit(source), F.col("path")).alias("id"), F.lit(source).alias("source"), "path", *facts, "started_at", "ended_at",
        F.floor(span).cast("long").alias("duration_seconds"), F.coalesce("message_count", F.lit(0)).alias("message_count"),
        F.coalesce("tool_count", F.lit(0)).cast("long").alias("tool_count"),
    )


def thread_calls(threads: DataFrame, source: str) -> DataFrame:
    """Tool calls of THREAD rows with their message, or with none: id, session_id, message_id, idx, tool_name, tool_input,
    bash_command, tool_use_id, agent_id and what agents and skills are told. A call of no message is numbered in its session."""
    rows = threads.filter("kind <> 'session'").select(
        session_id(F.lit(source), F.col("path")).alias("session_id"), "kind", F.col("idx").alias("message_idx"), "agent_id", "at",
        F.posexplode("calls").alias("place", "c"),
    )
    loose = Window.partitionBy("session_id", "kind").orderBy("message_idx", "at", "place")
    message = F.when(F.col("kind") == "message", message_id(F.col("session_id"), F.col("message_idx")))
    idx = F.when(F.col("kind") == "message", F.col("place")).otherwise(F.row_number().over(loose) - 1)
    numbered = rows.withColumn("message_id", message).withColumn("idx", idx)
    id_ = F.when(F.col("message_id").isNotNull(), tool_call_id(F.col("message_id"), F.col("idx"))).otherwise(
        orphan_call_id(F.col("session_id"), F.col("idx"))
    )
    name, given = F.col("c.name"), F.col("c.input")
    command = shell_command(name, given)
    return numbered.select(
        id_.alias("id"), "session_id", "message_id", "idx", name.alias("tool_name"), stored_input(given, command).alias("tool_input"),
        command.alias("bash_command"), F.col("c.id").alias("tool_use_id"), "agent_id", *agent_fields(name, given),
    )


def with_sidecars(sessions: DataFrame, sidecars: DataFrame) -> DataFrame:
    """sidecars (path, content) of summary files beside the transcripts override what the path told."""
    folder = lambda c: F.regexp_extract(c, r"^(.*)/[^/]+$", 1)
    at = lambda p: F.nullif(F.get_json_object(F.col("content").cast("string"), p), F.lit(""))
    side = sidecars.select(
        folder("path").alias("folder"), at("$.info.cwd").alias("s_cwd"), at("$.current_model_id").alias("s_model"),
        at("$.head_branch").alias("s_branch"),
    )
    names = {"cwd": "s_cwd", "model": "s_model", "git_branch": "s_branch"}
    both = sessions.withColumn("folder", folder("path")).join(side, "folder", "left")
    return both.withColumns({k: F.coalesce(v, k) for k, v in names.items()}).drop("folder", *names.values())
