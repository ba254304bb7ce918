import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from turnstone.functions import scalars
from turnstone.operators import search
from turnstone.sources import discovery, jsonl, programs
from turnstone.streaming import ledger


def test_capture_stops_at_a_bad_line_and_leaves_the_tail():
    data = b'{"a": 1}\n\n{"b": 2}\n[1]\n{"c": 3}\n'
    taken, at, _ = jsonl.captured_lines(data)
    assert [x[2] for x in taken] == ['{"a": 1}', '{"b": 2}'] and data[at:].startswith(b"[1]")
    assert [len(jsonl.captured_lines(x)[0]) for x in (b"", b'{"a": 1}', b'{"a": 1}\n{"b"')] == [0, 0, 1]


def test_claude_transcript(spark, tmp_path):
    use = {"input_tokens": 3, "cache_read_input_tokens": 4, "output_tokens": 2}
    records = [
        {"type": "mode", "sessionId": "s"},
        {"type": "user", "timestamp": "2025-01-01T00:00:00Z", "message": {"role": "user", "content": "hello"}},
        {"type": "assistant", "message": {"role": "assistant", "model": "m", "stop_reason": "end_turn", "usage": use, "content": [
            {"type": "thinking", "thinking": "hm"}, {"type": "text", "text": "a"}, {"type": "text", "text": "b"},
            {"type": "tool_use", "id": "t1", "name": "Bash", "input": {"command": "git status"}}]}},
    ]
    (tmp_path / "s.jsonl").write_text("".join(json.dumps(r) + "\n" for r in records) + '{"type": "us')
    messages = jsonl.claude_messages(jsonl.capture(spark, str(tmp_path)))
    a, b = messages.orderBy("idx").collect()
    assert (a["role"], a["content"], a["input_tokens"]) == ("user", "hello", None)
    assert (b["content"], b["thinking"], b["input_tokens"], b["output_tokens"], b["ends_turn"]) == ("a\nb", "hm", 7, 2, True)
    call = jsonl.claude_calls(messages).first()
    assert (call["message_idx"], call["tool_use_id"], call["bash_command"]) == (1, "t1", "git status")


def usage(sid, loop, msg=jsonl.USAGE_MESSAGE):
    ctx = {"loop_index": loop, "prompt_tokens": 10, "completion_tokens": True if loop == 2 else 5}
    return json.dumps({"ts": "2025-01-01T00:00:00Z", "sid": sid, "msg": msg, "ctx": ctx}) + "\n"


def test_ledger_counts_each_event_once_across_runs(spark, tmp_path):
    logs, table, point = (str(tmp_path / x) for x in ("logs", "table", "point"))
    (tmp_path / "logs").mkdir()
    (tmp_path / "logs/a.log").write_text(usage("x", 1) + usage("x", 1) + usage("x", 2) + usage("y", 1, "other") + usage("", 1))
    ledger.harvest(spark, logs, table, point).awaitTermination()
    (tmp_path / "logs/b.log").write_text(usage("x", 1) + usage("y", 1))
    ledger.harvest(spark, logs, table, point).awaitTermination()
    got = {r["source_session_id"]: r for r in ledger.rollup(spark.read.parquet(table)).collect()}
    assert (got["x"]["prompt_tokens"], got["x"]["completion_tokens"], got["x"]["events"]) == (20, 5, 2)
    assert got["y"]["events"] == 1


@pytest.mark.parametrize(
    "command, want",
    [("git status", ("git", "status", False)), ("  ", (None, None, None)), ('"my tool" x | y', ("my tool", None, True)),
     ("ls 'a", ("ls", None, False)), ("npm run a && b", ("npm", "run", True)), ("ls\npwd", ("ls", None, True))],
)
def test_shell_split(spark, command, want):
    row = spark.createDataFrame([(command,)], "c string").select(scalars.shell_parts("c").alias("p")).first()["p"]
    assert tuple(row) == want


def test_files_without_a_complete_line_are_told(spark, tmp_path):
    import zstandard

    (tmp_path / "a.jsonl").write_text('{"a": 1}')
    (tmp_path / "b.jsonl.zst").write_bytes(zstandard.compress(b'{"b": 1}\n{"b": 2}\n'))
    (tmp_path / "c.jsonl.zst").write_bytes(b"no such file")
    (tmp_path / "d.txt").write_text("no transcript")
    got = jsonl.capture(spark, str(tmp_path))
    files = {r["path"].rsplit("/", 1)[1]: (r["committed"], r["digest"] is not None) for r in jsonl.captured_files(got).collect()}
    assert files == {"a.jsonl": (0, True), "b.jsonl.zst": (18, True), "c.jsonl.zst": (None, False)}
    assert sorted(r["record"] for r in got.filter("line >= 0").collect()) == ['{"b": 1}', '{"b": 2}']
    assert jsonl.inflated(zstandard.compress(b"x" * 100), 99) is None and jsonl.inflated(zstandard.compress(b"x" * 100), 100) == b"x" * 100


def test_discovery(spark, tmp_path):
    for name in ("p/one.jsonl", "p/one.jsonl.zst", "p/q/two.jsonl.zst", "p/q/three.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("x")
    found = discovery.discover(spark, [("a", str(tmp_path)), ("a", str(tmp_path / "p" / "q")), ("b", str(tmp_path / "p"))])
    rows = {(r["source"], r["path"].removeprefix(str(tmp_path))): r["root"].removeprefix(str(tmp_path)) for r in found.collect()}
    assert rows == {("a", "/p/one.jsonl"): "", ("a", "/p/q/two.jsonl.zst"): "/p/q", ("b", "/p/one.jsonl"): "/p", ("b", "/p/q/two.jsonl.zst"): "/p"}
    assert "content" not in found.columns and discovery.newest_first(found).count() == 4
    sessions = spark.createDataFrame([("a", f"{tmp_path}/p/one.jsonl", "My-Repo")], "source string, path string, git_repo string")
    assert [r["path"] for r in discovery.in_scope(found, project="my-r", sessions=sessions).collect()] == [f"{tmp_path}/p/one.jsonl"]
    assert discovery.in_scope(found, since=datetime(2100, 1, 1)).count() == 0
    with pytest.raises(ValueError):
        discovery.in_scope(found, project="x")


@pytest.mark.parametrize(
    "program, want",
    [
        ("tools.run({a: 'x\\u0041\\n', \"b\": [1, -2.5, null, true,],})", [("run", {"a": "xA\n", "b": [1, -2.5, None, True]})]),
        ("const s = `two\nlines`; // tools.no({})\n/* tools.no({}) */ 'tools.no({})'; await tools.run({s, t: s})", [("run", {"s": "two\nlines", "t": "two\nlines"})]),
        ("const s = 'a' + b; tools.run({s, k: 1})", [("run", {"k": 1})]),
        ("tools.run({cmd: `${x}`}); tools.go(args)", [("run", None), ("go", None)]),
        ("tools.run({a: f({b: 1}, [2]), ...rest, c: {d: 'e'}})", [("run", {"c": {"d": "e"}})]),
        ("my.tools.run({a: 1}); tools.run", []),
        ("tools.run({a: 1", [("run", None)]),
        ("", []),
    ],
)
def test_calls_inside_programs(program, want):
    assert programs.inner_calls(program) == want


def test_programs_without_calls_are_kept():
    assert programs.wrapper_calls("x()") == [("exec", {"source": "x()"})]


def test_aliases_and_budgets():
    assert scalars.alias("mode", " RRF ") == "hybrid" and scalars.alias("source", "Pi-Agent") == "pi_agent"
    for bad in (lambda: scalars.alias("mode", "other"), lambda: scalars.truncated(F.lit("x"), 0)):
        with pytest.raises(ValueError):
            bad()


def test_fused_order(spark):
    leg = lambda rows: spark.createDataFrame(rows, "id long, score double")
    got = search.fuse(leg([(1, 3.0), (2, 2.0)]), leg([(2, 0.9), (3, 0.8)]), "id").collect()
    assert [(r["id"], r["lexical_match"]) for r in got] == [(2, True), (1, True), (3, False)]
