"""Streams of calls, results and changes, in whatever order their files come."""

import json

from pyspark.sql import functions as F
from turnstone.operators import ingest
from turnstone.streaming import pairing


def put(folder, name, rows):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("".join(json.dumps(r) + "\n" for r in rows))


def test_results_meet_their_calls_in_either_order(spark, tmp_path):
    calls, results, out = tmp_path / "calls", tmp_path / "results", []
    at = lambda day, hour: f"2031-01-{day:02d}T{hour:02d}:00:00"
    call = lambda use, day, hour: {"session_id": "s", "tool_use_id": use, "name": f"n{use}", "at": at(day, hour)}
    result = lambda use, day, hour, s: {"session_id": "s", "tool_use_id": use, "summary": s, "at": at(day, hour)}
    put(calls, "1.json", [call("late", 1, 1), call("never", 1, 2)])
    put(results, "1.json", [result("early", 1, 3, "e"), result("early", 1, 3, "e")])
    read = lambda folder, shape: spark.readStream.schema(shape).json(str(folder))
    pairs = pairing.paired(
        read(calls, "session_id string, tool_use_id string, name string, at timestamp"),
        read(results, "session_id string, tool_use_id string, summary string, at timestamp"),
    )
    query = pairs.writeStream.foreachBatch(lambda df, _: out.extend(df.collect())).option("checkpointLocation", str(tmp_path / "p")).start()
    query.processAllAvailable()
    put(calls, "2.json", [call("early", 1, 4)])
    put(results, "2.json", [result("late", 1, 9, "l")])
    query.processAllAvailable()
    # time goes on, so the call without a result is told without one
    put(calls, "3.json", [call("x", 9, 1)])
    put(results, "3.json", [result("x", 9, 1, "y")])
    query.processAllAvailable()
    put(calls, "4.json", [call("z", 9, 2)])
    put(results, "4.json", [result("z", 9, 2, "y")])
    query.processAllAvailable()
    query.stop()
    got = sorted((r["tool_use_id"], r["summary"]) for r in out if r["tool_use_id"] not in ("x", "z"))
    assert got == [("early", "e"), ("late", "l"), ("never", None)]


def test_changes_are_told_when_a_path_is_still(spark, tmp_path):
    folder, out = tmp_path / "in", []
    row = lambda path, second: {"path": path, "at": f"2031-01-01T00:00:{second:02d}"}
    put(folder, "1.json", [row("a", 1), row("a", 3), row("b", 2)])
    stream = spark.readStream.schema("path string, at timestamp").json(str(folder))
    quiet = ingest.debounced(stream, "5 seconds", "1 second")
    query = quiet.writeStream.outputMode("append").foreachBatch(lambda df, _: out.extend(df.collect())).option("checkpointLocation", str(tmp_path / "p")).start()
    query.processAllAvailable()
    assert not out
    put(folder, "2.json", [row("a", 6), row("c", 40)])
    query.processAllAvailable()
    query.stop()
    assert sorted((r["path"], r["n"], r["first"].second, r["last"].second) for r in out) == [("a", 3, 1, 6), ("b", 1, 2, 2)]


def test_batch_and_stream_agree_on_gaps(spark):
    rows = spark.createDataFrame([("a", 0), ("a", 4), ("a", 9), ("a", 20)], "path string, s int").select("path", F.timestamp_seconds("s").alias("at"))
    assert sorted(r["n"] for r in ingest.debounced(rows, "5 seconds").collect()) == [1, 3]
    assert sorted(r["n"] for r in ingest.debounced(rows, "4 seconds").collect()) == [1, 1, 2]
