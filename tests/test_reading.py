"""Cursors, reads, output, follow streams, skills, contexts and roster rules on small rows."""

import base64
import json

import numpy as np
import pytest
from pyspark.sql import functions as F
from turnstone.functions import skills
from turnstone.operators import enrich, ingest, output, relational
from turnstone.operators import sessions as reading


def test_cursors():
    assert reading.decode_cursor(reading.encode_cursor("a:b", 7, 3)) == ("a:b", 7, 3)
    assert reading.decode_cursor(reading.encode_cursor("s", -1)) == ("s", -1, 0)
    old = base64.urlsafe_b64encode(b"v1:s:4").decode().rstrip("=")
    assert reading.decode_cursor(old) == ("s", 4, None)
    assert reading.decode_page(reading.encode_page(12)) == 12 and reading.decode_page(None) == 0
    wrong = [base64.urlsafe_b64encode(x).decode() for x in (b"v3:0:s:1", b"v2:x:s:1", b"v2:0:s:x", b"v2:0::1", b"v2:-1:s:1", b"\xff\xfe", b"live-v1:-1")]
    for cursor in [*wrong, "?"]:
        with pytest.raises(ValueError):
            reading.decode_cursor(cursor)
        with pytest.raises(ValueError):
            reading.decode_page(cursor)


def test_what_a_read_may_not_ask():
    after = reading.encode_cursor("s", 3)
    assert reading.check_read("s", after=after, tail=4).last_idx == 3 and reading.check_read("s", message_limit=3) is None
    for ask in ({"message_limit": 3, "tail": 2}, {"message_limit": 3, "after": after}, {"tail": 0}):
        with pytest.raises(ValueError):
            reading.check_read("s", **ask)
    with pytest.raises(ValueError):
        reading.check_read("t", after=after)


def test_a_replaced_session_resets_its_cursor(spark):
    messages = spark.createDataFrame([(f"m{i}", "s", i) for i in range(150)], "id string, session_id string, idx int")
    calls = spark.createDataFrame([("c", "s", "m149", 0), ("o", "s", None, 0)], "id string, session_id string, message_id string, idx int")
    after = reading.encode_cursor("s", 147, 2)
    rows, reset = reading.read_behind(messages, calls, "s", after, 2, tools=True)
    assert [r["idx"] for r in rows.collect()] == [148, 149] and not reset
    assert [len(r["tool_calls"] or []) for r in rows.collect()] == [0, 1]
    rows, reset = reading.read_behind(messages, calls, "s", after, 3)
    assert rows.count() == 100 and reset
    rows, reset = reading.read_behind(messages, calls, "s", after, 3, tail=5)
    assert [r["idx"] for r in rows.collect()] == [145, 146, 147, 148, 149]


def test_pages_are_bounded(spark):
    rows = spark.range(5).withColumn("last_activity", F.col("id"))
    assert [r["id"] for r in reading.live_page(rows, 2, reading.encode_page(1)).collect()] == [3, 2]
    for limit in (0, 257):
        with pytest.raises(ValueError):
            reading.live_page(rows, limit)


def test_output_forms(spark, tmp_path):
    rows = spark.sql("SELECT 1 AS id, timestamp_ntz'2031-02-03 04:05:06' AS at, CAST(NULL AS STRING) AS gone, named_struct('k', 'v', 'x', 2) AS s")
    one = {"id": 1, "at": "2031-02-03T04:05:06.000000", "gone": None, "s": {"k": "v", "x": 2}}
    assert [json.loads(x) for x in output.lines(rows)] == [one] and json.loads("".join(output.lines(rows, "json"))) == [one]
    assert list(output.lines(rows.drop("s"), "text")) == ["id\tat\tgone", "1\t2031-02-03T04:05:06.000000\t"]
    output.write_records(rows, str(tmp_path / "j"))
    assert json.loads(spark.read.text(str(tmp_path / "j")).first()[0]) == one
    output.write_records(rows.drop("s"), str(tmp_path / "t"), "text")
    assert spark.read.text(str(tmp_path / "t")).count() == 2
    got = output.project(rows, ["s.k", "id", "s.k"])
    assert got.columns == ["s", "id"] and got.first()["s"].asDict() == {"k": "v"}
    assert output.project(rows, ["s", "s.k"]).first()["s"].asDict() == {"k": "v", "x": 2}
    with pytest.raises(ValueError, match="s.no, what"):
        output.project(rows, ["what", "id", "s.no"])


def test_guidance(spark):
    rows = spark.createDataFrame([(True,), (False,)], "lexical_match boolean")
    none, again = rows.filter("false"), lambda: rows
    assert output.guidance(rows, "Bash", again) is None
    assert "by meaning" in output.guidance(rows.filter("not lexical_match"), None, again)
    assert "2 without it, 1 of them" in output.guidance(none, "Bash", again)
    assert "none without it" in output.guidance(none, "Bash", lambda: none) and output.guidance(none, None, again) == "no result"
    assert "not ready" in output.guidance(rows, None, again, index_ready=False)


def test_follow_tells_new_messages_once_and_closes(spark, tmp_path):
    shape, told = "session_id string, idx int, content string", []
    folder = tmp_path / "m"
    folder.mkdir()
    put = lambda name, rows: (folder / name).write_text("".join(json.dumps(dict(zip(("session_id", "idx", "content"), r, strict=True))) + "\n" for r in rows))
    put("a.json", [("s", 0, "old"), ("s", 2, "b"), ("s", 1, "a"), ("t", 5, "other")])
    stream = spark.readStream.schema(shape).json(str(folder))
    query = output.follow(stream, "s", told.append, str(tmp_path / "point"), after_idx=0)
    query.processAllAvailable()
    put("b.json", [("s", 2, "b"), ("s", 3, "c")])
    output.follow_until(query, told.append, timeout=20, quiet=2)
    rows = [json.loads(x) for x in told]
    assert [r["message"]["idx"] for r in rows[:-1]] == [1, 2, 3] and rows[-1] == {"type": "closed", "reason": "quiet"}
    assert not query.isActive


@pytest.mark.parametrize(
    "command, want",
    [
        ("a b; c 'd ; e' | f", [["a", "b"], ["c", "d ; e"], ["f"]]),
        ('x "q\\"r" \\; y', [["x", 'q"r', ";", "y"]]),
        ("a \\\nb # c\nd", [["a", "b"], ["d"]]),
        ("cat <<-E x\n\tbody; rm\n\tE\nnext", [["cat"], ["-E", "x"], ["next"]]),
        ("ok\nbad 'open", [["ok"]]),
        ("'two\nlines' z", [["two\nlines", "z"]]),
        ("a#b c", [["a#b", "c"]]),
        ("", []),
    ],
)
def test_shell_segments(command, want):
    assert skills.segments(command) == want


def test_braces_and_candidates():
    assert skills.expanded("a{1,2}b{x,y}") == ["a1bx", "a1by", "a2bx", "a2by"]
    assert skills.expanded("{a,b}" * 7) == ["{a,b}" * 7]
    assert not skills.is_candidate("Task", json.dumps([["x"] * 300, "SKILL.md"][::-1][1:]), None)
    assert skills.skill_names("Read", "not json", None) == [] and skills.skill_names(None, None, None) == []


def test_contexts_and_backends(spark):
    rows = spark.createDataFrame([(1, "text", "r", None, None)], "id long, content string, repo string, cwd string, branch string")
    told = enrich.contexts(rows, "llm-local", lambda pairs: [f"{p}about {t}" for p, t in pairs]).first()
    assert (told["context"], told["context_version"]) == ("[r HEAD] about text", 1)
    assert enrich.contexts(rows, "off").first()["context"] == ""
    for bad in (("llm-codex", None), ("other", None)):
        with pytest.raises(ValueError):
            enrich.contexts(rows, *bad)
    assert enrich.backend("auto")(["a b"]).shape == (1, 64) and np.isclose(np.linalg.norm(enrich.backend("hashed", "8")(["a"])), 1)
    with pytest.raises(ValueError):
        enrich.backend("nothing")


def test_upserts_take_the_last_and_write_what_differs(spark):
    table = spark.createDataFrame([(1, "a", 0), (2, None, 0)], "k int, v string, at int")
    rows = spark.createDataFrame([(1, "a", 0), (2, None, 0), (2, "x", 1), (3, "y", 5), (3, "z", 4)], "k int, v string, at int")
    assert sorted(map(tuple, relational.changed(table, rows, ["k"], "at").collect())) == [(2, "x", 1), (3, "y", 5)]
    assert sorted(map(tuple, relational.upsert(table, rows, ["k"], "at").collect())) == [(1, "a", 0), (2, "x", 1), (3, "y", 5)]


def test_a_tail_replaces_metadata_it_tells(spark):
    shape = "id int, source string, message_count int, input_tokens int, output_tokens int, ended_at int, started_at int, model string, cwd string"
    before = spark.createDataFrame([(1, "s", 2, 5, None, 9, 1, "old", "/a")], shape)
    tail = spark.createDataFrame([(1, "s", 1, None, 4, 12, 8, "new", None)], shape)
    got = relational.merge_session(before, tail).first()
    assert (got["model"], got["cwd"], got["message_count"], got["input_tokens"], got["output_tokens"]) == ("new", "/a", 3, 5, 4)


def test_chunk_streams_take_a_bounded_batch(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for i in range(5):
        (folder / f"{i}.txt").write_text("x" * 100)
    sizes = []
    stream = spark.readStream.options(**ingest.chunk_options(250)).text(str(folder))
    query = stream.writeStream.foreachBatch(lambda df, _: sizes.append(df.count())).option("checkpointLocation", str(tmp_path / "p")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert sum(sizes) == 5 and max(sizes) < 5
    assert ingest.chunk_options(None) == {"maxFilesPerTrigger": "512"}


def test_of_markers_at_one_place_the_first_of_the_table_counts(spark):
    tails = spark.createDataFrame([("a", 5), ("b", 9), ("c", 9)], "session_id string, tail_idx long")
    lines = [("a", 3, True, 4), ("a", 3, False, 1), ("a", 3, True, 2), ("a", 6, True, 0), ("b", 2, True, 7), ("b", 2, False, 8), ("b", 1, False, 0)]
    lines += [("c", 4, None, 0), ("c", 3, True, 1)]
    for parts in (1, 5):
        for mine in (lines, lines[::-1]):
            markers = spark.createDataFrame(mine, "session_id string, message_idx long, ends_turn boolean, place int").repartition(parts)
            got = sorted(map(tuple, relational.marker_at_or_below(tails, markers, "place").collect()))
            assert got == [("a", 5, 3, False), ("b", 9, 2, True), ("c", 9, 4, True)]


def test_markers_match_their_sql_when_lines_are_shuffled(spark, tmp_path):
    """The answer does not hang on which side is broadcast or in which order rows arrive."""
    import duckdb
    from turnstone.plans.catalogue import ORACLE_SQL, QUERIES

    sf, con = "/root/testdata/sf0.01", duckdb.connect()
    for t in ("events", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = sorted(con.execute(ORACLE_SQL["jn10_marker_as_of"]).fetchall())
    held = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.files.maxPartitionBytes", "spark.sql.shuffle.partitions")}
    try:
        for k, v in zip(held, ("-1", "64k", "7"), strict=True):
            spark.conf.set(k, v)
        got = sorted(map(tuple, QUERIES["jn10_marker_as_of"](spark, sf).select("session_id", "tail_idx", "marker_idx", "ends_turn").collect()))
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
    assert got == want
