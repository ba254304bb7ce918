"""Named queries over ingestion, enrichment, the live roster and search results, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ingest, live, relational, search
from ..operators import sessions as reading
from .bindings import table, view
from .catalogue import query

# Driver files of a catalogue: generations, offsets, errors and retry times drawn from orders.
FILES = """SELECT o_orderkey AS path, o_custkey AS root, o_orderkey % 4 AS desired_generation, o_orderkey % 3 AS committed_generation,
                  100 + o_orderkey % 7 AS size, 100 + o_orderkey % 5 AS committed_offset, o_orderkey % 10 = 0 AS missing,
                  CASE WHEN o_orderkey % 6 = 0 THEN 'unsupported' WHEN o_orderkey % 6 = 1 THEN 'broken' END AS last_error,
                  o_orderkey % 100 AS next_retry_at, o_totalprice AS mtime, o_orderdate AS waiting_since FROM orders"""


def _files(spark, d):
    return spark.sql(FILES.replace("FROM orders", "FROM {orders}"), orders=table(spark, d, "orders"))


PENDING = """(desired_generation > committed_generation OR committed_offset < size OR last_error IS NOT NULL)
             AND NOT missing AND next_retry_at <= 60"""


@query(f"SELECT path FROM ({FILES}) WHERE {PENDING}")
def inc1_pending(spark, d):
    return _files(spark, d).filter(ingest.pending(60)).select("path")


@query(
    f"""SELECT path FROM ({FILES}) WHERE NOT missing AND committed_generation > 0 AND desired_generation = committed_generation
        AND committed_offset = size AND (last_error IS NULL OR last_error = 'unsupported')"""
)
def inc2_current(spark, d):
    return _files(spark, d).filter(ingest.is_current()).select("path")


@query(
    f"""WITH f AS ({FILES}) SELECT * FROM (SELECT path, 'active' AS lane FROM f WHERE path % 9 = 0 ORDER BY waiting_since, path LIMIT 85)
        UNION ALL SELECT * FROM (SELECT path, 'recent' FROM f WHERE path % 9 <> 0 AND mtime >= 300000 ORDER BY mtime DESC, path LIMIT 85)
        UNION ALL SELECT * FROM (SELECT path, 'oldest' FROM f ORDER BY waiting_since, path LIMIT 85)"""
)
def inc3_priority_lanes(spark, d):
    return ingest.priority_lanes(_files(spark, d), F.col("path") % 9 == 0, 300000)


@query(
    """SELECT path, CASE WHEN why <> 'proved' THEN 'full' WHEN size = off THEN 'unchanged' ELSE 'resume' END AS plan, why,
              CASE WHEN why = 'proved' THEN off ELSE 0 END AS start
       FROM (SELECT o_orderkey AS path, 100 + o_orderkey % 7 AS size, 100 + o_orderkey % 5 AS off,
                    CASE WHEN o_orderkey % 11 = 0 THEN 'new' WHEN o_orderkey % 2 = 1 AND o_orderkey % 3 = 0 THEN 'parser'
                         WHEN o_orderkey % 13 = 0 THEN 'identity' WHEN o_orderkey % 7 < o_orderkey % 5 THEN 'truncated'
                         WHEN o_orderkey % 17 = 0 THEN 'prefix' ELSE 'proved' END AS why FROM orders)"""
)
def inc4_resume_plan(spark, d):
    key = F.col("path")
    seen = _files(spark, d).select("path", (key * 2).alias("inode"), "size", F.sha2(key.cast("string"), 256).alias("prefix_digest"))
    old = _files(spark, d).filter(key % 11 != 0).select(
        "path", F.when((key % 2 == 1) & (key % 3 == 0), "r1").otherwise("r2").alias("parser_revision"),
        F.when(key % 13 != 0, key * 2).alias("inode"), "committed_offset",
        F.when(key % 17 == 0, "other").otherwise(F.sha2(key.cast("string"), 256)).alias("prefix_digest"),
    )
    return ingest.resume_plan(old, seen, "r2")


@query(
    """SELECT o_orderkey AS path, o_custkey AS digest FROM orders WHERE o_orderkey % 3 <> 0 AND o_orderkey % 5 <> 0"""
)
def inc6_commit_guard(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("path"), F.col("o_custkey").alias("digest"))
    parsed = rows.withColumn("complete", F.col("path") % 3 != 0)
    captured = rows.select("path", F.when(F.col("path") % 5 == 0, -1).otherwise(F.col("digest")).alias("digest"))
    return ingest.commit_guard(parsed, captured).select("path", "digest")


@query(
    """WITH p AS (SELECT a.o_orderkey AS before, b.o_orderkey AS after FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey
            WHERE a.o_orderkey % 2 = 0 AND b.o_orderkey % 2 = 1 AND a.o_orderkey % 5 = b.o_orderkey % 5
            AND a.o_custkey IN (SELECT o_custkey FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1 HAVING count(*) <= 16))
       SELECT before, after FROM (SELECT *, count(*) OVER (PARTITION BY before) AS x, count(*) OVER (PARTITION BY after) AS y FROM p)
       WHERE x = 1 AND y = 1"""
)
def inc7_detect_moves(spark, d):
    orders = table(spark, d, "orders")
    key, native = F.col("o_orderkey"), F.col("o_custkey").alias("native_id")
    digest = (key % 5).cast("string")
    gone = orders.filter(key % 2 == 0).select(key.alias("path"), F.lit(10).alias("offset"), digest.alias("prefix_digest"), native)
    heads = F.array(F.struct(F.lit(10).alias("offset"), digest.alias("digest")))
    came = orders.filter(key % 2 == 1).select(key.alias("path"), F.lit(12).alias("size"), heads.alias("heads"), native)
    return ingest.detect_moves(gone, came, "native_id")


@query(
    """SELECT m.id, CASE WHEN session_id % 3 = 0 THEN session_id + 1000000 ELSE session_id END AS session_id FROM messages m""",
    "messages",
)
def inc8_supersede(spark, d):
    messages = view(spark, d, "messages").select("id", "session_id")
    gone = messages.filter("session_id % 3 = 0").select(F.col("session_id").alias("before")).distinct()
    return ingest.supersede(messages, gone.withColumn("after", F.col("before") + 1000000), "session_id")


@query(
    f"""SELECT path, root, path % 3 = 0 AS missing, count(*) FILTER (path % 3 <> 0) OVER w > 0
               AND count(*) FILTER (path % 3 <> 0) OVER w * 2 >= count(*) OVER w AS moves_allowed
        FROM ({FILES}) WINDOW w AS (PARTITION BY root)"""
)
def inc9_vanished(spark, d):
    files = _files(spark, d).select("path", "root")
    return ingest.mark_vanished(files, files.filter("path % 3 <> 0"))


@query("SELECT id FROM sessions WHERE id NOT IN (SELECT user_id FROM events)", "sessions")
def dml5_delete_sessions(spark, d):
    gone = table(spark, d, "events").select(F.col("user_id").alias("id"))
    return ingest.delete_sessions(gone, sessions=(view(spark, d, "sessions").select("id"), "id"))["sessions"]


@query("SELECT session_id, idx FROM messages WHERE session_id % 4 <> 0 OR idx % 2 = 0", "messages")
def dml6_retire(spark, d):
    rows = view(spark, d, "messages").select("session_id", "idx")
    return ingest.retire(rows, rows.filter("session_id % 4 = 0 and idx % 2 = 0"), "session_id", "session_id", "idx")


@query(
    """SELECT c.id, c.session_id, c.idx AS tool_use_id, r.l_quantity AS summary FROM calls c JOIN
       (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC, l_quantity DESC) AS rn FROM lineitem) r
       ON r.l_orderkey = c.session_id AND r.l_linenumber = c.idx AND r.rn = 1""",
    "calls",
)
def dml7_pair_results(spark, d):
    calls = view(spark, d, "calls").select("id", "session_id", F.col("idx").alias("tool_use_id"))
    results = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("session_id"), F.col("l_linenumber").cast("long").alias("tool_use_id"), F.col("l_quantity").alias("summary"),
        F.col("l_shipdate").alias("at"),
    )
    return ingest.pair_results(calls, results).drop("at")


@query(
    """SELECT id, source, CASE WHEN id % 3 = 0 THEN 1 ELSE 5 END AS message_count,
              CASE WHEN id % 3 = 0 THEN input_tokens WHEN source = '1-URGENT' THEN greatest(input_tokens, 100000)
                   ELSE coalesce(input_tokens + 100000, 100000) END AS input_tokens,
              CASE WHEN id % 3 = 0 THEN started_at ELSE least(started_at, TIMESTAMP '1995-06-01') END AS started_at,
              CASE WHEN id % 3 = 0 THEN ended_at ELSE greatest(ended_at, TIMESTAMP '1996-06-01') END AS ended_at FROM sessions""",
    "sessions",
)
def dml8_merge_session(spark, d):
    before = view(spark, d, "sessions").select(
        "id", "source", F.lit(1).alias("message_count"), "input_tokens", "output_tokens", "ended_at", "started_at"
    )
    at = lambda text: F.lit(text).cast("timestamp_ntz")
    tail = before.filter("id % 3 <> 0").withColumns(
        {"message_count": F.lit(4), "input_tokens": F.lit(100000).cast("long"), "ended_at": at("1996-06-01"), "started_at": at("1995-06-01")}
    )
    merged = relational.merge_session(before, tail, ("1-URGENT",))
    return merged.select("id", "source", "message_count", "input_tokens", "started_at", "ended_at")


@query("SELECT id, CASE WHEN host = 'local' THEN 'here' ELSE host END AS host FROM sessions", "sessions")
def dml10_relabel_host(spark, d):
    return reading.relabel_host(view(spark, d, "sessions").select("id", "host"), "local", "here")


@query(
    """SELECT event_id AS path FROM events WHERE event_type IN ('click', 'view')
       AND json_extract_string(props, '$.k') IS DISTINCT FROM (CASE WHEN event_type = 'click' THEN '1' ELSE '2' END)"""
)
def dml11_reopen_parked(spark, d):
    files = table(spark, d, "events").select(
        F.col("event_id").alias("path"), F.col("event_type").alias("parser"), F.lit("unsupported").alias("last_error"),
        F.concat(F.lit('{"revision": '), F.get_json_object("props", "$.k"), F.lit("}")).alias("detail"),
    )
    revisions = spark.createDataFrame([("click", "1"), ("view", "2")], "parser string, revision string")
    return ingest.reopen_parked(files, revisions).select("path")


@query("SELECT id, CASE WHEN id % 3 = 0 THEN NULL ELSE git_repo END AS git_repo FROM sessions WHERE id % 3 = 0 AND git_repo IS NOT NULL OR id % 7 = 0", "sessions")
def dml12_write_if_distinct(spark, d):
    rows = view(spark, d, "sessions").select("id", "git_repo")
    fresh = rows.withColumn("git_repo", F.when(F.col("id") % 3 != 0, F.col("git_repo")))
    return ingest.write_if_distinct(rows.filter("id % 7 <> 0"), fresh, "id", ["git_repo"])


@query(
    """SELECT c_custkey AS path, CASE WHEN c_custkey % 3 = 0 THEN c_custkey END AS id,
              CASE WHEN c_custkey % 3 = 0 THEN 'indexed' WHEN c_custkey % 3 = 1 THEN 'catalogued' ELSE 'watched' END AS arm,
              c_custkey % 3 = 2 OR c_custkey % 5 = 0 OR c_custkey % 2 = 0 AND c_acctbal >= 5000 AS observed_write
       FROM customer WHERE c_custkey % 3 < 2 OR c_custkey % 5 = 0"""
)
def liv1_roster(spark, d):
    c = table(spark, d, "customer").withColumn("path", F.col("c_custkey"))
    files = c.filter("path % 3 < 2").select("path", (F.col("path") % 2 == 0).alias("present"), F.col("c_acctbal").alias("mtime"))
    sessions = c.filter("path % 3 = 0").select("path", F.col("path").alias("id"))
    return live.roster(sessions, files, c.filter("path % 5 = 0").select("path"), 5000)


@query("SELECT id FROM sessions WHERE id % 4 = 0 OR ended_at >= TIMESTAMP '1996-01-01'", "sessions")
def liv2_members(spark, d):
    rows = view(spark, d, "sessions").select("id", (F.col("id") % 4 == 0).alias("observed_write"), F.col("ended_at").alias("last_activity"))
    return live.members(rows, True, F.lit("1996-01-01").cast("timestamp")).select("id")


@query(
    """SELECT id, liveness FROM (SELECT id, ended_at, CASE id % 4 WHEN 0 THEN 'active' WHEN 1 THEN 'idle' WHEN 2 THEN 'unknown' ELSE 'ended' END
       AS liveness FROM sessions) ORDER BY CASE liveness WHEN 'active' THEN 0 WHEN 'idle' THEN 1 WHEN 'unknown' THEN 2 ELSE 3 END,
       ended_at DESC NULLS LAST, id LIMIT 50""",
    "sessions",
)
def srt9_fleet_live(spark, d):
    part = F.col("id") % 4
    state = F.when(part == 0, "active").when(part == 1, "idle").when(part == 2, "unknown").otherwise("ended")
    rows = view(spark, d, "sessions").select("id", F.col("ended_at").alias("last_activity"), state.alias("liveness"))
    return live.fleet_live(rows.filter("id % 2 = 0").unionByName(rows.filter("id % 2 = 1")), 50).select("id", "liveness")


@query(
    """SELECT c.id, coalesce(nullif(trim(s.host), ''), 'local') AS host FROM calls c LEFT JOIN sessions s ON s.id = c.session_id""",
    "calls", "sessions",
)
def sea14_stamp_host(spark, d):
    return search.stamp_host(view(spark, d, "calls").select("id", "session_id"), view(spark, d, "sessions")).select("id", "host")


@query("SELECT id FROM calls WHERE lower(tool_name) = 'click'", "calls")
def sea16_tool_filter(spark, d):
    return search.by_tool(view(spark, d, "calls"), "CLICK").select("id")


@query(
    """SELECT 'message' AS kind, count(*) AS n FROM messages WHERE id NOT IN (SELECT vec_id FROM embeddings) UNION ALL
       SELECT 'call', count(*) FROM calls WHERE id NOT IN (SELECT vec_id FROM embeddings)""",
    "messages", "calls",
)
def set2_pending_counts(spark, d):
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"))
    arm = lambda kind, name: relational.without(view(spark, d, name), vectors, "id").agg(F.count("*").alias("n"))
    return arm("message", "messages").select(F.lit("message").alias("kind"), "n").unionByName(
        arm("call", "calls").select(F.lit("call").alias("kind"), "n")
    )
