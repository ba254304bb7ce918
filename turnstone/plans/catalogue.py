"""Named queries over the driver's tables, and the SQL that gives the same rows."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import live, relational, stats
from ..operators import sessions as reading
from .bindings import table, view, with_views

QUERIES: dict = {}
ORACLE_SQL: dict = {}

CUTOFF = datetime(2024, 1, 1)


def query(sql: str | None = None, *views: str):
    """Register a query of frames named by its parameters' defaults, with its SQL over the same views."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = with_views(sql, *views) if views else sql
        return f

    return register


@query(
    """SELECT (SELECT count(*) FROM sessions) AS sessions, (SELECT count(*) FROM messages) AS messages,
       (SELECT count(*) FROM calls) AS tool_calls, (SELECT count(bash_base) FROM calls) AS bash_calls""",
    "sessions", "messages", "calls",
)
def agg1_overview(spark, d):
    calls = view(spark, d, "calls").withColumn("bash_command", F.col("bash_base"))
    return stats.overview(view(spark, d, "sessions"), view(spark, d, "messages"), calls)


@query("SELECT tool_name, count(*) AS n FROM calls GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50", "calls")
def agg2_tool_usage(spark, d):
    return stats.tool_usage(view(spark, d, "calls"))


@query(
    """SELECT bash_base, bash_sub, count(*) AS n, bool_or(is_compound) AS is_compound FROM calls
       WHERE bash_base IS NOT NULL GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 NULLS FIRST LIMIT 100""",
    "calls",
)
def agg3_bash_breakdown(spark, d):
    return stats.bash_breakdown(view(spark, d, "calls"))


@query(
    """SELECT concat(bash_base, ' ', coalesce(nullif(bash_sub, ''), '*')) AS pattern, n,
              CASE WHEN bash_base IN ('rm', 'sudo', 'chmod', 'chown', 'dd', 'mkfs', 'mount', 'umount', 'shutdown', 'reboot', 'kill', 'killall')
                   THEN 'skipped' WHEN is_compound THEN 'review' WHEN n >= 50 THEN 'high'
                   WHEN n >= 10 THEN 'medium' ELSE 'review' END AS confidence,
              CASE WHEN bash_base IN ('rm', 'sudo', 'chmod', 'chown', 'dd', 'mkfs', 'mount', 'umount', 'shutdown', 'reboot', 'kill', 'killall')
                   THEN 'destructive command' WHEN is_compound THEN 'compound command' WHEN n >= 10 THEN 'frequent command'
                   ELSE 'rare command' END AS reason
       FROM (SELECT bash_base, bash_sub, count(*) AS n, bool_or(is_compound) AS is_compound FROM calls
             WHERE trim(bash_base) <> '' GROUP BY 1, 2)""",
    "calls",
)
def agg4_bash_suggestions(spark, d):
    return stats.bash_suggestions(view(spark, d, "calls"))


@query(
    """SELECT git_repo, sum(coalesce(input_tokens, 0)) AS input_tokens, sum(coalesce(output_tokens, 0)) AS output_tokens
       FROM sessions GROUP BY 1 ORDER BY 2 + 3 DESC""".replace(
        "ORDER BY 2 + 3 DESC",
        "ORDER BY sum(coalesce(input_tokens, 0)) + sum(coalesce(output_tokens, 0)) DESC, git_repo NULLS FIRST LIMIT 50",
    ),
    "sessions",
)
def agg5_token_usage(spark, d):
    return stats.token_usage(view(spark, d, "sessions"))


USAGE = """
    SELECT source, model, host, coalesce(sum(input_tokens), 0) AS input_tokens,
           coalesce(sum(cached_tokens), 0) AS cached_tokens, coalesce(sum(output_tokens), 0) AS output_tokens,
           CASE WHEN sum(cached_tokens) <= coalesce(sum(input_tokens), 0)
                THEN coalesce(sum(input_tokens), 0) - sum(cached_tokens) END AS fresh_tokens, count(*) AS session_count
    FROM sessions WHERE (input_tokens IS NOT NULL OR output_tokens IS NOT NULL)
    GROUP BY 1, 2, 3
"""


@query(
    USAGE + """ ORDER BY coalesce(sum(input_tokens), 0) + coalesce(sum(output_tokens), 0) DESC, source, model, host
    LIMIT 200""",
    "sessions",
)
def agg6_usage_by_source(spark, d):
    return stats.usage_by_source(view(spark, d, "sessions"))


@query(
    f"""SELECT source, model, CASE WHEN host = 'local' THEN endpoint ELSE host END AS host,
               sum(input_tokens) AS input_tokens, sum(cached_tokens) AS cached_tokens, sum(output_tokens) AS output_tokens,
               sum(fresh_tokens) AS fresh_tokens, sum(session_count) AS session_count
        FROM (SELECT 'east' AS endpoint, * FROM ({USAGE.replace("GROUP BY", "AND id % 2 = 0 GROUP BY")})
              UNION ALL SELECT 'west', * FROM ({USAGE.replace("GROUP BY", "AND id % 2 = 1 GROUP BY")})) GROUP BY 1, 2, 3""",
    "sessions",
)
def agg9_fleet_usage(spark, d):
    sessions = view(spark, d, "sessions")
    side = lambda k, name: stats.usage_by_source(sessions.filter(F.col("id") % 2 == k), limit=1 << 30).withColumn(
        "endpoint", F.lit(name)
    )
    return stats.fleet_usage(side(0, "east").unionByName(side(1, "west")))


@query(
    """SELECT s.id, s.source_session_id, CASE WHEN s.id = owner THEN p END AS prompt_tokens,
              CASE WHEN s.id = owner THEN c END AS completion_tokens
       FROM sessions s JOIN (SELECT source_session_id, min(id) AS owner FROM sessions GROUP BY 1) o USING (source_session_id)
       JOIN (SELECT user_id AS source_session_id, sum(CAST(floor(value) AS BIGINT)) AS p, count(*) AS c FROM events GROUP BY 1) e
       USING (source_session_id)""",
    "sessions",
)
def agg8_usage_rollup(spark, d):
    events = table(spark, d, "events").select(
        F.col("user_id").alias("source_session_id"), F.floor("value").alias("prompt_tokens"), F.lit(1).alias("completion_tokens")
    )
    return stats.usage_rollup(events, view(spark, d, "sessions"))


FILES = """SELECT p_partkey AS path, p_brand AS source, p_type AS root, p_size AS size, p_size - p_partkey % 3 AS file_offset,
           p_partkey % 10 = 0 AS missing, p_retailprice AS mtime FROM part"""


def _files(spark, d):
    part = table(spark, d, "part")
    return part.select(
        F.col("p_partkey").alias("path"), F.col("p_brand").alias("source"), F.col("p_type").alias("root"),
        F.col("p_size").cast("long").alias("size"), (F.col("p_size") - F.col("p_partkey") % 3).alias("offset"),
        (F.col("p_partkey") % 10 == 0).alias("missing"), F.col("p_retailprice").alias("mtime"),
    )


@query(
    f"""SELECT source, root, count(*) AS files, count(*) FILTER (missing) AS missing,
               count(*) FILTER (NOT missing AND file_offset < size) AS pending,
               count(*) FILTER (NOT missing AND file_offset >= size) AS current,
               min(mtime) FILTER (NOT missing AND file_offset < size) AS oldest_pending FROM ({FILES}) GROUP BY 1, 2"""
)
def agg11_coverage(spark, d):
    return stats.coverage(_files(spark, d))


@query(
    f"""SELECT sum(CASE WHEN mtime < 1200 THEN 1 ELSE 0 END) AS eligible, sum(CASE WHEN mtime < 1200 THEN 0 ELSE 1 END) AS held
        FROM ({FILES})"""
)
def agg13_pending_split(spark, d):
    return stats.pending_split(_files(spark, d), 1200)


@query(
    f"""SELECT coalesce(sum(size) FILTER (source = 'Brand#11'), 0) AS kept, sum(size) AS total,
               coalesce(sum(size) FILTER (source = 'Brand#11'), 0) <= 0.1 * sum(size) AS selective FROM ({FILES})"""
)
def agg14_selectivity(spark, d):
    return stats.selectivity(_files(spark, d).withColumn("weight", F.col("size")), F.col("source") == "Brand#11")


@query("SELECT session_id, max(idx) AS high_water FROM messages GROUP BY 1", "messages")
def agg15_high_water(spark, d):
    return stats.high_water(view(spark, d, "messages"))


@query(
    """SELECT count(*) AS groups, coalesce(sum(n - 1), 0) AS excess
       FROM (SELECT count(*) AS n FROM documents GROUP BY text HAVING count(*) > 1)"""
)
def agg17_move_census(spark, d):
    return stats.duplicate_census(table(spark, d, "documents"), "text")


@query(
    """SELECT source, detail, files, paths FROM (
         SELECT source, detail, count(*) AS files, array_to_string(list_slice(list(path ORDER BY path), 1, 3), ',') AS paths
         FROM (SELECT DISTINCT event_type AS source, CAST(user_id % 7 AS VARCHAR) AS detail, user_id AS path FROM events)
         GROUP BY 1, 2) ORDER BY files DESC, source, detail LIMIT 8"""
)
def agg20_unsupported_summary(spark, d):
    events = table(spark, d, "events")
    rows = events.select(
        F.col("event_type").alias("source"), (F.col("user_id") % 7).cast("string").alias("detail"), F.col("user_id").alias("path")
    )
    return stats.sample_paths(rows)


@query("SELECT user_id, max(event_id) AS newest FROM events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
def agg21_recent_keys(spark, d):
    return stats.recent_keys(table(spark, d, "events"), "user_id", "event_id", 20)


@query(
    """SELECT id, source, host, source_session_id FROM (SELECT *, row_number() OVER (PARTITION BY source, coalesce(host, ''),
       source_session_id ORDER BY (input_tokens IS NOT NULL) DESC, coalesce(ended_at, started_at) DESC NULLS LAST, id) AS rn
       FROM sessions) WHERE rn = 1""",
    "sessions",
)
def win1_transcript_dedupe(spark, d):
    rows = view(spark, d, "sessions").select(
        "id", "source", "host", F.col("source_session_id").alias("transcript"),
        F.col("input_tokens").isNotNull().alias("present"), F.coalesce("ended_at", "started_at").alias("recency"),
    )
    return stats.newest_transcripts(rows).select("id", "source", "host", F.col("transcript").alias("source_session_id"))


LAST = """SELECT session_id, id, idx FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY idx DESC) AS rn
          FROM {0}) WHERE rn <= {1}"""


@query(LAST.format("messages", 8), "messages")
def win2_turn_tail(spark, d):
    return relational.last_per_session(view(spark, d, "messages"), 8, "idx").select("session_id", "id", "idx")


@query(LAST.format("calls", 32), "calls")
def win3_open_call_tail(spark, d):
    return relational.last_per_session(view(spark, d, "calls"), 32, "idx").select("session_id", "id", "idx")


@query("SELECT session_id, max(idx) AS idx, max_by(tool_name, idx) AS tool_name FROM calls GROUP BY 1", "calls")
def win4_last_marker(spark, d):
    return relational.latest(view(spark, d, "calls").select("session_id", "idx", "tool_name"), ["session_id"], "idx")


@query("SELECT user_id, event_type, max(event_id) AS event_id, max_by(value, event_id) AS value FROM events GROUP BY 1, 2")
def win5_keep_latest(spark, d):
    rows = table(spark, d, "events").select("user_id", "event_type", "event_id", "value")
    return relational.latest(rows, ["user_id", "event_type"], "event_id")


@query("SELECT event_id, user_id, sum(user_id) OVER () AS total FROM events ORDER BY user_id DESC, event_id LIMIT 10")
def win6_totals_beside_limit(spark, d):
    rows = table(spark, d, "events").select("event_id", "user_id")
    return relational.roster_with_totals(rows, "user_id", 10, F.desc("user_id"), F.asc("event_id"))


@query("SELECT s.id, s.host, count(c.id) AS calls FROM sessions s JOIN calls c ON s.id = c.session_id GROUP BY 1, 2", "sessions", "calls")
def jn1_sessions_calls(spark, d):
    return reading.call_counts(view(spark, d, "sessions"), view(spark, d, "calls"))


@query(
    """SELECT c.id, c.session_id FROM calls c WHERE NOT EXISTS (SELECT 1 FROM results r
       WHERE r.session_id = c.session_id AND r.idx = c.idx)""",
    "calls", "results",
)
def jn3_open_calls(spark, d):
    calls = view(spark, d, "calls").select("id", "session_id", F.col("idx").alias("tool_use_id"), F.col("id").alias("message_id"))
    results = view(spark, d, "results").select("session_id", F.col("idx").cast("long").alias("tool_use_id"))
    return relational.open_calls(calls, results).select("id", "session_id")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)")
def jn5_pending_embeddings(spark, d):
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"))
    return relational.without(table(spark, d, "documents").select("doc_id"), vectors, "doc_id")


@query(
    """SELECT o_orderstatus, count(DISTINCT o_custkey) AS n FROM orders
       WHERE NOT EXISTS (SELECT 1 FROM events WHERE user_id = o_custkey) GROUP BY 1"""
)
def jn6_index_only(spark, d):
    users = table(spark, d, "events").select(F.col("user_id").alias("o_custkey"))
    left = relational.without(table(spark, d, "orders").select("o_custkey", "o_orderstatus"), users, "o_custkey")
    return left.groupBy("o_orderstatus").agg(F.countDistinct("o_custkey").alias("n"))


@query("SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) AS present FROM customer")
def jn7_present_flag(spark, d):
    there = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return reading.with_presence(table(spark, d, "customer").select("c_custkey"), there, "c_custkey")


@query(
    """SELECT t.session_id, t.tail_idx, max(r.idx) AS marker_idx, max_by(r.l_linestatus = 'F', r.idx) AS ends_turn
       FROM (SELECT session_id, max(idx) AS tail_idx FROM calls GROUP BY 1) t JOIN results r
       ON r.session_id = t.session_id AND r.idx <= t.tail_idx GROUP BY 1, 2""",
    "calls", "results",
)
def jn10_marker_as_of(spark, d):
    tails = view(spark, d, "calls").groupBy("session_id").agg(F.max("idx").alias("tail_idx"))
    # lines share numbers, and the SQL's max_by keeps the first it reads: the results in the order of their file
    markers = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("session_id"), F.col("l_linenumber").cast("long").alias("message_idx"),
        (F.col("l_linestatus") == "F").alias("ends_turn"), "_metadata.file_path", "_metadata.row_index",
    )
    return relational.marker_at_or_below(tails, markers, "file_path", "row_index")


@query(
    """SELECT a.id FROM sessions a JOIN sessions b ON a.id = b.id - 1 AND a.model IS NOT DISTINCT FROM b.model
       AND a.git_repo IS NOT DISTINCT FROM b.git_repo""",
    "sessions",
)
def jn11_positional_match(spark, d):
    rows = view(spark, d, "sessions").select("id", "model", "git_repo")
    return relational.same_rows(rows, rows.withColumn("id", F.col("id") - 1), "id", ["model", "git_repo"]).select("id")


@query("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def jn12_membership(spark, d):
    some = table(spark, d, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return relational.among(table(spark, d, "orders").select("o_orderkey", "o_custkey"), some, "o_custkey").select("o_orderkey")


@query(
    """SELECT r_name, count(n_nationkey) AS nations FROM nation RIGHT JOIN region ON n_regionkey = r_regionkey AND n_name < 'C'
       GROUP BY 1"""
)
def jn15_census_keeps_empty(spark, d):
    regions = table(spark, d, "region")
    few = table(spark, d, "nation").filter("n_name < 'C'").join(regions, F.col("n_regionkey") == F.col("r_regionkey"))
    return reading.census(regions, few, "r_name", "nations")


@query("SELECT id FROM sessions ORDER BY coalesce(ended_at, started_at) DESC NULLS LAST, id LIMIT 50", "sessions")
def srt1_session_list(spark, d):
    rows = view(spark, d, "sessions").withColumn("indexed_at", F.lit(None).cast("timestamp_ntz"))
    return reading.list_sessions(rows, 50).select("id")


@query("SELECT id, idx, content FROM messages WHERE session_id = 3 ORDER BY idx, id LIMIT 10", "messages")
def srt3_head_read(spark, d):
    one = spark.range(3, 4)
    messages, _ = reading.load_sessions(view(spark, d, "messages"), _owned_calls(spark, d), one, tools=False, message_limit=10)
    return messages.select("id", "idx", "content")


@query("SELECT id, idx FROM (SELECT * FROM messages WHERE session_id = 3 AND idx > 1 ORDER BY idx DESC LIMIT 3) ORDER BY idx", "messages")
def srt4_delta_tail(spark, d):
    return reading.load_tail(view(spark, d, "messages"), _owned_calls(spark, d), 3, tail=3, after_idx=1).select("id", "idx")


@query("SELECT id, ended_at FROM sessions ORDER BY ended_at DESC NULLS LAST, id LIMIT 21 OFFSET 40", "sessions")
def srt5_live_page(spark, d):
    rows = view(spark, d, "sessions").select("id", F.col("ended_at").alias("last_activity"))
    return reading.live_page(rows, 21, reading.encode_page(40)).select("id", F.col("last_activity").alias("ended_at"))


@query(
    """SELECT role, id, NOT ((role, id) > ('system', 50000)) AS wrapped FROM messages
       ORDER BY 3, 1, 2 LIMIT 40""",
    "messages",
)
def srt7_keyset_page(spark, d):
    return relational.keyset_page(view(spark, d, "messages").select("role", "id"), ("system", 50000), 40, "role", "id")


@query(
    """SELECT kind, id FROM (SELECT 'call' AS kind, id FROM calls WHERE agent = 1 UNION ALL SELECT 'message', id FROM messages
       UNION ALL SELECT 'session', id FROM sessions)""",
    "calls", "messages", "sessions",
)
def set1_roster_union(spark, d):
    calls = view(spark, d, "calls").filter("agent = 1")
    return reading.roster_union(call=calls, message=view(spark, d, "messages"), session=view(spark, d, "sessions"))


@query(
    """SELECT 'left' AS side, x FROM (SELECT o_custkey % 100 AS x FROM orders EXCEPT ALL SELECT user_id % 100 FROM events)
       UNION ALL SELECT 'right', x FROM (SELECT user_id % 100 AS x FROM events EXCEPT ALL SELECT o_custkey % 100 FROM orders)"""
)
def set5_multiset_difference(spark, d):
    a = table(spark, d, "orders").select((F.col("o_custkey") % 100).alias("x"))
    b = table(spark, d, "events").select((F.col("user_id") % 100).alias("x"))
    return relational.multiset_difference(a, b)


@query(
    """SELECT 'left' AS side, x FROM (SELECT o_custkey AS x FROM orders EXCEPT SELECT user_id FROM events)
       UNION ALL SELECT 'right', x FROM (SELECT user_id AS x FROM events EXCEPT SELECT o_custkey FROM orders)"""
)
def set6_set_difference(spark, d):
    return relational.set_difference(
        table(spark, d, "orders").select(F.col("o_custkey").alias("x")), table(spark, d, "events").select(F.col("user_id").alias("x"))
    )


@query(
    """SELECT c_custkey AS k FROM customer UNION ALL SELECT DISTINCT user_id FROM events
       WHERE user_id NOT IN (SELECT c_custkey FROM customer)"""
)
def dml1_insert_new(spark, d):
    base = table(spark, d, "customer").select(F.col("c_custkey").alias("k"))
    return relational.insert_new(base, table(spark, d, "events").select(F.col("user_id").alias("k")), "k")


@query(
    """SELECT id, CASE WHEN id % 4 = 0 THEN 'moved' ELSE host END AS host FROM sessions""",
    "sessions",
)
def dml2_upsert(spark, d):
    rows = view(spark, d, "sessions").select("id", "host")
    return relational.upsert(rows, rows.filter("id % 4 = 0").withColumn("host", F.lit("moved")), ["id"])


@query(
    """SELECT id, CASE WHEN id % 5 = 0 THEN 'dropped' WHEN id % 5 = 1 THEN 'added' WHEN id % 5 = 2 AND git_repo IS NOT NULL
       THEN 'amended' ELSE 'preserved' END AS verdict FROM sessions""",
    "sessions",
)
def dml9_full_compare(spark, d):
    rows = view(spark, d, "sessions").select("id", "git_repo", "model")
    after = rows.filter("id % 5 <> 0").withColumn("git_repo", F.when(F.col("id") % 5 != 2, F.col("git_repo")))
    return relational.compare(rows.filter("id % 5 <> 1"), after, "id", ["git_repo", "model"])


@query(
    """SELECT c_custkey AS path, CAST(CASE WHEN c_custkey % 2 = 0 THEN 7 ELSE c_nationkey END AS BIGINT) AS signature,
              CAST(CASE WHEN c_custkey % 2 = 0 AND c_nationkey <> 7 THEN 1 ELSE 0 END AS BIGINT) AS generation,
              c_custkey % 3 = 0 AND c_custkey % 2 = 1 AS missing FROM customer"""
)
def dml4_observe_files(spark, d):
    catalog = table(spark, d, "customer").select(
        F.col("c_custkey").alias("path"), F.col("c_nationkey").cast("long").alias("signature"), F.lit(0).cast("long").alias("generation")
    )
    even = F.col("path") % 2 == 0
    seen = catalog.filter(even | (F.col("path") % 3 != 0)).select("path", F.when(even, 7).otherwise(F.col("signature")).alias("signature"))
    return relational.observe_files(catalog, seen)


@query(
    """SELECT id, session_id, idx FROM (SELECT *, sum(octet_length(encode(content))) OVER w AS b, count(*) OVER w AS n FROM messages
       WHERE octet_length(encode(content)) <= 1500
       WINDOW w AS (PARTITION BY session_id ORDER BY idx ROWS UNBOUNDED PRECEDING)) WHERE b <= 4000 AND n <= 4""",
    "messages",
)
def emb2_admit_bytes(spark, d):
    rows = view(spark, d, "messages").withColumn("size", F.octet_length("content"))
    return relational.admit_bytes(rows, "size", 4000, 4, "idx", single=1500).select("id", "session_id", "idx")


@query(
    """SELECT id, CASE WHEN lower(content) LIKE '%<command-message>%' OR lower(content) LIKE '%<command-name>%' THEN 0.25
       WHEN lower(trim(content)) LIKE '---%' AND lower(content) LIKE '%allowed-tools:%' THEN 0.35
       WHEN role = 'system' AND lower(content) LIKE '%## context%' THEN 0.5 ELSE 1.0 END::DOUBLE AS quality FROM messages""",
    "messages",
)
def sea12_quality(spark, d):
    return view(spark, d, "messages").select("id", scalars.quality(F.col("role"), F.col("content")).alias("quality"))


@query(
    """SELECT source, count(*) AS n, max(coalesce(ended_at, started_at)) AS newest FROM sessions
       WHERE git_repo ILIKE '%REPO1%' AND coalesce(ended_at, started_at) >= TIMESTAMP '1995-01-01' GROUP BY 1""",
    "sessions",
)
def ses1_filtered_list(spark, d):
    recency = F.coalesce("ended_at", "started_at")
    known = view(spark, d, "sessions").withColumn("indexed_at", F.lit(None).cast("timestamp_ntz"))
    rows = reading.list_sessions(known, None, since=datetime(1995, 1, 1), project="REPO1")
    return rows.groupBy("source").agg(F.count("*").alias("n"), F.max(recency).alias("newest"))


OWNED = """SELECT c.id, c.session_id, c.idx, m.id AS message_id, c.tool_name FROM calls c LEFT JOIN messages m
           ON c.session_id = m.session_id AND c.idx = m.idx"""


def _owned_calls(spark, d):
    """Calls with the message at their place in the session, or with none."""
    places = view(spark, d, "messages").select("session_id", F.col("idx").cast("long").alias("idx"), F.col("id").alias("message_id"))
    return view(spark, d, "calls").select("id", "session_id", "idx", "tool_name").join(places, ["session_id", "idx"], "left")


@query(
    f"""WITH o AS ({OWNED}) SELECT m.id, m.idx, (SELECT count(*) FROM o WHERE message_id = m.id) AS calls, 'message' AS kind FROM messages m
        WHERE m.session_id < 20 UNION ALL SELECT id, idx, 0, 'orphan' FROM o WHERE message_id IS NULL AND session_id < 20""",
    "messages", "calls",
)
def ses2_load_sessions(spark, d):
    messages, orphans = reading.load_sessions(view(spark, d, "messages"), _owned_calls(spark, d), spark.range(20))
    calls = F.coalesce(F.size("tool_calls"), F.lit(0)).cast("long")
    rows = messages.select("id", "idx", calls.alias("calls"), F.lit("message").alias("kind"))
    return rows.unionByName(orphans.select("id", "idx", F.lit(0).cast("long").alias("calls"), F.lit("orphan").alias("kind")))


@query(
    """SELECT id, CASE WHEN id % 9 = 0 THEN 'ended' WHEN id % 4 = 0 THEN 'active' WHEN id % 6 = 5 THEN 'ended'
       WHEN ended_at IS NULL THEN 'unknown' WHEN TIMESTAMP '1998-01-01' - ended_at <= INTERVAL 300 SECOND THEN 'idle'
       ELSE 'unknown' END AS liveness FROM sessions""",
    "sessions",
)
def liv4_liveness(spark, d):
    rows = view(spark, d, "sessions").select(
        "id", F.col("ended_at").alias("last_activity"), (F.col("id") % 9 != 0).alias("pid_alive"),
        (F.col("id") % 4 == 0).alias("watched"), (F.col("id") % 6 == 5).alias("ended"),
    )
    return live.liveness(rows, datetime(1998, 1, 1)).select("id", "liveness")


@query(
    f"""SELECT path, greatest(size - file_offset, 0) AS lag_bytes, array_to_string(list_filter([CASE WHEN file_offset < size
        THEN 'behind' END, CASE WHEN missing THEN 'missing' END], lambda x: x IS NOT NULL), ',') AS limitations,
        NOT (file_offset < size OR missing) AS current FROM ({FILES})"""
)
def liv5_freshness(spark, d):
    rows = _files(spark, d).withColumns({"generation": F.lit(0), "wanted": F.lit(0)})
    return live.freshness(rows).select("path", "lag_bytes", "limitations", "current")


@query(
    """WITH tail AS (SELECT session_id, max_by(role, idx) AS r FROM (SELECT *, row_number() OVER (PARTITION BY session_id
              ORDER BY idx DESC) AS rn FROM messages) WHERE rn <= 8 AND idx % 3 <> 1 GROUP BY 1),
            o AS (SELECT session_id, bool_or(agent = 1 AND agent IS NOT NULL) AS sub, count(*) AS n FROM (SELECT *, row_number() OVER
              (PARTITION BY session_id ORDER BY idx DESC) AS rn FROM calls WHERE tool_name = 'error') WHERE rn <= 32 GROUP BY 1),
            e AS (SELECT session_id, max_by(l_linestatus = 'F', idx) AS f FROM results GROUP BY 1)
       SELECT m.session_id, CASE WHEN sub THEN 'subagents_running' WHEN n > 0 THEN 'working'
              WHEN f AND coalesce(r, '') <> 'user' THEN 'awaiting_input' WHEN NOT f AND coalesce(r, '') <> 'user' THEN 'working'
              ELSE 'unknown' END AS turn
       FROM (SELECT DISTINCT session_id FROM messages) m LEFT JOIN tail USING (session_id) LEFT JOIN o USING (session_id)
       LEFT JOIN e USING (session_id)""",
    "messages", "calls", "results",
)
def liv6_turn_state(spark, d):
    messages = view(spark, d, "messages").withColumn("agent_id", F.when(F.col("idx") % 3 == 1, "a"))
    calls = view(spark, d, "calls").filter("tool_name = 'error'").select(
        "session_id", F.col("idx").alias("message_idx"), "idx", F.col("agent").alias("agent_id")
    )
    markers = view(spark, d, "results").select(
        "session_id", F.col("idx").alias("message_idx"), (F.col("l_linestatus") == "F").alias("ends_turn")
    )
    return live.turn_state(messages, calls, markers)


@query(
    """SELECT id, coalesce(git_repo ILIKE '%repo1%', false) AS matches, git_repo IS NULL AS possible_match FROM sessions""",
    "sessions",
)
def liv3_three_valued(spark, d):
    rows = view(spark, d, "sessions").select("id", "git_repo")
    return live.three_valued(rows, F.col("git_repo").ilike("%repo1%")).drop("git_repo")


@query(
    """SELECT id, sha256(concat(source, ':', CAST(id AS VARCHAR)))[1:32] AS session_key,
              CASE WHEN git_repo IS NULL THEN '[local HEAD] ' ELSE concat('[', git_repo, ' HEAD] ') END AS context FROM sessions""",
    "sessions",
)
def scl_identity_and_context(spark, d):
    from .. import model

    rows = view(spark, d, "sessions")
    context = scalars.context_prefix(F.col("git_repo"), F.lit("/"), F.lit(None).cast("string"))
    return rows.select("id", model.session_id(F.col("source"), F.col("id").cast("string")).alias("session_key"), context.alias("context"))


@query(
    """SELECT id, sha256(concat_ws('|', source, CAST(id AS VARCHAR), coalesce(CAST(input_tokens AS VARCHAR), ''),
       coalesce(CAST(cached_tokens AS VARCHAR), '')))[1:32] AS event_key FROM sessions""",
    "sessions",
)
def scl8_usage_event_id(spark, d):
    key = scalars.usage_event_id(F.col("source"), F.col("id"), F.col("input_tokens"), F.col("cached_tokens"))
    return view(spark, d, "sessions").select("id", key.alias("event_key"))
