"""Named queries of the scalar rules, of skills, and of the roster's and index's bookkeeping, with their SQL.

Rules are asked of every row of a table: a row's number picks one of a list of cases, and the SQL holds what each case
must give, worked out by hand from the rule.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import scalars, skills
from ..operators import enrich, ingest, live, output, relational, stats
from ..operators import sessions as reading
from .bindings import BASES, cases, table, view
from .catalogue import _owned_calls, query


def picked(values) -> Column:
    """The list's value for a row's event_id."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.col("event_id") % len(values) + 1).cast("int"))


def expected(**columns) -> str:
    return "SELECT event_id, " + ", ".join(f"{cases('event_id', v)} AS {name}" for name, v in columns.items()) + " FROM events"


# command, base, sub, compound
COMMANDS = [(f"{b} arg -x", b, "arg" if i < 13 else None, False) for i, b in enumerate(BASES) if b.strip()] + [
    ("", None, None, None),
    ("   ", None, None, None),
    ("git", "git", None, False),
    ('git commit -m "a && b"', "git", "commit", True),
    ("cd /x && pnpm test", "cd", None, True),
    ("cat a | grep b", "cat", None, True),
    ("ls; rm x", "ls", None, True),
    ("docker ps\ndocker rm x", "docker", "ps", True),
    ("'my tool' x", "my tool", None, False),
    ("echo 'unclosed quote", "echo", None, False),
    ("uv 'run it' now", "uv", "run it", False),
    ("FOO=1 make", "FOO=1", None, False),
    ("|| true", None, None, True),
]


@query(expected(base=[c[1] for c in COMMANDS], sub=[c[2] for c in COMMANDS], is_compound=[c[3] for c in COMMANDS]))
def scl1_shell_split(spark, d):
    rows = table(spark, d, "events").withColumn("p", scalars.shell_parts(picked([c[0] for c in COMMANDS])))
    return rows.select("event_id", "p.base", "p.sub", "p.is_compound")


# tool, input, command, stored input
INPUTS = [
    ("Bash", '{"command": "ls"}', "ls", '{"command": "ls"}'),
    ("shell", '{"cmd": "pwd"}', "pwd", '{"cmd": "pwd"}'),
    ("exec_command", '{"commands": ["a", "b"]}', "a && b", '{"commands": ["a", "b"]}'),
    ("SHELL_COMMAND", '"echo hi"', "echo hi", None),
    ("shell", '{"command": "x", "cmd": "y"}', "x", '{"command": "x", "cmd": "y"}'),
    ("Read", '{"command": "ls"}', None, '{"command": "ls"}'),
    ("apply_patch", '"*** Begin"', None, '{"input": "*** Begin"}'),
    ("bash", '{"command": 7}', None, '{"command": 7}'),
    ("bash", None, None, None),
]


@query(expected(command=[c[2] for c in INPUTS], stored=[c[3] for c in INPUTS]))
def scl2_shell_command(spark, d):
    rows = table(spark, d, "events").select("event_id", picked([c[0] for c in INPUTS]).alias("t"), picked([c[1] for c in INPUTS]).alias("i"))
    command = scalars.shell_command(F.col("t"), F.col("i"))
    return rows.select("event_id", command.alias("command"), scalars.stored_input(F.col("i"), command).alias("stored"))


# tool, input, subagent type, description, model, skill
AGENTS = [
    ("Agent", '{"subagent_type": "explore", "description": "look", "model": "m"}', "explore", "look", "m", None),
    ("Agent", '{"subagent_type": "", "skill": "x"}', None, None, None, None),
    ("Skill", '{"skill": "pdf", "model": "m"}', None, None, None, "pdf"),
    ("agent", '{"subagent_type": "explore"}', None, None, None, None),
    ("Bash", '{"skill": "pdf"}', None, None, None, None),
]


@query(expected(subagent_type=[c[2] for c in AGENTS], subagent_description=[c[3] for c in AGENTS], subagent_model=[c[4] for c in AGENTS],
                skill_name=[c[5] for c in AGENTS]))
def scl3_agent_fields(spark, d):
    rows = table(spark, d, "events").select("event_id", picked([c[0] for c in AGENTS]).alias("t"), picked([c[1] for c in AGENTS]).alias("i"))
    return rows.select("event_id", *scalars.agent_fields(F.col("t"), F.col("i")))


# tool, input, command, session's folder, names, whether it ought to have named one
LOADS = [
    ("Skill", '{"skill": " deploy "}', None, None, "deploy", True),
    ("Bash", None, "cat ~/.agents/skills/deploy/SKILL.md", None, "deploy", True),
    ("Bash", None, "cat ~/.claude/plugins/cache/m/tools/1.2/skills/lint/SKILL.md | head", None, "tools:lint", True),
    ("Bash", None, "head -5 /home/u/.codex/skills/.system/plan/SKILL.md", None, "plan", True),
    ("Bash", None, "sed -n 1,9p /root/.agents/skills/{a,b}/SKILL.md", None, "a,b", True),
    ("Bash", None, "sed -i s/a/b/ ~/.agents/skills/deploy/SKILL.md", None, "", True),
    ("Bash", None, "git diff ~/.agents/skills/deploy/SKILL.md", None, "", True),
    ("Bash", None, "printf 'x | cat ~/.agents/skills/deploy/SKILL.md'", None, "", True),
    ("Bash", None, "cat <<EOF\ncat ~/.agents/skills/no/SKILL.md\nEOF\ncat ~/.pi/agent/skills/yes/SKILL.md", None, "yes", True),
    ("Bash", None, "cat .agents/skills/local/SKILL.md", "/w/repo", "local", True),
    ("Bash", None, "cat .agents/skills/local/SKILL.md", None, "", True),
    ("Bash", None, "cat skills/local/SKILL.md", "/w/repo", "", True),
    ("Bash", None, "cat ~/.agents/skills/$X/SKILL.md ~/.agents/skills/ok/SKILL.md # ~/.agents/skills/c/SKILL.md", None, "ok", True),
    ("Bash", None, "cat ~/.pi/agent/git/host/org/repo/skills/x/SKILL.md && LESS=1 less ~/.agents/skills/grp/y/SKILL.md", None, "repo:x,grp:y", True),
    ("Bash", None, "cat 'unclosed ~/.agents/skills/deploy/SKILL.md", None, "", True),
    ("Read", '{"file_path": "/Users/me/.claude/skills/review/SKILL.md"}', None, None, "review", True),
    ("Read", '{"file_path": "/w/agent-profile/plugins/p/skills/s/SKILL.md"}', None, None, "p:s", True),
    ("Read", '{"file_path": "/w/skills/s/SKILL.md"}', None, None, "", True),
    ("exec_command", '{"source": "read SKILL.md"}', None, None, "", False),
    ("Task", '{"a": {"b": ["see SKILL.md"]}}', None, None, "", True),
]


def _loads(spark, d):
    rows = table(spark, d, "events").select(
        F.col("event_id").alias("id"), F.col("event_id").alias("session_id"), picked([c[0] for c in LOADS]).alias("tool_name"),
        picked([c[1] for c in LOADS]).alias("tool_input"), picked([c[2] for c in LOADS]).alias("bash_command"),
    )
    folders = table(spark, d, "events").select(F.col("event_id").alias("id"), picked([c[3] for c in LOADS]).alias("cwd"))
    return skills.skill_loads(rows, folders)


@query(expected(names=[c[4] for c in LOADS], candidate=[c[5] for c in LOADS]))
def scl4_skill_loads(spark, d):
    return _loads(spark, d).select(F.col("id").alias("event_id"), F.array_join("names", ",").alias("names"), "candidate")


SKILLS = f"""SELECT event_id, user_id AS session_id, unnest(string_split(names, ',')) AS skill_name FROM
             (SELECT event_id, user_id, {cases("event_id", [c[4] for c in LOADS])} AS names FROM events) WHERE names <> ''"""


@query(
    f"""SELECT skill_name, source, host, count(*) AS invocations, count(DISTINCT session_id) AS sessions FROM ({SKILLS})
        JOIN (SELECT id, source, host FROM (SELECT *, row_number() OVER (PARTITION BY source, coalesce(host, ''),
              source_session_id ORDER BY (input_tokens IS NOT NULL) DESC, coalesce(ended_at, started_at) DESC NULLS LAST, id) AS rn
              FROM sessions) WHERE rn = 1) s ON session_id = s.id GROUP BY 1, 2, 3""",
    "sessions",
)
def agg7_skill_usage(spark, d):
    uses = skills.skill_uses(_loads(spark, d)).join(table(spark, d, "events").select(F.col("event_id").alias("id"), "user_id"), "id")
    rows = view(spark, d, "sessions").select(
        "id", "source", "host", F.col("source_session_id").alias("transcript"),
        F.col("input_tokens").isNotNull().alias("present"), F.coalesce("ended_at", "started_at").alias("recency"),
    )
    return stats.skill_usage(uses.select(F.col("user_id").alias("session_id"), "skill_name"), stats.newest_transcripts(rows))


@query(
    f"""SELECT (SELECT count(*) FROM ({SKILLS})) AS attributed_invocations, count(*) AS unattributed_candidates FROM events
        WHERE {cases("event_id", [c[4] for c in LOADS])} = '' AND {cases("event_id", [c[5] for c in LOADS])}"""
)
def agg7_skill_attribution(spark, d):
    return skills.attribution(_loads(spark, d))


PARTS = f"""SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'east' END AS endpoint, o_orderpriority AS source,
                   {cases("o_orderkey", ["deploy", " lint ", "review"])} AS skill_name,
                   CASE WHEN o_orderkey % 4 < 2 THEN 'h1 ' ELSE 'h2' END AS host, o_orderkey % 7 AS invocations, o_orderkey % 5 AS sessions FROM orders"""


def _parts(spark, d):
    return spark.sql(PARTS.replace("FROM orders", "FROM {orders}"), orders=table(spark, d, "orders"))


@query(
    f"""SELECT trim(skill_name) AS skill_name, source, coalesce(endpoint, trim(host)) AS host, sum(invocations) AS invocations,
               sum(sessions) AS sessions FROM ({PARTS}) GROUP BY 1, 2, 3"""
)
def agg10_fleet_skills(spark, d):
    return stats.fleet_skills(_parts(spark, d))


@query(
    f"""WITH p AS (SELECT * EXCLUDE (endpoint), coalesce(endpoint, 'west') AS endpoint FROM ({PARTS})),
             s AS (SELECT endpoint, sum(invocations) AS total FROM p GROUP BY 1)
        SELECT endpoint, 'more sessions than invocations' AS rule, count(*) AS n FROM p WHERE sessions > invocations GROUP BY 1
        UNION ALL SELECT endpoint, 'count not positive', count(*) FROM p WHERE sessions <= 0 OR invocations <= 0 GROUP BY 1
        UNION ALL SELECT endpoint, 'source not asked for', count(*) FROM p WHERE source = '5-LOW' GROUP BY 1
        UNION ALL SELECT endpoint, 'row given twice', count(*) FROM (SELECT endpoint FROM p GROUP BY endpoint, skill_name, source, host
                  HAVING count(*) > 1) GROUP BY 1
        UNION ALL SELECT 'west', 'rows do not add up', 1 FROM s WHERE endpoint = 'west' AND total <> 1
        UNION ALL SELECT 'east', 'control of considered_sessions', 1 UNION ALL SELECT 'west', 'control of unattributed_candidates', 1"""
)
def agg10_skill_violations(spark, d):
    parts = _parts(spark, d).withColumn("endpoint", F.coalesce("endpoint", F.lit("west")))
    total = parts.filter("endpoint = 'east'").agg(F.sum("invocations").alias("attributed_invocations"))
    sources = F.array(*map(F.lit, ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED")))
    side = lambda name, bounded, frame, considered, open_: frame.select(
        F.lit(name).alias("endpoint"), F.lit(bounded).alias("bounded"), sources.alias("sources"), "attributed_invocations",
        F.lit(5).alias("considered_sessions"), F.lit(5).alias("unattributed_candidates"),
        F.col("attributed_invocations").alias("control_attributed_invocations"), F.lit(considered).alias("control_considered_sessions"),
        F.lit(open_).alias("control_unattributed_candidates"),
    )
    one = spark.range(1).select(F.lit(1).cast("long").alias("attributed_invocations"))
    return stats.skill_violations(parts, side("east", True, total, 4, 6).unionByName(side("west", False, one, 5, 6)))


SHA = "0123456789abcdef0123456789abcdef01234567"
# command, normal form
NORMAL = [
    (f"git show {SHA} ", "git show <git-sha>"),
    ("curl https://x.io/v1/123/items/45", "curl https://x.io/v1/<num>/items/<num>"),
    ("ls /data/42/x", "ls /data/<num>/x"),
    ("cat /tmp/a/b/y.txt", "cat <tmp-path>/y.txt"),
    ("cat /private/tmp/run", "cat <tmp-path>"),
    ("cat /tmp/run/", "cat <tmp-path>"),
    ("tail /var/folders/ab/cd/T/log.json /tmp/z", "tail <tmp-path>/log.json <tmp-path>"),
    ("ls /var/folders/ab/c.d/ef", "ls <tmp-path>"),
    ("kubectl logs api-7d9f8b6c5d-x2x9z -f", "kubectl logs <k8s-name> -f"),
    ("kill 123456 12", "kill <num> 12"),
    ("\n echo hi \t", "echo hi"),
    (None, None),
]


@query(expected(normal=[c[1] for c in NORMAL]))
def scl6_normalise_command(spark, d):
    return table(spark, d, "events").select("event_id", scalars.normalise_command(picked([c[0] for c in NORMAL])).alias("normal"))


@query(
    """SELECT id, sha256(concat('ns:content:1:', content)) AS off, sha256(concat('ns:content:1:ctx:2:[', role, '] ', content)) AS with_context,
              sha256(concat('ns:bash:1:', content)) AS command, sha256(concat('ns:content:1:ctx:2:', content)) AS versioned FROM messages""",
    "messages",
)
def scl7_cache_key(spark, d):
    text, context = F.col("content"), F.concat(F.lit("["), "role", F.lit("] "))
    key = lambda kind, *more: scalars.cache_key("ns", F.lit(kind), 1, text, *more)
    return view(spark, d, "messages").select(
        "id", key("content", F.lit(None).cast("string")).alias("off"), key("content", context, 2).alias("with_context"),
        key("bash", context, 2).alias("command"), key("content", F.lit(""), 2).alias("versioned"),
    )


# text, whole number, time, first of a and b
TEXTS = [
    ('{"a": "x", "b": "y", "n": 7, "t": "2025-01-02T03:04:05Z"}', 7, "2025-01-02T03:04:05", "x"),
    ('{"a": "", "b": "y", "n": true, "t": "yesterday"}', None, None, "y"),
    ('{"b": "", "n": "12", "t": "2025-01-02 03:04:05"}', 12, "2025-01-02T03:04:05", None),
    ('{"n": "x"}', None, None, None),
]


@query(expected(number=[c[1] for c in TEXTS], read=[c[2] for c in TEXTS], first=[c[3] for c in TEXTS]))
def scl9_lenient_reads(spark, d):
    rows = table(spark, d, "events").select("event_id", picked([c[0] for c in TEXTS]).alias("j"))
    time = scalars.parsed_time(F.get_json_object("j", "$.t"))
    return rows.select(
        "event_id", scalars.first_int(F.col("j"), "$.n").alias("number"), F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss").alias("read"),
        scalars.first_of(F.col("j"), "$.a", "$.b").alias("first"),
    )


@query(
    """SELECT id, CASE WHEN id % 2 = 0 THEN concat('[', role, '] ') ELSE '' END || content AS fts_content,
              CASE WHEN id % 2 = 0 THEN concat('[', role, '] ') ELSE '' END AS fts_thinking FROM messages WHERE id % 3 <> 0""",
    "messages",
)
def scl13_stale_searchable(spark, d):
    context = F.when(F.col("id") % 2 == 0, F.concat(F.lit("["), "role", F.lit("] ")))
    rows = view(spark, d, "messages").select("id", context.alias("context"), "content", F.lit(None).cast("string").alias("thinking"))
    fresh = F.col("id") % 3 == 0
    written = rows.withColumn("fts_content", F.when(fresh, scalars.searchable(F.col("context"), F.col("content"))))
    return scalars.stale_searchable(written.withColumn("fts_thinking", F.when(fresh, F.coalesce("context", F.lit("")))))


@query(
    """SELECT id, greatest(ended_at, CASE WHEN id % 4 <> 0 THEN make_timestamp(CAST(800000000 + id * 1000 AS BIGINT) * 1000000) END) AS last_activity
       FROM sessions""",
    "sessions",
)
def scl15_last_activity(spark, d):
    mtime = F.when(F.col("id") % 4 != 0, (800000000 + F.col("id") * 1000).cast("double"))
    return reading.with_activity(view(spark, d, "sessions").select("id", "ended_at", mtime.alias("file_mtime"))).select("id", "last_activity")


# path, key
PATHS = [
    ("/h/u/.claude/projects/-w-repo/abc.jsonl", "abc.jsonl"),
    ("/h/projects/x/sessions/2025/01/r.jsonl", "01/r.jsonl"),
    ("/h/sessions/one/two/three.jsonl", "two/three.jsonl"),
    ("/h/other/abc.jsonl", "/h/other/abc.jsonl"),
    ("/h/projects/abc.jsonl", "/h/projects/abc.jsonl"),
]


@query(expected(key=[c[1] for c in PATHS]))
def scl16_transcript_key(spark, d):
    return table(spark, d, "events").select("event_id", scalars.transcript_key(picked([c[0] for c in PATHS])).alias("key"))


# base, sub, pattern
PATTERNS = [("git", "status", "git status"), ("ls", None, "ls *"), ("npm", "", "npm *")]


@query(expected(pattern=[c[2] for c in PATTERNS]))
def scl17_permission_pattern(spark, d):
    pattern = scalars.permission_pattern(picked([c[0] for c in PATTERNS]), picked([c[1] for c in PATTERNS]))
    return table(spark, d, "events").select("event_id", pattern.alias("pattern"))


# host, shown
HOSTS = [
    ("node-1.example_x", "node-1.example_x"), ("my host", '"my host"'), ('a"b\\c', '"a\\"b\\\\c"'), ("é", '"\\u00e9"'),
    ("\U0001f600", '"\\ud83d\\ude00"'), ("tab\there", '"tab\\there"'), ("", '""'), (None, None),
]


@query(expected(shown=[c[1] for c in HOSTS]))
def scl18_host_text(spark, d):
    return table(spark, d, "events").select("event_id", scalars.host_text(picked([c[0] for c in HOSTS])).alias("shown"))


SIZED = "unhex(lpad(to_hex(octet_length(encode({0}))), 16, '0')) || encode({0})"


@query(
    f"""SELECT id, sha256(encode('sha256-length-prefixed-utf8-v1') || '\\x00'::BLOB || {SIZED.format("content")} || {SIZED.format("''")}) AS fingerprint,
               substr(content, 1, 400) AS shown, 4 * (length(content) + length(role)) AS payload FROM messages""",
    "messages",
)
def scl19_fingerprint_and_budget(spark, d):
    content = F.col("content")
    return view(spark, d, "messages").select(
        "id", scalars.content_fingerprint(content, F.lit(None).cast("string")).alias("fingerprint"),
        scalars.truncated(content).alias("shown"), scalars.payload_size(content, F.col("role"), F.lit(None).cast("string")).alias("payload"),
    )


@query(
    """SELECT m.id, m.session_id, CASE WHEN m.id % 2 = 0 THEN 'x' END AS context, s.source, s.host FROM messages m
       JOIN sessions s ON s.id = m.session_id WHERE m.id % 5 <> 0""",
    "messages", "sessions",
)
def jn2_messages_with_state(spark, d):
    messages = view(spark, d, "messages").select("id", "session_id")
    state = messages.filter("id % 5 <> 0").select(F.col("id").alias("message_id"), F.when(F.col("id") % 2 == 0, "x").alias("context"))
    return reading.with_state(messages, state, view(spark, d, "sessions")).select("id", "session_id", "context", "source", "host")


QUEUE = """SELECT event_id AS seq, CASE WHEN event_id % 2 = 0 THEN 'message' ELSE 'tool_call' END AS kind,
                  CASE WHEN event_id % 2 = 0 THEN user_id * 1000 + event_id % 4 ELSE event_id END AS id,
                  CASE WHEN event_id % 7 = 0 THEN 'delete' ELSE 'upsert' END AS op, ts AS queued_at FROM events"""
OWNERS = f"""SELECT q.kind, q.id, s.id AS session_id FROM ({QUEUE}) q LEFT JOIN messages m ON q.kind = 'message' AND m.id = q.id
             LEFT JOIN calls t ON q.kind = 'tool_call' AND t.id = q.id LEFT JOIN sessions s ON s.id = coalesce(m.session_id, t.session_id)"""


def _queue(spark, d):
    return spark.sql(QUEUE.replace("FROM events", "FROM {events}"), events=table(spark, d, "events"))


def _owners(spark, d):
    return ingest.keyword_owners(_queue(spark, d), view(spark, d, "messages"), view(spark, d, "calls"), view(spark, d, "sessions"))


@query(OWNERS, "messages", "calls", "sessions")
def jn16_keyword_owners(spark, d):
    return _owners(spark, d)


@query(
    f"""WITH o AS ({OWNERS}) SELECT c.c_mktsegment AS source, c.c_custkey AS path, c.c_custkey % 4 <> 0 AS bound,
               c.c_custkey % 4 <> 0 AND EXISTS (SELECT 1 FROM o WHERE o.session_id = c.c_custkey) AS pending,
               EXISTS (SELECT 1 FROM o WHERE session_id IS NULL) AS unknown FROM customer c""",
    "messages", "calls", "sessions",
)
def jn14_keyword_membership(spark, d):
    paths = table(spark, d, "customer").select(F.col("c_mktsegment").alias("source"), F.col("c_custkey").alias("path"))
    files = paths.filter("path % 4 <> 0").withColumn("session_id", F.col("path"))
    return ingest.keyword_membership(paths, files, _owners(spark, d))


@query(
    f"""WITH q AS (SELECT *, row_number() OVER (PARTITION BY kind, id ORDER BY queued_at DESC, seq DESC) AS rn FROM ({QUEUE})),
             r AS (SELECT q.*, coalesce(m.content, c.bash_base) AS one FROM q LEFT JOIN messages m ON kind = 'message' AND m.id = q.id
                   LEFT JOIN calls c ON kind = 'tool_call' AND c.id = q.id WHERE rn = 1)
        SELECT seq, kind, id, CASE WHEN op = 'upsert' AND one IS NOT NULL THEN 'upsert' ELSE 'delete' END AS op,
               CASE WHEN op = 'upsert' THEN one END AS one FROM r""",
    "messages", "calls",
)
def inc10_drain(spark, d):
    messages = view(spark, d, "messages").select("id", "content", F.lit(None).cast("string").alias("thinking"))
    calls = view(spark, d, "calls").select("id", F.col("bash_base").alias("bash_command"))
    return ingest.drain(_queue(spark, d), messages, calls).select("seq", "kind", "id", "op", "one")


@query(
    """SELECT root, path, size, CAST(greatest(floor(coalesce(sum(size) OVER w, 0) / 500.0), floor(count(*) OVER w / 6.0)) AS BIGINT) AS chunk
       FROM (SELECT p_brand AS root, p_partkey AS path, p_size AS size FROM part)
       WINDOW w AS (PARTITION BY root ORDER BY path ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"""
)
def inc5_chunks(spark, d):
    files = table(spark, d, "part").select(F.col("p_brand").alias("root"), F.col("p_partkey").alias("path"), F.col("p_size").alias("size"))
    return ingest.chunks(files, 6, 500)


@query(
    """SELECT id, 'orphan' AS side FROM messages WHERE id NOT IN (SELECT vec_id * 1000 FROM embeddings) UNION ALL
       SELECT vec_id * 1000, 'ghost' FROM embeddings WHERE vec_id * 1000 NOT IN (SELECT id FROM messages)""",
    "messages",
)
def set4_index_difference(spark, d):
    index = table(spark, d, "embeddings").select((F.col("vec_id") * 1000).alias("id"))
    return relational.index_difference(view(spark, d, "messages"), index, "id")


@query(
    """SELECT a.vec_id, CAST(len(a.embedding) AS INT) AS width FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id - a.vec_id % 2
       WHERE a.embedding IS DISTINCT FROM b.embedding OR a.vec_id % 5 = 0"""
)
def dml3_changed_vectors(spark, d):
    rows = table(spark, d, "embeddings").select("vec_id", "embedding")
    even = rows.select(F.col("vec_id").alias("even"), F.col("embedding").alias("other"))
    stored = rows.filter("vec_id % 5 <> 0").join(even, F.col("vec_id") - F.col("vec_id") % 2 == F.col("even"))
    found = relational.changed_vectors(stored.select("vec_id", F.col("other").alias("embedding")), rows, "vec_id", "embedding")
    return found.select("vec_id", F.size("embedding").alias("width"))


@query(
    """SELECT count(*) AS observed_paths, count(*) FILTER (id % 3 <> 0) AS indexed_paths, count(*) FILTER (id % 3 = 0) AS unindexed_paths,
              count(*) FILTER (git_repo IS NULL) AS unknown_count FROM sessions""",
    "sessions",
)
def agg12_live_coverage(spark, d):
    return live.live_coverage(_classified(spark, d))[0]


@query(
    """SELECT id AS path FROM sessions WHERE git_repo IS NULL ORDER BY ended_at DESC NULLS LAST, id LIMIT 16""", "sessions"
)
def agg12_unknown_paths(spark, d):
    return live.live_coverage(_classified(spark, d))[1]


def _classified(spark, d):
    rows = view(spark, d, "sessions").select(
        F.col("id").alias("path"), F.when(F.col("id") % 3 != 0, F.col("id")).alias("id"), "git_repo", F.col("ended_at").alias("last_activity")
    )
    return live.three_valued(rows, F.col("git_repo").ilike("%repo1%"))


@query(
    """SELECT m.session_id, min(ts) AS started_at, max(ts) AS ended_at, count(*) AS message_count, coalesce(max(tool_count), 0) AS tool_count,
              date_sub('second', min(ts), max(ts)) AS duration_seconds, max(i) AS input_tokens, max(o) AS output_tokens
       FROM (SELECT user_id AS session_id, ts FROM events) m
       LEFT JOIN (SELECT session_id, count(*) AS tool_count FROM calls WHERE tool_name = 'click' GROUP BY 1) c ON c.session_id = m.session_id
       LEFT JOIN (SELECT user_id AS session_id, sum(CASE WHEN event_id % 2 = 0 THEN CAST(floor(value) AS BIGINT) END) AS i,
                         sum(CASE WHEN event_type = 'error' THEN 1 END) AS o FROM events GROUP BY 1) u ON u.session_id = m.session_id GROUP BY 1""",
    "calls",
)
def agg16_derive_sessions(spark, d):
    events = table(spark, d, "events")
    usage = events.select(
        F.col("user_id").alias("session_id"), F.when(F.col("event_id") % 2 == 0, F.floor("value")).alias("input_tokens"),
        F.when(F.col("event_type") == "error", 1).alias("output_tokens"),
    )
    calls = view(spark, d, "calls").filter("tool_name = 'click'")
    return reading.derive_sessions(events.select(F.col("user_id").alias("session_id"), F.col("ts").alias("at")), calls, usage)


MOVES = "SELECT c_custkey AS before, c_nationkey AS after, c_custkey % 2 = 0 AS proved FROM customer"


@query(
    f"""SELECT class, count(*) AS n FROM (SELECT CASE WHEN NOT proved THEN 'unproved' WHEN count(*) OVER (PARTITION BY before, proved) = 1
               AND count(*) OVER (PARTITION BY after, proved) = 1 THEN 'moved' ELSE 'ambiguous' END AS class FROM ({MOVES})) GROUP BY 1"""
)
def agg17_move_classes(spark, d):
    return stats.move_classes(spark.sql(MOVES.replace("FROM customer", "FROM {customer}"), customer=table(spark, d, "customer")))


@query(
    """SELECT path, CASE WHEN count(*) = 1 THEN max(h) END AS high_water FROM (SELECT source_session_id AS path, id,
              (SELECT max(idx) FROM messages m WHERE m.session_id = s.id) AS h FROM sessions s) GROUP BY 1""",
    "sessions", "messages",
)
def agg15_high_water_of_path(spark, d):
    rows = view(spark, d, "sessions").select("id", F.col("source_session_id").alias("path"))
    return stats.high_water_of_path(rows, view(spark, d, "messages"))


# offset, size, missing, generation, wanted, signature, signature now, boundary, readable -> limits
STATES = [
    (9, 9, False, 2, 2, "a", "a", True, True, ""),
    (5, 9, False, 2, 2, "a", "a", True, True, "behind"),
    (5, 9, True, 2, 3, "a", "b", True, True, "catalog_source_missing,behind,generation,signature"),
    (0, 9, False, 0, 0, None, "a", None, None, "not_yet_indexed,behind,signature"),
    (9, 9, False, 2, 2, None, None, False, False, "boundary,unreadable"),
]
STATE_NAMES = ("offset", "size", "missing", "generation", "wanted", "signature", "signature_now", "boundary_ok", "readable")


def _states(spark, d):
    rows = table(spark, d, "events")
    columns = [picked([c[i] for c in STATES]).alias(n) for i, n in enumerate(STATE_NAMES)]
    return live.full_freshness(rows.select("event_id", F.lit("s").alias("source"), *columns))


@query(expected(limitations=[c[9] for c in STATES], current=[c[9] == "" for c in STATES], lag_bytes=[c[1] - c[0] for c in STATES]))
def liv5_full_freshness(spark, d):
    return _states(spark, d).select("event_id", "limitations", "current", "lag_bytes")


@query("SELECT event_id FROM events WHERE event_id % 5 IN (1, 4)")
def liv8_catch_up(spark, d):
    return live.catch_up(_states(spark, d)).select("event_id")


@query(
    """SELECT id, ended_at FROM (SELECT id, ended_at FROM sessions ORDER BY ended_at DESC NULLS LAST, id LIMIT 256) WHERE id % 4 <> 0""", "sessions"
)
def liv7_page_without_dead(spark, d):
    rows = view(spark, d, "sessions").select("id", F.col("ended_at").alias("last_activity"))
    return reading.live_page(rows, 256, keep=F.col("id") % 4 != 0).select("id", F.col("last_activity").alias("ended_at"))


@query(
    """SELECT path, id, arm, observed_write, CASE WHEN path % 2 = 0 THEN path % 4 = 0 END AS pid_alive FROM (
         SELECT c_custkey AS path, CASE WHEN c_custkey % 3 = 0 THEN c_custkey END AS id,
                CASE WHEN c_custkey % 3 = 0 THEN 'indexed' ELSE 'catalogued' END AS arm, c_acctbal >= 5000 AS observed_write FROM customer)"""
)
def liv1_marked_roster(spark, d):
    c = table(spark, d, "customer").withColumn("path", F.col("c_custkey"))
    files = c.select("path", F.lit(True).alias("present"), F.col("c_acctbal").alias("mtime"))
    rows = live.roster(c.filter("path % 3 = 0").select("path", F.col("path").alias("id")), files, c.filter("false").select("path"), 5000)
    even = c.filter("path % 2 = 0").select("path", (F.col("path") % 4 == 0).alias("pid_alive"))
    old = even.select("path", (~F.col("pid_alive")).alias("pid_alive"), F.lit(1).alias("marked_at"))
    marks = old.unionByName(even.withColumn("marked_at", F.lit(2)))
    return live.marked_roster(rows, marks).drop("marked_at")


@query(
    """SELECT host, id, started_at FROM (SELECT CASE WHEN host = 'local' THEN 'east' ELSE host END AS host, id, started_at FROM sessions)
       ORDER BY started_at DESC NULLS LAST, host, id LIMIT 100""",
    "sessions",
)
def srt9_merge_lists(spark, d):
    rows = view(spark, d, "sessions").select(
        F.lit("east").alias("endpoint"), F.when(F.col("host") != "local", F.col("host")).otherwise(" ").alias("host"), "id", "started_at"
    )
    # a second endpoint tells the same rows, with earlier times
    again = rows.withColumn("started_at", F.col("started_at") - F.expr("INTERVAL 1 DAY"))
    return live.merge_lists(rows.unionByName(again), "started_at", 100).drop("endpoint")


@query(
    """SELECT m.id, m.idx, (SELECT string_agg(CAST(c.id AS VARCHAR), ',' ORDER BY c.idx) FROM calls c WHERE c.session_id = 3 AND c.idx = m.idx) AS calls
       FROM (SELECT * FROM messages WHERE session_id = 3 ORDER BY idx DESC LIMIT 5) m""",
    "messages", "calls",
)
def ses3_tail_with_calls(spark, d):
    rows = reading.load_tail(view(spark, d, "messages"), _owned_calls(spark, d), 3, tail=5, tools=True)
    joined = F.array_join(F.transform("tool_calls", lambda c: c["id"].cast("string")), ",")
    return rows.select("id", "idx", F.when(F.size("tool_calls") > 0, joined).alias("calls"))


@query("SELECT id, session_id, idx FROM (SELECT * FROM messages WHERE session_id = 3 ORDER BY idx DESC LIMIT 100)", "messages")
def srt6_reset_cursor(spark, d):
    messages = view(spark, d, "messages").withColumn("session_id", F.col("session_id").cast("string"))
    calls = _owned_calls(spark, d).withColumn("session_id", F.col("session_id").cast("string"))
    rows, _ = reading.read_behind(messages, calls, "3", reading.encode_cursor("3", 1, epoch=4), epoch=5)
    return rows.select("id", F.col("session_id").cast("long").alias("session_id"), "idx")


@query(
    """SELECT m.id, m.role <> 'user' AND m.idx % 2 = 1 AS is_target FROM messages m JOIN sessions s ON s.id = m.session_id
       WHERE coalesce(s.ended_at, s.started_at) >= TIMESTAMP '1995-01-01'
       AND EXISTS (SELECT 1 FROM messages t WHERE t.session_id = m.session_id AND t.role <> 'user' AND t.idx % 2 = 1)""",
    "messages", "sessions",
)
def ses5_recompute_groups(spark, d):
    from datetime import datetime

    sessions = view(spark, d, "sessions").withColumn("indexed_at", F.lit(None).cast("timestamp_ntz"))
    messages = view(spark, d, "messages").select(
        "id", "session_id", F.when(F.col("role") != "user", F.col("content")).alias("content"), F.lit(None).cast("string").alias("thinking"),
        F.when(F.col("idx") % 2 == 1, "template").alias("context_mode"),
    )
    return reading.recompute_groups(sessions, messages, datetime(1995, 1, 1), "template").select("id", "is_target")


@query(
    """WITH w AS (SELECT id, ended_at, input_tokens FROM sessions WHERE ended_at <= TIMESTAMP '1998-01-01' - INTERVAL 600 SECOND)
       SELECT id, (SELECT count(*) FROM w) AS waiting, (SELECT coalesce(sum(input_tokens), 0) FROM w) AS waiting_size FROM w ORDER BY ended_at, id LIMIT 25""",
    "sessions",
)
def emb1_pending_with_totals(spark, d):
    from datetime import datetime

    rows = view(spark, d, "sessions").select("id", F.col("ended_at").alias("last_activity"), "input_tokens")
    return enrich.pending_with_totals(rows, "input_tokens", 25, datetime(1998, 1, 1)).select("id", "waiting", "waiting_size")


@query(
    """SELECT id, concat('[', coalesce(CASE WHEN id % 3 = 0 THEN 'r' END, 'w'), ' ', coalesce(CASE WHEN id % 2 = 0 THEN 'main' END, 'HEAD'), '] ')
              AS context, 'template' AS context_mode, 0 AS context_version FROM messages""",
    "messages",
)
def emb6_template_contexts(spark, d):
    rows = view(spark, d, "messages").select(
        "id", "content", F.when(F.col("id") % 3 == 0, "r").alias("repo"), F.lit("/x/w").alias("cwd"), F.when(F.col("id") % 2 == 0, "main").alias("branch")
    )
    return enrich.contexts(rows, "template")


@query("SELECT id, CASE WHEN input_tokens IS NOT NULL THEN input_tokens END AS input_tokens, source FROM sessions", "sessions")
def snk2_project(spark, d):
    rows = view(spark, d, "sessions").select("id", "host", "source", F.struct("input_tokens", "output_tokens").alias("usage"))
    return output.project(rows, ["id", "usage.input_tokens", "source"]).select("id", "usage.input_tokens", "source")


@query(
    """SELECT 'no result with the tool Bash, which leaves out message text; ' || count(*) || ' without it, '
               || count(*) FILTER (lexical) || ' of them by keyword' AS note FROM (SELECT id % 2 = 0 AS lexical FROM messages)""",
    "messages",
)
def snk3_guidance(spark, d):
    rows = view(spark, d, "messages").select("id", (F.col("id") % 2 == 0).alias("lexical_match"))
    note = output.guidance(rows.filter("false"), "Bash", lambda: rows)
    return spark.createDataFrame([(note,)], "note string")




@query(
    """SELECT c_custkey AS path, CASE WHEN c_custkey % 7 = 0 THEN 'created' WHEN c_custkey % 7 = 1 THEN 'removed' WHEN c_custkey % 7 = 2 THEN 'replaced'
              WHEN c_custkey % 7 = 3 THEN 'truncated' WHEN c_custkey % 7 = 4 THEN 'appended' ELSE 'rewritten' END AS change
       FROM customer WHERE c_custkey % 7 < 6"""
)
def str3_file_changes(spark, d):
    rows = table(spark, d, "customer").select(
        F.col("c_custkey").alias("path"), F.lit(5).alias("mtime"), (100 + F.col("c_nationkey")).alias("size"), F.col("c_custkey").alias("inode")
    )
    part = F.col("path") % 7
    after = rows.filter(part != 1).withColumns(
        {
            "inode": F.when(part == 2, -F.col("inode")).otherwise(F.col("inode")),
            "size": F.col("size") + F.when(part == 3, -1).when(part == 4, 1).otherwise(0),
            "mtime": F.when(part == 5, 6).otherwise(F.col("mtime")),
        }
    )
    return ingest.file_changes(rows.filter(part != 0), after)


@query(
    """SELECT user_id AS path, min(ts) AS first, max(ts) AS last, count(*) AS n FROM (
         SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM (
           SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 12 HOUR THEN 0 ELSE 1 END AS fresh FROM events))
       GROUP BY user_id, run"""
)
def str4_debounced(spark, d):
    changes = table(spark, d, "events").select(F.col("user_id").alias("path"), F.col("ts").alias("at"))
    return ingest.debounced(changes, "12 hours")
