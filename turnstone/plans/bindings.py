"""The model's tables over the driver's tables, as SQL that Spark and DuckDB read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Every tool with commands of its own, every destructive one, and some of neither.
BASES = (
    "git", "kubectl", "docker", "npm", "yarn", "pnpm", "cargo", "go", "uv", "pip", "brew", "apt", "systemctl", "rm", "sudo", "chmod",
    "chown", "dd", "mkfs", "mount", "umount", "shutdown", "reboot", "kill", "killall", "ls", " ", "make", "mv",
)


def literal(value) -> str:
    """A constant of SQL that both engines read alike."""
    if value is None:
        return "NULL"
    return str(value).upper() if isinstance(value, (bool, int)) else "'" + value.replace("'", "''") + "'"


def cases(key: str, values) -> str:
    """The value of a list that a number picks, in turn."""
    arms = " ".join(f"WHEN {i} THEN {literal(v)}" for i, v in enumerate(values))
    return f"CASE CAST({key} % {len(values)} AS INT) {arms} END"


CALLS = f"""
    SELECT event_id AS id, user_id AS session_id, event_type AS tool_name, ts, value,
           CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS idx,
           CASE WHEN event_type IN ('click', 'purchase', 'error') THEN {cases("event_id", BASES)} END AS bash_base,
           CASE WHEN event_id % 29 < 13 THEN event_type WHEN event_id % 29 = 27 THEN '' END AS bash_sub,
           event_id % 11 = 0 AS is_compound,
           CASE WHEN event_id % 3 = 0 THEN 1 END AS agent
    FROM events
"""
SESSIONS = """
    SELECT o_orderkey AS id, o_custkey AS source_session_id, o_orderpriority AS source, c_mktsegment AS model,
           CASE WHEN o_orderkey % 13 = 0 THEN 'local' ELSE n_name END AS host,
           CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE concat('repo', CAST(o_custkey % 60 AS VARCHAR(10))) END AS git_repo,
           o_orderdate AS started_at, CASE WHEN o_orderstatus <> 'O' THEN o_orderdate + INTERVAL '1' HOUR END AS ended_at,
           CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE CAST(floor(o_totalprice) AS BIGINT) END AS input_tokens,
           CASE WHEN o_orderkey % 7 IN (0, 1) THEN NULL ELSE CAST(floor(o_totalprice / 10) AS BIGINT) END AS output_tokens,
           CASE WHEN o_orderkey % 3 = 0 OR o_orderpriority = '5-LOW' THEN NULL
                ELSE CAST(floor(o_totalprice / 4) AS BIGINT) END AS cached_tokens
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
"""
MESSAGES = "SELECT conv_id * 1000 + turn AS id, conv_id AS session_id, turn AS idx, role, text AS content FROM conversations"
RESULTS = "SELECT l_orderkey AS session_id, l_linenumber AS idx, l_linestatus, l_quantity FROM lineitem"

VIEWS = {"calls": CALLS, "sessions": SESSIONS, "messages": MESSAGES, "results": RESULTS}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sql, frames = VIEWS[name], {}
    for t in ("events", "orders", "customer", "nation", "conversations", "lineitem"):
        for word in ("FROM", "JOIN"):
            if f"{word} {t}" in sql:
                sql = sql.replace(f"{word} {t}", f"{word} {{{t}}}")
                frames[t] = table(spark, sf_dir, t)
    return spark.sql(sql, **frames)


def with_views(sql: str, *names: str) -> str:
    """SQL behind the views' definitions."""
    defined = "WITH " + ", ".join(f"{n} AS ({VIEWS[n]})" for n in names)
    own = sql.lstrip()
    return f"{defined}, {own[5:]}" if own.startswith("WITH ") else f"{defined} {own}"
