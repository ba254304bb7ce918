"""What is to be read, what may be resumed, what moved, and how parsed facts enter the tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .relational import without

MOVE_CANDIDATES = 16


def pending(now) -> Column:
    """Behind its generation, not read to its end, or failed; not missing, and its retry is due."""
    behind = (F.col("desired_generation") > F.col("committed_generation")) | (F.col("committed_offset") < F.col("size"))
    return (behind | F.col("last_error").isNotNull()) & ~F.col("missing") & (F.col("next_retry_at") <= now)


def is_current() -> Column:
    return (
        ~F.col("missing")
        & (F.col("committed_generation") > 0)
        & (F.col("desired_generation") == F.col("committed_generation"))
        & (F.col("committed_offset") == F.col("size"))
        & F.coalesce(F.col("last_error") == "unsupported", F.lit(True))
    )


def priority_lanes(files: DataFrame, active: Column, recent_since, each: int = 85) -> DataFrame:
    """The first files of three lanes: active by turn, recent newest first, and oldest of all by turn. Each lane is a
    top-k of its own, so no file is sorted that cannot be shown; one file may stand in two lanes."""
    turn = [F.col("waiting_since"), F.col("path")]
    lane = lambda rows, name, *by: rows.orderBy(*by).limit(each).select("path", F.lit(name).alias("lane"))
    return (
        lane(files.filter(active), "active", *turn)
        .unionByName(lane(files.filter(~active & (F.col("mtime") >= recent_since)), "recent", F.desc("mtime"), F.col("path")))
        .unionByName(lane(files, "oldest", *turn))
    )


def resume_plan(catalog: DataFrame, seen: DataFrame, revision: str) -> DataFrame:
    """Per seen file: unchanged, resume (and where) or full, and why. A file resumes only if the parser, the file's
    identity and the digest of its committed prefix, computed anew, are all as recorded."""
    old = catalog.select("path", "parser_revision", "inode", "committed_offset", "prefix_digest")
    now = seen.select("path", F.col("inode").alias("inode_now"), "size", F.col("prefix_digest").alias("digest_now"))
    why = (
        F.when(F.col("committed_offset").isNull(), "new")
        .when(~F.col("parser_revision").eqNullSafe(F.lit(revision)), "parser")
        .when(~F.col("inode").eqNullSafe(F.col("inode_now")), "identity")
        .when(F.col("size") < F.col("committed_offset"), "truncated")
        .when(~F.col("prefix_digest").eqNullSafe(F.col("digest_now")), "prefix")
        .otherwise("proved")
    )
    rows = now.join(old, "path", "left").withColumn("why", why)
    proved = F.col("why") == "proved"
    plan = F.when(~proved, "full").when(F.col("size") == F.col("committed_offset"), "unchanged").otherwise("resume")
    return rows.select("path", plan.alias("plan"), "why", F.when(proved, F.col("committed_offset")).otherwise(0).alias("start"))


def commit_guard(parsed: DataFrame, captured: DataFrame) -> DataFrame:
    """Parses that may replace history: complete, and of the bytes that are still there."""
    now = captured.select("path", F.col("digest").alias("digest_now"))
    return parsed.join(now, "path").filter(F.col("complete") & (F.col("digest") == F.col("digest_now"))).drop("digest_now")


def detect_moves(departed: DataFrame, arrived: DataFrame, *evidence: str) -> DataFrame:
    """(path, offset, prefix_digest, evidence...) of files that left, and (path, size, heads: array of (offset, digest),
    evidence...) of files that came. A pair shares some evidence, and the arrival's digest at the old offset proves
    it; it counts only if neither side has another partner. A value shared by more than MOVE_CANDIDATES departed files
    proves nothing and is left out before the join, which bounds a hot value's pairs.
    """
    pairs = []
    for name in evidence:
        old = departed.filter(F.col(name).isNotNull())
        crowd = old.groupBy(name).agg(F.count("*").alias("n")).filter(F.col("n") <= MOVE_CANDIDATES)
        old = old.join(crowd.select(name), name, "left_semi").select(name, F.col("path").alias("before"), "offset", "prefix_digest")
        pairs.append(old.join(arrived.select(name, "path", "size", "heads"), name).drop(name))
    near = reduce(DataFrame.unionByName, pairs).filter("before <> path and offset <= size")
    proved = F.exists("heads", lambda h: (h["offset"] == F.col("offset")) & (h["digest"] == F.col("prefix_digest")))
    found = near.filter(proved).select("before", F.col("path").alias("after")).distinct()
    alone = lambda c: F.count("*").over(Window.partitionBy(c)) == 1
    return found.withColumn("only", alone("before") & alone("after")).filter("only").drop("only")


def supersede(rows: DataFrame, moves: DataFrame, key: str) -> DataFrame:
    """Rows under a moved key take the new one."""
    names = moves.select(F.col("before").alias(key), "after")
    return rows.join(names, key, "left").select(*[F.coalesce("after", key).alias(key) if c == key else c for c in rows.columns])


def mark_vanished(catalog: DataFrame, walked: DataFrame) -> DataFrame:
    """After a complete walk: absent files are missing. moves_allowed is false for a root of which the walk found
    nothing, or lost more than half."""
    here = walked.select("path").distinct().withColumn("found", F.lit(True))
    rows = catalog.join(here, "path", "left").withColumn("found", F.coalesce("found", F.lit(False)))
    roots = rows.groupBy("root").agg(F.count_if("found").alias("kept"), F.count("*").alias("known"))
    return rows.join(roots, "root").select(
        "path", "root", (~F.col("found")).alias("missing"),
        ((F.col("kept") > 0) & (F.col("kept") * 2 >= F.col("known"))).alias("moves_allowed"),
    )


def pair_results(calls: DataFrame, results: DataFrame) -> DataFrame:
    """Results with the call they answer, within a session; others are dropped. Of two results of a call the later stays."""
    last = results.groupBy("session_id", "tool_use_id").agg(F.max(F.struct("at", "summary")).alias("r")).select(
        "session_id", "tool_use_id", "r.summary", "r.at"
    )
    return calls.filter("tool_use_id is not null").select("id", "session_id", "tool_use_id").join(last, ["session_id", "tool_use_id"])


def retire(rows: DataFrame, kept: DataFrame, scope: str, *keys: str) -> DataFrame:
    """Of sessions in kept, only the kept keys stay; other sessions keep all theirs."""
    touched = kept.select(scope).distinct().withColumn("touched", F.lit(True))
    known = kept.select(*keys).distinct().withColumn("known", F.lit(True))
    marked = rows.join(touched, scope, "left").join(known, list(keys), "left")
    return marked.filter("touched is null or known").select(*rows.columns)


def delete_sessions(gone: DataFrame, **tables: tuple[DataFrame, str]) -> dict[str, DataFrame]:
    """name=(rows, session column): every table without the sessions that go."""
    return {n: without(rows, gone.select(F.col("id").alias(c)), c) for n, (rows, c) in tables.items()}


def reopen_parked(files: DataFrame, revisions: DataFrame) -> DataFrame:
    """Parked files whose recorded parser revision is no longer that of revisions (parser, revision)."""
    parked = files.filter("last_error = 'unsupported'").withColumn("was", F.get_json_object("detail", "$.revision"))
    return parked.join(revisions, "parser").filter(~F.col("was").eqNullSafe(F.col("revision"))).drop("was", "revision")


def write_if_distinct(table: DataFrame, fresh: DataFrame, key: str, payload: list[str]) -> DataFrame:
    """The rows of fresh that differ from the table's, nulls equal; new keys are written."""
    old = table.select(F.col(key).alias("_k"), F.struct(*payload).alias("_old"))
    both = fresh.withColumn("_new", F.struct(*payload)).join(old, F.col(key) == F.col("_k"), "left")
    return both.filter(F.col("_k").isNull() | ~F.col("_old").eqNullSafe(F.col("_new"))).select(*fresh.columns)


def keyword_owners(queue: DataFrame, messages: DataFrame, calls: DataFrame, sessions: DataFrame) -> DataFrame:
    """queue (kind, id) -> kind, id, session_id: the session of the message or call that waits for the keyword index; NULL
    where nothing is known of it."""
    said = messages.select(F.col("id").alias("_m"), F.col("session_id").alias("_ms"))
    made = calls.select(F.col("id").alias("_t"), F.col("session_id").alias("_ts"))
    owner = (
        queue.join(said, (F.col("kind") == "message") & (F.col("id") == F.col("_m")), "left")
        .join(made, (F.col("kind") == "tool_call") & (F.col("id") == F.col("_t")), "left")
        .select("kind", "id", F.coalesce("_ms", "_ts").alias("_s"))
    )
    known = sessions.select(F.col("id").alias("session_id"))
    return owner.join(known, F.col("_s") == F.col("session_id"), "left").select("kind", "id", "session_id")


def keyword_membership(selected: DataFrame, files: DataFrame, owners: DataFrame) -> DataFrame:
    """selected (source, path), files (source, path, session_id), owners as keyword_owners gives them -> per path whether it
    is bound to a session, whether that one waits for the index, and whether anything waits that has no session."""
    waiting = owners.filter("session_id is not null").select("session_id").distinct().withColumn("pending", F.lit(True))
    stray = owners.agg(F.coalesce(F.max(F.col("session_id").isNull()), F.lit(False)).alias("unknown"))
    rows = selected.join(files, ["source", "path"], "left").join(waiting, "session_id", "left")
    return rows.join(F.broadcast(stray)).select(
        "source", "path", F.col("session_id").isNotNull().alias("bound"), F.coalesce("pending", F.lit(False)).alias("pending"), "unknown"
    )


def drain(queue: DataFrame, messages: DataFrame, calls: DataFrame) -> DataFrame:
    """queue (seq, kind, id, op, queued_at) -> what the index has to do: of each row only the last order by time and
    sequence; an upsert of a row that is not there any more is a delete. messages (id, content, thinking), calls (id, bash_command)."""
    last = queue.groupBy("kind", "id").agg(F.max(F.struct("queued_at", "seq", "op")).alias("r"))
    said = messages.select(F.lit("message").alias("kind"), "id", F.coalesce("content", F.lit("")).alias("one"), F.coalesce("thinking", F.lit("")).alias("two"))
    made = calls.select(F.lit("tool_call").alias("kind"), "id", F.col("bash_command").alias("one"), F.lit(None).cast("string").alias("two"))
    rows = last.select("kind", "id", "r.*").join(said.unionByName(made), ["kind", "id"], "left")
    op = F.when((F.col("op") == "upsert") & F.col("one").isNotNull(), "upsert").otherwise("delete")
    keep = lambda c: F.when(op == "upsert", F.col(c)).alias(c)
    return rows.select("seq", "queued_at", "kind", "id", op.alias("op"), keep("one"), keep("two")).orderBy("queued_at", "seq")


#: What one chunk of work may hold: files, and bytes.
CHUNK_FILES, CHUNK_BYTES = 512, 8 << 20


def chunk_options(size: int | None = CHUNK_BYTES, files: int = CHUNK_FILES) -> dict[str, str]:
    """Options of a file stream whose batches are bounded in bytes, or where size is None in files: a stream takes one bound."""
    return {"maxBytesPerTrigger": str(size)} if size else {"maxFilesPerTrigger": str(files)}


def chunks(files: DataFrame, most: int = CHUNK_FILES, size: int = CHUNK_BYTES) -> DataFrame:
    """files (root, path, size) with the number of their chunk within the root. A chunk is closed by the first file that
    passes a bound, so a file above it is a chunk's last; bounds are counted over all files before."""
    by = Window.partitionBy("root").orderBy("path").rowsBetween(Window.unboundedPreceding, -1)
    bytes_before = F.coalesce(F.sum("size").over(by), F.lit(0))
    files_before = F.count("*").over(by)
    number = F.greatest(F.floor(bytes_before / size), F.floor(files_before / most))
    return files.withColumn("chunk", number.cast("long"))


def file_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Two walks (path, mtime, size, inode) -> path, change: what appeared, went, was replaced by another file, shrank, grew
    or was written over."""
    old = before.select("path", F.struct("mtime", "size", "inode").alias("old"))
    new = after.select("path", F.struct("mtime", "size", "inode").alias("new"))
    kind = (
        F.when(F.col("old").isNull(), "created")
        .when(F.col("new").isNull(), "removed")
        .when(~F.col("old.inode").eqNullSafe(F.col("new.inode")), "replaced")
        .when(F.col("new.size") < F.col("old.size"), "truncated")
        .when(F.col("new.size") > F.col("old.size"), "appended")
        .when(~F.col("old.mtime").eqNullSafe(F.col("new.mtime")), "rewritten")
    )
    return old.join(new, "path", "full_outer").select("path", kind.alias("change")).filter("change is not null")


def debounced(changes: DataFrame, quiet: str, late: str | None = None) -> DataFrame:
    """changes (path, at) -> path, first, last, n: changes of a path no more than `quiet` apart are one, told when the path has
    been still for so long. Of a stream, `late` is how much later than others a change may come."""
    rows = changes.withWatermark("at", late) if late is not None else changes
    return rows.groupBy("path", F.session_window("at", quiet).alias("w")).agg(
        F.min("at").alias("first"), F.max("at").alias("last"), F.count("*").alias("n")
    ).drop("w")
