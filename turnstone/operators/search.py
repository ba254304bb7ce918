"""Keyword (BM25 over a stored index), vector and fused search.

The keyword index holds stems (Porter) with their places in each field of a row, so that phrases,
prefixes and fields are answered from it. It is built once, stored sorted by term and read by term: a
query never reads the texts. `keyword_search` builds one in passing for tables that have none.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import quality
from ..functions.stemming import tokens, words

# Fixed values of the ranking.
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
RRF = 60


class Phrase(NamedTuple):
    """Stems that stand one behind the other; the last may be the beginning of a stem."""

    terms: tuple[str, ...]
    prefix: bool


class Index(NamedTuple):
    postings: DataFrame  # term, field, key, positions
    lengths: DataFrame  # key, length: stems of all fields, of every row


def parse_query(text: str) -> list[Phrase]:
    """Quoted runs are phrases; others are words, each of which may end in `*`. All must occur."""
    out = []
    for quoted, bare in re.findall(r'"([^"]*)"|(\w+\*?)', text):
        prefix = len(bare) > 1 and bare.endswith("*")
        terms = tuple(tokens(quoted or bare.rstrip("*")))
        if terms:
            out.append(Phrase(terms, prefix))
    return out


PLACES = T.ArrayType(T.StructType([T.StructField("term", T.StringType()), T.StructField("positions", T.ArrayType(T.IntegerType()))]))


def _places(cut: Callable[[str | None], list[str]]):
    def of(t):
        found: dict[str, list[int]] = {}
        for i, term in enumerate(cut(t)):
            found.setdefault(term, []).append(i)
        return [{"term": k, "positions": v} for k, v in found.items()]

    def places(text: pd.Series) -> pd.Series:
        return text.map(of)

    return F.pandas_udf(places, PLACES)


def build_index(docs: DataFrame, key: str, *fields: str, stemmed: bool = True) -> Index:
    """Postings are made where a row stands: nothing is shuffled. Searches need stems; statistics may be of the words themselves."""
    places = _places(tokens if stemmed else words)
    rows = docs.select(F.col(key).alias("key"), *[places(F.col(f)).alias(f) for f in fields])
    each = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("found")) for f in fields])
    by_field = rows.select("key", F.explode(each).alias("x")).select("key", "x.field", F.explode("x.found").alias("p"))
    count = lambda f: F.aggregate(f, F.lit(0), lambda n, p: n + F.size(p["positions"]))
    lengths = rows.select("key", reduce(Column.__add__, [count(f) for f in fields]).alias("length"))
    return Index(by_field.select("p.term", "field", "key", "p.positions"), lengths)


def write_index(index: Index, path: str) -> None:
    """Ranges of (term, key): a frequent term is split, and a reader skips what holds none of its terms."""
    index.postings.repartitionByRange("term", "key").sortWithinPartitions("term", "key").write.mode("overwrite").parquet(f"{path}/postings")
    index.lengths.write.mode("overwrite").parquet(f"{path}/lengths")


def read_index(spark: SparkSession, path: str) -> Index:
    return Index(spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/lengths"))


def index_statistics(index: Index) -> DataFrame:
    """Rows and occurrences of every term."""
    return index.postings.groupBy("term").agg(F.countDistinct("key").alias("df"), F.sum(F.size("positions")).alias("occurrences"))


def corpus_statistics(index: Index) -> DataFrame:
    """One row: rows and the mean of their lengths."""
    return index.lengths.agg(F.count("*").alias("n"), F.avg("length").alias("mean"))


def _matches(phrase: Phrase, j: int) -> Column:
    term = F.col("term")
    return term.startswith(phrase.terms[j]) if phrase.prefix and j == len(phrase.terms) - 1 else term == phrase.terms[j]


def _moved(places: Column, back: int) -> Column:
    return F.transform(places, lambda at: at - back)


def _frequencies(index: Index, phrases: list[Phrase], fields: tuple[str, ...]) -> DataFrame:
    """key, f0, f1, ...: how often each phrase stands in a row."""
    wanted = reduce(Column.__or__, [_matches(p, j) for p in phrases for j in range(len(p.terms))])
    some = index.postings.filter(wanted)
    if fields:
        some = some.filter(F.col("field").isin(*fields))
    ints = "array<int>"
    # the place a phrase would begin at, for each of its words
    begins = [
        F.flatten(F.collect_list(F.when(_matches(p, j), _moved(F.col("positions"), j)))).alias(f"p{i}_{j}")
        for i, p in enumerate(phrases)
        for j in range(len(p.terms))
    ]
    placed = some.groupBy("key", "field").agg(*begins)
    often = [
        F.size(reduce(F.array_intersect, [F.coalesce(F.col(f"p{i}_{j}"), F.array().cast(ints)) for j in range(len(p.terms))])).alias(f"f{i}")
        for i, p in enumerate(phrases)
    ]
    return placed.select("key", *often).groupBy("key").agg(*[F.sum(f"f{i}").alias(f"f{i}") for i in range(len(phrases))])


def search_index(
    index: Index,
    query: str,
    limit: int = 20,
    fields: tuple[str, ...] = (),
    candidates: DataFrame | None = None,
    offset: int = 0,
) -> DataFrame:
    """(key, score) of rows that hold all of a query's phrases, in the fields asked for (none: all). Statistics are the
    whole table's; candidates (key) restrict only what is shown. Equal scores stand in order of their key."""
    phrases = parse_query(query)
    if not phrases or limit <= 0:
        return index.lengths.select("key").limit(0).withColumn("score", F.lit(0.0))
    counts = [f"f{i}" for i in range(len(phrases))]
    often = _frequencies(index, phrases, fields)
    held = often.agg(*[F.count_if(F.col(c) > 0).alias(f"d{c}") for c in counts])
    all_ = reduce(Column.__and__, [F.col(c) > 0 for c in counts])
    # both sides are one row
    stats = corpus_statistics(index).join(held)
    found = often.filter(all_).join(index.lengths, "key").join(F.broadcast(stats))
    score: Column = F.lit(0.0)
    for c in counts:
        tf, df = F.col(c), F.col(f"d{c}")
        idf = F.log((F.col("n") - df + 0.5) / (df + 0.5))
        idf = F.when(idf <= 0, LEAST_IDF).otherwise(idf)
        score = score + idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("length") / F.col("mean")))
    scored = found.select("key", score.alias("score"))
    if candidates is not None:
        scored = scored.join(candidates.select("key"), "key", "left_semi")
    ranked = scored.orderBy(F.desc("score"), "key")
    return (ranked.offset(offset) if offset else ranked).limit(limit)


def keyword_search(
    docs: DataFrame, query: str, key: str, fields: tuple[str, ...], limit: int = 20, candidates: DataFrame | None = None, offset: int = 0
) -> DataFrame:
    """search_index over an index of docs made in passing; fields are those that are indexed."""
    some = None if candidates is None else candidates.select(F.col(key).alias("key"))
    found = search_index(build_index(docs, key, *fields), query, limit, (), some, offset)
    return found.withColumnRenamed("key", key)


def command_search(calls: DataFrame, query: str, limit: int = 20, candidates: DataFrame | None = None) -> DataFrame:
    """Tool calls by the words of their shell commands."""
    return keyword_search(calls, query, "id", ("bash_command",), limit, candidates)


def cosine(vector: Column, query: list[float]) -> Column:
    """In double precision against a literal: no join."""
    q = F.array(*[F.lit(float(x)) for x in query])
    dot = F.aggregate(F.zip_with(vector, q, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, x: s + x)
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return dot / F.nullif(norm * float(sum(x * x for x in query) ** 0.5), F.lit(0.0))


def vector_search(rows: DataFrame, key: str, columns: tuple[str, ...], query: list[float], limit: int = 20) -> DataFrame:
    """Score is the best cosine of the vectors a row has; ids are ranked before any payload is joined."""
    scores = [F.when(F.col(c).isNotNull(), cosine(F.col(c), query)) for c in columns]
    best = F.greatest(*scores) if len(scores) > 1 else scores[0]
    return rows.select(key, best.alias("score")).filter("score is not null").orderBy(F.desc("score"), key).limit(limit)


def with_quality(found: DataFrame, messages: DataFrame, key: str) -> DataFrame:
    """Scores times the quality of the message they are of; found is a top list, so only its rows' texts are looked at.
    What is no message keeps its score."""
    texts = messages.select(key, "role", "content").join(F.broadcast(found.select(key)), key, "left_semi")
    weighed = texts.select(key, quality(F.col("role"), F.col("content")).alias("quality"))
    rest = [c for c in found.columns if c not in (key, "score")]
    score = F.col("score") * F.coalesce("quality", F.lit(1.0))
    return found.join(weighed, key, "left").select(key, score.alias("score"), *rest)


def fuse(keyword: DataFrame, vector: DataFrame, key: str, limit: int = 20, messages: DataFrame | None = None) -> DataFrame:
    """Reciprocal-rank fusion; both legs are top lists already. With messages (key, role, content) a fused score is
    weighed by quality before rows are ordered: by score, keyword score, vector score, key."""

    def ranked(leg: DataFrame, name: str) -> DataFrame:
        by = Window.orderBy(F.desc("score"), key)
        return leg.select(key, F.col("score").alias(name), F.row_number().over(by).alias(f"{name}_rank"))

    part = lambda name: F.coalesce(1.0 / (RRF + F.col(f"{name}_rank")), F.lit(0.0))
    both = ranked(keyword, "bm25").join(ranked(vector, "cosine"), key, "full_outer")
    fused = both.select(
        key, (part("bm25") + part("cosine")).alias("score"), "bm25", "cosine", F.col("bm25").isNotNull().alias("lexical_match")
    )
    if messages is not None:
        fused = with_quality(fused, messages, key)
    return fused.orderBy(F.desc("score"), F.desc_nulls_last("bm25"), F.desc_nulls_last("cosine"), key).limit(limit)


def search_all(messages: DataFrame, calls: DataFrame, key: str, limit: int = 20) -> DataFrame:
    """Both legs' top lists (key, score), messages already weighed by quality, as one list."""
    both = messages.select(F.lit("message").alias("kind"), key, "score").unionByName(
        calls.select(F.lit("call").alias("kind"), key, "score")
    )
    return both.orderBy(F.desc("score"), "kind", key).limit(limit)


def keyword_all(messages: DataFrame, calls: DataFrame, query: str, fields: tuple[str, ...] = ("content",), limit: int = 20) -> DataFrame:
    """The best messages (id, role, content, ...) and calls (id, bash_command) as one list."""
    said = with_quality(keyword_search(messages, query, "id", fields, limit), messages, "id")
    return search_all(said, command_search(calls, query, limit), "id", limit)


def vector_all(
    messages: DataFrame, calls: DataFrame, query: list[float], columns: tuple[str, ...] = ("vector",), limit: int = 20
) -> DataFrame:
    """As keyword_all, by vectors: messages (id, role, content, columns), calls (id, vector)."""
    said = with_quality(vector_search(messages, "id", columns, query, limit), messages, "id")
    return search_all(said, vector_search(calls, "id", ("vector",), query, limit), "id", limit)


def by_tool(calls: DataFrame, tool: str) -> DataFrame:
    return calls.filter(F.lower("tool_name") == tool.lower())


def stamp_host(found: DataFrame, sessions: DataFrame) -> DataFrame:
    """The session's host; blank, null or no session is `local`."""
    hosts = sessions.select(F.col("id").alias("session_id"), F.nullif(F.trim("host"), F.lit("")).alias("host"))
    return found.join(hosts, "session_id", "left").withColumn("host", F.coalesce("host", F.lit("local")))


def resolve_mode(asked: str, tool: str | None, has_vectors: bool) -> str:
    """A tool filter makes it keyword; auto is hybrid where vectors exist, else keyword."""
    if tool or asked == "auto" and not has_vectors:
        return "keyword"
    return "hybrid" if asked == "auto" else asked


def plan_search(asked: str, tool: str | None, has_vectors: bool, embed: Callable[[], list[float]]) -> tuple[str, list[float] | None]:
    """The mode and, where it needs one, the query's vector. Where embedding fails auto falls back to keyword; a mode
    that was asked for by name fails with it."""
    mode = resolve_mode(asked, tool, has_vectors)
    if mode == "keyword":
        return mode, None
    try:
        return mode, embed()
    except Exception:
        if asked != "auto":
            raise
        return "keyword", None


class SessionNameError(ValueError):
    """A name for no session, for several, or for one outside the scope asked for."""


def resolve_session(sessions: DataFrame, identifier: str, most: int = 20) -> list:
    """The rows an identifier names: an exact id, else an exact source id, else 6 to 31 hex digits of an id's start.
    At most `most` + 1 rows come to the driver; more than one is ambiguous."""
    rungs = [F.col("id") == identifier, F.col("source_session_id") == identifier]
    if re.fullmatch("[0-9a-f]{6,31}", identifier):
        rungs.append(F.col("id").startswith(identifier))
    for rung in rungs:
        if found := sessions.filter(rung).orderBy("id").limit(most + 1).collect():
            return found
    return []


def one_session(sessions: DataFrame, identifier: str, scope: Column | None = None, most: int = 20):
    """The one row an identifier names, within the scope."""
    found = resolve_session(sessions, identifier, most)
    if not found:
        raise SessionNameError(f"session not found: {identifier}")
    if len(found) > 1:
        more = " and more" if len(found) > most else ""
        raise SessionNameError(f"{identifier} is ambiguous: {', '.join(r['id'] for r in found[:most])}{more}")
    if scope is not None and not sessions.filter((F.col("id") == found[0]["id"]) & scope).limit(1).count():
        raise SessionNameError(f"session {found[0]['id']} lies outside the scope asked for")
    return found[0]
