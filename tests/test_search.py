"""Keyword search against an independent full-text engine on the same texts, and what surrounds it."""

import random
import re
import sqlite3

import pytest
from turnstone.functions import stemming
from turnstone.operators import search

WORDS = (
    "run runs running runner ran fox foxes red reds café Cafe naïve relational relate hopping hoped agreed feed caresses ponies ties skies "
    "happy sky electricity electrical formaliti decisive x 42 a_b über ÜBER İstanbul test tests testing retest"
).split()
QUERIES = (
    "run", "running fox", '"red fox"', '"fox red" run', "te*", "hop* caress", "cafe", "CAFÉ", '"a b"', "a_b", "relat*", "agree", "sky tie", "absent",
    'red "run', "uber", '"running foxes" 42', '""', "happi electr*",
)


@pytest.fixture(scope="module")
def texts():
    chance = random.Random(7)
    some = lambda n: " ".join(chance.choice(WORDS) + chance.choice(["", "", ",", ".", "!"]) for _ in range(chance.randrange(n)))
    rows = [(i, some(40), some(8)) for i in range(300)]
    return [*rows, (300, "", ""), (301, None, None), (302, "...", "!!")]


@pytest.fixture(scope="module")
def engine(texts):
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE t USING fts5(content, thinking, tokenize='porter unicode61')")
    con.executemany("INSERT INTO t(rowid, content, thinking) VALUES (?, ?, ?)", [(i, a or "", b or "") for i, a, b in texts])
    return con


@pytest.fixture(scope="module")
def stored(spark, texts, tmp_path_factory):
    docs = spark.createDataFrame(texts, "id long, content string, thinking string").repartition(3)
    path = str(tmp_path_factory.mktemp("index"))
    search.write_index(search.build_index(docs, "id", "content", "thinking"), path)
    return search.read_index(spark, path)


def asked(engine, query, field=None):
    """The query as the engine reads it: quoted runs and words, all of which must occur."""
    parts = []
    for quoted, bare in re.findall(r'"([^"]*)"|([^\s"]+)', query):
        parts.append(f'"{quoted or bare.rstrip("*")}"' + "*" * bare.endswith("*") if quoted.strip() or bare else "")
    match = " ".join(p for p in parts if p)
    if not match:
        return []
    match = f"{{{field}}}: ({match})" if field else match
    sql = "SELECT rowid, -bm25(t) FROM t WHERE t MATCH ? ORDER BY bm25(t), rowid LIMIT 25"
    return [(i, s) for i, s in engine.execute(sql, [match])]


@pytest.mark.parametrize("field", [None, "thinking"])
def test_same_rows_and_scores_as_the_engine(engine, stored, field):
    for query in QUERIES:
        found = search.search_index(stored, query, 25, (field,) if field else ()).collect()
        want = asked(engine, query, field)
        assert [r["score"] for r in found] == pytest.approx([s for _, s in want]), query
        last = want[-1][1] if len(want) == 25 else -1
        # rows that tie with the last one shown may differ by rounding
        assert {r["key"] for r in found if r["score"] > last + 1e-9} == {i for i, s in want if s > last + 1e-9}, query


def test_candidates_and_pages_leave_statistics_alone(spark, stored):
    whole = [tuple(r) for r in search.search_index(stored, "run", 1000).collect()]
    some = spark.createDataFrame([(i,) for i in range(0, 300, 3)], "key long")
    got = [tuple(r) for r in search.search_index(stored, "run", 7, candidates=some, offset=2).collect()]
    assert got == [r for r in whole if r[0] % 3 == 0 and r[0] < 300][2:9]
    assert search.search_index(stored, "  ").count() == search.search_index(stored, "run", 0).count() == 0


def test_a_stored_index_is_read_by_term(stored):
    plan = search.search_index(stored, "run")._jdf.queryExecution().toString()
    assert "PushedFilters" in plan and "EqualTo(term,run)" in plan.replace(" ", "")


def test_query_terms():
    assert search.parse_query('a "b c" d* "e" fo_o "  "') == [
        (("a",), False), (("b", "c"), False), (("d",), True), (("e",), False), (("fo", "o"), False)]


def test_stems():
    pairs = {"caresses": "caress", "ponies": "poni", "feed": "feed", "agreed": "agre", "hopping": "hop", "falling": "fall", "filing": "file",
             "sky": "sky", "happy": "happi", "relational": "relat", "electricity": "electr", "adjustment": "adjust", "controll": "control"}
    assert {w: stemming.stem(w) for w in pairs} == pairs
    assert stemming.tokens("Ünïcode’s naïve_x 9") == ["unicod", "s", "naiv", "x", "9"] and stemming.tokens(None) == []


def test_quality_weighs_the_fused_order(spark):
    leg = lambda rows: spark.createDataFrame(rows, "id long, score double")
    said = spark.createDataFrame([(1, "user", "<command-name>x"), (2, "user", "y")], "id long, role string, content string")
    got = search.fuse(leg([(1, 3.0), (2, 2.0)]), leg([(1, 0.9), (9, 0.8)]), "id", messages=said).collect()
    assert [r["id"] for r in got] == [2, 9, 1] and got[2]["score"] == pytest.approx(2 / 61 / 4)


def test_modes_fall_back_only_where_auto_was_asked():
    def fails():
        raise RuntimeError("no model")

    assert search.plan_search("auto", None, True, fails) == ("keyword", None)
    assert search.plan_search("auto", None, True, lambda: [1.0]) == ("hybrid", [1.0])
    assert search.plan_search("vector", "Bash", True, fails) == ("keyword", None)
    with pytest.raises(RuntimeError):
        search.plan_search("vector", None, True, fails)


def test_names_that_do_not_name_one_session(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([("abcdef01", "s", "x"), ("abcdef02", "s", "y")], "id string, source_session_id string, host string")
    assert search.one_session(rows, "abcdef01", F.col("host") == "x")["id"] == "abcdef01"
    for name, scope in (("s", None), ("nothing", None), ("abcdef", None), ("abcdef01", F.col("host") == "y")):
        with pytest.raises(search.SessionNameError):
            search.one_session(rows, name, scope)


def test_statistics_of_words_count_no_other_word_of_their_stem(spark):
    texts = [(0, "of ofed Of"), (1, "reds red"), (2, "ofing"), (3, None)]
    docs = spark.createDataFrame(texts, "id long, content string")
    count = lambda index: {r["term"]: (r["df"], r["occurrences"]) for r in search.index_statistics(index).collect()}
    assert count(search.build_index(docs, "id", "content", stemmed=False)) == {"of": (1, 2), "ofed": (1, 1), "ofing": (1, 1), "reds": (1, 1), "red": (1, 1)}
    assert count(search.build_index(docs, "id", "content")) == {"of": (2, 4), "red": (1, 2)}


def test_term_statistics_match_their_sql_on_words_of_one_stem(spark, tmp_path):
    import duckdb
    from turnstone.plans.catalogue import ORACLE_SQL, QUERIES

    rows = [(0, 0, "user", "a plan of ofed things"), (0, 1, "assistant", "ofing boxing reds tos as aing"), (1, 0, "user", None), (2, 0, "user", "boxes of 7 7s")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    got = QUERIES["agg19_term_statistics"](spark, str(tmp_path)).select("term", "df", "occurrences").collect()
    want = con.execute(f"SELECT term, df, occurrences FROM ({ORACLE_SQL['agg19_term_statistics']})").fetchall()
    assert sorted(map(tuple, got)) == sorted(want)
