import pytest

from turnstone.operators import enrich, ingest, live, search


def test_moves_need_proof_and_a_single_partner(spark):
    heads = "array<struct<offset:int,digest:string>>"
    gone = spark.createDataFrame([("a", 3, "x", "n1"), ("b", 3, "y", "n2"), ("c", 3, "z", "n3"), ("d", 3, "z", None)],
                                 "path string, offset int, prefix_digest string, native string")
    came = spark.createDataFrame(
        [("a2", 9, [(3, "x")], "n1"), ("b2", 9, [(3, "other")], "n2"), ("c2", 9, [(3, "z")], "n3"), ("c3", 9, [(3, "z")], "n3")],
        f"path string, size int, heads {heads}, native string",
    )
    assert [tuple(r) for r in ingest.detect_moves(gone, came, "native").collect()] == [("a", "a2")]


def test_each_missing_key_is_inferred_once(spark):
    targets = spark.createDataFrame([(1, "k", "a b"), (2, "k", "a b"), (3, "c", "x"), (4, "e", None)], "id long, key string, text string")
    cache = spark.createDataFrame([("c", [1.0, 0.0])], "key string, vector array<double>")
    all_, fresh = enrich.embed_missing(targets, cache, enrich.hashed_backend(2))
    got = {r["id"]: r["vector"] for r in all_.collect()}
    assert set(got) == {1, 2, 3, 4} and got[1] == got[2] and got[3] == [1.0, 0.0] and got[4] == [0.0, 0.0]
    assert sorted(r["key"] for r in fresh.collect()) == ["e", "k"]


def test_runs_hold_their_budget():
    assert enrich.runs([], 4) == []
    sizes = [5, 1, 1, 3, 2, 8]
    made = enrich.runs(sizes, 8)
    assert sorted(i for run in made for i in run) == list(range(6))
    assert all(len(run) * max(sizes[i] for i in run) <= 8 for run in made)
    with pytest.raises(ValueError):
        enrich.runs([9], 8)


def test_session_names(spark):
    rows = spark.createDataFrame([("abcdef01", "s"), ("abcdef02", "s"), ("ffffff00", "abcdef01")], "id string, source_session_id string")
    name = lambda x: [r["id"] for r in search.resolve_session(rows, x)]
    assert name("abcdef01") == ["abcdef01"] and name("s") == ["abcdef01", "abcdef02"]
    assert name("abcdef") == ["abcdef01", "abcdef02"] and name("abc") == [] and name("zz") == []


def test_modes_and_watch_order(spark):
    assert [search.resolve_mode(*x) for x in (("auto", None, True), ("auto", None, False), ("vector", "Bash", True), ("vector", None, False))] == [
        "hybrid", "keyword", "keyword", "vector"]
    sessions = spark.createDataFrame([("p", 1), ("p", 2)], "path string, id long")
    assert [tuple(r) for r in live.watched_sessions(["q", "p"], sessions).select("path", "id").collect()] == [("q", None), ("p", 1), ("p", 2)]
