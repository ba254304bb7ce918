import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from turnstone.llm import embed_dedup, warc
from turnstone.llm.common import fresh_path


def test_warc_round_trip(spark):
    big, other = "<p>é" + "x" * 1500, "y" * 998 + "é"
    pages = [(1, big), (7, big), (7, big), (3, "small"), (4, "small"), (5, None), (None, big), (9, other), (8, other)]
    frame = spark.createDataFrame([(i, f"http://a.b/{i}\r\nX: y", h, "c") for i, h in pages], "page_id long, url string, html string, sha string")
    got = warc.round_trip(frame.repartition(2)).collect()
    assert Counter((r["page_id"], r["payload_bytes"], r["payload_digest"]) for r in got) == Counter(
        (i, len((h or "").encode()), hashlib.sha1((h or "").encode()).hexdigest()) for i, h in pages
    )
    by = defaultdict(list)
    for r in got:
        by[r["page_id"]].append((r["record_type"], r["refers_to"]))
    assert sorted(by[7], key=repr) == [("response", None), ("revisit", 7)]
    assert by[1] == by[None] == [("revisit", 7)] and by[9] == [("response", None)] and by[8] == [("revisit", 9)]
    assert by[3] == by[4] == by[5] == [("response", None)]
    assert warc.round_trip(frame.limit(0)).count() == 0


def test_members_stand_alone(spark, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 3000)
    pages = spark.createDataFrame([(i, "u", "z" * 700 + str(i)) for i in range(20)], "page_id long, url string, html string")
    raw, clean = fresh_path(spark, "raw"), fresh_path(spark, "clean")
    assert warc.write_archives(warc.assign_records(pages), raw).count() > 1
    assert warc.normalise_archives(spark, raw, clean).agg({"records": "sum"}).first()[0] == 20
    assert sorted(r["page_id"] for r in warc.read_archives(spark, clean).collect()) == list(range(20))


def test_archives_of_lost_attempts_are_not_read(spark):
    pages = spark.createDataFrame([(i, "u", "z" * 700 + str(i)) for i in range(20)], "page_id long, url string, html string")
    raw, clean = fresh_path(spark, "raw"), fresh_path(spark, "clean")
    lost = warc.write_archives(warc.assign_records(pages), raw).collect()
    listed = spark.createDataFrame(warc.write_archives(warc.assign_records(pages), raw).collect(), "name string, bytes long")
    assert not {r["name"] for r in lost} & {r["name"] for r in listed.collect()}
    warc.normalise_archives(spark, raw, clean, listed).count()
    done = spark.createDataFrame(warc.normalise_archives(spark, raw, clean, listed).collect(), "name string, records long")
    assert sorted(r["page_id"] for r in warc.read_archives(spark, clean, done).collect()) == list(range(20))


def test_a_record_longer_than_an_archive(spark, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 3000)
    pages = spark.createDataFrame([(1, "u", "é" * 50_000), (2, "u", "é" * 50_000), (3, "v", "x")], "page_id long, url string, html string")
    got = sorted(map(tuple, warc.round_trip(pages.coalesce(1)).select("page_id", "payload_bytes", "record_type", "refers_to").collect()))
    assert got == [(1, 100_000, "revisit", 2), (2, 100_000, "response", None), (3, 1, "response", None)]


def test_cut_archives_raise():
    data = warc._gzip(warc.record_bytes(1, "u", b"abc", "d", None) * 2)
    assert len(list(warc.stream_records(warc.inflate(data)))) == 2
    assert len(list(warc.stream_records(warc.inflate(data + data)))) == 4
    with pytest.raises(ValueError):
        list(warc.stream_records(warc.inflate(data[:-12])))


def brute(rows):
    unit = {}
    for k, (_, v, label) in enumerate(rows):
        if label is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v):
            x = np.asarray(v, np.float64)
            unit[k] = x / np.linalg.norm(x)
    links = defaultdict(set)
    for i in unit:
        for j in unit:
            if i != j and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.98:
                links[i].add(j)
    out = []
    for k, (vec, _, _) in enumerate(rows):
        seen, todo = {k}, [k]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        low = min(rows[j][0] for j in seen)
        out.append((vec, len(links[k]), low, vec == low))
    return sorted(out)


@pytest.mark.parametrize("tile", [1024, 3])
def test_embeddings(spark, monkeypatch, tile):
    monkeypatch.setattr(embed_dedup, "TILE", tile)
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((30, 32))
    rows = [(i, list(map(float, np.float32(centres[i % 30] + 0.05 * rng.standard_normal(32)))), i % 2) for i in range(240)]
    rows += [(500 + i, rows[4][1], 0) for i in range(5)] + [rows[4], rows[4]]
    rows += [(600, None, 0), (601, [0.0] * 32, 0), (602, [float("nan")] * 32, 0), (603, [None] * 32, 0), (604, rows[4][1], None)]
    rows += [(605, rows[4][1][:16], 0), (606, [x * 8 for x in rows[4][1]], 0)]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, cid string")
    got = sorted(map(tuple, embed_dedup.embedding_links(frame).collect()))
    want = brute(rows)
    found, there = sum(r[1] for r in got), sum(r[1] for r in want)
    assert [r[0] for r in got] == [r[0] for r in want] and 0.98 * there <= found <= there
    assert embed_dedup.embedding_links(frame.limit(0)).count() == 0


def test_share_of_pairs_found_on_whole_table(spark):
    frame = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in frame.collect()]
    want, got = brute(rows), embed_dedup.embedding_links(frame).collect()
    assert sum(r["n_links"] for r in got) >= 0.95 * sum(r[1] for r in want)
