"""The whole pipeline on odd rows, each stage against a plain version of it."""

from collections import Counter

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F
from test_documents import texts_of
from test_near_copies import brute_left
from turnstone.llm import language_id, mixing, near_copies, packing


def rows_of(frame):
    return Counter(map(tuple, frame.collect()))


def test_stages_on_odd_rows(spark, nasty, tmp_path):
    docs, left = nasty, {}
    for name, step in corpus_pipeline.STAGES:
        out = step(spark, docs, "")
        path = str(tmp_path / name)
        out.write.parquet(path)
        left[name] = spark.read.parquet(path)
        if name != "packing":
            assert left[name].columns == nasty.columns
        docs = left[name]

    # language: what the operator's own prediction accepts
    accepted = Counter((r["doc_id"],) for r in language_id.identify(nasty).filter("accepted").collect())
    assert Counter((r["doc_id"],) for r in left["language_id"].collect()) == accepted and accepted
    # exact copies: one row of each text
    assert Counter(t for _, t in texts_of(left["exact_dedup"])) == Counter({t for _, t in texts_of(left["language_id"])})
    # near copies: one row of each component of Jaccard 0.8, the smallest id
    before = sorted(texts_of(left["exact_dedup"]), key=lambda r: (r[0] is None, r[0] or 0))
    stays = brute_left(tuple(t for _, t in before))
    assert Counter(t for _, t in texts_of(left["simhash_dedup"])) == Counter(before[i][1] for i in stays)
    # mixing: each row as often as the operator's copies say
    copies = {(r["doc_id"], r["text_hash"]): r["copies"] for r in mixing.mix_documents(left["simhash_dedup"]).collect()}
    hashed = lambda frame: Counter(map(tuple, frame.select("doc_id", F.xxhash64(F.coalesce("text", F.lit("")))).collect()))
    assert hashed(left["mix_sources"]) == Counter({k: n for k, n in copies.items() if n})
    # packing: every token of every row in one piece
    pieces = left["packing"].collect()
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.tokenizer_path())
    want = Counter()
    for i, t in texts_of(left["mix_sources"]):
        want[i] += len(tok.encode(t, add_special_tokens=False).ids) + 1
    got = Counter()
    for r in pieces:
        got[r["doc_id"]] += r["length"]
    assert got == want


def test_run_is_its_stages(spark):
    got = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert got.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] and got.count() > 0


def test_empty_documents_go_through(spark, empty):
    docs = empty
    for _, step in corpus_pipeline.STAGES:
        docs = step(spark, docs, "")
        assert docs.count() == 0


@pytest.mark.parametrize("tile", [3, 256])
def test_large_groups_of_near_copies(spark, monkeypatch, tile):
    """One group of many like texts, a chain whose ends are not alike, and texts that share a passage."""
    monkeypatch.setattr(near_copies, "TILE", tile)
    rng = np.random.default_rng(6)
    base = [f"w{i}" for i in rng.integers(0, 10**6, 120)]
    texts = [" ".join(base[:k] + [f"x{i}"] + base[k + 1 :]) for i, k in enumerate(rng.integers(0, 120, 40).tolist())]
    chain = list(base) + ["chain"]
    for step in range(14):
        chain = chain[6:] + [f"c{step}-{i}" for i in range(6)]
        texts.append(" ".join(chain))
    shared = [f"s{i}" for i in range(60)]
    texts += [" ".join([f"a{i}-{j}" for j in range(40)] + shared) for i in range(12)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"] for r in near_copies.keep_one_each(docs).collect()}
    assert got == brute_left(tuple(texts))


def test_what_was_staged_is_deleted(spark, nasty):
    from pathlib import Path

    from turnstone.llm import common, embed_dedup, license_scan, pii

    folder = Path(common.run_folder(spark).removeprefix("file:"))
    before = set(folder.iterdir()) if folder.exists() else set()
    left = lambda: {p.name.rsplit("-", 1)[0] for p in set(folder.iterdir()) - before}
    pii.scan_pii(nasty).count()
    assert left() == {"pii", "gained"}
    license_scan.scan_licenses(nasty).count()
    mixing.apply_mix(nasty).count()
    assert left() == {"pii", "gained", "licenses"}
    near_copies.keep_one_each(nasty).count()
    vectors = spark.createDataFrame([(i, [float(i % 3), 1.0], 0) for i in range(9)], "vec_id long, embedding array<float>, label int")
    embed_dedup.embedding_links(vectors).count()
    assert left() == {"pii", "gained", "licenses", "marks", "coded", "linked"}
    common.drop_run(spark)
    assert not folder.exists()
