"""Vector links against brute force: counts, components and kept rows, hot groups, ties at the threshold, odd rows."""

import numpy as np
import pytest
from turnstone.llm import embed_dedup

from test_pages_vectors import brute

SHAPE = "vec_id long, embedding array<float>, label int, cid string"


def frame_of(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [x if x is None else float(x) for x in v], l, "x") for i, v, l in rows], SHAPE)


def clusters(rng, groups, width, noise, label=lambda k: k % 3):
    rows = []
    for k, n in enumerate(groups):
        centre = rng.standard_normal(width)
        centre /= np.linalg.norm(centre)
        for _ in range(n):
            rows.append((len(rows) + 10, np.float32(centre + noise * rng.standard_normal(width) / np.sqrt(width)), label(k)))
    return rows


@pytest.mark.parametrize("tile", [256, 7])
def test_rows_equal_brute_force(spark, monkeypatch, tile):
    monkeypatch.setattr(embed_dedup, "TILE", tile)
    rng = np.random.default_rng(8)
    rows = clusters(rng, [1] * 60 + [2] * 20 + [5, 9, 60], 48, 0.12)
    rows += [(3, rows[-1][1], rows[-1][2]), rows[-1], (2, rows[0][1], 1), (1, 4 * rows[0][1], rows[0][2]), (0, rows[0][1], None)]
    got = sorted(map(tuple, embed_dedup.embedding_links(frame_of(spark, rows)).collect()))
    assert got == brute(rows)


def test_chains_have_one_component_and_no_link_below_the_threshold(spark):
    step = np.arccos(0.981)
    rows = [(i, np.float32([np.cos(i * step), np.sin(i * step), 0, 0]), 0) for i in range(25)]
    rows += [(100, np.float32([1, 0, np.tan(np.arccos(0.9795)), 0]), 0), (101, np.float32([0, 0, 0, 5]), 0)]
    want = brute(rows)
    got = sorted(map(tuple, embed_dedup.embedding_links(frame_of(spark, rows)).collect()))
    assert all(a[1] <= b[1] for a, b in zip(got, want, strict=True))
    assert sum(r[1] for r in got) >= 0.95 * sum(r[1] for r in want)
    assert got[25:] == [(100, 0, 100, True), (101, 0, 101, True)]


def test_pairs_at_and_just_below_the_threshold(spark):
    rows = [(1, [1.0, 0, 0, 0], 0), (2, [0.98, 0.198997487421324, 0, 0], 0), (3, [0, 0, 1.0, 0], 1), (4, [0, 0, 0.97, 0.243104915623], 1)]
    want = brute([(i, np.float32(v), l) for i, v, l in rows])
    assert sorted(map(tuple, embed_dedup.embedding_links(frame_of(spark, rows)).collect())) == want


def test_planted_pairs_are_met(spark):
    rng = np.random.default_rng(1)
    for width, rows in ((64, 50_000), (64, 10**9), (300, 10**6), (5, 1000)):
        known = rng.standard_normal((2000, width)) + 0.3
        known /= np.linalg.norm(known, axis=1, keepdims=True)
        coder = embed_dedup.learn(known, width, rows)
        aside = rng.standard_normal(known.shape)
        aside -= (aside * known).sum(axis=1, keepdims=True) * known
        other = 0.98 * known + np.sqrt(1 - 0.98**2) * aside / np.linalg.norm(aside, axis=1, keepdims=True)
        (a, la), (b, lb) = embed_dedup.code(known, coder), embed_dedup.code(other, coder)
        assert (a == b).any(axis=1).mean() > 0.985
        assert (np.bitwise_count(a ^ b).sum(axis=1) <= coder.radius).mean() > 0.999
        assert (np.bitwise_count(la ^ lb) <= coder.sift).mean() > 0.999


def test_codes_are_balanced():
    rng = np.random.default_rng(3)
    known = rng.standard_normal((3000, 32)) * np.linspace(0.2, 2, 32) + 1
    known /= np.linalg.norm(known, axis=1, keepdims=True)
    coder = embed_dedup.learn(known, 32, 3000)
    bits = (known - coder.mean) @ coder.rotation > 0
    assert abs(bits.mean(axis=0) - 0.5).max() < 0.1
