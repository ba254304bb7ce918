"""Packing: the closed form against a simulated round-robin, whole coverage, rare sources, a bounded memo."""

import heapq
import time
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from turnstone.llm import packing


def simulated(queues, windows, window):
    """Tokens given before each window when every token in turn goes to the source that waits longest for its share."""
    given, out, at = [0] * len(queues), [], 0
    waits = [(Fraction(1, n), i) for i, n in enumerate(queues) if n]
    heapq.heapify(waits)
    for k in range(windows + 1):
        while at < min(k * window, sum(queues)):
            _, i = heapq.heappop(waits)
            given[i] += 1
            at += 1
            if given[i] < queues[i]:
                heapq.heappush(waits, (Fraction(2 * given[i] + 1, queues[i]), i))
        out.append(list(given))
    return np.array(out)


@pytest.mark.parametrize("queues", [[5], [1, 999], [300, 300, 300], [1, 3, 500, 7, 1234, 99], [17] * 40])
def test_served_is_a_deficit_round_robin(queues):
    window = 64
    last = -(-sum(queues) // window)
    got = packing.served(np.arange(last + 1), np.array(queues), window)
    assert (got == simulated(queues, last, window)).all()


def placed(queues, spans):
    q, a, b = (np.array(x, np.int64) for x in zip(*spans, strict=True))
    found = [np.stack(t, axis=1) for t in packing.pieces(q, a, b, np.array(queues, np.int64))]
    return [tuple(map(int, r)) for t in found for r in t]


@pytest.mark.parametrize("cells", [1 << 21, 8])
def test_every_token_in_one_piece(monkeypatch, cells):
    monkeypatch.setattr(packing, "CELLS", cells)
    monkeypatch.setattr(packing, "WINDOW", 32)
    monkeypatch.setattr(packing.served, "__defaults__", (32,))
    rng = np.random.default_rng(2)
    queues = [1, 2, 700, 40, 2500]
    spans = []
    for i, n in enumerate(queues):
        cuts = sorted({0, n, *rng.integers(0, n + 1, 1 + n // 30).tolist()})
        spans += [(i, a, b) for a, b in zip(cuts, cuts[1:])]
    pieces = placed(queues, spans)
    seats = {}
    for row, a, b, window, offset in pieces:
        for k in range(a, b):
            seat = (window, offset + k - a)
            assert seat not in seats and offset + b - a <= 32
            seats[seat] = (spans[row][0], k)
    assert len(set(seats.values())) == len(seats) == sum(queues)
    assert sorted(seats) == [divmod(i, 32) for i in range(sum(queues))]


def test_a_rare_source_costs_as_much_as_its_pieces():
    queues = [100, 10**12, 10**12 // 3]
    began = time.process_time()
    pieces = placed(queues, [(0, 0, 60), (0, 60, 100), (1, 10**11, 10**11 + 5000)])
    assert time.process_time() - began < 2
    assert sum(b - a for r, a, b, *_ in pieces if r < 2) == 100 and len({w for r, _, _, w, _ in pieces if r < 2}) == 100
    assert sum(b - a for r, a, b, *_ in pieces if r == 2) == 5000


@pytest.mark.parametrize(("memo", "group"), [(500_000, 1 << 22), (50, 300)])
def test_memo_is_bounded_and_changes_nothing(monkeypatch, memo, group):
    from tokenizers import Tokenizer

    monkeypatch.setattr(packing, "MEMO", memo)
    monkeypatch.setattr(packing, "GROUP", group)
    tok, own = Tokenizer.from_file(packing.tokenizer_path()), packing.WordIds(packing.tokenizer_path())
    words = [f"{a}{b}{c}" for a in ("Lo", "mi", "É") for b in ("na", "x9", "..") for c in ("", "!", "ß,", "|", " ")]
    texts = [" ".join(words[i % 45] + "y" * (i % 7) for i in range(k, k + 90)) for k in range(40)] + ["", "  ", "z" * 2000, None]
    got = list(own.all_texts(pa.array(texts, pa.string()).fill_null(""), 2))
    ids, sizes = np.concatenate([x for x, _ in got]), np.concatenate([n for _, n in got])
    assert len(sizes) == len(texts)
    for t, x in zip(texts, np.split(ids, np.cumsum(sizes)[:-1]), strict=True):
        assert x.tolist() == [*tok.encode(t or "", add_special_tokens=False).ids, 2]
    own._trim()
    assert len(own.keys) <= memo
