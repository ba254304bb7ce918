"""SimHash near-dedup with bit-sliced comparison.

Equal fingerprints are one class before anything is compared. Classes meet in buckets: the 64 bits
are cut in BLOCKS parts, and two fingerprints that differ in at most RADIUS bits agree on BLOCKS -
RADIUS of them, so every choice of that many parts is a table. Buckets above SPLIT members are
dealt again by each third of the other bits, which loses no pair by the same argument. Within a
bucket fingerprints are stored as bit planes; a query's difference to 64 fingerprints a word is
added plane by plane into carry-save counters, and a block whose counters have all passed the radius is
left. Links found in a bucket come out as stars of its components, never as pairs.

Null text counts as empty and has fingerprint zero, linked like any other. Repeated rows share a
fingerprint and so a component. A null doc_id sorts above every other. Other columns are ignored.
"""

from __future__ import annotations

from itertools import chain, combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import TEXT_BATCH, keep_rows, mix64, one_of_each, stage, staging, text_hash, whole_text
from .graph import connected_components

# Fixed values of the contract.
SHINGLE = 3
SEED = 42
RADIUS = 2

BLOCKS = 4
SPLIT = 2048
#: Shingles whose bits are counted at once, queries compared at once.
SLAB = 1 << 16
QUERIES = 64


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(b" ".join(words), SEED)]
    else:
        digest, join = xxhash.xxh64_intdigest, b" ".join
        hashes = [digest(join(x), SEED) for x in zip(*(words[i:] for i in range(shingle)), strict=False)]
    votes = np.zeros(64, np.int64)
    for i in range(0, len(hashes), SLAB):
        part = np.array(hashes[i : i + SLAB], dtype=">u8")
        votes += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * votes > len(hashes)).tobytes(), "big")


def wide_print(hashes: np.ndarray, words: int) -> np.ndarray:
    """A SimHash of 64 * words bits: each word votes on its own mix of the shingles' hashes."""
    out = np.zeros(words, np.uint64)
    for w in range(words):
        votes = np.zeros(64, np.int64)
        for i in range(0, len(hashes), SLAB):
            mixed = mix64(hashes[i : i + SLAB] + np.uint64(0x9E3779B97F4A7C15 * (w + 1) % 2**64))
            votes += np.unpackbits(mixed.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        out[w] = np.packbits(2 * votes > len(hashes), bitorder="little").view("<u8")[0]
    return out


def planes(prints: np.ndarray) -> np.ndarray:
    """prints (n, words) -> (64 * words, blocks): bit j of block w of plane b is bit b of fingerprint 64 * w + j."""
    n, bits = len(prints), np.unpackbits(np.ascontiguousarray(prints).astype("<u8").view(np.uint8), axis=1, bitorder="little")
    rows = np.zeros((bits.shape[1], -(-n // 64) * 64), np.uint8)
    rows[:, :n] = bits.T
    return np.packbits(rows, axis=1, bitorder="little").view("<u8")


def near(prints: np.ndarray, radius: int = RADIUS):
    """Pairs (i, j), i < j, of fingerprints (n,) or (n, words) within radius, in slabs of queries against
    blocks of 64 * 256 fingerprints. Distances are counted in carry-save counters, bit by bit of the count, that
    start so far below their overflow as the radius is wide: what overflows has passed it.
    """
    prints = prints.reshape(len(prints), -1)
    n, full = len(prints), np.uint64(2**64 - 1)
    stored = planes(prints)
    ones = np.unpackbits(stored.view(np.uint8), axis=1).sum(axis=1, dtype=np.int64)
    varying = np.flatnonzero((ones > 0) & (ones < n))
    width = int(radius + 1).bit_length()
    first = 2**width - (radius + 1)
    for q in range(0, n, QUERIES):
        asked = prints[q : q + QUERIES]
        flips = [np.where((asked[:, b // 64] >> np.uint64(b % 64)) & np.uint64(1), full, np.uint64(0)) for b in varying.tolist()]
        for w in range(q // 64, stored.shape[1], 256):
            block = stored[:, w : w + 256]
            shape = (len(asked), block.shape[1])
            counter = [np.full(shape, full if first >> k & 1 else 0, np.uint64) for k in range(width)]
            over = np.zeros(shape, np.uint64)
            for at, b in enumerate(varying.tolist()):
                carry = block[b][None, :] ^ flips[at][:, None]
                for k in range(width):
                    counter[k], carry = counter[k] ^ carry, counter[k] & carry
                over |= carry
                if at % 8 == 7 and (over == full).all():
                    break
            close = ~over
            rows, words = np.nonzero(close)
            if not len(rows):
                continue
            bits = np.unpackbits(close[rows, words].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            at, j = np.nonzero(bits)
            left, right = q + rows[at], (w + words[at]) * 64 + j
            fine = (left < right) & (right < n)
            yield left[fine], right[fine]


def components(n: int, slabs) -> np.ndarray:
    """Root (smallest member) of each of n nodes, by hooking and flattening over slabs of pairs."""
    root = np.arange(n)
    for left, right in slabs:
        while True:
            # flatten, hang each larger root under the smallest one it meets, until nothing changes
            while (root[root] != root).any():
                root = root[root]
            a, b = root[left], root[right]
            open_ = a != b
            if not open_.any():
                break
            left, right, a, b = left[open_], right[open_], a[open_], b[open_]
            np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
    while (root[root] != root).any():
        root = root[root]
    return root


def runs(frames, keys: list[str]):
    """Frames sorted by keys -> the rows of each key, whole, where there are two or more."""
    held = None
    for frame in frames:
        frame = frame if held is None else pd.concat([held, frame], ignore_index=True)
        held = None
        if not len(frame):
            continue
        change = np.zeros(len(frame), bool)
        for k in keys:
            v = frame[k].to_numpy()
            change[1:] |= v[1:] != v[:-1]
        starts = np.r_[0, np.flatnonzero(change)]
        held = frame.iloc[starts[-1] :]
        ends = np.r_[starts[1:], len(frame)]
        for a, b in zip(starts[:-1].tolist(), ends[:-1].tolist(), strict=True):
            if b - a > 1:
                yield frame.iloc[a:b]
    if held is not None and len(held) > 1:
        yield held


def whole_runs(frames, keys: list[str]):
    """Frames sorted by keys -> (columns as arrays, first and last place of each run of two or more); no run is cut."""
    held = None
    for frame in chain(frames, [None]):
        if frame is not None:
            held = frame if held is None else pd.concat([held, frame], ignore_index=True)
        if held is None or not len(held):
            continue
        change = np.ones(len(held), bool)
        change[1:] = False
        for k in keys:
            v = held[k].to_numpy()
            change[1:] |= v[1:] != v[:-1]
        starts = np.flatnonzero(change)
        whole = len(held) if frame is None else int(starts[-1])
        ends = np.r_[starts[1:], len(held)]
        fine = (ends <= whole) & (ends - starts > 1)
        if fine.any():
            yield {c: held[c].to_numpy()[:whole] for c in held}, starts[fine], ends[fine]
        held = held.iloc[whole:]


def _stars(frames):
    for run in runs(frames, ["part", "key", "third", "sub"]):
        prints = run["fp"].to_numpy().view(np.uint64)
        root = components(len(prints), near(prints))
        linked = np.flatnonzero(root != np.arange(len(root)))
        if len(linked):
            fps = run["fp"].to_numpy()
            yield pd.DataFrame({"a": fps[linked], "b": fps[root[linked]]})


def link_classes(classes: DataFrame) -> DataFrame:
    """Distinct fp (long) -> edges (a, b) that connect all fingerprints within RADIUS."""
    width = 64 // BLOCKS
    low = (1 << width) - 1
    cut = lambda i: F.shiftrightunsigned("fp", i * width).bitwiseAND(F.lit(low))
    tables = list(combinations(range(BLOCKS), BLOCKS - RADIUS))
    dealt = classes.select(
        "fp",
        F.posexplode(
            F.array(*[F.shiftleft(cut(a), width).bitwiseOR(cut(b)) for a, b in tables]),
        ).alias("part", "key"),
    )
    large = stage(dealt.groupBy("part", "key").count().filter(F.col("count") > SPLIT).select("part", "key"), "large")
    rest = F.lit(None).cast("long")
    for at, (a, b) in enumerate(tables):
        c, d = (i for i in range(BLOCKS) if i not in (a, b))
        rest = F.when(F.col("part") == at, F.shiftleft(cut(c), width).bitwiseOR(cut(d))).otherwise(rest)
    third = F.array(
        *[F.shiftright(rest, s).bitwiseAND(F.lit((1 << n) - 1)) for s, n in ((0, 11), (11, 11), (22, 10))]
    )
    marked = dealt.join(large.withColumn("big", F.lit(True)), ["part", "key"], "left")
    spread = marked.select(
        "fp", "part", "key", F.posexplode(F.when(F.col("big"), third).otherwise(F.array(F.lit(-1).cast("long")))).alias("third", "sub")
    )
    keys = ["part", "key", "third", "sub"]
    return spread.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(_stars, "a long, b long")


def fingerprints(docs: DataFrame) -> DataFrame:
    def run(frames):
        for frame in frames:
            fps = np.array([fingerprint(t) for t in frame["body"]], dtype=np.uint64).view(np.int64)
            yield pd.DataFrame({"doc_id": frame["doc_id"].astype("Int64"), "text_hash": frame["text_hash"], "fp": fps})

    ready = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(whole_text()).alias("text_hash"), whole_text().alias("body")
    )
    return ready.mapInPandas(run, "doc_id long, text_hash long, fp long")


def simhash_components(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> per row: doc_id, text_hash, fp, component_id."""
    rows = stage(fingerprints(docs), "simhash", TEXT_BATCH)
    with staging(docs.sparkSession) as made:
        classes = stage(rows.groupBy("fp").agg(F.min("doc_id").alias("low"), F.count("*").alias("n")), "classes")
        roots = connected_components(link_classes(classes))
        rooted = classes.join(roots, classes["fp"] == roots["node"], "left").select(
            "fp", "low", "n", F.coalesce("root", "fp").alias("root")
        )
        lowest = rooted.groupBy("root").agg(F.min("low").alias("component_id"), F.sum("n").alias("size"))
        known = made.keep(stage(rooted.join(lowest, "root").filter("size > 1").select("fp", "component_id"), "components"))
    return rows.join(known, "fp", "left").select(
        "doc_id", "text_hash", "fp", F.coalesce("component_id", "doc_id").alias("component_id")
    )


def keep_one_each(docs: DataFrame) -> DataFrame:
    """The rows of docs without all but one of each component: the smallest doc_id stays."""
    with staging(docs.sparkSession) as made:
        found = simhash_components(docs).groupBy("component_id", "doc_id", F.col("text_hash").alias("digest"))
        marks = made.keep(stage(one_of_each(found.agg(F.count("*").alias("n")), "component_id", F.lit(0)), "marks"))
    return keep_rows(docs, marks, text_hash())
