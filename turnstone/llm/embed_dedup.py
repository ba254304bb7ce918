"""Embedding near-dedup by iterative quantisation (ITQ) and multi-index Hamming tables.

Equal vectors of one label are one class. On a sample of at most TRAIN_ROWS vectors, chosen by hash,
a mean and rotations are learned that balance binary codes; vectors are centred and rotated alike
when they are coded. A code is cut into substrings whose width grows with the logarithm of the
table; every substring is a hash table. How many tables are needed is measured: pairs planted at the
threshold cosine around the sample must be missed with a chance of at most MISS, and the radius of
the codes holds all but a few in a million of them.

Vectors of one label that agree on a substring meet, first as the leading 64 bits of their codes
alone: a member with another within the radius asks for its vector, the rest are done. Vectors of
those are then fetched once a bucket, whole codes compared, and pairs within the radius reranked by
cosine in double precision. A pair that meets in several tables counts in the first; what leaves a
bucket is a count per vector and a star per component, never pairs. Buckets above TILE members are
cut in tiles and every pair of tiles is a task's work, so nothing is capped.

A vector that is null, zero, or holds null or non-finite components, or whose label is null, links
with nothing: n_links 0, component_id its own vec_id, kept. Vectors of different width do not link;
a width that the sample does not hold is coded by random rotations. Repeated rows are copies and
link with each other. Other columns are ignored.
"""

from __future__ import annotations

import math
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checked_broadcast, stage, staging
from .graph import connected_components
from .simhash import components, runs, whole_runs

COSINE = 0.98
#: Vectors the rotations are learned on, at most.
TRAIN_ROWS = 4000
ROUNDS = 30
#: Dimensions a rotation works in; wider vectors are projected to so many at random first.
WIDE = 256
#: Chance that a pair at the threshold meets in no table, and the most tables that may be made for it.
MISS, TABLES = 0.003, 64
#: Widths of a substring in bits.
NARROWEST, WIDEST = 10, 30
TILE = 256


class Coder(NamedTuple):
    mean: np.ndarray
    rotation: np.ndarray  # width of the vectors x bits of a code
    bits: int  # of a substring
    radius: int  # of whole codes
    sift: int  # of their leading 64 bits


def learn_rotation(vectors: np.ndarray, seed: int) -> np.ndarray:
    """ITQ: alternate codes B = sign(V R) and the rotation R nearest to V'B (orthogonal Procrustes)."""
    rng = np.random.default_rng(seed)
    d = vectors.shape[1]
    base = np.linalg.qr(rng.standard_normal((d, min(d, WIDE))))[0]
    flat, width = vectors @ base, base.shape[1]
    rotation = np.linalg.qr(rng.standard_normal((width, width)))[0]
    for _ in range(ROUNDS if len(flat) else 0):
        u, _, vt = np.linalg.svd(flat.T @ np.sign(flat @ rotation))
        rotation = u @ vt
    return base @ rotation


def learn(vectors: np.ndarray, width: int, rows: int, cosine: float = COSINE) -> Coder:
    """A coder for unit vectors of so many components, in a table of so many rows."""
    rng = np.random.default_rng(width)
    mean = vectors.mean(axis=0) if len(vectors) else np.zeros(width)
    some = vectors[rng.permutation(len(vectors))[:1000]] if len(vectors) else rng.standard_normal((1000, width))
    some = some / np.linalg.norm(some, axis=1, keepdims=True)
    aside = rng.standard_normal(some.shape)
    aside -= (aside * some).sum(axis=1, keepdims=True) * some
    length = np.linalg.norm(aside, axis=1, keepdims=True)
    planted = cosine * some + math.sqrt(max(0.0, 1 - cosine * cosine)) * np.divide(aside, length, where=length > 0, out=np.zeros_like(aside))
    bits = min(WIDEST, max(NARROWEST, math.ceil(math.log2(rows + 1))))
    parts, have = [], 0
    while True:
        # rotations until all tables that may be needed have their bits
        while have < bits * TABLES and (not parts or missed > MISS):
            parts.append(learn_rotation(vectors - mean, len(parts)))
            have += parts[-1].shape[1]
            rotation = np.hstack(parts)
            differ = ((some - mean) @ rotation > 0) != ((planted - mean) @ rotation > 0)
            tables = min(TABLES, have // bits)
            agree = ~differ[:, : tables * bits].reshape(len(some), tables, bits).any(axis=2)
            missed = float(np.prod(1 - agree.mean(axis=0)))
        if missed <= MISS or bits == NARROWEST:
            break
        bits, parts, have = bits - 1, [], 0
    # as few tables as will do
    chance = np.cumprod(1 - agree.mean(axis=0))
    tables = max(1, min(tables, int(np.searchsorted(-chance, -MISS)) + 1))
    differ = differ[:, : max(64, tables * bits)]

    def radius(d: np.ndarray) -> int:
        far = d.sum(axis=1)
        return math.ceil(far.mean() + 5 * far.std() + 1)

    return Coder(mean, rotation[:, : tables * bits], bits, radius(differ[:, : tables * bits]), radius(differ[:, : min(64, tables * bits)]))


def code(vectors: np.ndarray, coder: Coder) -> tuple[np.ndarray, np.ndarray]:
    """(substrings (n, tables), leading 64 bits (n,)) of unit vectors."""
    bits = ((vectors - coder.mean) @ coder.rotation > 0).astype(np.uint8)
    weights = 1 << np.arange(coder.bits - 1, -1, -1, dtype=np.int64)
    parts = bits.reshape(len(vectors), -1, coder.bits).astype(np.int64) @ weights
    lead = np.zeros((len(vectors), 64), np.uint8)
    lead[:, : min(64, bits.shape[1])] = bits[:, :64]
    return parts, np.packbits(lead, axis=1).view(">u8").astype(np.uint64).ravel()


def _unit(raw) -> np.ndarray:
    v = np.stack([np.asarray(x, dtype=np.float64) for x in raw])
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


@lru_cache(maxsize=8)
def _unlearned(width: int, rows: int, cosine: float) -> Coder:
    return learn(np.zeros((0, width)), width, rows, cosine)


def _coded(coders: dict[int, Coder], rows: int, cosine: float):
    def run(frames):
        for frame in frames:
            subs, lead = np.empty(len(frame), object), np.zeros(len(frame), np.int64)
            radius, bits, width = (np.zeros(len(frame), np.int32) for _ in range(3))
            sizes = np.array([0 if v is None else len(v) for v in frame["embedding"]])
            for w in np.unique(sizes[sizes > 0]).tolist():
                mine = np.flatnonzero(sizes == w)
                coder = coders.get(w) or _unlearned(w, rows, cosine)
                parts, first = code(_unit(frame["embedding"].iloc[mine]), coder)
                subs[mine] = list(parts.astype(np.int32))
                lead[mine], width[mine], bits[mine], radius[mine] = first.view(np.int64), w, coder.bits, coder.radius
                radius[mine] += coder.sift << 16
            out = frame.drop(columns="embedding")
            out["subs"], out["lead"], out["width"], out["bits"], out["radius"] = subs, lead, width, bits, radius
            yield out

    return run


def _sides(run: pd.DataFrame):
    """Places of the two sides that are compared, and whether they are one."""
    side = run["side"].to_numpy()
    return np.flatnonzero(side < 2), np.flatnonzero(side > 0), bool((side == 1).all())


def _met_before(a: np.ndarray, b: np.ndarray, bits: int, part: int) -> np.ndarray:
    """Whether leading bits show that a pair agrees on a substring before this one."""
    differ, seen = a ^ b, np.zeros(np.broadcast(a, b).shape, bool)
    for k in range(min(part, 64 // bits)):
        seen |= (differ >> np.uint64(64 - bits * (k + 1))) & np.uint64((1 << bits) - 1) == 0
    return seen


BUCKET = ["key", "tile_a", "tile_b"]


def _sift(frames):
    """Members that have another within the radius, as far as the leading bits tell, that no earlier table shows them."""
    for have, starts, ends in whole_runs(frames, BUCKET):
        lead, side, radius = have["lead"].view(np.uint64), have["side"], have["radius"] >> 16
        asked = np.zeros(len(lead), bool)
        # runs of two at once, by substring width and table
        two = starts[(ends - starts == 2) & ((side[starts] == 1) | (side[starts] != side[ends - 1]))]
        kinds = have["bits"][two].astype(np.int64) << 32 | have["part"][two]
        for kind in np.unique(kinds).tolist():
            at = two[kinds == kind]
            near = (np.bitwise_count(lead[at] ^ lead[at + 1]) <= radius[at]) & ~_met_before(lead[at], lead[at + 1], kind >> 32, kind & 0xFFFFFFFF)
            asked[at[near]] = asked[at[near] + 1] = True
        for start, end in zip(starts[ends - starts > 2].tolist(), ends[ends - starts > 2].tolist(), strict=True):
            mine = side[start:end]
            left, right, one = np.flatnonzero(mine < 2), np.flatnonzero(mine > 0), bool((mine == 1).all())
            bits, part, most = int(have["bits"][start]), int(have["part"][start]), int(radius[start])
            for k in range(0, len(left), 256):
                rows = left[k : k + 256]
                a, b = lead[start + rows][:, None], lead[start + right][None, :]
                near = (np.bitwise_count(a ^ b) <= most) & ~_met_before(a, b, bits, part)
                if one:
                    near &= rows[:, None] != right[None, :]
                asked[start + rows] |= near.any(axis=1)
                asked[start + right] |= near.any(axis=0)
        if asked.any():
            yield pd.DataFrame({c: have[c][asked] for c in [*BUCKET, "side", "part", "cid"]})


def _compare(cosine: float):
    def compare(frames):
        for run in runs(frames, [*BUCKET, "label", "width"]):
            left, right, one = _sides(run)
            if not len(left) or not len(right):
                continue
            vectors, subs = _unit(run["embedding"]), np.stack(run["subs"])
            part, most = int(run["part"].iloc[0]), int(run["radius"].iloc[0]) & 0xFFFF
            cid, size = run["cid"].to_numpy(), run["n"].to_numpy()
            counts, pairs = np.zeros(len(run), np.int64), []
            for k in range(0, len(left), 256):
                rows = left[k : k + 256]
                close = vectors[rows] @ vectors[right].T >= cosine
                if one:
                    # each pair once
                    close &= rows[:, None] < right[None, :]
                i, j = np.nonzero(close)
                i, j = rows[i], right[j]
                differ = subs[i] ^ subs[j]
                fine = (np.bitwise_count(differ).sum(axis=1) <= most) & (differ[:, :part] != 0).all(axis=1)
                i, j = i[fine], j[fine]
                np.add.at(counts, i, size[j])
                np.add.at(counts, j, size[i])
                pairs.append((i, j))
            linked = np.flatnonzero(counts)
            if len(linked):
                by_id = np.argsort(cid, kind="stable")
                place = np.empty(len(cid), np.int64)
                place[by_id] = np.arange(len(cid))
                root = by_id[components(len(cid), ((place[i], place[j]) for i, j in pairs))[place]]
                yield pd.DataFrame({"cid": cid[linked], "links": counts[linked], "low": cid[root[linked]]})

    return compare


def _in_buckets(frame: DataFrame) -> DataFrame:
    return frame.repartition(*BUCKET).sortWithinPartitions(*BUCKET)


def embedding_links(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """vectors (vec_id, embedding, label) -> per row: vec_id, n_links, component_id, kept."""
    spark = vectors.sparkSession
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    whole = F.col("embedding")
    given = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.col("label").cast("string").alias("label"),
        F.coalesce(F.col("label").isNotNull() & ~F.exists(whole, bad) & F.exists(whole, lambda x: x != 0), F.lit(False)).alias("valid"),
        F.xxhash64(whole).alias("h1"),
        F.xxhash64(F.lit(7), whole).alias("h2"),
        whole,
    )
    same = ["label", "h1", "h2"]
    coders, total = _learned(given.filter("valid"), cosine)
    shown = given.withColumn("embedding", F.when(F.col("valid"), whole))
    shape = "vec_id long, label string, valid boolean, h1 long, h2 long, subs array<int>, lead long, width int, bits int, radius int"
    rows = stage(shown.mapInPandas(_coded(coders, total, cosine), shape), "coded")
    with staging(spark) as made:
        about = ["subs", "lead", "width", "bits", "radius"]
        classes = stage(
            rows.filter("valid")
            .groupBy(*same)
            .agg(F.min("vec_id").alias("low"), F.count("*").alias("n"), *[F.first(c).alias(c) for c in about])
            .withColumn("cid", F.monotonically_increasing_id()),
            "vector-classes",
        )
        found = stage(_links(given, classes, cosine), "links")
        roots = connected_components(found.select(F.col("cid").alias("a"), F.col("low").alias("b")))
        linked = (
            classes.select("cid", *same, "low", "n")
            .join(found.groupBy("cid").agg(F.sum("links").alias("links")), "cid", "left")
            .join(roots, F.col("cid") == F.col("node"), "left")
            .select(*same, "low", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("root", "cid").alias("root"))
            .filter("n_links > 0")
        )
        lowest = linked.groupBy("root").agg(F.min("low").alias("component_id"))
        known = made.keep(stage(linked.join(lowest, "root").select(*same, "n_links", "component_id"), "linked"))
    valid = F.col("valid")
    out = rows.select("vec_id", *[F.when(valid, F.col(c)).alias(c) for c in same]).join(checked_broadcast(known, 64), same, "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.col("vec_id").eqNullSafe(component).alias("kept"),
    )


def _learned(valid: DataFrame, cosine: float) -> tuple[dict[int, Coder], int]:
    """Coders by width, from at most TRAIN_ROWS distinct vectors; and the number of rows."""
    total = valid.count()
    spot = F.pmod(F.xxhash64("h1", "h2"), F.lit(1_000_000))
    sample = valid.filter(spot < 1_000_000 * min(1.0, TRAIN_ROWS / max(1, total))).dropDuplicates(["h1", "h2"])
    by_width: dict[int, list] = {}
    for (v,) in sample.limit(TRAIN_ROWS).select("embedding").collect():
        by_width.setdefault(len(v), []).append(v)
    return {w: learn(_unit(x), w, total, cosine) for w, x in by_width.items()}, total


def _links(given: DataFrame, classes: DataFrame, cosine: float) -> DataFrame:
    """(cid, links, low): links a class gains in a bucket, and a star of its component there."""
    key = F.xxhash64("label", "width", "part", "sub").alias("key")
    # keys of all tables; what a bucket needs of a member is 64 bits of its code
    dealt = classes.select("cid", "lead", "bits", "radius", "label", "width", F.posexplode("subs").alias("part", "sub")).select(
        key, "cid", "lead", "bits", "radius", "part"
    )
    large = stage(dealt.groupBy("key").count().filter(F.col("count") > TILE), "large")
    tiles = large.select("key", F.ceil(F.col("count") / TILE).cast("int").alias("tiles"))
    split = dealt.join(checked_broadcast(tiles, 32), "key", "left").withColumn("tiles", F.coalesce("tiles", F.lit(1)))
    # tiles by a hash other than the one that deals out rows
    tiled = split.withColumn("tile", F.pmod(F.xxhash64(F.lit(11), "cid"), F.col("tiles")).cast("int")).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))
    )
    meets = tiled.select(
        "key", F.least("tile", "other").alias("tile_a"), F.greatest("tile", "other").alias("tile_b"),
        # 1: the tile against itself, 0 and 2: the two sides of a pair of tiles
        F.when(F.col("tile") == F.col("other"), 1).when(F.col("tile") < F.col("other"), 0).otherwise(2).alias("side"),
        "part", "cid", "lead", "bits", "radius",
    )
    asked = stage(_in_buckets(meets).mapInPandas(_sift, "key long, tile_a int, tile_b int, side int, part int, cid long"), "asked")
    wanted = stage(classes.join(checked_broadcast(asked.select("cid").distinct(), 16), "cid", "left_semi").drop("lead", "bits"), "wanted")
    ids = wanted.select("cid", *[F.col(c).alias(f"_{c}") for c in ("label", "h1", "h2", "low")])
    # of a class's rows those with its lowest id: a vector with many copies is read, not gathered
    same = [F.col(c) == F.col(f"_{c}") for c in ("label", "h1", "h2")]
    fetched = (
        given.filter("valid")
        .select("label", "h1", "h2", "vec_id", "embedding")
        .join(checked_broadcast(ids, 64), [*same, F.col("vec_id").eqNullSafe(F.col("_low"))])
        .groupBy("cid")
        .agg(F.first("embedding").alias("embedding"))
    )
    members = stage(wanted.select("cid", "n", "label", "width", "subs", "radius").join(fetched, "cid"), "members")
    placed = asked.join(checked_broadcast(members, 1 << 10), "cid")
    order = [*BUCKET, "label", "width"]
    return placed.repartition(*BUCKET).sortWithinPartitions(*order).mapInPandas(_compare(cosine), "cid long, links long, low long")
