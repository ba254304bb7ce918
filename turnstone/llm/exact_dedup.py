"""Exact dedup by Golomb-coded fingerprint exchange.

Blocks of rows send their sorted distinct 64-bit fingerprints, Golomb-Rice coded, to the owner of
each fingerprint range. Owners reply with one bitmap per block: bit i is set when the block's i-th
fingerprint also came from another block. Rows with a set bit, or with a fingerprint repeated in
their own block, are suspects; only suspects' texts are shuffled, compared byte by byte as keys of
an aggregation. Everything else is unique and never moves.

Nulls count as the empty text. A null doc_id sorts below every other. Repeated rows (same id and
text) form one group of which one row stays. Empty input gives empty output. Other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checked_broadcast, keep_rows, stage, staging, whole_text

#: Rows of a block (2 ** BLOCK_BITS at most) and fingerprints an owner receives (about).
BLOCK_BITS = 18
OWNER_ROWS = 1 << 20


def rice_encode(values: np.ndarray, span_bits: int) -> bytes:
    """Sorted distinct unsigned values below 2 ** span_bits: gaps as unary quotients, then fixed-width remainders."""
    n = len(values)
    gaps = np.diff(values, prepend=np.uint64(0)).astype(np.uint64)
    width = max(0, span_bits - max(1, n).bit_length())
    quotients = (gaps >> np.uint64(width)).astype(np.int64)
    ends = np.cumsum(quotients + 1) - 1
    unary = np.zeros(int(ends[-1]) + 1 if n else 0, np.uint8)
    unary[ends] = 1
    shifts = np.arange(width, dtype=np.uint64)
    fixed = ((gaps[:, None] >> shifts) & np.uint64(1)).astype(np.uint8).ravel()
    return struct.pack("<IBI", n, width, len(unary)) + np.packbits(unary).tobytes() + np.packbits(fixed).tobytes()


def rice_decode(data: bytes) -> np.ndarray:
    n, width, bits = struct.unpack_from("<IBI", data)
    cut = 9 + (bits + 7) // 8
    unary = np.unpackbits(np.frombuffer(data, np.uint8, cut - 9, 9), count=bits)
    quotients = np.diff(np.flatnonzero(unary), prepend=-1) - 1
    fixed = np.unpackbits(np.frombuffer(data, np.uint8, -1, cut), count=n * width).reshape(n, width)
    low = (fixed.astype(np.uint64) << np.arange(width, dtype=np.uint64)).sum(1, dtype=np.uint64)
    return np.cumsum((quotients.astype(np.uint64) << np.uint64(width)) + low, dtype=np.uint64)


def _sends(owner_bits: int):
    """(row_id, fp) of rows in order -> one coded list for each fragment of a block and owner."""
    shift = np.uint64(64 - owner_bits)

    def send(frames):
        held: list[np.ndarray] = []
        block = None

        def flush():
            ids, fps = np.concatenate([h[0] for h in held]), np.unique(np.concatenate([h[1] for h in held]))
            owners = (fps >> shift).astype(np.int64) if owner_bits else np.zeros(len(fps), np.int64)
            cuts = np.flatnonzero(np.diff(owners)) + 1
            base = (np.uint64(1) << shift) - np.uint64(1) if owner_bits else np.uint64(2**64 - 1)
            parts = np.split(fps, cuts)
            return pd.DataFrame(
                {
                    "block": block,
                    "lo": ids[0],
                    "hi": ids[-1],
                    "owner": owners[np.r_[0, cuts]],
                    "coded": [rice_encode(p & base, 64 - owner_bits) for p in parts],
                }
            )

        for frame in frames:
            ids, fps = frame["row_id"].to_numpy(), frame["fp"].to_numpy().view(np.uint64)
            blocks = ids >> BLOCK_BITS
            edges = np.flatnonzero((np.diff(blocks) != 0) | (np.diff(ids) < 0)) + 1
            for i, f in zip(np.split(ids, edges), np.split(fps, edges), strict=True):
                if not len(i):
                    continue
                if held and (i[0] >> BLOCK_BITS != block or i[0] < held[-1][0][-1]):
                    yield flush()
                    held = []
                block = i[0] >> BLOCK_BITS
                held.append((i, f))
        if held:
            yield flush()

    return send


def _reply(frame: pd.DataFrame) -> pd.DataFrame:
    """An owner: which of each block's fingerprints other blocks have sent as well."""
    lists = [rice_decode(c) for c in frame["coded"]]
    values, counts = np.unique(np.concatenate(lists), return_counts=True)
    twice = values[counts > 1]
    bitmaps = [np.packbits(np.isin(x, twice)).tobytes() for x in lists]
    return frame[["block", "lo", "hi", "owner"]].assign(bitmap=bitmaps)


def _marks(owner_bits: int):
    shift = np.uint64(64 - owner_bits)

    def mark(rows: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("row_id", ignore_index=True)
        ids, fps = rows["row_id"].to_numpy(), rows["fp"].to_numpy().view(np.uint64)
        values, inverse, counts = np.unique(fps, return_inverse=True, return_counts=True)
        suspect = counts > 1
        for (lo, hi), part in replies.groupby(["lo", "hi"]):
            own = np.unique(fps[np.searchsorted(ids, lo) : np.searchsorted(ids, hi, "right")])
            owners = (own >> shift).astype(np.int64) if owner_bits else np.zeros(len(own), np.int64)
            for owner, bitmap in zip(part["owner"], part["bitmap"], strict=True):
                mine = own[np.searchsorted(owners, owner) : np.searchsorted(owners, owner, "right")]
                bits = np.unpackbits(np.frombuffer(bitmap, np.uint8), count=len(mine)).astype(bool)
                suspect[np.searchsorted(values, mine[bits])] = True
        return rows[["row_id", "doc_id", "sha"]].assign(suspect=suspect[inverse])

    return mark


def exact_groups(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> per row: doc_id, keep_id, group_size, kept, text_sha256."""
    shown = F.sha2(whole_text().cast("binary"), 256)
    rows = stage(
        docs.select(
            F.monotonically_increasing_id().alias("row_id"),
            F.col("doc_id").cast("long").alias("doc_id"),
            F.unhex(shown).alias("sha"),
        ),
        "prints",
    )
    owner_bits = max(0, (rows.count() // OWNER_ROWS).bit_length() + 2)
    prints = rows.withColumn("fp", F.conv(F.hex(F.substring("sha", 1, 8)), 16, -10).cast("long"))
    sent = prints.select("row_id", "fp").mapInPandas(
        _sends(owner_bits), "block long, lo long, hi long, owner long, coded binary"
    )
    replies = sent.groupBy("owner").applyInPandas(_reply, "block long, lo long, hi long, owner long, bitmap binary")
    blocks = prints.withColumn("block", F.shiftright("row_id", BLOCK_BITS))
    marked = stage(
        blocks.groupBy("block")
        .cogroup(replies.groupBy("block"))
        .applyInPandas(_marks(owner_bits), "row_id long, doc_id long, sha binary, suspect boolean"),
        "marked",
    )
    suspects = marked.filter("suspect")
    # Suspect prints: the filter is pushed to the text scan by a semi join, its side size-checked.
    keys = stage(suspects.select("sha").distinct(), "suspects")
    texts = docs.select(whole_text().alias("body"), F.unhex(shown).alias("sha")).join(
        checked_broadcast(keys, 64), "sha", "left_semi"
    )
    verified = (
        texts.groupBy("sha", "body")
        .agg(F.count("*").alias("n"))
        .groupBy("sha")
        .agg(F.count("*").alias("bodies"), F.sum("n").alias("n"))
    )
    groups = suspects.groupBy("sha").agg(F.max(F.struct("doc_id", "row_id")).alias("top"), F.count("*").alias("rows"))
    groups = groups.join(verified, "sha").select(
        "sha",
        "top",
        F.when((F.col("bodies") == 1) & (F.col("n") == F.col("rows")), F.col("rows"))
        .otherwise(F.raise_error(F.lit("two texts share a SHA-256, or the input changed while it was read")).cast("long"))
        .alias("group_size"),
    )
    # written first: rows of a hot group then meet a plain table, so Spark may split them
    among = suspects.join(checked_broadcast(stage(groups, "groups"), 96), "sha").select(
        "doc_id",
        F.col("top.doc_id").alias("keep_id"),
        "group_size",
        (F.col("row_id") == F.col("top.row_id")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )
    alone = marked.filter("not suspect").select(
        "doc_id",
        F.col("doc_id").alias("keep_id"),
        F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )
    return alone.unionByName(among)


def drop_exact(docs: DataFrame) -> DataFrame:
    """docs without the rows that repeat another's text; all columns as they came."""
    with staging(docs.sparkSession) as made:
        # only rows of a group are marked; a key has a row that stays, or none
        twice = exact_groups(docs).filter("group_size > 1").groupBy(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_digest"))
        keys = twice.agg(F.max("kept").alias("_one"), F.count("*").alias("_n"))
        marks = made.keep(stage(keys.filter("not _one or _n > 1").drop("_n"), "marks"))
    return keep_rows(docs, marks, F.sha2(whole_text().cast("binary"), 256))
