"""Embedding of messages and commands: what is due, what is cached, and inference over the rest."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import context_prefix

IDLE = 600
#: Embeds a list of texts as an (n, width) array.
Backend = Callable[[list[str]], np.ndarray]


def hashed_backend(width: int = 64) -> Backend:
    """A stand-in without a model: words hashed to signed places, in unit length. Empty text is the zero vector."""

    def embed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), width))
        for i, text in enumerate(texts):
            for word in text.lower().split():
                h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
                out[i, (h >> 1) % width] += 1 if h & 1 else -1
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norm == 0, 1, norm)

    return embed


def runs(lengths: list[int], cells: int) -> list[list[int]]:
    """Places in runs of like length: run size times its longest length is at most cells. One longer alone is an error."""
    sizes = np.asarray(lengths, np.int64)
    if len(sizes) and (sizes.min() < 0 or sizes.max() > cells):
        raise ValueError("an input exceeds the cell budget")
    out, order = [], np.argsort(sizes, kind="stable")
    while len(order):
        fits = sizes[order] * np.arange(1, len(order) + 1) <= cells
        n = len(order) if fits.all() else int(np.argmin(fits))
        out.append(order[:n].tolist())
        order = order[n:]
    return out


def pending_roster(sessions: DataFrame, now, idle: int = IDLE) -> DataFrame:
    """Sessions idle for long enough, oldest first; those still written to are held."""
    age = F.lit(now).cast("timestamp").cast("long") - F.col("last_activity").cast("timestamp").cast("long")
    return sessions.filter(F.coalesce(age >= idle, F.lit(False))).orderBy("last_activity", "id")


def pending_with_totals(sessions: DataFrame, size: str, limit: int, now, idle: int = IDLE) -> DataFrame:
    """The first sessions of the pending roster, each with the sums over all that wait: sessions and `size`."""
    rows = pending_roster(sessions, now, idle)
    totals = rows.agg(F.count("*").alias("waiting"), F.coalesce(F.sum(size), F.lit(0)).alias("waiting_size"))
    return rows.limit(limit).join(F.broadcast(totals))


#: Makes contexts for a list of (prefix, text): a language model, or anything that stands for one.
Describer = Callable[[list[tuple[str, str]]], list[str]]
# The version a context's text has by the mode that made it.
CONTEXT_VERSIONS = {"off": 0, "template": 0, "llm-local": 1, "llm-remote": 2, "llm-codex": 3}


def contexts(messages: DataFrame, mode: str, describe: Describer | None = None) -> DataFrame:
    """messages (id, content, repo, cwd, branch) -> id, context, context_mode, context_version. `off` gives none,
    `template` the place the message was said in, a model's mode what describe makes of that and the text."""
    if mode not in CONTEXT_VERSIONS:
        raise ValueError(f"unsupported context mode: {mode}")
    prefix = context_prefix(F.col("repo"), F.col("cwd"), F.col("branch")) if mode != "off" else F.lit("")
    rows = messages.select("id", "content", prefix.alias("context"))
    if mode.startswith("llm"):
        if describe is None:
            raise ValueError(f"context mode {mode} needs a describer")

        def run(frames):
            for frame in frames:
                asked = list(zip(frame["context"].fillna(""), frame["content"].fillna(""), strict=True))
                yield pd.DataFrame({"id": frame["id"], "content": frame["content"], "context": describe(asked)})

        rows = rows.mapInPandas(run, rows.schema)
    return rows.select("id", "context", F.lit(mode).alias("context_mode"), F.lit(CONTEXT_VERSIONS[mode]).alias("context_version"))


#: Backends by name, best first: (name, whether it can run here, how it is made).
BACKENDS: list[tuple[str, Callable[[], bool], Callable[[str], Backend]]] = []


def register_backend(name: str, available: Callable[[], bool], make: Callable[[str], Backend], first: bool = False) -> None:
    BACKENDS.insert(0 if first else len(BACKENDS), (name, available, make))


def onnx_backend(path: str, tokenizer: str, width: int | None = None) -> Backend:
    """A sentence model exported to ONNX, with its tokenizer's file: token vectors averaged over the text, in unit length.
    Each worker opens the model when it first embeds."""
    held: dict = {}

    def embed(texts: list[str]) -> np.ndarray:
        if not held:
            import onnxruntime
            from tokenizers import Tokenizer

            held["model"] = onnxruntime.InferenceSession(path, providers=["CPUExecutionProvider"])
            held["tokens"] = Tokenizer.from_file(tokenizer)
            held["tokens"].enable_padding()
        found = held["tokens"].encode_batch(texts)
        given = {"input_ids": [x.ids for x in found], "attention_mask": [x.attention_mask for x in found], "token_type_ids": [x.type_ids for x in found]}
        names = {x.name for x in held["model"].get_inputs()}
        out = held["model"].run(None, {k: np.array(v, np.int64) for k, v in given.items() if k in names})[0]
        mask = np.array(given["attention_mask"], float)[:, :, None]
        mean = (out * mask).sum(axis=1) / np.maximum(mask.sum(axis=1), 1)
        mean = mean[:, :width] if width else mean
        return mean / np.maximum(np.linalg.norm(mean, axis=1, keepdims=True), 1e-12)

    return embed


def backend(name: str, model: str = "") -> Backend:
    """A backend by name; `auto` is the first that can run here."""
    known = {n: (ok, make) for n, ok, make in BACKENDS}
    if name == "auto":
        name = next((n for n, ok, _ in BACKENDS if ok()), "")
        if not name:
            raise ValueError("no embedding backend can run here")
    if name not in known:
        raise ValueError(f"unsupported embedding backend: {name}")
    return known[name][1](model)


register_backend("hashed", lambda: True, lambda model: hashed_backend(int(model or 64)))


def embed_missing(targets: DataFrame, cache: DataFrame, backend: Backend, cells: int = 1 << 15) -> tuple[DataFrame, DataFrame]:
    """targets (id, key, text), cache (key, vector) -> (id, vector) of all targets, and the cache's new rows.
    Each missing key is inferred once, however many targets share it."""
    missing = targets.groupBy("key").agg(F.min("text").alias("text")).join(cache.select("key"), "key", "left_anti")

    def infer(frames):
        for frame in frames:
            texts = frame["text"].fillna("").tolist()
            vectors: list = [None] * len(texts)
            sizes = [max(len(t.split()), 1) for t in texts]
            for run in runs(sizes, max(cells, *sizes, 1)):
                for place, vector in zip(run, backend([texts[i] for i in run]), strict=True):
                    vectors[place] = vector.astype("float64").tolist()
            yield pd.DataFrame({"key": frame["key"], "vector": vectors})

    fresh = missing.mapInPandas(infer, "key string, vector array<double>")
    known = cache.select("key", F.col("vector").cast("array<double>")).unionByName(fresh)
    return targets.select("id", "key").join(known, "key").select("id", "vector"), fresh
