"""Secret scan, native: fixed patterns plus sliding-window Shannon entropy per character class.

Candidate strings are runs of 20 or more token characters. A fold slides a window of WINDOW
characters over each. It keeps a count for every character (five bits each, twelve to a long), the
sum of c*log2(c) over the counts, and how many of the window's characters are letters and are not
hex digits; a step adds the entering character's part and takes the leaving one's off, and nothing
else changes. A window is of the class hex (all its characters are hex digits) or wide, and its
entropy must reach the class's threshold; a window without a letter is a number and never does.
Windows that reach it and touch are one span.

The allow-list suppresses entropy spans only, never fixed patterns: candidates that are words,
numbers or slugs, or that the caller names, and windows that overlap an allowed fragment (a
placeholder, a run of one character, the alphabet); the rest of such a candidate is still searched.

Null text counts as empty and has no spans. Rows are scanned one by one, repeated or not. The cost of
a text is in proportion to its length, however many hits it holds.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPANS, fold, let, located, whole_text

# Fixed values of the contract.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
KINDS = ("assign", "access", "hex", "entropy")

CANDIDATE = r"[A-Za-z0-9+/_-]{20,}+"
WINDOW = 20
HEX_BITS = 3.0
WIDE_BITS = 3.7
#: Whole candidates that hold no secret: words of one case or capitalised, numbers, slugs.
ALLOW = (
    r"^(?:[A-Z]?[a-z]+|[A-Z]+)$",
    r"^[0-9_-]+$",
    r"^[A-Za-z]*(?:[/_-][A-Za-z]*)+$",
)
#: Fragments whose windows hold no secret.
FRAGMENT = r"(?i:example|placeholder|changeme|x{6,}+|0{8,}+|0123456789|abcdefgh)"

FIRST = ord("+")
#: Characters counted in one long, and the bits of a count.
PER, BITS = 12, 5
LONGS = -(-(ord("z") - FIRST + 1) // PER)


def _shift(name: str, value: Column, by: Column) -> Column:
    return F.call_function(name, value, by)


def _window_spans(hit: Column) -> Column:
    """Merged spans, within the candidate, of the windows whose entropy reaches their class's threshold."""
    gain = F.array(*[F.lit(float(c * math.log2(c)) if c else 0.0) for c in range(WINDOW + 2)])
    one = F.lit(1).cast("long")

    def place(c: Column, name: str) -> list[Column]:
        by = (c % PER * BITS).cast("int")
        return [F.floor(c / PER).cast("int").alias(f"{name}_long"), by.alias(f"{name}_by"), _shift("shiftleft", one, by).alias(f"{name}_one")]

    def flags(ch: Column, i: Column, bad: Column) -> Column:
        return F.struct(
            (F.ascii(ch) - FIRST).alias("c"),
            ch.rlike("[A-Za-z]").cast("int").alias("letter"),
            (~ch.rlike("[0-9A-Fa-f]")).cast("int").alias("wide"),
            F.exists(bad, lambda b: (b["start"] <= i) & (i < b["end"])).cast("int").alias("bad"),
        )

    bad = F.when(hit.rlike(FRAGMENT), located(hit, FRAGMENT)).otherwise(F.array().cast(SPANS))
    signs = let(bad, lambda b: F.transform(F.split(hit, ""), lambda ch, i: flags(ch, i, b)))

    def moves(all_: Column) -> Column:
        def move(x, i):
            out = F.when(i >= WINDOW, F.get(all_, i - WINDOW))
            change = lambda f: (x[f] - F.coalesce(out[f], F.lit(0))).alias(f)
            gone = F.coalesce(out["c"], F.lit(-1))
            return F.struct(
                (i + 1).alias("i"), (x["c"] == gone).alias("same"), *place(x["c"], "into"), *place(F.greatest(gone, F.lit(0)), "outof"),
                (gone >= 0).alias("leaves"), change("letter"), change("wide"), change("bad"),
            )

        return F.transform(all_, move)

    longs = [f"n{k}" for k in range(LONGS)]
    start = F.struct(
        *[F.lit(0).cast("long").alias(n) for n in longs], F.lit(0.0).alias("sum"),
        *[F.lit(0).alias(n) for n in ("letter", "wide", "bad")], F.lit(-1).alias("open"), F.lit(-1).alias("till"),
    )
    shape = "struct<start:int,end:int>"

    def held(acc: Column, at: Column, by: Column) -> Column:
        which = F.lit(0).cast("long")
        for k, n in enumerate(longs):
            which = F.when(at == k, acc[n]).otherwise(which)
        return _shift("shiftright", which, by).bitwiseAND(F.lit((1 << BITS) - 1)).cast("int")

    def step(acc: Column, x: Column) -> Column:
        leaving = held(acc, x["outof_long"], x["outof_by"])
        entering = held(acc, x["into_long"], x["into_by"]) - x["same"].cast("int")
        left = F.when(x["leaves"], F.get(gain, leaving - 1) - F.get(gain, leaving)).otherwise(F.lit(0.0))
        total = acc["sum"] + left + F.get(gain, entering + 1) - F.get(gain, entering)
        letter, wide, bad = (acc[f] + x[f] for f in ("letter", "wide", "bad"))
        least = F.when(wide > 0, F.lit(WIDE_BITS)).otherwise(F.lit(HEX_BITS))
        high = (x["i"] >= WINDOW) & (letter > 0) & (bad == 0) & (F.lit(math.log2(WINDOW)) - total / WINDOW >= least - 1e-9)
        begins = x["i"] - WINDOW
        joins = high & (acc["open"] >= 0) & (begins <= acc["till"])
        closes = high & ~joins & (acc["open"] >= 0)
        zero = F.lit(0).cast("long")
        state = F.struct(
            *[
                (acc[n] + F.when(x["into_long"] == k, x["into_one"]).otherwise(zero)
                 - F.when(x["leaves"] & (x["outof_long"] == k), x["outof_one"]).otherwise(zero)).alias(n)
                for k, n in enumerate(longs)
            ],
            total.alias("sum"), letter.alias("letter"), wide.alias("wide"), bad.alias("bad"),
            F.when(high & ~joins, begins).otherwise(acc["open"]).alias("open"),
            F.when(high, x["i"]).otherwise(acc["till"]).alias("till"),
        )
        return F.struct(state.alias("state"), F.when(closes, F.struct(acc["open"].alias("start"), acc["till"].alias("end"))).alias("emit"))

    # a last step that belongs to no window closes what is open
    steps = let(signs, moves)
    ends = lambda x: x.isNotNull()
    return F.filter(_closing(steps, start, step, shape), ends)


def _closing(steps: Column, start: Column, step, shape: str) -> Column:
    """fold, with the last open span put behind what was emitted."""
    tagged = F.concat(F.transform(steps, lambda x: F.struct(x.alias("x"))), F.array(F.struct(F.lit(None).alias("x"))))

    def either(acc, item):
        last = F.when(acc["open"] >= 0, F.struct(acc["open"].alias("start"), acc["till"].alias("end")))
        return F.when(item["x"].isNull(), F.struct(acc.alias("state"), last.alias("emit"))).otherwise(step(acc, item["x"]))

    return fold(tagged, start, either, shape)


def _allowed(hit: Column, allow: tuple[str, ...]) -> Column:
    found = hit.isin(*allow) if allow else F.lit(False)
    for pattern in ALLOW:
        found = found | hit.rlike(pattern)
    return found


def ranked(spans: Column, rank: int, kind: str) -> Column:
    return F.transform(
        spans,
        lambda x: F.struct(
            x["start"].alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), x["end"].alias("end")
        ),
    )


def scan_secrets(docs: DataFrame, allow: tuple[str, ...] = ()) -> DataFrame:
    """docs (doc_id, text) -> doc_id, spans: array of (start, rank, kind, end), by start, then kind
    as listed in KINDS; places in code points, end exclusive. allow: further strings to suppress.
    """
    text = F.col("body")
    body = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("body"))
    found = body.select(
        "doc_id",
        F.filter(located(text, ASSIGN), lambda x: F.length(F.regexp_extract(x["hit"], ASSIGN, 2)) >= 12).alias("assign"),
        located(text, ACCESS).alias("access"),
        located(text, HEX).alias("hex"),
        located(text, CANDIDATE).alias("candidates"),
    )
    entropy = F.flatten(
        F.transform(
            F.filter("candidates", lambda x: ~_allowed(x["hit"], allow)),
            lambda x: F.transform(
                _window_spans(x["hit"]),
                lambda s: F.struct((x["start"] + s["start"]).alias("start"), (x["start"] + s["end"]).alias("end")),
            ),
        )
    )
    sources = (F.col("assign"), F.col("access"), F.col("hex"), entropy)
    named = [ranked(c, rank, kind) for rank, (kind, c) in enumerate(zip(KINDS, sources, strict=True))]
    return found.select("doc_id", F.array_sort(F.concat(*named)).alias("spans"))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
