"""License scan by diagonal voting, native.

The hashes of all word k-grams of a text (k is K, and LONG_K for templates of LONG_WORDS words or
more) are joined to the places of the same hash in license templates. Matches vote for their
diagonal (place in text less place in template). Neighbouring diagonals, at most SLACK apart with no
gap of more than REACH words, are merged into one candidate span, so a notice with words put in or
left out is one. A span is verified on the words themselves: the share of the template's k-grams
found in it, as words, must reach LEAST. Where spans of licenses that share wording overlap, the one
with the largest share counts.

Templates are few and fixed, so their table is a side of proven size. Texts stay where they are: what
is shuffled is one row for a diagonal, and only texts that hold a candidate span are read again.

Null text counts as empty: no words, no labels, score 0. Repeated rows get the same result each.
Other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checked_broadcast, let, stage, staging, whole_text
from .license_templates import family, templates

K = 3
LONG_K, LONG_WORDS = 7, 100
SLACK = 40
REACH = 40
LEAST = 0.6

# Fixed values of the contract.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
PHRASES = {"mit": "mit license", "apache": "apache license", "gpl": "general public license"}
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

def words_of(text: Column) -> Column:
    """Words in order; text that begins or ends with a separator leaves no empty word."""
    return F.filter(F.split(F.translate(text, UPPER, LOWER), SEPARATORS), lambda w: w != "")


def _words(text: str) -> list[str]:
    return [w for w in re.split(SEPARATORS, text.translate(str.maketrans(UPPER, LOWER))) if w]


def template_rows(spark, known=None) -> DataFrame:
    """label, family, template, k, words: one row a template."""
    rows = []
    for label, texts in (known or templates()).items():
        for i, text in enumerate(texts):
            words = _words(text)
            rows.append((label, family(label), f"{label}/{i}", LONG_K if len(words) >= LONG_WORDS else K, words))
    return spark.createDataFrame(rows, "label string, family string, template string, k int, words array<string>")


def _grams(words: Column, k: int) -> Column:
    n = F.size(words)
    joined = lambda w, i: F.concat_ws(" ", w, *[F.get(words, i + j) for j in range(1, k)])
    some = F.transform(F.slice(words, 1, F.greatest(n - k + 1, F.lit(0))), joined)
    return F.when(n >= k, some).otherwise(F.array().cast("array<string>"))


def _short(words: Column) -> Column:
    """Hash of the K-gram at each place."""
    return F.transform(_grams(words, K), lambda g: F.xxhash64(g))


def _long(short: Column) -> Column:
    """Hash of the LONG_K-gram at each place, rolled from those of the K-grams that make it up."""
    count = F.size(short) - (LONG_K - K)
    steps = range(K - 1, LONG_K - K + 1, K - 1)
    rolled = F.transform(
        F.slice(short, 1, F.greatest(count, F.lit(0))), lambda h, i: F.xxhash64(F.lit(LONG_K), h, *[F.get(short, i + j) for j in steps])
    )
    return F.when(count > 0, rolled).otherwise(F.array().cast("array<bigint>"))


def _doc_key() -> Column:
    return F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_key")


def find_templates(docs: DataFrame, known=None) -> DataFrame:
    """docs (doc_id, text) -> verified spans: doc_key, text_hash, label, template, first, last, coverage.
    Rows with equal id and text share theirs.
    """
    spark = docs.sparkSession
    known = template_rows(spark, known)
    about = ["label", "family", "template", "k", "grams"]
    own = lambda w, k: F.when(k == K, _grams(w, K)).otherwise(_grams(w, LONG_K))
    known = known.select("label", "family", "template", "k", "words", F.array_distinct(own(F.col("words"), F.col("k"))).alias("known"))
    places = known.select(
        "label", "family", "template", "k", F.size("known").alias("grams"),
        F.posexplode(let(_short(F.col("words")), lambda h: F.when(F.col("k") == K, h).otherwise(_long(h)))).alias("place", "hash"),
    )
    keyed = docs.select(_doc_key(), F.xxhash64(whole_text()).alias("text_hash"), whole_text().alias("body"))
    key = ["doc_key", "text_hash"]
    hashed = keyed.select(
        *key, let(let(words_of(F.col("body")), _short), lambda h: F.struct(F.size(h).alias("n"), F.concat(h, _long(h)).alias("all"))).alias("x")
    )
    # places of the longer grams come after those of the shorter
    at = hashed.select(*key, F.col("x.n").alias("n"), F.posexplode("x.all").alias("at", "hash"))
    pos = F.when(F.col("at") < F.col("n"), F.col("at")).otherwise(F.col("at") - F.col("n"))
    votes = (
        at.join(F.broadcast(places), "hash")
        .withColumn("pos", pos)
        .groupBy(*key, *about, (F.col("pos") - F.col("place")).alias("diagonal"), "pos")
        .agg(F.lit(1).alias("vote"))
    )
    diagonals = votes.groupBy(*key, *about, "diagonal").agg(
        F.min("pos").alias("low"), F.max("pos").alias("high"), F.count("*").alias("votes")
    )
    by = Window.partitionBy(*key, "template").orderBy("diagonal", "low")
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    jump = (F.col("diagonal") - F.lag("diagonal").over(by) > SLACK) | (F.col("low") - F.max("high").over(before) > REACH)
    candidates = (
        diagonals.withColumn("new", F.coalesce(jump, F.lit(True)).cast("int"))
        .withColumn("band", F.sum("new").over(by))
        .groupBy(*key, *about, "band")
        .agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("votes").alias("votes"))
        .filter(F.col("votes") >= LEAST * F.col("grams"))
    )
    spans = stage(candidates.select(*key, *about, "low", "high"), "license-spans")
    place = stage(spans.groupBy(*key).agg(F.collect_list(F.struct(*about, "low", "high")).alias("spans")), "license-places")
    # the words of those texts alone, cut to the spans
    texts = keyed.join(checked_broadcast(place, 512), key).select(*key, words_of(F.col("body")).alias("words"), "spans")
    cut = texts.select(
        *key,
        F.explode(
            F.transform(
                "spans",
                lambda s: F.struct(s.alias("s"), let(F.slice("words", s["low"] + 1, s["high"] - s["low"] + s["k"]), lambda w: own(w, s["k"])).alias("own")),
            )
        ).alias("x"),
    )
    checked = cut.select(*key, "x.s.*", "x.own").join(F.broadcast(known.select("template", "known")), "template")
    coverage = F.size(F.array_intersect("own", "known")) / F.size("known")
    verified = checked.select(
        *key, "label", "family", "template", F.col("low").alias("first"), (F.col("high") + F.col("k")).alias("last"), coverage.alias("coverage")
    ).filter(F.col("coverage") >= LEAST)
    # rows of one id and text have found the same; of a family's spans that overlap the best stays
    by = Window.partitionBy(*key, "family").orderBy("first", "last")
    apart = F.col("first") >= F.max("last").over(by.rowsBetween(Window.unboundedPreceding, -1))
    grouped = verified.distinct().withColumn("new", F.coalesce(apart, F.lit(True)).cast("int"))
    best = grouped.withColumn("island", F.sum("new").over(by)).withColumn(
        "most", F.max("coverage").over(Window.partitionBy(*key, "family", "island"))
    )
    return best.filter("coverage = most").select(*key, "label", "template", "first", "last", "coverage")


def scan_licenses(docs: DataFrame, known=None) -> DataFrame:
    """docs (doc_id, text) -> per row: doc_id, n_words, base (label, start) by place, found (label, first, last, coverage)."""
    words = F.col("words")
    with staging(docs.sparkSession) as made:
        spans = find_templates(docs, known)
        found = stage(
            spans.groupBy(F.col("doc_key").alias("_key"), F.col("text_hash").alias("_th")).agg(
                F.array_sort(F.collect_list(F.struct("label", "first", "last", "coverage"))).alias("found")
            ),
            "licenses",
        )
        made.keep(found)
    ends = F.filter(F.transform(words, lambda w, i: F.when(w == "license", i)), lambda i: i.isNotNull())
    at = lambda i, back: F.when(i >= back, F.get(words, i - back))
    place = lambda i: (
        F.when(at(i, 1) == "mit", F.struct(F.lit("mit").alias("label"), (i - 1).alias("start")))
        .when(at(i, 1) == "apache", F.struct(F.lit("apache").alias("label"), (i - 1).alias("start")))
        .when(
            (at(i, 1) == "public") & (at(i, 2) == "general"),
            F.struct(F.lit("gpl").alias("label"), (i - 2).alias("start")),
        )
    )
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), _doc_key(), F.xxhash64(whole_text()).alias("text_hash"), words_of(whole_text()).alias("words")
    )
    based = rows.select(
        "doc_id",
        "doc_key",
        "text_hash",
        F.size(words).cast("long").alias("n_words"),
        F.filter(F.transform(F.when(F.array_contains(words, "license"), ends), place), lambda p: p.isNotNull()).alias("base"),
    )
    empty = F.array().cast("array<struct<label:string,start:int>>")
    joined = based.join(checked_broadcast(found, 256), (F.col("doc_key") == F.col("_key")) & (F.col("text_hash") == F.col("_th")), "left")
    return joined.select(
        "doc_id",
        "n_words",
        F.coalesce("base", empty).alias("base"),
        F.coalesce("found", F.array().cast("array<struct<label:string,first:int,last:int,coverage:double>>")).alias("found"),
    )
