"""PII by bootstrapped contextual extraction, native.

Fixed patterns find e-mail addresses, IP addresses, card and phone numbers: the seeds. Words with two
or more digits or an @ that no seed covers are candidates. Seeds and candidates are instances; what
stands around one gives its lexical patterns, letters in lower case and digits as 0: the two words
before it, the word before it, the words on both sides, and a label written to it (`tel:`).

Spark holds the bipartite graph of patterns and instances as a table and scores it in ROUNDS rounds. A
pattern's confidence is the sum of its distinct instances' scores over their number and the number of
places where it surrounds an ordinary word (counted over all words of the corpus). A pattern with
SUPPORT instances that are seeds or found, and confidence of CONFIDENT, is trusted; an instance's
score is the chance that not all its trusted patterns err. So what a round has found supports patterns
that no seed has, and these find more in the next. Candidates in trusted patterns are kind `context`.

Null text counts as empty. Rows are scanned one by one; a repeated row gets the same spans. Words,
however long, are whole, and the cost of a text grows with its length. Other columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checked_broadcast, fold, let, located, stage, staging, whole_text

# Fixed values of the contract. Possessive forms that match the same strings: nothing they could
# give back is followed by anything that could match it.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9]){15,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = ("email", "ip", "card", "phone", "context")

EDGE = r"^[\p{Punct}]+|[\p{Punct}]+$"
#: A label written to what it names.
LABEL = r"(?<!\S)[A-Za-z_-]++[:=#]++(?=\S)"
#: Words that may be an identifier.
LIKELY = r"[0-9][^0-9\s]*+[0-9]|\S@\S"
ROUNDS = 4
CONFIDENT = 0.8
SUPPORT = 3


def _octets(hit: Column) -> Column:
    part = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
    return hit.rlike(rf"^{part}(?:\.{part}){{3}}$")


def _luhn(hit: Column) -> Column:
    digits = F.regexp_replace(hit, r"[\x20-]", "")
    doubled = F.transform(
        F.reverse(F.split(digits, "")),
        lambda c, i: F.when(
            i % 2 == 1, (c.cast("int") * 2) - F.when(c.cast("int") > 4, F.lit(9)).otherwise(F.lit(0))
        ).otherwise(c.cast("int")),
    )
    total = F.aggregate(doubled, F.lit(0), lambda a, x: a + x)
    return F.when(F.length(digits).between(16, 19), total % 10 == 0).otherwise(F.lit(False))


def _digits(hit: Column) -> Column:
    return F.length(F.regexp_replace(hit, "[^0-9]", ""))


def _plain(word: Column) -> Column:
    return F.translate(F.lower(word), "123456789", "000000000")


def _patterns(before: Column, left: Column, right: Column, label: Column) -> Column:
    """Hashes of the lexical patterns around a place; those with a word that is not there are left out."""
    both = lambda a, b, x: F.when(a.isNotNull() & b.isNotNull(), x)
    return F.array_compact(
        F.array(
            both(before, left, F.xxhash64(F.lit(1), before, left)),
            F.when(left.isNotNull(), F.xxhash64(F.lit(2), left)),
            both(left, right, F.xxhash64(F.lit(3), left, right)),
            F.when(label != "", F.xxhash64(F.lit(4), label)),
        )
    )


def _at(words: Column, i: Column) -> Column:
    return F.when(i >= 0, _plain(F.get(words, i)["hit"]))


def base_spans(text: Column) -> list[Column]:
    """Spans of email, ip, card and phone, failing matches dropped."""
    return [
        located(text, EMAIL),
        F.filter(located(text, IP), lambda x: _octets(x["hit"])),
        F.filter(located(text, CARD), lambda x: _luhn(x["hit"])),
        F.filter(located(text, PHONE), lambda x: _digits(x["hit"]).between(8, 15)),
    ]


SPAN = "struct<start:int,end:int,value:bigint,patterns:array<bigint>>"


def _scanned(docs: DataFrame) -> DataFrame:
    """row_id, doc_id, base (rank, start, end), seeds and candidates (start, end, value, patterns)."""
    body = docs.select(
        F.monotonically_increasing_id().alias("row_id"),
        F.col("doc_id").cast("long").alias("doc_id"),
        whole_text().alias("body"),
    )
    named = list(KINDS[:4])
    found = body.select("row_id", "doc_id", "body", *[c.alias(n) for n, c in zip(named, base_spans(F.col("body")), strict=True)])
    ranked = lambda name, rank: F.transform(
        name, lambda x: F.struct(F.lit(rank).alias("rank"), x["start"].alias("start"), x["end"].alias("end"), x["hit"].alias("hit"))
    )
    found = found.select("row_id", "doc_id", "body", F.array_sort(F.concat(*[ranked(n, r) for r, n in enumerate(named)])).alias("hits"))
    none = F.array().cast(f"array<{SPAN}>")
    # only a text with a seed or a candidate is cut into words
    some = (F.size("hits") > 0) | F.col("body").rlike(LIKELY)
    places = F.when(some, let(located(F.col("body"), r"\S++"), lambda w: _places(w, F.col("hits"))))
    return found.select(
        "row_id", "doc_id",
        F.transform("hits", lambda x: F.struct(x["rank"].alias("rank"), x["start"].alias("start"), x["end"].alias("end"))).alias("base"),
        places.alias("places"),
    ).select(
        "row_id", "doc_id", "base", F.coalesce("places.seeds", none).alias("seeds"), F.coalesce("places.candidates", none).alias("candidates")
    )


def _places(words: Column, base: Column) -> Column:
    """Seeds and candidates with their patterns. Words and seeds are gone through together in order of
    their start: a seed stands at the last word that begins before it, and covers what reaches beyond."""
    event = lambda start, order, end, at: F.struct(
        start.alias("start"), F.lit(order).alias("order"), end.alias("end"), at.cast("int").alias("at")
    )
    events = F.array_sort(
        F.concat(
            F.transform(words, lambda w, i: event(w["start"], 0, w["end"], i)),
            F.transform(base, lambda b, i: event(b["start"], 1, b["end"], i)),
        )
    )
    shape = "struct<word:int,seed:int,covered:boolean>"

    def step(state, x):
        seed = x["order"] == 1
        word = F.when(seed, state["word"]).otherwise(x["at"])
        till = F.when(seed, F.greatest(state["till"], x["end"])).otherwise(state["till"])
        emit = F.struct(word.alias("word"), F.when(seed, x["at"]).alias("seed"), (seed | (state["till"] > x["start"])).alias("covered"))
        return F.struct(F.struct(word.alias("word"), till.alias("till")).alias("state"), emit.alias("emit"))

    walked = F.when(
        F.size(base) > 0, F.filter(fold(events, F.struct(F.lit(-1).alias("word"), F.lit(-1).alias("till")), step, shape), lambda x: x["covered"])
    ).otherwise(F.array().cast(f"array<{shape}>"))

    def seeds(gone):
        def seed(x):
            b, w = F.get(base, x["seed"]), F.get(words, x["word"])
            label = F.lower(F.substring(w["hit"], F.lit(1), b["start"] - w["start"]))
            after = x["word"] + F.size(F.split(b["hit"], r"\s+"))
            patterns = _patterns(
                _at(words, x["word"] - 2), _at(words, x["word"] - 1), _at(words, after), F.when(label.rlike(r"^[a-z_-]+[:=#]+$"), label)
            )
            return F.struct(
                b["start"].alias("start"), b["end"].alias("end"), F.xxhash64(F.lower(b["hit"])).alias("value"), patterns.alias("patterns")
            )

        return F.transform(F.filter(gone, lambda x: x["seed"].isNotNull()), seed)

    def candidates(gone):
        covered = F.transform(gone, lambda x: x["word"])
        likely = F.filter(F.transform(words, lambda w, i: F.when(w["hit"].rlike(LIKELY), i.cast("int"))), lambda i: i.isNotNull())

        def candidate(i):
            w = F.get(words, i)
            label = F.regexp_extract(w["hit"], LABEL, 0)
            rest = F.substring(w["hit"], F.length(label) + 1, F.length(w["hit"]))
            value = F.regexp_replace(rest, EDGE, "")
            start = w["start"] + F.length(label) + F.length(F.regexp_extract(rest, r"^[\p{Punct}]*", 0))
            patterns = _patterns(_at(words, i - 2), _at(words, i - 1), _at(words, i + 1), F.lower(label))
            return F.struct(
                start.alias("start"), (start + F.length(value)).alias("end"), F.xxhash64(F.lower(value)).alias("value"), patterns.alias("patterns")
            )

        return F.filter(F.transform(F.array_except(likely, covered), candidate), lambda x: x["end"] > x["start"])

    return let(walked, lambda gone: F.struct(seeds(gone).alias("seeds"), candidates(gone).alias("candidates")))


def _surroundings(docs: DataFrame) -> DataFrame:
    """pattern: one row for each pattern at each word of the corpus."""
    words = F.filter(F.split(_plain(whole_text()), r"\s+"), lambda w: w != "")

    def around(ws):
        """As _patterns; at a text's ends a word that is not there makes a hash that no pattern has."""

        def at(right, i):
            left, before = F.when(i > 0, F.get(ws, i - 1)), F.when(i > 1, F.get(ws, i - 2))
            return F.array(F.xxhash64(F.lit(1), before, left), F.xxhash64(F.lit(2), left), F.xxhash64(F.lit(3), left, right))

        # the word on the right of each place, and none on that of the last
        return F.flatten(F.transform(F.concat(F.slice(ws, 2, F.size(ws)), F.array(F.lit(None).cast("string"))), at))

    labels = F.transform(
        F.when(whole_text().rlike(LABEL), F.regexp_extract_all(whole_text(), F.lit(LABEL), F.lit(0))).otherwise(F.array().cast("array<string>")),
        lambda x: F.xxhash64(F.lit(4), F.lower(x)),
    )
    none = F.array().cast("array<bigint>")
    near = let(words, lambda ws: F.when(F.size(ws) > 0, around(ws)).otherwise(none))
    return docs.select(F.explode(F.concat(near, labels)).alias("pattern"))


def score_patterns(edges: DataFrame, ordinary: DataFrame) -> DataFrame:
    """edges (pattern, instance, seed) distinct, ordinary (pattern, ordinary) -> trusted patterns (pattern, confidence)."""
    scores = edges.filter("seed").select("instance", F.lit(1.0).alias("score")).distinct()
    trusted = None
    for _ in range(ROUNDS):
        known = edges.join(scores, "instance", "left").select("pattern", F.coalesce("score", F.lit(0.0)).alias("score"))
        sums = known.groupBy("pattern").agg(
            F.sum("score").alias("sum"), F.count("*").alias("n"), F.count_if(F.col("score") >= CONFIDENT).alias("support")
        )
        confidence = F.col("sum") / (F.col("n") + F.coalesce("ordinary", F.lit(0)))
        trusted = stage(
            sums.filter(F.col("support") >= SUPPORT)
            .join(ordinary, "pattern", "left")
            .select("pattern", confidence.alias("confidence"))
            .filter(F.col("confidence") >= CONFIDENT),
            "trusted",
        )
        doubt = F.sum(F.log(1 - F.least("confidence", F.lit(0.99))))
        found = edges.filter("not seed").join(trusted, "pattern").groupBy("instance").agg((1 - F.exp(doubt)).alias("score"))
        seeds = edges.filter("seed").select("instance", F.lit(1.0).alias("score"))
        scores = stage(seeds.unionByName(found).groupBy("instance").agg(F.max("score").alias("score")), "scores")
    return trusted


def scan_pii(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> doc_id, spans: array of (rank, kind, start, end) by kind, then start."""
    rows = stage(_scanned(docs), "pii")
    with staging(docs.sparkSession) as made:
        instances = lambda name, seed: rows.select(F.explode(name).alias("x")).select(
            F.explode("x.patterns").alias("pattern"), F.col("x.value").alias("instance"), F.lit(seed).alias("seed")
        )
        # a pattern of few instances can never gain support; places are counted with their instances
        seen = instances("seeds", True).unionByName(instances("candidates", False)).groupBy("pattern", "instance").agg(
            F.max("seed").alias("seed"), F.count("*").alias("n")
        )
        linked = stage(seen, "pii-edges")
        usable = stage(
            linked.groupBy("pattern").agg(F.count("*").alias("instances"), F.sum("n").alias("places")).filter(F.col("instances") >= SUPPORT), "usable"
        )
        edges = stage(linked.join(checked_broadcast(usable.select("pattern"), 40), "pattern", "left_semi").drop("n"), "edges")
        total = _surroundings(docs).join(checked_broadcast(usable.select("pattern"), 40), "pattern", "left_semi").groupBy("pattern").agg(
            F.count("*").alias("total")
        )
        ordinary = stage(
            usable.join(total, "pattern", "left").select("pattern", F.greatest(F.coalesce("total", F.lit(0)) - F.col("places"), F.lit(0)).alias("ordinary")),
            "ordinary",
        )
        trusted = score_patterns(edges, ordinary).select("pattern")
        places = rows.select("row_id", F.explode("candidates").alias("x")).select("row_id", "x.start", "x.end", F.explode("x.patterns").alias("pattern"))
        gained = stage(
            places.join(checked_broadcast(trusted, 40), "pattern", "left_semi")
            .groupBy("row_id")
            .agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("more")),
            "gained",
        )
        made.keep(gained)
    named = lambda x, rank: F.struct(
        rank.alias("rank"), F.element_at(F.array(*map(F.lit, KINDS)), rank + 1).alias("kind"), x["start"].alias("start"), x["end"].alias("end")
    )
    return rows.join(checked_broadcast(gained, 256), "row_id", "left").select(
        "doc_id",
        F.concat(
            F.transform("base", lambda x: named(x, x["rank"])),
            F.transform(
                F.coalesce("more", F.array().cast("array<struct<start:int,end:int>>")), lambda x: named(x, F.lit(4))
            ),
        ).alias("spans"),
    )
