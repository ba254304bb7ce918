"""Language ID by word-first backoff.

A word the model knows scores by its smoothed log frequency in each language. An unseen word backs
off: it is cut into character 5-grams (with word marks); each gram that is unknown backs off to the
grams one character shorter, down to single characters, losing PENALTY for every step.

The model is fitted on a bounded sample of labelled rows (about SAMPLE_PER_LANG rows a language,
chosen by hash; languages are the labels' closed set), so it is small whatever the corpus: grams are
counted in all words of the sample, and words and grams seen MIN_COUNT times or more are kept.
Prediction reads every whole text. Grams are known by 64-bit hashes.

Text that is null or has no letter gives `und` with score 0. Without any labelled row everything is
`und`. Rows, repeated or not, are scored one by one; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, mix64

#: Documents of each language the model is fitted on, about.
SAMPLE_PER_LANG = 3000
#: Words and grams seen less often than this are left to shorter grams.
MIN_COUNT = 3
LONGEST_GRAM = 5
PENALTY = math.log(0.4)
#: Words of evidence the score is tempered to, and the least score of an accepted document.
EVIDENCE = 20
ACCEPT = 0.5

LETTERS = r"[^\p{L}]+"
#: Grams of a word; longer words are cut in pieces of this many characters, none is dropped.
PIECE = 40
#: Characters scored at once, and unseen words whose scores a task keeps.
GROUP, MEMO = 1 << 21, 200_000


def held_out(doc_id=None):
    return F.crc32((F.col("doc_id") if doc_id is None else doc_id).cast("string").cast("binary")) % 3 == 1


class Grams:
    """Hashes of all grams of words, marked at their ends: at[n][i] is that of the n characters from place i."""

    def __init__(self, words: list[str]):
        owner, pieces = list(range(len(words))), words
        if any(len(w) > PIECE for w in words):
            cut = [(i, w[k : k + PIECE]) for i, w in enumerate(words) for k in range(0, len(w), PIECE)]
            owner, pieces = [x[0] for x in cut], [x[1] for x in cut]
        marked = "<" + "><".join(pieces) + ">"
        signs = np.frombuffer(marked.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        self.length = np.fromiter(map(len, pieces), np.int64, len(pieces)) + 2
        self.start = np.cumsum(self.length) - self.length
        self.owner = np.array(owner, np.int64)
        self.at = [None, mix64(signs + np.uint64(1))]
        for n in range(2, LONGEST_GRAM + 1):
            self.at.append(mix64(self.at[-1][:-1] + signs[n - 1 :] * np.uint64(0x9E3779B97F4A7C15)))

    def places(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(place, word) of all grams of n characters; of a shorter piece its longest gram."""
        counts = np.maximum(self.length - n + 1, 0)
        ends = np.cumsum(counts)
        piece = np.repeat(np.arange(len(counts)), counts)
        return (self.start - ends + counts)[piece] + np.arange(len(piece)), self.owner[piece]


def _sums(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and the sums of their rows."""
    found, at = np.unique(keys, return_inverse=True)
    return found, np.stack([np.bincount(at, c, len(found)) for c in values.T], axis=1).reshape(len(found), values.shape[1])


class BackoffModel:
    """langs; words (Arrow strings) and their rows; by length the grams' hashes, sorted, and their rows.
    Rows are log frequencies by language."""

    def __init__(self, langs: list[str], words: pa.Array, rows: np.ndarray, grams: list):
        self.langs, self.words, self.rows, self.grams = langs, words, rows, grams
        self._forget()

    def _forget(self) -> None:
        self.met, self.met_rows = pa.array([], pa.string()), np.zeros((0, len(self.langs)), np.float32)

    @property
    def parts(self) -> tuple:
        return self.langs, self.words, self.rows, self.grams

    @classmethod
    def fit(cls, table) -> BackoffModel:
        """table: rows or an Arrow table (lang, word, count), all words of a sample."""
        if not isinstance(table, pa.Table):
            langs_, words_, counts_ = zip(*table, strict=True) if table else ((), (), ())
            table = pa.table({"lang": pa.array(langs_, pa.string()), "word": pa.array(words_, pa.string()), "count": pa.array(counts_, pa.int64())})
        langs = sorted(pc.unique(table["lang"]).to_pylist())
        column = np.asarray(pc.index_in(table["lang"], value_set=pa.array(langs, pa.string()))).astype(np.int64)
        coded = table["word"].combine_chunks().dictionary_encode()
        coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
        counts = np.zeros((len(coded.dictionary), len(langs)))
        np.add.at(counts, (np.asarray(coded.indices), column), np.asarray(table["count"]))

        def logs(sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            often = sums.sum(axis=1) >= MIN_COUNT
            return often, np.log((sums[often] + 0.5) / (sums.sum(axis=0) + 0.5 * (len(sums) + 1))).astype(np.float32)

        grams: list = [None]
        held: list[list] = [[] for _ in range(LONGEST_GRAM + 1)]
        for k in range(0, len(counts), 1 << 16):
            some = Grams(coded.dictionary.slice(k, 1 << 16).to_pylist())
            for n in range(1, LONGEST_GRAM + 1):
                place, word = some.places(n)
                held[n].append(_sums(some.at[n][place], counts[k + word]))
        for parts in held[1:]:
            keys, sums = _sums(*(np.concatenate(x) for x in zip(*parts, strict=True))) if parts else (np.zeros(0, np.uint64), np.zeros((0, len(langs))))
            often, rows = logs(sums)
            grams.append((keys[often], rows))
        often, rows = logs(counts)
        return cls(langs, coded.dictionary.filter(pa.array(often)), rows, grams)

    def unseen(self, words: list[str]) -> np.ndarray:
        """Of each word the mean over its grams, each at the longest length that is known."""
        some, wide = Grams(words), len(self.langs)
        size = len(some.at[1])
        need = [np.zeros(size, bool) for _ in range(LONGEST_GRAM + 1)]
        top, owner = some.places(LONGEST_GRAM)
        need[LONGEST_GRAM][top] = True
        short = np.flatnonzero(some.length < LONGEST_GRAM)
        for n in range(3, LONGEST_GRAM):
            need[n][some.start[short[some.length[short] == n]]] = True
        found = [None] * (LONGEST_GRAM + 1)
        for n in range(LONGEST_GRAM, 0, -1):
            place = np.flatnonzero(need[n])
            keys, rows = self.grams[n]
            at = np.minimum(np.searchsorted(keys, some.at[n][place]), max(len(keys) - 1, 0))
            known = keys[at] == some.at[n][place] if len(keys) else np.zeros(len(place), bool)
            found[n] = place, at, known
            if n > 1:
                need[n - 1][place[~known]] = True
                need[n - 1][place[~known] + 1] = True
        sums, parts = np.zeros((len(words), wide)), np.zeros(len(words))
        shorter = np.zeros((size + 1, wide), np.float32)
        for n in range(1, LONGEST_GRAM + 1):
            place, at, known = found[n]
            now = np.zeros((size + 1, wide), np.float32)
            if known.any():
                now[place[known]] = self.grams[n][1][at[known]]
            lost = place[~known]
            if n > 1:
                now[lost] = 0.5 * (shorter[lost] + shorter[lost + 1]) + np.float32(PENALTY)
            shorter = now
            ends = (top, owner) if n == LONGEST_GRAM else (some.start[short[some.length[short] == n]], some.owner[short[some.length[short] == n]])
            for i in range(wide):
                sums[:, i] += np.bincount(ends[1], now[ends[0], i], len(words))
            parts += np.bincount(ends[1], minlength=len(words))
        return (sums / parts[:, None]).astype(np.float32)

    def _rows(self, words: pa.Array) -> np.ndarray:
        """Rows of distinct words."""
        out = np.zeros((len(words), len(self.langs)), np.float32)
        known = pc.index_in(words, value_set=self.words)
        fresh = np.asarray(known.is_null())
        out[~fresh] = self.rows[np.asarray(known.fill_null(0))[~fresh]]
        left = words.filter(pa.array(fresh))
        met = pc.index_in(left, value_set=self.met)
        new = np.asarray(met.is_null())
        if len(self.met):
            out[np.flatnonzero(fresh)[~new]] = self.met_rows[np.asarray(met.fill_null(0))[~new]]
        left = left.filter(pa.array(new))
        if len(left):
            rows = self.unseen(left.to_pylist())
            out[np.flatnonzero(fresh)[new]] = rows
            if len(self.met) + len(left) > MEMO:
                self._forget()
            self.met, self.met_rows = pa.concat_arrays([self.met, left]), np.concatenate([self.met_rows, rows])
        return out

    def _group(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(sums by language, words) of texts."""
        runs = pc.split_pattern_regex(pc.utf8_lower(texts), LETTERS)
        coded, ends = runs.flatten().dictionary_encode(), np.asarray(runs.offsets)
        # texts that begin or end with another character leave empty words
        blank = np.asarray(pc.equal(coded.dictionary, ""))
        rows = np.zeros((len(blank), len(self.langs)), np.float32)
        rows[~blank] = self._rows(coded.dictionary.filter(pa.array(~blank)))
        index = np.asarray(coded.indices)
        upto = lambda x: np.concatenate([[0], np.cumsum(x, dtype=np.float64)])[ends]
        sums = np.stack([np.diff(upto(rows[index, i])) for i in range(rows.shape[1])], axis=1)
        return sums, np.diff(upto(~blank[index]))

    def scores(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(place in langs or -1, score) of each text, in groups of about GROUP characters."""
        texts = pc.fill_null(texts, "")
        if not self.langs:
            return np.full(len(texts), -1), np.zeros(len(texts))
        size = np.cumsum(np.asarray(pc.binary_length(texts)).astype(np.int64))
        cuts = [0, *np.unique(np.searchsorted(size, np.arange(GROUP, size[-1] if len(size) else 0, GROUP), "right")).tolist(), len(texts)]
        found = [self._group(texts.slice(a, b - a)) for a, b in zip(cuts, cuts[1:]) if b > a]
        if not found:
            return np.zeros(0, np.int64), np.zeros(0)
        sums, words = (np.concatenate(x) for x in zip(*found, strict=True))
        sums = sums * np.minimum(1.0, EVIDENCE / np.maximum(words, 1))[:, None]
        odds = np.exp(sums - sums.max(axis=1, keepdims=True))
        best = sums.argmax(axis=1)
        score = odds[np.arange(len(best)), best] / odds.sum(axis=1)
        return np.where(words > 0, best, -1), np.where(words > 0, score.round(6), 0.0)

    def score(self, text: str) -> tuple[str, float]:
        best, score = self.scores(pa.array([text], pa.string()))
        return (self.langs[best[0]] if best[0] >= 0 else "und"), float(score[0])


def fit(docs: DataFrame) -> BackoffModel:
    """Fit on labelled rows of docs outside the held-out third."""
    labelled = docs.select("doc_id", "text", "lang").filter(
        F.col("lang").isNotNull() & F.col("text").isNotNull() & ~F.coalesce(held_out(), F.lit(False))
    )
    counts = {r[0]: r[1] for r in labelled.groupBy("lang").count().collect()}
    share = F.lit(0.0)
    for lang, n in counts.items():
        share = F.when(F.col("lang") == lang, min(1.0, SAMPLE_PER_LANG / n)).otherwise(share)
    # copies of one text are chosen one by one
    spot = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_000))
    words = (
        labelled.filter(spot < share * 1_000_000)
        .select("lang", F.explode(F.split(F.lower("text"), LETTERS)).alias("word"))
        .filter("word <> ''")
        .groupBy("lang", "word")
        .count()
    )
    model = BackoffModel.fit(words.toArrow())
    give_back()
    return model


def identify(docs: DataFrame, model: BackoffModel | None = None) -> DataFrame:
    """docs (doc_id, text, lang) -> doc_id, held_out, lang_pred, score, accepted, for every row."""
    model = model or fit(docs)
    shared = docs.sparkSession.sparkContext.broadcast(model.parts)

    def predict(batches):
        own = BackoffModel(*shared.value)
        names = pa.array([*own.langs, "und"], pa.string())
        for batch in batches:
            best, score = own.scores(batch.column("text"))
            columns = [batch.column("doc_id"), batch.column("held_out"), names.take(pa.array(np.where(best < 0, len(own.langs), best)))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(score, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])
            give_back()

    ready = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held_out(), F.lit(False)).alias("held_out"), "text")
    return ready.mapInArrow(predict, "doc_id long, held_out boolean, lang_pred string, score double").withColumn(
        "accepted", (F.col("lang_pred") != "und") & (F.col("score") >= ACCEPT)
    )


def keep_identified(docs: DataFrame) -> DataFrame:
    """The rows of docs whose language is found, all columns as they came."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs).parts)
    held: list = []

    @F.arrow_udf("boolean")
    def accepted(text: pa.Array) -> pa.Array:
        if not held:
            held.append(BackoffModel(*shared.value))
        best, score = held[0].scores(text)
        give_back()
        return pa.array((best >= 0) & (score >= ACCEPT))

    return docs.filter(F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))).filter(accepted(F.col("text")))
