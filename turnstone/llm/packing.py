"""Mixture-controlled packing.

Every source is a queue of tokens. Windows of WINDOW tokens are filled by deficit round-robin: a
source is owed its share of every window, what a window could not give in whole tokens is its
deficit, and the source with the largest deficit relative to its share is served next. Served so,
what a source has been given before window k is a fixed function of k and the queues' lengths (the
divisor method with odd divisors), so `served` gives every source's deficit at any window at once:
each partition takes up the round where the one before leaves off, without waiting for it. Only the
last window can hold padding.

A document's tokens are its ids and END_ID; it is cut wherever a window's share of its source ends.
The work for a document grows with its pieces, however rare its source is. Sources are a mixture's
configuration: one row a source comes to the driver.

Null text counts as empty: one token. A null source is a queue of its own, last. Repeated rows are
packed each. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import re
import uuid
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import TEXT_BATCH, give_back, stage

WINDOW = 4096
END_ID = 2
#: Words, and bytes of their characters, that a worker's memo of ids may hold: some 20 MB in all.
MEMO, MEMO_BYTES = 300_000, 6 << 20
#: Characters encoded at once.
GROUP = 1 << 21
#: Bytes of texts after which a worker gives freed memory back.
GIVE_BACK = 1 << 24
#: Cells of a table of windows by sources.
CELLS = 1 << 21

# White space to Unicode and so to the tokenizer; str.split() also cuts at U+001C to U+001F.
SPACE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
SEPARATORS = "[\x1c-\x1f]"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _gather(pool: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The slices of pool at starts, one after the other."""
    ends = np.cumsum(lengths)
    at = np.repeat(starts - ends + lengths, lengths)
    at += np.arange(len(at))
    return pool[at]


class WordIds:
    """Ids of runs of characters without white space. The tokenizer drops white space and never
    joins across it, so a text's ids are those of its runs. Of a run of Latin letters and ASCII marks
    behind it, letters and marks are pieces of their own to the tokenizer, which lower-cases: such
    runs share their stems' ids. Distinct stems of a group of texts that the memo does not hold are
    encoded together. A stem is one piece, so it skips the steps that find pieces, and ends at the
    one id that ends a word; any other run stands between bars.

    The memo is an Arrow array of keys beside one array of ids. Above MEMO keys or MEMO_BYTES it
    keeps what the last groups used, and starts anew if that alone is too much.
    """

    BAR = "|"
    #: Letters that are in composed form and whose lower case does not depend on their neighbours.
    STEM = "[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f]"
    STEMMED = f"^(?P<stem>{STEM}*)(?P<mark>[!-/:-@\\[-`{{-~]*)$"

    def __init__(self, path: str):
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.bar = self._encode(self.BAR)
        # the same model without the steps before it
        self.pieces = Tokenizer(self.tokenizer.model)
        self.pieces.normalizer = normalizers.Sequence([])
        self.pieces.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
        )
        suffix, known = self.tokenizer.model.end_of_word_suffix, self.tokenizer.get_vocab()
        self.ends = np.zeros(max(known.values()) + 1, bool)
        if suffix:
            self.ends[[i for x, i in known.items() if x.endswith(suffix)]] = True
        self._clear()

    def _clear(self) -> None:
        self.keys, self.pool = pa.array([], pa.string()), np.zeros(0, "<u2")
        self.begins, self.lengths, self.used = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def _encode(self, text: str, tokenizer=None) -> np.ndarray:
        found = (tokenizer or self.tokenizer).encode_batch_fast([text], add_special_tokens=False)
        return np.array(found[0].ids, dtype="<u2")

    def _barred(self, words: list[str]):
        """(ids, lengths) of any runs."""
        ids, lengths = [], np.zeros(len(words), np.int64)
        plain = [i for i, w in enumerate(words) if w and self.BAR not in w]
        found: dict[int, np.ndarray] = {i: self._encode(w) for i, w in enumerate(words) if self.BAR in w}
        for k in range(0, len(plain), 4096):
            some = plain[k : k + 4096]
            joined = self._encode(f" {self.BAR} ".join(words[i] for i in some))
            bars = np.flatnonzero(joined == self.bar[0])
            if len(bars) != len(some) - 1:
                raise ValueError("the tokenizer joins across white space")
            for i, a, b in zip(some, [0, *(bars + 1).tolist()], [*bars.tolist(), len(joined)], strict=True):
                found[i] = joined[a:b]
        for i in sorted(found):
            ids.append(found[i])
            lengths[i] = len(found[i])
        return np.concatenate([np.zeros(0, "<u2"), *ids]), lengths

    def _stemmed(self, stems: pa.Array):
        """(ids, lengths) of stems in lower case, not empty."""
        ids, lengths = [np.zeros(0, "<u2")], [np.zeros(0, np.int64)]
        for k in range(0, len(stems), 8192):
            some = stems.slice(k, 8192).to_pylist()
            found = self._encode(" ".join(some), self.pieces)
            ends = np.flatnonzero(self.ends[found]) + 1
            if len(ends) == len(some) and ends[-1] == len(found):
                size = np.diff(ends, prepend=0)
            else:
                found, size = self._barred(some)
            ids.append(found)
            lengths.append(size)
        return np.concatenate(ids), np.concatenate(lengths)

    def _learn(self, fresh: pa.Array) -> np.ndarray:
        """Add keys that are not in the memo; their places there."""
        simple, places = np.asarray(pc.match_substring_regex(fresh, f"^{self.STEM}+$")), np.zeros(len(fresh), np.int64)
        for mine, run in ((simple, self._stemmed), (~simple, lambda x: self._barred(x.to_pylist()))):
            keys = fresh.filter(pa.array(mine))
            if not len(keys):
                continue
            ids, lengths = run(keys)
            places[mine] = len(self.keys) + np.arange(len(keys))
            begins = len(self.pool) + np.cumsum(lengths) - lengths
            self.keys = pa.concat_arrays([self.keys, keys])
            self.pool = np.concatenate([self.pool, ids])
            self.begins, self.lengths = np.concatenate([self.begins, begins]), np.concatenate([self.lengths, lengths])
            self.used = np.concatenate([self.used, np.ones(len(keys), bool)])
        return places

    def _trim(self) -> None:
        full = lambda: len(self.keys) > MEMO or self.keys.nbytes > MEMO_BYTES
        if not full():
            return
        keep = np.flatnonzero(self.used)
        self.keys, self.pool = self.keys.take(pa.array(keep)), _gather(self.pool, self.begins[keep], self.lengths[keep])
        self.lengths = self.lengths[keep]
        self.begins = np.cumsum(self.lengths) - self.lengths
        self.used = np.zeros(len(keep), bool)
        if 2 * len(self.keys) > MEMO or 2 * self.keys.nbytes > MEMO_BYTES:
            self._clear()

    def _runs(self, texts: pa.Array) -> pa.ListArray:
        odd = pc.any(pc.match_substring_regex(texts, SEPARATORS)).as_py()
        if odd:
            return pa.array([SPACE.split(t) for t in texts.to_pylist()], pa.list_(pa.string()))
        return pc.utf8_split_whitespace(texts)

    def group(self, texts: pa.Array, end: int | None = None):
        """(ids, number of ids by text), each text's followed by end if that is given."""
        self._trim()
        runs = self._runs(texts)
        coded = runs.flatten().dictionary_encode()
        words, index = coded.dictionary, np.asarray(coded.indices)
        parts = pc.extract_regex(words, self.STEMMED)
        stem, mark = parts.field(0), parts.field(1)
        whole = pc.is_null(parts)
        keyed = pc.if_else(whole, words, pc.utf8_lower(stem)).dictionary_encode()
        known = pc.index_in(keyed.dictionary, value_set=self.keys)
        fresh, at = np.asarray(known.is_null()), np.asarray(known.fill_null(0)).astype(np.int64)
        at[fresh] = self._learn(keyed.dictionary.filter(pa.array(fresh)))
        self.used[at] = True
        at = at[np.asarray(keyed.indices)]
        marks = pc.if_else(whole, "", mark).dictionary_encode()
        ids, sizes = self._barred(marks.dictionary.to_pylist())
        begins = len(self.pool) + np.cumsum(sizes) - sizes
        place = np.asarray(marks.indices)
        pool = np.concatenate([self.pool, ids, np.zeros(0, "<u2") if end is None else np.array([end], "<u2")])
        # each distinct word's ids in one run of a table: its key's, then its marks'
        starts = np.stack([self.begins[at], begins[place]], axis=1).ravel()
        lengths = np.stack([self.lengths[at], sizes[place]], axis=1)
        table = np.concatenate([_gather(pool, starts, lengths.ravel()), pool[-1:]])
        lengths = np.append(lengths.sum(axis=1), end is not None)
        starts = np.cumsum(lengths) - lengths
        # a text's words and, as the last word of the table, its end
        counts = np.diff(np.asarray(runs.offsets)) + 1
        order = np.full(counts.sum(), len(words), np.int64)
        last = np.cumsum(counts) - 1
        order[np.setdiff1d(np.arange(len(order)), last, assume_unique=True)] = index
        size = lengths[order]
        ids = _gather(table, starts[order], size)
        return ids, np.diff(np.concatenate([[0], np.cumsum(size)[last]]))

    def all_texts(self, texts: pa.Array, end: int | None = None):
        """(ids, number of ids by text) for groups of whole texts of about GROUP characters; a
        longer text is a group of its own, encoded in parts cut at white space."""
        size = np.asarray(pc.fill_null(pc.binary_length(texts), 0))
        begin, held = 0, 0
        for i, n in enumerate([*size.tolist(), GROUP + 1]):
            if i > begin and held + n > GROUP:
                yield from self._long(texts[begin], end) if i == begin + 1 and held > GROUP else [
                    self.group(texts.slice(begin, i - begin), end)
                ]
                begin, held = i, 0
            held += n

    def texts(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, as 16-bit numbers."""
        groups = self.all_texts(pa.array(texts, pa.string()))
        return [x.tobytes() for ids, sizes in groups for x in np.split(ids, np.cumsum(sizes)[:-1])]

    def _long(self, text, end):
        text, ids, at = text.as_py(), [], 0
        while at < len(text):
            cut = SPACE.search(text, min(at + GROUP // 4, len(text)))
            stop = cut.end() if cut else len(text)
            ids.append(self.group(pa.array([text[at:stop]], pa.string()))[0])
            at = stop
        out = np.concatenate([*ids, np.array([] if end is None else [end], "<u2")])
        yield out, np.array([len(out)])


@lru_cache(maxsize=1)
def word_ids(path: str, run: str) -> WordIds:
    """A worker's tokenizer and memo, kept from task to task of one run and no longer: a run does
    the same work whatever its workers ran before."""
    return WordIds(path)


def _running(queues: pa.Array, tokens: np.ndarray, ends: dict) -> np.ndarray:
    """Tokens of the row's queue before it; ends (by queue) is carried on."""
    coded = queues.dictionary_encode()
    place, out = np.asarray(coded.indices), np.zeros(len(tokens), np.int64)
    for i, queue in enumerate(coded.dictionary.to_pylist()):
        mine = np.flatnonzero(place == i)
        upto = np.cumsum(tokens[mine])
        out[mine] = ends.get(queue, 0) + upto - tokens[mine]
        ends[queue] = ends.get(queue, 0) + int(upto[-1])
    return out


TOKENS = "doc_id long, queue string, part int, start long, ids binary, tokens int"


def _tokenize(path: str, run: str):
    def tokenize(batches):
        from pyspark import TaskContext

        own, part = word_ids(path, run), TaskContext.get().partitionId()
        ends: dict = {}
        seen = 0
        for batch in batches:
            at = 0
            for ids, sizes in own.all_texts(batch.column("body"), END_ID):
                rows = batch.slice(at, len(sizes))
                at += len(sizes)
                places = pa.array(np.concatenate([[0], np.cumsum(2 * sizes)]).astype(np.int32))
                coded = pa.Array.from_buffers(pa.binary(), len(sizes), [None, places.buffers()[1], pa.py_buffer(ids)])
                queue = rows.column("queue")
                columns = [
                    rows.column("doc_id"), queue, np.full(len(sizes), part, np.int32),
                    _running(queue, sizes, ends), coded, sizes.astype(np.int32),
                ]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c) if isinstance(c, np.ndarray) else c for c in columns], [c.split()[0] for c in TOKENS.split(", ")]
                )
            seen += batch.nbytes
            if seen > GIVE_BACK:
                seen = 0
                give_back()
        give_back()

    return tokenize


def served(windows: np.ndarray, queues: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """(len(windows), queues): tokens each queue has given before each window."""
    total = int(queues.sum())
    # a window number that times its width passes int64 lies beyond the last
    given = np.minimum(np.minimum(windows.astype(np.int64), total // window + 1) * window, total)
    owed = given[:, None].astype(np.longdouble) * queues.astype(np.longdouble) / max(total, 1)
    out = np.minimum(np.floor(owed + np.longdouble(0.5)).astype(np.int64), queues)
    length = queues.astype(np.float64)
    while len(rows := np.flatnonzero(out.sum(axis=1) < given)):
        # whoever waits longest, relative to its share, is served
        first = np.argmax(np.where(out[rows] < queues, length / (2 * out[rows] + 1), -1), axis=1)
        out[rows, first] += 1
    while len(rows := np.flatnonzero(out.sum(axis=1) > given)):
        # ties are served in the order of queues, so of those the last gives its token back
        waits = np.where(out[rows] > 0, length / np.maximum(2 * out[rows] - 1, 1), np.inf)
        out[rows, len(queues) - 1 - np.argmin(waits[:, ::-1], axis=1)] -= 1
    return out


def spread(low: np.ndarray, high: np.ndarray):
    """(row, value) of all values low..high of each row."""
    counts = high - low + 1
    ends = np.cumsum(counts)
    row = np.repeat(np.arange(len(low)), counts)
    return row, (low - ends + counts)[row] + np.arange(len(row))


def candidate_windows(queue: np.ndarray, begin: np.ndarray, end: np.ndarray, queues: np.ndarray):
    """(row, window) for every window that may hold one of a row's tokens begin..end of its queue, in order:
    all windows from the first to the last, or where tokens lie further apart than windows the few around each token.
    """
    total = int(queues.sum())
    last = max(-(-total // WINDOW) - 1, 0)
    # served() strays from the even share by at most one token for each other queue
    stray = len(queues) + 1
    scale = np.longdouble(total) / queues.astype(np.longdouble)[queue] / WINDOW

    def around(rows, first, until):
        low = np.clip(np.floor((first - stray) * scale[rows]), 0, last).astype(np.int64)
        high = np.clip(np.floor((until + stray) * scale[rows]), 0, last).astype(np.int64)
        return low, high

    every = np.arange(len(queue))
    low, high = around(every, begin, end)
    rare = high - low > 4 * (end - begin) + 4 * stray
    near = np.flatnonzero(~rare)
    owner, window = spread(low[near], high[near])
    owner = near[owner]
    if rare.any():
        # a token leaves its queue within a few tokens' time of its even place, whatever the queue's length
        far = np.flatnonzero(rare)
        row, token = spread(begin[far], end[far] - 1)
        row = far[row]
        middle = (token.astype(np.longdouble) + np.longdouble(0.5)) * scale[row]
        margin = np.longdouble(stray) / WINDOW
        lows = np.clip(np.floor(middle - margin), 0, last).astype(np.int64)
        highs = np.clip(np.floor(middle + margin), 0, last).astype(np.int64)
        which, found = spread(lows, highs)
        pairs = np.unique(np.stack([row[which], found], axis=1), axis=0)
        owner, window = np.concatenate([owner, pairs[:, 0]]), np.concatenate([window, pairs[:, 1]])
        order = np.lexsort((window, owner))
        owner, window = owner[order], window[order]
    return owner, window


def pieces(queue: np.ndarray, begin: np.ndarray, end: np.ndarray, queues: np.ndarray):
    """Tables (row, first token, token after the last, window, offset there) of the pieces of rows whose tokens
    begin..end stand in a queue; tokens count from the queue's head."""
    owner, window = candidate_windows(queue, begin, end, queues)
    slab, covered = max(1, CELLS // max(1, len(queues))), np.zeros(len(queue), np.int64)
    for k in range(0, len(owner), slab):
        rows, at = owner[k : k + slab], window[k : k + slab]
        needed = np.unique(np.concatenate([at, at + 1]))
        given = served(needed, queues)
        here = np.searchsorted(needed, at)
        share = given[here + 1] - given[here]
        before = np.cumsum(share, axis=1) - share
        q, each = queue[rows], np.arange(len(rows))
        left = given[here, q]
        start, stop = np.maximum(begin[rows], left), np.minimum(end[rows], given[here + 1, q])
        some = stop > start
        np.add.at(covered, rows[some], (stop - start)[some])
        yield rows[some], start[some], stop[some], at[some], (before[each, q] + start - left)[some]
    if (covered != end - begin).any():
        raise ValueError("a token was given no window")


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, queue string"


def _cut(order: list[str], lengths: list[int]):
    queues = np.array(lengths, np.int64)
    names = pa.array(order, pa.string())

    def cut(batches):
        # the words of this worker are not needed any more
        word_ids.cache_clear()
        for whole in batches:
            for k in range(0, whole.num_rows, 1024):
                batch = whole.slice(k, 1024)
                queue = np.asarray(pc.index_in(batch.column("queue"), value_set=names)).astype(np.int64)
                tokens = np.asarray(batch.column("tokens")).astype(np.int64)
                begin = np.asarray(batch.column("start")) + np.asarray(batch.column("base"))
                ids, wide = batch.column("ids"), (-1, b"")
                for rows, start, stop, window, offset in pieces(queue, begin, begin + tokens, queues):
                    first = start - begin[rows]
                    sums = np.zeros(len(rows), np.int64)
                    for i, (r, a, n) in enumerate(zip(rows.tolist(), first.tolist(), (stop - start).tolist(), strict=True)):
                        if wide[0] != r:
                            wide = (r, memoryview(np.frombuffer(ids[r].as_buffer(), "<u2").astype("<u4").tobytes()))
                        sums[i] = zlib.crc32(wide[1][4 * a : 4 * (a + n)])
                    picked = pa.array(rows)
                    columns = [
                        batch.column("doc_id").take(picked), first, stop - start, sums, tokens[rows], window, offset,
                        batch.column("queue").take(picked),
                    ]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c) if isinstance(c, np.ndarray) else c for c in columns], [c.split()[0] for c in PIECES.split(", ")]
                    )
            give_back()

    return cut


def pack_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """docs (doc_id, text, source) -> pieces; queue is `s` and the source, `n` for null."""
    ready = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.when(F.col("source").isNull(), "n").otherwise(F.concat(F.lit("s"), F.col("source"))).alias("queue"),
        F.coalesce("text", F.lit("")).alias("body"),
    )
    coded = stage(ready.mapInArrow(_tokenize(path or tokenizer_path(), uuid.uuid4().hex), TOKENS), "tokens", TEXT_BATCH)
    sums = stage(coded.groupBy("queue", "part").agg(F.sum("tokens").alias("n")), "queues")
    before = Window.partitionBy("queue").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select("queue", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    lengths = {r[0]: r[1] for r in sums.groupBy("queue").agg(F.sum("n")).collect()}
    order = sorted(lengths, key=lambda q: (q == "n", q))
    placed = coded.join(bases, ["queue", "part"])
    return placed.mapInArrow(_cut(order, [lengths[q] for q in order]), PIECES)
