"""Language ID against a plain word-first backoff on strings."""

import math
import zlib
from collections import Counter, defaultdict
from functools import cache

import pyarrow as pa
import pytest
import regex
from turnstone.llm import language_id


def words_of(text):
    return regex.findall(r"\p{L}+", (text or "").lower())


def plain_model(rows):
    """rows (text, lang): predict(text) -> (language, score)."""
    langs = sorted({lang for _, lang in rows})
    words = defaultdict(Counter)
    for text, lang in rows:
        for w in words_of(text):
            words[w][lang] += 1
    tables = [words] + [defaultdict(Counter) for _ in range(5)]
    pieces = lambda w: [f"<{w[k : k + 40]}>" for k in range(0, len(w), 40)]
    for w, counts in words.items():
        for p in pieces(w):
            for n in range(1, 6):
                for i in range(len(p) - n + 1):
                    tables[n][p[i : i + n]].update(counts)

    def logs(table):
        totals = {x: sum(c[x] for c in table.values()) + 0.5 * (len(table) + 1) for x in langs}
        return {k: [math.log((c[x] + 0.5) / totals[x]) for x in langs] for k, c in table.items() if sum(c.values()) >= 3}

    tables = [logs(t) for t in tables]

    @cache
    def gram(g):
        if g in tables[len(g)]:
            return tables[len(g)][g]
        if len(g) == 1:
            return [0.0] * len(langs)
        return [0.5 * (a + b) + math.log(0.4) for a, b in zip(gram(g[:-1]), gram(g[1:]), strict=True)]

    @cache
    def word(w):
        if w in tables[0]:
            return tables[0][w]
        parts = [gram(p[i : i + 5]) for p in pieces(w) for i in range(max(1, len(p) - 4))]
        return [sum(x) / len(parts) for x in zip(*parts, strict=True)]

    def predict(text):
        found = [word(w) for w in words_of(text)]
        if not found:
            return "und", 0.0
        sums = [sum(x) * min(1.0, 20 / len(found)) for x in zip(*found, strict=True)]
        odds = [math.exp(x - max(sums)) for x in sums]
        best = max(range(len(langs)), key=lambda i: (odds[i], -i))
        return langs[best], odds[best] / sum(odds)

    return predict


def held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 3 == 1


@pytest.mark.parametrize("group", [1 << 21, 2000])
def test_predictions_equal_plain_backoff(spark, monkeypatch, group):
    monkeypatch.setattr(language_id, "GROUP", group)
    monkeypatch.setattr(language_id, "MEMO", 500 if group < 10_000 else 200_000)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in docs.collect()]
    rows += [(900_001, "x" * 95 + " zeitungsübung", None), (900_002, "1234", "en"), (900_003, None, "en"), (900_004, "Q", None)]
    predict = plain_model([(t, lang) for i, t, lang in rows if lang and t is not None and not held_out(i)])
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    got = {r["doc_id"]: r for r in language_id.identify(frame).collect()}
    assert len(got) == len(rows)
    for i, text, _ in rows:
        lang, score = predict(text)
        assert got[i]["lang_pred"] == lang and abs(got[i]["score"] - score) < 1e-4, (i, got[i], score)
        assert got[i]["held_out"] == held_out(i)


def test_copies_of_one_text_do_not_swell_the_sample(spark, monkeypatch):
    monkeypatch.setattr(language_id, "SAMPLE_PER_LANG", 100)
    sizes = []
    monkeypatch.setattr(language_id.BackoffModel, "fit", classmethod(lambda cls, t: sizes.append(max(t["count"].to_pylist())) or cls([], pa.array([], pa.string()), None, [])))
    for word in "abcdefgh":
        docs = spark.range(3000).selectExpr("id AS doc_id", f"'{word}' AS text", "'en' AS lang")
        language_id.fit(docs)
    assert all(30 < n < 250 for n in sizes), sizes
