"""Bootstrapped extraction against a plain version of its graph, rounds that feed each other, and precision."""

import math
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F
from test_documents import brute_pii
from turnstone.llm import pii


def context(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    return {r["doc_id"]: [(x["start"], x["end"]) for x in r["spans"] if x["kind"] == "context"] for r in pii.scan_pii(docs).collect()}


def plain(texts, rounds=4):
    """The same graph with dictionaries: start and end of what is found, by text."""
    low = lambda w: w.lower().translate(str.maketrans("123456789", "000000000"))
    label = re.compile(r"(?<!\S)[A-Za-z_-]+[:=#]+(?=\S)")
    marks = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"

    def patterns(ws, i, j, tag):
        left, before = (ws[i - 1] if i > 0 else None), (ws[i - 2] if i > 1 else None)
        right = ws[j] if j < len(ws) else None
        out = []
        if before is not None:
            out.append((1, before, left))
        if left is not None:
            out.append((2, left))
        if left is not None and right is not None:
            out.append((3, left, right))
        return out + ([(4, tag)] if tag else [])

    edges, places, total, where = set(), Counter(), Counter(), []
    for t, text in enumerate(texts):
        text = text or ""
        words = [(m.start(), m.end(), m[0]) for m in re.finditer(r"\S+", text)]
        ws = [low(w[2]) for w in words]
        for i in range(len(ws)):
            total.update(patterns(ws, i, i + 1, ""))
        total.update((4, m[0].lower()) for m in label.finditer(text))
        base = [tuple(map(int, x.split(":")[1:])) for x in brute_pii(text).split(",") if x]
        covered = {i for i, (a, b, _) in enumerate(words) for s, e in base if s < b and a < e}
        for s, e in base:
            i = max(k for k, w in enumerate(words) if w[0] <= s)
            tag = words[i][2][: s - words[i][0]].lower()
            found = patterns(ws, i, i + len(text[s:e].split()), tag if re.fullmatch("[a-z_-]+[:=#]+", tag) else "")
            places.update(found)
            edges |= {(p, text[s:e].lower(), True) for p in found}
        for i, (a, _, w) in enumerate(words):
            if i in covered or not re.search(r"[0-9][^0-9]*[0-9]|\S@\S", w):
                continue
            m = label.match(w)
            rest = w[len(m[0]) :] if m else w
            value = rest.strip(marks)
            start = a + len(w) - len(rest) + len(rest) - len(rest.lstrip(marks))
            if value:
                found = patterns(ws, i, i + 1, m[0].lower() if m else "")
                places.update(found)
                edges |= {(p, value.lower(), False) for p in found}
                where.append((t, start, start + len(value), value.lower(), found))
    seeds = {v for _, v, s in edges if s}
    edges = {(p, v) for p, v, _ in edges}
    by = defaultdict(set)
    for p, v in edges:
        by[p].add(v)
    score, trusted = dict.fromkeys(seeds, 1.0), {}
    for _ in range(rounds):
        trusted = {}
        for p, vs in by.items():
            c = sum(score.get(v, 0.0) for v in vs) / (len(vs) + max(0, total[p] - places[p]))
            if sum(score.get(v, 0.0) >= 0.8 for v in vs) >= 3 and c >= 0.8:
                trusted[p] = c
        score = dict.fromkeys(seeds, 1.0)
        for p, v in edges:
            if p in trusted and v not in seeds:
                score[v] = 1 - (1 - score.get(v, 0.0)) * (1 - min(trusted[p], 0.99))
    out = defaultdict(set)
    for t, a, b, _, found in where:
        if any(p in trusted for p in found):
            out[t].add((a, b))
    return {t: sorted(out[t]) for t in range(len(texts))}


def corpus():
    texts = [f"please write to me at user{i}@mail.example.com today" for i in range(9)]
    texts += [f"please write to me at jane{i}(at)4455-6677{i} today" for i in range(1)]
    texts += [f"call tel:+1 (386) 555-37{i:02d} now" for i in range(6)] + ["call tel:386.555.4433x now", "call TEL:0049/30/12345; soon"]
    texts += ["the year 20455 was there", "born in 1999 or 2001", "home by 10:30 to see", None, "", "x" * 300 + " me at 99887766 today"]
    texts += [f"ticket {1000 + i} was closed in {1990 + i}" for i in range(12)]
    return texts


def test_graph_equals_the_plain_version(spark):
    texts = corpus()
    got, want = context(spark, texts), plain(texts)
    assert got == want
    assert got[9] and got[16] and got[17] and not any(got[i] for i in range(18, 21)) and not any(got[i] for i in range(len(texts) - 12, len(texts)))


def test_a_later_round_finds_what_the_first_cannot(spark, monkeypatch):
    # seeds show `reach me on _`; numbers found there show `my line is _`, which no seed has
    texts = [f"you can reach me on user{i}@mail.example.com always" for i in range(60)]
    numbers = [f"0{i}-77{i}-88{i}" for i in range(10, 20)]
    texts += [f"you can reach me on {n} always" for n in numbers] + [f"for you my line is {n} here" for n in numbers]
    texts += ["for you my line is 0999-111-222 here"]
    assert context(spark, texts)[len(texts) - 1] == [(19, 31)]
    assert context(spark, texts) == plain(texts)
    monkeypatch.setattr(pii, "ROUNDS", 1)
    assert context(spark, texts)[len(texts) - 1] == [] and context(spark, texts)[len(texts) - 2] == []


def test_words_of_any_length_and_wide_space(spark):
    far = " " * 200
    texts = [f"{'w' * 90}{far}user{i}@mail.example.com{far}{'v' * 70}" for i in range(5)] + [f"{'w' * 90}{far}id-4455-66{far}{'v' * 70}"]
    at = texts[5].index("id-")
    assert context(spark, texts)[5] == [(at, at + 10)]


def test_texts_full_of_hits_take_seconds(spark):
    import time

    text = " ".join(f"mail u{i}@a.example.org or +1 386 555 {i:05d} then {i}{i}" for i in range(10_000))
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    began = time.time()
    got = pii.scan_pii(docs).select(F.size(F.filter("spans", lambda x: x["kind"] != "context"))).first()[0]
    assert got == 20_000 and time.time() - began < 120


@pytest.mark.parametrize("text", ["", None, "   ", "no digits here"])
def test_texts_without_instances(spark, text):
    assert context(spark, [text]) == {0: []}
