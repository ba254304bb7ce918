"""Each document operator against a brute-force version on small rows that hold every odd case."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from turnstone.llm import exact_dedup, language_id, license_scan, mixing, packing, pii, queries, secret_scan, simhash


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def texts_of(docs):
    return [(r["doc_id"], r["text"] or "") for r in docs.collect()]


def test_rice_round_trip():
    rng = np.random.default_rng(1)
    for n, bits in ((0, 64), (1, 64), (1000, 62), (5000, 20)):
        values = np.unique(rng.integers(0, 2**bits - 1, n, dtype=np.uint64, endpoint=True))
        assert (exact_dedup.rice_decode(exact_dedup.rice_encode(values, bits)) == values).all()


def test_exact_groups(nasty):
    groups = defaultdict(list)
    for i, t in texts_of(nasty):
        groups[t].append(i)
    got = exact_dedup.exact_groups(nasty).collect()
    assert len(got) == nasty.count()
    by_sha = defaultdict(list)
    for r in got:
        by_sha[r["text_sha256"]].append(r)
    for t, ids in groups.items():
        mine = by_sha.pop(hashlib.sha256(t.encode()).hexdigest())
        top = max((i for i in ids if i is not None), default=None)
        assert Counter(r["doc_id"] for r in mine) == Counter(ids)
        assert {(r["keep_id"], r["group_size"]) for r in mine} == {(top, len(ids))}
        assert [r["doc_id"] for r in mine if r["kept"]] == [top]
    assert not by_sha


def test_drop_exact_keeps_columns_and_one_of_each(nasty):
    left = exact_dedup.drop_exact(nasty)
    assert left.columns == nasty.columns
    assert Counter(t for _, t in texts_of(left)) == Counter({t for _, t in texts_of(nasty)})


def spans_digest(found, kinds):
    found = sorted(found)
    return ",".join(f"{kinds[k]}:{s}:{e}" for s, k, e in found)


def brute_secrets(text):
    assign = re.compile(
        r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII
    )
    out = [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[2]) >= 12]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    return out + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]


def brute_entropy(text):
    out = []
    for m in re.finditer(r"[A-Za-z0-9+/_-]{20,}", text):
        hit, spans = m[0], []
        if any(re.search(p, hit) for p in secret_scan.ALLOW):
            continue
        bad = [f.span() for f in re.finditer(secret_scan.FRAGMENT.replace("}+", "}"), hit)]
        for i in range(len(hit) - 19):
            window = hit[i : i + 20]
            if any(a < i + 20 and i < b for a, b in bad) or not re.search("[A-Za-z]", window):
                continue
            least = secret_scan.HEX_BITS if re.fullmatch("[0-9A-Fa-f]+", window) else secret_scan.WIDE_BITS
            share = np.array(list(Counter(window).values())) / 20
            if -(share * np.log2(share)).sum() >= least - 1e-9:
                if spans and i <= spans[-1][1]:
                    spans[-1][1] = i + 20
                else:
                    spans.append([i, i + 20])
        out += [(m.start() + a, 3, m.start() + b) for a, b in spans]
    return out


def test_secrets(nasty):
    got = secret_scan.scan_secrets(nasty).select("doc_id", secret_scan.joined(F.col("spans")).alias("s"))
    want = [(i, spans_digest(brute_secrets(t) + brute_entropy(t), secret_scan.KINDS)) for i, t in texts_of(nasty)]
    assert rows_of(got) == sorted(want, key=repr)
    assert any("entropy" in s for _, s in want)


def test_windows_beside_an_allowed_fragment_are_searched(spark):
    key = "q8Zr2LmX9vT4sKe7Wp1Bn5cY3u"
    texts = [f"/{key}/xxxxxxxx/{key}", f"example{key}", f"{key}00000000", "kQwZmPxRtYvBnLsDfGhJcE", "12345678901234567890123", "deadbeefcafe" * 3 + "Z" * 30]
    texts += ["".join(np.random.default_rng(i).choice(list("abcdefABCDEF0123456789+/_-xyzXYZ"), 300)) for i in range(8)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = secret_scan.scan_secrets(docs).select("doc_id", secret_scan.joined(F.filter("spans", lambda x: x["kind"] == "entropy")).alias("s"))
    want = [(i, spans_digest(brute_entropy(t), secret_scan.KINDS)) for i, t in enumerate(texts)]
    assert rows_of(got) == sorted(want, key=repr)
    assert all(s for i, s in want if i < 4) and not want[4][1]


def test_texts_full_of_hits_take_seconds(spark):
    import time

    hits = " ".join(f"{i:020x} token=Zx9Qw3Er7Ty1Ui5Op8As{i}" for i in range(20_000))
    docs = spark.createDataFrame([(1, hits)], "doc_id long, text string")
    began = time.time()
    got = secret_scan.scan_secrets(docs).select(F.expr("aggregate(spans, 0, (n, x) -> n + int(x.kind = 'hex'))"), F.size("spans")).first()
    assert got[0] == 20_000 and got[1] > 40_000 and time.time() - began < 120


def test_allow_list_suppresses_only_entropy(spark):
    docs = spark.createDataFrame([(1, "key q8Zr2LmX9vT4sKe7Wp1Bn5 deadbeefdeadbeef12")], "doc_id long, text string")
    all_, some = (
        {x["kind"] for x in secret_scan.scan_secrets(docs, a).first()["spans"]} for a in ((), ("q8Zr2LmX9vT4sKe7Wp1Bn5",))
    )
    assert all_ == {"entropy", "hex"} and some == {"hex"}


def luhn(d):
    return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0


def brute_pii(text):
    found = lambda rx: re.finditer(rx, text)
    out = [(0, m.start(), m.end()) for m in found(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")] if "@" in text else []
    out += [
        (1, m.start(), m.end())
        for m in found(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
        if max(map(int, m[0].split("."))) <= 255
    ]
    for m in found(r"[0-9]([\x20-]?[0-9])+"):
        d = re.sub("[^0-9]", "", m[0])
        if 16 <= len(d) <= 19 and luhn(d):
            out.append((2, m.start(), m.end()))
    out += [
        (3, m.start(), m.end())
        for m in found(r"\+[0-9][\x20().0-9-]+[0-9]")
        if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15
    ]
    return ",".join(f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in sorted(out))


def test_pii_base(nasty):
    got = pii.scan_pii(nasty).select(
        "doc_id", secret_scan.joined(F.filter("spans", lambda x: x["kind"] != "context")).alias("s")
    )
    assert rows_of(got) == sorted(((i, brute_pii(t)) for i, t in texts_of(nasty)), key=repr)


def test_pii_patterns_find_unseen_identifiers(spark):
    texts = [f"please write to me at user{i}@mail.example.com today" for i in range(5)]
    texts += ["please write to me at jane(at)4455-6677 today", "the year 20455 was at sea", "born in 1999 or 2001"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: [(x["kind"], x["start"], x["end"]) for x in r["spans"]] for r in pii.scan_pii(docs).collect()}
    at = texts[5].index("jane")
    assert got[5] == [("context", at, at + len("jane(at)4455-6677"))]
    assert not got[6] and not got[7] and all(got[i][0][0] == "email" for i in range(5))


def test_licenses(nasty):
    got = queries_row(license_scan.scan_licenses(nasty))
    for i, t in texts_of(nasty):
        words = [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t)) if w]
        base = []
        for label, phrase in license_scan.PHRASES.items():
            p = phrase.split()
            base += [(label, k) for k in range(len(words)) if words[k : k + len(p)] == p]
        assert (len(words), sorted(base, key=lambda x: x[1])) in got[i], (i, t[:80])


def queries_row(df):
    out = defaultdict(list)
    for r in df.collect():
        out[r["doc_id"]].append((r["n_words"], sorted(((x["label"], x["start"]) for x in r["base"]), key=lambda x: x[1])))
    return out


def brute_print(text, k=3):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text)) if w]
    grams = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(ids, linked):
    root = list(range(len(ids)))
    changed = True
    while changed:
        changed = False
        for i in range(len(ids)):
            for j in range(len(ids)):
                if root[i] != root[j] and linked(i, j):
                    root[i] = root[j] = min(root[i], root[j])
                    changed = True
    low = defaultdict(list)
    for i, r in enumerate(root):
        low[r].append(ids[i])
    return [min((x for x in low[r] if x is not None), default=None) for r in root]


def test_simhash(nasty):
    docs = texts_of(nasty)
    prints = [brute_print(t) for _, t in docs]
    want = brute_components([i for i, _ in docs], lambda i, j: (prints[i] ^ prints[j]).bit_count() <= 2)
    got = simhash.simhash_components(nasty).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")), "component_id")
    assert rows_of(got) == sorted(((d[0], f"{p:016x}", c) for d, p, c in zip(docs, prints, want, strict=True)), key=repr)


@pytest.mark.parametrize("split", [2048, 4])
def test_links_lose_no_pair(spark, monkeypatch, split):
    monkeypatch.setattr(simhash, "SPLIT", split)
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    prints = [int(b) ^ (1 << int(i)) ^ (1 << int(j)) for b in base for i, j in rng.integers(0, 64, (8, 2))]
    prints = sorted(set(prints) | set(map(int, base)) | {0, 2**64 - 1})
    signed = [p - 2**64 if p >= 2**63 else p for p in prints]
    edges = simhash.link_classes(spark.createDataFrame([(p,) for p in signed], "fp long"))
    roots = {r[0]: r[1] for r in simhash.connected_components(edges).collect()}
    want = brute_components(signed, lambda i, j: (prints[i] ^ prints[j]).bit_count() <= 2)
    assert [roots.get(p, p) for p in signed] == want


def test_near_copies_leave_one(nasty):
    left = simhash.keep_one_each(nasty)
    assert left.columns == nasty.columns
    assert left.count() == len({r["component_id"] for r in simhash.simhash_components(nasty).collect()})


def test_mix(nasty):
    sizes = Counter()
    for r in nasty.collect():
        sizes[r["source"]] += len((r["text"] or "").encode().split())
    goal = mixing.targets(list(sizes.items()))
    total = sum(sizes.values())
    assert sum(goal.values()) == total * mixing.SHARE or all(goal[s] == 2 * sizes[s] for s in sizes)
    assert all(goal[s] <= 2 * sizes[s] for s in sizes)
    got = mixing.mix_documents(nasty).collect()
    assert len(got) == nasty.count()
    by_target, largest = Counter(), Counter()
    for r in got:
        assert r["taken"] in (0, r["size"], 2 * r["size"])
        by_target[r["target"]] += r["taken"]
        largest[r["target"]] = max(largest[r["target"]], r["size"])
    assert all(abs(n - t) <= largest[t] for t, n in by_target.items())
    assert rows_of(mixing.mix_documents(nasty)) == sorted(map(tuple, got), key=repr)


def test_targets_reshare():
    goal = mixing.targets([("a", 10), ("b", 100), ("c", 100), (None, 0)])
    assert goal["a"] == 20 and goal[None] == 0 and sum(goal.values()) == 315
    assert goal["b"] == 2 * goal["c"] or goal["b"] == 200


def test_packing(nasty):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.tokenizer_path())
    want = Counter()
    for i, t in texts_of(nasty):
        want[(i, len(tok.encode(t, add_special_tokens=False).ids) + 1)] += 1
    got = packing.pack_documents(nasty).collect()
    assert sum(r["length"] for r in got) == sum(n * c for (_, n), c in want.items())
    assert Counter((r["doc_id"], r["doc_tokens"]) for r in got if r["start"] == 0) == want
    by_seq = defaultdict(list)
    for r in got:
        by_seq[r["sequence_id"]].append((r["offset"], r["length"]))
    for k, parts in by_seq.items():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == packing.WINDOW or k == max(by_seq)
    shares = defaultdict(Counter)
    for r in got:
        shares[r["sequence_id"]][r["queue"]] += r["length"]
    total = Counter()
    for c in shares.values():
        total.update(c)
    for k, c in shares.items():
        if k != max(shares):
            for q, n in total.items():
                assert abs(c[q] - packing.WINDOW * n / sum(total.values())) <= len(total) + 1


def test_piece_checksums(nasty):
    import zlib

    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.tokenizer_path())
    ids = {i: [*tok.encode(t, add_special_tokens=False).ids, 2] for i, t in texts_of(nasty) if i not in (None, 3)}
    for r in packing.pack_documents(nasty).collect():
        if r["doc_id"] in ids:
            piece = np.array(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]], "<u4")
            assert zlib.crc32(piece.tobytes()) == r["ids_crc32"]


def test_word_ids_equal_the_tokenizers():
    from tokenizers import Tokenizer

    tok, own = Tokenizer.from_file(packing.tokenizer_path()), packing.WordIds(packing.tokenizer_path())
    for t in ("It's ΣΟΦΟΣ İzmir x y", "a\x1cb \x1f", "<|endoftext|> x<|startoftext|>y", "é ́ ﬁ ½ 12a3", "🎉​z\u0085q", "a|b | c", "Word, word. É! ß? A.. 's It'S.", "x."):
        assert np.frombuffer(own.texts([t])[0], "<u2").tolist() == tok.encode(t, add_special_tokens=False).ids, t


def test_word_ids_of_random_runs_equal_the_tokenizers():
    import random

    from tokenizers import Tokenizer

    tok, own = Tokenizer.from_file(packing.tokenizer_path()), packing.WordIds(packing.tokenizer_path())
    signs, chance = "aAzZéÉİıſŉΣσß́ !!'\"|.,#1٣你\x1c\x85ǅ%<>-_^`{}~[]\\sS", random.Random(1)
    texts = ["".join(chance.choices(signs, k=chance.randint(0, 12))) for _ in range(3000)]
    for t, got in zip(texts, own.texts(texts), strict=True):
        assert np.frombuffer(got, "<u2").tolist() == tok.encode(t, add_special_tokens=False).ids, repr(t)


def test_served_is_monotone_and_whole():
    queues = np.array([1, 3, 50_000, 7, 123_456, 0, 999])
    given = packing.served(np.arange(0, -(-queues.sum() // 4096) + 1), queues)
    assert (np.diff(given, axis=0) >= 0).all() and (given[-1] == queues).all()
    assert (given.sum(axis=1) == np.minimum(np.arange(len(given)) * 4096, queues.sum())).all()


def test_language(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    truth = {r["doc_id"]: r["lang"] for r in docs.collect()}
    got = [r for r in language_id.identify(docs).collect() if r["held_out"] and truth[r["doc_id"]]]
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in got]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got)


def test_language_of_odd_texts(nasty):
    got = {r["doc_id"]: r for r in language_id.identify(nasty).collect()}
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (0, 1, 2))
    assert language_id.keep_identified(nasty).columns == nasty.columns


def test_unseen_words_back_off():
    model = language_id.BackoffModel.fit([("en", "nation", 9), ("en", "station", 9), ("de", "zeitung", 9), ("de", "leitung", 9)])
    assert model.score("ration") [0] == "en" and model.score("Meitung")[0] == "de"
    assert model.score("")[0] == "und"


def test_empty_tables(empty):
    for run in (
        exact_dedup.exact_groups, exact_dedup.drop_exact, language_id.identify, language_id.keep_identified,
        secret_scan.scan_secrets, mixing.mix_documents, mixing.apply_mix, simhash.simhash_components,
        simhash.keep_one_each, pii.scan_pii, license_scan.scan_licenses, packing.pack_documents,
    ):
        assert run(empty).count() == 0, run


def test_queries_are_registered():
    assert list(queries.QUERIES)[:10] == sorted(queries.QUERIES, key=lambda q: int("".join(filter(str.isdigit, q.split("_")[0])) or 99))[:10]
