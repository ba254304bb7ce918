"""Labels that diagonals find: edited, cut, reflowed and repeated notices, whole texts, and nothing in ordinary prose."""

import random
import re

import pytest
from turnstone.llm import license_scan
from turnstone.llm.license_templates import SHORT, TEXTS, templates


def scan(spark, texts, known=None):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    found = license_scan.scan_licenses(docs, known).collect()
    return {r["doc_id"]: [(x["label"], x["first"], x["last"], x["coverage"]) for x in r["found"]] for r in found}


def edited(text, share, seed=1):
    chance, words = random.Random(seed), text.split()
    for _ in range(int(len(words) * share)):
        i = chance.randrange(len(words))
        words[i : i + 1] = chance.choice([["other"], [words[i], "more"], []])
    return " ".join(words)


def labels(found):
    return {i: sorted({x[0] for x in rows}) for i, rows in found.items()}


def test_notices_whole_edited_cut_and_reflowed(spark):
    mit, isc, bsd, apache = SHORT["mit"][0], SHORT["isc"][0], SHORT["bsd"][1], SHORT["apache"][0]
    words = mit.split()
    texts = [
        "Some words first. " + mit,
        edited(mit, 0.04),
        "\n\n * ".join(isc.upper().split(" ")),
        " ".join(apache.split()[: len(apache.split()) * 3 // 4]),
        # ten words put in near the middle
        " ".join([*words[:70], "here", "is", "a", "clause", "that", "the", "holder", "put", "in", "here", *words[70:]]),
        " ".join(reversed(words)),
        " ".join(words[: len(words) // 3]),
        bsd + "\n" + apache,
        edited(bsd, 0.03) + " and " + edited(mit, 0.03),
        None,
        "",
    ]
    got = labels(scan(spark, texts))
    want = [["mit"], ["mit"], ["isc"], ["apache"], ["mit"], [], [], ["apache", "bsd"], ["bsd", "mit"], [], []]
    assert got == dict(enumerate(want))


def test_places_and_coverage(spark):
    mit = SHORT["mit"][0]
    n = len(license_scan._words(mit))
    (one, two), *rest = scan(spark, [f"a b c {mit} " + "x " * 500 + mit])[0], None
    assert (one, two) == (("mit", 3, 3 + n, 1.0), ("mit", 3 + n + 500, 3 + 2 * n + 500, 1.0))


@pytest.mark.parametrize("name", ["GPL-2", "GPL-3", "Apache-2.0", "MPL-2.0", "LGPL-2.1"])
def test_long_texts(spark, name):
    text = (TEXTS / f"{name}.txt").read_text()
    label = re.match("[a-z]+", name.lower())[0]
    got = labels(scan(spark, [text, edited(text, 0.02), " ".join(text.split()[: len(text.split()) // 4])]))
    assert label in got[0] and label in got[1] and not set(got[2]) - {"gpl", "lgpl", "mpl", "apache"}


def test_creative_commons_variants_are_told_apart(spark):
    kinds = ["by", "by-sa", "by-nc", "by-nd", "by-nc-sa", "by-nc-nd"]
    texts = [f"This work is licensed under CC {k.upper()} 4.0" for k in kinds] + [f"Photo: licensed under CC {k.upper()} 4.0, 2019." for k in kinds]
    got = labels(scan(spark, texts))
    assert all(got[i] == [f"cc-{k}"] for i, k in enumerate(kinds))
    assert all(got[len(kinds) + i] in ([f"cc-{k}"], []) for i, k in enumerate(kinds)) and got[8] == ["cc-by-nc"]


def test_prose_about_licenses_has_none(spark):
    texts = [
        "The software is provided by our partner, and the license of the work is the subject of the following conditions.",
        "He got his MIT degree and a driving license; permission is granted to any person who asks.",
        "Redistribution of income and use of source material in binary forms of thinking.",
    ]
    assert labels(scan(spark, texts)) == {0: [], 1: [], 2: []}


def test_texts_full_of_hits_and_repeated_rows(spark):
    notice = "This work is licensed under CC BY-NC 4.0 "
    docs = spark.createDataFrame([(1, notice * 3000, "x")] * 3 + [(None, notice, "y"), (1, notice, "z")], "doc_id long, text string, label string")
    got = [(r["doc_id"], r["n_words"], sorted({x["label"] for x in r["found"]})) for r in license_scan.scan_licenses(docs).collect()]
    assert sorted(got, key=repr) == sorted([(1, 30_000, ["cc-by-nc"])] * 3 + [(None, 10, ["cc-by-nc"]), (1, 10, ["cc-by-nc"])], key=repr)


def test_brute_coverage(spark):
    known = {"one": ("a b c d e f g h",), "two": ("k l m n o p q r s t", "a b c x y z")}
    rng = random.Random(3)
    texts = [" ".join(rng.choice("abcdefgh") if i % 9 else "a b c d e f" for i in range(rng.randrange(3, 40))) for _ in range(60)]
    got = scan(spark, texts, known)
    for i, text in enumerate(texts):
        words = text.split()
        grams = {tuple(words[k : k + 3]) for k in range(len(words) - 2)}
        one = [tuple("abcdefgh"[k : k + 3]) for k in range(6)]
        # all of a short text is one span, whose share no larger than that of the whole text
        for label, _, _, coverage in got[i]:
            if label == "one":
                assert coverage <= sum(g in grams for g in one) / 6
        if re.search("a b c d e f", text):
            assert any(label == "one" for label, *_ in got[i]), text


def test_templates_are_public_texts():
    known = templates()
    assert {"mit", "apache", "gpl", "lgpl", "agpl", "bsd", "isc", "mpl", "zlib", "unlicense", "artistic", "cc0", "cc-by-nc"} <= set(known)
    assert all(len(license_scan._words(t)) >= 8 for texts in known.values() for t in texts)
