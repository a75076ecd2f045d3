"""Operators on texts against brute force, round trips and edge cases."""

import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixframe.llm import chat_format, components, fingerprint, language_id, license_scan, mixing, near_dedup, piece_codec, quality_classifier, quality_rules, token_counts
from helixframe.llm.queries import op5_license_scan, piece_model_path

ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, words__ string, n_words string, score string"
EDGE = [None, "", "   \n\t", "one", "a b", "a b c", "A B C d", "a\x0bb\x0cc\rd e", "Ünï cödé ▁ mark", "<s> </s> <unk> <0x0A>", "x" * 5000, "word " * 3000, "  two  spaces ", "nul\x00 byte", "l1\nl1\nl2\n\nl1", "é" * 40 + " ﬁ ①"]


def table(spark, texts, ids=None):
    """A documents table with extra columns whose names clash with those in use inside."""
    rows = [(i if ids is None else ids[i], t, None if i % 5 == 0 else "en", None if i % 7 == 0 else f"s{i % 2}", None, "x", "y", "z") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def random_texts(seed, n, words=60, vocabulary=400):
    rng = random.Random(seed)
    return [" ".join(rng.choice("abcdefghij") * rng.randint(1, 3) + str(rng.randrange(vocabulary)) for _ in range(rng.randint(1, words))) for _ in range(n)]


# operator 7


def shingles(text, size):
    w = [x for x in re.split(r"[ \t-\r]+", (text or "").translate(ASCII)) if x]
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)])


def brute_components(rows, size):
    sets = {i: shingles(t, size) for i, t in rows}
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def copies(seed, base_words, n, edits):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(10_000)}" for _ in range(base_words)]
    out = []
    for _ in range(n):
        own = list(base)
        for _ in range(rng.randint(0, edits)):
            own[rng.randrange(len(own))] = f"e{rng.randrange(40)}"
        if rng.random() < 0.3:
            own = own[: -rng.randint(1, 8)]
        out.append(" ".join(own))
    return out


@pytest.mark.parametrize("size,short,k", [(4, 24, 32), (5, 3, 32), (4, 2, 16)])
def test_near_duplicates_match_all_pairs(spark, size, short, k):
    passage = " ".join(f"p{i}" for i in range(30))
    texts = EDGE + copies(1, 100, 45, 5) + copies(2, 30, 30, 2) + [passage + " " + t for t in random_texts(3, 40)] + random_texts(4, 30) + ["same text here twice ok"] * 6
    ids = list(range(len(texts)))
    random.Random(5).shuffle(ids)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_dedup.near_duplicates(table(spark, texts, ids), size=size, short=short, k=k).collect()}
    want = brute_components(list(zip(ids, texts)), size)
    assert got == {i: (n, c, c == i) for i, (n, c) in want.items()}


@pytest.mark.parametrize("size", [4, 5])
def test_near_duplicates_of_short_texts(spark, size):
    """Pairs of 30 to 37 words, the third word from an end changed: near the threshold, with unions around k."""
    texts = []
    for n in range(30, 38):
        for i in range(6):
            w = [f"t{n}x{i}w{j}" for j in range(n)]
            texts += [" ".join(w), " ".join(w[:2] + ["other"] + w[3:] if i % 2 else w[:-3] + ["other"] + w[-2:])]
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(table(spark, texts), size=size).collect()}
    want = brute_components(list(enumerate(texts)), size)
    assert got == {i: c for i, (_, c) in want.items()}
    assert sum(got[i] == i - 1 for i in range(1, len(texts), 2)) > 30


def test_small_sets_of_few_symbols(spark, monkeypatch):
    """Many short texts over three letters share all their values; they meet by choices of values."""
    monkeypatch.setattr(near_dedup, "OPEN", 20)
    monkeypatch.setattr(near_dedup, "CROWDED", 2_000)
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choice("abc") for _ in range(rng.choice([6, 9, 13, 20, 20, 26])))) for i in range(700)]
    got = near_dedup.near_duplicates(table(spark, [t for _, t in rows]), size=4).select("doc_id", "n_shingles", "component_id").collect()
    assert {r[0]: (r[1], r[2]) for r in got} == brute_components(rows, 4)


def test_subset_keys_are_shared_by_links():
    """Two sets that are linked have a key in common, whatever their sizes below 25."""
    rng = np.random.default_rng(8)
    for _ in range(600):
        union = rng.integers(-(2**62), 2**62, rng.integers(1, 25))
        lost = rng.permutation(len(union))[: len(union) // 5]
        at = rng.integers(0, len(lost) + 1)
        a, b = np.sort(np.delete(union, lost[:at])), np.sort(np.delete(union, lost[at:]))
        both = set(near_dedup._subset_keys(a).tolist()) & set(near_dedup._subset_keys(b).tolist())
        assert both or min(len(a), len(b)) >= near_dedup.BANDED


def test_near_duplicates_empty_and_repeated(spark):
    assert near_dedup.near_duplicates(table(spark, [])).count() == 0
    rows = near_dedup.near_duplicates(table(spark, ["a b c d e f"] * 3 + [None, None], [4, 4, 2, 9, 9])).collect()
    assert sorted((r["doc_id"], r["component_id"], r["kept"]) for r in rows) == [(2, 2, True), (4, 2, False), (4, 2, False), (9, 9, True), (9, 9, True)]


def test_components(spark):
    links = [(1, 2), (2, 3), (9, 8), (8, 7), (7, 3), (20, 21), (5, 5), (None, 4)]
    got = components.components(spark.createDataFrame(links, "a long, b long"))
    assert dict(map(tuple, got.collect())) == {1: 1, 2: 1, 3: 1, 7: 1, 8: 1, 9: 1, 20: 20, 21: 20}


# operator 4


def brute_rules(text):
    text = text or ""
    w = [x for x in re.split(r"[ \t-\r]+", text) if x]
    windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    twice = {x for x in windows if windows.count(x) > 1} if len(windows) < 500 else set(windows)
    covered = {j for i, x in enumerate(windows) if x in twice for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if re.search(r"[^ \t-\r]", x)]
    failed = len(w) < 20 or 100 * len(covered) > 30 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed


def test_base_rules(spark):
    again = " ".join(f"w{i}" for i in range(40))
    texts = EDGE + random_texts(1, 30, 80) + [f"{again} tail {again}", f"{again}\n{' '.join(again.split()[:9])} end", "a b " * 20, "# $ %% <b> | * & x\n" * 3]
    got = {r["doc_id"]: (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in quality_rules.quality_rules(table(spark, texts)).collect()}
    assert got == {i: brute_rules(t) for i, t in enumerate(texts)}


def test_outliers(spark):
    rng = random.Random(3)
    clean = [" ".join(rng.choice(["alpha", "beta", "gamma", "delta", "to", "of"]) + str(rng.randrange(99)) for _ in range(rng.randint(40, 300))) for _ in range(300)]
    odd = [" ".join(f"w{rng.randrange(500)}$$$" for _ in range(100)) for _ in range(30)]
    rows = [(i, t, "en", "s", None, "", "", "") for i, t in enumerate(clean + odd)]
    out = quality_rules.quality_rules(spark.createDataFrame(rows, SCHEMA)).select("doc_id", "kept", "base_failed").collect()
    assert all(r["kept"] == (r["doc_id"] < 300) for r in out)
    assert quality_rules.quality_rules(table(spark, [])).count() == 0


def test_cutoff_is_the_quantile_it_names():
    assert len(quality_rules.FEATURES) == 6
    beyond = lambda x, terms: math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(terms))
    assert beyond(quality_rules.CUTOFF, 3) == pytest.approx(1e-6, rel=0.01)
    low, high = 0.0, 50.0
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if beyond(middle, 3) > 1 - quality_rules.SUBSET else (low, middle)
    assert quality_rules.CONSISTENCY == pytest.approx(quality_rules.SUBSET / (1 - beyond(low, 4)), rel=1e-3)


def test_estimates_match_all_subsets(spark):
    """Small groups: the determinant found is the least one over all subsets of three quarters of the rows."""
    from itertools import combinations

    from helixframe.llm.common import Scratch

    rng = np.random.default_rng(3)
    p = len(quality_rules.FEATURES)
    floors = np.diag([f**2 for _, f in quality_rules.FEATURES.values()])
    groups = {"a": rng.normal(0, 0.3, (12, p)), "b": rng.normal(2, 0.5, (9, p)), "c": rng.normal(0, 0.1, (10, p)), "one": np.ones((1, p)), "two": rng.normal(0, 1, (2, p))}
    groups["a"][:3] += 6
    groups["c"][4:6] -= 4
    rows = [(g, *map(float, x)) for g, own in groups.items() for x in own]
    df = spark.createDataFrame(rows, "g string, " + ", ".join(f"x{i} double" for i in range(p)))
    got = {r["g"]: r for r in quality_rules.mcd(df, Scratch(spark)).collect()}
    for g, own in groups.items():
        h = math.ceil(quality_rules.SUBSET * len(own))
        least = min(np.linalg.slogdet(np.cov(own[list(s)].T, bias=True).reshape(p, p) * quality_rules.CONSISTENCY + floors)[1] if h > 1 else np.linalg.slogdet(floors)[1] for s in combinations(range(len(own)), h))
        assert got[g]["n"] == len(own) and got[g]["log_det"] == pytest.approx(least, abs=1e-6 if g in "ac" else 0.5)


def test_groups_that_differ_have_their_own_estimates(spark):
    """Two small sources of one language, one with a symbol in each word: each row is judged by its own source."""
    rng = random.Random(8)
    text = lambda end: " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) + str(rng.randrange(99)) + end for _ in range(rng.randint(60, 90)))
    rows = [(i, text(""), "aa", "s0", None, "", "", "") for i in range(25)] + [(i, text("$"), "aa", "s1", None, "", "", "") for i in range(25, 50)]
    rows += [(50, text("$"), "aa", "s0", None, "", "", ""), (51, text(""), None, None, None, "", "", "")]
    out = {r["doc_id"]: r for r in quality_rules.quality_rules(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(out[i]["kept"] for i in range(50)) and not out[50]["kept"] and out[51]["kept"]


def test_small_groups_are_not_pooled_across_languages(spark):
    """Two languages of 60 rows, one with a symbol in each word: a row of the other that has them too is an outlier."""
    rng = random.Random(6)
    text = lambda end: " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) + str(rng.randrange(99)) + end for _ in range(rng.randint(40, 200)))
    rows = [(i, text(""), "aa", f"s{i % 3}", None, "", "", "") for i in range(60)] + [(i, text("$"), "bb", "s0", None, "", "", "") for i in range(60, 120)]
    rows.append((120, text("$"), "aa", "s0", None, "", "", ""))
    out = quality_rules.quality_rules(spark.createDataFrame(rows, SCHEMA)).select("doc_id", "kept").collect()
    assert all(r["kept"] == (r["doc_id"] < 120) for r in out)


# operator 5


def brute_base(text):
    w = [x for x in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(ASCII)) if x]
    at = {k: [i for i in range(len(w) - len(p) + 1) if tuple(w[i : i + len(p)]) == p] for k, p in license_scan.PHRASES.items()}
    every = sorted(i for x in at.values() for i in x)
    return len(w), len(every), every[0] if every else None, every[-1] if every else None, ",".join(sorted(k for k, x in at.items() if x))


def test_license_scan(spark):
    fill = random_texts(8, 6, 200)
    found = {"gpl-3.0": "This work is licensed under the GNU General Public License, version 3.", "apache-2.0": "Licensed under the Apache License, Version 2.0.", "mit": "Released under the MIT License.", "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0."}
    texts = EDGE + [f"{fill[i]} {notice} {fill[i + 1]}" for i, notice in enumerate(found.values())] + ["All rights reserved. ALL RIGHTS RESERVED", "cc by cc by", "é cc by", "the mit"]
    rows = license_scan.scan(table(spark, texts)).collect()
    got = {r["doc_id"]: (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in rows}
    assert got == {i: brute_base(t) for i, t in enumerate(texts)}
    labels = {r["doc_id"]: r["labels"].split(",") for r in rows}
    for i, label in enumerate(found):
        assert label in labels[len(EDGE) + i]
    assert all(0 <= r["score"] <= 1 for r in rows)
    assert license_scan.scan(table(spark, [])).count() == 0


def brute_labels(text, containment=0.8):
    """Labels of notices that stand together, and of all blocks that meet the threshold."""
    w = [x for x in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(ASCII)) if x]
    own, contained = set(), set()
    for _, label, family, t, span in license_scan._template_rows():
        width = license_scan.FAMILIES[family][1]
        meets = lambda held: len(held & set(t)) >= containment * len(t) - 1e-9
        for s in range(0, len(w), width // 2):
            block = w[s : s + width]
            if meets(set(block)):
                contained.add(label)
                parts = [set(block[i : i + span]) for i in range(max(1, len(block) - span + 1))]
                if any(meets(held) and held >= set(t) & license_scan.NAMING for held in parts):
                    own.add(label)
    return own | {x for x in brute_base(text)[4].split(",") if x}, contained


def test_scattered_words_are_no_notice(spark):
    """Blocks that meet the threshold are reported, and labelled only where the words stand together. Also: a very
    long text, null and repeated ids."""
    texts = [
        "the film was released in spring under heavy rain and a license fee was paid by mit students",
        "MIT said the patent license was released",
        "an apache pilot got the license under version 2 0 of the rules",
        "It is released under the MIT License.",
        "Licensed under the Apache License, Version 2.0",
        "word " * 150_000 + "released under the mit license " + "more " * 50_000,
        None,
    ]
    rows = license_scan.scan(table(spark, texts, [None, 1, 1, 2, 2, 3, None]), keep=("doc_id", "source")).collect()
    by = sorted((r["n_words"], r["labels"], r["contained"], r["containment"]) for r in rows)
    assert [x[1] for x in by] == ["", "", "mit", "apache-2.0", "", "", "mit"]
    assert by[1][2:] == ("mit", 0.8) and [x[2] for x in by][4:6] == ["apache-2.0", "mit"]


def test_license_join_is_exact(spark):
    """Every label that a check of all blocks against all templates finds, and no other: whole notices, shuffled
    ones, and ones that lack words up to the threshold and one more."""
    rng = random.Random(2)
    rows = license_scan._template_rows()
    texts = []
    for i in range(150):
        t = list(rows[i % len(rows)][3])
        most = len(t) - math.ceil(0.8 * len(t) - 1e-9)
        for x in rng.sample([x for x in t if x not in license_scan.NAMING or i % 7 == 0], min(most + i % 2, len(t) - 3)):
            t[t.index(x)] = "other"
        rng.shuffle(t)
        texts.append(" ".join(random_texts(i, 1, 90)[0].split() + t + random_texts(i + 99, 1, 190)[0].split()))
    got = license_scan.scan(table(spark, texts)).collect()
    want = {i: ",".join(sorted(brute_labels(text)[0])) for i, text in enumerate(texts)}
    assert {r["doc_id"]: r["labels"] for r in got} == want
    assert {r["doc_id"]: r["contained"] for r in got} == {i: ",".join(sorted(brute_labels(text)[1])) for i, text in enumerate(texts)}
    assert len({x for v in want.values() for x in v.split(",")}) > 12 and sum(v == "" for v in want.values()) > 20


def test_license_notices_in_a_text(spark, tmp_path):
    """The query labels real notices, also with a word changed, and none that lacks a naming word."""
    gpl = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"
    cases = {gpl: ["gpl", "gpl-3.0"], mit: ["mit"], mit.replace("hereby ", "").replace("publish", "print"): ["mit"], "Licensed under the Apache License 2.0.": ["apache-2.0"], "Licensed under CC BY-SA 4.0": ["cc-by", "cc-by-sa-4.0"], "Released under the BSD License": [""], gpl.replace("3", "9").replace("GNU", "ABC"): ["gpl"], "long " * 300 + gpl.lower() + " tail" * 300: ["gpl", "gpl-3.0"]}
    table(spark, list(cases)).write.parquet(f"{tmp_path}/documents.parquet")
    labels = [r["labels"].split(",") for r in op5_license_scan(spark, str(tmp_path)).orderBy("doc_id").collect()]
    assert labels == list(cases.values())
    assert all(len(text.split()) <= license_scan.FAMILIES[-1][0] for some in license_scan.TEMPLATES.values() for text in some)
    lacking = [math.floor(len(t) - math.ceil(0.8 * len(t) - 1e-9)) for *_, t, _ in license_scan._template_rows()]
    assert min(lacking) >= 1


# operators 3 and 10


def test_counts_match_library(spark):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=piece_model_path())
    texts = EDGE + random_texts(12, 20) + ["Straße l'été. " * 30, "日本語 テキスト", "🙂 emoji", "a▁b ▁", " lead", "trail ", "\n"]
    ids = [None if i % 9 == 0 else i // 2 for i in range(len(texts))]
    got = token_counts.count_tokens(table(spark, texts, ids), piece_model_path(), slice_chars=500).collect()
    assert sorted((r["text"] or "", r["n_tokens"]) for r in got) == sorted((t or "", len(library.encode(t or ""))) for t in texts)
    assert token_counts.count_tokens(table(spark, []), piece_model_path()).count() == 0


def test_tokens_match_library(spark):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=piece_model_path())
    texts = EDGE + random_texts(11, 20) + ["Straße l'été. " * 30, "日本語 テキスト", "🙂 emoji", "a▁b ▁", " lead", "trail ", "\n"]
    docs = table(spark, texts)
    want = [library.encode(t or "") for t in texts]
    coded = piece_codec.encode(docs, piece_model_path())
    rows = {r["doc_id"]: r for r in coded.collect()}
    assert {i: r["input_ids"] for i, r in rows.items()} == dict(enumerate(want))
    assert all(r["round_trip"] and r["parity"] for r in rows.values())
    back = {r["doc_id"]: r["decoded"] for r in piece_codec.decode(coded, piece_model_path()).collect()}
    assert back == {i: (t or "").replace("▁", " ") for i, t in enumerate(texts)}
    assert piece_codec.encode(table(spark, []), piece_model_path()).count() == 0


def unigram_file(path, squeeze=True, fallback=True):
    """A unigram model of a few pieces, written field by field."""
    import struct

    def varint(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    field = lambda number, data: varint(number << 3 | 2) + varint(len(data)) + data
    flag = lambda number, n: varint(number << 3) + varint(n)
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)]
    if fallback:
        pieces += [(f"<0x{b:02X}>", 0.0, 6) for b in range(256)]
    pieces += [(p, -s, 1) for p, s in [("▁", 2.5), ("▁a", 2.0), ("a", 3.0), ("b", 3.1), ("ab", 2.75), ("▁ab", 3.5), ("c", 3.6), ("bc", 4.0), ("abc", 5.25), ("▁abc", 6.5), ("▁the", 4.5), ("t", 5.0), ("h", 5.1), ("e", 4.2), ("he", 5.5), ("ca", 6.0)]] + [("<sep>", 0.0, 4)]
    data = b"".join(field(1, field(1, p.encode()) + varint(2 << 3 | 5) + struct.pack("<f", s) + flag(3, k)) for p, s, k in pieces)
    data += field(2, flag(3, 1) + flag(4, len(pieces)) + flag(35, int(fallback)) + flag(40, 0) + flag(41, 1) + flag(42, 2) + varint(43 << 3) + b"\xff" * 9 + b"\x01")
    data += field(3, field(1, b"identity") + flag(3, 1) + flag(4, int(squeeze)) + flag(5, 1))
    path.write_bytes(data)
    return str(path)


@pytest.mark.parametrize("squeeze", [True, False])
def test_unigram_files_are_rebuilt(spark, tmp_path, squeeze):
    """Unigram scores, squeezed spaces, pieces of the user and byte fallback, against the SentencePiece library."""
    import sentencepiece

    path = unigram_file(tmp_path / "uni.model", squeeze)
    library, rng = sentencepiece.SentencePieceProcessor(model_file=path), random.Random(4)
    texts = ["", "a", " abc  ab ", "the cab", "é🙂 z", "a<sep>b", "  ", None, "x" * 50] + ["".join(rng.choice("aabbcc the<>") for _ in range(rng.randint(1, 60))) for _ in range(150)]
    rows = {r["doc_id"]: r for r in piece_codec.encode(table(spark, texts), path).collect()}
    assert {i: r["input_ids"] for i, r in rows.items()} == {i: library.encode(t or "") for i, t in enumerate(texts)}
    assert all(r["parity"] for r in rows.values())
    if not squeeze:
        assert all(r["round_trip"] for r in rows.values())


def test_lone_marker_is_compared(monkeypatch):
    """A rebuilt tokenizer that drops a trailing space gives no parity for a text that ends in one; ids stay the library's."""
    from types import SimpleNamespace

    good = piece_codec.rebuild(piece_model_path())
    texts = ["two words", "trail "]
    right = list(piece_codec._codec(piece_model_path())(texts))
    assert [same for _, _, same in right] == [True, True]
    worse = SimpleNamespace(encode=lambda t, **k: good.encode(t.rstrip(" "), **k), encode_batch_fast=good.encode_batch_fast, decode=good.decode, decode_batch=good.decode_batch)
    monkeypatch.setattr(piece_codec, "rebuild", lambda path: worse)
    rows = list(piece_codec._codec.__wrapped__(piece_model_path())(texts))
    assert [same for _, _, same in rows] == [True, False]
    assert [ids.tolist() for ids, _, _ in rows] == [ids.tolist() for ids, _, _ in right]


# operator 6


def test_edit_study(spark):
    texts = EDGE + random_texts(21, 40)
    ids = [3 * i for i in range(len(texts))]
    for parts in (1, 7):
        rows = {r["doc_id"]: r for r in fingerprint.edit_study(table(spark, texts, ids), parts).collect()}
        order = sorted(zip(ids, texts), reverse=True)
        for at, (i, t) in enumerate(order):
            t, after = t or "", order[(at + 1) % len(order)][1] or ""
            k = len(t) // 3
            edited = t[: len(t) - k] + after[:k]
            r = rows[i]
            assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
            assert (r["fingerprint"], r["edited_fingerprint"]) == (fingerprint.digest(t), fingerprint.digest(edited))
            assert r["near_edited"] == fingerprint.likeness(fingerprint.digest(t), fingerprint.digest(edited))
            assert r["near_next"] == fingerprint.likeness(fingerprint.digest(t), fingerprint.digest(after))
    assert fingerprint.edit_study(table(spark, []), 3).count() == 0
    alone = fingerprint.edit_study(table(spark, ["only one here"]), 3).first()
    assert alone["near_next"] == 1.0


def plain_digest(text):
    """The digest's definition in plain Python, byte by byte."""
    data, counts, word = text.encode(), [0] * 256, 0xFFFFFFFF
    for i in range(len(data)):
        for salt, (a, b) in enumerate(((1, 2), (1, 3), (2, 3), (1, 4), (2, 4), (3, 4))):
            if i + b < len(data):
                v = (data[i] | data[i + a] << 8 | data[i + b] << 16 | salt << 24) * 0x9E3779B1 & word
                counts[((v ^ v >> 15) * 0x85EBCA6B & word) >> 24] += 1
    low, middle, high = (sorted(counts)[i] for i in (63, 127, 191))
    bits = "".join(f"{(c > low) + (c > middle) + (c > high):02b}" for c in counts)
    return f"{min(255, round(8 * math.log2(1 + len(data)))):02x}{int(bits, 2):0128x}"


def plain_likeness(a, b):
    codes = lambda x: [int(f"{int(x[2:], 16):0512b}"[i : i + 2], 2) for i in range(0, 512, 2)]
    apart = sum(6 if abs(x - y) == 3 else abs(x - y) for x, y in zip(codes(a), codes(b)))
    return 1 - min(512, apart + min(48, max(0, abs(int(a[:2], 16) - int(b[:2], 16)) - 1))) / 512


def test_digests_match_plain_python():
    """Also texts over the size that is worked on at once, ties of bucket counts, and few bytes."""
    rng = random.Random(4)
    long = "".join(rng.choice("abcdefg é") for _ in range(300_000))
    texts = ["", "a", "ab", "abc", "abcd", "aaaa" * 9, "é🙂" * 40, long, long[: (1 << 18) - 1], "tie " * 2000, *[t for t in EDGE if t], *random_texts(9, 5)]
    made = [fingerprint.digest(t) for t in texts]
    assert made == [plain_digest(t) for t in texts]
    assert all(fingerprint.likeness(a, b) == plain_likeness(a, b) for a in made for b in made[:9])


def test_fingerprint_columns(spark):
    docs = fingerprint.fingerprints(table(spark, [None, "", "abc def ghi", "abc def ghi"]))
    got = [r["fingerprint"] for r in docs.orderBy("doc_id").collect()]
    assert got[0] == got[1] and got[2] == got[3] != got[0]
    assert docs.select(fingerprint.likeness_column(F.col("fingerprint"), F.col("fingerprint")).alias("x")).distinct().collect()[0]["x"] == 1.0
    assert fingerprint.difference(got[0], got[2]) == fingerprint.difference(got[2], got[0]) > 0


# operator 9


def test_chats(spark):
    tricky = [r"\### Assistant: </turn> ok", "ends in \\", "\n</turn>\n", "\n</part>\n### user: x", "", None, "### ", "\\\\</part>", "a: b", "</turn", ">"]
    rng = random.Random(1)
    rows = []
    for conv in range(30):
        rows += [(conv, turn, rng.choice(["user", "assistant", "system", "odd: role\\n\n", None]), rng.choice(tricky), "extra") for turn in range(rng.randint(1, 7))]
    rows += [(99, 1, "user", "tie"), (99, 1, "user", "tie"), (99, None, "assistant", "first")] and [(99, 1, "user", "tie", ""), (99, 1, "user", "tie", ""), (99, None, "assistant", "first", "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, turns string").repartition(3)
    out = {r["conv_id"]: r for r in chat_format.read_back(chat_format.format_chats(df)).collect()}
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        assert [(t["role"], t["text"]) for t in out[conv]["turns"]] == [(r[2] or "", r[3] or "") for r in own]
        assert out[conv]["learned"] == [r[3] or "" for r in own if r[2] == "assistant"]
    merged = chat_format.format_chats(spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "user", "b"), (1, 2, "assistant", "c")], "conv_id long, turn long, role string, text string")).first()["formatted"]
    assert merged == "### user: a\n</part>\nb\n</turn>\n### assistant: c\n</turn>\n"
    assert chat_format.format_chats(df.limit(0)).count() == 0


def test_chats_of_many_turns_and_long_runs(spark):
    """100,000 turns, and a million backslashes, take seconds, not their square."""
    import time

    turns = spark.range(100_000).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 5 < 2, "user").otherwise("assistant").alias("role"), F.concat(F.lit("said 🙂 "), "id").alias("text"))
    slashes = "\\" * 1_000_000
    runs = spark.createDataFrame([(2, 0, "user", slashes), (2, 1, "assistant", slashes + "### "), (2, 2, "assistant", "x" + slashes + "</part>" + slashes)], "conv_id int, turn long, role string, text string")
    began = time.time()
    out = {r["conv_id"]: r for r in chat_format.read_back(chat_format.format_chats(turns.unionByName(runs))).collect()}
    assert time.time() - began < 60
    assert [t["text"] for t in out[1]["turns"]] == [f"said 🙂 {i}" for i in range(100_000)]
    assert out[1]["learned"] == [f"said 🙂 {i}" for i in range(100_000) if i % 5 >= 2]
    assert out[2]["learned"] == [slashes + "### ", "x" + slashes + "</part>" + slashes] and out[2]["turns"][0]["text"] == slashes


# operator 8


def test_raking_meets_every_margin(spark):
    """Weights equal those of a plain raking in numpy, and every margin's shares are its targets."""
    rng = np.random.default_rng(0)
    rows = [(f"a{i}", f"b{j}", f"c{k}", float(rng.integers(1, 100))) for i in range(5) for j in range(4) for k in range(3)]
    cells = spark.createDataFrame(rows, "a string, b string, c string, tokens double")
    targets = {m: mixing.targets_of(cells, m, power=0.4) for m in "abc"}
    got = mixing.rake(cells, targets, tolerance=1e-9).toPandas().sort_values(["a", "b", "c"])
    tokens = np.array([r[3] for r in sorted(rows)]).reshape(5, 4, 3)
    brute = tokens.copy()
    for _ in range(200):
        for axis, m in enumerate("abc"):
            own = tokens.sum(tuple(x for x in range(3) if x != axis)) ** 0.4
            shape = [-1 if x == axis else 1 for x in range(3)]
            now = brute.sum(tuple(x for x in range(3) if x != axis))
            brute = brute * (own / own.sum() * tokens.sum() / now).reshape(shape)
    assert (got.tokens * got.weight).to_numpy() == pytest.approx(brute.ravel(), rel=1e-6)


def test_mixture_attains_targets(spark):
    """Kept tokens have the given shares, within the budget; a category with too few tokens gives all."""
    rng = random.Random(3)
    rows = [(i, rng.choice(["en"] * 6 + ["de"] * 3 + ["fr"]), rng.choice(["web"] * 8 + ["book", None]), rng.randint(1, 90), "clash", 1.0) for i in range(20_000)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, source string, n long, weight string, mix_kept double")
    given = {"lang": {"en": 0.4, "de": 0.35, "fr": 0.25}, "source": {"book": 0.15}}
    mixed = mixing.mix(docs, ("lang", "source"), F.col("n"), given, {"source": 0.5}, budget=0.3)
    assert set(docs.columns) < set(mixed.columns) and mixed.count() == 20_000
    total = mixed.agg(F.sum("n"), F.sum(F.when(F.col("mix_kept"), F.col("n")))).first()
    assert total[1] / total[0] == pytest.approx(0.3, rel=0.05)
    for margin in ("lang", "source"):
        for r in mixing.attained(mixed, margin, given[margin], 0.5).collect():
            assert r["expected"] == pytest.approx(r["target"], rel=1e-3) and r["kept"] == pytest.approx(r["target"], rel=0.12)
            assert r["target"] == pytest.approx(given[margin].get(r["category"], r["target"]))
    again = mixing.mix(docs.repartition(7), ("lang", "source"), F.col("n"), given, {"source": 0.5}, budget=0.3)
    assert {r["doc_id"] for r in mixed.filter("mix_kept").collect()} == {r["doc_id"] for r in again.filter("mix_kept").collect()}
    scarce = mixing.mix(docs, ("lang",), F.col("n"), {"lang": {"fr": 0.6, "en": 0.2, "de": 0.2}}, budget=0.5).groupBy("lang").agg(F.max("mix_probability").alias("p"))
    chance = {r["lang"]: r["p"] for r in scarce.collect()}
    assert chance["fr"] == pytest.approx(1, abs=1e-6) and chance["en"] < 1
    assert mixing.mix(docs.limit(0), ("lang",), F.col("n")).count() == 0


def test_topics_follow_content(spark):
    """Texts of two vocabularies get different topics, whatever their length; no words, no topic."""
    rng = random.Random(5)
    own = ["planet orbit stellar comet galaxy".split(), "butter flour sugar oven whisk".split()]
    texts = [" ".join(rng.choice(own[i % 2]) for _ in range(rng.randint(20, 2000))) for i in range(60)]
    docs = table(spark, texts + [None, "", "a of"]).withColumn("topic", F.lit("old"))
    got = {r["doc_id"]: r for r in mixing.with_topics(docs, tokens_out="n_tokens", topics=2).collect()}
    assert {got[i]["topic"] for i in range(0, 60, 2)}.isdisjoint({got[i]["topic"] for i in range(1, 60, 2)})
    assert len({r["topic"] for r in got.values()}) == 3 and [got[i]["topic"] for i in (60, 61, 62)] == ["none"] * 3
    assert all(got[i]["n_tokens"] == len(t.split()) for i, t in enumerate(texts))
    assert mixing.with_topics(table(spark, [])).count() == 0


# operators 1 and 2


def test_languages(spark):
    said = {"xx": "the quick brown fox of this land and that".split(), "yy": "der schnelle braune fuchs und das land ist".split(), "zz": "le renard brun rapide est dans la forêt".split()}
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choices(said[k], k=15)), k) for i, k in enumerate(rng.choices(list(said), k=150))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(docs.filter("doc_id % 5 <> 0"))
    got = language_id.predict(docs, model, keep=("doc_id", "lang")).collect()
    assert all(r["lang"] == r["lang_pred"] and 0 <= r["score"] <= 1 for r in got)
    unseen = language_id.predict(table(spark, ["schnellste fuchse", "123 !", None, ""]), model).orderBy("doc_id").collect()
    assert [r["lang_pred"] for r in unseen] == ["yy", "und", "und", "und"]
    signs = language_id.predict(table(spark, ["½ ² ①", "Ⅷ", "²", "der² das"]), model).orderBy("doc_id").collect()
    assert [r["lang_pred"] for r in signs] == ["und", "und", "und", "yy"]
    nothing = language_id.fit(docs.filter("false"))
    assert {r["lang_pred"] for r in language_id.predict(docs, nothing).collect()} == {"und"}
    assert len(language_id.predict(table(spark, EDGE), model).collect()) == len(EDGE)


def test_quality_classifier(spark):
    rng = random.Random(9)
    text = lambda f: " ".join(f(f"w{chr(97 + rng.randrange(26))}{chr(97 + rng.randrange(26))}") + (". Then" if j % 9 == 8 else "") for j in range(60)) + "."
    good = [text(lambda w: w) for _ in range(200)]
    bad = [text(lambda w: w + "$$$") for _ in range(20)] + [text(lambda w: w.upper() + "!!") for _ in range(20)] + ["same " * 50] * 10
    out = quality_classifier.classify(table(spark, good + bad + EDGE)).orderBy("doc_id").collect()
    assert all(r["quality_kept"] == (i < 200) for i, r in enumerate(out[:250]))
    assert all(0 <= r["quality_score"] <= 1 for r in out)
    assert quality_classifier.classify(table(spark, [])).count() == 0


def test_expectation_maximisation_recovers_accuracies():
    rng = np.random.default_rng(1)
    truth = rng.random(20_000) < 0.8
    rates = [0.9, 0.8, 0.7, 0.85, 0.95]
    votes = np.stack([np.where(rng.random(truth.size) < r, truth, ~truth).astype(int) for r in rates], 1)
    rows, counts = np.unique(votes, axis=0, return_counts=True)
    either = np.array([quality_classifier.PRIOR_TWO_SIDED] * 5).transpose(1, 0, 2)
    model = quality_classifier.estimate([str(i) for i in range(5)], rows, counts.astype(float), expected=either)
    assert abs(model.prior - 0.8) < 0.03
    assert np.allclose(model.votes[1, :, 1], rates, atol=0.03)


def test_estimates_of_the_query_follow_the_data():
    """With the priors that the query uses: one-sided labellers get no votes that they can't cast, and shares come out as drawn."""
    rng = np.random.default_rng(2)
    names = ["vote__symbols", "vote__letters", "vote__echoes", "vote__variety", "vote__sentences"]
    good = rng.random(40_000) < 0.85
    bad_rates, false_rates, good_rates = [0.7, 0.5, 0.3, 0.3, 0.2], [0.002, 0.01, 0.001, 0.01, 0.02], [0, 0, 0, 0.9, 0.8]
    votes = np.full((good.size, 5), -1)
    for i, (b, f, g) in enumerate(zip(bad_rates, false_rates, good_rates)):
        draw = rng.random(good.size)
        votes[:, i] = np.where(good, np.where(draw < f, 0, np.where(draw < f + g, 1, -1)), np.where(draw < b, 0, -1))
    rows, counts = np.unique(votes, axis=0, return_counts=True)
    model = quality_classifier.estimate(names, rows, counts.astype(float))
    assert abs(model.prior - 0.85) < 0.01
    assert (model.votes[:, :3, 1] == 0).all()
    assert np.allclose(model.votes[0, :, 0], bad_rates, atol=0.03) and np.allclose(model.votes[1, :, 0], false_rates, atol=0.01)
    assert np.allclose(model.votes[1, 3:, 1], good_rates[3:], atol=0.02)


def test_quality_classifier_on_hard_rows(spark):
    """Null and repeated ids, a very long text, columns with names used inside."""
    long = " ".join(f"word{i % 999} and then." for i in range(60_000))
    rows = [(None, t, None, None, None, "x", "y", "z") for t in ["Some plain words here. More of them follow."] * 30 + [long, None, ""]]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("vote__symbols", F.lit("kept")).withColumn("letters__", F.lit("kept"))
    out = quality_classifier.classify(docs, sample_rows=10).collect()
    assert len(out) == 33 and all(0 <= r["quality_score"] <= 1 and r["vote__symbols"] == "kept" for r in out)
    assert len({r["quality_score"] for r in out[:30]}) == 1


def test_quality_scorer_learns_from_every_row(spark):
    """Of more rows than the 8,000 that were drawn once, each bad one teaches its own words."""
    from helixframe.llm.common import Scratch

    own = [f"own{i}$$$" for i in range(20)]
    bad = spark.createDataFrame([(i, " ".join([f"b{i}$$$"] * 3 + [w] * 9)) for i, w in enumerate(own)], "doc_id long, text string")
    good = spark.range(100, 16_100).select(F.col("id").alias("doc_id"), F.concat(F.lit("Some plain words here and there. More of them number "), "id", F.lit(" follow.")).alias("text"))
    voted, names = quality_classifier.voted_vectors(good.unionByName(bad), Scratch(spark))
    assert voted.count() == 16_020
    weights = quality_classifier.fit_scorer(voted, quality_classifier.fit_labellers(voted, names))
    assert all(weights[quality_classifier.features(w)[0][0]] < 0 for w in own)
    # sparse vectors hold what the scorer adds up
    text = "a b a b. C"
    at, x = quality_classifier.features(text)
    dense = np.bincount(at, x, 1 << quality_classifier.BITS)
    got = quality_classifier.voted_vectors(table(spark, [text, None]), Scratch(spark))[0].collect()
    assert any(np.allclose(r["features"].toArray(), dense) for r in got) and any(r["features"].toArray()[0] == 1 for r in got)


def test_language_model_counts_every_string(spark):
    """The model's tables against counts in plain Python, over all strings of the sample."""
    from collections import Counter

    rows = [(i, "Été l'ami Ⅷx ½ straße der der", "fr" if i % 2 else "de") for i in range(6)] + [(9, None, "de"), (10, "x", None)]
    model = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    own = {k: Counter(w for _, t, lang in rows if t and lang == k for w in re.findall(r"[a-zéß]+", t.lower())) for k in ("de", "fr")}
    assert model.languages == ["de", "fr"] and set(model.words) == set(own["de"])
    for w, got in model.words.items():
        assert got == pytest.approx([math.log((own[k][w] + 0.5) / own[k].total()) for k in ("de", "fr")])
    for size in (1, 2, 3, 4):
        grams = Counter()
        for w, n in own["fr"].items():
            for i in range(len(w) + 3 - size):
                grams[f"<{w}>"[i : i + size]] += n
        assert {g for g in model.grams if len(g) == size} == set(grams)
        assert all(model.grams[g][1] == pytest.approx(math.log((n + 0.5) / grams.total())) for g, n in grams.items())


def test_topics_are_fitted_on_all_texts(spark):
    """The centroids are those of nearest-mean rounds over every text, however many copies a text has; no draw takes part."""
    docs = table(spark, ["alpha beta alpha" if i % 3 else "gamma delta epsilon zeta" for i in range(60)])
    got = mixing.with_topics(docs, topics=2, rounds=2).select("text", "topic").distinct().collect()
    assert len(got) == 2 and len({r["topic"] for r in got}) == 2
    with pytest.raises(TypeError):
        mixing.with_topics(docs, sample_rows=10)


def test_quality_classifier_hashes_texts_once(spark, tmp_path):
    """What is scored are the features written for training, not the texts again; scores are those of the weights."""
    path = str(tmp_path / "docs")
    texts = ["Some plain words here. More of them follow.", "$$ ## $$ || ## $$", None, "", "a😀 b".encode("utf-16", "surrogatepass").decode("utf-16")] * 20
    table(spark, texts).write.parquet(path)
    docs = spark.read.parquet(path)
    out = quality_classifier.classify(docs, keep=("doc_id",))
    assert out.columns == ["doc_id", "quality_score", "quality_kept"]
    assert not any(path in f for f in out.inputFiles())
    every = quality_classifier.classify(docs)
    assert every.columns == [*docs.columns, "quality_score", "quality_kept"] and not any(path in f for f in every.inputFiles())
    rows = every.orderBy("doc_id").collect()
    assert [r["text"] for r in rows] == texts and {r["doc_id"]: r["quality_score"] for r in rows} == {r["doc_id"]: r["quality_score"] for r in out.collect()}
    assert rows[0]["quality_kept"] and not rows[1]["quality_kept"] and rows[2]["quality_score"] == rows[3]["quality_score"]


def test_topics_read_texts_once(spark, tmp_path):
    """Topics and numbers of words come from profiles written in one pass over the texts."""
    path = str(tmp_path / "docs")
    texts = ["alpha beta alpha", "gamma delta epsilon zeta", None, "", "a b"] * 6
    table(spark, texts).write.parquet(path)
    docs = spark.read.parquet(path)
    out = mixing.with_topics(docs, tokens_out="n", topics=2, keep=("doc_id",))
    assert out.columns == ["doc_id", "n", "topic"] and not any(path in f for f in out.inputFiles())
    got = [(r["n"], r["topic"]) for r in out.orderBy("doc_id").collect()]
    assert [n for n, _ in got] == [len((t or "").split()) for t in texts] and [t for _, t in got[2:5]] == ["none"] * 3 and got[0][1] != got[1][1] != "none"
    every = mixing.with_topics(docs, topics=2)
    assert every.columns == [*docs.columns, "topic"] and sorted(r["topic"] for r in every.collect()) == sorted(t for _, t in got)


def test_raking_few_cells_takes_one_job_a_round(spark, monkeypatch):
    """Few cells are raked in one partition, with the weights that sums and joins give."""
    rows = [(f"a{i}", f"b{j}", float(1 + (7 * i + 3 * j) % 11)) for i in range(6) for j in range(5)] + [(None, "b0", 3.0)]
    cells = spark.createDataFrame(rows, "a string, b string, tokens double")
    targets = {m: mixing.targets_of(cells, m, power=0.5) for m in "ab"}

    def raked():
        spark.sparkContext.setJobGroup(name := f"rake {mixing.AT_ONCE}", "")
        got = {(r["a"], r["b"]): r["weight"] for r in mixing.rake(cells, targets, 0.5, 1.0, rounds=8, tolerance=1e-12).collect()}
        return got, len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))

    (at_once, jobs), _ = raked(), monkeypatch.setattr(mixing, "AT_ONCE", 0)
    apart, more = raked()
    assert at_once == pytest.approx(apart, rel=1e-9) and len(at_once) == 31
    assert jobs < 0.6 * more


def test_covariances_are_made_of_one_sum_a_product(spark):
    """The moments are numpy's, and their plan holds one average for each mean and product."""
    x = np.random.default_rng(3).normal(0.5, 0.2, (400, len(quality_rules.FEATURES)))
    made = quality_rules._moments(spark.createDataFrame([("g", *map(float, r)) for r in x], ["g", *[f"x{i}" for i in range(x.shape[1])]]), "g")
    assert "covar" not in made._jdf.queryExecution().analyzed().toString()
    got, wanted = made.first(), np.cov(x.T, bias=True) * quality_rules.CONSISTENCY
    for i, j in quality_rules._pairs():
        assert got[f"c{i}_{j}"] == pytest.approx(wanted[i, j] + (list(quality_rules.FEATURES.values())[i][1] ** 2 if i == j else 0), rel=1e-9, abs=1e-12)
