"""Each operator on small tables: odd rows, ties, repeats, empty tables, clashing names; against brute force where SQL can't say it."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from winnow_spark.llm import fingerprints, jaccard_join, licenses, mixing, quality, sentencepieces, sharding, token_counts, toxicity, url_filters
from winnow_spark.llm.components import connected_components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, shard string, verdict string"


def prose(seed, words=80):
    draw = random.Random(seed)
    return " ".join("".join(draw.choice("abcdeiou") for _ in range(draw.randint(2, 7))) for _ in range(words))


def odd_texts():
    base = prose(1)
    near = base.replace(base.split()[40], "changed", 1)
    very_long = " ".join(prose(k, 400) for k in range(30))
    return [base, base.upper(), near, None, "", "  \n ", "one two", "ONE two", "x", prose(2), prose(3, 4), very_long, "é ▁ \x00 \t ü😀  a", base, "GNU General Public License, cc-by. CC BY cc by\nReleased under the MIT License."]


def table(spark, texts, ids=None):
    ids = ids or list(range(len(texts)))
    return spark.createDataFrame([(i, t, "en", ("b", "a", None)[k % 3], 0, "s", "h", "v") for k, (i, t) in enumerate(zip(ids, texts))], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, odd_texts()).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return table(spark, ["x"]).where("false")


def shingle_set(text):
    words = tuple((text or "").encode().lower().split())
    return frozenset([words] if 0 < len(words) < 5 else [words[i : i + 5] for i in range(len(words) - 4)])


def brute_components(rows):
    sets = [(d, shingle_set(t)) for d, t in rows]
    comp = {d: d for d, _ in sets if d is not None}
    changed = True
    while changed:
        changed = False
        for d, s in sets:
            for e, u in sets:
                if d is not None and e is not None and s and u and 100 * len(s & u) >= 80 * len(s | u) and comp[d] != comp[e]:
                    comp[d] = comp[e] = min(comp[d], comp[e])
                    changed = True
    return {(d, len(s), comp.get(d)) for d, s in sets}


def test_urls(spark):
    urls = ["http://WWW.Example.com/en/1?x", "https://a.example.com/en/", "b.example.com/en/", None, "", "x://net/es/1", "x://net/es", "ftp://q.net#/fr/", "a://xexample.com/en/", "a://b://net/fr/", "http://example.com./en/"]
    rows = spark.createDataFrame([(i, u, "old") for i, u in enumerate(urls)], "page_id long, url string, verdict string")
    got = [tuple(r) for r in url_filters.judge_urls(rows, url_filters.RULES).orderBy("page_id").select("host", "path", "rule", "verdict").collect()]
    assert got[0] == ("www.example.com", "/en/1", "www.example.com/en/", "allow") and got[1] == ("a.example.com", "/en/", "example.com/en/", "block")
    assert got[2] == got[3] == got[4] == ("", "", None, "allow") and got[5][2:] == ("net/es/", "block") and got[6][2] is None and got[7][:3] == ("q.net", "", None)
    assert got[8][2:] == ("com/", "allow") and got[9][0] == "b:" and got[10][2] is None
    assert url_filters.UrlTrie([("allow", "a.com/x"), ("block", "a.com/x")]).find("a.com", "/xyz") == ("a.com/x", "block")
    with pytest.raises(ValueError):
        url_filters.UrlTrie([("maybe", "a.com/")])
    assert url_filters.judge_urls(rows.where("false"), url_filters.RULES).count() == 0


def test_token_counts(spark, docs, empty):
    pieces = ["▁a", "▁ab", "abc", "a", "b", "c", "bcd", "▁", "d", "▁abcde"]
    automaton = token_counts.LongestMatch(pieces)
    for word in ["▁abcd", "▁abcde", "▁abcdbcd", "▁x", "▁abx", "▁", "▁dcba"]:
        rest, n = word, 0
        while rest:
            best = max((p for p in pieces if rest.startswith(p)), key=len, default=None)
            if best is None:
                n = token_counts.UNKNOWN
                break
            rest, n = rest[len(best) :], n + 1
        assert automaton.count(word) == n, word
    got = token_counts.count_tokens(docs, pieces).toPandas()
    assert len(got) == docs.count() and (got.loc[got["text"].isna(), "n_tokens"] == 0).all() and (got["n_tokens"] >= got["n_words"]).all()
    assert token_counts.count_tokens(empty, pieces).count() == 0


def test_quality(spark, docs, empty):
    for text in odd_texts():
        words = (text or "").encode().split()
        windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)} if len(words) < 500 else None
        lines = [line for line in (text or "").split("\n") if line.encode().split()]
        stats = quality.document_stats(text)[0]
        assert stats[:4] == [len(words), sum(len(w.decode()) for w in words), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines))]
        assert covered is None or stats[4] == len(covered)
    assert quality.document_stats("a b c a b c a")[0][4] == 7
    draw = np.random.default_rng(0)
    x = draw.random((800, 2))
    y = ((x[:, 0] < 0.5) ^ (draw.random(800) < 0.1)).astype(float)
    trees = quality.fit_trees(x, y, [-1, 0])
    grid = np.column_stack([np.linspace(0, 1, 200), np.full(200, 0.3)])
    assert (np.diff(trees.score(grid)) <= 1e-12).all() and ((trees.score(x) > 0.5) == (x[:, 0] < 0.5)).mean() > 0.95
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    judged = quality.judge_quality(docs, quality.fit_quality(docs, none)).toPandas()
    assert (judged["kept"] == ~judged["base_failed"]).all() and quality.judge_quality(empty, trees).count() == 0


def test_jaccard(spark, docs, empty):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert {tuple(r) for r in jaccard_join.link_components(docs).collect()} == brute_components(rows)
    assert jaccard_join.link_components(empty).count() == 0
    kept = jaccard_join.keep_representatives(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {c for _, _, c in brute_components(rows)}


def test_jaccard_near_group(spark):
    """A group of near copies, some of them linked only in a chain, and documents that share a passage."""
    words, draw = prose(9, 120).split(), random.Random(4)
    texts = []
    for k in range(60):
        copy = list(words)
        for _ in range(draw.randint(0, 4)):
            copy[draw.randrange(len(copy))] = f"edit{draw.randrange(10**6)}"
        texts.append(" ".join(copy))
    texts += [prose(100 + k, 60) + " " + " ".join(words[:60]) for k in range(15)]
    rows = list(enumerate(texts))
    assert {tuple(r) for r in jaccard_join.link_components(table(spark, texts)).collect()} == brute_components(rows)


def test_jaccard_repeated_ids(spark):
    """Rows of one id are one document: it links if any of its texts does, and none of its texts is dropped alone."""
    a, b, c, d = (prose(k) for k in (21, 22, 23, 24))
    rows = [(1, a), (5, a), (5, b), (7, b), (9, c), (9, d), (9, d), (11, ""), (11, d), (12, "  "), (None, a)]
    docs = spark.createDataFrame([(i, t, "en", "a", 0, "s", "h", "v") for i, t in rows], SCHEMA).repartition(3)
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_join.link_components(docs).collect()), key=str)
    of = {1: 1, 5: 1, 7: 1, 9: 9, 11: 9, 12: 12, None: None}
    assert got == sorted(((i, len(shingle_set(t)), of[i]) for i, t in rows), key=str)
    kept = {(r["doc_id"], r["text"]) for r in jaccard_join.keep_representatives(docs).collect()}
    assert kept == {(1, a), (9, c), (9, d), (12, "  "), (None, a)} and jaccard_join.keep_representatives(docs).count() == 5


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 30)] + [(50, 40), (40, 45), (60, 60)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 1 for i in range(1, 31)} | {40: 40, 45: 40, 50: 40}


def test_fingerprints(spark, docs, empty):
    got = {r["doc_id"]: r for r in fingerprints.compare_edited(docs).collect()}
    texts = [t or "" for t in odd_texts()]
    for i, text in enumerate(texts):
        after, half = texts[i - 1], len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        assert got[i]["n_chars"] == len(text) and got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= got[i]["near_edited"] <= 1 and 0 <= got[i]["near_next"] <= 1
    assert got[0]["fingerprint"] == got[13]["fingerprint"] and got[3]["fingerprint"] == got[4]["fingerprint"] != got[5]["fingerprint"]
    assert fingerprints.compare_edited(empty).count() == 0
    twice = fingerprints.compare_edited(docs.unionByName(docs.where("doc_id = 2"))).collect()
    assert len(twice) == len(texts) + 1


def test_sentencepieces(spark, docs, empty):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=sentencepieces.piece_model())
    got = {r["doc_id"]: r for r in sentencepieces.encode_digest(sentencepieces.encode_decode(docs, sentencepieces.piece_model()), sentencepieces.piece_model()).collect()}
    for i, text in enumerate(odd_texts()):
        ids = model.encode(text or "")
        assert got[i]["ids"] == ids and got[i]["decoded"] == model.decode(ids) and got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    assert sentencepieces.encode_digest(empty, sentencepieces.piece_model()).count() == 0


def test_sharding(spark, docs, empty):
    got = sharding.shard_by_bytes(docs, 4).toPandas().sort_values("doc_id")
    sizes = [len((t or "").encode()) + 1 for t in odd_texts()]
    assert got["size"].tolist() == sizes and got["text_crc32"].tolist() == [zlib.crc32((t or "").encode()) for t in odd_texts()]
    starts = np.cumsum(sizes) - sizes
    assert got["shard"].tolist() == [int((2 * b + s) * 4 // (2 * sum(sizes))) for b, s in zip(starts, sizes)]
    assert all(sorted(part["slot"]) == list(range(len(part))) for _, part in got.groupby("shard"))
    assert sharding.shard_by_bytes(empty, 4).count() == 0 and sharding.shard_by_bytes(docs.unionByName(docs), 4).count() == 2 * len(sizes)


def test_toxicity(spark, empty):
    texts = [prose(k) + (" idiot and moron" if k % 4 == 0 else "") for k in range(120)] + [None, ""]
    docs = table(spark, texts)
    labels = spark.createDataFrame([(k, 1, int(k % 4 == 0)) for k in range(80)], "doc_id long, quality int, toxic int")
    chain = toxicity.fit_toxicity(docs, labels)
    got = {r["doc_id"]: r["is_toxic"] for r in toxicity.score_toxicity(docs, chain).collect()}
    assert got == {k: k < 120 and k % 4 == 0 for k in range(122)}  # those from 80 on were held out
    assert toxicity.score_toxicity(empty, chain).count() == 0
    nothing = toxicity.fit_toxicity(docs, labels.where("false"))
    assert toxicity.score_toxicity(docs, nothing).where("is_toxic").count() == 0


def test_licenses(spark, docs, empty):
    got = {r["doc_id"]: r for r in licenses.scan_licenses(docs).collect()}
    hit = got[14]
    assert (hit["n_words"], hit["n_base"], hit["first_word"], hit["last_word"]) == (15, 5, 0, 13)
    assert hit["base_labels"] == hit["labels"] == "cc-by,gpl,mit" and hit["score"] == 1.0
    assert (got[3]["n_words"], got[3]["n_base"], got[3]["first_word"], got[3]["labels"], got[3]["score"]) == (0, 0, None, "", 0.0)
    assert licenses.scan_licenses(empty).count() == 0
    own = licenses.scan_licenses(table(spark, ["Intro\nRedistribution and use in source & binary forms, with or without modification, are permitted: that the following conditions are met"])).first()
    assert own["labels"] == "bsd" and own["base_labels"] == "" and 0.9 <= own["score"] < 1


def brute_labels(text):
    words = [w for w in re.split(licenses.SEPARATOR, (text or "").lower()) if w]
    found = {}
    for label, notice in licenses.TEMPLATES:
        own, width = set(notice.split()), math.ceil(licenses.SPREAD * len(notice.split()))
        must, foreign = licenses.MARKS.get(label, ((), ()))
        windows = [set(words[i : i + n]) for i in range(len(words)) for n in range(1, width + 1)]
        best = max((len(own & w) for w in windows if w.issuperset(must) and not w.intersection(foreign)), default=0)
        if best >= 0.9 * len(own) - 1e-9:
            found[label] = max(found.get(label, 0), best / len(own))
    return found


def test_licenses_wrapped(spark):
    """Notices over several lines, in comments and long texts; all windows against brute force."""
    bsd = " * Redistribution and use in source and binary forms,\n * with or without modification, are permitted provided\n * that the following conditions are met:"
    isc = "Permission to use, copy, modify, and/or\nREM distribute this software for any purpose\nREM with or without fee is hereby granted"
    draw, texts = random.Random(3), [bsd, isc, prose(5, 300) + "\n" + bsd + "\n" + prose(6, 300), bsd.replace("\n", "\n" + prose(7, 9) + "\n")]
    for _, notice in licenses.TEMPLATES:
        for gap in (2, 4, 6):
            words = [w for w in notice.split() if draw.random() > 0.03]
            for _ in range(len(words) // gap):
                words.insert(draw.randrange(len(words)), f"x{draw.randrange(9)}\n")
            texts.append(" ".join([prose(draw.randrange(99), draw.randrange(40)), *words, prose(8, 5)]))
    rows = table(spark, texts)
    got = {r["doc_id"]: r for r in licenses.scan_licenses(rows).collect()}
    assert [got[i]["labels"] for i in range(4)] == ["bsd", "isc", "bsd", ""] and got[0]["score"] == got[2]["score"] == 1.0
    matched = licenses.match_templates(rows.select("doc_id", licenses._lower(rows["text"]).alias("lowered")), ["doc_id"])
    want = {(i, label): share for i, t in enumerate(texts) for label, share in brute_labels(t).items()}
    assert {(r["doc_id"], r["label"]): r["share"] for r in matched.collect()} == pytest.approx(want) and len(want) > 20


def test_licenses_siblings(spark):
    gnu = "This {} is free software: you can redistribute it and/or modify it under the terms of the GNU {}General Public License as published by the Free Software Foundation, either version 3"
    cc = "This work is licensed under a Creative Commons Attribution{} 4.0 International License."
    file = "You may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.{}"
    cases = {
        gnu.format("program", ""): "gpl", gnu.format("library", ""): "gpl", gnu.format("program", "Affero "): "agpl",
        gnu.format("library", "Lesser "): "lgpl", gnu.format("library", "Library "): "lgpl", gnu.format("program", "Lesser "): "lgpl",
        gnu.format("program", "") + ".\n" + gnu.format("program", "Affero "): "agpl,gpl",
        cc.format(""): "cc-by", cc.format("-ShareAlike"): "cc-by-sa", cc.format("-Share Alike"): "cc-by-sa", cc.format("-NonCommercial"): "",
        cc.format("-NonCommercial-ShareAlike"): "", cc.format("-ShareAlike") + " " + cc.format(""): "cc-by,cc-by-sa",
        file.format("apache.org/licenses/"): "apache", file.format("mozilla.org/MPL/"): "",
        "This Source Code Form is subject to the terms of the Eclipse Public License": "",
        "We released the software into the public domain and this version is free.": "",
        "This is free and unencumbered software released into the public domain.": "unlicense",
        " ".join(f"{w} {prose(k, 6)}" for k, w in enumerate(licenses.TEMPLATES[8][1].split())): "",
    }
    got = {r["doc_id"]: r["labels"] for r in licenses.scan_licenses(table(spark, list(cases))).collect()}
    assert got == dict(enumerate(cases.values()))


def test_mixing(spark, docs, empty):
    got = mixing.curriculum(docs).toPandas()
    words = {i: len((t or "").encode().split()) for i, t in enumerate(odd_texts())}
    assert dict(zip(got["doc_id"], got["size"])) == words and (got["taken"] <= 2 * got["size"]).all()
    for _, part in got.groupby(got["source"].fillna("~")):
        assert part["taken"].sum() == int(part["target"].iloc[0] + 1e-9) and part["source_size"].iloc[0] == part["size"].sum()
    assert abs(got.groupby(got["source"].fillna("~"))["target"].first().sum() - 1.5 * sum(words.values())) < 1e-6
    assert got["position"].is_monotonic_increasing and mixing.curriculum(empty).count() == 0
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns and sum(len(r["text"].encode().split()) for r in mixed.collect()) == got["taken"].sum()
    assert mixing.mixed_documents(empty).count() == 0
