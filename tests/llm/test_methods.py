"""The operators' methods against brute force, hot and large paths on small tables, and names that clash."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.test_operators import SCHEMA, brute_components, odd_texts, prose, table
from winnow_spark.llm import fingerprints, jaccard_join, labelled, licenses, mixing, quality, sentencepieces, shingles, token_counts, toxicity, url_filters

SMALL = "/root/testdata/sf0.001"


def test_clashing_names(spark):
    """Outputs replace columns of their name in any case; names with dots and backticks are carried."""
    docs = spark.createDataFrame([(1, "some text https://a.com/x", "v", 5)], "doc_id long, text string, `meta.x` string, `odd``name` int")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    cases = [
        ("Verdict", url_filters.judge_urls(docs.withColumn("Verdict", F.lit(1)), url_filters.RULES, url="text"), "verdict"),
        ("N_Words", token_counts.count_tokens(docs.withColumn("N_Words", F.lit(1)), ["a", "b"]), "n_words"),
        ("Kept", quality.judge_quality(docs.withColumn("Kept", F.lit(1)), quality.fit_quality(docs, none)).where("NOT kept"), "kept"),
        ("IDS", sentencepieces.encode_decode(docs.withColumn("IDS", F.lit(1)), sentencepieces.piece_model()), "ids"),
        ("Is_Toxic", toxicity.score_toxicity(docs.withColumn("Is_Toxic", F.lit(1)), toxicity.fit_toxicity(docs, none)).where("NOT is_toxic"), "is_toxic"),
        ("made", token_counts.count_tokens(docs.withColumn("made", F.lit(1)), ["a", "b"]), "made"),
    ]
    for name, out, own in cases:
        row = out.first()
        assert [c for c in out.columns if c.lower() == name.lower()] == [own] and row["meta.x"] == "v" and row["odd`name"] == 5, name
    mixed = mixing.mixed_documents(docs.withColumn("source", F.lit("s")))
    assert mixed.columns == [*docs.columns, "source"] and mixed.first()["meta.x"] == "v"


def test_word_hashes():
    """Words that a power hash modulo 2**64 takes for one; words of all sizes around its limits."""
    word = "a"
    for _ in range(10):
        word += word.translate(str.maketrans("ab", "ba"))
    texts = [word, word.translate(str.maketrans("ab", "ba")), *["x" * n for n in range(1, 40)], *["x" * n + "y" for n in range(1, 40)], "a", "a\x00", "é", "É"]
    found = [s.tolist()[0] for s in shingles.shingle_sets(texts)]
    assert len(set(found)) == len(texts)
    assert [s.tolist() for s in shingles.shingle_sets(["AbC dé", "abc dé", None, "", " \t"])][:2] == [s.tolist() for s in shingles.shingle_sets(["abc dé"])] * 2


@pytest.mark.parametrize("hot,broadcast", [(1, 300_000), (2048, 0), (3, 0)])
def test_jaccard_paths(spark, monkeypatch, hot, broadcast):
    """Shingles dealt to salts, and joins that shuffle: as brute force, for odd texts and for a near group beside a shared passage."""
    monkeypatch.setattr(jaccard_join, "HOT_DOCUMENTS", hot)
    monkeypatch.setattr(jaccard_join, "MAX_BROADCAST", broadcast)
    monkeypatch.setattr(jaccard_join, "ABOVE_MEAN", 0)
    words, draw = prose(9, 120).split(), random.Random(hot)
    texts = odd_texts()
    for _ in range(25):
        copy = list(words)
        for _ in range(draw.randint(0, 4)):
            copy[draw.randrange(len(copy))] = f"edit{draw.randrange(10**6)}"
        texts.append(" ".join(copy))
    texts += [prose(100 + k, 30) + " " + " ".join(words[:60]) for k in range(10)]
    rows = list(enumerate(texts))
    assert {tuple(r) for r in jaccard_join.link_components(table(spark, texts)).collect()} == brute_components(rows)


def test_salts_follow_the_counters():
    """Counters that are full of rare shingles make none of them a frequent one."""
    level = lambda n: np.minimum(8 * np.log2(np.asarray(n) + 1), 255).astype(np.uint8)
    assert jaccard_join.least_frequent(level(np.full(1000, 3))) == jaccard_join.HOT_DOCUMENTS
    assert jaccard_join.least_frequent(level(np.full(1000, 4000))) > 4 * 4000


def test_salts_are_taken_off(spark):
    postings = spark.createDataFrame([(k, int(s)) for k, s in enumerate([0, 1, -1, 2**63 - 1, -(2**63), 1234567890123456789])], "k int, shingle long")
    for salt in (0, 1, 5, jaccard_join.SALTS - 1):
        step = (salt * jaccard_join._SALT_STEP) % 2**64
        key = F.udf(lambda s, step=step: (s % 2**64 + step) % 2**64 - (2**64 if (s % 2**64 + step) % 2**64 >= 2**63 else 0), "long")
        made = postings.withColumn("key", key("shingle")).withColumn("facts", F.lit((7 << 32) | (salt << 24) | 3))
        row = made.where(jaccard_join.shingle_of("key", "facts") != F.col("shingle")).count()
        sizes = made.select(jaccard_join.size_of(F.col("facts")).alias("n"), jaccard_join.place_of(F.col("facts")).alias("p"), jaccard_join.salt_of(F.col("facts")).alias("s")).first()
        assert row == 0 and tuple(sizes) == (7, 3, salt)


def test_sample_is_bounded(spark):
    rows = [(1, f"text {k}") for k in range(500)] + [(2, "two"), (2, "two"), (3, None)]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(1, 1), (2, 0), (2, 1), (3, 0), (4, 1), (5, None)], "doc_id long, quality int")
    got = labelled.labelled_sample(docs, labels, ["quality"]).collect()
    assert {(r["doc_id"], r["quality"]) for r in got} == {(1, 1), (2, 1), (3, 0)} and len(got) == 3
    again = labelled.labelled_sample(docs.repartition(7), labels, ["quality"]).collect()
    assert {tuple(r) for r in again} == {tuple(r) for r in got}
    assert labelled.labelled_sample(docs, labels, ["quality"], most=2).count() <= 2


def test_trees_as_a_walk():
    """The flattened trees score as a plain walk from node to node does."""
    draw = np.random.default_rng(3)
    x = draw.random((600, 4))
    y = (x[:, 0] + 0.5 * x[:, 1] + 0.3 * draw.random(600) > 0.9).astype(float)
    trees = quality.fit_trees(x, y, [1, 0, 0, -1])

    def walk(row):
        total = trees.start
        for t in range(len(trees.feature)):
            node = 0
            for _ in range(trees.depth):
                node = 2 * node + (2 if row[trees.feature[t][node]] > trees.threshold[t][node] else 1)
            total += trees.value[t][node]
        return 1 / (1 + np.exp(-total))

    assert np.allclose(trees.score(x), [walk(r) for r in x]) and len(trees.feature) == 60
    up, down = np.tile(x[:50], (2, 1)), np.tile(x[:50], (2, 1))
    up[50:, 0] += 0.3
    down[50:, 3] += 0.3
    assert (trees.score(up)[50:] >= trees.score(up)[:50] - 1e-12).all() and (trees.score(down)[50:] <= trees.score(down)[:50] + 1e-12).all()


def test_chain_features_by_fold(spark):
    """What only a fold's own toxic documents hold is no feature of the model that predicts this fold."""
    rows = []
    for k in range(240):
        fold, toxic = int(toxicity.fold_of([k], toxicity.FOLDS)[0]), k % 3 == 0
        rows.append((k, prose(k, 30) + (f" leak{'abc'[fold]} everywhere" if toxic else ""), int(toxic)))
    sample = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    picked = toxicity.pick_features(sample, ("toxic",))
    for fold in range(toxicity.FOLDS):
        assert f"leak{'abc'[fold]}" not in picked[fold] and "everywhere" in picked[fold] and f"leak{'abc'[fold]}" in picked[-1]
    assert len(picked) == toxicity.FOLDS + 1 and all(len(p) <= toxicity.MAX_FEATURES for p in picked)


def test_logistic_has_converged():
    draw = np.random.default_rng(5)
    x = np.column_stack([draw.random((400, 6)), np.ones(400)]).astype(np.float32)
    y = (x[:, 0] > 0.5).astype(float)
    used = np.arange(400) % 4 > 0
    w = toxicity.fit_logistic(x, y, used)
    slope = x.T @ (used * (toxicity.predict_logistic(x, w) - y)) + np.array([1.0] * 6 + [1e-3]) * w
    assert np.abs(slope).max() <= 2e-4 * used.sum()
    assert np.allclose(w, toxicity.fit_logistic(x[used], y[used], np.ones(used.sum())), atol=1e-2)


def test_chain_on_held_out(spark):
    """Of documents that were not in the sample, nearly all planted ones are caught and no clean one is."""
    texts = [prose(k, 60) + (" what an idiot you are" if k % 5 == 0 else " what a day it was") for k in range(400)]
    labels = spark.createDataFrame([(k, int(k % 2), int(k % 5 == 0)) for k in range(250)], "doc_id long, quality int, toxic int")
    scored = toxicity.score_toxicity(table(spark, texts), toxicity.fit_toxicity(table(spark, texts), labels)).where("doc_id >= 250").collect()
    assert all(r["is_toxic"] == (r["doc_id"] % 5 == 0) for r in scored) and len(scored) == 150
    assert all(r["p_toxic_junk"] + r["p_toxic_prose"] < 1.5 for r in scored)


def test_token_counts_of_a_table(spark):
    """Every word of a whole table against greedy longest match, piece by piece."""
    pieces = token_counts.vocabulary(sentencepieces.piece_model())
    known, longest = set(pieces), max(map(len, pieces))

    def greedy(word):
        at = count = 0
        while at < len(word):
            size = next((n for n in range(min(longest, len(word) - at), 0, -1) if word[at : at + n] in known), 0)
            if not size:
                return None
            at, count = at + size, count + 1
        return count

    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    got = {r["doc_id"]: (r["n_words"], r["n_tokens"], r["n_unknown"]) for r in token_counts.count_tokens(docs, pieces).collect()}
    counts: dict = {}
    for r in docs.collect():
        words = [w.decode() for w in r["text"].encode().split()]
        found = [counts.setdefault(w, greedy("▁" + w)) for w in words]
        assert got[r["doc_id"]] == (len(words), sum(1 if c is None else c for c in found), found.count(None))


def test_very_many_rules(spark, monkeypatch):
    """Rules as a join: as the trie, and both as a plain look at each rule."""
    draw = random.Random(12)
    hosts, parts = ["com", "a.com", "b.a.com", "x.net", "", "localhost"], ["", "/", "/e", "/en", "/en/", "/en/x", "/enter/x/y"]
    rules = [(draw.choice(["allow", "block"]), draw.choice(hosts) + draw.choice(parts)) for _ in range(60)]
    urls = [f"{scheme}{draw.choice(['', 'www.'])}{h}{p}{tail}" for scheme in ("http://", "x", "HTTP://") for h in [*hosts, "A.Com", "zz.org"] for p in parts for tail in ("", "?q=1", "z/w#f")] + [None, "", "no scheme"]
    df = spark.createDataFrame([(k, u, "h") for k, u in enumerate(urls)], "k int, url string, Host string")

    def plain(host, path):
        fits = [(len(r), len(r.partition("/")[0]), v == "block", r, v) for v, r in rules for h, s, t in [r.partition("/")] if (host == h or host.endswith("." + h)) and path.startswith(s + t)]
        return max(fits)[3:] if fits else (None, "block")

    judged = [url_filters.judge_urls(df, rules, default="block")]
    monkeypatch.setattr(url_filters, "MAX_RULE_BYTES", 0)
    judged.append(url_filters.judge_urls(df, rules, default="block"))
    assert judged[0].columns == judged[1].columns == ["k", "url", "host", "path", "rule", "verdict"]
    for out in judged:
        rows = out.collect()
        assert len(rows) == len(urls) and all((r["rule"], r["verdict"]) == plain(r["host"], r["path"]) for r in rows)
    with pytest.raises(ValueError):
        url_filters.judge_urls(df, [("maybe", "com/")])


def terms_of(text):
    import re

    return {w for w in re.split(fingerprints.SEPARATOR, (text or "").lower()) if w}


def test_fingerprints_by_brute_force(spark):
    """Subset hashes are equal where the subsets' lexicon words are, and near_edited and near_next are the shares of these."""
    vocabulary = prose(77, 300).split()
    draw = random.Random(8)
    texts = [" ".join(draw.choice(vocabulary) for _ in range(draw.randrange(3, 40))) for _ in range(90)] + [None, "", "zzz", "zzz"]
    texts[5] = texts[4]
    docs = table(spark, texts)
    rows = {r["doc_id"]: r for r in fingerprints.compare_edited(docs).collect()}
    counts = Counter(w for t in texts for w in terms_of(t))
    low, high = max(2.0, fingerprints.RARE * len(texts)), max(2.0, fingerprints.COMMON * len(texts))
    masks = {r["term"]: r["mask"] for r in fingerprints.lexicon(docs).collect()}
    hashes = {r["w"]: r["h"] for r in spark.createDataFrame([(w,) for w in counts], "w string").select("w", F.xxhash64("w").alias("h")).collect()}
    assert {hashes[w] for w, n in counts.items() if low <= n <= high} == set(masks)

    def subsets(text):
        words = [w for w in terms_of(text) if hashes.get(w) in masks]
        return [frozenset(w for w in words if masks[hashes[w]] >> k & 1) or ("whole", text or "") for k in range(fingerprints.SUBSETS)]

    like = lambda a, b: sum(x == y for x, y in zip(subsets(a), subsets(b))) / fingerprints.SUBSETS
    for i, text in enumerate(texts):
        text, after = text or "", texts[i - 1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        assert rows[i]["near_edited"] == pytest.approx(like(text, edited)) and rows[i]["near_next"] == pytest.approx(like(text, after))
        assert (rows[i]["fingerprint"] == rows[i]["edited_fingerprint"]) == (subsets(text) == subsets(edited))
    for i in range(0, len(texts), 3):
        for j in range(i):
            assert (rows[i]["fingerprint"] == rows[j]["fingerprint"]) == (subsets(texts[i]) == subsets(texts[j]))


def test_fingerprints_find_near_copies(spark):
    """Of near copies with a similarity of 0.8 or more, nine of ten share a subset; unlike texts hardly ever do."""
    vocabulary = [w + str(k) for k, w in enumerate(prose(5, 4000).split())]
    draw, texts = random.Random(6), []
    for _ in range(150):
        base = [draw.choice(vocabulary) for _ in range(250)]
        copy = list(base)
        for _ in range(draw.randint(1, 5)):
            copy[draw.randrange(len(copy))] = draw.choice(vocabulary)
        texts += [" ".join(base), " ".join(copy)]
    sets = [frozenset(s.tolist()) for s in shingles.shingle_sets(texts)]
    got = {r["doc_id"]: r["fingerprint"].split("-") for r in fingerprints.compare_edited(table(spark, texts)).collect()}
    like = lambda i, j: any(x == y for x, y in zip(got[i], got[j]))
    near = [(i, i + 1) for i in range(0, len(texts), 2) if len(sets[i] & sets[i + 1]) >= 0.8 * len(sets[i] | sets[i + 1]) and texts[i] != texts[i + 1]]
    assert len(near) > 100 and sum(like(i, j) for i, j in near) >= 0.9 * len(near)
    assert sum(like(i, j) for i in range(0, 300, 2) for j in range(i + 2, 300, 2)) <= 10


def test_repeated_and_long_rows(spark):
    """Rows that are repeated in full have a result each; one very long text among short ones changes nothing."""
    texts = ["one two three", "one two three", None, " ".join(prose(k, 500) for k in range(60))]
    docs = table(spark, texts, ids=[1, 1, 2, 3])
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    outs = [
        token_counts.count_tokens(docs, ["▁one", "a"]), quality.judge_quality(docs, quality.fit_quality(docs, none)), sentencepieces.encode_digest(docs, sentencepieces.piece_model()),
        toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, none)), jaccard_join.link_components(docs), licenses.scan_licenses(docs),
    ]
    assert [sorted(r["doc_id"] for r in out.collect()) for out in outs] == [[1, 1, 2, 3]] * len(outs)
    assert SCHEMA and mixing.curriculum(docs).count() == 4
