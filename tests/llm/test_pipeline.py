"""The pipeline's stages on a small folder of tables."""

import random

import corpus_pipeline
import pytest

from winnow_spark.llm import mixing, quality, registry, sentencepieces, toxicity

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def mixed(spark, tmp_path_factory):
    """The mix of many documents, and its files as the pipeline writes them: several, of unlike sizes."""
    draw = random.Random(2)
    rows = [(i, " ".join(draw.choice(["an", "old", "house\n", "stood", "there"]) for _ in range(draw.randrange(1, 400 if i % 50 else 4000))), "en", "ab"[i % 2], 0) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    out = str(tmp_path_factory.mktemp("mixed") / "files")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    corpus_pipeline.mix_sources(spark, docs, "").write.parquet(out)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    return docs, out


def test_training_order_reaches_the_result(spark, mixed):
    docs, out = mixed
    passes = []
    for r in mixing.curriculum(docs).collect():
        passes += [(r["position"], r["doc_id"])] * (r["first_taken"] > 0) + [(r["again_position"], r["doc_id"])] * (r["taken"] > r["first_taken"])
    got = corpus_pipeline.encode_pieces(spark, spark.read.parquet(out), "").orderBy("place").collect()
    assert [r["doc_id"] for r in got] == [i for _, i in sorted(passes)] and len({r["place"] for r in got}) == len(got) > len({i for _, i in passes})


def test_cut_copies_keep_their_lines(spark, mixed):
    docs, out = mixed
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    cut = [r for r in spark.read.parquet(out).collect() if r["text"] != texts[r["doc_id"]]]
    assert cut and all(texts[r["doc_id"]].startswith(r["text"]) and "\n" in r["text"] and r["n_chars"] == len(r["text"]) for r in cut)


def test_run(spark):
    """The whole run: the two fitted stages by their judgement of each row, the others by brute force."""
    import sentencepiece

    docs, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    toxic = {r["doc_id"] for r in toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, labels)).where("is_toxic").collect()}
    clean = docs.where(~docs["doc_id"].isin(list(toxic)))
    good = {r["doc_id"] for r in quality.judge_quality(clean, quality.fit_quality(clean, labels)).where("kept").collect()}
    texts = {r["doc_id"]: r["text"] for r in clean.collect() if r["doc_id"] in good}
    words = {i: t.encode().lower().split() for i, t in texts.items()}
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set() for i, w in words.items()}
    comp = {i: i for i in sets}
    for i in sets:
        for j in sets:
            if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                old, new = max(comp[i], comp[j]), min(comp[i], comp[j])
                comp = {k: new if c == old else c for k, c in comp.items()}
    kept = {i for i in comp if comp[i] == i}
    assert 0 < len(kept) < len(good) and toxic
    passes = []
    for r in mixing.curriculum(docs.where(docs["doc_id"].isin(list(kept)))).collect():
        for taken, at in ((r["first_taken"], r["position"]), (r["taken"] - r["first_taken"], r["again_position"])):
            passes += [(at, r["doc_id"], taken == r["size"])] * (taken > 0)
    got = corpus_pipeline.run(spark, SMALL).orderBy("place").collect()
    assert [r["doc_id"] for r in got] == [i for _, i, _ in sorted(passes)]
    model = sentencepiece.SentencePieceProcessor(model_file=sentencepieces.piece_model())
    for r, (_, i, whole) in zip(got, sorted(passes)):
        assert not whole or r["ids"] == model.encode(texts[i])


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_queries_give_every_row(spark, name):
    table = "pages" if name.startswith("op1_") else "documents"
    assert registry.QUERIES[name](spark, SMALL).count() == spark.read.parquet(f"{SMALL}/{table}.parquet").count()


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages_on_odd_rows(spark, tmp_path, name, stage):
    """Nulls in any column, empty and repeated rows, extra columns with names of the stages' own, and an empty table."""
    long = " ".join(f"word{k % 700}" for k in range(30_000))
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (2, "", "en", "a", 0), (None, "no id at all", "en", None, 12), (3, long, "de", "a", len(long)), (4, long, "de", "b", len(long)), (5, "short text", "en", "b", 10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.selectExpr("*", "'x' AS Kept", "'y' AS `is_toxic`", "1 AS `meta.size`", "2 AS position")
    for number, df in enumerate((docs, docs.where("false"), docs.repartition(4))):
        df.write.parquet(f"{tmp_path}/{number}")
        out = stage(spark, spark.read.parquet(f"{tmp_path}/{number}"), SMALL)
        got = out.collect()
        assert len(got) <= 2 * df.count()
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns and all(r["Kept"] == "x" and r["meta.size"] == 1 for r in got)


def test_run_leaves_one_folder(spark):
    import os

    from winnow_spark.session import use_checkpoint_dir

    use_checkpoint_dir(spark)
    at = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    before = {f for f in os.listdir(at) if f.startswith("pipeline-")}
    corpus_pipeline.run(spark, SMALL).count()
    new = {f for f in os.listdir(at) if f.startswith("pipeline-")} - before
    assert len(new) == 1 and os.listdir(f"{at}/{new.pop()}") == ["4"]
