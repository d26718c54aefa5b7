"""The pipeline's stages, each on what the one before kept."""

import random

import corpus_pipeline as pipeline


def test_stages(spark, tmp_path):
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(800)]
    clean = [" ".join(w if i % 3 else "the" for i, w in enumerate(rng.sample(words, 60))) for _ in range(60)]
    junk = ["### $$$ %%% " * 20, "few words", "again and again and again " * 20]
    texts = clean + junk + clean[:5] + [clean[9] + " tail"]
    rows = [(i, t, "en", f"s{i % 4}", len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert len(pipeline.STAGES) == 5
    seen = []
    for _, stage in pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(path := f"{tmp_path}/{len(seen)}")
        columns, docs = docs.columns, spark.read.parquet(path)
        seen.append(sorted(r["doc_id"] for r in docs.collect()))
        if len(seen) < 5:
            assert docs.columns == columns
    kept = list(range(len(clean)))
    assert seen[0] == sorted({*range(len(texts))} - {60, 61, 62})
    assert seen[1] == kept and seen[2] == kept
    assert {*seen[3]} <= {*kept} and seen[4] == seen[3]
    ran = pipeline.run(spark, str(tmp_path))
    assert sorted(r["doc_id"] for r in ran.collect()) == seen[4]
    assert pipeline.ORACLE_SQL is None


def test_columns_of_the_input_stay_as_they_are(spark, tmp_path):
    line = "the river of the stone and the end of the road that was not in the book, nor at the sea"
    texts = [None, "", f"{line}\nthe first of all", f"{line}\nthe second of all of them, and then the one that is last", "the word " + " ".join(f"w{i} of" for i in range(30_000))]
    made = ["n_words", "word_chars", "kept", "base_failed", "n_lines", "n_removed", "all_lines", "size", "source_size", "target", "copies", "tie", "doc", "version", "gone", "id", "same"]
    rows = [(i, t, None, None if i % 2 else "s", *[-7 - i] * len(made)) for i, t in enumerate(texts)] + [(3, texts[3], None, "s", *[-10] * len(made)), (None, texts[2], None, "s", *[-50] * len(made))]
    schema = "doc_id long, text string, lang string, source string, " + ", ".join(f"`{c}` int" for c in made)
    docs = spark.createDataFrame(rows, schema)
    for empty in (False, True):
        now = docs.limit(0) if empty else docs
        for k, (name, stage) in enumerate(pipeline.STAGES[:-1]):
            out = stage(spark, now, str(tmp_path))
            assert out.columns == docs.columns
            out.write.parquet(path := f"{tmp_path}/{empty}{k}")
            now = spark.read.parquet(path)
            got = now.collect()
            assert bool(got) != empty, name
            for r in got:
                want = {-50} if r["doc_id"] is None else {-7 - r["doc_id"]}
                assert {r[c] for c in made} == want, name
