"""The stages one after the other."""

import corpus_pipeline
from evispark.llm import langid, minhash_dedup, pii, suffix_dedup

DATA = "/root/testdata/sf0.001"


def test_stages_take_effect_and_keep_columns(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    seen = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, seen, DATA).cache()
        assert after.columns == docs.columns, name
        seen = after
    assert seen.count() < docs.count()
    assert pii.detect(seen).selectExpr("sum(n_email + n_ip + n_card + n_phone)").first()[0] == 0
    assert minhash_dedup.digests(minhash_dedup.keep_first(langid.accept(docs))).where("not kept").count() == 0
    rows = corpus_pipeline.run(spark, DATA).groupBy("sequence_id").sum("length").collect()
    assert rows and all(r[1] <= 2048 for r in rows)


def test_repeats_leave_the_first(spark):
    text = " ".join(f"word{i}" for i in range(80))
    df = spark.createDataFrame([(1, "a " + text, "en", "s", 1), (2, "b " + text + " c", "en", "s", 1), (3, "clean", "en", "s", 5)], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r for r in suffix_dedup.without_repeats(df, corpus_pipeline.REPEAT_BYTES).collect()}
    assert got[1].text == "a " + text and got[2].text == "b c" and got[3].text == "clean" and got[2].n_chars == 3


def test_repeats_of_short_words_go(spark):
    text = " ".join("abcdefghijklmnopq"[i % 17] for i in range(51))
    assert 100 <= len(text) < 200
    df = spark.createDataFrame([(1, "x " + text, "en", "s", 1), (2, "y " + text + " z", "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r.text for r in corpus_pipeline.repeats(spark, df, DATA).collect()}
    assert got[1].startswith("x a b c d") and got[2] == "y z"


def test_odd_rows(spark, odd, empty):
    for docs in (odd, empty):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, DATA)
            assert out.count() >= 0, name
