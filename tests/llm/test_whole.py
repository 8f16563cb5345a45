"""Registered queries on a whole table against brute force, and one very long text through every operator."""

import collections
import hashlib
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from evispark.llm import bpe, langid, lm_score, media_ts, minhash_dedup, packing, pii, registry, spotsigs, suffix_dedup

DATA = "/root/testdata/sf0.01"
needs_tables = pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables")


def linked(rows, words, percent):
    """Components over all pairs that share a shingle, counted one by one."""
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set())
    have = collections.defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            have[x].append(i)
    both = collections.Counter()
    for docs in have.values():
        for a, i in enumerate(docs):
            for j in docs[:a]:
                both[j, i] += 1
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for (j, i), n in both.items():
        if 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
            parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return {d: (len(sets[i]), least[find(i)], d == least[find(i)]) for i, (d, _) in enumerate(rows)}


@needs_tables
def test_near_duplicates_lose_no_link(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in registry.queries()["op5_minhash"](spark, DATA).collect()}
    assert got == linked(rows, 3, 85) and sum(not k for *_, k in got.values()) > 50


@needs_tables
def test_predictions_of_held_out_rows(spark):
    got = registry.queries()["op3_langid"](spark, DATA).join(spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out and lang is not null")
    assert got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.98


@needs_tables
def test_urls_of_a_whole_table(spark):
    got = registry.queries()["op4_url_rules"](spark, DATA).collect()
    assert len(got) == spark.read.parquet(f"{DATA}/pages.parquet").count() and {r.verdict for r in got} <= {"allow", "block"}


@needs_tables
@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_equals_sql(spark, name):
    import duckdb

    small = DATA.replace("0.01", "0.001")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{small}/documents.parquet'")
    got = registry.queries()[name](spark, small)
    expected = con.execute(registry.oracle_sql()[name]).df()[got.columns]
    assert sorted(map(tuple, got.collect())) == sorted(expected.itertuples(index=False, name=None))


LONG = 20 << 20


@pytest.fixture(scope="module")
def long_text():
    """Twenty megabytes of words in one text, a repeated passage and an address near its end."""
    rng = random.Random(1)
    words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 9))) for _ in range(5000)]
    part = " ".join(rng.choices(words, k=90))
    block = " ".join(rng.choices(words, k=300_000))
    text = (block + " " + part + " ") * (LONG // len(block)) + "write to someone@example.com now"
    return text[: LONG - 40] + " and write to someone@example.com " + "end"


@pytest.fixture(scope="module")
def long_docs(spark, long_text):
    rows = [(1, long_text, "en", "s", len(long_text)), (2, "the cat sat on the mat, and the dog sat by the door of the house", "en", "s", 60), (3, None, None, "s", None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(2).cache()


def test_long_language(long_docs):
    got = {r.doc_id: r.lang_pred for r in langid.predict(long_docs, langid.learn(long_docs.where("lang is not null"))).collect()}
    assert got == {1: "en", 2: "en", 3: "und"}


def test_long_near_duplicates(long_docs, long_text):
    got = {r.doc_id: r for r in minhash_dedup.digests(long_docs).collect()}
    assert got[1].kept and got[1].n_shingles > 299_000 and got[3].n_shingles == 0


def test_long_repeats(long_docs, long_text):
    got = {r.doc_id: r for r in suffix_dedup.digests(long_docs).collect()}
    assert got[1].n_bytes == len(long_text) and got[1].n_removed > 0.8 * len(long_text) and got[2].n_removed == 0


def test_long_encoding(long_docs, long_text):
    tool = bpe.codec(bpe.tokenizer_path())
    ids = tool.encode(long_text)
    got = {r.doc_id: r for r in bpe.digests(long_docs).collect()}
    assert got[1].n_tokens == len(ids) // 4 and got[1].ids_sha256 == hashlib.sha256(ids).hexdigest()
    pieces = packing.pack(long_docs).where("doc_id = 1").agg(F.sum("length"), F.count(F.lit(1))).first()
    assert pieces[0] == len(ids) // 4 + 1 and pieces[1] == -(-(len(ids) // 4 + 1) // 2048)
    scored = {r.doc_id: r for r in lm_score.score(long_docs).collect()}
    assert scored[1].n_tokens == len(ids) // 4 and scored[1].log10_score < 0 and scored[3].log10_score is None


def test_long_stream_and_personal_data(long_docs, long_text):
    got = {r.doc_id: r for r in media_ts.read_back(media_ts.store(long_docs)).collect()}
    assert got[1].payload_sha256 == hashlib.sha256(media_ts.padded(long_text)[1]).hexdigest() and "bad=0" in got[1].feature
    found = {r.doc_id: r for r in pii.detect(long_docs).collect()}
    assert found[1].n_email == long_text.count("someone@example.com") >= 1


def test_long_fingerprint(spark, long_text):
    short = long_text[: 4 << 20]
    df = spark.createDataFrame([(1, short), (2, short[: len(short) // 2])], "doc_id long, text string")
    got = {r.doc_id: r for r in spotsigs.digests(df).collect()}
    assert got[1].n_chars == len(short) and len(got[1].fingerprint) > 16 * 1000
