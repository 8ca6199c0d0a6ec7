"""Very long texts, empty tables, repeated rows and clashing columns for every operator."""

import random

import pytest
from fixtures import CLASH, documents, odd
from pyspark.sql import functions as F
from test_lattice import check as check_scores
from test_mixing import check as check_mix
from test_packing import check as check_pack
from test_quality import brute as measures
from test_secrets import brute as base_spans
from test_sharding import check as check_shards
from test_simhash import check as check_groups

from millrace.llm import embedding_dedup, language_id, lattice_lm, licenses, mixing, packing, quality, queries, secrets, sharding, simhash


@pytest.fixture(scope="module")
def long_docs(spark, tmp_path_factory):
    """Texts of 1.2 MB: prose with a notice and a secret at its end, one word, one line, one repeated word, and white space."""
    rng = random.Random(12)
    words = [w for r in documents(spark).where("lang = 'en' AND NOT lower(text) LIKE '%licen%'").select("text").collect() for w in (r.text or "").split() if len(w) > 1]
    prose = " ".join(rng.choices(words, k=240_000))[:1_200_000] + "\n\nReleased under the MIT License.\n\npassword = hunter2hunter2"
    texts = [prose, prose, "x" * 1_200_000, "one line of words " * 70_000, "again " * 200_000, " \n" * 600_000, "\U0001f600é你" * 300_000, "short text of a few words"]
    d = spark.createDataFrame([(i, t, "en", "ab"[i % 2], len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    path = str(tmp_path_factory.mktemp("long"))
    d.repartition(4).write.parquet(f"{path}/documents.parquet")
    return spark.read.parquet(f"{path}/documents.parquet")


def rows(d):
    return [(r.doc_id, r.text) for r in d.select("doc_id", "text").collect()]


def test_licences(spark, long_docs):
    found = {r.doc_id: [x.family for x in r.licences] for r in licenses.scan(long_docs, licenses.train(documents(spark))).select("doc_id", "licences").collect()}
    assert found == {i: ["MIT"] if i < 2 else [] for i in range(8)}


def test_packing(long_docs):
    check_pack(packing.pack_documents(long_docs).collect(), rows(long_docs))


def test_quality(long_docs):
    for r in quality.verdicts(long_docs, with_measures=True).select("text", *quality.MEASURES).collect():
        assert {k: r[k] for k in quality.MEASURES} == measures(r.text)


def test_mixing(long_docs):
    check_mix(long_docs)


def test_secrets(spark, long_docs):
    texts = dict(rows(long_docs))
    for r in secrets.find_secrets(long_docs, secrets.train(documents(spark))).collect():
        assert r["base"] == secrets.joined(base_spans(texts[r["doc_id"]])) and (r["n_assign"] == 1) == (r["doc_id"] < 2)


def test_near_copies(long_docs):
    check_groups(simhash.near_duplicates(long_docs).collect(), rows(long_docs))


def test_scores(spark, long_docs):
    d = long_docs.select("doc_id", "text", (F.col("doc_id") != 3).alias("train"))
    check_scores(lattice_lm.score_documents(d, steps=1).collect(), [tuple(r) for r in d.collect()])


def test_shards(long_docs):
    check_shards(long_docs, 3)


def test_languages(spark, long_docs):
    model = language_id.train(documents(spark))
    found = {r.doc_id: (r.lang_pred, r.score) for r in language_id.identify(long_docs, model).collect()}
    assert found[0] == found[1] and found[0][0] == "en" and found[5] == ("und", 0.0) and len(found) == 8


EMPTY = {
    "licences": lambda d: licenses.scan(d, licenses.train(d)), "packing": packing.pack_documents, "quality": quality.verdicts, "mixing": mixing.mix,
    "secrets": lambda d: secrets.find_secrets(d, secrets.train(d)), "simhash": simhash.near_duplicates, "scores": lambda d: lattice_lm.score_documents(d.withColumn("train", F.lit(True))),
    "shards": sharding.shard, "languages": lambda d: language_id.identify(d, language_id.train(d)),
}


@pytest.mark.parametrize("name", sorted(EMPTY))
def test_empty_tables_and_repeated_rows(spark, name):
    run, d = EMPTY[name], odd(spark)
    assert all(c.split(" AS ")[1] in d.columns for c in CLASH.split(", ") if c.strip())
    assert run(d.where("false")).count() == 0
    null = d.where("text IS NULL").union(d.where("text IS NULL"))
    assert run(null).count() == 2
    # A row repeated three times gives three rows, equal but for places and copies.
    same = d.where("doc_id = 1").withColumn("k", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3)))).drop("k")
    got = run(same).drop("sequence_id", "offset", "shard", "slot", "copies", "taken")
    assert got.count() == 3 and got.distinct().count() == 1


def test_embeddings_of_an_empty_table(spark):
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int, component_id int, n int, cid int")).count() == 0


def test_queries_cover_whole_tables():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == list(range(1, 11))
