"""The pipeline stage by stage against brute force, each on its own input."""

from collections import Counter, defaultdict

import corpus_pipeline
import pytest
from fixtures import documents, groups_of, odd
from test_mixing import brute_targets
from test_packing import check as check_packed
from test_quality import brute, verdict
from test_simhash import brute as fingerprint

from millrace.llm import secrets
from millrace.llm.common import materialize

COLUMNS = corpus_pipeline.COLUMNS


@pytest.fixture(scope="module", params=["documents", "odd"])
def inputs(spark, request):
    docs, out = documents(spark) if request.param == "documents" else odd(spark).select(*COLUMNS), []
    for _, stage in corpus_pipeline.STAGES:
        after = materialize(stage(spark, docs, ""))
        out.append((docs.collect(), after.collect(), after.columns))
        docs = after
    return out


def test_stages_keep_the_columns(inputs):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "simhash_dedup", "secret_scan", "source_mix", "pack"]
    assert all(columns == COLUMNS for _, _, columns in inputs[:-1])


def test_quality(inputs):
    before, after, _ = inputs[0]
    assert Counter(after) == Counter(r for r in before if verdict(brute(r.text)))


def kept_rows(rows):
    """For each group of near copies the least doc_id, null if none has one."""
    fps = [fingerprint(r.text) for r in rows]
    links = [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4]
    root = groups_of(range(len(fps)), links)
    groups = defaultdict(list)
    for i, r in enumerate(rows):
        groups[root[i]].append(r)
    return groups


def test_dedup(inputs):
    before, after, _ = inputs[1]
    groups = kept_rows(before)
    ids = [min((r.doc_id for r in g if r.doc_id is not None), default=None) for g in groups.values()]
    assert Counter(r.doc_id for r in after) == Counter(ids)
    assert not Counter(after) - Counter(before)
    assert all(len(set(g) & set(after)) == 1 for g in groups.values())


def test_dedup_loses_no_text_without_an_id(spark):
    long = [" ".join(f"{p}{i}" for i in range(50)) for p in "abcd"]
    texts = [(None, long[0]), (7, long[1]), (7, long[2]), (None, long[2]), (None, long[3]), (None, long[3]), (8, None), (9, "")]
    d = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in texts], "doc_id long, text string, lang string, source string, n_chars long")
    got = Counter((r.doc_id, r.text) for r in corpus_pipeline.near_dedup(spark, d, "").collect())
    assert got == Counter([(None, long[0]), (7, long[1]), (7, long[2]), (None, long[3]), (8, None)])


def test_empty_and_very_long(spark):
    empty = documents(spark).where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, "").count() == 0
    rng = __import__("random").Random(4)
    vocabulary = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(3, 9))) for _ in range(20_000)]
    long = " ".join(rng.choices(vocabulary, k=180_000))  # above 1 MB
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate([long, long + " more", " ".join(vocabulary[:100])])], "doc_id long, text string, lang string, source string, n_chars long")
    assert len(long) > 1_000_000
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialize(stage(spark, docs, ""))
        if name != "source_mix":
            assert {r.text for r in docs.collect()} >= {long}
    check_packed(corpus_pipeline.pack(spark, docs, "").collect(), [(r.doc_id, r.text) for r in docs.collect()])


def test_secrets(inputs):
    before, after, _ = inputs[2]
    old = {r.doc_id: r for r in before}
    assert Counter(r.doc_id for r in before) == Counter(r.doc_id for r in after) and len(old) == len(before)
    for r in after:
        spans = secrets.base_spans(old[r.doc_id].text)
        if spans:
            assert not {(k) for s, e, k in secrets.base_spans(r.text)} and "[SECRET]" in r.text and r.n_chars == len(r.text)
        elif r.text != old[r.doc_id].text:
            assert "[SECRET]" in r.text


def test_mix(inputs):
    before, after, _ = inputs[3]
    sizes, taken, largest = defaultdict(int), defaultdict(int), defaultdict(int)
    n = lambda r: len(r.text.encode().split())
    for r in before:
        sizes[r.source] += n(r)
        largest[r.source] = max(largest[r.source], n(r))
    for r in after:
        taken[r.source] += n(r)
    copies = Counter(after)
    assert set(copies) <= set(before) and max(copies.values(), default=0) <= 3
    for s, target in brute_targets(dict(sizes)).items():
        assert abs(taken[s] - target) <= largest[s]


def test_pack(inputs):
    before, after, _ = inputs[4]
    check_packed(after, [(r.doc_id, r.text) for r in before])


def test_run(spark):
    assert corpus_pipeline.ORACLE_SQL is None
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 0
