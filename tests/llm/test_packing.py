import zlib
from collections import defaultdict

import numpy as np
from fixtures import documents, odd
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm import packing


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 200), max_size=20))
def test_plan_uses_counts_exactly(counts):
    left = dict(counts)
    for bin_, times in packing.plan_bins(counts, 64):
        assert sum(k * n for k, n in bin_) <= 64 and times >= 1
        for k, n in bin_:
            left[k] -= n * times
    assert all(v == 0 for v in left.values())


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 12), st.integers(1, 3), max_size=5), st.integers(0, 30))
def test_fullest_is_best(counts, room):
    sums = {0}
    for k, n in counts.items():
        sums = {s + k * i for s in sums for i in range(n + 1)}
    used = packing.fullest(counts, room)
    assert all(used[k] <= counts[k] for k in used)
    assert sum(k * n for k, n in used.items()) == max(s for s in sums if s <= room)


def test_encoder_gives_the_ids_of_tokenizers():
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(packing.tokenizer_path(packing.TOKENIZER))
    texts = ["", " ", "\n\n  x", "It's they'll  DON'T", "a b c\u0085d", "١٢٣ ½ ²", "你好​世界", "\U0001f600\U0001f468‍\U0001f469", "<|endoftext|>", "a <|endoftext|>\n b", "<|endoftext|><|endoftext", "x" * 3000, "\r\n\t\v\f", "ﬁ ß İ ſ", "�\u0000\u0001"]
    assert packing.encoder()(texts) == [slow.encode(t, add_special_tokens=False).ids for t in texts]


def check(pieces, docs):
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(packing.tokenizer_path(packing.TOKENIZER))
    want = []
    for doc_id, text in docs:
        raw = np.array([*slow.encode(text or "", add_special_tokens=False).ids, 0], dtype="<u4")
        for k, (s, n) in enumerate(packing.cut(len(raw), 2048)):
            want.append((doc_id, k, s, n, zlib.crc32(raw[s : s + n].tobytes())))
    assert sorted((tuple(r[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")) for r in pieces), key=lambda r: (r[0] is None, r[0] or 0, r[1:])) == sorted(want, key=lambda r: (r[0] is None, r[0] or 0, r[1:]))
    bins = defaultdict(list)
    for r in pieces:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    return len(bins), sum(r["length"] for r in pieces)


def test_pack_round_trip(spark):
    docs = documents(spark)
    n, total = check(packing.pack_documents(docs).collect(), [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    assert n <= -(-total // 2048) + 1


def test_odd_rows(spark):
    d = odd(spark)
    check(packing.pack_documents(d).collect(), [(r.doc_id, r.text) for r in d.select("doc_id", "text").collect()])
    assert packing.pack_documents(d.where("false")).count() == 0
    with_ids = packing.pack_documents(d, with_ids=True).collect()
    assert all(len(r["ids"]) == r["length"] for r in with_ids)


def test_cut():
    assert packing.cut(2048, 2048) == [(0, 2048)] and packing.cut(5000, 2048) == [(0, 904), (904, 2048), (2952, 2048)] and packing.cut(4096, 2048) == [(0, 2048), (2048, 2048)]


def test_very_long_runs_of_white_space():
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(packing.tokenizer_path(packing.TOKENIZER))
    for text in ("a" + " " * 1_000_100 + "b", "a" + "\n\u3000" * 600_000):
        assert packing.encoder()([text]) == [slow.encode(text, add_special_tokens=False).ids]
