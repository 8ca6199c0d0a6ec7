from collections import Counter

from fixtures import documents, odd, words

from millrace.llm import quality


def brute(text):
    w = words(text)
    windows = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {i + k for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for k in range(5)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    return {
        "n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": sum(c in "#*$%&|<>" for c in text or ""), "n_lines": len(lines),
        "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered), "n_stutter": sum(a == b for a, b in zip(w, w[1:], strict=False)),
    }


def verdict(m):
    return (
        m["n_words"] >= 10 and 100 * m["n_repeat_words"] <= 20 * m["n_words"] and 100 * m["n_dup_lines"] <= 50 * m["n_lines"] and 100 * m["n_stutter"] <= 30 * m["n_words"]
        and 10 * m["n_symbols"] <= m["n_words"] and 2 * m["n_words"] <= m["word_chars"] <= 20 * m["n_words"]
    )


def test_measures_and_verdicts(spark):
    for d in (documents(spark), odd(spark)):
        for r in quality.verdicts(d, with_measures=True).select("text", *quality.MEASURES, "rejected_by").collect():
            m = brute(r["text"])
            assert {k: r[k] for k in quality.MEASURES} == m
            assert (r["rejected_by"] is None) == verdict(m)


def test_lazy_cascade_agrees(spark):
    d = documents(spark)
    some = quality.verdicts(d, with_measures=("n_words", "n_repeat_words"))
    assert some.columns == [*d.columns, "n_words", "n_repeat_words", "rejected_by"]
    assert {(r.doc_id, r.n_words, r.n_repeat_words, r.rejected_by) for r in some.collect()} == {(r.doc_id, r.n_words, r.n_repeat_words, r.rejected_by) for r in quality.verdicts(d, with_measures=True).collect()}
    full = {(r.doc_id, r.rejected_by) for r in quality.verdicts(d, with_measures=True).collect()}
    assert {(r.doc_id, r.rejected_by) for r in quality.verdicts(d).collect()} == full
    kept = quality.verdicts(d).where("rejected_by IS NULL")
    assert kept.count() == sum(b is None for _, b in full)


def test_order_is_by_rejection_per_cost_and_changes_no_verdict(spark):
    d = documents(spark)
    given = quality.rules()
    names = [r.name for r in quality.order_rules(d, given)]
    assert sorted(names) == sorted(r.name for r in given)
    assert names == [r.name for r in quality.order_rules(d, list(reversed(given)))]
    sampled = quality.order_rules(d, given, sample_docs=20)
    assert sampled == quality.order_rules(d.repartition(9), given, sample_docs=20)
    assert sorted(r.name for r in sampled) == sorted(names)
    assert quality.verdicts(d.where("false")).count() == 0


def test_labels_agree(spark):
    sf = "/root/testdata/sf0.01"
    d, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    both = quality.verdicts(d).join(labels, "doc_id").where("length(text) > 100").select("quality", "rejected_by").collect()
    good = [r.rejected_by is None for r in both if r.quality == 1]
    bad = [r.rejected_by is not None for r in both if r.quality == 0]
    assert sum(good) >= 0.98 * len(good) and sum(bad) >= 0.95 * len(bad)
