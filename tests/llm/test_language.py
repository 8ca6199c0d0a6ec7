import numpy as np
from fixtures import odd
from pyspark.sql import functions as F

from millrace.llm import language_id as li
from millrace.llm.queries import fold


def test_held_out_accuracy(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").withColumn("held", fold(F.col("doc_id"), 4) == 2)
    model = li.train(d.where("NOT held"))
    got = li.identify(d, model).join(d.where("held").select("doc_id", "lang", "text"), "doc_id").collect()
    right = lambda rows: sum(r.lang == r.lang_pred for r in rows) / len(rows)
    assert right(got) >= 0.97 and right([r for r in got if len(r.text or "") > 100]) >= 0.99 and all(0 <= r.score <= 1 for r in got)


def naive(net, window):
    """The network by plain loops."""
    pooled = []
    for w in li.WIDTHS:
        kernel = net.p[f"conv{w}"].reshape(w, li.EMBED, li.FILTERS)
        for f in range(li.FILTERS):
            best = max(sum(float(net.p["embed"][window[i + k], e]) * float(kernel[k, e, f]) for k in range(w) for e in range(li.EMBED)) for i in range(len(window) - w + 1))
            pooled.append(max(0.0, best + float(net.p[f"bias{w}"][f])))
    order = [pooled[i * li.FILTERS + f] for i in range(len(li.WIDTHS)) for f in range(li.FILTERS)]
    z = [sum(h * float(net.p["out"][j, c]) for j, h in enumerate(order)) + float(net.p["out_bias"][c]) for c in range(len(net.labels))]
    e = [np.exp(x - max(z)) for x in z]
    return [x / sum(e) for x in e]


def test_forward_against_plain_loops():
    net = li.ByteCnn(["a", "b", "c"])
    rng = np.random.default_rng(2)
    x = rng.integers(0, 257, (3, 20)).astype(np.int16)
    assert np.allclose(net.forward(x)[0], [naive(net, list(w)) for w in x], atol=1e-5)


def test_gradients_are_right():
    net = li.ByteCnn(["a", "b"])
    for k in net.p:
        net.p[k] = net.p[k].astype(np.float64)
    rng = np.random.default_rng(0)
    x, y = rng.integers(0, 257, (4, 12)).astype(np.int16), np.array([0, 1, 1, 0])
    loss = lambda: -np.log(net.forward(x)[0][np.arange(4), y]).mean()
    for k, g in net.gradients(x, y).items():
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        before = net.p[k][at]
        net.p[k][at] = before + 1e-6
        up = loss()
        net.p[k][at] = before - 1e-6
        down = loss()
        net.p[k][at] = before
        assert abs((up - down) / 2e-6 - g[at]) < 1e-4


def test_windows_cover_every_byte():
    for n in (0, 1, 255, 256, 257, 1000):
        w, s = li.windows_of(bytes(i % 256 for i in range(n)))
        assert int((w < 256).sum()) == n and s.sum() == max(1, n)


def test_repetition_speaks_once():
    rng = np.random.default_rng(0)
    prose = bytes(rng.integers(97, 123, 1024).astype(np.uint8))
    short = prose[:256] + b"the same again. " * 16
    assert li.novelty(short, li.windows_of(short)[1])[1] < 0.25 * 256
    raw = prose + b"the same again. " * 128
    sizes = li.windows_of(raw)[1]
    weights = li.novelty(raw, sizes)
    assert (weights > 0).all() and (weights <= sizes).all() and weights[:4].sum() > 5 * weights[5:].sum()
    assert (li.novelty(prose, li.windows_of(prose)[1]) == 256).all() and (li.novelty(b"ab", np.array([2.0])) == 2).all()


def test_odd_rows(spark):
    d = odd(spark)
    model = li.train(d)
    rows = {r["doc_id"]: r for r in li.identify(d, model).collect()}
    assert all(rows[i]["lang_pred"] == "und" and rows[i]["score"] == 0 for i in (3, 4, 5, 9)) and rows[6]["lang_pred"] in model.labels
    assert li.identify(d, model).count() == d.count()
    assert li.train(d.where("false")) is None and li.train(d.withColumn("lang", F.lit(None).cast("string"))) is None
    assert {r["lang_pred"] for r in li.identify(d, None).collect()} == {"und"}
    assert li.identify(d.where("false"), model).count() == 0
