import math
import random
import zlib

import numpy as np
import pytest
from data import SCHEMA, prose, rows, table

from strophe.llm import quality_cnn
from strophe.llm.quality_cnn import CHUNK, OVERLAP, Network, chunks, fit, op10_quality_cnn, score


def test_chunks_cover_all_bytes():
    for n in (0, 1, OVERLAP, CHUNK - 1, CHUNK, CHUNK + 1, 2 * CHUNK - OVERLAP, 5000):
        text = "".join(chr(33 + i % 90) for i in range(n))
        rows_ = chunks(text)
        step = CHUNK - OVERLAP
        joined = b"".join(r.tobytes()[: step if i < len(rows_) - 1 else CHUNK] for i, r in enumerate(rows_))
        assert joined.rstrip(b"\0") == text.encode() and all((a[step:] == b[:OVERLAP]).all() for a, b in zip(rows_, rows_[1:]))
    assert chunks(None).shape == (1, CHUNK)


def test_filters_equal_a_plain_convolution():
    net, rows_ = Network(), chunks("The quick brown fox. " * 60)
    z = net.pooled(rows_)
    width = 2 * quality_cnn.STRIDE
    for c, row in enumerate(rows_):
        x = net.p["embed"][row]
        r = [x[i : i + width].ravel() @ net.p["filter"] for i in range(0, CHUNK - width + 1, quality_cnn.STRIDE)]
        assert np.allclose(z[c], np.maximum(np.max(r, 0) + net.p["bias"], 0), atol=1e-4)


def test_gradients():
    net, rng = Network(3), np.random.default_rng(0)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    docs, y = [chunks("some text here " * 90), chunks("#### $$$$ " * 30)], np.array([1.0, 0.0])

    def loss():
        p = np.array([net.score(net.pooled(d)) for d in docs])
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()

    g = net.gradients(docs, y)
    for k in net.p:
        for _ in range(6):
            at = tuple(rng.integers(0, s) for s in net.p[k].shape)
            old, e = net.p[k][at], 1e-6
            net.p[k][at] = old + e
            up = loss()
            net.p[k][at] = old - e
            down = loss()
            net.p[k][at] = old
            assert g[k][at] == pytest.approx((up - down) / (2 * e), abs=1e-5), (k, at)


def labelled(seed, n):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        good = rng.random() < 0.7
        t = prose(rng, "en", rng.randint(2, 20))
        out.append((i, t if good else " ".join(w + rng.choice(["***", "$$$", "###"]) for w in t.split()), int(good)))
    return out


def test_held_out_accuracy(spark):
    data = labelled(1, 240)
    docs = table(spark, [(i, t, None) for i, t, _ in data])
    labels = spark.createDataFrame([(i, q, 0) for i, _, q in data] + [(3, data[3][2], 0), (None, 1, 0), (4, None, 0)], "doc_id long, quality int, toxic int")
    net = fit(docs, labels)
    test = labelled(2, 100)
    got = {r["doc_id"]: r["score"] for r in score(table(spark, [(i, t, None) for i, t, _ in test]), net).collect()}
    assert np.mean([(got[i] >= 0.3) == q for i, _, q in test]) > 0.95


def test_awkward_rows(spark):
    net = Network()
    got = sorted((repr(r["doc_id"]), round(r["score"], 5)) for r in score(table(spark), net).collect())
    assert got == sorted((repr(i), round(net.score(net.pooled(chunks(t))), 5)) for i, t, _ in rows())
    empty = spark.createDataFrame([], SCHEMA)
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert score(empty, net).collect() == [] and fit(table(spark), none) is None and fit(empty, spark.createDataFrame([(1, 1)], "doc_id long, quality int")) is None
    assert {r["score"] for r in score(table(spark), None).collect()} == {0.5}


def test_sample_is_bounded_and_whole(spark, monkeypatch):
    """All chunks of a long labelled text are learned from; documents beyond the bytes are not."""
    seen = []
    monkeypatch.setattr(quality_cnn, "train", lambda docs, labels: seen.append((docs, labels)))
    long = "word " * 4000
    docs = table(spark, [(1, long, None), (2, "short", None), (3, None, None), (4, "x", None)])
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 1)], "doc_id long, quality int")
    fit(docs, labels)
    assert sorted(len(d) for d in seen[0][0]) == [1, 1, len(chunks(long))] and len(chunks(long)) > 20
    fit(docs, labels, sample_bytes=10)
    assert all(len(d) == 1 for d in seen[-1][0]) and fit(docs, labels.filter("doc_id = 1"), sample_bytes=10) is None


def test_plain_forward_pass(spark):
    """Scores equal a forward pass written without slices, strides or batches."""
    net = fit(table(spark, [(i, t, None) for i, t, _ in labelled(1, 60)]), spark.createDataFrame([(i, q) for i, _, q in labelled(1, 60)], "doc_id long, quality int"))
    test = labelled(6, 12)
    got = {r["doc_id"]: r["score"] for r in score(table(spark, [(i, t, None) for i, t, _ in test]), net).collect()}
    width, p = 2 * quality_cnn.STRIDE, net.p
    for i, t, _ in test:
        raw, features = t.encode(), []
        for lo in range(0, max(1, len(raw) - OVERLAP), CHUNK - OVERLAP):
            part = raw[lo : lo + CHUNK].ljust(CHUNK, b"\0")
            x = [np.concatenate([p["embed"][b] for b in part[j : j + width]]) @ p["filter"] + p["bias"] for j in range(0, CHUNK - width + 1, quality_cnn.STRIDE)]
            features.append(np.maximum(np.max(x, 0), 0))
        s = np.mean(features, 0) @ p["mean"] + np.max(features, 0) @ p["max"] + p["out"][0]
        assert got[i] == pytest.approx(1 / (1 + math.exp(-s)), abs=1e-4)


def test_held_out_labels_teach_nothing(spark, tmp_path):
    data = labelled(4, 80)
    out = []
    for k in range(2):
        table(spark, [(i, t, None) for i, t, _ in data]).write.parquet(str(tmp_path / f"{k}/documents.parquet"))
        y = [(i, (1 - q) if k and zlib.crc32(str(i).encode()) % 5 == 0 else q, 0) for i, _, q in data]
        spark.createDataFrame(y, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / f"{k}/labels.parquet"))
        out.append(sorted((r["doc_id"], r["held_out"], round(r["score"], 5), r["predicted"]) for r in op10_quality_cnn(spark, str(tmp_path / str(k))).collect()))
    assert out[0] == out[1] and all(p == (s >= 0.3) for _, _, s, p in out[0])
