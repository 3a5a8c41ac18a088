import math
import random

import numpy as np
from data import LANG_WORDS, SCHEMA, prose, rows, table

from strophe.llm import language_id
from strophe.llm.language_id import DIM, fit, keep_known, ngram_counts, op2_language_id, predict, tfidf, train


def corpus(seed, n):
    rng = random.Random(seed)
    return [(i, prose(rng, lang, rng.randint(1, 8)), lang) for i in range(n) for lang in [rng.choice(list(LANG_WORDS))]]


def test_counts_and_tfidf():
    c = ngram_counts("Ab, ab!")
    assert c.sum() == (7 + 6 + 5) and (c == ngram_counts("ab AB")).all()  # " ab ab ": 1-, 2- and 3-grams
    assert ngram_counts(None) is None and ngram_counts("12 \n!") is None and ngram_counts("") is None
    x = tfidf(np.array([[3.0, 0.0, 1.0]]), np.array([1.0, 5.0, 2.0], np.float32))[0]
    raw = [math.log(4), 0, 2 * math.log(2)]
    assert np.allclose(x, np.array(raw) / math.sqrt(sum(v * v for v in raw)))


def test_counts_by_slices(monkeypatch):
    """Cut anywhere, a text gives the counts of one that is counted whole."""
    texts = [t for _, t, _ in rows()] + ["a1", "1a", "  ab  cd", "a" * 40, ".a.b..c", "12 3456 78 9 x"]
    whole = [ngram_counts(t) for t in texts]
    for size in (1, 2, 3, 7):
        monkeypatch.setattr(language_id, "SLICE", size)
        for t, w in zip(texts, whole):
            c = ngram_counts(t[:500] if t else t)
            monkeypatch.setattr(language_id, "SLICE", 1 << 18)
            one = ngram_counts(t[:500] if t else t)
            monkeypatch.setattr(language_id, "SLICE", size)
            assert (c is None) == (one is None) == (w is None or one is None) and (c is None or (c == one).all())


def plain_ftrl(rows_, y, classes):
    """The update rule coordinate by coordinate."""
    z, n = {}, {}
    rng = np.random.default_rng(7)

    def weight(j, k):
        l1 = 0.0 if j == DIM else language_id.L1
        v = z.get((j, k), 0.0)
        if abs(v) <= l1:
            return 0.0
        return -(v - math.copysign(l1, v)) / ((language_id.BETA + math.sqrt(n.get((j, k), 0.0))) / language_id.ALPHA + language_id.L2)

    for _ in range(language_id.PASSES):
        for i in rng.permutation(len(rows_)):
            at, values = rows_[i]
            w = {(j, k): weight(j, k) for j in at.tolist() for k in range(classes)}
            s = [sum(v * w[j, k] for j, v in zip(at.tolist(), values.tolist())) for k in range(classes)]
            e = [math.exp(x - max(s)) for x in s]
            for k in range(classes):
                d = e[k] / sum(e) - (k == y[i])
                for j, v in zip(at.tolist(), values.tolist()):
                    g, old = v * d, n.get((j, k), 0.0)
                    z[j, k] = z.get((j, k), 0.0) + g - (math.sqrt(old + g * g) - math.sqrt(old)) / language_id.ALPHA * w[j, k]
                    n[j, k] = old + g * g
    return {(j, k): weight(j, k) for j, k in z}


def test_ftrl_against_a_plain_loop(monkeypatch):
    monkeypatch.setattr(language_id, "L1", 0.4)
    rng = np.random.default_rng(3)
    rows_ = [(np.append(np.sort(rng.choice(40, 6, replace=False)), DIM), np.append(rng.random(6), 1.0)) for _ in range(30)]
    y = rng.integers(0, 3, 30)
    got, want = language_id._ftrl(rows_, y, 3), plain_ftrl(rows_, y, 3)
    assert all(abs(got[j, k] - w) < 1e-5 for (j, k), w in want.items()) and sum(w == 0 for w in want.values()) > 0
    assert np.count_nonzero(got) == sum(abs(w) > 0 for w in want.values())


def test_query_against_plain_model(spark):
    """Predictions equal a plain forward pass of the model over dense vectors."""
    model = fit(table(spark, corpus(1, 200)), per_language=40)
    test = corpus(5, 40)
    got = {r["doc_id"]: r for r in predict(table(spark, test), model).collect()}
    for i, t, _ in test:
        x = [math.log(1 + c) * f for c, f in zip(ngram_counts(t).tolist(), model.idf.tolist())]
        norm = math.sqrt(sum(v * v for v in x))
        s = [(sum(v * w for v, w in zip(x, model.weights[:-1, k].tolist()) if v) / norm + float(model.weights[-1, k])) / model.temperature for k in range(4)]
        e = [math.exp(v - max(s)) for v in s]
        assert abs(max(e) / sum(e) - got[i]["score"]) < 1e-4 and model.languages[e.index(max(e))] == got[i]["lang_pred"]


def test_sparse_and_calibrated():
    data = corpus(1, 240)
    counts = []
    for _, t, _ in data:
        c = ngram_counts(t)
        at = np.flatnonzero(c)
        counts.append((at, c[at]))
    m = train(counts, [g for _, _, g in data], [i % 5 for i in range(len(data))])
    assert m.languages == sorted(LANG_WORDS) and m.weights.shape == (DIM + 1, 4)
    assert (m.weights == 0).mean() > 0.5 and m.temperature > 0
    p = m.probabilities(np.array([ngram_counts(t) for _, t, _ in corpus(2, 50)]))
    assert np.allclose(p.sum(1), 1, atol=1e-5)


def test_held_out_accuracy(spark):
    model = fit(table(spark, corpus(1, 300)), per_language=60)
    test = corpus(9, 120)
    got = {r["doc_id"]: r for r in predict(table(spark, test), model).collect()}
    assert np.mean([got[i]["lang_pred"] == g for i, _, g in test]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_awkward_rows(spark):
    model = fit(table(spark, corpus(1, 100)))
    got = sorted((repr(r["doc_id"]), r["lang_pred"] == "und", r["score"] == 0) for r in predict(table(spark), model).collect())
    want = sorted((repr(i), und, und) for i, t, _ in rows() for und in [not any(c.isalpha() for c in t or "")])
    assert got == want
    kept = keep_known(table(spark), model, least=0.0)
    assert kept.columns == table(spark).columns and kept.count() == sum(not w[1] for w in want)
    assert keep_known(table(spark), model, least=1.1).count() == 0


def test_nothing_to_learn(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert fit(empty) is None and predict(empty, None).collect() == []
    unlabelled = table(spark, [(1, "text", None), (2, None, "en")])
    assert fit(unlabelled) is None
    assert {(r["lang_pred"], r["score"]) for r in predict(unlabelled, None).collect()} == {("und", 0.0)}
    assert keep_known(unlabelled, None).count() == 1


def test_held_out_rows_teach_nothing(spark, tmp_path):
    """Labels of held-out rows may be anything: predictions stay the same."""
    import zlib

    data = corpus(4, 160)
    spoiled = [(i, t, "xx" if zlib.crc32(str(i).encode()) % 4 == 2 else g) for i, t, g in data]
    out = []
    for k, d in enumerate((data, spoiled)):
        table(spark, d).select("doc_id", "text", "lang").write.parquet(str(tmp_path / f"{k}/documents.parquet"))
        out.append(sorted(map(tuple, op2_language_id(spark, str(tmp_path / str(k))).collect())))
    assert out[0] == out[1] and {r[1] for r in out[0]} == {True, False}
    assert language_id.MIN_SCORE == 0.5
