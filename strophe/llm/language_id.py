"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Texts are lower-cased, everything but letters becomes one space, and 1- to 3-grams of the whole text are
hashed to ``DIM`` buckets. Weights are learned by follow-the-regularised-leader with an elastic-net
penalty, which leaves most of them zero; one temperature is then fitted on rows kept out of that.
The fit uses a sample of about ``PER_LANGUAGE`` labelled documents of each language, its n-gram counts
being all that reaches the driver. Prediction is one Arrow pass over the table.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_batches, load

DIM = 1 << 14
ORDERS = (1, 2, 3)
#: Labelled documents of each language that the fit uses (expected number; chosen by a hash of doc_id).
PER_LANGUAGE = 400
#: FTRL: learning rate, its smoothing, L1, L2; passes over the sample.
ALPHA, BETA, L1, L2, PASSES = 0.5, 1.0, 0.02, 0.01, 4
#: Probability of the best language below which a document is rejected.
MIN_SCORE = 0.5
#: Characters of a text whose n-grams are counted at a time.
SLICE = 1 << 18
_LETTER: list[np.ndarray] = []


def _letters() -> np.ndarray:
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(i).isalpha() for i in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1))
    return _LETTER[0]


def ngram_counts(text: str | None) -> np.ndarray | None:
    """Bucket counts of the whole text, or None if it has no letter. Only the lower-cased text is held whole."""
    text = (text or "").lower()
    total, letters, before = np.zeros(DIM, np.int64), False, False
    held = np.zeros(0, np.uint64)  # the last code points that begin n-grams of the next slice

    def count(points):
        nonlocal held
        joined = np.concatenate((held, points.astype(np.uint64)))
        for n in ORDERS:
            own = joined[max(0, len(held) - n + 1) :]  # n-grams that end in this slice
            if len(own) < n:
                continue
            h = np.full(len(own) - n + 1, n, np.uint64)
            for i in range(n):
                h = (h ^ own[i : len(own) - n + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(29)
            total[:] += np.bincount((h & np.uint64(DIM - 1)).astype(np.int64), minlength=DIM)
        held = joined[-(max(ORDERS) - 1) :]

    for at in range(0, len(text), SLICE):
        points = np.frombuffer(text[at : at + SLICE].encode("utf-32-le", "surrogatepass"), "<u4")
        letter = _letters()[points]
        if letter.any() and not letters:
            letters = True
            count(np.array([32]))
        keep = letter | np.concatenate(([before], letter[:-1]))  # of other characters the first after a letter
        before = bool(letter[-1])
        if keep.any():
            count(np.where(letter, points, 32)[keep])
    if before:
        count(np.array([32]))
    return total if letters else None


def tfidf(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Rows of log-damped counts times idf, scaled to unit length."""
    x = np.log1p(counts.astype(np.float32)) * idf
    return x / np.maximum(np.sqrt((x * x).sum(-1, keepdims=True)), 1e-12)


class Model:
    def __init__(self, languages: list[str], idf: np.ndarray, weights: np.ndarray, temperature: float):
        self.languages, self.idf, self.weights, self.temperature = languages, idf, weights, temperature

    def probabilities(self, counts) -> np.ndarray:
        """For rows of bucket counts; only the buckets that a row has are multiplied."""
        z = np.empty((len(counts), len(self.languages)), np.float32)
        for i, c in enumerate(counts):
            at = np.flatnonzero(c)
            z[i] = tfidf(c[at], self.idf[at]) @ self.weights[at] + self.weights[-1]
        z /= self.temperature
        e = np.exp(z - z.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)


def _ftrl(x: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, classes: int, seed: int = 7) -> np.ndarray:
    """Weights (DIM + 1, classes), the last row the intercept; x holds (buckets, values) of each row."""
    z, n = np.zeros((DIM + 1, classes)), np.zeros((DIM + 1, classes))

    def weights(at):
        zz, nn = z[at], n[at]
        l1 = np.where(at[:, None] == DIM, 0.0, L1)
        return np.where(np.abs(zz) <= l1, 0.0, -(zz - np.sign(zz) * l1) / ((BETA + np.sqrt(nn)) / ALPHA + L2))

    rng = np.random.default_rng(seed)
    for _ in range(PASSES):
        for i in rng.permutation(len(x)):
            at, v = x[i]
            w = weights(at)
            s = v @ w
            p = np.exp(s - s.max())
            p /= p.sum()
            p[y[i]] -= 1
            g = v[:, None] * p
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - sigma * w
            n[at] += g * g
    return weights(np.arange(DIM + 1)).astype(np.float32)


def _temperature(logits: np.ndarray, y: np.ndarray) -> float:
    def loss(t):
        s = logits / t
        s = s - s.max(1, keepdims=True)
        return (np.log(np.exp(s).sum(1)) - s[np.arange(len(y)), y]).mean()

    return float(min(np.geomspace(0.02, 20, 120), key=loss)) if len(y) else 1.0


def train(counts: list[np.ndarray], labels: list[str], folds: list[int]) -> Model:
    """Fit on rows whose fold is not 0, calibrate on those whose fold is 0. ``counts`` are sparse (bucket, count)."""
    languages = sorted(set(labels))
    y = np.array([languages.index(v) for v in labels])
    df = np.zeros(DIM)
    for at, _ in counts:
        df[at] += 1
    idf = (np.log((1 + len(counts)) / (1 + df)) + 1).astype(np.float32)
    rows = []
    for at, c in counts:
        v = np.log1p(c.astype(np.float32)) * idf[at]
        rows.append((np.append(at, DIM), np.append(v / max(np.sqrt((v * v).sum()), 1e-12), 1.0)))
    fit = [i for i, f in enumerate(folds) if f != 0] or list(range(len(rows)))
    w = _ftrl([rows[i] for i in fit], y[fit], len(languages))
    held = [i for i, f in enumerate(folds) if f == 0]
    logits = np.array([rows[i][1] @ w[rows[i][0]] for i in held]).reshape(len(held), len(languages))
    return Model(languages, idf, w, _temperature(logits, y[held]))


def _count_batches(batches):
    for b in batches:
        at, n = [], []
        for t in b.column("text"):
            c = ngram_counts(t.as_py())
            nz = np.flatnonzero(c) if c is not None else np.zeros(0, np.int64)
            at.append(nz.astype("<u2").tobytes())
            n.append(c[nz].clip(max=(1 << 32) - 1).astype("<u4").tobytes() if c is not None else b"")
        yield pa.RecordBatch.from_arrays([b.column("lang"), b.column("fold"), pa.array(at, pa.binary()), pa.array(n, pa.binary())], names=["lang", "fold", "at", "n"])


def fit(labelled: DataFrame, per_language: int = PER_LANGUAGE) -> Model | None:
    """Learn from ``doc_id, text, lang`` rows; null texts and langs are left out. None if nothing is left."""
    rows = in_batches(labelled).filter("text is not null and lang is not null").select("doc_id", "text", "lang")
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not sizes:
        return None
    spark = labelled.sparkSession
    shares = spark.createDataFrame([(k, min(1.0, per_language / n)) for k, n in sizes.items()], "lang string, share double")
    h = F.xxhash64("doc_id", F.lit("language"))
    unit = F.shiftrightunsigned(h, 11) / F.lit(float(1 << 53))
    sample = (
        rows.join(F.broadcast(shares), "lang").filter(unit < F.col("share"))
        .select("text", "lang", F.pmod(h, F.lit(5)).cast("int").alias("fold"))
        .mapInArrow(_count_batches, "lang string, fold int, at binary, n binary").toArrow()
    )
    got = sorted(zip(*[sample.column(c).to_pylist() for c in ("lang", "fold", "at", "n")], strict=True))
    got = [r for r in got if r[2]]
    if not got:
        return None
    counts = [(np.frombuffer(r[2], "<u2").astype(np.int64), np.frombuffer(r[3], "<u4")) for r in got]
    return train(counts, [r[0] for r in got], [r[1] for r in got])


def _predict_batches(model: Model | None):
    def run(batches):
        for b in batches:
            langs, scores = [], []
            texts = b.column("text")
            for lo in range(0, b.num_rows, 64):
                rows = [ngram_counts(t.as_py()) for t in texts[lo : lo + 64]]
                known = [r for r in rows if r is not None] if model else []
                p = iter(model.probabilities(known) if known else ())
                for r in rows:
                    q = next(p) if r is not None and model else None
                    langs.append("und" if q is None else model.languages[int(q.argmax())])
                    scores.append(0.0 if q is None else float(q.max()))
            rest = [b.column(c) for c in b.schema.names if c != "text"]
            names = [c for c in b.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(langs), pa.array(scores, pa.float64())], names=[*names, "lang_pred", "score"])

    return run


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """``doc_id, lang_pred, score`` for each row; ``und`` with score 0 for a null text or one without a letter.

    Repeated rows get equal results, other columns are ignored, an empty table gives an empty result.
    Without a model (no labelled row) everything is ``und``.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    return in_batches(docs.select("doc_id", "text")).mapInArrow(_predict_batches(model), f"doc_id {kind}, lang_pred string, score double")


def _accepting_batches(model: Model | None, least: float):
    def run(batches):
        for b in batches:
            keep = []
            for t in b.column("text"):
                c = ngram_counts(t.as_py())
                keep.append(c is not None and (model is None or float(model.probabilities(c[None]).max()) >= least))
            yield b.filter(pa.array(keep, pa.bool_()))

    return run


def keep_known(docs: DataFrame, model: Model | None, least: float = MIN_SCORE) -> DataFrame:
    """The input's rows, in its columns, that have a letter and a language with at least this probability.

    Without a model (no labelled row) every row with a letter stays.
    """
    return in_batches(docs).mapInArrow(_accepting_batches(model, least), docs.schema)


def remainder(column: str, n: int):
    """crc32 of an id's decimal text, modulo n; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))), F.lit(n)).cast("int")


def op2_language_id(spark, sf_dir):
    docs = load(spark, sf_dir, "documents")
    held = remainder("doc_id", 4) == 2
    model = fit(docs.filter(~held))
    return predict(docs, model).withColumn("held_out", held).select("doc_id", "held_out", "lang_pred", "score")
