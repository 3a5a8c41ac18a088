"""Document quality by a byte-level convolutional network in numpy.

A text's UTF-8 bytes are cut into overlapping chunks that cover it whole. Learned filters run over
embedded bytes of each chunk; their largest responses are the chunk's features. The mean and the
maximum of these over all chunks go through a logistic unit, which gives one probability.

The fit uses a sample of labelled documents, whole: in the order of a hash of doc_id, up to about ``SAMPLE``
of them and up to ``SAMPLE_BYTES`` together. That is all that reaches the driver. Scoring reads every byte
of every text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_batches, load, materialise
from .language_id import remainder

CHUNK, OVERLAP = 1024, 64
EMBED, FILTERS, STRIDE = 8, 24, 4  # a filter sees 2 * STRIDE bytes
SAMPLE, SAMPLE_BYTES, EPOCHS, BATCH, RATE = 3000, 12 << 20, 8, 32, 0.01
THRESHOLD = 0.3
#: Chunks convolved at a time.
SLICE = 64


def chunks(text: str | None) -> np.ndarray:
    """Rows of CHUNK bytes, zero-padded at the end; neighbours share OVERLAP bytes."""
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    step = CHUNK - OVERLAP
    n = max(1, -(-(len(raw) - OVERLAP) // step))
    padded = np.zeros((n - 1) * step + CHUNK, np.uint8)
    padded[: len(raw)] = raw
    return np.lib.stride_tricks.sliding_window_view(padded, CHUNK)[::step]


class Network:
    def __init__(self, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.p = {
            "embed": rng.normal(0, 0.5, (256, EMBED)).astype(np.float32),
            "filter": rng.normal(0, (2 / (2 * STRIDE * EMBED)) ** 0.5, (2 * STRIDE * EMBED, FILTERS)).astype(np.float32),
            "bias": np.zeros(FILTERS, np.float32),
            "mean": rng.normal(0, 0.1, FILTERS).astype(np.float32),
            "max": rng.normal(0, 0.1, FILTERS).astype(np.float32),
            "out": np.zeros(1, np.float32),
        }

    def pooled(self, rows: np.ndarray, where: bool = False):
        """Largest filter responses (at least 0) of each chunk, and the positions of these."""
        half, p = STRIDE * EMBED, self.p
        x = p["embed"][rows].reshape(len(rows), CHUNK // STRIDE, half)
        y = x @ p["filter"][:half]
        y = y[:, :-1] + (x @ p["filter"][half:])[:, 1:]
        top = y.max(1)
        z = np.maximum(top + p["bias"], 0)
        return (z, y.argmax(1)) if where else z

    def score(self, features: np.ndarray) -> float:
        """Probability of a document from its chunks' features."""
        p = self.p
        s = features.mean(0) @ p["mean"] + features.max(0) @ p["max"] + p["out"][0]
        return float(1 / (1 + np.exp(-np.clip(s, -30, 30))))

    def gradients(self, docs: list[np.ndarray], labels: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean log loss over documents given as chunk rows."""
        p, rows = self.p, np.concatenate(docs)
        z, at = (np.concatenate(x) for x in zip(*[self.pooled(rows[i : i + SLICE], where=True) for i in range(0, len(rows), SLICE)]))
        owner = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
        starts = np.searchsorted(owner, np.arange(len(docs)))
        count = np.bincount(owner)[:, None]
        mean, top = np.add.reduceat(z, starts) / count, np.maximum.reduceat(z, starts)
        s = mean @ p["mean"] + top @ p["max"] + p["out"][0]
        d = ((1 / (1 + np.exp(-np.clip(s, -30, 30)))) - labels) / len(docs)
        g = {"mean": d @ mean, "max": d @ top, "out": np.array([d.sum()])}
        best = z == top[owner]
        best = best / np.maximum(np.add.reduceat(best.astype(np.float32), starts)[owner], 1)
        gz = (d[owner, None] * (p["mean"] / count[owner] + p["max"] * best)) * (z > 0)
        g["bias"] = gz.sum(0)
        window = at[:, :, None] * STRIDE + np.arange(2 * STRIDE)  # chunk, filter, byte
        byte = rows[np.arange(len(rows))[:, None, None], window]
        seen = p["embed"][byte].reshape(len(rows), FILTERS, -1)
        g["filter"] = np.einsum("cf,cfk->kf", gz, seen)
        back = (gz[:, :, None] * p["filter"].T[None]).reshape(-1, EMBED)
        g["embed"] = np.zeros_like(p["embed"])
        np.add.at(g["embed"], byte.ravel(), back)
        return g


def train(docs: list[np.ndarray], labels: np.ndarray, seed: int = 11) -> Network:
    """Adam over minibatches; the step shrinks to a tenth over the epochs."""
    net, rng = Network(seed), np.random.default_rng(seed)
    m, v, t = {k: 0.0 for k in net.p}, {k: 0.0 for k in net.p}, 0
    share = np.clip(labels.mean(), 1e-3, 1 - 1e-3)
    net.p["out"][0] = np.log(share / (1 - share))
    steps = EPOCHS * -(-len(docs) // BATCH)
    for _ in range(EPOCHS):
        order = rng.permutation(len(docs))
        for lo in range(0, len(docs), BATCH):
            pick = order[lo : lo + BATCH]
            g, t = net.gradients([docs[i] for i in pick], labels[pick]), t + 1
            rate = RATE * 0.1 ** (t / steps)
            for k, x in g.items():
                m[k], v[k] = 0.9 * m[k] + 0.1 * x, 0.999 * v[k] + 0.001 * x * x
                net.p[k] -= (rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
    return net


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> Network | None:
    """Learn ``quality`` of labelled documents; rows with a null label are left out. None without labels.

    Labels are narrow: they are thinned to about ``sample`` by a hash of doc_id before they meet the texts.
    Of these, in the order of the hash, each document is taken that still fits into ``sample_bytes``.
    """
    known = labels.filter("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    n = known.count()
    if not n:
        return None
    seed = F.xxhash64("doc_id", F.lit("quality"))
    unit = F.shiftrightunsigned(seed, 11) / F.lit(float(1 << 53))
    thin = lambda df: df.filter(unit < F.lit(min(1.0, sample / n)))
    texts = F.coalesce("text", F.lit(""))
    chosen = materialise(
        thin(docs.select("doc_id", "text")).join(thin(known), "doc_id")
        .select(seed.alias("seed"), texts.alias("text"), F.col("quality").cast("int").alias("quality"), F.octet_length(texts).alias("size"), F.xxhash64(texts).alias("h")),
        "labelled-sample",
    )
    left, picks = sample_bytes, []
    for r in sorted(chosen.select("seed", "h", "size").collect()):
        if r["size"] <= left:
            left -= r["size"]
            picks.append(tuple(r))
    if not picks:
        return None
    picked = chosen.sparkSession.createDataFrame(sorted(set(picks)), "seed long, h long, size int")
    rows = sorted((r["seed"], r["h"], r["quality"], r["text"]) for r in chosen.join(F.broadcast(picked), ["seed", "h", "size"]).collect())
    return train([chunks(r[3]) for r in rows], np.array([float(r[2]) for r in rows]))


def _score_batches(net: Network | None):
    def run(batches):
        for b in batches:
            scores = []
            texts = b.column("text")
            at = 0
            while at < b.num_rows:  # documents together up to SLICE chunks; longer ones in slices
                group, n = [], 0
                while at < b.num_rows and (not group or n < SLICE):
                    group.append(chunks(texts[at].as_py()))
                    n += len(group[-1])
                    at += 1
                if net is None:
                    scores += [0.5] * len(group)
                    continue
                rows = np.concatenate(group)
                z = np.concatenate([net.pooled(rows[i : i + SLICE]) for i in range(0, len(rows), SLICE)])
                lo = 0
                for g in group:
                    scores.append(net.score(z[lo : lo + len(g)]))
                    lo += len(g)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    return run


def score(docs: DataFrame, net: Network | None) -> DataFrame:
    """``doc_id, score`` for each row; a null text is scored as the empty one, without a network all get 0.5.

    Repeated rows get equal scores, other columns are ignored, an empty table gives an empty result.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    return in_batches(docs.select("doc_id", "text")).mapInArrow(_score_batches(net), f"doc_id {kind}, score double")


def op10_quality_cnn(spark, sf_dir):
    docs, labels = load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels")
    net = fit(docs, labels.filter(remainder("doc_id", 5) != 0))
    out = score(docs, net)
    return out.select(
        "doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )
