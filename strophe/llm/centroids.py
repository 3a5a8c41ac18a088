"""Centroid clustering of integer vectors, with block-norm screening.

A vector is cut into segments. Of each segment its sum and the norm of what the mean leaves over are computed
once and stored with the vector; they are its compressed form. The squared distance of two segments is the
part along the mean plus that of the rest, and by Cauchy-Schwarz the rest is at least as far apart as its norms
are. The sum over the segments is a lower bound of the distance, taken from the compressed forms alone. In
every round a vector's exact integer distance is computed to the centroid of the least bound, then only to
those centroids whose bound, less a margin for rounding, does not exceed the best distance so far; what is
left out is farther for certain, so ties are decided exactly.

A round is one pass over the stored vectors. Each task adds up its vectors by centroid, so a round shuffles
one row per task and centroid, and only the centroids reach the driver. Components beyond 2**27 take Python's
integers; everything is exact at any size.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import load, materialise

DIMENSIONS, SCALE = 64, 1024
CENTROIDS, ROUNDS = 8, 10
#: Components of a segment.
SEGMENT = 8
#: Components up to this size have distances that fit 64 bits; values from the second size on, which no 32-bit float has, are not kept.
NARROW, WIDEST = 1 << 27, 2.0**128
#: Part of the squared norms by which a bound is lowered, far above its rounding error.
MARGIN = 1e-6
#: Sums travel as two numbers, the lower one of so many bits.
LOW = 62
_MAX = (1 << 63) - 1


def compress(c: np.ndarray) -> np.ndarray:
    """For each vector the scaled sums of its segments, then the norms of the segments less their means."""
    parts = c.reshape(len(c), DIMENSIONS // SEGMENT, SEGMENT)
    mean = parts.mean(2)
    rest = np.sqrt(((parts - mean[:, :, None]) ** 2).sum(2))
    return np.concatenate((mean * np.sqrt(SEGMENT), rest), 1)


def lower_bounds(short: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Bounds below every squared distance, vectors by centroids, from compressed forms."""
    out = np.empty((len(short), len(centres)))
    own = (short**2).sum(1)
    for k, z in enumerate(centres):
        out[:, k] = ((short - z) ** 2).sum(1) - MARGIN * (own + (z**2).sum()) - 1
    return out


def distances(c: np.ndarray, centre: list[int], wide: bool) -> np.ndarray:
    """Exact squared distances, 64-bit integers or, if ``wide``, Python's."""
    if wide:
        return np.array([sum((int(a) - b) ** 2 for a, b in zip(v, centre, strict=True)) for v in c.tolist()], object)
    return ((c.astype(np.int64) - np.array(centre, np.int64)) ** 2).sum(1)


def assign(c: np.ndarray, short: np.ndarray, centres: list[list[int]]) -> tuple[np.ndarray, np.ndarray, int]:
    """Number of the nearest centroid and its distance for each vector, and how many exact distances that took."""
    low = lower_bounds(short, compress(np.array(centres, float)))
    wide = bool(np.abs(c).max(initial=0) > NARROW or max(abs(x) for z in centres for x in z) > NARROW)
    first = low.argmin(1)
    best, where, exact = np.zeros(len(c), object if wide else np.int64), first.copy(), len(c)
    for k, z in enumerate(centres):
        at = np.flatnonzero(first == k)
        best[at] = distances(c[at], z, wide)
    for k, z in enumerate(centres):
        at = np.flatnonzero((first != k) & (low[:, k] <= best.astype(float)))
        d = distances(c[at], z, wide)
        nearer = (d < best[at]) | ((d == best[at]) & (k < where[at]))
        best[at[nearer]], where[at[nearer]] = d[nearer], k
        exact += len(at)
    return where, best, exact


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, width)


def _prepare_batches(batches):
    """Vectors of whole, finite components as integers (in doubles, which hold them exactly) and their compressed form."""
    for b in batches:
        e = b.column("embedding")
        rows = pa.array(np.flatnonzero(pc.fill_null(pc.list_value_length(e), -1).to_numpy(zero_copy_only=False) == DIMENSIONS))
        x = _matrix(e.take(rows), DIMENSIONS)
        ok = (np.abs(x) < WIDEST).all(1)  # false for what is null or not a number too
        c = np.floor(x[ok] * SCALE) + 0.0
        lists = [pa.array(list(m), pa.list_(pa.float64())) for m in (c, compress(c))]
        yield pa.RecordBatch.from_arrays([b.column("vec_id").take(rows).filter(pa.array(ok)), *lists], names=["vec_id", "c", "short"])


def _assigned(b: pa.RecordBatch, centres):
    c = _matrix(b.column("c"), DIMENSIONS)
    return c, *assign(c, _matrix(b.column("short"), 2 * DIMENSIONS // SEGMENT), centres)[:2]


def _sum_batches(centres):
    """A row per centroid: how many vectors it has, and the componentwise sums in two parts."""

    def run(batches):
        n, total = [0] * len(centres), [np.zeros(DIMENSIONS, object) for _ in centres]
        for b in batches:
            if not b.num_rows:
                continue
            c, where, _ = _assigned(b, centres)
            narrow = np.abs(c).max() <= NARROW
            for k in set(where.tolist()):
                mine = c[where == k]
                n[k] += len(mine)
                total[k] = total[k] + (mine.astype(np.int64).sum(0).astype(object) if narrow else np.array([sum(map(int, x)) for x in mine.T.tolist()], object))
        used = [k for k in range(len(centres)) if n[k]]
        high = pa.array([[int(x) >> LOW for x in total[k]] for k in used], pa.list_(pa.decimal128(38, 0)))
        low = pa.array([[int(x) & ((1 << LOW) - 1) for x in total[k]] for k in used], pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([n[k] for k in used], pa.int64()), high, low], names=["cluster", "n", "high", "low"])

    return run


def _nearest_batches(centres):
    def run(batches):
        for b in batches:
            if b.num_rows:
                _, where, best = _assigned(b, centres)
                kept = [d if d <= _MAX else None for d in best.tolist()]
                yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(where, pa.int32()), pa.array(kept, pa.int64())], names=["vec_id", "cluster", "distance"])

    return run


def prepare(vectors: DataFrame) -> DataFrame:
    """``vec_id, c, short`` of the vectors that are kept, written to the shared folder."""
    kind = vectors.schema["vec_id"].dataType.simpleString()
    return materialise(vectors.select("vec_id", "embedding").mapInArrow(_prepare_batches, f"vec_id {kind}, c array<double>, short array<double>"), "vectors")


def start(ready: DataFrame, k: int) -> list[list[int]]:
    """The vectors of the k smallest hashes, in their order."""
    named = F.sha2(F.concat(F.lit("3:"), F.col("vec_id").cast("string")), 256)
    rows = ready.select(named.alias("hash"), "c").orderBy(F.asc_nulls_last("hash"), "c").limit(k).collect()
    return [[int(x) for x in r["c"]] for r in rows]


def moved(ready: DataFrame, centres: list[list[int]]) -> list[list[int]]:
    """The centroids after a round: the floored mean of each one's vectors; one without vectors stays."""
    parts = ready.select("vec_id", "c", "short").mapInArrow(_sum_batches(centres), "cluster int, n long, high array<decimal(38,0)>, low array<long>")
    cells = parts.select("cluster", "n", F.posexplode(F.arrays_zip("high", "low")).alias("i", "s"))
    sums = cells.groupBy("cluster", "i").agg(F.sum("n").alias("n"), F.sum("s.high").alias("high"), F.sum(F.col("s.low").cast("decimal(38,0)")).alias("low"))
    out = [list(z) for z in centres]
    for r in sums.collect():  # as many as centroids have components
        out[r["cluster"]][r["i"]] = ((int(r["high"]) << LOW) + int(r["low"])) // r["n"]
    return out


def cluster(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS) -> DataFrame:
    """One row per kept vector: ``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256``.

    Kept are the rows of ``vec_id, embedding`` whose vector has 64 components, none null, none non-finite (nor
    of 2**128 or more, which only a column of doubles can hold). With fewer kept vectors than centroids, each
    is one; without any, as of an empty table, the result is empty. A null vec_id is hashed behind all others; vectors
    of equal hash start in the order of their components. Repeated rows are vectors each for itself, other
    columns are ignored. A distance or sum that a long can't hold is null. Rounds end early once no
    centroid moves, which gives the same result.
    """
    spark = vectors.sparkSession
    ready = prepare(vectors)
    centres = start(ready, k)
    kind = vectors.schema["vec_id"].dataType.simpleString()
    if not centres:
        return spark.createDataFrame([], f"vec_id {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    for _ in range(rounds):
        before, centres = centres, moved(ready, centres)
        if centres == before:
            break
    found = materialise(ready.mapInArrow(_nearest_batches(centres), f"vec_id {kind}, cluster int, distance long"), "nearest")
    total = F.when(F.count("distance") == F.count(F.lit(1)), F.sum(F.col("distance").cast("decimal(38,0)")))
    per = found.groupBy("cluster").agg(total.alias("cluster_inertia"))
    whole = found.agg(total.alias("inertia")).first()["inertia"]
    names = [(i, hashlib.sha256(",".join(map(str, z)).encode()).hexdigest()) for i, z in enumerate(centres)]
    facts = per.join(spark.createDataFrame(names, "cluster int, centroid_sha256 string"), "cluster")  # a row per centroid
    inertia = F.lit(None if whole is None else str(whole)).try_cast("long")
    return found.join(F.broadcast(facts), "cluster").select(
        "vec_id", "cluster", "distance", F.col("cluster_inertia").try_cast("long").alias("cluster_inertia"), inertia.alias("inertia"), "centroid_sha256"
    )


def op11_centroid_clustering(spark, sf_dir):
    return cluster(load(spark, sf_dir, "embeddings"))


def _sql() -> str:
    far = "list_transform(t, lambda z: list_sum(list_transform(range(1, 65), lambda i: (c[i] - z[i]) * (c[i] - z[i])))::BIGINT)"
    near = f"SELECT *, list_position(ds, list_min(ds)) AS k, list_min(ds) AS d FROM (SELECT v.*, {far} AS ds FROM v, {{0}})"
    steps = []
    for r in range(ROUNDS):
        steps.append(f"""
a{r} AS MATERIALIZED ({near.format(f"t{r}")}),
m{r} AS MATERIALIZED (
  SELECT k, list((s - ((s % n) + n) % n) // n ORDER BY i) AS z
  FROM (SELECT k, i, sum(x)::BIGINT AS s, count(*) AS n FROM (SELECT k, unnest(range(1, 65)) AS i, unnest(c) AS x FROM a{r}) GROUP BY k, i) GROUP BY k
),
t{r + 1} AS MATERIALIZED (
  SELECT list(coalesce(m{r}.z, o.z) ORDER BY o.k) AS t
  FROM (SELECT unnest(t) AS z, unnest(range(1, len(t) + 1)) AS k FROM t{r}) o LEFT JOIN m{r} ON m{r}.k = o.k
)""")
    return f"""
WITH v AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 1024)::BIGINT) AS c FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64
),
t0 AS MATERIALIZED (
  SELECT list(c ORDER BY h, c) AS t FROM (SELECT c, sha256('3:' || vec_id) AS h FROM v ORDER BY h NULLS LAST, c LIMIT {CENTROIDS})
),{",".join(steps)},
f AS MATERIALIZED ({near.format(f"t{ROUNDS}")})
SELECT vec_id, (k - 1)::INTEGER AS cluster, d AS distance, sum(d) OVER (PARTITION BY k)::BIGINT AS cluster_inertia, sum(d) OVER ()::BIGINT AS inertia,
       sha256(array_to_string(t[k], ',')) AS centroid_sha256
FROM f, t{ROUNDS}
"""


OP11_SQL = _sql()
