"""Positional trigram postings, kept in segments: phrases are found, counted and ranked without reading a text.

A segment covers some rows of a catalogue and never changes. Its postings are rows ``gram, id, field, d, positions``:
the code of a trigram, the song, main or background text, the song's length in trigrams, and the places of the
trigram in the lower-cased text. They lie in folders by a hash of the trigram, as many as the segment's size asks
for, in files by the task that cut the texts, sorted by trigram, so a search reads a folder for each trigram of its phrase and of that only the row
groups and pages of the trigram. Segments are listed from old to new; a song in a newer one replaces the song of that id
in older ones.

A phrase stands where all its trigrams stand at the right distance, so places are shifted and intersected. The
exact number of such songs enters BM25's weight, so every candidate's places are looked at and no bound on scores can spare
that; texts are read for the snippets of the best hits alone.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

K1, B = 1.2, 0.75
#: Weights of the main and the background text.
WEIGHTS = (1.0, 0.25)
MIN_CHARS = 3
#: Trigram places of a folder, folders of a segment at most (beyond, their files are more), rows of one trigram in a merged file.
FOLDER_GRAMS, FOLDERS, FILE_ROWS = 1 << 26, 4096, 1 << 22
#: Characters of a text that are cut into trigrams at a time, and rows of a batch.
SLICE, BATCH = 1 << 20, 1 << 17
#: Replaced songs up to which they are broadcast; songs from which the rarest trigram is looked up first, and its songs up to which they are broadcast.
SMALL, LARGE = 100_000, 1_000_000
_SCHEMA = "gram long, id long, field int, d long, positions array<int>, bucket int"


class Segment(NamedTuple):
    """Folder of a segment, its number of posting folders (none: lengths alone are kept), its songs and the sum of their lengths in trigrams."""

    path: str
    buckets: int
    docs: int
    length: int


def codes(text: str) -> np.ndarray:
    """Codes of a text's trigrams in order: three code points of 21 bits."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    return c[:-2] << 42 | c[1:-1] << 21 | c[2:] if len(c) >= 3 else c[:0]


def bucket_of(gram, buckets: int):
    return ((gram % 1_000_003) * 40_503 >> 4) % buckets


def _places(text: str):
    """For each slice of a text: the distinct codes, where each one's places begin and end, and the places."""
    for at in range(0, max(1, len(text) - 2), SLICE):
        found = codes(text[at : at + SLICE + 2])
        order = np.argsort(found, kind="stable")
        begins = np.flatnonzero(np.diff(found[order], prepend=-1))
        yield found[order[begins]], np.append(begins, len(found)), (order + at).astype(np.int32)


def _posting_batches(buckets):
    def run(batches):
        held: list[tuple] = []
        rows = 0

        def batch():
            grams, ids, fields, lengths, sizes, places = (np.concatenate(x) for x in zip(*held, strict=True))
            offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(places))
            arrays = [pa.array(grams), pa.array(ids), pa.array(fields.astype(np.int32)), pa.array(lengths), lists, pa.array(bucket_of(grams, buckets).astype(np.int32))]
            held.clear()
            return pa.RecordBatch.from_arrays(arrays, names=["gram", "id", "field", "d", "positions", "bucket"])

        for b in batches:
            for number, d, *texts in zip(b.column("id").to_pylist(), b.column("d").to_pylist(), b.column("main"), b.column("bg"), strict=True):
                for field, text in enumerate(texts):
                    for grams, ends, places in _places(text.as_py() or ""):
                        n = len(grams)
                        if n:
                            held.append((grams, np.full(n, number), np.full(n, field), np.full(n, d), np.diff(ends), places))
                            rows += n + len(places) // 8
                    if rows >= BATCH:
                        yield batch()
                        rows = 0
        if held:
            yield batch()

    return run


def _length(column: str):
    return F.greatest(F.char_length(F.coalesce(column, F.lit(""))) - 2, F.lit(0)).cast("long")


def write_segment(docs: DataFrame, root: str, postings: bool = True) -> Segment:
    """The segment of ``id, lyric_text, bg_vocal_text`` rows, in a new folder below ``root``; without ``postings`` it has the songs' lengths alone."""
    spark, path = docs.sparkSession, f"{root.rstrip('/')}/{uuid.uuid4().hex}"
    docs = docs.select("id", "lyric_text", "bg_vocal_text", (_length("lyric_text") + _length("bg_vocal_text")).alias("d"))
    docs.select("id", "d").write.parquet(f"{path}/docs")
    r = spark.read.parquet(f"{path}/docs").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("d"), F.lit(0)).alias("total")).first()
    if not postings:
        return Segment(path, 0, r["n"], r["total"])
    files = -(-r["total"] // FOLDER_GRAMS)
    buckets = min(FOLDERS, 1 << max(0, files - 1).bit_length())
    texts = docs.select("id", "d", F.lower("lyric_text").alias("main"), F.lower("bg_vocal_text").alias("bg"))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))
    # Each task sorts and writes what it cuts: a trigram's rows lie in a file of each task, and the postings, many times the texts, meet no shuffle.
    rows = texts.mapInArrow(_posting_batches(buckets), _SCHEMA).sortWithinPartitions("bucket", "gram", "id")
    rows.write.option("compression", "zstd").partitionBy("bucket").parquet(f"{path}/postings")
    return Segment(path, buckets, r["n"], r["total"])


class TextIndex(NamedTuple):
    """Segments from old to new, and the songs and lengths that are valid, without those that were replaced."""

    segments: tuple[Segment, ...]
    docs: int
    length: int

    def _newer(self, spark: SparkSession, number: int) -> DataFrame | None:
        """``gone``: ids that segments after this one hold; broadcast if few."""
        later = [s for s in self.segments[number + 1 :] if s.docs]
        if not later:
            return None
        ids = None
        for s in later:
            mine = spark.read.schema("id long").parquet(f"{s.path}/docs").select(F.col("id").alias("gone"))
            ids = mine if ids is None else ids.unionByName(mine)
        return F.broadcast(ids) if sum(s.docs for s in later) <= SMALL else ids

    def postings(self, spark: SparkSession, grams: Sequence[int]) -> DataFrame:
        """The valid postings of some trigrams; of each segment their folders alone are read."""
        out = spark.createDataFrame([], _SCHEMA)
        for number, s in enumerate(self.segments):
            if not s.buckets:
                raise ValueError("the catalogue keeps no postings of texts")
            if not s.docs or not s.length:
                continue
            rows = spark.read.schema(_SCHEMA).parquet(f"{s.path}/postings")
            rows = rows.filter(F.col("bucket").isin(sorted({bucket_of(g, s.buckets) for g in grams})) & F.col("gram").isin(sorted(set(grams))))
            newer = self._newer(spark, number)
            out = out.unionByName(rows if newer is None else rows.join(newer, F.col("id") == F.col("gone"), "left_anti"))
        return out

    def hits(self, spark: SparkSession, phrase: str) -> DataFrame:
        """``id, d, in_main, in_bg``: songs that have the phrase, and how often each of their texts has it, overlaps included."""
        grams = codes(phrase.lower()).tolist()
        if len(phrase) < MIN_CHARS or not grams:
            return spark.createDataFrame([], "id long, d long, in_main int, in_bg int")
        rows = self.postings(spark, grams)
        if self.docs > LARGE and len(set(grams)) > 1:
            counts = {r["gram"]: r["count"] for r in rows.groupBy("gram").count().collect()}
            rarest = min(set(grams), key=lambda g: counts.get(g, 0))
            if counts.get(rarest, 0) <= SMALL:
                few = rows.filter(F.col("gram") == rarest).select(F.col("id").alias("wanted"))
                rows = rows.join(F.broadcast(few), F.col("id") == F.col("wanted"), "left_semi")
        at = spark.createDataFrame([(g, i) for i, g in enumerate(grams)], "at_gram long, at int")  # as many as the phrase has characters
        shifted = rows.join(F.broadcast(at), F.col("gram") == F.col("at_gram")).select("id", "d", "field", "at", F.transform("positions", lambda p: p - F.col("at")).alias("begins"))
        per = shifted.groupBy("id").agg(F.first("d").alias("d"), F.collect_list(F.struct("field", "at", "begins")).alias("found"))

        def begins(field: int, i: Column) -> Column:
            own = F.filter("found", lambda x: (x["field"] == field) & (x["at"] == i))
            return F.flatten(F.transform(own, lambda x: x["begins"]))

        def times(field: int):
            rest = F.sequence(F.lit(1), F.lit(len(grams) - 1)) if len(grams) > 1 else F.array().cast("array<int>")
            return F.size(F.aggregate(rest, begins(field, F.lit(0)), lambda have, i: F.array_intersect(have, begins(field, i))))

        return per.select("id", "d", times(0).alias("in_main"), times(1).alias("in_bg")).filter("in_main + in_bg > 0")

    def top(self, spark: SparkSession, phrase: str, limit: int) -> list[tuple[int, float]]:
        """(id, rank) of the best ``limit`` songs by BM25, smaller is better, ties by id; one pass also counts all hits."""
        if not self.docs:
            return []
        mean = self.length / self.docs
        f = F.col("in_main") * WEIGHTS[0] + F.col("in_bg") * WEIGHTS[1]
        share = f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("d") / F.lit(mean)))
        counted = Observation()
        found = self.hits(spark, phrase).select("id", share.alias("share")).observe(counted, F.count(F.lit(1)).alias("n"))
        best = found.orderBy(F.desc("share"), F.asc("id")).limit(limit).collect()
        if not best:
            return []
        n = counted.get["n"]
        idf = math.log((self.docs - n + 0.5) / (n + 0.5))
        return [(r["id"], -(idf if idf > 0 else 1e-6) * r["share"]) for r in best]


def merge_segments(spark: SparkSession, index: TextIndex, root: str) -> Segment:
    """One segment with the valid postings of several, without looking at texts."""
    path = f"{root.rstrip('/')}/{uuid.uuid4().hex}"
    docs = rows = None
    for number, s in enumerate(index.segments):
        newer = index._newer(spark, number)
        valid = lambda df: df if newer is None else df.join(newer, F.col("id") == F.col("gone"), "left_anti")  # noqa: B023, E731
        mine = valid(spark.read.schema("id long, d long").parquet(f"{s.path}/docs"))
        docs = mine if docs is None else docs.unionByName(mine)
        if s.length and s.buckets:
            mine = valid(spark.read.schema(_SCHEMA).parquet(f"{s.path}/postings")).drop("bucket")
            rows = mine if rows is None else rows.unionByName(mine)
    docs.write.parquet(f"{path}/docs")
    r = spark.read.parquet(f"{path}/docs").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("d"), F.lit(0)).alias("total")).first()
    if not all(s.buckets for s in index.segments):
        return Segment(path, 0, r["n"], r["total"])
    files = -(-r["total"] // FOLDER_GRAMS)
    buckets = min(FOLDERS, 1 << max(0, files - 1).bit_length())
    salts = max(1 + r["n"] // FILE_ROWS, -(-files // buckets))
    if rows is not None:
        bucket = F.pmod(F.shiftright((F.col("gram") % 1_000_003) * 40_503, 4), F.lit(buckets)).cast("int")
        rows = rows.withColumn("bucket", bucket).withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(salts)))
        rows = rows.repartition(buckets * salts, "bucket", "salt").sortWithinPartitions("bucket", "gram", "id").drop("salt")
        rows.write.option("compression", "zstd").partitionBy("bucket").parquet(f"{path}/postings")
    return Segment(path, buckets, r["n"], r["total"])
