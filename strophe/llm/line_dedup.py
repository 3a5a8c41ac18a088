"""Reversible line deduplication: sharded cuckoo filters backed by exact reference-count tables.

A line's key is the line stripped of white space and lower-cased in A-Z, as a 128-bit digest. A :class:`LineIndex`
holds, as tables in the shared folder,

- references: which document holds which key, a folder for each insertion, and the documents deleted since;
- counts: for each key in how many documents it stands and the largest of these, exact;
- filters: cuckoo filters of the keys that stand in ``MIN_DOCS`` documents or more, a shard a row. A shard has a
  fixed size and takes the keys that share the leading bits of their digests; shards double when they fill up.

Inserting or deleting documents changes the counts of their keys only. A key that comes to ``MIN_DOCS`` is inserted
into its shard's filter, one that falls below is deleted from it, which cuckoo filters allow. An index is a value:
each change gives a new one and leaves the tables of the old one as they are.

Whether a line goes is decided in two steps: references pass the filter of their key's shard, a probe made of
built-in functions that drops all but one in some thousand of the keys below the threshold; what passes meets the exact
counts. Counting is pre-aggregated, the few keys that hold a large part of the references meet the counts by
broadcast, and only texts that lose a line travel.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import UPPER, in_batches, load, materialise, new_path, sieved, unused

#: Code points of a key, and documents that hold it, from which its lines are dropped.
MIN_CHARS, MIN_DOCS = 20, 3
SPACE = b" \t\n\x0b\x0c\r"
#: A shard's filter: buckets, slots of a bucket, fingerprints (0 is an empty slot), keys up to which it is filled.
BUCKETS, SLOTS, FINGERPRINTS = 1 << 12, 4, 32767
CAPACITY = BUCKETS * SLOTS * 3 // 4
#: Multiplies a fingerprint for the distance of its two buckets; rounds of displacement before a shard counts as full.
MIX, KICKS = 23497, 200
#: Shards up to which filters are broadcast (32 KiB each); keys with a larger part of the references than one in so many meet their counts by broadcast.
BROADCAST_SHARDS, HOT_SHARE = 1024, 1024
#: Copies of the filters among which references are dealt where they are shuffled.
SALT = 64


def digests(text: bytes, chars: int = MIN_CHARS) -> list[bytes | None]:
    """The key of each line; None for lines with fewer code points."""
    out = []
    for line in text.lower().split(b"\n"):
        key = line.strip(SPACE)
        long = len(key) >= 4 * chars or (len(key) >= chars and len(key.decode("utf-8", "replace")) >= chars)
        out.append(xxhash.xxh3_128_digest(key) if long else None)
    return out


def _reference_batches(chars):
    def run(batches):
        for b in batches:
            rows, keys = [], []
            for r, text in enumerate(b.column("text").cast(pa.binary())):
                mine = set(digests(text.as_py() or b"", chars)) - {None}
                rows += [r] * len(mine)
                keys += mine
            halves = np.frombuffer(b"".join(keys), ">i8").astype(np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(rows, pa.int32())), pa.array(halves[:, 0]), pa.array(halves[:, 1])], names=["doc_id", "hi", "lo"])

    return run


def references(docs: DataFrame, chars: int = MIN_CHARS) -> DataFrame:
    """``doc_id, hi, lo`` of each document and key; rows that share a doc_id are one document."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    refs = in_batches(docs.select("doc_id", "text")).mapInArrow(_reference_batches(chars), f"doc_id {kind}, hi long, lo long")
    single = docs.groupBy("doc_id").count().filter("count > 1").isEmpty()
    return refs if single else refs.distinct()


# The filter of a shard, in numpy; the probe, in Spark's functions


def places(hi: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First bucket and fingerprint of each key."""
    return hi & (BUCKETS - 1), (lo & 0x7FFFFFFF) % FINGERPRINTS + 1


def other(bucket: np.ndarray, fp: np.ndarray) -> np.ndarray:
    return bucket ^ (fp * MIX & (BUCKETS - 1))


def put(table: np.ndarray, hi: np.ndarray, lo: np.ndarray) -> bool:
    """Insert keys into ``table`` (buckets by slots), all together; False if they don't fit, which spoils the table.

    What finds its bucket full tries the other one. Then one key of each full bucket takes a slot there, and what
    held the slot goes to its own other bucket.
    """
    rng = np.random.default_rng(len(hi))
    at, fp = places(hi, lo)
    for turn in range(KICKS):
        order = np.argsort(at, kind="stable")
        at, fp = at[order], fp[order]
        rank = np.arange(len(at)) - np.searchsorted(at, at)
        full = table[at] != 0
        fits = rank < SLOTS - full.sum(1)
        free = np.argsort(full[fits], axis=1, kind="stable")  # empty slots first
        table[at[fits], free[np.arange(len(free)), rank[fits]]] = fp[fits]
        at, fp = at[~fits], fp[~fits]
        if not len(at):
            return True
        if turn:
            one = np.unique(at, return_index=True)[1]
            slot = rng.integers(0, SLOTS, len(one))
            held = table[at[one], slot].astype(fp.dtype)
            table[at[one], slot] = fp[one]
            fp[one] = held
        at = other(at, fp)
    return False


def take(table: np.ndarray, hi: np.ndarray, lo: np.ndarray) -> None:
    """Delete keys that are in the table: of each, one slot that holds its fingerprint."""
    for bucket, fp in zip(*(x.tolist() for x in places(hi, lo)), strict=True):
        for b in (bucket, int(other(np.int64(bucket), np.int64(fp)))):
            held = np.flatnonzero(table[b] == fp)
            if len(held):
                table[b, held[0]] = 0
                break
        else:
            raise ValueError("a key that isn't in the filter")


def probe() -> Column:
    """Whether the filter ``slots`` may hold the key ``hi, lo``; never false for one that it holds."""
    fp = F.col("lo").bitwiseAND(F.lit(0x7FFFFFFF)) % FINGERPRINTS + 1
    first = F.col("hi").bitwiseAND(F.lit(BUCKETS - 1))
    hit = F.lit(False)
    for bucket in (first, first.bitwiseXOR((fp * MIX).bitwiseAND(F.lit(BUCKETS - 1)))):
        for slot in range(SLOTS):
            hit = hit | (F.get("slots", (bucket * SLOTS + slot).cast("int")) == fp)
    return hit


def shard_of(bits: int) -> Column:
    return F.shiftrightunsigned("hi", 64 - bits).cast("int") if bits else F.lit(0)


_FILTERS = "shard int, n int, slots array<smallint>"


def _row(shard: int, n: int, table: np.ndarray, ok: bool) -> pd.DataFrame:
    return pd.DataFrame({"shard": [shard], "n": [n], "slots": [table.ravel().tolist() if ok else None]})


def _filled(key: tuple, keys: pd.DataFrame) -> pd.DataFrame:
    table = np.zeros((BUCKETS, SLOTS), np.int16)
    return _row(key[0], len(keys), table, len(keys) <= BUCKETS * SLOTS and put(table, keys["hi"].to_numpy(), keys["lo"].to_numpy()))


def _changed(key: tuple, old: pd.DataFrame, change: pd.DataFrame) -> pd.DataFrame:
    table, n = np.zeros((BUCKETS, SLOTS), np.int16), 0
    if len(old):
        table, n = np.array(old["slots"].iloc[0], np.int16).reshape(BUCKETS, SLOTS), int(old["n"].iloc[0])
    up = change["up"].to_numpy(bool)
    hi, lo = change["hi"].to_numpy(), change["lo"].to_numpy()
    take(table, hi[~up], lo[~up])
    n += int(up.sum()) - int((~up).sum())
    return _row(key[0], n, table, n <= BUCKETS * SLOTS and put(table, hi[up], lo[up]))


def _written(df: DataFrame, label: str) -> str:
    """The folder of a table that is written to the shared folder."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return path


class LineIndex(NamedTuple):
    """Folders of an index's tables: references by insertion, deleted documents with the number of insertions before, counts, filters."""

    refs: tuple[str, ...] = ()
    gone: tuple[tuple[int, str], ...] = ()
    counts: str | None = None
    filters: str | None = None
    bits: int = 0
    chars: int = MIN_CHARS
    docs: int = MIN_DOCS

    def references(self, spark: SparkSession) -> DataFrame | None:
        """``doc_id, hi, lo`` of the documents that are in the index; None if there never were any."""
        out = None
        for number, folder in enumerate(self.refs):
            rows = spark.read.parquet(folder)
            for before, ids in self.gone:
                if before > number:
                    lost = spark.read.parquet(ids).withColumnRenamed("doc_id", "lost_id")
                    rows = rows.join(lost, F.col("doc_id").eqNullSafe(F.col("lost_id")), "left_anti")
            out = rows if out is None else out.unionByName(rows)
        return out

    def insert(self, docs: DataFrame) -> LineIndex:
        """With the documents of ``doc_id, text`` rows. A document that is there already gets the keys it lacks."""
        spark = docs.sparkSession
        new = references(docs, self.chars)
        held = self.references(spark)
        if held is not None:
            same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ("doc_id", "hi", "lo")]
            new = new.alias("a").join(held.alias("b"), same, "left_anti")
        folder = _written(new, "line-refs")
        new = spark.read.parquet(folder)
        delta = new.groupBy("hi", "lo").agg(F.count(F.lit(1)).alias("d"), F.max("doc_id").alias("last"))
        if self.counts is None:
            changed = delta.select("hi", "lo", F.lit(0).cast("long").alias("was"), F.col("d").alias("n_docs"), "last")
        else:
            old = spark.read.parquet(self.counts).select("hi", "lo", "n_docs", F.col("last").alias("old_last"))
            was = F.coalesce("n_docs", F.lit(0).cast("long"))
            changed = delta.join(old, ["hi", "lo"], "left").select("hi", "lo", was.alias("was"), (was + F.col("d")).alias("n_docs"), F.greatest("last", "old_last").alias("last"))
        return self._replace(refs=(*self.refs, folder))._apply(spark, changed)

    def delete(self, ids: DataFrame) -> LineIndex:
        """Without the documents of the ``doc_id`` rows; ids that the index doesn't have change nothing."""
        spark, held = ids.sparkSession, self.references(ids.sparkSession)
        if held is None:
            return self
        folder = _written(ids.select("doc_id").distinct(), "line-gone")
        lost = spark.read.parquet(folder).withColumnRenamed("doc_id", "lost_id")
        dead = materialise(held.join(lost, F.col("doc_id").eqNullSafe(F.col("lost_id")), "left_semi"), "line-dead")
        out = self._replace(gone=(*self.gone, (len(self.refs), folder)))
        delta = dead.groupBy("hi", "lo").agg(F.count(F.lit(1)).alias("d"), F.max("doc_id").alias("dead_last"))
        less = materialise(
            spark.read.parquet(self.counts).join(delta, ["hi", "lo"])
            .select("hi", "lo", F.col("n_docs").alias("was"), (F.col("n_docs") - F.col("d")).alias("n_docs"), "last", F.col("last").eqNullSafe(F.col("dead_last")).alias("headless")),
            "line-less",
        )
        # A key whose largest document went looks for the next among the references that are left.
        orphans = less.filter("headless and n_docs > 0").select("hi", "lo")
        heads = out.references(spark).join(orphans, ["hi", "lo"], "left_semi").groupBy("hi", "lo").agg(F.max("doc_id").alias("head"))
        changed = less.join(heads, ["hi", "lo"], "left").select("hi", "lo", "was", "n_docs", F.when(F.col("headless"), F.col("head")).otherwise(F.col("last")).alias("last"))
        return out._apply(spark, changed)

    def _apply(self, spark: SparkSession, changed: DataFrame) -> LineIndex:
        """With the counts of the changed keys in place of the old ones, and filters that follow."""
        counts = _written(changed, "line-changes")
        changed = spark.read.parquet(counts)
        if self.counts is not None:
            kept = spark.read.parquet(self.counts).join(changed.select("hi", "lo"), ["hi", "lo"], "left_anti")
            counts = _written(kept.unionByName(changed.filter("n_docs > 0")), "line-counts")
        crossed = changed.withColumn("up", F.col("n_docs") >= self.docs).filter(F.col("up") != (F.col("was") >= self.docs)).select("hi", "lo", "up")
        return self._replace(counts=counts)._refilter(spark, materialise(crossed, "line-crossed"))

    def _refilter(self, spark: SparkSession, crossed: DataFrame) -> LineIndex:
        old = spark.read.schema(_FILTERS).parquet(self.filters) if self.filters else None
        held = (old.agg(F.sum("n")).first()[0] or 0) if old is not None else 0
        r = crossed.agg(F.count_if("up").alias("up"), F.count_if(~F.col("up")).alias("down")).first()
        bits = self.bits
        while held + r["up"] - r["down"] > CAPACITY << bits:
            bits += 1
        if old is not None and bits == self.bits:
            here = crossed.withColumn("shard", shard_of(bits))
            path = _written(old.groupBy("shard").cogroup(here.groupBy("shard")).applyInPandas(_changed, _FILTERS), "line-filters")
            if spark.read.schema(_FILTERS).parquet(path).filter("slots is null").isEmpty():
                return self._replace(filters=path)
            bits += 1
        while True:  # made anew from the counts, with more shards if one is overfull
            repeated = spark.read.parquet(self.counts).filter(F.col("n_docs") >= self.docs).select("hi", "lo", shard_of(bits).alias("shard"))
            path = _written(repeated.groupBy("shard").applyInPandas(_filled, _FILTERS), "line-filters")
            if spark.read.schema(_FILTERS).parquet(path).filter("slots is null").isEmpty():
                return self._replace(filters=path, bits=bits)
            bits += 1

    def passing(self, refs: DataFrame) -> DataFrame:
        """The references whose keys pass the filter of their shard."""
        spark, shard = refs.sparkSession, shard_of(self.bits)
        filters = spark.read.schema(_FILTERS).parquet(self.filters).select("shard", "slots")
        if 1 << self.bits <= BROADCAST_SHARDS:
            met = refs.withColumn("shard", shard).join(F.broadcast(filters), "shard")
        else:  # a hot key's shard is dealt out by document
            copies = filters.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
            met = refs.withColumn("shard", shard).withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALT)).cast("int")).join(copies.hint("merge"), ["shard", "salt"])
        return met.filter(probe()).select("doc_id", "hi", "lo")

    def dropped(self, refs: DataFrame) -> DataFrame:
        """The references whose lines go: the key stands in enough documents, of which this is not the largest."""
        near = materialise(self.passing(refs), "line-candidates")
        exact = refs.sparkSession.read.parquet(self.counts).filter(F.col("n_docs") >= self.docs).select("hi", "lo", "n_docs", "last")
        hot = F.col("n_docs") * HOT_SHARE > near.count()  # so there are less than HOT_SHARE of them
        tagged = near.join(F.broadcast(exact.filter(hot).select("hi", "lo", F.lit(True).alias("hot"), F.col("last").alias("hot_last"))), ["hi", "lo"], "left")
        loses = lambda last: ~F.col("doc_id").eqNullSafe(F.col(last))
        cold = tagged.filter("hot is null").select("doc_id", "hi", "lo").join(exact.filter(~hot).select("hi", "lo", "last").hint("merge"), ["hi", "lo"])
        return tagged.filter("hot").filter(loses("hot_last")).select("doc_id", "hi", "lo").unionByName(cold.filter(loses("last")).select("doc_id", "hi", "lo"))

    def cut(self, docs: DataFrame) -> DataFrame:
        """The rows and columns of ``docs``, whose documents are in the index, with ``text`` cut, and ``n_lines, n_dropped``.

        If the input has columns of these names, the new ones, which are the last, are ``n_lines_, n_dropped_``.
        """
        spark = docs.sparkSession
        h, lists, lost_id, n_lines, n_dropped, out = unused(docs, "h", "lists", "lost_id", "n_lines", "n_dropped", "out")
        refs = self.references(spark)
        text = F.coalesce("text", F.lit(""))
        lines = (F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long")
        hashed = docs.withColumn(n_lines, lines).withColumn(h, F.xxhash64("doc_id"))
        kept = [F.col(f"`{c}`") for c in (*docs.columns, n_lines)]
        if refs is None:
            return hashed.select(*kept, F.lit(0).cast("long").alias(n_dropped))
        gone = self.dropped(refs).groupBy("doc_id").agg(F.collect_list(F.struct("hi", "lo")).alias(lists))
        gone = materialise(gone.select(F.xxhash64("doc_id").alias(h), F.col("doc_id").alias(lost_id), lists), "line-drops")
        keys = gone.select(h)
        met = sieved(hashed, h, keys).join(gone.drop(h), F.col("doc_id").eqNullSafe(F.col(lost_id)), "left")
        met = met.withColumn(out, F.pandas_udf(_cut_with(self.chars), "text string, n long")("text", f"{lists}.hi", f"{lists}.lo"))
        text_or = [F.col(f"`{out}`.text").alias(c) if c == "text" else F.col(f"`{c}`") for c in (*docs.columns, n_lines)]
        rest = sieved(hashed, h, keys, hit=False).select(*kept, F.lit(0).cast("long").alias(n_dropped))
        return met.select(*text_or, F.col(f"`{out}`.n").alias(n_dropped)).unionByName(rest)


def _cut_with(chars):
    def run(text: pd.Series, hi: pd.Series, lo: pd.Series) -> pd.DataFrame:
        texts, counts = [], []
        for t, a, b in zip(text, hi, lo, strict=True):
            n = 0
            if t and a is not None and len(a):
                gone = set(np.stack([a, b], 1).astype(">i8").tobytes()[i : i + 16] for i in range(0, 16 * len(a), 16))
                lines = t.split("\n")
                keys = digests(t.encode("utf-8", "surrogatepass"), chars)
                kept = [x for x, k in zip(lines, keys, strict=True) if k not in gone]
                n, t = len(lines) - len(kept), "\n".join(kept)
            texts.append(t)
            counts.append(n)
        return pd.DataFrame({"text": texts, "n": counts})

    run.__annotations__ = {"text": pd.Series, "hi": pd.Series, "lo": pd.Series, "return": pd.DataFrame}
    return run


def dedup_lines(docs: DataFrame, chars: int = MIN_CHARS, least: int = MIN_DOCS) -> DataFrame:
    """The rows and columns of ``docs`` with ``text`` cut, and ``n_lines, n_dropped`` (see :meth:`LineIndex.cut`).

    Lines whose key has ``chars`` code points and stands in ``least`` documents stay in the largest doc_id that holds
    it alone, there all of them. A null text is one empty line and stays null. Rows that share a doc_id, null
    ones too, are one document; a null doc_id is smaller than any other. An empty table gives an empty result.
    """
    return LineIndex(chars=chars, docs=least).insert(docs).cut(docs)


def op12_line_dedup(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


_TRIM = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
OP12_SQL = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS MATERIALIZED (
  SELECT r, doc_id, i, line, translate(trim(line, {_TRIM}), '{UPPER}', '{UPPER.lower()}') AS key
  FROM (SELECT r, doc_id, unnest(lines) AS line, unnest(range(1, len(lines) + 1)) AS i FROM d)
),
k AS (
  SELECT key, max(doc_id) AS last FROM l WHERE length(key) >= {MIN_CHARS} GROUP BY key
  HAVING count(DISTINCT doc_id) + CASE WHEN count(*) > count(doc_id) THEN 1 ELSE 0 END >= {MIN_DOCS}
),
x AS (SELECT l.*, k.key IS NOT NULL AND l.doc_id IS DISTINCT FROM last AS gone FROM l LEFT JOIN k ON k.key = l.key)
SELECT min(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM x GROUP BY r
"""
