"""Exact deduplication with an extendible-hash index kept in shared files.

1. Each row gets a 64-bit hash and a SHA-256 of its normalised text; these narrow keys are written once.
2. The distinct hashes, pre-aggregated before their shuffle, fill a directory that starts with one bucket and
   doubles: a bucket with over ``capacity`` hashes splits by the next bit, as deep as it takes. The directory is
   a table of (depth, prefix) in the shared folder; only whether buckets are overfull reaches the driver.
3. Texts whose hash occurs once are entries by their key. The others are compared as bytes: their texts are
   pre-aggregated before a shuffle, and different texts behind one hash form a chain in its bucket. Owner
   tasks take ranges of buckets and write the entries, which carry the row that stays and the group's size.
4. Every row is looked up: the directory gives its bucket, the bucket's entry for its hash and digest gives
   the answer. Rows behind a digest that two texts of a chain share are looked up by their bytes.

Everything is DataFrame expressions. No text leaves its scan task unless its hash occurs twice or passes the
sieve for such hashes.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import UPPER, load, materialise, new_path, shuffle_width, sieved, unused, without

#: Distinct hashes in a bucket before it splits.
CAPACITY = 1 << 16
#: Bits by which overfull buckets are counted at a time.
STEP = 10
#: Rows of the directory up to which it is broadcast (16 bytes each).
BROADCAST_ROWS = 1 << 18


class Index(NamedTuple):
    """Folders of the index: ``keys`` of the rows, the ``directory``, and the ``buckets`` with their entries."""

    path: str

    def read(self, spark: SparkSession, part: str) -> DataFrame:
        return spark.read.parquet(f"{self.path}/{part}")


def normalised(text: str = "text"):
    return F.translate(F.coalesce(F.col(text), F.lit("")), UPPER, UPPER.lower())


def _prefix(h, depth):
    """The first ``depth`` bits of the hash."""
    return F.when(depth == 0, F.lit(0).cast("long")).otherwise(F.expr(f"shiftrightunsigned({h}, cast(64 - depth as int))"))


def directory(hashes: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``depth, prefix`` of each bucket over the distinct hashes ``h``; together they cover every hash in it once.

    A pass counts hashes by the next STEP bits of overfull buckets. The buckets are the shortest prefixes
    that hold no more than ``capacity``, so each but the first is half of one that was overfull.
    """
    base, out = 0, None
    inside = hashes.select("h")
    while True:
        top = min(64, base + STEP)
        cells = inside.groupBy(F.shiftrightunsigned("h", 64 - top).alias("cell")).agg(F.count(F.lit(1)).alias("n"))
        depths = F.explode(F.sequence(F.lit(base), F.lit(top))).alias("depth")
        up = F.expr(f"shiftrightunsigned(cell, cast({top} - depth as int))")
        sums = materialise(cells.select("cell", "n", depths).groupBy("depth", up.alias("prefix")).agg(F.sum("n").alias("n")), "directory-sums")
        over = sums.filter(F.col("n") > capacity)
        halves = over.filter(F.col("depth") < top).select((F.col("depth") + 1).alias("depth"), F.explode(F.array(F.shiftleft("prefix", 1), F.shiftleft("prefix", 1).bitwiseOR(F.lit(1)))).alias("prefix"))
        found = sums.filter(F.col("n") <= capacity).join(halves, ["depth", "prefix"], "left_semi")
        if base == 0:
            found = found.unionByName(sums.filter((F.col("depth") == 0) & (F.col("n") <= capacity)))
        found = found.select("depth", "prefix")
        out = found if out is None else out.unionByName(found)
        rest = over.filter(F.col("depth") == top).select(F.col("prefix").alias("full"))
        if top == 64 or rest.isEmpty():
            return out
        inside = inside.join(rest, F.shiftrightunsigned("h", 64 - top) == F.col("full"), "left_semi")
        base = top


def placed(rows: DataFrame, cells: DataFrame, h: str = "h") -> DataFrame:
    """The rows with ``depth`` and ``prefix`` of their hash's bucket."""
    depths = [r["depth"] for r in cells.select("depth").distinct().collect()]  # at most 65
    if not depths:
        return rows.withColumn("depth", F.lit(0)).withColumn("prefix", F.lit(0).cast("long"))
    cells = F.broadcast(cells) if cells.count() <= BROADCAST_ROWS else cells
    options = rows.withColumn("depth", F.explode(F.lit(depths))).withColumn("prefix", _prefix(h, F.col("depth")))
    return options.join(cells, ["depth", "prefix"], "left_semi")


def build_index(docs: DataFrame, capacity: int = CAPACITY) -> Index:
    """Write the index of ``doc_id, text`` rows to the shared folder."""
    spark, index = docs.sparkSession, Index(new_path(docs.sparkSession, "index"))
    sha = F.unhex(F.sha2("t", 256)).alias("sha")
    texts = docs.select("doc_id", normalised().alias("t")).withColumn("h", F.xxhash64("t"))
    texts.select("doc_id", "h", sha).write.parquet(f"{index.path}/keys")
    entries = materialise(
        index.read(spark, "keys").groupBy("h").agg(F.count(F.lit(1)).alias("n_rows"), F.max("doc_id").alias("keep_id"), F.first("sha").alias("sha")), "entries"
    )
    directory(entries.select("h"), capacity).write.parquet(f"{index.path}/directory")

    single = entries.filter("n_rows = 1").select("h", "sha", F.lit(1).cast("long").alias("chain"), F.lit(None).cast("string").alias("t"), "keep_id", "n_rows")
    repeated = entries.filter("n_rows > 1").select("h")
    equal = (
        sieved(texts, "h", repeated).select("doc_id", "h", "t", sha)
        .groupBy("h", "sha", "t").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n_rows"))
    )
    behind, digest = Window.partitionBy("h"), Window.partitionBy("h", "sha")
    chains = (
        equal.withColumn("all_rows", F.sum("n_rows").over(behind)).withColumn("chain", F.count(F.lit(1)).over(digest)).filter("all_rows > 1")
        .select("h", "sha", "chain", F.when(F.col("chain") > 1, F.col("t")).alias("t"), "keep_id", "n_rows")
    )
    filled = placed(single.unionByName(chains), index.read(spark, "directory"))
    low = F.when(F.col("depth") == 0, F.lit(0).cast("long")).otherwise(F.expr("shiftleft(prefix, cast(64 - depth as int))"))
    (
        filled.withColumn("low", low).repartitionByRange(shuffle_width(spark), "low", "h").sortWithinPartitions("low", "h", "sha").drop("low")
        .write.parquet(f"{index.path}/buckets")
    )
    return index


def lookup(docs: DataFrame, index: Index) -> DataFrame:
    """What the index says of the rows it was built of: ``doc_id, keep_id, group_size, kept, text_sha256``."""
    spark = docs.sparkSession
    keys, cells, buckets = (index.read(spark, part) for part in ("keys", "directory", "buckets"))
    key = ["depth", "prefix", "h", "sha"]
    rows = placed(keys, cells)
    plain = buckets.filter("chain = 1").select(*key, "keep_id", "n_rows")
    chained = buckets.filter("chain > 1")
    if chained.isEmpty():
        found = rows.join(plain.hint("merge"), key, "left")
    else:
        found = rows.join(chained.select(*key).distinct(), key, "left_anti").join(plain.hint("merge"), key, "left")
        texts = docs.select("doc_id", normalised().alias("t")).withColumn("h", F.xxhash64("t"))
        near = sieved(texts, "h", chained.select("h").distinct()).withColumn("sha", F.unhex(F.sha2("t", 256)))
        found = found.unionByName(placed(near, cells).join(chained.select(*key, "t", "keep_id", "n_rows"), [*key, "t"]).drop("t"))
    return found.select(
        "doc_id", "keep_id", F.col("n_rows").alias("group_size"), F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256")
    )


def dedup(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when identical after lower-casing A-Z; null counts as empty. The largest doc_id of
    equal texts is kept. Other columns of the input are ignored, an empty table gives an empty result.
    A null doc_id loses against any other; a group of null doc_ids only has a null ``keep_id`` and keeps
    its rows. Rows that repeat a doc_id together with its text are one document: they count in
    ``group_size`` and share ``kept``.
    """
    return lookup(docs, build_index(docs, capacity))


def keep_last(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The input's rows that stay, in its columns; of rows that repeat doc_id and text one stays."""
    h, sha, lost_id, lost_sha = unused(docs, "h", "sha", "lost_id", "lost_sha")
    seen = materialise(dedup(docs, capacity).select("doc_id", "kept", "group_size", F.unhex("text_sha256").alias("sha")), "exact-duplicates")
    hashed = docs.withColumn(sha, F.unhex(F.sha2(normalised(), 256))).withColumn(h, F.xxhash64(sha))
    lost = seen.filter(~F.col("kept")).select(F.xxhash64("sha").alias(h), F.col("doc_id").alias(lost_id), F.col("sha").alias(lost_sha)).distinct()
    same = lambda a, b: (a[h] == b[h]) & (F.col(sha) == F.col(lost_sha)) & F.col("doc_id").eqNullSafe(F.col(lost_id))
    out = without(hashed, h, materialise(lost, "lost-copies"), same)
    again = seen.filter("kept and group_size > 1").groupBy("doc_id", "sha").count().filter("count > 1").select(F.xxhash64("sha").alias(h)).distinct()
    again = materialise(again, "repeated-rows")
    if not again.isEmpty():
        out = sieved(out, h, again, hit=False).unionByName(sieved(out, h, again).dropDuplicates(["doc_id", sha]))
    return out.drop(h, sha)


def op9_exact_dedup(spark, sf_dir):
    return dedup(load(spark, sf_dir, "documents"))


OP9_SQL = f"""
WITH t AS (
  SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}') AS t FROM documents
)
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY t) AS keep_id,
       count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept,
       sha256(t) AS text_sha256
FROM t
"""
