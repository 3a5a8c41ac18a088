"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most bytes of an Arrow batch that goes to Python; a longer row is a batch of its own.
BATCH_BYTES = 4 << 20
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Bits of a sieve: 16 a key, but at least the first and at most the second power of two (a bitmap of 16 MiB).
SIEVE_BITS = (16, 27)


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local session that names none writes below its warehouse."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/checkpoints"
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/strophe/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write to the shared folder and read again: the lineage ends in files that outlive an executor.

    The files stay as long as the folder: what is returned to a caller still reads them.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def in_batches(df: DataFrame) -> DataFrame:
    """The frame, with Arrow batches for Python held to BATCH_BYTES, however long the texts are.

    This sets the session's ``spark.sql.execution.arrow.maxBytesPerBatch``, which is read when a query runs,
    after this function has returned; so it stays set.
    """
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, lengthened where the frame has a column of that name in any case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def sieved(df: DataFrame, h: str, keys: DataFrame, hit: bool = True) -> DataFrame:
    """Rows whose long column ``h`` shares its leading bits with a key (or, with hit=False, the other rows).

    ``keys`` has one long column. No row that equals a key is missed; about one other row in 16 passes too,
    more beyond 2**23 keys, for the bitmap that is broadcast has a bound.
    """
    (key,) = keys.columns
    width = min(SIEVE_BITS[1], max(SIEVE_BITS[0], keys.count().bit_length() + 4))
    block, bits, bit = unused(df, "block", "bits", "bit")
    bitmap = (
        keys.select(F.shiftrightunsigned(key, 64 - width).alias("at"))
        .groupBy(F.shiftright("at", 15).alias(block))
        .agg(F.bitmap_construct_agg(F.col("at").bitwiseAND(F.lit(32767))).alias(bits))
    )
    found = df.withColumn(bit, F.shiftrightunsigned(h, 64 - width)).join(F.broadcast(bitmap), F.shiftright(bit, 15) == F.col(block), "inner" if hit else "left")
    byte = f"cast(conv(hex(substring(`{bits}`, cast(shiftright(`{bit}` & 32767, 3) as int) + 1, 1)), 16, 10) as int)"
    passes = F.coalesce(F.expr(f"shiftright({byte}, cast(`{bit}` & 7 as int)) & 1 = 1"), F.lit(False))
    return found.filter(passes if hit else ~passes).drop(block, bits, bit)


def without(df: DataFrame, h: str, keys: DataFrame, same) -> DataFrame:
    """Rows of ``df`` that have no partner in ``keys``; only rows the sieve passes are shuffled.

    ``h`` is a long column of both; ``same(df, keys)`` is the join condition, which one key at most meets. An
    anti join would be planned below the sieve, which would shuffle every row, so an outer one is filtered.
    """
    (met,) = unused(df, "met")
    near = sieved(df, h, keys.select(h))
    marked = keys.withColumn(met, F.lit(True))
    lone = near.join(marked, same(near, marked), "left").filter(F.col(met).isNull()).select(*[near[c] for c in df.columns])
    return sieved(df, h, keys.select(h), hit=False).unionByName(lone)
