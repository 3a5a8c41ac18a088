import hashlib
import random
from collections import Counter, defaultdict

import pytest
from data import SCHEMA, lower_az, rows, table
from pyspark.sql import functions as F

from strophe.llm import exact_dedup
from strophe.llm.exact_dedup import OP9_SQL, build_index, dedup, directory, keep_last, lookup, placed


def brute(data):
    groups = defaultdict(list)
    for i, t, _ in data:
        groups[lower_az(t)].append(i)
    out = Counter()
    for i, t, _ in data:
        ids = groups[lower_az(t)]
        keep = max((x for x in ids if x is not None), default=None) if len(ids) > 1 else i
        out[i, keep, len(ids), i == keep, hashlib.sha256(lower_az(t).encode()).hexdigest()] += 1
    return out


def got(df):
    return Counter((r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in df.collect())


def test_against_brute_force(spark):
    assert got(dedup(table(spark))) == brute(rows())


@pytest.mark.parametrize("capacity", [1, 3])
def test_tiny_buckets(spark, capacity):
    assert got(dedup(table(spark), capacity=capacity)) == brute(rows())


def brute_directory(hashes, capacity):
    out, todo = set(), [(0, 0, list(hashes))]
    while todo:
        depth, prefix, own = todo.pop()
        if len(own) <= capacity:
            out.add((depth, prefix))
            continue
        for bit in (0, 1):
            half = [h for h in own if h >> (63 - depth) & 1 == bit]
            todo.append((depth + 1, 2 * prefix + bit, half))
    return {(d, p) for d, p in out if any(h >> (64 - d) == p for h in hashes)}


@pytest.mark.parametrize("capacity", [1, 4, 1000])
def test_directory_doubles(spark, capacity):
    """Buckets split until none is overfull, far below the first pass's bits where hashes share them."""
    rng = random.Random(1)
    hashes = {rng.getrandbits(64) for _ in range(200)} | {0xABCDEF0123456789 ^ x for x in range(12)} | {5, 4, 1 << 63}
    df = spark.createDataFrame([(h - (1 << 64) if h >> 63 else h,) for h in hashes], "h long")
    found = {(r["depth"], r["prefix"] % (1 << 64)) for r in directory(df, capacity).collect()}
    assert found == brute_directory(hashes, capacity)


def test_every_hash_has_one_bucket(spark):
    index = build_index(table(spark), capacity=3)
    keys, cells, buckets = (index.read(spark, p) for p in ("keys", "directory", "buckets"))
    assert placed(keys, cells).count() == keys.count() == len(rows()) and buckets.count() == len({lower_az(t) for _, t, _ in rows()})
    assert max(r["count"] for r in buckets.groupBy("depth", "prefix").count().collect()) <= 3


def test_bucket_files_decide(spark):
    """What a bucket file says is the answer: a changed entry and a lost entry show."""
    df = table(spark)
    index = build_index(df, capacity=3)
    h = df.filter("doc_id = 100").select(F.xxhash64(exact_dedup.normalised())).first()[0]
    damaged = index.read(spark, "buckets").withColumn("keep_id", F.when(F.col("h") == h, F.lit(77)).otherwise(F.col("keep_id"))).filter("n_rows <> 2 or h = " + str(h)).collect()
    schema = index.read(spark, "buckets").schema
    spark.createDataFrame(damaged, schema).write.mode("overwrite").parquet(f"{index.path}/buckets")
    out = lookup(df, index).collect()
    assert {r["keep_id"] for r in out if r["doc_id"] in (0, 100)} == {77} and any(r["group_size"] is None for r in out) and len(out) == len(rows())


def test_hot_text(spark):
    """A text that a third of the rows share is one entry before anything is shuffled."""
    docs = spark.range(30_000).selectExpr("id AS doc_id", "if(id % 3 = 0, 'The SAME text', concat('text ', id)) AS text")
    out = dedup(docs)
    assert out.filter("group_size = 10000 and keep_id = 29997").count() == 10_000 and out.filter("kept").count() == 20_001


def test_colliding_hashes_chain(spark, monkeypatch):
    """With a hash that everything shares, and a digest that two texts share, bytes still decide."""
    monkeypatch.setattr(F, "xxhash64", lambda *c: F.lit(7).cast("long"))
    real = F.sha2
    monkeypatch.setattr(F, "sha2", lambda c, n: F.when(F.col(c) == "word", real(F.lit("one two three"), n)).otherwise(real(c, n)))
    data = rows()
    want = brute(data)
    fake = hashlib.sha256(b"one two three").hexdigest()
    want = Counter({(i, k, n, kept, fake if s == hashlib.sha256(b"word").hexdigest() else s): c for (i, k, n, kept, s), c in want.items()})
    assert got(dedup(table(spark))) == want


def test_empty_and_columns(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert dedup(empty).collect() == [] and keep_last(empty).columns == empty.columns


def test_keep_last(spark):
    data = rows()
    kept = keep_last(table(spark)).select("doc_id", "text").collect()
    texts = Counter(lower_az(r["text"]) for r in kept)
    assert set(texts) == {lower_az(t) for _, t, _ in data} and max(texts.values()) == 1
    assert kept is not None and exact_dedup.CAPACITY > 1


def test_sql(spark, tmp_path):
    import duckdb

    data = [(i, t, g) for i, t, g in rows() if i is not None]
    documents = table(spark, data).select("doc_id", "text").toPandas()  # noqa: F841
    con = duckdb.connect()
    con.register("documents", documents)
    want = Counter(con.execute(f"SELECT doc_id, keep_id, group_size, kept, text_sha256 FROM ({OP9_SQL})").fetchall())
    assert got(dedup(table(spark, data))) == want
