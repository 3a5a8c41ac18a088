import random
import zlib
from collections import defaultdict

import pytest
from data import SCHEMA, rows, table
from hypothesis import given, settings
from hypothesis import strategies as st

from strophe.llm import sharding
from strophe.llm.sharding import shard, smallest_capacity


def brute_capacity(sizes, shards):
    """Least over all contiguous partitions of the largest part, by dynamic programming."""
    best = [0] + [float("inf")] * len(sizes)
    for _ in range(shards):
        new = best[:]
        for i in range(1, len(sizes) + 1):
            total = 0
            for j in range(i, 0, -1):
                total += sizes[j - 1]
                new[i] = min(new[i], max(best[j - 1], total))
        best = new
    return best[-1]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=14), st.integers(1, 5))
def test_smallest_capacity(sizes, shards):
    capacity, cuts = smallest_capacity(sizes, shards)
    assert capacity == (brute_capacity(sizes, shards) if sizes else 0) and len(cuts) <= shards


def check(spark, data, shards):
    got = shard(table(spark, data), shards).collect()
    assert len(got) == len(data)
    by_text, used = defaultdict(set), defaultdict(list)
    texts = defaultdict(list)
    for i, t, _ in data:
        texts[i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())].append(t)
    load = defaultdict(int)
    for r in got:
        t = texts[r["doc_id"], r["size"], r["text_crc32"]].pop()
        by_text[t].add(r["shard"])
        used[r["shard"]].append(r["slot"])
        load[r["shard"]] += r["size"]
        assert r["law"] == "bytes" and r["grown_shard"] is None and 0 <= r["shard"] < shards
    assert all(len(s) == 1 for s in by_text.values())
    assert all(sorted(s) == list(range(len(s))) for s in used.values())
    return load, got


def order(spark, data):
    from pyspark.sql import functions as F

    sizes = defaultdict(int)
    for r in table(spark, data).select(F.xxhash64("text").alias("p"), "text").collect():
        sizes[r["p"] % (1 << 64)] += len((r["text"] or "").encode()) + 8
    return [sizes[p] for p in sorted(sizes)]


@pytest.mark.parametrize(("first", "more"), [(14, 8), (1, 1), (2, 5)])
def test_minimax(spark, monkeypatch, first, more):
    """The refined histogram gives the same capacity as a search over all groups, however coarse it begins."""
    monkeypatch.setattr(sharding, "FIRST_BITS", first)
    monkeypatch.setattr(sharding, "MORE_BITS", more)
    rng = random.Random(first)
    data = rows() + [(1000 + i, "w" * rng.randint(0, 400) + str(rng.randint(0, 150)), "en") for i in range(300)]
    load, _ = check(spark, data, 7)
    assert max(load.values()) == smallest_capacity(order(spark, data), 7)[0]


def test_hot_group(spark):
    data = [(i, "same text", "en") for i in range(200)] + [(200 + i, f"text {i}", "en") for i in range(400)]
    load, _ = check(spark, data, 24)
    assert max(load.values()) >= 200 * 17


def test_few_rows(spark):
    check(spark, [(1, None, None), (2, "", "en"), (3, "a", "en"), (3, "a", "en")], 24)
    assert shard(spark.createDataFrame([], SCHEMA)).collect() == []


LAWS = """
WITH d AS (SELECT doc_id, coalesce(text, chr(0)) AS t, coalesce(strlen(text), 0) + 8 AS size FROM documents),
r AS (SELECT got.*, d.t, d.size AS want FROM got JOIN d USING (doc_id)),
loads AS (SELECT shard, sum(size) AS load, count(*) AS n, min(slot) AS low, max(slot) AS high, count(DISTINCT slot) AS slots FROM r GROUP BY shard)
SELECT (SELECT count(*) FROM r) - (SELECT count(*) FROM d) AS lost,
       (SELECT count(*) FROM r WHERE size <> want) AS wrong_sizes,
       (SELECT count(*) FROM (SELECT t FROM r GROUP BY t HAVING count(DISTINCT shard) > 1)) AS cut_groups,
       (SELECT count(*) FROM loads WHERE low <> 0 OR high <> n - 1 OR slots <> n) AS gaps,
       (SELECT count(*) FROM r WHERE shard NOT BETWEEN 0 AND 23 OR law <> 'bytes' OR grown_shard IS NOT NULL) AS odd,
       (SELECT max(load) FROM loads) AS largest,
       (SELECT greatest(sum(size) / 24.0, (SELECT max(s) FROM (SELECT sum(size) AS s FROM r GROUP BY t))) FROM r) AS bound
"""


def test_laws_in_sql(spark):
    """Size, groups, slots and near equality on a whole bench table, checked by DuckDB."""
    import duckdb

    path = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/documents.parquet'")
    con.register("got", sharding.op7_sharding(spark, path).toArrow())
    *faults, largest, bound = con.execute(LAWS).fetchone()
    assert faults == [0] * 5 and largest <= 1.25 * float(bound)
