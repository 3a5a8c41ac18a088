import math
from collections import Counter

import numpy as np
import pytest
import regex
from data import SCHEMA, rows, table

from strophe.llm import quality_rules as q

WORD = regex.compile(r"[^\x20\x09-\x0D]+")


def brute_base(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    count = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if count[w] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


def brute_references(data):
    classes, words, totals = {}, {}, Counter()
    for _, t, g in data:
        for k in {g or q.ALL, q.ALL}:
            for c in t or "":
                n = q.CLASSES[int(np.flatnonzero(q.class_counts(c))[0])]
                classes.setdefault(k, Counter())[n] += 1
            for w in WORD.findall(t or ""):
                words.setdefault(k, Counter())[q.common_form(w.encode())] += 1
                totals[k] += 1
    common = {k: {w: n for w, n in c.items() if w and n >= totals[k] * q.COMMON_SHARE} for k, c in words.items()}
    return classes, common, totals


def test_distance():
    p, r = np.array([1.0, 1, 0, 2]), np.array([0.0, 1, 3, 0])
    a, b = p / 4, r / 4
    m = (a + b) / 2
    want = math.sqrt(sum(x * math.log2(x / y) for v in (a, b) for x, y in zip(v, m) if x) / 2)
    assert q.js_distance(p, r) == pytest.approx(want) and q.js_distance(p, 7 * p) == pytest.approx(0, abs=1e-7)
    assert q.js_distance(np.array([1.0, 0]), np.array([0.0, 1])) == 1 == q.js_distance(np.zeros(2), p[:2])


def test_against_brute_force(spark):
    data = rows()
    ref = q.references(table(spark))
    classes, common, totals = brute_references(data)
    assert set(ref.classes) == set(classes) and all(dict(zip(q.CLASSES, map(int, v))) == {c: classes[k][c] for c in q.CLASSES} for k, v in ref.classes.items())
    for k, c in common.items():
        if c:
            assert sorted(ref.words[k]) == sorted(c) and ref.histograms[k].sum() == totals[k]
    want = []
    for i, t, g in data:
        base = brute_base(t)
        failed = base[0] < 50 or 100 * base[4] > 50 * base[0]
        a, b = q.distances(t or "", *q.numbered(t or ""), g, ref)
        ok = not failed and (a is None or a <= q.MAX_CLASS_DISTANCE) and (b is None or b <= q.MAX_WORD_DISTANCE)
        want.append(repr((i, *base, failed, ok)))
    got = q.judge(table(spark), ref).collect()
    assert sorted(repr(tuple(r)[:8]) for r in got) == sorted(want)


def plain_distance(p, r):
    total = lambda x: sum(x.values())
    keys = set(p) | set(r)
    a, b = ({k: x.get(k, 0) / total(x) for k in keys} for x in (p, r))
    return math.sqrt(sum(v * math.log2(2 * v / (a[k] + b[k])) / 2 for x in (a, b) for k, v in x.items() if v))


def test_distances_against_plain_dictionaries(spark):
    data = rows()
    ref = q.references(table(spark))
    classes, common, totals = brute_references(data)
    for _, t, g in data:
        t = t or ""
        words = WORD.findall(t)
        a, b = q.distances(t, *q.numbered(t), g, ref)
        key = g if g in classes else q.ALL
        assert (a is None) == (len(t) < q.MIN_CHARS) and (b is None) == (len(words) < q.MIN_WORDS)
        if a is not None:
            assert a == pytest.approx(plain_distance(Counter(q.CLASSES[int(np.flatnonzero(q.class_counts(c))[0])] for c in t), classes[key]), abs=1e-6)
        if b is not None:
            mine = Counter(w if w in common[key] else None for w in (q.common_form(w.encode()) for w in words))
            theirs = {**common[key], None: totals[key] - sum(common[key].values())}
            assert b == pytest.approx(plain_distance(mine, theirs), abs=1e-6)


BASE_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM d),
g AS (SELECT doc_id, i, w[i] || chr(10) || w[i + 1] || chr(10) || w[i + 2] AS three FROM w, unnest(range(1, len(w) - 1)) r(i)),
again AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, three) > 1),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM again, range(0, 3) s(k) GROUP BY doc_id),
lines AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n
          FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id)
SELECT w.doc_id, len(w) AS n_words, list_sum(list_transform(w, lambda x: length(x))) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
       coalesce(lines.n, 0) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words,
       len(w) < 50 OR 100 * coalesce(covered.n, 0) > 50 * len(w) AS base_failed
FROM w LEFT JOIN lines USING (doc_id) LEFT JOIN covered USING (doc_id)
"""


def test_base_figures_in_sql(spark):
    """Every row's base figures on a whole bench table, computed by DuckDB."""
    import duckdb

    path = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/documents.parquet'")
    want = Counter((a, b, c or 0, *r) for a, b, c, *r in con.execute(BASE_SQL).fetchall())
    assert Counter(tuple(r)[:7] for r in q.op5_quality_rules(spark, path).collect()) == want


def test_guards_and_verdict(spark):
    data = rows()
    ref = q.references(table(spark, data))
    a, b = q.distances("short", *q.numbered("short"), "en", ref)
    assert a is None and b is None
    junk = " ".join(f"q{i}x***" for i in range(300))
    got = {r["doc_id"]: r for r in q.judge(table(spark, [(1, junk, "en"), (2, data[0][1] * 3, data[0][2]), (3, junk, "unknown"), (4, None, "en")]), ref).collect()}
    assert not got[1]["base_failed"] and not got[1]["kept"] and not got[3]["kept"] and got[4]["base_failed"] and got[4]["class_distance"] is None


def test_flush_and_empty(spark, monkeypatch):
    whole = q.references(table(spark))
    monkeypatch.setattr(q, "_FLUSH", 10)
    parts = q.references(table(spark))
    assert all((whole.histograms[k] == parts.histograms[k]).all() for k in whole.histograms) and whole.words == parts.words
    empty = spark.createDataFrame([], SCHEMA)
    none = q.references(empty)
    assert none.classes == {} and q.judge(empty, none).collect() == []
    assert q.judge(table(spark), none).count() == len(rows())


def test_long_words_are_counted_by_digests(spark):
    """A common long word has a bin of its own, whatever its length, and is found again."""
    word = "Base64" + "abcdEFGH" * 2000
    text = " ".join([word, "(" + word.lower() + ")", *(f"w{i % 40}" for i in range(98))])
    ref = q.references(spark.createDataFrame([(i, text, "en") for i in range(5)], "doc_id long, text string, lang string"))
    name = q.common_form(word.encode())
    assert len(name) == 33 and name in ref.words["en"] and ref.histograms["en"][ref.words["en"][name]] == 10
    assert q.common_form(("(" + word.lower() + ").").encode()) == name and q.common_form(b"(" + b"Word" * 3 + b")") == "wordwordword"
    assert q.distances(text, *q.numbered(text), "en", ref) == (0.0, 0.0) and q.common_form(b"*" * 500) == ""


def test_many_long_words_in_bounded_memory():
    """6,000 texts of one distinct word of 10 kB each leave nothing of that size behind."""
    import subprocess
    import sys

    code = """
import random, resource, pyarrow as pa
from strophe.llm import packing, quality_rules
rng = random.Random(1)
peak = lambda: resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024
def batches():
    for i in range(60):
        yield pa.RecordBatch.from_pydict({"doc_id": list(range(100)), "lang": ["en"] * 100, "text": ["".join(rng.choices("abcdefgh", k=10_000)) for _ in range(100)]})
run = packing._pack_batches(packing.tokenizer_path(), 1, 2048, 64, None, False)
sum(b.num_rows for b in run(iter([next(batches())])))
sum(b.num_rows for b in quality_rules._reference_batches(iter([next(batches())])))
before = peak()
n = sum(b.num_rows for b in quality_rules._reference_batches(batches()))
m = sum(b.num_rows for b in packing._pack_batches(packing.tokenizer_path(), 1, 2048, 64, None, False)(batches()))
print(n, m, peak() - before)
"""
    n, m, mb = map(int, subprocess.run([sys.executable, "-c", code], check=True, capture_output=True, text=True).stdout.split())
    assert n >= 6000 and m >= 6000 and mb < 200
