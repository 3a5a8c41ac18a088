"""Each stage on its own input, and the whole, against brute force."""

from collections import defaultdict

import corpus_pipeline
import pytest
from data import lower_az, rows, table
from test_packing import library_ids
from test_simhash import brute_copies

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("sf")
    data = [(i, t, g) for i, t, g in rows() if i is not None]
    docs = spark.createDataFrame([(i, t, g, "s", len(t or "")) for i, t, g in data], COLUMNS)
    docs.write.parquet(str(path / "documents.parquet"))
    out, docs = [docs], docs
    for _, f in corpus_pipeline.STAGES:
        docs = corpus_pipeline.materialise(f(spark, docs, str(path)), "test")
        out.append(docs)
    return str(path), out


def texts(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]


def test_stages(stages):
    _, (source, known, exact, near, cut, packed) = stages
    for df in (known, exact, near, cut):
        assert df.columns == source.columns
    have = texts(known)
    assert all(any(c.isalpha() for c in t or "") for _, t in have) and {i for i, _ in have} >= set(range(60))
    want = {}
    for i, t in have:
        want[lower_az(t)] = max(i, want.get(lower_az(t), i))
    assert sorted((i, lower_az(t)) for i, t in texts(exact)) == sorted((i, t) for t, i in want.items())
    have = texts(exact)
    comp = brute_copies([t for _, t in have])
    least = {}
    for c, (i, _) in zip(comp, have):
        least[c] = min(i, least.get(c, i))
    assert sorted(texts(near)) == sorted((i, t) for c, (i, t) in zip(comp, have) if least[c] == i)
    assert {i for i, _ in texts(cut)} == {i for i, _ in texts(near)} and all(r["n_chars"] == len(r["text"]) for r in cut.collect())
    tokens = defaultdict(int)
    for r in packed.collect():
        tokens[r["doc_id"]] += r["length"]
    want = defaultdict(int)
    for i, t in texts(cut):
        want[i] += len(library_ids(t)) + 1
    assert tokens == want


def test_run(spark, stages):
    path, out = stages
    show = lambda df: sorted((r["doc_id"], r["start"], r["length"], r["ids_crc32"]) for r in df.select("doc_id", "start", "length", "ids_crc32").collect())
    total = lambda rs: sum(n for _, _, n, _ in rs)
    assert total(show(corpus_pipeline.run(spark, path))) == total(show(out[-1]))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "near_dedup", "substring_dedup", "packing"] and corpus_pipeline.ORACLE_SQL is None


def test_clashing_names(spark, tmp_path):
    """Stages keep every column of the input, whatever its name, with its values."""
    docs = table(spark, [(i, t, g) for i, t, g in rows() if i is not None])
    rest = [c for c in docs.columns if c not in ("doc_id", "text", "n_chars")]
    want = {tuple(r) for r in docs.select("doc_id", *rest).collect()}
    for _, f in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.materialise(f(spark, docs, str(tmp_path)), "test")
        assert docs.schema.names == table(spark).columns
        assert 0 < docs.count() and {tuple(r) for r in docs.select("doc_id", *rest).collect()} <= want
    assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()


def test_empty(spark, tmp_path):
    spark.createDataFrame([], COLUMNS).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
    assert table(spark).count() > 0
