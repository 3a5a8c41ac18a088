"""Each operator on one very long text: memory stays a small multiple of the text."""

import subprocess
import sys

import pytest

MB = 10
SETUP = f"""
import random, resource
import pandas as pd, pyarrow as pa, public_tokenizers as public
from strophe.llm import bpe, language_id, packing, quality_cnn, quality_rules, simhash, substring_dedup
rng = random.Random(1)
words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(30000)]
parts = [" ".join(rng.choice(words) for _ in range(12)) + rng.choice([". ", ".\\n", ", "]) for _ in range({MB} << 14)]
text = "".join(parts)[: {MB} << 20]
assert len(text) == {MB} << 20
del parts
row = lambda **k: pa.RecordBatch.from_pydict(k)
peak = lambda: resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024
"""
RUNS = {
    "language_id": "n = int(language_id.ngram_counts(text).sum())",
    "simhash": "n = simhash.fingerprint(text)",
    "near_copies": "n = sum(b.num_rows for b in simhash._sketch_batches(5, 20, 4)([row(node=[1], text=[text])]))",
    "confirm": "n = sum(b.num_rows for b in simhash._confirmed_batches(5, 0.8)([row(u=[1], v=[2], a=[text], b=[text])]))",
    "bpe": "n = [b['n_tokens'][0].as_py() for b in bpe._digest_batches(public.path(bpe.RANKS), public.PATTERN, False)([row(doc_id=[1], text=[text])])][0]",
    "quality_rules": "n = [b['n_words'][0].as_py() for b in quality_rules._judge_batches(quality_rules.References([], {}))([row(doc_id=[1], lang=['en'], text=[text])])][0]",
    "references": "n = sum(b.num_rows for b in quality_rules._reference_batches([row(doc_id=[1], lang=['en'], text=[text])]))",
    "substring_dedup": "u = next(iter(substring_dedup._unit_batches(1)([row(doc_id=[1], k=[1], text=[text])]))).column('unit').to_pylist(); "
    "n = len(substring_dedup._cut(pd.Series([text]), pd.Series([u[::2]]))['removed'][0])",
    "packing": "n = sum(b.num_rows for b in packing._pack_batches(packing.tokenizer_path(), 1, 2048, 64, None, False)([row(doc_id=[1], text=[text])]))",
    "quality_cnn": "n = sum(b.num_rows for b in quality_cnn._score_batches(quality_cnn.Network())([row(doc_id=[1], text=[text])]))",
}


@pytest.mark.parametrize("name", RUNS)
def test_memory(name):
    code = f"{SETUP}\nbefore = peak()\n{RUNS[name]}\nprint(n, peak() - before)"
    n, mb = map(int, subprocess.run([sys.executable, "-c", code], check=True, capture_output=True, text=True).stdout.split())
    assert n > 0 and mb < 40 * MB


def test_stages_and_joins(spark, tmp_path):
    """Long texts pass through Spark, exact dedup and sharding included, beside short ones."""
    from strophe.llm import exact_dedup, sharding

    long = "many words, " * 400_000
    docs = spark.createDataFrame([(1, long), (2, long.upper()), (3, "short"), (4, None)], "doc_id long, text string")
    assert {(r["doc_id"], r["keep_id"]) for r in exact_dedup.dedup(docs).collect()} == {(1, 2), (2, 2), (3, 3), (4, 4)}
    assert [(r["doc_id"]) for r in exact_dedup.keep_last(docs).orderBy("doc_id").collect()] == [2, 3, 4]
    assert sharding.shard(docs, 2).filter("size = 4800008").count() == 2
