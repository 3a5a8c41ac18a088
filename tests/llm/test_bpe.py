import base64
import hashlib
import random

import numpy as np
import public_tokenizers as public
import pyarrow as pa
import pytest
import tiktoken
from data import SCHEMA, rows, table

from strophe.llm import bpe
from strophe.llm.bpe import RANKS, DuckBpe, encode

PATH = public.path(RANKS)


@pytest.fixture(scope="module")
def library():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def coder():
    return DuckBpe(PATH, public.PATTERN)


def texts():
    rng = random.Random(2)
    odd = ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(160, 0x500), rng.randrange(0x4E00, 0x5000), 0x1F642, 10, 32, 0x3000, 0x1C, 0x85])) for _ in range(80)) for _ in range(40)]
    return [t or "" for _, t, _ in rows()] + odd + [" " * 300 + "a", "I'll we've 'S 'd''d", "aaaa" * 50, "0123456789" * 20]


def test_words(coder, library):
    for t, parts in zip(texts(), coder.encode_batch(texts())):
        assert np.frombuffer(b"".join(parts), "<u4").tolist() == library.encode_ordinary(t), t[:40]
        assert b"".join(coder.bytes[p] for p in parts) == t.encode()


def test_merge_and_decode(coder, library):
    ids = library.encode_ordinary(texts()[0])
    raw = [np.array(ids, "<u4").tobytes(), b"", np.array(ids[:3], "<u4").tobytes()]
    assert coder.decode(raw) == [library.decode_bytes(ids), b"", library.decode_bytes(ids[:3])] and coder.decode([]) == [] == coder.merge([])


def pieces(coder, library, words):
    got = coder.merge([w.encode() for w in words])
    for w, ids in zip(words, got, strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library._core_bpe.encode_single_piece(w.encode()), w[:40]


def letters(rng, n, low=97, high=123):
    return "".join(chr(rng.randrange(low, high)) for _ in range(n))


def test_long_words(coder, library):
    """Unbroken runs of up to two million letters and many middling words, under the coder's 600 MB and without spilling."""
    rng = random.Random(8)
    pieces(coder, library, [letters(rng, n) for n in (20_000, 100_000, 2_000_000)])
    pieces(coder, library, [letters(rng, 7000, 0x4E00, 0x9FA0), letters(rng, 50_000, 0xE01, 0xE2F), "=" * 20_000, " " * 90_000 + "a", "ab" * 9000])
    pieces(coder, library, [letters(rng, rng.randint(150, 300)) for _ in range(10_000)])
    pieces(coder, library, [letters(rng, rng.randint(1, 200), 97, 100) for _ in range(1000)])


def test_common_parts(coder, library):
    """Words of frequent tokens, where new tokens often have lower ranks than their parts."""
    rng = random.Random(9)
    parts = ["th", "he", "the", "er", "in", "ing", " ", "  ", "t", "h", "e", "=", "==", "\n", "ab", "aba"]
    pieces(coder, library, ["".join(rng.choice(parts) for _ in range(rng.randint(1, 60))) for _ in range(4000)])


def test_piece_by_piece(coder, library, monkeypatch):
    """Words longer than a piece, cut nowhere else, among them runs that shift all later tokens."""
    monkeypatch.setattr(bpe, "CHUNK", 70)
    rng = random.Random(10)
    parts = ["th", "he", "the", "er", "in", "ing", " ", "  ", "t", "h", "e", "=", "==", "tion", "and"]
    pieces(coder, library, ["".join(rng.choice(parts) for _ in range(rng.randint(80, 500))) for _ in range(60)] + ["=" * 999, " " * 500 + "x", "ab" * 300])


def test_long_text_in_blocks(spark, library, monkeypatch):
    monkeypatch.setattr(bpe, "GATHER", 1000)
    monkeypatch.setattr(bpe, "BLOCK", 7)
    text = " ".join(t or "" for _, t, _ in rows())
    ids = library.encode_ordinary(text)
    batch = pa.RecordBatch.from_pydict({"doc_id": [1, 2, 3], "text": [text, "", text[:30]]})
    got = [r for b in bpe._digest_batches(PATH, public.PATTERN, True)([batch]) for r in b.to_pylist()]
    assert np.frombuffer(got[0]["ids"], "<u4").tolist() == ids and got[0]["decoded"] == text.encode() and got[1]["n_tokens"] == 0
    assert got[0]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest() and [r["doc_id"] for r in got] == [1, 2, 3]


def test_full_cache_is_emptied(coder, library, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_BYTES", 1000)
    for t in texts()[:20]:
        (parts,) = coder.encode_batch([t])
        assert np.frombuffer(b"".join(parts), "<u4").tolist() == library.encode_ordinary(t)


def test_operator(spark, library):
    want = []
    for i, t, _ in rows():
        ids = library.encode_ordinary(t or "")
        want.append(repr((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())))
    got = encode(table(spark), PATH, public.PATTERN, with_ids=True).collect()
    assert sorted(repr(tuple(r)[:4]) for r in got) == sorted(want)
    assert all(hashlib.sha256(r["decoded"]).hexdigest() == r["decoded_sha256"] and len(r["ids"]) == 4 * r["n_tokens"] for r in got)
    assert encode(spark.createDataFrame([], SCHEMA), PATH, public.PATTERN).collect() == []
