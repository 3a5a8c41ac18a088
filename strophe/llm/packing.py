"""Sequence packing as vector bin packing with the dot-product heuristic.

A sequence has three limits: tokens, segments and loss-bearing tokens. The open sequence takes, of the
pieces that fit, the one whose weighted size has the largest dot product with what is left of the
limits. Documents may be cut anywhere, so the last segment that a sequence can take is cut to fill it,
and what a partition has left over at its end goes into sequences whose length is a power of two, which
need no padding. Each partition packs its own documents in blocks of bounded size.
"""

from __future__ import annotations

import re
import struct
import sys
import types
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_batches, load

TOKENS = 2048
SEGMENTS = 64
END_ID = 1
TOKENIZER = "word_bpe_49k.json"
#: Tokens that a partition gathers before it packs them, bytes that a worker's word cache takes, and characters of the longest words in it.
BLOCK_TOKENS = 4_000_000
CACHE_BYTES, CACHED = 160 << 20, 128
#: Bytes of an entry beyond its word and ids.
_ENTRY = 200
#: Characters outside these, a "<|" or text that is not in NFC takes the library's own whole path.
_ODD = re.compile(r"[^\t\n\r\x20-\x7e¡-¬®-įĲ-ňŊ-ž]|<\|")
#: Characters of a text that are encoded at a time, and where it may be cut.
SLICE, _CUT = 1 << 18, re.compile(r"[ \n]")
_ASCII = b"\t\n\r" + bytes(range(0x20, 0x7F))
_WORD = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")


def _per_worker() -> dict:
    """What a Python worker keeps between tasks."""
    return sys.modules.setdefault("_strophe_worker", types.ModuleType("_strophe_worker")).__dict__


class WordBpe:
    """Ids of the tokenizers library for this vocabulary, with a cache per stretch without white space.

    The vocabulary's pre-tokenizer never joins across white space and its model sees one word at a time,
    so a stretch's ids do not depend on its surroundings. Only the model runs for a new stretch.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = True
        self.model = self.whole.model
        level = ByteLevel(add_prefix_space=False, use_regex=False)
        self.level = level
        self.cache, self.words, self.held = {}, {}, 0

    def keep(self, known: dict, w: str, ids: bytes) -> None:
        """Remember a word unless it is long; a full cache is emptied."""
        if len(w) <= CACHED:
            known[w] = ids
            self.held += _ENTRY + len(w) + len(ids)

    def stretch(self, s: str) -> bytes:
        parts = []
        for w in (s,) if s.isalpha() else _WORD.findall(s):  # letters alone are one word
            ids = self.words.get(w)
            if ids is None:
                mapped = w if w.isascii() else self.level.pre_tokenize_str(w)[0][0]
                tokens = self.model.tokenize(mapped)
                ids = struct.pack(f"<{len(tokens)}I", *[t.id for t in tokens])
                self.keep(self.words, w, ids)
            parts.append(ids)
        return parts[0] if len(parts) == 1 else b"".join(parts)

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers; long texts are cut at white space."""
        if len(text) <= SLICE:
            return self._encode(text)
        parts, at = [], 0
        while at < len(text):
            cut = _CUT.search(text, at + SLICE)
            end = cut.start() if cut else len(text)
            parts.append(self._encode(text[at:end]))
            at = end
        return b"".join(parts)

    def _encode(self, text: str) -> bytes:
        if text.isascii():  # no need to look at characters one by one
            odd = bool(text.encode().translate(None, _ASCII)) or "<|" in text
        else:
            odd = bool(_ODD.search(text))
        if odd or not unicodedata.is_normalized("NFC", text):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        words, cache = text.lower().split(), self.cache
        parts = list(map(cache.get, words))
        if None in parts:
            if self.held > CACHE_BYTES:
                cache.clear()
                self.words.clear()
                self.held = 0
            own = {}
            for at, ids in enumerate(parts):
                if ids is None:
                    w = words[at]
                    ids = own.get(w)
                    if ids is None:
                        ids = own[w] = self.stretch(w)
                        self.keep(cache, w, ids)
                    parts[at] = ids
        return b"".join(parts)


class Pool:
    """Pieces waiting, by type (tokens, loss-bearing tokens)."""

    def __init__(self):
        self.at, self.stacks, self.total = {}, [], 0
        self.size = np.zeros((256, 3))  # tokens, segments, loss
        self.n = np.zeros(256, np.int64)

    def add(self, doc: int, start: int, end: int, loss_from: int) -> None:
        loss = max(0, end - max(start, loss_from))
        k = self.at.get((end - start, loss))
        if k is None:
            k = self.at[end - start, loss] = len(self.stacks)
            self.stacks.append([])
            if k == len(self.n):
                self.size, self.n = np.concatenate((self.size, np.zeros_like(self.size))), np.concatenate((self.n, np.zeros_like(self.n)))
            self.size[k] = (end - start, 1, loss)
        self.stacks[k].append((doc, start, end, loss_from))
        self.n[k] += 1
        self.total += end - start

    def pop(self, k: int) -> tuple[int, int, int, int]:
        self.n[k] -= 1
        piece = self.stacks[k].pop()
        self.total -= piece[2] - piece[1]
        return piece


class Packer:
    def __init__(self, tokens=TOKENS, segments=SEGMENTS, loss=None):
        self.limits = np.array([tokens, segments, tokens if loss is None else loss], float)
        if self.limits.min() < 1:
            raise ValueError("every limit must be at least 1")
        self.pool, self.sequences = Pool(), []

    def add(self, doc: int, length: int, loss_from: int = 0) -> None:
        """A document; full sequences are cut off it at once where the loss limit lets them."""
        start, full = 0, int(self.limits[0])
        while length - start >= full and full - max(0, min(full, loss_from - start)) <= self.limits[2]:
            self.sequences.append([(doc, start, start + full)])
            start += full
        if start < length:
            self.pool.add(doc, start, length, loss_from)

    def _head(self, left: np.ndarray) -> tuple | None:
        """Cut off a waiting piece what fills the rest of a sequence; the remainder waits."""
        pool, m = self.pool, len(self.pool.stacks)
        over = (pool.size[:m, 0] > left[0]) | (pool.size[:m, 2] > left[2])
        large = np.flatnonzero((pool.n[:m] > 0) & over)
        if not len(large):
            return None
        doc, a, b, loss_from = pool.pop(int(large[np.argmax(pool.size[large, 0])]))
        cut = min(a + int(left[0]), max(a, loss_from) + int(left[2]))
        if cut > a:
            pool.add(doc, cut, b, loss_from)
            return doc, a, cut, loss_from
        pool.add(doc, a, b, loss_from)
        return None

    def _fill(self) -> list:
        pool, left, parts = self.pool, self.limits.copy(), []
        while left[0] > 0 and left[1] > 0:
            m = len(pool.stacks)
            size = pool.size[:m]
            fits = (pool.n[:m] > 0) & (size <= left).all(1)
            if left[1] == 1:  # the last segment should fill the sequence
                fits &= size[:, 0] == left[0]
            if fits.any():
                gain = size @ (left / self.limits / self.limits)
                piece = pool.pop(int(np.argmax(np.where(fits, gain, -1.0))))
            else:
                piece = self._head(left)
                if piece is None and left[1] == 1 and ((pool.n[:m] > 0) & (size <= left).all(1)).any():
                    at = np.flatnonzero((pool.n[:m] > 0) & (size <= left).all(1))
                    piece = pool.pop(int(at[np.argmax(size[at, 0])]))
                if piece is None:
                    break
            parts.append(piece)
            left -= (piece[2] - piece[1], 1, max(0, piece[2] - max(piece[1], piece[3])))
        return parts

    def run(self, last: bool) -> list[list[tuple[int, int, int]]]:
        """Sequences as lists of (document, start, end); what is left waits for the next block unless last."""
        while self.pool.total >= self.limits[0] or (last and self.pool.total):
            parts = self._fill()
            have = sum(b - a for _, a, b, _ in parts)
            if not have:
                raise RuntimeError("no piece fits an empty sequence")
            if have < self.limits[0]:  # shorten to a power of two, which is not padded
                over = have - (1 << (have.bit_length() - 1))
                while over:
                    doc, a, b, loss_from = parts.pop()
                    keep = max(a, b - over)
                    over -= b - keep
                    self.pool.add(doc, keep, b, loss_from)
                    if keep > a:
                        parts.append((doc, a, keep, loss_from))
            self.sequences.append([p[:3] for p in parts])
        out, self.sequences = self.sequences, []
        return out


def _pack_batches(path, end_id, tokens, segments, loss, with_ids, loss_start=None):
    def run(batches):
        kept = _per_worker()
        coder = kept.get(("word", path)) or kept.setdefault(("word", path), WordBpe(path))
        end = np.array([end_id], "<u4").tobytes()
        packer, docs, gathered = Packer(tokens, segments, loss), {}, 0
        sequence, number, kind = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 36, 0, None

        def flush(last):
            nonlocal sequence
            out = {k: [] for k in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids")}
            for parts in packer.run(last):
                at = 0
                for doc, a, b in parts:
                    doc_id, ids = docs[doc]
                    piece = ids[4 * a : 4 * b]
                    for k, v in zip(out, (doc_id, a, b - a, zlib.crc32(piece), len(ids) // 4, sequence, at, piece), strict=True):
                        out[k].append(v)
                    at += b - a
                sequence += 1
            waiting = {p[0] for stack in packer.pool.stacks for p in stack}
            for doc in [d for d in docs if d not in waiting]:
                del docs[doc]
            old, packer.pool = packer.pool, Pool()  # forget types that are empty now
            for stack in old.stacks:
                for p in stack:
                    packer.pool.add(*p)
            types_ = {"doc_id": kind, "ids": pa.binary()}
            names = list(out) if with_ids else list(out)[:-1]
            return pa.RecordBatch.from_arrays([pa.array(out[k], types_.get(k, pa.int64())) for k in names], names=names)

        for b in batches:
            kind = b.column("doc_id").type
            starts = [0] * len(b) if loss_start is None else b.column("loss_start").to_pylist()
            for doc_id, text, loss_from in zip(b.column("doc_id").to_pylist(), b.column("text"), starts, strict=True):
                ids = coder.encode(text.as_py() or "") + end
                docs[number] = (doc_id, ids)
                packer.add(number, len(ids) // 4, loss_from or 0)
                number += 1
                gathered += len(ids) // 4
                if gathered >= BLOCK_TOKENS:
                    yield flush(False)
                    gathered = 0
        if docs:
            yield flush(True)

    return run


def pack(docs: DataFrame, path: str, tokens=TOKENS, segments=SEGMENTS, loss=None, end_id=END_ID, with_ids=False, loss_start=None) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset`` (and ``ids``).

    Each document's ids end with ``end_id``; a null or empty text is that id alone. ``loss_start``
    names a column with the number of a document's first token that bears loss, as after a prompt; without
    it, or where it is null, every token does. Repeated rows are packed each for itself, a null doc_id is carried along, other
    columns are ignored, an empty table gives an empty result. Sequence ids are unique, not gapless.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    run = _pack_batches(path, end_id, tokens, segments, loss, with_ids, loss_start)
    columns = ["doc_id", "text"] + ([] if loss_start is None else [F.col(loss_start).cast("long").alias("loss_start")])
    return in_batches(docs.select(*columns)).mapInArrow(run, schema + (", ids binary" if with_ids else ""))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def op8_packing(spark, sf_dir):
    return pack(load(spark, sf_dir, "documents"), tokenizer_path())
