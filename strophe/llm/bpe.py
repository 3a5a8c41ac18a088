"""Byte-level BPE by recursive DuckDB queries in each partition.

A document is cut by the tokenizer's pattern. Words that a worker has not seen are encoded together: their
single-byte tokens become rows (word, position, token), and a recursive query joins neighbours to the merge
table and contracts each word's leftmost pair of least rank until no pair is left. The recursion is keyed
by word and position, so it holds one row a byte, however many rounds it takes. Words of over LONG bytes
would take many rounds: there a round contracts all pairs of the least rank that don't overlap, unless some
token of lower rank holds the new token's bytes before its own end. Only then could what grows out of one
contraction reach the next one first, and the round contracts the leftmost pair alone.

A query takes words of at most QUERY_BYTES together. Long words are first cut between bytes that no token
has side by side, which no merge can cross. What is still longer than CHUNK is encoded piece by piece: each
piece is encoded behind the last tokens before it, further back until the first token and the one before it
are also what their bytes alone encode to. Tokens that neighbours encode to in pairs are the encoding of the
whole, for BPE asks nothing else of a sequence.

Decoding joins ids to the vocabulary and aggregates bytes in order of position. Both results are kept per
worker, up to ``CACHE_BYTES``, so a document is a concatenation of what its words gave.
"""

from __future__ import annotations

import base64
import hashlib
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import in_batches, load
from .packing import _per_worker

RANKS = "byte_bpe_multi_50k.tiktoken"
#: Bytes of words and of what is kept of them, counting KEPT for each, beyond which a worker's cache is emptied.
CACHE_BYTES, KEPT = 320 << 20, 300
#: Bytes that a recursive query takes, of a word that is cut, of a piece of one, and characters gathered before new words are encoded.
QUERY_BYTES, LONG, CHUNK, GATHER = 1 << 17, 64, 1 << 16, 8_000_000
#: Words of a long text that are held at a time.
BLOCK = 500_000
#: Tokens before a piece that are encoded with it at first, and the factor by which they become more.
BACK, MORE = 8, 4

#: Each round contracts the leftmost pair of least rank of each word (words of up to LONG bytes).
_ENCODE = """
WITH RECURSIVE step(id, tok) USING KEY (id) AS (
  SELECT (w << 20) | pos, tok FROM start
  UNION ALL
  (WITH scored AS MATERIALIZED (
     SELECT id, tok, id >> 20 AS w, (m.rank << 40) | ((id & 1048575) << 20) | (after & 1048575) AS score
     FROM (SELECT *, lead(tok) OVER line AS nxt, lead(id) OVER line AS after FROM step WHERE tok IS NOT NULL WINDOW line AS (ORDER BY id)) s
     LEFT JOIN merges m ON m.pair = (s.tok << 20) | s.nxt AND s.after >> 20 = s.id >> 20
   ), best AS (
     SELECT w, min(score) AS least FROM scored GROUP BY w HAVING least IS NOT NULL
   )
   SELECT id, CASE id & 1048575 WHEN least & 1048575 THEN NULL WHEN (least >> 20) & 1048575 THEN least >> 40 ELSE tok END
   FROM scored JOIN best USING (w))
)
SELECT id >> 20 AS w, tok FROM step WHERE tok IS NOT NULL ORDER BY id
"""

#: Each round contracts every pair of least rank that the contractions to its left leave over (longer pieces).
_ENCODE_LONG = """
WITH RECURSIVE step(id, tok) USING KEY (id) AS (
  SELECT (w << 20) | pos, tok FROM start
  UNION ALL
  (WITH scored AS MATERIALIZED (
     SELECT id, tok, id >> 20 AS w, n, m.rank, m.alone
     FROM (SELECT *, lead(tok) OVER line AS nxt, lead(id) OVER line AS after, row_number() OVER line AS n FROM step WHERE tok IS NOT NULL WINDOW line AS (ORDER BY id)) s
     LEFT JOIN merges m ON m.pair = (s.tok << 20) | s.nxt AND s.after >> 20 = s.id >> 20
   ), best AS (
     SELECT w, min((rank << 40) | n) AS least FROM scored GROUP BY w HAVING least IS NOT NULL
   ), runs AS (
     SELECT s.*, least, coalesce(max(CASE WHEN rank IS DISTINCT FROM least >> 40 THEN n END) OVER (ORDER BY n ROWS UNBOUNDED PRECEDING), 0) AS before
     FROM scored s JOIN best USING (w)
   ), marked AS (
     SELECT *, rank = least >> 40 AND CASE WHEN alone THEN n = least & 1099511627775 ELSE (n - before) % 2 = 1 END AS taken FROM runs
   )
   SELECT id, CASE WHEN lag(taken) OVER (ORDER BY n) THEN NULL WHEN taken THEN rank ELSE tok END FROM marked)
)
SELECT id >> 20 AS w, tok FROM step WHERE tok IS NOT NULL ORDER BY id
"""

_DECODE = """
SELECT w, string_agg(hex(v.bytes), '' ORDER BY pos) AS bytes
FROM ids JOIN vocabulary v USING (tok) GROUP BY w
"""


class DuckBpe:
    """Encoder and decoder for a rank file; one DuckDB connection on one thread."""

    def __init__(self, path: str, pattern: str):
        import duckdb

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        # White space is the Unicode property, as in the tiktoken library's pattern engine.
        pattern = pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")
        self.find, self.each = regex.compile(pattern).findall, regex.compile(pattern).finditer
        self.byte = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = {
            (self.ranks[t[:i]] << 20) | self.ranks[t[i:]]: r
            for t, r in self.ranks.items() for i in range(1, len(t)) if t[:i] in self.ranks and t[i:] in self.ranks
        }
        crossed = {  # tokens whose bytes a token of lower rank holds before its end
            r for t, k in self.ranks.items() for i in range(len(t) - 1) for j in range(i + 2, len(t)) if (r := self.ranks.get(t[i:j], -1)) > k
        }
        ranks = pa.array(pairs.values(), pa.int64())
        merges = pa.table({"pair": pa.array(pairs.keys(), pa.int64()), "rank": ranks, "alone": pa.array([r in crossed for r in pairs.values()])})  # noqa: F841
        vocabulary = pa.table({"tok": pa.array(self.ranks.values(), pa.int64()), "bytes": pa.array(self.ranks.keys(), pa.binary())})  # noqa: F841
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "600MB", "temp_directory": ""})
        self.db.execute("CREATE TABLE merges AS SELECT * FROM merges")
        self.db.execute("CREATE TABLE vocabulary AS SELECT * FROM vocabulary")
        self.beside = np.zeros((256, 256), bool)  # bytes that some token has side by side
        for t in self.ranks:
            raw = np.frombuffer(t, np.uint8)
            self.beside[raw[:-1], raw[1:]] = True
        self.token = {r: t for t, r in self.ranks.items()}
        self.ids, self.bytes, self.held = {}, {}, 0

    def _rows(self, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        w = np.repeat(np.arange(len(lengths)), lengths)
        return w, np.arange(len(w)) - np.repeat(np.cumsum(lengths) - lengths, lengths)

    def _pieces(self, word: bytes) -> list[bytes]:
        """The word, if it is long cut where no merge can cross."""
        if len(word) <= LONG:
            return [word]
        raw = np.frombuffer(word, np.uint8)
        cuts = (np.flatnonzero(~self.beside[raw[:-1], raw[1:]]) + 1).tolist()
        return [word[a:b] for a, b in zip([0, *cuts], [*cuts, len(word)], strict=True)]

    def merge(self, words: list[bytes]) -> list[bytes]:
        """Ids of each non-empty word, as little-endian unsigned 32-bit integers."""
        pieces = [self._pieces(w) for w in words]
        ids = dict.fromkeys(p for x in pieces for p in x)
        part, size = [], 0
        for p in sorted(ids, key=len):
            if part and (size + len(p) > QUERY_BYTES or len(part[0]) <= LONG < len(p)):
                ids.update(zip(part, self._merge_part(part), strict=True))
                part, size = [], 0
            if len(p) > CHUNK:
                ids[p] = self._merge_long(p)
                continue
            part.append(p)
            size += len(p)
        if part:
            ids.update(zip(part, self._merge_part(part), strict=True))
        return [ids[x[0]] if len(x) == 1 else b"".join([ids[p] for p in x]) for x in pieces]

    def _merge_part(self, part: list[bytes]) -> list[bytes]:
        """Ids of words that are all of up to LONG bytes, or all longer."""
        w, pos = self._rows(np.fromiter(map(len, part), np.int64, len(part)))
        tok = self.byte[np.frombuffer(b"".join(part), np.uint8)]
        self.db.register("start", pa.table({"w": w, "pos": pos, "tok": tok}))
        got = self.db.execute(_ENCODE_LONG if len(part[-1]) > LONG else _ENCODE).fetchnumpy()
        self.db.unregister("start")
        ids = np.asarray(got["tok"]).astype("<u4").tobytes()
        ends = 4 * np.cumsum(np.bincount(got["w"], minlength=len(part)))
        return [ids[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]

    def _merge_long(self, word: bytes) -> bytes:
        """Piece by piece, each behind as many of the tokens before it as its first token needs."""
        ids: list[int] = []
        for at in range(0, len(word), CHUNK):
            back = BACK
            while True:
                tail = ids[-back:]
                new = np.frombuffer(self._merge_part([b"".join([self.token[t] for t in tail]) + word[at : at + CHUNK]])[0], "<u4").tolist()
                if back >= len(ids):
                    break
                pair = [ids[-back - 1], new[0]]
                if np.frombuffer(self._merge_part([self.token[pair[0]] + self.token[pair[1]]])[0], "<u4").tolist() == pair:
                    break
                back *= MORE
            ids[len(ids) - len(tail) :] = new
        return np.array(ids, "<u4").tobytes()

    def decode(self, sequences: list[bytes]) -> list[bytes]:
        """Bytes of each sequence of ids (little-endian unsigned 32-bit integers)."""
        w, pos = self._rows(np.fromiter(map(len, sequences), np.int64, len(sequences)) // 4)
        out = [b""] * len(sequences)
        if len(w):
            tok = np.frombuffer(b"".join(sequences), "<u4").astype(np.int64)
            self.db.register("ids", pa.table({"w": w, "pos": pos, "tok": tok}))
            for k, text in self.db.execute(_DECODE).fetchall():
                out[k] = bytes.fromhex(text)
            self.db.unregister("ids")
        return out

    def learn(self, words: set[str]) -> None:
        """Encode and decode the words that are not known yet."""
        if self.held > CACHE_BYTES:
            self.ids.clear()
            self.bytes.clear()
            self.held = 0
        raw = {w: w.encode() for w in words if w not in self.ids}
        self.held += sum(KEPT + 8 * len(b) for b in raw.values())
        whole = {w: np.array([self.ranks[b]], "<u4").tobytes() for w, b in raw.items() if b in self.ranks}
        rest = [w for w in raw if w not in whole]
        self.ids.update(whole)
        self.ids.update(zip(rest, self.merge([raw[w] for w in rest]), strict=True))
        new, size = [], 0
        for s in {self.ids[w] for w in raw}:
            if s not in self.bytes:
                new.append(s)
                size += len(s)
                if size > 4 * QUERY_BYTES:
                    self.bytes.update(zip(new, self.decode(new), strict=True))
                    new, size = [], 0
        if new:
            self.bytes.update(zip(new, self.decode(new), strict=True))

    def encode_batch(self, texts: list[str]) -> list[list[bytes]]:
        """For each text the ids of its words, in order."""
        words = [self.find(t) for t in texts]
        self.learn(set().union(*words))
        ids = self.ids
        return [[ids[w] for w in x] for x in words]

    def encode_long(self, text: str):
        """Lists of the ids of a long text's words, in order, BLOCK words each."""
        words = (m.group() for m in self.each(text))
        while block := list(islice(words, BLOCK)):
            self.learn(set(block))
            yield [self.ids[w] for w in block]


def _coder(path, pattern) -> DuckBpe:
    kept = _per_worker()
    return kept.get(("bpe", path, pattern)) or kept.setdefault(("bpe", path, pattern), DuckBpe(path, pattern))


def _digest_batches(path, pattern, with_ids):
    def run(batches):
        coder = _coder(path, pattern)

        def digests(blocks):
            """Of one text: number of ids, digests of ids and bytes, and these themselves if they are asked for."""
            n, a, b, ids, text = 0, hashlib.sha256(), hashlib.sha256(), [], []
            for parts in blocks:
                x, y = b"".join(parts), b"".join([coder.bytes[p] for p in parts])
                n += len(x) // 4
                a.update(x)
                b.update(y)
                if with_ids:
                    ids.append(x)
                    text.append(y)
            return n, a.hexdigest(), b.hexdigest(), b"".join(ids), b"".join(text)

        def flush(keys, texts, kind):
            rows = [digests(coder.encode_long(texts[0]))] if len(texts) == 1 else [digests([x]) for x in coder.encode_batch(texts)]
            n, a, b, ids, text = zip(*rows, strict=True)
            columns = [pa.array(keys, kind), pa.array(n, pa.int64()), pa.array(a), pa.array(b)]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                columns += [pa.array(ids, pa.binary()), pa.array(text, pa.binary())]
                names += ["ids", "decoded"]
            return pa.RecordBatch.from_arrays(columns, names=names)

        keys, texts, gathered, kind = [], [], 0, None
        for batch in batches:
            kind = batch.column("doc_id").type
            for key, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                text = text.as_py() or ""
                if keys and gathered + len(text) > GATHER:
                    yield flush(keys, texts, kind)
                    keys, texts, gathered = [], [], 0
                keys.append(key)
                texts.append(text)
                gathered += len(text)
        if keys:
            yield flush(keys, texts, kind)

    return run


def encode(docs: DataFrame, path: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """One row per input row: ``doc_id, n_tokens, ids_sha256, decoded_sha256`` (and ``ids, decoded``).

    A null or empty text has no token and the digests of no bytes. Strings of special tokens are ordinary
    text. Repeated rows give repeated results, other columns are ignored, an empty table gives an empty
    result. Words may be of any length.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids binary, decoded binary" if with_ids else "")
    return in_batches(docs.select("doc_id", "text")).mapInArrow(_digest_batches(path, pattern, with_ids), schema)


def op4_bpe(spark, sf_dir):
    import public_tokenizers

    return encode(load(spark, sf_dir, "documents"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN)
