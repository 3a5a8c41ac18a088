"""Substring deduplication by hashing lines and the clauses within them.

Every text is cut into units at line ends, after clause punctuation and, in long clauses, at anchors that
the words near them decide, so that a passage is cut alike wherever it begins. Marks that end fewer than
``UNIT_WORDS`` words since the last don't cut. Every unit with a word is normalised (lower case, single
spaces) and hashed. Digests are grouped over the whole corpus; the occurrence with the smallest rank
(doc_id, text hash, unit number) is kept, others may go. A run of such units in a document goes, with the
empty lines in it, if it has at least ``RUN_WORDS`` words, so repeated passages are found even where they
stand inside other text, while short stock phrases stay. Whole lines of ``LINE_WORDS`` words or more have
digests of their own, and each later occurrence of such a line goes, whatever stands beside it. Characters
of scripts without spaces count as words. Offsets of all that is removed are returned.

Digests have 128 bits and are counted with pre-aggregation. Only units that a sieve for repeated digests
passes are shuffled again to meet their first occurrence; the at most HOT_SHARE digests that hold a larger
part of the units than 1/HOT_SHARE meet it by broadcast. Only texts with enough removable words travel to
be cut. One document's unit numbers are the largest group.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .common import in_batches, load, materialise, sieved, unused

UNIT_WORDS = 4
RUN_WORDS = 20
LINE_WORDS = 1
HOT_SHARE = 1024
#: Added to the number of a line's first unit, the number of the line; longer lines go by the run rule.
LINE = 1 << 30
#: A clause of more words is cut at anchors too: before a word whose hash with the word before it is the
#: least of the REACH on either side. Where none comes for GAP words, every STEP words.
ANCHORED, REACH, GAP, STEP = 12, 3, 24, 16
_CLOSE = "[\"'”’»)\\]」』）】]*"
_UNIT = re.compile(
    rf"(?:[^\n.,;:?!。，、；：？！．｡､…]+|[.,;:?!](?!{_CLOSE}\s))*+(?:[.,;:?!]{_CLOSE}(?=\s)|[。，、；：？！．｡､…]+{_CLOSE}|\n|\Z)"
)
#: Scripts that are written without spaces; each of their characters counts as a word.
_SPACELESS = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
_IS_SPACELESS = re.compile(f"[{_SPACELESS}]")
_WORD, _TOKEN = re.compile(r"\S+"), re.compile(rf"[{_SPACELESS}]|[^\s{_SPACELESS}]+")


def words_of(text: str) -> list[str]:
    """Words between white space; in scripts without spaces, characters."""
    return _TOKEN.findall(text) if not text.isascii() and _IS_SPACELESS.search(text) else text.split()


def anchors(words: list[str]) -> list[int]:
    """Numbers of the words before which a clause is cut; what is near a word alone decides, save in a gap."""
    n = len(words)
    if n <= ANCHORED:
        return []
    digest = xxhash.xxh32_intdigest
    h = [0, *[digest(f"{v} {w}".encode("utf-8", "surrogatepass")) for v, w in zip(words, words[1:])]]
    out, last = [], 0
    for i in range(UNIT_WORDS, n - UNIT_WORDS + 1):
        x = h[i]
        if x < h[i - 1] and x < min(h[max(1, i - REACH) : i]) and x < min(h[i + 1 : i + 1 + REACH], default=x + 1):
            if i - last > GAP:
                out += range(last + STEP, i - UNIT_WORDS + 1, STEP)
            out.append(i)
            last = i
    if n - last > GAP:
        out += range(last + STEP, n - UNIT_WORDS + 1, STEP)
    return out


def _clauses(text: str) -> list[tuple[int, int]]:
    """Spans that end after a line end, or after a mark that ends ``UNIT_WORDS`` words since the mark before it."""
    out, at, begin = [], 0, 0  # begin: of the line
    for m in _UNIT.finditer(text):
        a, b = m.span()
        if a == b:
            break
        ends = text[b - 1] == "\n"
        if not ends and b < len(text) and (b - a < UNIT_WORDS or len(words_of(text[a:b])) < UNIT_WORDS):
            continue
        if (ends or b == len(text)) and at > begin and len(words_of(text[at:b])) < UNIT_WORDS:
            at = out.pop()[0]  # a short end of a line belongs to what stands before it
        out.append((at, b))
        at = b
        if ends:
            begin = b
    return out


def units(text: str) -> list[tuple[int, int]]:
    """Spans that cover the text: clauses, cut at anchors; only lines of their own have under ``UNIT_WORDS`` words."""
    out, spaceless = [], not text.isascii() and _IS_SPACELESS.search(text)
    token, least = (_TOKEN, ANCHORED) if spaceless else (_WORD, 2 * ANCHORED)  # fewer characters can't hold so many words
    for a, b in _clauses(text):
        if b - a > least:
            starts = [w.start() for w in token.finditer(text, a, b)]
            if len(starts) > ANCHORED:
                for i in anchors(token.findall(text[a:b].lower())):
                    out.append((a, starts[i]))
                    a = starts[i]
        out.append((a, b))
    return out


def _digest(words: list[str], seed: int = 0) -> bytes:
    return xxhash.xxh3_128_digest(" ".join(words).encode("utf-8", "surrogatepass"), seed)


def _hashed(text: str, line_words: int) -> list[tuple[int, int, bytes]]:
    """Number, words and digest of every unit with a word, and of whole lines that the run rule doesn't reach."""
    out, line, begin = [], [], 0
    spans = units(text)
    for i, (a, b) in enumerate(spans):
        words = words_of(text[a:b].lower())
        if words:
            out.append((i, len(words), _digest(words)))
        line += words
        if text[b - 1] == "\n" or i == len(spans) - 1:
            if line_words <= len(line) < RUN_WORDS and line:
                out.append((LINE + begin, len(line), _digest(line, 1)))
            line, begin = [], i + 1
    return out


def _unit_batches(line_words):
    def run(batches):
        for b in batches:
            rows, numbers, words, digests = [], [], [], []
            for r, text in enumerate(b.column("text")):
                found = _hashed(text.as_py() or "", line_words)
                rows += [r] * len(found)
                numbers += [x[0] for x in found]
                words += [min(x[1], RUN_WORDS) for x in found]
                digests += [x[2] for x in found]
            at = pa.array(rows, pa.int32())
            halves = np.frombuffer(b"".join(digests), ">i8").astype(np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").take(at), b.column("k").take(at), pa.array(numbers, pa.int32()), pa.array(words, pa.int16()), pa.array(halves[:, 0]), pa.array(halves[:, 1])],
                names=["doc_id", "k", "unit", "words", "hi", "lo"],
            )

    return run


def removed_spans(text: str, removable: list[int]) -> list[tuple[int, int]]:
    """Spans of the runs of removable units that are long enough, and of removable lines outside them."""
    spans, gone = units(text), set(removable)
    whole, inside = [], False
    for i, (a, b) in enumerate(spans):
        inside = inside or LINE + i in gone
        whole.append(inside)
        inside = inside and text[b - 1] != "\n"
    out, run, words = [], [], 0
    for i, (a, b) in enumerate(spans):
        n = len(words_of(text[a:b]))
        if i in gone or whole[i] or (run and not n):
            run.append(i)
            words += n
        elif run:
            out.append((run, words))
            run, words = [], 0
    if run:
        out.append((run, words))
    result = []
    for run, words in out:
        while run[-1] not in gone and not whole[run[-1]]:  # empty lines at the end belong to what follows
            run.pop()
        if words >= RUN_WORDS:
            result.append((spans[run[0]][0], spans[run[-1]][1]))
            continue
        before = None
        for i in run:
            if whole[i]:
                at = result.pop()[0] if before == i - 1 else spans[i][0]
                result.append((at, spans[i][1]))
                before = i
    return result


_CUT = "text string, removed array<struct<start:long,end:long>>"


def _cut(text: pd.Series, numbers: pd.Series) -> pd.DataFrame:
    texts, removed = [], []
    for t, n in zip(text, numbers, strict=True):
        spans = removed_spans(t, list(n)) if t is not None and n is not None and len(n) else []
        removed.append([{"start": a, "end": b} for a, b in spans])
        if spans:
            parts, at = [], 0
            for a, b in spans:
                parts.append(t[at:a])
                at = b
            t = "".join([*parts, t[at:]])
        texts.append(t)
    return pd.DataFrame({"text": texts, "removed": removed})


def _removable(found: DataFrame) -> DataFrame:
    """``doc_id, k, units`` of the documents in which enough words stand in later occurrences of units."""
    repeated = materialise(found.groupBy("hi", "lo").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "repeated-units")
    near = sieved(found, "hi", repeated.select("hi"))
    rank = F.struct("doc_id", "k", "unit")
    firsts = (
        near.groupBy("hi", "lo").agg(F.min(rank).alias("first"), F.max(rank).alias("last"), F.count(F.lit(1)).alias("n"))
        .filter("first < last").select("hi", "lo", "first", "n")
    )
    firsts = materialise(firsts, "first-units")
    hot = F.col("n") * HOT_SHARE > found.count()
    tagged = near.join(F.broadcast(firsts.filter(hot).drop("n")), ["hi", "lo"], "left")
    met = tagged.filter("first is not null").unionByName(tagged.filter("first is null").drop("first").join(firsts.filter(~hot).drop("n").hint("merge"), ["hi", "lo"]))
    return (
        met.filter(rank > F.col("first")).groupBy("k", "doc_id").agg(F.collect_set("unit").alias("units"), F.sum("words").alias("words"), F.max("unit").alias("most"))
        .filter((F.col("words") >= RUN_WORDS) | (F.col("most") >= LINE)).select("doc_id", "k", "units")
    )


def dedup_substrings(docs: DataFrame, line_words: int = LINE_WORDS) -> DataFrame:
    """The input's rows and columns with ``text`` cut, and ``removed``: spans in characters of the input text.

    Later occurrences of whole lines go from ``line_words`` words on; a larger value spares short lines.

    A null text stays null and has no span, an empty one stays empty. Rows that repeat doc_id and text
    count as one document and are cut alike; a null doc_id ranks first. Of ties in rank there are none
    else. Equal passages within one document are repeats too. If the input has a column ``removed``, the
    spans' column, which is always the last, is ``removed_``; an empty table gives an empty result.
    """
    k, doc, units_, cut, removed = unused(docs, "k", "unit_doc", "units", "cut", "removed")
    key = F.xxhash64("doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, k long, unit int, words smallint, hi long, lo long"
    found = materialise(in_batches(docs).select("doc_id", key.alias("k"), "text").mapInArrow(_unit_batches(line_words), schema), "units")
    removable = materialise(_removable(found), "removable").select(F.col("k").alias(k), F.col("doc_id").alias(doc), F.col("units").alias(units_))
    hashed = docs.withColumn(k, key)
    near = sieved(hashed, k, removable.select(k))
    joined = near.join(removable, (near[k] == removable[k]) & F.col("doc_id").eqNullSafe(F.col(doc)), "left").withColumn(cut, pandas_udf(_cut, _CUT)("text", units_))
    columns = [F.col(f"`{cut}`.text").alias(c) if c == "text" else F.col(f"`{c}`") for c in docs.columns]
    none = F.array().cast("array<struct<start:long,end:long>>")
    rest = sieved(hashed, k, removable.select(k), hit=False).select(*[F.col(f"`{c}`") for c in docs.columns], none.alias(removed))
    return joined.select(*columns, F.col(f"`{cut}`.removed").alias(removed)).unionByName(rest)


def op6_substring_dedup(spark, sf_dir):
    """doc_id, the cut text, the removed spans of the original text, and how many characters they hold."""
    out = dedup_substrings(load(spark, sf_dir, "documents"))
    chars = F.aggregate("removed", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return out.select("doc_id", "text", "removed", chars.alias("removed_chars"))
