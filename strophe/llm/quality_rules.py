"""Quality rules by distribution divergence.

Two histograms of a document are compared with those of its language by Jensen-Shannon distance: character
classes, and common words with everything else in one bin. The references come from all documents of the
language; a word is common if it makes up at least ``COMMON_SHARE`` of the language's words, so there are
at most 1/COMMON_SHARE of them. Documents too short for a histogram are not judged by it.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_batches, load, materialise
from .simhash import word_slices

SYMBOLS = "#*$%&|<>"
COMMON_SHARE = 0.002
#: Largest distances that pass, and the least characters and words for them to count.
MAX_CLASS_DISTANCE, MIN_CHARS = 0.28, 300
MAX_WORD_DISTANCE, MIN_WORDS = 0.36, 100
MIN_BASE_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: The key of the reference over all documents, for those without a language.
ALL = ""
CLASSES = ("lower", "upper", "digit", "space", "newline", "stop", "quote", "symbol", "other")
_STRIP = regex.compile(r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$")
#: Bytes of a word from which its form is counted by a digest, and different words that a task counts before it passes them on.
LONG_WORD, _FLUSH = 64, 500_000
#: Characters of a text that are classed at a time.
SLICE = 1 << 20


def _class_table() -> np.ndarray:
    """Class of each code point below 0x3000 by its properties; those above count as lower (letters) or other."""
    out = np.full(0x3000, 8, np.uint8)
    for i in range(0x3000):
        c = chr(i)
        if c.isalpha():
            out[i] = 1 if c.isupper() else 0
        elif c.isnumeric():
            out[i] = 2
        elif c in "\n\r":
            out[i] = 4
        elif c.isspace():
            out[i] = 3
        elif c in ".,;:?!":
            out[i] = 5
        elif c in "'\"()-’“”«»„":
            out[i] = 6
        elif c in SYMBOLS:
            out[i] = 7
    return out


_TABLE = _class_table()


def class_counts(text: str) -> np.ndarray:
    out = np.zeros(len(CLASSES), np.int64)
    for at in range(0, len(text), SLICE):
        points = np.frombuffer(text[at : at + SLICE].encode("utf-32-le", "surrogatepass"), "<u4")
        low = points < 0x3000
        out += np.bincount(_TABLE[points[low]], minlength=len(CLASSES))
        if not low.all():
            high = [chr(p).isalpha() for p in points[~low].tolist()]
            out[0] += sum(high)
            out[8] += len(high) - sum(high)
    return out


def common_form(word: bytes) -> str:
    """The word in lower case without marks at its ends; of a long word a digest of that, which begins as no form does."""
    form = _STRIP.sub("", word.decode("utf-8", "surrogatepass").lower())
    return form if len(word) <= LONG_WORD else "#" + xxhash.xxh3_128_hexdigest(form.encode("utf-8", "surrogatepass")) if form else ""


def counted(words: list[bytes]):
    """What is counted for each word until forms are made: the word, or for a long one its form behind a byte that begins none."""
    for w in words:
        yield w if len(w) <= LONG_WORD else b"\xff" + common_form(w).encode()


def js_distance(p: np.ndarray, q: np.ndarray) -> float:
    """Square root of the Jensen-Shannon divergence in bits, 0 to 1; counts are scaled to distributions."""
    if not p.sum() or not q.sum():
        return 1.0
    p, q = p / p.sum(), q / q.sum()
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        d = np.where(p > 0, p * np.log2(p / m), 0).sum() + np.where(q > 0, q * np.log2(q / m), 0).sum()
    return float(np.sqrt(max(0.0, d / 2)))


def numbered(text: str) -> tuple[np.ndarray, dict[bytes, int]]:
    """The words of a text as numbers, and the number of each word; only a slice's words are held at a time."""
    known: dict[bytes, int] = {}
    parts = [np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words)) for words in word_slices(text.encode("utf-8", "surrogatepass"))]
    return np.concatenate(parts) if parts else np.zeros(0, np.int64), known


def repeated_words(ids: np.ndarray, size: int = 3) -> int:
    """Words, given as numbers, that lie in a window of ``size`` words found at least twice."""
    n = len(ids) - size + 1
    if n < 2:
        return 0
    code, base = ids[:n], int(ids.max()) + 1
    for k in range(1, size):
        code = np.unique(code * base + ids[k : k + n], return_inverse=True)[1]
    again = np.bincount(code)[code] > 1
    covered = np.zeros(len(ids), bool)
    for k in range(size):
        covered[k : k + n] |= again
    return int(covered.sum())


def base_figures(text: str, ids: np.ndarray) -> tuple[int, int, int, int]:
    """word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    seen, dup = set(), 0
    for line in text.split("\n"):
        if line.strip(" \t\n\x0b\x0c\r"):
            dup += line in seen
            seen.add(line)
    chars = len(text) - sum(text.count(c) for c in " \t\n\x0b\x0c\r")
    return chars, sum(text.count(c) for c in SYMBOLS), dup, repeated_words(ids)


def _reference_batches(batches):
    """Rows (lang, kind, key, n): character classes and words, summed within bounded memory."""
    classes: dict[str, np.ndarray] = {}
    words: dict[str, Counter] = {}

    def flush():
        rows = [(g, "class", CLASSES[i], int(n)) for g, c in classes.items() for i, n in enumerate(c) if n]
        rows += [(g, "word", w, n) for g, c in words.items() for w, n in c.items()]
        classes.clear()
        words.clear()
        g, kind, key, n = zip(*rows, strict=True) if rows else ((), (), (), ())
        return pa.RecordBatch.from_arrays([pa.array(g, pa.string()), pa.array(kind, pa.string()), pa.array(key, pa.string()), pa.array(n, pa.int64())], names=["lang", "kind", "key", "n"])

    for b in batches:
        for lang, text in zip(b.column("lang").to_pylist(), b.column("text"), strict=True):
            text = text.as_py()
            if not text:
                continue
            lang = lang or ALL
            classes[lang] = classes.get(lang, 0) + class_counts(text)
            counter = words.setdefault(lang, Counter())
            for some in word_slices(text.encode("utf-8", "surrogatepass")):
                counter.update(some if max(map(len, some), default=0) <= LONG_WORD else counted(some))
        if sum(map(len, words.values())) > _FLUSH:
            words = {g: _formed(c) for g, c in words.items()}
            yield flush()
    words = {g: _formed(c) for g, c in words.items()}
    yield flush()


def _formed(counts: Counter) -> Counter:
    out: Counter = Counter()
    for w, n in counts.items():
        out[w[1:].decode() if w[:1] == b"\xff" else common_form(w)] += n
    return out


class References:
    """Histograms by language; ALL is their sum."""

    def __init__(self, rows: list[tuple[str, str, str, int]], totals: dict[str, int]):
        self.classes: dict[str, np.ndarray] = {}
        self.words: dict[str, dict[str, int]] = {}
        self.histograms: dict[str, np.ndarray] = {}
        counts: dict[str, dict[str, int]] = {}
        for g, kind, key, n in rows:
            if kind == "class":
                self.classes.setdefault(g, np.zeros(len(CLASSES)))[CLASSES.index(key)] = n
            elif key:
                counts.setdefault(g, {})[key] = n
        for g, c in counts.items():
            self.words[g] = {w: i for i, w in enumerate(sorted(c))}
            bins = [c[w] for w in sorted(c)]
            self.histograms[g] = np.array([*bins, totals[g] - sum(bins)], float)


def references(docs: DataFrame, share: float = COMMON_SHARE) -> References:
    """Corpus references, from every row; only classes and common words of each language are collected."""
    counted = in_batches(docs).select("lang", "text").mapInArrow(_reference_batches, "lang string, kind string, key string, n long")
    per = materialise(counted.groupBy("lang", "kind", "key").agg(F.sum("n").alias("n")), "word-counts")
    every = per.groupBy("kind", "key").agg(F.sum("n").alias("n")).select(F.lit(ALL).alias("lang"), "kind", "key", "n")
    per = per.filter(F.col("lang") != ALL).unionByName(every)
    totals = {r["lang"]: r["n"] for r in per.filter("kind = 'word'").groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    if not totals:
        return References([], {})
    limit = docs.sparkSession.createDataFrame([(g, n * share) for g, n in totals.items()], "lang string, least double")
    common = per.join(F.broadcast(limit), "lang").filter("kind = 'class' or n >= least")
    rows = [(r["lang"], r["kind"], r["key"], r["n"]) for r in common.collect()]
    return References(rows, totals)


def distances(text: str, ids: np.ndarray, known: dict[bytes, int], lang: str | None, ref: References) -> tuple[float | None, float | None]:
    """Distances of the character classes and of the common words; None where the text is too short."""
    g = lang if lang in ref.classes else ALL
    by_class = js_distance(class_counts(text), ref.classes[g]) if len(text) >= MIN_CHARS and g in ref.classes else None
    by_word = None
    if len(ids) >= MIN_WORDS and g in ref.words:
        at, counts = ref.words[g], np.zeros(len(ref.words[g]) + 1)
        bins = np.fromiter((at.get(common_form(w), -1) for w in known), np.int64, len(known))
        np.add.at(counts, bins, np.bincount(ids, minlength=len(known)))
        by_word = js_distance(counts, ref.histograms[g])
    return by_class, by_word


def _judge_batches(ref: References):
    def run(batches):
        for b in batches:
            out = []
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text"), strict=True):
                text = text.as_py() or ""
                ids, known = numbered(text)
                chars, symbols, dup, repeat = base_figures(text, ids)
                failed = len(ids) < MIN_BASE_WORDS or 100 * repeat > MAX_REPEAT_PERCENT * len(ids)
                a, c = distances(text, ids, known, lang, ref)
                kept = not failed and (a is None or a <= MAX_CLASS_DISTANCE) and (c is None or c <= MAX_WORD_DISTANCE)
                out.append((len(ids), chars, symbols, dup, repeat, failed, kept, a, c))
            kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()] * 2
            columns = zip(*out, strict=True) if out else [()] * 9
            arrays = [b.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", *_NAMES])

    return run


_NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "class_distance", "word_distance")


def judge(docs: DataFrame, ref: References) -> DataFrame:
    """The base figures, ``base_failed``, ``kept`` and both distances for each row.

    A null text has no words, hence fails. A null or unknown lang is compared with the reference over all
    languages. A distance is null where the text is too short for it. Repeated rows get equal results,
    other columns are ignored, an empty table gives an empty result.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, class_distance double, word_distance double"
    return in_batches(docs.select("doc_id", "lang", "text")).mapInArrow(_judge_batches(ref), schema)


def op5_quality_rules(spark, sf_dir):
    docs = load(spark, sf_dir, "documents")
    return judge(docs, references(docs))
