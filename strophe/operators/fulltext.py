"""Phrase search in lyrics with trigram semantics and column-weighted BM25.

A catalogue's :class:`TextIndex` finds and ranks phrases without reading texts. The forms here read all texts;
they state the rule, serve catalogues without an index, and cut the snippets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lyrics import exact_snippet, quoted, snippet
from ..functions.text import simplify_text
from .textindex import K1, MIN_CHARS, WEIGHTS, B, TextIndex

MAIN_WEIGHT, BACKGROUND_WEIGHT = WEIGHTS
#: Ids that are pushed to the scan of the texts.
PUSHED = 1000


def matches(text: Column, keyword: str) -> Column:
    """Case-folded containment of a phrase of at least three characters."""
    return F.contains(F.lower(text), F.lit(keyword.lower())) if len(keyword) >= MIN_CHARS else F.lit(False)


def occurrences(text: Column, keyword: str) -> Column:
    """Overlapping occurrences, case-folded."""
    return F.regexp_count(F.lower(text), F.lit(f"(?={quoted(keyword.lower())})"))


def trigrams(text: Column) -> Column:
    return F.greatest(F.char_length(text) - 2, F.lit(0)).cast("long")


def corpus_statistics(docs: DataFrame, keyword: str) -> DataFrame:
    """One row: documents, mean length in trigrams, documents with the phrase; a single aggregate."""
    hit = matches(F.col("lyric_text"), keyword) | matches(F.col("bg_vocal_text"), keyword)
    length = trigrams(F.col("lyric_text")) + trigrams(F.col("bg_vocal_text"))
    return docs.agg(F.count(F.lit(1)).alias("n_docs"), F.sum(length).alias("total"), F.count_if(hit).alias("n_hits")).select(
        "n_docs", (F.col("total") / F.col("n_docs")).alias("mean_length"), "n_hits"
    )


def bm25(docs: DataFrame, keyword: str, statistics: DataFrame | None = None) -> DataFrame:
    """Hits with ``rank`` (negative, smaller is better), unordered; input columns are kept."""
    statistics = corpus_statistics(docs, keyword) if statistics is None else statistics
    idf = F.log((F.col("n_docs") - F.col("n_hits") + 0.5) / (F.col("n_hits") + 0.5))
    idf = F.when(idf <= 0, 1e-6).otherwise(idf)
    f = occurrences(F.col("lyric_text"), keyword) * MAIN_WEIGHT + occurrences(F.col("bg_vocal_text"), keyword) * BACKGROUND_WEIGHT
    length = trigrams(F.col("lyric_text")) + trigrams(F.col("bg_vocal_text"))
    rank = -idf * (F.col("f") * (K1 + 1)) / (F.col("f") + K1 * (1 - B + B * F.col("d") / F.col("mean_length")))
    hits = docs.filter(matches(F.col("lyric_text"), keyword) | matches(F.col("bg_vocal_text"), keyword))
    scored = hits.withColumns({"f": f, "d": length}).crossJoin(F.broadcast(statistics))  # an aggregate's one row
    return scored.withColumn("rank", rank).select(*docs.columns, "rank")


def search(docs: DataFrame, keyword: str, limit: int, exact: bool = False, index: TextIndex | None = None) -> DataFrame:
    """The best ``limit`` hits: ``id, timestamp, rank, field, snippet``; ties by id.

    ``field`` is MainLyric unless only the background text has a line with the phrase; a phrase across
    lines has no snippet. ``exact`` takes the Arrow path for snippets, which differs only where
    lower-casing changes a text's length; it runs on the best hits alone. With ``index``, which must be that of
    ``docs``, hits are found and ranked from its postings, and texts are read for the best hits, whose ids and ranks
    pass through the driver; without it, all texts are read.
    """
    keyword = simplify_text(keyword)
    docs = docs.select("id", "timestamp", "lyric_text", "bg_vocal_text")
    if len(keyword.strip()) == 0:
        return docs.select("id", "timestamp", F.lit(0.0).alias("rank"), F.lit("").alias("field"), F.lit("").alias("snippet")).limit(0)
    if index is None:
        top = bm25(docs, keyword).orderBy("rank", "id").limit(limit)
    else:
        best = index.top(docs.sparkSession, keyword, limit)
        ranks = docs.sparkSession.createDataFrame(best, "best_id long, rank double")
        wanted = docs.filter(F.col("id").isin([i for i, _ in best])) if len(best) <= PUSHED else docs
        top = wanted.join(F.broadcast(ranks) if len(best) <= PUSHED else ranks, F.col("id") == F.col("best_id")).drop("best_id")
    cut = exact_snippet(keyword) if exact else lambda c: snippet(F.col(c), keyword)
    top = top.withColumns({"in_main": cut("lyric_text"), "in_bg": cut("bg_vocal_text")})
    field = F.when(F.col("in_main").isNull() & F.col("in_bg").isNotNull(), "BackgroundVocal").otherwise("MainLyric")
    return top.select("id", "timestamp", "rank", field.alias("field"), F.coalesce("in_main", "in_bg").alias("snippet")).orderBy("rank", "id")
