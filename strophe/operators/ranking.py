"""Merging metadata hits and lyric hits under one total order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scoring import priority
from ..schema import PERFECT

#: Rank of a hit without a lyric match; fixed value.
NO_RANK = 1000.0


def merge(songs: DataFrame, meta: DataFrame, lyric: DataFrame, explicit: bool, full_metadata: bool = False) -> DataFrame:
    """``id, timestamp, score, rank, field, snippet, priority``, unordered; one join.

    ``meta`` has ``id, timestamp, score``; ``lyric`` has ``id, rank, field, snippet`` and, where it comes from
    the catalogue itself, ``timestamp``. If lyrics were asked for, hits must be in both; when metadata hits
    are as many as songs (``full_metadata``), every lyric hit counts as perfect. Otherwise hits of either
    side are united, and a lyric hit without metadata scores 0. Lyric hits without a timestamp take it from
    ``songs``; those whose song is not in the catalogue are dropped.
    """
    if "timestamp" not in lyric.columns:
        lyric = lyric.join(songs.select("id", "timestamp"), "id")
    if explicit and full_metadata:
        out = lyric.withColumn("score", F.lit(PERFECT))
    elif explicit:
        out = lyric.join(meta.select("id", "score"), "id")
    else:
        named = meta.select("id", F.col("timestamp").alias("meta_timestamp"), "score")
        out = named.join(lyric, "id", "full").withColumns(
            {"timestamp": F.coalesce("meta_timestamp", "timestamp"), "score": F.coalesce("score", F.lit(0))}
        )
    bucket = priority(F.col("score"), F.col("field").isNotNull(), F.coalesce(F.col("field") == "MainLyric", F.lit(False)))
    return out.select("id", "timestamp", "score", "rank", "field", "snippet", bucket.alias("priority"))


ORDER = (F.desc, "priority"), (F.asc, "rank"), (F.desc, "score"), (F.desc, "timestamp"), (F.asc, "id")


def ordered(hits: DataFrame) -> DataFrame:
    """Priority first, then lyric rank, score, newest, smallest id."""
    keys = [f(F.coalesce("rank", F.lit(NO_RANK))) if c == "rank" else f(c) for f, c in ORDER]
    return hits.orderBy(*keys)
