"""Extension: index files that arrive in a folder drive ingestion, a micro-batch at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.catalogue import Busy, Catalogue, sync_once
from ..sources.index import parse_lines


def ingest_stream(spark: SparkSession, index_dir: str, catalogue: Catalogue, archive: str, checkpoint: str):
    """Run until the folder's index files are taken in; one query per checkpoint, so runs never overlap.

    The state that takes a batch's rows records its number under the checkpoint's name, so a batch that is repeated
    after a failure adds nothing and is not compared with the catalogue again. A batch that meets another sync fails,
    and is repeated by the next run.
    """

    def take(batch: DataFrame, number: int) -> None:
        lines = batch.select("value", F.monotonically_increasing_id().alias("seq"))
        if sync_once(catalogue, parse_lines(lines), archive=archive, batch=(checkpoint, number)).strategy == "busy":
            raise Busy("another sync runs")

    stream = spark.readStream.format("text").load(index_dir)
    query = stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
