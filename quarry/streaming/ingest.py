"""Documents that keep arriving: new Markdown files join an index as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quarry.plans.evidence import Models, append
from quarry.sources.config import Settings
from quarry.sources.files import base_name


def follow(spark: SparkSession, settings: Settings, folder: str, checkpoint: str, models: Models = Models(), once: bool = True) -> StreamingQuery:
    """Adds every new Markdown file of ``folder`` to the index's chunks.

    A batch that is run again adds nothing twice, because chunks are told by their content's place.  ``once`` ends
    when all files that are there have been read.
    """
    lines = spark.readStream.format("text").option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").load(folder)
    docs = lines.select(F.col("_metadata.file_path").alias("source"), F.lit(None).cast("int").alias("page"), F.lit(base_name(folder)).alias("knowledge_base"), F.col("value").alias("text"))

    def add(batch: DataFrame, _: int) -> None:
        append(batch.sparkSession, settings.index.rstrip("/"), batch, settings, models)

    writer = docs.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
