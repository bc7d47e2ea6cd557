"""Pages that arrive as files, indexed as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gleanery import storage
from gleanery.operators import incremental
from gleanery.operators import index as ix


def follow(spark: SparkSession, folder: str, root: str, checkpoint: str, *, fmt: str = "parquet", once: bool = True) -> StreamingQuery:
    """Index new (filename, text) rows under ``folder`` into the index published at ``root``, a version a batch.

    A batch that is tried again finds its pages there and adds nothing, so a failure between the publication and the
    checkpoint does no harm.
    """

    def take(batch: DataFrame, _: int) -> None:
        session = batch.sparkSession
        with storage.scope():
            if storage.current_version(session, root) is None:
                ix.build(batch.dropDuplicates(["filename"])).publish(root)
                return
            old = ix.Index.read(session, root)
            new = incremental.append(old, batch)
            if new is not old:
                new.publish(root)

    stream = spark.readStream.format(fmt).schema("filename string, text string").load(folder)
    writer = stream.where(F.col("filename").isNotNull()).writeStream.foreachBatch(take).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
