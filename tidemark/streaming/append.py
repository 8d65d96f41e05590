"""Appending runs that survive a restart: every batch is written once, whatever fails in between.

Each micro-batch is written to a folder of its own and then entered in the
manifest. A batch that is replayed, because a run ended between the two or
before the stream's checkpoint was committed, overwrites its own folder, and one
that is in the manifest already is skipped. Readers see the batches of the
manifest only, so neither halves nor repeats show.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "batch_id long, n_rows long"


def manifest(spark: SparkSession, sink: str) -> DataFrame:
    """``batch_id, n_rows`` of the batches that are complete."""
    spark.createDataFrame([], MANIFEST).write.mode("append").json(f"{sink}/manifest")
    return spark.read.schema(MANIFEST).json(f"{sink}/manifest").distinct()


def append_available(spark: SparkSession, source_dir: str, schema: str, transform: Callable[[DataFrame], DataFrame], sink: str,
                     fmt: str = "parquet", after_write: Callable[[int], None] | None = None) -> None:
    """Append what arrived under ``source_dir`` since the last complete run, then stop.

    ``after_write(batch_id)`` runs between a batch's rows and its manifest entry; it may fail, as a lost driver would.
    """
    def append(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        if manifest(session, sink).where(F.col("batch_id") == batch_id).count():
            return
        batch.write.mode("overwrite").parquet(f"{sink}/rows/batch={batch_id}")
        if after_write:
            after_write(batch_id)
        n = session.read.parquet(f"{sink}/rows/batch={batch_id}").count()
        session.createDataFrame([(batch_id, n)], MANIFEST).write.mode("append").json(f"{sink}/manifest")

    stream = transform(spark.readStream.schema(schema).format(fmt).load(source_dir))
    query = (stream.writeStream.foreachBatch(append).option("checkpointLocation", f"{sink}/progress")
             .trigger(availableNow=True).start())
    query.awaitTermination()


def committed(spark: SparkSession, sink: str) -> DataFrame:
    """The rows of all complete batches, with their ``batch``."""
    done = manifest(spark, sink).select(F.col("batch_id").alias("batch"))
    return spark.read.parquet(f"{sink}/rows").join(F.broadcast(done), "batch", "left_semi")
