"""Booking admission as requests arrive: ``readStream`` of request files → ``foreachBatch`` → ``admit_bookings``.

Each micro-batch is one ``admit_bookings`` call against the bookings table as
it stands — the stored bookings plus everything admitted by earlier
micro-batches — so a request arriving later is checked against earlier
admissions exactly as the reference checks each POST against the rows
already inserted. Inside a batch, requests are taken in request_id order.

The sink is idempotent: epoch N writes ``{out}/bookings/batch=N`` and
``{out}/rejected/batch=N`` with overwrite, and reads only ``batch < N``, so
re-running an epoch after a failure reproduces the same files. Progress
lives in the query's checkpoint location (shared storage on a cluster).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from slotwise.operators.changes import admit_bookings
from slotwise.sources.tables import Tables, conform, read_if_present


def _admitted_before(spark: SparkSession, out_dir: str, epoch: int) -> DataFrame | None:
    prior = read_if_present(spark, f"{out_dir}/bookings")
    return None if prior is None else prior.filter(F.col("batch") < epoch).drop("batch")


def admit_stream(spark: SparkSession, t: Tables, requests_dir: str, request_schema, out_dir: str,
                 checkpoint_location: str, strict: bool = False, files_per_batch: int | None = None,
                 available_now: bool = True) -> StreamingQuery:
    """Start the admission stream; returns the running query (``availableNow`` drains and stops)."""
    reader = spark.readStream.schema(request_schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    requests = reader.parquet(requests_dir)

    def apply(batch: DataFrame, epoch: int) -> None:
        prior = _admitted_before(spark, out_dir, epoch)
        bookings = t.bookings if prior is None else t.bookings.unionByName(conform(prior, "bookings").select(
            *t.bookings.columns), allowMissingColumns=True)
        res = admit_bookings(t.replace(bookings=bookings), batch, strict=strict)
        res.bookings.write.mode("overwrite").parquet(f"{out_dir}/bookings/batch={epoch}")
        res.rejected.write.mode("overwrite").parquet(f"{out_dir}/rejected/batch={epoch}")

    writer = requests.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint_location)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    return writer.start()
