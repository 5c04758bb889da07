"""A stream of fetched pages applied to a published manifest, batch by batch.

Every micro-batch is what a pull would be: envelopes become records, of equal pages the last in the batch stays, states
come from the current manifest, clean remote changes overwrite, conflicts wait for a person. Each batch is published as
a version of its own that carries the batch's number, so a batch that is run again after a failure is not applied twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopy.functions import canon, extract
from canopy.functions import patterns as P
from canopy.operators import merge, state
from canopy.sources import durable


def records_of(envelopes: DataFrame, dialect: P.Dialect = P.DEFAULT) -> DataFrame:
    """page_id, remote_text, remote_hash, title of ``envelopes(page_id, text, pos)``; of equal pages the last stays."""
    last = envelopes.groupBy("page_id").agg(F.max_by("text", "pos").alias("text"))
    parts = last.select("page_id", extract.body(F.col("text")).alias("body"), extract.title(F.col("text")).alias("title"))
    done = canon.canonical(parts, "body", "remote_text", "remote", F.coalesce("title", F.lit("")), dialect)
    return done.select("page_id", "title", "remote_text", canon.fingerprint(F.col("remote_text")).alias("remote_hash"))


def apply_batch(envelopes: DataFrame, batch: int, manifest_table: str, local_table: str, now: str, dialect: P.Dialect = P.DEFAULT) -> bool:
    """Apply one batch; False if the manifest already has it."""
    spark = envelopes.sparkSession
    manifest, local = durable.latest(spark, manifest_table), durable.latest(spark, local_table)
    if manifest.where(F.col("batch") >= batch).limit(1).count():
        return False
    read = records_of(envelopes, dialect)
    states = state.pull_classify(manifest, local, read)
    bodies = read.select("page_id", "remote_text", "remote_hash", F.lit(None).cast("string").alias("merged_text"), F.lit(None).cast("string").alias("merged_hash"))
    none = spark.createDataFrame([], "page_id string, choice string, pos int")
    done = merge.pull_apply(manifest, local, states, bodies, none, now)
    durable.publish(done.local, local_table)
    durable.publish(done.manifest.withColumn("batch", F.lit(batch).cast("long")), manifest_table)
    return True


def follow(envelopes: DataFrame, manifest_table: str, local_table: str, checkpoint: str, now: str, dialect: P.Dialect = P.DEFAULT):
    """Start applying a stream of ``envelopes(page_id, text, pos)``; returns the running query."""
    return (
        envelopes.writeStream.foreachBatch(lambda df, n: apply_batch(df, n, manifest_table, local_table, now, dialect))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
