"""Incremental writing: claims arrive in micro-batches; snapshots follow (survey 2.12).

Log and snapshots are dealt to buckets by subject. A batch reads only the buckets that its claims touch, goes on from the
facts stored there (so consolidation, merges and promotions that were written to a snapshot stay), and writes only those
buckets as the next version; a reader takes each bucket's newest version. Claims are taken in the order of ``claim_seq``
within a batch and of arrival between batches, and one that was logged before is not applied again, so a replayed batch
gives the same version.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from factweave.operators.maintenance import consolidate
from factweave.operators.writing import FACTS, prepared, write_more
from factweave.sources.store import load_buckets, save_buckets

BUCKETS = 64


def bucket(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def fold_batch(spec: DataFrame, log: str, root: str, buckets: int = BUCKETS, resolved: DataFrame | None = None, consolidate_every: int = 0, as_of: str = "date_obs"):
    """A function for ``foreachBatch``: (batch, epoch) -> snapshot version ``epoch``.

    ``consolidate_every``: after so many epochs all facts are consolidated, as of the latest ``as_of`` of the batch.
    """

    def run(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        once = batch.dropDuplicates(["claim_seq"])
        keys = prepared(once, spec, resolved).select("claim_seq", bucket(F.col("sujet_key"), buckets).alias("bucket"))
        keyed = once.join(keys, "claim_seq")
        keyed.write.mode("overwrite").partitionBy("bucket").parquet(f"{log}/epoch={epoch}")
        fields = [f for f in keyed.schema.fields if f.name != "bucket"] + [StructField("bucket", IntegerType())]
        new = spark.read.schema(StructType(fields)).parquet(f"{log}/epoch={epoch}")
        touched = [r["bucket"] for r in new.select("bucket").distinct().collect()]  # at most ``buckets`` numbers
        if epoch:
            seen = spark.read.schema(StructType([*fields, StructField("epoch", LongType())])).parquet(log).filter((F.col("epoch") < epoch) & F.col("bucket").isin(touched))
            new = new.join(seen.select("claim_seq").distinct(), "claim_seq", "left_anti")
        last = consolidate_every and (epoch + 1) % consolidate_every == 0
        before = load_buckets(spark, root, epoch - 1, None if last else touched)
        facts = before if before is not None else spark.createDataFrame([], FACTS)
        after = write_more(facts, new.drop("bucket"), spec, resolved)
        if last:
            when = new.agg(F.max(as_of)).first()[0]
            if when is not None:
                after = consolidate(after, spec, F.lit(when))
        save_buckets(after.withColumn("bucket", bucket(F.col("sujet_key"), buckets)), root, epoch)

    return run


def stream_claims(claims: DataFrame, spec: DataFrame, log: str, root: str, checkpoint: str, **settings):
    """Start the query on a streaming DataFrame of claims; ``settings``: see ``fold_batch``."""
    return claims.writeStream.foreachBatch(fold_batch(spec, log, root, **settings)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
