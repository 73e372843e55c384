"""Incremental queries: a given table read as a stream, written, and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from defectspark.catalog.registry import query, table
from defectspark.session import shared_folder
from defectspark.streaming import incremental as T
from defectspark.streaming.keyed import KeyedTable


def stream_of(spark, sf_dir, name):
    schema = table(spark, sf_dir, name).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def finish(running) -> None:
    running.awaitTermination()
    if running.exception():
        raise running.exception()


@query(
    "streamed_append",
    "SELECT p_brand, count(*) AS n_rows, round(sum(p_retailprice), 2) AS total FROM part WHERE p_size > 5 GROUP BY p_brand",
)
def _append(spark, sf_dir):
    """Results appended by a stream, then summarised; a second run finds nothing new."""
    target, checkpoint = shared_folder(spark, "append"), shared_folder(spark, "append-ckpt")
    for _ in range(2):
        rows = stream_of(spark, sf_dir, "part").where("p_size > 5").select("p_brand", "p_retailprice")
        finish(T.append_new(rows, target, checkpoint))
    done = spark.read.parquet(target)
    return done.groupBy("p_brand").agg(F.count(F.lit(1)).alias("n_rows"), F.round(F.sum("p_retailprice"), 2).alias("total"))


@query(
    "streamed_upsert",
    "SELECT o_custkey, o_orderpriority, arg_max(o_totalprice, o_orderkey) AS price, max(o_orderkey) AS o_orderkey FROM orders GROUP BY ALL",
)
def _upsert(spark, sf_dir):
    """The last row per key of a streamed table, upserted in four batches whose rows are out of order."""
    source = shared_folder(spark, "upsert-in")
    dealt = table(spark, sf_dir, "orders").withColumn("part", F.pmod(F.xxhash64("o_orderkey"), F.lit(4)))
    dealt.repartition(4, "part").write.partitionBy("part").parquet(source)
    target = KeyedTable(spark, shared_folder(spark, "upsert"), ["o_custkey", "o_orderpriority"], buckets=16)
    reader = spark.readStream.schema(dealt.schema).option("maxFilesPerTrigger", "1")
    rows = reader.parquet(source).select(
        "o_custkey", "o_orderpriority", F.col("o_totalprice").alias("price"), "o_orderkey"
    )
    finish(T.upsert_new(rows, target, shared_folder(spark, "upsert-ckpt"), ["o_orderkey"]))
    return target.read()


@query(
    "process_rest",
    "SELECT c_mktsegment, count(*) AS n_left FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000) GROUP BY 1",
)
def _rest(spark, sf_dir):
    finished = table(spark, sf_dir, "orders").where("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"))
    count = lambda rest: rest.groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n_left"))
    return T.process_rest(table(spark, sf_dir, "customer"), finished, ["c_custkey"], count)
