"""Keyed results with a time to live, as tables: sets, lookups at a time, expiry, statistics.

Clocks are never read: every function takes the time it is to hold at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafscan.plans.shared import checkpointed

TTL = "24 hours"


def entries(sets: DataFrame, ttl: str = TTL) -> DataFrame:
    """The current entry of every (store, key): latest set wins; expires_at from its time and the time to live."""
    last = sets.groupBy("store", "key").agg(F.max(F.struct("ts", "data", "size")).alias("e"))
    return last.select("store", "key", "e.ts", "e.data", "e.size", (F.col("e.ts") + F.expr(f"INTERVAL {ttl}")).alias("expires_at"))


def lookups(accesses: DataFrame, ttl: str = TTL) -> DataFrame:
    """Accesses (store, key, ts, id) with ``hit``: whether an access of the key lies at most the time to live before it.

    Every access leaves its result in the cache, so the last one before is the set that it finds.  One key's accesses
    are read in one task, in order and with nothing held; ``found_at`` is the form for a table of sets.
    """
    before = F.lag("ts").over(Window.partitionBy("store", "key").orderBy("ts", "id"))
    return accesses.withColumn("set_at", before).withColumn("hit", F.coalesce(F.col("ts") <= F.col("set_at") + F.expr(f"INTERVAL {ttl}"), F.lit(False)))


def found_at(gets: DataFrame, sets: DataFrame, ttl: str = TTL) -> DataFrame:
    """Each get (store, key, ts, id, and more) with the latest set (store, key, ts, data) up to its time: set_at, data, hit.

    A hit lasts to the very end of the set's life.  Gets and sets are sorted together by store, key and time into ranges, a
    set before the gets of its time.  Each range is read once in order with its last set in hand; what a range ends with, one
    row each, goes on to the next.  So one key may hold most of the rows and still be spread over many tasks.  Gets with
    a null in store, key or time find nothing.
    """
    columns = gets.columns
    carried = F.struct(*columns)
    nothing = F.lit(None).cast(gets.select(carried.alias("c")).schema["c"].dataType)
    one = sets.groupBy("store", "key", "ts").agg(F.max("data").alias("data")).where("store IS NOT NULL AND key IS NOT NULL AND ts IS NOT NULL")
    of_sets = one.select("store", "key", "ts", F.lit(True).alias("is_set"), F.lit(None).cast(gets.schema["id"].dataType).alias("id"), "data", nothing.alias("get"))
    of_gets = gets.select("store", "key", "ts", F.lit(False).alias("is_set"), "id", F.lit(None).cast(sets.schema["data"].dataType).alias("data"), carried.alias("get"))
    order = ["store", "key", "ts", F.desc("is_set"), "id"]
    ranged = checkpointed(of_sets.unionByName(of_gets).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()))
    last = ranged.where("is_set").groupBy("part").agg(F.max(F.struct("store", "key", "ts", "data")).alias("last"))  # a row for each range
    ends = last.select(F.struct("part", "last").alias("e")).agg(F.array_sort(F.collect_list("e")).alias("ends"))
    schema = gets.select(F.lit(0).alias("part"), carried.alias("get")).schema
    for name, kind in (("set_store", sets.schema["store"]), ("set_key", sets.schema["key"]), ("set_at", sets.schema["ts"]), ("data", sets.schema["data"])):
        schema = schema.add(name, kind.dataType)

    def carry(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            known = batch.select(["store", "key", "ts", "data"])
            held = known.slice(0, 0) if held is None else held
            both, ahead = pa.concat_batches([held, known]), len(held)
            is_set = batch.column("is_set").to_numpy(zero_copy_only=False)
            at = np.maximum.accumulate(np.where(is_set, np.arange(len(batch)) + ahead, ahead - 1)) if len(batch) else np.zeros(0, np.int64)
            asked = np.flatnonzero(~is_set)
            found = both.take(pa.array(at[asked], mask=at[asked] < 0))
            yield pa.RecordBatch.from_arrays([batch.column("part").take(pa.array(asked)), batch.column("get").take(pa.array(asked)), *found.columns], names=schema.names)
            if len(batch) and at[-1] >= 0:
                held = both.slice(int(at[-1]), 1)

    read = ranged.select("part", "store", "key", "ts", "data", "is_set", "get").mapInArrow(carry, schema)
    before = F.try_element_at(F.filter("ends", lambda e: e["part"] < F.col("part")), F.lit(-1))["last"]  # the last set of all ranges before
    whole = read.join(F.broadcast(ends), F.lit(True)).withColumn("b", F.when(F.col("set_at").isNull() & (F.size("ends") > 0), before))
    same = lambda store, key: (store == F.col("get.store")) & (key == F.col("get.key"))
    at = F.when(same(F.col("set_store"), F.col("set_key")), F.struct(F.col("set_at").alias("ts"), "data")).when(same(F.col("b.store"), F.col("b.key")), F.struct(F.col("b.ts").alias("ts"), F.col("b.data").alias("data")))
    at = F.when(F.col("get.ts").isNotNull(), at)
    done = whole.select("get.*", at.alias("_found")).select(*columns, F.col("_found.ts").alias("set_at"), F.col("_found.data").alias("data"))
    return done.withColumn("hit", F.coalesce(F.col("ts") <= F.col("set_at") + F.expr(f"INTERVAL {ttl}"), F.lit(False)))


def hit_rates(looked_up: DataFrame) -> DataFrame:
    """store, hits, misses, hit_rate of lookups."""
    hits, misses = F.sum(F.col("hit").cast("long")), F.sum((~F.col("hit")).cast("long"))
    return looked_up.groupBy("store").agg(hits.alias("hits"), misses.alias("misses"), (hits / (hits + misses)).alias("hit_rate"))


def store_info(current: DataFrame) -> DataFrame:
    """Entries and size of every store, and of all (store null)."""
    return current.rollup("store").agg(F.count("*").alias("entries"), F.coalesce(F.sum("size"), F.lit(0)).alias("size"))


def cleaned(current: DataFrame, at: Column) -> tuple[DataFrame, DataFrame]:
    """What is left at a time (an entry still holds at the very end of its life), and count and size of what went."""
    live = F.col("expires_at").isNull() | (at <= F.col("expires_at"))
    gone = current.where(~live).groupBy("store").agg(F.count("*").alias("expired"), F.sum("size").alias("freed"))
    return current.where(live), gone


def without_keys(current: DataFrame, gone: DataFrame) -> DataFrame:
    """Entries whose (store, key) is not among those to delete."""
    return current.join(gone.select("store", "key").distinct(), ["store", "key"], "left_anti")


def without_stores(current: DataFrame, *stores: str) -> DataFrame:
    """Entries of all other stores; without a name, none at all."""
    return current.where(~F.col("store").isin(*stores)) if stores else current.where("false")


def packed(data: Column) -> Column:
    """A value as it is stored."""
    return F.to_json(data)


class Store:
    """Entries kept under a path, as Parquet in a fixed number of buckets of keys; each change rewrites only its buckets.

    An entry is store, key, ts, data, size; of one key the latest time counts, and at one time a deletion.  A deletion is kept
    as a mark, so that a batch that is put again, or late, changes nothing that came after it; ``swept`` drops
    old marks and what has expired.  Changes must not run at the same time.
    """

    def __init__(self, spark: SparkSession, path: str, key_type: str = "string", buckets: int = 64):
        self.spark, self.path, self.buckets = spark, path, buckets
        self.schema = f"store string, key {key_type}, ts timestamp, gone boolean, data string, size long, bucket int"

    def _all(self) -> DataFrame:
        """All entries and marks; an empty table before the first change."""
        place = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not place.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(place):
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(self.path)

    def _changed(self, rows: DataFrame) -> None:
        bucket = F.pmod(F.xxhash64("store", "key"), F.lit(self.buckets)).cast("int")
        new = checkpointed(rows.withColumn("bucket", bucket).select(*self._all().columns))
        touched = [r["bucket"] for r in new.select("bucket").distinct().collect()]  # at most the number of buckets
        if not touched:
            return
        every = self._all().where(F.col("bucket").isin(touched)).unionByName(new)
        last = every.groupBy("bucket", "store", "key").agg(F.max(F.struct("ts", "gone", "data", "size")).alias("e"))
        kept = checkpointed(last.select("store", "key", "e.ts", "e.gone", "e.data", "e.size", "bucket"))
        kept.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(self.path)

    def put(self, entries: DataFrame) -> None:
        """Set entries: store, key, ts, data, size."""
        self._changed(entries.select("store", "key", "ts", F.lit(False).alias("gone"), "data", F.col("size").cast("long").alias("size")))

    def delete(self, keys: DataFrame, at: Column) -> None:
        """Delete keys (store, key) as of a time."""
        none = F.lit(None)
        self._changed(keys.select("store", "key", at.cast("timestamp").alias("ts"), F.lit(True).alias("gone"), none.cast("string").alias("data"), none.cast("long").alias("size")))

    def clear(self, at: Column, *stores: str) -> None:
        """Delete all keys of some stores, or of all, as of a time."""
        held = self.read()
        self.delete((held.where(F.col("store").isin(*stores)) if stores else held).select("store", "key"), at)

    def read(self) -> DataFrame:
        """store, key, ts, data, size of all entries."""
        return self._all().where("NOT gone").select("store", "key", "ts", "data", "size")

    def swept(self, at: Column, ttl: str = TTL) -> None:
        """Drop entries that have expired at a time, and marks as old."""
        kept = checkpointed(self._all().where(at.cast("timestamp") <= F.col("ts") + F.expr(f"INTERVAL {ttl}")))
        kept.write.mode("overwrite").partitionBy("bucket").parquet(self.path)
