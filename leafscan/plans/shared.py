"""Plans that need the folder shared by driver and executors."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes, about, up to which a measured side of a join is broadcast.
BROADCAST_BYTES = 32 << 20


def taken_apart(df: DataFrame, items: str | Column, place: str, item: str, *keep: str | Column) -> DataFrame:
    """The kept columns with each element of an array and its place (from 0); rows without an element give none.

    An inner generator makes Spark filter by the array's size before it, as near to the files as can be: the array (the words
    of a text) is then worked out twice, and the first time in as few tasks as there are files.  The outer one doesn't;
    the row that it gives for an empty array is dropped behind it.
    """
    return df.select(*keep, F.posexplode_outer(items).alias(place, item)).where(F.col(place).isNotNull())


def checkpointed(df: DataFrame) -> DataFrame:
    """The same rows with their lineage cut by a reliable checkpoint in ``spark.checkpoint.dir``.

    Where a local session names no folder, as in tests, one in its warehouse is set; a cluster must name one.
    """
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(named or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared")
    return df.checkpoint()


#: Pages, and characters of them about, that go to a block of queries in one row.
HELD_PAGES, HELD_CHARS = 256, 1 << 19


def against_all(pages: DataFrame, queries: DataFrame, block: int) -> DataFrame:
    """block, query_ids, asked, page_ids, held: a stated set of queries (query_id, qs), in blocks, against all pages
    (page_id, ws); pages are held together in rows, so that a block isn't sent with each of them."""
    known = checkpointed(queries)
    blocks = max(1, -(-known.count() // block))
    listed = known.groupBy(F.pmod(F.xxhash64("query_id"), F.lit(blocks)).alias("block")).agg(F.collect_list("query_id").alias("query_ids"), F.collect_list("qs").alias("asked"))
    own = pages.where(F.size("ws") > 0).select("page_id", "ws")
    schema = T.StructType([T.StructField("page_ids", T.ArrayType(own.schema["page_id"].dataType)), T.StructField("held", T.ArrayType(own.schema["ws"].dataType))])

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column(1).value_lengths().to_numpy(zero_copy_only=False)
            first, words = 0, 0
            for row in range(len(batch)):
                words += sizes[row]
                if row + 1 == len(batch) or row + 1 - first == HELD_PAGES or words * 6 >= HELD_CHARS:
                    part = batch.slice(first, row + 1 - first)
                    offsets = pa.array([0, len(part)], pa.int32())
                    columns = [pa.ListArray.from_arrays(offsets, pa.concat_arrays([c])) for c in part.columns]
                    yield pa.RecordBatch.from_arrays(columns, names=["page_ids", "held"])
                    first, words = row + 1, 0

    every = own.mapInArrow(together, schema).crossJoin(settled(listed.coalesce(1)))
    return every.select("block", "query_ids", "asked", "page_ids", "held")


def _bytes_of(column: Column, kind: T.DataType) -> Column:
    """About the bytes that a value takes."""
    if isinstance(kind, T.StringType | T.BinaryType):
        size = F.octet_length(column) + 16
    elif isinstance(kind, T.ArrayType):
        inner = kind.elementType
        one = F.transform(column, lambda x: _bytes_of(x, inner)) if isinstance(inner, T.StringType | T.BinaryType | T.ArrayType | T.StructType) else None
        size = F.size(column) * 8 if one is None else F.aggregate(one, F.lit(0).cast("long"), lambda n, x: n + x)
        size = size + 16
    elif isinstance(kind, T.StructType):
        size = sum((_bytes_of(column[f.name], f.dataType) for f in kind), F.lit(8))
    else:
        size = F.lit(8)
    return F.coalesce(size.cast("long"), F.lit(8).cast("long"))


def settled(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """Rows worked out once and measured; joins broadcast them if they are small, else shuffle."""
    kept = checkpointed(df)
    each = sum((_bytes_of(F.col(f"`{f.name}`"), f.dataType) for f in kept.schema), F.lit(16))
    return F.broadcast(kept) if (kept.agg(F.sum(each)).first()[0] or 0) <= most else kept


def globally_ranked(df: DataFrame, *order: Column, name: str = "rank") -> DataFrame:
    """Rows with their number (from 1) in a total order, without bringing them into one task.

    Range partitions are sorted, each row takes its number within its partition, and the sizes of the partitions
    before it are added: one row for each partition, whatever the data.
    """
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order)
    numbered = checkpointed(placed.withColumn("_at", F.monotonically_increasing_id()))
    part, within = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    sizes = sorted(numbered.groupBy(part.alias("part")).count().collect(), key=lambda r: r["part"])
    base, bases = 0, [F.struct(F.lit(-1).cast("long").alias("_part"), F.lit(0).cast("long").alias("_base"))]
    for row in sizes:
        bases.append(F.struct(F.lit(row["part"]).cast("long").alias("_part"), F.lit(base).cast("long").alias("_base")))
        base += row["count"]
    known = F.broadcast(df.sparkSession.range(1).select(F.inline(F.array(*bases))))
    return numbered.join(known, part == F.col("_part")).withColumn(name, F.col("_base") + within + 1).drop("_at", "_part", "_base")
