"""Longest-processing-time sharding: equal texts stay together, the largest groups go first.

Each group goes to the shard with the least bytes so far, through a heap, in order of size. Only
groups of more than `total / (shards * GRAIN)` bytes are placed one by one, and there are fewer than
`shards * GRAIN` of those. All other groups are hashed into `shards * GRAIN` bundles, and the bundles
are placed as items beside the large groups. So what the driver sorts, and what is broadcast back,
is bounded by `2 * shards * GRAIN` rows however large the corpus, and the shards differ by about the
size of one bundle: a share of 1 / GRAIN of a shard at most, if no single group is larger than that.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from knotwork.llm import store

GRAIN = 1000
#: Rows of a shard that are numbered by one task at most, on average.
NUMBERED = 1_000_000


def longest_first(sizes: list[tuple[str, int]], shards: int) -> dict[str, int]:
    """The shard of each item: by size, then name, to the least loaded shard, then the lowest number."""
    heap = [(0, s) for s in range(shards)]
    out = {}
    for name, size in sorted(sizes, key=lambda x: (-x[1], x[0])):
        load, s = heapq.heappop(heap)
        out[name] = s
        heapq.heappush(heap, (load + size, s))
    return out


def shard(df: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, size, text_crc32, law, shard, slot, grown_shard of every row, by the law `bytes`.

    Size: UTF-8 bytes of the text plus 8. Null texts are a group of their own (crc of nothing), apart
    from empty ones. Null or repeated ids are placed like others; slots are gapless in each shard.
    An empty table gives no rows. Further columns of the input are left behind.
    """
    spark = df.sparkSession
    text = F.col(text_col)
    key = F.unhex(F.sha2(F.coalesce(text.cast("binary"), F.lit(b"")), 256))
    slim = store.written(
        df.select(
            F.col(id_col).alias("id"),
            (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("size"),
            F.crc32(F.coalesce(text.cast("binary"), F.lit(b""))).alias("text_crc32"),
            F.when(text.isNull(), F.lit(b"null")).otherwise(key).alias("grp"),
        ),
        "shard-rows",
    )
    total, n = slim.agg(F.sum("size"), F.count("*")).first()
    bundles = shards * GRAIN
    heavy_from = (total or 0) / bundles
    bundle = F.pmod(F.xxhash64("grp"), F.lit(bundles))
    groups = slim.groupBy("grp").agg(F.sum("size").alias("bytes"))
    item = F.when(F.col("bytes") > heavy_from, F.hex("grp")).otherwise(F.concat(F.lit("#"), bundle.cast("string")))
    items = groups.groupBy(item.alias("item")).agg(F.sum("bytes").alias("bytes"))
    placed = longest_first([(r["item"], r["bytes"]) for r in items.toLocalIterator()], shards)
    where = spark.createDataFrame([(k, v) for k, v in placed.items()], "item string, shard int")
    heavy = F.broadcast(where.where("item not like '#%'").select(F.unhex("item").alias("grp"), F.col("shard").alias("own")))
    light = F.broadcast(where.where("item like '#%'").select(F.expr("cast(substring(item, 2) as bigint)").alias("bundle"), F.col("shard").alias("shared")))
    rows = slim.withColumn("bundle", bundle).join(heavy, "grp", "left").join(light, "bundle", "left")
    rows = rows.select("id", "size", "text_crc32", F.coalesce("own", "shared").alias("shard"))
    # Slots: rows are dealt over parts of a shard by hash, numbered there, and the parts' sizes added up.
    parts = max(16, -(-n // (shards * NUMBERED)))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("id", "text_crc32", "size"), F.lit(parts)).cast("int"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("shard", "part").count().select("shard", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    within = Window.partitionBy("shard", "part").orderBy("id", "text_crc32")
    rows = rows.withColumn("rank", F.row_number().over(within)).join(starts, ["shard", "part"])
    return rows.select(
        F.col("id").alias(id_col),
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("before") + F.col("rank") - 1).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
