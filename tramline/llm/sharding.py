"""Size-balanced shards by sampled splitters; DataFrame functions only.

Every row gets a 52-bit range key: the CRC-32 of its text (equal texts stay neighbours), then 20 hash bits of its
id. A bounded size-weighted sample of keys gives quantile splitters, rows are range-partitioned by them, and a range
over twice its fair size is cut again, so neither a hot group of copies nor a badly drawn sample makes one large task.
A range of one key only, which repeated rows or null ids make, is cut by a number that each row draws when the rows are
written. Running sums inside the ranges plus the sums of the ranges before give each row its exact place in key order,
and the shard is where the middle of the row falls among n equal lengths, a function of that running sum alone: no shard
is off by more than its two border rows, wherever the splitters fell.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tramline.llm.common import stored

#: Sampled keys per shard, and ranges per shard; both bound what the driver sees.
SAMPLES_PER_SHARD = 64
RANGES_PER_SHARD = 8
SUB_BITS = 20


def _splitters(rows: DataFrame, total: int, n_shards: int) -> list[int]:
    """Quantile boundaries of about n_shards * SAMPLES_PER_SHARD keys, each drawn with a chance as its size."""
    wanted, ranges = n_shards * SAMPLES_PER_SHARD, n_shards * RANGES_PER_SHARD
    draw = F.pmod(F.xxhash64("doc_id", "text_crc32", F.lit("splitter")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    keys = sorted(r[0] for r in rows.filter(draw < F.col("size") * F.lit(wanted / total)).select("range_key").collect())
    return sorted({keys[i * len(keys) // ranges] for i in range(1, ranges)}) if keys else []


def _range_of(key: Column, splits: list[int]) -> Column:
    """How many of the sorted splits are not over key, by binary search in a literal array."""
    steps = [1 << n for n in reversed(range(len(splits).bit_length()))]
    padded = F.lit(splits + [(1 << 63) - 1] * ((1 << len(steps)) - 1 - len(splits)))

    def search(found: Column, step: Column) -> Column:
        return F.when(F.get(padded, found + step - 1) <= key, found + step).otherwise(found)

    return F.aggregate(F.lit(steps), F.lit(0), search) if steps else F.lit(0)


def shard(docs: DataFrame, n_shards: int = 40, *, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard, then the columns of carry.

    size is the text's UTF-8 bytes plus 16. A null text counts as empty (16 bytes, CRC 0); null ids are ordered first;
    repeated rows each get a slot of their own; an empty table gives no rows. Columns other than doc_id, text and carry
    are ignored.
    """
    if n_shards < 1:
        raise ValueError("n_shards must be positive")
    if clash := set(carry) & {"doc_id", "size", "text_crc32", "range_key", "law", "shard", "slot", "grown_shard", "part", "piece", "drawn"}:
        raise ValueError(f"these columns cannot be carried: {sorted(clash)}")
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text).cast("long") + 16).alias("size"), F.crc32(text).alias("text_crc32"), *carry)
    sub = F.pmod(F.xxhash64("doc_id"), F.lit(1 << SUB_BITS))
    rows = rows.withColumn("range_key", F.col("text_crc32") * F.lit(1 << SUB_BITS) + sub).withColumn("drawn", F.xxhash64(F.monotonically_increasing_id()))
    rows = stored(rows, "shard-rows")
    total = rows.agg(F.sum("size")).first()[0] or 1

    rows = rows.withColumn("part", _range_of(F.col("range_key"), _splitters(rows, total, n_shards)))
    # at most RANGES_PER_SHARD * n_shards rows
    parts = rows.groupBy("part").agg(F.sum("size").alias("part_size"), F.min("range_key").alias("low"), F.max("range_key").alias("high"))
    fair = max(1, total // (n_shards * RANGES_PER_SHARD))
    cuts = F.when(F.col("part_size") > 2 * fair, F.ceil(F.col("part_size") / fair)).otherwise(F.lit(1))
    rows = rows.join(F.broadcast(parts.select("part", "low", "high", cuts.alias("cuts"))), "part")
    along = F.floor((F.col("range_key") - F.col("low")) / (F.col("high") - F.col("low") + 1) * F.col("cuts"))
    piece = F.when(F.col("low") == F.col("high"), F.pmod("drawn", "cuts")).otherwise(F.least(along, F.col("cuts") - 1))
    rows = rows.withColumn("piece", piece).drop("low", "high", "cuts", "drawn")

    # at most one row for each range and cut: three times the ranges
    pieces = rows.groupBy("part", "piece").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    before = Window.orderBy("part", "piece").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.select("part", "piece", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"), F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows_before"))
    inside = Window.partitionBy("part", "piece").orderBy("range_key", "doc_id", "size")
    rows = rows.withColumn("through", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0))).withColumn("nth", F.row_number().over(inside))
    rows = rows.join(F.broadcast(pieces), ["part", "piece"])
    middle = F.expr(f"(2 * (bytes_before + through) - size) * {n_shards} div {2 * total}")
    placed = stored(
        rows.select("doc_id", "size", "text_crc32", F.least(middle, F.lit(n_shards - 1)).cast("int").alias("shard"), (F.col("rows_before") + F.col("nth") - 1).alias("place"), *carry),
        "shard-places",
    )
    first = placed.groupBy("shard").agg(F.min("place").alias("first_place"))  # n_shards rows
    return placed.join(F.broadcast(first), "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("place") - F.col("first_place")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), *carry
    )


def write_shards(docs: DataFrame, path: str, n_shards: int = 40) -> None:
    """Writes the texts as Parquet in folders shard=0 ..., in slot order inside each file."""
    rows = shard(docs, n_shards, carry=("text",))
    # a shard is written by several tasks, each with a run of slots
    rows.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
