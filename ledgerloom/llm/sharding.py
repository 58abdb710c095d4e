"""Sharding [native]: a permutation-filled lookup table.

Every shard has a preference order over the slots of a table of prime size: it starts at an
offset and steps by a skip, both hashed from its name, and so visits every slot once. Shards take
turns; at its turn a shard claims the first slot of its order that is still free. Shards so
get equal numbers of slots, give or take one, and when a shard joins or leaves, most slots keep
their owner. A row goes to slot md5(key) mod size: one broadcast hash lookup, no shuffle, and
no key, however hot its source, decides for another.

The fill is one SQL fold over the turns. The table has `size` rows whatever the data, so its
broadcast has a proven bound.

Cases: a null key counts as the empty string; repeated rows go to the same shard; an empty
table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.exprs import let
from ledgerloom.llm.columns import unused
from ledgerloom.session import written

#: The largest table that is broadcast; a larger one would need another way of placing.
MAX_TABLE = 1_000_003
SHARDS = tuple(f"shard-{i:03d}" for i in range(32))
TABLE_SIZE = 4_093


def is_prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


def hash32(text: Column, start: int = 1) -> Column:
    """8 hex digits of md5 as a number; start 1, 9, 17 or 25 gives independent values."""
    return F.conv(F.substring(F.md5(text.cast("binary")), start, 8), 16, 10).cast("long")


def _put(array: Column, at: Column, value: Column) -> Column:
    n = F.size(array)
    return F.concat(F.slice(array, F.lit(1), at), F.array(value), F.slice(array, at + 2, n - at - 1))


def lookup_table(spark: SparkSession, shards=SHARDS, size: int = TABLE_SIZE) -> DataFrame:
    """(slot int, shard string), one row per slot of the filled table."""
    if not is_prime(size) or size < len(shards) or size > MAX_TABLE:
        raise ValueError("size must be prime, at least the number of shards and at most MAX_TABLE")
    if len(set(shards)) != len(shards) or not shards:
        raise ValueError("shard names must be distinct and not empty")
    names = F.array(*[F.lit(s) for s in shards])
    n = len(shards)
    order = F.transform(
        names,
        lambda s: F.struct(
            (hash32(s) % size).alias("offset"), (hash32(s, 9) % (size - 1) + 1).alias("skip")
        ),
    )

    def fill(order: Column) -> Column:
        def turn(state: Column, t: Column) -> Column:
            i = t % n
            mine = F.get(order, i)
            start = F.get(state["next"], i)

            def slot(j: Column) -> Column:
                return ((mine["offset"] + j * mine["skip"]) % size).cast("int")

            def first_free(last: Column) -> Column:
                return F.get(
                    F.filter(F.sequence(start, last), lambda j: F.get(state["owner"], slot(j)) < 0), F.lit(0)
                )

            # free slots are near in the order; only if none is, the whole rest is searched
            j = F.coalesce(first_free(F.least(start + 31, F.lit(size - 1))), first_free(F.lit(size - 1)))
            return let(
                j,
                lambda j: F.struct(
                    _put(state["owner"], slot(j), i.cast("int")).alias("owner"),
                    _put(state["next"], i, (j + 1).cast("int")).alias("next"),
                ),
            )

        return F.aggregate(
            F.sequence(F.lit(0), F.lit(size - 1)),
            F.struct(
                F.array_repeat(F.lit(-1), size).alias("owner"), F.array_repeat(F.lit(0), n).alias("next")
            ),
            turn,
            lambda state: state["owner"],
        )

    table = spark.range(1, numPartitions=1).select(
        F.posexplode(F.transform(let(order, fill), lambda i: F.get(names, i))).alias("slot", "shard")
    )
    return written(table, "shard-table")


def place(
    rows: DataFrame, table: DataFrame, key_col: str = "doc_id", size: int = TABLE_SIZE, slot_name: str = "_slot", shard_name: str = "_shard"
) -> DataFrame:
    """Adds slot and shard to rows by constant-time lookup."""
    slot = (hash32(F.coalesce(F.col(f"`{key_col}`").cast("string"), F.lit(""))) % size).cast("int")
    look = table.select(F.col("slot").alias(slot_name), F.col("shard").alias(shard_name))
    return rows.withColumn(slot_name, slot).join(F.broadcast(look), slot_name, "left")


def assign_shards(
    docs: DataFrame, shards=SHARDS, size: int = TABLE_SIZE, id_col: str = "doc_id"
) -> DataFrame:
    """doc_id, slot, shard for every row of docs."""
    ids = docs.select(F.col(id_col).alias("doc_id"))
    placed = place(ids, lookup_table(docs.sparkSession, shards, size), "doc_id", size)
    return placed.select("doc_id", F.col("_slot").alias("slot"), F.col("_shard").alias("shard"))


def write_shards(
    docs: DataFrame, path: str, shards=SHARDS, size: int = TABLE_SIZE, id_col: str = "doc_id", salts: int | None = None
) -> str:
    """Write docs under path, one folder a shard, and return the name of the folders' column: shard, or with
    underscores before it where docs has such a column. salts tasks share the writing of a shard (the session's
    shuffle partitions over all shards), so no shard is one task."""
    slot, shard, salt = unused(docs, "slot", "shard", "salt")
    if salts is None:
        salts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) // len(shards))
    placed = place(docs, lookup_table(docs.sparkSession, shards, size), id_col, size, slot, shard)
    # neighbours of a repeated key part too
    spread = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(salts))
    out = placed.drop(slot).withColumn(salt, spread).repartition(F.col(shard), F.col(salt)).drop(salt)
    out.write.partitionBy(shard).mode("overwrite").parquet(path)
    return shard
