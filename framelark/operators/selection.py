"""Values by rank without sorting a table: counts of ranges of values, refined pass by pass."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Bits of a value that a pass settles: it counts 2 ** BITS ranges of a key at most. 64 bits take four passes.
BITS = 16


def ordered_bits(x: Column) -> Column:
    """A whole number for each double, in the same order; NaN comes last, and -0.0 equals 0.0."""
    bits = F.java_method(F.lit("java.lang.Double"), F.lit("doubleToLongBits"), x + 0.0).cast("long")
    return F.when(bits < 0, bits.bitwiseXOR(F.lit((1 << 63) - 1))).otherwise(bits)


def percentile(rows: DataFrame, value: str, share: float, keys: tuple[str, ...] = (), to: str = "percentile") -> DataFrame:
    """(_key, <to>): the exact percentile of each key's values, in proportion between the two values next to it. _key is a
    struct of the keys (0 without any). Null values take no part; a key without others is left out.

    The first pass counts the ranges of the upper bits; each of the two ranks falls into one. The next counts the finer
    ranges within those only, and so on, until a range is a value. Counts are made by task first: a pass shuffles at most
    2 ** BITS rows a task and key, and no task sees all values of a key.
    """
    values = rows.where(F.col(value).isNotNull()).select((F.struct(*keys) if keys else F.lit(0)).alias("_key"), F.col(value).cast("double").alias("value"))
    values = values.withColumn("_bits", ordered_bits(F.col("value")))
    upper = lambda k: F.shiftright("_bits", 64 - BITS * k)

    def counted(held: DataFrame, k: int) -> DataFrame:
        """(_key, _at, _next, n, _before, value): finer ranges of each range, how many values they and those before have."""
        counts = held.groupBy("_key", "_at", upper(k).alias("_next")).agg(F.count("*").alias("n"), F.min("value").alias("value"))
        return counts.withColumn("_before", F.sum("n").over(W.partitionBy("_key", "_at").orderBy("_next")) - F.col("n"))

    inside = (F.col("_rank") >= F.col("_before")) & (F.col("_rank") < F.col("_before") + F.col("n"))
    first = counted(values.withColumn("_at", F.lit(0)), 1).withColumn("_place", (F.sum("n").over(W.partitionBy("_key")) - 1) * F.lit(share))
    both = F.array(*[F.struct(F.lit(k).alias("which"), f("_place").alias("rank")) for k, f in enumerate((F.floor, F.ceil))])
    picks = first.withColumn("_r", F.explode(both)).withColumns({"_which": F.col("_r.which"), "_rank": F.col("_r.rank")}).where(inside)
    for k in range(2, 64 // BITS + 1):
        picks = picks.select("_key", "_which", "_place", F.col("_next").alias("_at"), (F.col("_rank") - F.col("_before")).alias("_rank"))
        ranges = picks.select("_key", "_at").distinct()
        held = values.withColumn("_at", upper(k - 1)).join(ranges if keys else F.broadcast(ranges), ["_key", "_at"], "left_semi")  # without keys, two rows
        picks = picks.join(counted(held, k), ["_key", "_at"]).where(inside)
    low, high = (F.max(F.when(F.col("_which") == k, F.col("value"))) for k in (0, 1))
    part = F.max(F.col("_place") - F.floor("_place"))
    return picks.groupBy("_key").agg(F.when(part == 0, low).otherwise((1 - part) * low + part * high).alias(to))
