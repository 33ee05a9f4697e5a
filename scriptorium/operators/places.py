"""Places of rows in one order, without a task that holds all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.session import materialise

#: Bits of a row's number in its range.
_BITS = 33


def placed(df: DataFrame, *order) -> DataFrame:
    """`df` with _range, _i (place from 0 in the order) and _n (all rows). Ranges of the order are
    sorted each on its own and written; only the counts of ranges meet in one task. Rows that are
    equal in the order have some order of their own, which stays as written."""
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.repartitionByRange(ranges, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    rows = materialise(rows, "placed").withColumn("_range", F.shiftright("_at", _BITS).cast("int"))
    counts = rows.groupBy("_range").agg(F.count("*").alias("_own")).withColumn("_one", F.lit(1))
    all_ = Window.partitionBy("_one")
    before = F.coalesce(F.sum("_own").over(all_.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    counts = counts.select(F.col("_range").alias("_of"), before.alias("_before"), F.sum("_own").over(all_).alias("_n"))
    found = rows.join(F.broadcast(counts), F.col("_range") == F.col("_of"))  # a row for each range
    own = F.col("_at") - F.shiftleft(F.col("_range").cast("long"), _BITS)
    return found.withColumn("_i", F.col("_before") + own).drop("_at", "_of", "_before")
