"""Numbers and latest earlier values of rows in the order of their subjects, without a window over a subject.

Rows are sorted in ranges of (subject, order), so a subject with most of the rows is many ranges. Each
range is scanned on its own; only its first subject can have rows in ranges before, and what that one
brings along is read from the last row of the range before: a row for each range, summed up in order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from scriptorium.session import materialise, ship


def scanned(df: DataFrame, key: str, order: list[Column], value: str | None = None) -> DataFrame:
    """`df` with `n`, the number of a row of its key in the order (from 1), and, if a value is named, `before`: the last
    value of an earlier row of the key that is not null.

    A null key is a key. Rows that are equal in the order have some order of their own, one for both
    columns. An empty table gives an empty one."""
    ship(df.sparkSession)
    kept = value or "_none"
    rows = df if value else df.withColumn(kept, F.lit(None).cast("long"))
    kind = rows.schema[kept].dataType
    made = StructType([*rows.schema, StructField("_range", IntegerType()), StructField("_at", LongType()), StructField("_head", IntegerType()), StructField("_n", LongType()), StructField("_before", kind), StructField("_last", kind)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at, of, n, last, head = TaskContext.get().partitionId(), 0, None, 0, None, 1
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, values = batch.column(key), batch.column(kept)
            code = keys.dictionary_encode("encode").indices.to_numpy()
            begins = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
            first = (keys[0].as_py(),)  # of a tuple, as a key may be null
            goes_on = first == of
            place = np.arange(len(code))
            start = np.maximum.accumulate(np.where(np.isin(place, begins), place, 0))
            number = place - start + 1
            head_rows = np.zeros(len(code), np.int32)
            if goes_on:
                own = begins[1] if len(begins) > 1 else len(code)
                number[:own] += n
                head_rows[:own] = head
            elif of is None:
                head_rows[: begins[1] if len(begins) > 1 else len(code)] = 1
            # place of the last value up to each row, within its key; -1: none in this batch
            have = np.where(values.is_valid().to_numpy(zero_copy_only=False), place, -1)
            upto = np.maximum.accumulate(have)
            upto = np.where(upto >= start, upto, -1)
            earlier = np.where(start == place, -1, np.concatenate([[-1], upto[:-1]]))
            held = pa.array([last], values.type)

            def taken(i: np.ndarray) -> pa.Array:
                """The values at i; before the batch, what was held, if the key goes on."""
                pool = pa.concat_arrays([values, held])
                carried = goes_on & (start == 0)
                return pool.take(pa.array(np.where(i >= 0, i, len(values)), mask=(i < 0) & ~carried))

            lasts = taken(upto)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(code), part, np.int32)), pa.array(at + place), pa.array(head_rows), pa.array(number), taken(earlier), lasts], names=made.names)
            head = int(head_rows[-1])
            at, of, n, last = at + len(code), (keys[-1].as_py(),), int(number[-1]), lasts[-1].as_py()

    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(ranges, F.col(key), *order).sortWithinPartitions(F.col(key), *order)
    local = materialise(ordered.mapInArrow(run, made), "scanned")
    end = F.max_by(F.struct(F.col(key).alias("key"), F.col("_n").alias("n"), F.col("_last").alias("last"), F.col("_head").alias("head")), "_at")
    tails = local.groupBy("_range").agg(end.alias("end")).withColumn("_one", F.lit(1))  # a row for each range
    # A tail that is the only key of its range goes on with what the range before brings along.
    along = Window.partitionBy("_one").orderBy("_range")
    fresh = F.when((F.col("end.head") == 0) | ~F.col("end.key").eqNullSafe(F.lag("end.key").over(along)), 1).otherwise(0)
    tails = tails.withColumn("fresh", fresh).withColumn("chain", F.sum("fresh").over(along))
    chain = Window.partitionBy("_one", "chain").orderBy("_range")
    tails = tails.withColumn("sum", F.sum("end.n").over(chain)).withColumn("latest", F.last("end.last", True).over(chain))
    carry = tails.select("_range", F.lag("end.key").over(along).alias("_key"), F.lag("sum").over(along).alias("_sum"), F.lag("latest").over(along).alias("_latest"), F.lag("_range").over(along).isNotNull().alias("_some")).withColumnRenamed("_range", "_of")
    found = local.join(F.broadcast(carry), F.col("_range") == F.col("_of"))
    goes_on = (F.col("_head") == 1) & F.col("_some") & F.col(key).eqNullSafe(F.col("_key"))
    n = F.col("_n") + F.when(goes_on, F.col("_sum")).otherwise(F.lit(0))
    before = F.coalesce("_before", F.when(goes_on, F.col("_latest")))
    return found.select(*df.columns, n.alias("n"), *([before.alias("before")] if value else []))
