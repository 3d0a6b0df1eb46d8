"""Global orders without a global task.

Rows are dealt to partitions by ranges of their keys and sorted there; what a partition adds up to is
one number, and the sums of the partitions before it are its offset. So ranks and running sums over a
whole table need one range shuffle, and only one row a partition reaches the driver.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairbench.operators.components import cut


def running(df: DataFrame, by: list[str], weight: str | None = None, before: str = "before") -> tuple[DataFrame, int]:
    """df with the sum of `weight` (a whole number; None: 1, so that the sum is the row's place from 0)
    over all rows that come before in the order of `by`, and the sum over all rows. Keys that tie
    stand in any order, so `by` should be unique. The sorted rows are kept in the shared folder: their
    ranges are drawn once."""
    own = df.withColumn("_n", F.lit(1).cast("long") if weight is None else F.col(weight).cast("long"))
    rows = cut(own.repartitionByRange(*by).sortWithinPartitions(*by)).withColumn("_part", F.spark_partition_id())
    sums = dict(rows.groupBy("_part").agg(F.sum("_n")).collect())
    parts = sorted(sums)
    offset = dict(zip(parts, [0, *accumulate(sums[p] for p in parts)], strict=False))

    def add(batches):
        here = None
        for batch in batches:
            n = batch.column("_n").to_numpy()
            if len(n) and here is None:
                here = offset[batch.column("_part")[0].as_py()]
            total = (here or 0) + np.cumsum(n)
            keep = batch.drop_columns(["_n", "_part"])
            yield keep.append_column(before, pa.array(total - n, pa.int64()))
            here = int(total[-1]) if len(n) else here

    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema]
    return rows.mapInArrow(add, ", ".join([*kinds, f"`{before}` long"])), sum(sums.values())


def tile(place: Column, total: int, parts: int) -> Column:
    """The part (from 0) of a place when `total` places are cut into parts of equal size, of which the
    first total % parts have one more."""
    q, r = divmod(total, parts)
    late = F.floor((place - r * (q + 1)) / q) + r if q else F.lit(parts - 1).cast("long")
    return F.when(place < r * (q + 1), F.floor(place / (q + 1))).otherwise(late)


def codes(df: DataFrame, key: str, code: str = "code") -> DataFrame:
    """(key, code): a dictionary of the distinct non-null values of `key`, numbered densely from 0 in
    their order: the same codes on every cluster and for every partitioning."""
    return running(df.select(key).where(F.col(key).isNotNull()).distinct(), [key], before=code)[0]


def encode(df: DataFrame, dictionary: DataFrame, key: str, code: str = "code") -> DataFrame:
    """df with `code` in place of `key`. A value that the dictionary lacks is an error that names
    some; a null key has a null code."""
    some = df.join(dictionary, key, "left_anti").where(F.col(key).isNotNull()).select(key).distinct().orderBy(key).limit(5)
    if lost := [r[0] for r in some.collect()]:
        raise KeyError(f"not in the dictionary of {key}: {lost}")
    return df.join(dictionary, key, "left").drop(key)
