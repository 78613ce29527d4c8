"""Row numbers in a total order without a window over one partition."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import materialise


def numbered(df: DataFrame, order: list, name: str = "n", start: int = 1) -> DataFrame:
    """df with `name`: 1, 2, ... by `order`. Rows are sorted by range; each partition's rows count from the
    sum of those before it (one number per partition is all that meets in one place). discard() of the result deletes the table behind it."""
    x = df.repartitionByRange(*order).sortWithinPartitions(*order)
    x = materialise(x.withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id() % (1 << 33)), "numbered")
    sizes = sorted((r["_p"], r["c"]) for r in x.groupBy("_p").agg(F.count(F.lit(1)).alias("c")).collect())
    offsets, total = [], start
    for p, c in sizes:
        offsets.append((p, total))
        total += c
    if not offsets:
        return df.withColumn(name, F.lit(0).cast("long"))
    base = F.broadcast(df.sparkSession.createDataFrame(offsets, "_p int, _base long"))  # one row per partition
    out = x.join(base, "_p").withColumn(name, F.col("_base") + F.col("_i")).drop("_p", "_i", "_base")
    out._scratch = x._scratch
    return out
