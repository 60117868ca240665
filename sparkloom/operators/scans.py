"""Scans in order that windows can't say, as table functions over ordered partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class GreedyBins:
    """Rows in order into bins of ``capacity``: a row opens a new bin if it doesn't fit into the open one. State ends with the partition."""

    def __init__(self):
        self.bin, self.used = 1, 0

    def eval(self, row):
        size, capacity = row["_size"] or 0, row["_capacity"]
        if self.used and self.used + size > capacity:
            self.bin, self.used = self.bin + 1, 0
        yield row["_key"], self.bin, self.used
        self.used += size


def greedy_bins(df: DataFrame, by: list[str], order: str, size: Column, capacity: int, chunk: int = 100_000) -> DataFrame:
    """by, chunk, order, bin (from 1 on) and start (what stands before the row in its bin) of every row.

    ``order`` is a whole number that tells the rows of a list apart. A list is packed in pieces of ``chunk`` places of it, so a hot
    list is many partitions; a bin holds rows of one piece. A row larger than ``capacity`` is a bin of its own.
    """
    from pyspark.sql.functions import udtf

    cut = F.floor(F.col(order) / chunk).cast("long").alias("chunk")
    rows = df.select(*by, cut, F.col(order).cast("long").alias("_key"), size.cast("long").alias("_size"), F.lit(capacity).cast("long").alias("_capacity"))
    scan = udtf(GreedyBins, returnType="key long, bin long, start long")
    placed = scan(rows.asTable().partitionBy(*by, "chunk").orderBy("_key"))
    keys = rows.select(*by, "chunk", "_key")
    return keys.join(placed, F.col("_key") == F.col("key")).select(*by, "chunk", F.col("key").alias(order), "bin", "start")
