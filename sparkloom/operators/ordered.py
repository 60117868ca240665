"""Running sums, row numbers and quantiles over long orders, without a task that holds a whole order.

A list is cut into blocks of places. Blocks are summed first, the few sums are
added up along the list, and each block then runs on its own from the sum before
it. A total order is cut into sorted ranges in the same way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.session import stored


def running_sums(df: DataFrame, by: list[str], at: str, sums: dict[str, Column], block: int = 1 << 16, then: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with, for each name of ``sums``, the sum of its expression over the rows of the list ``by`` up to and with this one.

    ``at`` is a whole number that orders a list, ``then`` further columns for
    rows at one place. A task holds the rows of ``block`` places of a list, or
    one row for each block of it. Rows with a null ``at`` come first.
    """
    own, before = {k: f"_own_{k}" for k in sums}, {k: f"_before_{k}" for k in sums}
    rows = df.select("*", F.floor(F.col(at) / block).alias("_block"), *[x.alias(own[k]) for k, x in sums.items()])
    parts = rows.groupBy(*by, "_block").agg(*[F.sum(own[k]).alias(own[k]) for k in sums])
    ahead = Window.partitionBy(*by).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(*by, "_block", *[F.coalesce(F.sum(own[k]).over(ahead), F.lit(0)).alias(before[k]) for k in sums])
    keys = [*by, "_block"]
    both = rows.alias("r").join(parts.alias("p"), [F.col(f"r.{k}").eqNullSafe(F.col(f"p.{k}")) for k in keys])
    both = both.select("r.*", *[F.col(f"p.{before[k]}") for k in sums])
    inside = Window.partitionBy(*keys).orderBy(at, *then).rowsBetween(Window.unboundedPreceding, 0)
    return both.select(*df.columns, *[(F.sum(own[k]).over(inside) + F.col(before[k])).alias(k) for k in sums])


def match_brackets(steps: DataFrame, by: list[str], at: str, opens: Column, closes: Column, carry: tuple[str, ...] = (), block: int = 1 << 16) -> DataFrame:
    """by, start, stop for each opening row and the row that closes it, with ``carry`` columns of both (``name``, ``name_stop``).

    The depth is a running sum. Rows that open and close at one depth alternate,
    so the k-th of either kind belong together: an equi-join on list, depth and
    rank. Rows without a partner give nothing; ``bracket_balance`` reports them.
    Depths and ranks are written as they are found, so that no step is computed again.
    """
    rows = steps.where(opens | closes).select(*by, at, opens.alias("_open"), *carry)
    rows = running_sums(rows, by, at, {"_depth": F.when(F.col("_open"), 1).otherwise(-1)}, block)
    rows = stored(rows.withColumn("_level", F.col("_depth") + F.when(F.col("_open"), 0).otherwise(1)))
    rows = stored(running_sums(rows, [*by, "_level"], at, {"_rank": F.col("_open").cast("int")}, block))
    keys = [*by, "_level", "_rank"]
    first = rows.where("_open").select(*keys, F.col(at).alias("start"), *carry)
    last = rows.where(~F.col("_open")).select(*keys, F.col(at).alias("stop"), *[F.col(c).alias(f"{c}_stop") for c in carry])
    return first.join(last, keys).select(*by, "start", "stop", *carry, *[f"{c}_stop" for c in carry])


def bracket_balance(steps: DataFrame, by: list[str], at: str, opens: Column, closes: Column, block: int = 1 << 16) -> DataFrame:
    """by, n_pairs, unopened and unclosed of each list that has a row: how many are paired, close nothing, and stay open."""
    rows = running_sums(steps.select(*by, at, F.when(opens, 1).when(closes, -1).otherwise(0).alias("_step")), by, at, {"_depth": F.col("_step")}, block)
    lowest = F.greatest(-F.min("_depth"), F.lit(0))
    closing = F.sum(F.when(F.col("_step") < 0, 1).otherwise(0))
    return rows.groupBy(*by).agg((closing - lowest).alias("n_pairs"), lowest.alias("unopened"), (F.sum("_step") + lowest).alias("unclosed"))


def outside_intervals(rows: DataFrame, intervals: DataFrame, by: list[str], at: str, block: int = 1 << 16) -> DataFrame:
    """The rows whose place is in no interval start <= at < stop of their list; intervals may overlap and hold one another.

    Starts and stops are laid among the rows, and a running sum tells how many intervals are open. The rows are written once, as
    sums and rows both read them.
    """
    edge = lambda place, step: intervals.where("start < stop").select(*by, F.col(place).alias(at), F.lit(step).alias("_step"), F.lit(None).alias("_row"))
    kept = rows.select(*by, at, F.lit(0).alias("_step"), F.struct("*").alias("_row"))
    both = kept.unionByName(edge("start", 1)).unionByName(edge("stop", -1)).withColumn("_late", F.col("_row").isNotNull())
    both = stored(both)
    covered = running_sums(both, by, at, {"_open": F.col("_step")}, block, then=("_late",))
    return covered.where("_late and _open = 0").select("_row.*")


def row_numbers(df: DataFrame, *order: Column | str, name: str = "row_number", parts: int | None = None) -> DataFrame:
    """``df`` with the place from 1 on of each row in the order of all rows.

    Rows are dealt into sorted ranges, which are written; the counts of the ranges
    (a row each) give where each begins. Rows that are equal in ``order`` come in any order.
    """
    spark = df.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    sorted_rows = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    rows = stored(sorted_rows.withColumn("_id", F.monotonically_increasing_id()))  # the range's number, then 33 bits of place in it
    place, part = F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)), F.shiftrightunsigned("_id", 33)
    counts = rows.groupBy(part.alias("_part")).agg(F.count("*").alias("n")).orderBy("_part").collect()  # a row for each range
    base, bases = 0, []
    for r in counts:
        bases.append((r["_part"], base))
        base += r.n
    if not bases:
        return rows.withColumn(name, F.lit(None).cast("long")).drop("_id")
    begins = F.broadcast(spark.createDataFrame(bases, "_part long, _base long"))
    return rows.withColumn("_part", part).join(begins, "_part").withColumn(name, F.col("_base") + place + 1).drop("_id", "_part", "_base")


def exact_quantiles(df: DataFrame, value: str, at: list[float]) -> DataFrame:
    """quantile and value: for each share the smallest value that so many of the values that aren't null don't exceed."""
    known = df.where(F.col(value).isNotNull()).select(value)
    numbered = row_numbers(known, value)
    n = numbered.count()
    wanted = [(q, max(1, -(-int(round(q * n * 1e9)) // 10**9))) for q in at] if n else []
    places = F.broadcast(df.sparkSession.createDataFrame(wanted, "quantile double, row_number long"))
    return numbered.join(places, "row_number").select("quantile", F.col(value).alias("value"))
