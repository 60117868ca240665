"""Relational queries over the driver's tables, each beside SQL that another engine can run.

Money is summed as exact decimals and returned as double, so that results don't
depend on the order of addition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.operators.intervals import overlap_pairs
from sparkloom.operators.study import as_of, interpolate
from sparkloom.session import stored, table

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None):
    def add(f):
        if f.__name__ in QUERIES:
            raise ValueError(f"{f.__name__} is registered already")
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def money(c: Column, scale: int = 2) -> Column:
    return c.cast(f"decimal(18,{scale})")


def total(c: Column) -> Column:
    return F.sum(c).cast("double")


def micros(ts: str = "ts") -> Column:
    """Microseconds since 1970 of a timestamp with or without a zone (the session's is UTC)."""
    return F.unix_micros(F.col(ts).cast("timestamp"))


REVENUE = "sum(CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(4,2))))"


def revenue() -> Column:
    return F.sum(F.col("l_extendedprice").cast("decimal(12,2)") * (1 - F.col("l_discount").cast("decimal(4,2)"))).cast("double")


@query(f"SELECT n_name, year(o_orderdate) AS o_year, CAST({REVENUE} AS DOUBLE) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL")
def revenue_by_nation_year(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey", F.year("o_orderdate").alias("o_year"))
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_extendedprice", "l_discount")
    people = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name")
    joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(people, F.col("o_custkey") == F.col("c_custkey"))
    return joined.groupBy("n_name", "o_year").agg(revenue().alias("revenue")).orderBy("n_name", "o_year")


@query("SELECT l_orderkey, l_partkey, l_quantity * 2 AS twice FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-01-01' AND l_shipdate < TIMESTAMP '1998-03-01' AND l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24")
def filter_project(spark, d):
    return table(spark, d, "lineitem").where("l_shipdate >= TIMESTAMP '1998-01-01' AND l_shipdate < TIMESTAMP '1998-03-01' AND l_discount BETWEEN 0.05D AND 0.07D AND l_quantity < 24").select("l_orderkey", "l_partkey", (F.col("l_quantity") * 2).alias("twice"))


@query(f"SELECT l_returnflag, l_linestatus, CAST(sum(CAST(l_quantity AS DECIMAL(12,2))) AS DOUBLE) AS sum_qty, CAST({REVENUE} AS DOUBLE) AS revenue, CAST(sum(CAST(l_quantity AS DECIMAL(12,2))) AS DOUBLE) / count(l_quantity) AS avg_qty, count(*) AS n_lines FROM lineitem WHERE l_shipdate <= TIMESTAMP '2001-09-02' GROUP BY ALL")
def pricing_summary(spark, d):
    rows = table(spark, d, "lineitem").where("l_shipdate <= TIMESTAMP '2001-09-02'")
    quantity = total(F.col("l_quantity").cast("decimal(12,2)"))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(quantity.alias("sum_qty"), revenue().alias("revenue"), (quantity / F.count("l_quantity")).alias("avg_qty"), F.count("*").alias("n_lines"))


@query("SELECT r_name, count(*) AS n_suppliers FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL")
def join_broadcast(spark, d):
    # nation and region have a fixed number of rows
    small = table(spark, d, "nation").join(F.broadcast(table(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    return table(spark, d, "supplier").join(F.broadcast(small), F.col("s_nationkey") == F.col("n_nationkey")).groupBy("r_name").agg(F.count("*").alias("n_suppliers"))


@query("SELECT c_custkey, count(o_orderkey) AS n_orders FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL")
def join_left_outer(spark, d):
    counts = table(spark, d, "orders").groupBy("o_custkey").agg(F.count("o_orderkey").alias("n"))
    return table(spark, d, "customer").join(counts, F.col("o_custkey") == F.col("c_custkey"), "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n_orders"))


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")
def join_semi(spark, d):
    big = table(spark, d, "orders").where("o_totalprice > 400000").select("o_custkey")
    return table(spark, d, "customer").join(big, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_name")


@query("SELECT p_partkey, p_name FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 48)")
def join_anti(spark, d):
    sold = table(spark, d, "lineitem").where("l_quantity > 48").select("l_partkey")
    return table(spark, d, "part").join(sold, F.col("p_partkey") == F.col("l_partkey"), "left_anti").select("p_partkey", "p_name")


@query("SELECT coalesce(a.k, b.k) AS nationkey, coalesce(a.n, 0) AS n_customers, coalesce(b.n, 0) AS n_suppliers FROM (SELECT c_nationkey AS k, count(*) AS n FROM customer WHERE c_acctbal > 9000 GROUP BY 1) a FULL JOIN (SELECT s_nationkey AS k, count(*) AS n FROM supplier WHERE s_acctbal > 5000 GROUP BY 1) b ON a.k = b.k")
def join_full_outer(spark, d):
    a = table(spark, d, "customer").where("c_acctbal > 9000").groupBy(F.col("c_nationkey").alias("nationkey")).agg(F.count("*").alias("n_customers"))
    b = table(spark, d, "supplier").where("s_acctbal > 5000").groupBy(F.col("s_nationkey").alias("nationkey")).agg(F.count("*").alias("n_suppliers"))
    return a.join(b, "nationkey", "full").select("nationkey", F.coalesce("n_customers", F.lit(0)).alias("n_customers"), F.coalesce("n_suppliers", F.lit(0)).alias("n_suppliers"))


@query("SELECT a.s_suppkey AS one, b.s_suppkey AS two FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey AND abs(a.s_acctbal - b.s_acctbal) < 500")
def join_self(spark, d):
    s = table(spark, d, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal")
    a, b = s.alias("a"), s.alias("b")
    return a.join(b, F.expr("a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey AND abs(a.s_acctbal - b.s_acctbal) < 500")).select(F.col("a.s_suppkey").alias("one"), F.col("b.s_suppkey").alias("two"))


@query("SELECT /* sort-merge */ o_orderpriority, count(*) AS n_lines FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL")
def join_sort_merge(spark, d):
    return table(spark, d, "orders").hint("merge").join(table(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).groupBy("o_orderpriority").agg(F.count("*").alias("n_lines"))


def range_join(points: DataFrame, at: str, ranges: DataFrame, start: str, stop: str, width: float) -> DataFrame:
    """Points with the half-open ranges that hold them, joined by bins.

    Bins are ``width`` wide, twice that, and so on; a range goes to the at most two bins of the first size that is not
    narrower than itself, so a long range is no more rows than a short one. A point goes to one bin of each size that
    some range has, a list of some 2,000 sizes at most, as lengths are doubles. Null or empty ranges and null points
    meet nothing.
    """
    length = F.col(stop).cast("double") - F.col(start).cast("double")
    size = F.ceil(F.greatest(F.least(F.log2(length / width), F.lit(1100.0)), F.lit(0.0))).cast("int")  # 1100: a bin without end
    bin_of = lambda x: F.floor(F.col(x) / (F.lit(float(width)) * F.pow(F.lit(2.0), F.col("_size"))))
    r = ranges.where(F.col(start) < F.col(stop)).withColumn("_size", size)
    sizes = r.select("_size").distinct()
    r = r.withColumn("_bin", F.explode(F.sequence(bin_of(start), bin_of(stop))))
    p = points.where(F.col(at).isNotNull()).join(F.broadcast(sizes)).withColumn("_bin", bin_of(at))
    return p.join(r, ["_size", "_bin"]).where((F.col(at) >= F.col(start)) & (F.col(at) < F.col(stop))).drop("_size", "_bin")


BANDS = [(1, 0.0, 50000.0), (2, 40000.0, 200000.0), (3, 200000.0, 350000.0), (4, 300000.0, 900000.0)]


@query(f"SELECT band, count(*) AS n_orders FROM orders JOIN (VALUES {', '.join(map(str, BANDS))}) b(band, lo, hi) ON o_totalprice >= lo AND o_totalprice < hi GROUP BY ALL")
def join_range(spark, d):
    bands = spark.createDataFrame(BANDS, "band int, lo double, hi double")
    return range_join(table(spark, d, "orders").select("o_totalprice"), "o_totalprice", bands, "lo", "hi", 50000.0).groupBy("band").agg(F.count("*").alias("n_orders"))


_SPANS = "(SELECT event_id, user_id, epoch_us(ts) // 1000000 AS start, epoch_us(ts) // 1000000 + CAST(floor(value * value) AS BIGINT) AS stop FROM events WHERE event_type = 'purchase' AND floor(value * value) > 0)"


@query(f"SELECT a.event_id, b.event_id AS other_id, greatest(a.start, b.start) AS since FROM {_SPANS} a JOIN {_SPANS} b ON a.event_id < b.event_id AND a.start < b.stop AND b.start < a.stop")
def join_overlap(spark, d):
    """Pairs of purchases whose spans, of a second up to hours by their value, overlap: each pair once; an empty span overlaps none."""
    begin = F.floor(micros() / 1_000_000).cast("long")
    spans = table(spark, d, "events").where("event_type = 'purchase'").select("event_id", begin.alias("start"), (begin + F.floor(F.col("value") * F.col("value"))).alias("stop"))
    pairs = overlap_pairs(spans, "event_id", "start", "stop", 600.0)
    return pairs.select("event_id", F.col("other.event_id").alias("other_id"), F.greatest("start", "other.start").alias("since"))


@query("SELECT a.event_id, b.value AS last_view FROM (SELECT * FROM events WHERE event_type = 'purchase') a ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') b ON a.user_id = b.user_id AND a.ts >= b.ts")
def join_as_of(spark, d):
    e = table(spark, d, "events")
    return as_of(e.where("event_type = 'purchase'"), e.where("event_type = 'view'"), ["user_id"], "ts", "value", ["event_id"]).select("event_id", F.col("value").alias("last_view"))


@query("SELECT r_name, seg, size FROM region CROSS JOIN (SELECT DISTINCT c_mktsegment AS seg FROM customer) CROSS JOIN (VALUES (1), (2), (3)) v(size)")
def factorial_grid(spark, d):
    from sparkloom.operators.study import grid

    return grid(table(spark, d, "region").select("r_name"), table(spark, d, "customer").select(F.col("c_mktsegment").alias("seg")), spark.createDataFrame([(1,), (2,), (3,)], "size int"))


@query("SELECT c_custkey AS k, 'base' AS origin FROM customer WHERE c_acctbal > 5000 UNION ALL SELECT c_custkey, 'more' FROM customer WHERE c_acctbal > 2000 AND NOT c_acctbal > 5000")
def superset_union(spark, d):
    from sparkloom.operators.study import superset

    c = table(spark, d, "customer")
    return superset(c.where("c_acctbal > 5000").select(F.col("c_custkey").alias("k")), c.where("c_acctbal > 2000").select(F.col("c_custkey").alias("k")), ["k"])


@query("SELECT l_suppkey AS k FROM lineitem WHERE l_discount > 0.08 INTERSECT SELECT l_suppkey FROM lineitem WHERE l_tax > 0.07")
def set_intersect(spark, d):
    rows = table(spark, d, "lineitem")
    return rows.where("l_discount > 0.08").select(F.col("l_suppkey").alias("k")).intersect(rows.where("l_tax > 0.07").select("l_suppkey"))


@query("SELECT l_partkey AS k FROM lineitem WHERE l_quantity > 48 EXCEPT ALL SELECT l_partkey FROM lineitem WHERE l_discount > 0.09 AND l_tax > 0.07")
def set_except_all_lines(spark, d):
    rows = table(spark, d, "lineitem")
    return rows.where("l_quantity > 48").select(F.col("l_partkey").alias("k")).exceptAll(rows.where("l_discount > 0.09D AND l_tax > 0.07D").select("l_partkey"))


@query("SELECT DISTINCT p_brand, p_type FROM part")
def distinct_rows(spark, d):
    return table(spark, d, "part").select("p_brand", "p_type").distinct()


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n, grouping(o_orderpriority) AS g FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
def aggregate_rollup(spark, d):
    return table(spark, d, "orders").rollup("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), F.grouping("o_orderpriority").cast("long").alias("g"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def aggregate_cube(spark, d):
    return table(spark, d, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))


@query("SELECT p_brand, p_size, count(*) AS n FROM part GROUP BY GROUPING SETS ((p_brand), (p_size), ())")
def aggregate_grouping_sets(spark, d):
    return table(spark, d, "part").groupingSets([["p_brand"], ["p_size"], []], "p_brand", "p_size").agg(F.count("*").alias("n"))


@query("SELECT l_returnflag, count(DISTINCT l_suppkey) AS suppliers, count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY ALL")
def aggregate_distinct(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.count_distinct("l_suppkey").alias("suppliers"), F.count_distinct("l_partkey").alias("parts"))


@query("SELECT event_type, true AS users_close, true AS median_close FROM events GROUP BY ALL")
def aggregate_approximate(spark, d):
    """Sketches beside exact values: both must be close."""
    e = table(spark, d, "events").groupBy("event_type").agg(
        F.approx_count_distinct("user_id", 0.02).alias("a"), F.count_distinct("user_id").alias("b"), F.percentile_approx("value", 0.5, 10000).alias("c"), F.median("value").alias("m")
    )
    return e.select("event_type", (F.abs(F.col("a") - F.col("b")) <= 0.1 * F.col("b")).alias("users_close"), (F.abs(F.col("c") - F.col("m")) <= 0.05 * F.abs("m") + 0.05).alias("median_close"))


@query("SELECT c_mktsegment, median(c_acctbal) AS mid, quantile_cont(c_acctbal, 0.9) AS p90 FROM customer GROUP BY ALL")
def aggregate_quantiles(spark, d):
    return table(spark, d, "customer").groupBy("c_mktsegment").agg(F.median("c_acctbal").alias("mid"), F.expr("percentile_cont(0.9) WITHIN GROUP (ORDER BY c_acctbal)").alias("p90"))


@query("SELECT l_returnflag, round(corr(l_quantity, l_extendedprice), 6) AS r, round(regr_slope(l_extendedprice, l_quantity), 3) AS slope, round(stddev_samp(l_quantity), 6) AS sd, round(avg(l_quantity * l_quantity * l_quantity), 2) AS third FROM lineitem GROUP BY ALL")
def aggregate_statistics(spark, d):
    q = F.col("l_quantity")
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(
        F.round(F.corr("l_quantity", "l_extendedprice"), 6).alias("r"), F.round(F.regr_slope("l_extendedprice", "l_quantity"), 3).alias("slope"), F.round(F.stddev_samp("l_quantity"), 6).alias("sd"), F.round(F.avg(q * q * q), 2).alias("third")
    )


@query("SELECT p_type, arg_min(p_partkey, p_retailprice * 1000000 + p_partkey) AS cheapest, max(p_retailprice) AS top FROM part GROUP BY ALL")
def aggregate_min_by(spark, d):
    return table(spark, d, "part").groupBy("p_type").agg(F.min_by("p_partkey", F.struct("p_retailprice", "p_partkey")).alias("cheapest"), F.max("p_retailprice").alias("top"))


@query("SELECT o_orderstatus, count(*) FILTER (o_orderpriority = '1-URGENT') AS urgent, count(*) FILTER (o_orderpriority = '5-LOW') AS low FROM orders GROUP BY ALL")
def pivot_priorities(spark, d):
    return table(spark, d, "orders").groupBy("o_orderstatus").pivot("o_orderpriority", ["1-URGENT", "5-LOW"]).agg(F.count("o_orderkey")).select("o_orderstatus", F.coalesce("1-URGENT", F.lit(0)).alias("urgent"), F.coalesce("5-LOW", F.lit(0)).alias("low"))


@query("SELECT s_suppkey, kind, v FROM (SELECT s_suppkey, CAST(s_nationkey AS DOUBLE) AS nation, s_acctbal AS balance FROM supplier) UNPIVOT (v FOR kind IN (nation, balance))")
def unpivot_columns(spark, d):
    return table(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").cast("double").alias("nation"), F.col("s_acctbal").alias("balance")).unpivot("s_suppkey", ["nation", "balance"], "kind", "v")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def top_k(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25)


@query("SELECT c_nationkey, c_custkey, rn FROM (SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS rn FROM customer) WHERE rn <= 3")
def top_k_per_group(spark, d):
    w = Window.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"), "c_custkey")
    return table(spark, d, "customer").select("c_nationkey", "c_custkey", F.row_number().over(w).alias("rn")).where("rn <= 3")


@query("SELECT s_suppkey, rank() OVER w AS r, dense_rank() OVER w AS dr, ntile(4) OVER (PARTITION BY s_nationkey ORDER BY s_acctbal, s_suppkey) AS q, round(percent_rank() OVER w, 9) AS pr, round(cume_dist() OVER w, 9) AS cd FROM supplier WINDOW w AS (PARTITION BY s_nationkey ORDER BY s_acctbal)")
def window_ranking(spark, d):
    w, u = Window.partitionBy("s_nationkey").orderBy("s_acctbal"), Window.partitionBy("s_nationkey").orderBy("s_acctbal", "s_suppkey")
    return table(spark, d, "supplier").select("s_suppkey", F.rank().over(w).alias("r"), F.dense_rank().over(w).alias("dr"), F.ntile(4).over(u).alias("q"), F.round(F.percent_rank().over(w), 9).alias("pr"), F.round(F.cume_dist().over(w), 9).alias("cd"))


@query("SELECT event_id, lag(value) OVER w AS before, lead(value, 2, -1.0) OVER w AS after, first_value(value) OVER w AS first, last_value(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def window_analytic(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return table(spark, d, "events").select("event_id", F.lag("value").over(w).alias("before"), F.lead("value", 2, -1.0).over(w).alias("after"), F.first("value").over(w).alias("first"), F.last("value").over(whole).alias("last"))


@query("SELECT event_id, CAST(sum(CAST(value AS DECIMAL(18,2))) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS DOUBLE) AS last3, count(*) OVER (PARTITION BY user_id ORDER BY epoch(ts) RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW) AS day_count FROM events")
def window_frames(spark, d):
    rows = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-2, 0)
    day = Window.partitionBy("user_id").orderBy(micros()).rangeBetween(-86400 * 1000000, 0)
    return table(spark, d, "events").select("event_id", F.sum(F.col("value").cast("decimal(18,2)")).over(rows).cast("double").alias("last3"), F.count("*").over(day).alias("day_count"))


@query("WITH e AS (SELECT *, CASE WHEN ts - lag(ts) OVER w > INTERVAL 6 HOUR THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM e) SELECT user_id, CAST(session AS BIGINT) AS session, count(*) AS n FROM s GROUP BY ALL")
def sessions(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    gap = micros() - F.lag(micros()).over(w) > 6 * 3600 * 1000000
    e = table(spark, d, "events").withColumn("new", F.when(gap, 1).otherwise(0)).withColumn("session", F.sum("new").over(w))
    return e.groupBy("user_id", "session").agg(F.count("*").alias("n"))


@query("SELECT CAST(epoch(time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01')) AS BIGINT) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def tumbling_windows(spark, d):
    return table(spark, d, "events").groupBy(F.window("ts", "6 hours").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.unix_seconds(F.col("w.start").cast("timestamp")).alias("start"), "event_type", "n")


@query("SELECT CAST(epoch(time_bucket(INTERVAL 1 HOUR, ts, TIMESTAMP '1970-01-01')) AS BIGINT) - 3600 * k AS start, count(*) AS n FROM events CROSS JOIN (VALUES (0), (1), (2)) v(k) GROUP BY ALL")
def sliding_windows(spark, d):
    return table(spark, d, "events").groupBy(F.window("ts", "3 hours", "1 hour").alias("w")).agg(F.count("*").alias("n")).select(F.unix_seconds(F.col("w.start").cast("timestamp")).alias("start"), "n")


@query("SELECT p_partkey, upper(p_name) AS up, split_part(p_name, ' ', 1) AS first, length(p_name) AS n, replace(p_name, 'ring', 'RING') AS r, regexp_extract(p_brand, '#([0-9]+)', 1) AS num, levenshtein(p_name, 'small ring') AS dist, substr(p_type, 1, 3) AS s, lpad(p_brand, 10, '*') AS l, concat_ws('-', p_brand, p_type) AS c FROM part")
def string_functions(spark, d):
    return table(spark, d, "part").select(
        "p_partkey", F.upper("p_name").alias("up"), F.split_part("p_name", F.lit(" "), F.lit(1)).alias("first"), F.length("p_name").cast("long").alias("n"), F.replace("p_name", F.lit("ring"), F.lit("RING")).alias("r"),
        F.regexp_extract("p_brand", "#([0-9]+)", 1).alias("num"), F.levenshtein("p_name", F.lit("small ring")).cast("long").alias("dist"), F.substring("p_type", 1, 3).alias("s"), F.lpad("p_brand", 10, "*").alias("l"), F.concat_ws("-", "p_brand", "p_type").alias("c"),
    )


@query("SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, dayofweek(o_orderdate) + 1 AS dow, date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS days, strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS month, strftime(o_orderdate + INTERVAL 30 DAY, '%Y-%m-%d') AS due, strftime(last_day(o_orderdate), '%Y-%m-%d') AS last FROM orders")
def date_functions(spark, d):
    day = "yyyy-MM-dd"
    return table(spark, d, "orders").select(
        "o_orderkey", F.year("o_orderdate").cast("long").alias("y"), F.month("o_orderdate").cast("long").alias("m"), F.dayofweek("o_orderdate").cast("long").alias("dow"), F.datediff("o_orderdate", F.lit("1995-01-01").cast("date")).cast("long").alias("days"),
        F.date_format(F.date_trunc("month", "o_orderdate"), day).alias("month"), F.date_format(F.date_add("o_orderdate", 30), day).alias("due"), F.date_format(F.last_day("o_orderdate"), day).alias("last"),
    )


@query("SELECT l_orderkey, l_linenumber, l_partkey, abs(l_tax - l_discount) AS a, l_orderkey % 7 AS m, l_orderkey // 7 AS q, round(ln(l_extendedprice), 9) AS ln, round(power(l_quantity, 1.5), 6) AS p, floor(l_quantity / 7) AS f, ceil(l_quantity / 7) AS c, greatest(l_tax, l_discount) AS g, sign(l_tax - l_discount) AS s FROM lineitem")
def math_functions(spark, d):
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", F.abs(F.col("l_tax") - F.col("l_discount")).alias("a"), (F.col("l_orderkey") % 7).alias("m"), F.expr("l_orderkey div 7").alias("q"), F.round(F.ln("l_extendedprice"), 9).alias("ln"),
        F.round(F.pow("l_quantity", F.lit(1.5)), 6).alias("p"), F.floor(F.col("l_quantity") / 7).cast("double").alias("f"), F.ceil(F.col("l_quantity") / 7).cast("double").alias("c"), F.greatest("l_tax", "l_discount").alias("g"), F.signum(F.col("l_tax") - F.col("l_discount")).cast("int").alias("s"),
    )


@query("SELECT vec_id, len(embedding) AS n, len(list_filter(embedding, lambda x: x > 0)) AS positive, round(list_max(embedding), 5) AS top, list_position(embedding, list_max(embedding)) AS at FROM embeddings")
def array_functions(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.size("embedding").cast("long").alias("n"), F.size(F.filter("embedding", lambda x: x > 0)).cast("long").alias("positive"), F.round(F.array_max("embedding").cast("float"), 5).alias("top"), F.array_position("embedding", F.array_max("embedding")).cast("int").alias("at"))


@query("SELECT user_id, count(*) AS n, max(CASE WHEN event_type = 'purchase' THEN c END) AS purchases FROM (SELECT user_id, event_type, count(*) AS c FROM events GROUP BY ALL) GROUP BY ALL")
def map_functions(spark, d):
    counts = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("c")).groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "c"))).alias("m"))
    return counts.select("user_id", F.size("m").cast("long").alias("n"), F.try_element_at("m", F.lit("purchase")).alias("purchases"))


@query("SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY ALL")
def json_functions(spark, d):
    return table(spark, d, "events").groupBy(F.from_json("props", "k long")["k"].alias("k")).agg(F.count("*").alias("n"))


@query("SELECT p_partkey, sha256(p_name) AS sha, md5(p_name) AS md FROM part")
def hash_functions(spark, d):
    return table(spark, d, "part").select("p_partkey", F.sha2("p_name", 256).alias("sha"), F.md5(F.col("p_name").cast("binary")).alias("md"))


@query("SELECT event_id, value - CAST((SELECT avg(b.value) FROM events b WHERE b.event_type = a.event_type) AS DOUBLE) > 0 AS above FROM events a")
def correlated_subquery(spark, d):
    e = table(spark, d, "events")
    return spark.sql("SELECT event_id, value - (SELECT avg(b.value) FROM {e} b WHERE b.event_type = a.event_type) > 0 AS above FROM {e} a", e=e)


@query("WITH p AS (SELECT user_id, min(epoch(ts)) AS a, max(epoch(ts)) AS b FROM events GROUP BY 1), t AS (SELECT user_id, a + (b - a) * k / 4 AS x FROM p CROSS JOIN (VALUES (1), (2), (3)) v(k)) SELECT t.user_id, count(*) AS n, true AS inside FROM t JOIN p USING (user_id) GROUP BY ALL")
def interpolated_values(spark, d):
    """Values of each user between known points; all lie within the user's range."""
    e = table(spark, d, "events").select("user_id", (micros() / 1e6).alias("x"), "value")
    ends = e.groupBy("user_id").agg(F.min("x").alias("a"), F.max("x").alias("b"), F.min("value").alias("lo"), F.max("value").alias("hi"))
    asked = ends.select("user_id", F.explode(F.array(*[F.col("a") + (F.col("b") - F.col("a")) * k / 4 for k in (1, 2, 3)])).alias("x"))
    got = interpolate(e, asked, ["user_id"], "x", "value", log=False).join(ends, "user_id")
    return got.groupBy("user_id").agg(F.count("value").alias("n"), F.bool_and(F.col("value").between(F.col("lo") - 1e-9, F.col("hi") + 1e-9)).alias("inside"))


@query("""
WITH k AS (SELECT user_id, epoch(ts) AS x, avg(value) AS y FROM events GROUP BY ALL),
e AS (SELECT user_id, min(x) AS a, max(x) AS b FROM k GROUP BY ALL),
t AS (SELECT user_id, a + (b - a) * part / 4 AS x FROM e CROSS JOIN (VALUES (1), (2), (3)) v(part)),
lo AS (SELECT t.user_id, t.x, k.x AS x0, k.y AS y0 FROM t ASOF JOIN k ON t.user_id = k.user_id AND t.x >= k.x),
hi AS (SELECT lo.*, k.x AS x1, k.y AS y1 FROM lo ASOF JOIN k ON lo.user_id = k.user_id AND lo.x <= k.x)
SELECT user_id, round(avg(CASE WHEN x0 = x1 THEN y0 ELSE y0 + (x - x0) / (x1 - x0) * (y1 - y0) END), 4) AS mean FROM hi GROUP BY ALL
""")
def interpolated_means(spark, d):
    """The mean of three values of each user between known points."""
    e = table(spark, d, "events").select("user_id", (micros() / 1e6).alias("x"), "value")
    ends = e.groupBy("user_id").agg(F.min("x").alias("a"), F.max("x").alias("b"))
    asked = ends.select("user_id", F.explode(F.array(*[F.col("a") + (F.col("b") - F.col("a")) * k / 4 for k in (1, 2, 3)])).alias("x"))
    got = interpolate(e, asked, ["user_id"], "x", "value", log=False)
    return got.groupBy("user_id").agg(F.round(F.avg("value"), 4).alias("mean"))


_MOMENTS = "avg(l_quantity) AS m1, avg(l_quantity ** 2) AS m2, avg(l_quantity ** 3) AS m3, avg(l_quantity ** 4) AS m4"


@query(
    f"""WITH m AS (SELECT l_returnflag, {_MOMENTS}, var_pop(l_quantity) AS v, var_samp(l_quantity) AS vs, covar_pop(l_quantity, l_discount) AS c FROM lineitem GROUP BY ALL)
    SELECT l_returnflag, round(v, 6) AS var_pop, round(vs, 6) AS var_samp, round(c, 6) AS covar,
    round((m3 - 3 * m1 * m2 + 2 * m1 ** 3) / v ** 1.5, 6) AS skew, round((m4 - 4 * m1 * m3 + 6 * m1 ** 2 * m2 - 3 * m1 ** 4) / v ** 2 - 3, 6) AS kurt FROM m"""
)
def aggregate_moments(spark, d):
    q = F.col("l_quantity")
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(
        F.round(F.var_pop(q), 6).alias("var_pop"),
        F.round(F.var_samp(q), 6).alias("var_samp"),
        F.round(F.covar_pop(q, "l_discount"), 6).alias("covar"),
        F.round(F.skewness(q), 6).alias("skew"),
        F.round(F.kurtosis(q), 6).alias("kurt"),
    )


@query("SELECT event_type, count(*) AS n FROM events GROUP BY ALL")
def aggregate_approximate_top(spark, d):
    """A sketch of the most frequent values, exact while it has room for all of them."""
    top = table(spark, d, "events").agg(F.expr("approx_top_k(event_type, 100, 1000)").alias("top"))
    return top.select(F.explode("top").alias("x")).select(F.col("x.item").alias("event_type"), F.col("x.count").alias("n"))


@query("SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier")
def set_intersect_all(spark, d):
    return table(spark, d, "customer").select(F.col("c_nationkey").alias("k")).intersectAll(table(spark, d, "supplier").select("s_nationkey"))


@query("SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier")
def set_except_all(spark, d):
    return table(spark, d, "customer").select(F.col("c_nationkey").alias("k")).exceptAll(table(spark, d, "supplier").select("s_nationkey"))


#: A level's sketches: distinct events and users with 2**12 cells, quantiles of value with k of 1024, the 5 top users in room for 64.
_LEVELS = "(SELECT CAST(ts AS DATE) AS day, event_type, event_id, user_id, value FROM events)"


@query(
    f"""SELECT 'type' AS level, event_type AS name, count(*) AS n, count(DISTINCT event_id) AS events, count(DISTINCT user_id) AS users, true AS within_bounds FROM {_LEVELS} GROUP BY event_type
    UNION ALL SELECT 'day', CAST(day AS VARCHAR), count(*), count(DISTINCT event_id), count(DISTINCT user_id), true FROM {_LEVELS} GROUP BY day
    UNION ALL SELECT 'all', 'all', count(*), count(DISTINCT event_id), count(DISTINCT user_id), true FROM {_LEVELS}"""
)
def sketches_merged_upward(spark, d):
    """Sketches stored by day and type, merged to days, to types and to all, each estimate held against the exact numbers.

    Bounds: three standard errors of 1.04 / sqrt(4096) for distinct values (0.5 at least), twice the 0.26 % of a sketch of k = 1024 for the
    rank of the median, and n / 64 for the counts of the most frequent users.
    """
    rows = table(spark, d, "events").select(F.col("ts").cast("date").cast("string").alias("day"), "event_type", "event_id", "user_id", "value")
    kept = stored(
        rows.groupBy("day", "event_type").agg(
            F.expr("hll_sketch_agg(event_id, 12)").alias("events"),
            F.expr("hll_sketch_agg(user_id, 12)").alias("users"),
            F.expr("kll_sketch_agg_double(value, 1024)").alias("value_ranks"),
            F.expr("approx_top_k_accumulate(user_id, 64)").alias("top"),
        )
    )
    out = None
    for level, name in (("type", F.col("event_type")), ("day", F.col("day")), ("all", F.lit("all"))):
        merged = kept.groupBy(name.alias("name")).agg(
            F.expr("hll_sketch_estimate(hll_union_agg(events))").alias("about_events"),
            F.expr("hll_sketch_estimate(hll_union_agg(users))").alias("about_users"),
            F.expr("kll_sketch_get_quantile_double(kll_merge_agg_double(value_ranks), 0.5D)").alias("middle"),
            F.expr("approx_top_k_estimate(approx_top_k_combine(top, 64), 5)").alias("top"),
        )
        named = rows.withColumn("name", name).join(F.broadcast(merged.select("name", "middle")), "name")  # a row for each name of the level
        exact = named.groupBy("name").agg(
            F.count("*").alias("n"), F.count_distinct("event_id").alias("events"), F.count_distinct("user_id").alias("users"),
            F.count_if(F.col("value") < F.col("middle")).alias("below"), F.count_if(F.col("value") <= F.col("middle")).alias("upto"), F.count("value").alias("known"),
        )
        counts = rows.groupBy(name.alias("name"), "user_id").agg(F.count("*").alias("c"))
        top = merged.select("name", F.explode("top").alias("x")).select("name", F.col("x.item").alias("user_id"), F.col("x.count").alias("about"))
        off = top.join(counts, ["name", "user_id"]).groupBy("name").agg(F.max(F.abs(F.col("about") - F.col("c"))).alias("off"))
        close = lambda a, b: F.abs(F.col(a) - F.col(b)) <= F.greatest(F.lit(0.5), 3 * 1.04 / 64 * F.col(b))
        rank = (F.col("below") <= (0.5 + 0.0052) * F.col("known") + 1) & (F.col("upto") >= (0.5 - 0.0052) * F.col("known") - 1)
        good = close("about_events", "events") & close("about_users", "users") & rank & (F.coalesce("off", F.lit(0)) <= F.col("n") / 64)  # no user may be frequent
        one = merged.join(exact, "name").join(off, "name", "left").select(F.lit(level).alias("level"), "name", "n", "events", "users", good.alias("within_bounds"))
        out = one if out is None else out.unionByName(one)
    return out
