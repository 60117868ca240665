"""Reports from pages in a row each, against those from joined pages; what the page queries shuffle."""

import random

import duckdb
from pyspark.sql import functions as F

from sparkloom.operators.content import checks_report, row_report
from sparkloom.functions.layout import changed_pixels, compare_pages, outside_boxes
from sparkloom.plans.content_queries import _BLOCKS, dealt_blocks, page_comparison
from sparkloom.session import table
from tests.test_intervals import shuffles
from tests.test_oracles import DATA

PAGE = "struct<doc: string, page: long, width: int, height: int, links: int, spans: array<struct<text: string, color: int, size: double, bbox: array<double>>>, pixels: array<int>>"


def test_row_report(spark):
    rng, rows = random.Random(11), []
    for k in range(60):
        old = [rng.choice([0, 255, None]) for _ in range(rng.choice([0, 30, 200]))]
        new = [rng.choice([v, v, v, v, 7]) for v in old]
        spans = [("t", rng.choice([0, 0xFCFCFC]), 9.0, [0.0, 0.0, 1.0, 1.0])]
        page = lambda p, s: (f"d{k % 4}", k, 10, 20, 1, s, p)  # noqa: B023, E731
        boxes = [(float(x), float(y), x + rng.choice([-9.0, 1.0, 5.0]), y + 2.0) for x, y in [(rng.randint(0, 9), rng.randint(0, 19))] * rng.randint(0, 2)]
        rows.append((f"d{k % 4}", k, k % 3, page(old, spans), page(new, rng.choice([spans, []])), boxes))
    kind = f"doc string, page long, removed int, b {PAGE}, a {PAGE}, boxes array<struct<x0: double, y0: double, x1: double, y1: double>>"
    df = spark.createDataFrame(rows, kind)
    before, after = df.select("b.*"), df.select("a.*")
    points = changed_pixels(before, after)
    count = lambda p, name: p.groupBy("doc", "page").agg(F.count("*").alias(name))
    stray = outside_boxes(points, df.select("doc", "page", F.inline("boxes")))
    checks = compare_pages(before, after).join(df.select("doc", "page", F.col("removed").cast("long").alias("removed")), ["doc", "page"])
    checks = checks.join(count(points, "changed_pixels"), ["doc", "page"], "left").join(count(stray, "stray_pixels"), ["doc", "page"], "left").fillna(0)
    want = sorted(r.report for r in checks_report(checks).collect())
    assert sorted(r.report for r in row_report(df).collect()) == want and '"stray_pixels":0' in want[0] and len(want) == 4


def test_only_blocks_are_shuffled(spark):
    """Twice for each line, not once and more for each operator of it."""
    n = table(spark, DATA, "lineitem").count()
    moved = sum(int(x.metrics().apply("shuffleRecordsWritten").value()) for x in shuffles(page_comparison(spark, DATA)))
    assert 0 < moved <= 2 * n


def test_lines_are_shuffled_once(spark):
    """One shuffle, by page, a narrow row for each line."""
    found = shuffles(page_comparison(spark, DATA))
    assert len(found) == 1 and int(found[0].metrics().apply("shuffleRecordsWritten").value()) == table(spark, DATA, "lineitem").count()


def test_hidden_is_the_greatest_flag(spark, tmp_path):
    """Of lines with one number the greatest flag and size count, also flags behind R, and null only where all are."""
    flags = [["R", "A"], ["R", "S"], [None, "R"], [None, None], ["RR"], ["r", "R"], ["", "N"], ["R"], [None, "A"], [None, "S"]]
    rows = [(k, k % 3 + 1, f, float(n)) for k, fs in enumerate(flags) for n, f in enumerate(fs)] + [(None, 1, "R", 3.0), (None, 1, "R", 4.0), (4, None, "R", None), (-9, 2, "A", None)]
    path = str(tmp_path / "lineitem.parquet")
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_returnflag string, l_quantity double").write.parquet(path)
    sql = _BLOCKS.replace("lineitem", f"'{path}/*.parquet'")
    assert sorted(map(str, map(tuple, dealt_blocks(spark, str(tmp_path)).collect()))) == sorted(map(str, duckdb.sql(f"FROM {sql}").fetchall()))
