"""Joins by edit distance against all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from sparkloom.functions import cleaning


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.mark.parametrize("most", [0, 1, 2, 3, 4])
def test_edit_pairs_are_all_pairs(spark, most):
    rng = random.Random(most)
    words = {"".join(rng.choices("abé", k=rng.randint(0, 9))) for _ in range(150)}
    for w in list(words)[:60]:
        for _ in range(rng.randint(1, 4)):
            at = rng.randint(0, len(w))
            w = w[:at] + rng.choice(["", "b", "xy"]) + w[at + rng.randint(0, 2) :]
        words.add(w)
    left, right = sorted(words)[::2] + [None, ""], sorted(words)[1::2] + [None, "", ""]
    want = {(a, b, n) for a in left for b in right if a is not None and b is not None for n in [distance(a, b)] if n <= most}
    got = cleaning.edit_pairs(spark.createDataFrame([(w,) for w in left], "a string"), spark.createDataFrame([(w,) for w in right], "b string"), "a", "b", most).collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_long_texts_and_hot_parts(spark):
    """Texts that share most parts, and a long one."""
    rows = [f"the very same beginning {k:04d} and the very same end" for k in range(0, 400, 7)] + ["x" * 3000, "x" * 2998 + "yz"]
    df = spark.createDataFrame([(r,) for r in rows], "a string")
    got = cleaning.edit_pairs(df, df.withColumnRenamed("a", "b"), "a", "b", 2).collect()
    assert {tuple(r) for r in got} == {(a, b, n) for a in rows for b in rows if abs(len(a) - len(b)) < 3 and len(a) < 3000 for n in [distance(a, b)] if n <= 2} | {(rows[i], rows[j], 0 if i == j else 2) for i in (-1, -2) for j in (-1, -2)}


def test_nearest_names(spark):
    right = spark.createDataFrame([("Small Ring",), ("small  ring",), ("Tall Ring",), ("red widget",), (None,)], "b string")
    left = spark.createDataFrame([("qmall ring",), ("all ring",), ("rod-wdgt",), ("nothing like it",), (None,), ("qmall ring",)], "a string")
    got = {r.a: (r.b, r.distance) for r in cleaning.fuzzy_match(left, right, "a", "b").collect()}
    assert got == {"qmall ring": ("Small Ring", 1), "all ring": ("Tall Ring", 1), "rod-wdgt": ("red widget", 3)}
    plan = cleaning.fuzzy_match(left, right, "a", "b")._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert cleaning.fuzzy_match(left.where(F.lit(False)), right, "a", "b").collect() == []
