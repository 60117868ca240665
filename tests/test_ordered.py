"""Running sums, brackets, cut intervals and total orders against plain loops, with blocks of a few rows."""

import random

import pytest
from pyspark.sql import functions as F

from sparkloom.functions import layout
from sparkloom.operators import content, ordered


def lists(n, seed):
    rng = random.Random(seed)
    return [(k % 7 if k % 7 else None, rng.choice("qQx"), rng.randint(-3, 9)) for k in range(n)]


@pytest.mark.parametrize("block", [1, 3, 1000])
def test_running_sums(spark, block):
    rows = [(i, at, v) for at, (i, _, v) in enumerate(lists(200, 1))]
    got = ordered.running_sums(spark.createDataFrame(rows, "i int, at int, v int"), ["i"], "at", {"s": F.col("v"), "n": F.lit(1)}, block).collect()
    want, sums = set(), {}
    for i, at, v in rows:
        s, n = sums.get(i, (0, 0))
        sums[i] = s + v, n + 1
        want.add((i, at, v, *sums[i]))
    assert {tuple(r) for r in got} == want


@pytest.mark.parametrize("block", [2, 1000])
@pytest.mark.parametrize("seed", range(4))
def test_brackets(spark, block, seed):
    """Against a stack, with lists that are unbalanced either way."""
    rows = [(k % 3, at, c) for at, (k, c) in enumerate((random.Random(seed + at).randint(0, 5), random.Random(seed * 1000 + at).choice("qqQQx")) for at in range(150))]
    df = spark.createDataFrame(rows, "i int, at int, c string")
    opens, closes = F.col("c") == "q", F.col("c") == "Q"
    pairs, stacks, count = set(), {k: [] for k in range(3)}, {k: [0, 0] for k in range(3)}
    for i, at, c in rows:
        if c == "q":
            stacks[i].append(at)
        elif c == "Q" and stacks[i]:
            pairs.add((i, stacks[i].pop(), at))
            count[i][0] += 1
        elif c == "Q":
            count[i][1] += 1
    assert {tuple(r) for r in ordered.match_brackets(df, ["i"], "at", opens, closes, block=block).collect()} == pairs
    assert {tuple(r) for r in ordered.bracket_balance(df, ["i"], "at", opens, closes, block).collect()} == {(i, *count[i], len(stacks[i])) for i in range(3)}
    assert ordered.match_brackets(df.limit(0), ["i"], "at", opens, closes).collect() == []


@pytest.mark.parametrize("block", [2, 1000])
def test_outside_intervals(spark, block):
    rng = random.Random(2)
    spans = [(rng.randint(0, 2), a, a + rng.randint(-1, 9)) for a in rng.choices(range(60), k=12)]
    rows = [(i, at, f"t{at}") for i in range(3) for at in range(70)] + [(0, 5, "again"), (3, 1, "alone")]
    got = ordered.outside_intervals(spark.createDataFrame(rows, "i int, at int, t string"), spark.createDataFrame(spans, "i int, start int, stop int"), ["i"], "at", block).collect()
    assert sorted(tuple(r) for r in got) == sorted(r for r in rows if not any(i == r[0] and a <= r[1] < z for i, a, z in spans))


def test_row_numbers_and_quantiles(spark):
    rng = random.Random(3)
    values = [rng.choice([None, rng.randint(0, 50)]) for _ in range(500)]
    df = spark.createDataFrame(list(enumerate(values)), "k int, v int").repartition(5)
    got = ordered.row_numbers(df, F.asc_nulls_last("v"), "k", parts=7)
    order = sorted(range(500), key=lambda k: (values[k] is None, values[k] or 0, k))
    assert {r.k: r.row_number for r in got.collect()} == {k: n + 1 for n, k in enumerate(order)}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "SinglePartition" not in plan
    known = sorted(v for v in values if v is not None)
    shares = [0.0, 0.25, 0.5, 0.9, 1.0]
    assert {r.quantile: r.value for r in ordered.exact_quantiles(df, "v", shares).collect()} == {q: known[max(1, -(-int(q * 100) * len(known) // 100)) - 1] for q in shares}
    assert ordered.row_numbers(df.limit(0), "v").collect() == [] and ordered.exact_quantiles(df.limit(0), "v", shares).collect() == []


def test_rows_and_arrays_agree(spark):
    """The overlay rule as running sums finds the groups that the rule over a page's array finds, however pages nest."""
    rng, pages = random.Random(4), []
    shade, others = [0.988] * 3, [("rg", [0.1, 0.1, 0.1]), ("Tj", []), ("cm", []), ("RG", [0.988, 0.988, 0.988]), ("Tf", [1.0, 9.0]), ("BT", []), ("Tf", None)]

    def group(depth):
        inner = [("q", [])]
        for _ in range(rng.randint(0, 2)):
            inner += group(depth - 1) if depth and rng.random() < 0.5 else [rng.choice(others)]
        if rng.random() < 0.7:
            inner += [("BT", []), ("Tf", [1.0, 5.0]), ("rg", shade), ("ET", [])]
        return [*inner, ("Q", [])]

    for page in range(60):
        pages.append(("d", page, [o for _ in range(rng.randint(0, 4)) for o in (group(2) if rng.random() < 0.8 else [rng.choice(others)])]))
    arrays = spark.createDataFrame(pages, "doc string, page int, ops array<struct<op:string,args:array<double>>>")
    rows = arrays.select("doc", "page", F.posexplode("ops").alias("at", "o")).select("doc", "page", "at", "o.op", "o.args")
    want = layout.remove_overlays(arrays).collect()
    removed = {r.page: r.removed for r in content.removed_groups(rows, block=3).collect()}
    assert removed == {r.page: r.removed for r in want if len(pages[r.page][2])} and sum(removed.values()) > 10
    left = {}
    for r in content.without_overlays(rows, block=3).orderBy("page", "at").collect():
        left.setdefault(r.page, []).append((r.op, r.args))
    assert left == {r.page: [(o.op, o.args) for o in r.ops] for r in want if r.ops}


def test_positions_of_long_lists(spark):
    df = spark.createDataFrame([(list(range(50_000)), list(range(0, 50_000, 2)))], "items array<int>, gone array<int>")
    assert df.select(layout.without_positions(F.col("items"), F.col("gone")).alias("x")).first().x == list(range(1, 50_000, 2))
    df = spark.createDataFrame([([], [1]), ([7, 7, None], [1])], "items array<int>, gone array<int>")
    assert [r.x for r in df.select(layout.without_positions(F.col("items"), F.col("gone")).alias("x")).collect()] == [[], [7, None]]
