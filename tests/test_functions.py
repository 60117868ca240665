"""Page functions and study operators at their edges."""

import random

import pytest
from pyspark.sql import functions as F

from sparkloom.functions import cleaning, layout
from sparkloom.operators import laws, study

OPS = "id long, ops array<struct<op:string,args:array<double>>>"


def brackets(ops):
    stack, out = [], []
    for i, o in enumerate(ops):
        if o == "q":
            stack.append(i)
        elif o == "Q":
            out.append((stack.pop(), i + 1))
    return out


def test_intervals_match_a_stack(spark):
    random.seed(1)
    rows = []
    for k in range(60):
        ops, depth = [], 0
        for _ in range(random.randint(0, 30)):
            o = random.choice("qQx")
            if o == "Q" and not depth:
                o = "x"
            depth += (o == "q") - (o == "Q")
            ops.append(o)
        rows.append((k, ops + ["Q"] * depth))
    df = spark.createDataFrame([(k, [(o, []) for o in ops]) for k, ops in rows], OPS)
    got = {r.id: [tuple(i) for i in r.i] for r in df.select("id", layout.group_intervals(F.col("ops")).alias("i")).collect()}
    assert got == {k: brackets(ops) for k, ops in rows}


@pytest.mark.parametrize("ops", [["q"], ["Q"], ["Q", "q"]])
def test_unbalanced_is_an_error(spark, ops):
    df = spark.createDataFrame([(1, [(o, []) for o in ops])], OPS)
    with pytest.raises(Exception, match="closed twice or never"):
        df.select(layout.group_intervals(F.col("ops"))).collect()


def test_spans_without_lines(spark):
    kind = "blocks array<struct<lines:array<struct<spans:array<struct<text:string,color:int>>>>>>"
    df = spark.createDataFrame([([([([("a", 1)],), ([("b", 2)],)],), (None,)],), ([],)], kind)
    assert [[s.text for s in r.s] for r in df.select(layout.spans_of(F.col("blocks")).alias("s")).collect()] == [["a", "b"], []]


def test_interpolation_and_as_of(spark):
    points = spark.createDataFrame([("a", 1.0, 0.0), ("a", 100.0, 2.0), ("a", 100.0, 4.0), ("b", 5.0, 1.0)], "g string, x double, y double")
    asked = spark.createDataFrame([("a", 10.0), ("a", 100.0), ("a", 0.5), ("b", 5.0), ("b", 6.0), ("c", 1.0)], "g string, x double")
    got = {(r.g, r.x): r.y for r in study.interpolate(points, asked, ["g"], "x", "y").collect()}
    assert got.pop(("a", 10.0)) == pytest.approx(1.5)
    assert got == {("a", 100.0): 3.0, ("a", 0.5): None, ("b", 5.0): 1.0, ("b", 6.0): None, ("c", 1.0): None}
    left = spark.createDataFrame([("a", 5, 1), ("a", 0, 2)], "g string, t int, id int")
    right = spark.createDataFrame([("a", 5, "x"), ("a", 3, None), ("a", 9, "z")], "g string, t int, v string")
    assert {r.id: r.v for r in study.as_of(left, right, ["g"], "t", "v", ["id"]).collect()} == {1: "x", 2: None}


def test_as_of_takes_the_greatest_of_one_time(spark):
    left = spark.createDataFrame([("a", 5, 1)], "g string, t int, id int")
    right = spark.createDataFrame([("a", 4, "x"), ("a", 4, "z"), ("a", 4, None), ("a", 4, "y")], "g string, t int, v string")
    assert study.as_of(left, right, ["g"], "t", "v", ["id"]).first().v == "z"


def test_range_join_of_short_long_and_endless_ranges(spark):
    from sparkloom.plans.relational import range_join

    rng, inf = random.Random(2), float("inf")
    spots = [rng.uniform(-1e4, 1e4) for _ in range(200)] + [0.0, 5.0, 1e15, -1e15, inf, None]
    ranges = [(k, a, a + 10 ** rng.uniform(-3, 6)) for k, a in enumerate(rng.uniform(-1e4, 1e4) for _ in range(60))]
    ranges += [(100, -inf, inf), (101, 0.0, inf), (102, -1e300, 5.0), (103, 5.0, 5.0), (104, 7.0, 1.0), (105, None, 1.0), (106, 5.0, 6.0)]
    points = spark.createDataFrame(list(enumerate(spots)), "i int, x double")
    bands = spark.createDataFrame(ranges, "k int, lo double, hi double")
    got = [(r.i, r.k) for r in range_join(points, "x", bands, "lo", "hi", 1.0).collect()]
    want = [(i, k) for i, x in enumerate(spots) for k, lo, hi in ranges if None not in (x, lo) and lo <= x < hi]
    assert sorted(got) == sorted(want)


def test_law_prediction_of_unseen_points(spark):
    kind = "g string, N_params_B double, D_tokens_B double, val_loss double"
    law = lambda g, n, d: (1.0 if g == "a" else 2.0) + 3 * n**-0.5 + d**-0.5
    seen = [(g, float(n), float(d), law(g, n, d)) for g in "ab" for n in range(1, 6) for d in range(1, 6)]
    fits = laws.fit_law(spark.createDataFrame(seen, kind), [0.4, 0.5], [0.5, 0.6], ["g"])
    new = spark.createDataFrame([("a", 40.0, 50.0, law("a", 40, 50) + 1), ("b", 9.0, 9.0, law("b", 9, 9)), ("c", 1.0, 1.0, 1.0), ("b", 0.0, 1.0, 1.0), ("b", 1.0, 1.0, None)], kind)
    got = {r.g: (r.held_out_rmse, r.n) for r in laws.held_out_error(new, fits, ["g"]).collect()}
    assert got == {"a": (pytest.approx(1, abs=1e-6), 1), "b": (pytest.approx(0, abs=1e-5), 1)}
    one = laws.fit_law(spark.createDataFrame(seen[:25], kind), [0.5], [0.5])
    assert laws.predict(new.where("g = 'a'"), one, []).first().predicted == pytest.approx(law("a", 40, 50), abs=1e-6)


def test_published_law_and_mixture_sums(spark):
    row = spark.range(1).select(laws.project(F.lit(70.0), F.lit(1400.0)).alias("l")).first()
    assert row.l == pytest.approx(1.69 + 406.4 / 70e9**0.34 + 410.7 / 1400e9**0.28)
    from sparkloom.plans.schemas import DOMAINS, SCHEMAS

    rows = [(0, *([0.997 / 17] * 17)), (1, *([0.0] * 17))]
    got = study.mixture_long(spark.createDataFrame(rows, SCHEMAS["mixture"])).groupBy("index").agg(F.sum("weight").alias("w"), F.count("*").alias("n")).orderBy("index").collect()
    assert got[0].w == pytest.approx(1.0) and got[1].w is None and got[0].n == len(DOMAINS)


def test_lists_flags_and_unions(spark):
    df = spark.createDataFrame([("a, b,a,",), (None,), ("",)], "organization string")
    assert sorted(r.item for r in study.organizations(df).collect()) == ["a", "b"]
    assert study.tagged_union(x=spark.range(2), y=spark.range(1).withColumn("k", F.lit(1))).count() == 3
    assert spark.range(1).select(cleaning.null_if(F.lit("(none)"), "(none)").alias("x")).first().x is None
    ranks = spark.createDataFrame([("formula",), ("reported",), ("?",)], "p string").select(study.provenance_rank(F.col("p")).alias("r")).collect()
    assert [r.r for r in ranks] == [4, 0, 5]


def test_fit_leaves_formula_rows_out(spark):
    rows = [(float(n), float(d), 2 + n**-0.5 + d**-0.5, "reported") for n in range(1, 6) for d in range(1, 6)] + [(1.0, 1.0, 99.0, "formula")]
    fit = laws.fit_law(spark.createDataFrame(rows, "N_params_B double, D_tokens_B double, val_loss double, provenance string"), [0.4, 0.5], [0.5, 0.6]).first()
    assert (fit.alpha, fit.beta) == (0.5, 0.5) and fit.E == pytest.approx(2, abs=1e-6)
