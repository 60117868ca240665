"""Loss laws: projection, fits by sums of products, and compute budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Published constants of a loss law in parameters and tokens (fixed values): E + A / N**a + B / D**b.
PUBLISHED = {"E": 1.69, "A": 406.4, "a": 0.34, "B": 410.7, "b": 0.28}


def project(n_b: Column, d_b: Column, law: dict = PUBLISHED) -> Column:
    """Loss at N and D, both in billions."""
    return F.lit(law["E"]) + law["A"] / F.pow(n_b * 1e9, F.lit(law["a"])) + law["B"] / F.pow(d_b * 1e9, F.lit(law["b"]))


def log_log(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """Slope and intercept of ln y on ln x by group; rows at or below zero are left out."""
    ok = df.where((F.col(x) > 0) & (F.col(y) > 0))
    return ok.groupBy(*by).agg(F.regr_slope(F.ln(y), F.ln(x)).alias("slope"), F.regr_intercept(F.ln(y), F.ln(x)).alias("intercept"), F.count("*").alias("n"))


def determinant(m: list[list[Column]]) -> Column:
    (a, b, c), (d, e, f), (g, h, i) = m
    return a * (e * i - f * h) - b * (d * i - f * g) + c * (d * h - e * g)


def fit_law(points: DataFrame, exponents_n: list[float], exponents_d: list[float], by: list[str] | None = None) -> DataFrame:
    """Best E, A, B, alpha, beta and rmse of E + A N**-alpha + B D**-beta over a grid of exponents.

    For fixed exponents the law is linear, so sums of products settle it: each
    point meets the grid (a fixed list of exponents) and one aggregation a cell
    gives the 3 x 3 normal equations, solved by Cramer's rule. Rows that a formula made are left out
    if the points tell their provenance.
    """
    by = by or []
    if "provenance" in points.columns:
        points = points.where("provenance <> 'formula'")
    points = points.where("N_params_B > 0 and D_tokens_B > 0 and val_loss is not null")
    cells = F.array(*[F.struct(F.lit(float(a)).alias("alpha"), F.lit(float(b)).alias("beta")) for a in exponents_n for b in exponents_d])
    rows = points.select(*by, F.explode(cells).alias("_cell"), "N_params_B", "D_tokens_B", F.col("val_loss").alias("y")).select(*by, "_cell.alpha", "_cell.beta", F.pow("N_params_B", -F.col("_cell.alpha")).alias("u"), F.pow("D_tokens_B", -F.col("_cell.beta")).alias("v"), "y")
    s = rows.groupBy(*by, "alpha", "beta").agg(F.count("*").cast("double").alias("n"), *[F.sum(F.expr(e)).alias(k) for k, e in dict(u="u", v="v", y="y", uu="u*u", uv="u*v", vv="v*v", uy="u*y", vy="v*y", yy="y*y").items()])
    c = {k: F.col(f"s_{k}") for k in ("n", "u", "v", "y", "uu", "uv", "vv", "uy", "vy", "yy")}
    s = s.select(*by, "alpha", "beta", *[F.col(k).alias(f"s_{k}") for k in c])
    left = [[c["n"], c["u"], c["v"]], [c["u"], c["uu"], c["uv"]], [c["v"], c["uv"], c["vv"]]]
    right = [c["y"], c["uy"], c["vy"]]
    whole = determinant(left)
    put = lambda k: determinant([[right[i] if j == k else left[i][j] for j in range(3)] for i in range(3)])
    s = s.withColumn("E", F.try_divide(put(0), whole)).withColumn("A", F.try_divide(put(1), whole)).withColumn("B", F.try_divide(put(2), whole))
    sse = c["yy"] - F.col("E") * c["y"] - F.col("A") * c["uy"] - F.col("B") * c["vy"]
    s = s.where("E is not null").withColumn("rmse", F.sqrt(F.greatest(sse, F.lit(0.0)) / c["n"]))
    best = F.min_by(F.struct("E", "A", "B", "alpha", "beta", "rmse"), F.struct("rmse", "alpha", "beta"))
    out = s.groupBy(*by).agg(best.alias("f"))
    return out.select(*by, "f.*")


#: Parameters of a law in the order of the refit's vectors; sizes and exponents are fitted as logarithms, so they stay positive.
LAW = ["E", "A", "B", "alpha", "beta"]


def refit_law(points: DataFrame, start: DataFrame, by: list[str], steps: int = 30, robust: float = 1.345, tolerance: float = 1e-7) -> DataFrame:
    """E, A, B, alpha, beta, rmse and steps by group: E + A N**-alpha + B D**-beta refitted from ``start`` (``fit_law``) off the grid.

    Levenberg and Marquardt's method with Huber's loss. Each step is one aggregation
    of the products of the Jacobian, 21 sums a group, over all points; the driver holds and
    solves a 5 x 5 system for each group of ``start`` and no points. Residuals beyond ``robust``
    times the usual error (of the start first, then by the median of the residuals) count by their size,
    not its square, so that a few wild losses don't decide. Groups without a start are left out;
    ``steps`` bounds each of the two rounds, and a step that doesn't lessen the loss is undone.
    """
    import numpy as np

    spark = points.sparkSession
    known = points.where("N_params_B > 0 and D_tokens_B > 0 and val_loss is not null").select(*by, "N_params_B", "D_tokens_B", "val_loss")
    groups = {tuple(r[k] for k in by): r for r in start.collect()}  # a row for each group
    state = {g: np.array([r.E, np.log(max(abs(r.A), 1e-9)), np.log(max(abs(r.B), 1e-9)), r.alpha, r.beta]) for g, r in groups.items()}
    scale = {g: max(robust * r.rmse, 1e-12) for g, r in groups.items()}
    names = ["_e", "_a", "_b", "_alpha", "_beta"]
    kind = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in start.select(*by).schema.fields] + [f"{n} double" for n in [*names, "_scale"]])

    def sums(at: dict) -> dict:
        rows = [(*g, *map(float, w), scale[g]) for g, w in at.items()]
        both = known.join(F.broadcast(spark.createDataFrame(rows, kind)), by) if by else known.crossJoin(F.broadcast(spark.createDataFrame(rows, kind)))
        u = F.exp(F.col("_a") - F.col("_alpha") * F.ln("N_params_B"))
        v = F.exp(F.col("_b") - F.col("_beta") * F.ln("D_tokens_B"))
        rest = F.col("val_loss") - F.col("_e") - u - v
        weight = F.least(F.lit(1.0), F.col("_scale") / F.greatest(F.abs(rest), F.lit(1e-300)))
        size = F.abs(rest)
        loss = F.when(size <= F.col("_scale"), rest * rest / 2).otherwise(F.col("_scale") * (size - F.col("_scale") / 2))
        slopes = [F.lit(1.0), u, v, -u * F.ln("N_params_B"), -v * F.ln("D_tokens_B")]
        rows = both.select(*by, *[j.alias(f"_j{k}") for k, j in enumerate(slopes)], rest.alias("_r"), weight.alias("_w"), loss.alias("_l"))
        products = [F.sum(F.col("_w") * F.col(f"_j{i}") * F.col(f"_j{k}")) for i in range(5) for k in range(i + 1)]
        right = [F.sum(F.col("_w") * F.col(f"_j{i}") * F.col("_r")) for i in range(5)]
        out = rows.groupBy(*by).agg(F.array(*products).alias("_m"), F.array(*right).alias("_right"), F.sum("_l").alias("_loss"), F.sum(F.col("_r") * F.col("_r")).alias("_sse"), F.count("*").alias("_n"), F.percentile_approx(F.abs("_r"), 0.5, 1000).alias("_middle"))
        return {tuple(r[k] for k in by): r for r in out.collect()}

    def solved(r, damp: float):
        m = np.zeros((5, 5))
        m[np.tril_indices(5)] = r["_m"]
        m = m + np.tril(m, -1).T
        return np.linalg.solve(m + damp * np.diag(np.diag(m) + 1e-12), np.array(r["_right"]))

    best, taken = sums(state), 0
    state = {g: w for g, w in state.items() if g in best}
    for again in range(2):
        if again:  # the spread of most residuals is known now
            scale |= {g: max(robust * 1.4826 * r["_middle"], 1e-12) for g, r in best.items()}
            best = sums(state)
        damp, left, end = dict.fromkeys(state, 1e-2), set(state), taken + steps
        while left and taken < end:
            taken += 1
            tried = {g: state[g] + solved(best[g], damp[g]) for g in left}
            for g, r in sums(tried).items():
                if np.isfinite(r["_loss"]) and r["_loss"] <= best[g]["_loss"]:
                    if best[g]["_loss"] - r["_loss"] <= tolerance * best[g]["_loss"]:
                        left.discard(g)
                    state[g], best[g], damp[g] = tried[g], r, max(damp[g] / 5, 1e-12)
                else:
                    damp[g] *= 4
                    if damp[g] > 1e12:
                        left.discard(g)
    rows = [(*g, float(w[0]), float(np.exp(w[1])), float(np.exp(w[2])), float(w[3]), float(w[4]), float((best[g]["_sse"] / best[g]["_n"]) ** 0.5), taken) for g, w in state.items()]
    kind = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in start.select(*by).schema.fields] + [f"{n} double" for n in [*LAW, "rmse"]] + ["steps int"])
    return spark.createDataFrame(rows, kind)


def predict(points: DataFrame, fits: DataFrame, by: list[str]) -> DataFrame:
    """``points`` with the loss (``predicted``) that their group's law, a row of ``fit_law``, gives; groups without a law go."""
    law = fits.select(*by, F.struct("E", "A", "B", "alpha", "beta").alias("_law"))
    both = points.join(law, by) if by else points.crossJoin(law)  # without groups the law is one row
    value = F.col("_law.E") + F.col("_law.A") * F.pow("N_params_B", -F.col("_law.alpha")) + F.col("_law.B") * F.pow("D_tokens_B", -F.col("_law.beta"))
    return both.withColumn("predicted", value).drop("_law")


def held_out_error(points: DataFrame, fits: DataFrame, by: list[str]) -> DataFrame:
    """Root mean square error and number of points by group, of points that the fits haven't seen."""
    known = points.where("N_params_B > 0 and D_tokens_B > 0 and val_loss is not null")
    rows = predict(known, fits, by).withColumn("_square", F.pow(F.col("val_loss") - F.col("predicted"), F.lit(2.0)))
    return rows.groupBy(*by).agg(F.sqrt(F.avg("_square")).alias("held_out_rmse"), F.count("*").alias("n"))


def best_within_budget(grid: DataFrame, budgets: DataFrame, law: dict = PUBLISHED, fine: int = 64) -> DataFrame:
    """For each budget (flops) the grid point with 6 N D within it and the least projected loss, of equal ones the cheaper.

    Costs fall into steps, ``fine`` for each doubling. A step's best point is one
    row, and so is the best up to a step: some ten thousand rows however large the
    grid, as costs are doubles. A budget takes the best of the steps below its own by one
    equi-join, and of its own step those points that it can pay by another.
    """
    step = lambda c: F.floor(F.log2(c) * fine).cast("int")
    cost = 6e18 * F.col("N_params_B") * F.col("D_tokens_B")
    points = grid.withColumn("cost", cost).where("cost > 0").withColumn("loss", project(F.col("N_params_B"), F.col("D_tokens_B"), law))
    points = points.select(step(F.col("cost")).alias("_step"), F.struct("loss", "cost", "N_params_B", "D_tokens_B").alias("_x"))
    asked = budgets.where("flops > 0").select("flops").distinct().withColumn("_step", step(F.col("flops")))
    best = points.groupBy("_step").agg(F.min("_x").alias("_x"))
    steps = best.unionByName(asked.select("_step").distinct().withColumn("_x", F.lit(None)))  # a budget's step may hold no point
    steps = steps.groupBy("_step").agg(F.min("_x").alias("_x"))
    below = Window.orderBy("_step").rowsBetween(Window.unboundedPreceding, -1)  # a row for each step
    steps = steps.select("_step", F.min("_x").over(below).alias("_x"))
    lower = asked.join(steps, "_step").select("flops", "_x")
    equal = asked.join(points, "_step").where(F.col("_x.cost") <= F.col("flops")).groupBy("flops").agg(F.min("_x").alias("_x"))
    found = lower.unionByName(equal).where("_x is not null").groupBy("flops").agg(F.min("_x").alias("_x"))
    return found.select("flops", "_x.N_params_B", "_x.D_tokens_B", "_x.cost", "_x.loss")


def attribution(points: DataFrame, by: list[str], law: dict = PUBLISHED) -> DataFrame:
    """Mean shares of the reducible loss that model size and data size account for."""
    n = law["A"] / F.pow(F.col("N_params_B") * 1e9, F.lit(law["a"]))
    d = law["B"] / F.pow(F.col("D_tokens_B") * 1e9, F.lit(law["b"]))
    ok = points.where("N_params_B > 0 and D_tokens_B > 0")
    return ok.groupBy(*by).agg(F.avg(n / (n + d)).alias("size_share"), F.avg(d / (n + d)).alias("data_share"), F.count("*").alias("n"))


def quality_score(text: Column) -> Column:
    """0 to 1: the mean of four shares of a text that plain prose has near 1 (letters and spaces, words of usual length, lower case, ended sentences)."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    n = F.greatest(F.size(words), F.lit(1))
    letters = F.try_divide(F.char_length(F.regexp_replace(text, r"[^\p{L}\s]", "")), F.char_length(text))
    usual = F.size(F.filter(words, lambda w: (F.char_length(w) >= 2) & (F.char_length(w) <= 20))) / n
    lower = 1 - F.try_divide(F.char_length(F.regexp_replace(text, r"[^\p{Lu}]", "")), F.greatest(F.char_length(F.regexp_replace(text, r"[^\p{L}]", "")), F.lit(1)))
    ended = F.when(F.trim(text).rlike(r"[.!?]$"), 1.0).otherwise(0.0)
    return F.when(F.char_length(text) > 0, (letters + usual + lower + ended) / 4).otherwise(0.0)
