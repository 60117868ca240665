"""Reshaping, joins and scores of the study's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions.cleaning import list_items, null_if
from sparkloom.plans.schemas import DOMAINS, LOSS_DOMAINS


def mixture_long(mixture: DataFrame, normalize: bool = True) -> DataFrame:
    """index, domain, weight; with ``normalize`` the weights of a row are divided by their sum."""
    names = [f"train_the_pile_{d}" for d in DOMAINS]
    if normalize:
        total = sum((F.coalesce(F.col(n), F.lit(0.0)) for n in names), F.lit(0.0))
        mixture = mixture.select("index", *[F.try_divide(F.col(n), total).alias(n) for n in names])
    return mixture.select("index", *[F.col(f"train_the_pile_{d}").alias(d) for d in DOMAINS]).unpivot("index", DOMAINS, "domain", "weight")


def losses_long(losses: DataFrame) -> DataFrame:
    """index, domain, loss for the domains that have one."""
    return losses.select("index", *[F.col(f"`metric/the_pile_{d}_val_loss`").alias(d) for d in LOSS_DOMAINS]).unpivot("index", LOSS_DOMAINS, "domain", "loss")


def mixture_with_losses(mixture: DataFrame, losses: DataFrame) -> DataFrame:
    """index, domain, weight, loss by index and domain within one scale; a domain without a loss has null."""
    return mixture_long(mixture).join(losses_long(losses), ["index", "domain"], "left")


def own_domain_correlation(joined: DataFrame) -> DataFrame:
    """Correlation of a domain's weight with its own loss; domains without losses are left out."""
    return joined.where("loss is not null").groupBy("domain").agg(F.try_divide(F.covar_pop("weight", "loss"), F.stddev_pop("weight") * F.stddev_pop("loss")).alias("corr"), F.count("*").alias("n"))


def map_domains(df: DataFrame, mapping: DataFrame, domain: str = "domain") -> DataFrame:
    """Adds quality_domain and mapping_type by name; ``(none)`` counts as null. The mapping has one row a domain."""
    m = mapping.select(F.col("mixture_domain").alias(domain), null_if(F.col("quality_domain"), "(none)").alias("quality_domain"), "mapping_type")
    return df.join(m, domain, "left")


def domain_summary(rows: DataFrame, domain: str = "source", text: str = "text") -> DataFrame:
    return rows.groupBy(domain).agg(F.count("*").alias("sample_rows"), F.avg(F.char_length(text)).alias("avg_text_chars"))


def grid(n: DataFrame, d: DataFrame, q: DataFrame) -> DataFrame:
    """The full factorial of three lists of distinct levels, whose product is the result's own size."""
    return n.distinct().crossJoin(d.distinct()).crossJoin(q.distinct())


def family_files(files: DataFrame) -> DataFrame:
    return files.groupBy("family").agg(F.count("*").alias("n_repos"), F.sum("weight_file_count").alias("weight_files"), F.sum("weight_total_bytes").alias("weight_bytes"))


def complete_cases(df: DataFrame, positive: list[str]) -> DataFrame:
    """Rows in which all named columns are above zero (null, NaN and 0 are missing)."""
    keep = F.lit(True)
    for c in positive:
        keep = keep & F.coalesce((F.col(c) > 0) & ~F.isnan(c), F.lit(False))
    return df.where(keep)


def excluded_cases(df: DataFrame, positive: list[str], key: list[str]) -> DataFrame:
    """The rows that ``complete_cases`` leaves out, for an audit."""
    kept = complete_cases(df, positive).select(*key).distinct()
    return df.join(kept, key, "left_anti")


def superset(base: DataFrame, more: DataFrame, key: list[str]) -> DataFrame:
    """All of ``base`` and those rows of ``more`` whose key it lacks, with ``origin``."""
    return base.withColumn("origin", F.lit("base")).unionByName(more.join(base.select(*key).distinct(), key, "left_anti").withColumn("origin", F.lit("more")), allowMissingColumns=True)


def tagged_union(**sources: DataFrame) -> DataFrame:
    """Like tables one below the other with ``origin``; unlike rows of one family and size are never joined."""
    out = None
    for name, df in sources.items():
        df = df.withColumn("origin", F.lit(name))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def chance_corrected(score: Column, chance: Column, floor: float | None = 0.0) -> Column:
    """(score - chance) / (1 - chance) * 100, not below ``floor``."""
    x = (score - chance) / (F.lit(1.0) - chance) * 100
    return x if floor is None else F.greatest(x, F.when(x.isNotNull(), F.lit(float(floor))))


def macro_mean(scores: DataFrame, group: list[str], score: str, chance: str, floor: float | None = 0.0) -> DataFrame:
    """Mean of chance-corrected subtask scores, each subtask alike."""
    return scores.groupBy(*group).agg(F.avg(chance_corrected(F.col(score), F.col(chance), floor)).alias("macro"))


def item_weighted_mean(scores: DataFrame, group: list[str], score: str, items: str) -> DataFrame:
    """Pooled score: each item alike, so that larger subtasks weigh more."""
    return scores.groupBy(*group).agg((F.sum(F.col(score) * F.col(items)) / F.sum(F.when(F.col(score).isNotNull(), F.col(items)))).alias("pooled"))


def row_mean(*names: str) -> Column:
    """Plain mean of the columns; null if one is null."""
    return sum((F.col(n) for n in names), F.lit(0.0)) / len(names)


def organizations(models: DataFrame, column: str = "organization") -> DataFrame:
    """One row for each distinct item of a list column; models without one are left out."""
    return models.withColumn("item", F.explode(list_items(F.col(column))))


def compute_flags(models: DataFrame, tolerance: float = 0.05) -> DataFrame:
    """Ratio of stated FLOPs to 6 N D (both in billions) and a flag; nothing is repaired."""
    ratio = F.try_divide(F.col("FLOPs"), 6e18 * F.col("N_params_B") * F.col("D_tokens_B"))
    return models.withColumn("flops_ratio", ratio).withColumn("flops_flag", F.when(ratio.isNull(), "unknown").when(F.abs(ratio - 1) <= tolerance, "consistent").otherwise("implausible"))


def head_flags(models: DataFrame) -> DataFrame:
    return models.withColumn("heads_divide", F.col("d_model") % F.nullif(F.col("n_heads"), F.lit(0)) == 0)


def provenance_grades(bridge: DataFrame) -> DataFrame:
    return bridge.groupBy(F.coalesce("Loss_Comparability", F.lit("unknown")).alias("grade")).agg(F.count("*").alias("n"))


def provenance_rank(p: Column) -> Column:
    """0 for reported rows up to 5 for rows that a formula made; unknown ones are last."""
    names = ["reported", "estimated", "semi_synthetic", "interpolated", "formula"]
    out = F.lit(len(names))
    for k, n in enumerate(names):
        out = F.when(p == n, k).otherwise(out)
    return out


def previous_and_next(points: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """Each known point with the next one, as the bracket that ends there."""
    w = Window.partitionBy(*by).orderBy(x)
    return points.withColumn("x1", F.lead(x).over(w)).withColumn("y1", F.lead(y).over(w))


def interpolate(points: DataFrame, targets: DataFrame, by: list[str], x: str, y: str, log: bool = True) -> DataFrame:
    """``y`` at the target places by straight lines between known points, in log x if ``log``; null outside their range.

    Points and targets are put in one order and each target sees the last point
    before it and the first one after it, in one shuffle by ``by``.
    """
    known = points.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*by, x).agg(F.avg(y).alias(y)).select(*by, x, y, F.lit(0).alias("_target"))
    asked = targets.where(F.col(x).isNotNull()).select(*by, x, F.lit(None).cast("double").alias(y), F.lit(1).alias("_target"))
    w = Window.partitionBy(*by).orderBy(x, "_target")
    back = w.rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(*by).orderBy(F.col(x).desc(), "_target").rowsBetween(Window.unboundedPreceding, 0)
    here = F.when(F.col("_target") == 0, F.struct(F.col(x).alias("x"), F.col(y).alias("y")))
    both = known.union(asked).withColumn("_p", F.last(here, ignorenulls=True).over(back)).withColumn("_n", F.last(here, ignorenulls=True).over(ahead)).where("_target = 1")
    scale = (lambda c: F.ln(c)) if log else (lambda c: c)
    part = F.try_divide(scale(F.col(x)) - scale(F.col("_p.x")), scale(F.col("_n.x")) - scale(F.col("_p.x")))
    value = F.when(F.col("_p.x") == F.col("_n.x"), F.col("_p.y")).otherwise(F.col("_p.y") + part * (F.col("_n.y") - F.col("_p.y")))
    return both.select(*by, x, value.alias(y))


def as_of(left: DataFrame, right: DataFrame, by: list[str], at: str, value: str, keep: list[str]) -> DataFrame:
    """Left rows with the last right ``value`` at or before them within ``by``; one shuffle, no join.

    Of right rows at one time the greatest value counts, and a null value counts only where it stands alone there.
    """
    one = left.select(*by, at, *keep, F.lit(None).alias("_v"), F.lit(1).alias("_left"))
    two = right.select(*by, at, *[F.lit(None).alias(k) for k in keep], F.struct(value).alias("_v"), F.lit(0).alias("_left"))
    w = Window.partitionBy(*by).orderBy(at, "_left", "_v").rowsBetween(Window.unboundedPreceding, 0)
    return two.unionByName(one).withColumn("_v", F.last("_v", ignorenulls=True).over(w)).where("_left = 1").select(*by, at, *keep, F.col(f"_v.{value}").alias(value))
