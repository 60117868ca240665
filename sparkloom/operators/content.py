"""Page content as rows (doc, page, at, op, args), cleaned and verified as one plan.

The rules are those of ``functions.layout``, which work on one page's array; here
a page of any length splits over tasks, as every condition on a group of
operators is a difference of running sums at its two ends.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.functions.layout import OVERLAY_OPERATORS, OVERLAY_SIZE, changed_pixels, changed_places, compare_pages, near, outside_boxes, page_checks, places_outside, shaded
from sparkloom.operators.ordered import match_brackets, outside_intervals, running_sums
from sparkloom.session import stored
from sparkloom.sources.writers import report

PAGE = ["doc", "page"]


def overlay_groups(ops: DataFrame, block: int = 1 << 16) -> DataFrame:
    """doc, page, start, stop (half open) of the groups between q and Q that are overlays."""
    op, one = F.col("op"), F.struct("op", "args")
    yes = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    counts = {
        "n_foreign": yes(~op.isin(OVERLAY_OPERATORS)),
        "n_blocks": yes(op == "BT"),
        "n_sizes": yes((op == "Tf") & near(F.get("args", F.lit(1)), OVERLAY_SIZE)),
        "n_shades": yes((op == "rg") & shaded(one)),
        "n_colors": yes(op.isin("rg", "RG") & ~shaded(one)),
    }
    own = stored(ops.select(*PAGE, "at", "op", *[c.alias(k) for k, c in counts.items()]))
    sums = running_sums(own, PAGE, "at", {f"s{k}": F.col(k) for k in counts}, block).where(op.isin("q", "Q"))
    rows = stored(sums.select(*PAGE, "at", "op", *[F.col(f"s{k}").alias(k) for k in counts]))
    groups = match_brackets(rows, PAGE, "at", op == "q", op == "Q", tuple(counts), block)
    inside = {k: F.col(f"{k}_stop") - F.col(k) for k in counts}
    rule = (inside["n_foreign"] == 0) & (inside["n_blocks"] == 1) & (inside["n_sizes"] > 0) & (inside["n_shades"] > 0) & (inside["n_colors"] == 0)
    return groups.where(rule).select(*PAGE, "start", (F.col("stop") + 1).alias("stop"))


def without_overlays(ops: DataFrame, block: int = 1 << 16, groups: DataFrame | None = None) -> DataFrame:
    """The operators that stand in no overlay group; ``groups`` are those of ``overlay_groups``, if they stand somewhere."""
    return outside_intervals(ops, overlay_groups(ops, block) if groups is None else groups, PAGE, "at", block)


def removed_groups(ops: DataFrame, block: int = 1 << 16, groups: DataFrame | None = None) -> DataFrame:
    """doc, page, removed for every page, also those with none."""
    pages, groups = ops.select(*PAGE).distinct(), overlay_groups(ops, block) if groups is None else groups
    return pages.join(groups.groupBy(*PAGE).agg(F.count("*").alias("removed")), PAGE, "left").fillna(0, ["removed"])


def verified_report(ops: DataFrame, before: DataFrame, after: DataFrame, boxes: DataFrame, pad: float = 2.0, groups: DataFrame | None = None) -> DataFrame:
    """doc and report: for each document a JSON text of its pages, the groups removed, and what the checks found.

    ``before`` and ``after`` are pages (doc, page, width, height, links, spans,
    pixels); a page fails if it lacks its partner, its geometry, visible text or
    number of links changed, the hidden colour is left, or a pixel changed
    outside ``boxes``, the places of what was removed.
    """
    pixels = changed_pixels(before, after)
    changed = pixels.groupBy(*PAGE).agg(F.count("*").alias("changed_pixels"))
    stray = outside_boxes(pixels, boxes, pad).groupBy(*PAGE).agg(F.count("*").alias("stray_pixels"))
    checks = compare_pages(before, after).join(removed_groups(ops, groups=groups), PAGE, "left").join(changed, PAGE, "left").join(stray, PAGE, "left")
    return checks_report(checks.fillna(0, ["removed", "changed_pixels", "stray_pixels"]))


def row_report(pages: DataFrame, pad: float = 2.0) -> DataFrame:
    """The same report from pages that stand in a row each before and after: doc, page, removed, structs ``b`` and ``a``, and ``boxes``.

    Nothing is joined, so only the checks of a page are shuffled, not its pixels.
    """
    changed = pages.withColumn("_places", changed_places(F.col("b.pixels"), F.col("a.pixels")))
    stray = F.size(places_outside(F.col("_places"), F.col("b.width"), F.col("boxes"), pad)).cast("long")
    counted = changed.select("b", "a", F.col("removed").cast("long").alias("removed"), F.size("_places").cast("long").alias("changed_pixels"), stray.alias("stray_pixels"))
    return checks_report(page_checks(counted, "removed", "changed_pixels", "stray_pixels"))


def checks_report(checks: DataFrame) -> DataFrame:
    passed = F.col("paired") & F.col("same_geometry") & F.col("same_visible") & F.col("hidden_gone") & F.col("same_links") & (F.col("stray_pixels") == 0)
    rows = checks.select(*PAGE, "removed", "changed_pixels", "stray_pixels", passed.alias("passed"), F.when(passed, 0).otherwise(1).alias("failed"))
    return report(rows, "doc", "page", ["removed", "changed_pixels", "stray_pixels", "failed"])
