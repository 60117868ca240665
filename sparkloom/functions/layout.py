"""Expressions over page content: operator lists, spans, boxes. All are higher-order built-ins, row by row in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the overlay rule: a near-white text block of 5 points.
OVERLAY_OPERATORS = ["q", "Q", "BT", "ET", "Tm", "Tf", "RG", "rg", "TJ", "Tj"]
OVERLAY_SIZE, OVERLAY_SHADE, OVERLAY_COLOR, TOLERANCE = 5.0, 0.988, 0xFCFCFC, 1e-6


def near(x: Column, value: float, tolerance: float = TOLERANCE) -> Column:
    return F.coalesce(F.abs(x - value) < tolerance, F.lit(False))


def only_operators(ops: Column, allowed: list[str] = OVERLAY_OPERATORS) -> Column:
    """Every element (op, args) is one of the allowed operators."""
    return F.forall(ops, lambda o: o["op"].isin(allowed))


def exactly_one(ops: Column, operator: str) -> Column:
    return F.size(F.filter(ops, lambda o: o["op"] == operator)) == 1


def shaded(o: Column) -> Column:
    """Three arguments, all of the overlay shade."""
    return (F.size(o["args"]) == 3) & F.forall(o["args"], lambda a: near(a, OVERLAY_SHADE))


def is_overlay(ops: Column) -> Column:
    """A text block of the overlay size whose only colour is the overlay shade; ``ops`` is array<struct<op, args: array<double>>>."""
    return (
        only_operators(ops)
        & exactly_one(ops, "BT")
        & F.exists(ops, lambda o: (o["op"] == "Tf") & near(F.get(o["args"], F.lit(1)), OVERLAY_SIZE))
        & F.exists(ops, lambda o: (o["op"] == "rg") & shaded(o))
        & F.forall(ops, lambda o: ~o["op"].isin("rg", "RG") | shaded(o))
    )


def spans_of(page_blocks: Column) -> Column:
    """All spans of blocks -> lines -> spans in order; a block without lines has none."""
    lines = F.flatten(F.transform(page_blocks, lambda b: F.coalesce(b["lines"], F.array())))
    return F.flatten(F.transform(lines, lambda s: F.coalesce(s["spans"], F.array())))


def visible_signature(spans: Column, hidden: int = OVERLAY_COLOR) -> Column:
    """Text, colour, size and box of the spans that are not of the hidden colour, numbers half-even to 4 places."""
    return F.transform(
        F.filter(spans, lambda s: s["color"] != hidden),
        lambda s: F.struct(s["text"].alias("text"), s["color"].alias("color"), F.bround(s["size"], 4).alias("size"), F.transform(s["bbox"], lambda v: F.bround(v, 4)).alias("bbox")),
    )


def has_color(spans: Column, color: int = OVERLAY_COLOR) -> Column:
    return F.exists(spans, lambda s: s["color"] == color)


def group_intervals(ops: Column) -> Column:
    """array<struct<start, stop>> of the operators between each q and its Q, by a fold with a stack.

    Intervals come in the order in which they close; an unbalanced list raises an error.
    """
    start = F.struct(F.array().cast("array<int>").alias("stack"), F.array().cast("array<struct<start:int,stop:int>>").alias("out"), F.lit(0).alias("at"), F.lit(False).alias("bad"))

    def step(s: Column, o: Column) -> Column:
        opens, closes, empty = o["op"] == "q", o["op"] == "Q", F.size(s["stack"]) == 0
        rest = F.slice(s["stack"], F.lit(1), F.greatest(F.size(s["stack"]) - 1, F.lit(0)))
        stack = F.when(opens, F.concat(s["stack"], F.array(s["at"]))).when(closes & ~empty, rest).otherwise(s["stack"])
        made = F.array(F.struct(F.get(s["stack"], F.size(s["stack"]) - 1).alias("start"), (s["at"] + 1).alias("stop")))
        return F.struct(stack.alias("stack"), F.when(closes & ~empty, F.concat(s["out"], made)).otherwise(s["out"]).alias("out"), (s["at"] + 1).alias("at"), (s["bad"] | (closes & empty)).alias("bad"))

    return F.aggregate(ops, start, step, lambda s: F.when(s["bad"] | (F.size(s["stack"]) > 0), F.raise_error(F.lit("a group is closed twice or never")).cast("array<struct<start:int,stop:int>>")).otherwise(s["out"]))


def interval_positions(intervals: Column) -> Column:
    """Sorted distinct positions that half-open intervals cover."""
    return F.array_sort(F.array_distinct(F.flatten(F.transform(F.filter(intervals, lambda i: i["stop"] > i["start"]), lambda i: F.sequence(i["start"], i["stop"] - 1)))))


def without_positions(items: Column, positions: Column) -> Column:
    """The items whose place from 0 is not among ``positions``, in order."""
    places = F.when(F.size(items) > 0, F.sequence(F.lit(0), F.size(items) - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(F.array_except(places, positions), lambda i: F.get(items, i))


def remove_overlays(pages: DataFrame) -> DataFrame:
    """Pages (doc, page, ops) with the overlay groups taken out of ``ops``, and ``removed``, their number (0 stays)."""
    found = F.filter(F.col("_groups"), lambda g: is_overlay(F.slice(F.col("ops"), g["start"] + 1, g["stop"] - g["start"])))
    out = pages.withColumn("_groups", group_intervals(F.col("ops"))).withColumn("_groups", found)
    return out.withColumn("removed", F.size("_groups")).withColumn("ops", without_positions(F.col("ops"), interval_positions(F.col("_groups")))).drop("_groups")


def deduplicate_objects(objects: DataFrame, keep: str, *content: str) -> DataFrame:
    """Objects of equal content as one, the one with the smallest ``keep``, and the number of its copies."""
    return objects.groupBy(*content).agg(F.min(keep).alias(keep), F.count("*").alias("copies"))


def compare_pages(before: DataFrame, after: DataFrame) -> DataFrame:
    """Checks page by page: pages (doc, page, width, height, spans, links) paired by position.

    A page on one side only has ``paired`` false. The order of visible spans counts.
    """
    b, a = before.alias("b"), after.alias("a")
    return page_checks(b.join(a, (F.col("b.doc") == F.col("a.doc")) & (F.col("b.page") == F.col("a.page")), "full"))


def page_checks(joined: DataFrame, *more: str) -> DataFrame:
    """The checks of ``compare_pages`` where both pages stand in one row, as ``b`` and ``a``, and columns ``more`` of it."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    return joined.select(
        F.coalesce("b.doc", "a.doc").alias("doc"),
        F.coalesce("b.page", "a.page").alias("page"),
        (F.col("b.page").isNotNull() & F.col("a.page").isNotNull()).alias("paired"),
        yes((F.col("b.width") == F.col("a.width")) & (F.col("b.height") == F.col("a.height"))).alias("same_geometry"),
        yes(visible_signature(F.col("b.spans")) == visible_signature(F.col("a.spans"))).alias("same_visible"),
        yes(~has_color(F.col("a.spans"))).alias("hidden_gone"),
        yes(F.col("b.links") == F.col("a.links")).alias("same_links"),
        *more,
    )


def changed_pixels(before: DataFrame, after: DataFrame) -> DataFrame:
    """doc, page, x, y of pixels that differ; pages (doc, page, width, pixels: array) of equal size.

    Pages meet as whole arrays, and only places that differ become rows.
    """
    one = before.select("doc", "page", "width", F.col("pixels").alias("_old"))
    both = one.join(after.select("doc", "page", F.col("pixels").alias("_new")), ["doc", "page"])
    places = F.when(F.size("_old") > 0, F.sequence(F.lit(0), F.least(F.size("_old"), F.size("_new")) - 1)).otherwise(F.array().cast("array<int>"))
    differs = F.zip_with("_old", "_new", lambda a, b: ~a.eqNullSafe(b))
    rows = both.where(~F.col("_old").eqNullSafe(F.col("_new"))).withColumn("_differs", differs)
    rows = rows.select("doc", "page", "width", F.explode(F.filter(places, lambda i: F.get(F.col("_differs"), i))).alias("at"))
    return rows.select("doc", "page", F.pmod("at", "width").alias("x"), F.floor(F.col("at") / F.col("width")).cast("int").alias("y"))


def outside_boxes(points: DataFrame, boxes: DataFrame, pad: float = 2.0, cell: int = 64) -> DataFrame:
    """Points (doc, page, x, y) that lie in no box (doc, page, x0, y0, x1, y1) widened by ``pad``.

    Boxes are dealt to the grid cells that they touch, so a point meets only
    the boxes of its own cell by an equi-join.
    """
    down = lambda c: F.floor(c / cell).cast("int")
    wide = boxes.select("doc", "page", (F.col("x0") - pad).alias("x0"), (F.col("y0") - pad).alias("y0"), (F.col("x1") + pad).alias("x1"), (F.col("y1") + pad).alias("y1")).where("x0 < x1 and y0 < y1")
    dealt = wide.withColumn("cx", F.explode(F.sequence(down(F.col("x0")), down(F.col("x1"))))).withColumn("cy", F.explode(F.sequence(down(F.col("y0")), down(F.col("y1")))))
    p, b = points.withColumn("cx", down(F.col("x"))).withColumn("cy", down(F.col("y"))).alias("p"), dealt.alias("b")
    inside = [F.col(f"p.{k}") == F.col(f"b.{k}") for k in ("doc", "page", "cx", "cy")] + [F.col("p.x") >= F.col("b.x0"), F.col("p.x") < F.col("b.x1"), F.col("p.y") >= F.col("b.y0"), F.col("p.y") < F.col("b.y1")]
    return p.join(b, inside, "left_anti").drop("cx", "cy")


def changed_places(old: Column, new: Column) -> Column:
    """Places from 0 at which two arrays of pixels differ, as far as the shorter goes."""
    size = F.least(F.size(old), F.size(new))
    return F.when((size > 0) & ~old.eqNullSafe(new), F.filter(F.sequence(F.lit(0), size - 1), lambda i: ~F.get(old, i).eqNullSafe(F.get(new, i)))).otherwise(F.array().cast("array<int>"))


def places_outside(places: Column, width: Column, boxes: Column, pad: float = 2.0) -> Column:
    """The places of a page that lie in none of its boxes (x0, y0, x1, y1), widened by ``pad``."""
    x, y = lambda i: F.pmod(i, width), lambda i: F.floor(i / width)
    holds = lambda b, i: (x(i) >= b["x0"] - pad) & (x(i) < b["x1"] + pad) & (y(i) >= b["y0"] - pad) & (y(i) < b["y1"] + pad)
    return F.filter(places, lambda i: ~F.exists(boxes, lambda b: F.coalesce(holds(b, i), F.lit(False))))
