"""Column functions on boxes: relative, origin top left, fields x, y, width, height."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What opposing margins must leave free, and the least side of a drawn box.
LEAST_FREE = 0.02
LEAST_SIDE = 0.01


def box(x: Column, y: Column, width: Column, height: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"), width.alias("width"), height.alias("height"))


def overlaps(a: Column, b: Column) -> Column:
    """Do two boxes share area; touching edges do not."""
    return (a["x"] < b["x"] + b["width"]) & (b["x"] < a["x"] + a["width"]) & (a["y"] < b["y"] + b["height"]) & (b["y"] < a["y"] + a["height"])


def inside(a: Column, b: Column) -> Column:
    """Does ``a`` lie in ``b``, edges included."""
    return (a["x"] >= b["x"]) & (a["y"] >= b["y"]) & (a["x"] + a["width"] <= b["x"] + b["width"]) & (a["y"] + a["height"] <= b["y"] + b["height"])


def centre_inside(a: Column, b: Column) -> Column:
    """Does the centre of ``a`` lie in ``b``, edges included."""
    cx, cy = a["x"] + a["width"] / 2, a["y"] + a["height"] / 2
    return cx.between(b["x"], b["x"] + b["width"]) & cy.between(b["y"], b["y"] + b["height"])


def large_enough(b: Column) -> Column:
    return (b["width"] >= LEAST_SIDE) & (b["height"] >= LEAST_SIDE)


def to_pixels(b: Column, width: Column, height: Column) -> Column:
    return box(b["x"] * width, b["y"] * height, b["width"] * width, b["height"] * height)


def to_relative(b: Column, width: Column, height: Column) -> Column:
    return box(b["x"] / width, b["y"] / height, b["width"] / width, b["height"] / height)


def to_points(b: Column, width: Column, height: Column) -> Column:
    """In points, origin bottom left: left, bottom, right, top."""
    return F.struct((b["x"] * width).alias("left"), ((1 - b["y"] - b["height"]) * height).alias("bottom"), ((b["x"] + b["width"]) * width).alias("right"), ((1 - b["y"]) * height).alias("top"))


def clamp_margins(top: Column, bottom: Column, left: Column, right: Column) -> Column:
    """Each margin within 0 and 1; a pair that leaves too little free shrinks by half the excess each."""
    one = lambda m: F.least(F.greatest(m, F.lit(0.0)), F.lit(1.0))

    def pair(a: Column, b: Column) -> tuple[Column, Column]:
        half = F.greatest((a + b - (1 - LEAST_FREE)) / 2, F.lit(0.0))
        return F.greatest(a - half, F.lit(0.0)), F.greatest(b - half, F.lit(0.0))

    (t, b), (le, r) = pair(one(top), one(bottom)), pair(one(left), one(right))
    return F.struct(t.alias("top"), b.alias("bottom"), le.alias("left"), r.alias("right"))


def bounds(m: Column) -> Column:
    """The rectangle that margins leave free."""
    return F.struct(m["left"].alias("min_x"), m["top"].alias("min_y"), (1 - m["right"]).alias("max_x"), (1 - m["bottom"]).alias("max_y"))


def in_margin(b: Column, m: Column) -> Column:
    """Does the centre of a box lie in a margin; null margins hold nothing."""
    cx, cy = b["x"] + b["width"] / 2, b["y"] + b["height"] / 2
    return F.coalesce((cy < m["top"]) | (cy > 1 - m["bottom"]) | (cx < m["left"]) | (cx > 1 - m["right"]), F.lit(False))


def union_box(boxes: Column) -> Column:
    """The smallest box around an array of boxes; null for none."""
    edge = lambda f: F.transform(boxes, f)
    x, y = F.array_min(edge(lambda b: b["x"])), F.array_min(edge(lambda b: b["y"]))
    right, low = F.array_max(edge(lambda b: b["x"] + b["width"])), F.array_max(edge(lambda b: b["y"] + b["height"]))
    return F.when(F.size(boxes) > 0, box(x, y, right - x, low - y))


def upper_median(values: Column) -> Column:
    """The middle value, of an even number the upper one; null for none."""
    return F.get(F.array_sort(values), (F.size(values) / 2).cast("int"))


def line_count(boxes: Column) -> Column:
    """Lines that boxes stand on: a new one where sorted centres are more than half the tallest box apart."""
    height = F.greatest(F.array_max(F.transform(boxes, lambda b: b["height"])), F.lit(1e-4))
    centres = F.array_sort(F.transform(boxes, lambda b: b["y"] + b["height"] * 0.5))
    n = F.size(centres)
    steps = F.zip_with(F.slice(centres, 1, F.greatest(n - 1, F.lit(0))), F.slice(centres, 2, F.greatest(n - 1, F.lit(0))), lambda a, b: b - a)
    return F.when(F.size(boxes) > 0, 1 + F.size(F.filter(steps, lambda s: s > height * 0.5))).otherwise(0)


def cell_gap(boxes: Column) -> Column:
    """Is any box more than two widths of the first one right of the box before it."""
    width = F.greatest(F.get(boxes, F.lit(0))["width"], F.lit(1e-4))
    n = F.greatest(F.size(boxes) - 1, F.lit(0))
    return F.coalesce(F.exists(F.zip_with(F.slice(boxes, 1, n), F.slice(boxes, 2, n), lambda a, b: b["x"] - a["x"]), lambda s: s > width * 2), F.lit(False))


#: Cells of a page's grid along each side, and how often that number can be halved: a tile is a cell of such a coarser grid.
GRID = 32
COARSEST = 5


def _on_grid(at: Column, n: int = GRID) -> Column:
    """The row or column of the grid that a place is in; what lies off the page is in the outermost one."""
    return F.least(F.greatest(F.floor(at * n), F.lit(0)), F.lit(n - 1)).cast("int")


def grid_cells(b: Column, n: int = GRID) -> Column:
    """The cells that a box touches, its edges included: ``n`` squared at most. Empty for a null box or one with a null or NaN side."""
    x0, y0, x1, y1 = (F.when(~F.isnan(v), v) for v in (b["x"], b["y"], b["x"] + b["width"], b["y"] + b["height"]))
    line = lambda low, high: F.sequence(_on_grid(F.least(low, high), n), _on_grid(F.greatest(low, high), n))
    cells = F.flatten(F.transform(line(y0, y1), lambda r: F.transform(line(x0, x1), lambda c: r * n + c)))
    return F.when(x0.isNotNull() & y0.isNotNull() & x1.isNotNull() & y1.isNotNull(), cells).otherwise(F.array().cast("array<int>"))


def corner_cell(b: Column, n: int = GRID) -> Column:
    """The cell of a box's upper left corner."""
    return _on_grid(b["y"], n) * n + _on_grid(b["x"], n)


def grid_edges(b: Column) -> Column:
    """The columns ``x0, x1`` and rows ``y0, y1`` of the grid where a box begins and ends; null for a null box or one with a null or NaN side."""
    sides = (b["x"], b["y"], b["x"] + b["width"], b["y"] + b["height"])
    whole = reduce(lambda p, q: p & q, (v.isNotNull() & ~F.isnan(v) for v in sides))
    return F.when(whole, F.struct(*(_on_grid(v).alias(c) for v, c in zip(sides, ("x0", "y0", "x1", "y1"), strict=True))))


_halved = lambda at, shift: F.call_function("shiftright", at, shift)


def corner_tile(edges: Column, shift: Column) -> Column:
    """The tile of a box's upper left corner, on a grid that is halved ``shift`` times."""
    return _halved(edges["y0"], shift) * GRID + _halved(edges["x0"], shift)


def tiles_before(edges: Column, wide: Column, high: Column, shift: Column) -> Column:
    """The tiles where a box can begin that reaches over ``wide`` and ``high`` cells at most and overlaps the one of ``edges``; null if something is null."""
    back = lambda at, by: F.greatest(at - by, F.lit(0))
    line = lambda low, last: F.sequence(_halved(low, shift), _halved(last, shift))
    columns, rows = line(back(edges["x0"], wide), edges["x1"]), line(back(edges["y0"], high), edges["y1"])
    return F.flatten(F.transform(rows, lambda r: F.transform(columns, lambda c: r * GRID + c)))
