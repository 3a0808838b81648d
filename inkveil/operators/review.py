"""The review table: merging, filtering, sorting, editing, placing items on pages.

Items have ``doc_id, id, origin, page, bbox, category, content`` and more; boxes are structs of x, y,
width, height. Joins are on document and page first, so they are hash or sort-merge joins with the
geometry as a further condition, never a product of all items.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkveil.functions import geometry
from inkveil.functions.text import category_label
from inkveil.operators.spans import running_sum

PAGE = ["doc_id", "page"]
#: Cells of the grid along each side where one side of a join is in a single cell: fewer rows for the other.
COARSE = 8


def drop_overlapping(detected: DataFrame, kept: DataFrame) -> DataFrame:
    """Detected items that overlap no item of ``kept`` on their page."""
    d, k = detected.alias("d"), kept.select(*PAGE, "bbox").alias("k")
    on = (F.col("d.doc_id") == F.col("k.doc_id")) & (F.col("d.page") == F.col("k.page")) & geometry.overlaps(F.col("d.bbox"), F.col("k.bbox"))
    return d.join(k, on, "left_anti")


def merge_redetected(items: DataFrame, detected: DataFrame) -> DataFrame:
    """Manual and imported items stay, detected ones are replaced by the new finds that overlap none of those."""
    own = items.where(F.col("origin") != "detected")
    return own.unionByName(drop_overlapping(detected, own), allowMissingColumns=True)


def absorbed(items: DataFrame, boxes: DataFrame) -> DataFrame:
    """Items that lie fully in a box of ``boxes`` (``doc_id, page, bbox``) on their page. Sides are not negative.

    An item's corner lies in the box too, so it meets the boxes, each once, that touch its corner's cell of a coarse grid. The join is
    sorted: Spark does not know how many cells a box has.
    """
    i = items.withColumn("_cell", geometry.corner_cell(F.col("bbox"), COARSE)).alias("i")
    b = boxes.select(*PAGE, "bbox").distinct().withColumn("_cell", F.explode(geometry.grid_cells(F.col("bbox"), COARSE))).alias("b")
    same = (F.col("i.doc_id") == F.col("b.doc_id")) & (F.col("i.page") == F.col("b.page")) & (F.col("i._cell") == F.col("b._cell"))
    return i.join(b.hint("merge"), same & geometry.inside(F.col("i.bbox"), F.col("b.bbox")), "left_semi").drop("_cell")


def list_filter(items: DataFrame, categories: list[str] | None = None, pages: list[int] | Column | None = None) -> DataFrame:
    """Items of the categories and (1-based) pages; None filters nothing, an empty list lets nothing pass. Pages may be an array column."""
    if categories is not None:
        items = items.where(F.col("category").isin(categories) if categories else F.lit(False))
    if isinstance(pages, Column):
        items = items.where(F.array_contains(pages, F.col("page") + 1))
    elif pages is not None:
        items = items.where((F.col("page") + 1).isin(pages) if pages else F.lit(False))
    return items


def save_filter(items: DataFrame, categories: list[str] | None) -> DataFrame:
    """``redact`` is true for items that a save writes: the category filter counts, a page filter does not."""
    return items.withColumn("redact", F.lit(True) if categories is None else F.col("category").isin(categories) if categories else F.lit(False))


def save_summary(items: DataFrame, categories: list[str] | None) -> DataFrame:
    """For each document of :func:`save_filter`: how many items a save redacts, and how many the category filter hides from it."""
    told = save_filter(items, categories)
    return told.groupBy("doc_id").agg(F.count_if("redact").alias("n_redacted"), F.count_if(~F.col("redact")).alias("n_hidden"))


def list_order(column: str = "position", descending: bool = False) -> list[Column]:
    """Order of the list by ``category`` (label), ``content``, ``page`` or position; ties by position and id.

    Labels and contents are in Korean order: Hangul before Latin letters, and these without regard to case first.
    """
    korean = lambda c: F.collate(c, "ko")
    key = {"category": [korean(category_label(F.col("category")))], "content": [korean(F.col("content"))], "page": [F.col("page")]}.get(column, [])
    place = [F.col("page"), F.col("bbox.y"), F.col("bbox.x"), F.col("id")]
    return [c.desc() if descending else c.asc() for c in [*key, *place]]


def facets(items: DataFrame) -> DataFrame:
    """Categories there are, with label and count; ``place`` orders by label, Custom last."""
    counted = items.groupBy("category").agg(F.count("*").alias("n")).withColumn("label", category_label(F.col("category")))
    return counted.withColumn("place", F.row_number().over(Window.orderBy(F.col("category") == "Custom", "label")))


def neighbours(items: DataFrame) -> DataFrame:
    """Add ``previous`` and ``next``: ids beside an item in its document's list, itself at the ends."""
    w = Window.partitionBy("doc_id").orderBy("page", "bbox.y", "bbox.x", "id")
    return items.withColumn("previous", F.coalesce(F.lag("id").over(w), "id")).withColumn("next", F.coalesce(F.lead("id").over(w), "id"))


def find_summary(items: DataFrame) -> DataFrame:
    """For each document: number of detected items and the first page that has one."""
    return items.where(F.col("origin") == "detected").groupBy("doc_id").agg(F.count("*").alias("n_found"), F.min("page").alias("first_page"))


def edit_cells(items: DataFrame, edits: DataFrame, now: Column) -> DataFrame:
    """Changed items only: ``edits`` (``doc_id, id, field, value``) set category or content, trimmed; an empty category and an unchanged value are refused."""
    value = F.trim(F.col("value"))
    joined = items.join(edits, ["doc_id", "id"])
    changed = F.when(F.col("field") == "category", (value != "") & ~value.eqNullSafe(F.col("category"))).when(F.col("field") == "content", ~value.eqNullSafe(F.col("content")))
    put = lambda name: F.when(F.col("field") == name, value).otherwise(F.col(name))
    return joined.where(changed).withColumns({"category": put("category"), "content": put("content"), "modified": F.lit(True), "updated_at": now}).drop("field", "value")


def move_boxes(items: DataFrame, moves: DataFrame, texts: DataFrame, now: Column) -> DataFrame:
    """Moved items: ``moves`` (``doc_id, id, new_bbox``); the first original box stays, and detected items take the text under the new box (``texts``: ``doc_id, id, text``) if there is any."""
    joined = items.join(moves, ["doc_id", "id"]).join(texts, ["doc_id", "id"], "left")
    reread = F.when((F.col("origin") == "detected") & (F.col("text") != ""), F.col("text")).otherwise(F.col("content"))
    return joined.withColumns({"original_bbox": F.coalesce("original_bbox", "bbox"), "content": reread, "modified": F.lit(True), "updated_at": now}).withColumn("bbox", F.col("new_bbox")).drop("new_bbox", "text")


def new_items(boxes: DataFrame, now: Column) -> DataFrame:
    """Manual items from drawn boxes (``doc_id, id, page, bbox``), too small ones left out."""
    return boxes.where(geometry.large_enough(F.col("bbox"))).select(
        "doc_id", "id", F.lit("manual").alias("origin"), "page", "bbox", F.lit("Custom").alias("category"), F.lit("").alias("content"), F.lit(None).cast("string").alias("pattern_type"),
        F.lit(None).cast("double").alias("confidence"), F.lit("NotValidated").alias("validation"), F.lit(False).alias("modified"), now.alias("created_at"), now.alias("updated_at"),
    )


def text_in_boxes(boxes: DataFrame, glyphs: DataFrame) -> DataFrame:
    """``text`` of each box (``doc_id, page, id, bbox``): glyphs (``doc_id, page, n, ch, box``) whose centre it holds, in order, trimmed.

    Boxes and glyphs meet page by page, so what travels is each of them once and no pair of both; a page's glyphs are in
    memory together. Boxes that lie alike are read once. Defined cases: boxes with a null key or side hold nothing, and so
    have an empty text; boxes of one id are read as one, a glyph in two of them twice.
    """
    side = lambda c, name: F.col(f"{c}.{name}").cast("double")
    b = boxes.select(*PAGE, "id", side("bbox", "x").alias("x"), (side("bbox", "x") + side("bbox", "width")).alias("right"), side("bbox", "y").alias("y"), (side("bbox", "y") + side("bbox", "height")).alias("low"))
    centre = lambda at, size: side("box", at) + side("box", size) / 2
    g = glyphs.where(F.col("doc_id").isNotNull() & F.col("page").isNotNull()).select(*PAGE, "n", "ch", centre("x", "width").alias("x"), centre("y", "height").alias("y"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in b.select(*PAGE, "id").schema) + ", text string"
    read = b.groupBy(*PAGE).cogroup(g.groupBy(*PAGE)).applyInArrow(_read_boxes, schema)
    return read.withColumn("text", F.trim("text"))


def _read_boxes(boxes: pa.Table, glyphs: pa.Table) -> pa.Table:
    """The boxes of a page, each id once, with the characters of the glyphs whose centre they hold, by ``n`` and character (nulls last)."""
    glyphs = glyphs.filter(pc.is_valid(glyphs["ch"])).sort_by([("n", "ascending"), ("ch", "ascending")])
    x, y, ch = (glyphs[c].to_numpy() for c in ("x", "y", "ch"))
    ids = boxes["id"].combine_chunks().dictionary_encode(null_encoding="encode")
    sides: dict[int, list[tuple]] = {}
    for one, *box in zip(ids.indices.to_pylist(), *(boxes[c].to_numpy() for c in ("x", "right", "y", "low"))):
        sides.setdefault(one, []).append(tuple(box))

    def inside(left: float, right: float, top: float, low: float) -> np.ndarray:
        return np.flatnonzero((x >= left) & (x <= right) & (y >= top) & (y <= low))

    @cache
    def read(*box: float) -> str:
        return "".join(ch[inside(*box)])

    text = [read(*b[0]) if len(b) == 1 else "".join(ch[np.sort(np.concatenate([inside(*one) for one in b]))]) for _, b in sorted(sides.items())]
    keys = {c: boxes[c].slice(0, len(text)) for c in PAGE}  # the same in each row
    return pa.table({**keys, "id": ids.dictionary, "text": pa.array(text, pa.string())})


def reanchor(items: DataFrame, pages: DataFrame, text_col: str = "text") -> DataFrame:
    """Add ``found_at`` (place of the first hit of the content on its page, from 0; null if none or empty) and ``position_uncertain``."""
    joined = items.join(pages.select("doc_id", F.col("page_index").alias("page"), F.col(text_col).alias("_page")), PAGE, "left")
    at = F.expr("position(content, _page)")
    found = F.when((F.coalesce(F.length("content"), F.lit(0)) > 0) & (at > 0), at - 1)
    return joined.withColumn("found_at", found).withColumn("position_uncertain", F.col("found_at").isNull()).drop("_page")


def reanchor_boxes(items: DataFrame, pages: DataFrame) -> DataFrame:
    """Items (``doc_id, page, bbox, content``) with the box around the first place where their content stands on their page, and ``found_at``.

    ``pages`` (``doc_id, page_index, glyphs``) are put together to texts, as they are; a glyph may hold several characters
    or none, so the hit's characters are led back to the glyphs that they come from. What is not found keeps its box and is
    ``position_uncertain``.

    Defined cases: an empty or null content, a page that is missing and one without glyphs find nothing; of repeated
    pages one is used; items with null keys find nothing; other columns come along. The join is sorted: Spark does not know
    how many glyphs a page has, and takes pages for few bytes.
    """
    box = lambda g: geometry.box(g["x"].cast("double"), g["y"].cast("double"), g["w"].cast("double"), g["h"].cast("double"))
    drawn = pages.groupBy("doc_id", F.col("page_index").alias("page")).agg(F.first("glyphs").alias("_glyphs"))
    texts = F.transform("_glyphs", lambda g: F.coalesce(g["ch"], F.lit("")))
    read = drawn.withColumn("_page", F.array_join(texts, "")).withColumn("_single", F.forall(texts, lambda t: F.length(t) == 1))
    joined = items.join(read.hint("merge"), PAGE, "left")
    at = F.expr("position(content, _page)")
    step = joined.withColumn("found_at", F.when((F.coalesce(F.length("content"), F.lit(0)) > 0) & (at > 0), at - 1))
    start, size = F.col("found_at"), F.length("content")
    # With one character a glyph, places are glyphs; else a glyph counts if its characters and the hit's overlap.
    ends = running_sum(F.transform("_glyphs", lambda g: F.length(F.coalesce(g["ch"], F.lit("")))))
    placed = F.zip_with("_glyphs", ends, lambda g, e: F.struct(g.alias("g"), (e - F.length(F.coalesce(g["ch"], F.lit("")))).alias("s"), e.alias("e")))
    several = F.transform(F.filter(placed, lambda p: (p["e"] > start) & (p["s"] < start + size) & (p["e"] > p["s"])), lambda p: p["g"])
    hit = F.when(F.col("_single"), F.slice("_glyphs", start + 1, size)).otherwise(several)
    found = F.when(start.isNotNull(), geometry.union_box(F.transform(hit, box)))
    boxed = step.withColumn("_found", found).withColumn("bbox", F.coalesce("_found", "bbox"))
    return boxed.withColumn("position_uncertain", start.isNull()).drop("_glyphs", "_page", "_single", "_found")


#: The whole page, for groups that no margin binds.
_PAGE_BOUNDS = "named_struct('min_x', 0D, 'min_y', 0D, 'max_x', 1D, 'max_y', 1D)"


def _bounded(items: DataFrame, zones: DataFrame | None) -> DataFrame:
    """Add ``_b``: what the margins of the page's zone (``doc_id, page, margins``) leave free; without one the whole page."""
    if zones is None:
        return items.withColumn("_b", F.expr(_PAGE_BOUNDS))
    free = zones.select(*PAGE, geometry.bounds(F.col("margins")).alias("_b"))
    return items.join(free, PAGE, "left").withColumn("_b", F.coalesce("_b", F.expr(_PAGE_BOUNDS)))


def shift_group(items: DataFrame, dx: float, dy: float, keys: list[str] | None = None, zones: DataFrame | None = None) -> DataFrame:
    """Move each group (by ``keys``) by one shift, cut so that the whole group stays within its page or what ``zones`` leave of it.

    A group larger than that ends at its left or top. A group over several pages keeps within the tightest of their bounds.
    """
    w = Window.partitionBy(*(keys or PAGE))
    b = F.col("bbox")
    held = _bounded(items, zones)
    edge = lambda name, f: f(F.col(f"_b.{name}")).over(w)
    cut = lambda d, low, high, least, most: F.greatest(F.least(F.lit(d), most - high), least - low)
    x = cut(dx, F.min(b["x"]).over(w), F.max(b["x"] + b["width"]).over(w), edge("min_x", F.max), edge("max_x", F.min))
    y = cut(dy, F.min(b["y"]).over(w), F.max(b["y"] + b["height"]).over(w), edge("min_y", F.max), edge("max_y", F.min))
    moved = held.withColumn("_dx", x).withColumn("_dy", y).withColumn("bbox", geometry.box(b["x"] + F.col("_dx"), b["y"] + F.col("_dy"), b["width"], b["height"]))
    return moved.drop("_dx", "_dy", "_b")


def scale_group(items: DataFrame, x: float, y: float, width: float, height: float, keys: list[str] | None = None, zones: DataFrame | None = None) -> DataFrame:
    """Map each group's common box onto the given one; an axis of no size keeps its scale. With ``zones`` each box is cut to what they leave free of its page."""
    w = Window.partitionBy(*(keys or PAGE))
    b = F.col("bbox")
    left, top = F.min(b["x"]).over(w), F.min(b["y"]).over(w)
    wide, high = F.max(b["x"] + b["width"]).over(w) - left, F.max(b["y"] + b["height"]).over(w) - top
    step = items.withColumns({"_l": left, "_t": top, "_sx": F.when(wide > 0, width / wide).otherwise(1.0), "_sy": F.when(high > 0, height / high).otherwise(1.0)})
    new = geometry.box(x + (b["x"] - F.col("_l")) * F.col("_sx"), y + (b["y"] - F.col("_t")) * F.col("_sy"), b["width"] * F.col("_sx"), b["height"] * F.col("_sy"))
    scaled = step.withColumn("bbox", new).drop("_l", "_t", "_sx", "_sy")
    if zones is None:
        return scaled
    free = F.col("_b")
    inside = lambda at, size, low, most: (F.least(F.greatest(at, low), most), F.least(F.greatest(at + size, low), most))
    (x0, x1), (y0, y1) = inside(b["x"], b["width"], free["min_x"], free["max_x"]), inside(b["y"], b["height"], free["min_y"], free["max_y"])
    return _bounded(scaled, zones).withColumn("bbox", geometry.box(x0, y0, x1 - x0, y1 - y0)).drop("_b")


#: Boxes of a template at most that goes into the plan: a group drawn by hand.
TEMPLATE_BOXES = 1000


def _rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    """The columns as ``F.round`` gives them, without making a decimal number of each value, which takes longer than all else of a stamped box.

    A number from 0 on, with few enough digits, lies above a half step if it is at least the double nearest to that, so what is
    close to a half step is compared with it; other numbers are left to ``F.round``.
    """
    step = 10.0**digits
    scaled = df.withColumns({f"_s_{c}": F.col(c) * step for c in columns}).withColumns({f"_f_{c}": F.floor(f"_s_{c}").cast("double") for c in columns})

    def one(c: str) -> Column:
        v, s, f = F.col(c), F.col(f"_s_{c}"), F.col(f"_f_{c}")
        up = F.when(s - f < 0.49, F.lit(0.0)).when((s - f > 0.51) | (v >= (f + 0.5) / step), F.lit(1.0)).otherwise(F.lit(0.0))
        return F.when((v >= 0) & (s < 1e11), (f + up) / step).otherwise(F.round(v, digits))

    return scaled.withColumns({c: one(c) for c in columns}).select(*df.columns)


def stamp(template: DataFrame, pages: DataFrame, most: int | None = TEMPLATE_BOXES) -> DataFrame:
    """The boxes of :func:`stamp_sides` as ``doc_id, page, n, bbox``."""
    return stamp_sides(template, pages, most).select("doc_id", "page", "n", geometry.box(*(F.col(c) for c in ("x", "y", "width", "height"))).alias("bbox"))


def stamp_sides(template: DataFrame, pages: DataFrame, most: int | None = TEMPLATE_BOXES, digits: int | None = None) -> DataFrame:
    """Copy a group of boxes (``n, bbox``) to each page's anchor (``doc_id, page, x, y``), moved back where it would leave the page, sizes kept.

    Gives ``doc_id, page, n, x, y, width, height``, as a struct for each of so many rows takes two fifths more time.

    The template is read to the driver, with an error for more than ``most`` boxes, and is a constant of the plan, so that
    stamping is one projection of the pages. With ``most`` None it may have any number of boxes and stays a table, which
    is sent to the pages' tasks (the boxes of one page) and there joined to every anchor. An empty template gives no rows.
    With ``digits`` places and sizes are rounded; what depends on the template or the page alone is worked out once for it.
    """
    hit = lambda at, size: F.greatest(F.least(F.col(at), 1 - size), F.lit(0.0))
    size = lambda c: c if digits is None else F.round(c, digits)
    if most is None:
        b = F.col("bbox")
        edges = template.agg(F.min(b["x"]).alias("_l"), F.min(b["y"]).alias("_t"), F.max(b["x"] + b["width"]).alias("_r"), F.max(b["y"] + b["height"]).alias("_b"))
        l, t = F.col("_l"), F.col("_t")
        drawn = template.crossJoin(F.broadcast(edges)).select("n", (b["x"] - l).alias("dx"), (b["y"] - t).alias("dy"), size(b["width"]).alias("width"), size(b["height"]).alias("height"))
        at = pages.crossJoin(F.broadcast(edges)).select("doc_id", "page", hit("x", F.col("_r") - l).alias("ax"), hit("y", F.col("_b") - t).alias("ay"))
        placed = at.crossJoin(F.broadcast(drawn))
    else:
        rows = template.select("n", "bbox.x", "bbox.y", "bbox.width", "bbox.height").orderBy("n").limit(most + 1).collect()
        if len(rows) > most:
            raise ValueError(f"a template has {most} boxes at most")
        left, top = (min((r[c] for r in rows), default=0.0) for c in ("x", "y"))
        wide, high = (max((r[c] + r[s] for r in rows), default=0.0) - at for c, s, at in (("x", "width", left), ("y", "height", top)))
        kind = f"array<struct<n:{template.schema['n'].dataType.simpleString()},dx:double,dy:double,width:double,height:double>>"
        boxes = F.array(*(F.struct(F.lit(r["n"]), F.lit(r["x"] - left), F.lit(r["y"] - top), size(F.lit(r["width"])), size(F.lit(r["height"]))) for r in rows)).cast(kind)
        placed = pages.select("doc_id", "page", hit("x", F.lit(wide)).alias("ax"), hit("y", F.lit(high)).alias("ay"), F.explode(boxes).alias("t")).select("doc_id", "page", "ax", "ay", "t.*")
    placed = placed.select("doc_id", "page", "n", (F.col("ax") + F.col("dx")).alias("x"), (F.col("ay") + F.col("dy")).alias("y"), "width", "height")
    return placed if digits is None else _rounded(placed, digits, "x", "y")


def exclude_margins(glyphs: DataFrame, zones: DataFrame) -> DataFrame:
    """Glyphs (``doc_id, page, box``) whose centre lies in no margin of their page's first zone (``doc_id, page, n, margins``)."""
    first = zones.groupBy(*PAGE).agg(F.min_by("margins", "n").alias("margins"))
    return glyphs.join(first, PAGE, "left").where(~geometry.in_margin(F.col("box"), F.col("margins"))).drop("margins")


def upsert_zones(zones: DataFrame, new: DataFrame) -> DataFrame:
    """Zones with those of ``new`` in place of the ones of the same page."""
    return zones.join(new, PAGE, "left_anti").unionByName(new)


def same_margins(pages: DataFrame, margins: Column) -> DataFrame:
    """Zones that give all ``pages`` (``doc_id, page``) the same margins, clamped."""
    m = geometry.clamp_margins(*(margins[c] for c in ("top", "bottom", "left", "right")))
    return pages.select(*PAGE).distinct().withColumn("margins", m)


def replace_imported(items: DataFrame, log: DataFrame, imported: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Items and log after an import: a document with imported rows has those only, and its log is empty; others stay as they are."""
    documents = imported.select("doc_id").distinct()
    own = items.join(documents, "doc_id", "left_anti")
    return own.unionByName(imported, allowMissingColumns=True), log.join(documents, "doc_id", "left_anti")


def summary(items: DataFrame) -> DataFrame:
    """Counts by category, validation and confidence band, with subtotals."""
    band = F.when(F.col("confidence") >= 0.8, "high").when(F.col("confidence") >= 0.5, "middle").otherwise("low")
    return items.withColumn("band", band).rollup("category", "validation", "band").agg(F.count("*").alias("n"))
