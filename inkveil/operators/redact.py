"""Redaction of texts and glyphs, and the checks after it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkveil.functions import geometry
from inkveil.functions.text import fingerprint
from inkveil.operators.detect import masked

#: Fixed value: an object this many times larger than the boxes on its page holds more than what is to go.
OVERSIZE = 3.0
#: Boxes of a page for each tile of its grid.
TILE_BOXES = 16
PAGE = ["doc_id", "page"]


def redact_texts(found: DataFrame, categories: list[str] | None = None, token: bool = False, text_col: str = "text") -> DataFrame:
    """Add ``redacted`` to pages with ``finds``: the finds of the categories (None: all) blacked out, the original kept.

    What was found goes from the whole page: where it stands again and no rule claims it (a number without its anchor), it
    is blacked out as well, longer contents first, so that no part of one is left of a shorter one in it.
    """
    finds = F.col("finds") if categories is None else F.filter("finds", lambda f: f["category"].isin(categories))
    text = F.coalesce(F.col(text_col), F.lit(""))
    size = lambda f: f["claim_end"] - f["claim_start"]
    content = lambda f: F.struct((-size(f)).alias("n"), F.substring(text, f["claim_start"] + 1, size(f)).alias("c"), f["category"].alias("k"))
    fill = lambda f: F.concat(F.lit("["), f["k"], F.lit("]")) if token else F.repeat(F.lit("█"), -f["n"])
    contents = F.array_sort(F.array_distinct(F.transform(finds, content)))
    return found.withColumn("redacted", F.aggregate(contents, masked(text, finds, token), lambda out, f: F.replace(out, f["c"], fill(f))))


def _pages(boxes: DataFrame) -> DataFrame:
    """``doc_id, page, n_boxes, area`` of ``boxes``, how coarse the page's grid is (``_shift``) and how many of the finest grid's cells its largest box reaches over."""
    side = F.greatest(F.avg(F.greatest("bbox.width", "bbox.height")), F.lit(2 / geometry.GRID))
    tiles = F.greatest(F.least(F.sqrt(F.count("*") / TILE_BOXES), 2 / side), F.lit(1.0))
    shift = F.greatest(geometry.COARSEST - F.floor(F.log2(tiles)), F.lit(0)).cast("int").alias("_shift")
    return boxes.groupBy(*PAGE).agg(F.count("*").alias("n_boxes"), F.sum(F.col("bbox.width") * F.col("bbox.height")).alias("area"), shift, *_reach("bbox"))


def _reach(box: str) -> tuple[Column, Column]:
    edges = geometry.grid_edges(F.col(box))
    return F.max(edges["x1"] - edges["x0"]).alias("_wide"), F.max(edges["y1"] - edges["y0"]).alias("_high")


def _corners(df: DataFrame, box: str) -> DataFrame:
    """Add the ``_tile`` of each box's corner, on pages with a ``_shift``."""
    return df.withColumn("_tile", geometry.corner_tile(geometry.grid_edges(F.col(box)), F.col("_shift")))


def _tiles(df: DataFrame, box: str) -> DataFrame:
    """``doc_id, page, _tile`` and the box for each tile where a box of the other side that overlaps it can begin (``_shift``, and the other side's ``_wide, _high``)."""
    tiles = geometry.tiles_before(geometry.grid_edges(F.col(box)), F.col("_wide"), F.col("_high"), F.col("_shift"))
    return df.select(*PAGE, box, F.explode(tiles).alias("_tile"))


def _met(a: str, b: str, outer: bool = False) -> Column:
    """On a tile of a page: does ``a``'s box overlap ``b``'s. ``outer``: ``a`` is outside of a subquery."""
    at = lambda c: F.col(f"{a}.{c}").outer() if outer else F.col(f"{a}.{c}")
    return reduce(lambda x, y: x & y, (F.col(f"{b}.{c}") == at(c) for c in (*PAGE, "_tile"))) & geometry.overlaps(at("box"), F.col(f"{b}.bbox"))


def _over(glyphs: DataFrame, boxes: DataFrame, pages: DataFrame) -> DataFrame:
    """The ``_tiles`` of ``boxes`` for ``glyphs``.

    A page's grid is as fine as its boxes are many and small: a page of few is one tile. A glyph is on the tile of its corner
    alone, a box on each where a glyph that it overlaps can begin, so a glyph is one row throughout, is done with at its first
    box, and no pair is ever a row. Glyphs are shuffled twice, by page for its grid and by tile. The joins are sorted, never
    broadcast: Spark does not know how many tiles a box has.
    """
    reach = glyphs.groupBy(*PAGE).agg(*_reach("box"))
    grid = pages.select(*PAGE, "_shift").join(reach.hint("merge"), PAGE)
    return _tiles(boxes.select(*PAGE, "bbox").join(grid.hint("merge"), PAGE), "bbox")


def redact_glyphs(glyphs: DataFrame, boxes: DataFrame) -> DataFrame:
    """Glyphs (``doc_id, page, box``) that overlap no box of their page."""
    pages = _pages(boxes)
    placed = _corners(glyphs.join(pages.select(*PAGE, "_shift").hint("merge"), PAGE, "left"), "box")
    return placed.alias("g").join(_over(glyphs, boxes, pages).alias("b").hint("merge"), _met("g", "b"), "left_anti").select(*glyphs.columns)


def _routed(boxes: DataFrame, objects: DataFrame) -> DataFrame:
    """The rows of :func:`route_pages` with the page's ``_shift``."""
    pages = _pages(boxes)
    held = objects.where(F.col("kind").isin("form", "image")).select(*PAGE, F.col("bbox").alias("box"))
    oversize = held.join(pages.hint("merge"), PAGE).where(F.col("box.width") * F.col("box.height") > OVERSIZE * F.col("area"))
    drawn = _corners(boxes.select(*PAGE, "bbox").join(pages.select(*PAGE, "_shift").hint("merge"), PAGE), "bbox")
    whole = _tiles(oversize, "box").alias("o").join(drawn.alias("b").hint("merge"), _met("o", "b"), "left_semi").select(*PAGE).distinct().withColumn("_whole", F.lit(True))
    route = F.when(F.col("_whole"), "page").otherwise("spans").alias("route")
    return pages.join(whole.hint("merge"), PAGE, "left").select(*PAGE, "n_boxes", "area", route, "_shift")


def route_pages(boxes: DataFrame, objects: DataFrame) -> DataFrame:
    """``doc_id, page, n_boxes, area, route``: ``page`` where a form or image object overlaps a box and is over three times the boxes' area, else ``spans``.

    Only objects that are that large for their page are searched for overlaps.
    """
    return _routed(boxes, objects).drop("_shift")


def carry_out(glyphs: DataFrame, boxes: DataFrame, objects: DataFrame) -> DataFrame:
    """Glyphs (``doc_id, page, box``) with the ``route`` of their page and ``removed``: what goes is marked, so both outputs come from one plan.

    On a page with the route ``page`` (:func:`route_pages`) all glyphs go; on one with ``spans`` those that overlap a box. Pages
    without boxes have no route and lose nothing. Rows that are left: ``where("NOT removed")``; the count of what each
    route removed: :func:`removed_counts`. Repeated boxes count once for a glyph; null keys match no page.
    """
    routes = _routed(boxes, objects).select(*PAGE, "route", "_shift")
    routed = _corners(glyphs.join(routes.hint("merge"), PAGE, "left"), "box")
    under = _over(glyphs, boxes, _pages(boxes)).alias("b").hint("merge").where(_met("g", "b", outer=True)).exists()
    marked = routed.alias("g").withColumn("_under", under)
    return marked.select(*glyphs.columns, "route", (F.coalesce(F.col("route") == "page", F.lit(False)) | F.col("_under")).alias("removed"))


def removed_counts(carried: DataFrame) -> DataFrame:
    """For each page of :func:`carry_out`: its route, and how many glyphs went and stayed."""
    return carried.groupBy("doc_id", "page", "route").agg(F.count_if("removed").alias("n_removed"), F.count_if(~F.col("removed")).alias("n_left"))


def residue(redacted: DataFrame, text_col: str = "text") -> DataFrame:
    """Finds of ``redacted`` pages (``finds, redacted`` and the original text) whose content still stands in the redacted text; empty if all is well.

    A content that also stands where no rule claimed it is residue too (:func:`redact_texts` leaves none).
    """
    content = F.substring(F.col(text_col), F.col("f.claim_start") + 1, F.col("f.claim_end") - F.col("f.claim_start"))
    found = redacted.select("doc_id", "page_index", F.col(text_col), "redacted", F.explode("finds").alias("f"))
    return found.select("doc_id", "page_index", F.col("f.category").alias("category"), content.alias("content"), "redacted").where(F.contains("redacted", "content")).drop("redacted")


def post_check(redacted: DataFrame, text_col: str = "text") -> DataFrame:
    """For each document: its fingerprint before and after, and the number of contents that are left. Pages of a null document are one."""
    prints = redacted.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page_index", F.coalesce(F.col(text_col), F.lit("")).alias("t"), "redacted"))).alias("p"))
    left = residue(redacted, text_col).groupBy(F.col("doc_id").alias("_doc")).agg(F.count("*").alias("n"))
    return prints.join(left, F.col("doc_id").eqNullSafe(F.col("_doc")), "left").select("doc_id", fingerprint(F.transform("p", lambda x: x["t"])).alias("before"), fingerprint(F.transform("p", lambda x: x["redacted"])).alias("after"), F.coalesce("n", F.lit(0)).alias("n_left"))
