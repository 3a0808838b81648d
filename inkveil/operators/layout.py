"""Detection on pages of positioned glyphs: ``doc_id, page_index, glyphs array<struct<ch, x, y, w, h>>`` in document order.

Text rules run as in text mode. Numbers that stand in a column or jump a cell are refused, and an
address claims the whole cell that it stands in. Only that cell is found by an Arrow function, on
pages that have an address at all: following lines greedily is no window of SQL.
"""

from __future__ import annotations

import re
import string
from bisect import bisect_left
from collections.abc import Iterable
from functools import reduce
from itertools import accumulate, pairwise, takewhile
from operator import and_, or_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkveil.functions import geometry
from inkveil.functions.text import normalized
from inkveil.operators.detect import PAGE, _confirmed
from inkveil.operators.spans import CANDIDATE, greedy, once, spans, with_candidates
from inkveil.plans import rules as R

# Fixed values, in widths (of a seed's middle glyph) across and heights down.
COLUMN_GAP, NAME_MARGIN, LEFT_SLACK, EDGE_SLACK = 2.0, 0.8, 0.25, 0.1
SAME_LINE, LINE_GAP = 0.6, 3.5
#: Lines below an address that may belong to its cell; none below a building's line.
MORE_LINES = 2
BARS = "|│┃｜∣ǀ⏐￨ｌ"

_LINE_REGION = re.compile(r"\s*" + R.REGION)
_POSTAL = re.compile(r"[1-7]\d{2}-?\d{3}|(?:0[1-9]|[1-5]\d|6[0-3])\d{3}")


def _postal(token: str) -> bool:
    digits = token.replace("-", "")
    return bool(_POSTAL.fullmatch(digits)) and (len(digits) == 6) == ("-" in token)


#: What a cell is made of, beside syllables.
_COUNTED = frozenset(string.ascii_letters + string.digits + "-")


def _counted(c: str) -> bool:
    return "가" <= c <= "힣" or c in _COUNTED


def _middle(values: np.ndarray) -> float:
    return max(float(np.sort(values)[len(values) // 2]), 1e-4)


class _Page:
    """One page's glyphs. Whole columns are arrays; a line has few glyphs, for which lists are faster than arrays."""

    def __init__(self, text: str, x, y, w, h):
        x, y, w, h = (np.asarray(a, float) for a in (x, y, w, h))
        self.ch, self.columns, self.yc = text, (x, x + w, w, h), y + h / 2
        self.x, self.right, self.xc = x.tolist(), (x + w).tolist(), (x + w / 2).tolist()
        self.known: dict[float, tuple[list[list[int]], list[float], list[float]]] = {}

    def span(self, line: list[int], left: float, right: float, cw: float) -> tuple[float, float]:
        """Left and right edge of the cell on the seed's line: as far as glyphs follow without a gap or a wall.

        To the left a postal code is the cell's end, and any other number of three digits or more is outside it.
        Where nothing bounds the text on the left it is prose, and the seed's own edge holds.
        """
        x, ends, slack, gap = self.x, self.right, EDGE_SLACK * cw, COLUMN_GAP * cw
        bars = [i for i in line if self.ch[i] in BARS]
        east_wall = min((ends[i] for i in bars if x[i] >= right - slack), default=np.inf)
        west_wall = max((x[i] for i in bars if ends[i] <= left + slack), default=-np.inf)
        glyphs = [i for i in line if _counted(self.ch[i])]

        east = sorted((i for i in glyphs if ends[i] > right + slack), key=x.__getitem__)
        reach = list(accumulate((ends[i] for i in east), max, initial=right))
        east_end = reach[_first(x[i] >= east_wall or x[i] - r > gap for i, r in zip(east, reach))]

        west = sorted((i for i in glyphs if x[i] < left - slack), key=lambda i: (ends[i] != ends[i], -ends[i]))
        reach = list(accumulate((x[i] for i in west), min, initial=left))
        n = _first(x[i] <= west_wall or r - ends[i] > gap for i, r in zip(west, reach))
        for number in re.finditer("[0-9-]+", "".join(self.ch[i] for i in west[:n])):
            token = number.group()[::-1]
            if _postal(token):
                return reach[number.end()], east_end
            if len(token.replace("-", "")) >= 3:
                return reach[number.start()], east_end
        return (reach[n] if n < len(west) else left), east_end

    def lines(self, tolerance: float) -> tuple[list[list[int]], list[float], list[float]]:
        """Lines from the top with their glyphs and heights, and the band of each glyph: a line takes what is within the tolerance of its first. Found once for all seeds of a size."""
        if tolerance not in self.known:
            order = np.argsort(self.yc, kind="stable")
            yc, order, starts = self.yc[order].tolist(), order.tolist(), [0]
            while starts[-1] < len(yc):
                first = starts[-1]
                starts.append(max(first + 1, bisect_left(yc, tolerance, first, key=lambda v: v - yc[first])))  # a glyph without a place is a line
            bands = np.round(self.yc / tolerance)
            self.known[tolerance] = [order[a:b] for a, b in pairwise(starts)], [yc[a] for a in starts[:-1]], np.where(np.isnan(bands), np.inf, bands).tolist()
        return self.known[tolerance]

    def cell(self, start: int, end: int, more: int) -> list[int]:
        """Places of the glyphs of the cell around ``[start, end)``, in reading order."""
        if end - start < 2:
            return list(range(start, end))
        x, ends, widths, heights = (a[start:end] for a in self.columns)
        cw, ch = _middle(widths), _middle(heights)
        at, tolerance = float(np.sort(self.yc[start:end])[(end - start) // 2]), SAME_LINE * ch
        own_line = np.flatnonzero(np.abs(self.yc - at) < tolerance).tolist()
        left, right = self.span(own_line, float(x.min()), float(ends.max()), cw)
        low, high, name_edge = left - LEFT_SLACK * cw, right + COLUMN_GAP * cw, left - NAME_MARGIN * cw
        in_column = lambda line: [i for i in line if low <= self.xc[i] <= high and self.ch[i] not in BARS]

        lines, tops, bands = self.lines(tolerance)
        own = _first(abs(top - at) < tolerance for top in tops) % len(tops)
        near = [k for k in range(own + 1, min(own + 1 + more, len(lines))) if tops[k] - tops[k - 1] <= LINE_GAP * ch and all(self.right[i] >= name_edge for i in lines[k])]
        below = {k: ids for k in near if (ids := in_column(lines[k]))}
        another = lambda ids: _LINE_REGION.match("".join(self.ch[i] for i in sorted(ids, key=self.x.__getitem__)))
        kept = takewhile(lambda k: k in below and not another(below[k]), range(own + 1, own + 1 + more))

        ids = {*range(start, end), *in_column(lines[own])}.union(*(below[k] for k in kept))
        return sorted(ids, key=lambda i: (bands[i], self.x[i] if self.x[i] == self.x[i] else np.inf, i))


def _first(stops: Iterable[bool]) -> int:
    """How many come before the first stop."""
    return sum(1 for _ in takewhile(lambda stop: not stop, stops))


@F.arrow_udf(T.ArrayType(T.ArrayType(T.IntegerType())))
def cells(text: pa.Array, x: pa.Array, y: pa.Array, w: pa.Array, h: pa.Array, starts: pa.Array, ends: pa.Array, more: pa.Array) -> pa.Array:
    """For each seed of a page its cell; a negative ``more`` stands for the seed itself."""
    flat = lambda a: a.values.to_numpy(zero_copy_only=False)
    boxes, seeds = [flat(a) for a in (x, y, w, h)], [flat(a).tolist() for a in (starts, ends, more)]
    glyph_at, seed_at = (pairwise(a.offsets.to_pylist()) for a in (x, more))
    out = []
    for t, (a, b), (c, d) in zip(text.to_pylist(), glyph_at, seed_at):
        asked = list(zip(*(s[c:d] for s in seeds)))
        page = _Page(t, *(v[a:b] for v in boxes)) if any(m >= 0 for *_, m in asked) else None
        out.append([page.cell(s, e, m) if m >= 0 else list(range(s, e)) for s, e, m in asked])
    return pa.array(out, pa.list_(pa.list_(pa.int32())))


def _slice(glyphs: Column, start: Column, end: Column) -> Column:
    boxes = F.slice(glyphs, start + 1, end - start)
    return F.transform(boxes, lambda g: F.struct(g["x"].alias("x"), g["y"].alias("y"), g["w"].alias("width"), g["h"].alias("height")))


def _may_grow(text: Column) -> Column:
    """Are all letters of a building's word on the page, wherever they stand? No cell of another page can hold one."""
    words = R.LATE_BUILDING.removeprefix("(?:").removesuffix(")").split("|")
    return reduce(or_, (reduce(and_, (F.contains(text, F.lit(c)) for c in dict.fromkeys(w))) for w in words))


def page_cells(pages: DataFrame, rules: tuple[R.Rule, ...] = R.RULES, dongs: DataFrame | None = None) -> DataFrame:
    """Add ``text`` and ``finds``: structs of the candidate's fields and ``claimed``, the places it claims in reading order."""
    rules = tuple(r for r in rules if dongs is not None or not r.lookup)
    g = F.col("glyphs")
    step = once(pages, "text", F.array_join(F.transform(g, lambda c: c["ch"]), ""))
    step = once(step, "_norm", normalized(F.col("text")))

    def stands(c: Column) -> Column:
        boxes = _slice(g, c["start"], c["end"])
        number = c["pattern_type"].isin("RRN", "Card")
        return ~(number & (geometry.line_count(boxes) > 2)) & ~((c["pattern_type"] == "Card") & geometry.cell_gap(boxes))

    step = with_candidates(step, rules, F.col("text"))
    step = once(step, "_all", F.filter("_all", stands))
    if dongs is not None and any(r.lookup for r in rules):
        step = _confirmed(step, rules, dongs)
    region = F.when(F.col("_norm").rlike("[시군구도]") & _may_grow(F.col("_norm")), spans(F.col("_norm"), "(?U)" + R.REGION + R.TOWN)).otherwise(F.array().cast("array<struct<start:int,end:int,match:string>>"))
    step = once(step, "_late", region)
    more = F.concat(
        F.transform("_all", lambda c: F.when(c["category"] != "Address", -1).when(c["pattern_type"] == "AddressBuildingLine", 0).otherwise(MORE_LINES)),
        F.transform("_late", lambda s: F.lit(MORE_LINES)),
    )
    both = lambda name, late: F.concat(F.transform("_all", lambda c: c[name]), F.transform("_late", lambda s: s[late]))
    axis = lambda n: F.transform(g, lambda c: c[n].cast("double"))
    step = step.withColumn("_cells", cells("text", axis("x"), axis("y"), axis("w"), axis("h"), both("claim_start", "start"), both("claim_end", "end"), more))

    with_cells = F.transform("_all", lambda c, i: F.struct(*(c[f].alias(f) for f in _FIELDS), F.get("_cells", i).alias("claimed")))
    test = lambda c: F.sequence(c["start"], c["end"] - 1)
    clash = lambda k, c: F.arrays_overlap(k["claimed"], test(c)) | F.coalesce((k["claim_start"] < c["end"]) & (c["start"] < k["claim_end"]), F.lit(False))
    low = lambda c: F.least(c["start"], c["claim_start"], F.array_min(c["claimed"]))
    high = lambda c: F.greatest(c["end"], c["claim_end"], F.array_max(c["claimed"]) + 1)
    found = greedy(with_cells, _FOUND, low, high, clash)
    step = once(step, "finds", found)
    step = once(step, "_taken", F.flatten(F.transform("finds", lambda f: F.concat(f["claimed"], F.sequence(f["claim_start"], f["claim_end"] - 1)))))
    return once(step, "_more", _late_finds(len(rules))).withColumn("finds", F.concat("finds", "_more")).drop("_more", "_norm", "_all", "_late", "_cells", "_taken")


_FIELDS = [c.split(":")[0] for c in CANDIDATE.removeprefix("struct<").removesuffix(">").split(",")]
_FOUND = f"{CANDIDATE.removesuffix('>')},claimed:array<int>>"


def _late_finds(rule: int) -> Column:
    """Regions that nothing claimed, whose cell grows below them and holds a building's word."""
    text = lambda ids: F.array_join(F.transform(ids, lambda i: F.substring(F.col("_norm"), i + 1, F.lit(1))), "")
    seeds = F.transform("_late", lambda s, i: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["match"].alias("match"), F.get("_cells", i + F.size("_all")).alias("claimed")))
    free = F.filter(seeds, lambda s: (F.size(s["claimed"]) > s["end"] - s["start"]) & ~F.arrays_overlap(F.col("_taken"), F.concat(s["claimed"], F.sequence(s["start"], s["end"] - 1))) & text(s["claimed"]).rlike(R.LATE_BUILDING))
    finds = F.transform(
        free,
        lambda s: F.struct(
            F.lit(rule).alias("rule"), F.lit("Address").alias("category"), F.lit("AddressRegionBuilding").alias("pattern_type"), F.lit("NotValidated").alias("status"), F.lit(0.4).alias("confidence"),
            s["start"].alias("start"), s["end"].alias("end"), s["start"].alias("claim_start"), s["end"].alias("claim_end"), s["match"].alias("match"), s["claimed"].alias("claimed"),
        ),
    )
    overlap = lambda k, c: F.arrays_overlap(k["claimed"], c["claimed"])
    return greedy(finds, _FOUND, lambda c: F.array_min(c["claimed"]), lambda c: F.array_max(c["claimed"]) + 1, overlap)


def detect_layout(pages: DataFrame, rules: tuple[R.Rule, ...] = R.RULES, dongs: DataFrame | None = None, excluded: Iterable[str] = ()) -> DataFrame:
    """Review items of glyph pages, with content in reading order and the box around it."""
    flat = page_cells(pages, rules, dongs).select(*PAGE, "glyphs", F.explode("finds").alias("f"))
    order = Window.partitionBy("doc_id").orderBy("page_index", "f.rule", "f.start")
    rows = flat.withColumn("_n", F.row_number().over(order) - 1)
    rows = rows.where(~F.col("f.category").isin(list(excluded))) if excluded else rows
    own = F.transform("f.claimed", lambda i: F.get("glyphs", i))
    boxes = F.transform(own, lambda g: F.struct(g["x"].alias("x"), g["y"].alias("y"), g["w"].alias("width"), g["h"].alias("height")))
    return rows.select(
        "doc_id", F.concat(F.lit("r-"), F.col("_n")).alias("id"), F.lit("detected").alias("origin"), F.col("page_index").alias("page"), geometry.union_box(boxes).alias("bbox"), F.col("f.category").alias("category"),
        F.array_join(F.transform(own, lambda g: g["ch"]), "").alias("content"), F.col("f.pattern_type").alias("pattern_type"), F.col("f.confidence").alias("confidence"), F.col("f.status").alias("validation"),
    )


def exclude_glyph_margins(pages: DataFrame, zones: DataFrame) -> DataFrame:
    """Pages without the glyphs whose centre lies in a margin (``zones``: ``doc_id, page_index, n, margins``, the first of a page holds). What stood on both sides of them becomes adjacent."""
    first = zones.groupBy(*PAGE).agg(F.min_by("margins", "n").alias("_m"))
    box = lambda g: F.struct(g["x"].alias("x"), g["y"].alias("y"), g["w"].alias("width"), g["h"].alias("height"))
    return pages.join(first, PAGE, "left").withColumn("glyphs", F.filter("glyphs", lambda g: ~geometry.in_margin(box(g), F.col("_m")))).drop("_m")
