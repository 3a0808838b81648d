"""What keeps queries within bounds as tables grow, and the whole job of those that a change of SQL had made smaller."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from inkveil.operators import redact, review
from inkveil.plans import catalogue, placed  # noqa: F401

KIND = "struct<x:double,y:double,width:double,height:double>"


def sent_whole(df):
    """Lines of what the plan broadcasts."""
    out, depth = [], None
    for line in df._jdf.queryExecution().executedPlan().toString().splitlines():
        at = len(line) - len(line.lstrip(" :+-"))
        depth = None if depth is not None and at <= depth else depth
        if depth is not None:
            out.append(line)
        elif "BroadcastExchange" in line:
            depth = at
    return out


@pytest.fixture(scope="module")
def page(spark, tmp_path_factory):
    rng = random.Random(3)
    side = lambda most: (rng.randrange(40) / 64, rng.randrange(40) / 64, rng.randrange(1, most) / 64, rng.randrange(1, most) / 64)
    glyphs, boxes, objects = ([(d, p, *extra(n), side(size)) for d in range(6) for p in range(2) for n in range(rng.randrange(most))] for most, size, extra in ((30, 9, lambda n: ()), (4, 12, lambda n: ()), (9, 30, lambda n: (rng.choice(["form", "image", "text"]),))))
    frames = [spark.createDataFrame(r, s) for r, s in ((glyphs, f"doc_id long, page int, box {KIND}"), (boxes + boxes[:2], f"doc_id long, page int, bbox {KIND}"), (objects, f"doc_id long, page int, kind string, bbox {KIND}"))]
    folder = tmp_path_factory.mktemp("page")  # of files Spark knows the size, and sends small ones whole
    for k, frame in enumerate(frames):
        frame.coalesce(1).write.parquet(f"{folder}/{k}")
    frames = [spark.read.parquet(f"{folder}/{k}") for k in range(3)]
    return frames, glyphs, boxes + boxes[:2], objects


def over(a, b):
    return a[0] < b[0] + b[2] and b[0] < a[0] + a[2] and a[1] < b[1] + b[3] and b[1] < a[1] + a[3]


def test_routes_equal_brute_force(page):
    (_, b, o), _, boxes, objects = page
    want = {}
    for d, p in {r[:2] for r in boxes}:
        on = [r[2] for r in boxes if r[:2] == (d, p)]
        largest = max((r[3][2] * r[3][3] for r in objects if r[:2] == (d, p) and r[2] != "text" and any(over(r[3], x) for x in on)), default=0)
        want[d, p] = "page" if largest > 3 * sum(x[2] * x[3] for x in on) else "spans"
    assert {(r.doc_id, r.page): r.route for r in redact.route_pages(b, o).collect()} == want and set(want.values()) == {"page", "spans"}


def test_glyphs_left_equal_brute_force(page):
    (g, b, _), glyphs, boxes, _ = page
    want = sorted(r for r in glyphs if not any(x[:2] == r[:2] and over(r[2], x[2]) for x in boxes))
    assert sorted((r.doc_id, r.page, tuple(r.box)) for r in redact.redact_glyphs(g, b).collect()) == want


@pytest.mark.parametrize(("most", "n"), [(0.9, 40), (0.2, 400), (0.02, 900)])
def test_redaction_on_grids_of_any_fineness_equals_brute_force(spark, most, n):
    rng, nan = random.Random(n), float("nan")
    at = lambda low, high, size: (rng.uniform(low, high), rng.uniform(low, high), rng.uniform(-size / 9, size), rng.uniform(-size / 9, size))
    odd = [(nan, 0.1, 0.5, 0.5), (0.1, 0.1, nan, 0.5), (None, 0.1, 0.5, 0.5), (0.5, 0.5, 0.0, 0.0), (0.25, 0.25, 0.125, 0.125), (1e300, 0.0, 1.0, 1.0), (-1e300, 0.5, 1e300, 0.01)]
    boxes = [(1, p, b) for p in range(2) for b in [at(-0.2, 1.1, most) for _ in range(n)] + odd + odd[4:5]] + [(None, 0, (0.0, 0.0, 1.0, 1.0))]
    glyphs = [(d, p, b) for d, p in ((1, 0), (1, 1), (2, 0), (None, 0)) for b in [at(-0.2, 1.1, 0.03) for _ in range(n)] + [at(0, 1, 0.7 * p) for _ in range(9)] + odd + odd[4:5]]
    objects = [(1, 1, "form", (0.5, 0.5, 1e4, 1e4)), (1, 0, "image", (9.0, 9.0, 1e4, 1e4)), (1, 0, "text", (0.0, 0.0, 1e4, 1e4))]
    whole = lambda r: all(v is not None and v == v for v in r)
    hit = lambda g, b: g[:2] == b[:2] and None not in g[:2] and whole(g[2]) and whole(b[2]) and over(g[2], b[2])
    boxes = [b for b in boxes if whole(b[2]) or b[1] == 1]  # a side that is NaN leaves no area to compare objects with
    g, b, o = (spark.createDataFrame(r, s) for r, s in ((glyphs, f"doc_id long, page int, box {KIND}"), (boxes, f"doc_id long, page int, bbox {KIND}"), (objects, f"doc_id long, page int, kind string, bbox {KIND}")))
    key = lambda r: str((r[0], r[1], tuple(r[2])))
    want = sorted(key(x) for x in glyphs if not any(hit(x, y) for y in boxes))
    assert sorted(key(r) for r in redact.redact_glyphs(g, b).collect()) == want
    done = redact.carry_out(g, b, o).collect()
    assert {(r.doc_id, r.page, r.route) for r in done} == {(1, 0, "spans"), (1, 1, "spans"), (2, 0, None), (None, 0, None)}
    assert sorted(key(r) for r in done if not r.removed) == want
    plain = spark.createDataFrame([(p, 0, x[2]) for p in range(3) for x in boxes[:n]], b.schema)
    large = spark.createDataFrame([(0, 0, "form", (0.5, 0.5, 1e4, 1e4)), (1, 0, "image", (9.0, 9.0, 1e4, 1e4)), (2, 0, "text", (0.0, 0.0, 1e4, 1e4))], o.schema)
    assert {r.doc_id: r.route for r in redact.route_pages(plain, large).collect()} == {0: "page", 1: "spans", 2: "spans"}


def test_boxes_of_a_page_of_few_are_shuffled_as_they_are(spark):
    b = "named_struct('x', rand(5), 'y', rand(6), 'width', 0.125D, 'height', 0.15D)"
    boxes, glyphs = (spark.range(n).selectExpr("id % 100 AS doc_id", "CAST(0 AS INT) AS page", f"{b} AS {name}") for n, name in ((1800, "bbox"), (7000, "box")))
    objects = glyphs.selectExpr("doc_id", "page", "'form' AS kind", "box AS bbox")
    store, new = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway.new_array
    stages = lambda: [x for x in (lambda s: [s.apply(i) for i in range(s.size())])(store.stageList(None, False, False, new(spark._jvm.double, 0), spark._jvm.java.util.ArrayList()))]
    last = max((s.stageId() for s in stages()), default=-1)
    assert len(redact.removed_counts(redact.carry_out(glyphs, boxes, objects)).collect()) == 100
    assert sum(s.shuffleWriteRecords() for s in stages() if s.stageId() > last) < 3 * (1800 + 7000 + 7000)


@pytest.mark.parametrize("query", ["redact_glyphs", "redact_route", "redact_carried_out"])
def test_cells_of_boxes_are_never_sent_whole(page, query):
    g, b, o = page[0]
    made = {"redact_glyphs": lambda: redact.redact_glyphs(g, b), "redact_route": lambda: redact.route_pages(b, o), "redact_carried_out": lambda: redact.carry_out(g, b, o)}
    assert not [line for line in sent_whole(made[query]()) if "Generate" in line]


@pytest.mark.parametrize("query", ["redact_route", "redact_glyphs", "overlap_antijoin", "containment_semijoin", "merge_redetect", "glyphs_in_box", "template_stamp"])
def test_pages_grow_with_the_tables(query):
    sql = catalogue.ORACLE_SQL[query]
    assert "/ 128) AS BIGINT" not in sql and re.search(r"_orderkey % 500 AS doc_id", sql)


def test_text_of_boxes_that_lie_alike_share_an_id_or_lack_a_side(spark):
    b = lambda *v: v
    boxes = [(1, 0, 1, b(0.0, 0.0, 0.5, 0.5)), (1, 0, 2, b(0.0, 0.0, 0.5, 0.5)), (1, 0, 3, b(None, 0.0, 1.0, 1.0)), (1, 0, 4, b(0.0, 0.0, 0.2, 0.2)), (1, 0, 4, b(0.0, 0.0, 0.5, 0.5)), (2, 0, 5, b(0.0, 0.0, 1.0, 1.0)), (None, 0, 6, b(0.0, 0.0, 1.0, 1.0))]
    glyphs = [(1, 0, 2, "b", b(0.1, 0.1, 0.1, 0.1)), (1, 0, 1, "a", b(0.4, 0.4, 0.2, 0.2)), (1, 0, 3, None, b(0.1, 0.1, 0.1, 0.1)), (1, 0, 4, "z", b(0.6, 0.6, 0.1, 0.1)), (3, 0, 1, "c", b(0.1, 0.1, 0.1, 0.1)), (None, 0, 1, "d", b(0.1, 0.1, 0.1, 0.1))]
    got = review.text_in_boxes(spark.createDataFrame(boxes, f"doc_id long, page int, id long, bbox {KIND}"), spark.createDataFrame(glyphs, f"doc_id long, page int, n long, ch string, box {KIND}"))
    assert {(r.doc_id, r.id): r.text for r in got.collect()} == {(1, 1): "ab", (1, 2): "ab", (1, 3): "", (1, 4): "abb", (2, 5): "", (None, 6): ""}


def test_a_template_of_any_size_is_stamped_whole(spark):
    n = review.TEMPLATE_BOXES + 500
    template = spark.range(n).select(F.col("id").alias("n"), F.expr("named_struct('x', 0.1D + id / 10000, 'y', 0.2D, 'width', 0.05D, 'height', 0.1D)").alias("bbox"))
    anchors = spark.createDataFrame([(7, 0, 0.95, 0.0), (8, 0, 0.0, 0.5)], "doc_id long, page int, x double, y double")
    rows = {(r.doc_id, r.n): r.bbox for r in review.stamp(template, anchors, most=None).collect()}
    assert len(rows) == 2 * n and rows[8, 0].x == pytest.approx(0.0) and rows[7, n - 1].x + 0.05 == pytest.approx(1.0)
    few = template.limit(40)
    at = lambda df: sorted((r.doc_id, r.n, *(round(v, 9) for v in r.bbox)) for r in df.collect())
    assert at(review.stamp(few, anchors, most=None)) == at(review.stamp(few, anchors))
    assert review.stamp(template.limit(0), anchors, most=None).count() == 0


def test_places_are_rounded_as_spark_rounds(spark):
    rng = random.Random(4)
    halves = [(k + 0.5) / 1e4 for k in (*range(0, 20_000, 7), 2**30 + 1, 10**10 + 1)] + [k / 128 for k in range(300)]
    values = [v for h in halves for v in (math.nextafter(h, 0), h, math.nextafter(h, 9e9), math.nextafter(math.nextafter(h, 0), 0))]
    values += [rng.random() * 10 ** rng.randrange(-7, 9) for _ in range(3000)] + [-v for v in halves[:500]] + [0.0, -0.0, 0.49999999999999994, 1e-300, 1e7 - 0.00005, 1e9, 1e18, 1e300, math.inf, -math.inf, math.nan, None]
    df = spark.createDataFrame([(v, v) for v in values], "want double, got double")
    rows = review._rounded(df.withColumn("want", F.round("want", 4)), 4, "got").collect()
    assert [repr(r.got) for r in rows] == [repr(r.want) for r in rows]


def test_stamping_makes_no_decimal_number_for_each_row(spark, sf_dir):
    df = catalogue.QUERIES["template_stamp"](spark, sf_dir)
    above = df._jdf.queryExecution().optimizedPlan().toString().split("Join Cross")[0]
    assert "CASE WHEN" in above and above.count("round(") == above.count("ELSE round(")


@pytest.mark.parametrize("query", ["detect_ko_all", "detect_ko_places", "detect_layout_items", "address_cell", "region_building", "reanchor_boxes"])
def test_narrow_rows_are_many_tasks(spark, sf_dir, query):
    catalogue.QUERIES[query](spark, sf_dir)
    sizes = spark.table("customer").groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) > spark.sparkContext.defaultParallelism


def test_pages_of_glyphs_are_never_sent_whole(spark, sf_dir):
    assert not sent_whole(catalogue.QUERIES["reanchor_boxes"](spark, sf_dir))
