import json

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from inkveil.functions.text import box_string, category_code, category_label, page_list, parse_box
from inkveil.operators import changelog, profile, review
from inkveil.sources import tables
from inkveil.streaming.detection import latest_states


def now():
    return F.lit("2024-01-02 03:04:05").cast("timestamp")


def test_boxes_labels_and_page_lists(spark):
    rows = [("0.1,0.2,0.3,0.4", "이메일", "1, 3x 5"), ("1,,2,3", "unknown", ""), ("1,2", "", "0 -4"), ("a,b,c,d", None, "7"), (None, None, None)]
    df = spark.createDataFrame(rows, "box string, label string, pages string")
    b = F.col("b")
    got = df.withColumn("b", parse_box(F.col("box"))).select(box_string(b["x"], b["y"], b["width"], b["height"]).alias("again"), category_code(F.col("label")).alias("code"), page_list(F.col("pages")).alias("p"), "b").collect()
    assert got[0].again == "0.1,0.2,0.3,0.4" and got[1].again == "1,0,2,3" and [r.b for r in got[2:]] == [None] * 3
    assert [r.code for r in got] == ["Email", "unknown", "", None, None]
    assert [r.p for r in got[:4]] == [[1, 3, 5], [], [], [7]]
    assert spark.range(1).select(category_label(F.lit("Card"))).first()[0] == "신용카드"


def test_exchange_round_trip(spark, tmp_path):
    items = spark.createDataFrame([(1, 0, Row(x=0.1, y=0.25, width=0.5, height=0.125), "Email", 'a "quoted", text\nwith lines')], "doc_id long, page int, bbox struct<x:double,y:double,width:double,height:double>, category string, content string").withColumn("updated_at", now())
    names = spark.createDataFrame([(1, "f.pdf")], "doc_id long, filename string")
    tables.write_exchange(tables.exchange_rows(items, names), f"file://{tmp_path}/x")
    back = tables.imported_items(tables.read_exchange(spark, f"file://{tmp_path}/x"), now()).first()
    assert (back.filename, back.page, back.category, back.content, back.origin) == ("f.pdf", 0, "Email", 'a "quoted", text\nwith lines', "imported")
    assert tuple(back.bbox) == (0.1, 0.25, 0.5, 0.125)


def test_reviews(spark, tmp_path):
    (tmp_path / "old.json").write_text(json.dumps({"doc_id": 1, "source": {"filename": "f"}, "items": [{"id": "r-0", "review_status": "x"}]}))
    got = tables.read_reviews(spark, f"file://{tmp_path}/old.json").first()
    assert got.exclusion_zones == [] and got["items"][0].id == "r-0"
    (tmp_path / "bad.json").write_text("{broken")
    with pytest.raises(Exception):
        tables.read_reviews(spark, f"file://{tmp_path}/bad.json").collect()
    assert tables.read_excluded(spark, f"file://{tmp_path}/none") == []
    tables.write_excluded(spark, f"file://{tmp_path}/some", ["Email"])
    assert tables.read_excluded(spark, f"file://{tmp_path}/some") == ["Email"]


def test_list_filter_none_and_empty(spark):
    items = spark.createDataFrame([("a", "Email", 0), ("b", "Card", 1)], "id string, category string, page int")
    ids = lambda *a: [r.id for r in review.list_filter(items, *a).collect()]
    assert (ids(), ids([]), ids(["Card"]), ids(None, [1]), ids(None, [])) == (["a", "b"], [], ["b"], ["a"], [])


def test_change_log(spark):
    log = spark.createDataFrame([(1, 1, "edit", "i", None, "a", "g"), (1, 2, "edit", "i", "a", "b", "g"), (1, 3, "delete", "j", "z", None, None)], "doc_id long, seq int, action string, item_id string, before string, after string, group_id string")
    base = spark.createDataFrame([(1, "j", "z"), (1, "k", "y")], "doc_id long, item_id string, state string")
    at = lambda n: spark.createDataFrame([(1, n)], "doc_id long, cursor int")
    state = lambda n: {r.item_id: r.state for r in changelog.state_as_of(base, log, at(n)).collect()}
    assert (state(0), state(2), state(3)) == ({"j": "z", "k": "y"}, {"i": "b", "j": "z", "k": "y"}, {"i": "b", "k": "y"})
    step = changelog.undo_redo(log, at(2)).first()
    assert (step.undo_to, step.redo_to) == (0, 3)
    undone = changelog.undone_state(log, at(2), spark.createDataFrame([(1, 0)], "doc_id long, undo_to int")).collect()
    assert [(r.item_id, r.state) for r in undone] == [("i", None)]
    new = spark.createDataFrame([(1, 1, "add", "n", None, "q", None)], "doc_id long, n int, action string, item_id string, before string, after string, group_id string")
    assert [(r.seq, r.item_id) for r in changelog.record(log, at(1), new).orderBy("seq").collect()] == [(1, "i"), (2, "n")]


def test_reviews_round_trip(spark, tmp_path):
    box = Row(x=0.1, y=0.2, width=0.3, height=0.4)
    item = "id string, origin string, page int, bbox struct<x:double,y:double,width:double,height:double>, category string, content string"
    sources = spark.createDataFrame([(1, "f.pdf", 2), (2, "g.pdf", 1)], "doc_id long, filename string, page_count int")
    pages = spark.createDataFrame([(1, 1, 10.0), (1, 2, 20.0)], "doc_id long, page_number int, page_width double")
    items = spark.createDataFrame([(1, "r-0", "manual", 0, box, "Email", "a@b.kr")], "doc_id long, " + item)
    history = spark.createDataFrame([(1, n, f"t{n}", "edit", "r-0") for n in (2, 1, 3)], "doc_id long, seq int, timestamp string, action string, item_id string")
    zones = spark.createDataFrame([], "doc_id long, page_index int, margins struct<top:double,bottom:double,left:double,right:double>")
    cursors = spark.createDataFrame([(1, 2)], "doc_id long, cursor int")
    tables.write_reviews(tables.assemble_reviews(sources, pages, items, history, zones, cursors), f"file://{tmp_path}/r")
    first, second = tables.read_reviews(spark, f"file://{tmp_path}/r").orderBy("doc_id").collect()
    assert first.history.cursor == 2 and [e.seq for e in first.history.entries] == [1, 2, 3]
    assert first["items"][0].bbox == box and [p.page_width for p in first.pages] == [10.0, 20.0]
    assert second["items"] == [] and second.history.cursor == 0 and second.exclusion_zones == []
    assert tables.read_reviews(spark, f"file://{tmp_path}/none.json").count() == 0
    (tmp_path / "pretty.json").write_text(json.dumps({"doc_id": 7, "source": {"filename": "f"}, "history": {"entries": [], "cursor": 0}}, indent=2))
    assert tables.read_reviews(spark, f"file://{tmp_path}/pretty.json", pretty=True).first().doc_id == 7


def test_outline_of_any_depth(spark):
    chain = [(1, n, n - 1 if n else None, 0) for n in range(150)] + [(2, 5, None, 1), (2, 6, 5, 2), (2, 7, 5, 1), (2, 8, None, 0), (2, 9, 99, 0)]
    got = {(r.doc_id, r.node_id): (r.depth, r.position) for r in profile.preorder(spark.createDataFrame(chain, "doc_id long, node_id long, parent_id long, ord int")).collect()}
    assert all(got[1, n] == (n, n) for n in range(150))
    assert {k: v for k, v in got.items() if k[0] == 2} == {(2, 8): (0, 0), (2, 5): (0, 1), (2, 7): (1, 2), (2, 6): (1, 3)}
    with pytest.raises(ValueError, match="circle"):
        profile.preorder(spark.createDataFrame([(1, 1, 2, 0), (1, 2, 1, 0)], "doc_id long, node_id long, parent_id long, ord int"))


def test_latest_state_goes_by_time(spark, tmp_path):
    for batch, rows in enumerate([[(1, 10, "late"), (2, 1, "a")], [(1, 5, "early"), (2, 1, "b")]]):
        spark.createDataFrame(rows, "doc_id long, at long, state string").write.parquet(f"file://{tmp_path}/s/batch={batch}")
    assert {r.doc_id: r.state for r in latest_states(spark, f"file://{tmp_path}/s").collect()} == {1: "late", 2: "b"}


def test_a_group_larger_than_the_page_ends_at_its_edge(spark):
    rows = [(1, 0, 1, Row(x=0.0, y=0.5, width=1.4, height=0.1)), (1, 0, 2, Row(x=0.25, y=0.75, width=0.5, height=0.25))]
    items = spark.createDataFrame(rows, "doc_id long, page int, id long, bbox struct<x:double,y:double,width:double,height:double>")
    assert {r.id: (r.bbox.x, r.bbox.y) for r in review.shift_group(items, 0.2, 0.5).collect()} == {1: (0.0, 0.5), 2: (0.25, 0.75)}
