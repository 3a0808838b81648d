"""Cells, claims, names, placing and runs against brute force and fixed cases."""

import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkveil.operators import changelog, dictionary, layout, redact, review, runs
from inkveil.operators.detect import detect, page_finds
from inkveil.operators.spans import CANDIDATE, resolve, resolve_table
from inkveil.plans.rules import REGION, RULES
from inkveil.streaming import detection


def brute_cell(glyphs, a, b, more):
    """The cell by its definition: edges as the farthest prefix of a sweep that has no stop, lines one by one."""
    ids = range(len(glyphs))
    ch, x, y, w, h = zip(*glyphs)
    r, seed, mid = [p + q for p, q in zip(x, w)], range(a, b), lambda v: max(sorted(v)[len(v) // 2], 1e-4)
    if b - a < 2:
        return list(seed)
    cw, lh, yc = mid([w[i] for i in seed]), mid([h[i] for i in seed]), [y[i] + h[i] / 2 for i in ids]
    at, left, right = sorted(yc[i] for i in seed)[len(seed) // 2], min(x[i] for i in seed), max(r[i] for i in seed)
    line = [i for i in ids if abs(yc[i] - at) < 0.6 * lh]
    bars, counted = [i for i in line if ch[i] in "|│"], [i for i in line if re.match("[가-힣A-Za-z0-9-]", ch[i])]
    wall_r = min([r[i] for i in bars if x[i] >= right - 0.1 * cw], default=1e9)
    wall_l = max([x[i] for i in bars if r[i] <= left + 0.1 * cw], default=-1e9)
    east = sorted((i for i in counted if r[i] > right + 0.1 * cw), key=lambda i: x[i])
    reach = lambda k: max([right, *(r[i] for i in east[:k])])
    n = max(k for k in range(len(east) + 1) if all(x[east[j]] < wall_r and x[east[j]] - reach(j) <= 2 * cw for j in range(k)))
    cell_r = reach(n)
    west = sorted((i for i in counted if x[i] < left - 0.1 * cw), key=lambda i: -r[i])
    back = lambda k: min([left, *(x[i] for i in west[:k])])
    n = max(k for k in range(len(west) + 1) if all(x[west[j]] > wall_l and back(j) - r[west[j]] <= 2 * cw for j in range(k)))
    cell_l = back(n) if n < len(west) else left
    for m in re.finditer("[0-9-]+", "".join(ch[i] for i in west[:n])):
        t = m[0][::-1]
        if re.fullmatch(r"(?=.*-)-*[1-7](-*\d){5}-*|(0[1-9]|[1-5]\d|6[0-3])\d{3}", t):
            cell_l = back(m.end())
            break
        if len(re.sub("-", "", t)) > 2:
            cell_l = back(m.start())
            break
    column = {i for i in ids if ch[i] not in "|│" and cell_l - 0.25 * cw <= x[i] + w[i] / 2 <= cell_r + 2 * cw}
    rows = []
    for i in sorted(ids, key=lambda i: yc[i]):
        if rows and abs(yc[i] - yc[rows[-1][0]]) < 0.6 * lh:
            rows[-1].append(i)
        else:
            rows.append([i])
    k = next(k for k, r in enumerate(rows) if abs(yc[r[0]] - at) < 0.6 * lh)
    taken = set(seed) | set(rows[k]) & column
    for upper, row in zip(rows[k:], rows[k + 1 : k + 1 + more]):
        own = sorted(set(row) & column, key=lambda i: (x[i], row.index(i)))
        if yc[row[0]] - yc[upper[0]] > 3.5 * lh or any(r[i] < cell_l - 0.8 * cw for i in row) or not own or re.match(r"\s*" + REGION, "".join(ch[i] for i in own)):
            break
        taken |= set(own)
    return sorted(sorted(taken), key=lambda i: (np.round(yc[i] / (0.6 * lh)), x[i]))


def test_cells_equal_brute_force_on_random_pages():
    rng = random.Random(1)
    for _ in range(3000):
        glyphs, top = [], 0.1
        for _ in range(rng.randrange(1, 5)):
            x = rng.random() * 0.2
            for _ in range(rng.randrange(1, 22)):
                glyphs.append((rng.choice("강남구시동가 |-0123456789ab~^;"), x, top + rng.choice([0, 0, 0.002, 0.006]), 0.02 * rng.choice([1, 1, 0.5]), 0.02))
                x += rng.choice([0.02, 0.02, 0.02, 0.03, 0.05, 0.09, -0.01])
            top += rng.choice([0.012, 0.02, 0.03, 0.05, 0.08])
        a = rng.randrange(len(glyphs))
        b, more = min(len(glyphs), a + rng.randrange(1, 9)), rng.choice([0, 2])
        ch, *boxes = zip(*glyphs)
        assert layout._Page("".join(ch), *boxes).cell(a, b, more) == brute_cell(glyphs, a, b, more)


def drawn_candidates(rng, pages, most):
    rows, want = [], {}
    for p in range(pages):
        drawn = []
        for _ in range(rng.randrange(most)):
            a = rng.randrange(60)
            b = a + rng.randrange(1, 6)
            drawn.append((rng.randrange(5), a, b, max(0, a - rng.choice([0, 0, 3])), b + rng.choice([0, 0, 4])))
        kept = []
        for c in sorted(drawn):
            if not any(k[3] < c[2] and c[1] < k[4] for k in kept):
                kept.append(c)
        rows += [(p, n, *c) for n, c in enumerate(sorted(drawn))]
        want[p] = kept
    return rows, want


def test_claims_by_islands_equal_the_plain_fold(spark):
    rows, want = drawn_candidates(random.Random(0), 200, 30)
    df = spark.createDataFrame(rows, "doc_id long, n int, rule int, start int, end int, claim_start int, claim_end int")
    got = {p: [] for p in want}
    for r in resolve_table(df, ["doc_id"], ["rule", "start", "n"]).orderBy("doc_id", "n").collect():
        got[r.doc_id].append(r[2:])
    assert got == want
    named = F.struct("rule", F.lit("c"), F.lit("p"), F.lit("s"), F.lit(0.5), "start", "end", "claim_start", "claim_end", F.lit("m")).cast(CANDIDATE)
    lists = df.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", named.alias("c")))), lambda x: x["c"]).alias("f"))
    for r in lists.select("doc_id", resolve(F.col("f")).alias("kept")).collect():
        assert [(k.rule, k.start, k.end, k.claim_start, k.claim_end) for k in r.kept] == want[r.doc_id]
    assert resolve_table(df.limit(0), ["doc_id"], ["n"]).count() == 0


def test_a_page_of_100_000_candidates(spark):
    one = lambda i: F.struct((i % 7).cast("int"), F.lit("c"), F.lit("p"), F.lit("s"), F.lit(0.5), i * 3, i * 3 + 2 + i % 3, i * 3, i * 3 + 2 + i % 3, F.lit("m")).cast(CANDIDATE)
    page = spark.range(1).select(F.transform(F.sequence(F.lit(0), F.lit(99_999)), one).alias("f"))
    began = time.time()
    assert page.select(F.size(resolve(F.col("f"))).alias("n")).first().n == 66_667
    assert time.time() - began < 60


@pytest.mark.parametrize("text", ["@" + "a" * 1_000_000 + " b.c@d.ef", "a" * 1_000_000 + "@", "a.b@" * 200_000, "7" * 1_000_000, " " * 1_000_000 + "02-123-4567", "1 " * 500_000, "주소 " + "길" * 200_000])
def test_long_runs_end(spark, text):
    began = time.time()
    detect(spark.createDataFrame([(1, 0, text)], "doc_id long, page_index int, text string"), tuple(r for r in RULES if r.around or r.required)).count()
    assert time.time() - began < 120


def test_mail_addresses_are_those_of_the_plain_pattern(spark):
    rng, plain = random.Random(4), re.compile(r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}")
    texts = ["".join(rng.choices("ab.@-_% 가1", weights=[9, 9, 5, 4, 1, 2, 1, 1, 1, 2], k=60)) for _ in range(400)] + ["a@b.cde_f@g.hi", "a@b.cd@e.fg", "x" * 50 + "@y.zz"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("page_index", F.lit(0))
    got = {r.doc_id: r.m for r in page_finds(df, tuple(r for r in RULES if r.category == "Email")).select("doc_id", F.col("finds.match").alias("m")).collect()}
    assert got == {i: plain.findall(t) for i, t in enumerate(texts)} and sum(map(len, got.values())) > 100


def test_names_one_edit_apart_equal_brute_force(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("가나다", k=rng.randrange(0, 6)))
    a, b = {word() for _ in range(120)}, {word() for _ in range(120)}

    def near(s, t):
        cuts = lambda s: {s[:i] + s[i + 1 :] for i in range(len(s))}
        return s == t or s in cuts(t) or t in cuts(s) or len(s) == len(t) and sum(p != q for p, q in zip(s, t)) == 1

    frame = lambda words, c: spark.createDataFrame([(w,) for w in [*words, None]], f"{c} string")
    got = {tuple(r) for r in dictionary.near_names(frame(a, "x"), frame(b, "y"), "x", "y").collect()}
    assert got == {(s, t) for s in a for t in b if near(s, t)}


GLYPHS = "doc_id long, page_index int, glyphs array<struct<ch:string,x:double,y:double,w:double,h:double>>"
ITEMS = "doc_id long, id string, page int, content string, bbox struct<x:double,y:double,width:double,height:double>"


def test_boxes_of_replaced_items(spark):
    ring = [(c, 0.1 * i, 0.2, 0.1, 0.1) for i, c in enumerate("abcab")]
    joined = [("ab", 0.0, 0.1, 0.2, 0.1), (None, 0.2, 0.1, 0.1, 0.1), ("", 0.9, 0.9, 0.1, 0.1), ("c", 0.3, 0.3, 0.1, 0.1)]
    pages = spark.createDataFrame([(1, 0, ring), (1, 0, ring), (2, 0, joined), (3, 0, []), (4, 0, None)], GLYPHS)
    old = (0.5, 0.5, 0.1, 0.1)
    wants = [(1, "ab", 0, (0.0, 0.2, 0.2, 0.1)), (1, "cab", 2, (0.2, 0.2, 0.3, 0.1)), (1, "zz", None, old), (1, "", None, old), (1, None, None, old), (2, "bc", 1, (0.0, 0.1, 0.4, 0.3)), (2, "c", 2, (0.3, 0.3, 0.1, 0.1)), (3, "a", None, old), (4, "a", None, old), (9, "a", None, old)]
    items = spark.createDataFrame([(d, str(i), 0, c, old) for i, (d, c, _, _) in enumerate(wants)], ITEMS)
    rows = {int(r.id): r for r in review.reanchor_boxes(items, pages).collect()}
    for i, (_, _, at, box) in enumerate(wants):
        assert rows[i].found_at == at and rows[i].position_uncertain == (at is None)
        assert tuple(rows[i].bbox) == pytest.approx(box)


def test_korean_order_of_labels_contents_and_pages(spark):
    rows = [(1, "1", 3, "b"), (1, "2", 1, "나"), (1, "3", 2, "A"), (1, "4", 1, "가"), (1, "5", 2, "a"), (1, "6", 0, "B")]
    items = spark.createDataFrame([(d, i, p, c, (0.1, 0.1, 0.1, 0.1)) for d, i, p, c in rows], ITEMS).withColumn("category", F.when(F.col("id") == "1", "Zebra").when(F.col("id") == "2", "Email").otherwise("Address"))
    ids = lambda column, down=False: "".join(r.id for r in items.orderBy(*review.list_order(column, down)).collect())
    assert ids("content") == "425316" and ids("content", True) == "613524"
    assert ids("page") == "624351" and ids("page", True) == "153426"
    assert ids("category") == "264351" and ids("category", True) == "153462"


def test_bounds_stamps_imports_and_deletions(spark):
    box = lambda *v: v
    items = spark.createDataFrame([(1, "a", 0, "x", box(0.2, 0.2, 0.1, 0.1)), (1, "b", 0, "y", box(0.5, 0.2, 0.1, 0.1)), (2, "c", 0, "z", box(0.2, 0.2, 0.1, 0.1))], ITEMS)
    zones = spark.createDataFrame([(1, 0, (0.1, 0.1, 0.15, 0.3))], "doc_id long, page int, margins struct<top:double,bottom:double,left:double,right:double>")
    at = lambda df: {r.id: (round(r.bbox.x, 6), round(r.bbox.y, 6)) for r in df.collect()}
    assert at(review.shift_group(items, 1.0, -1.0, zones=zones)) == {"a": (0.3, 0.1), "b": (0.6, 0.1), "c": (0.9, 0.0)}
    cut = {r.id: tuple(round(v, 6) for v in r.bbox) for r in review.scale_group(items, 0.0, 0.0, 1.0, 1.0, zones=zones).collect()}
    assert cut["a"] == (0.15, 0.1, 0.1, 0.8) and cut["c"] == (0.0, 0.0, 1.0, 1.0)
    anchors = spark.createDataFrame([(7, 0, 0.95, 0.0)], "doc_id long, page int, x double, y double")
    stamped = review.stamp(items.where("doc_id = 1").select(F.col("id").alias("n"), "bbox"), anchors).collect()
    assert {(r.n, round(r.bbox.x, 6)) for r in stamped} == {("a", 0.6), ("b", 0.9)}
    assert review.stamp(items.limit(0).select(F.col("id").alias("n"), "bbox"), anchors).count() == 0
    many = spark.range(review.TEMPLATE_BOXES + 1).select(F.col("id").alias("n"), F.expr("named_struct('x', 0D, 'y', 0D, 'width', 1D, 'height', 1D)").alias("bbox"))
    with pytest.raises(ValueError):
        review.stamp(many, anchors)
    log = spark.createDataFrame([(1, 1), (2, 1)], "doc_id long, seq int")
    for new in (items.where("doc_id = 2").withColumn("id", F.lit("n")), items.limit(0)):
        once = review.replace_imported(items, log, new)
        again = review.replace_imported(*once, new)
        assert [sorted(map(tuple, x.collect())) for x in once] == [sorted(map(tuple, x.collect())) for x in again]
    assert {r.id for r in review.replace_imported(items, log, items.where("doc_id = 2").withColumn("id", F.lit("n")))[0].collect()} == {"a", "b", "n"}
    gone = changelog.delete_listed(items.withColumn("state", F.col("content")), spark.createDataFrame([(1, "b"), (1, "q")], "doc_id long, id string")).collect()
    assert [(r.doc_id, r.n, r.item_id, r.before, r.after, r.group_id) for r in gone] == [(1, 1, "b", "y", None, None)]


def test_suppressed_pages_keep_no_glyph(spark):
    b = lambda *v: v
    kind = "struct<x:double,y:double,width:double,height:double>"
    glyphs = spark.createDataFrame([(1, p, n, b(0.1 * n, 0.1, 0.05, 0.05)) for p in range(3) for n in range(5)], f"doc_id long, page int, n int, box {kind}")
    boxes = spark.createDataFrame([(1, 0, b(0.0, 0.0, 0.12, 0.3)), (1, 0, b(0.0, 0.0, 0.12, 0.3)), (1, 1, b(0.0, 0.0, 0.12, 0.3))], f"doc_id long, page int, bbox {kind}")
    objects = spark.createDataFrame([(1, 0, "image", b(0.0, 0.0, 1.0, 1.0)), (1, 1, "text", b(0.0, 0.0, 1.0, 1.0))], f"doc_id long, page int, kind string, bbox {kind}")
    carried = redact.carry_out(glyphs, boxes, objects)
    assert carried.count() == 15
    assert {(r.page, r.route, r.n_removed, r.n_left) for r in redact.removed_counts(carried).collect()} == {(0, "page", 5, 0), (1, "spans", 2, 3), (2, None, 0, 5)}


def test_streams_tell_their_progress(spark, tmp_path):
    pages = spark.createDataFrame([(i, 0, f"mail a{i}@b.co") for i in range(6)], "doc_id long, page_index int, text string")
    for k in range(3):
        pages.where(F.col("doc_id") % 3 == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    listener = runs.Progress("finds")
    spark.streams.addListener(listener)
    try:
        stream = spark.readStream.schema(pages.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        found = detection.stream_finds(stream, tuple(r for r in RULES if r.category == "Email")).observe("finds", F.count(F.lit(1)).alias("n"))
        found.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start().awaitTermination()
        for _ in range(50):
            if len(listener.rows) >= 3:
                break
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(listener)
    table = listener.table(spark)
    assert table.where("rows_read > 0").count() == 3
    assert table.agg(F.sum(F.get_json_object("counts", "$.n").cast("int"))).first()[0] == 6 == spark.read.parquet(str(tmp_path / "out")).count()


def _arriving(spark, folder, batches, schema):
    """A stream that gets one batch of rows at a time, in order."""
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
        time.sleep(0.05)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def test_stream_log_leaves_out_repeated_and_late_entries(spark, tmp_path):
    at = lambda minute: f"2024-01-01 10:{minute:02}:00"
    batches = [
        [(at(1), 1, "a", 1, "edit"), (at(1), 1, "a", 1, "edit"), (at(3), 1, "b", 2, "add")],
        [(at(3), 1, "b", 2, "add"), (at(2), 1, "c", 3, "edit"), (at(30), 1, "d", 4, "edit")],
        [(at(31), 1, "f", 6, "add")],
        [(at(4), 1, "e", 5, "edit"), (at(59), 1, "g", 7, "edit")],  # the first comes 27 minutes late
    ]
    stream = _arriving(spark, str(tmp_path / "in"), batches, "timestamp string, doc_id long, item_id string, seq int, action string")
    counts = detection.ordered_log(stream.withColumn("timestamp", F.col("timestamp").cast("timestamp")))
    counts.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start().awaitTermination()
    got = {(r.window.start.minute, r.action): r.n for r in spark.read.schema(counts.schema).parquet(str(tmp_path / "out")).collect()}
    assert got == {(0, "edit"): 2, (0, "add"): 1, (30, "edit"): 1, (30, "add"): 1}


def test_latest_states_are_compacted_and_survive_a_restart(spark, tmp_path):
    path, schema = str(tmp_path / "states"), "doc_id long, at int, state string"
    batches = [[(1, 1, "a"), (2, 1, "x")], [(1, 2, "b")], [(1, 1, "late"), (3, 1, "z")], [(2, 5, "y")], [(3, 1, "again")]]
    run = lambda rows: detection.save_latest(_arriving(spark, str(tmp_path / "in"), rows, schema), path, str(tmp_path / "log"), every=None, compact=2).awaitTermination()
    run(batches[:3])
    now = lambda: {r.doc_id: r.state for r in detection.latest_states(spark, path).collect()}
    assert now() == {1: "b", 2: "x", 3: "z"}
    run(batches[3:])
    assert now() == {1: "b", 2: "y", 3: "again"}
    assert detection._folders(spark, path, "base") == [3] and detection._folders(spark, path, "batch") == [4]
    with pytest.raises(FileNotFoundError):
        detection.latest_states(spark, str(tmp_path / "none"))
