"""Registered queries on pages of glyphs, islands of claims, names one edit apart, imports and runs, with their SQL.

The SQL states what must come out in its own words: none of it is built from the catalogue of rules.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkveil.operators import changelog, dictionary, profile, redact, review, runs
from inkveil.operators.detect import detect, page_finds
from inkveil.operators.layout import detect_layout
from inkveil.operators.spans import resolve_table
from inkveil.plans import derived as D
from inkveil.plans.catalogue import _BOXES_OVER, _OBJECTS, ORACLE_SQL, QUERIES, _rules, query
from inkveil.plans.derived import boxed, flat
from inkveil.streaming import detection
from inkveil.streaming import runs as streams

# Claims on pages of some 250 candidates each; the number of pages grows with the table.
_CANDIDATES = """
  SELECT CAST(floor(CAST(l_orderkey AS DOUBLE) / 64) AS BIGINT) AS doc_id, CAST(l_linenumber AS INT) AS rule, l_orderkey * 10 + l_linenumber AS id,
    CAST(l_partkey % 900 AS INT) AS start, CAST(l_partkey % 900 + 1 + l_suppkey % 9 AS INT) AS "end",
    CAST(l_partkey % 900 - l_orderkey % 4 AS INT) AS claim_start, CAST(l_partkey % 900 + 1 + l_suppkey % 9 + l_linenumber % 3 AS INT) AS claim_end
  FROM lineitem
"""


@query(
    "lineitem",
    sql=f"""
  WITH RECURSIVE c AS (
    SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY rule, start, id) AS k FROM ({_CANDIDATES})
  ),
  f(doc_id, k, kept, ids) AS (
    SELECT DISTINCT doc_id, CAST(0 AS BIGINT), CAST([] AS STRUCT(a INT, b INT)[]), CAST([] AS BIGINT[]) FROM c
    UNION ALL
    SELECT f.doc_id, c.k,
      CASE WHEN len(list_filter(kept, lambda x: x.a < c."end" AND c.start < x.b)) > 0 THEN kept ELSE list_append(kept, {{'a': claim_start, 'b': claim_end}}) END,
      CASE WHEN len(list_filter(kept, lambda x: x.a < c."end" AND c.start < x.b)) > 0 THEN ids ELSE list_append(ids, c.id) END
    FROM f JOIN c ON c.doc_id = f.doc_id AND c.k = f.k + 1
  )
  SELECT doc_id, unnest(arg_max(ids, k)) AS id FROM f GROUP BY doc_id
""",
)
def resolve_claims(spark):
    """Lines that the SQL's order ties are taken by end and claim. Lines of a null order are on no page, as the SQL joins by doc_id."""
    candidates = spark.sql(_CANDIDATES.replace('"end"', "`end`")).where("doc_id IS NOT NULL")
    return resolve_table(candidates, ["doc_id"], ["rule", "start", "id"]).select("doc_id", "id")


# Places that rules find beside plain numbers, with the rows that must come out.
_N = "CAST(10 + c_custkey % 90 AS VARCHAR(3))"
_PLACES = [
    # text before, what is found (with a number of two digits for N), text after, category, pattern type, confidence
    ("전화: ", f"concat('(65)6253', {_N}, '33')", " 번", "PhoneNumber", "PhoneNumber", 0.6),
    ("회의는 ", "'강남구 역삼동'", " 에서", "Address", "AddressDict", 0.5),
    ("", "'영등포구 여의도를'", "", "Address", "AddressFuzzy", 0.45),
    ("", "'성남시 분당구 매화마을'", " 입구", "Address", "AddressBuilding", 0.4),
    ("주소 ", f"concat('테헤란로 ', {_N})", " 이다", "Address", "Address", 0.7),
    ("배송 ", f"concat('역삼동 ', {_N}, '-7')", " 앞", "Address", "Address", 0.7),
    ("", f"concat('광주광역시 서구 ', {_N}, '-2')", "", "Address", "AddressDamagedDong", 0.4),
    ("", f"concat('궁전 T 동 9', {_N}, '호')", " 앞", "Address", "AddressBuildingLine", 0.35),
    ("", f"concat('현대APT.1', {_N}, '-406')", "", "Address", "AddressBuildingLine", 0.35),
]
_CASE = lambda pick: f"CASE c_custkey % {len(_PLACES)} " + " ".join(f"WHEN {k} THEN {pick(p)}" for k, p in enumerate(_PLACES)) + " END"
_SENTENCES = f"SELECT c_custkey AS doc_id, CAST(0 AS INT) AS page_index, {_CASE(lambda p: f'concat({p[0]!r}, {p[1]}, {p[2]!r})')} AS text FROM customer"
_DONGS = "SELECT explode(array('서빙고동', '압구정동', '역삼동', '반포동', '성복동', '여의도동', '용암동')) AS dong"


@query("customer", sql=f"SELECT c_custkey AS doc_id, {_CASE(lambda p: repr(p[3]))} AS category, {_CASE(lambda p: repr(p[4]))} AS pattern_type, CAST({_CASE(lambda p: p[5])} AS DOUBLE) AS confidence, {_CASE(lambda p: p[1])} AS content FROM customer")
def detect_ko_places(spark):
    return detect(spark.sql(_SENTENCES), dongs=spark.sql(_DONGS)).select("doc_id", "category", "pattern_type", "confidence", "content")


# Names of 3 to 7 letters and endings with a letter put in, left out or replaced.
_LETTER = lambda e: f"substr('가나다라마바사아자차카타파하', CAST(1 + ({e}) % 14 AS INT), 1)"
_HIGH = lambda e, by: f"CAST(floor(CAST({e} AS DOUBLE) / {by}) AS BIGINT)"
_NAME = lambda k: f"concat({_LETTER(k)}, {_LETTER(_HIGH(k, 14))}, {_LETTER(_HIGH(k, 196))}, repeat({_LETTER(k + ' * 5')}, CAST({k} % 4 AS INT)), CASE WHEN {k} % 3 = 0 THEN '리' ELSE '동' END)"
_DISTRICTS = f"SELECT DISTINCT {_NAME('p_partkey')} AS dong FROM part"
_WRONG = f"""
  SELECT id, concat('강남구 ', CASE k % 5
      WHEN 0 THEN concat(substr(name, 1, length(name) - 1), '를')
      WHEN 1 THEN concat(substr(name, 1, 1), '밖', substr(name, 2, length(name)), '은')
      WHEN 2 THEN substr(name, 1, length(name) - 1)
      WHEN 3 THEN concat('안', substr(name, 2, length(name) - 2), '를')
      ELSE concat(name, '은') END) AS place
  FROM (SELECT c_custkey AS id, c_custkey % 7 AS k, {_NAME('c_custkey')} AS name FROM customer) q
"""


def _edit_sql(ending: str, name: str) -> str:
    """SQL for: one letter put in, left out or replaced at most, by comparing what is before and after each place."""
    n, m = f"length({ending})", f"length({name})"
    same = lambda skip_e, skip_n: f"len(list_filter(range(0, {n} + 1), lambda i: substr({ending}, 1, i) = substr({name}, 1, i) AND substr({ending}, i + 1 + {skip_e}, 99) = substr({name}, i + 1 + {skip_n}, 99))) > 0"
    return f"({ending} = {name} OR ({n} = {m} AND {same(1, 1)}) OR ({n} = {m} + 1 AND {same(1, 0)}) OR ({n} + 1 = {m} AND {same(0, 1)}))"


@query(
    "customer",
    "part",
    sql=f"WITH e AS (SELECT id, unnest([right(place, k) for k in range(3, 7)]) AS ending, place FROM ({_WRONG}) s WHERE NOT regexp_matches(place, '[동리]$')), "
    f"f AS (SELECT DISTINCT id, ending FROM e WHERE length(ending) < length(replace(place, ' ', '')) AND regexp_matches(replace(place, ' ', ''), concat('[구시군읍면도]', ending, '$')) AND NOT contains(ending, ' ')) "
    f"SELECT DISTINCT id FROM f JOIN ({_DISTRICTS}) n ON length(n.dong) BETWEEN length(ending) - 1 AND length(ending) + 1 WHERE {_edit_sql('ending', 'n.dong')}",
)
def dong_one_edit(spark):
    return dictionary.fuzzy(spark.sql(_WRONG), spark.sql(_DISTRICTS), "place", ["id"])


# Pages of glyphs, two hundredths of a page wide and high, line by line.


def _line(text: Column, x: float, y: float) -> Column:
    glyph = lambda c, i: F.struct(c.alias("ch"), (x + 0.02 * i).cast("double").alias("x"), F.lit(y).alias("y"), F.lit(0.02).alias("w"), F.lit(0.02).alias("h"))
    return F.transform(F.split(text, ""), glyph)


_ADDRESS = "concat('서울특별시 강남구 테헤란로 ', CAST(100 + c_custkey % 500 AS VARCHAR(3)))"
_NEXT = "concat('서초구 반포동 ', CAST(1 + c_custkey % 9 AS VARCHAR(1)))"
_WIDE = f"0.02 * length({_ADDRESS})"


@query(
    "customer",
    sql=f"""
  SELECT c_custkey AS doc_id, content, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y, round(CAST(width AS DOUBLE), 4) AS width, CAST(height AS DOUBLE) AS height FROM (
    SELECT c_custkey, concat({_ADDRESS}, '한솔아파트') AS content, 0.3 AS x, 0.1 AS y, {_WIDE} AS width, 0.05 AS height FROM customer WHERE c_custkey % 4 = 0
    UNION ALL SELECT c_custkey, {_ADDRESS}, 0.3, 0.1, {_WIDE}, 0.02 FROM customer WHERE c_custkey % 4 IN (1, 3)
    UNION ALL SELECT c_custkey, concat('135-080 ', {_ADDRESS}), 0.14, 0.1, {_WIDE} + 0.16, 0.02 FROM customer WHERE c_custkey % 4 = 2
    UNION ALL SELECT c_custkey, {_NEXT}, 0.3, 0.13, 0.02 * length({_NEXT}), 0.02 FROM customer WHERE c_custkey % 4 = 3
  )
""",
)
def address_cell(spark):
    """Cells with a building below, behind a wall, behind a postal code, and above another address; a phone number stands in the next column."""
    kind = F.col("c_custkey") % 4
    rows = spark.sql(f"SELECT c_custkey, {_ADDRESS} AS address, {_NEXT} AS other FROM customer")
    left = F.when(kind == 1, _line(F.lit("김문구|"), 0.22, 0.1)).when(kind == 2, _line(F.lit("135-080 "), 0.14, 0.1)).otherwise(F.array())
    below = F.when(kind == 0, _line(F.lit("한솔아파트"), 0.3, 0.13)).when(kind == 3, _line(F.col("other"), 0.3, 0.13)).otherwise(F.array())
    glyphs = F.concat(left, _line(F.col("address"), 0.3, 0.1), below, _line(F.lit("끝"), 1.2, 0.3), _line(F.lit("02-123-4567"), 1.2, 0.1))
    found = detect_layout(rows.select(F.col("c_custkey").alias("doc_id"), F.lit(0).alias("page_index"), glyphs.alias("glyphs")))
    return flat(found.where("category = 'Address'").select("doc_id", "content", "bbox"))


@query(
    "customer",
    sql="SELECT c_custkey AS doc_id, 'AddressRegionBuilding' AS pattern_type, CAST(0.4 AS DOUBLE) AS confidence, concat('경기도 성남시 분당구', CASE WHEN c_custkey % 2 = 0 THEN '매화마을 동신빌라' ELSE '한솔주공타운' END) AS content, CAST(0.1 AS DOUBLE) AS x, CAST(0.1 AS DOUBLE) AS y, CAST(0.22 AS DOUBLE) AS width, CAST(0.05 AS DOUBLE) AS height FROM customer WHERE c_custkey % 5 > 0",
)
def region_building(spark):
    """A region whose building stands a line below it, with a phone number between them in the text; on every fifth page it is too far below."""
    key = F.col("c_custkey")
    far = F.when(key % 5 == 0, _line(F.lit("한솔주공타운"), 0.1, 0.5)).when(key % 2 == 0, _line(F.lit("매화마을 동신빌라"), 0.1, 0.13)).otherwise(_line(F.lit("한솔주공타운"), 0.1, 0.13))
    phone = F.concat(F.lit("02-123-"), F.lpad((key % 10000).cast("string"), 4, "0"))
    glyphs = F.concat(_line(F.lit("경기도 성남시 분당구"), 0.1, 0.1), _line(phone, 0.7, 0.1), far)
    found = detect_layout(spark.table("customer").select(key.alias("doc_id"), F.lit(0).alias("page_index"), glyphs.alias("glyphs")))
    return flat(found.where("category = 'Address'").select("doc_id", "pattern_type", "confidence", "content", "bbox"))


# Placing imported items on pages of glyphs: each customer's name is a page of one line.
_WANTED = "SELECT c_custkey AS doc_id, c_custkey AS id, CAST(0 AS INT) AS page, CAST(0.5 AS DOUBLE) AS x, CAST(0.5 AS DOUBLE) AS y, CAST(0.1 AS DOUBLE) AS width, CAST(0.1 AS DOUBLE) AS height, CASE c_custkey % 4 WHEN 0 THEN substr(c_name, 3, 6) WHEN 1 THEN '' WHEN 2 THEN 'not there' ELSE substr(c_name, 10, 99) END AS content FROM customer"
_FOUND = "length(content) > 0 AND strpos(c_name, content) > 0"


@query(
    "customer",
    sql=f"SELECT w.doc_id, NOT ({_FOUND}) AS position_uncertain, CASE WHEN {_FOUND} THEN CAST(strpos(c_name, content) - 1 AS BIGINT) END AS found_at, round(CASE WHEN {_FOUND} THEN 0.1 + 0.02 * (strpos(c_name, content) - 1) ELSE x END, 4) AS x, CASE WHEN {_FOUND} THEN 0.2 ELSE y END AS y, round(CASE WHEN {_FOUND} THEN 0.02 * length(content) ELSE width END, 4) AS width, CASE WHEN {_FOUND} THEN 0.02 ELSE height END AS height FROM ({_WANTED}) w JOIN customer ON c_custkey = doc_id",
)
def reanchor_boxes(spark):
    pages = spark.table("customer").select(F.col("c_custkey").alias("doc_id"), F.lit(0).alias("page_index"), _line(F.col("c_name"), 0.1, 0.2).alias("glyphs"))
    placed = review.reanchor_boxes(boxed(spark.sql(_WANTED)), pages)
    return flat(placed.select("doc_id", "position_uncertain", F.col("found_at").cast("long").alias("found_at"), "bbox"))


# An import replaces the items of its documents and clears their log.
_IMPORTED = "SELECT CAST(floor(CAST(o_orderkey AS DOUBLE) / 128) AS BIGINT) AS doc_id, -o_orderkey AS id, 'imported' AS origin FROM orders WHERE CAST(floor(CAST(o_orderkey AS DOUBLE) / 128) AS BIGINT) % 3 = 0"
_ENTRIES = "SELECT CAST(floor(CAST(l_orderkey AS DOUBLE) / 128) AS BIGINT) AS doc_id, l_orderkey * 10 + l_linenumber AS seq FROM lineitem WHERE l_linenumber < 3"


@query(
    "lineitem",
    "orders",
    sql=f"WITH i AS ({_IMPORTED}), d AS (SELECT DISTINCT doc_id FROM i), a AS (SELECT doc_id, origin FROM ({D.ITEMS}) x WHERE doc_id NOT IN (SELECT doc_id FROM d) UNION ALL SELECT doc_id, origin FROM i), l AS (SELECT doc_id, count(*) AS n_log FROM ({_ENTRIES}) e WHERE doc_id NOT IN (SELECT doc_id FROM d) GROUP BY ALL) SELECT a.doc_id, origin, count(*) AS n_items, coalesce(any_value(n_log), 0) AS n_log FROM a LEFT JOIN l USING (doc_id) GROUP BY a.doc_id, origin",
)
def import_replaces(spark):
    items, log = review.replace_imported(spark.sql(D.ITEMS).select("doc_id", "id", "origin"), spark.sql(_ENTRIES), spark.sql(_IMPORTED))
    entries = log.groupBy("doc_id").agg(F.count("*").alias("n_log"))
    return items.groupBy("doc_id", "origin").agg(F.count("*").alias("n_items")).join(entries, "doc_id", "left").withColumn("n_log", F.coalesce("n_log", F.lit(0)))


# Redaction carried out by route, and what the run did.


@query(
    "orders",
    "lineitem",
    sql=f"WITH g AS ({D.GLYPHS}), a AS ({D.BOXES}), b AS ({_OBJECTS}), s AS (SELECT doc_id, page, sum(width * height) AS area FROM a GROUP BY ALL), o AS (SELECT a.doc_id, a.page, max(b.width * b.height) AS largest FROM a JOIN b ON a.doc_id = b.doc_id AND a.page = b.page AND b.kind IN ('form', 'image') AND {_BOXES_OVER} GROUP BY ALL), r AS (SELECT s.doc_id, s.page, CASE WHEN largest > 3.0 * area THEN 'page' ELSE 'spans' END AS route FROM s LEFT JOIN o USING (doc_id, page)), m AS (SELECT g.doc_id, g.page, route, coalesce(route = 'page', false) OR (coalesce(route = 'spans', false) AND EXISTS (SELECT 1 FROM a AS b WHERE b.doc_id = g.doc_id AND b.page = g.page AND {_BOXES_OVER.replace('a.', 'g.')})) AS gone FROM g LEFT JOIN r USING (doc_id, page)) SELECT doc_id, page, route, count(*) FILTER (gone) AS n_removed, count(*) FILTER (NOT gone) AS n_left FROM m GROUP BY doc_id, page, route",
)
def redact_carried_out(spark):
    glyphs = boxed(spark.sql(D.GLYPHS)).withColumnRenamed("bbox", "box")
    return redact.removed_counts(redact.carry_out(glyphs, boxed(spark.sql(D.BOXES)), boxed(spark.sql(_OBJECTS))))


@query(
    "documents",
    sql="WITH p AS (SELECT coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[A-Za-z0-9._%+\\-]+@[A-Za-z0-9.\\-]+\\.[A-Za-z]{2,}', '[Email]', 'g') AS r, len(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9._%+\\-]+@[A-Za-z0-9.\\-]+\\.[A-Za-z]{2,}')) AS n FROM documents) SELECT 'redaction' AS run, count(*) AS pages, CAST(sum(n) AS BIGINT) AS finds, CAST(sum(strlen(t)) AS BIGINT) AS bytes_in, CAST(sum(strlen(r)) AS BIGINT) AS bytes_out FROM p",
)
def run_summary(spark):
    """Counts observed while redacted pages are written out, without a second pass."""
    pages = spark.sql(D.PAGES).withColumn("text", F.coalesce("text", F.lit("")))
    written = redact.redact_texts(page_finds(pages, _rules("Email")), token=True)
    return runs.summarised("redaction", written, lambda df: df.write.format("noop").mode("overwrite").save()).drop("elapsed_ms")


# Edits within margins, and small reports.
_MARGINED = "SELECT doc_id, page, 0.1 AS l, 0.05 AS t, 0.2 AS r, 0.1 AS b FROM (SELECT DISTINCT CAST(floor(CAST(l_orderkey AS DOUBLE) / 128) AS BIGINT) AS doc_id, CAST(l_linenumber - 1 AS INT) AS page FROM lineitem) q WHERE doc_id % 2 = 0"


def _zones(spark):
    return spark.sql(_MARGINED).select("doc_id", "page", F.struct(F.col("t").alias("top"), F.col("b").alias("bottom"), F.col("l").alias("left"), F.col("r").alias("right")).alias("margins"))


_IN_ZONE = f"(SELECT i.*, coalesce(z.l, 0) AS zl, coalesce(z.t, 0) AS zt, 1 - coalesce(z.r, 0) AS zr, 1 - coalesce(z.b, 0) AS zb FROM ({D.ITEMS}) i LEFT JOIN ({_MARGINED}) z USING (doc_id, page)) i"


@query(
    "lineitem",
    sql=f"SELECT id, round(x + greatest(least(0.4, zr - r), zl - l), 4) AS x, round(y + greatest(least(-0.3, zb - b), zt - t), 4) AS y FROM (SELECT *, min(x) OVER w AS l, max(x + width) OVER w AS r, min(y) OVER w AS t, max(y + height) OVER w AS b FROM {_IN_ZONE} WINDOW w AS (PARTITION BY doc_id, page))",
)
def group_shift_in_margins(spark):
    return flat(review.shift_group(boxed(spark.sql(D.ITEMS)), 0.4, -0.3, zones=_zones(spark)).select("id", "bbox")).select("id", "x", "y")


@query("lineitem", sql=f"SELECT doc_id, count(*) FILTER (category IN ('RRN', 'Card')) AS n_redacted, count(*) FILTER (category NOT IN ('RRN', 'Card')) AS n_hidden FROM ({D.ITEMS}) i GROUP BY doc_id")
def save_hidden(spark):
    return review.save_summary(spark.sql(D.ITEMS), ["RRN", "Card"])


@query("orders", "lineitem", sql=f"WITH z AS (SELECT DISTINCT doc_id, page FROM ({D.BOXES}) b) SELECT doc_id, page, CAST(0.49 AS DOUBLE) AS top, CAST(0.49 AS DOUBLE) AS bottom, CAST(0.1 AS DOUBLE) AS l, CAST(0.0 AS DOUBLE) AS r FROM z")
def same_margins(spark):
    margins = F.struct(F.lit(0.7).alias("top"), F.lit(0.7).alias("bottom"), F.lit(0.1).alias("left"), F.lit(-1.0).alias("right"))
    zones = review.same_margins(spark.sql(D.BOXES), margins)
    return zones.select("doc_id", "page", F.round("margins.top", 6).alias("top"), F.round("margins.bottom", 6).alias("bottom"), F.col("margins.left").alias("l"), F.col("margins.right").alias("r"))


@query("lineitem", "orders", sql=f"WITH l AS (SELECT DISTINCT CAST(floor(CAST(o_orderkey AS DOUBLE) / 128) AS BIGINT) AS doc_id, o_orderkey * 10 + 1 AS id FROM orders) SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY id) AS n, id AS item_id FROM ({D.ITEMS}) i WHERE (doc_id, id) IN (SELECT doc_id, id FROM l)")
def delete_listed(spark):
    listed = spark.sql("SELECT CAST(floor(CAST(o_orderkey AS DOUBLE) / 128) AS BIGINT) AS doc_id, o_orderkey * 10 + 1 AS id FROM orders")
    items = spark.sql(D.ITEMS).select("doc_id", "id", F.col("content").alias("state"))
    return changelog.delete_listed(items, listed).select("doc_id", F.col("n").cast("long").alias("n"), "item_id")


@query("part", sql=f"SELECT doc_id, count(*) AS n_nodes, count(*) FILTER (parent_id IS NULL) AS n_top, count(page_index) AS n_placed FROM ({D.OUTLINE}) o GROUP BY doc_id")
def outline_counts(spark):
    return profile.node_counts(spark.sql(D.OUTLINE))


def stream_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream over the events' files as a change log: entries by window and action, of the windows that the watermark has closed."""
    folder, files = streams.folder_of(spark, sf_dir, "events")
    events = spark.readStream.schema(spark.read.parquet(f"{sf_dir}/events.parquet").schema).option("pathGlobFilter", files).parquet(folder)
    log = events.select(F.col("ts").cast("timestamp").alias("timestamp"), F.col("user_id").alias("doc_id"), (F.col("event_id") % 5).alias("item_id"), F.col("event_id").alias("seq"), F.col("event_type").alias("action"))
    counts = streams.to_end(detection.ordered_log(log))
    return counts.select(F.unix_timestamp("window.start").alias("begins"), "action", "n")


QUERIES["stream_log"] = stream_log
ORACLE_SQL["stream_log"] = """
  WITH l AS (SELECT DISTINCT user_id, event_id, event_type, CAST(floor(epoch(ts) / 300) AS BIGINT) * 300 AS begins FROM events WHERE ts IS NOT NULL)
  SELECT begins, event_type AS action, count(*) AS n FROM l WHERE begins + 300 <= (SELECT max(epoch(ts)) FROM events) - 600 GROUP BY begins, event_type
"""
