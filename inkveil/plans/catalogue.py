"""Registered queries and their SQL: each reads the given tables, or what both engines derive from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkveil.functions import checks, geometry, text
from inkveil.operators import changelog, dictionary, profile, redact, review
from inkveil.operators.detect import detect, page_finds
from inkveil.operators.layout import detect_layout
from inkveil.operators.spans import anchor, before, blocks
from inkveil.plans import derived as D
from inkveil.plans import detection_sql as Q
from inkveil.plans.derived import boxed, flat, load
from inkveil.plans.rules import RULES
from inkveil.sources import tables
from inkveil.streaming import detection, runs

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(*reads: str, sql: str | None = None):
    """Register a query that reads tables as views; ``sql`` is its DuckDB version."""

    def put(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            load(spark, sf_dir, *reads)
            return f(spark)

        QUERIES[f.__name__] = run
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


TEXT_RULES = tuple(r for r in RULES if not r.lookup)


def _rules(*kinds: str):
    return tuple(r for r in TEXT_RULES if r.pattern_type in kinds)


# Detection on the given documents. The list of finds for all rules is folded in SQL as well.

_DOCUMENTS = "SELECT doc_id, 0 AS page_index, coalesce(text, '') AS text FROM documents"
_ALL = Q.finds(Q.chosen(), _DOCUMENTS)


@query("documents", sql=f"WITH {_ALL} SELECT category, status AS validation, count(*) AS n FROM found GROUP BY ALL")
def detect_summary(spark):
    found = page_finds(spark.sql(D.PAGES)).select(F.explode("finds").alias("f"))
    return found.groupBy(F.col("f.category").alias("category"), F.col("f.status").alias("validation")).agg(F.count("*").alias("n"))


@query("documents", sql=f"WITH {_ALL} SELECT doc_id, concat('r-', row_number() OVER (PARTITION BY doc_id ORDER BY page_index, rule, s) - 1) AS id, category, pattern_type, status AS validation, confidence, m AS content, s AS start, e AS \"end\" FROM found")
def detect_items(spark):
    return detect(spark.sql(D.PAGES)).select("doc_id", "id", "category", "pattern_type", "validation", "confidence", "content", "start", "end")


def _of(name: str, kinds: tuple[str, ...], pages: str, *reads: str) -> None:
    rules = Q.chosen(*kinds)
    sql = f"WITH {Q.finds({k: r for k, r in enumerate(rules.values())}, pages)} SELECT doc_id, category, status AS validation, confidence, m AS content FROM found"

    def f(spark):
        return detect(spark.sql(pages), _rules(*kinds)).select("doc_id", "category", "validation", "confidence", "content")

    f.__name__ = name
    query(*reads, sql=sql)(f)


_of("detect_email", ("Email",), _DOCUMENTS, "documents")
_of("detect_card_rrn", ("RRN", "Card"), _DOCUMENTS, "documents")
_of("detect_phone_fax", ("PhoneNumber", "PhoneNumberSeoulLocal"), _DOCUMENTS, "documents")
_of("detect_ko_rrn", ("RRN",), D.SENTENCES, "customer")
_of("detect_ko_card", ("Card",), D.SENTENCES, "customer")
_of("detect_ko_phone_fax", ("PhoneNumber", "PhoneNumberSeoulLocal"), D.SENTENCES, "customer")
_of("detect_ko_dob", ("DateOfBirth",), D.SENTENCES, "customer")
_of("detect_ko_passport", ("Passport",), D.SENTENCES, "customer")
_of("detect_ko_address", ("Address",), D.SENTENCES, "customer")


@query("customer", sql=f"WITH s AS ({D.SENTENCES}) SELECT doc_id, 'BankAccount' AS category, CAST(0.7 AS DOUBLE) AS confidence, regexp_extract(text, '국민은행 [0-9-]+') AS content, 0 AS start FROM s WHERE text LIKE '국민은행%'")
def detect_ko_account(spark):
    return detect(spark.sql(D.SENTENCES), _rules("BankAccount")).select("doc_id", "category", "confidence", "content", "start")


@query("customer", sql=f"WITH {Q.finds(Q.chosen(), D.SENTENCES)} SELECT category, pattern_type, status AS validation, confidence, count(*) AS n FROM found WHERE category <> 'BankAccount' GROUP BY ALL")
def detect_ko_all(spark):
    found = detect(spark.sql(D.SENTENCES)).where("category <> 'BankAccount'")
    return found.groupBy("category", "pattern_type", "validation", "confidence").agg(F.count("*").alias("n"))


# Text functions and checks.

_FW = "concat('Ａ', translate(CAST(c_custkey AS VARCHAR(12)), '0123456789', '０１２３４５６７８９'), '　｜', c_name)"


@query("customer", sql=f"SELECT c_custkey, concat('A', c_custkey, ' |', c_name) AS norm, length({_FW}) AS n FROM customer")
def normalize_fullwidth(spark):
    return spark.sql(f"SELECT c_custkey, {_FW} AS t FROM customer").select("c_custkey", text.halfwidth(F.col("t")).alias("norm"), F.length("t").cast("long").alias("n"))


_OCR = "concat('Ollo IBM ', translate(CAST(c_custkey * 1001 + 1 AS VARCHAR(12)), '10', 'lO'), 'ㅡ7|5 oO')"


@query("customer", sql="SELECT c_custkey, concat('Ollo IBM ', c_custkey * 1001 + 1, '-715 oO') AS norm FROM customer")
def normalize_ocr_digits(spark):
    return spark.sql(f"SELECT c_custkey, {_OCR} AS t FROM customer").select("c_custkey", text.normalized(F.col("t")).alias("norm"))


_RRN = "concat(lpad(CAST(o_orderkey * 7919 % 1000000 AS VARCHAR(6)), 6, '0'), '-', lpad(CAST(o_orderkey * 104729 % 10000000 AS VARCHAR(7)), 7, '0'))"


@query("orders", sql=f"SELECT o_orderkey, {Q.rrn_valid('r')} AS valid FROM (SELECT o_orderkey, {_RRN} AS r FROM orders)")
def rrn_checksum(spark):
    return spark.sql(f"SELECT o_orderkey, {_RRN} AS r FROM orders").select("o_orderkey", checks.rrn_valid(F.col("r")).alias("valid"))


_CARD = "concat(CAST(1000 + o_orderkey * 7 % 9000 AS VARCHAR(4)), CASE o_orderkey % 3 WHEN 0 THEN '-' WHEN 1 THEN ' ' ELSE '' END, '1111', CASE WHEN o_orderkey % 2 = 0 THEN '-' ELSE ' ' END, lpad(CAST(o_orderkey * 31 % 10000 AS VARCHAR(4)), 4, '0'), CAST(o_orderkey % 2000 AS VARCHAR(4)))"


@query("orders", sql=f"SELECT o_orderkey, {Q.card_format('r')} AS is_card, {Q.luhn_valid('r')} AS luhn FROM (SELECT o_orderkey, {_CARD} AS r FROM orders)")
def luhn_validate(spark):
    return spark.sql(f"SELECT o_orderkey, {_CARD} AS r FROM orders").select("o_orderkey", checks.card_format(F.col("r")).alias("is_card"), checks.luhn_valid(F.col("r")).alias("luhn"))


_POSTAL = "CASE o_orderkey % 3 WHEN 0 THEN concat(lpad(CAST(o_orderkey % 1000 AS VARCHAR(3)), 3, '0'), '-', CAST(100 + o_custkey % 900 AS VARCHAR(3))) WHEN 1 THEN lpad(CAST(o_orderkey * 7 % 100000 AS VARCHAR(5)), 5, '0') ELSE CAST(o_orderkey AS VARCHAR(12)) END"


@query(
    "orders",
    sql=f"SELECT o_orderkey, postal, length(regexp_replace(t, '[^0-9]', '', 'g')) >= 3 AND NOT postal AS significant FROM (SELECT *, regexp_matches(t, '^[1-7][0-9]{{2}}-[0-9]{{3}}$') OR (regexp_matches(t, '^[0-9]{{5}}$') AND CAST(substr(t, 1, 2) AS INT) BETWEEN 1 AND 63) AS postal FROM (SELECT o_orderkey, {_POSTAL} AS t FROM orders))",
)
def postal_token(spark):
    t = F.col("t")
    return spark.sql(f"SELECT o_orderkey, {_POSTAL} AS t FROM orders").select("o_orderkey", checks.postal_token(t).alias("postal"), checks.significant_number(t).alias("significant"))


# A dictionary and places made of syllables by number.
_ONE_OF = "substr('가나다라마바사아자차카타파하', CAST(1 + {} % 14 AS INT), 1)"
_NAMES = f"SELECT DISTINCT concat({_ONE_OF.format('p_partkey')}, {_ONE_OF.format('CAST(floor(CAST(p_partkey AS DOUBLE) / 14) AS BIGINT)')}, CASE WHEN p_partkey % 3 = 0 THEN '리' ELSE '동' END) AS dong FROM part WHERE p_partkey % 7 < 3"
_PLACES = f"SELECT c_custkey AS id, concat('강남구 ', {_ONE_OF.format('c_custkey')}, CASE WHEN c_custkey % 4 = 0 THEN '하' ELSE {_ONE_OF.format('CAST(floor(CAST(c_custkey AS DOUBLE) / 14) AS BIGINT)')} END, CASE WHEN c_custkey % 2 = 0 THEN '동' ELSE '를' END) AS place FROM customer"


@query("customer", "part", sql=f"SELECT id FROM ({_PLACES}) s WHERE regexp_matches(place, '[동리]$') AND EXISTS (SELECT 1 FROM ({_NAMES}) n WHERE n.dong = substr(place, 5, 3))")
def dong_exact(spark):
    return dictionary.exact(spark.sql(_PLACES), spark.sql(_NAMES), "place", ["id"])


# Names and endings have three characters, so one edit is one character changed. DuckDB's own distance counts bytes.
_CHANGED = " + ".join(f"CASE WHEN substr(n.dong, {i}, 1) = substr(place, {i + 4}, 1) THEN 0 ELSE 1 END" for i in (1, 2, 3))


@query("customer", "part", sql=f"SELECT id FROM ({_PLACES}) s WHERE NOT regexp_matches(place, '[동리]$') AND EXISTS (SELECT 1 FROM ({_NAMES}) n WHERE {_CHANGED} <= 1)")
def dong_fuzzy(spark):
    return dictionary.fuzzy(spark.sql(_PLACES), spark.sql(_NAMES), "place", ["id"])


@query("customer", sql=f"SELECT doc_id, CASE WHEN contains(c, '팩스') THEN 'FaxNumber' WHEN contains(c, '연락처') THEN 'PhoneNumber' END AS category FROM (SELECT doc_id, regexp_replace(lower(substr(text, 1, 6)), '\\s', '', 'g') AS c FROM ({D.SENTENCES}))")
def anchor_context(spark):
    phone = next(r for r in RULES if r.pattern_type == "PhoneNumber" and r.required)
    return spark.sql(D.SENTENCES).select("doc_id", anchor(before(blocks(F.col("text")), F.lit(6)), phone)["category"].alias("category"))


# Redaction.


@query("documents", sql="SELECT doc_id, regexp_replace(coalesce(text, ''), '[A-Za-z0-9._%+\\-]+@[A-Za-z0-9.\\-]+\\.[A-Za-z]{2,}', '[Email]', 'g') AS redacted FROM documents")
def redact_text(spark):
    return redact.redact_texts(page_finds(spark.sql(D.PAGES), _rules("Email")), token=True).select("doc_id", "redacted")


@query("documents", sql=f"WITH {_ALL} SELECT doc_id, count(*) AS n_found, 0 AS n_left FROM found GROUP BY doc_id")
def redact_residual(spark):
    red = redact.redact_texts(page_finds(spark.sql(D.PAGES))).where(F.size("finds") > 0)
    left = redact.post_check(red).select(F.col("doc_id").alias("_doc"), F.col("n_left").cast("int").alias("n_left"))
    counts = red.groupBy("doc_id").agg(F.sum(F.size("finds")).alias("n_found"))
    return counts.join(left, F.col("doc_id").eqNullSafe(F.col("_doc"))).drop("_doc")


_OBJECTS = "SELECT doc_id, page, CASE n % 3 WHEN 0 THEN 'image' WHEN 1 THEN 'form' ELSE 'text' END AS kind, x, y, width * (1 + n % 24) AS width, height * (1 + n % 12) AS height FROM (" + D.GLYPHS + ") g"
_WIDE_OBJECTS = "SELECT doc_id, page, CASE n % 3 WHEN 0 THEN 'image' WHEN 1 THEN 'form' ELSE 'text' END AS kind, x, y, width * (1 + n % 24) AS width, height * (1 + n % 12) AS height FROM (" + D.WIDE_GLYPHS + ") g"
_OVER = _BOXES_OVER = "a.x < b.x + b.width AND b.x < a.x + a.width AND a.y < b.y + b.height AND b.y < a.y + a.height"


@query(
    "orders",
    "lineitem",
    sql=f"WITH a AS ({D.WIDE_BOXES}), b AS ({_WIDE_OBJECTS}), s AS (SELECT doc_id, page, count(*) AS n_boxes, sum(width * height) AS area FROM a GROUP BY ALL), o AS (SELECT a.doc_id, a.page, max(b.width * b.height) AS largest FROM a JOIN b ON a.doc_id = b.doc_id AND a.page = b.page AND b.kind <> 'text' AND {_OVER} GROUP BY ALL) SELECT s.doc_id, s.page, n_boxes, round(area, 6) AS area, CASE WHEN largest > 3 * area THEN 'page' ELSE 'spans' END AS route FROM s LEFT JOIN o USING (doc_id, page)",
)
def redact_route(spark):
    return redact.route_pages(boxed(spark.sql(D.WIDE_BOXES)), boxed(spark.sql(_WIDE_OBJECTS))).withColumn("area", F.round("area", 6))


@query("orders", "lineitem", sql=f"WITH a AS ({D.WIDE_GLYPHS}), b AS ({D.WIDE_BOXES}) SELECT doc_id, count(*) AS n_left FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE a.doc_id = b.doc_id AND a.page = b.page AND {_OVER}) GROUP BY ALL")
def redact_glyphs(spark):
    glyphs = boxed(spark.sql(D.WIDE_GLYPHS)).withColumnRenamed("bbox", "box")
    return redact.redact_glyphs(glyphs, boxed(spark.sql(D.WIDE_BOXES))).groupBy("doc_id").agg(F.count("*").alias("n_left"))


# Review table.


@query("lineitem", sql=f"WITH i AS ({D.WIDE_ITEMS}), a AS (SELECT * FROM i WHERE origin = 'detected'), b AS (SELECT * FROM i WHERE origin <> 'detected') SELECT id FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE a.doc_id = b.doc_id AND a.page = b.page AND {_OVER})")
def overlap_antijoin(spark):
    items = boxed(spark.sql(D.WIDE_ITEMS))
    return review.drop_overlapping(items.where("origin = 'detected'"), items.where("origin <> 'detected'")).select("id")


@query("lineitem", "orders", sql=f"WITH a AS ({D.WIDE_ITEMS}), b AS ({D.WIDE_BOXES}) SELECT id FROM a WHERE EXISTS (SELECT 1 FROM b WHERE a.doc_id = b.doc_id AND a.page = b.page AND a.x >= b.x AND a.y >= b.y AND a.x + a.width <= b.x + b.width AND a.y + a.height <= b.y + b.height)")
def containment_semijoin(spark):
    return review.absorbed(boxed(spark.sql(D.WIDE_ITEMS)), boxed(spark.sql(D.WIDE_BOXES))).select("id")


_NEW = "SELECT doc_id, -id AS id, page, 'detected' AS origin, x + 0.25 AS x, y, width, height FROM (" + D.WIDE_ITEMS + ") i WHERE origin = 'detected'"


@query("lineitem", sql=f"WITH i AS ({D.WIDE_ITEMS}), a AS ({_NEW}), b AS (SELECT * FROM i WHERE origin <> 'detected') SELECT id, origin FROM b UNION ALL SELECT id, origin FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE a.doc_id = b.doc_id AND a.page = b.page AND {_OVER})")
def merge_redetect(spark):
    return review.merge_redetected(boxed(spark.sql(D.WIDE_ITEMS)), boxed(spark.sql(_NEW))).select("id", "origin")


_CENTRE = "g.x + g.width / 2 BETWEEN b.x AND b.x + b.width AND g.y + g.height / 2 BETWEEN b.y AND b.y + b.height"


@query("orders", "lineitem", sql=f"WITH b AS ({D.WIDE_BOXES}), g AS ({D.WIDE_GLYPHS}) SELECT b.doc_id, b.page, b.id, coalesce(string_agg(ch, '' ORDER BY n, ch), '') AS text FROM b LEFT JOIN g ON b.doc_id = g.doc_id AND b.page = g.page AND {_CENTRE} GROUP BY ALL")
def glyphs_in_box(spark):
    return review.text_in_boxes(boxed(spark.sql(D.WIDE_BOXES)), boxed(spark.sql(D.WIDE_GLYPHS)).withColumnRenamed("bbox", "box"))


@query("lineitem", sql=f"SELECT doc_id, page, round(min(x), 4) AS x, round(min(y), 4) AS y, round(max(x + width) - min(x), 4) AS width, round(max(y + height) - min(y), 4) AS height FROM ({D.ITEMS}) i GROUP BY ALL")
def union_box(spark):
    return flat(boxed(spark.sql(D.ITEMS)).groupBy("doc_id", "page").agg(geometry.union_box(F.collect_list("bbox")).alias("bbox")))


_ZONES = "SELECT CAST(floor(CAST(o_orderkey AS DOUBLE) / 128) AS BIGINT) AS doc_id, CAST(o_orderkey % 7 AS INT) AS page, min(o_orderkey) AS n, CAST(min(o_orderkey) % 16 AS DOUBLE) / 64 AS top, CAST(min(o_orderkey) % 8 AS DOUBLE) / 64 AS bottom, CAST(min(o_orderkey) % 4 AS DOUBLE) / 64 AS l, CAST(min(o_orderkey) % 32 AS DOUBLE) / 64 AS r FROM orders GROUP BY CAST(floor(CAST(o_orderkey AS DOUBLE) / 128) AS BIGINT), CAST(o_orderkey % 7 AS INT), o_orderkey % 2"


@query("orders", "lineitem", sql=f"WITH g AS ({D.GLYPHS}), z AS (SELECT doc_id, page, arg_min(top, n) AS top, arg_min(bottom, n) AS bottom, arg_min(l, n) AS l, arg_min(r, n) AS r FROM ({_ZONES}) GROUP BY ALL) SELECT n FROM g LEFT JOIN z USING (doc_id, page) WHERE top IS NULL OR NOT (y + height / 2 < top OR y + height / 2 > 1 - bottom OR x + width / 2 < l OR x + width / 2 > 1 - r)")
def margin_exclusion(spark):
    zones = spark.sql(_ZONES).select("doc_id", "page", "n", F.struct("top", "bottom", F.col("l").alias("left"), F.col("r").alias("right")).alias("margins"))
    return review.exclude_margins(boxed(spark.sql(D.GLYPHS)).withColumnRenamed("bbox", "box"), zones).select("n")


@query("lineitem", sql=f"WITH g AS (SELECT doc_id, page, y + height * 0.5 AS c, max(height) OVER (PARTITION BY doc_id, page) AS h FROM ({D.GLYPHS})) SELECT doc_id, page, CAST(1 + count(*) FILTER (d > h * 0.5) AS INT) AS n_lines FROM (SELECT *, c - lag(c) OVER (PARTITION BY doc_id, page ORDER BY c) AS d FROM g) GROUP BY ALL")
def line_count(spark):
    return boxed(spark.sql(D.GLYPHS)).groupBy("doc_id", "page").agg(geometry.line_count(F.collect_list("bbox")).alias("n_lines"))


@query("lineitem", sql=f"WITH g AS (SELECT doc_id, page, x - lag(x) OVER w AS d, first_value(width) OVER w AS w0 FROM ({D.GLYPHS}) WINDOW w AS (PARTITION BY doc_id, page ORDER BY n, x, y, width, height)) SELECT doc_id, page, coalesce(bool_or(d > 2 * w0), false) AS gap FROM g GROUP BY ALL")
def cell_gap(spark):
    boxes = F.transform(F.array_sort(F.collect_list(F.struct("n", "bbox"))), lambda g: g["bbox"])
    return boxed(spark.sql(D.GLYPHS)).groupBy("doc_id", "page").agg(geometry.cell_gap(boxes).alias("gap"))


@query("lineitem", sql=f"SELECT doc_id, page, v[len(v) // 2 + 1] AS middle FROM (SELECT doc_id, page, list(width ORDER BY width) AS v FROM ({D.ITEMS}) i GROUP BY ALL)")
def upper_median(spark):
    return spark.sql(D.ITEMS).groupBy("doc_id", "page").agg(geometry.upper_median(F.collect_list("width")).alias("middle"))


_ASKED = "SELECT doc_id, item_id AS id, page, content FROM (SELECT doc_id, doc_id AS item_id, 0 AS page, CASE doc_id % 4 WHEN 0 THEN substr(text, 11, 12) WHEN 1 THEN '' WHEN 2 THEN 'not there at all' ELSE substr(text, 1, 5) END AS content FROM documents) q"


@query("documents", sql=f"SELECT a.doc_id, a.id, CASE WHEN length(content) > 0 AND strpos(text, content) > 0 THEN strpos(text, content) - 1 END AS found_at, NOT coalesce(length(content) > 0 AND strpos(text, content) > 0, false) AS position_uncertain FROM ({_ASKED}) a JOIN documents d ON a.doc_id = d.doc_id")
def reanchor(spark):
    return review.reanchor(spark.sql(_ASKED), spark.sql(D.PAGES)).select("doc_id", "id", F.col("found_at").cast("long").alias("found_at"), "position_uncertain")


_LABEL = "CASE category WHEN 'RRN' THEN '주민등록번호' WHEN 'Email' THEN '이메일' WHEN 'Card' THEN '신용카드' WHEN 'PhoneNumber' THEN '전화번호' ELSE '사용자 지정' END"


def _number(c: str) -> str:
    return f"regexp_replace(regexp_replace(printf('%.6f', round({c}, 6)), '0+$', ''), '\\.$', '')"


@query("lineitem", sql=f"SELECT concat('f', doc_id) AS filename, {_LABEL} AS label, content, page + 1 AS page, concat_ws(',', {', '.join(map(_number, ('x', 'y', 'width', 'height')))}) AS box FROM ({D.ITEMS}) i")
def exchange_export(spark):
    items = boxed(spark.sql(D.ITEMS)).withColumn("updated_at", F.lit("2024-01-01").cast("timestamp"))
    files = items.select("doc_id").distinct().select("doc_id", F.concat(F.lit("f"), "doc_id").alias("filename"))
    return tables.exchange_rows(items, files).toDF("filename", "label", "content", "page", "box", "at").drop("at")


_ROWS = "SELECT CASE WHEN o_orderkey % 11 = 0 THEN ' ' ELSE concat('f', CAST(o_custkey AS VARCHAR(9))) END AS f, CASE WHEN o_orderkey % 11 = 0 THEN '' ELSE '이메일' END AS l, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE CAST(o_orderkey AS VARCHAR(9)) END AS c, CASE WHEN o_orderkey % 11 = 0 THEN '' WHEN o_orderkey % 7 = 0 THEN 'x1' WHEN o_orderkey % 5 = 0 THEN '3.0' ELSE CAST(o_orderkey % 4 AS VARCHAR(2)) END AS p, CASE WHEN o_orderkey % 11 = 0 THEN '' WHEN o_orderkey % 13 = 0 THEN '1,2' ELSE '0.5,,0.25,1' END AS b, '' AS u FROM orders"


@query("orders", sql=f"SELECT f AS filename, 'Email' AS category, c AS content, CASE WHEN p = 'x1' THEN NULL ELSE greatest(CAST(CAST(p AS DOUBLE) AS INT) - 1, 0) END AS page, CAST(CASE WHEN b = '1,2' THEN 0.0 ELSE 0.5 END AS DOUBLE) AS x, CAST(0.0 AS DOUBLE) AS y, CAST(CASE WHEN b = '1,2' THEN 0.0 ELSE 0.25 END AS DOUBLE) AS width, CAST(CASE WHEN b = '1,2' THEN 0.0 ELSE 1.0 END AS DOUBLE) AS height FROM ({_ROWS}) WHERE c IS NOT NULL")
def exchange_import(spark):
    rows = tables.imported_items(tables.import_rows(spark.sql(_ROWS)), F.lit("2024-01-01").cast("timestamp"))
    return flat(rows.select("filename", "category", "content", "page", "bbox"))


@query("lineitem", sql=f"SELECT id FROM ({D.ITEMS}) i WHERE category IN ('RRN', 'Card') AND page + 1 IN (1, 3, 5)")
def list_filter(spark):
    pages = text.page_list(F.lit("1, 3x  5,-2,0"))
    return review.list_filter(spark.sql(D.ITEMS), ["RRN", "Card"], pages).select("id")


@query("lineitem", sql=f"SELECT id, row_number() OVER (PARTITION BY doc_id ORDER BY {_LABEL} DESC, page DESC, y DESC, x DESC, id DESC) AS place FROM ({D.ITEMS}) i")
def list_sort(spark):
    w = Window.partitionBy("doc_id").orderBy(*review.list_order("category", descending=True))
    return boxed(spark.sql(D.ITEMS)).select("id", F.row_number().over(w).alias("place"))


@query("lineitem", sql=f"SELECT category, label, n, row_number() OVER (ORDER BY category = 'Custom', label) AS place FROM (SELECT category, {_LABEL} AS label, count(*) AS n FROM ({D.ITEMS}) i GROUP BY ALL)")
def facet_categories(spark):
    return review.facets(spark.sql(D.ITEMS))


@query("lineitem", sql=f"SELECT id, coalesce(lag(id) OVER w, id) AS previous, coalesce(lead(id) OVER w, id) AS next FROM ({D.ITEMS}) i WINDOW w AS (PARTITION BY doc_id ORDER BY page, y, x, id)")
def neighbours(spark):
    return review.neighbours(boxed(spark.sql(D.ITEMS))).select("id", "previous", "next")


@query("lineitem", sql=f"SELECT doc_id, count(*) AS n_found, min(page) AS first_page FROM ({D.ITEMS}) i WHERE origin = 'detected' GROUP BY ALL")
def find_summary(spark):
    return review.find_summary(spark.sql(D.ITEMS))


@query("lineitem", sql=f"SELECT id, category, CASE WHEN field = 'content' THEN trim(value) ELSE content END AS content FROM (SELECT *, CASE WHEN id % 2 = 0 THEN 'category' ELSE 'content' END AS field, CASE WHEN id % 3 = 0 THEN ' ' ELSE concat(' c', id % 50, ' ') END AS value FROM ({D.ITEMS}) i) WHERE field = 'content' AND trim(value) <> content UNION ALL SELECT id, concat('c', id % 50), content FROM ({D.ITEMS}) i WHERE id % 2 = 0 AND id % 3 <> 0")
def edit_cells(spark):
    items = spark.sql(D.ITEMS)
    edits = items.select("doc_id", "id", F.expr("if(id % 2 = 0, 'category', 'content')").alias("field"), F.expr("if(id % 3 = 0, ' ', concat(' c', id % 50, ' '))").alias("value")).distinct()
    return review.edit_cells(items, edits, F.current_timestamp()).select("id", "category", "content")


_BAND = "CASE WHEN confidence >= 0.8 THEN 'high' WHEN confidence >= 0.5 THEN 'middle' ELSE 'low' END"


@query("lineitem", sql=f"SELECT category, validation, band, count(*) AS n FROM (SELECT *, {_BAND} AS band FROM ({D.ITEMS}) i) GROUP BY ROLLUP (category, validation, band)")
def summary_rollup(spark):
    return review.summary(spark.sql(D.ITEMS))


# Geometry edits.

_EDGES = "min(x) OVER w AS l, max(x + width) OVER w AS r, min(y) OVER w AS t, max(y + height) OVER w AS b"


@query("lineitem", sql=f"SELECT id, round(x + least(greatest(0.4, -l), 1 - r), 4) AS x, round(y + least(greatest(-0.3, -t), 1 - b), 4) AS y, round(width, 4) AS width, round(height, 4) AS height FROM (SELECT *, {_EDGES} FROM ({D.ITEMS}) i WINDOW w AS (PARTITION BY doc_id, page))")
def group_shift(spark):
    return flat(review.shift_group(boxed(spark.sql(D.ITEMS)), 0.4, -0.3).select("id", "bbox"))


@query("lineitem", sql=f"SELECT id, round(0.1 + (x - l) * (0.5 / (r - l)), 4) AS x, round(0.2 + (y - t) * (0.25 / (b - t)), 4) AS y, round(width * (0.5 / (r - l)), 4) AS width, round(height * (0.25 / (b - t)), 4) AS height FROM (SELECT *, {_EDGES} FROM ({D.ITEMS}) i WINDOW w AS (PARTITION BY doc_id, page))")
def group_scale(spark):
    return flat(review.scale_group(boxed(spark.sql(D.ITEMS)), 0.1, 0.2, 0.5, 0.25).select("id", "bbox"))


_TEMPLATE = "SELECT id AS n, x, y, width, height FROM (" + D.WIDE_ITEMS + ") i WHERE doc_id = 1 AND page = 0"
_ANCHORS = "SELECT o_orderkey AS doc_id, 0 AS page, CAST(o_orderkey % 128 AS DOUBLE) / 128 AS x, CAST(o_custkey % 128 AS DOUBLE) / 128 AS y FROM orders"


@query("orders", "lineitem", sql=f"WITH t AS ({_TEMPLATE}), e AS (SELECT min(x) AS l, min(y) AS t, max(x + width) - min(x) AS w, max(y + height) - min(y) AS h FROM t) SELECT doc_id, page, n, round(greatest(least(a.x, 1 - e.w), 0) + t.x - e.l, 4) AS x, round(greatest(least(a.y, 1 - e.h), 0) + t.y - e.t, 4) AS y, round(width, 4) AS width, round(height, 4) AS height FROM ({_ANCHORS}) a, t, e")
def template_stamp(spark):
    return review.stamp_sides(boxed(spark.sql(_TEMPLATE)), D.spread(spark.sql(_ANCHORS), "doc_id"), most=None, digits=4)


_MARGINS = "SELECT o_orderkey, CAST(o_orderkey % 13 AS DOUBLE) / 10 - 0.1 AS t, CAST(o_orderkey % 7 AS DOUBLE) / 6 AS b, CAST(o_custkey % 11 AS DOUBLE) / 10 AS l, CAST(o_custkey % 5 AS DOUBLE) / 4 AS r FROM orders"
_ONE = ", ".join(f"least(greatest({c}, 0.0), 1.0) AS {c}" for c in "tblr")


@query("orders", sql=f"SELECT o_orderkey, round(greatest(t - v, 0), 6) AS t, round(greatest(b - v, 0), 6) AS b, round(greatest(l - h, 0), 6) AS l, round(greatest(r - h, 0), 6) AS r FROM (SELECT *, greatest((t + b - 0.98) / 2, 0) AS v, greatest((l + r - 0.98) / 2, 0) AS h FROM (SELECT o_orderkey, {_ONE} FROM ({_MARGINS})))")
def clamp_margins(spark):
    m = spark.sql(_MARGINS).select("o_orderkey", geometry.clamp_margins(*map(F.col, "tblr")).alias("m"))
    return m.select("o_orderkey", *(F.round(F.col(f"m.{n}"), 6).alias(n[0]) for n in ("top", "bottom", "left", "right")))


@query("lineitem", sql=f"SELECT id, round(x * 600, 4) AS px, round((1 - y - height) * 842, 4) AS bottom, width >= 0.01 AND height >= 0.01 AS large FROM ({D.ITEMS}) i")
def box_units(spark):
    b = F.col("bbox")
    return boxed(spark.sql(D.ITEMS)).select("id", F.round(geometry.to_pixels(b, F.lit(600), F.lit(800))["x"], 4).alias("px"), F.round(geometry.to_points(b, F.lit(595), F.lit(842))["bottom"], 4).alias("bottom"), geometry.large_enough(b).alias("large"))


# Profiles, outline, log.

_TWO = "SELECT CAST(floor(CAST(doc_id AS DOUBLE) / 8) AS BIGINT) AS doc_id, CAST(row_number() OVER (PARTITION BY CAST(floor(CAST(doc_id AS DOUBLE) / 8) AS BIGINT) ORDER BY doc_id) - 1 AS INT) AS page_index, CASE WHEN doc_id % 9 = 0 THEN '  ' ELSE text END AS text FROM documents"


@query("documents", sql=f"SELECT doc_id, concat('sha256:', sha256(trim(regexp_replace(concat(string_agg(text, chr(10) ORDER BY page_index), chr(10)), '[\\s\\x0b]+', ' ', 'g')))) AS text_fingerprint FROM ({_TWO}) GROUP BY doc_id")
def fingerprint(spark):
    return profile.profile(spark.sql(_TWO)).select("doc_id", "text_fingerprint")


@query("documents", sql=f"SELECT doc_id, count(*) AS page_count, bool_or(trim(text) <> '') AS any_text, count(*) FILTER (trim(text) = '') AS n_textless FROM ({_TWO}) GROUP BY doc_id")
def text_layer_status(spark):
    return profile.profile(spark.sql(_TWO)).select("doc_id", "page_count", "any_text", F.size("textless_pages").alias("n_textless"))


@query("documents", sql=f"SELECT DISTINCT doc_id, CASE doc_id % 3 WHEN 0 THEN 'fresh' WHEN 1 THEN 'restore' ELSE 'differs' END AS decision FROM ({_TWO})")
def same_source(spark):
    pages = spark.sql(_TWO)
    saved = pages.where("doc_id % 3 > 0").withColumn("text", F.when(F.col("doc_id") % 3 == 1, F.concat(F.lit(" "), "text")).otherwise(F.concat(F.lit("other "), "text")))
    return profile.same_source(profile.profile(pages), profile.profile(saved))


@query("part", sql=f"WITH RECURSIVE o AS ({D.OUTLINE}), w AS (SELECT doc_id, node_id, [CAST(ord AS BIGINT)] AS path FROM o WHERE parent_id IS NULL UNION ALL SELECT o.doc_id, o.node_id, list_append(w.path, CAST(o.ord AS BIGINT)) FROM o JOIN w ON o.doc_id = w.doc_id AND o.parent_id = w.node_id) SELECT doc_id, node_id, len(path) - 1 AS depth, row_number() OVER (PARTITION BY doc_id ORDER BY path, node_id) - 1 AS position FROM w")
def outline_preorder(spark):
    return profile.preorder(spark.sql(D.OUTLINE)).select("doc_id", "node_id", "depth", "position")


_VISITS = "SELECT DISTINCT CAST(floor(CAST(l_partkey AS DOUBLE) / 128) AS BIGINT) AS doc_id, CAST(l_orderkey % 100 AS INT) AS page_index FROM lineitem"


@query("part", "lineitem", sql=f"WITH o AS (SELECT *, node_id AS position FROM ({D.OUTLINE})) SELECT v.doc_id, v.page_index, (SELECT arg_max(o.node_id, CAST(o.page_index AS BIGINT) * 1000000000 + o.position) FROM o WHERE o.doc_id = v.doc_id AND o.page_index <= v.page_index) AS section FROM ({_VISITS}) v")
def section_asof(spark):
    outline = spark.sql(D.OUTLINE).withColumn("position", F.col("node_id"))
    return profile.section_of(spark.sql(_VISITS), outline)


@query("events", sql=f"WITH l AS ({D.LOG}), c AS ({D.CURSORS}) SELECT doc_id, item_id, arg_max(coalesce(after, '-'), seq) AS state FROM l JOIN c USING (doc_id) WHERE seq <= cursor GROUP BY ALL HAVING arg_max(coalesce(after, '-'), seq) <> '-'")
def log_state_as_of(spark):
    log = spark.sql(D.LOG)
    base = log.select("doc_id", "item_id", F.lit(None).cast("string").alias("state")).distinct()
    return changelog.state_as_of(base, log, spark.sql(D.CURSORS))


@query("events", sql=f"WITH l AS ({D.LOG}), n AS (SELECT *, CASE WHEN group_id = lag(group_id) OVER w THEN 0 ELSE 1 END AS new FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY seq)), s AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY seq) AS step FROM n), e AS (SELECT *, min(seq) OVER (PARTITION BY doc_id, step) AS f, max(seq) OVER (PARTITION BY doc_id, step) AS z FROM s) SELECT doc_id, cursor, max(CASE WHEN seq = cursor THEN f - 1 END) AS undo_to, max(CASE WHEN seq = cursor + 1 THEN z END) AS redo_to FROM e JOIN ({D.CURSORS}) c USING (doc_id) GROUP BY ALL")
def undo_span(spark):
    return changelog.undo_redo(spark.sql(D.LOG), spark.sql(D.CURSORS))


_ENTRIES = "SELECT DISTINCT user_id AS doc_id, 1 AS n, 'edit' AS action, 'new' AS item_id, 'x' AS after, CAST(NULL AS VARCHAR(1)) AS group_id FROM events"


@query("events", sql=f"WITH c AS ({D.CURSORS}) SELECT doc_id, seq, item_id FROM ({D.LOG}) l JOIN c USING (doc_id) WHERE seq <= cursor UNION ALL SELECT doc_id, cursor + 1, 'new' FROM c")
def log_truncate(spark):
    log = spark.sql(D.LOG).select("doc_id", "seq", "item_id", "action", "after", "group_id")
    return changelog.record(log, spark.sql(D.CURSORS), spark.sql(_ENTRIES)).select("doc_id", "seq", "item_id")


# Layout mode and streams, which SQL does not express; tests hold them against fixed cases and the batch result.


@query("customer")
def detect_layout_items(spark):
    glyphs = F.transform(F.split("text", ""), lambda c, i: F.struct(c.alias("ch"), (0.01 * i).alias("x"), F.lit(0.5).alias("y"), F.lit(0.01).alias("w"), F.lit(0.02).alias("h")))
    pages = spark.sql(D.SENTENCES).select("doc_id", "page_index", glyphs.alias("glyphs"))
    return flat(detect_layout(pages).select("doc_id", "id", "category", "content", "confidence", "validation", "bbox"))


def stream_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Finds of a stream over the documents' files, run to their end into a table in the shared folder."""
    folder, files = runs.folder_of(spark, sf_dir, "documents")
    pages = spark.readStream.schema(spark.read.parquet(f"{sf_dir}/documents.parquet").schema).option("pathGlobFilter", files).parquet(folder)
    found = runs.to_end(detection.stream_finds(pages.select("doc_id", F.lit(0).alias("page_index"), "text")))
    return found.select("doc_id", "category", "status", "start", "content")


QUERIES["stream_detect"] = stream_detect
ORACLE_SQL["stream_detect"] = f"WITH {_ALL} SELECT doc_id, category, status, s AS start, m AS content FROM found"
