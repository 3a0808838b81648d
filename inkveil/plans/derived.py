"""Tables that Spark and DuckDB derive from the given ones by the same SQL: the given corpus has no Korean text and no boxes.

Each is a SELECT that both dialects read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkveil.functions import geometry


#: Tables of few bytes whose rows are much work.
NARROW = ("customer",)


def spread(df: DataFrame, key: str) -> DataFrame:
    """Rows dealt by ``key`` over several tasks a core: a file is cut by its bytes, and one of a million narrow rows is one task."""
    spark = df.sparkSession
    return df.repartition(max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), key)


def load(spark: SparkSession, sf_dir: str, *tables: str) -> None:
    for t in tables:
        df = spark.read.parquet(f"{sf_dir}/{t}.parquet")
        (spread(df, df.columns[0]) if t in NARROW else df).createOrReplaceTempView(t)


#: Sentences by customer with numbers of every kind; resident numbers with a right check digit for two of three.
SENTENCES = """
  SELECT c_custkey AS doc_id, 0 AS page_index,
    CASE c_custkey % 8
      WHEN 0 THEN concat('연락처 010-', lpad(CAST(c_custkey * 7919 % 10000 AS VARCHAR(4)), 4, '0'), '-', lpad(CAST(c_custkey * 31 % 10000 AS VARCHAR(4)), 4, '0'), ' 입니다')
      WHEN 1 THEN concat('팩스 02-', lpad(CAST(c_custkey * 7919 % 10000 AS VARCHAR(4)), 4, '0'), '-', lpad(CAST(c_custkey * 31 % 10000 AS VARCHAR(4)), 4, '0'), ' 로')
      WHEN 2 THEN concat('주민등록번호 ', lpad(CAST(c_custkey * 7919 % 1000000 AS VARCHAR(6)), 6, '0'), '-', lpad(CAST(c_custkey * 104729 % 10000000 AS VARCHAR(7)), 7, '0'), ' 확인')
      WHEN 3 THEN concat('국민은행 ', CAST(100 + c_custkey % 900 AS VARCHAR(3)), '-', CAST(10 + c_custkey % 90 AS VARCHAR(2)), '-', lpad(CAST(c_custkey * 7919 % 1000000 AS VARCHAR(6)), 6, '0'), ' 입금')
      WHEN 4 THEN concat('생년월일 ', CAST(1950 + c_custkey % 60 AS VARCHAR(4)), '.', lpad(CAST(1 + c_custkey % 12 AS VARCHAR(2)), 2, '0'), '.', lpad(CAST(1 + c_custkey % 28 AS VARCHAR(2)), 2, '0'), '입니다')
      WHEN 5 THEN concat('여권번호 M', lpad(CAST(c_custkey * 7919 % 100000000 AS VARCHAR(8)), 8, '0'), ' ok')
      WHEN 6 THEN concat('서울특별시 강남구 테헤란로 ', CAST(1 + c_custkey % 500 AS VARCHAR(3)), ' / 끝')
      ELSE concat('카드 4111-1111-', lpad(CAST(c_custkey * 7919 % 10000 AS VARCHAR(4)), 4, '0'), '-', lpad(CAST(c_custkey * 31 % 10000 AS VARCHAR(4)), 4, '0'), ' 결제')
    END AS text
  FROM customer
"""

#: Review items by order line, with boxes.
ITEMS = """
  SELECT CAST(floor(CAST(l_orderkey AS DOUBLE) / 128) AS BIGINT) AS doc_id, l_orderkey * 10 + l_linenumber AS id, CAST(l_linenumber - 1 AS INT) AS page,
    CASE l_suppkey % 10 WHEN 0 THEN 'manual' WHEN 1 THEN 'imported' ELSE 'detected' END AS origin,
    CASE l_partkey % 5 WHEN 0 THEN 'RRN' WHEN 1 THEN 'Email' WHEN 2 THEN 'Card' WHEN 3 THEN 'PhoneNumber' ELSE 'Custom' END AS category,
    CASE l_partkey % 3 WHEN 0 THEN 'Valid' WHEN 1 THEN 'Invalid' ELSE 'NotValidated' END AS validation,
    CAST(l_partkey % 101 AS DOUBLE) / 100 AS confidence,
    concat('c', CAST(l_partkey % 50 AS VARCHAR(4))) AS content,
    CAST(l_partkey % 64 AS DOUBLE) / 128 AS x, CAST(l_suppkey % 64 AS DOUBLE) / 128 AS y,
    CAST(1 + l_orderkey % 16 AS DOUBLE) / 128 AS width, CAST(1 + l_partkey % 8 AS DOUBLE) / 128 AS height
  FROM lineitem
"""

#: Glyphs by order line: a letter on a page each.
GLYPHS = """
  SELECT CAST(floor(CAST(l_orderkey AS DOUBLE) / 128) AS BIGINT) AS doc_id, CAST(l_linenumber - 1 AS INT) AS page, l_orderkey * 10 + l_linenumber AS n, chr(CAST(97 + l_partkey % 26 AS INT)) AS ch,
    CAST(l_partkey % 60 AS DOUBLE) / 64 AS x, CAST(l_suppkey % 60 AS DOUBLE) / 64 AS y, CAST(1 AS DOUBLE) / 64 AS width, CAST(1 + l_orderkey % 3 AS DOUBLE) / 128 AS height
  FROM lineitem
"""

#: Boxes drawn on pages, by order.
BOXES = """
  SELECT CAST(floor(CAST(o_orderkey AS DOUBLE) / 128) AS BIGINT) AS doc_id, o_orderkey AS id, CAST(o_orderkey % 7 AS INT) AS page,
    CAST(o_orderkey % 48 AS DOUBLE) / 64 AS x, CAST(o_custkey % 48 AS DOUBLE) / 64 AS y, CAST(8 AS DOUBLE) / 64 AS width, CAST(10 AS DOUBLE) / 64 AS height
  FROM orders
"""

#: The same with a fixed number of documents, so that each page's items, glyphs and boxes grow with the tables.
_GROWING = ("CAST(floor(CAST({} AS DOUBLE) / 128) AS BIGINT) AS doc_id", "{} % 500 AS doc_id")
_fixed = lambda sql, key, by: sql.replace(_GROWING[0].format(key), _GROWING[1].format(by))
WIDE_ITEMS = _fixed(ITEMS, "l_orderkey", "l_orderkey")
WIDE_GLYPHS = _fixed(GLYPHS, "l_orderkey", "l_orderkey")
WIDE_BOXES = _fixed(BOXES, "o_orderkey", "o_custkey")

#: A change log by user: each event sets or deletes an item.
LOG = """
  SELECT user_id AS doc_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INT) AS seq, ts, event_id,
    concat('i', CAST(event_id % 5 AS VARCHAR(2))) AS item_id,
    CASE WHEN event_type = 'click' THEN 'delete' ELSE 'edit' END AS action,
    CASE WHEN event_type = 'click' THEN NULL ELSE concat(event_type, CAST(event_id AS VARCHAR(12))) END AS after,
    CASE WHEN event_id % 3 = 0 THEN NULL ELSE concat('g', CAST(event_id % 2 AS VARCHAR(2))) END AS group_id
  FROM events
"""

#: A cursor by user, within the log or at its end.
CURSORS = "SELECT user_id AS doc_id, CAST(count(*) - count(*) % 4 AS INT) AS cursor FROM events GROUP BY user_id"

#: An outline by document: up to 128 nodes, the first three at the top, each of the others below the one at a third of its place.
OUTLINE = """
  SELECT CAST(floor(CAST(p_partkey AS DOUBLE) / 128) AS BIGINT) AS doc_id, p_partkey AS node_id,
    CASE WHEN p_partkey % 128 < 3 THEN NULL ELSE p_partkey - p_partkey % 128 + CAST(floor(CAST(p_partkey % 128 AS DOUBLE) / 3) AS BIGINT) END AS parent_id,
    p_size AS ord, p_name AS title, CASE WHEN p_size % 5 = 0 THEN NULL ELSE CAST(p_partkey % 97 AS INT) END AS page_index
  FROM part
"""

#: Each document is one page.
PAGES = "SELECT doc_id, CAST(0 AS INT) AS page_index, text FROM documents"


def boxed(df: DataFrame) -> DataFrame:
    """x, y, width, height as a struct ``bbox``."""
    return df.withColumn("bbox", geometry.box(*(F.col(c) for c in ("x", "y", "width", "height")))).drop("x", "y", "width", "height")


def flat(df: DataFrame) -> DataFrame:
    """The struct ``bbox`` as x, y, width, height, rounded for comparison."""
    return df.select(*(c for c in df.columns if c != "bbox"), *(F.round(F.col(f"bbox.{c}"), 4).alias(c) for c in ("x", "y", "width", "height")))
