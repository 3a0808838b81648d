"""Sources and sinks: glyph tables, review documents as JSON, exchange tables, settings."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkveil.functions import geometry
from inkveil.functions.text import box_string, category_code, category_label, iso_utc, parse_box

#: The header of an exchange table, in order.
EXCHANGE_HEADER = ("$파일명", "구분", "내용", "페이지", "$bbox", "수정추가시각")
#: Ending of a review document beside its source file.
REVIEW_SUFFIX = ".review.json"

BOX = "struct<x:double,y:double,width:double,height:double>"
MARGINS = "struct<top:double,bottom:double,left:double,right:double>"
ITEM = (
    f"struct<id:string,origin:string,page:int,bbox:{BOX},original_bbox:{BOX},category:string,content:string,pattern_type:string,"
    "confidence:double,validation:string,modified:boolean,created_at:string,updated_at:string>"
)
REVIEW_SCHEMA = (
    "doc_id bigint, source struct<filename:string,path:string,page_count:int,text_fingerprint:string,created_at:string,updated_at:string>, "
    "pages array<struct<page_number:int,page_width:double,page_height:double,unit:string,text_layer_status:string>>, "
    f"items array<{ITEM}>, history struct<entries:array<struct<seq:int,timestamp:string,action:string,item_id:string,before:{ITEM},after:{ITEM},group_id:string>>,cursor:int>, "
    f"exclusion_zones array<struct<page_index:int,margins:{MARGINS}>>"
)


def page_glyphs(raw: DataFrame) -> DataFrame:
    """Glyphs (``doc_id, page_index, n, ch, left, bottom, right, top, page_width, page_height``; points from the bottom left) as one array for each page, relative to the top left; glyphs without a box are left out."""
    w, h = F.col("page_width"), F.col("page_height")
    rows = raw.where(F.col("left").isNotNull() & F.col("bottom").isNotNull() & F.col("right").isNotNull() & F.col("top").isNotNull())
    glyph = F.struct("n", "ch", (F.col("left") / w).alias("x"), (1 - F.col("top") / h).alias("y"), ((F.col("right") - F.col("left")) / w).alias("w"), ((F.col("top") - F.col("bottom")) / h).alias("h"))
    return rows.groupBy("doc_id", "page_index").agg(F.transform(F.array_sort(F.collect_list(glyph)), lambda g: g.dropFields("n")).alias("glyphs"))


def read_reviews(spark: SparkSession, path: str, pretty: bool = False) -> DataFrame:
    """Review documents: one to a line, or with ``pretty`` one to a file over any number of lines.

    Unknown fields are ignored, missing zones and items are empty, broken JSON is an error; a path that
    does not exist has no documents.
    """
    try:
        docs = spark.read.schema(REVIEW_SCHEMA).option("mode", "FAILFAST").option("multiLine", pretty).json(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        docs = spark.createDataFrame([], REVIEW_SCHEMA)
    empty = lambda c: F.coalesce(F.col(c), F.array().cast(docs.schema[c].dataType)).alias(c)
    return docs.select("doc_id", "source", empty("pages"), empty("items"), "history", empty("exclusion_zones"))


def write_reviews(docs: DataFrame, path: str) -> None:
    """Write review documents as JSON lines."""
    docs.write.json(path)


def review_path(path):
    """Where the review document of a source file lies."""
    return F.concat(path, F.lit(REVIEW_SUFFIX))


def assemble_reviews(sources: DataFrame, pages: DataFrame, items: DataFrame, history: DataFrame, zones: DataFrame, cursors: DataFrame | None = None) -> DataFrame:
    """One nested review document for each source, as :func:`read_reviews` reads it; each part is gathered by document before the join.

    ``cursors`` (``doc_id, cursor``) tells how much of a history holds; without it all does.
    """

    def part(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(*(c for c in df.columns if c != "doc_id")))).alias(name))

    out = sources.select("doc_id", F.struct(*(c for c in sources.columns if c != "doc_id")).alias("source"))
    for df, name in ((pages, "pages"), (items, "items"), (history, "history"), (zones, "exclusion_zones")):
        gathered = part(df, name)
        out = out.join(gathered, "doc_id", "left").withColumn(name, F.coalesce(F.col(name), F.array().cast(gathered.schema[name].dataType)))
    told = F.lit(None).cast("int")
    if cursors is not None:
        out, told = out.join(cursors.select("doc_id", F.col("cursor").alias("_cursor")), "doc_id", "left"), F.col("_cursor")
    return out.withColumn("history", F.struct(F.col("history").alias("entries"), F.coalesce(told, F.size("history")).cast("int").alias("cursor"))).drop("_cursor")


def exchange_rows(items: DataFrame, filenames: DataFrame) -> DataFrame:
    """Items as exchange rows: file name, label, content, 1-based page, box to six places, time of change."""
    b = F.col("bbox")
    rows = items.join(filenames, "doc_id").select("filename", category_label(F.col("category")), "content", F.col("page") + 1, box_string(b["x"], b["y"], b["width"], b["height"]), iso_utc(F.col("updated_at")))
    return rows.toDF(*EXCHANGE_HEADER)


def write_exchange(rows: DataFrame, path: str) -> None:
    """Write exchange rows as CSV with their header; an empty table gives the header alone."""
    rows.write.option("header", True).option("escape", '"').csv(path)


def read_exchange(spark: SparkSession, path: str) -> DataFrame:
    """Rows of exchange CSV files; rows of blanks are dropped. ``page`` is null and ``bad_page`` true where the page is no whole number."""
    schema = ", ".join(f"`{c}` string" for c in EXCHANGE_HEADER)
    rows = spark.read.schema(schema).option("header", True).option("escape", '"').option("multiLine", True).csv(path)
    return import_rows(rows)


def import_rows(rows: DataFrame) -> DataFrame:
    """Exchange rows by their header as columns ``filename, label, content, page, box, updated_at, bad_page``."""
    named = rows.toDF("filename", "label", "content", "page", "box", "updated_at")
    some = F.lit(False)
    for c in named.columns:
        some = some | (F.trim(F.coalesce(F.col(c), F.lit(""))) != "")
    number = F.trim("page").try_cast("double")
    whole = F.when(number == F.floor(number), number.try_cast("int"))
    return named.where(some).withColumn("bad_page", whole.isNull()).withColumn("page", whole)


def imported_items(rows: DataFrame, now) -> DataFrame:
    """Imported rows as items: page from 0 (0 at least), a box that does not parse is all zeros, nothing validated."""
    zero = geometry.box(*(F.lit(0.0) for _ in range(4)))
    return rows.select(
        "filename", F.lit("imported").alias("origin"), F.when(F.col("page").isNotNull(), F.greatest(F.col("page") - 1, F.lit(0))).alias("page"), F.coalesce(parse_box(F.col("box")), zero).alias("bbox"),
        category_code(F.col("label")).alias("category"), "content", F.lit(None).cast("double").alias("confidence"), F.lit("NotValidated").alias("validation"), now.alias("created_at"), now.alias("updated_at"),
    )


def read_excluded(spark: SparkSession, path: str) -> list[str]:
    """Excluded categories, a short list kept as JSON lines (``category``); none if nothing was saved."""
    try:
        return [r.category for r in spark.read.schema("category string").json(path).collect()]
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return []


def write_excluded(spark: SparkSession, path: str, categories: list[str]) -> None:
    spark.createDataFrame([(c,) for c in categories], "category string").write.mode("overwrite").json(path)
