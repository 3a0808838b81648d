"""Documents' profiles and identity, and the outline's sections."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkveil.functions.text import fingerprint, has_text
from inkveil.sources.scratch import land


def profile(pages: DataFrame, text_col: str = "text") -> DataFrame:
    """One aggregation of pages (``doc_id, page_index, text, page_width, page_height``; sizes may be absent).

    Returns ``doc_id, page_count, page_dimensions, text_fingerprint, any_text, textless_pages`` (1-based).
    """
    size = lambda c: (F.col(c) if c in pages.columns else F.lit(None)).cast("double").alias(c)
    page = F.struct((F.col("page_index") + 1).alias("page_number"), size("page_width"), size("page_height"), F.lit("pt").alias("unit"), has_text(F.col(text_col)).alias("text_layer_status"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    gathered = pages.groupBy("doc_id").agg(F.array_sort(F.collect_list(page)).alias("p"))
    return gathered.select(
        "doc_id",
        F.size("p").alias("page_count"),
        F.transform("p", lambda x: x.dropFields("text")).alias("page_dimensions"),
        fingerprint(F.transform("p", lambda x: x["text"])).alias("text_fingerprint"),
        F.exists("p", lambda x: x["text_layer_status"] == "HasText").alias("any_text"),
        F.transform(F.filter("p", lambda x: x["text_layer_status"] == "NoText"), lambda x: x["page_number"]).alias("textless_pages"),
    )


def same_source(opened: DataFrame, saved: DataFrame) -> DataFrame:
    """``doc_id, decision`` for each opened profile: ``fresh`` (nothing saved), ``restore`` (pages and fingerprint alike) or ``differs``. Names do not count."""
    fields = ("page_count", "page_dimensions", "text_fingerprint")
    kept = saved.select("doc_id", *(F.col(c).alias(f"_{c}") for c in fields), F.lit(True).alias("_saved"))
    alike = F.col(fields[0]).eqNullSafe(F.col(f"_{fields[0]}"))
    for c in fields[1:]:
        alike = alike & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return opened.join(kept, "doc_id", "left").select("doc_id", F.when(F.col("_saved").isNull(), "fresh").when(alike, "restore").otherwise("differs").alias("decision"))


def preorder(outline: DataFrame) -> DataFrame:
    """Add ``depth`` and ``position`` (pre-order, from 0) to outline nodes (``doc_id, node_id, parent_id, ord, title, page_index``).

    Paths double: in each round a node puts its ancestor's path before its own and goes on from there, so a
    tree takes as many rounds as the logarithm of its depth. A node's path of ordinals sorts parents
    before children. Nodes that reach no root are left out; parents in a circle are an error.
    """
    paths = land(outline.select("doc_id", "node_id", F.col("parent_id").alias("up"), F.array("ord").alias("path")))
    reach, nodes = 1, outline.count()
    while not paths.where(F.col("up").isNotNull()).isEmpty():
        if reach > nodes:
            raise ValueError("an outline has parents in a circle")
        above = paths.select("doc_id", F.col("node_id").alias("up"), F.col("up").alias("next"), F.col("path").alias("head"))
        climbed = paths.where(F.col("up").isNotNull()).join(above, ["doc_id", "up"]).select("doc_id", "node_id", F.col("next").alias("up"), F.concat("head", "path").alias("path"))
        paths, reach = land(paths.where(F.col("up").isNull()).unionByName(climbed)), 2 * reach
    paths = paths.drop("up")
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("path", "node_id")) - 1
    return outline.join(paths, ["doc_id", "node_id"]).withColumn("depth", F.size("path") - 1).withColumn("position", place).drop("path")


def section_of(pages: DataFrame, outline: DataFrame) -> DataFrame:
    """Add ``section`` (node id or null) to pages: the node with the greatest page up to theirs, of several the last in pre-order.

    As-of join without a range join: nodes and pages are sorted together, and the last node before a page is carried on.
    """
    nodes = outline.where(F.col("page_index").isNotNull()).select("doc_id", F.col("page_index").alias("at"), "position", F.col("node_id").alias("node"), F.lit(None).cast("struct<x:int>").alias("row"))
    marked = pages.withColumn("_row", F.struct(*pages.columns))
    rows = marked.select("doc_id", F.col("page_index").alias("at"), F.lit(2**31 - 1).alias("position"), F.lit(None).cast(outline.schema["node_id"].dataType).alias("node"), F.col("_row").alias("row"))
    both = rows.unionByName(nodes.withColumn("row", F.lit(None).cast(rows.schema["row"].dataType)))
    w = Window.partitionBy("doc_id").orderBy("at", "position").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("section", F.last("node", ignorenulls=True).over(w)).where(F.col("row").isNotNull()).select("row.*", "section")


def node_counts(outline: DataFrame) -> DataFrame:
    """For each document of an outline (``doc_id, node_id, parent_id, page_index``): nodes, nodes at the top, and nodes that lead to a page."""
    return outline.groupBy("doc_id").agg(F.count("*").alias("n_nodes"), F.count_if(F.col("parent_id").isNull()).alias("n_top"), F.count("page_index").alias("n_placed"))
