"""The change log: ``doc_id, seq, action, item_id, before, after, group_id``; one cursor for each document (``doc_id, cursor``).

Entries with ``seq`` up to the cursor are in force; ``seq`` counts from 1 without gaps.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def record(log: DataFrame, cursors: DataFrame, entries: DataFrame) -> DataFrame:
    """Drop what was undone, then append ``entries`` (``n`` orders them within a document)."""
    kept = log.join(cursors, "doc_id", "left").where(F.col("cursor").isNull() | (F.col("seq") <= F.col("cursor"))).drop("cursor")
    last = kept.groupBy("doc_id").agg(F.max("seq").alias("last"))
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("n"))
    new = entries.join(last, "doc_id", "left").withColumn("seq", (F.coalesce("last", F.lit(0)) + number).cast(log.schema["seq"].dataType)).drop("n", "last")
    return kept.unionByName(new)


def steps(log: DataFrame) -> DataFrame:
    """Add ``step``: entries in a row with one group id are one step of undo and redo; an entry without a group is a step of its own."""
    w = Window.partitionBy("doc_id").orderBy("seq")
    same = F.coalesce(F.col("group_id") == F.lag("group_id").over(w), F.lit(False))
    return log.withColumn("_new", F.when(same, 0).otherwise(1)).withColumn("step", F.sum("_new").over(w)).drop("_new")


def undo_redo(log: DataFrame, cursors: DataFrame) -> DataFrame:
    """For each cursor: ``undo_to`` (the cursor after an undo, null at the start) and ``redo_to`` (after a redo, null at the end)."""
    numbered = steps(log).join(cursors, "doc_id")
    span = Window.partitionBy("doc_id", "step")
    ends = numbered.withColumn("first", F.min("seq").over(span)).withColumn("last", F.max("seq").over(span))
    # A cursor within a group cuts it: undo goes to its start, redo to its end.
    return ends.groupBy("doc_id", "cursor").agg(F.max(F.when(F.col("seq") == F.col("cursor"), F.col("first") - 1)).alias("undo_to"), F.max(F.when(F.col("seq") == F.col("cursor") + 1, F.col("last"))).alias("redo_to"))


def state_as_of(base: DataFrame, log: DataFrame, cursors: DataFrame) -> DataFrame:
    """``doc_id, item_id, state`` at each document's cursor: the last ``after`` in force wins over the base (``doc_id, item_id, state``); a null one removes the item."""
    in_force = log.join(cursors, "doc_id").where(F.col("seq") <= F.col("cursor"))
    latest = in_force.groupBy("doc_id", "item_id").agg(F.max_by(F.struct("after"), "seq").alias("last"))
    joined = base.join(latest, ["doc_id", "item_id"], "full")
    state = F.when(F.col("last").isNotNull(), F.col("last.after")).otherwise(F.col("state"))
    return joined.select("doc_id", "item_id", state.alias("state")).where(F.col("state").isNotNull())


def undone_state(log: DataFrame, cursors: DataFrame, targets: DataFrame) -> DataFrame:
    """``doc_id, item_id, state`` that an undo to ``undo_to`` (``doc_id, undo_to``) gives the items it touches: what stood before the first undone entry."""
    undone = log.join(cursors, "doc_id").join(targets, "doc_id").where((F.col("seq") > F.col("undo_to")) & (F.col("seq") <= F.col("cursor")))
    return undone.groupBy("doc_id", "item_id").agg(F.min_by(F.struct("before"), "seq").alias("first")).select("doc_id", "item_id", F.col("first.before").alias("state"))


def delete_entries(items: DataFrame, group_id: str | None = None) -> DataFrame:
    """One delete entry for each item (``doc_id, id, state``); with a group id they are one step."""
    n = F.row_number().over(Window.partitionBy("doc_id").orderBy("id"))
    return items.select("doc_id", n.alias("n"), F.lit("delete").alias("action"), F.col("id").alias("item_id"), F.col("state").alias("before"), F.lit(None).cast(items.schema["state"].dataType).alias("after"), F.lit(group_id).cast("string").alias("group_id"))


def delete_listed(items: DataFrame, listed: DataFrame) -> DataFrame:
    """One delete entry, a step of its own, for each of ``items`` (``doc_id, id, state``) that ``listed`` (``doc_id, id``) names; names without an item are ignored."""
    return delete_entries(items.join(listed.select("doc_id", "id"), ["doc_id", "id"], "left_semi"))


def add_and_absorb(box: DataFrame, absorbed: DataFrame, group_id: str) -> DataFrame:
    """Entries of one step: the items that a new box absorbs go, then the box (``doc_id, id, state``) comes."""
    gone = delete_entries(absorbed, group_id)
    kind = box.schema["state"].dataType
    new = box.select("doc_id", F.lit(2**31 - 1).alias("n"), F.lit("add").alias("action"), F.col("id").alias("item_id"), F.lit(None).cast(kind).alias("before"), F.col("state").alias("after"), F.lit(group_id).alias("group_id"))
    return gone.unionByName(new)
