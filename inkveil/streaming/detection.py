"""Detection and the review log on streams."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkveil.operators.detect import page_finds
from inkveil.operators.spans import blocks, cut
from inkveil.plans.rules import RULES, Rule


def stream_finds(pages: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> DataFrame:
    """A row for each find of a stream of pages; the same row-wise work as in batch, so no state."""
    flat = page_finds(pages, rules, text_col=text_col).select("doc_id", "page_index", blocks(F.col(text_col)).alias("_text"), F.explode("finds").alias("f"))
    content = cut(F.col("_text"), F.col("f.claim_start"), F.col("f.claim_end") - F.col("f.claim_start"))
    return flat.select("doc_id", "page_index", "f.*", content.alias("content")).drop("match")


def ordered_log(log: DataFrame, delay: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """Entries of a stream of change logs (``timestamp, doc_id, item_id, seq, action``), each once, counted by window and action.

    A repeated entry counts once while the watermark, ``delay`` behind the latest entry, has not passed it; an entry that comes
    later than that is left out. A window is given out when the watermark passes its end, and is final then.
    """
    once = log.withWatermark("timestamp", delay).dropDuplicatesWithinWatermark(["doc_id", "item_id", "seq"])
    return once.groupBy(F.window("timestamp", window), "action").agg(F.count("*").alias("n"))


def _folders(spark: SparkSession, path: str, kind: str) -> list[int]:
    """Numbers of the folders ``kind=n`` below a path that were written to their end, ascending; in any file system that Spark reads."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    root = hadoop.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(root)] if fs.exists(root) else []
    done = lambda n: fs.exists(hadoop.Path(f"{path}/{n}/_SUCCESS"))
    return sorted(int(n.removeprefix(f"{kind}=")) for n in names if n.startswith(f"{kind}=") and done(n))


def _drop(spark: SparkSession, path: str) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def save_latest(states: DataFrame, path: str, checkpoint: str, every: str | None = "800 milliseconds", compact: int = 50):
    """Start a query that keeps the last of a stream of states (``doc_id, at, state``) for each document; without ``every`` it ends with what is there.

    A batch has a folder of its own, ``batch=n``, written once and overwritten if the batch is run again. After each ``compact``
    batches the latest states so far are merged to ``base=n``, and what went into it is dropped; so a reader meets
    one base and fewer than ``compact`` batches, and a batch that is run again changes nothing that a base holds.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        _latest(batch.withColumn("batch", F.lit(epoch))).drop("written").write.mode("overwrite").parquet(f"{path}/batch={epoch}")
        bases = _folders(spark, path, "base")
        if (epoch + 1) % compact == 0 and (not bases or bases[-1] < epoch):
            _latest(_stored(spark, path)).write.mode("overwrite").parquet(f"{path}/base={epoch}")
            for old in (f"base={b}" for b in bases):
                _drop(spark, f"{path}/{old}")
            for old in (b for b in _folders(spark, path, "batch") if b <= epoch):
                _drop(spark, f"{path}/batch={old}")

    trigger = {"processingTime": every} if every else {"availableNow": True}
    return states.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def _latest(states: DataFrame) -> DataFrame:
    """For each document the state with the latest ``at``; of several the last batch's."""
    best = states.groupBy("doc_id").agg(F.max_by(F.struct("at", "state", "batch"), F.struct("at", "batch")).alias("s"))
    return best.select("doc_id", F.col("s.at").alias("at"), F.col("s.state").alias("state"), F.col("s.batch").alias("written"))


def _stored(spark: SparkSession, path: str) -> DataFrame:
    """All rows that count: the last base, and the batches after it."""
    bases = _folders(spark, path, "base")[-1:]
    after = [b for b in _folders(spark, path, "batch") if not bases or b > bases[0]]
    parts = [spark.read.parquet(f"{path}/base={n}").withColumnRenamed("written", "batch") for n in bases]
    parts += [spark.read.parquet(f"{path}/batch={n}").withColumn("batch", F.lit(n)) for n in after]
    if not parts:
        raise FileNotFoundError(f"no states below {path}")
    return reduce(DataFrame.unionByName, parts)


def latest_states(spark: SparkSession, path: str) -> DataFrame:
    """The state of each document with the latest ``at`` over all that :func:`save_latest` wrote; of several the last batch's."""
    return _latest(_stored(spark, path)).drop("written")
