"""What the operators of this subpackage have in common: the shared folder, words, and joins that survive hot keys."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as the contracts of this subpackage define it.
SPACE = r"[\x20\x09-\x0D]"
NOT_SPACE = r"[^\x20\x09-\x0D]"

#: Copies of the small side of a salted join; a hot key's rows spread over as many tasks.
SALTS = 16


@functools.cache
def _own_folder(application: str) -> str:
    return tempfile.mkdtemp(prefix="spark-")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    A cluster names it in ``spark.checkpoint.dir``. Only in local mode, where all share one disk,
    an unset name is replaced by a temporary folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return "file://" + _own_folder(spark.sparkContext.applicationId)


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_folder(spark)}/inkveil/{uuid.uuid4().hex}/{name}"


def land(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` to the shared folder, with the writer's ``options``, and read it back.

    Cuts the lineage: a lost executor costs tasks that read this table, not the work that made it.
    """
    path = shared_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(text, upper, upper.lower())


def salt_of(*row: Column, salts: int = SALTS) -> Column:
    """A salt that a row keeps when its task is run again."""
    return F.pmod(F.xxhash64(*row), F.lit(salts)).cast("int")


def salted_left_join(left: DataFrame, right: DataFrame, key: str, row: list[str], salts: int = SALTS) -> DataFrame:
    """Left join on ``key`` where a key may hold a third of ``left``; ``right`` has one row for a key.

    ``row`` names the columns of ``left`` that tell its rows apart.
    """
    spread = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.withColumn("_salt", salt_of(*map(F.col, row), salts=salts)).join(spread, [key, "_salt"], "left").drop("_salt")


def unused(name: str, *frames: DataFrame) -> str:
    """``name``, led by as many underscores as no column of ``frames`` has."""
    taken = {c.lower() for f in frames for c in f.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def keep_rows(docs: DataFrame, verdicts: DataFrame, id_col: str, digest: Column, prefer: Column) -> DataFrame:
    """Rows of ``docs`` that ``verdicts`` (``doc_id, digest, kept``; a row for each of ``docs``) keep, with all their columns.

    A row is told by its id and digest, so rows that repeat an id with other texts have verdicts of
    their own. Of rows alike in both, the one with the greatest ``prefer`` stays; only those are aggregated.
    """
    i, d, row = unused("_id", docs), unused("_digest", docs), unused("_row", docs)
    known = verdicts.select(F.col("doc_id").alias(i), F.col("digest").alias(d), F.col("kept").alias(row))
    dropped = known.where(~F.col(row)).select(i, d).distinct()
    repeated = land(known.where(F.col(row)).groupBy(i, d).agg(F.count("*").alias(row)).where(F.col(row) > 1).select(i, d), "repeated")
    alike = F.col(id_col).cast("long").eqNullSafe(F.col(i)) & digest.eqNullSafe(F.col(d))
    if repeated.isEmpty():
        return docs.join(dropped, alike, "left_anti")
    plain = [f.name for f in docs.schema if f.dataType.typeName() not in ("map", "variant")]
    best = F.max_by(F.struct(*docs.columns), F.struct(prefer, F.xxhash64(*plain)))
    once = docs.join(repeated, alike, "left_semi").groupBy(F.col(id_col).alias(i), digest.alias(d)).agg(best.alias(row)).select(f"{row}.*")
    return docs.join(dropped.unionByName(repeated), alike, "left_anti").unionByName(once)
