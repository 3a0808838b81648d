"""Running a stream over stored files to its end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from inkveil.sources.scratch import work_folder


def folder_of(spark: SparkSession, sf_dir: str, table: str) -> tuple[str, str]:
    """Folder and file pattern under which a stream finds a table, which is one file or a folder of files."""
    path = f"{sf_dir}/{table}.parquet"
    files = spark.read.parquet(path).inputFiles()
    alone = len(files) == 1 and files[0].rstrip("/").endswith(f"/{table}.parquet")
    return (sf_dir, f"{table}.parquet") if alone else (path, "*.parquet")


def to_end(stream: DataFrame) -> DataFrame:
    """Run a stream over all files there are now, exactly once each, into a Parquet table; return the table."""
    folder = work_folder(stream.sparkSession)
    query = stream.writeStream.format("parquet").option("path", f"{folder}/table").option("checkpointLocation", f"{folder}/log").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/table")
