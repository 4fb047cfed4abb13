"""Reading tables and files, and views over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.scalars import mime_of


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register_views(spark: SparkSession, sf_dir: str, names: list[str]) -> None:
    for n in names:
        read_table(spark, sf_dir, n).createOrReplaceTempView(n)


def eligible_responses(responses: DataFrame, view: str | None = None) -> DataFrame:
    """Responses that count: those not ignored after a cancel."""
    out = responses.where(~F.col("ignored_after_cancel"))
    if view:
        out.createOrReplaceTempView(view)
    return out


def uploaded_files(spark: SparkSession, path: str, most_bytes: int = 100 << 20) -> DataFrame:
    """Files with kind by magic bytes, sha256, and whether an upload would take them."""
    f = spark.read.format("binaryFile").load(path)
    mime = mime_of(F.col("content"))
    return f.select(
        "path", F.col("length").alias("bytes"), mime.alias("mime"), F.sha2("content", 256).alias("sha256"),
        ((mime == "application/pdf") & (F.col("length") <= most_bytes)).alias("accepted"),
    )


def lab_files(files: DataFrame, most_file: int = 32 << 20, most_all: int = 64 << 20, most_pages: int = 50) -> DataFrame:
    """Parse-lab admission: known kind, size of each file and of all together, number of pages."""
    totals = files.agg(F.sum("bytes").alias("all_bytes"), F.count(F.lit(1)).alias("pages"))
    return files.crossJoin(F.broadcast(totals)).withColumn(
        "accepted", F.col("mime").isNotNull() & (F.col("bytes") <= most_file) & (F.col("all_bytes") <= most_all) & (F.col("pages") <= most_pages)
    )


def snapshot(df: DataFrame) -> DataFrame:
    """Keep a result so that several outputs are made from the same rows."""
    return df.persist()
