"""Helpers shared by the corpus operators: shared storage, tables, Arrow plumbing."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.session import ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which every executor sees.

    Only a local session (tests) may go without it; it then gets a folder of its own.
    """
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not path:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="lectern-")
        sc.setCheckpointDir(path)
    elif not sc.getCheckpointDir():
        sc.setCheckpointDir(path)
    return path if "://" in path or path.startswith("file:") else f"file://{path}"


def new_path(spark: SparkSession, kind: str) -> str:
    """A fresh folder name in the shared folder, removed when the driver ends."""
    path = f"{shared_dir(spark)}/lectern-{kind}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)
    except Exception:  # the session has ended; the cluster's own cleaning of the folder applies
        pass


def written(df: DataFrame, kind: str) -> DataFrame:
    """Cut the lineage: df as a Parquet table in the shared folder, read again.

    zstd works in heap buffers; snappy's direct buffers pile up over many small files.
    """
    spark = df.sparkSession
    path = new_path(spark, kind)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """Written tables of one operator, deleted as soon as nothing reads them any more."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.paths = spark, []

    def written(self, df: DataFrame, kind: str) -> DataFrame:
        path = new_path(self.spark, kind)
        df.write.option("compression", "zstd").parquet(path)
        self.paths.append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def clear(self) -> None:
        """Call it when all that was made from the tables is written itself."""
        for path in self.paths:
            _remove(self.spark, path)
        self.paths = []


def free_names(columns: list[str], *wanted: str) -> list[str]:
    """The wanted names, with underscores added to those that clash with a column (in any case)."""
    taken, out = {c.lower() for c in columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def without(df: DataFrame, *names: str) -> DataFrame:
    """df without columns of these names (in any case), which an operator is about to add."""
    mine = {n.lower() for n in names}
    return df.select(*[df[_quoted(c)] for c in df.columns if c.lower() not in mine])


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


#: Texts are long: batches of this size keep both sides of the exchange with Python small.
BATCH_BYTES = "8m"


def map_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow with small batches: the session's limit of bytes is lowered while it has its default."""
    spark = df.sparkSession
    ship(spark)
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == "67108864b":  # still the default
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return df.mapInArrow(fn, schema)


def crc32(col) -> F.Column:
    """Unsigned crc32 of the text's UTF-8 bytes; null text counts as empty."""
    return F.crc32(F.coalesce(col, F.lit("")).cast("binary"))


#: A table is broadcast up to so many bytes of values.
BROADCAST_BYTES = 16 << 20
_FIXED = {"boolean": 1, "tinyint": 1, "smallint": 2, "int": 4, "bigint": 8, "float": 4, "double": 8, "date": 4, "timestamp": 8}


def small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """df, marked for broadcast if its measured bytes stay within the limit; else it joins by a shuffle."""
    each, sums = 8, [F.count(F.lit(1))]
    for name, kind in df.dtypes:
        if kind in _FIXED:
            each += _FIXED[kind]
        elif kind.startswith("array<") and kind[6:-1] in _FIXED:
            sums.append(_FIXED[kind[6:-1]] * F.sum(F.size(_quoted(name))))
        elif kind in ("string", "binary"):
            sums.append(F.sum(F.octet_length(_quoted(name))))
        else:
            return df
    rows, *rest = df.agg(*[x.alias(f"x{k}") for k, x in enumerate(sums)]).first()
    return F.broadcast(df) if rows * each + sum(x or 0 for x in rest) <= limit else df


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that are no longer referenced."""
    gc.collect()
    spark._jvm.System.gc()
