"""The folder that driver and executors share, tables written there to cut lineage, and files in it."""

from __future__ import annotations

import tempfile
import uuid

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_KEY = "spark.checkpoint.dir"
#: Schemes that both Spark and the workers' own file access know: fixed values.
SCHEMES = ("file", "hdfs", "viewfs", "s3", "gs")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, with its scheme. Where the session names none, a local one serves a
    session on one machine; on a cluster that is an error."""
    where = spark.conf.get(_KEY, None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"{_KEY} must name a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="tablewarden-")
    where = qualified(spark, where)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def qualified(spark: SparkSession, where: str) -> str:
    """The path with the scheme that Spark itself would use for it."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(where)
    full = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(p).toString()
    return "file://" + full[5:] if full.startswith("file:/") and not full.startswith("file://") else full


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def filesystem(path: str) -> tuple[fs.FileSystem, str]:
    """The workers' own access to a folder of the shared one, for files that are no tables. A scheme that it
    does not know is refused by name, never taken for a local folder."""
    scheme = path.partition("://")[0] if "://" in path else None
    if scheme == "s3a":  # one store under two names
        path, scheme = "s3" + path[3:], "s3"
    if scheme not in SCHEMES:
        raise ValueError(f"`{path}`: files can be kept under {', '.join(SCHEMES)}; name such a folder in {_KEY}")
    return fs.FileSystem.from_uri(path)


def open_output(path: str):
    where, name = filesystem(path)
    where.create_dir(name.rsplit("/", 1)[0], recursive=True)
    return where.open_output_stream(name)


def open_input(path: str):
    where, name = filesystem(path)
    return where.open_input_stream(name)


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows, written as Parquet in the shared folder and read again: computed once, and safe when
    executors are lost later. The caller's session removes the folder when it is no longer needed."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bytes_of(df: DataFrame) -> int:
    """Bytes of a stored table's files, as the planner knows them from their listing."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


#: Stored (compressed) bytes up to which a table is broadcast.
BROADCAST_BYTES = 8 << 20
SALTS = 8


def looked_up(df: DataFrame, small: DataFrame, on: list[str], how: str = "inner", salts: int = SALTS) -> DataFrame:
    """``df`` joined with a stored table that has each key once.

    A table of few measured bytes is broadcast, so the rows of ``df`` stay where they are. A larger one is joined by
    key and salt: the rows of a hot key are dealt to ``salts`` tasks, each with its copy of the key's one row.
    """
    if bytes_of(small) <= BROADCAST_BYTES:
        return df.join(F.broadcast(small), on, how)
    spread = df.withColumn("__salt", F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int"))
    copies = small.withColumn("__salt", F.explode(F.array(*map(F.lit, range(salts)))))
    return spread.join(copies, [*on, "__salt"], how).drop("__salt")


#: Parts of all rows: a key with more than one of them is hot.
HOT_PARTS = 2000


def looked_up_counted(df: DataFrame, small: DataFrame, on: list[str], n: str, how: str = "inner") -> DataFrame:
    """``df`` joined with a stored table that grows with it, has each key once and knows how many rows of ``df``
    each key has (column ``n``, which stays). Rows of hot keys, of which there are ``HOT_PARTS`` at most, stay where
    they are, and all others are dealt out by key, at every size alike."""
    total = small.agg(F.coalesce(F.sum(n), F.lit(0))).first()[0]
    hot = stored(small.where(F.col(n) > max(total // HOT_PARTS, 1)), "hot-keys")
    if hot.isEmpty():
        return df.join(small.hint("merge"), on, how)
    keys = F.broadcast(hot.select(*on))
    return df.join(F.broadcast(hot), on).unionByName(df.join(keys, on, "left_anti").join(small.hint("merge"), on, how))


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def stored_at(df: DataFrame) -> str:
    """Where ``stored`` put a table."""
    return df.inputFiles()[0].rsplit("/", 1)[0] if df.inputFiles() else ""


def done_with(*tables: DataFrame) -> None:
    """Remove stored tables from which everything that is still needed has been written elsewhere."""
    for t in tables:
        if where := stored_at(t):
            remove(t.sparkSession, where)
