"""Session, table reading and lineage cutting shared by all operators."""

from __future__ import annotations

import atexit
import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only when its rows times its row width stay below this many bytes.
BROADCAST_BYTES = 16 << 20


def session(cpus: str = "*", partitions: int = 8) -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", os.environ.get("LECTERN_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.driver.host", "127.0.0.1")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The named columns of a table; nothing else is read."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Only a local session may do without; it gets a temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="lectern-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session has ended; the folder goes with it
        pass


def written(df: DataFrame, name: str) -> str:
    """Write df to the shared folder; its path. The table stays until clear() or the end of the process."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lectern-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not _WRITTEN:
        atexit.register(clear, spark)
    _WRITTEN.append(path)
    return path


_WRITTEN: list[str] = []


def clear(spark: SparkSession) -> None:
    """Delete all tables written so far. Call it when a result has been written and nothing that was made before is read again."""
    while _WRITTEN:
        _delete(spark, _WRITTEN.pop())


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read back: the lineage ends there, and lost executors cost nothing."""
    return df.sparkSession.read.schema(df.schema).parquet(written(df, name))


def small(df: DataFrame, row_bytes: int, rows: int | None = None, limit: int = BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint if its counted rows are few enough, else df as it is, for a shuffled join."""
    n = df.count() if rows is None else rows
    return F.broadcast(df) if n * row_bytes <= limit else df


def folded(rows: DataFrame, key: str, order: list[str], start: Callable[[], object], step: Callable[[object, tuple], list[tuple]], schema: str, finish: Callable[[object, object], list[tuple]] | None = None) -> DataFrame:
    """The rows that step(state, row) gives for the rows of each key in order, and finish(key, state) behind the last; state is start() at first
    and changed in place. NULL keys are dropped.

    One shuffle and a sort; a task streams through its keys batch by batch and holds the state of one key, however many rows it has.
    """
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = state = None
        begun = False
        for pdf in batches:
            out: list[tuple] = []
            for row in pdf.itertuples(index=False):
                k = getattr(row, key)
                if not begun or k != own:
                    if begun and finish:
                        out += finish(own, state)
                    own, state, begun = k, start(), True
                out += step(state, row)
            yield pd.DataFrame(out, columns=names)
        if begun and finish:
            yield pd.DataFrame(finish(own, state), columns=names)

    return rows.where(F.col(key).isNotNull()).repartition(key).sortWithinPartitions(key, *order).mapInPandas(run, schema)


def words(text: Column) -> Column:
    """Maximal runs of letters and digits, lower case. NULL gives an empty array."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def ranked(df: DataFrame, keys: list[str], spread: Column, weight: Column, rows: int = 0) -> DataFrame:
    """Adds `before`: the weight of all rows of the same keys that come earlier in the order of spread (a bigint hash).

    Two levels, so that one key may hold any share of the rows: sums by key and bucket of the hash, a running sum over the
    buckets of a key, then a running sum inside each bucket. Of `rows` rows, where given, a bucket holds about a hundred thousand at most.
    Equal hashes are ordered by the columns of df.
    """
    from pyspark.sql import Window

    buckets = max(512, rows // 100_000)
    rest = [c for c in df.columns if c not in keys]
    spread_rows = df.withColumns({"_h": spread, "_w": weight}).withColumn("_b", F.pmod(F.shiftright("_h", 20), F.lit(buckets)).cast("int"))
    sums = spread_rows.groupBy(*keys, "_b").agg(F.sum("_w").alias("_s"))
    first = sums.withColumn("_p", F.sum("_s").over(Window.partitionBy(*keys).orderBy("_b")) - F.col("_s")).drop("_s")
    inside = Window.partitionBy(*keys, "_b").orderBy("_h", *rest).rowsBetween(Window.unboundedPreceding, 0)
    out = spread_rows.withColumn("_r", F.sum("_w").over(inside) - F.col("_w"))
    on = [out[k].eqNullSafe(first[k]) for k in keys] + [out["_b"] == first["_b"]]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    return out.join(first, cond).select(*[out[c] for c in df.columns], (F.col("_p") + F.col("_r")).alias("before"))
