"""What the library asks of a session."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from itertools import chain
from typing import Any

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``; only a local session
    without one gets a folder of this machine."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir", None)
    if named is None and context._jsc.sc().getCheckpointDir().isEmpty():
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="lamina-"))
    elif context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(named)
    return context._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and written to the shared folder; survives the loss of executors."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def kept(df: DataFrame) -> DataFrame:
    """``df`` written once as a compressed table in the shared folder and read back; for rows that are
    read several times and of which readers want a few columns."""
    place = f"{checkpoint_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(place)
    return df.sparkSession.read.schema(df.schema).parquet(place)


def block_by_block(spark: SparkSession, blocks: Iterator[Any], plan: Callable[[Any], DataFrame]) -> DataFrame | None:
    """Union of ``plan(broadcast block)`` over all blocks; None without any. A single block stays
    lazy. Of several, each is run, its result written to the shared folder and its broadcast
    released before the next is read: driver and executors hold one block at a time."""
    first, second, out = next(blocks, None), next(blocks, None), None
    if second is None:
        return None if first is None else plan(spark.sparkContext.broadcast(first))
    for block in chain((first, second), blocks):
        shared = spark.sparkContext.broadcast(block)
        part = cut(plan(shared))
        shared.destroy()
        out = part if out is None else out.unionByName(part)
    return out


def ship(spark: SparkSession) -> None:
    """Gives Python workers this package where they would not find it: neither on PYTHONPATH nor
    in the folder the session was started in. Once a session; the archive lies in the shared folder."""
    import io
    import os
    import zipfile

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    context = spark.sparkContext
    if root in os.environ.get("PYTHONPATH", "").split(os.pathsep) or os.getcwd() == root or getattr(context, "_lamina_shipped", False):
        return
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for folder, _, files in os.walk(os.path.join(root, "lamina")):
            for f in files:
                if f.endswith(".py"):
                    path = os.path.join(folder, f)
                    z.write(path, os.path.relpath(path, root))
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{checkpoint_dir(spark)}/lamina.zip")
    out = place.getFileSystem(context._jsc.hadoopConfiguration()).create(place, True)
    out.write(bytearray(data.getvalue()))
    out.close()
    context.addPyFile(place.toString())
    context._lamina_shipped = True


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores where a scan of few small files would leave most of them idle; a scan
    of enough files or bytes stays as it is, without a shuffle. For scans that feed heavy work."""
    spark = df.sparkSession
    cores, files = spark.sparkContext.defaultParallelism, len(df.inputFiles())
    split = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    small = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() < cores * split
    return df.repartition(cores) if 0 < files < cores and small else df


def few_tasks(df: DataFrame) -> DataFrame:
    """``df`` in as many tasks as there are cores at most, without a shuffle; for tasks that each return k
    rows a query however few items they read."""
    return df.coalesce(df.sparkSession.sparkContext.defaultParallelism)
