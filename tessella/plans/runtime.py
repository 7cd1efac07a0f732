"""What every plan needs of its session: tables, lineage cuts, spreading of work."""

from __future__ import annotations

import atexit
import os
import re
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once per application: their Python may not find it otherwise."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    package = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp(prefix="tessella-")) / "tessella.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    context.addPyFile(str(archive))
    _SHIPPED.add(context.applicationId)


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """The Parquet table ``name`` (a file or a folder) of ``directory``."""
    ship(spark)
    return spark.read.parquet(f"{directory}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder for checkpoints.

    The session's ``spark.checkpoint.dir`` counts; only where neither it nor a
    folder set on the context exists (local tests) is one of our own set.
    """
    context = spark.sparkContext
    current = context._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    named = context.getConf().get("spark.checkpoint.dir", "")
    if not named:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="tessella-checkpoint-")
    context.setCheckpointDir(named)
    return context._jsc.sc().getCheckpointDir().get()


_WRITTEN: dict[str, SparkSession] = {}


def scratch(spark: SparkSession) -> str:
    """A fresh path in the shared checkpoint folder; ``release`` removes it."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/tessella-{uuid.uuid4().hex}"
    _WRITTEN[path] = spark
    return path


def cut(df: DataFrame) -> DataFrame:
    """``df`` written as a table to the shared checkpoint folder and read again; its lineage ends there.

    A table rather than a checkpoint: a checkpoint keeps the optimizer's
    estimates, and the estimated size of a join is the product of its sides',
    so that in a loop the mere numbers fill the driver's memory. The table's
    size is known from its files, so later joins are planned rightly as well.
    """
    return read_cut(df.sparkSession, [write_cut(df)], df)


def write_cut(df: DataFrame) -> str:
    """Writes ``df`` as ``cut`` does; the path."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return path


def read_cut(spark: SparkSession, paths: list[str], like: DataFrame) -> DataFrame:
    """Several tables of ``write_cut`` in one scan, whose plan doesn't grow with their number."""
    return spark.read.schema(like.schema).parquet(*paths)


@atexit.register
def release() -> None:
    """Removes the tables that ``cut`` wrote; what was computed from them can't be read any more."""
    while _WRITTEN:
        path, spark = _WRITTEN.popitem()
        try:
            jvm = spark.sparkContext._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # noqa: BLE001 - the session may have ended before the process
            continue


#: Operators of a plan after which the number of partitions is not that of the scan's splits.
_MOVED = re.compile(r"^[\s:+\-]*(?:Join|Aggregate|Generate|Window|Distinct|Repartition|RepartitionByExpression|MapInPandas|GlobalLimit|LocalRelation|LogicalRDD)\b", re.MULTILINE)


def spread(df: DataFrame, factor: int = 2) -> DataFrame:
    """``df`` in enough partitions for work that is heavy per row.

    A plain scan that has as many splits by its files' size stays as it is;
    anything else is dealt out evenly, else one task would do all of the work.
    Judged from the optimized plan alone: nothing is run for it.
    """
    session = df.sparkSession
    want = factor * session.sparkContext.defaultParallelism
    plan = df._jdf.queryExecution().optimizedPlan()
    split = int(session._jsparkSession.sessionState().conf().filesMaxPartitionBytes())
    if not _MOVED.search(plan.toString()) and sum(1 for x in plan.toString().split("\n") if "Relation" in x) == 1:
        if _file_bytes(plan) >= want * split:
            return df
    return df.repartition(want)


def _file_bytes(plan: object) -> int:
    """The size of the files that a plan scans: its leaves' own estimate, before columns are pruned."""
    leaves = plan.collectLeaves()
    return sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once: an expression used inside a lambda would be computed again for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def bytes_of(df: DataFrame) -> int:
    """Catalyst's estimate of the size of ``df`` in bytes."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def broadcast_if_small(df: DataFrame, limit: int = 32 << 20) -> DataFrame:
    """``df`` with a broadcast hint if its estimated size is within ``limit``; else as it is (a shuffled join)."""
    return F.broadcast(df) if bytes_of(df) <= limit else df


def local_session(cores: str = "*", partitions: int = 8) -> SparkSession:
    """A session for tests and the bench."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("TESSELLA_DRIVER_MEMORY", "8g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
