"""Session construction and the shared scratch folder used to cut lineage."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def build_session(cores: int | str = "*", app: str = "clinloom", **conf: str) -> SparkSession:
    """A local session with the settings the engine is tested under (UTC, AQE, ANSI)."""
    n = os.cpu_count() if cores == "*" else int(cores)
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", str(n))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", conf.pop("driver_memory", "8g"))
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_root(spark: SparkSession) -> str:
    """The folder every executor can reach: spark.checkpoint.dir when the cluster names one.

    Only where neither the setting nor a checkpoint directory exists and the master is local
    (tests) is a temporary folder of this machine taken; on a cluster that raises.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        named = current.get() if current.isDefined() else None
    if not named:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("name a folder that all executors share in spark.checkpoint.dir")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="clinloom-"))
        named = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return named.rstrip("/")


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the executors' Python this package, once for an application.

    Where the package was itself submitted with the application there is nothing to do.
    """
    app, package = spark.sparkContext.applicationId, Path(__file__).resolve().parent
    if app in _shipped or not package.is_dir():
        return
    target = Path(tempfile.mkdtemp(prefix="clinloom-ship-"), "clinloom.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for file in sorted(package.rglob("*.py")):
            z.write(file, file.relative_to(package.parent))
    spark.sparkContext.addPyFile(str(target))
    _shipped.add(app)


#: Rows of narrow columns that are worth a file of their own.
ROWS_A_FILE = 250_000


def materialize(df: DataFrame, tag: str, rows: int | None = None) -> DataFrame:
    """Write ``df`` as Parquet to the shared scratch folder and read it back.

    Cuts the lineage with a copy that outlives any executor, and gives the optimizer
    real sizes for what follows. Where about how many ``rows`` of narrow columns come is
    known, they go to no more files than that is worth, whatever the number of partitions.
    """
    if rows is not None:
        df = df.coalesce(rows // ROWS_A_FILE + 1)
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{tag}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out._scratch_path = path
    if _scopes:
        _scopes[-1].append(out)
    return out


_scopes: list[list[DataFrame]] = []


@contextmanager
def scratch() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """At its end, the tables materialized in it are deleted, but for those given to the function it yields."""
    own: list[DataFrame] = []
    kept: list[DataFrame] = []
    _scopes.append(own)

    def keep(df: DataFrame) -> DataFrame:
        kept.append(df)
        return df

    try:
        yield keep
    finally:
        _scopes.pop()
        left = {df._scratch_path for df in kept}
        discard(*[df for df in own if df._scratch_path not in left])
        if _scopes:
            _scopes[-1].extend(kept)


def discard(*frames: DataFrame) -> None:
    """Delete materialized frames that no later plan reads."""
    for df in frames:
        path = getattr(df, "_scratch_path", None)
        if path:
            jvm = df.sparkSession.sparkContext._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def release(spark: SparkSession) -> None:
    """Let the cleaner delete shuffle files of plans that nothing refers to any more.

    It acts on what the driver's garbage collector finds; a long query asks for that
    between its steps, so that its disk holds one step's shuffles and not all of them.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()
