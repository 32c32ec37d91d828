"""Session helpers shared by every operator: sessions, table loading and lineage cuts."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_kept: list[str] = []
_cleaning: set[str] = set()


def local_session(cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("plumbline")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(scan: DataFrame) -> DataFrame:
    """A scanned table in at least as many parts as there are cores: a small table of long texts may lie in one file.

    Large tables have more parts already and aren't shuffled. ``scan`` must be a plain scan, for its parts are counted.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: the cluster's ``spark.checkpoint.dir``.

    Only a local session without that setting gets a temporary folder; any other session without
    it is refused.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder:
            if not sc.master.startswith("local[") and sc.master != "local":
                raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="plumbline-checkpoint-")
        sc.setCheckpointDir(folder)
    if sc.applicationId not in _cleaning:
        # Spark's cleaner then removes a checkpoint once no plan refers to it
        sc._jsc.sc().conf().set("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        _cleaning.add(sc.applicationId)
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder, so that later stages read one fixed copy. Spark removes the files once nothing refers to them."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def keep(df: DataFrame) -> DataFrame:
    """As ``cut``, but as a Parquet table, which is smaller and read by column. ``tidy`` removes it, at the end of the program at the latest, unless the session is stopped before."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _kept.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def tidy(spark: SparkSession) -> None:
    """Remove the tables of ``keep``; results that weren't computed yet can't be computed after it."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    while _kept:
        path = jvm.org.apache.hadoop.fs.Path(_kept.pop())
        path.getFileSystem(conf).delete(path, True)


@atexit.register
def _tidy_at_exit() -> None:
    sc = SparkContext._active_spark_context
    if _kept and sc is not None and sc._jsc is not None:
        try:
            tidy(SparkSession.builder.getOrCreate())
        except Exception:  # the session is gone already
            pass


def one_delivery(df: DataFrame, key: str, arrival: str, columns: list[str]) -> DataFrame:
    """One row per ``key``: of records delivered more than once, the first to arrive.

    Only ``columns`` are kept beside the key. Equal arrivals are settled by the remaining values,
    so the choice never depends on row order. Rows without a key can't be told apart or named
    and are left out. The aggregate combines on the map side, so a key that holds a third of
    all rows shuffles one row per task.
    """
    rest = [c for c in columns if c not in (key, arrival)]
    kept = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct(arrival, *rest)).alias("_first"))
    return kept.select(key, *[F.col(f"_first.{c}").alias(c) for c in ([arrival] if arrival in columns else []) + rest])


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once per application."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    folder = Path(tempfile.mkdtemp(prefix="plumbline-code-"))
    archive = folder / "plumbline_code.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted(root.rglob("*")):
            if p.is_file() and "__pycache__" not in p.parts:
                z.write(p, p.relative_to(root.parent))
    sc.addPyFile(str(archive))
    _shipped.add(sc.applicationId)


def map_arrow(df: DataFrame, step: Callable, schema) -> DataFrame:
    """``df.mapInArrow`` with this package at hand in the workers."""
    ship(df.sparkSession)
    return df.mapInArrow(step, schema)
