"""Session helpers.

The library never creates a session implicitly inside an operator; callers pass
their own.  ``local_session`` is for tests, benchmarks and the driver contract.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "textlab") -> SparkSession:
    """A local session with the settings the oracle comparison needs (UTC, AQE)."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder, setting a scratch one only when unset.

    On a cluster ``spark.checkpoint.dir`` names a shared folder (HDFS, S3, ...)
    and is respected as is.  Only a ``local`` session without one (tests, local
    runs) gets a fresh folder; on a cluster its absence is an error, because a
    folder of one machine would be unreadable from the others.
    """
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    if not conf_dir:
        if not _single_machine(sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share "
                               f"(master is {sc.master}); intermediates are written there")
        conf_dir = tempfile.mkdtemp(prefix="textlab-ckpt-")
        spark.conf.set("spark.checkpoint.dir", conf_dir)
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir() or conf_dir


def _single_machine(master: str) -> bool:
    """``local`` masters run driver and executors in one process; all others need a shared folder."""
    return master == "local" or master.startswith("local[")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared checkpoint folder for written intermediates."""
    base = ensure_checkpoint_dir(spark)
    return os.path.join(base, f"{name}-{uuid.uuid4().hex[:12]}")


#: Spark's switch to delete the shuffle files of a query when it has ended, not when the driver next collects garbage.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df, name: str, codec: str | None = None, by: str | None = None):
    """Cut lineage by writing ``df`` as parquet under the shared checkpoint folder
    and reading it back.

    Used before long or repeated stages: recovery after an executor loss starts
    from the written table, and later plans are a plain scan.  (``checkpoint()``
    cannot convert some plans holding DataFrame scalar subqueries; a write can.)
    ``codec`` is a Parquet codec for tables that Spark's default does not shrink.
    ``by`` is a last column of few values that each get a folder, to be deleted one by one.
    What was shuffled for the table is deleted once it is written, so the disk never
    holds the shuffles of several steps.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    before = spark.conf.get(CLEAN_UP, None)
    spark.conf.set(CLEAN_UP, "true")
    try:
        df.write.mode("overwrite").parquet(path, partitionBy=by, compression=codec)
    finally:
        if before is None:
            spark.conf.unset(CLEAN_UP)
        else:
            spark.conf.set(CLEAN_UP, before)
    return spark.read.schema(df.schema).parquet(path) if by else spark.read.parquet(path)  # without rows there is no folder


def discard(*tables, only: Iterable[str] | None = None) -> None:
    """Delete written intermediates that nothing will read again; ``only``: of a table written ``by`` a column, the folders of
    these names (``column=value``)."""
    for t in tables:
        spark = t.sparkSession
        folders = {p.rsplit("/", 1)[0] for p in t.inputFiles()}
        if only is not None:
            folders = {f for f in folders if f.rsplit("/", 1)[1] in only}
        else:
            folders = {f.rsplit("/", 1)[0] if "=" in f.rsplit("/", 1)[1] else f for f in folders}
        for f in folders:
            path = spark._jvm.org.apache.hadoop.fs.Path(f)
            path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``textlab`` importable in every Python worker (UDFs refer to its
    functions by module), once per application, with ``addPyFile``.

    The zip is built next to the shared checkpoint folder when that is a local
    path, else in a driver temp file that Spark's file server distributes.
    """
    try:
        sc = spark.sparkContext
        app = sc.applicationId
    except Exception:  # Spark Connect: the package must be installed on the cluster
        return
    if app in _SHIPPED:
        return
    import zipfile
    pkg = os.path.dirname(os.path.abspath(__file__))
    base = ensure_checkpoint_dir(spark)
    folder = base[len("file:"):] if base.startswith("file:") else tempfile.mkdtemp(prefix="textlab-code-")
    os.makedirs(folder, exist_ok=True)
    path = os.path.join(folder, f"textlab-{uuid.uuid4().hex[:8]}.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for root, _dirs, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(pkg)))
    sc.addPyFile(path)
    _SHIPPED.add(app)
