"""Session factory and the shared folder for intermediate tables."""

from __future__ import annotations

import atexit
import pickle
import shutil
import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

_own_dirs: dict[str, str] = {}
_swept: set[str] = set()


def get_spark(app: str = "docweave", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are written for; a running session is reused."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
    } | {k: str(v) for k, v in conf.items()}
    for k, v in settings.items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables: the session's ``spark.checkpoint.dir``.

    Where it is unset, a local session gets a temporary folder of its own (tests); a cluster is refused, for
    its executors share no folder that could be guessed.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        given = sc._jsc.sc().getCheckpointDir()
        named = given.get() if given.isDefined() else None
    if named:
        return named.rstrip("/")
    if sc.master.startswith("local") and not sc.master.startswith("local-cluster"):
        app = sc.applicationId
        if app not in _own_dirs:
            _own_dirs[app] = tempfile.mkdtemp(prefix="docweave-")
            atexit.register(shutil.rmtree, _own_dirs[app], True)
        return "file://" + _own_dirs[app]
    raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")


def _sweep(spark: SparkSession, folder: str) -> None:
    """Intermediate tables go with the application that wrote them, if it ends in order."""
    try:
        jvm = spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:
        pass


def materialize(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` as a compressed table in the shared folder and read it back.

    This cuts lineage in a way that survives the loss of executors, and the table is
    smaller than a checkpoint because it is columnar and compressed.
    """
    spark = df.sparkSession
    app = spark.sparkContext.applicationId
    folder = f"{shared_dir(spark)}/docweave/{app}"
    if app not in _swept:
        _swept.add(app)
        atexit.register(_sweep, spark, folder)
    path = f"{folder}/{name}-{uuid.uuid4().hex}"
    w = df.write.option("compression", "zstd")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._docweave_table = path
    return out


def release(df: DataFrame) -> None:
    """Delete the table behind what ``materialize`` gave, once nothing is to be read from it again."""
    path = getattr(df, "_docweave_table", None)
    if path:
        _sweep(df.sparkSession, path)


def share(spark: SparkSession, value: object):
    """Broadcast ``value`` so that workers without this package can load it: ``load_shared(shared)``.

    For values of a size bounded by construction only.
    """
    return spark.sparkContext.broadcast(cloudpickle.dumps(value))


def load_shared(shared) -> object:
    return pickle.loads(shared.value)
