"""Session builder and the shared scratch folder."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_SCRATCH: dict[str, str] = {}
_SHIPPED: set[str] = set()


def build_session(app: str = "hunkwise", master: str | None = None, **conf: str) -> SparkSession:
    """A session with AQE on and UTC time; ``conf`` uses ``__`` for dots."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    base = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    for k, v in (base | {k.replace("__", "."): v for k, v in conf.items()}).items():
        b = b.config(k, v)
    return b.getOrCreate()


def ship(spark: SparkSession) -> SparkSession:
    """Sends this package to the session's Python workers, once an application."""
    sc = spark.sparkContext
    if sc.applicationId not in _SHIPPED:
        _SHIPPED.add(sc.applicationId)
        here = os.path.dirname(os.path.abspath(__file__))
        to = os.path.join(os.path.realpath(tempfile.mkdtemp(prefix="hunkwise-")), "hunkwise_package.zip")
        with zipfile.ZipFile(to, "w") as z:
            for folder, _, names in os.walk(here):
                for n in names:
                    if n.endswith(".py"):
                        full = os.path.join(folder, n)
                        z.write(full, os.path.join("hunkwise", os.path.relpath(full, here)))
        sc.addPyFile(to)
    return spark


def scratch_root(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``.

    A folder of our own is made only where the setting is missing and all executors are on this machine,
    as in tests; elsewhere that is an error, as other machines would not see the folder.
    """
    app = spark.sparkContext.applicationId
    if app not in _SCRATCH:
        root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if not root and not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        _SCRATCH[app] = f"{root or tempfile.mkdtemp(prefix='hunkwise-')}/hunkwise-{uuid.uuid4().hex}"
        atexit.register(_drop, spark, _SCRATCH[app])
    return _SCRATCH[app]


def _drop(spark: SparkSession, path: str) -> None:
    try:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session has ended; the folder's owner clears it
        pass


def cut(df: DataFrame, name: str = "t", instead: DataFrame | None = None) -> DataFrame:
    """Writes ``df`` as Parquet in the shared folder and reads it back.

    This ends the lineage durably: a lost executor never repeats what stands before, and several
    readers share one computation.  ``instead`` is an earlier cut that nothing needs any more, as the
    round before in a loop; its table is removed.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    if instead is not None:
        _drop(spark, instead._cut_path)
    return out


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as it takes to be new among the frame's columns."""
    used, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in used:
            name = f"_{name}"
        used.add(name.lower())
        out.append(name)
    return out
