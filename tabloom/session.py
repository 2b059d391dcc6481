"""Session settings and the shared staging folder."""

from __future__ import annotations

import re
import tempfile
import uuid
import warnings
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}

_SHIPPED: set[str] = set()
_LOCAL_STAGING: dict[str, str] = {}
_MADE: dict[str, list[str]] = {}


def build_session(app: str = "tabloom", master: str | None = None, **conf: str) -> SparkSession:
    """A UTC session with adaptive execution; ``conf`` keys use ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Give this package to the workers of the session, once per application.

    Functions that run in a worker name their module; without this the workers find it only if their own search path
    happens to hold the package. The archive goes through Spark's file service, as any ``addPyFile``.
    """
    key = spark.sparkContext.applicationId
    if key in _SHIPPED:
        return
    _SHIPPED.add(key)
    package = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="tabloom-code-")) / f"{package.name}.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for source in sorted(package.rglob("*.py")):
            out.write(source, source.relative_to(package.parent))
    try:
        spark.sparkContext.addPyFile(str(archive))
    except Exception as failed:  # e.g. a gateway on another machine; workers that have the package installed need none
        warnings.warn(f"the package was not shipped, workers must have it installed: {failed}", stacklevel=2)


def staging_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    A local session without the setting gets a folder of its own. On a cluster
    a machine-local folder would be lost with its executor, so there it is an
    error to leave the setting out.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_STAGING:
        _LOCAL_STAGING[app] = tempfile.mkdtemp(prefix="tabloom-")
        spark.sparkContext.setCheckpointDir(_LOCAL_STAGING[app])
    return _LOCAL_STAGING[app]


def staging_path(spark: SparkSession, label: str) -> str:
    """A new path below the staging folder; nothing exists there yet."""
    path = f"{staging_root(spark).rstrip('/')}/{label}-{uuid.uuid4().hex[:12]}"
    _MADE.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def clear_staging(spark: SparkSession) -> int:
    """Delete what this application has staged, and say how many folders that were.

    A result may still read staged tables when it is returned, so nothing is deleted before its caller says so:
    call this once results are written where they belong.
    """
    made = _MADE.pop(spark.sparkContext.applicationId, [])
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    gone = 0
    for name in made:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
        gone += bool(path.getFileSystem(conf).delete(path, True))
    return gone
