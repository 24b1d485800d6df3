"""Session and scratch-folder helpers."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession


def get_session(master: str = "local[8]", shuffle_partitions: int = 8,
                app: str = "churnlens", driver_memory: str = "8g") -> SparkSession:
    """A session configured the way the library is tested.

    On a cluster, build the session with the cluster's own settings instead;
    operators only rely on AQE being available, never on these values.
    """
    return (
        SparkSession.builder.master(master).appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", driver_memory)
        .getOrCreate()
    )


def scratch_dir(spark: SparkSession) -> str:
    """Shared folder for intermediate files: the session's checkpoint dir.

    On a cluster ``spark.checkpoint.dir`` names a shared folder that every
    executor and the driver can read; it is only set here, to a fresh local
    temporary folder, when the session has none and runs in local mode (tests and
    local runs). A cluster session without one is an error: files written to a
    machine-local folder would be lost with the executor that wrote them.
    """
    sc = spark.sparkContext
    d = sc.getCheckpointDir()
    if not d:
        conf_dir = spark.conf.get("spark.checkpoint.dir", None)
        if not conf_dir and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder (for example on HDFS or an object store); "
                               "churnlens writes intermediate tables and checkpoints there")
        sc.setCheckpointDir(conf_dir or tempfile.mkdtemp(prefix="churnlens-"))
        d = sc.getCheckpointDir()
    return d.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unique path under the scratch folder."""
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _PATHS.setdefault(spark.sparkContext.applicationId, []).append(path)
    for made in getattr(_SCOPES, "open", ()):
        made.append(path)
    return path


_PATHS: dict[str, list[str]] = {}
_SCOPES = threading.local()


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Scratch paths that this thread takes within are deleted at its end: for steps whose result is stored elsewhere by then."""
    _SCOPES.open = [*getattr(_SCOPES, "open", ()), made := []]
    try:
        yield
    finally:
        _SCOPES.open = _SCOPES.open[:-1]
        delete_scratch(spark, made)


def delete_scratch(spark: SparkSession, paths: list[str]) -> None:
    """Delete paths that nothing reads any more."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    known = _PATHS.get(spark.sparkContext.applicationId, [])
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(conf).delete(path, True)
        if p in known:
            known.remove(p)
_CACHES: list[dict] = []


def scratch_cache() -> dict:
    """A dict for what stands in ``scratch_path``s, with the application's id first in its keys; ``remove_scratch`` forgets it."""
    _CACHES.append({})
    return _CACHES[-1]


_NAMES: dict[str, dict[str, str]] = {}


def scratch_name(spark: SparkSession, name: str, kind: str = "TABLE") -> str:
    """Note that the catalog's ``name`` stands on files in ``scratch_path``s, so that ``remove_scratch`` drops it too."""
    _NAMES.setdefault(spark.sparkContext.applicationId, {})[name] = kind
    return name


def remove_scratch(spark: SparkSession) -> int:
    """Delete what this application has written to ``scratch_path``s, and the catalog's names for it; returns how many paths there were.

    Frames that were read from them can't be used any more; a query called afterwards loads its tables anew. Checkpoints
    belong to Spark (``spark.cleaner.referenceTracking.cleanCheckpoints``).
    """
    app = spark.sparkContext.applicationId
    paths = _PATHS.pop(app, [])
    for name, kind in _NAMES.pop(app, {}).items():
        spark.sql(f"DROP {kind} IF EXISTS {name}")
    for cache in _CACHES:
        for key in [k for k in cache if k[0] == app]:
            del cache[key]
    delete_scratch(spark, paths)
    return len(paths)
